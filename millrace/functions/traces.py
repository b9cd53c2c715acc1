"""Checks of reasoning traces and records, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import lines, plain_words, question_keys, stated_letter, stated_letters, strip, the_only

#: Patterns and lists.
CONCLUSION = r"(?is).*((?:conclusion|final answer|in summary|therefore).*)"
STOP_WORDS = "the and for with from that this are was not all none above both these its into than which may can".split()
ENDINGS = ".?!)]\"'*`"
FIRST_PERSON = r"(?i)^\s*(okay|ok|alright|so|hmm|let me|let's|i need|i'm|i am|first,? i|well|right)\b"
SELF_CHECK = r"(?i)\b(wait|hmm|let me (?:double[- ]check|think again|re-?check)|actually|on second thought)\b"
MARKDOWN = r"(?m)^\s*(#{1,6}\s|\*\*[^*]+\*\*\s*:?\s*$|\d+\.\s+\*\*)"
GRAPH_STYLE = r"(?i)finding reasoning paths|reasoning process:"
AMBIGUOUS = r"(?i)\b(all of the above|none of the above|both|all of these|none of these)\b"
ANSWER_GIVEN = r"(?i)\b(provided|expected) answer\b|\banswer (provided|key)\b|\bgiven answer\b"
AS_AN_AI = r"(?i)\bas an ai\b"
TAIL, SHORT_TAIL, STEM, LONG_LINE, REPEATS, SHORT_TRACE, FOREIGN = 1500, 400, 5, 30, 3, 200, 0.03


def stems(c: Column) -> Column:
    """Distinct five-letter beginnings of content words."""
    words = F.filter(plain_words(c), lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS))
    return F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, STEM)))


def conclusion(c: Column) -> Column:
    """From the last concluding word of the last 1,500 characters, else the last 400."""
    found = F.regexp_extract(F.right(c, F.lit(TAIL)), CONCLUSION, 1)
    return F.when(found != "", found).otherwise(F.right(c, F.lit(SHORT_TAIL)))


def named_option(trace: Column, options: Column) -> Column:
    """The one option all of whose stems are in the trace's conclusion; the one with most stems, null on a tie."""
    words = stems(conclusion(trace))
    sized = F.transform(F.map_entries(options), lambda e: F.struct(e["key"].alias("key"), stems(e["value"]).alias("s")))
    hits = F.filter(sized, lambda e: (F.size(e["s"]) > 0) & (F.size(F.array_except(e["s"], words)) == 0))
    most = F.array_max(F.transform(hits, lambda e: F.size(e["s"])))
    return the_only(F.filter(hits, lambda e: F.size(e["s"]) == most))["key"]


def answer_agreement(kind: Column, trace: Column, options: Column, answer: Column) -> Column:
    """n/a, agree, conflict (a stated letter), agree_text, other_text (a named option) or unstated."""
    keys = F.coalesce(F.map_keys(options), F.array().cast("array<string>"))
    letter, named = stated_letter(trace), named_option(trace, options)
    known = F.coalesce(F.array_contains(keys, letter), F.lit(False))
    none = (F.coalesce(kind, F.lit("")) != "mcq") | (F.coalesce(trace, F.lit("")) == "") | (F.size(keys) == 0)
    return (
        F.when(none, "n/a").when(known & letter.eqNullSafe(answer), "agree").when(known, "conflict")
        .when(named.isNull(), "unstated").when(named.eqNullSafe(answer), "agree_text").otherwise("other_text")
    )


def revised_answer(trace: Column, options: Column) -> Column:
    """Two different option letters are stated."""
    both = F.array_intersect(stated_letters(trace), F.coalesce(F.map_keys(options), F.array().cast("array<string>")))
    return F.size(both) > 1


def looping(c: Column) -> Column:
    """A line of 30 characters or more occurs three times: equal neighbours in the sorted lines, two steps apart."""
    long = F.array_sort(F.filter(F.transform(lines(c), strip), lambda x: F.length(x) >= LONG_LINE))
    return F.exists(F.arrays_zip(long.alias("a"), F.slice(long, REPEATS, 2**30).alias("b")), lambda z: F.coalesce(z["a"] == z["b"], F.lit(False)))


def unterminated(c: Column) -> Column:
    end = F.right(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+$", ""), F.lit(1))
    return (end != "") & ~end.isin(list(ENDINGS))


def style_flags(c: Column) -> dict[str, Column]:
    text = F.coalesce(c, F.lit(""))
    words = F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"(?U)\S+")))
    return {
        "first_person_open": text.rlike(FIRST_PERSON),
        "markdown": text.rlike(MARKDOWN),
        "kg_template": text.rlike(GRAPH_STYLE),
        "self_checks_per_1k_words": F.regexp_count(text, F.lit(SELF_CHECK)) * 1000.0 / words,
    }


def malformed(kind: Column, question: Column, options: Column, answer: Column, response: Column, reasoning: Column) -> Column:
    """What is wrong with a record, as a list of reasons."""
    empty = lambda x: strip(F.coalesce(x, F.lit(""))) == ""
    keys = F.coalesce(F.map_keys(options), F.array().cast("array<string>"))
    texts = question_keys(F.coalesce(F.map_values(options), F.array().cast("array<string>")))
    mcq = F.coalesce(kind == "mcq", F.lit(False))
    choice = F.when(F.size(keys) == 0, "mcq without options").when(~F.coalesce(F.array_contains(keys, answer), F.lit(False)), "answer not among options").when(F.size(F.array_distinct(texts)) < F.size(texts), "duplicate option text")
    return F.array_compact(F.array(F.when(empty(question), "empty question"), F.when(mcq, choice).when(empty(response), "empty response"), F.when(reasoning.isNotNull() & empty(reasoning), "empty reasoning")))


def ambiguous_options(options: Column) -> Column:
    return F.coalesce(F.exists(F.map_values(options), lambda v: v.rlike(AMBIGUOUS)), F.lit(False))


def label_of(source: Column, kind: Column) -> Column:
    return F.when(source == "medreason", F.concat(F.lit("medreason:"), kind)).otherwise(source)


def suspicious_flags(reasoning: Column, response: Column, options: Column) -> dict[str, Column]:
    """Named flags of a row; those of traces hold only where there is one."""
    trace = F.coalesce(reasoning, F.lit(""))
    has = trace != ""
    text = F.concat(trace, F.coalesce(response, F.lit("")))
    foreign = F.length(F.regexp_replace(text, r"[\x00-\x7F]", "")) / F.nullif(F.length(text), F.lit(0))
    return {
        "think_tags": has & (trace.contains("<think>") | trace.contains("</think>")),
        "answer_given": has & trace.rlike(ANSWER_GIVEN),
        "looping": has & looping(trace),
        "mid_sentence": has & unterminated(trace),
        "short_trace": has & (F.length(trace) < SHORT_TRACE),
        "non_ascii": F.coalesce(foreign > FOREIGN, F.lit(False)),
        "as_an_ai": text.rlike(AS_AN_AI),
        "two_answers": has & revised_answer(trace, options),
    }


def suspected_bad(kind: Column, question: Column, options: Column, answer: Column, response: Column, reasoning: Column) -> Column:
    trace = F.coalesce(reasoning, F.lit(""))
    bad = answer_agreement(kind, reasoning, options, answer) == "conflict"
    return bad | (F.size(malformed(kind, question, options, answer, response, reasoning)) > 0) | looping(trace) | trace.contains("<think>") | trace.contains("</think>")


