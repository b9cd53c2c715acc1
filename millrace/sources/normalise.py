"""Raw rows of ten question sources to records: a projection and a validity filter each.

Each function takes a table with the source's own columns and idx (the row's number), and returns
records. Rows that aren't usable go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import clean, is_english, lines, looks_medical, match_option, option_map, or_null, plain_text, stated_letter, stem_and_options, the_only
from millrace.schema import RECORD

#: Which sub-sources count, and the shortest explanation.
MCQ_SETS, FREE_SETS, LEAST_EXPLANATION = ("medqa", "medmcqa", "MedXpertQA"), ("huatuo",), 80
YES_NO_MAYBE = {"A": "yes", "B": "no", "C": "maybe"}


def _records(df: DataFrame, keep: Column, **fields: Column) -> DataFrame:
    made = {f.name: fields.get(f.name, F.lit(None)).cast(f.dataType) for f in RECORD}
    return df.where(F.coalesce(keep, F.lit(False))).select(*(c.alias(n) for n, c in made.items()))


def _numbered(prefix: str) -> Column:
    return F.concat(F.lit(prefix + "-"), F.col("idx").cast("string"))


def _filled(*cs: Column) -> Column:
    out = F.lit(True)
    for c in cs:
        out = out & (c != "")
    return out


def _lettered(values: list[Column]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, "ABCD"[: len(values)])), F.array(*values))


def _letter_at(i: Column) -> Column:
    return F.get(F.array(*map(F.lit, "ABCD")), i.cast("int"))


def _split(df: DataFrame, text: Column) -> tuple[DataFrame, Column, Column]:
    """Stem and options as columns of their own: they are used several times, and nest deep."""
    stem, opts = stem_and_options(text)
    return df.withColumns({"_stem": stem, "_opts": opts}), F.col("_stem"), F.col("_opts")


def medmcqa(df: DataFrame, require_rationale: bool = True, single_choice: bool = True) -> DataFrame:
    opts = [clean(F.col(c)) for c in ("opa", "opb", "opc", "opd")]
    question, why = clean(F.col("question")), clean(F.col("exp"))
    keep = _filled(question, *opts) & F.col("cop").between(0, 3)
    if require_rationale:
        keep = keep & (F.length(why) >= LEAST_EXPLANATION)
    if single_choice:
        keep = keep & (F.lower(clean(F.col("choice_type"))) == "single")
    name = F.coalesce(or_null(clean(F.col("id"))), _numbered("medmcqa"))
    return _records(df, keep, id=name, source=F.lit("medmcqa"), kind=F.lit("mcq"), question=question, options=_lettered(opts), answer=_letter_at(F.col("cop")), rationale=why, subject=or_null(clean(F.col("subject_name"))))


def medqa(df: DataFrame) -> DataFrame:
    opts = F.transform_values("options", lambda k, v: clean(v))
    letter, question = F.upper(clean(F.col("answer_idx"))), clean(F.col("question"))
    whole = F.array_sort(F.map_keys("options")) == F.array(*map(F.lit, "ABCD"))
    keep = whole & F.forall(F.map_values(opts), lambda v: v != "") & letter.isin(list("ABCD")) & (question != "")
    return _records(df, keep, id=_numbered("medqa"), source=F.lit("medqa"), kind=F.lit("mcq"), question=question, options=opts, answer=letter, subject=or_null(clean(F.col("meta_info"))))


def _dialogue(df: DataFrame, source: str, keep: Column, question: Column, response: Column, reasoning: Column | None = None, **more: Column) -> DataFrame:
    return _records(df, keep, id=_numbered(source), source=F.lit(source), kind=F.lit("dialogue"), question=question, response=response, **({} if reasoning is None else {"reasoning": reasoning}), **more)


def medical_o1(df: DataFrame) -> DataFrame:
    """First form: thinking and response in one answer."""
    q, cot, r = (clean(F.col(c)) for c in ("Question", "Complex_CoT", "Response"))
    return _dialogue(df, "medical_o1", _filled(q, r), q, F.when(cot != "", F.concat_ws("\n\n", cot, r)).otherwise(r), rationale=or_null(cot))


def medical_o1_reasoning(df: DataFrame) -> DataFrame:
    q, cot, r = (clean(F.col(c)) for c in ("Question", "Complex_CoT", "Response"))
    return _dialogue(df, "medical_o1", _filled(q, cot, r), q, r, cot)


def medical_o1_direct(df: DataFrame) -> DataFrame:
    q, r = (clean(F.col(c)) for c in ("Question", "Response"))
    return _dialogue(df, "medical_o1_direct", _filled(q, r), q, r)


def chatdoctor(df: DataFrame) -> DataFrame:
    q, r = clean(F.col("input")), clean(F.col("output"))
    return _dialogue(df, "chatdoctor", _filled(q, r), q, r)


def medreason(df: DataFrame) -> DataFrame:
    name, q, why, answer = (clean(F.col(c)) for c in ("dataset_name", "question", "reasoning", "answer"))
    usable = _filled(q, why, answer) & is_english(F.concat(q, why))
    free = _dialogue(df, "medreason", usable & name.isin(*FREE_SETS), q, answer, why, subject=name)
    df, opts = df.withColumn("_opts", option_map(lines(clean(F.col("options"))))), F.col("_opts")
    df, letter = df.withColumn("_letter", match_option(answer, opts)), F.col("_letter")
    explanation = or_null(clean(F.when(answer.contains("Explanation:"), F.regexp_extract(answer, r"(?s)^.*?Explanation:(.*)$", 1))))
    mcq = _records(df, usable & name.isin(*MCQ_SETS) & letter.isNotNull(), id=_numbered("medreason"), source=F.lit("medreason"), kind=F.lit("mcq"), question=q, options=opts, answer=letter, rationale=explanation, subject=name, reasoning=why)
    return mcq.unionByName(free)


def r1_distill(df: DataFrame) -> DataFrame:
    q, why, r = (clean(F.col(f"`{c}`")) for c in ("question", "reasoning (reasoning_content)", "response (content)"))
    keep = _filled(q, why, r) & is_english(F.concat(q, r)) & looks_medical(F.concat_ws(" ", q, r))
    return _dialogue(df, "r1_distill", keep, q, r, why)


def ultramedical(df: DataFrame) -> DataFrame:
    turns = F.col("conversations")
    df, stem, opts = _split(df, clean(F.get(turns, F.lit(0))["value"]))
    why, answer = clean(F.try_element_at(turns, F.lit(-1))["value"]), F.upper(clean(F.col("answer")))
    keep = (F.size(turns) >= 2) & _filled(stem, why) & opts.isNotNull() & F.array_contains(F.map_keys(opts), answer) & (stated_letter(why) == answer) & is_english(F.concat(stem, why))
    name = F.coalesce(or_null(clean(F.col("id"))), _numbered("ultramedical"))
    return _records(df, keep, id=name, source=F.lit("ultramedical"), kind=F.lit("mcq"), question=stem, options=opts, answer=answer, subject=or_null(clean(F.col("type"))), reasoning=why)


def reasonmed(df: DataFrame) -> DataFrame:
    asked = F.regexp_replace(clean(F.col("instruction")), r"(?i)^\s*please answer the following multiple-choice question:?\s*", "")
    extra, out = clean(F.col("input")), clean(F.col("output"))
    df, stem, opts = _split(df, F.when(extra != "", F.concat_ws("\n", asked, extra)).otherwise(asked))
    tail = F.concat(F.lit(" "), plain_text(F.right(out, F.lit(800))), F.lit(" "))
    said = F.filter(F.map_entries(opts), lambda e: (plain_text(e["value"]) != "") & tail.contains(F.concat(F.lit(" "), plain_text(e["value"]), F.lit(" "))))
    stated = stated_letter(out)
    letter = F.when(F.coalesce(F.array_contains(F.map_keys(opts), stated), F.lit(False)), stated).otherwise(the_only(said)["key"])
    keep = opts.isNotNull() & _filled(stem, out) & is_english(F.concat(stem, out)) & letter.isNotNull()
    return _records(df, keep, id=_numbered("reasonmed"), source=F.lit("reasonmed"), kind=F.lit("mcq"), question=stem, options=opts, answer=letter, reasoning=out)


def pubmedqa(df: DataFrame, source: str = "pubmedqa") -> DataFrame:
    passages = F.filter(F.col("context.contexts"), lambda p: F.coalesce(p, F.lit("")) != "")
    q, decision = clean(F.col("question")), F.lower(clean(F.col("final_decision")))
    letter = F.when(decision == "yes", "A").when(decision == "no", "B").when(decision == "maybe", "C")
    opts = F.map_from_arrays(F.array(*map(F.lit, YES_NO_MAYBE)), F.array(*map(F.lit, YES_NO_MAYBE.values())))
    text = F.concat(F.lit("Context: "), F.array_join(passages, " "), F.lit("\n\nQuestion: "), q)
    name = F.concat(F.lit(source + "-"), F.coalesce(F.col("pubid").cast("string"), F.col("idx").cast("string")))
    return _records(df, (F.size(passages) > 0) & (q != "") & letter.isNotNull(), id=name, source=F.lit(source), kind=F.lit("mcq"), question=text, options=opts, answer=letter, rationale=or_null(clean(F.col("long_answer"))))


def mmlu(df: DataFrame) -> DataFrame:
    choices = F.transform("choices", lambda c: clean(c))
    q, subject = clean(F.col("question")), F.coalesce(or_null(clean(F.col("subject"))), F.lit("unknown"))
    keep = (F.size(choices) == 4) & F.forall(choices, lambda c: c != "") & (q != "") & F.col("answer").between(0, 3)
    opts = F.when(F.size(choices) == 4, F.map_from_arrays(F.array(*map(F.lit, "ABCD")), choices))
    name = F.concat(F.lit("mmlu-"), subject, F.lit("-"), F.col("idx").cast("string"))
    return _records(df, keep, id=name, source=F.lit("mmlu_medical"), kind=F.lit("mcq"), question=q, options=opts, answer=_letter_at(F.col("answer")), subject=subject)


NORMALISERS = {f.__name__: f for f in (medmcqa, medqa, medical_o1, medical_o1_reasoning, medical_o1_direct, chatdoctor, medreason, r1_distill, ultramedical, reasonmed, pubmedqa, mmlu)}


def load(df: DataFrame, name: str, seed: int = 0, limit: int = 0, reverse: bool = False, **options: bool) -> DataFrame:
    """Records of a source in a seeded order (reverse: from its other end), the first `limit` usable ones (0: all); fewer is an error."""
    from millrace.operators.guards import check_least

    made = NORMALISERS[name](df, **options) if options else NORMALISERS[name](df)
    if not limit:
        return made
    ids = F.xxhash64(F.lit(str(seed)), F.col("id"))
    return check_least(made.orderBy(ids.desc() if reverse else ids, "id").limit(limit), limit)
