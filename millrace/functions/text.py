"""Scalar text functions as Column expressions; only Unicode decomposition needs Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Patterns that decide what is kept.
OPTION_LINE = r"^\s*\(?([A-J])\s*[.):]\s*:?\s*(\S.*?)\s*$"
STATED = r"[Aa]nswer is:?\s*\**\s*\(?([A-J])\b"
DECISION = r"(?i)final decision is:?\s*\**\s*(yes|no|maybe)\b"
MEDICAL = (
    "(?i)patient|year-old|diagnos|treat|disease|symptom|clinic|drug|medic|syndrome|infect|cell|blood|pain|therap|dose|dosage|tumou?r|cancer|"
    "pregnan|surg|anatom|nerve|muscle|arter|vein|enzyme|gene|chromosom|mutation|bacteri|viru|viral|hormone|organ|tissue|heart|cardi|lung|pulmon|"
    "liver|hepat|kidney|renal|brain|neur|skin|derma|bone|fetus|fetal|trisomy|coagul|thromb|immun|antibod|vaccin|lesion|biopsy|pharmac|physiolog|"
    r"patholog|protein|receptor|plasma|serum|urin|glucose|insulin|diabet|hypert|anemi|fracture|lymph|dna|rna|mg\b"
)
LETTERS = "ABCDEFGHIJ"
LINE_BREAK = r"\R|[\x1c-\x1e]"


@F.pandas_udf(StringType())
def _decomposed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKD", x), na_action="ignore")


def strip(c: Column) -> Column:
    """Without white space, of any script, at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """Null to empty, anything else to text without outer white space."""
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def decomposed(c: Column) -> Column:
    """Compatibility-decomposed text. Plain ASCII, most text, stays as it is."""
    return F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(_decomposed(c))


def key_of_decomposed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " "), r"(?U)\s+", " "))


def question_key(c: Column) -> Column:
    """Decomposed, lower-cased, punctuation to blanks, blanks joined: the key that tells questions apart.

    A mark that decomposition splits off is no word character, so accents split words.
    """
    return key_of_decomposed(decomposed(F.coalesce(c, F.lit(""))))


def question_keys(texts: Column) -> Column:
    """The keys of an array of texts. They are decomposed as one text, as a Python function can't stand in a lambda."""
    apart = F.transform(texts, lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit("\0"), F.lit(" ")))
    return F.when(F.size(texts) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.split(decomposed(F.array_join(apart, "\0")), "\0", -1), key_of_decomposed))


def plain_words(c: Column) -> Column:
    """The runs of a-z and 0-9 of a lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def plain_text(c: Column) -> Column:
    return F.array_join(plain_words(c), " ")


def ascii_share(c: Column) -> Column:
    """Share of ASCII characters; null for an empty text."""
    return F.length(F.regexp_replace(c, r"[^\x00-\x7F]", "")) / F.nullif(F.length(c), F.lit(0))


def is_english(c: Column, least: float = 0.97) -> Column:
    return F.coalesce(ascii_share(c) >= least, F.lit(False))


def looks_medical(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(MEDICAL)


def lines(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), LINE_BREAK)


def option_map(line_array: Column) -> Column:
    """'A. x', 'A) x', '(A) x' or 'A.: x' lines as letter to text, first of a letter; null unless letters run A, B, ... with two at least."""
    found = F.filter(line_array, lambda x: x.rlike(OPTION_LINE))
    pairs = F.transform(found, lambda x: F.struct(F.regexp_extract(x, OPTION_LINE, 1).alias("k"), F.regexp_extract(x, OPTION_LINE, 2).alias("v")))
    letters = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["k"])))
    texts = F.transform(letters, lambda k: F.get(F.filter(pairs, lambda p: p["k"] == k), F.lit(0))["v"])
    run = F.slice(F.array(*map(F.lit, LETTERS)), 1, F.greatest(F.size(letters), F.lit(1)))
    return F.when((F.size(letters) >= 2) & (letters == run), F.map_from_arrays(letters, texts))


def stem_and_options(c: Column) -> tuple[Column, Column]:
    """A text's stem and the options written as its trailing lines (null: none, and the stem is the whole text)."""
    parts = lines(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+$", ""))
    body = F.array_max(F.transform(parts, lambda x, i: F.when(x.rlike(OPTION_LINE) | (strip(x) == ""), 0).otherwise(i + 1)))
    count = F.size(parts)
    options = option_map(F.when(body < count, F.slice(parts, body + 1, F.greatest(count - body, F.lit(0)))).otherwise(F.array().cast("array<string>")))
    stem = F.when(options.isNull(), clean(c)).otherwise(strip(F.array_join(F.slice(parts, 1, body), "\n")))
    return stem, options


def the_only(candidates: Column) -> Column:
    """The element of a one-element array, else null."""
    return F.when(F.size(candidates) == 1, F.get(candidates, F.lit(0)))


def match_option(answer: Column, options: Column) -> Column:
    """The letter of the one option an answer names: by its stated decision, else by equality or prefix, the longest first."""
    text = F.coalesce(answer, F.lit(""))
    said, want = plain_text(text), F.lower(F.regexp_extract(text, DECISION, 1))
    entries = F.transform(F.map_entries(options), lambda e: F.struct(e["key"].alias("key"), plain_text(e["value"]).alias("value")))
    decided = F.filter(entries, lambda e: e["value"] == want)
    near = F.filter(entries, lambda e: (e["value"] != "") & ((said == e["value"]) | said.startswith(F.concat(e["value"], F.lit(" ")))))
    longest = F.array_max(F.transform(near, lambda e: F.length(e["value"])))
    best = F.filter(near, lambda e: F.length(e["value"]) == longest)
    return F.when(want != "", the_only(decided)["key"]).when(said != "", the_only(best)["key"])


def stated_letters(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(STATED), F.lit(1))


def stated_letter(c: Column) -> Column:
    """The last 'answer is X'; null without one."""
    return F.try_element_at(stated_letters(c), F.lit(-1))


def thinking_and_final(text: Column) -> tuple[Column, Column]:
    """What stands before and behind the last </think>; null, null if it never closed."""
    t = F.coalesce(text, F.lit(""))
    final = F.substring_index(t, "</think>", -1)
    head = F.substring(t, F.lit(1), F.length(t) - F.length(final) - 8)
    inner = F.when(F.regexp_replace(head, r"(?U)^\s+", "").startswith("<think>"), F.regexp_replace(head, r"(?s)^.*?<think>", "")).otherwise(head)
    closed = t.contains("</think>")
    return F.when(closed, strip(inner)), F.when(closed, strip(F.replace(final, F.lit("<|im_end|>"), F.lit(""))))


def opening_think(text: Column) -> Column:
    """The thinking of a completion: up to its first </think>, without tags."""
    return strip(F.replace(F.substring_index(F.coalesce(text, F.lit("")), "</think>", 1), F.lit("<think>"), F.lit("")))
