"""Queries over literal rows: normalisers, option lines, letters, chat text and audits, with the expected rows as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import chat, letters, text, traces
from millrace.operators import audit
from millrace.schema import RECORD, as_records, from_record_json, record_json
from millrace.sources import normalise

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _lit(x) -> str:
    if x is None:
        return "cast(null as varchar)"
    return str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def values(columns: str, rows: list[tuple]) -> str:
    return f"select * from (values {', '.join('(' + ', '.join(map(_lit, r)) + ')' for r in rows)}) t({columns})"


def golden(name: str, columns: str, expected: list[tuple]):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark)
        ORACLE[name] = values(columns, expected)
        return f

    return add


def _cases(spark, rows: list, schema: str):
    return spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "case_no int, " + schema)


LETTER_CASES = [
    ("The correct answer is C.", "C"), ("**Answer: B**", "B"), ("I would choose option (D) here", "D"), ("C is the correct choice.", "C"), ("A is wrong, B is incorrect, the answer is C", "C"),
    ("Option A is not right; option B is best.", "B"), ("The answer is A. Wait, the correct option is D.", "D"), ("some reasoning\nC", "C"), ("reasoning\n(B)", "B"), ("text\nC) Vitamin D", "C"),
    ("A 45-year-old man presents with fever.", None), ("Vitamin D is given.", None), ("", None), (None, None), ("option A is ruled out", None), ("select b", "B"),
]


@golden("extract_letter", "case_no, letter", [(i, b) for i, (_, b) in enumerate(LETTER_CASES)])
def _extract_letter(spark):
    return _cases(spark, [a for a, _ in LETTER_CASES], "text string").select("case_no", letters.extract_letter("text").alias("letter"))


FINAL_CASES = [("Answer: B\n\nBecause", ["A", "B"], "B"), ("Answer: (E) x", ["A", "B", "C", "D"], None), ("the answer is D", ["A", "B"], None), ("Answer: F. the answer is A", ["A", "B"], "A"), (None, ["A"], None), ("Answer: J", list("ABCDEFGHIJ"), "J")]


@golden("final_letter", "case_no, letter", [(i, c) for i, (_, _, c) in enumerate(FINAL_CASES)])
def _final_letter(spark):
    return _cases(spark, [x[:2] for x in FINAL_CASES], "text string, options array<string>").select("case_no", letters.final_letter("text", "options").alias("letter"))


SHORT_CASES = [
    ("Explanation: Ans. is 'c' i.e., Heparin acts fast. It binds antithrombin. It is given IV.", "Heparin acts fast. It binds antithrombin."), ("See Dr. Smith, p. 373. Next one.", "See Dr. Smith, p. 373. Next one."),
    (None, ""), ("   ", ""), ("One. Two! Three?", "One. Two!"), ("word " * 100, ("word " * 80).strip() + "..."),
]


@golden("short_explanation", "case_no, short", [(i, b) for i, (_, b) in enumerate(SHORT_CASES)])
def _short(spark):
    return _cases(spark, [a for a, _ in SHORT_CASES], "text string").select("case_no", letters.short_explanation("text").alias("short"))


OPTION_CASES = [
    ("Q?\nA. one\nB) two\n(C) three", "Q?", "A=one;B=two;C=three"), ("Q\nA.: x\n\nB. y\n", "Q", "A=x;B=y"), ("Q\nA. one\nC. three", "Q\nA. one\nC. three", None), ("no options", "no options", None),
    ("Q\nA. one\nB. two\nA. again", "Q", "A=one;B=two"), ("Q\nA. only", "Q\nA. only", None), (None, "", None), ("A. x\nB. y", "", "A=x;B=y"), ("Q\nA. x\ntail\nB. y", "Q\nA. x\ntail\nB. y", None),
]


@golden("option_lines", "case_no, stem, options", [(i, b, c) for i, (_, b, c) in enumerate(OPTION_CASES)])
def _option_lines(spark):
    stem, opts = text.stem_and_options(F.col("text"))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(opts)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return _cases(spark, [a for a, _, _ in OPTION_CASES], "text string").select("case_no", stem.alias("stem"), shown.alias("options"))


_ABC = {"A": "Aspirin", "B": "Aspirin therapy", "C": "Yes"}
MATCH_CASES = [("Aspirin", "A"), ("aspirin therapy is best", "B"), ("Final decision is: **yes**", "C"), ("the final decision is no", None), ("Warfarin", None), (None, None), ("aspirin, of course", "A")]


@golden("match_option", "case_no, letter", [(i, b) for i, (_, b) in enumerate(MATCH_CASES)])
def _match(spark):
    rows = _cases(spark, [(a, _ABC) for a, _ in MATCH_CASES], "answer string, options map<string,string>")
    return rows.select("case_no", text.match_option(F.col("answer"), F.col("options")).alias("letter"))


STATED_CASES = [("The answer is A. Later the answer is: **C**", "C"), ("the answer is a combination", None), ("Answer is (D)", "D"), ("", None), (None, None)]


@golden("stated_letter", "case_no, letter", [(i, b) for i, (_, b) in enumerate(STATED_CASES)])
def _stated(spark):
    return _cases(spark, [a for a, _ in STATED_CASES], "text string").select("case_no", text.stated_letter(F.col("text")).alias("letter"))


_DRUGS = {"A": "Aspirin", "B": "Heparin infusion", "C": "Warfarin", "D": "Both of these"}
AGREE_CASES = [
    ("mcq", "So the answer is B.", "B", "agree", None), ("mcq", "So the answer is A.", "B", "conflict", None), ("mcq", "In conclusion, heparin infusions work.", "B", "agree_text", "B"), ("mcq", "Therefore warfarin.", "B", "other_text", "C"),
    ("mcq", "Nothing is said.", "B", "unstated", None), ("dialogue", "the answer is B", "B", "n/a", None), ("mcq", None, "B", "n/a", None), ("mcq", "Aspirin or warfarin.", "B", "unstated", None),
]


@golden("answer_agreement", "case_no, agreement", [(i, c[3]) for i, c in enumerate(AGREE_CASES)])
def _agreement(spark):
    rows = _cases(spark, [(k, t, a, _DRUGS) for k, t, a, _, _ in AGREE_CASES], "kind string, trace string, answer string, options map<string,string>")
    return rows.select("case_no", traces.answer_agreement(F.col("kind"), F.col("trace"), F.col("options"), F.col("answer")).alias("agreement"))


@golden("named_option", "case_no, letter", [(i, c[4]) for i, c in enumerate(AGREE_CASES)])
def _named(spark):
    rows = _cases(spark, [(t, _DRUGS) for _, t, _, _, _ in AGREE_CASES], "trace string, options map<string,string>")
    return rows.select("case_no", traces.named_option(F.col("trace"), F.col("options")).alias("letter"))


COMPLETIONS = [("<think>\nplan\n</think>\n\nAnswer: A<|im_end|>", "plan", "Answer: A"), ("plan</think>B", "plan", "B"), ("no end", None, None), (None, None, None), ("<think>a</think>b</think>c", "a</think>b", "c")]


@golden("split_completion", "case_no, thinking, final", [(i, *c[1:]) for i, c in enumerate(COMPLETIONS)])
def _completions(spark):
    thinking, final = text.thinking_and_final(F.col("text"))
    return _cases(spark, [c[0] for c in COMPLETIONS], "text string").select("case_no", thinking.alias("thinking"), final.alias("final"))


KEY_CASES = [("Café au lait?", "cafe au lait"), ("  A  B\tC ", "a b c"), ("été", "e te"), ("x_1-y", "x_1 y"), (None, ""), ("ﬁne ½", "fine 1 2")]


@golden("question_key", "case_no, key", [(0, "cafe au lait"), (1, "a b c"), (2, "e te"), (3, "x_1 y"), (4, ""), (5, "fine 1 2")])
def _keys(spark):
    return _cases(spark, [a for a, _ in KEY_CASES], "text string").select("case_no", text.question_key(F.col("text")).alias("key"))


# normalisers: raw rows (usable and not) to records

RAW = {
    "medmcqa": ("id string, question string, opa string, opb string, opc string, opd string, cop int, choice_type string, exp string, subject_name string", [("q1", "Which?", "a", "b", "c", "d", 2, "single", "x" * 80, "Surgery"), (None, "Which?", "a", "b", "c", "d", 0, "Single", "y" * 90, ""), ("q3", "Which?", "a", "b", "c", "d", 2, "multi", "x" * 80, None), ("q4", "Which?", "a", "", "c", "d", 2, "single", "x" * 80, None), ("q5", "Which?", "a", "b", "c", "d", 4, "single", "x" * 80, None), ("q6", "Which?", "a", "b", "c", "d", 1, "single", "short", None)]),
    "medqa": ("question string, options map<string,string>, answer_idx string, meta_info string", [("Q?", {"A": "1", "B": "2", "C": "3", "D": "4"}, "d", "step1"), ("Q?", {"A": "1", "B": "2", "C": "3"}, "A", None), ("Q?", {"A": "1", "B": "2", "C": "3", "D": " "}, "A", None), ("Q?", {"A": "1", "B": "2", "C": "3", "D": "4"}, "E", None)]),
    "medical_o1": ("Question string, Complex_CoT string, Response string", [("Q", "cot", "R"), ("Q", "", "R"), ("", "cot", "R")]),
    "medical_o1_reasoning": ("Question string, Complex_CoT string, Response string", [("Q", "cot", "R"), ("Q", "", "R")]),
    "medical_o1_direct": ("Question string, Complex_CoT string, Response string", [("Q", None, "R"), ("Q", "c", None)]),
    "chatdoctor": ("instruction string, input string, output string", [("i", " hi ", "hello"), ("i", "", "hello")]),
    "medreason": ("dataset_name string, question string, options string, answer string, reasoning string", [("medqa", "Q", "A. Aspirin\nB. Heparin", "Heparin. Explanation: it works", "why"), ("huatuo", "Q", "", "long answer", "why"), ("pubmedqa", "Q", "A. x\nB. y", "x", "why"), ("medmcqa", "Q", "A. x\nB. y", "z", "why"), ("huatuo", "问题问题", "", "a", "why")]),
    "r1_distill": ("question string, `reasoning (reasoning_content)` string, `response (content)` string", [("A patient has pain?", "why", "Treat it"), ("What is a bond yield?", "why", "A rate"), ("A patient?", "", "x")]),
    "ultramedical": ("id string, type string, answer string, conversations array<struct<`from`:string,value:string>>", [("u1", "Exam", "b", [("human", "Q?\nA. x\nB. y"), ("gpt", "So, the answer is B.")]), (None, None, "A", [("human", "Q?\nA. x\nB. y"), ("gpt", "the answer is B")]), ("u3", None, "A", [("human", "Q?\nA. x\nB. y")]), (None, None, "A", [("human", "Q?\nA. x\nB. y"), ("gpt", "the answer is A")])]),
    "reasonmed": ("instruction string, input string, output string", [("Please answer the following multiple-choice question:\nQ?\nA. iron\nB. zinc", "", "reasons. The answer is B."), ("Q?", "A. iron\nB. zinc", "In the end it is iron alone"), ("Q?\nA. iron\nB. zinc", "", "iron or zinc"), ("Q?", "", "the answer is A")]),
    "pubmedqa": ("pubid long, question string, final_decision string, long_answer string, context struct<contexts:array<string>>", [(7, "Q?", "Yes", "because", (["p1", "", "p2"],)), (8, "Q?", "unsure", "because", (["p1"],)), (9, "Q?", "no", "", ([""],)), (None, "Q?", "maybe", "", (["p"],))]),
    "mmlu": ("question string, subject string, choices array<string>, answer int", [("Q?", "anatomy", ["a", "b", "c", "d"], 2), ("Q?", "", ["a", "b", "c", "d"], 0), ("Q?", "x", ["a", "b", "c"], 0), ("Q?", "x", ["a", "b", "c", "d"], 4)]),
}

_N = None
EXPECTED = {
    "medmcqa": [("q1", "medmcqa", "mcq", "Which?", "A=a;B=b;C=c;D=d", "C", "x" * 80, _N, "Surgery", _N), ("medmcqa-1", "medmcqa", "mcq", "Which?", "A=a;B=b;C=c;D=d", "A", "y" * 90, _N, _N, _N)],
    "medqa": [("medqa-0", "medqa", "mcq", "Q?", "A=1;B=2;C=3;D=4", "D", _N, _N, "step1", _N)],
    "medical_o1": [("medical_o1-0", "medical_o1", "dialogue", "Q", _N, _N, "cot", "cot\n\nR", _N, _N), ("medical_o1-1", "medical_o1", "dialogue", "Q", _N, _N, _N, "R", _N, _N)],
    "medical_o1_reasoning": [("medical_o1-0", "medical_o1", "dialogue", "Q", _N, _N, _N, "R", _N, "cot")],
    "medical_o1_direct": [("medical_o1_direct-0", "medical_o1_direct", "dialogue", "Q", _N, _N, _N, "R", _N, _N)],
    "chatdoctor": [("chatdoctor-0", "chatdoctor", "dialogue", "hi", _N, _N, _N, "hello", _N, _N)],
    "medreason": [("medreason-0", "medreason", "mcq", "Q", "A=Aspirin;B=Heparin", "B", "it works", _N, "medqa", "why"), ("medreason-1", "medreason", "dialogue", "Q", _N, _N, _N, "long answer", "huatuo", "why")],
    "r1_distill": [("r1_distill-0", "r1_distill", "dialogue", "A patient has pain?", _N, _N, _N, "Treat it", _N, "why")],
    "ultramedical": [("u1", "ultramedical", "mcq", "Q?", "A=x;B=y", "B", _N, _N, "Exam", "So, the answer is B."), ("ultramedical-3", "ultramedical", "mcq", "Q?", "A=x;B=y", "A", _N, _N, _N, "the answer is A")],
    "reasonmed": [("reasonmed-0", "reasonmed", "mcq", "Q?", "A=iron;B=zinc", "B", _N, _N, _N, "reasons. The answer is B."), ("reasonmed-1", "reasonmed", "mcq", "Q?", "A=iron;B=zinc", "A", _N, _N, _N, "In the end it is iron alone")],
    "pubmedqa": [("pubmedqa-7", "pubmedqa", "mcq", "Context: p1 p2\n\nQuestion: Q?", "A=yes;B=no;C=maybe", "A", "because", _N, _N, _N), ("pubmedqa-3", "pubmedqa", "mcq", "Context: p\n\nQuestion: Q?", "A=yes;B=no;C=maybe", "C", _N, _N, _N, _N)],
    "mmlu": [("mmlu-anatomy-0", "mmlu_medical", "mcq", "Q?", "A=a;B=b;C=c;D=d", "C", _N, _N, "anatomy", _N), ("mmlu-unknown-1", "mmlu_medical", "mcq", "Q?", "A=a;B=b;C=c;D=d", "A", _N, _N, "unknown", _N)],
}


def raw(spark, name: str):
    schema, rows = RAW[name]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "idx int, " + schema)


def shown(records):
    opts = F.array_join(F.transform(F.array_sort(F.map_entries("options")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return records.select(*(opts.alias("options") if f.name == "options" else F.col(f.name) for f in RECORD))


_COLUMNS = ", ".join(f.name for f in RECORD)
for _name, _f in normalise.NORMALISERS.items():
    golden(f"norm_{_name}", _COLUMNS, EXPECTED[_name])(lambda spark, n=_name, f=_f: shown(f(raw(spark, n))))


def all_records(spark):
    out = None
    for name, f in normalise.NORMALISERS.items():
        made = f(raw(spark, name))
        out = made if out is None else out.unionByName(made)
    return out


@golden("load_limited", "rows", [(2,)])
def _load(spark):
    return normalise.load(raw(spark, "mmlu"), "mmlu", seed=3, limit=2).agg(F.count("*").cast("int").alias("rows"))


@golden("record_round_trip", "rows, equal", [(19, 19)])
def _round_trip(spark):
    rows = all_records(spark)
    back = rows.select(from_record_json(record_json()).alias("r")).select("r.*")
    n = lambda d: d.select(record_json().alias("j"))
    return rows.agg(F.count("*").cast("int").alias("rows")).join(n(rows).intersectAll(n(back)).agg(F.count("*").cast("int").alias("equal")))


@golden("malformed_records", "case_no, reasons", [(0, ""), (1, "answer not among options"), (2, "mcq without options"), (3, "empty question;duplicate option text"), (4, "empty response;empty reasoning"), (5, "duplicate option text"), (6, "")])
def _malformed(spark):
    rows = [("mcq", "Q", {"A": "x", "B": "y"}, "A", None, None), ("mcq", "Q", {"A": "x", "B": "y"}, "C", None, "t"), ("mcq", "Q", None, "A", None, None), ("mcq", " ", {"A": "x!", "B": "X"}, "A", None, None), ("dialogue", "Q", None, None, " ", " "), ("mcq", "Q", {"A": "x²", "B": "x2"}, "A", None, None), ("mcq", "Q", {"A": "x²", "B": "x3"}, "A", None, None)]
    df = _cases(spark, rows, "kind string, question string, options map<string,string>, answer string, response string, reasoning string")
    return df.select("case_no", F.array_join(traces.malformed(*(F.col(c) for c in ("kind", "question", "options", "answer", "response", "reasoning"))), ";").alias("reasons"))


@golden("audit_by_label", "label, rows, reasoning_rows, mcq_rows, agreement_agree, agreement_unstated, answer_verified, suspected_bad, short_trace, mid_sentence", [
    ("chatdoctor", 1, 0, 0, 0, 0, 0, 0, 0, 0), ("medical_o1", 3, 1, 0, 0, 0, 0, 0, 1, 1), ("medical_o1_direct", 1, 0, 0, 0, 0, 0, 0, 0, 0), ("medmcqa", 2, 0, 2, 0, 0, 2, 0, 0, 0), ("medqa", 1, 0, 1, 0, 0, 1, 0, 0, 0), ("medreason:dialogue", 1, 1, 0, 0, 0, 0, 0, 1, 1),
    ("medreason:mcq", 1, 1, 1, 0, 1, 0, 0, 1, 1), ("mmlu_medical", 2, 0, 2, 0, 0, 0, 0, 0, 0), ("pubmedqa", 2, 0, 2, 0, 0, 0, 0, 0, 0), ("r1_distill", 1, 1, 0, 0, 0, 0, 0, 1, 1), ("reasonmed", 2, 2, 2, 1, 0, 0, 0, 2, 1), ("ultramedical", 2, 2, 2, 2, 0, 2, 0, 2, 1),
])
def _audit(spark):
    got = audit.by_label(audit.flagged(all_records(spark)))
    names = ("rows", "reasoning_rows", "mcq_rows", "agreement_agree", "agreement_unstated", "answer_verified", "suspected_bad", "short_trace", "mid_sentence")
    return got.select("label", *(F.col(c).cast("int").alias(c) for c in names))


@golden("prompts", "id, question_v1, target_v1, target_v2, turns, prompt_end", [
    ("q1", "Which?\n\nA. a\nB. b\nC. c\nD. d", "x" * 80 + "\n\nAnswer: C", "Answer: C\n\n" + "x" * 80, 3, "/no_think"), ("mmlu-anatomy-0", "Q?\n\nA. a\nB. b\nC. c\nD. d", "Answer: C", "Answer: C. c", 3, "/no_think"),
    ("u1", "Q?\n\nA. x\nB. y", "Answer: B", "Answer: B. y", 3, "/think"), ("chatdoctor-0", "hi", "hello", "hello", 3, "/no_think"),
])
def _prompts(spark):
    rows = as_records(all_records(spark)).where(F.col("id").isin("q1", "mmlu-anatomy-0", "u1", "chatdoctor-0"))
    abcd = F.array(*map(F.lit, "ABCD"))
    turns = chat.messages(True)
    return rows.select("id", chat.question_text(abcd).alias("question_v1"), chat.rationale_first().alias("target_v1"), chat.letter_first().alias("target_v2"), F.size(turns).alias("turns"), F.substring_index(turns[1]["content"], "\n\n", -1).alias("prompt_end"))
