"""The jobs from end to end on few rows."""

from millrace.operators import mix
from millrace.plans import workflows
from millrace.schema import RECORD


def test_build_mix(spark, tmp_path):
    q = lambda k: f"Question number {k} on the anatomy of the heart?"
    mmlu = spark.createDataFrame([(k, q(k % 9), "anatomy", ["a", "b", "c", "d"], k % 4) for k in range(20)], "idx int, question string, subject string, choices array<string>, answer int")
    held = spark.createDataFrame([(q(3),)], "question string")
    rows, funnel, lengths = workflows.build_mix({"mmlu": mmlu}, [mix.Entry("mmlu", "mcq", 6)], held, out=f"file://{tmp_path}/out")
    got = [r.question for r in rows.collect()]
    assert len(got) == len(set(got)) == 6 and q(3) not in got
    f = funnel.first()
    assert f.kept == 6 and f.seen == f.kept + f.duplicate + f.exact and lengths.first().max_seq == 64
    assert spark.read.schema(RECORD).json(f"file://{tmp_path}/out/train.jsonl").count() == 6


def test_pool_and_first_form(spark):
    rec = lambda k, s: (f"{s}{k}", s, "mcq", f"case {k} of {s} with some words", {"A": "x", "B": "y"}, "A", None, None, None, None)
    rows = spark.createDataFrame([rec(k, s) for s in ("m", "n") for k in range(12)] + [rec(1, "m")], RECORD)
    held = spark.createDataFrame([("Case 2 of m with some words!",)], "question string")
    dev, pool = workflows.build_pool(rows, held, {"m": 2, "n": 3}, {"m": 100, "n": 4})
    ids = lambda d: [r.id for r in d.collect()]
    assert len(ids(dev)) == 5 and len(ids(pool)) == 9 + 4 and not set(ids(dev)) & set(ids(pool)) and "m2" not in ids(dev) + ids(pool)
    out = workflows.first_form(rows.dropDuplicates(["id"]), held, 4)
    assert out.count() == 23 and out.where("split = 'val'").count() == 4


def test_audit_tables(spark):
    text = "a trace of more than eight words that ends in the answer is A. "
    rows = spark.createDataFrame([(f"r{k}", "medqa", "mcq", f"question {k % 3} with some five words", {"A": "x", "B": "y"}, "A", None, None, None, text * (1 + k // 4)) for k in range(8)], RECORD)
    tables = {k: v.collect() for k, v in workflows.audit(rows, 3).items()}
    assert tables["by_label"][0].rows == 8 and tables["by_label"][0].agreement_agree == 8 and tables["duplicate_questions"][0].duplicates == 8
    assert tables["cross_source_traces"][0].cross_pairs == 0 and tables["cross_source_traces"][0].pairs > 0 and tables["lengths"][0].n == 8


def test_choose_traces(spark):
    pool = spark.createDataFrame([(f"q{k}", "medqa", "mcq", "Q?", {"A": "x", "B": "y"}, "A", "why", None, None, None) for k in range(8)], RECORD)
    gen = [(f"q{k}", s, "A" if (k + s) % 2 else "B", True, False, "<think>so it is</think>\n\nAnswer: A\n\nbecause", 10) for k in range(8) for s in range(3)]
    got = workflows.choose_traces(spark.createDataFrame(gen, "id string, sample int, letter string, closed boolean, forced boolean, text string, think_tokens int"), pool, 100, 1000, 0.2, 2)
    rows = got["rows"].collect()
    traces = [r for r in rows if r.source == "e2_self"]
    assert len(traces) == 12 and all(r.reasoning == "so it is" and r.rationale == "because" for r in traces)
    assert len(rows) - len(traces) == 3 and {r.passed: r.questions for r in got["histogram"].collect()} == {"1/3": 4, "2/3": 4}
