"""The engine's jobs from end to end: build a mix, split a pool, compare models, audit records, choose traces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import question_key
from millrace.functions.traces import label_of
from millrace.operators import audit as auditing
from millrace.operators import decontam, guards, mix, neardup, report, split, traces
from millrace.schema import RECORD, as_records
from millrace.sources import io, normalise

#: How near-copies of questions and traces are told: words, similarity, characters.
QUESTION_NEAR, TRACE_NEAR, TRACE_HEAD = (5, 0.8), (8, 0.6), 3000


def words(c: Column) -> Column:
    """The default length: words parted by white space."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"\S+")).cast("long")


def record_length(measure: Callable[[Column], Column] = words) -> Column:
    return measure(F.concat_ws(" ", "question", F.array_join(F.map_values("options"), " "), "reasoning", "rationale", "response"))


def benchmarks(records: dict[str, DataFrame], sizes: dict[str, int] | None = None) -> DataFrame:
    """bench, id, gold, subject, pos of several benchmarks; stops at a wrong size or an answer that is no option."""
    out = None
    for bench, rows in records.items():
        rows = guards.scorable(as_records(rows), "ABCDEFGHIJ").withColumn("bench", F.lit(bench))
        out = rows if out is None else out.unionByName(rows)
    if sizes:
        guards.check_sizes(out, "bench", sizes)
    pos = F.row_number().over(Window.partitionBy("bench").orderBy("id")) - 1
    return out.select("bench", "id", F.col("answer").alias("gold"), "subject", pos.alias("pos"), "question")


def build_mix(raw: dict[str, DataFrame], entries: list[mix.Entry], held_out: DataFrame, out: str | None = None, max_len: int = 3072, seed: int = 42, scale: float = 1.0, measure: Callable[[Column], Column] = words) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(training rows in a seeded order, funnel, lengths and cap); out: also train.jsonl and report.json.

    raw: each source's table with idx. held_out: records whose questions must not occur.
    """
    rows = None
    for name, df in raw.items():
        made = normalise.NORMALISERS[name](df)
        made = made.withColumn("name", F.lit(name)).withColumn("usable", F.lit(True)).withColumn("_order", split.seeded(seed, "id"))
        rows = made if rows is None else rows.unionByName(made)
    rows = rows.withColumns({"pos": F.row_number().over(Window.partitionBy("name").orderBy("_order", "id")) - 1, "key": question_key(F.col("question")), "length": record_length(measure), "_row": F.concat_ws("/", "name", "id")}).persist()
    held = decontam.HeldOut(held_out, "question")
    named = rows.join(held.verdicts(rows, "_row"), "_row", "left")
    seen, kept = mix.fill(named, entries, max_len, scale=scale)
    cap = kept.agg(mix.sequence_cap("length", max_len))
    final = mix.within(kept, "length", cap).orderBy(split.seeded(seed, "_row"))
    lengths = kept.agg(*mix.length_stats("length"), mix.sequence_cap("length", max_len).alias("max_seq"))
    if out:
        io.write_jsonl(final.select(*RECORD.fieldNames(), split.seeded(seed, "_row").alias("_o")).orderBy("_o").drop("_o"), f"{out}/train.jsonl")
    return final.select(*RECORD.fieldNames()), mix.funnel(seen), lengths


def first_form(records: DataFrame, held_out: DataFrame, val_size: int, seed: int = 42) -> DataFrame:
    """Records without held-out questions, first of each, with a column split: the first form of the job."""
    keyed = as_records(records).withColumn("key", question_key(F.col("question")))
    items = held_out.select(question_key(F.col("question")).alias("key"))
    return split.train_val(decontam.without_held_out(keyed, items, "key", "key", "id").drop("key"), val_size, split.seeded(seed, "id"), "id")


def build_pool(candidates: DataFrame, held_out: DataFrame, dev: dict[str, int], pool: dict[str, int], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(dev, pool) of records: clean, first of each key, the pool not near dev."""
    rows = as_records(candidates).withColumn("key", question_key(F.col("question")))
    rows = split.place(rows, split.seeded(seed, "id"), "id").withColumnRenamed("place", "pos")
    clean = rows.join(decontam.HeldOut(held_out, "question").verdicts(rows, "pos"), "pos", "left_anti")
    near = lambda r, d: decontam.HeldOut(d, "question").verdicts(r, "pos").select("pos")
    got = split.split_pool(clean, dev, pool, near)
    return tuple(x.select(*RECORD.fieldNames()) for x in got)


def compare(predictions: DataFrame, bench: DataFrame, baseline: str = "base") -> dict[str, DataFrame]:
    """Tables of a comparison: summary, any_correct, common, vs_baseline, pooled, ledger rows and the rows themselves."""
    rows = io.check_one_file(predictions) if "_file" in predictions.columns else predictions
    guards.check_complete(rows, bench, ["bench", "id"])
    firsts = report.scored(report.first_samples(rows), bench)
    return {
        "summary": report.model_summary(firsts), "any_correct": report.any_correct(rows, bench), "common": report.common_accuracy(firsts), "vs_baseline": report.against(firsts, baseline),
        "pooled": report.pooled(firsts), "thinking": report.thinking_length(firsts), "export": report.export_rows(rows, bench),
    }


def audit(records: DataFrame, max_seq: int, measure: Callable[[Column], Column] = words) -> dict[str, DataFrame]:
    """Tables of an audit: by label, duplicate questions and responses, near-copies of questions and traces, rows over max_seq."""
    rows = as_records(records)
    flags = auditing.flagged(rows, measure(F.col("reasoning")))
    by = rows.withColumn("label", label_of(F.col("source"), F.col("kind"))).withColumn("length", record_length(measure))
    q_pairs = neardup.near_pairs(by, "id", "question", *QUESTION_NEAR)
    t_pairs = neardup.near_pairs(by.where("reasoning <> ''").withColumn("head", F.substring("reasoning", 1, TRACE_HEAD)), "id", "head", *TRACE_NEAR)
    ends = lambda p: neardup.in_pairs(p).join(by.select("id", "label"), "id").groupBy("label").agg(F.count("*").alias("rows"))
    return {
        "by_label": auditing.by_label(flags), "duplicate_questions": auditing.duplicate_rows(by.withColumn("key", question_key(F.col("question"))), "key", "label"),
        "duplicate_responses": auditing.duplicate_rows(by.where("response <> ''").withColumn("key", question_key(F.col("response"))), "key", "label"),
        "near_questions": ends(q_pairs), "near_traces": ends(t_pairs), "cross_source_traces": neardup.cross_label(t_pairs, by.select("id", "label")),
        "lengths": by.groupBy("label").agg(*mix.length_stats("length"), F.count_if(F.col("length") > max_seq).alias("over_max_seq")),
    }


def choose_traces(generations: DataFrame, pool: DataFrame, max_think: int, cap: int, direct_fraction: float, per_question: int = 1, seed: int = 42, source: str = "e2_self", measure: Callable[[Column], Column] = words) -> dict[str, DataFrame]:
    """Training rows from verified completions (id, sample, letter, closed, forced, text, think_tokens) of the pool's questions, and tables of what was rejected."""
    own = as_records(pool)
    rows = traces.judged(generations.join(own.select("id", F.col("answer").alias("gold")), "id"), max_think).persist()
    picked = traces.pick_samples(rows, per_question, seed)
    made = own.drop("source", "reasoning", "rationale").join(picked.select("id", "pick", "text"), "id").withColumns(traces.trace_columns(F.col("text")))
    made = made.withColumn("source", F.lit(source)).withColumn("_id", F.col("id")).withColumn("id", F.concat(F.lit("t-"), "id", F.lit("-"), F.col("pick")))
    fitting = made.withColumn("_n", record_length(measure)).where(F.col("_n") <= cap)
    direct = own.join(traces.direct_share(fitting, rows, direct_fraction, seed), "id", "left_semi").drop("source", "rationale", "reasoning")
    direct = direct.withColumns({"source": F.lit("direct"), "rationale": F.lit(None).cast("string"), "reasoning": F.lit(None).cast("string"), "id": F.concat(F.lit("d-"), "id")}).where(record_length(measure) <= cap)
    both = fitting.select(*RECORD.fieldNames()).unionByName(direct.select(*RECORD.fieldNames()))
    return {"rows": both.orderBy(split.seeded(seed, "id")), "rejected": rows.groupBy("reason").agg(F.count("*").alias("samples")), "histogram": traces.pass_histogram(rows), "weak": traces.weak_questions(rows)}


def run_query(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    from millrace.plans.queries import QUERIES

    return QUERIES[name](spark, sf_dir)
