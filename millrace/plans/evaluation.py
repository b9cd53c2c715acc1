"""Queries that compare models and select traces, over events and labels, each with its SQL.

An event is a prediction: user_id the question, event_type the letter (a small value: no letter),
props.k the tokens thought, event_id mod 3 the model, the event's place among those of its user and
model the sample, user_id mod 5 the gold letter, user_id mod 2 the benchmark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import tokens
from millrace.operators import plan, report, stats, traces

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


_TYPES = ("click", "error", "purchase", "signup", "view")

PRED = """pred as (select 'm' || (event_id % 3) as model, 'reasoning' as mode, case when user_id % 2 = 0 then 'medqa' else 'medmcqa' end as bench, cast(user_id as varchar) as id,
 row_number() over (partition by event_id % 3, user_id order by ts, event_id) - 1 as sample,
 case when value < 2 then null else substr('ABCDE', list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type), 1) end as letter,
 event_id % 7 <> 0 as closed, event_id % 11 = 0 as forced, cast(json_extract(props, '$.k') as bigint) as think_tokens, cast(json_extract(props, '$.k') as bigint) + 10 as new_tokens, event_id,
 case when event_id % 13 = 0 then '<think>a<think>b</think>Answer: A' when event_id % 17 = 0 then 'never closed' else '<think>' || event_type || '</think>Answer: A done' end as text from events),
 bench as (select distinct case when user_id % 2 = 0 then 'medqa' else 'medmcqa' end as bench, cast(user_id as varchar) as id, substr('ABCDE', cast(user_id % 5 + 1 as int), 1) as gold, case when user_id % 4 = 0 then '' else 's' || (user_id % 4) end as subject from events),
 firsts as (select p.*, b.gold, b.subject, coalesce(p.letter = b.gold, false) as correct from pred p join bench b using (bench, id) where sample = 0)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    letter = F.when(F.col("value") >= 2, F.get(F.array(*map(F.lit, "ABCDE")), F.array_position(F.array(*map(F.lit, _TYPES)), F.col("event_type")).cast("int") - 1))
    place = F.row_number().over(Window.partitionBy(F.col("event_id") % 3, "user_id").orderBy("ts", "event_id")).cast("long") - 1
    text = F.when(F.col("event_id") % 13 == 0, "<think>a<think>b</think>Answer: A").when(F.col("event_id") % 17 == 0, "never closed").otherwise(F.concat(F.lit("<think>"), "event_type", F.lit("</think>Answer: A done")))
    return e.select(
        F.concat(F.lit("m"), F.col("event_id") % 3).alias("model"), F.lit("reasoning").alias("mode"), F.when(F.col("user_id") % 2 == 0, "medqa").otherwise("medmcqa").alias("bench"), F.col("user_id").cast("string").alias("id"),
        place.alias("sample"), letter.alias("letter"), (F.col("event_id") % 7 != 0).alias("closed"), (F.col("event_id") % 11 == 0).alias("forced"), k.alias("think_tokens"), (k + 10).alias("new_tokens"), "event_id", text.alias("text"),
    )


def benchmarks(spark: SparkSession, sf: str) -> DataFrame:
    u = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct()
    return u.select(F.when(F.col("user_id") % 2 == 0, "medqa").otherwise("medmcqa").alias("bench"), F.col("user_id").cast("string").alias("id"), F.get(F.array(*map(F.lit, "ABCDE")), (F.col("user_id") % 5).cast("int")).alias("gold"), F.when(F.col("user_id") % 4 == 0, "").otherwise(F.concat(F.lit("s"), F.col("user_id") % 4)).alias("subject"))


def firsts(spark: SparkSession, sf: str) -> DataFrame:
    return report.scored(report.first_samples(predictions(spark, sf), "event_id"), benchmarks(spark, sf))


# paired statistics over labels


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    return labels.join(docs, "doc_id").select("doc_id", "lang", (F.col("quality") == 1).alias("base"), (F.col("toxic") == 0).alias("tuned"))


OUT = "o as (select l.doc_id, lang, quality = 1 as base, toxic = 0 as tuned from labels l join documents using (doc_id))"
_CELLS = "count(*) as n, count(*) filter (base and tuned) as both, count(*) filter (not base and tuned) as wins, count(*) filter (base and not tuned) as regressions, count(*) filter (not base and not tuned) as neither"


@query("paired_contingency", f"with {OUT} select lang, {_CELLS.replace('as both', 'as both_right')} from o group by lang")
def paired_contingency(spark, sf):
    return outcomes(spark, sf).groupBy("lang").agg(*stats.contingency(F.col("base"), F.col("tuned"))).withColumnRenamed("both", "both_right")


# the tail sum needs C(n, i): logarithms of factorials through lgamma
_P = "round(case when wins + regressions = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, least(wins, regressions) + 1), lambda i: exp(lgamma(wins + regressions + 1) - lgamma(i + 1) - lgamma(wins + regressions - i + 1) - (wins + regressions) * ln(2.0))))) end, 6)"


@query("mcnemar", f"with {OUT}, c as (select lang, count(*) filter (not base and tuned) as wins, count(*) filter (base and not tuned) as regressions from o group by lang) select lang, wins, regressions, {_P} as p_value from c")
def mcnemar(spark, sf):
    c = outcomes(spark, sf).groupBy("lang").agg(*stats.contingency(F.col("base"), F.col("tuned"))[2:4])
    return c.withColumn("p_value", F.round(stats.mcnemar(F.col("wins"), F.col("regressions")), 6))


_D, _H = "(wins - regressions) / n", "1.959964 * sqrt(greatest(0.0, (wins + regressions) - pow(wins - regressions, 2) / n)) / n"
_CI = f"round({_D}, 6) as diff, round(greatest(-1.0, {_D} - {_H}), 6) as ci_low, round(least(1.0, {_D} + {_H}), 6) as ci_high"


@query("paired_ci", f"with {OUT}, c as (select lang, count(*) as n, count(*) filter (not base and tuned) as wins, count(*) filter (base and not tuned) as regressions from o group by lang) select lang, {_CI} from c")
def paired_ci(spark, sf):
    c = outcomes(spark, sf).groupBy("lang").agg(*stats.contingency(F.col("base"), F.col("tuned")))
    return c.select("lang", *(F.round(v, 6).alias(k) for k, v in stats.paired_interval(F.col("n"), F.col("wins"), F.col("regressions")).items()))


@query("by_subject", f"with {OUT} select coalesce(nullif(lang, 'es'), 'unknown') as subject, count(*) as n, avg(base::int) as base_accuracy, avg(tuned::int) as other_accuracy from o group by 1")
def by_subject(spark, sf):
    named = outcomes(spark, sf).withColumn("subject", F.nullif(F.col("lang"), F.lit("es")))
    return stats.by_subject(named, "subject", F.col("base"), F.col("tuned"), "doc_id")


@query("accuracy", f"with {PRED} select model, avg(correct::int) as accuracy from firsts group by model")
def accuracy(spark, sf):
    return firsts(spark, sf).groupBy("model").agg(stats.accuracy(F.col("correct")).alias("accuracy"))


_GOLDEN = [(112, 85, 3, 0.064), (399, 334, 3, 0.018), (22, 67, 6, 0.000002), (67, 50, 6, 0.138753), (164, 198, 6, 0.082697), (0, 0, 6, 1.0)]


@query("golden_statistics", "select wins, regressions, cast(p as double) as p_value from (values " + ", ".join(f"({w}, {r}, {p})" for w, r, _, p in _GOLDEN) + ") t(wins, regressions, p)")
def golden_statistics(spark, sf):
    """Published p values from their counts, to the published digits."""
    rows = spark.createDataFrame([x[:3] for x in _GOLDEN], "wins int, regressions int, digits int")
    p = stats.mcnemar(F.col("wins").cast("long"), F.col("regressions").cast("long"))
    return rows.select("wins", "regressions", F.when(F.col("digits") == 3, F.round(p, 3)).otherwise(F.round(p, 6)).alias("p_value"))


# reports over predictions


@query("first_sample", f"with {PRED} select model, bench, id, letter, correct from firsts")
def first_sample(spark, sf):
    return firsts(spark, sf).select("model", "bench", "id", "letter", "correct")


@query("all_samples", f"with {PRED} select model, bench, id, count(*) as n_samples, string_agg(coalesce(letter, '-'), '' order by sample) as letters from pred group by model, bench, id")
def all_samples(spark, sf):
    got = report.samples_of(predictions(spark, sf))
    return got.select("model", "bench", "id", F.col("n_samples").cast("long").alias("n_samples"), F.array_join(F.transform("samples", lambda s: F.coalesce(s["letter"], F.lit("-"))), "").alias("letters"))


@query("majority_vote", f"with {PRED}, v as (select model, id, letter, count(*) as n, min(sample) as first from pred where letter is not null group by model, id, letter) select model, id, letter from v qualify row_number() over (partition by model, id order by n desc, first) = 1")
def majority_vote(spark, sf):
    got = report.samples_of(predictions(spark, sf)).withColumn("letter", report.majority_letter(F.transform("samples", lambda s: s["letter"])))
    return got.where("letter is not null").select("model", "id", "letter")


_ANY = f"""{PRED}, cnt as (select model, mode, bench, id, count(*) as c from pred group by all having count(*) > 1), ks as (select model, mode, bench, min(c) as k from cnt group by all),
 cut as (select p.*, ks.k, b.gold from pred p join cnt using (model, mode, bench, id) join ks using (model, mode, bench) join bench b using (bench, id) where sample < k),
 v as (select model, bench, id, letter, count(*) as n, min(sample) as first from cut where letter is not null group by all),
 major as (select model, bench, id, letter as major from v qualify row_number() over (partition by model, bench, id order by n desc, first) = 1),
 q as (select model, mode, bench, id, k, gold, coalesce(bool_or(letter = gold), false) as a, coalesce(bool_or(letter = gold and sample = 0), false) as f from cut group by all)"""


@query("any_correct", f"with {_ANY} select q.model, q.mode, q.bench, cast(k as int) as k, count(*) as n, avg(a::int) as any_accuracy, avg(coalesce(major = gold, false)::int) as majority_accuracy, avg(f::int) as first_accuracy from q left join major m on m.model = q.model and m.bench = q.bench and m.id = q.id group by all")
def any_correct(spark, sf):
    return report.any_correct(predictions(spark, sf), benchmarks(spark, sf))


_COMMON = f"{PRED}, f as (select * from firsts where not (model = 'm1' and cast(id as int) % 9 = 0)), common as (select bench, id from f group by bench, id having count(distinct model) = 3)"


def _uneven(spark, sf):
    return firsts(spark, sf).where(~((F.col("model") == "m1") & (F.col("id").cast("int") % 9 == 0)))


@query("common_set", f"with {_COMMON} select model, 'reasoning' as mode, bench, count(*) as n, avg(correct::int) as accuracy from f where (bench, id) in (select bench, id from common) group by model, bench")
def common_set(spark, sf):
    return report.common_accuracy(_uneven(spark, sf))


@query("ledger_pivot", f"with {_COMMON}, a as (select model, bench, avg(correct::int) as accuracy from f where (bench, id) in (select bench, id from common) group by model, bench) select model, max(accuracy) filter (bench = 'medqa') as \"reasoning:medqa\", max(accuracy) filter (bench = 'medmcqa') as \"reasoning:medmcqa\" from a group by model")
def ledger_pivot(spark, sf):
    return report.ledger(_uneven(spark, sf), ["reasoning:medqa", "reasoning:medmcqa"])


_PAIRS = f"{PRED}, pairs as (select o.model, o.bench, o.gold, b.letter as bl, o.letter as ol, b.correct as base, o.correct as tuned from firsts o join firsts b on b.model = 'm0' and o.model <> 'm0' and o.bench = b.bench and o.id = b.id)"


@query("vs_baseline", f"with {_PAIRS}, c as (select model, 'reasoning' as mode, bench, {_CELLS.replace('as both', 'as both_right')}, avg(base::int) as base_accuracy, avg(tuned::int) as other_accuracy, count(*) filter (bl is null) as base_unparseable, count(*) filter (ol is null) as other_unparseable from pairs group by model, bench) select *, {_P} as p_value, {_CI} from c")
def vs_baseline(spark, sf):
    got = report.against(firsts(spark, sf), "m0").withColumnRenamed("both", "both_right")
    return got.withColumns({c: F.round(c, 6) for c in ("p_value", "diff", "ci_low", "ci_high")})


@query("pooled_report", f"with {PRED} select model, mode, bench, count(*) as n, avg(correct::int) as accuracy from firsts group by grouping sets ((model, mode, bench), (model, mode))")
def pooled_report(spark, sf):
    return report.pooled(firsts(spark, sf))


@query("model_summary", f"with {PRED} select model, mode, bench, count(*) as n, avg(correct::int) as accuracy, count(*) filter (letter is null) as unparseable, count(*) filter (forced) as forced, count(*) filter (closed) as closed, quantile_disc(new_tokens, 0.5) as median_new_tokens, quantile_disc(think_tokens, 0.5) as median_think, avg(think_tokens) as mean_think, quantile_disc(think_tokens, 0.9) as p90_think, quantile_disc(think_tokens, 0.95) as p95_think from firsts group by model, mode, bench")
def model_summary(spark, sf):
    return report.model_summary(firsts(spark, sf))


@query("reasoning_counts", f"with {PRED} select model, mode, bench, count(*) filter (forced) as forced, count(*) filter (closed) as closed, median(new_tokens) as median_new_tokens from firsts group by model, mode, bench")
def reasoning_counts(spark, sf):
    return report.reasoning_counts(firsts(spark, sf))


@query("think_length_stats", f"with {PRED}, f as (select model, mode, bench, new_tokens, case when model = 'm2' and cast(id as int) % 10 = 0 then null else think_tokens end as think_tokens from firsts) select model, mode, bench, case when count(think_tokens) = count(*) then quantile_disc(think_tokens, 0.5) else quantile_disc(new_tokens, 0.5) end as median_length, case when count(think_tokens) = count(*) then 'think_tokens' else 'new_tokens' end as kind from f group by model, mode, bench")
def think_length_stats(spark, sf):
    some = firsts(spark, sf).withColumn("think_tokens", F.when(~((F.col("model") == "m2") & (F.col("id").cast("int") % 10 == 0)), F.col("think_tokens")))
    return report.thinking_length(some)


@query("export_rows", f"with {PRED} select id as question_id, bench, mode, model, sample, gold as gold_answer, letter as prediction, coalesce(letter = gold, false) as correct, think_tokens as thinking_length, new_tokens, forced, closed, subject from pred join bench using (bench, id)")
def export_rows(spark, sf):
    return report.export_rows(predictions(spark, sf), benchmarks(spark, sf))


# traces

JUDGED = f"""{PRED}, judged as (select p.*, b.gold, case when not closed or forced then 'unfinished_or_forced' when letter is distinct from gold then 'wrong_letter'
 when text not like '%</think>%' or text like '<think>a%' then 'nested_think' when think_tokens > 80 then 'thinking_too_long' end as reason from pred p join bench b using (bench, id))"""


def judged(spark, sf, max_think: int = 80) -> DataFrame:
    return traces.judged(report.scored(predictions(spark, sf), benchmarks(spark, sf)), max_think)


@query("reject_reasons", f"with {JUDGED} select model, reason, count(*) as samples from judged group by model, reason")
def reject_reasons(spark, sf):
    return judged(spark, sf).groupBy("model", "reason").agg(F.count("*").alias("samples"))


@query("pass_histogram", f"with {JUDGED}, p as (select id, count(*) filter (reason is null) || '/' || count(*) as passed from judged group by id) select passed, count(*) as questions from p group by passed")
def pass_histogram(spark, sf):
    return traces.pass_histogram(judged(spark, sf))


@query("pick_samples", f"with {JUDGED} select id, least(2, count(*)) as picked from judged where reason is null group by id")
def pick_samples(spark, sf):
    return traces.pick_samples(judged(spark, sf), 2, 42).groupBy("id").agg(F.count("*").alias("picked"))


@query("trace_records", f"with {JUDGED} select event_id, regexp_extract(text, '<think>(.*)</think>', 1) as reasoning, 'done' as rationale from judged where reason is null")
def trace_records(spark, sf):
    return judged(spark, sf).where("reason is null").withColumns(traces.trace_columns(F.col("text"))).select("event_id", "reasoning", "rationale")


@query("direct_share", f"with {JUDGED} select cast(round_even((select count(*) from judged where reason is null and sample = 0) * 0.2 / 0.8, 0) as bigint) as direct_rows")
def direct_share(spark, sf):
    j = judged(spark, sf)
    return traces.direct_share(j.where("reason is null and sample = 0"), j, 0.2, 42).agg(F.count("*").alias("direct_rows"))


@query("weak_questions", f"with {JUDGED} select id, count(*) as samples from judged where sample < 4 group by id having bool_and(reason is not null)")
def weak_questions(spark, sf):
    return traces.weak_questions(judged(spark, sf).where("sample < 4"))


_PILOT = f"{JUDGED}, s as (select model as teacher, count(distinct id) as answered, count(distinct id) filter (reason is null) as rescued, 600.0 + 60 * cast(substr(model, 2) as int) as seconds from judged where sample < 4 group by model)"


def _pilot(spark, sf):
    rows = judged(spark, sf).where("sample < 4").withColumnRenamed("model", "teacher")
    seconds = rows.select("teacher").distinct().withColumn("seconds", 600.0 + 60 * F.substring("teacher", 2, 1).cast("int"))
    return traces.pilot_stats(rows, seconds)


@query("pilot_stats", f"with {_PILOT} select teacher, answered, rescued, cast(seconds as double) as seconds, rescued / answered as rescue_rate, rescued / cast(seconds as double) * 3600 as rescued_per_hour from s")
def pilot_stats(spark, sf):
    return _pilot(spark, sf)


@query("choose_teacher", f"with {_PILOT} select (select teacher from s where rescued / answered >= 0.2 order by rescued / seconds desc, rescued / answered desc limit 1) as teacher")
def choose_teacher(spark, sf):
    return traces.choose_teacher(_pilot(spark, sf))


@query("plan_estimate", "select 'q' || (o_orderkey % 4) as queue, sum(case o_orderstatus when 'F' then 3.0 when 'O' then 0.25 else 9.0 end * (o_orderkey % 100) * (o_orderkey % 3 + 1) * 1.5)::double as seconds, sum(case o_orderstatus when 'F' then 3.0 when 'O' then 0.25 else 9.0 end * (o_orderkey % 100) * (o_orderkey % 3 + 1) * 1.5)::double / 3600 as hours from orders group by 1")
def plan_estimate(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    key = F.col("o_orderkey")
    stages = o.select(F.concat(F.lit("q"), key % 4).alias("queue"), F.lit("reasoning").alias("mode"), F.col("o_orderstatus").alias("bench"), (key % 100).alias("n"), (key % 3 + 1).alias("samples"), F.lit(1.5).alias("slowdown"))
    rates = o.select(F.col("o_orderstatus").alias("bench")).distinct().select(F.lit("reasoning").alias("mode"), "bench", F.when(F.col("bench") == "F", 3.0).when(F.col("bench") == "O", 0.25).otherwise(9.0).alias("seconds_each"))
    return plan.queue_hours(stages, rates)


@query("loss_curve", "select * from (values (10, 0.5::double, 1.25::double, 0.0002::double), (20, 1.0::double, 0.75::double, 0.0001::double)) t(step, epoch, loss, lr)")
def loss_curve(spark, sf):
    log = spark.createDataFrame([([(10, 0.5, 1.25, 2e-4), (15, 0.75, None, None), (20, 1.0, 0.75, 1e-4)],)], "history array<struct<step:int,epoch:double,loss:double,learning_rate:double>>")
    return plan.loss_curve(log)


_CODES = "list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type)"


@query("completion_lengths", f"""with t as (select user_id, list({_CODES} order by event_id) as w from events group by user_id),
 c as (select user_id, w, len(w) - coalesce(nullif(list_position([x not in (4, 5) for x in list_reverse(w)], true), 0), len(w) + 1) + 1 as n from t),
 d as (select user_id, w, n, coalesce(nullif(list_position(list_reverse(w[1:n]), 3), 0), 0) as p from c)
 select user_id, p > 0 as closed, cast(n as int) as new_tokens, cast(n - p as int) as think_tokens, not (list_contains(w, 4) or list_contains(w, 5)) as capped from d""")
def completion_lengths(spark, sf):
    """Event types as token ids in the order of events; 3 ends the thinking, 4 and 5 the completion."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    code = F.array_position(F.array(*map(F.lit, _TYPES)), F.col("event_type")).cast("int")
    listed = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", code.alias("w"))))["w"].alias("w"))
    stops = tokens.stop_ids([4, 5], 5)
    return listed.select("user_id", *(c.alias(k) for k, c in tokens.row_of_tokens(F.col("w"), 3, stops).items()), tokens.hit_the_cap(F.col("w"), stops).alias("capped"))


@query("letter_choices", "select vec_id, substr('ABCD', cast(list_position(v, list_max(v)) as int), 1) as letter from (select vec_id, [cast(x as double) for x in embedding[1:4]] as v from embeddings)")
def letter_choices(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    return v.select("vec_id", tokens.pick_letter(F.slice("embedding", 1, 4).cast("array<double>"), F.array(*map(F.lit, "ABCD"))).alias("letter"))


@query("deadline_batches", """with recursive b as (select user_id, row_number() over (partition by user_id order by event_id) as k, cast(value as double) as took from events),
 r as (select user_id, cast(0 as bigint) as done, cast(0 as double) as used, cast(40 as double) as rate from (select distinct user_id from b)
 union all select r.user_id, done + 1, used + took, case when done = 0 then took else cast(0.8 as double) * rate + cast(0.2 as double) * took end from r join b on b.user_id = r.user_id and b.k = r.done + 1 where used + rate <= 300)
 select user_id, max(done) as done from r group by user_id""")
def deadline_batches(spark, sf):
    """Events as batches of a user's stage, value as their seconds."""
    return plan.before_deadline(spark.read.parquet(f"{sf}/events.parquet"), ["user_id"], "event_id", "value", 300, 40).select("user_id", "done")


@query("eval_budget", """select c_nationkey, cast(floor(2 * (n * 0.25 + g * 1.5)) as bigint) as seconds, floor(2 * (n * 0.25 + g * 1.5)) > 60 as over
 from (select c_nationkey, count(*) as n, count(*) filter (c_acctbal > 0) as g from customer group by c_nationkey)""")
def eval_budget(spark, sf):
    n = spark.read.parquet(f"{sf}/customer.parquet").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("g"))
    timed = n.select("c_nationkey", plan.eval_seconds(F.col("n"), F.lit(0.25), F.col("g"), F.lit(1.5)).alias("seconds"))
    return timed.withColumn("over", plan.over_budget(F.col("seconds"), 60))
