"""Corpus queries over documents, benchmark and conversations, each with its SQL.

The corpus: text is the question, source the source, lang the kind, doc_id the place, and the
number of words the length.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import traces as T
from millrace.functions.text import MEDICAL, ascii_share, is_english, looks_medical, question_key
from millrace.operators import audit, decontam, mix, neardup, split

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Characters of the test tables whose decomposition differs from them.
_ACCENTED = "ÄÇÈÉÊÍÑÓÖÜäçèéêíñóöü"


def _sql_key(x: str) -> str:
    for c in _ACCENTED:
        x = f"replace({x}, '{c}', '{unicodedata.normalize('NFKD', c)[0]} ')"
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _sql_plain(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


WORDS = "len(regexp_extract_all(text, '\\S+'))"
CORPUS = f"corpus as (select doc_id, text, source, lang, {_sql_key('text')} as key, {WORDS} as words from documents)"
HELD = f"held as (select distinct {_sql_key('text')} as key from benchmark)"


def _grams(table: str, ident: str, n: int, words: str, out: str) -> str:
    """Distinct n-word grams of a table as (ident, gram)."""
    cols = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"{out} as (select distinct {ident}, {cols} as gram from (select {ident}, w, unnest(range(1, len(w) - {n - 2})) as i from (select {ident}, {words} as w from {table}) where len(w) >= {n}))"


VERDICTS = (
    f"{CORPUS}, {HELD}, {_grams('corpus', 'doc_id', 13, "string_split(key, ' ')", 'dg')}, items as (select row_number() over (order by key) as item, key from held), "
    f"{_grams('items', 'item', 13, "string_split(key, ' ')", 'ig')}, sizes as (select item, count(*) as size from ig group by item), "
    "hits as (select doc_id, item, count(*) as n from dg join ig using (gram) group by doc_id, item), "
    "verdicts as (select doc_id, min(verdict) as verdict from (select doc_id, 'exact' as verdict from corpus where key in (select key from held) "
    "union all select doc_id, 'ngram' from hits join sizes using (item) where n >= 0.5 * size) group by doc_id)"
)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", "text", "source", "lang", question_key(F.col("text")).alias("key"), F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("words"))


def held(spark: SparkSession, sf: str) -> decontam.HeldOut:
    return decontam.HeldOut(spark.read.parquet(f"{sf}/benchmark.parquet"), "text")


def clean_corpus(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus(spark, sf)
    return decontam.first_of_key(rows.join(held(spark, sf).verdicts(rows, "doc_id"), "doc_id", "left_anti"), "key", "doc_id")


CLEAN = f"{VERDICTS}, clean as (select * from corpus where doc_id in (select min(doc_id) from corpus where doc_id not in (select doc_id from verdicts) group by key))"


@query("decontaminated_corpus", f"with {CLEAN} select source, count(*) as docs, cast(sum(words) as bigint) as words from clean group by source")
def decontaminated_corpus(spark, sf):
    return clean_corpus(spark, sf).groupBy("source").agg(F.count("*").alias("docs"), F.sum("words").alias("words"))


@query("decontam_exact", f"with {CORPUS}, {HELD} select count(*) as docs, count(*) filter (key in (select key from held)) as hits, (select count(*) from held) as items from corpus")
def decontam_exact(spark, sf):
    rows, h = corpus(spark, sf).select("doc_id", "key"), held(spark, sf)
    hits = rows.join(h.keys, "key", "left_semi").agg(F.count("*").alias("hits"))
    return rows.agg(F.count("*").alias("docs")).join(hits).join(h.keys.agg(F.count("*").alias("items")))


@query("decontam_ngram", f"with {VERDICTS} select doc_id, verdict from verdicts")
def decontam_ngram(spark, sf):
    return held(spark, sf).verdicts(corpus(spark, sf), "doc_id")


@query("dedupe_first", f"with {CORPUS} select source, count(*) as kept from corpus where doc_id in (select min(doc_id) from corpus group by key) group by source")
def dedupe_first(spark, sf):
    return decontam.first_of_key(corpus(spark, sf).select("doc_id", "source", "key"), "key", "doc_id").groupBy("source").agg(F.count("*").alias("kept"))


@query("decontaminate_v1", f"with {CORPUS}, {HELD} select source, count(*) as kept from corpus where doc_id in (select min(doc_id) from corpus where key not in (select key from held) group by key) group by source")
def decontaminate_v1(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select(question_key(F.col("text")).alias("key"))
    return decontam.without_held_out(corpus(spark, sf).select("doc_id", "source", "key"), items, "key", "key", "doc_id").groupBy("source").agg(F.count("*").alias("kept"))


ENTRIES = [mix.Entry("src0", "en", 12), mix.Entry("src1", "en", 20), mix.Entry("src2", "fr", 3), mix.Entry("src3", "en", 15)]
MIX_MAX = 800


def mix_rows(spark, sf):
    rows, h = corpus(spark, sf).where(F.col("source").isin([e.name for e in ENTRIES])), held(spark, sf)
    named = rows.join(h.verdicts(rows, "doc_id"), "doc_id", "left")
    pos = F.row_number().over(split.Window.partitionBy("source").orderBy("doc_id")) - 1
    return named.select(F.col("source").alias("name"), pos.alias("pos"), F.col("lang").alias("kind"), "key", (ascii_share(F.col("text")) >= 0.9).alias("usable"), "verdict", F.col("words").alias("length"), "doc_id")


def _mix_sql() -> str:
    parts = [f"{VERDICTS}, pool as (select c.doc_id, source as name, row_number() over (partition by source order by c.doc_id) - 1 as pos, lang as kind, key, verdict, words as length, "
             "len(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / len(text) >= 0.9 as usable from corpus c left join verdicts v on c.doc_id = v.doc_id)"]  # fmt: skip
    known = "select key from pool where false"
    for k, e in enumerate(ENTRIES):
        parts.append(f"first{k} as (select key, min(pos) as pos from pool where name = '{e.name}' and pos < {8 * e.target} and usable and kind = '{e.kind}' and verdict is null group by key)")
        parts.append(f"""r{k} as (select p.*, case when not usable then 'unusable' when kind <> '{e.kind}' then 'other_kind' when verdict is not null then verdict
            when p.key in ({known}) or p.pos <> f.pos then 'duplicate' when length > {MIX_MAX} then 'too_long' else 'kept' end as reason
            from pool p left join first{k} f on p.key = f.key where name = '{e.name}' and p.pos < {8 * e.target})""")
        parts.append(f"s{k} as (select * from (select *, coalesce(sum((reason = 'kept')::int) over (order by pos rows between unbounded preceding and 1 preceding), 0) as before from r{k}) where before < {e.target})")
        known += f" union all select key from s{k} where reason in ('duplicate', 'too_long', 'kept')"
    return "with " + ", ".join(parts)


_REASON_COLS = ", ".join(f"count(*) filter (reason = '{r}') as {r}" for r in mix.REASONS)
_SEEN = " union all ".join(f"select {k} as entry_no, '{e.label}' as entry, * from s{k}" for k, e in enumerate(ENTRIES))


@query("mix_funnel", f"{_mix_sql()} select entry_no, entry, count(*) as seen, {_REASON_COLS} from ({_SEEN}) group by entry_no, entry")
def mix_funnel(spark, sf):
    return mix.funnel(mix.fill(mix_rows(spark, sf), ENTRIES, MIX_MAX)[0])


@query("mix_summary", f"{_mix_sql()} select name, count(*) as rows, avg((length > 300)::int) as long, count(*) / sum(count(*)) over () as fraction from ({_SEEN}) where reason = 'kept' group by name")
def mix_summary(spark, sf):
    return mix.shares(mix.fill(mix_rows(spark, sf), ENTRIES, MIX_MAX)[1], "name", long=F.col("length") > 300)


@query("length_stats", f"with {CORPUS} select lang, count(words) as n, min(words) as min, avg(words) as mean, max(words) as max, " + ", ".join(f"quantile_disc(words, {q}) as {n}" for n, q in (("median", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))) + " from corpus group by lang")
def length_stats(spark, sf):
    return corpus(spark, sf).groupBy("lang").agg(*mix.length_stats("words"))


@query("max_seq", f"with {CORPUS} select least(3072, cast(ceil(quantile_disc(words, 0.99) / 64) * 64 as int)) as capped, greatest(256, cast(ceil(max(words) / 64) * 64 as int)) as longest from corpus")
def max_seq(spark, sf):
    return corpus(spark, sf).agg(mix.sequence_cap("words", 3072).alias("capped"), mix.sequence_cap_of_longest("words").alias("longest"))


@query("drop_overlength", f"with {CORPUS} select source, count(*) as kept from corpus where words <= (select least(1024, cast(ceil(quantile_disc(words, 0.99) / 64) * 64 as int)) from corpus) group by source")
def drop_overlength(spark, sf):
    rows = corpus(spark, sf).select("source", "words")
    return mix.within(rows, "words", rows.agg(mix.sequence_cap("words", 1024))).groupBy("source").agg(F.count("*").alias("kept"))


PAIRS = (
    f"{_grams('documents', 'doc_id', 5, _sql_plain('text'), 'g')}, sizes as (select doc_id, count(*) as size from g group by doc_id), few as (select gram from g group by gram having count(*) between 2 and 50), "
    "proposed as (select distinct x.doc_id as a, y.doc_id as b from g x join g y using (gram) where x.doc_id < y.doc_id and gram in (select gram from few)), "
    "shared as (select a, b, count(*) as n from proposed join g x on x.doc_id = a join g y on y.doc_id = b and y.gram = x.gram group by a, b), "
    "pairs as (select a, b, n / (sa.size + sb.size - n) as jaccard from shared join sizes sa on sa.doc_id = a join sizes sb on sb.doc_id = b where n / (sa.size + sb.size - n) >= 0.8)"
)


def near_pairs(spark, sf):
    return neardup.near_pairs(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")


@query("near_dup_pairs", f"with {PAIRS} select a, b, jaccard from pairs")
def near_dup_pairs(spark, sf):
    return near_pairs(spark, sf)


@query("near_dup_flags", f"with {PAIRS} select source, count(*) as flagged, cast(sum(n) as bigint) as links from (select doc_id, count(*) as n from (select a as doc_id from pairs union all select b from pairs) group by doc_id) join documents using (doc_id) group by source")
def near_dup_flags(spark, sf):
    ends = neardup.in_pairs(near_pairs(spark, sf)).withColumnRenamed("id", "doc_id")
    return ends.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("flagged"), F.sum("n_pairs").alias("links"))


@query("near_dup_cross_source", f"with {PAIRS} select count(*) as pairs, count(*) filter (x.source <> y.source) as cross_pairs from pairs join documents x on x.doc_id = a join documents y on y.doc_id = b")
def near_dup_cross_source(spark, sf):
    labels = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("source").alias("label"))
    return neardup.cross_label(near_pairs(spark, sf), labels)


@query("exact_dup_counts", f"with {CORPUS}, n as (select *, count(*) over (partition by key) as n from corpus) select source, cast(count(*) filter (n > 1) as bigint) as duplicates from n group by source")
def exact_dup_counts(spark, sf):
    return audit.duplicate_rows(corpus(spark, sf), "key", "source")


@query("dup_response_counts", f"with c as (select role, {_sql_key('text')} as key from conversations), n as (select *, count(*) over (partition by key) as n from c) select role, cast(count(*) filter (n > 1) as bigint) as duplicates from n group by role")
def dup_response_counts(spark, sf):
    return audit.duplicate_rows(spark.read.parquet(f"{sf}/conversations.parquet").select("role", question_key(F.col("text")).alias("key")), "key", "role")


@query("english_screen", f"with e as (select lang, len(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / nullif(len(text), 0) >= 0.97 as en, regexp_matches(text, '{MEDICAL.replace(chr(39), chr(39) * 2)}') as med from documents) select lang, count(*) as docs, count(*) filter (en) as english, count(*) filter (med) as medical from e group by lang")
def english_screen(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(is_english(F.col("text"))).alias("english"), F.count_if(looks_medical(F.col("text"))).alias("medical"))


@query("degenerate_repetition", r"with l as (select doc_id, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) as line from documents), r as (select doc_id from l where len(line) >= 30 group by doc_id, line having count(*) >= 3) select source, count(*) as looping from documents where doc_id in (select doc_id from r) group by source")
def degenerate_repetition(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").where(T.looping(F.col("text"))).groupBy("source").agg(F.count("*").alias("looping"))


_END = "right(regexp_replace(text, '\\s+$', ''), 1)"


@query("unterminated", f"select lang, count(*) filter ({_END} not in ('.', '?', '!', ')', ']', '\"', '''', '*', '`', '')) as cut_off from documents group by lang")
def unterminated(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").groupBy("lang").agg(F.count_if(T.unterminated(F.col("text"))).alias("cut_off"))


def _sq(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@query("style_features", f"select lang, avg(regexp_matches(text, {_sq(T.FIRST_PERSON)})::int) as first_person_open, avg(regexp_matches(text, {_sq(T.MARKDOWN)})::int) as markdown, avg(regexp_matches(text, {_sq(T.GRAPH_STYLE)})::int) as kg_template, cast(sum(len(regexp_extract_all(text, {_sq(T.SELF_CHECK)}))) as bigint) as self_checks from documents group by lang")
def style_features(spark, sf):
    text = F.col("text")
    flags = T.style_flags(text)
    return spark.read.parquet(f"{sf}/documents.parquet").groupBy("lang").agg(*(F.avg(flags[k].cast("double")).alias(k) for k in ("first_person_open", "markdown", "kg_template")), F.sum(F.regexp_count(text, F.lit(T.SELF_CHECK))).alias("self_checks"))


@query("chat_render", "select conv_id, count(*) as turns, md5(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by turn)) as digest from conversations group by conv_id")
def chat_render(spark, sf):
    from millrace.functions.chat import render

    turns = spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"), F.lit(None).cast("string").alias("reasoning_content")))).alias("m"))
    return turns.select("conv_id", F.size("m").cast("long").alias("turns"), F.md5(render(F.col("m")).cast("binary")).alias("digest"))


@query("shard_chunks", "with p as (select row_number() over (order by doc_id desc) - 1 as place, doc_id from documents) select place // 100 as chunk, count(*) as docs, cast(sum(1234 * 1000003 + place + 100003) as bigint) as seeds from p where place % 3 = 1 group by chunk")
def shard_chunks(spark, sf):
    placed = split.place(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id"), F.col("doc_id").desc())
    part = split.shard(placed, 1, 3).withColumn("chunk", split.chunk("place", 100))
    return part.groupBy("chunk").agg(F.count("*").alias("docs"), F.sum(split.batch_seed(1234, F.col("place"), F.lit(1))).alias("seeds"))


@query("stage_order", "select doc_id from documents order by doc_id limit 40")
def stage_order(spark, sf):
    return split.stage_order(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id"), "letter", "medqa", 1234, 40, "doc_id", "doc_id")


@query("train_val_split", "select case when rn <= 50 then 'val' else 'train' end as split, count(*) as docs, cast(sum(doc_id) as bigint) as ids from (select doc_id, row_number() over (order by md5(cast(doc_id as varchar)), doc_id) as rn from documents) group by 1")
def train_val_split(spark, sf):
    rows = split.train_val(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id"), 50, F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
    return rows.groupBy("split").agg(F.count("*").alias("docs"), F.sum("doc_id").alias("ids"))


_POOL_SQL = f"""with {VERDICTS}, cand as (select * from corpus where doc_id not in (select doc_id from verdicts) and source in ('src1', 'src2') and doc_id in (select min(doc_id) from corpus where doc_id not in (select doc_id from verdicts) and source in ('src1', 'src2') group by key)),
 n as (select *, row_number() over (partition by source order by doc_id) as rn from cand), dev as (select * from n where rn <= 8),
 dgr as (select distinct dg.doc_id, gram from dg join dev on dg.doc_id = dev.doc_id), dsz as (select doc_id, count(*) as size from dgr group by doc_id),
 near as (select x.doc_id from n x join dg on dg.doc_id = x.doc_id join dgr on dgr.gram = dg.gram join dsz on dsz.doc_id = dgr.doc_id where x.rn > 8 group by x.doc_id, dgr.doc_id, dsz.size having count(*) >= 0.5 * dsz.size),
 rest as (select *, row_number() over (partition by source order by doc_id) as k from n where rn > 8 and doc_id not in (select doc_id from near) and key not in (select key from dev))
 select 'dev' as part, source, doc_id from dev union all select 'pool', source, doc_id from rest where k <= 20"""


@query("split_pool", _POOL_SQL)
def split_pool(spark, sf):
    rows = corpus(spark, sf).where(F.col("source").isin("src1", "src2"))
    cand = rows.join(held(spark, sf).verdicts(rows, "doc_id"), "doc_id", "left_anti").withColumnRenamed("doc_id", "pos")
    dev, pool = split.split_pool(cand, {"src1": 8, "src2": 8}, {"src1": 20, "src2": 20}, lambda r, d: decontam.HeldOut(d, "text").verdicts(r, "pos").select("pos"))
    both = dev.select(F.lit("dev").alias("part"), "source", "pos").unionByName(pool.select(F.lit("pool").alias("part"), "source", "pos"))
    return both.withColumnRenamed("pos", "doc_id")


@query("merge_sets", "select set_no, count(*) as rows from (select 0 as set_no from documents where lang = 'de' union all select 1 from documents where lang = 'es') group by set_no")
def merge_sets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    return split.merge_sets(docs.where("lang = 'de'"), docs.where("lang = 'es'"), seed=7, id_col="doc_id").groupBy("set_no").agg(F.count("*").alias("rows"))


@query("sample_sheet", "select lang, least(5, count(*)) as sampled from documents group by lang")
def sample_sheet(spark, sf):
    from millrace.sources.io import sample_sheet as sheet

    return sheet(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "lang", 5, 42, "doc_id").groupBy("lang").agg(F.count("*").alias("sampled"))


@query("size_guard", "select source, cast(50 as bigint) as expected, count(*) as found, count(*) = 50 as ok from documents group by source")
def size_guard(spark, sf):
    from millrace.operators.guards import size_report

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("source")
    return size_report(docs, "source", docs.select("source").distinct().withColumn("expected", F.lit(50).cast("long")))
