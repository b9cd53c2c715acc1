"""A corpus from raw documents: drop toxic ones, keep known languages, one of each near-copy, mix sources, pack.

Each stage is (name, function of (spark, docs, sf_dir)); its rows are written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import fold, fresh_path, table, written
from millrace.llm.langid import fit as fit_languages
from millrace.llm.langid import identify
from millrace.llm.mixing import mixed
from millrace.llm.near_copies import one_of_each
from millrace.llm.packing import pack, pieces
from millrace.llm.toxicity import fit as fit_toxicity
from millrace.llm.toxicity import score_toxicity
from millrace.session import prepared


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half (operator 6), each row as it is.

    A null or empty text has no words and stays, as the rate of toxic labels among such texts is below
    one half, if any are labelled at all; so do texts that share no word with an example. Rows that
    repeat go or stay together, null ids are scored but never learned from, ids without a label too.
    Without any label nothing goes; an empty table stays empty.
    """
    prepared(spark)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return _kept(docs, lambda d: score_toxicity(d, model), "toxic_score < 0.5")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence (operator 10), each row as it is.

    Null and empty texts, and those without a letter, are rejected. Rows without lang, and rows with a
    null id, are told like others. With one language or none in lang, nothing is told from another: a
    text with letters stays if there is one, and goes if there is none. An empty table stays empty.
    """
    prepared(spark)
    model = fit_languages(docs, fold("doc_id", 4) != 2)
    return _kept(docs, lambda d: identify(d, model), "not lang_rejected")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: five-word shingles, Jaccard similarity 0.8 or more.

    Candidates are links of SimHash fingerprints (operator 2) and, as those reach the closest copies only,
    sets that share a band of min-hashes; all are verified by the exact similarity. First is the smallest id, null ids last; then the least hash of the text; of rows that repeat both,
    the one whose columns have the least hash. Null, empty and blank texts are copies of one another;
    texts of fewer than five words are one shingle. An empty table stays empty.
    """
    prepared(spark)
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that a mix of the sources by weights 1, 2, 3 takes, in the mix's order (operator 9).

    A row for each run of words that a pass over its source takes of a document, with the document's
    other columns. Null sources are one source, the last; null, empty and blank texts give no row;
    rows that repeat are mixed each; an empty table stays empty.
    """
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence of at most 2048 tokens and their place in it (operator 5).

    A null or empty text is one piece of its end id. Rows that repeat, or have a null id, are packed
    each; equal pieces may change places. Other columns are left out; an empty table gives no rows.
    """
    prepared(spark)
    return pack(written(pieces(docs, 2048), "pieces"), 2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _kept(docs: DataFrame, decide, keep: str) -> DataFrame:
    """The rows of docs for which keep holds among the columns that decide adds, which may have names of docs' own."""
    own = ["text" if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)]
    return decide(docs.toDF(*own)).where(keep).select(*(F.col(o).alias(c) for o, c in zip(own, docs.columns)))


STAGES = [("toxicity", toxicity), ("language", language), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Learned models, fingerprints and token ids aren't SQL; tests/llm compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
