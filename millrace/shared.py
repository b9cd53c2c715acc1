"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir where the cluster names one.

    Only where a session on this machine alone (master local) names none, a temporary folder stands in.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return qualified(spark, named)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="millrace-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark reads it by, so that workers open the same file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")
    return "file://" + full[5:] if re.match("file:/(?!/)", full) else full


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/millrace/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a table made by written() that nothing reads any more."""
    path = getattr(df, "_millrace_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
