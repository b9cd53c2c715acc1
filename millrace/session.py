"""What a session needs so that Python workers find this package and get batches that fit their memory."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepared(spark: SparkSession) -> SparkSession:
    """Lets workers that start from now on import the package from where the driver has it.

    Where the session leaves the size of Arrow batches at Spark's 10,000 rows, it becomes 1,000: rows
    here hold whole texts, and a batch stands in the JVM and the worker at once.
    """
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1000")
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark
