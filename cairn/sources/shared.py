"""Tables written to the folder that the cluster's machines share: how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; set to a fresh local one only where it is unset and Spark runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again, so that what follows neither repeats nor loses its work.
    The tables of an application lie under cairn-<application id>; they may go when it has ended."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cairn-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch, where the session leaves Spark's 10,000: pages are long.
ARROW_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, str(ARROW_ROWS))
