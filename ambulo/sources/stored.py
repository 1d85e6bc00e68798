"""Tables that a plan with several outputs computes once."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder set, or the warehouse; a folder of its own in a local session."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known and spark.sparkContext.master.startswith("local"):
        known = f"file://{tempfile.mkdtemp(prefix='ambulo-')}"
        spark.sparkContext.setCheckpointDir(known)
    return known or spark.conf.get("spark.sql.warehouse.dir")


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written once to a table in the folder that driver and executors share; lost executors do not matter.

    The table stays until that folder is cleaned, as checkpoints do. Unlike cached rows it is on no executor, and unlike
    checkpointed ones it has a known size, by which joins are planned.
    """
    path = f"{_folder(df.sparkSession).rstrip('/')}/stored-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
