"""Reliable cuts of lineage in the folder that the cluster names in spark.checkpoint.dir, and rows dealt out before they multiply."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder.  Rows, their partitions and their order there stay as they are, also after a lost executor."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="larkspur-"))
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df over as many partitions as hold about so many rows each, by keys that are (nearly) unique.

    A small file is one split, and what multiplies its rows afterwards would do so in one task; the planner's sizes do not tell it that rows multiply.
    What is grouped by the keys afterwards needs no other shuffle.  Counting a Parquet table reads its footers only.
    """
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(least, -(-df.count() // rows)), *keys)
