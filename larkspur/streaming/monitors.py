"""Polling monitors as structured streams: health of whole histories once for each new checkpoint, progress counts, resumable work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.timeseries import health_records


def history_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


METRICS = ("loss", "grad_norm", "learning_rate", "mean_token_accuracy")


def merged_tails(held: DataFrame | None, fresh: DataFrame, by: str, n: int, batch: int, quiet: int) -> DataFrame:
    """The last n rows of each variant by step: those held, then those of a micro-batch.  A step that is held already stays as it is.

    `told` is the step that the variant's last record had, `touched` the last batch with a row of it.  Variants without rows in
    `quiet` batches are forgotten, so there are at most n rows of each variant that still runs.
    """
    names = [by, "step", *METRICS]
    x = fresh.where("loss is not null and step is not null").select(by, F.col("step").cast("bigint").alias("step"), *(F.col(c).cast("double").alias(c) for c in METRICS))
    x = x.withColumns({"told": F.lit(None).cast("bigint"), "touched": F.lit(batch).cast("bigint"), "_new": F.lit(1)})
    if held is not None:
        x = held.where(F.col("touched") >= batch - quiet).withColumn("_new", F.lit(0)).unionByName(x)
    once = Window.partitionBy(by, "step").orderBy("_new", *METRICS)
    last = Window.partitionBy(by).orderBy(F.desc("step"))
    x = x.withColumn("_k", F.row_number().over(once)).where("_k = 1").withColumn("_k", F.row_number().over(last)).where(F.col("_k") <= n)
    every = Window.partitionBy(by)
    return x.select(*names, F.max("told").over(every).alias("told"), F.max("touched").over(every).alias("touched"))


def watch_health(stream: DataFrame, emit: Callable[[DataFrame, int], None], checkpoint: str, by: str = "variant", n: int = 100, quiet: int = 10_000):
    """`health_records` over all rows that have come so far, for each variant whose last step has grown: once for each (variant, step).

    What a record needs of the past, the last n rows of each variant, is a table beside the checkpoint: batch k reads the one that
    batch k - 1 wrote and writes the other, so a batch that runs again after a failure finds the same past.  Such a batch calls
    `emit` again with the same number, and `once_by_batch` makes a sink of that.  Rows that come late or again count as `merged_tails` says.
    """
    slot = lambda k: f"{checkpoint}/tails-{k % 2}"

    def batch(df: DataFrame, k: int) -> None:
        spark = df.sparkSession
        held = spark.read.parquet(slot(k - 1)).drop("grown") if k else None
        tails = merged_tails(held, df, by, n, k, quiet)
        # The record of a variant is told when its step is the table's.
        grown = (F.max("step").over(Window.partitionBy(by)) > F.coalesce("told", F.lit(-1))).alias("grown")
        now = tails.select("*", grown).withColumn("told", F.max("step").over(Window.partitionBy(by)))
        now.write.mode("overwrite").parquet(slot(k))
        emit(health_records(spark.read.parquet(slot(k)).where("grown"), by, n), k)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_by_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for `watch_health`: a folder for each batch, which a batch that runs again replaces."""
    return lambda df, k: df.write.mode("overwrite").parquet(f"{path}/batch={k}")


def progress_counts(stream: DataFrame, by: str) -> DataFrame:
    """Rows so far by run, for the update or complete output mode."""
    return stream.groupBy(by).agg(F.count(F.lit(1)).alias("rows"))


def resume(stream: DataFrame, path: str, checkpoint: str):
    """Append what is new since the last call; each input file is handled once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_telemetry(stream: DataFrame, emit: Callable[[DataFrame, int], None], checkpoint: str, by: str = "run_name", seconds: int = 5):
    """Device and checkpoint telemetry (run_name, at, checkpoint, used_mb, busy): one record for each run and interval of some seconds.

    at is the event time; records later than ten intervals are dropped, and so is the state of older ones.
    """
    late = f"{10 * seconds} seconds"
    g = stream.withWatermark("at", late).groupBy(F.window("at", f"{seconds} seconds").alias("w"), by)
    out = g.agg(F.max("checkpoint").alias("checkpoint"), F.max("used_mb").alias("used_mb"), F.avg("busy").alias("busy"), F.count(F.lit(1)).alias("records"))
    flat = out.select(by, F.col("w.start").alias("at"), "checkpoint", "used_mb", "busy", "records")
    return flat.writeStream.outputMode("append").foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
