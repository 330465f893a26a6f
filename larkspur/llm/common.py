"""What the operators of this subpackage share: tables, the shared folder, row streams, packing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of other characters than these six.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conf(spark: SparkSession, key: str, default: str | None = None) -> str | None:
    try:
        return spark.conf.get(key, default)
    except Exception:  # the key is unknown to this session
        return default


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where that is unset one is made, in local mode only."""
    found = conf(spark, "spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(spark, "_larkspur_shared", None)
    if own is None:
        own = spark._larkspur_shared = "file://" + tempfile.mkdtemp(prefix="larkspur-")
    return own


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: it outlives executors and goes when nothing refers to it.

    A checkpointed frame carries the size estimate and constraints of its plan.  The estimate of a join is a product, so
    over the turns of a loop its digits double each time; the frame is therefore made anew from the checkpoint's rows.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    done = df.checkpoint(eager=True)
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), spark)


def release(spark: SparkSession) -> None:
    """Collect on the driver: shuffle files that a checkpoint has made needless go now, and not with the driver's next collection.

    What refers to them goes in two turns: first the frames and their plans, then the exchanges of these.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


#: Ids of 8 bytes: a table of at most so many is broadcast, a larger one is joined by a shuffle.
BROADCAST_IDS = 2_000_000


def near(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A table of ids that is cut or cheap to read, marked for broadcast if a count shows that it is small enough."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def hash_sample(df: DataFrame, n: int, *keys: str, rows: int | None = None) -> DataFrame:
    """The n rows with the least hash of some columns, or all if there are fewer; cut, so that it is taken once.

    Their number, counted here if it is not given, tells which hashes can be among them; so all tasks send about 2 n rows in
    all, and not n each.  Where few distinct columns fill many rows, too few of these may have such a hash; then tasks do send n each.
    """
    rows = df.count() if rows is None else rows
    h = F.xxhash64(*keys)
    if rows > 2 * n:
        found = cut(df.where(h < F.lit(int(-(1 << 63) + (1 << 64) * (2 * n / rows)))).orderBy(h, *keys).limit(n))
        if found.count() == n:
            return found
    return cut(df.orderBy(h, *keys).limit(n))


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """Arrow batches of at most so many bytes go between executors and Python workers in this session, unless it sets a size itself.

    Batches of 10,000 long texts are large, and both sides and the buffers between them hold one or more.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf(spark, key) == "67108864b":  # Spark's own
        spark.conf.set(key, most)


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/larkspur-{what}-{uuid.uuid4().hex[:12]}"


def partitions(spark: SparkSession) -> int:
    return max(1, int(conf(spark, "spark.sql.shuffle.partitions", "200")))


def id_column(df: DataFrame, name: str = "doc_id"):
    return F.col(name).cast("bigint").alias(name)


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id and text of every document; a null text is empty."""
    return docs.select(id_column(docs), *extra, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of a column: a batch of long texts never is one piece of work."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        start, size = 0, 0
        for i, n in enumerate(pa.compute.binary_length(values).to_pylist()):
            size += n or 0
            if size >= most:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def give_back() -> None:
    """Return freed memory to the system: a worker process lives on after its task, beside others on its executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library may have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def freed(f):
    """A function of batches that gives memory back when a task ends."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
