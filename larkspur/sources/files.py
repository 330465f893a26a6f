"""Scans and sinks: schema-gated JSONL, CSV, manifests, line counts, fingerprints, resumption."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from fnmatch import fnmatchcase
from hashlib import sha256

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.text import is_json_object
from ..schemas import SCHEMAS


def read_jsonl(spark: SparkSession, paths, schema=None) -> DataFrame:
    """JSON objects, one a line, by a fixed schema; blank lines are skipped and a bad line fails the read."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).json(paths)


def bad_lines(spark: SparkSession, paths) -> DataFrame:
    """path and text of lines that are neither blank nor one JSON object."""
    lines = spark.read.text(paths).select(F.input_file_name().alias("path"), "value").where(F.trim("value") != "")
    return lines.where(~is_json_object(F.col("value")))


def numbered_lines(spark: SparkSession, paths, bad: bool = False) -> DataFrame:
    """path, line (from 1) and value of every line, or of the bad ones, however files are split.

    A task reads the lines that begin in its block of a file, in order.  Lines are counted by block first; the counts of the blocks before, and
    a line's place in its own block, give its number.  Ends of line are those of the reader: LF, CR LF or CR.
    """
    place = F.monotonically_increasing_id()
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), place.alias("_i"))
    blocks = lines.groupBy("path", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    # A row for each block; a window has those of one file.
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select("path", "_block", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    some = lines.where((F.trim("value") != "") & ~is_json_object(F.col("value"))) if bad else lines
    return some.join(offsets, ["path", "_block"]).select("path", (F.col("_i") + F.col("_shift")).alias("line"), "value")


def numbered_bad_lines(spark: SparkSession, paths) -> DataFrame:
    """The lines of bad_lines with their numbers."""
    return numbered_lines(spark, paths, bad=True)


def read_tagged(spark: SparkSession, paths, tag: str, key: str = "sample_id") -> DataFrame:
    """Records of one schema version; other tags, keys that are missing, blank or repeated, are an error."""
    rows = read_jsonl(spark, paths, SCHEMAS[tag])
    wrong = rows.where(~F.col("schema_version").eqNullSafe(tag)).limit(1).count()
    if wrong:
        raise ValueError(f"a record is not tagged {tag}")
    refuse_keys(rows, [key])
    return rows


def refuse_keys(rows: DataFrame, keys: list[str]) -> None:
    """An error if a key is null or blank, or if the keys of two rows are the same."""
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "")
    if rows.where(blank).limit(1).count():
        raise ValueError(f"{', '.join(keys)}: a value is missing or blank")
    if rows.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"{', '.join(keys)}: repeats")


def read_runs(spark: SparkSession, runs: dict[str, str], expected: set[str] | None = None, schema=None, key: str | None = None) -> DataFrame:
    """Named inputs NAME -> path as one frame with run_name; the set of names may be fixed.  With a key, one that a run repeats or lacks is an error."""
    if expected is not None and set(runs) != expected:
        raise ValueError(f"runs differ from the expected set: {sorted(set(runs) ^ expected)}")
    out = None
    for name, path in runs.items():
        x = read_jsonl(spark, path, schema).withColumn("run_name", F.lit(name))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    if key is not None and out is not None:
        refuse_keys(out, ["run_name", key])
    return out


def parse_seed_input(value: str) -> tuple[str, int, str, str]:
    """FAMILY:SEED:STATUS:PATH."""
    family, seed, status, path = value.split(":", 3)
    if status not in ("pilot", "confirmatory", "corrective") or not family or not path:
        raise ValueError(f"not FAMILY:SEED:STATUS:PATH: {value!r}")
    return family, int(seed), status, path


def write_jsonl(df: DataFrame, path: str, compression: str | None = None) -> int:
    """Write with keys in order of name; the job's committer makes it appear at once.  The number of rows, observed while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    writer = df.select(*sorted(df.columns)).observe(seen, F.count(F.lit(1)).alias("n")).write
    (writer.option("compression", compression) if compression else writer).json(path)
    return seen.get["n"]


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """A small table as one file with a header and a fixed order of fields."""
    df.select(*fields).coalesce(1).write.option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, blank_is_missing: bool = True) -> DataFrame:
    """By a fixed schema; a file without one of its columns, or with a value of another type, is an error."""
    wanted = {f.name for f in spark.createDataFrame([], schema).schema}
    lacking = wanted - set(spark.read.option("header", True).csv(path).columns)
    if lacking:
        raise ValueError(f"{path} has no column {', '.join(sorted(lacking))}")
    reader = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
    return (reader.option("nullValue", "") if blank_is_missing else reader).csv(path)


def write_tokens(df: DataFrame, path: str) -> None:
    df.select("row_index", "input_ids", "completion_mask").write.parquet(path)


def select_rows(df: DataFrame, wanted: DataFrame, index: str = "row_index") -> DataFrame:
    return df.join(wanted.select(index), index, "left_semi")


def indexed_rows(spark: SparkSession, path: str, index: str = "row_index") -> DataFrame:
    """The rows of Parquet files with their places from 0: files in order of path, rows in the order of the file, by what the reader knows of them."""
    x = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = x.groupBy("_file").agg((F.max("_row") + 1).alias("_n"))
    # A row for each file.
    before = F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_file", F.coalesce(before, F.lit(0)).alias("_before"))
    return x.join(F.broadcast(offsets), "_file").withColumn(index, F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")


def take_rows(df: DataFrame, wanted: DataFrame, order: str, index: str = "row_index") -> DataFrame:
    """The rows at a list of places (order, index), in the order of the list and as often as it names them.

    A place that no row has is an error when the rows are read.
    """
    there = df.withColumn("_there", F.lit(True))
    x = wanted.select(order, index).join(there, index, "left")
    lost = F.raise_error(F.concat(F.lit("no row at "), F.coalesce(F.col(index).cast("string"), F.lit("null"))))
    return x.where(F.when(F.col("_there"), F.lit(True)).otherwise(lost)).drop("_there").orderBy(order)


def line_counts(spark: SparkSession, paths) -> DataFrame:
    lines = spark.read.text(paths).select(F.input_file_name().alias("path"), "value")
    return lines.groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.length(F.trim("value")) > 0).alias("non_blank"))


#: Bytes of a file that are read at a time.
CHUNK = 1 << 20


def _fed(digest, path: str, chunk: int) -> None:
    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_stream(at) as f:
        while piece := f.read(chunk):
            digest.update(piece)


def listed_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and bytes of every file below a folder, empty ones too, or of a file; contents are not read.  The driver lists, as for any scan."""
    store, at = fs.FileSystem.from_uri(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    found = store.get_file_info(at)
    found = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    rows = [(prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatchcase(f.base_name, pattern)]
    return spark.createDataFrame(rows, "path string, bytes bigint")


def manifest(spark: SparkSession, path: str, pattern: str = "*", chunk: int = CHUNK) -> DataFrame:
    """path, bytes and SHA-256 of every file below a folder.  Files are dealt out and each is read in chunks, whatever its size."""

    def hashed(batches):
        for b in batches:
            sums = []
            for p in b.column(0).to_pylist():
                digest = sha256()
                _fed(digest, p, chunk)
                sums.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sums, pa.string())], names=["path", "bytes", "sha256"])

    tasks = 4 * spark.sparkContext.defaultParallelism
    return listed_files(spark, path, pattern).repartition(tasks, "path").mapInArrow(hashed, "path string, bytes bigint, sha256 string")


def manifest_totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def folder_fingerprint(files: DataFrame, root: str, chunk: int = CHUNK) -> DataFrame:
    """The SHA-256 of a folder: for each file in order of its path, folder by folder, the relative path, a NUL and the bytes.

    It is one digest over all bytes, so one task reads them, in chunks.  An empty folder is an error when the row is read.
    """
    top = root.rstrip("/") + "/"

    def whole(batches):
        digest, paths = sha256(), [p for b in batches for p in b.column(0).to_pylist() if p is not None]
        if not paths:
            raise ValueError(f"no files below {root}")
        for p in sorted(paths, key=lambda p: p.removeprefix(top).split("/")):
            digest.update(p.removeprefix(top).encode() + b"\0")
            _fed(digest, p, chunk)
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], names=["fingerprint"])

    one = files.sparkSession.range(1).select(F.lit(None).cast("string").alias("path"))  # so that the task also runs for no files
    return files.select("path").unionByName(one).repartition(1).mapInArrow(whole, "fingerprint string")


def latest_checkpoint(files: DataFrame) -> DataFrame:
    """The path with the largest number after checkpoint-, by number and not by text."""
    n = F.regexp_extract("path", r"checkpoint-(\d+)$", 1)
    x = files.withColumn("step", n).where("step <> ''").withColumn("step", F.col("step").cast("bigint"))
    return x.agg(F.max_by("path", "step").alias("path"), F.max("step").alias("step"))


class OneFile(DataSource):
    """A sink of texts as one file: tasks write parts beside it, and the commit joins them in order of their partitions.

    The file appears at once, under its name and whole; if a task fails for good, parts go and nothing is left.  Options: path, and
    `head`, `between` and `tail` around the texts.
    """

    @classmethod
    def name(cls) -> str:
        return "larkspur_file"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return OneFileWriter(self.options, overwrite)


class OneFileWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.head, self.between, self.tail = (options.get(k, "").encode() for k in ("head", "between", "tail"))
        self.parts = f"{self.path}._parts-{uuid.uuid4().hex}"

    def write(self, rows) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, folder = fs.FileSystem.from_uri(self.parts)
        store.create_dir(folder, recursive=True)
        number, n = TaskContext.get().partitionId(), 0
        name = f"{number:08d}-{uuid.uuid4().hex}"
        with store.open_output_stream(f"{folder}/{name}") as f:
            for row in rows:
                f.write((self.between if n else b"") + row[0].encode())
                n += 1
        return PartWritten(name, n)

    def commit(self, messages) -> None:
        store, at = fs.FileSystem.from_uri(self.path)
        folder = fs.FileSystem.from_uri(self.parts)[1]
        if not self.overwrite and store.get_file_info(at).type != fs.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(self.path)
        whole = f"{folder}/whole"
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(whole) as out:
            out.write(self.head)
            seen = False
            for m in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.name):
                out.write(self.between if seen else b"")
                seen = True
                with store.open_input_stream(f"{folder}/{m.name}") as part:
                    while piece := part.read(CHUNK):
                        out.write(piece)
            out.write(self.tail)
        store.move(whole, at)
        store.delete_dir(folder)

    def abort(self, messages) -> None:
        store, folder = fs.FileSystem.from_uri(self.parts)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


@dataclass
class PartWritten(WriterCommitMessage):
    name: str
    rows: int


def sorted_json(df: DataFrame) -> Column:
    """A row as JSON with names in order, nulls included."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"})


def write_file(texts: DataFrame, path: str, overwrite: bool = True, **options: str) -> None:
    """One file of the texts of a frame's only column, in order of its partitions; see OneFile."""
    texts.sparkSession.dataSource.register(OneFile)
    texts.write.format("larkspur_file").options(path=path, **options).mode("overwrite" if overwrite else "append").save()


def write_jsonl_file(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """One JSONL file with sorted names."""
    write_file(df.select(F.concat(sorted_json(df), F.lit("\n"))), path, overwrite)


def write_report(path: str, frames: dict[str, DataFrame]) -> None:
    """A report: tables by name, in order, each a list of records with sorted names, in one JSON document."""
    out = None
    for k, name in enumerate(sorted(frames)):
        df = frames[name]
        opening = ("" if k == 0 else ",\n") + json.dumps(name, ensure_ascii=False) + ": ["
        edge = lambda t, o: df.sparkSession.createDataFrame([(2 * k, o, t)], "k int, o int, t string").coalesce(1)  # noqa: B023, E731
        rows = df.select(F.lit(2 * k).alias("k"), F.lit(1).alias("o"), sorted_json(df).alias("t"))
        # The first record of each partition begins a line, all others follow a comma; empty texts stand for none.
        lines = edge(opening, 0).unionByName(_separated(rows)).unionByName(edge("]", 2))
        out = lines if out is None else out.unionByName(lines)
    if out is None:
        raise ValueError("a report has one table at least")
    write_file(out.select("t"), path, head="{", tail="}\n")


def _separated(rows: DataFrame) -> DataFrame:
    """Records with a comma before each but the first of all, which is told by the first partition that has rows."""
    placed = rows.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    first = placed.agg(F.min("_i").alias("_first"))  # one row
    comma = F.when(F.col("_i") == F.col("_first"), "\n").otherwise(",\n")
    return placed.join(F.broadcast(first), F.lit(True), "left").select("k", "o", F.concat(comma, "t").alias("t"))
