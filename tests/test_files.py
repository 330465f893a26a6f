"""Files: line numbers of split files, rows by place, one-file sinks, streamed hashes."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from larkspur.sources import files


def test_line_numbers_of_split_files(spark, tmp_path):
    r = random.Random(3)
    kinds = ['{"a": 1}', "", "   ", "[1]", "x", '{"a": "' + "y" * 300 + '"}', '{"a": 1} z', "{"]
    want = {}
    for k, end in enumerate(("\n", "\r\n", "\n")):
        lines = [r.choice(kinds) for _ in range(6000 if k < 2 else 1)]
        if lines[-1] == "":
            lines[-1] = "x"
        path = tmp_path / f"{k}.jsonl"
        path.write_bytes(end.join(lines).encode() + (b"" if k == 0 else end.encode()))  # the first lacks its last end of line
        want |= {(path.name, n): line for n, line in enumerate(lines, 1)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        every = files.numbered_lines(spark, str(tmp_path))
        assert every.select(F.spark_partition_id()).distinct().count() > 1
        got = {(x.path.rsplit("/", 1)[1], x.line): x.value for x in every.collect()}
        bad = {(x.path.rsplit("/", 1)[1], x.line): x.value for x in files.numbered_bad_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want
    assert bad == {k: v for k, v in want.items() if v.strip() and v not in kinds[:1] + kinds[5:6]}


def test_rows_by_a_list_of_places(spark, tmp_path):
    spark.range(0, 40, 1, 4).withColumn("v", F.col("id") * 10).write.parquet(f"{tmp_path}/t")
    rows = files.indexed_rows(spark, f"{tmp_path}/t")
    assert sorted(x.row_index for x in rows.collect()) == list(range(40))
    place = {x.row_index: x.v for x in rows.collect()}
    for k, asked in enumerate(([5, 2, 2, 9], [39, 0, 39, 17, 17, 17], [])):
        wanted = spark.createDataFrame(list(enumerate(asked)), "n int, row_index bigint").repartition(3)
        got = files.take_rows(rows, wanted, "n").collect()
        assert [x.v for x in got] == [place[i] for i in asked], k
    for lost in (40, -1, None):
        with pytest.raises(Exception, match="no row at"):
            files.take_rows(rows, spark.createDataFrame([(0, 3), (1, lost)], "n int, row_index bigint"), "n").collect()


def test_one_file_of_many_tasks(spark, tmp_path):
    df = spark.range(0, 3000, 1, 7).select((F.col("id") * 2).alias("z"), F.when(F.col("id") % 3 > 0, F.concat(F.lit('é"\n'), F.col("id").cast("string"))).alias("a"))
    files.write_jsonl_file(df, f"{tmp_path}/x.jsonl")
    lines = (tmp_path / "x.jsonl").read_text(encoding="utf-8").split("\n")
    assert lines.pop() == "" and [json.loads(x)["z"] for x in lines] == list(range(0, 6000, 2)) and lines[0] == '{"a":null,"z":0}'
    files.write_report(f"{tmp_path}/r.json", {"b": df, "a": df.limit(1), "none": df.where("z < 0")})
    report = json.loads((tmp_path / "r.json").read_text(encoding="utf-8"))
    assert list(report) == ["a", "b", "none"] and len(report["b"]) == 3000 and report["none"] == [] and report["a"] == [{"a": None, "z": 0}]
    with pytest.raises(Exception, match="FileExists|exists"):
        files.write_jsonl_file(df, f"{tmp_path}/x.jsonl", overwrite=False)
    files.write_jsonl_file(df.limit(0), f"{tmp_path}/empty.jsonl", overwrite=False)
    assert (tmp_path / "empty.jsonl").read_bytes() == b"" and len(lines) == 3000
    assert sorted(p.name for p in tmp_path.iterdir()) == ["empty.jsonl", "r.json", "x.jsonl"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    odd = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("odd row"))).otherwise(F.col("id").cast("string")).alias("t"))
    with pytest.raises(Exception, match="odd row"):
        files.write_file(odd, f"{tmp_path}/x.txt")
    assert not list(tmp_path.iterdir())
    (tmp_path / "x.txt").write_text("old")
    with pytest.raises(Exception, match="odd row"):
        files.write_file(odd, f"{tmp_path}/x.txt")
    assert [p.name for p in tmp_path.iterdir()] == ["x.txt"] and (tmp_path / "x.txt").read_text() == "old"


def folder_hash(root):
    digest = hashlib.sha256()
    for p in sorted(p for p in root.rglob("*") if p.is_file()):
        digest.update(str(p.relative_to(root)).encode() + b"\0" + p.read_bytes())
    return digest.hexdigest()


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_streamed_hashes(spark, tmp_path, chunk):
    for name in ("b/x.bin", "b.txt", "a/z/1", "a/z", "a/y é", "b/empty", "B"):
        p = tmp_path / name if name != "a/z" else tmp_path / "a/zz"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"" if name == "b/empty" else name.encode() * 50)
    found = files.manifest(spark, str(tmp_path), chunk=chunk)
    assert {x.path: (x.bytes, x.sha256) for x in found.collect()} == {str(p): (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.rglob("*") if p.is_file()}
    assert files.folder_fingerprint(found, str(tmp_path), chunk).first().fingerprint == folder_hash(tmp_path)
