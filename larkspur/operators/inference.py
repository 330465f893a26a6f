"""Bootstrap, contrasts, multiple testing, non-inferiority and seed-level intervals.

A bootstrap never replays rows.  Each resampling unit is one row of sums; a replicate is how often it picks each unit of a stratum, the same for all
runs, and statistics are taken on the product of these counts and the sums.  Draws come from hashes of (seed, replicate, stratum,
number), so any engine gives the same (`resample`, whose tasks count a replicate's draws and send the counts to blocks of units); or counts are split over blocks of units by hashes of the blocks, which works for any
number of units (`resample_by_counts`).  Tasks multiply in Arrow batches and sum by replicate before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..lineage import cut
from ..schemas import RUNS
from .ranks import numbered

#: The 97.5 % points of Student's t for 1 to 10 degrees of freedom; beyond, 1.96.
T_975 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228)
SUPERVISIONS = ("answer", "evidence_id", "evidence")
PRIMARY = ("confirmatory", "corrective")


def signed(name: str, factor: dict[str, float]) -> list[tuple[str, str, float]]:
    return [(name, run, w) for run, w in factor.items() if w]


def contrasts_two_by_three() -> list[tuple[str, str, float]]:
    """(contrast, run, weight), as products of a pairing factor and a supervision factor: each run against base, pairing at each
    supervision and in the mean, supervision steps and their interactions with pairing."""
    cell = lambda pairing, level: {f"{p}_{s}": a * b for p, a in pairing.items() for s, b in level.items()}
    difference, mean = {"paired": 1.0, "independent": -1.0}, {"paired": 0.5, "independent": 0.5}
    at = lambda **weight: {s: weight.get(s, 0.0) for s in SUPERVISIONS}
    out = [c for r in RUNS[1:] for c in signed(f"{r}_minus_base", {r: 1.0, "base": -1.0})]
    out += [c for s in SUPERVISIONS for c in signed(f"paired_minus_independent_at_{s}", cell(difference, at(**{s: 1.0})))]
    out += signed("paired_minus_independent_main_effect", cell(difference, dict.fromkeys(SUPERVISIONS, 1 / 3)))
    for low, high in (("answer", "evidence_id"), ("evidence_id", "evidence"), ("answer", "evidence")):
        step = at(**{high: 1.0, low: -1.0})
        out += signed(f"{high}_minus_{low}_main_effect", cell(mean, step)) + signed(f"pairing_x_{high}_vs_{low}", cell(difference, step))
    return out


def contrasts_two_by_two() -> list[tuple[str, str, float]]:
    cells = [f"{p}_{s}" for p in ("paired", "independent") for s in ("evidence", "answer")]
    out = [(f"{r}_minus_base", x, w) for r in cells for x, w in ((r, 1.0), ("base", -1.0))]
    signs = {"paired_minus_independent_main_effect": (0.5, 0.5, -0.5, -0.5), "evidence_minus_answer_main_effect": (0.5, -0.5, 0.5, -0.5), "pairing_x_supervision_interaction": (1.0, -1.0, -1.0, 1.0)}
    return out + [(k, r, w) for k, ws in signs.items() for r, w in zip(cells, ws)]


def contrast_subset() -> list[tuple[str, str, float]]:
    return [c for c in contrasts_two_by_three() if c[0].endswith("_minus_base") or "_at_" in c[0]]


def weights(spark: SparkSession, definitions) -> DataFrame:
    order = {k: i for i, k in enumerate(dict.fromkeys(c[0] for c in definitions))}
    return spark.createDataFrame([(order[c], c, r, w) for c, r, w in definitions], "ordinal int, contrast string, run_name string, weight double")


def weighted(values: DataFrame, by: list[str], value: str, spark_weights: DataFrame) -> DataFrame:
    """Sum of weight times value; null if a run's value is missing or null.  The weights are a few literal rows."""
    n = spark_weights.groupBy("contrast").agg(F.count(F.lit(1)).alias("needed"))
    x = values.join(F.broadcast(spark_weights), "run_name").join(F.broadcast(n), "contrast")
    return x.groupBy("ordinal", "contrast", *by).agg(F.when(F.count(value) == F.max("needed"), F.sum(F.col("weight") * F.col(value))).alias(value))


def p_two_sided(x: Column) -> Column:
    n = F.count(x)
    return F.least(F.lit(1.0), 2 * F.least((F.count_if(x <= 0) + 1) / (n + 1), (F.count_if(x >= 0) + 1) / (n + 1)))


def interval(x: str) -> list[Column]:
    return [F.percentile(x, F.lit(0.025)).alias("low"), F.percentile(x, F.lit(0.975)).alias("high")]


def holm(tests: DataFrame, family: list[str], p: str = "p", order: str = "ordinal") -> DataFrame:
    """Step-down adjusted p values within a family; ties keep the order of definition."""
    w = Window.partitionBy(*family).orderBy(p, order)
    m = F.count(F.lit(1)).over(Window.partitionBy(*family))
    step = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    stepped = tests.withColumn("_step", step)
    return stepped.withColumn("p_holm", F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_step")


def ordinals(units: DataFrame, stratum: str, unit: str) -> DataFrame:
    """stratum, unit, its number from 0 within the stratum, and the stratum's size."""
    u = numbered(units.select(stratum, unit).distinct(), [stratum], [unit], "idx", "n_units")
    return u.withColumn("idx", F.col("idx") - 1)


#: Draws from one hash, and the hex digits of each (60 bits).
DRAWS_A_HASH, DIGITS = 4, 15


def draws(numbered: DataFrame, stratum: str, replicates: int, seed: int) -> DataFrame:
    """replicate, stratum and idx of every draw: as many in a replicate as the stratum has units."""
    strata = numbered.groupBy(stratum).agg(F.max("n_units").alias("n_units"))
    each = strata.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).repartition(stratum, "replicate")
    blocks = each.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_units") - 1) / DRAWS_A_HASH))))
    hashed = blocks.withColumn("hash", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col(stratum).cast("string"), F.col("block").cast("string")), 256))
    number = lambda k: F.pmod(F.conv(F.substring("hash", 1 + DIGITS * k, DIGITS), 16, 10).cast("bigint"), F.col("n_units"))
    picked = F.array(*(F.when(F.col("block") * DRAWS_A_HASH + k < F.col("n_units"), number(k)) for k in range(DRAWS_A_HASH)))
    return hashed.select("replicate", stratum, F.explode(picked).alias("idx")).where("idx is not null")


#: Numbers in a table of units up to which it is broadcast (32 MB).
BROADCAST_NUMBERS = 4_000_000
#: Counts of draws that a task holds at a time, or those of one replicate of a stratum, and hashes that it holds.
COUNTS, HASHES = 2_000_000, 100_000
#: Ranges of replicates in a task.
RANGES = 8
#: Units of a block to which counts are sent.
SENT = 16_384


def drawn_counts(text: str, n: int, first: int, stop: int, seed: int) -> np.ndarray:
    """(replicates from first to stop, units): how often `draws` picks each of the n units of a stratum."""
    out = np.zeros((stop - first, n))
    low = np.uint64((1 << 60) - 1)
    for start in range(0, -(-n // DRAWS_A_HASH), HASHES):
        blocks = [str(b).encode() for b in range(start, min(start + HASHES, -(-n // DRAWS_A_HASH)))]
        for r in range(first, stop):
            head = f"{seed}:{r}:{text}:".encode()
            raw = np.frombuffer(b"".join([sha256(head + b).digest() for b in blocks]), np.uint8).reshape(-1, 32)
            at = lambda k: np.ascontiguousarray(raw[:, k : k + 8]).view(">u8")[:, 0].astype(np.uint64)  # noqa: B023, E731
            # 60 bits each, which begin at bits 0, 60, 120 and 180.
            picked = np.stack([at(0) >> np.uint64(4), at(7) & low, at(15) >> np.uint64(4), at(22) & low], 1).ravel()[: n - start * DRAWS_A_HASH]
            np.add.at(out[r - first], (picked % np.uint64(n)).astype(np.int64), 1.0)
    return out


def product(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Sums over the picked units; whole numbers stay exact."""
    if sums.dtype.kind != "i":
        return counts @ sums
    if len(sums) and float(np.abs(sums).max()) * counts.sum(1).max() < 1 << 52:
        return np.rint(counts @ sums.astype(float)).astype(np.int64)
    return counts.astype(np.int64) @ sums


def _shape(sums: DataFrame, keys: list[str], values: list[str]) -> tuple[T.StructType, np.dtype]:
    """The schema of replicate, keys and values, and the type of the values: all whole numbers, or all doubles."""
    whole = all(isinstance(sums.schema[v].dataType, T.IntegralType) for v in values)
    kind = T.LongType() if whole else T.DoubleType()
    fields = [T.StructField("replicate", T.IntegerType()), *(T.StructField(k, sums.schema[k].dataType) for k in keys), *(T.StructField(v, kind) for v in values)]
    return T.StructType(fields), np.dtype(np.int64 if whole else np.float64)


def _matrix(t: pa.Table, values: list[str], kind: np.dtype) -> np.ndarray:
    return np.stack([t[v].to_numpy().astype(kind) for v in values], 1) if t.num_rows else np.zeros((0, len(values)), kind)


def _codes(t: pa.Table, columns: list[str]) -> np.ndarray:
    """A number for each distinct combination of values in a row, nulls included."""
    out = np.zeros(t.num_rows, np.int64)
    for c in columns:
        own = t[c].combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        out = np.unique(out * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
    return out


def _rows(first: int, found: np.ndarray, heads: pa.Table, values: list[str], schema: pa.Schema) -> pa.RecordBatch:
    """found: (replicates, groups, values) -> rows; heads: the keys of the groups."""
    r, g, _ = found.shape
    which = pa.array(np.tile(np.arange(g), r))
    columns = [pa.array(np.repeat(np.arange(first, first + r, dtype=np.int32), g)), *(heads[k].combine_chunks().take(which) for k in heads.column_names), *(pa.array(found[:, :, k].ravel()) for k in range(len(values)))]
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=schema)


def _by_matrix(t: pa.Table, sums: DataFrame, keys: list[str], values: list[str], replicates: int, seed: int) -> DataFrame:
    """Few units: their table goes to all tasks, and a task multiplies the counts of some replicates of a stratum with it."""
    spark = sums.sparkSession
    shape, kind = _shape(sums, keys, values)
    t = t.sort_by([("_s", "ascending"), ("_u", "ascending")])
    s = _codes(t, ["_s"])
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if t.num_rows else np.zeros(0, np.int64)
    strata, work = [], []
    for k, (i, j) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows])):
        part = t.slice(i, j - i)
        u, group = _codes(part, ["_u"]), _codes(part, keys)
        idx = np.cumsum(np.r_[0, u[1:] != u[:-1]])
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
        n = int(idx[-1]) + 1
        strata.append((part["_t"][0].as_py(), n, np.split(idx[order], cuts[1:]), np.split(_matrix(part, values, kind)[order], cuts[1:]), part.select(keys).take(pa.array(order[cuts]))))
        step = max(1, min(replicates, COUNTS // n))
        work += [(k, r, min(r + step, replicates)) for r in range(0, replicates, step)]
    sent, schema = spark.sparkContext.broadcast((strata, work)), to_arrow_schema(shape)

    def run(batches):
        strata, work = sent.value
        for b in batches:
            for item in b.column(0).to_pylist():
                k, first, stop = work[item]
                text, n, units, matrices, heads = strata[k]
                counts = drawn_counts(text, n, first, stop, seed)
                yield _rows(first, np.stack([product(counts[:, i], m) for i, m in zip(units, matrices)], 1), heads, values, schema)

    tasks = max(1, min(len(work), 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, len(work), 1, tasks).mapInArrow(run, shape)


def resample(sums: DataFrame, stratum: str, unit: str, keys: list[str], values: list[str], replicates: int, seed: int) -> DataFrame:
    """Sums of `values` over the picked units by replicate and keys.  sums: a row for each (stratum, unit, keys).

    The picks are those of `draws`.  Up to BROADCAST_NUMBERS numbers the sums go to all tasks, which count a replicate's picks and take the
    product of counts and sums; beyond, see `_by_blocks`.  Rows without a stratum or unit take no part.  sums is read several times: cut it
    if it is dear.
    """
    sums = sums.where(F.col(stratum).isNotNull() & F.col(unit).isNotNull())
    most = BROADCAST_NUMBERS // (len(keys) + len(values) + 3)
    few = sums.select(F.col(stratum).alias("_s"), F.col(unit).alias("_u"), F.col(stratum).cast("string").alias("_t"), *keys, *values).limit(most + 1).toArrow()
    if few.num_rows <= most:
        found = _by_matrix(few, sums, keys, values, replicates, seed)
        return found.groupBy("replicate", *keys).agg(*(F.sum(v).alias(v) for v in values))
    return _by_blocks(sums, stratum, unit, keys, values, replicates, seed).groupBy("replicate", *keys).agg(*(F.sum(v).alias(v) for v in values))


def _ranges(strata: DataFrame, replicates: int) -> DataFrame:
    """strata (with n_units) with the first and stop of ranges of replicates, of about COUNTS draws each or one replicate, dealt out.

    Ranges are dear and alike, so they are dealt in turn, a few to a task: by a hash, some tasks would have twice as many as others.
    """
    step = F.greatest(F.lit(1), F.least(F.lit(replicates), F.floor(F.lit(COUNTS) / F.col("n_units")))).cast("int")
    each = strata.withColumn("_step", step).withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.col("_step"))))
    each = each.withColumn("stop", F.least(F.col("first") + F.col("_step"), F.lit(replicates))).drop("_step")
    n, least = each.count(), 4 * strata.sparkSession.sparkContext.defaultParallelism
    return each.repartition(max(1, min(n, least), -(-n // RANGES)))


def _placed(sums: DataFrame, units: DataFrame, stratum: str, unit: str, keys: list[str], values: list[str], size: int) -> DataFrame:
    """sums by block of `size` units: _t (the stratum as text), n_units, _b, the unit's place _i in the block, the keys as _k0.., the values."""
    u = units.select(F.col(stratum).alias("_s"), F.col(unit).alias("_u"), "idx", "n_units").hint("merge")
    placed = sums.join(u, (F.col(stratum) == F.col("_s")) & (F.col(unit) == F.col("_u")))
    return placed.select(F.col(stratum).cast("string").alias("_t"), "n_units", F.floor(F.col("idx") / size).alias("_b"), (F.col("idx") % size).alias("_i"), *(F.col(c).alias(f"_k{k}") for k, c in enumerate(keys)), *values)


def _grouped(t: pa.Table, keys: int, values: list[str], kind: np.dtype) -> tuple[list[np.ndarray], list[np.ndarray], pa.Table]:
    """The rows of a block by their keys: places in the block and values of each group, and the groups' keys."""
    own = [f"_k{k}" for k in range(keys)]
    group, at, m = _codes(t, own), t["_i"].to_numpy(), _matrix(t, values, kind)
    order = np.lexsort((at, group))
    cuts = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
    parts = np.split(order, cuts[1:])
    return [at[p] for p in parts], [m[p] for p in parts], t.select(own).take(pa.array(order[cuts]))


def _alike(places: list[np.ndarray], matrices: list[np.ndarray], kind: np.dtype) -> list[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Groups with the same places, their values side by side: one product for all of them.  Doubles stay apart, as the order of adding must."""
    same: dict[object, list[int]] = {}
    for g, p in enumerate(places):
        same.setdefault(p.tobytes() if kind.kind == "i" else g, []).append(g)
    return [(places[gs[0]], np.concatenate([matrices[g] for g in gs], 1), gs) for gs in same.values()]


def _by_blocks(sums: DataFrame, stratum: str, unit: str, keys: list[str], values: list[str], replicates: int, seed: int) -> DataFrame:
    """Any number of units: tasks count the picks of some replicates of a stratum and send the counts, a byte or less for a unit and
    replicate, to blocks of SENT units, where the product with the sums is taken.

    No row stands for a pick, nor for keys that a replicate does not pick.  A task holds the counts of one replicate of a stratum, 8 bytes a unit, or COUNTS; a block all replicates' counts of
    its units, compressed.
    """
    shape, kind = _shape(sums, keys, values)
    units = ordinals(sums, stratum, unit)
    placed = _placed(sums, units, stratum, unit, keys, values, SENT)
    schema = to_arrow_schema(shape)
    sent = T.StructType([T.StructField(n, k()) for n, k in (("_t", T.StringType), ("n_units", T.LongType), ("_b", T.LongType), ("first", T.IntegerType), ("stop", T.IntegerType), ("width", T.IntegerType), ("counts", T.BinaryType))])
    sent_schema = to_arrow_schema(sent)

    def count(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for b in batches:
            for row in b.to_pylist():
                text, n, first, stop = row["_t"], row["n_units"], row["first"], row["stop"]
                counts = drawn_counts(text, n, first, stop, seed)
                width = np.uint8 if counts.max(initial=0) < 256 else np.uint32
                starts = range(0, n, SENT)
                packed = [codec.compress(np.ascontiguousarray(counts[:, s : s + SENT].astype(width)), asbytes=True) for s in starts]
                same = lambda v: [v] * len(starts)
                columns = (same(text), same(n), list(range(len(starts))), same(first), same(stop), same(width().itemsize), packed)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, sent_schema)], schema=sent_schema)

    strata = cut(units.groupBy(F.col(stratum).cast("string").alias("_t")).agg(F.max("n_units").alias("n_units")))  # a row for each stratum
    picked = _ranges(strata, replicates).mapInArrow(count, sent)

    def multiply(t, c):
        places, matrices, heads = _grouped(t, len(keys), values, kind)
        alike, every = _alike(places, matrices, kind), np.arange(SENT)
        codec, found = pa.Codec("zstd"), []
        for row in c.to_batches(max_chunksize=64):
            for x in row.to_pylist():
                size = min(SENT, x["n_units"] - x["_b"] * SENT)
                raw = codec.decompress(x["counts"], (x["stop"] - x["first"]) * size * x["width"])
                counts = np.frombuffer(raw, np.uint8 if x["width"] == 1 else np.uint32).reshape(-1, size).astype(float)
                out, picked = np.empty((len(counts), len(places), len(values)), kind), np.empty((len(counts), len(places)), bool)
                for at, m, groups in alike:
                    own = counts if np.array_equal(at, every[:size]) else counts[:, at]
                    out[:, groups], picked[:, groups] = product(own, m).reshape(len(counts), len(groups), -1), own.any(1)[:, None]
                found.append(_rows(x["first"], out, heads, values, schema).filter(pa.array(picked.ravel())))
        return pa.Table.from_batches(found, schema)

    # A block is much work and few bytes: as many partitions as blocks, which the planner does not put together by their bytes.
    by, spark = ("_t", "n_units", "_b"), sums.sparkSession
    blocks = strata.agg(F.sum(F.ceil(F.col("n_units") / SENT))).first()[0] or 0
    n = max(4 * spark.sparkContext.defaultParallelism, blocks)
    return placed.repartition(n, *by).groupBy(*by).cogroup(picked.repartition(n, *by).groupBy(*by)).applyInArrow(multiply, shape)


def draw_totals(strata: DataFrame, replicates: int, seed: int) -> DataFrame:
    """stratum, replicate, draws, distinct_units and index_sum of what `draws` gives, from strata (stratum, n_units): no row stands for a draw."""
    x = strata.where("stratum is not null and n_units > 0").select("stratum", F.col("stratum").cast("string").alias("_t"), F.col("n_units").cast("bigint").alias("n_units"))
    shape = T.StructType([x.schema["stratum"], T.StructField("replicate", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("draws", "distinct_units", "index_sum"))])
    schema = to_arrow_schema(shape)

    def run(batches):
        for b in batches:
            for k, row in enumerate(b.select(["_t", "n_units", "first", "stop"]).to_pylist()):
                counts = drawn_counts(row["_t"], row["n_units"], row["first"], row["stop"], seed)
                # Whole numbers below 2^53 at each step: a share of the counts at a time.
                index = sum(((counts[:, s : s + SENT] @ (np.arange(s, min(s + SENT, counts.shape[1])) - s).astype(float)).astype(np.int64) + s * counts[:, s : s + SENT].sum(1).astype(np.int64) for s in range(0, counts.shape[1], SENT)), np.zeros(len(counts), np.int64))
                heads = b.column("stratum").take(pa.array([k] * len(counts)))
                columns = (pa.array(np.arange(row["first"], row["stop"], dtype=np.int32)), pa.array(counts.sum(1).astype(np.int64)), pa.array(np.count_nonzero(counts, axis=1).astype(np.int64)), pa.array(index))
                yield pa.RecordBatch.from_arrays([heads, *columns], schema=schema)

    return _ranges(cut(x), replicates).mapInArrow(run, shape)


#: Units of a block.
BLOCK = 4096


def _generator(*parts) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(sha256(":".join(map(str, parts)).encode()).digest(), "big"))


def block_totals(text: str, n: int, block: int, size: int, replicates: int, seed: int) -> np.ndarray:
    """How many of the n draws of each replicate fall on a block of units.

    The draws of a range of blocks are split between its halves by binomial numbers, which a hash of the range decides, from all blocks
    down to this one.  So every block finds its own total and no other block's, and those of all blocks sum to n.
    """
    low, high = 0, -(-n // size)
    total = np.full(replicates, n)
    while high - low > 1:
        mid = (low + high) // 2
        units = min(n, high * size) - low * size
        left = _generator(seed, text, low, high).binomial(total, (mid - low) * size / units)
        low, high, total = (low, mid, left) if block < mid else (mid, high, total - left)
    return total


def block_counts(text: str, n: int, block: int, size: int, replicates: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first replicate, counts of its units by replicate) of a block, for some replicates at a time."""
    units = min(n, (block + 1) * size) - block * size
    totals, own = block_totals(text, n, block, size, replicates, seed), _generator(seed, text, block)
    step = max(1, COUNTS // units)
    for first in range(0, replicates, step):
        some = totals[first : first + step]
        at = np.repeat(np.arange(len(some)), some) * units + own.integers(0, units, int(some.sum()))
        yield first, np.bincount(at, minlength=len(some) * units).reshape(len(some), units).astype(float)


def resample_by_counts(sums: DataFrame, stratum: str, unit: str, keys: list[str], values: list[str], replicates: int, seed: int, size: int = BLOCK) -> DataFrame:
    """The same sums for any number of units, with draws of its own: as many in a replicate as a stratum has units, each unit as likely.

    A task has a block of a stratum's units, draws how often each replicate picks them and multiplies that with their sums.  No row
    stands for a draw: blocks give rows of sums, which are added up by replicate before they are shuffled.
    """
    sums = sums.where(F.col(stratum).isNotNull() & F.col(unit).isNotNull())
    shape, kind = _shape(sums, keys, values)
    placed = _placed(sums, ordinals(sums, stratum, unit), stratum, unit, keys, values, size)
    schema = to_arrow_schema(shape)

    def run(head, t):
        text, n, block = (x.as_py() for x in head)
        places, matrices, heads = _grouped(t, len(keys), values, kind)
        found = [_rows(first, np.stack([product(counts[:, i], m) for i, m in zip(places, matrices)], 1), heads, values, schema) for first, counts in block_counts(text, n, block, size, replicates, seed)]
        return pa.Table.from_batches(found, schema)

    return placed.groupBy("_t", "n_units", "_b").applyInArrow(run, shape).groupBy("replicate", *keys).agg(*(F.sum(v).alias(v) for v in values))


def summarize(points: DataFrame, replicates: DataFrame, by: list[str], value: str, digits: int = 9) -> DataFrame:
    """Point, 95 % percentile interval and two-sided p of each statistic."""
    r = replicates.groupBy(*by).agg(*interval(value), p_two_sided(F.col(value)).alias("p"))
    return points.withColumnRenamed(value, "estimate").join(r, by).select(*by, *(F.round(c, digits).alias(c) for c in ("estimate", "low", "high", "p")))


def position_statistics(sums: DataFrame, by: list[str], condition: list[str]) -> DataFrame:
    """From (by, condition, position_label, hits, n): mean over conditions of worst and gap, long form (statistic, value)."""
    cell = sums.withColumn("rate", F.col("hits") / F.col("n"))
    per = cell.groupBy(*by, *condition).agg(F.min("rate").alias("worst"), (F.max("rate") - F.min("rate")).alias("gap"))
    # Rounded, so that the order in which floats are added does not reach the percentiles.
    m = per.groupBy(*by).agg(F.round(F.avg("worst"), 12).alias("worst"), F.round(F.avg("gap"), 12).alias("gap"))
    return m.unpivot(by, ["worst", "gap"], "statistic", "value")


def non_inferior(effects: DataFrame, margin: float) -> DataFrame:
    return effects.withColumn("non_inferior", F.col("low") > -margin)


def screening(summary: DataFrame, base: str = "base") -> DataFrame:
    """Exploratory thresholds against the base run; a base gap of 0 makes the gap reduction null and its check false."""
    b = summary.where(F.col("run_name") == base).select(*(F.col(c).alias(f"base_{c}") for c in ("gap", "worst", "edge", "answer_correct")))
    x = summary.where(F.col("run_name") != base).crossJoin(F.broadcast(b))  # one row
    reduction = F.try_divide(F.col("base_gap") - F.col("gap"), F.nullif(F.col("base_gap"), F.lit(0.0)))
    delta = lambda c: F.col(c) - F.col(f"base_{c}")
    checks = {"gap_halved": F.coalesce(reduction >= 0.50, F.lit(False)), "worst_gained": delta("worst") >= 0.10, "answers_held": delta("answer_correct") >= -0.02, "edge_held": delta("edge") >= -0.02, "json_valid": F.col("valid_json") >= 0.99}
    passed = F.lit(True)
    for c in checks.values():
        passed = passed & c
    return x.select("run_name", F.round(reduction, 9).alias("gap_reduction"), F.round(delta("worst"), 9).alias("worst_gain"), F.round(delta("answer_correct"), 9).alias("answer_delta"), F.round(delta("edge"), 9).alias("edge_delta"), *(v.alias(k) for k, v in checks.items()), passed.alias("passes_all"))


def saturated(summary: DataFrame, value: str, least: float, spread: float) -> DataFrame:
    return summary.agg(F.min(value).alias("lowest"), F.round(F.max(value) - F.min(value), 9).alias("range"), ((F.min(value) >= least) & (F.max(value) - F.min(value) < spread)).alias("saturated"))


def t_critical(n: Column) -> Column:
    table = F.array(*map(F.lit, T_975))
    return F.when(n - 1 <= len(T_975), F.try_element_at(table, (n - 1).cast("int"))).otherwise(F.lit(1.96))


def mean_intervals(values: DataFrame, by: list[str], value: str = "estimate") -> DataFrame:
    """Mean over seeds with Student's t interval; one seed gives no interval.  Not clipped."""
    n, sd = F.count(value), F.stddev_samp(value)
    half = F.when(n > 1, t_critical(F.greatest(n, F.lit(2))) * sd / F.sqrt(n))
    m = F.avg(value)
    return values.groupBy(*by).agg(n.alias("n"), F.round(m, 9).alias("mean"), F.round(F.when(n > 1, sd), 9).alias("sd"), F.round(m - half, 9).alias("low"), F.round(m + half, 9).alias("high"))


def fixed_base(values: DataFrame, by: list[str], value: str = "estimate") -> DataFrame:
    """Copies of one base estimate: a single value with n = 1, or null and consistent = false where copies differ (1e-12, or 1e-9 relative)."""
    lo, hi = F.min(value), F.max(value)
    same = (hi - lo) <= F.greatest(F.lit(1e-12), F.lit(1e-9) * F.greatest(F.abs(lo), F.abs(hi)))
    return values.groupBy(*by).agg(F.count(value).alias("copies"), same.alias("consistent"), F.when(same, lo).alias("estimate"))


def direction(values: DataFrame, by: list[str], value: str = "estimate") -> DataFrame:
    v, m = F.col(value), F.avg(value)
    return values.groupBy(*by).agg(F.count_if(v > 0).alias("positive"), F.count_if(v == 0).alias("zero"), F.count_if(v < 0).alias("negative"), F.when(m > 0, F.count_if(v > 0)).when(m < 0, F.count_if(v < 0)).otherwise(F.count_if(v == 0)).alias("same_sign_as_mean"))


def primary_seeds(values: DataFrame, least: int = 2) -> DataFrame:
    """Rows of confirmatory and corrective seeds, of families that have at least two of these."""
    kept = values.where(F.col("status").isin(*PRIMARY))
    enough = kept.groupBy("family").agg(F.count_distinct("seed").alias("n")).where(F.col("n") >= least).select("family")
    return kept.join(F.broadcast(enough), "family")


def family_difference(means: DataFrame, by: list[str], value: str = "mean") -> DataFrame:
    """Difference of two families' means where exactly two give a value: the second by name minus the first."""
    x = means.groupBy(*by).agg(F.count_distinct("family").alias("families"), F.min_by(value, "family").alias("a"), F.max_by(value, "family").alias("b"))
    return x.where("families = 2").select(*by, F.round(F.col("b") - F.col("a"), 9).alias("difference"))


def unmatched_estimands(values: DataFrame, by: list[str]) -> DataFrame:
    """Estimands that not every seed of a family has."""
    seeds = values.groupBy("family").agg(F.count_distinct("seed").alias("seeds"))
    return values.groupBy("family", *by).agg(F.count_distinct("seed").alias("n")).join(seeds, "family").where("n <> seeds")


def display_points(c: Column) -> Column:
    """A difference of shares in percentage points, with its sign."""
    return F.format_string("%+.1f", F.round(c * 100, 6))


def display_interval(low: Column, high: Column) -> Column:
    """[low, high] in percentages, cut to 0..100."""
    cut = lambda x: display(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    return F.concat(F.lit("["), cut(low), F.lit(", "), cut(high), F.lit("]"))


def display(c: Column) -> Column:
    """A share as a percentage with one place, halves rounded up."""
    return F.format_string("%.1f", F.round(c * 100, 6))


def cluster_problems(rows: DataFrame, cluster: str, stratum: str, group: str, expected: int | None = None) -> DataFrame:
    """Violations (rule, key, detail): clusters and strata constant in a group, a cluster in one stratum, two clusters or more, the expected number."""
    g = rows.groupBy(group).agg(F.count_distinct(cluster).alias("c"), F.count_distinct(stratum).alias("s"))
    out = g.where("c > 1 or s > 1").select(F.lit("group_not_constant").alias("rule"), F.col(group).cast("string").alias("key"), F.greatest("c", "s").alias("detail"))
    k = rows.groupBy(cluster).agg(F.count_distinct(stratum).alias("s")).where("s > 1").select(F.lit("cluster_in_several_strata").alias("rule"), F.col(cluster).cast("string").alias("key"), F.col("s").alias("detail"))
    n = rows.agg(F.count_distinct(cluster).alias("n"))
    wrong = F.col("n") < 2 if expected is None else (F.col("n") < 2) | (F.col("n") != expected)
    return out.unionByName(k).unionByName(n.where(wrong).select(F.lit("number_of_clusters").alias("rule"), F.lit("*").alias("key"), F.col("n").alias("detail")))


def cluster_choice(rows: DataFrame, hard_split: bool) -> tuple[str | None, str | None, int | None]:
    """Cluster key, strata key and expected number that a needle suite implies; none for other rows."""
    needle = rows.where("metadata.case_id is not null").limit(1).count() > 0
    if not needle:
        return None, None, None
    return "metadata.case_id", "task", 10 if hard_split and rows.count() == 1050 else None
