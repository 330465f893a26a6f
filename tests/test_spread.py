"""Operators that spread one group over many tasks: ranks, draw counts, scans, gaps, order statistics, memberships."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.operators import design, inference, timeseries
from larkspur.operators.ranks import numbered, order_statistics, percentiles


def test_ranks_equal_windows(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([1, 2]), r.choice([None, *range(400)]), k) for k in range(3000)] + [("one", 1, 5, -1)]
    x = spark.createDataFrame(rows, "s string, t int, o int, k int").repartition(7)
    got = numbered(x, ["s", "t"], ["o", "k"], "rank", "n").collect()
    w = Window.partitionBy("s", "t")
    want = x.withColumn("rank", F.row_number().over(w.orderBy("o", "k"))).withColumn("n", F.count(F.lit(1)).over(w)).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert numbered(x.limit(0), ["s"], ["o"]).count() == 0
    one = numbered(x.withColumn("s", F.lit("all")), ["s"], [-F.col("k")], "rank").orderBy("rank").collect()
    assert [v.k for v in one] == sorted((v[3] for v in rows), reverse=True) and [v["rank"] for v in one] == list(range(1, len(rows) + 1))


def test_a_stratum_of_all_rows_spreads(spark):
    x = spark.range(0, 20_000, 1, 8).select(F.lit("all").alias("s"), F.xxhash64("id").alias("h"))
    ranked = numbered(x, ["s"], ["h"])
    sizes = [v["count"] for v in ranked.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 20_000
    by_stretch = ranked.withColumn("b", F.floor(F.col("rank") / 5_000)).groupBy("b").agg(F.min("h").alias("low"), F.max("h").alias("high")).orderBy("b").collect()
    assert all(a.high < b.low for a, b in zip(by_stretch, by_stretch[1:]))
    taken = design.evenly_spread(x, ["s"], "h", 7).count()
    assert taken == 7


def test_drawn_counts_are_the_draws(spark):
    s = spark.createDataFrame([(t, u) for t, n in (("a", 1), ("b", 4), ("c", 37), ("5", 130)) for u in range(n)], "stratum string, unit int")
    drawn = inference.draws(inference.ordinals(s, "stratum", "unit"), "stratum", 6, 9).groupBy("stratum", "replicate", "idx").count().collect()
    want = collections.defaultdict(dict)
    for x in drawn:
        want[x.stratum, x.replicate][x.idx] = x["count"]
    for text, n in (("a", 1), ("b", 4), ("c", 37), ("5", 130)):
        counts = inference.drawn_counts(text, n, 0, 6, 9)
        assert np.array_equal(counts[2:5], inference.drawn_counts(text, n, 2, 5, 9)) and (counts.sum(1) == n).all()
        for r in range(6):
            assert {k: int(v) for k, v in enumerate(counts[r]) if v} == want[text, r]


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_block_counts_sum_to_the_units(size):
    n, b = 333, 400
    counts = np.zeros((b, n))
    for block in range(-(-n // size)):
        total = inference.block_totals("s", n, block, size, b, 3)
        for first, some in inference.block_counts("s", n, block, size, b, 3):
            counts[first : first + len(some), block * size : block * size + some.shape[1]] = some
            assert (some.sum(1) == total[first : first + len(some)]).all()
    assert (counts.sum(1) == n).all()
    # Each unit is as likely as any other, and counts vary as those of independent draws do.
    expected = b
    chi = ((counts.sum(0) - expected) ** 2 / expected).sum()
    assert abs(chi - (n - 1)) < 5 * (2 * (n - 1)) ** 0.5
    assert abs(counts.var(0).mean() - (1 - 1 / n)) < 0.05
    # Units of different blocks are drawn against each other as a fixed total asks.
    assert abs(np.cov(counts[:, 0], counts[:, -1])[0, 1] + 1 / n) < 0.25


def test_resample_by_counts(spark):
    rows = [(t, u, k, u * (k + 1), u / 7) for t, n in (("a", 90), ("b", 11)) for u in range(n) for k in range(2) if (u + k) % 5]
    s = spark.createDataFrame(rows, "stratum string, unit int, key int, v int, x double").repartition(5)
    got = inference.resample_by_counts(s, "stratum", "unit", ["stratum", "key"], ["v"], 50, 3, 16).collect()
    counts = {}
    for t, n in (("a", 90), ("b", 11)):
        counts[t] = np.zeros((50, n))
        for block in range(-(-n // 16)):
            for first, some in inference.block_counts(t, n, block, 16, 50, 3):
                counts[t][first : first + len(some), 16 * block : 16 * block + some.shape[1]] = some
    want = collections.Counter()
    for t, u, k, v, _ in rows:
        for r in range(50):
            want[r, t, k] += int(counts[t][r, u]) * v
    assert {(g.replicate, g.stratum, g.key): g.v for g in got} == dict(want) and len(got) == 200
    of_doubles = inference.resample_by_counts(s, "stratum", "unit", [], ["x", "v"], 50, 3, 16).orderBy("replicate").collect()
    assert [g.v for g in of_doubles] == pytest.approx([sum(want[r, t, k] for t in "ab" for k in range(2)) for r in range(50)])
    nothing = inference.resample_by_counts(s.where("stratum is null"), "stratum", "unit", ["key"], ["v"], 5, 3)
    assert nothing.count() == 0 and inference.resample(s.limit(0), "stratum", "unit", ["key"], ["v"], 5, 3).count() == 0


def test_resample_holds_odd_keys(spark, monkeypatch):
    s = spark.createDataFrame([(1, "u1", None, 2**53 + 1, 1), (1, "u2", "k", 5, 1), (2, "u1", "k", 7, 1), (None, "u1", "k", 9, 1), (1, None, "k", 9, 1)], "stratum int, unit string, key string, v bigint, one int")
    few = sorted(map(tuple, inference.resample(s, "stratum", "unit", ["key"], ["v", "one"], 20, 7).collect()), key=str)
    monkeypatch.setattr(inference, "BROADCAST_NUMBERS", 0)
    # A row stands for picked keys only there; the product also has those that a replicate never picks, as zeros.
    rows = sorted(map(tuple, inference.resample(s, "stratum", "unit", ["key"], ["v", "one"], 20, 7).collect()), key=str)
    assert [x for x in few if x[3]] == rows and all(x[2] == 0 for x in few if not x[3])


def recursive(xs, span):
    a, y, out = 2.0 / (span + 1), None, []
    for x in xs:
        if x is None:
            out.append(None)
            continue
        y = x if y is None else a * x + (1 - a) * y
        out.append(y)
    return out


def test_scan_equals_recursion(spark):
    r = np.random.default_rng(2)
    million = [1e6, *r.standard_normal(1_000_000).tolist()]
    rows = spark.createDataFrame([("long", k, x) for k, x in enumerate(million[:3])], "s string, k bigint, x double").limit(0)
    import pandas as pd

    rows = rows.unionByName(spark.createDataFrame(pd.DataFrame({"s": "long", "k": np.arange(len(million)), "x": million})))
    got = timeseries.ewma(rows.repartition(8), "s", "x", "k", 10).orderBy("k").toPandas()["smooth"].to_numpy()
    want = np.array(recursive(million, 10))
    assert len(got) == len(want) and np.abs(got - want).max() <= 1e-12 * np.abs(want).max()
    assert (np.abs(got - want)[1000:] <= 1e-12).all()


def test_scan_of_odd_series(spark):
    nan, inf = float("nan"), float("inf")
    r = random.Random(5)
    series = {
        "gap": [1.0, None, 1.0, 1.0], "none": [None, None], "first": [None, 3.0, None, 5.0], "nan": [1.0, nan, 2.0, None, 2.0], "inf": [2.0, inf, 1.0], "both": [1.0, inf, 1.0, -inf, 1.0],
        "begins": [inf, 1.0], "wide": [r.choice([None, r.random()]) for _ in range(3000)], "one": [7.0], None: [1.0, 2.0],
    }
    rows = spark.createDataFrame([(s, k, x) for s, xs in series.items() for k, x in enumerate(xs)], "s string, k int, x double").repartition(5)
    got = collections.defaultdict(dict)
    for v in timeseries.ewma(rows, "s", "x", "k", 3).collect():
        got[v.s][v.k] = v.smooth
    for s, xs in series.items():
        for k, y in enumerate(recursive(xs, 3)):
            assert (got[s][k] is None) == (y is None) and (y is None or got[s][k] == pytest.approx(y, rel=1e-12, nan_ok=True)), (s, k)
    assert timeseries.ewma(rows.limit(0), "s", "x", "k", 3).count() == 0


def test_gaps_are_ranges(spark):
    r = random.Random(4)
    series = {"far": [3, 10**9], "zero": [0], "below": [-5, -1], "whole": [1, 2, 3], "some": sorted(r.sample(range(1, 500), 200)) + [3, 3], "null": [None], "late": [None, -2, 0, 4]}
    rows = spark.createDataFrame([(s, k) for s, ks in series.items() for k in ks], "variant string, step bigint").repartition(6)
    got = collections.defaultdict(list)
    for v in timeseries.missing_ranges(rows, ["variant"]).collect():
        got[v.variant].append((v["first"], v["last"], v.n))
    assert sorted(got.pop("far")) == [(1, 2, 2), (4, 10**9 - 1, 10**9 - 4)]
    for s, ks in series.items():
        if s != "far":
            steps = {k for k in ks if k is not None and k >= 1}
            lacking = sorted(set(range(1, max(steps, default=0) + 1)) - steps)
            found = sorted(got[s])
            assert [k for a, b, _ in found for k in range(a, b + 1)] == lacking and all(n == b - a + 1 for a, b, n in found)
            assert all(b + 1 in steps for _, b, _ in found) and all(a - 1 in steps or a == 1 for a, _, _ in found)
    assert timeseries.missing_steps(rows.where("variant in ('zero', 'below')"), "variant").count() == 0
    upto = timeseries.missing_ranges(rows.where("variant in ('whole', 'zero', 'null', 'far')"), ["variant"], "step", F.lit(5)).collect()
    assert sorted(map(tuple, upto)) == [("far", 1, 2, 2), ("far", 4, 5, 2), ("null", 1, 5, 5), ("whole", 4, 5, 2), ("zero", 1, 5, 5)]
    x = timeseries.completeness(rows.where("variant = 'zero'").withColumns({"seq": F.col("step"), "loss": F.lit(0.5), "eval_loss": F.lit(None), "learning_rate": F.lit(None), "mean_token_accuracy": F.lit(0.5)}), "variant", 0)
    assert x.count() == 0


def test_order_statistics(spark):
    nan = float("nan")
    r = random.Random(9)
    groups = {"a": [r.choice([1.5, 2.0, 7.0, r.random() * 9]) for _ in range(2001)], "b": [5.0], "c": [nan, 1.0, None, nan, -0.0], "n": [None], None: [3.0, 4.0]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(6)
    x = order_statistics(rows, ["g"], "v", {"least": F.lit(0), "upper": F.floor(F.col("n") / 2), "last": F.col("n") - 1, "beyond": F.col("n"), "below": F.lit(-1)})
    got = {v.g: tuple(v)[1:] for v in x.collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, (n, least, upper, last, beyond, below) in got.items():
        vs = sorted((v for v in groups[g] if v is not None), key=lambda v: (v != v, v))
        assert n == len(vs) and (least, upper) == pytest.approx((vs[0], vs[n // 2]), nan_ok=True) and last == pytest.approx(vs[-1], nan_ok=True) and beyond is None is below
    shares = {"p0": 0.0, "p1": 0.025, "p2": 0.5, "p3": 0.975, "p4": 1.0}
    mine = {v.g: v for v in percentiles(rows.where("g <> 'c'"), ["g"], "v", shares).collect()}
    theirs = rows.where("g <> 'c' and v is not null").groupBy("g").agg(*(F.percentile("v", F.lit(p)).alias(k) for k, p in shares.items())).collect()
    assert len(theirs) == len(mine) and all(mine[t.g][k] == pytest.approx(t[k], rel=1e-12) for t in theirs for k in shares)
    assert order_statistics(rows.limit(0), ["g"], "v", {"x": F.lit(0)}).count() == 0
    assert [v.p95 for v in timeseries.nearest_rank_of(rows.where("g = 'a'"), "g", "v", 0.95, "p95").collect()] == [sorted(groups["a"])[1900]]


def test_memberships(spark):
    from larkspur.operators import align

    r = random.Random(7)
    runs = [f"run{k:03d}" for k in range(130)]  # more than fit into two words
    rows = [(run, i) for run in runs for i in range(40) if r.random() < 0.9] + [("run000", 7), ("run129", None), (None, 3)]
    x = spark.createDataFrame(rows, "run_name string, sample string").repartition(4)
    x = x.withColumn("sample", F.col("sample").cast("bigint"))
    wanted = spark.createDataFrame([(i,) for i in range(5, 45)], "sample bigint")
    got = {v.run_name: (v.missing, v.extra) for v in align.set_differences(x, "sample", wanted).collect()}
    for run in runs:
        own = {i for n, i in rows if n == run}
        assert got[run] == (len(set(range(5, 45)) - own), len(own - set(range(5, 45))))
    assert set(got) == set(runs)
    few = x.where("run_name in ('run000', 'run001') and sample is not null")
    bad = {v["sample"]: (v.runs, v.n) for v in align.misaligned(few, "sample", 2).collect()}
    count = collections.Counter((n, i) for n, i in rows if n in ("run000", "run001") and i is not None)
    want = {i: (len({n for n, j in count if j == i}), sum(c for (_, j), c in count.items() if j == i)) for i in {j for _, j in count}}
    assert bad == {i: v for i, v in want.items() if v != (2, 2)} and 7 in bad
    assert align.set_differences(x.limit(0), "sample", wanted).count() == 0


def test_rows_hash_keeps_nulls(spark):
    from larkspur.operators import cells

    def of(*rows):
        x = spark.createDataFrame([(1, *r, "stop", True) for r in rows], "cap int, a string, b string, c string, finish_reason string, valid_json boolean")
        return cells.gate_metrics(x, "cap", ["a", "b", "c"]).first().rows_hash

    assert of(("a", None, "b")) != of(("a", "b", None)) and of(("ab", "", None)) != of(("a", "b", None)) and of(("-", None, "x")) != of((None, "-", "x"))
    assert of(("a", "b", "c"), ("d", None, None)) == of(("d", None, None), ("a", "b", "c")) != of(("a", "b", "c"), ("a", "b", "c"))


def test_cases_without_arguments(spark):
    n = spark.createDataFrame([("1", "A {1} x", {"q": "Who {1}?"}, {"t0": [], "t1": ["Ann"]})], "id string, needle string, questions map<string, string>, tests map<string, array<string>>")
    got = {v.case_id: (v.needle, v.question, v.unresolved) for v in design.expand_cases(n).collect()}
    assert got == {"1_t0_q": ("A {1} x", "Who {1}?", True), "1_t1_q": ("A Ann x", "Who Ann?", False)}
