"""Ranks and order statistics within strata, without a stratum in one task.

Rows are range-partitioned by stratum and order and sorted there, so each partition holds one stretch of a stratum's order.  The rows of
every (stratum, partition) are counted, the counts of the partitions before give an offset, and a row's rank is that offset plus its
place in the stretch.  The table of counts has a row for each partition and each stratum at most, give or take; data are shuffled once.

An order statistic needs less: distinct values are counted, dealt out by range, and the counts of the stretches tell in which one a
rank lies.  Only that stretch, a partition at most, is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut


def _null_safe(a: str, b: str, columns: list[str]) -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return same


def numbered(rows: DataFrame, stratum: list[str], order: list[Column | str], rank: str = "rank", total: str | None = None) -> DataFrame:
    """rows with their rank from 1 within the stratum, and the stratum's size under `total`.

    The order is ascending.  Nulls are a stratum and come first in the order, as in Spark's windows.  Rows that are equal in stratum and order are ranked in some
    order, which stays the same once they are ranked.
    """
    keys = {f"_o{k}": F.col(c) if isinstance(c, str) else c for k, c in enumerate(order)}
    keys["_t"] = F.monotonically_increasing_id()  # so that rows equal in all else need not lie in one partition
    dealt = rows.withColumns(keys).repartitionByRange(*stratum, *keys).sortWithinPartitions(*stratum, *keys)
    # Both are the checkpoint's: where the cuts between partitions lie is decided once.
    placed = cut(dealt.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}).drop(*keys))
    stretches = placed.groupBy(*stratum, "_p").agg(F.count(F.lit(1)).alias("_c"), F.min("_i").alias("_first"))
    own = Window.partitionBy(*stratum)
    before = F.sum("_c").over(own.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = stretches.select(*(F.col(c).alias(f"_s{k}") for k, c in enumerate(stratum)), F.col("_p").alias("_q"), (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"), F.sum("_c").over(own).alias("_n"))
    same = F.col("_p") == F.col("_q")
    for k, c in enumerate(stratum):
        same = same & F.col(c).eqNullSafe(F.col(f"_s{k}"))
    more = [] if total is None else [F.col("_n").alias(total)]
    return placed.join(offsets, same).select(*rows.columns, (F.col("_i") + F.col("_shift")).alias(rank), *more)


def order_statistics(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """For each group the values at some ranks: by, the number of values under `n`, and a column for each name of `ranks`.

    A rank counts from 0 and is a whole-number expression of the column `n`; one below 0 or beyond the last gives null.  Null values are not
    counted; NaN comes last.  A group without values has no row.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    placed = cut(counted.repartitionByRange(*by, "_v").withColumn("_p", F.spark_partition_id()))
    own = Window.partitionBy(*by)
    before = F.sum("_c").over(own.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    stretches = placed.groupBy(*by, "_p").agg(F.sum("_c").alias("_c")).select(*by, "_p", "_c", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_c").over(own).alias("n"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), r.cast("bigint").alias("rank")) for k, r in ranks.items())))
    asked = stretches.select("*", each.alias("x")).where((F.col("x.rank") >= F.col("_before")) & (F.col("x.rank") < F.col("_before") + F.col("_c")))
    asked = asked.select(*by, "_p", F.col("x.name").alias("name"), (F.col("x.rank") - F.col("_before")).alias("left"))  # a row for each group and name
    inner = placed.alias("v").join(asked.alias("a"), (F.col("v._p") == F.col("a._p")) & _null_safe("v", "a", by)).select(*(F.col(f"v.{c}") for c in by), "a.name", "a.left", "v._v", "v._c")
    upto = F.sum("_c").over(Window.partitionBy(*by, "name").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hit = inner.withColumn("_upto", upto).where((F.col("_upto") > F.col("left")) & (F.col("_upto") - F.col("_c") <= F.col("left")))
    found = hit.groupBy(*by).agg(*(F.max(F.when(F.col("name") == k, F.col("_v"))).alias(k) for k in ranks))
    sizes = stretches.groupBy(*by).agg(F.max("n").alias("n"))
    return sizes.alias("s").join(found.alias("f"), _null_safe("s", "f", by), "left").select(*(F.col(f"s.{c}") for c in by), "s.n", *(F.col(f"f.{k}") for k in ranks))


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each group the values at some shares, between the two order statistics beside (n - 1) times the share."""
    at = lambda p: (F.col("n") - 1) * F.lit(float(p))
    x = order_statistics(rows, by, value, {f"{k}_{side}": f(at(p)) for k, p in shares.items() for side, f in (("low", F.floor), ("high", F.ceil))})
    low, high = (lambda k: F.col(f"{k}_low").cast("double")), (lambda k: F.col(f"{k}_high").cast("double"))
    part = lambda p: at(p) - F.floor(at(p))
    return x.select(*by, "n", *(F.when(part(p) == 0, low(k)).otherwise(low(k) * (1 - part(p)) + high(k) * part(p)).alias(k) for k, p in shares.items()))
