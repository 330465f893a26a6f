"""Compute ledgers, budgets, projections, progress and remaining time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


def unique_events(events: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """One row for each event id, and the ids whose copies disagree (which plain deduplication would hide)."""
    body = F.sha2(F.to_json(F.struct(*fields)), 256)
    x = events.withColumn("_body", body)
    w = Window.partitionBy(key).orderBy("_body")
    one = x.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_body")
    return one, x.groupBy(key).agg(F.count_distinct("_body").alias("versions")).where("versions > 1")


def compute_ledger(events: DataFrame, key: str, kind: str, seconds: str, rate: float) -> DataFrame:
    """Sums by kind after copies are dropped: events, copies dropped, seconds, hours, cost.

    An id whose copies disagree counts under none: unique_events names it.
    """
    lo, hi = F.min(F.struct(kind, seconds)), F.max(F.struct(kind, seconds))
    g = events.groupBy(key).agg(lo.alias("lo"), hi.alias("hi"), F.count(F.lit(1)).alias("copies")).where(F.col("lo").eqNullSafe(F.col("hi")))
    g = g.select(F.col(f"lo.{kind}").alias(kind), F.col(f"lo.{seconds}").alias(seconds), "copies")
    s = F.sum(seconds)
    return g.groupBy(kind).agg(F.count(F.lit(1)).alias("events"), (F.sum("copies") - F.count(F.lit(1))).alias("duplicates"), F.round(s, 6).alias("seconds"), F.round(s / 3600, 9).alias("hours"), F.round(s / 3600 * rate, 6).alias("cost"))


def window_ledger(rows: DataFrame, by: str, start: str, end: str, rate: float) -> DataFrame:
    s = F.unix_micros(F.max(end).cast("timestamp")) - F.unix_micros(F.min(start).cast("timestamp"))
    return rows.groupBy(by).agg(F.min(start).alias("started"), F.max(end).alias("finished"), F.round(s / 3.6e9, 9).alias("hours"), F.round(s / 3.6e9 * rate, 6).alias("cost"))


def budget(workloads: DataFrame, contingency: float, round_up: int) -> tuple[DataFrame, DataFrame]:
    """Hours, wall hours and cost of each workload, and the totals with contingency, rounded up."""
    hours = F.col("runs") * (F.col("units_per_run") * F.col("seconds_per_unit") / 3600 + F.col("fixed_hours_per_run"))
    each = workloads.withColumn("gpu_hours", hours).withColumn("wall_hours", hours / F.col("parallel_instances")).withColumn("cost", hours * F.col("hourly_rate"))
    c = F.sum("cost") * (1 + contingency)
    total = each.agg(F.round(F.sum("gpu_hours"), 6).alias("gpu_hours"), F.round(F.sum("wall_hours"), 6).alias("wall_hours"), F.round(F.sum("cost"), 6).alias("cost"), F.round(c, 6).alias("with_contingency"), (F.ceil(F.round(c, 6) / round_up) * round_up).cast("bigint").alias("top_up"))
    return each, total


def overridden(workloads: DataFrame, overrides: DataFrame, key: str, value: str) -> DataFrame:
    return workloads.join(overrides.select(key, F.col(value).alias("_new")), key, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def config_problems(workloads: DataFrame) -> DataFrame:
    from .audits import violations

    return violations(workloads, "name", positive_runs=F.col("runs") > 0, positive_units=F.col("units_per_run") > 0, positive_seconds=F.col("seconds_per_unit") > 0, known_rate=F.col("hourly_rate") > 0, instances=F.col("parallel_instances") >= 1)


def projection(rate: DataFrame, samples: Column, tokens_ratio: Column, fixed_seconds: float, hourly: float, round_up: int = 10) -> DataFrame:
    """Seconds of a full run from a measured rate, scaled by the ratio of tokens, and its cost, rounded up."""
    s = F.lit(fixed_seconds) + samples * F.col("seconds_per_sample") * tokens_ratio
    return rate.withColumn("seconds", F.round(s, 6)).withColumn("cost", F.round(F.col("seconds") / 3600 * hourly, 6)).withColumn("cost_ceiling", (F.ceil(F.col("cost") / round_up) * round_up).cast("bigint"))


def order_statistics(rows: DataFrame, by: str, tokens: str, key: str) -> DataFrame:
    """Least, upper median, 95 % by lower index, and largest prompt with its id: order statistics, not interpolated.  Null lengths come first."""
    t = F.coalesce(F.col(tokens), F.lit(-(1 << 62))).alias("_t")
    x = rows.select(by, t, F.col(key).alias("_k"))
    n = F.col("n")
    found = ranks.order_statistics(x, [by], "_t", {"least": n * 0, "median": F.floor(n / 2), "p95": F.floor(F.lit(0.95) * (n - 1)), "most": n - 1})
    longest = x.groupBy(F.col(by).alias("_by")).agg(F.max(F.struct("_t", "_k"))["_k"].alias("longest"))
    shown = lambda c: F.when(F.col(c) > -(1 << 62), F.col(c)).alias(c)
    return found.join(longest, F.col(by).eqNullSafe(F.col("_by"))).select(by, n.cast("int").alias("n"), *map(shown, ("least", "median", "p95", "most")), "longest")


def progress(counts: DataFrame, by: list[str], done: str, expected: str) -> DataFrame:
    d = F.sum(F.least(done, expected))
    return counts.groupBy(*by).agg(d.alias("done"), F.sum(expected).alias("expected"), F.round(d / F.sum(expected), 9).alias("fraction"))


def remaining(work: DataFrame, measured: DataFrame, family: str, hourly: float, contingency: float) -> DataFrame:
    """Hours and cost of what is left, at the median rate of each family, or over all families where one has none."""
    med = measured.groupBy(family).agg(F.median("seconds_per_unit").alias("rate"))
    overall = measured.agg(F.median("seconds_per_unit").alias("overall"))
    x = work.join(med, family, "left").crossJoin(F.broadcast(overall))  # one row
    h = F.col("units_left") * F.coalesce("rate", "overall") / 3600
    return x.groupBy(family).agg(F.round(F.sum(h), 9).alias("hours"), F.round(F.sum(h) * hourly * (1 + contingency), 6).alias("cost"), F.bool_and(F.col("rate").isNotNull()).alias("calibrated"))


def timestamp(c: Column) -> Column:
    """ISO 8601 with Z or an offset; a text without either gives null."""
    ok = c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})\z")
    return F.when(ok, F.try_to_timestamp(c))


def finished_at(c: Column) -> Column:
    """The ISO timestamp after finished_at= in a status text."""
    return timestamp(F.regexp_extract(c, r"\bfinished_at=([^\s,;]+)", 1))


def log_timestamp(c: Column) -> Column:
    return F.try_to_timestamp(F.regexp_extract(c, r"(\d{8}T\d{6})Z", 1), F.lit("yyyyMMdd'T'HHmmss"))


def completion(now: Column, hours: Column, contingency: float) -> tuple[Column, Column]:
    add = lambda h: F.timestamp_micros((F.unix_micros(now) + F.round(h * 3.6e9)).cast("bigint"))
    return add(hours), add(hours * (1 + contingency))


def event_id(kind: Column, *fields: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", kind, *fields), 256)
