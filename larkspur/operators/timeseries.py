"""Metric histories: tails, gaps, smoothing, health, completeness."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import is_finite
from ..lineage import cut
from .ranks import numbered, order_statistics


def nearest_rank_of(rows: DataFrame, by: str, value: str, p: float, name: str) -> DataFrame:
    """The order statistic at rank (n - 1) p, rounded half to even, of each group."""
    return order_statistics(rows, [by], value, {name: F.bround((F.col("n") - 1) * F.lit(p))}).drop("n")


def nearest_rank(value, p: float) -> Column:
    """The same within an aggregation over few rows, such as a tail: it gathers them."""
    xs = F.sort_array(F.collect_list(value))
    k = F.least(F.size(xs), F.bround((F.size(xs) - 1) * F.lit(p)).cast("int") + 1)
    return F.try_element_at(xs, k)


def last_n(rows: DataFrame, by: list[str], n: int, order: str = "step") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return rows.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= n).drop("_back")


def keep_last(rows: DataFrame, by: list[str], seq: str) -> DataFrame:
    """One row for each key: the last that came.  Rows without any of the three main metrics are no records."""
    w = Window.partitionBy(*by).orderBy(F.desc(seq))
    some = rows.where("loss is not null or eval_loss is not null or learning_rate is not null")
    return some.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def duplicates(rows: DataFrame, by: str, key: str) -> DataFrame:
    some = rows.where("loss is not null or eval_loss is not null or learning_rate is not null")
    return some.groupBy(by).agg(F.count(F.lit(1)).alias("records"), (F.count(F.lit(1)) - F.count_distinct(key)).alias("duplicates"))


def islands(rows: DataFrame, by: list[str], step: str = "step") -> DataFrame:
    """Stretches (first, last) of consecutive steps of a series.  Repeated steps count once; null steps are left out.

    A step less its rank is one number within a stretch, so stretches are a grouping, and no series is walked in one task.
    """
    x = numbered(rows.where(F.col(step).isNotNull()).select(*by, F.col(step).cast("bigint").alias("_s")).distinct(), by, ["_s"], "_k")
    return x.groupBy(*by, (F.col("_s") - F.col("_k")).alias("_g")).agg(F.min("_s").alias("first"), F.max("_s").alias("last")).drop("_g")


def missing_ranges(rows: DataFrame, by: list[str], step: str = "step", upto: Column | None = None) -> DataFrame:
    """Ranges (first, last, n) of whole numbers from 1 to a series' largest step, or to `upto`, that it lacks.

    Series whose largest step is below 1 lack none of it.
    """
    x = islands(rows.where(F.col(step) >= 1), by, step)
    if upto is not None:  # a stretch without steps beyond the end closes the last range
        series = rows.select(*by).distinct().where(upto >= 1)
        x = x.where(F.col("first") <= upto).unionByName(series.select(*by, (upto + 1).cast("bigint").alias("first"), (upto + 1).cast("bigint").alias("last")))
    x = numbered(x, by, ["first"], "_k")
    same = F.col("a._k") + 1 == F.col("b._k")
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    after = x.alias("b").join(x.alias("a"), same, "left").select(*(F.col(f"b.{c}").alias(c) for c in by), (F.coalesce(F.col("a.last"), F.lit(0)) + 1).alias("first"), (F.col("b.first") - 1).alias("last"))
    return after.where("first <= last").withColumn("n", F.col("last") - F.col("first") + 1)


def missing_steps(rows: DataFrame, by: str, step: str = "step") -> DataFrame:
    """The same, a row for each missing step."""
    kind = rows.schema[step].dataType
    each = F.explode(F.sequence(F.col("first").cast(kind), F.col("last").cast(kind)))
    return missing_ranges(rows, [by], step).select(by, each.alias(step))


def first_last_best(rows: DataFrame, by: str) -> DataFrame:
    x = rows.where("loss is not null")
    return x.groupBy(by).agg(F.min_by("loss", "step").alias("first_loss"), F.max_by("loss", "step").alias("last_loss"), F.min("loss").alias("best_loss"), F.min_by("step", F.struct("loss", "step")).alias("best_step"))


def tail_statistics(rows: DataFrame, by: str, n: int) -> DataFrame:
    """Median, mean and maximum of the last n losses; null losses are dropped before the last n are taken."""
    t = last_n(rows.where("loss is not null"), [by], n)
    return t.groupBy(by).agg(F.median("loss").alias("median_loss"), F.round(F.avg("loss"), 9).alias("mean_loss"), F.max("loss").alias("max_loss"), F.count(F.lit(1)).alias("n"))


#: Values of a series that are smoothed by one product.
SCAN = 256


def _smoothed(batches: Iterator[pa.RecordBatch], alpha: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(by, order, value), sorted -> also the partition, the weighted sum of a stretch's values that begins with 0, how many of them
    there are, and the sum of those that are not finite."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    keep = 1 - alpha
    lags = np.subtract.outer(np.arange(SCAN), np.arange(SCAN))
    weights = np.where(lags >= 0, alpha * keep ** np.maximum(lags, 0).astype(float), 0.0)
    decay = keep ** np.arange(1.0, SCAN + 1)
    series, y, n, odd = object(), 0.0, 0, None
    for b in batches:
        by, x = b.column(0).to_pylist(), b.column(2)
        valid = x.is_valid().to_numpy(zero_copy_only=False)
        v = x.fill_null(0.0).to_numpy(zero_copy_only=False)
        local, count, odds = np.zeros(len(v)), np.zeros(len(v), np.int64), np.full(len(v), None, object)
        cuts = [0, *(k for k in range(1, len(by)) if by[k] != by[k - 1]), len(by)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if by[i] != series:
                series, y, n, odd = by[i], 0.0, 0, None
            at = np.flatnonzero(valid[i:j]) + i
            own, strange = v[at], ~np.isfinite(v[at])
            if odd is not None or strange.any():
                upto = np.cumsum(np.r_[odd or 0.0, np.where(strange, own, 0.0)])[1:]
                seen = np.logical_or.accumulate(strange) | (odd is not None)
                odds[at[seen]] = upto[seen]
                odd = upto[-1] if len(seen) and seen[-1] else odd
                own = np.where(strange, 0.0, own)
            out = np.empty(len(own))
            for k in range(0, len(own), SCAN):
                z = own[k : k + SCAN]
                out[k : k + SCAN] = weights[: len(z), : len(z)] @ z + decay[: len(z)] * y
                y = float(out[min(k + SCAN, len(own)) - 1])
            local[at], count[at] = out, n + np.arange(1, len(own) + 1)
            n += len(own)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), x, pa.array(np.full(len(v), part, np.int32)), pa.array(local), pa.array(count), pa.array(odds, pa.float64(), from_pandas=False)], schema=schema)


def ewma(rows: DataFrame, by: str, value: str, order: str, span: int) -> DataFrame:
    """Exponentially weighted mean with alpha = 2 / (span + 1), started at the first value, over whole series.

    A value x takes the mean y to alpha x + (1 - alpha) y.  Such steps compose: those of a stretch of a series take any y to a number of their own
    plus (1 - alpha)^n y.  Series are dealt out by range; a task finds that number for each place of its stretches, the ends of a
    series' stretches are composed in order, and the mean before a stretch then enters all its places.

    A null value has no mean, and the next goes on from the last one; what is not finite stays in the mean for ever.
    """
    alpha = 2.0 / (span + 1)
    x = rows.select(by, order, F.col(value).cast("double").alias("_x"))
    shape = T.StructType([*x.schema.fields, T.StructField("_p", T.IntegerType()), T.StructField("_l", T.DoubleType()), T.StructField("_n", T.LongType()), T.StructField("_odd", T.DoubleType())])
    schema = to_arrow_schema(shape)
    ordered = x.repartitionByRange(by, order, "_x").sortWithinPartitions(by, order, "_x")
    placed = cut(ordered.mapInArrow(lambda it: _smoothed(it, alpha, schema), shape))
    some = placed.where("_x is not null")
    place = F.struct("_n").alias("place")
    ends = some.groupBy(by, "_p").agg(F.max("_n").alias("n"), F.max_by(F.struct("_l", "_odd"), "_n").alias("end"), F.min_by("_x", place).alias("first"))
    # A row for each stretch: at most as many of a series as there are partitions.
    fold = lambda s, e: F.struct(
        F.array_append(s["out"], F.struct(e["_p"].alias("p"), s["y"].alias("y"), s["odd"].alias("odd"))).alias("out"),
        (F.pow(F.lit(1 - alpha), e["n"].cast("double")) * s["y"] + e["end"]["_l"]).alias("y"),
        F.when(e["end"]["_odd"].isNotNull(), e["end"]["_odd"] + F.coalesce(s["odd"], F.lit(0.0))).otherwise(s["odd"]).alias("odd"),
    )
    none = F.array().cast("array<struct<p: int, y: double, odd: double>>")
    listed = ends.groupBy(F.col(by).alias("_by")).agg(F.array_sort(F.collect_list(F.struct("_p", "n", "end", "first"))).alias("s"))
    first = F.col("s")[0]["first"]
    # What is not finite counts as 0 in the means and is kept apart.
    start = F.struct(none.alias("out"), F.when(is_finite(first), first).otherwise(F.lit(0.0)).alias("y"), F.lit(None).cast("double").alias("odd"))
    carried = listed.select("_by", F.explode(F.aggregate("s", start, fold)["out"]).alias("c")).select("_by", "c.*")
    y = placed.join(carried, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_p") == F.col("p")), "left")
    mean = F.col("_l") + F.pow(F.lit(1 - alpha), F.col("_n").cast("double")) * F.col("y")
    strange = F.when(F.col("_odd").isNotNull() & F.col("odd").isNotNull(), F.col("_odd") + F.col("odd")).otherwise(F.coalesce("_odd", "odd"))
    return y.select(by, order, F.when(F.col("_x").isNotNull(), F.coalesce(strange, mean)).alias("smooth"))


def _alerts() -> tuple[list[Column], Column, Column]:
    """Aggregates of a tail, and from them the alerts and the severity.  Nulls of other metrics than the loss drop out."""
    fine = lambda c: F.col(c).isNull() | is_finite(F.col(c))
    sums = [F.bool_and(fine("loss") & fine("grad_norm") & fine("learning_rate")).alias("finite"), F.max("grad_norm").alias("g"), F.median("loss").alias("loss_median"), F.max("loss").alias("loss_max"), nearest_rank("loss", 0.95).alias("loss_p95"), F.median("mean_token_accuracy").alias("accuracy_median"), F.count(F.lit(1)).alias("n")]
    alerts = F.array_compact(F.array(F.when(~F.col("finite"), F.lit("non_finite_metric")), F.when(F.col("g") > 100, F.lit("gradient_norm_above_100")), F.when((F.col("loss_median") < 1e-4) & (F.col("accuracy_median") > 0.999), F.lit("training_distribution_saturated_check_generalization")), F.when((F.col("loss_median") > 0) & (F.col("loss_max") / F.col("loss_median") > 1000), F.lit("loss_outlier_above_1000x_median"))))
    severity = F.when(~F.col("finite"), "critical").when(F.size(alerts) > 0, "warning").otherwise("ok")
    return sums, F.array_join(alerts, ",").alias("alerts"), severity.alias("severity")


def health(rows: DataFrame, by: str, n: int = 100) -> DataFrame:
    """Alerts on the last n rows that have a loss, and a severity."""
    sums, alerts, severity = _alerts()
    g = last_n(rows.where("loss is not null"), [by], n).groupBy(by).agg(*sums)
    return g.select(by, "n", "loss_median", "loss_max", "loss_p95", "accuracy_median", alerts, severity)


def health_records(rows: DataFrame, by: str, n: int = 100, recent: int = 20) -> DataFrame:
    """The record of a checkpoint: `health`, the last row's step and metrics, the mean loss of the most recent rows and the gradient's median."""
    sums, alerts, severity = _alerts()
    t = rows.where("loss is not null").withColumn("_back", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("step")))).where(F.col("_back") <= n)
    last = F.max_by(F.struct("step", "loss", "grad_norm", "learning_rate"), "step").alias("last")
    g = t.groupBy(by).agg(*sums, last, F.avg(F.when(F.col("_back") <= recent, F.col("loss"))).alias("loss_mean_recent"), F.median("grad_norm").alias("grad_norm_median"))
    return g.select(by, F.col("last.step").alias("checkpoint_step"), "n", F.col("last.loss").alias("loss_last"), "loss_mean_recent", "loss_median", "loss_p95", "loss_max", F.col("last.grad_norm").alias("grad_norm_last"), "grad_norm_median", F.col("last.learning_rate").alias("learning_rate_last"), "accuracy_median", "finite", alerts, severity)


def completeness(rows: DataFrame, by: str, expected: int, tail: int = 100) -> DataFrame:
    """Violations (rule, key, detail) of a trainer history: missing steps, another last step, losses that are not finite, repeated
    steps, and warnings on the medians of the last rows that have a loss (below 1e-4) or a token accuracy (above 0.999)."""
    x = keep_last(rows, [by, "step"], "seq")
    named = lambda y, rule: y.select(F.lit(rule).alias("rule"), F.col(by).alias("key"), F.col("detail").cast("bigint").alias("detail"))
    count = F.count(F.lit(1)).alias("detail")
    out = named(missing_ranges(x, [by]).groupBy(by).agg(F.sum("n").alias("detail")), "missing_steps")
    out = out.unionByName(named(x.groupBy(by).agg(F.max("step").alias("detail")).where(F.col("detail") != expected), "last_step"))
    out = out.unionByName(named(x.where(F.col("loss").isNotNull() & ~is_finite(F.col("loss"))).groupBy(by).agg(count), "non_finite_loss"))
    out = out.unionByName(named(duplicates(rows, by, "step").where("duplicates > 0").withColumn("detail", F.col("duplicates")), "repeated_steps"))
    for metric, rule, bad in (("loss", "saturated_loss", F.col("m") < 1e-4), ("mean_token_accuracy", "saturated_accuracy", F.col("m") > 0.999)):
        t = last_n(x.where(F.col(metric).isNotNull()), [by], tail)
        out = out.unionByName(named(t.groupBy(by).agg(F.median(metric).alias("m"), count).where(bad), rule))
    return out


def completed_training(rows: DataFrame, completions: DataFrame, by: list[str], steps: int, recent: int = 20) -> DataFrame:
    """A record for each finished series: completions (by, global_step, elapsed_seconds, seconds_per_step) at `steps`, whose loss rows have just the
    steps from 1 on.  First, final and median loss, medians of the last finite values, final accuracy and rate, and whether all is finite.
    """
    x = rows.where("loss is not null")
    done = completions.where(F.col("global_step") == steps)
    finite = lambda c: F.when(is_finite(F.col(c)), F.col(c))
    place = Window.partitionBy(*by).orderBy(F.desc("step"))
    # The last finite values of a metric, by their own order.
    back = lambda c: F.when(is_finite(F.col(c)), F.sum(is_finite(F.col(c)).cast("int")).over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    x = x.withColumns({"_loss": back("loss"), "_grad": back("grad_norm")})
    fine = lambda c: F.col(c).isNull() | is_finite(F.col(c))
    g = x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("metric_rows"),
        F.count_distinct("step").alias("_steps"),
        F.min("step").alias("_low"),
        F.max("step").alias("_high"),
        F.min_by("loss", F.when(is_finite(F.col("loss")), F.col("step"))).alias("first_loss"),
        F.max_by("loss", F.when(is_finite(F.col("loss")), F.col("step"))).alias("final_loss"),
        F.median(finite("loss")).alias("median_loss"),
        F.median(F.when(F.col("_loss") <= recent, F.col("loss"))).alias("median_loss_recent"),
        F.max_by("mean_token_accuracy", F.when(is_finite(F.col("mean_token_accuracy")), F.col("step"))).alias("final_accuracy"),
        F.median(finite("mean_token_accuracy")).alias("median_accuracy"),
        F.max_by("learning_rate", "step").alias("final_learning_rate"),
        F.median(F.when(F.col("_grad") <= recent, F.col("grad_norm"))).alias("median_grad_recent"),
        F.bool_and(fine("loss") & fine("learning_rate") & fine("grad_norm")).alias("all_finite"),
    )
    g = g.where((F.col("_steps") == steps) & (F.col("_low") == 1) & (F.col("_high") == steps)).drop("_steps", "_low", "_high")
    saturated = F.coalesce((F.col("median_loss") < 1e-4) & (F.col("median_accuracy") > 0.999), F.lit(False))
    return done.join(g, by).withColumn("saturated", saturated)


def metric_matrix_problems(rows: DataFrame, by: list[str], steps: int | None, metric: str) -> DataFrame:
    """Violations (by, step, rule) over every row: a metric that is missing, not finite or not positive, a step outside 1..steps,
    a step that comes more than once, and expected steps that are missing.  With steps None the largest step of any series is expected."""
    x = rows.select(*by, "step", F.col(metric).alias("m"))
    upto = F.lit(steps if steps is not None else rows.agg(F.max("step")).first()[0] or 0)
    kind = rows.schema["step"].dataType
    each = F.explode(F.sequence(F.col("first").cast(kind), F.col("last").cast(kind)))
    missing = missing_ranges(rows, by, "step", upto).select(*by, each.alias("step"), F.lit("missing").alias("rule"))
    bad = F.when(~is_finite(F.col("m")), "not_finite").when(F.col("m") <= 0, "not_positive")
    out_of_range = F.col("step").isNull() | (F.col("step") < 1) | (F.lit(False) if steps is None else F.col("step") > steps)
    found = x.select(*by, "step", F.explode(F.array_compact(F.array(bad, F.when(out_of_range, "unexpected_step")))).alias("rule"))
    again = x.groupBy(*by, "step").count().where("count > 1").select(*by, "step", F.lit("duplicate_step").alias("rule"))
    return missing.unionByName(found).unionByName(again)


def schedule_differences(rows: DataFrame, step: str = "step", tolerance: float = 1e-12) -> DataFrame:
    """Steps at which series differ in learning rate by more than the tolerance."""
    return rows.groupBy(step).agg((F.max("learning_rate") - F.min("learning_rate")).alias("spread")).where(F.col("spread") > tolerance)


def seed_curves(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, minimum, maximum and number over seeds of each metric by variant and step."""
    long = rows.unpivot(["variant", "seed", "step"], metrics, "metric", "value").where("value is not null")
    return long.groupBy("variant", "step", "metric").agg(F.round(F.avg("value"), 9).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n"))


def last_match(lines: DataFrame, pattern: str, by: str, line: str = "line_no", text: str = "text") -> DataFrame:
    """The last line's number that a pattern finds (its first group)."""
    x = lines.withColumn("v", F.regexp_extract(text, pattern, 1)).where("v <> ''")
    return x.groupBy(by).agg(F.max_by("v", line).alias("last"))


def active_state(lines: DataFrame, by: str, line: str = "line_no", text: str = "text") -> DataFrame:
    """What began last and did not end: from BEGIN / DONE / FAILED lines."""
    x = lines.withColumn("state", F.regexp_extract(text, r"^(BEGIN|DONE|FAILED)\b", 1)).where("state <> ''")
    last = x.groupBy(by).agg(F.max_by(F.struct("state", text), line).alias("s"))
    return last.select(by, F.col("s.state").alias("state"), (F.col("s.state") == "BEGIN").alias("active"))
