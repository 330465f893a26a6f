"""Joins that align runs: exact-set joins, transitions, mechanism joins, set checks, pair counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach(rows: DataFrame, source: DataFrame, key: str, field: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Join of rows with the metadata of a source, and the violations (rule, key).

    Violations: ids missing on either side, ids that the source repeats, rows without an id, and with `field` rows whose own
    value of that field is not null and differs from the source's.  Ids that the source repeats are not joined.
    """
    name = lambda x, rule: x.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))
    counted = source.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    once = source.join(counted.where("_n = 1").select(key), key, "left_semi")
    bad = name(rows.join(source, key, "left_anti"), "missing_in_source").unionByName(name(source.join(rows, key, "left_anti"), "missing_in_rows")).unionByName(name(counted.where("_n > 1"), "repeated_in_source"))
    if field is None:
        return rows.join(once, key), bad
    theirs = once.withColumnRenamed(field, "_theirs")
    both = rows.join(theirs, key)
    clash = F.col(field).isNotNull() & ~F.col(field).eqNullSafe(F.col("_theirs"))
    return both.withColumn(field, F.col("_theirs")).drop("_theirs"), bad.unionByName(name(both.where(clash), "conflict"))


def look_up(rows: DataFrame, source: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Many-to-one: fields of the source's row with that key, null where it has none; a key that the source repeats is an error."""
    one = source.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *(F.first(f).alias(f) for f in fields))
    checked = [F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"{key} repeats: "), F.col(key).cast("string")))).otherwise(F.col(f)).alias(f) for f in fields]
    return rows.join(one.select(key, *checked), key, "left")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def run_names(rows: DataFrame, run: str = "run_name") -> list:
    """The distinct runs, in order: as many bits has a membership."""
    return sorted(r[0] for r in rows.where(F.col(run).isNotNull()).select(run).distinct().collect())


def memberships(rows: DataFrame, key: str, runs: list, run: str = "run_name") -> DataFrame:
    """For each key which runs have it, and which more than once, as bits of 64-bit words by the runs' places in the list.

    One aggregation that combines before its shuffle, with a row for each key: no row stands for a key and a run that should be there.
    """
    words = range(-(-max(1, len(runs)) // 63))
    bit = lambda w: F.coalesce(*(F.when(F.col(run) == r, F.lit(1 << (k % 63))) for k, r in enumerate(runs) if k // 63 == w), F.lit(0)).cast("bigint")
    once = rows.groupBy(F.col(key).alias("key"), F.col(run).alias(run)).agg(F.count(F.lit(1)).alias("_c"))
    has = [F.bit_or(bit(w)).alias(f"has{w}") for w in words]
    again = [F.bit_or(F.when(F.col("_c") > 1, bit(w)).otherwise(F.lit(0).cast("bigint"))).alias(f"again{w}") for w in words]
    return once.groupBy("key").agg(*has, *again, F.sum("_c").alias("n"))


def held_by(k: int, what: str = "has") -> Column:
    """Whether the bit of run k is set."""
    return F.getbit(F.col(f"{what}{k // 63}"), F.lit(k % 63)) == 1


def misaligned(rows: DataFrame, key: str, n_runs: int) -> DataFrame:
    """Samples that not every run has exactly once."""
    g = memberships(rows, key, run_names(rows))
    runs = sum((F.bit_count(c) for c in g.columns if c.startswith("has")), F.lit(0)).cast("bigint")
    x = g.select(F.col("key").alias(key), runs.alias("runs"), "n")
    return x.where((F.col("runs") != n_runs) | (F.col("n") != n_runs))


def incomplete_groups(rows: DataFrame, group: list[str], positions: int, condition: list[str]) -> DataFrame:
    """Groups without every position exactly once, or of several conditions."""
    g = rows.groupBy(*group).agg(F.count_distinct("position_label").alias("labels"), F.count(F.lit(1)).alias("n"), F.count_distinct(*condition).alias("conditions"))
    return g.where((F.col("labels") != positions) | (F.col("n") != positions) | (F.col("conditions") != 1))


def transitions(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """How often each value of a becomes each value of b, by key.  The sides are as large as the runs: the join is told to shuffle, as the
    planner takes rows that an explode has multiplied for small, and would broadcast them."""
    x = a.select(key, F.col(value).alias("before")).join(b.select(key, F.col(value).alias("after")).hint("merge"), key)
    return x.groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


def set_differences(rows: DataFrame, key: str, expected: DataFrame) -> DataFrame:
    """By run: expected ids that are missing, and extra ids.  An id is one row of bits on either side, so one join settles all runs."""
    runs = run_names(rows)
    if not runs:
        return rows.sparkSession.createDataFrame([], rows.select("run_name").schema.add("missing", "long").add("extra", "long"))
    got, want = memberships(rows, key, runs), expected.select(F.col(key).alias("key")).distinct().withColumn("wanted", F.lit(True))
    x = got.join(want, got["key"].eqNullSafe(want["key"]), "full_outer")
    wanted = F.coalesce("wanted", F.lit(False))
    sums = [f(c).alias(f"{name}{k}") for k in range(len(runs)) for name, f, c in (("m", F.count_if, wanted & ~F.coalesce(held_by(k), F.lit(False))), ("e", F.count_if, ~wanted & F.coalesce(held_by(k), F.lit(False))))]
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("run_name"), F.col(f"m{k}").alias("missing"), F.col(f"e{k}").alias("extra")) for k, r in enumerate(runs))))
    return x.agg(*sums).select(each.alias("x")).select("x.*")


def cell_differences(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Grid cells in which two variants differ, in one full outer join: nulls equal nulls."""
    x = a.select(*keys, F.struct(*values).alias("va")).join(b.select(*keys, F.struct(*values).alias("vb")), keys, "full_outer")
    return x.where(~F.col("va").eqNullSafe(F.col("vb"))).select(*keys, F.when(F.col("va").isNull(), "only_right").when(F.col("vb").isNull(), "only_left").otherwise("differs").alias("kind"))


def mechanism_records(rows: DataFrame, positions: int = 7, within: str | None = None) -> DataFrame:
    """One record for each (run, group) that has 7 free, 7 locate, 1 oracle-long and 1 oracle-short row.

    The derived group keys carry a suffix; cut off, one aggregation replaces three joins.  within: a column that is the same in all rows of a
    group, by which rows are dealt out already; then they are not shuffled.
    """
    g = F.regexp_replace("group_id", "@diag-.*$", "").alias("group_id")
    is_ = lambda mode: F.col("evaluation_mode") == mode
    right, quote, support = (F.coalesce(F.col(c), F.lit(False)) for c in ("answer_correct", "evidence_quotes_correct", "all_predicted_quotes_supported"))
    share = lambda mode, c: F.sum(F.when(is_(mode), c.cast("int"))) / positions
    x = rows.groupBy("run_name", g, *([] if within is None else [within])).agg(
        *(F.count_if(is_(m)).alias(f"n_{m}") for m in ("free", "locate_only", "oracle_long", "oracle_short")),
        share("free", right).alias("free_answer"),
        share("free", quote).alias("free_quote"),
        F.bool_and(F.when(is_("free"), right)).cast("int").alias("free_worst_answer"),
        share("locate_only", quote).alias("locate_quote"),
        F.bool_and(F.when(is_("locate_only"), quote)).cast("int").alias("locate_worst_quote"),
        share("locate_only", support).alias("locate_supported"),
        F.max(F.when(is_("oracle_long"), right.cast("int"))).alias("oracle_long_answer"),
        F.max(F.when(is_("oracle_short"), right.cast("int"))).alias("oracle_short_answer"),
    )
    whole = (F.col("n_free") == positions) & (F.col("n_locate_only") == positions) & (F.col("n_oracle_long") == 1) & (F.col("n_oracle_short") == 1)
    return x.where(whole).drop("n_free", "n_locate_only", "n_oracle_long", "n_oracle_short", *([] if within is None else [within]))


def with_derived(x: DataFrame) -> DataFrame:
    return x.withColumns({"retrieval_recovery": F.col("oracle_long_answer") - F.col("free_answer"), "localization_gain": F.col("locate_quote") - F.col("free_quote"), "long_distraction_penalty": F.col("oracle_short_answer") - F.col("oracle_long_answer"), "residual_reasoning_error": 1.0 - F.col("oracle_short_answer")})


def pair_counts(rows: DataFrame, fact: str, position: str) -> DataFrame:
    """Unordered pairs of rows of one fact, and those at different positions, in closed form instead of a self-join."""
    pairs = lambda n: n * (n - 1) / 2
    by = rows.groupBy(fact, position).agg(F.count(F.lit(1)).alias("k"))
    g = by.groupBy(fact).agg(F.sum("k").alias("n"), F.sum(pairs(F.col("k"))).alias("same"), F.count(F.lit(1)).alias("positions"))
    return g.select(fact, "n", "positions", pairs(F.col("n")).cast("bigint").alias("pairs"), (pairs(F.col("n")) - F.col("same")).cast("bigint").alias("cross_position_pairs"))


def weighted_mean(rows: DataFrame, weights: DataFrame, key: str, by: list[str], value: str) -> DataFrame:
    """Mean over tasks by weight; null unless every weighted task is there."""
    n = weights.count()
    x = rows.join(F.broadcast(weights), key)
    return x.groupBy(*by).agg(F.when(F.count(value) == n, F.round(F.sum(F.col("weight") * F.col(value)) / F.sum("weight"), 9)).alias(value))


def pending(samples: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return samples.join(done.select(key).distinct(), key, "left_anti")


def axes(spark, **values) -> DataFrame:
    """The product of condition axes: small literal lists."""
    out = None
    for name, items in values.items():
        x = spark.createDataFrame([(v,) for v in items], [name])
        out = x if out is None else out.crossJoin(F.broadcast(x))
    return out

