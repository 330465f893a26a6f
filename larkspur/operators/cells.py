"""Rates, cells, position gaps, consistency and profiles of scored rows.

A row to which a metric applies and whose metric is null counts as a failure; a row to which it does not apply counts
nowhere; a rate over no rows is null.  Every operator is one aggregation per level, all with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import APPLICABLE, GRID, METRICS

CONDITION = ("evaluation_mode", "task", "filler_type", "target_tokens")
CELL = ("run_name", *CONDITION, "position_label")
EDGES, MIDDLE = (GRID[0], GRID[-1]), GRID[3]


def applies(metric: str) -> Column:
    return F.coalesce(F.col(APPLICABLE[metric]), F.lit(True)) if metric in APPLICABLE else F.lit(True)


def hit(metric: str) -> Column:
    """1 or 0 where the metric applies, else null."""
    return F.when(applies(metric), F.coalesce(F.col(metric), F.lit(False)).cast("int"))


def rates(metrics=METRICS) -> list[Column]:
    out = [F.count(F.lit(1)).alias("n")]
    for m in metrics:
        out += [F.count(hit(m)).alias(f"{m}_n"), F.avg(hit(m)).alias(m)]
    return out


def by_cell(rows: DataFrame, keys=CELL, metrics=METRICS) -> DataFrame:
    return rows.groupBy(*keys).agg(*rates(metrics))


def rollups(rows: DataFrame) -> DataFrame:
    """Rates by run and by (run, mode) in one scan."""
    sets = rows.groupingSets([["run_name"], ["run_name", "evaluation_mode"]], "run_name", "evaluation_mode")
    return sets.agg(F.grouping("evaluation_mode").cast("int").alias("all_modes"), *rates())


def condition_gaps(rows: DataFrame, metric: str = "answer_correct") -> DataFrame:
    """Two levels: the rate of each cell, then best, worst, gap and number of positions of each condition."""
    cell = rows.groupBy(*CELL).agg(F.avg(hit(metric)).alias("rate"))
    return cell.where("rate is not null").groupBy("run_name", *CONDITION).agg(F.max("rate").alias("best"), F.min("rate").alias("worst"), (F.max("rate") - F.min("rate")).alias("gap"), F.count(F.lit(1)).alias("n_positions"))


def at(label: str, rate: str = "rate") -> Column:
    return F.max(F.when(F.col("position_label") == label, F.col(rate)))


def edge_and_middle(rate: str = "rate") -> list[Column]:
    edge = (at(EDGES[0], rate) + at(EDGES[1], rate)) / 2
    return [edge.alias("edge"), at(MIDDLE, rate).alias("middle"), (edge - at(MIDDLE, rate)).alias("penalty")]


def conditions(rows: DataFrame, correct: Column, keys) -> DataFrame:
    cell = rows.groupBy(*keys, "position_label").agg(F.avg(correct).alias("rate"))
    return cell.groupBy(*keys).agg(F.min("rate").alias("worst"), (F.max("rate") - F.min("rate")).alias("gap"), *edge_and_middle())


def mean_over_conditions(per_condition: DataFrame, by: str = "run_name", digits: int = 9) -> DataFrame:
    return per_condition.groupBy(by).agg(*(F.round(F.avg(c), digits).alias(c) for c in ("worst", "gap", "edge", "middle", "penalty")))


def position_gap(rows: DataFrame, metric: str = "answer_correct") -> DataFrame:
    """By run: worst, gap, edge, middle and penalty, a mean over conditions of equal weight."""
    keys = ("run_name", "task", "filler_type", "target_tokens")
    return mean_over_conditions(conditions(rows, F.coalesce(F.col(metric), F.lit(False)).cast("int"), keys))


def summary_two_by_two(rows: DataFrame) -> DataFrame:
    """Row rates with all rows in every denominator, and the position statistics."""
    plain = rows.groupBy("run_name").agg(*(F.avg(F.coalesce(F.col(m), F.lit(False)).cast("int")).alias(m) for m in METRICS))
    return plain.join(position_gap(rows), "run_name")


def group_consistency(rows: DataFrame, keys=("run_name", "evaluation_mode", "group_id")) -> DataFrame:
    one = F.count("answer") == F.count(F.lit(1))
    return rows.groupBy(*keys).agg(F.bool_and(F.coalesce("answer_correct", F.lit(False))).alias("all_correct"), (one & (F.min("answer") == F.max("answer"))).alias("same"))


def consistency(rows: DataFrame) -> DataFrame:
    """Share of groups that are all correct, and of those that give one non-null answer, by run and mode."""
    g = group_consistency(rows)
    return g.groupBy("run_name", "evaluation_mode").agg(F.count(F.lit(1)).alias("groups"), F.avg(F.col("all_correct").cast("int")).alias("all_positions_correct"), F.avg(F.coalesce("same", F.lit(False)).cast("int")).alias("same_answer"))


def quote_conditions(rows: DataFrame) -> DataFrame:
    """Worst and gap of quotes, only for conditions in which all positions have rows to which they apply."""
    m = "evidence_quotes_correct"
    cell = rows.groupBy("run_name", *CONDITION, "position_label").agg(F.avg(hit(m)).alias("rate"), F.count(hit(m)).alias("m"))
    full = F.count_if(F.col("m") > 0) == len(GRID)
    return cell.groupBy("run_name", *CONDITION).agg(F.when(full, F.min("rate")).alias("worst"), F.when(full, F.max("rate") - F.min("rate")).alias("gap"))


def summary_two_by_three(rows: DataFrame) -> DataFrame:
    plain = rows.groupBy("run_name").agg(*(F.avg(hit(m)).alias(m) for m in METRICS))
    quotes = quote_conditions(rows).groupBy("run_name").agg(F.round(F.avg("worst"), 9).alias("quote_worst"), F.round(F.avg("gap"), 9).alias("quote_gap"))
    where = mean_over_conditions(conditions(rows, hit("answer_correct"), ("run_name", *CONDITION)))
    g = group_consistency(rows).groupBy("run_name").agg(F.avg(F.col("all_correct").cast("int")).alias("all_positions_correct"), F.avg(F.coalesce("same", F.lit(False)).cast("int")).alias("same_answer"))
    return plain.join(quotes, "run_name").join(where, "run_name").join(g, "run_name")


def profile(rows: DataFrame, metric: str = "answer_correct") -> DataFrame:
    """Mean by task, length and position, pooled over fillers."""
    return rows.groupBy("run_name", "task", "target_tokens", "position_label").agg(F.avg(hit(metric)).alias("rate"))


def cell_diagnostics(rows: DataFrame) -> DataFrame:
    stop = F.avg((F.coalesce("finish_reason", F.lit("unknown")) == "length").cast("int"))
    return rows.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), stop.alias("length_stop_rate"), F.avg(F.coalesce("output_tokens", F.lit(0))).alias("mean_output_tokens"), F.avg(hit("valid_json")).alias("valid_json"), F.avg(hit("answer_correct")).alias("answer_correct"))


def finish_reasons(rows: DataFrame) -> DataFrame:
    tokens = F.coalesce("output_tokens", F.lit(0))
    return rows.groupBy("run_name", F.coalesce("finish_reason", F.lit("unknown")).alias("finish_reason")).agg(F.count(F.lit(1)).alias("n"), F.avg(tokens).alias("mean_tokens"), F.max(tokens).alias("max_tokens"))


def instruction_ratios(rows: DataFrame, lists: str, by: str) -> DataFrame:
    """Prompts that follow all instructions, and the share of instructions followed over all prompts (a ratio of sums)."""
    followed = F.size(F.filter(F.col(lists), lambda x: x))
    return rows.groupBy(by).agg(F.avg((followed == F.size(lists)).cast("int")).alias("prompt_rate"), (F.sum(followed) / F.sum(F.size(lists))).alias("instruction_rate"))


def length_bin(n: Column) -> Column:
    return F.when(n < 4000, "short").when(n < 8000, "medium").otherwise("long")


def slice_means(rows: DataFrame, length: str, score: str) -> DataFrame:
    """Means over all rows, by task and by length bin, in one scan: each row goes to its three slices."""
    labels = F.array(F.lit("overall"), F.concat(F.lit("task:"), F.col("task")), F.concat(F.lit("length:"), length_bin(F.col(length))))
    return rows.select("run_name", F.explode(labels).alias("slice"), score).groupBy("run_name", "slice").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 9).alias("mean_score"))


def subject_accuracy(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.groupBy("run_name", F.regexp_replace("subject", f"^{prefix}", "").alias("subject")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("int")).alias("accuracy"))


def execution_report(rows: DataFrame, batch: int = 8) -> DataFrame:
    """By run: generation seconds (a batch's wall time shared by its rows), per row, rates and token counts."""
    wall = F.sum(F.col("batch_wall_seconds") / batch)
    return rows.groupBy("run_name").agg(F.count(F.lit(1)).alias("n"), F.round(wall, 6).alias("seconds"), F.round(wall / F.count(F.lit(1)), 9).alias("seconds_per_row"), F.avg(hit("valid_json")).alias("valid_json"), F.avg((F.coalesce("finish_reason", F.lit("unknown")) == "length").cast("int")).alias("length_stop_rate"), F.max("output_tokens").alias("max_tokens"), F.avg("output_tokens").alias("mean_tokens"))


def gate_metrics(rows: DataFrame, cap: str, fields: list[str]) -> DataFrame:
    """By cap: rows, length stops, valid share, and a hash of the rows that does not hang on their order and is summed where they lie.

    A row is written with the length of each field, and a null as a dash; two words of 60 bits of its hash are summed.
    """
    text = [F.col(c).cast("string") for c in fields]
    digest = F.sha2(F.concat(*(F.coalesce(F.concat(F.length(t), F.lit(":"), t), F.lit("-")) for t in text)), 256)
    word = lambda k: F.sum(F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return rows.groupBy(F.col(cap).alias("cap")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("finish_reason") == "length").alias("length_stops"), F.avg(F.col("valid_json").cast("int")).alias("valid_rate"), F.concat_ws(":", word(0), word(1)).alias("rows_hash"))
