"""Queries of rates, cells, gaps and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells
from ..schemas import APPLICABLE, METRICS
from .registry import query
from .views import GRID_SQL, RESULTS_SQL, grid, results, table


def sql_hit(m: str) -> str:
    one = f"CAST(coalesce({m}, false) AS INT)"
    return f"CASE WHEN coalesce({APPLICABLE[m]}, true) THEN {one} END" if m in APPLICABLE else one


SQL_RATES = "count(*) AS n, " + ", ".join(f"count({sql_hit(m)}) AS {m}_n, avg({sql_hit(m)}) AS {m}" for m in METRICS)
COND = "evaluation_mode, task, filler_type, target_tokens"
SQL_EDGES = """(max(rate) FILTER (position_label = 'p000') + max(rate) FILTER (position_label = 'p100')) / 2 AS edge, max(rate) FILTER (position_label = 'p050') AS middle,
 (max(rate) FILTER (position_label = 'p000') + max(rate) FILTER (position_label = 'p100')) / 2 - max(rate) FILTER (position_label = 'p050') AS penalty"""
SQL_MEANS = ", ".join(f"round(avg({c}), 9) AS {c}" for c in ("worst", "gap", "edge", "middle", "penalty"))
SQL_GAP = f"""cell AS (SELECT run_name, task, filler_type, target_tokens, position_label, avg(CAST(coalesce(answer_correct, false) AS INT)) AS rate FROM results GROUP BY ALL),
 cond AS (SELECT run_name, task, filler_type, target_tokens, min(rate) AS worst, max(rate) - min(rate) AS gap, {SQL_EDGES} FROM cell GROUP BY run_name, task, filler_type, target_tokens),
 gaps AS (SELECT run_name, {SQL_MEANS} FROM cond GROUP BY run_name)"""
SQL_GROUPS = "grp AS (SELECT run_name, evaluation_mode, group_id, bool_and(coalesce(answer_correct, false)) AS all_correct, coalesce(count(answer) = count(*) AND min(answer) = max(answer), false) AS same FROM results GROUP BY ALL)"


@query("position_gap", f"WITH {RESULTS_SQL}, {SQL_GAP} SELECT * FROM gaps")
def position_gap(spark, d):
    return cells.position_gap(results(spark, d))


@query("rates_by_cell", f"WITH {RESULTS_SQL} SELECT run_name, {COND}, position_label, {SQL_RATES} FROM results GROUP BY run_name, {COND}, position_label")
def rates_by_cell(spark, d):
    return cells.by_cell(results(spark, d))


@query("rates_rollup", f"WITH {RESULTS_SQL} SELECT run_name, evaluation_mode, CAST(grouping(evaluation_mode) AS INT) AS all_modes, {SQL_RATES} FROM results GROUP BY GROUPING SETS ((run_name), (run_name, evaluation_mode))")
def rates_rollup(spark, d):
    return cells.rollups(results(spark, d))


@query("condition_gaps", f"WITH {RESULTS_SQL}, cell AS (SELECT run_name, {COND}, position_label, avg({sql_hit('answer_correct')}) AS rate FROM results GROUP BY ALL) SELECT run_name, {COND}, max(rate) AS best, min(rate) AS worst, max(rate) - min(rate) AS gap, count(*) AS n_positions FROM cell WHERE rate IS NOT NULL GROUP BY run_name, {COND}")
def condition_gaps(spark, d):
    return cells.condition_gaps(results(spark, d))


@query("group_consistency", f"WITH {RESULTS_SQL}, {SQL_GROUPS} SELECT run_name, evaluation_mode, count(*) AS groups, avg(CAST(all_correct AS INT)) AS all_positions_correct, avg(CAST(same AS INT)) AS same_answer FROM grp GROUP BY run_name, evaluation_mode")
def group_consistency(spark, d):
    return cells.consistency(results(spark, d))


@query("summary_two_by_two", f"WITH {RESULTS_SQL}, {SQL_GAP}, plain AS (SELECT run_name, " + ", ".join(f"avg(CAST(coalesce({m}, false) AS INT)) AS {m}" for m in METRICS) + " FROM results GROUP BY run_name) SELECT * FROM plain JOIN gaps USING (run_name)")
def summary_two_by_two(spark, d):
    return cells.summary_two_by_two(results(spark, d))


@query(
    "summary_two_by_three",
    f"""WITH {RESULTS_SQL}, {SQL_GROUPS}, plain AS (SELECT run_name, {", ".join(f"avg({sql_hit(m)}) AS {m}" for m in METRICS)} FROM results GROUP BY run_name),
 qc AS (SELECT run_name, {COND}, position_label, avg({sql_hit("evidence_quotes_correct")}) AS rate, count({sql_hit("evidence_quotes_correct")}) AS m FROM results GROUP BY ALL),
 qk AS (SELECT run_name, {COND}, CASE WHEN count(*) FILTER (m > 0) = 7 THEN min(rate) END AS w, CASE WHEN count(*) FILTER (m > 0) = 7 THEN max(rate) - min(rate) END AS g FROM qc GROUP BY run_name, {COND}),
 quotes AS (SELECT run_name, round(avg(w), 9) AS quote_worst, round(avg(g), 9) AS quote_gap FROM qk GROUP BY run_name),
 cell AS (SELECT run_name, {COND}, position_label, avg({sql_hit("answer_correct")}) AS rate FROM results GROUP BY ALL),
 cond AS (SELECT run_name, {COND}, min(rate) AS worst, max(rate) - min(rate) AS gap, {SQL_EDGES} FROM cell GROUP BY run_name, {COND}),
 pos AS (SELECT run_name, {SQL_MEANS} FROM cond GROUP BY run_name),
 cons AS (SELECT run_name, avg(CAST(all_correct AS INT)) AS all_positions_correct, avg(CAST(same AS INT)) AS same_answer FROM grp GROUP BY run_name)
 SELECT * FROM plain JOIN quotes USING (run_name) JOIN pos USING (run_name) JOIN cons USING (run_name)""",
)
def summary_two_by_three(spark, d):
    return cells.summary_two_by_three(results(spark, d))


@query("edge_middle", f"WITH {RESULTS_SQL}, cell AS (SELECT run_name, {COND}, position_label, avg({sql_hit('answer_correct')}) AS rate FROM results GROUP BY ALL) SELECT run_name, {COND}, min(rate) AS worst, max(rate) - min(rate) AS gap, {SQL_EDGES} FROM cell GROUP BY run_name, {COND}")
def edge_middle(spark, d):
    return cells.conditions(results(spark, d), cells.hit("answer_correct"), ("run_name", *cells.CONDITION))


@query("position_profile", f"WITH {RESULTS_SQL} SELECT run_name, task, target_tokens, position_label, avg({sql_hit('answer_correct')}) AS rate FROM results GROUP BY run_name, task, target_tokens, position_label")
def position_profile(spark, d):
    return cells.profile(results(spark, d))


@query("cell_diagnostics", f"WITH {RESULTS_SQL} SELECT run_name, {COND}, position_label, count(*) AS n, avg(CAST(coalesce(finish_reason, 'unknown') = 'length' AS INT)) AS length_stop_rate, avg(coalesce(output_tokens, 0)) AS mean_output_tokens, avg({sql_hit('valid_json')}) AS valid_json, avg({sql_hit('answer_correct')}) AS answer_correct FROM results GROUP BY run_name, {COND}, position_label")
def cell_diagnostics(spark, d):
    return cells.cell_diagnostics(results(spark, d))


@query("finish_reasons", f"WITH {RESULTS_SQL} SELECT run_name, coalesce(finish_reason, 'unknown') AS finish_reason, count(*) AS n, avg(coalesce(output_tokens, 0)) AS mean_tokens, max(coalesce(output_tokens, 0)) AS max_tokens FROM results GROUP BY 1, 2")
def finish_reasons(spark, d):
    return cells.finish_reasons(results(spark, d))


_FLAGS = "l_tax <= 0.06, l_discount >= 0.03, l_quantity < 30"


@query("instruction_ratios", f"WITH x AS (SELECT l_suppkey % 7 AS run_no, CASE WHEN l_linenumber % 2 = 0 THEN [{_FLAGS}] ELSE [l_tax <= 0.06] END AS flags FROM lineitem) SELECT run_no, avg(CAST(len(list_filter(flags, lambda f: f)) = len(flags) AS INT)) AS prompt_rate, sum(len(list_filter(flags, lambda f: f))) / sum(len(flags)) AS instruction_rate FROM x GROUP BY run_no")
def instruction_ratios(spark, d):
    x = table(spark, d, "lineitem").selectExpr("l_suppkey % 7 AS run_no", f"CASE WHEN l_linenumber % 2 = 0 THEN array({_FLAGS}) ELSE array(l_tax <= 0.06) END AS flags")
    return cells.instruction_ratios(x, "flags", "run_no")


@query(
    "slice_means",
    f"""WITH {RESULTS_SQL}, x AS (SELECT run_name, answer_score, unnest(['overall', 'task:' || task, 'length:' || CASE WHEN output_tokens * 100 < 4000 THEN 'short' WHEN output_tokens * 100 < 8000 THEN 'medium' ELSE 'long' END]) AS slice FROM results)
 SELECT run_name, slice, count(*) AS n, round(avg(answer_score), 9) AS mean_score FROM x GROUP BY run_name, slice""",
)
def slice_means(spark, d):
    return cells.slice_means(results(spark, d).withColumn("length", F.col("output_tokens") * 100), "length", "answer_score")


@query("subject_accuracy", f"WITH {GRID_SQL} SELECT run_name, regexp_replace(subject, '^Brand#', '') AS subject, count(*) AS n, avg(CAST(correct AS INT)) AS accuracy FROM grid GROUP BY 1, 2")
def subject_accuracy(spark, d):
    return cells.subject_accuracy(grid(spark, d), "Brand#")


@query("execution_report", f"WITH {RESULTS_SQL} SELECT run_name, count(*) AS n, round(sum(batch_wall_seconds / 8), 6) AS seconds, round(sum(batch_wall_seconds / 8) / count(*), 9) AS seconds_per_row, avg({sql_hit('valid_json')}) AS valid_json, avg(CAST(coalesce(finish_reason, 'unknown') = 'length' AS INT)) AS length_stop_rate, max(output_tokens) AS max_tokens, avg(output_tokens) AS mean_tokens FROM results GROUP BY run_name")
def execution_report(spark, d):
    return cells.execution_report(results(spark, d))
