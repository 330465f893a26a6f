"""Queries of metric histories, ledgers, budgets, files and counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits, cells, ledger, timeseries
from ..sources import files
from .registry import query
from .views import HISTORY_SQL, RESULTS_SQL, history, results, table

SOME = "(loss IS NOT NULL OR eval_loss IS NOT NULL OR learning_rate IS NOT NULL)"


@query("tail_statistics", f"WITH {HISTORY_SQL}, t AS (SELECT variant, loss, row_number() OVER (PARTITION BY variant ORDER BY step DESC) AS k FROM history WHERE loss IS NOT NULL) SELECT variant, median(loss) AS median_loss, round(avg(loss), 9) AS mean_loss, max(loss) AS max_loss, count(*) AS n FROM t WHERE k <= 20 GROUP BY variant")
def tail_statistics(spark, d):
    return timeseries.tail_statistics(history(spark, d), "variant", 20)


@query("first_last_best", f"WITH {HISTORY_SQL} SELECT variant, arg_min(loss, step) AS first_loss, arg_max(loss, step) AS last_loss, min(loss) AS best_loss, arg_min(step, (loss, step)) AS best_step FROM history WHERE loss IS NOT NULL GROUP BY variant")
def first_last_best(spark, d):
    return timeseries.first_last_best(history(spark, d), "variant")


@query("deduplicated_steps", f"WITH {HISTORY_SQL}, h AS (SELECT *, step // 2 AS s2 FROM history WHERE {SOME}), k AS (SELECT variant, s2, loss, row_number() OVER (PARTITION BY variant, s2 ORDER BY seq DESC) AS k FROM h) SELECT variant, s2, loss FROM k WHERE k = 1")
def deduplicated_steps(spark, d):
    h = history(spark, d).withColumn("s2", F.floor(F.col("step") / 2).cast("int"))
    return timeseries.keep_last(h, ["variant", "s2"], "seq").select("variant", "s2", "loss")


@query("duplicate_steps", f"WITH {HISTORY_SQL} SELECT variant, count(*) AS records, count(*) - count(DISTINCT step // 2) AS duplicates FROM history WHERE {SOME} GROUP BY variant")
def duplicate_steps(spark, d):
    return timeseries.duplicates(history(spark, d).withColumn("s2", F.floor(F.col("step") / 2)), "variant", "s2")


@query("missing_steps", f"WITH {HISTORY_SQL}, h AS (SELECT * FROM history WHERE loss IS NOT NULL), m AS (SELECT variant, unnest(range(1, max(step) + 1)) AS step FROM h GROUP BY variant) SELECT variant, CAST(step AS INT) AS step FROM m WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.variant = m.variant AND h.step = m.step)")
def missing_steps(spark, d):
    return timeseries.missing_steps(history(spark, d).where("loss is not null"), "variant")


def ewma_sql(alpha: str, steps: int) -> str:
    """The weighted mean by doubling: after a step with distance h it holds the last 2 h terms; beyond h = 4096 weights are 0."""
    out = f"e0 AS (SELECT variant, step, k, CASE WHEN k = 1 THEN loss ELSE {alpha} * loss END AS s FROM h)"
    for i in range(steps):
        out += f", e{i + 1} AS (SELECT variant, step, k, s + pow(1 - {alpha}, {1 << i}) * coalesce(lag(s, {1 << i}) OVER (PARTITION BY variant ORDER BY k), 0) AS s FROM e{i})"
    return out


@query("smoothed_losses", f"WITH {HISTORY_SQL}, h AS (SELECT variant, step, loss, row_number() OVER (PARTITION BY variant ORDER BY step) AS k FROM history WHERE loss IS NOT NULL), {ewma_sql('(2.0::DOUBLE / 11)', 13)} SELECT variant, step, round(s, 8) AS smooth FROM e13")
def smoothed_losses(spark, d):
    """Every step of every series."""
    return timeseries.ewma(history(spark, d).where("loss is not null"), "variant", "loss", "step", 10).withColumn("smooth", F.round("smooth", 8))


@query("training_health", f"WITH {HISTORY_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY step DESC) AS k FROM history WHERE loss IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY loss) - 1 AS r FROM t WHERE k <= 100), g AS (SELECT variant, count(*) AS n, median(loss) AS loss_median, max(loss) AS loss_max, max(loss) FILTER (r = CAST(round_even(99 * 0.95, 0) AS INT)) AS loss_p95, median(mean_token_accuracy) AS accuracy_median, max(grad_norm) AS g FROM o GROUP BY variant) SELECT variant, n, loss_median, loss_max, loss_p95, accuracy_median, array_to_string(list_filter([CASE WHEN g > 100 THEN 'gradient_norm_above_100' END, CASE WHEN loss_median < 1e-4 AND accuracy_median > 0.999 THEN 'training_distribution_saturated_check_generalization' END, CASE WHEN loss_median > 0 AND loss_max / loss_median > 1000 THEN 'loss_outlier_above_1000x_median' END], lambda x: x IS NOT NULL), ',') AS alerts, CASE WHEN g > 100 OR (loss_median < 1e-4 AND accuracy_median > 0.999) OR (loss_median > 0 AND loss_max / loss_median > 1000) THEN 'warning' ELSE 'ok' END AS severity FROM g")
def training_health(spark, d):
    return timeseries.health(history(spark, d), "variant")


@query("health_records", f"WITH {HISTORY_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY step DESC) AS k FROM history WHERE loss IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY loss) - 1 AS r FROM t WHERE k <= 100), g AS (SELECT variant, max(step) AS checkpoint_step, count(*) AS n, round(avg(loss) FILTER (k <= 20), 9) AS loss_mean_recent, median(loss) AS loss_median, max(loss) AS loss_max, max(loss) FILTER (r = CAST(round_even(99 * 0.95, 0) AS INT)) AS loss_p95, median(mean_token_accuracy) AS accuracy_median, max(grad_norm) AS g, median(grad_norm) AS grad_norm_median, bool_and(isfinite(loss) AND coalesce(isfinite(grad_norm), true) AND coalesce(isfinite(learning_rate), true)) AS finite FROM o GROUP BY variant), s AS (SELECT *, list_filter([CASE WHEN NOT finite THEN 'non_finite_metric' END, CASE WHEN g > 100 THEN 'gradient_norm_above_100' END, CASE WHEN loss_median < 1e-4 AND accuracy_median > 0.999 THEN 'training_distribution_saturated_check_generalization' END, CASE WHEN loss_median > 0 AND loss_max / loss_median > 1000 THEN 'loss_outlier_above_1000x_median' END], lambda x: x IS NOT NULL) AS a FROM g) SELECT s.variant, checkpoint_step, n, t.loss AS loss_last, loss_mean_recent, loss_median, loss_p95, loss_max, t.grad_norm AS grad_norm_last, grad_norm_median, t.learning_rate AS learning_rate_last, accuracy_median, finite, array_to_string(a, ',') AS alerts, CASE WHEN NOT finite THEN 'critical' WHEN len(a) > 0 THEN 'warning' ELSE 'ok' END AS severity FROM s JOIN t ON t.variant = s.variant AND t.k = 1")
def health_records(spark, d):
    return timeseries.health_records(history(spark, d), "variant").withColumn("loss_mean_recent", F.round("loss_mean_recent", 9))


@query("history_completeness", f"WITH {HISTORY_SQL}, x AS (SELECT * FROM history WHERE {SOME}), m AS (SELECT variant, max(step) AS top, count(*) AS n FROM x GROUP BY variant), t AS (SELECT variant, loss, row_number() OVER (PARTITION BY variant ORDER BY step DESC) AS k FROM x WHERE loss IS NOT NULL), a AS (SELECT variant, mean_token_accuracy AS c, row_number() OVER (PARTITION BY variant ORDER BY step DESC) AS k FROM x WHERE mean_token_accuracy IS NOT NULL) SELECT 'missing_steps' AS rule, variant AS key, top - n AS detail FROM m WHERE top > n UNION ALL SELECT 'last_step', variant, CAST(top AS BIGINT) FROM m WHERE top <> 2000 UNION ALL SELECT 'saturated_loss', variant, count(*) FROM t WHERE k <= 100 GROUP BY variant HAVING median(loss) < 1e-4 UNION ALL SELECT 'saturated_accuracy', variant, count(*) FROM a WHERE k <= 100 GROUP BY variant HAVING median(c) > 0.999")
def history_completeness(spark, d):
    return timeseries.completeness(history(spark, d), "variant", 2000)


WHOLE_MATRIX_SQL = f"WITH {HISTORY_SQL}, n AS (SELECT max(step) AS top FROM history), w AS (SELECT variant, unnest(range(1, (SELECT top FROM n) + 1)) AS step FROM (SELECT DISTINCT variant FROM history)) SELECT coalesce(w.variant, h.variant) AS variant, CAST(coalesce(w.step, h.step) AS INT) AS step, CASE WHEN h.variant IS NULL THEN 'missing' WHEN h.loss IS NULL THEN 'not_finite' ELSE 'not_positive' END AS rule FROM w FULL JOIN history h ON h.variant = w.variant AND h.step = w.step WHERE h.variant IS NULL OR h.loss IS NULL OR h.loss <= 0"


@query("metric_matrix", WHOLE_MATRIX_SQL)
def metric_matrix(spark, d):
    """Every row; each series is held against the longest."""
    return timeseries.metric_matrix_problems(history(spark, d), ["variant"], None, "loss")


@query("schedule_differences", f"WITH {HISTORY_SQL} SELECT step, CAST(round(max(learning_rate) - min(learning_rate), 12) AS DOUBLE) AS spread FROM history GROUP BY step HAVING max(learning_rate) - min(learning_rate) > 1e-12")
def schedule_differences(spark, d):
    return timeseries.schedule_differences(history(spark, d)).withColumn("spread", F.round("spread", 12))


@query("seed_curves", f"WITH {HISTORY_SQL}, l AS (SELECT variant, step // 100 AS step, unnest(['loss', 'grad_norm']) AS metric, unnest([loss, grad_norm]) AS value FROM history) SELECT variant, step, metric, round(avg(value), 9) AS mean, min(value) AS low, max(value) AS high, count(value) AS n FROM l WHERE value IS NOT NULL GROUP BY ALL")
def seed_curves(spark, d):
    return timeseries.seed_curves(history(spark, d).withColumn("step", F.floor(F.col("step") / 100).cast("int")), ["loss", "grad_norm"])


LINES = "event_type, event_id AS line_no, CASE event_id % 5 WHEN 0 THEN 'BEGIN ' || user_id WHEN 1 THEN 'DONE ' || user_id WHEN 2 THEN 'rate=' || event_id || ' s' WHEN 3 THEN 'FAILED x' ELSE 'noise' END AS text"


@query("last_log_rates", f"WITH l AS (SELECT {LINES} FROM events) SELECT event_type, arg_max(regexp_extract(text, 'rate=(\\d+)', 1), line_no) AS last FROM l WHERE regexp_extract(text, 'rate=(\\d+)', 1) <> '' GROUP BY event_type".replace("\\\\", "\\"))
def last_log_rates(spark, d):
    return timeseries.last_match(table(spark, d, "events").selectExpr(*LINES.split(", CASE")[0].split(", "), "CASE" + LINES.split(", CASE")[1]), r"rate=(\d+)", "event_type")


@query("active_states", f"WITH l AS (SELECT {LINES} FROM events) SELECT event_type, arg_max(split_part(text, ' ', 1), line_no) AS state, arg_max(split_part(text, ' ', 1), line_no) = 'BEGIN' AS active FROM l WHERE split_part(text, ' ', 1) IN ('BEGIN', 'DONE', 'FAILED') GROUP BY event_type")
def active_states(spark, d):
    return timeseries.active_state(table(spark, d, "events").selectExpr(*LINES.split(", CASE")[0].split(", "), "CASE" + LINES.split(", CASE")[1]), "event_type")


@query("compute_ledger", "WITH e AS (SELECT user_id * 100 + event_id % 40 AS id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'all' END AS kind, CASE WHEN event_id % 7 = 0 THEN round(abs(value) * 10) ELSE user_id::DOUBLE END AS s FROM events), g AS (SELECT id, min(kind) AS kind, min(s) AS s, count(*) AS c FROM e GROUP BY id HAVING count(DISTINCT (kind, s)) = 1) SELECT kind, count(*) AS events, CAST(sum(c) - count(*) AS BIGINT) AS duplicates, round(sum(s), 6) AS seconds, round(sum(s) / 3600, 9) AS hours, round(sum(s) / 3600 * 2.78, 6) AS cost FROM g GROUP BY kind")
def compute_ledger(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") * 100 + F.col("event_id") % 40).alias("id"), F.expr("CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'all' END AS kind"), F.expr("CASE WHEN event_id % 7 = 0 THEN round(abs(value) * 10) ELSE CAST(user_id AS DOUBLE) END AS s"))
    return ledger.compute_ledger(e, "id", "kind", "s", 2.78)


@query("event_conflicts", "SELECT user_id * 100 + event_id % 40 AS id, count(DISTINCT event_type) AS versions FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def event_conflicts(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") * 100 + F.col("event_id") % 40).alias("id"), "event_type")
    return ledger.unique_events(e, "id", ["event_type"])[1]


@query("window_ledger", "SELECT event_type, min(ts) AS started, max(ts) AS finished, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 9) AS hours, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 * 2.78, 6) AS cost FROM events GROUP BY event_type")
def window_ledger(spark, d):
    return ledger.window_ledger(table(spark, d, "events"), "event_type", "ts", "ts", 2.78)


WORK = "n_name AS name, 1 + n_nationkey % 5 AS runs, 100 + n_nationkey AS units_per_run, 2.5D AS seconds_per_unit, 0.1D AS fixed_hours_per_run, 1 + n_nationkey % 3 AS parallel_instances, 2.78D AS hourly_rate"
WORK_SQL = "w AS (SELECT " + WORK.replace("2.5D", "2.5::DOUBLE").replace("0.1D", "0.1::DOUBLE").replace("2.78D", "2.78::DOUBLE") + " FROM nation)"


def workloads(spark, d):
    return table(spark, d, "nation").selectExpr(*WORK.split(", "))


@query("budget_workloads", f"WITH {WORK_SQL} SELECT name, round(runs * (units_per_run * seconds_per_unit / 3600 + fixed_hours_per_run), 9) AS gpu_hours, round(runs * (units_per_run * seconds_per_unit / 3600 + fixed_hours_per_run) / parallel_instances, 9) AS wall_hours, round(runs * (units_per_run * seconds_per_unit / 3600 + fixed_hours_per_run) * hourly_rate, 9) AS cost FROM w")
def budget_workloads(spark, d):
    each, _ = ledger.budget(workloads(spark, d), 0.25, 10)
    return each.select("name", *(F.round(c, 9).alias(c) for c in ("gpu_hours", "wall_hours", "cost")))


@query("budget_totals", f"WITH {WORK_SQL}, h AS (SELECT *, runs * (units_per_run * seconds_per_unit / 3600 + fixed_hours_per_run) AS g FROM w) SELECT round(sum(g), 6) AS gpu_hours, round(sum(g / parallel_instances), 6) AS wall_hours, round(sum(g * hourly_rate), 6) AS cost, round(sum(g * hourly_rate) * 1.25, 6) AS with_contingency, CAST(ceil(round(sum(g * hourly_rate) * 1.25, 6) / 10) * 10 AS BIGINT) AS top_up FROM h")
def budget_totals(spark, d):
    return ledger.budget(workloads(spark, d), 0.25, 10)[1]


OVERRIDES = "SELECT n_name AS name, CASE WHEN n_regionkey = 2 THEN NULL ELSE 9 + n_nationkey END AS runs FROM nation WHERE n_name LIKE '%A%' UNION ALL SELECT concat(n_name, '?'), 1 FROM nation"


@query("budget_overrides", f"WITH {WORK_SQL}, o AS ({OVERRIDES}) SELECT w.name, coalesce(o.runs, w.runs) AS runs FROM w LEFT JOIN o ON o.name = w.name")
def budget_overrides(spark, d):
    """Runs of some workloads replaced; a null replaces nothing, and names that no workload has are left out."""
    table(spark, d, "nation").createOrReplaceTempView("larkspur_nation")
    o = spark.sql(OVERRIDES.replace("FROM nation", "FROM larkspur_nation"))
    return ledger.overridden(workloads(spark, d), o, "name", "runs").select("name", "runs")


@query("budget_problems", f"WITH {WORK_SQL} SELECT 'positive_runs' AS rule, name AS key FROM w WHERE runs - 1 <= 0")
def budget_problems(spark, d):
    return ledger.config_problems(workloads(spark, d).withColumn("runs", F.col("runs") - 1))


@query("linear_projection", f"WITH {RESULTS_SQL}, r AS (SELECT run_name, round(sum(batch_wall_seconds) / count(*), 6) AS seconds_per_sample FROM results GROUP BY run_name), p AS (SELECT *, round(120.0 + 4200 * seconds_per_sample * 1.5, 6) AS seconds FROM r) SELECT run_name, seconds_per_sample, seconds, round(seconds / 3600 * 2.78, 6) AS cost, CAST(ceil(round(seconds / 3600 * 2.78, 6) / 10) * 10 AS BIGINT) AS cost_ceiling FROM p")
def linear_projection(spark, d):
    r = results(spark, d).groupBy("run_name").agg(F.round(F.sum("batch_wall_seconds") / F.count(F.lit(1)), 6).alias("seconds_per_sample"))
    return ledger.projection(r, F.lit(4200), F.lit(1.5), 120.0, 2.78)


@query("prompt_length_statistics", "WITH o AS (SELECT lang, n_chars, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, CAST(max(n) AS INT) AS n, max(n_chars) FILTER (k = 0) AS least, max(n_chars) FILTER (k = n // 2) AS median, max(n_chars) FILTER (k = CAST(floor(0.95 * (n - 1)) AS BIGINT)) AS p95, max(n_chars) FILTER (k = n - 1) AS most, max(doc_id) FILTER (k = n - 1) AS longest FROM o GROUP BY lang")
def prompt_length_statistics(spark, d):
    return ledger.order_statistics(table(spark, d, "documents"), "lang", "n_chars", "doc_id")


@query("token_length_totals", "WITH x AS (SELECT source, doc_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS n FROM documents) SELECT source, count(*) AS rows, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(n - n // 2) AS BIGINT) AS completion_tokens, min(n) AS least, max(n) AS most, count(*) FILTER (doc_id % 10 = 0 AND n > 1) AS bad_masks FROM x GROUP BY source")
def token_length_totals(spark, d):
    """Ids and completion masks of every text: the second half is the completion, and every tenth mask is turned round."""
    n = F.size("ids")
    x = table(spark, d, "documents").select("doc_id", "source", F.split("text", " ").alias("ids"))
    head, tail = F.array_repeat(F.lit(0), F.floor(n / 2).cast("int")), F.array_repeat(F.lit(1), (n - F.floor(n / 2)).cast("int"))
    x = x.withColumn("mask", F.when(F.col("doc_id") % 10 == 0, F.concat(tail, head)).otherwise(F.concat(head, tail)))
    return audits.selected_summary(x, ["source"], "ids", "mask")


GATE_ROW = " || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("run_name", "group_id", "position_label", "answer"))
GATE_WORD = "CAST(sum(CAST(CAST('0x' || substr(h, {}, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR)"


@query("gate_metrics", f"WITH {RESULTS_SQL}, x AS (SELECT *, sha256({GATE_ROW}) AS h FROM results) SELECT target_tokens AS cap, count(*) AS n, count(*) FILTER (finish_reason = 'length') AS length_stops, avg(CAST(valid_json AS INT)) AS valid_rate, {GATE_WORD.format(1)} || ':' || {GATE_WORD.format(16)} AS rows_hash FROM x GROUP BY target_tokens")
def gate_metrics(spark, d):
    return cells.gate_metrics(results(spark, d), "target_tokens", ["run_name", "group_id", "position_label", "answer"])


@query("queue_progress", "WITH c AS (SELECT c_nationkey, c_custkey, count(o_orderkey) AS done FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL) SELECT c_nationkey, CAST(sum(least(done, 12)) AS BIGINT) AS done, count(*) * 12 AS expected, round(sum(least(done, 12)) / (count(*) * 12), 9) AS fraction FROM c GROUP BY c_nationkey")
def queue_progress(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("done"))
    c = table(spark, d, "customer").join(o, "c_custkey", "left").select("c_nationkey", F.coalesce("done", F.lit(0)).alias("done"), F.lit(12).cast("bigint").alias("expected"))
    return ledger.progress(c, ["c_nationkey"], "done", "expected")


@query("remaining_estimates", "WITH m AS (SELECT o_orderpriority AS f, median(o_totalprice / 1000) AS r FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1), a AS (SELECT median(o_totalprice / 1000) AS r FROM orders WHERE o_orderpriority <> '5-LOW'), w AS (SELECT o_orderpriority AS f, count(*) AS u FROM orders GROUP BY 1) SELECT w.f AS family, round(sum(u * coalesce(m.r, (SELECT r FROM a)) / 3600), 9) AS hours, round(sum(u * coalesce(m.r, (SELECT r FROM a)) / 3600) * 2.78 * 1.25, 6) AS cost, bool_and(m.r IS NOT NULL) AS calibrated FROM w LEFT JOIN m ON m.f = w.f GROUP BY w.f")
def remaining_estimates(spark, d):
    o = table(spark, d, "orders").withColumn("family", F.col("o_orderpriority"))
    work = o.groupBy("family").agg(F.count(F.lit(1)).alias("units_left"))
    return ledger.remaining(work, o.where("family <> '5-LOW'").withColumn("seconds_per_unit", F.col("o_totalprice") / 1000), "family", 2.78, 0.25)


DAY, CLOCK = "substr(cast(ts AS STRING), 1, 10)", "substr(cast(ts AS STRING), 12, 8)"
STAMP = f"CASE event_id % 5 WHEN 0 THEN concat({DAY}, 'T', {CLOCK}, 'Z') WHEN 1 THEN concat({DAY}, 'T', {CLOCK}, '.25+02:00') WHEN 2 THEN concat({DAY}, 'T', {CLOCK}) WHEN 3 THEN concat('2026-13-01T', {CLOCK}, 'Z') ELSE concat('run-', replace({DAY}, '-', ''), 'T', replace({CLOCK}, ':', ''), 'Z.log') END"


@query("timestamps", f"WITH x AS (SELECT event_id, ts, {STAMP} AS t FROM events) SELECT event_id, CASE WHEN regexp_matches(t, '^[0-9]{{4}}-.*(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') THEN CAST(floor(epoch(TRY_CAST(t AS TIMESTAMPTZ))) AS BIGINT) END AS iso_seconds, CAST(epoch(try_strptime(nullif(regexp_extract(t, '([0-9]{{8}}T[0-9]{{6}})Z', 1), ''), '%Y%m%dT%H%M%S')) AS BIGINT) AS log_seconds, epoch_us(ts) + CAST(1.5 * 3.6e9 AS BIGINT) AS done_micros FROM x")
def timestamps(spark, d):
    x = table(spark, d, "events").selectExpr("event_id", "ts", f"{STAMP} AS t")
    done, _ = ledger.completion(F.col("ts").cast("timestamp"), F.lit(1.5), 0.25)
    return x.select("event_id", F.unix_seconds(ledger.timestamp(F.col("t"))).alias("iso_seconds"), F.unix_seconds(ledger.log_timestamp(F.col("t")).cast("timestamp")).alias("log_seconds"), F.unix_micros(done).alias("done_micros"))


@query("event_ids", "SELECT event_id, sha256(event_type || chr(31) || user_id || chr(31) || props) AS id FROM events")
def event_ids(spark, d):
    return table(spark, d, "events").select("event_id", ledger.event_id(F.col("event_type"), F.col("user_id").cast("string"), F.col("props")).alias("id"))


@query("latest_checkpoints", "SELECT 'run/checkpoint-' || max(event_id) AS path, max(event_id) AS step FROM events")
def latest_checkpoints(spark, d):
    return files.latest_checkpoint(table(spark, d, "events").select(F.concat(F.lit("run/checkpoint-"), F.col("event_id").cast("string")).alias("path")))


@query("table_manifest")
def table_manifest(spark, d):
    """Files of the label table with sizes and hashes, through the reader of binary files."""
    return files.manifest(spark, f"{d}/labels.parquet").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "bytes", "sha256")
