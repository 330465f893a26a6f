"""Queries of whole-row scores, sample counts, finished trainings, needle summaries and record fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import audits, needles, scored, timeseries
from .audits import NEEDLES_SQL, made_needles
from .generation import tokens_sql
from .registry import query
from .views import GRID_SQL, HISTORY_SQL, grid, history, table

#: Outputs of every kind: other answers, lost or foreign evidence, texts that are no object, flags that say, leave open or deny.
OUTPUT = {
    "id": "event_id",
    "generated": "CASE event_id % 9 WHEN 0 THEN concat('{\"answer\": \"', event_type, '\", \"evidence_ids\": [\"e1\", \"e2\"], \"evidence_quotes\": [\"', event_type, '\"]}') WHEN 1 THEN concat('{\"answer\": \"', event_type, '\"}') WHEN 2 THEN concat('{\"answer\": \"x\", \"evidence_ids\": [\"e1\"], \"evidence_quotes\": []}') "
    "WHEN 3 THEN concat('[\"', event_type, '\"]') WHEN 4 THEN concat('{\"answer\": \"', event_type, '\"') WHEN 5 THEN concat('{\"answer\": \"The ', upper(event_type), '!\", \"evidence_ids\": [\"e9\"], \"evidence_quotes\": [\"not there\", \"', event_type, '\"]}') ELSE concat('{\"answer\": \"', event_type, '\", \"evidence_ids\": [\"e1\"], \"evidence_quotes\": [\"of ', event_type, '\"]}') END",
    "prompt": "concat('a text of ', event_type, '.')",
    "answer": "event_type",
    "metric": "CASE event_id % 4 WHEN 0 THEN 'normalized_exact' WHEN 1 THEN 'exact' END",
    "ids": "CASE event_id % 5 WHEN 0 THEN 'e1' WHEN 1 THEN 'e1,e2' ELSE '' END",
    "quotes": "CASE event_id % 7 WHEN 0 THEN concat('of ', event_type) WHEN 1 THEN event_type ELSE '' END",
    "id_flag": "CASE event_id % 11 WHEN 0 THEN true WHEN 1 THEN false END",
    "quote_flag": "CASE event_id % 13 WHEN 0 THEN true WHEN 1 THEN false END",
}
LIST = "CASE WHEN {0} = '' THEN []::VARCHAR[] ELSE string_split({0}, ',') END"
PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9_\\s]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("scored_rows", f"""WITH o AS (SELECT {', '.join(f'{v} AS {k}' for k, v in OUTPUT.items())} FROM events), p AS (SELECT *, json_valid(generated) AND json_type(CASE WHEN json_valid(generated) THEN generated END) = 'OBJECT' AS valid_json, {LIST.format('ids')} AS want_ids, {LIST.format('quotes')} AS want_quotes FROM o),
 q AS (SELECT *, CASE WHEN valid_json THEN generated END AS g, coalesce(json_extract_string(g, '$.answer'), '') AS said, coalesce(CAST(json_extract(g, '$.evidence_ids') AS VARCHAR[]), []) AS got_ids, coalesce(CAST(json_extract(g, '$.evidence_quotes') AS VARCHAR[]), []) AS got_quotes, coalesce(id_flag, len(want_ids) > 0) AS on_ids, coalesce(quote_flag, len(want_quotes) > 0) AS on_quotes FROM p),
 s AS (SELECT *, CASE WHEN NOT valid_json THEN 0.0 WHEN coalesce(metric, 'exact') = 'exact' THEN CAST(said = answer AS DOUBLE) ELSE CAST({PLAIN.format('said')} = {PLAIN.format('answer')} AS DOUBLE) END AS answer_score FROM q)
 SELECT id, valid_json, answer_score::DOUBLE AS answer_score, valid_json AND answer_score = 1.0 AS answer_correct, on_ids AS evidence_ids_applicable, CASE WHEN on_ids THEN valid_json AND list_has_all(got_ids, want_ids) END AS evidence_ids_correct, on_quotes AS evidence_quotes_applicable,
 CASE WHEN on_quotes THEN valid_json AND list_has_all(got_quotes, want_quotes) END AS evidence_quotes_correct, CASE WHEN on_quotes THEN valid_json AND len(got_quotes) > 0 AND len(list_filter(got_quotes, lambda x: NOT contains(prompt, x))) = 0 END AS all_predicted_quotes_supported FROM s""")
def scored_rows(spark, d):
    x = table(spark, d, "events").selectExpr(*(f"{v} AS {k}" for k, v in OUTPUT.items()))
    listed = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))
    x = x.select("id", "generated", "prompt", F.array("answer").alias("answers"), F.col("metric").alias("answer_metric"), listed("ids").alias("expected_ids"), listed("quotes").alias("expected_quotes"), F.col("id_flag").alias("evidence_id_applicable"), F.col("quote_flag").alias("evidence_quote_applicable"))
    return scored.score_rows(x).select("id", "valid_json", "answer_score", "answer_correct", "evidence_ids_applicable", "evidence_ids_correct", "evidence_quotes_applicable", "evidence_quotes_correct", "all_predicted_quotes_supported")


@query("sample_counts", f"WITH {GRID_SQL}, x AS (SELECT * FROM grid WHERE run_name = 'base' AND unit % 5 < unit % 7) SELECT 'condition' AS field, task || '|' || filler_type || '|' || target_tokens::INT AS value, count(*) AS rows FROM x GROUP BY 2 UNION ALL SELECT 'position', position_label, count(*) FROM x GROUP BY 2 UNION ALL SELECT 'rows', '*', count(*) FROM x UNION ALL SELECT 'groups', '*', count(DISTINCT unit) FROM x")
def sample_counts(spark, d):
    x = grid(spark, d).where("run_name = 'base' AND unit % 5 < unit % 7").withColumnRenamed("unit", "group_id")
    return audits.sample_counts(x, ["task", "filler_type", "target_tokens"])


@query("replica_histogram", "WITH n AS (SELECT l_partkey, count(DISTINCT l_linenumber) AS replicas FROM lineitem GROUP BY l_partkey) SELECT replicas, count(*) AS facts FROM n GROUP BY replicas")
def replica_histogram(spark, d):
    return audits.replica_histogram(table(spark, d, "lineitem"), "l_partkey", "l_linenumber")


@query("needle_summary", f"WITH {NEEDLES_SQL}, c AS (SELECT target, g, p, {tokens_sql('context')} AS actual, {tokens_sql('substr(context, 1, spot)')} AS before FROM made) SELECT target AS target_tokens, count(*) AS rows, count(DISTINCT g) AS groups, max(actual)::INT AS most_tokens, round(max(abs(before / greatest(actual, 1) - p)), 9) AS position_error FROM c GROUP BY target")
def needle_summary(spark, d):
    return needles.summary(made_needles(spark, d))


#: Trainings on events: some lack a step, some stopped early, some have values that are not finite.
STEPS = 30
RUN = f"history, LATERAL (SELECT (step - 1) // {STEPS} AS run, (step - 1) % {STEPS} + 1 AS s)"
TRAINED = {"loss": "CASE WHEN run % 7 = 3 AND s = 4 THEN CAST('NaN' AS DOUBLE) ELSE coalesce(loss, 0.5) END", "grad_norm": "CASE WHEN s % 6 = 0 THEN NULL ELSE grad_norm END"}


@query("completed_trainings", f"""WITH {HISTORY_SQL}, h AS (SELECT variant, run, s AS step, {TRAINED['loss']} AS loss, {TRAINED['grad_norm']} AS grad_norm, learning_rate, mean_token_accuracy FROM {RUN} WHERE NOT (run % 5 = 2 AND s = 9)),
 c AS (SELECT DISTINCT variant, run, CASE WHEN run % 4 = 1 THEN 29 ELSE {STEPS} END AS global_step, run * 2.5 AS elapsed_seconds FROM h), f AS (SELECT *, row_number() OVER (PARTITION BY variant, run ORDER BY step DESC) AS k FROM h WHERE isfinite(loss)), g AS (SELECT *, row_number() OVER (PARTITION BY variant, run ORDER BY step DESC) AS k FROM h WHERE isfinite(grad_norm)),
 a AS (SELECT variant, run, arg_max(mean_token_accuracy, step) AS final_accuracy, median(mean_token_accuracy) AS median_accuracy FROM h WHERE isfinite(mean_token_accuracy) GROUP BY ALL),
 l AS (SELECT variant, run, arg_min(loss, step) AS first_loss, arg_max(loss, step) AS final_loss, median(loss) AS median_loss, median(loss) FILTER (k <= 20) AS median_loss_recent FROM f GROUP BY ALL), m AS (SELECT variant, run, median(grad_norm) AS median_grad_recent FROM g WHERE k <= 20 GROUP BY ALL),
 e AS (SELECT variant, run, count(*) AS metric_rows, arg_max_null(learning_rate, step) AS final_learning_rate, bool_and(isfinite(loss) AND coalesce(isfinite(learning_rate), true) AND coalesce(isfinite(grad_norm), true)) AS all_finite FROM h GROUP BY ALL HAVING count(DISTINCT step) = {STEPS} AND min(step) = 1 AND max(step) = {STEPS})
 SELECT variant, run, elapsed_seconds::DOUBLE AS elapsed_seconds, metric_rows, first_loss, final_loss, median_loss, median_loss_recent, final_accuracy, median_accuracy, final_learning_rate, median_grad_recent, all_finite, coalesce(median_loss < 1e-4 AND median_accuracy > 0.999, false) AS saturated
 FROM c JOIN e USING (variant, run) JOIN l USING (variant, run) LEFT JOIN a USING (variant, run) LEFT JOIN m USING (variant, run) WHERE global_step = {STEPS}""")
def completed_trainings(spark, d):
    h = history(spark, d).selectExpr("*", f"CAST(floor((step - 1) / {STEPS}) AS INT) AS run", f"(step - 1) % {STEPS} + 1 AS s").where("NOT (run % 5 = 2 AND s = 9)")
    h = h.selectExpr("variant", "run", "s AS step", *(f"{v} AS {k}" for k, v in TRAINED.items()), "learning_rate", "mean_token_accuracy")
    done = h.select("variant", "run").distinct().selectExpr("*", f"CASE WHEN run % 4 = 1 THEN 29 ELSE {STEPS} END AS global_step", "CAST(run * 2.5 AS DOUBLE) AS elapsed_seconds")
    return timeseries.completed_training(h, done, ["variant", "run"], STEPS).drop("global_step")


@query("record_fingerprints", "SELECT c_custkey, sha256('{' || '\"c_acctbal\":' || CASE WHEN c_acctbal IS NULL THEN 'null' ELSE CAST(c_acctbal AS VARCHAR) END || ',\"c_name\":' || to_json(c_name) || ',\"c_nationkey\":' || c_nationkey || ',\"more\":{\"flag\":' || (c_custkey % 2 = 0) || ',\"names\":[' || to_json(c_name) || ',null]}}') AS record_sha256 FROM customer")
def record_fingerprints(spark, d):
    x = table(spark, d, "customer").selectExpr("c_custkey", "c_name", "c_nationkey", "c_acctbal", "named_struct('names', array(c_name, NULL), 'flag', c_custkey % 2 = 0) AS more")
    return x.select("c_custkey", hashing.record_fingerprint(x, ["c_name", "c_nationkey", "c_acctbal", "more"]).alias("record_sha256"))
