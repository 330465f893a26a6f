"""Queries of nested JSON: forbidden names, flattened reports, catalogs as documents, tampered examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import failures, nested
from .design import FAIL_SQL, ROW_SQL, failing
from .registry import query
from .views import table

#: Names of every kind at some depth, escaped ones, look-alikes in values, and texts that are cut off.
NESTED = r"""'{"rows": [' || props || ', {"note": "say \"target\": x", "' || CASE event_id % 9 WHEN 0 THEN 'prompt' WHEN 1 THEN 'answer' WHEN 2 THEN 'messages' WHEN 3 THEN '\u0070rompt' WHEN 4 THEN 'book\u005fid' WHEN 5 THEN 'sample_id": {"case_id": 1}, "x' WHEN 6 THEN 'Prompt' ELSE 'safe' END || '" : [1, {"k2": "prompt"}, {"' || substr('target_group_id', event_id % 5 + 1, event_id % 12) || '": {}}]}]' || CASE WHEN event_id % 13 = 0 THEN '' ELSE '}' END"""
NAMES = ", ".join(f"'{n}'" for n in failures.FORBIDDEN)


@query("forbidden_keys", f"WITH j AS (SELECT event_id, {NESTED} AS t FROM events) SELECT DISTINCT event_id, key AS name FROM j, json_tree(CASE WHEN json_valid(t) THEN t END) WHERE key IN ({NAMES}) UNION ALL SELECT event_id, NULL FROM j WHERE NOT json_valid(t)")
def forbidden_keys(spark, d):
    """Forbidden names at any depth, once for each text; a text that cannot be read is reported, too."""
    x = table(spark, d, "events").select("event_id", F.expr(NESTED.replace("\\", "\\\\")).alias("json"))
    return nested.forbidden_names(x, "event_id", "json", failures.FORBIDDEN)


#: Seeds 0 to 4 have factorial reports, 5 and 6 transfer reports, 7 another schema and 8 a cut-off text.  Seed 3 lacks profiles, seed 4 repeats them.
REPORT = {
    "head": "CASE WHEN seed < 5 OR seed = 8 THEN '{\"schema_version\": \"matched-factorial-analysis-v1\", \"run_summary_intervals\": {' WHEN seed < 7 THEN '{\"schema_version\": \"natural-transfer-analysis-v1\", \"run_intervals\": {' ELSE '{\"schema_version\": \"v0\", \"runs\": {' END",
    "tail": "CASE WHEN seed = 8 THEN '' WHEN seed IN (3, 5, 6, 7) THEN '}' WHEN seed = 4 THEN ', \"position_profiles\": [' || profile || ', ' || profile || ']}' ELSE ', \"position_profiles\": [' || profile || ']}' END",
    "one": "'\"' || stat || '\": {\"estimate\": ' || CASE WHEN v % 11 = 0 THEN 'null' ELSE CAST(v AS STRING) END || ', \"ci\": [0, {\"estimate\": 1}]}'",
    "profile": "'{\"run_name\": \"' || run || '\", \"task\": \"t\", \"target_tokens\": 8192, \"position_label\": \"' || stat || '\", \"answer_accuracy\": ' || CAST(v AS STRING) || '}'",
    "bare": "'\"' || run || '\": {' || one || '}'",
    "wrapped": "'\"' || run || '\": {\"statistics\": {' || one || '}}'",
    "text": "head || bare || '}, \"contrasts\": {' || CASE WHEN seed < 5 THEN wrapped ELSE bare END || '}' || tail",
}
REPORTS_SQL = f"""v AS (SELECT o_custkey % 9 AS seed, o_orderpriority AS run, o_orderstatus AS stat, CAST(sum(o_orderkey % 1000) AS BIGINT) AS v FROM orders GROUP BY ALL),
 a AS (SELECT seed, run, string_agg({REPORT['one']}, ', ' ORDER BY stat) AS one, string_agg({REPORT['profile']}, ', ' ORDER BY stat) AS profile FROM v GROUP BY seed, run),
 b AS (SELECT seed, string_agg({REPORT['bare']}, ', ' ORDER BY run) AS bare, string_agg({REPORT['wrapped']}, ', ' ORDER BY run) AS wrapped, string_agg(profile, ', ' ORDER BY run) AS profile FROM a GROUP BY seed),
 c AS (SELECT *, {REPORT['head']} AS head, {REPORT['tail']} AS tail FROM b), r AS (SELECT seed, {REPORT['text']} AS t FROM c),
 ok AS (SELECT seed, t, json_extract_string(t, '$.schema_version') AS schema FROM r WHERE json_valid(t)),
 fl AS (SELECT seed, 'factorial' AS kind, 'run:' || x.key AS estimand, y.key AS statistic, CAST(json_extract_string(y.value, '$.estimate') AS DOUBLE) AS value FROM ok, json_each(t, '$.run_summary_intervals') x, json_each(x.value) y WHERE schema = '{nested.FACTORIAL}' AND json_extract_string(y.value, '$.estimate') IS NOT NULL
   UNION ALL SELECT seed, 'factorial', 'contrast:' || x.key, y.key, CAST(json_extract_string(y.value, '$.estimate') AS DOUBLE) FROM ok, json_each(t, '$.contrasts') x, json_each(x.value, '$.statistics') y WHERE schema = '{nested.FACTORIAL}' AND json_extract_string(y.value, '$.estimate') IS NOT NULL
   UNION ALL SELECT seed, 'natural_transfer', 'run:' || y.key, x.key, CAST(json_extract_string(y.value, '$.estimate') AS DOUBLE) FROM ok, json_each(t, '$.run_intervals') x, json_each(x.value) y WHERE schema = '{nested.TRANSFER}'
   UNION ALL SELECT seed, 'natural_transfer', 'contrast:' || y.key, x.key, CAST(json_extract_string(y.value, '$.estimate') AS DOUBLE) FROM ok, json_each(t, '$.contrasts') x, json_each(x.value) y WHERE schema = '{nested.TRANSFER}')"""
PROFILES_SQL = "pp AS (SELECT seed, json_extract_string(x.value, '$.run_name') AS run_name, json_extract_string(x.value, '$.task') AS task, CAST(json_extract_string(x.value, '$.target_tokens') AS BIGINT) AS target_tokens, json_extract_string(x.value, '$.position_label') AS position_label, CAST(json_extract_string(x.value, '$.answer_accuracy') AS DOUBLE) AS answer_accuracy FROM ok, json_each(t, '$.position_profiles') x)"


def reports(spark, d):
    joined = lambda text, order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.expr(text).alias("t")))), lambda x: x["t"]), ", ")
    v = table(spark, d, "orders").groupBy((F.col("o_custkey") % 9).alias("seed"), F.col("o_orderpriority").alias("run"), F.col("o_orderstatus").alias("stat")).agg(F.sum(F.col("o_orderkey") % 1000).alias("v"))
    a = v.groupBy("seed", "run").agg(joined(REPORT["one"], "stat").alias("one"), joined(REPORT["profile"], "stat").alias("profile"))
    b = a.groupBy("seed").agg(joined(REPORT["bare"], "run").alias("bare"), joined(REPORT["wrapped"], "run").alias("wrapped"), joined("profile", "run").alias("profile"))
    return b.withColumns({"head": F.expr(REPORT["head"]), "tail": F.expr(REPORT["tail"])}).select("seed", F.expr(REPORT["text"]).alias("report"))


@query("flattened_estimands", f"WITH {REPORTS_SQL} SELECT seed, kind, estimand, statistic, value FROM fl")
def flattened_estimands(spark, d):
    return nested.flattened_estimands(reports(spark, d), "seed", "report")


@query("report_profiles", f"WITH {REPORTS_SQL}, {PROFILES_SQL} SELECT * FROM pp")
def report_profiles(spark, d):
    return nested.position_profiles(reports(spark, d), "seed", "report")


@query("report_problems", f"""WITH {REPORTS_SQL}, {PROFILES_SQL}, k AS (SELECT DISTINCT seed, kind FROM fl), n AS (SELECT count(*) AS n FROM r), e AS (SELECT estimand, statistic FROM fl, n GROUP BY estimand, statistic, n HAVING count(DISTINCT seed) < n)
 SELECT 'unreadable' AS rule, CAST(seed AS VARCHAR) AS key FROM r WHERE NOT json_valid(t) UNION ALL SELECT 'unsupported_schema', CAST(seed AS VARCHAR) FROM ok WHERE seed NOT IN (SELECT seed FROM k)
 UNION ALL SELECT 'several_kinds', CAST(seed AS VARCHAR) FROM k WHERE kind <> (SELECT min(kind) FROM k) UNION ALL SELECT DISTINCT 'missing_estimand', CAST(k.seed AS VARCHAR) FROM k, e WHERE NOT EXISTS (SELECT 1 FROM fl WHERE fl.seed = k.seed AND fl.estimand = e.estimand AND fl.statistic = e.statistic)
 UNION ALL SELECT DISTINCT 'null_estimate', CAST(seed AS VARCHAR) FROM fl WHERE value IS NULL UNION ALL SELECT DISTINCT 'repeated_profile', CAST(seed AS VARCHAR) FROM pp GROUP BY seed, run_name, task, target_tokens, position_label HAVING count(*) > 1
 UNION ALL SELECT 'no_profile', CAST(seed AS VARCHAR) FROM k WHERE kind = 'factorial' AND seed NOT IN (SELECT seed FROM pp)""")
def report_problems(spark, d):
    return nested.report_problems(reports(spark, d), "seed", "report")


STORED = "CASE WHEN substr({0}, 1, 1) IN ('0', 'a') THEN concat(substr({0}, 1, 63), '-') ELSE {0} END"


@query("tampered_examples", f"WITH {FAIL_SQL}, {ROW_SQL}, x AS (SELECT run_name, category, sha256(to_json(CAST(group_id AS VARCHAR))) AS group_sha256, sha256(to_json(sample_id)) AS sample_sha256 FROM rc), y AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY run_name, group_sha256, sample_sha256) AS rank FROM x), z AS (SELECT category, CASE WHEN rank = 3 THEN 'base_x' ELSE run_name END AS run_name, group_sha256, {STORED.format('sample_sha256')} AS sample_sha256 FROM y WHERE rank <= 25) SELECT category, run_name, group_sha256, sample_sha256 FROM z WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.category = z.category AND x.run_name = z.run_name AND x.group_sha256 = z.group_sha256 AND x.sample_sha256 = z.sample_sha256)")
def tampered_examples(spark, d):
    """Stored examples with changed hashes or runs, found by hashing the source rows again."""
    rows = failing(spark, d)
    stored = failures.examples(failures.catalog(rows).where("scope = 'row'"), 25)
    stored = stored.withColumns({"sample_sha256": F.expr(STORED.format("sample_sha256")), "run_name": F.expr("CASE WHEN rank = 3 THEN 'base_x' ELSE run_name END")}).drop("rank")
    return failures.tampered(stored, rows).select("category", "run_name", "group_sha256", "sample_sha256")
