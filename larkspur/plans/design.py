"""Queries of failures, alignment, selection and assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, design, failures
from ..schemas import GRID, RUNS
from ..sources import files
from .registry import query
from .views import GRID_SQL, RESULTS_SQL, grid, results, table

#: Scored rows on the aligned grid.
FAIL = {
    "run_name": "run_name",
    "group_id": "unit",
    "sample_id": "concat(unit, '@', position_label)",
    "task": "task",
    "target_position": "target_position",
    "valid_json": "score > 0.05",
    "answer_correct": "correct AND score > 0.05",
    "answer": "CASE WHEN score > 0.05 THEN CASE WHEN correct THEN 'right' ELSE concat('wrong', unit % 2) END END",
    "evidence_quotes_applicable": "unit % 5 <> 0",
    "evidence_quotes_correct": "CASE WHEN unit % 7 = 0 THEN NULL ELSE score > 0.4 END",
    "all_predicted_quotes_supported_applicable": "CASE WHEN unit % 3 = 0 THEN NULL ELSE true END",
    "all_predicted_quotes_supported": "score > 0.3",
    "finish_reason": "CASE WHEN score > 0.9 THEN 'length' ELSE 'stop' END",
}
FAIL_SQL = f"{GRID_SQL}, rows_ AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in FAIL.items()) + " FROM grid), fl AS (SELECT run_name, group_id, sample_id, target_position, answer, valid_json, answer_correct, CASE WHEN evidence_quotes_applicable THEN evidence_quotes_correct END AS q, finish_reason FROM rows_)"


def failing(spark, d):
    return grid(spark, d).selectExpr(*(f"{v} AS {k}" for k, v in FAIL.items()))


ROW_SQL = """rc AS (SELECT run_name, group_id, sample_id, unnest(list_filter([CASE WHEN NOT valid_json THEN 'invalid_json' END, CASE WHEN NOT answer_correct THEN 'answer_wrong' END, CASE WHEN answer_correct AND NOT q THEN 'answer_correct_quote_wrong' END, CASE WHEN NOT answer_correct AND q THEN 'answer_wrong_quote_correct' END, CASE WHEN finish_reason = 'length' THEN 'generation_hit_length_cap' END], lambda x: x IS NOT NULL)) AS category FROM fl)"""
GROUP_SQL = """pl AS (SELECT *, row_number() OVER (PARTITION BY run_name, group_id ORDER BY target_position, sample_id) = 1 OR row_number() OVER (PARTITION BY run_name, group_id ORDER BY target_position DESC, sample_id DESC) = 1 AS edge FROM fl),
 gg AS (SELECT run_name, group_id, count(*) AS n, bool_or(edge AND answer_correct) AS eh, bool_or(edge AND NOT answer_correct) AS em, bool_or(NOT edge AND answer_correct) AS mh, bool_or(NOT edge AND NOT answer_correct) AS mm, count(DISTINCT answer) AS a FROM pl GROUP BY ALL),
 gc AS (SELECT run_name, group_id, unnest(list_filter([CASE WHEN eh AND mm THEN 'edge_success_middle_failure' END, CASE WHEN mh AND em THEN 'middle_success_edge_failure' END, CASE WHEN a > 1 THEN 'answer_changes_across_positions' END], lambda x: x IS NOT NULL)) AS category FROM gg WHERE n >= 3)"""
CROSS_SQL = """cc AS (SELECT t.run_name, t.sample_id, t.group_id, unnest(list_filter([CASE WHEN b.answer_correct AND NOT t.answer_correct THEN 'base_only_answer_success' END, CASE WHEN NOT b.answer_correct AND t.answer_correct THEN 'treatment_only_answer_success' END, CASE WHEN NOT b.q AND t.q THEN 'treatment_quote_recovery' END], lambda x: x IS NOT NULL)) AS category FROM fl t JOIN fl b ON b.run_name = 'base' AND t.run_name <> 'base' AND t.sample_id = b.sample_id)"""


@query("row_failures", f"WITH {FAIL_SQL}, {ROW_SQL} SELECT run_name, category, count(*) AS n FROM rc GROUP BY ALL")
def row_failures(spark, d):
    return failures.row_categories(failing(spark, d)).groupBy("run_name", "category").agg(F.count(F.lit(1)).alias("n"))


@query("group_failures", f"WITH {FAIL_SQL}, {GROUP_SQL} SELECT run_name, group_id, category FROM gc")
def group_failures(spark, d):
    return failures.group_categories(failing(spark, d))


@query("cross_run_failures", f"WITH {FAIL_SQL}, {CROSS_SQL} SELECT run_name, category, count(*) AS n, count(DISTINCT group_id) AS groups FROM cc GROUP BY ALL")
def cross_run_failures(spark, d):
    return failures.cross_run_categories(failing(spark, d)).groupBy("run_name", "category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("group_id").alias("groups"))


@query("failure_rates", f"""WITH {FAIL_SQL}, {ROW_SQL}, {GROUP_SQL}, {CROSS_SQL}, al AS (SELECT 'row' AS scope, category FROM rc UNION ALL SELECT 'group', category FROM gc UNION ALL SELECT 'cross_run', category FROM cc),
 de AS (SELECT 'row' AS scope, count(*) AS n FROM rows_ UNION ALL SELECT 'group', count(*) FROM (SELECT run_name, group_id FROM rows_ GROUP BY ALL HAVING count(*) >= 3) UNION ALL SELECT 'cross_run', count(*) FROM rows_ t JOIN rows_ b ON b.run_name = 'base' AND t.run_name <> 'base' AND t.sample_id = b.sample_id)
 SELECT scope, category, count(*) AS count, max(n) AS denominator, count(*) / max(n) AS rate FROM al JOIN de USING (scope) GROUP BY scope, category""")
def failure_rates(spark, d):
    return failures.rates(failing(spark, d))


@query("failure_examples", f"""WITH {FAIL_SQL}, {ROW_SQL}, x AS (SELECT run_name, category, sha256(to_json(CAST(group_id AS VARCHAR))) AS group_sha256, sha256(to_json(sample_id)) AS sample_sha256 FROM rc), y AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY run_name, group_sha256, sample_sha256) AS rank FROM x) SELECT category, rank, run_name, group_sha256, sample_sha256 FROM y WHERE rank <= 25""")
def failure_examples(spark, d):
    c = failures.catalog(failing(spark, d)).where("scope = 'row'")
    return failures.examples(c, 25).select("category", "rank", "run_name", "group_sha256", "sample_sha256")


@query("catalog_audit", f"WITH {FAIL_SQL}, {ROW_SQL}, x AS (SELECT category, count(*) AS n FROM rc GROUP BY category) SELECT category, n, n > 25 AS over_limit FROM x")
def catalog_audit(spark, d):
    """Recount of a catalog against its limit of examples for each category."""
    x = failures.row_categories(failing(spark, d)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return x.withColumn("over_limit", F.col("n") > 25)


@query("repeated_keys", f"WITH {RESULTS_SQL} SELECT run_name, group_id, position_label, count(*) AS n FROM results GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, d):
    return align.repeated(results(spark, d), ["run_name", "group_id", "position_label"])


@query("attached_metadata", "SELECT o_orderkey AS key, CASE WHEN c.c_custkey IS NULL THEN 'missing_in_source' ELSE 'joined' END AS status FROM (SELECT o_orderkey, o_custkey * 2 AS o_custkey FROM orders) o LEFT JOIN customer c ON c.c_custkey = o.o_custkey")
def attached_metadata(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("c_custkey"))
    both, _ = align.attach(o, table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")
    lost = o.join(table(spark, d, "customer"), "c_custkey", "left_anti")
    return both.select(F.col("o_orderkey").alias("key"), F.lit("joined").alias("status")).unionByName(lost.select(F.col("o_orderkey").alias("key"), F.lit("missing_in_source").alias("status")))


@query("metadata_violations", "SELECT 'missing_in_rows' AS rule, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'missing_in_source', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def metadata_violations(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    _, bad = align.attach(o, table(spark, d, "customer").select("c_custkey"), "c_custkey")
    rules = spark.createDataFrame([("missing_in_rows",), ("missing_in_source",)], "rule string")
    return rules.join(bad.groupBy("rule").agg(F.count(F.lit(1)).alias("m")), "rule", "left").select("rule", F.coalesce("m", F.lit(0)).alias("n"))


@query("misaligned_samples", f"WITH {RESULTS_SQL} SELECT group_id, count(DISTINCT run_name) AS runs, count(*) AS n FROM results GROUP BY group_id HAVING count(DISTINCT run_name) <> 7 OR count(*) <> 7")
def misaligned_samples(spark, d):
    return align.misaligned(results(spark, d), "group_id", len(RUNS))


@query("incomplete_groups", f"WITH {RESULTS_SQL} SELECT run_name, group_id, count(DISTINCT position_label) AS labels, count(*) AS n, count(DISTINCT task || filler_type || target_tokens) AS conditions FROM results GROUP BY run_name, group_id HAVING count(DISTINCT position_label) <> 7 OR count(*) <> 7 OR count(DISTINCT task || filler_type || target_tokens) <> 1")
def incomplete_groups(spark, d):
    return align.incomplete_groups(results(spark, d, by_group=True), ["run_name", "group_id"], len(GRID), ["task", "filler_type", "target_tokens"])


@query("run_transitions", f"WITH {GRID_SQL} SELECT a.correct AS before, b.correct AS after, count(*) AS n FROM grid a JOIN grid b ON a.unit = b.unit AND a.position_label = b.position_label AND a.run_name = 'base' AND b.run_name = 'paired_evidence' GROUP BY ALL")
def run_transitions(spark, d):
    g = grid(spark, d).withColumn("sample_id", F.concat_ws("@", "unit", "position_label"))
    return align.transitions(g.where("run_name = 'base'"), g.where("run_name = 'paired_evidence'"), "sample_id", "correct")


@query("run_set_differences", f"WITH {RESULTS_SQL}, w AS (SELECT DISTINCT group_id FROM results WHERE target_tokens = 8192), g AS (SELECT DISTINCT run_name, group_id FROM results), r AS (SELECT DISTINCT run_name FROM results) SELECT run_name, (SELECT count(*) FROM w WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.run_name = r.run_name AND g.group_id = w.group_id)) AS missing, (SELECT count(*) FROM g WHERE g.run_name = r.run_name AND g.group_id NOT IN (SELECT group_id FROM w)) AS extra FROM r")
def run_set_differences(spark, d):
    r = results(spark, d)
    return align.set_differences(r, "group_id", r.where("target_tokens = 8192"))


@query("variant_cell_differences", f"WITH {GRID_SQL}, a AS (SELECT unit, position_label, correct FROM grid WHERE run_name = 'paired_answer'), b AS (SELECT unit, position_label, correct FROM grid WHERE run_name = 'independent_answer') SELECT unit, position_label, CASE WHEN a.correct IS NULL THEN 'only_right' WHEN b.correct IS NULL THEN 'only_left' ELSE 'differs' END AS kind FROM a FULL JOIN b USING (unit, position_label) WHERE a.correct IS DISTINCT FROM b.correct")
def variant_cell_differences(spark, d):
    g = grid(spark, d)
    return align.cell_differences(g.where("run_name = 'paired_answer'"), g.where("run_name = 'independent_answer'"), ["unit", "position_label"], ["correct"])


MECH_COLUMNS = ("run_name", "CAST(unit AS STRING) || CASE WHEN m = 'free' THEN '' ELSE '@diag-' || m END AS group_id", "m AS evaluation_mode", "position_label", "correct AS answer_correct", "score > 0.5 AS evidence_quotes_correct", "score > 0.2 AS all_predicted_quotes_supported")
MECH = "SELECT " + ", ".join(MECH_COLUMNS)
MECH_WHERE = "m IN ('free', 'locate_only') OR position_label = 'p000'"
SQL_MECH = f"""{GRID_SQL}, mr AS ({MECH} FROM grid, (SELECT unnest(['free', 'locate_only', 'oracle_long', 'oracle_short']) AS m) WHERE {MECH_WHERE}),
 f AS (SELECT run_name, group_id, sum(CAST(answer_correct AS INT)) / 7 AS free_answer, sum(CAST(evidence_quotes_correct AS INT)) / 7 AS free_quote, CAST(bool_and(answer_correct) AS INT) AS free_worst_answer FROM mr WHERE evaluation_mode = 'free' GROUP BY ALL HAVING count(*) = 7),
 l AS (SELECT run_name, replace(group_id, '@diag-locate_only', '') AS group_id, sum(CAST(evidence_quotes_correct AS INT)) / 7 AS locate_quote, CAST(bool_and(evidence_quotes_correct) AS INT) AS locate_worst_quote, sum(CAST(all_predicted_quotes_supported AS INT)) / 7 AS locate_supported FROM mr WHERE evaluation_mode = 'locate_only' GROUP BY ALL HAVING count(*) = 7),
 ol AS (SELECT run_name, replace(group_id, '@diag-oracle_long', '') AS group_id, CAST(answer_correct AS INT) AS oracle_long_answer FROM mr WHERE evaluation_mode = 'oracle_long'),
 os AS (SELECT run_name, replace(group_id, '@diag-oracle_short', '') AS group_id, CAST(answer_correct AS INT) AS oracle_short_answer FROM mr WHERE evaluation_mode = 'oracle_short')
 SELECT *, oracle_long_answer - free_answer AS retrieval_recovery, locate_quote - free_quote AS localization_gain, CAST(oracle_short_answer - oracle_long_answer AS INT) AS long_distraction_penalty, CAST(1.0 - oracle_short_answer AS DOUBLE) AS residual_reasoning_error FROM f JOIN l USING (run_name, group_id) JOIN ol USING (run_name, group_id) JOIN os USING (run_name, group_id)"""


@query("mechanism_records", f"WITH {SQL_MECH}")
def mechanism_records(spark, d):
    modes = spark.createDataFrame([(m,) for m in ("free", "locate_only", "oracle_long", "oracle_short")], "m string")
    rows = grid(spark, d).crossJoin(F.broadcast(modes)).where(MECH_WHERE).selectExpr(*MECH_COLUMNS, "unit")
    x = align.with_derived(align.mechanism_records(rows, within="unit"))
    return x.withColumn("residual_reasoning_error", F.col("residual_reasoning_error").cast("double"))


@query("pair_counts", "WITH x AS (SELECT l_partkey AS fact, l_linenumber AS pos, row_number() OVER (ORDER BY l_partkey, l_linenumber, l_orderkey, l_suppkey, l_extendedprice) AS i FROM lineitem), k AS (SELECT fact, pos, count(*) AS k FROM x GROUP BY ALL) SELECT fact, CAST(sum(k) AS BIGINT) AS n, count(*) AS positions, CAST(sum(k) * (sum(k) - 1) / 2 AS BIGINT) AS pairs, CAST(sum(k) * (sum(k) - 1) / 2 - sum(k * (k - 1) / 2) AS BIGINT) AS cross_position_pairs FROM k GROUP BY fact")
def pair_counts(spark, d):
    return align.pair_counts(table(spark, d, "lineitem").select(F.col("l_partkey").alias("fact"), F.col("l_linenumber").alias("pos")), "fact", "pos")


@query("case_weighted_means", f"WITH {RESULTS_SQL}, v AS (SELECT run_name, task, avg(CAST(answer_correct AS INT)) AS rate FROM results GROUP BY ALL), w(task, weight) AS (VALUES ('A', 2), ('N', 6), ('R', 2)) SELECT run_name, CASE WHEN count(rate) = 3 THEN round(sum(weight * rate) / sum(weight), 9) END AS rate FROM v JOIN w USING (task) GROUP BY run_name")
def case_weighted_means(spark, d):
    v = results(spark, d).groupBy("run_name", "task").agg(F.avg(F.col("answer_correct").cast("int")).alias("rate"))
    w = spark.createDataFrame([("A", 2), ("N", 6), ("R", 2)], "task string, weight int")
    return align.weighted_mean(v, w, "task", ["run_name"], "rate")


@query("pending_samples", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def pending_samples(spark, d):
    return align.pending(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("selected_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def selected_rows(spark, d):
    ids = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return files.select_rows(table(spark, d, "orders"), ids, "o_custkey").select("o_orderkey", "o_totalprice")


@query("condition_axes", "SELECT * FROM (SELECT unnest(['kv', 'two_hop']) AS task), (SELECT unnest(['neutral', 'same_format', 'answer_bearing']) AS filler_type), (SELECT unnest([8192, 32768]) AS target_tokens), (SELECT unnest(range(4)) AS replica), (SELECT n_nationkey AS book FROM nation)")
def condition_axes(spark, d):
    a = align.axes(spark, task=["kv", "two_hop"], filler_type=["neutral", "same_format", "answer_bearing"], target_tokens=[8192, 32768], replica=[0, 1, 2, 3])
    return a.crossJoin(F.broadcast(table(spark, d, "nation").select(F.col("n_nationkey").alias("book"))))


@query("in_list_filter", f"WITH {RESULTS_SQL} SELECT run_name, task, count(*) AS n FROM results WHERE task IN ('A', 'N') AND target_tokens IN (8192) AND position_label IN ('p000', 'p050') GROUP BY ALL")
def in_list_filter(spark, d):
    x = design.in_lists(results(spark, d), {"task": ["A", "N"], "target_tokens": [8192], "position_label": ["p000", "p050"], "filler_type": []})
    return x.groupBy("run_name", "task").agg(F.count(F.lit(1)).alias("n"))


@query("run_factors", f"WITH {RESULTS_SQL} SELECT DISTINCT run_name, CASE WHEN run_name <> 'base' THEN split_part(run_name, '_', 1) END AS pairing, CASE WHEN run_name <> 'base' THEN substr(run_name, strpos(run_name, '_') + 1) END AS supervision FROM results")
def run_factors(spark, d):
    return results(spark, d).select("run_name", *design.factors()).distinct()


@query("block_selection", "WITH f AS (SELECT DISTINCT p_brand, p_partkey FROM part), r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('block96:7:' || p_partkey), p_partkey) AS rank FROM f) SELECT * FROM r WHERE rank <= 3")
def block_selection(spark, d):
    return design.block_select(table(spark, d, "part").select("p_brand", "p_partkey").distinct(), ["p_brand"], "p_partkey", 3, 7)


@query("short_strata", "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL HAVING count(*) < 2")
def short_strata(spark, d):
    return design.short_strata(table(spark, d, "part"), ["p_brand", "p_size"], 2)


@query("round_robin_sample", "WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rank FROM customer) SELECT c_custkey, rank FROM r ORDER BY rank, CAST(c_nationkey AS VARCHAR) LIMIT 60")
def round_robin_sample(spark, d):
    return design.round_robin(table(spark, d, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], "c_custkey", 60).select("c_custkey", "rank")


@query("spread_sample", "WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT c_custkey, c_nationkey FROM r WHERE n <= 7 OR k IN (SELECT i * r.n // 7 FROM range(7) t(i))")
def spread_sample(spark, d):
    return design.evenly_spread(table(spark, d, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], "c_custkey", 7)


@query("hash_split", "WITH r AS (SELECT o_orderpriority, o_custkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('split:3:' || o_custkey), o_custkey) AS rank FROM (SELECT DISTINCT o_orderpriority, o_custkey FROM orders)) SELECT o_orderpriority, o_custkey, rank, CASE WHEN rank <= 20 THEN 'paired' ELSE 'independent' END AS kind, CASE WHEN rank > 20 THEN ['p000', 'p050', 'p100'][(rank - 21) % 3 + 1] END AS position_label FROM r WHERE rank <= 50")
def hash_split(spark, d):
    g = table(spark, d, "orders").select("o_orderpriority", "o_custkey").distinct()
    return design.hash_split(g, ["o_orderpriority"], "o_custkey", 20, 30, ["p000", "p050", "p100"], 3)


@query("latin_assignment", """WITH x AS (SELECT l_returnflag, l_linestatus, l_partkey, l_suppkey FROM lineitem GROUP BY ALL), h AS (SELECT *, sha256('7:(''' || l_returnflag || ''', ''' || l_linestatus || '''):' || l_partkey) AS h FROM x),
 r AS (SELECT *, dense_rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY h, l_partkey) - 1 AS f, dense_rank() OVER (PARTITION BY l_returnflag, l_linestatus, l_partkey ORDER BY l_suppkey) - 1 AS k FROM h)
 SELECT l_returnflag, l_linestatus, l_partkey, l_suppkey, ['p000', 'p050', 'p100'][f % 3 + 1] AS independent_position, ['p000', 'p050', 'p100'][k % 3 + 1] AS paired_position FROM r""")
def latin_assignment(spark, d):
    x = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_partkey", "l_suppkey").distinct()
    return design.latin_assignment(x, ["l_returnflag", "l_linestatus"], "l_partkey", "l_suppkey", ["p000", "p050", "p100"], 7)


@query("balanced_quotas", "SELECT n_nationkey, CAST(103 // 25 + CAST(row_number() OVER (ORDER BY n_nationkey) - 1 < 103 % 25 AS INT) AS INT) AS quota FROM nation")
def balanced_quotas(spark, d):
    n = design.ranked(table(spark, d, "nation").withColumn("all_", F.lit(0)), ["all_"], "n_nationkey")
    return n.select("n_nationkey", design.quota(103, 25, F.col("rank") - 1).cast("int").alias("quota"))


@query("chat_rows", "SELECT 'v1:' || doc_id AS id, sha256(text) AS prompt_sha256, 3 AS n_messages, source AS variant_group FROM documents")
def chat_rows(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), F.lit("Answer.").alias("system_prompt"), F.col("text").alias("prompt"), F.col("lang").alias("answer"), F.col("source").alias("group_id"), F.lit("p000").alias("position_label"))
    c = design.to_chat(x, "v1")
    return c.select("id", F.sha2(c["messages"][1]["content"], 256).alias("prompt_sha256"), F.size("messages").alias("n_messages"), F.col("metadata.group_id").alias("variant_group"))


@query("exposure_histogram", "SELECT n AS exposures, count(*) AS facts FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) GROUP BY n")
def exposure_histogram(spark, d):
    return design.exposure_histogram(table(spark, d, "lineitem"), "l_partkey")


@query("exposure_statistics", "WITH g AS (SELECT l_returnflag, l_partkey, count(*) AS n, count(DISTINCT l_linenumber) AS p FROM lineitem GROUP BY ALL) SELECT l_returnflag, count(*) AS facts, count(*) FILTER (n > 1) AS multi, count(*) FILTER (p > 1) AS cross, count(*) FILTER (p >= 4) AS all_positions, max(n) AS max_exposures, min(n) AS min_exposures FROM g GROUP BY l_returnflag")
def exposure_statistics(spark, d):
    return design.exposure_statistics(table(spark, d, "lineitem"), "l_returnflag", "l_partkey", "l_linenumber", 4)


@query("design_summary", "WITH e AS (SELECT l_returnflag, l_partkey, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS t FROM lineitem GROUP BY ALL) SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS rows, count(*) AS facts, min(n) AS min_exposures, max(n) AS max_exposures, CAST(sum(t) AS BIGINT) AS tokens FROM e GROUP BY l_returnflag")
def design_summary(spark, d):
    return design.design_summary(table(spark, d, "lineitem").withColumn("t", F.col("l_quantity").cast("bigint")), "l_returnflag", "l_partkey", "t")


@query("budget_gap", "WITH s AS (SELECT l_returnflag, sum(CAST(l_quantity AS BIGINT)) AS t FROM lineitem GROUP BY ALL) SELECT round((max(t) - min(t)) / greatest(avg(t), 1.0), 9) AS gap, (max(t) - min(t)) / greatest(avg(t), 1.0) <= 0.05 AS within FROM s")
def budget_gap(spark, d):
    return design.budget_gap(table(spark, d, "lineitem").withColumn("t", F.col("l_quantity").cast("bigint")), "l_returnflag", "t", 0.05)


@query("dataset_prefix", "SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 5")
def dataset_prefix(spark, d):
    return design.first_per_dataset(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 5)


@query("choice_prompts", "SELECT printf('%05d', p_partkey) AS id, 'Q ' || p_name || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'C. ' || p_size || chr(10) || 'D. none' AS prompt, ['A', 'B', 'C', 'D'][p_partkey % 4 + 1] AS answer, len(string_split(p_name, ' ')) AS words FROM part")
def choice_prompts(spark, d):
    choices = F.array("p_brand", "p_type", F.col("p_size").cast("string"), F.lit("none"))
    p = table(spark, d, "part")
    out = design.choice_prompts(p.withColumn("words", F.size(F.split("p_name", " ")).cast("bigint")), F.col("p_partkey"), F.concat(F.lit("Q "), "p_name"), choices, F.col("p_partkey") % 4)
    return out.join(p.select(F.format_string("%05d", "p_partkey").alias("id"), F.size(F.split("p_name", " ")).cast("bigint").alias("words")), "id")


@query("instruction_families", "SELECT split_part(i, ':', 1) AS family, count(*) AS n FROM (SELECT unnest([event_type || ':a', props || 'x']) AS i FROM events) GROUP BY 1")
def instruction_families(spark, d):
    x = table(spark, d, "events").select(F.array(F.concat("event_type", F.lit(":a")), F.concat("props", F.lit("x"))).alias("instructions"))
    return design.family_histogram(x, "instructions")


@query("needle_cases", "WITH t AS (SELECT n_nationkey, n_name, unnest(['t0', 't1']) AS test, unnest([['Ann', 'pier'], ['Bob', 'mill']]) AS args FROM nation), q AS (SELECT *, unnest(['onehop', 'twohop']) AS qt, unnest(['Who saw {1}?', 'Who was near {2} and {3}?']) AS question FROM t) SELECT n_nationkey || '_' || test || '_' || qt AS case_id, args[1] || ' went to ' || n_name || ' by ' || args[2] AS needle, replace(replace(question, '{1}', args[1]), '{2}', args[2]) AS question, qt = 'twohop' AS unresolved FROM q")
def needle_cases(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.concat(F.lit("{1} went to "), "n_name", F.lit(" by {2}")).alias("needle"), F.create_map(F.lit("onehop"), F.lit("Who saw {1}?"), F.lit("twohop"), F.lit("Who was near {2} and {3}?")).alias("questions"), F.create_map(F.lit("t0"), F.array(F.lit("Ann"), F.lit("pier")), F.lit("t1"), F.array(F.lit("Bob"), F.lit("mill"))).alias("tests"))
    return design.expand_cases(n)
