"""Queries of audits, arguments, joins with checks and needles."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import arguments, text
from ..operators import align, audits, design, failures, generate, ledger, needles
from ..schemas import RUNS
from .design import CROSS_SQL, FAIL_SQL, GROUP_SQL, ROW_SQL, failing
from .generation import fitted_sql, tokens_sql
from .registry import query
from .scoring import TOKEN_SQL
from .views import GRID_SQL, grid, table


def some(*rules: tuple[str, str]) -> str:
    """Names of the rules whose condition is not true, as rows."""
    return "unnest(list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in rules) + "], lambda x: x IS NOT NULL)) AS rule"


LISTS = "CASE o_orderkey % 7 WHEN 0 THEN '8K, 32k' WHEN 1 THEN '1_024,2048,' WHEN 2 THEN ' , ' WHEN 3 THEN '4k,x' WHEN 4 THEN '0,5' WHEN 5 THEN '-2K' ELSE '16' END"
SHARES = "CASE o_orderkey % 5 WHEN 0 THEN '0,25,50,100' WHEN 1 THEN '0.5, 50' WHEN 2 THEN '1,0.1' WHEN 3 THEN '120,x' ELSE '' END"
ITEMS_SQL = "list_filter(list_transform(string_split({}, ','), lambda x: trim(x)), lambda x: x <> '')"
LENGTH_SQL = "list_transform(i, lambda x: CASE WHEN coalesce(TRY_CAST(replace(regexp_replace(lower(x), 'k$', ''), '_', '') AS BIGINT), 0) * CASE WHEN ends_with(lower(x), 'k') THEN 1024 ELSE 1 END > 0 THEN TRY_CAST(replace(regexp_replace(lower(x), 'k$', ''), '_', '') AS BIGINT) * CASE WHEN ends_with(lower(x), 'k') THEN 1024 ELSE 1 END END)"
SHARE_SQL = "list_transform(i, lambda x: CASE WHEN TRY_CAST(x AS DOUBLE) > 1 AND TRY_CAST(x AS DOUBLE) <= 100 THEN TRY_CAST(x AS DOUBLE) / 100 WHEN TRY_CAST(x AS DOUBLE) BETWEEN 0 AND 1 THEN TRY_CAST(x AS DOUBLE) END)"


@query("token_length_lists", f"WITH a AS (SELECT o_orderkey, {ITEMS_SQL.format(LISTS)} AS i FROM orders) SELECT o_orderkey, array_to_string(list_transform({LENGTH_SQL}, lambda x: coalesce(CAST(x AS VARCHAR), '-')), '|') AS lengths FROM a")
def token_length_lists(spark, d):
    x = table(spark, d, "orders").selectExpr("o_orderkey", f"{LISTS} AS t")
    return x.select("o_orderkey", F.array_join(F.transform(arguments.listed(F.col("t")), arguments.token_length), "|", "-").alias("lengths"))


@query("position_list_problems", f"WITH a AS (SELECT o_orderkey, {ITEMS_SQL.format(SHARES)} AS i FROM orders), v AS (SELECT o_orderkey, {SHARE_SQL} AS p FROM a) SELECT {some(('not_empty', 'len(p) > 0'), ('valid_items', 'len(list_filter(p, lambda x: x IS NULL)) = 0'), ('unique_items', 'len(list_distinct(p)) = len(list_filter(p, lambda x: x IS NOT NULL))'))}, CAST(o_orderkey AS VARCHAR) AS key FROM v")
def position_list_problems(spark, d):
    x = table(spark, d, "orders").selectExpr("o_orderkey", f"{SHARES} AS t")
    return arguments.list_problems(x, "o_orderkey", "t", arguments.position, unique=True)


CASE_ID = "CASE WHEN o_orderkey % 10 = 0 THEN '  ' WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN concat(' ', o_orderstatus, ' ') ELSE substr(o_orderpriority, 8, o_orderkey % 4) END"


@query("blank_bootstrap_keys", f"SELECT 'key_present' AS rule, CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE coalesce(trim({CASE_ID}), '') = ''")
def blank_bootstrap_keys(spark, d):
    x = table(spark, d, "orders").selectExpr("o_orderkey", f"named_struct('case_id', {CASE_ID}) AS metadata")
    return arguments.blank_keys(x, "o_orderkey", "metadata.case_id")


STORED_SQL = f"""{FAIL_SQL}, {ROW_SQL}, {GROUP_SQL}, {CROSS_SQL}, al AS (SELECT 'row' AS scope, category FROM rc UNION ALL SELECT 'group', category FROM gc UNION ALL SELECT 'cross_run', category FROM cc), ct AS (SELECT scope, category, count(*) AS count FROM al GROUP BY ALL)"""


#: What a stored catalog says of each category, from the right count n, rate r and scope.
TOLD = {
    "scope": "CASE WHEN category = 'treatment_quote_recovery' THEN 'row' ELSE scope END",
    "count": "CASE WHEN category = 'answer_wrong' THEN count + 1 ELSE count END",
    "rate": "CASE WHEN category LIKE '%quote%' THEN rate + 1e-10 ELSE rate END",
    "listed": "CASE WHEN category = 'generation_hit_length_cap' THEN 26 ELSE least(25, count + CASE WHEN category = 'middle_success_edge_failure' THEN 30 ELSE 0 END) END",
}
STORED_RULES = (("in_both", "paired"), ("same_scope", "NOT paired OR s.scope = ct.scope"), ("same_count", "NOT paired OR s.count = ct.count"), ("same_rate", "NOT paired OR abs(s.rate - ct.rate) <= 1e-12"), ("within_limit", "NOT paired OR s.listed <= least(25, ct.count)"))


@query("stored_catalog_audit", f"""WITH {STORED_SQL.replace("count(*) AS count FROM al GROUP BY ALL)", "count(*) AS n FROM al GROUP BY ALL)")}, dn AS (SELECT 'row' AS scope, (SELECT count(*) FROM fl) AS denominator UNION ALL SELECT 'group', (SELECT count(*) FROM (SELECT 1 FROM fl GROUP BY run_name, group_id HAVING count(*) >= 3)) UNION ALL SELECT 'cross_run', (SELECT count(*) FROM fl t JOIN fl b ON b.run_name = 'base' AND t.run_name <> 'base' AND t.sample_id = b.sample_id)),
 fresh AS (SELECT category, scope, n AS count, n / denominator AS rate FROM ct JOIN dn USING (scope)), s AS (SELECT category, {', '.join(f'{v} AS {k}' for k, v in TOLD.items())} FROM fresh WHERE category <> 'invalid_json' UNION ALL SELECT 'made_up', 'row', 1, 0.5, 1),
 x AS (SELECT coalesce(s.category, ct.category) AS key, s.count IS NOT NULL AND ct.count IS NOT NULL AS paired, {', '.join(f"{c} AS {n}" for n, c in STORED_RULES[1:]).replace("NOT paired", "s.count IS NULL OR ct.count IS NULL")} FROM s FULL JOIN fresh ct USING (category)) SELECT {some(("in_both", "paired"), *((n, n) for n, _ in STORED_RULES[1:]))}, key FROM x""")
def stored_catalog_audit(spark, d):
    """A stored catalog with wrong counts, rates and a scope, a lost category, a foreign one and too many examples."""
    rows = failing(spark, d)
    stored = failures.rates(rows).where("category <> 'invalid_json'").selectExpr("category", *(f"{v} AS {k}" for k, v in TOLD.items()))
    foreign = spark.createDataFrame([("made_up", "row", 1, 0.5, 1)], "category string, scope string, count bigint, rate double, listed bigint")
    return failures.catalog_problems(stored.withColumn("listed", F.col("listed").cast("bigint")).unionByName(foreign), rows, 25)


SOURCE_SQL = "s AS (SELECT c_custkey AS k, c_name AS m FROM customer UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 50 = 0), r AS (SELECT o_orderkey, o_custkey + CASE WHEN o_orderkey % 100 = 1 THEN 1000000 ELSE 0 END AS k, CASE WHEN o_orderkey % 40 = 2 THEN 'other' END AS m FROM orders)"


@query("source_conflicts", f"WITH {SOURCE_SQL} SELECT 'missing_in_source' AS rule, CAST(k AS VARCHAR) AS key FROM r WHERE k NOT IN (SELECT k FROM s) UNION ALL SELECT 'missing_in_rows', CAST(k AS VARCHAR) FROM s WHERE k NOT IN (SELECT k FROM r) UNION ALL SELECT 'repeated_in_source', CAST(k AS VARCHAR) FROM s GROUP BY k HAVING count(*) > 1 UNION ALL SELECT 'conflict', CAST(r.k AS VARCHAR) FROM r WHERE m IS NOT NULL AND k IN (SELECT k FROM s GROUP BY k HAVING count(*) = 1)")
def source_conflicts(spark, d):
    """Metadata of customers on their orders: ids that are missing, repeated or in conflict."""
    c = table(spark, d, "customer").selectExpr("c_custkey AS k", "c_name AS m")
    o = table(spark, d, "orders").selectExpr("o_custkey + CASE WHEN o_orderkey % 100 = 1 THEN 1000000 ELSE 0 END AS k", "CASE WHEN o_orderkey % 40 = 2 THEN 'other' END AS m")
    return align.attach(o, c.unionByName(c.where("k % 50 = 0")), "k", "m")[1]


@query("looked_up_names", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2")
def looked_up_names(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("c_custkey"))
    return align.look_up(o, table(spark, d, "customer"), "c_custkey", ["c_name"]).select("o_orderkey", "c_name")


MODE = "CASE p_partkey % 4 WHEN 0 THEN 'answer' WHEN 1 THEN 'evidence_id' WHEN 2 THEN 'evidence' ELSE 'unknown' END"


SFT_SQL = f"""p AS (SELECT p_partkey AS k, {MODE} AS mode, p_name AS answer FROM part), q AS (SELECT *, CASE WHEN k % 7 = 0 THEN CASE WHEN mode = 'answer' THEN 'evidence' ELSE 'answer' END ELSE mode END AS shown FROM p),
 r AS (SELECT *, (CASE WHEN k % 5 = 0 THEN '{{"extra": 1, ' ELSE '{{' END) || '"answer": ' || to_json(answer) || ', "confidence": 1.0, "evidence_ids": ' || CASE WHEN shown IN ('evidence_id', 'evidence') THEN '["e1"]' ELSE '[]' END || ', "evidence_quotes": ' || CASE WHEN shown = 'evidence' THEN '["a quote"]' ELSE '[]' END || '}}' AS body,
   CASE WHEN k % 13 = 0 THEN ['user', 'system', 'assistant'] ELSE ['system', 'user', 'assistant'] END AS roles FROM q),
 t AS (SELECT *, json_valid(body) AND list_sort(json_keys(body)) = ['answer', 'confidence', 'evidence_ids', 'evidence_quotes'] AS exact, json_array_length(body, '$.evidence_ids') > 0 AS ids, json_array_length(body, '$.evidence_quotes') > 0 AS quotes FROM r)"""


@query("sft_audit", f"WITH {SFT_SQL} SELECT {some(('roles', "roles = ['system', 'user', 'assistant']"), ('payload', 'exact'), ('supervision', "NOT exact OR (mode = 'answer' AND NOT ids AND NOT quotes) OR (mode = 'evidence_id' AND ids AND NOT quotes) OR (mode = 'evidence' AND ids AND quotes)"))}, CAST(k AS VARCHAR) AS key FROM t")
def sft_audit(spark, d):
    """Training rows with foreign roles, an extra field, an unknown mode, and evidence that a mode does not give."""
    x = table(spark, d, "part").selectExpr("p_partkey", f"{MODE} AS mode", "p_name AS answer")
    k = F.col("p_partkey")
    shown = F.when(k % 7 == 0, F.when(F.col("mode") == "answer", "evidence").otherwise("answer")).otherwise(F.col("mode"))
    body = text.assistant_payload(shown, F.col("answer"), F.array(F.lit("e1")), F.array(F.lit("a quote")))
    body = F.when(k % 5 == 0, F.concat(F.lit('{"extra": 1, '), F.substring(body, F.lit(2), F.length(body)))).otherwise(body)
    m = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    usual = F.array(m("system", F.lit("s")), m("user", F.lit("u")), m("assistant", body))
    rows = x.select("p_partkey", "mode", F.when(k % 13 == 0, F.array(m("user", F.lit("u")), m("system", F.lit("s")), m("assistant", body))).otherwise(usual).alias("messages"))
    return audits.chat_rows(rows, "p_partkey", F.col("mode"))


SUBSET_SQL = f"{GRID_SQL}, x AS (SELECT split_part(run_name, '_', 1) AS pairing, substr(run_name, strpos(run_name, '_') + 1) AS supervision, unit, position_label, CASE WHEN unit % 50 = 0 THEN run_name ELSE 'h' || unit END AS prompt_hash, 100 + unit % 7 + CASE WHEN run_name = 'paired_evidence' THEN 9 ELSE 0 END AS tokens FROM grid WHERE run_name <> 'base' AND NOT (run_name = 'paired_answer' AND unit % 40 = 0 AND position_label = 'p050'))"


def subset(spark, d):
    g = grid(spark, d).where("run_name <> 'base' AND NOT (run_name = 'paired_answer' AND unit % 40 = 0 AND position_label = 'p050')")
    return g.select(*design.factors(), "unit", "position_label", F.expr("CASE WHEN unit % 50 = 0 THEN run_name ELSE concat('h', unit) END AS prompt_hash"), F.expr("100 + unit % 7 + CASE WHEN run_name = 'paired_evidence' THEN 9 ELSE 0 END AS tokens"))


@query("sibling_audit", f"WITH {SUBSET_SQL}, g AS (SELECT pairing || '/' || unit || '/' || position_label AS key, count(*) AS n, count(DISTINCT supervision) AS m, count(DISTINCT prompt_hash) AS p FROM x GROUP BY ALL) SELECT {some(('every_mode_once', 'n = 3 AND m = 3'), ('same_prompt_hash', 'p = 1'))}, key FROM g")
def sibling_audit(spark, d):
    """Rows that should differ in supervision only, some with other prompts and some lacking a mode."""
    return audits.siblings(subset(spark, d), ["pairing", "unit", "position_label"], ["prompt_hash"], 3)


@query("pairing_comparison", f"WITH {SUBSET_SQL}, c AS (SELECT supervision, unit, position_label, count(*) FILTER (pairing = 'paired') AS p, count(*) FILTER (pairing = 'independent') AS i, coalesce(sum(tokens) FILTER (pairing = 'paired'), 0) AS pt, coalesce(sum(tokens) FILTER (pairing = 'independent'), 0) AS it FROM x GROUP BY ALL), f AS (SELECT supervision, unit, sum(p) AS p, sum(i) AS i, sum(pt) AS pt, sum(it) AS it FROM c GROUP BY ALL), l AS (SELECT supervision, bool_and(p = i) AS same_positions FROM (SELECT supervision, position_label, sum(p) AS p, sum(i) AS i FROM c GROUP BY ALL) GROUP BY supervision), s AS (SELECT supervision, bool_and((p > 0) = (i > 0)) AS same_facts, bool_and(p = i) AS same_exposures, round(abs(sum(pt) - sum(it)) / greatest((sum(pt) + sum(it)) / 2, 1.0), 9) AS token_gap FROM f GROUP BY supervision) SELECT *, same_facts AND same_exposures AND same_positions AND token_gap <= 0.02 AS strict FROM s JOIN l USING (supervision)")
def pairing_comparison(spark, d):
    return audits.pairing_comparison(subset(spark, d), "unit", "position_label", "tokens")


CELLS_SQL = "x AS (SELECT 'f' || l_partkey AS fact, l_linenumber AS replica, v AS variant, CASE WHEN l_partkey % 20 = 0 THEN v ELSE 'same' END AS filler, CAST(l_quantity AS BIGINT) + CASE WHEN v = 'b' THEN 3 ELSE 0 END AS tokens FROM lineitem, (SELECT unnest(['a', 'b', 'c']) AS v) WHERE NOT (v = 'c' AND l_partkey % 30 = 0))"


@query("matched_cell_audit", f"WITH {CELLS_SQL}, g AS (SELECT fact || '/' || replica AS key, count(DISTINCT variant) AS v, count(DISTINCT filler) AS f FROM x GROUP BY ALL), t AS (SELECT (max(t) - min(t)) / greatest(avg(t), 1.0) AS gap FROM (SELECT sum(tokens) AS t FROM x GROUP BY variant)) SELECT {some(('every_variant', 'v = 3'), ('same_fillers', 'f = 1'))}, key FROM g UNION ALL SELECT 'token_gap', '*' FROM t WHERE gap > 0.02")
def matched_cell_audit(spark, d):
    v = F.explode(F.array(*map(F.lit, "abc")))
    x = table(spark, d, "lineitem").select(F.concat(F.lit("f"), "l_partkey").alias("fact"), F.col("l_linenumber").alias("replica"), "l_partkey", "l_quantity", v.alias("variant")).where("NOT (variant = 'c' AND l_partkey % 30 = 0)")
    x = x.selectExpr("fact", "replica", "variant", "CASE WHEN l_partkey % 20 = 0 THEN variant ELSE 'same' END AS filler", "CAST(l_quantity AS BIGINT) + CASE WHEN variant = 'b' THEN 3 ELSE 0 END AS tokens")
    return audits.matched_cells(x, "fact", 3, "tokens", "filler", 0.02)


CAP_SQL = f"{GRID_SQL}, x AS (SELECT task, unit, run_name, position_label, cap, CASE WHEN unit % 25 = 0 THEN 'other' || cap ELSE 's' || unit END AS sample FROM grid, (SELECT unnest([128, 256]) AS cap) WHERE NOT (cap = 256 AND unit % 35 = 0 AND run_name < 'p') UNION ALL SELECT task, unit, run_name, position_label, 128, 's' || unit FROM grid WHERE unit % 45 = 0 AND position_label = 'p100')"


@query("cap_audit", f"WITH {CAP_SQL}, g AS (SELECT task || '/' || unit || '/' || run_name || '/' || position_label AS key, count(*) AS n, count(DISTINCT cap) AS c, count(DISTINCT sample) AS s FROM x GROUP BY ALL) SELECT {some(('one_row_a_cap', 'n = 2 AND c = 2'), ('one_sample', 's = 1'))}, key FROM g")
def cap_audit(spark, d):
    """Two output caps over all cells, some with another sample, a missing row or a row too many."""
    g = grid(spark, d).select("task", "unit", "run_name", "position_label")
    # A cap of 0 stands for the row too many, which is made in place: a union would read the cells twice and lose how they are dealt out.
    more = F.array_compact(F.array(F.lit(128), F.expr("CASE WHEN NOT (unit % 35 = 0 AND run_name < 'p') THEN 256 END"), F.expr("CASE WHEN unit % 45 = 0 AND position_label = 'p100' THEN 0 END")))
    x = g.withColumn("c", F.explode(more)).withColumn("cap", F.expr("CASE WHEN c = 0 THEN 128 ELSE c END"))
    x = x.withColumn("sample", F.expr("CASE WHEN c <> 0 AND unit % 25 = 0 THEN concat('other', cap) ELSE concat('s', unit) END")).drop("c")
    return audits.balanced_prefix(x, ["task", "unit", "run_name", "position_label"], "cap", "sample")


#: Renderings: the length of the whole, a prompt that may be no prefix of it, and sentinels that may be lost.
RENDERED = {
    "native": ("transform(sequence(1, 4 + p_partkey % 3), i -> i * (p_partkey % 5))", "CASE WHEN p_partkey % 3 = 0 THEN array(9, 2) ELSE transform(sequence(1, 2), i -> i * (p_partkey % 5)) END", "CASE WHEN p_partkey % 7 = 0 THEN 'USR' ELSE 'SYS USR' END"),
    "merge_system": ("transform(sequence(1, 3), i -> i)", "transform(sequence(1, 1 + p_partkey % 4), i -> i)", "CASE WHEN p_partkey % 2 = 0 THEN 'USR' ELSE 'SYS USR' END"),
}


def rendered_sql(protocol: str) -> str:
    whole, prompt, shown = (re.sub(r"transform\(sequence\(1, ([^()]*(?:\([^()]*\))?)\), i -> ", r"list_transform(range(1, \1 + 1), lambda i: ", t).replace("array(9, 2)", "[9, 2]::BIGINT[]") for t in RENDERED[protocol])
    return f"SELECT p_partkey AS k, '{protocol}' AS protocol, {whole} AS whole, {prompt} AS prompt, {shown} AS shown FROM part"


@query("protocol_audit", f"""WITH r AS ({rendered_sql('native')} UNION ALL {rendered_sql('merge_system')}), o AS (SELECT k, protocol, len(whole) - len(prompt) AS more, len(prompt) <= len(whole) AND whole[1:len(prompt)] = prompt AND contains(shown, 'SYS') AND contains(shown, 'USR') AS ok FROM r),
 g AS (SELECT k, bool_or(ok AND protocol = 'native') AS native, bool_or(ok AND protocol = 'merge_system') AS merged, max(more) FILTER (ok AND protocol = 'native') AS n1, max(more) FILTER (ok AND protocol = 'merge_system') AS n2 FROM o GROUP BY k)
 SELECT 't' || k AS tokenizer, CASE WHEN native OR merged THEN 'passed' ELSE 'failed' END AS status, CASE WHEN native THEN 'native' WHEN merged THEN 'merge_system' END AS selected_protocol, CASE WHEN native THEN 'passed' ELSE 'failed' END AS native_status, CAST(CASE WHEN native THEN n1 ELSE n2 END AS INT) AS completion_tokens FROM g""")
def protocol_audit(spark, d):
    """Renderings by two protocols, with prompts that are no prefix and sentinels that are lost."""
    p, out = table(spark, d, "part"), None
    for protocol, (whole, prompt, shown) in RENDERED.items():
        x = p.selectExpr("concat('t', p_partkey) AS tokenizer", f"'{protocol}' AS protocol", f"cast({whole} AS array<bigint>) AS full_ids", f"cast({prompt} AS array<bigint>) AS prompt_ids", f"{shown} AS text", "array('SYS', 'USR') AS sentinels")
        out = x if out is None else out.unionByName(x)
    return audits.chat_protocol(out)


@query("token_counters", f"SELECT doc_id, CAST(len(regexp_extract_all(text, {TOKEN_SQL})) AS INT) AS words_and_marks, CAST(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS INT) AS blanks, CAST(ceil(length(text) / 4) AS INT) AS quarter_characters FROM documents".replace("\\\\", "\\"))
def token_counters(spark, d):
    return table(spark, d, "documents").select("doc_id", *(text.count_tokens(n, F.col("text")).alias(n) for n in ("words_and_marks", "blanks", "quarter_characters")))


CASES = (("c1", "A zebra was seen at the Old Quay by Quillan.", "Quillan", "Who saw the zebra?"), ("c2", "Marvolina left the Old Quay before noon.", "Marvolina", "Who left before noon?"))
LENGTHS = (96, 256, 1024)
PLACES = (0.0, 0.25, 0.5, 1.0)


def made_needles(spark, d):
    """Needle rows of every text; those that do not come down to a length have none of it."""
    books = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("book"), "text")
    return needles.needle_rows(books, spark.createDataFrame(list(CASES), "case_id string, needle string, answer string, question string"), list(LENGTHS), list(PLACES))


def needles_sql() -> str:
    """The same rows: fitted texts, insertion by the nearest newline, and what is counted of them."""
    fitted = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS case_id, '{needle}' AS needle, '{answer}' AS answer, {n} AS target, fitted FROM ({fitted_sql(n - needles.ROOM, needle)}) WHERE fits" for c, needle, answer, _ in CASES for n in LENGTHS)
    return f"""f AS ({fitted}), i AS (SELECT *, doc_id || '-' || case_id || '-' || target AS g, sha256(fitted) AS base, unnest([{', '.join(map(str, PLACES))}]::DOUBLE[]) AS p FROM f), m AS (SELECT *, CAST(round_even(length(fitted) * p, 0) AS INT) AS t FROM i),
 n AS (SELECT *, CASE WHEN strpos(substr(fitted, 1, t + 1), chr(10)) > 0 THEN length(substr(fitted, 1, t + 1)) - strpos(reverse(substr(fitted, 1, t + 1)), chr(10)) ELSE -1 END AS pr, CASE WHEN strpos(substr(fitted, t + 1), chr(10)) > 0 THEN t + strpos(substr(fitted, t + 1), chr(10)) - 1 ELSE -1 END AS fo FROM m),
 o AS (SELECT *, CAST(CASE WHEN p <= 0 THEN 0 WHEN p >= 1 THEN length(fitted) WHEN pr >= 0 AND fo >= 0 THEN CASE WHEN t - pr <= fo - t THEN pr ELSE fo END WHEN pr >= 0 THEN pr WHEN fo >= 0 THEN fo ELSE t END AS INT) AS spot FROM n),
 made AS (SELECT *, CASE p WHEN 0 THEN 'p000' WHEN 0.25 THEN 'p025' WHEN 0.5 THEN 'p050' ELSE 'p100' END AS label, substr(fitted, 1, spot) || chr(10) || needle || chr(10) || substr(fitted, spot + 1) AS context FROM o)"""


NEEDLES_SQL = needles_sql()
#: Rules of one row and of a group, as conditions over what is counted.
ROW_RULES = (("fits", "actual <= target"), ("little_slack", "target - actual <= 192"), ("needle_present", "contains(context, needle)"), ("answer_once", "len(string_split(context, answer)) = 2"))
GROUP_RULES = (("every_position", f"p = {len(PLACES)}"), ("one_target", "a = 1"), ("one_base", "b = 1"))


def needle_rules_sql(rows: str) -> str:
    return f"""c AS (SELECT *, {tokens_sql('context')} AS actual, g || '@' || label AS id FROM {rows}), q AS (SELECT g, count(DISTINCT label) AS p, count(DISTINCT answer || needle) AS a, count(DISTINCT base) AS b FROM c GROUP BY g), w AS (SELECT id, count(*) AS n FROM c GROUP BY id)
 SELECT {some(*ROW_RULES)}, id AS key FROM c UNION ALL SELECT {some(('unique_id', 'n = 1'))}, id FROM w UNION ALL SELECT {some(*GROUP_RULES)}, g FROM q"""


@query("needle_audit", f"WITH {NEEDLES_SQL}, {needle_rules_sql('made')}")
def needle_audit(spark, d):
    """Needle rows as they are made."""
    return needles.audit(made_needles(spark, d), len(PLACES))


#: What is done to some rows, by the text's id and the position: texts, hashes and needles change, rows go or come again.
CHANGED = {"context": "CASE WHEN doc_id % 7 = 0 AND label = 'p000' THEN replace(context, needle, '') WHEN doc_id % 17 = 0 THEN concat(context, ' ', answer) WHEN doc_id % 19 = 0 THEN replace(context, ' ', ' , ') ELSE context END", "base": "CASE WHEN doc_id % 13 = 0 AND label = 'p100' THEN 'other' ELSE base END", "answer": "CASE WHEN doc_id % 23 = 0 AND label = 'p050' THEN 'the' ELSE answer END"}


@query("needle_problems", f"WITH {NEEDLES_SQL}, some_made AS (SELECT * REPLACE ({', '.join(f'{v} AS {k}' for k, v in CHANGED.items())}) FROM made WHERE NOT (doc_id % 5 = 0 AND label = 'p050')), twice AS (SELECT * FROM some_made UNION ALL SELECT * FROM some_made WHERE doc_id % 11 = 0 AND label = 'p100'), {needle_rules_sql('twice')}")
def needle_problems(spark, d):
    """The same rows with changed texts, answers and base hashes, lost positions and repeated ids."""
    r = made_needles(spark, d).withColumnsRenamed({"position_label": "label", "base_sha256": "base"}).withColumn("doc_id", F.col("book").cast("bigint")).where("NOT (doc_id % 5 = 0 AND label = 'p050')")
    r = r.withColumn("made", F.col("context")).withColumns({k: F.expr(v) for k, v in CHANGED.items()})
    r = r.withColumn("actual_tokens", F.when(F.col("context") == F.col("made"), F.col("actual_tokens")).otherwise(text.token_count(F.col("context")))).drop("made")
    r = r.unionByName(r.where("doc_id % 11 = 0 AND label = 'p100'")).withColumnsRenamed({"label": "position_label", "base": "base_sha256"})
    return needles.audit(r, len(PLACES))


STATUS = "concat(CASE event_id % 5 WHEN 0 THEN 'state=done ' WHEN 1 THEN 'un' ELSE '' END, 'finished_at=', CASE event_id % 4 WHEN 0 THEN concat(substr(cast(ts AS STRING), 1, 10), 'T', substr(cast(ts AS STRING), 12, 8), 'Z') WHEN 1 THEN concat(substr(cast(ts AS STRING), 1, 10), 'T', substr(cast(ts AS STRING), 12, 8), '+02:00') WHEN 2 THEN concat(substr(cast(ts AS STRING), 1, 10), 'T', substr(cast(ts AS STRING), 12, 8)) ELSE 'soon' END, CASE event_id % 3 WHEN 0 THEN ' code=0' WHEN 1 THEN ';x' ELSE '' END)"


@query("finish_stamps", f"WITH x AS (SELECT event_id, regexp_extract({STATUS}, '\\bfinished_at=([^\\s,;]+)', 1) AS t FROM events) SELECT event_id, CASE WHEN regexp_matches(t, '(Z|[+-]\\d\\d:\\d\\d)$') THEN CAST(epoch(TRY_CAST(t AS TIMESTAMPTZ)) AS BIGINT) END AS seconds FROM x".replace("\\\\", "\\"))
def finish_stamps(spark, d):
    x = table(spark, d, "events").selectExpr("event_id", f"{STATUS} AS t")
    return x.select("event_id", F.unix_seconds(ledger.finished_at(F.col("t"))).alias("seconds"))


@query("design_histograms", "SELECT l_returnflag, 'l_linenumber' AS field, CAST(l_linenumber AS VARCHAR) AS value, count(*) AS rows FROM lineitem GROUP BY ALL UNION ALL SELECT l_returnflag, 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY ALL")
def design_histograms(spark, d):
    return design.design_histograms(table(spark, d, "lineitem"), "l_returnflag", ["l_linenumber", "l_linestatus"])


@query("short_datasets", "WITH g AS (SELECT source, count(*) AS n, count(*) FILTER (coalesce(trim(lang), '') = '' OR doc_id % 97 = 0) AS e FROM documents GROUP BY source) SELECT " + some(("enough_rows", "n >= 60"), ("answers_given", "e = 0")) + ", source AS key FROM g")
def short_datasets(spark, d):
    x = table(spark, d, "documents").select("source", F.when(F.col("doc_id") % 97 != 0, F.col("lang")).otherwise(F.lit(" ")).alias("answer"))
    return design.short_datasets(x, "source", "answer", 60)


@query("matched_chat_rows", "SELECT r || ':' || l_orderkey || '-' || l_linenumber AS id, split_part(r, '_', 1) AS pairing_mode, substr(r, strpos(r, '_') + 1) AS supervision_mode, 'f' || l_partkey AS fact_id FROM lineitem, (SELECT unnest([" + ", ".join(f"'{r}'" for r in RUNS[1:3]) + "]) AS r)")
def matched_chat_rows(spark, d):
    x = table(spark, d, "lineitem").selectExpr("concat_ws('-', l_orderkey, l_linenumber) AS sample_id", "'s' AS system_prompt", "l_comment AS prompt" if "l_comment" in table(spark, d, "lineitem").columns else "'p' AS prompt", "l_returnflag AS answer", "l_orderkey AS group_id", "l_linestatus AS position_label", "concat('f', l_partkey) AS fact_id", "l_linenumber AS replica_index")
    out = None
    for run in RUNS[1:3]:
        y = design.to_chat(x, run, matched=True).select("id", "metadata.pairing_mode", "metadata.supervision_mode", "metadata.fact_id")
        out = y if out is None else out.unionByName(y)
    return out


@query("repeated_cases", "SELECT CAST(n_regionkey AS VARCHAR) || '_t0_onehop' AS case_id, count(*) AS n FROM nation GROUP BY n_regionkey HAVING count(*) > 1")
def repeated_cases(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("id"), F.col("n_name").alias("needle"), F.create_map(F.lit("onehop"), F.lit("Who?")).alias("questions"), F.create_map(F.lit("t0"), F.array(F.lit("Ann"))).alias("tests"))
    return design.repeated_cases(design.expand_cases(n))


@query("replica_seeds", "WITH f AS (SELECT 'fact-' || p_partkey AS f, unnest(range(2)) AS r FROM part), g AS (SELECT f || '-neutral-160-rep-' || printf('%03d', r) AS group_id, f FROM f) SELECT group_id, substr(sha256('7:fact:' || f), 1, 16) AS fact_seed, substr(sha256('7:filler:' || group_id), 1, 16) AS filler_seed FROM g")
def replica_seeds(spark, d):
    f = table(spark, d, "part").select(F.concat(F.lit("fact-"), F.col("p_partkey").cast("string")).alias("fact_id"), F.lit("kv").alias("task"), F.lit("neutral").alias("filler_type"), F.lit(160).alias("target_tokens"))
    return generate.replicas(f, 2, 7).select("group_id", "fact_seed", "filler_seed")
