"""Queries of matched designs, realized subsets, ordered selection and needle diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits, generate
from ..sources import files
from .audits import some
from .registry import query
from .views import GRID_SQL, grid, table

PAIRINGS, MODES = ("independent", "paired"), ("answer", "evidence_id", "evidence")

#: A matched design on the grid, as both engines read it: cells of (fact, replica), with rows that are changed, lost or there twice.
PAIRING = "split_part(run_name, '_', 1)"
SUPERVISION = "substr(run_name, instr(run_name, '_') + 1)"
DESIGN = {
    "pairing": PAIRING,
    "supervision": SUPERVISION,
    "fact": "unit",
    "replica": "position_label",
    "position_label": f"CASE WHEN {PAIRING} = 'paired' THEN CASE WHEN unit % 31 = 0 AND position_label = 'p000' THEN 'p100' ELSE position_label END WHEN unit % 29 = 0 AND position_label = 'p100' THEN 'p000' ELSE concat('p', unit % 7) END",
    "filler_fingerprint": f"concat('f', unit, position_label, CASE WHEN unit % 40 = 0 AND {SUPERVISION} = 'evidence' AND position_label = 'p050' THEN 'x' ELSE '' END)",
    "fact_fingerprint": f"concat('a', unit, CASE WHEN unit % 43 = 0 AND {PAIRING} = 'paired' THEN 'x' ELSE '' END)",
    "actual_tokens": f"100 + unit % 9 + CASE WHEN unit % 33 = 0 AND {PAIRING} = 'paired' THEN 900 ELSE 0 END",
}
LOST = f"run_name <> 'base' AND NOT (unit % 37 = 0 AND run_name = 'paired_answer' AND position_label = 'p025') AND NOT (unit % 47 = 0 AND {PAIRING} = 'independent')"
AGAIN = "unit % 41 = 0 AND run_name = 'independent_evidence' AND position_label = 'p075'"
DESIGN_SQL = f"{GRID_SQL}, d0 AS (SELECT unit, run_name, {', '.join(f'{v} AS {k}_' for k, v in DESIGN.items())} FROM grid WHERE {LOST} UNION ALL SELECT unit, run_name, {', '.join(f'{v}' for v in DESIGN.values())} FROM grid WHERE {LOST} AND {AGAIN}), x AS (SELECT {', '.join(f'{k}_ AS {k}' for k in DESIGN)} FROM d0)"


def matched_rows(spark, d):
    g = grid(spark, d).where(LOST)
    return g.unionByName(g.where(AGAIN)).selectExpr(*(f"{v} AS {k}" for k, v in DESIGN.items()))


@query("matched_variants_audit", f"""WITH {DESIGN_SQL}, c AS (SELECT pairing || '/' || fact || '/' || replica AS key, count(*) AS n, count(DISTINCT supervision) AS m, count(DISTINCT (position_label, filler_fingerprint, fact_fingerprint, actual_tokens)) AS d FROM x GROUP BY ALL),
 b AS (SELECT fact || '/' || replica AS key, count(DISTINCT pairing) AS p, count(DISTINCT fact_fingerprint) AS ff, count(DISTINCT filler_fingerprint) AS fl, count(DISTINCT actual_tokens) AS t FROM x WHERE supervision = 'answer' GROUP BY ALL),
 e AS (SELECT pairing, fact, count(*) AS n, count(DISTINCT position_label) AS ps FROM x WHERE supervision = 'answer' GROUP BY ALL), t AS (SELECT (max(t) - min(t)) / greatest(avg(t), 1.0) AS gap FROM (SELECT sum(actual_tokens) AS t FROM x WHERE supervision = 'answer' GROUP BY pairing)),
 a AS (SELECT pairing, count(DISTINCT n) AS n FROM e GROUP BY pairing), m AS (SELECT count(DISTINCT (pairing, supervision)) AS n FROM x)
 SELECT {some(('unique_cell', 'n = m'), ('every_mode', 'm = 3'), ('same_input', 'd = 1'))}, key FROM c UNION ALL SELECT {some(('both_pairings', 'p = 2'), ('same_fact_fingerprint', 'ff = 1'), ('same_filler_fingerprint', 'fl = 1'), ('same_actual_tokens', 't = 1'))}, key FROM b
 UNION ALL SELECT {some(('independent_at_one_position', "pairing <> 'independent' OR ps = 1"), ('paired_at_every_position', "pairing = 'independent' OR ps = n"))}, pairing || '/' || fact FROM e UNION ALL SELECT {some(('equal_exposures', 'n = 1'))}, pairing FROM a
 UNION ALL SELECT {some(('token_gap', 'gap <= 0.01'))}, '*' FROM t UNION ALL SELECT {some(('complete_matrix', 'n = 6'))}, '*' FROM m""")
def matched_variants_audit(spark, d):
    return audits.matched_variants(matched_rows(spark, d), PAIRINGS, MODES, "fact", "replica", 0.01)


#: Realized subsets by filler type: the neutral ones match, the others differ in some respect each.
KIND = "concat(filler_type, '-', unit % 4)"
PAIRED = "run_name = 'paired_answer'"
REALIZED = {
    "kind": KIND,
    "at": "unit * 10 + CASE position_label WHEN 'p000' THEN 0 WHEN 'p050' THEN 1 ELSE 2 END",
    "fact": f"unit + CASE WHEN {PAIRED} AND {KIND} = 'same_format-1' AND unit % 9 = 0 THEN 1000000 ELSE 0 END",
    "replica": "position_label",
    "fact_fingerprint": f"concat('a', unit, CASE WHEN {PAIRED} AND {KIND} = 'same_format-2' AND unit % 9 = 1 THEN 'x' ELSE '' END)",
    "filler_fingerprint": f"concat('f', unit, CASE WHEN {PAIRED} AND {KIND} = 'same_format-3' AND unit % 9 = 2 THEN 'x' ELSE '' END)",
    "task": f"CASE WHEN {PAIRED} AND {KIND} = 'answer_bearing-1' AND unit % 9 = 0 THEN 'kv' ELSE task END",
    "filler_type": "filler_type",
    "target_tokens": "target_tokens",
    "position_label": f"CASE WHEN {KIND} = 'answer_bearing-2' AND unit % 9 = 0 AND {PAIRED} THEN 'p000' ELSE position_label END",
    "prompt_tokens": f"100 + unit % 9 + CASE WHEN {PAIRED} AND {KIND} = 'neutral-3' THEN 3 ELSE 0 END",
}
REALIZED_ROWS = f"position_label IN ('p000', 'p050', 'p100') AND NOT ({PAIRED} AND {KIND} = 'answer_bearing-3' AND unit % 9 = 0 AND position_label = 'p050')"
REALIZED_SQL = f"{GRID_SQL}, r0 AS (SELECT run_name, {', '.join(f'{v} AS {k}_' for k, v in REALIZED.items())} FROM grid WHERE {REALIZED_ROWS}), r AS (SELECT run_name, {', '.join(f'{k}_ AS {k}' for k in REALIZED)} FROM r0), i AS (SELECT * FROM r WHERE run_name = 'independent_answer'), p AS (SELECT * FROM r WHERE run_name = 'paired_answer')"


@query("realized_pairing", f"""WITH {REALIZED_SQL}, j AS (SELECT coalesce(i.kind, p.kind) AS kind, coalesce(i.fact = p.fact AND i.replica = p.replica, false) AS a, coalesce(i.fact_fingerprint = p.fact_fingerprint, false) AS b, coalesce(i.filler_fingerprint = p.filler_fingerprint, false) AS c, i.prompt_tokens AS t1, p.prompt_tokens AS t2 FROM i FULL JOIN p ON i.kind = p.kind AND i.at = p.at),
 g AS (SELECT kind, bool_and(a) AS same_ordered_identities, bool_and(b) AS same_facts, bool_and(c) AS same_fillers, coalesce(sum(t1), 0)::BIGINT AS independent_tokens, coalesce(sum(t2), 0)::BIGINT AS paired_tokens FROM j GROUP BY kind),
 l AS (SELECT kind, 1 AS s, unnest(['task', 'filler', 'length', 'replica', 'position']) AS field, unnest([task, filler_type, target_tokens::INT::VARCHAR, replica, position_label]) AS value FROM i UNION ALL SELECT kind, -1, unnest(['task', 'filler', 'length', 'replica', 'position']), unnest([task, filler_type, target_tokens::INT::VARCHAR, replica, position_label]) FROM p),
 h AS (SELECT kind, bool_and(field = 'position' OR s = 0) AS same_counts, bool_and(field <> 'position' OR s = 0) AS same_positions FROM (SELECT kind, field, value, sum(s) AS s FROM l GROUP BY ALL) GROUP BY kind),
 k AS (SELECT kind, bool_and(n = 3) AS complete_blocks FROM (SELECT kind, fact, count(DISTINCT position_label) AS n FROM p GROUP BY ALL) GROUP BY kind),
 z AS (SELECT *, round(abs(independent_tokens - paired_tokens) / greatest((independent_tokens + paired_tokens) / 2, 1.0), 9) AS token_gap FROM g JOIN h USING (kind) JOIN k USING (kind))
 SELECT *, same_ordered_identities AND same_facts AND same_fillers AND same_counts AND same_positions AND complete_blocks AND token_gap <= 0.02 AS strict FROM z""")
def realized_pairing(spark, d):
    """Subsets that differ in order, facts, fillers, counts, positions, blocks or tokens, each in one group."""
    r = grid(spark, d).where(REALIZED_ROWS).select("run_name", *(F.expr(v).alias(f"{k}_") for k, v in REALIZED.items()))
    r = r.select("run_name", *(F.col(f"{k}_").alias(k) for k in REALIZED))
    return audits.realized_pairing(r.where("run_name = 'independent_answer'"), r.where(PAIRED), "kind", "at", "fact", "replica", 3, 0.02)


MOVED = "unit + CASE WHEN run_name = 'paired_evidence' AND unit % 19 = 0 THEN 1 ELSE 0 END"
AT = "unit * 7 + CASE position_label WHEN 'p000' THEN 0 WHEN 'p012' THEN 1 WHEN 'p025' THEN 2 WHEN 'p050' THEN 3 WHEN 'p075' THEN 4 WHEN 'p088' THEN 5 ELSE 6 END"
SHORT = "run_name <> 'base' AND NOT (run_name = 'independent_evidence' AND unit % 53 = 0 AND position_label = 'p050')"


@query("ordered_identity_audit", f"WITH {GRID_SQL}, v AS (SELECT run_name, {AT} AS at_, {MOVED} AS fact, position_label AS replica FROM grid WHERE {SHORT}), w AS (SELECT DISTINCT at_ FROM v WHERE at_ % 3 = 0), n AS (SELECT run_name, count(*) AS n FROM v GROUP BY run_name), o AS (SELECT v.* FROM v JOIN w USING (at_) WHERE run_name = 'independent_answer'), q AS (SELECT n.run_name, o.at_, o.fact, o.replica FROM o, n WHERE n.run_name <> 'independent_answer'), x AS (SELECT q.run_name || '/' || q.at_ AS key, v.fact = q.fact AND v.replica = q.replica AS fine FROM q LEFT JOIN v ON v.run_name = q.run_name AND v.at_ = q.at_) SELECT {some(('same_rows', "n = (SELECT n FROM n WHERE run_name = 'independent_answer')"))}, run_name AS key FROM n UNION ALL SELECT {some(('same_identity', 'fine'))}, key FROM x")
def ordered_identity_audit(spark, d):
    """Every third place of all variants: one has rows moved, one lacks rows."""
    v = grid(spark, d).where(SHORT).selectExpr("run_name", f"{AT} AS at_", f"{MOVED} AS fact", "position_label AS replica")
    return audits.ordered_identities(v, "run_name", "independent_answer", "at_", v.where("at_ % 3 = 0").select("at_"), "fact", "replica")


@query("ordered_rows", "WITH o AS (SELECT row_number() OVER () - 1 AS i, o_orderkey, o_totalprice FROM orders), n AS (SELECT count(*) AS n FROM orders), w AS (SELECT c_custkey AS place, unnest([c_custkey * 7919 % n, c_custkey % 10]) AS row_index, unnest([0, 1]) AS half FROM customer, n) SELECT place * 2 + half AS place, row_index, o_orderkey, o_totalprice FROM w JOIN o ON o.i = w.row_index")
def ordered_rows(spark, d):
    """Rows of a table by a list of places, with repeats."""
    orders = files.indexed_rows(spark, f"{d}/orders.parquet").select("row_index", "o_orderkey", "o_totalprice")
    n = orders.count()
    wanted = table(spark, d, "customer").selectExpr("c_custkey", f"posexplode(array(c_custkey * 7919 % {n}, c_custkey % 10)) AS (half, row_index)").selectExpr("c_custkey * 2 + half AS place", "row_index")
    return files.take_rows(orders, wanted, "place")


#: Needle prompts on texts: the needle stands at the start or the end, some prompts are off the template, some needles are lost or there twice.
NEEDLE = "concat('The ', source, ' needle of ', cast(doc_id AS STRING), '.')"
NEEDLE_BOOK = "CASE WHEN doc_id % 11 = 0 AND p = 1 THEN concat(text, 'x') ELSE text END"
NEEDLE_ROWS = {
    "sample_id": "concat(doc_id, '@', p)",
    "group_id": "concat('g', doc_id)",
    "position_label": "concat('p', p)",
    "target_position": "p / 2.0",
    "actual_position": "p / 2.0",
    "answer": "source",
    "needle": NEEDLE,
    "prompt": f"concat('Read:\n\n', CASE WHEN doc_id % 13 = 0 AND p = 2 THEN '<tome>' ELSE '<book>' END, '\n', CASE p WHEN 0 THEN concat('\n', CASE WHEN doc_id % 17 = 0 THEN 'no' ELSE {NEEDLE} END, '\n', {NEEDLE_BOOK}) WHEN 1 THEN concat({NEEDLE_BOOK}, '\n', {NEEDLE}, '\n') ELSE concat({NEEDLE_BOOK}, '\n', {NEEDLE}, '\n', CASE WHEN doc_id % 19 = 0 THEN {NEEDLE} ELSE '' END) END, '\n</book>\n\nQuestion: Which source?', CASE WHEN doc_id % 23 = 0 AND p = 0 THEN '' ELSE '\nResponse:' END)",
}
NEEDLE_SQL = (
    "n0 AS (SELECT doc_id, source, " + ", ".join(f"{v} AS {k}".replace("'\n", "chr(10) || '").replace("\n", "' || chr(10) || '") for k, v in NEEDLE_ROWS.items()) + " FROM documents, (SELECT unnest([0, 1, 2]) AS p)), "
    "n1 AS (SELECT *, strpos(prompt, '<book>' || chr(10)) AS a, substr(prompt, a + 7) AS rest, strpos(rest, chr(10) || '</book>') AS b, substr(rest, b + 8) AS tail, strpos(tail, chr(10) || 'Question: ') AS c, substr(tail, c + 11) AS ask, a > 0 AND b > 0 AND c > 0 AND ends_with(ask, chr(10) || 'Response:') AS fits FROM n0), "
    "n2 AS (SELECT *, substr(ask, 1, length(ask) - 10) AS q, substr(rest, 1, b - 1) AS book, chr(10) || needle || chr(10) AS blk FROM n1), "
    "n3 AS (SELECT *, CASE WHEN fits AND len(string_split(book, needle)) = 2 THEN trim(CASE WHEN contains(book, blk) THEN substr(book, 1, strpos(book, blk) - 1) || substr(book, strpos(book, blk) + length(blk)) ELSE substr(book, 1, strpos(book, needle) - 1) || substr(book, strpos(book, needle) + length(needle)) END, chr(10)) END AS r FROM n2), "
    "n4 AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY position_label) AS k, count(r) OVER (PARTITION BY group_id) = count(*) OVER (PARTITION BY group_id) AND min(r) OVER (PARTITION BY group_id) = max(r) OVER (PARTITION BY group_id) AS good FROM n3)"
)
BLOCK_SQL = "'<oracle_evidence>' || chr(10) || needle || chr(10) || '</oracle_evidence>'"
ASK_SQL = "chr(10) || chr(10) || 'Question: ' || q"


def needle_prompts(spark, d):
    p = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    return table(spark, d, "documents").select("doc_id", "source", "text", p.alias("p")).selectExpr(*(f"{v} AS {k}" for k, v in NEEDLE_ROWS.items()))


@query("needle_diagnostics", f"""WITH {NEEDLE_SQL}, l AS (SELECT sample_id || '@diag-locate_only' AS sample_id, 'locate_only' AS evaluation_mode, position_label, '' AS answer, '{generate.LOCATE}' AS system, prompt FROM n4
 UNION ALL SELECT group_id || '@diag-oracle_long', 'oracle_long', 'oracle', answer, '{generate.ORACLE}', '<book>' || chr(10) || r || chr(10) || '</book>' || {ASK_SQL} || chr(10) || chr(10) || {BLOCK_SQL} || chr(10) || 'Response:' FROM n4 WHERE k = 1 AND good
 UNION ALL SELECT group_id || '@diag-oracle_short', 'oracle_short', 'oracle', answer, '{generate.ORACLE}', {BLOCK_SQL} || {ASK_SQL} || chr(10) || 'Response:' FROM n4 WHERE k = 1 AND good)
 SELECT sample_id, evaluation_mode, position_label, answer, sha256(prompt) AS prompt_sha256 FROM l""")
def needle_diagnostics(spark, d):
    x = generate.derive_needles(needle_prompts(spark, d))
    return x.select("sample_id", "evaluation_mode", "position_label", "answer", F.sha2("prompt", 256).alias("prompt_sha256"))


@query("needle_diagnostic_problems", f"WITH {NEEDLE_SQL} SELECT {some(('template', 'fits'), ('needle_once', 'NOT fits OR r IS NOT NULL'))}, sample_id AS key FROM n4 UNION ALL SELECT {some(('one_book', 'n <= 1'))}, group_id FROM (SELECT group_id, count(DISTINCT r) AS n FROM n4 GROUP BY group_id)")
def needle_diagnostic_problems(spark, d):
    return generate.needle_group_problems(needle_prompts(spark, d))
