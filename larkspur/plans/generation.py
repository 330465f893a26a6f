"""Queries of generation, diagnostics, validation and text placement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.hashing import ALPHABET, random_code
from ..lineage import dealt
from ..operators import audits, generate
from ..schemas import GRID
from .registry import query
from .scoring import TOKEN_SQL
from .views import GRID_SQL, RESULTS_SQL, grid, results, table


def groups(spark, d):
    """A group for each part: its task, filler and length, and seeds for fact and filler."""
    return table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("group_id"),
        F.when(F.col("p_partkey") % 2 == 0, "kv").otherwise("two_hop").alias("task"),
        F.element_at(F.array(F.lit("neutral"), F.lit("same_format"), F.lit("answer_bearing")), (F.col("p_size") % 3 + 1).cast("int")).alias("filler_type"),
        F.when(F.col("p_retailprice") < 1400, 384).otherwise(512).alias("target_tokens"),
        F.concat(F.lit("fact-"), (F.floor(F.col("p_partkey") / 4)).cast("string")).alias("fact_seed"),
        F.concat(F.lit("filler-"), F.col("p_partkey").cast("string")).alias("filler_seed"),
    )


def code_sql(prefix: str, width: int, *parts: str) -> str:
    key = lambda k: " || ':' || ".join((*parts, f"'{k}'"))
    return f"'{prefix}-' || " + " || ".join(f"substr('{ALPHABET}', CAST(CAST('0x' || substr(sha256({key(k)}), 1, 15) AS BIGINT) % {len(ALPHABET)} + 1 AS INT), 1)" for k in range(width))


FACT_SEED = "'fact-' || CAST(p_partkey // 4 AS VARCHAR)"


@query("random_codes", f"SELECT p_partkey, {code_sql('KEY', 10, FACT_SEED, chr(39) + 'KEY' + chr(39))} AS code FROM part")
def random_codes(spark, d):
    seed = F.concat(F.lit("fact-"), F.floor(F.col("p_partkey") / 4).cast("string"))
    return table(spark, d, "part").select("p_partkey", random_code("KEY", 10, seed, F.lit("KEY")).alias("code"))


@query("task_facts", f"SELECT CAST(p_partkey AS VARCHAR) AS group_id, CASE WHEN p_partkey % 2 = 0 THEN {code_sql('VALUE', 8, FACT_SEED, chr(39) + 'VALUE' + chr(39))} END AS kv_answer, CASE WHEN p_partkey % 2 = 0 THEN 'Which value does the register hold for ' || {code_sql('KEY', 10, FACT_SEED, chr(39) + 'KEY' + chr(39))} || '?' ELSE 'Which shade belongs to ' || {code_sql('ENTITY', 8, FACT_SEED, chr(39) + 'ENTITY' + chr(39))} || '?' END AS query, CAST(1 + p_partkey % 2 AS INT) AS documents FROM part")
def task_facts(spark, d):
    f = generate.facts(dealt(groups(spark, d), 20_000, "group_id"))
    return f.select("group_id", F.when(F.col("task") == "kv", F.col("answer")).alias("kv_answer"), "query", F.size("evidence").alias("documents"))


@query("budget_cuts", "WITH c AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 97 + 1 AS tokens FROM orders), u AS (SELECT *, 10 + sum(tokens) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS upto FROM c) SELECT o_custkey, o_orderkey, CAST(upto AS BIGINT) AS upto FROM u WHERE upto <= 200 OR (upto - tokens <= 200 AND abs(upto - 200) < abs(upto - tokens - 200))")
def budget_cuts(spark, d):
    c = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("idx"), (F.floor("o_totalprice") % 97 + 1).alias("tokens"), F.lit(10).alias("base"), F.lit(200).alias("target"))
    return generate.fit_budget(c, "o_custkey", "base", "target").select("o_custkey", F.col("idx").alias("o_orderkey"), F.col("upto").cast("bigint").alias("upto"))


POINTS = (0.0, 0.25, 0.5, 1.0)


def samples(spark, d):
    return generate.position_groups(groups(spark, d), POINTS)


def tokens_sql(c: str) -> str:
    return f"CAST(len(regexp_extract_all({c}, {TOKEN_SQL})) AS BIGINT)"


def pick_sql(values, *parts: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[CAST(CAST('0x' || substr(sha256(concat_ws(':', {', '.join(parts)})), 1, 15) AS BIGINT) % {len(values)} + 1 AS INT)]"


def filler_sql(prefix: str, width: int) -> str:
    return code_sql(prefix, width, "filler_seed", "idx", f"'{prefix}'")


def samples_sql() -> str:
    """The same samples: facts, candidates, the budget cut, places and prompts, one CTE each."""
    code = lambda prefix, width: code_sql(prefix, width, "fact_seed", f"'{prefix}'")
    doc = lambda i, t: f"'[Document ' || {i} || ']' || chr(10) || {t}"
    holds = lambda k, v: f"'In the register ' || {k} || ' holds ' || {v} || '.'"
    filed = lambda e, b: f"{e} || ' is filed under ' || {b} || '.'"
    carries = lambda b, c: f"'Whatever is filed under ' || {b} || ' carries the shade ' || {c} || '.'"
    bears = lambda c: f"CASE WHEN filler_type = 'answer_bearing' AND idx % 3 = 0 THEN answer ELSE {c} END"
    kv = "task = 'kv'"
    words = " || ' ' || ".join(pick_sql(generate.WORDS, "filler_seed", "idx", f"'{k}'") for k in range(1, 13))
    shade = f"{pick_sql(generate.COLORS, 'filler_seed', 'idx', chr(39) + 'color' + chr(39))} || '-' || {filler_sql('SHADE', 4)}"
    chain = f"'Index page ' || idx || '. ' || {filed(filler_sql('ENTITY', 8), filler_sql('BRIDGE', 8))} || ' ' || {carries(filler_sql('BRIDGE', 8), bears(shade))} || ' Remarks: '"
    prompt = lambda docs: f"'<context>' || chr(10) || array_to_string({docs}, chr(10) || chr(10)) || chr(10) || '</context>' || chr(10) || chr(10) || 'Question: ' || query || chr(10) || 'Response:'"
    whole = lambda p: f"'{generate.SYSTEM}' || chr(10) || chr(10) || {p}"
    return f"""g AS (SELECT CAST(p_partkey AS VARCHAR) AS group_id, CASE WHEN p_partkey % 2 = 0 THEN 'kv' ELSE 'two_hop' END AS task, (['neutral', 'same_format', 'answer_bearing'])[CAST(p_size % 3 + 1 AS INT)] AS filler_type, CASE WHEN p_retailprice < 1400 THEN 384 ELSE 512 END AS target_tokens, {FACT_SEED} AS fact_seed, 'filler-' || p_partkey AS filler_seed FROM part),
 c AS (SELECT *, {code('KEY', 10)} AS k, {code('VALUE', 8)} AS v, {code('ENTITY', 8)} AS e, {code('BRIDGE', 8)} AS b, {pick_sql(generate.COLORS, 'fact_seed', chr(39) + 'color' + chr(39))} || '-' || {code('SHADE', 4)} AS s, substr(sha256(fact_seed), 1, 10) AS tag FROM g),
 f AS (SELECT *, CASE WHEN {kv} THEN v ELSE s END AS answer, CASE WHEN {kv} THEN 'Which value does the register hold for ' || k || '?' ELSE 'Which shade belongs to ' || e || '?' END AS query, CASE WHEN {kv} THEN 'evidence-' ELSE 'evidence-a-' END || tag AS first_id,
  CASE WHEN {kv} THEN [{doc("'evidence-' || tag", holds('k', 'v'))}] ELSE [{doc("'evidence-a-' || tag", filed('e', 'b'))}, {doc("'evidence-b-' || tag", carries('b', 's'))}] END AS evidence FROM c),
 f2 AS (SELECT *, {tokens_sql(whole(prompt('evidence')))} AS base FROM f),
 t AS (SELECT *, CASE WHEN filler_type = 'neutral' THEN 'Logbook page ' || idx || '. ' || w || '. Nothing on this page is about registers or shades.' WHEN {kv} THEN 'Register page ' || idx || '. ' || {holds(filler_sql('KEY', 10), bears(filler_sql('VALUE', 8)))} || ' Remarks: ' || w || '.' ELSE {chain} || w || '.' END AS body FROM (SELECT *, {words} AS w FROM (SELECT *, unnest(range(40)) AS idx FROM f2))),
 n AS (SELECT *, {tokens_sql('rendered')} AS tokens FROM (SELECT *, {doc("printf('filler-%05d', idx)", 'body')} AS rendered FROM t)),
 u AS (SELECT *, base + sum(tokens) OVER (PARTITION BY group_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS upto FROM n),
 taken AS (SELECT * FROM u WHERE upto <= target_tokens OR (upto - tokens <= target_tokens AND abs(upto - target_tokens) < abs(upto - tokens - target_tokens))),
 d AS (SELECT group_id, list(rendered ORDER BY idx) AS filler, list(upto - base ORDER BY idx) AS sums FROM taken GROUP BY group_id),
 p AS (SELECT f2.*, coalesce(filler, []) AS filler, coalesce(sums, []) AS sums, unnest([{', '.join(f'CAST({p} AS DOUBLE)' for p in POINTS)}]) AS target_position FROM f2 LEFT JOIN d USING (group_id)),
 i AS (SELECT *, CASE WHEN target_position <= 0 THEN 0 WHEN target_position >= 1 THEN len(filler) ELSE list_position(list_transform(list_concat([0], sums), lambda x: abs(x - target_position * sums[-1])), list_min(list_transform(list_concat([0], sums), lambda x: abs(x - target_position * sums[-1])))) - 1 END AS spot FROM p),
 r AS (SELECT *, {prompt('list_concat(list_concat(list_slice(filler, 1, spot), evidence), list_slice(filler, spot + 1, len(filler)))')} AS prompt FROM i),
 sa AS (SELECT *, printf('p%03d', CAST(target_position * 100 AS INT)) AS position_label, {tokens_sql(whole('prompt'))} AS actual_tokens, {tokens_sql(f"substr({whole('prompt')}, 1, strpos({whole('prompt')}, '[Document ' || first_id || ']') - 1)")} / greatest({tokens_sql(whole('prompt'))}, 1) AS actual_position FROM r)"""


SAMPLES_SQL = samples_sql()


@query("position_groups", f"WITH {SAMPLES_SQL} SELECT group_id || '@' || position_label AS sample_id, group_id, task, filler_type, position_label, target_tokens, CAST(actual_tokens AS INT) AS actual_tokens, round(actual_position, 6) AS actual_position, CAST(len(filler) AS INT) AS filler_document_count, sha256(prompt) AS prompt_sha256 FROM sa")
def position_groups(spark, d):
    """Whole position groups."""
    s = samples(spark, d)
    return s.select("sample_id", "group_id", "task", "filler_type", "position_label", "target_tokens", "actual_tokens", F.round("actual_position", 6).alias("actual_position"), "filler_document_count", F.sha2("prompt", 256).alias("prompt_sha256"))


@query("raw_validation", f"WITH {SAMPLES_SQL}, w AS (SELECT CASE WHEN CAST(group_id AS INT) % 10 = 0 THEN replace(prompt, answer, '') ELSE prompt END AS prompt, actual_tokens, target_tokens, actual_position, target_position, evidence FROM sa) SELECT 'length_error' AS rule, count(*) AS n FROM w WHERE abs(actual_tokens - target_tokens) > 0.02 * target_tokens HAVING count(*) > 0 UNION ALL SELECT 'position_error', count(*) FROM w WHERE abs(actual_position - target_position) > 0.03 HAVING count(*) > 0 UNION ALL SELECT 'evidence_in_prompt', count(*) FROM w WHERE NOT list_bool_and(list_transform(evidence, lambda x: contains(prompt, x))) HAVING count(*) > 0")
def raw_validation(spark, d):
    """Violations by rule over all generated samples, the answers of every tenth group being taken out of the prompts."""
    s = samples(spark, d).withColumn("prompt", F.when(F.col("group_id").cast("int") % 10 == 0, F.replace("prompt", "answer", F.lit(""))).otherwise(F.col("prompt")))
    return audits.raw_samples(s).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


BANK_SQL = "f AS (SELECT p_partkey AS k, 'fact-' || p_partkey AS key FROM part)"


@query("matched_bank_audit", f"WITH {BANK_SQL} SELECT 'one_answer' AS rule, key FROM f WHERE k % 10 = 0 UNION ALL SELECT 'distinct_fillers', key FROM f WHERE k % 7 = 0 UNION ALL SELECT 'one_grid', key FROM f WHERE k % 11 = 0")
def matched_bank_audit(spark, d):
    """A bank of three replicas of each fact, with an answer, a filler view and a position changed in some."""
    facts = table(spark, d, "part").select(F.concat(F.lit("fact-"), F.col("p_partkey").cast("string")).alias("fact_id"), F.when(F.col("p_partkey") % 2 == 0, "kv").otherwise("two_hop").alias("task"), F.lit("neutral").alias("filler_type"), F.lit(160).alias("target_tokens"))
    bank = generate.replicas(facts, 3, 7)
    s = generate.position_groups(bank, (0.0, 0.5, 1.0)).withColumn("fact_id", F.regexp_extract("group_id", r"^(fact-\d+)-", 1)).withColumn("replica", F.regexp_extract("group_id", r"rep-(\d+)$", 1).cast("int"))
    k = F.regexp_extract("fact_id", r"(\d+)$", 1).cast("int")
    last = F.col("replica") == 2
    s = s.where(~(last & (k % 11 == 0) & (F.col("position_label") == "p050")))
    s = s.withColumn("answer", F.when(last & (k % 10 == 0), F.lit("other")).otherwise(F.col("answer"))).withColumn("filler_fingerprint", F.when(k % 7 == 0, F.lit("same")).otherwise(F.col("filler_fingerprint")))
    return audits.matched_bank(s, "fact_id", "replica")


@query("diagnostic_rows", f"WITH n AS (SELECT count(*) AS g FROM part) SELECT 'locate_only' AS evaluation_mode, {len(POINTS)} * g AS n, {len(POINTS)} * g AS ids, 0::BIGINT AS with_oracle FROM n UNION ALL SELECT 'oracle_long', {len(POINTS)} * g, {len(POINTS)} * g, {len(POINTS)} * g FROM n UNION ALL SELECT 'oracle_short', g, g, g FROM n")
def diagnostic_rows(spark, d):
    x = generate.derive(samples(spark, d))
    return x.groupBy("evaluation_mode").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sample_id").alias("ids"), F.count_if(F.contains("prompt", F.lit("<oracle_evidence>"))).alias("with_oracle"))


@query("insertion_points", "WITH x AS (SELECT doc_id, text, p, CAST(round_even(length(text) * p, 0) AS INT) AS t FROM documents, (SELECT unnest([0.0, 0.25, 0.5, 1.0]::DOUBLE[]) AS p)), y AS (SELECT *, CASE WHEN strpos(substr(text, 1, t + 1), chr(10)) > 0 THEN length(substr(text, 1, t + 1)) - strpos(reverse(substr(text, 1, t + 1)), chr(10)) ELSE -1 END AS pr, CASE WHEN strpos(substr(text, t + 1), chr(10)) > 0 THEN t + strpos(substr(text, t + 1), chr(10)) - 1 ELSE -1 END AS fo FROM x) SELECT doc_id, p, CAST(CASE WHEN p <= 0 THEN 0 WHEN p >= 1 THEN length(text) WHEN pr >= 0 AND fo >= 0 THEN CASE WHEN t - pr <= fo - t THEN pr ELSE fo END WHEN pr >= 0 THEN pr WHEN fo >= 0 THEN fo ELSE t END AS INT) AS at FROM y")
def insertion_points(spark, d):
    x = table(spark, d, "documents").select("doc_id", "text", F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.5, 1.0)))).alias("p"))
    return x.select("doc_id", "p", text.insertion_index(F.col("text"), F.col("p")).cast("int").alias("at"))


@query("needle_round_trips", "SELECT doc_id, CASE WHEN len(string_split('x' || text || chr(10) || '#needle#' || chr(10), '#needle#')) = 2 THEN sha256(trim('x' || text, chr(10))) END AS restored_sha256 FROM documents")
def needle_round_trips(spark, d):
    """A needle put behind each text and taken out again."""
    whole = F.concat(F.lit("x"), F.col("text"))
    put = text.insert_block(whole, F.lit("#needle#"), F.length(whole))
    return table(spark, d, "documents").select("doc_id", F.sha2(text.remove_needle(put, F.lit("#needle#")), 256).alias("restored_sha256"))


def fitted_sql(target: int, needle: str) -> str:
    """Three passes: the length, the text, its tokens, and the next length."""
    cut = lambda n: f"array_to_string(w[1:greatest({n}, 1)], ' ')"
    tokens = lambda n: tokens_sql(f"{cut(n)} || chr(10) || '{needle}'")
    after = lambda n, c: f"CASE WHEN {c} <= {target} AND {n} > 0 THEN {n} ELSE {n} - greatest(1, {c} - {target} + 8) END"
    return f"""WITH a AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
 b AS (SELECT *, least(len(w), greatest(1, {target} - {tokens_sql(f"'{needle}'")} - 16)) AS n1 FROM a), b1 AS (SELECT *, {tokens('n1')} AS c1 FROM b),
 b2 AS (SELECT *, {after('n1', 'c1')} AS n2 FROM b1), b3 AS (SELECT *, {tokens('n2')} AS c2 FROM b2),
 b4 AS (SELECT *, {after('n2', 'c2')} AS n3 FROM b3), b5 AS (SELECT *, {tokens('n3')} AS c3 FROM b4),
 x AS (SELECT doc_id, CASE WHEN c1 <= {target} AND n1 > 0 THEN c1 WHEN c2 <= {target} AND n2 > 0 THEN c2 WHEN c3 <= {target} AND n3 > 0 THEN c3 END AS c,
   CASE WHEN c1 <= {target} AND n1 > 0 THEN {cut('n1')} WHEN c2 <= {target} AND n2 > 0 THEN {cut('n2')} WHEN c3 <= {target} AND n3 > 0 THEN {cut('n3')} END AS fitted FROM b5)
 SELECT doc_id, c IS NOT NULL AS fits, CAST(c AS INT) AS tokens, fitted FROM x"""


@query("fitted_prefixes", f"SELECT doc_id, fits, tokens FROM ({fitted_sql(256, 'the needle is here')})")
def fitted_prefixes(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("words"), F.lit("the needle is here").alias("needle"))
    f = generate.fit_prefix(x, "words", "needle", 256)
    return f.select("doc_id", F.col("fitted").isNotNull().alias("fits"), text.token_count(F.concat("fitted", F.lit("\n"), "needle")).alias("tokens"))


@query("full_matrix_audit", f"WITH {GRID_SQL}, c AS (SELECT run_name, task, filler_type, target_tokens, position_label, count(DISTINCT unit) AS g FROM grid GROUP BY ALL), r AS (SELECT run_name, count(*) AS cells, min(g) AS low, max(g) AS high FROM c GROUP BY run_name) SELECT unnest(list_filter([CASE WHEN cells <> 84 THEN 'all_cells' END, CASE WHEN NOT (low = 50 AND high = 50) THEN 'groups_per_cell' END], lambda x: x IS NOT NULL)) AS rule, run_name AS key FROM r")
def full_matrix_audit(spark, d):
    return audits.full_matrix(grid(spark, d).withColumn("group_id", F.col("unit")), ["task", "filler_type", "target_tokens", "position_label"], 84, 50)


@query("coverage_audit", f"WITH {RESULTS_SQL}, r AS (SELECT run_name, count(DISTINCT task) AS t, count(DISTINCT position_label) AS p FROM results GROUP BY run_name) SELECT unnest(list_filter([CASE WHEN t < 4 THEN 'tasks' END, CASE WHEN p < 7 THEN 'positions' END], lambda x: x IS NOT NULL)) AS rule, run_name AS key FROM r")
def coverage_audit(spark, d):
    return audits.coverage(results(spark, d), 4, len(GRID))


@query("block_audit", "WITH f AS (SELECT l_returnflag, l_partkey, count(*) AS n, count(DISTINCT l_linenumber) AS dd FROM lineitem GROUP BY ALL), s AS (SELECT l_returnflag, count(*) AS facts FROM f GROUP BY 1) SELECT 'complete_block' AS rule, CAST(l_partkey AS VARCHAR) AS key FROM f WHERE NOT (n = 7 AND dd = 7) UNION ALL SELECT 'enough_facts', l_returnflag FROM s WHERE facts < 5000")
def block_audit(spark, d):
    return audits.blocks(table(spark, d, "lineitem"), ["l_returnflag"], "l_partkey", "l_linenumber", 7, 5000)


@query("matched_design_audit", f"WITH {GRID_SQL}, x AS (SELECT split_part(run_name, '_', 1) AS pairing, substr(run_name, strpos(run_name, '_') + 1) AS supervision, unit AS fact, unit || '@' || position_label AS cell, position_label, CASE WHEN unit % 50 = 0 THEN run_name ELSE 'h' || unit END AS ph FROM grid WHERE run_name <> 'base'), i AS (SELECT pairing, cell, count(DISTINCT ph) AS p FROM x GROUP BY ALL), e AS (SELECT fact, pairing, supervision, count(*) AS n, count(DISTINCT position_label) AS ps FROM x GROUP BY ALL), f AS (SELECT fact, count(DISTINCT n) AS n, max(ps) FILTER (pairing = 'independent') AS ind FROM e GROUP BY fact) SELECT 'same_input_across_supervision' AS rule, cell AS key FROM i WHERE p <> 1 UNION ALL SELECT 'equal_exposures', CAST(fact AS VARCHAR) FROM f WHERE n <> 1 UNION ALL SELECT 'independent_has_one_position', CAST(fact AS VARCHAR) FROM f WHERE ind <> 1")
def matched_design_audit(spark, d):
    g = grid(spark, d).where("run_name <> 'base'")
    x = g.selectExpr("substring_index(run_name, '_', 1) AS pairing", "substring(run_name, instr(run_name, '_') + 1) AS supervision", "unit AS fact", "concat(unit, '@', position_label) AS cell", "position_label", "CASE WHEN unit % 50 = 0 THEN run_name ELSE concat('h', unit) END AS prompt_hash")
    return audits.matched_design(x, "cell")


@query("chat_audit", "WITH c AS (SELECT conv_id, list(role ORDER BY turn, role, text) AS r, list(text ORDER BY turn, role, text) AS t FROM conversations GROUP BY conv_id) SELECT unnest(list_filter([CASE WHEN r <> ['system', 'user', 'assistant'] THEN 'roles' END, CASE WHEN NOT coalesce(list_sort(json_keys(CASE WHEN json_valid(t[-1]) THEN t[-1] END)) = ['answer', 'confidence', 'evidence_ids', 'evidence_quotes'], false) THEN 'payload' END], lambda x: x IS NOT NULL)) AS rule, CAST(conv_id AS VARCHAR) AS key FROM c")
def chat_audit(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.expr("transform(array_sort(collect_list(struct(turn, role, text))), x -> named_struct('role', x.role, 'content', x.text))").alias("messages"))
    return audits.chat_rows(c, "conv_id")


@query("prompt_budget_audit", "SELECT 'fits_window' AS rule, CAST(doc_id AS VARCHAR) AS key FROM documents WHERE n_chars // 4 + 256 > 2048")
def prompt_budget_audit(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.floor(F.col("n_chars") / 4).alias("t"))
    return audits.prompt_budget(x, "doc_id", "t", 256, 2048)


STATUS = {
    "top": "CASE c_custkey % 6 WHEN 0 THEN 'FAILED x' WHEN 1 THEN 'validated' WHEN 2 THEN 'stage=qwen' WHEN 3 THEN 'stage=mistral' WHEN 4 THEN 'audit' END",
    "qwen": "CASE WHEN c_custkey % 7 = 0 THEN 'failed' ELSE 'ok' END",
    "qwen_training": "CASE WHEN c_custkey % 11 = 0 THEN 'Failed' END",
    "mistral": "CASE WHEN c_custkey % 13 = 0 THEN 'failed' END",
    "mistral_training": "'running'",
    "process_present": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 3 = 1 END",
}
STATUS_LIST = ", ".join(f"{v} AS {k}" for k, v in STATUS.items())


@query("queue_health", f"WITH s AS (SELECT c_custkey, {STATUS_LIST} FROM customer), x AS (SELECT *, lower(coalesce(top, '')) AS t, starts_with(lower(coalesce(qwen, '')), 'failed') AS q, starts_with(lower(coalesce(qwen_training, '')), 'failed') AS qt, starts_with(lower(coalesce(mistral, '')), 'failed') AS m FROM s) SELECT c_custkey, CASE WHEN starts_with(t, 'failed') THEN 'failed' WHEN starts_with(t, 'validated') THEN 'validated' WHEN contains(t, 'stage=qwen') AND (q OR qt) THEN 'failed' WHEN NOT contains(t, 'stage=qwen') AND contains(t, 'stage=mistral') AND (q OR m) THEN 'failed' WHEN process_present THEN 'running' WHEN NOT process_present THEN 'stalled' ELSE 'unknown' END AS health FROM x")
def queue_health(spark, d):
    s = table(spark, d, "customer").selectExpr("c_custkey", *(f"{v} AS {k}" for k, v in STATUS.items()))
    return audits.queue_health(s).select("c_custkey", "health")


@query("identity_changes", "SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0")
def identity_changes(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    return audits.identity_changes(c, c.withColumn("c_name", F.when(F.col("c_custkey") % 10 == 0, F.lit("other")).otherwise(F.col("c_name"))), "c_custkey", ["c_name", "c_nationkey"])


@query("release_selection", "SELECT decision, count(*) AS n FROM (SELECT CASE WHEN NOT starts_with(url, 'https://') THEN 'outside' WHEN NOT ends_with(url, '.html') THEN 'kind' WHEN length(html) > 3000 THEN 'too_large' ELSE 'included' END AS decision FROM pages) GROUP BY decision")
def release_selection(spark, d):
    f = table(spark, d, "pages").select(F.col("url").alias("path"), F.length("html").alias("bytes"))
    return audits.release_selection(f, ["https://"], [".html"], 3000).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))
