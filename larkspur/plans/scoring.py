"""Queries of scoring and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, text
from ..lineage import dealt
from .registry import query
from .views import table

PUNCT_SQL = "'" + text.PUNCTUATION.replace("'", "''") + "'"
TOKEN_SQL = r"'[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'"


def norm_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(translate(lower({x}), {PUNCT_SQL}, ''), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"


F1_SQL = f"""f AS (SELECT id, CASE WHEN {norm_sql('pred')} = '' THEN [] ELSE string_split({norm_sql('pred')}, ' ') END AS p, CASE WHEN {norm_sql('ref')} = '' THEN [] ELSE string_split({norm_sql('ref')}, ' ') END AS e FROM qa),
 g AS (SELECT id, p, e, coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(e, lambda x: x = t))))), 0) AS shared FROM f),
 f1 AS (SELECT id, CASE WHEN len(p) = 0 OR len(e) = 0 THEN CAST(len(p) = len(e) AS DOUBLE) WHEN shared = 0 THEN 0.0 ELSE 2 * (shared / len(p)) * (shared / len(e)) / (shared / len(p) + shared / len(e)) END AS f1 FROM g)"""
QA_COLUMNS = ("p_partkey AS id", "concat('The ', p_type, ', ', p_name, '!') AS pred", "CASE WHEN p_partkey % 4 = 0 THEN concat(p_name, ' a ', p_type) WHEN p_partkey % 4 = 1 THEN p_brand WHEN p_partkey % 4 = 2 THEN concat('THE ', p_type, ' ', p_name) ELSE '' END AS ref")
QA = ", ".join(QA_COLUMNS)


def qa(spark, d):
    """Texts are dear to compare: their rows are dealt out."""
    return dealt(table(spark, d, "part"), 20_000, "p_partkey").selectExpr(*QA_COLUMNS)


@query("normalize_answer", f"WITH qa AS (SELECT {QA} FROM part) SELECT id, {norm_sql('pred')} AS pred_norm, {norm_sql('ref')} AS ref_norm FROM qa")
def normalize_answer(spark, d):
    return qa(spark, d).select("id", text.normalize_answer(F.col("pred")).alias("pred_norm"), text.normalize_answer(F.col("ref")).alias("ref_norm"))


@query("token_f1", f"WITH qa AS (SELECT {QA} FROM part), {F1_SQL} SELECT id, round(f1, 9) AS f1 FROM f1")
def token_f1(spark, d):
    return qa(spark, d).select("id", F.round(text.token_f1(F.col("pred"), F.col("ref")), 9).alias("f1"))


@query(
    "answer_scores",
    f"""WITH qa AS (SELECT {QA} FROM part), {F1_SQL}, m AS (SELECT id, pred, ref, ['exact', 'normalized_exact', 'qa_f1_en'][id % 3 + 1] AS metric FROM qa)
 SELECT id, metric, round(CASE metric WHEN 'exact' THEN CAST(pred = ref AS DOUBLE) WHEN 'normalized_exact' THEN CAST({norm_sql('pred')} = {norm_sql('ref')} AS DOUBLE) ELSE f1 END, 9) AS answer_score,
 CASE metric WHEN 'exact' THEN pred = ref WHEN 'normalized_exact' THEN {norm_sql('pred')} = {norm_sql('ref')} ELSE f1 = 1.0 END AS answer_correct FROM m JOIN f1 USING (id)""",
)
def answer_scores(spark, d):
    metric = F.element_at(F.array(F.lit("exact"), F.lit("normalized_exact"), F.lit("qa_f1_en")), (F.col("id") % 3 + 1).cast("int"))
    x = qa(spark, d).withColumn("metric", metric)
    x = x.withColumn("s", text.answer_score(F.col("metric"), F.col("pred"), F.array("ref")))
    return x.select("id", "metric", F.round("s", 9).alias("answer_score"), (F.col("s") == 1.0).alias("answer_correct"))


VARIANTS = "CASE event_id % 8 WHEN 0 THEN concat('[', props, ']') WHEN 1 THEN concat(props, 'x') WHEN 2 THEN concat(props, ' ', props) WHEN 3 THEN concat('{\"v\":', props) WHEN 4 THEN '\"text\"' WHEN 5 THEN concat(' ', props, ' ') ELSE props END"


@query("strict_json", f"WITH x AS (SELECT event_id, {VARIANTS} AS generated FROM events) SELECT event_id, json_valid(generated) AND starts_with(trim(generated), '{{') AS valid_json FROM x")
def strict_json(spark, d):
    return table(spark, d, "events").selectExpr("event_id", f"{VARIANTS} AS generated").select("event_id", text.is_json_object(F.col("generated")).alias("valid_json"))


QUOTES = "CASE WHEN doc_id % 5 = 0 THEN {a}() WHEN doc_id % 5 = 1 THEN {a}(substring(text, 11, 20), 'not to be found') ELSE {a}(substring(text, 3, 15), substring(text, 40, 9)) END"


@query("quote_support", f"WITH x AS (SELECT doc_id, text, {QUOTES.format(a='list_value').replace('list_value()', 'CAST([] AS VARCHAR[])')} AS quotes, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 7 <> 1 END AS flag FROM documents), y AS (SELECT doc_id, coalesce(flag, len(quotes) > 0) AS applicable, len(quotes) > 0 AND len(list_filter(quotes, lambda q: NOT contains(text, q))) = 0 AS ok, len(list_filter(quotes, lambda q: q = 'not to be found')) > 0 AS has FROM x) SELECT doc_id, applicable, CASE WHEN applicable THEN ok END AS supported, CASE WHEN applicable THEN has END AS recalled FROM y")
def quote_support(spark, d):
    x = table(spark, d, "documents").selectExpr("doc_id", "text", f"{QUOTES.format(a='array').replace('array()', 'cast(array() as array<string>)')} AS quotes", "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 7 <> 1 END AS flag")
    applicable = F.coalesce("flag", F.size("quotes") > 0)
    return x.select("doc_id", applicable.alias("applicable"), F.when(applicable, text.quotes_supported(F.col("quotes"), F.col("text"))).alias("supported"), F.when(applicable, text.is_superset(F.col("quotes"), F.array(F.lit("not to be found")))).alias("recalled"))


@query("token_counts", f"SELECT doc_id, CAST(len(regexp_extract_all(text, {TOKEN_SQL})) AS BIGINT) AS tokens, CAST(len(regexp_extract_all('You answer.' || chr(10) || chr(10) || text, {TOKEN_SQL})) AS BIGINT) AS chat_tokens FROM documents")
def token_counts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.token_count(t).cast("bigint").alias("tokens"), text.chat_tokens(F.lit("You answer."), t).cast("bigint").alias("chat_tokens"))


OPTIONS = "CASE o_orderkey % 9 WHEN 0 THEN '{\"answer\": \"C\", \"evid' WHEN 1 THEN ' (b). ' WHEN 2 THEN 'The answer is A because option A fits' WHEN 3 THEN 'answer is A or option B' WHEN 4 THEN 'nothing here' WHEN 5 THEN '' WHEN 6 THEN 'I think choice: d' WHEN 7 THEN 'D' ELSE o_orderpriority END"
PARSED = "CASE WHEN o_orderkey % 5 = 0 THEN ' a ' WHEN o_orderkey % 5 = 1 THEN 'E' END"


@query(
    "option_letters",
    f"""WITH x AS (SELECT o_orderkey, {OPTIONS} AS generated, upper(trim({PARSED})) AS given FROM orders),
 y AS (SELECT o_orderkey, given, upper(regexp_extract(generated, '(?i)["'']answer["'']\\s*:\\s*["'']?([ABCD])["'']?', 1)) AS j, upper(regexp_extract(generated, '(?i)^[\\s\\(\\[]*([ABCD])[\\s\\)\\].,:;!-]*$', 1)) AS b,
  list_distinct(list_transform(regexp_extract_all(generated, '(?i)\\b(?:the\\s+)?(?:answer|option|choice)\\s*(?:is|=|:)?\\s*[\\(\\[]?([ABCD])[\\)\\]]?\\b', 1), lambda v: upper(v))) AS s FROM x)
 SELECT o_orderkey, CASE WHEN given IN ('A', 'B', 'C', 'D') THEN given WHEN j <> '' THEN j WHEN b <> '' THEN b WHEN len(s) = 1 THEN s[1] END AS letter,
  CASE WHEN given IN ('A', 'B', 'C', 'D') THEN 'parsed_json' WHEN j <> '' THEN 'truncated_or_embedded_json' WHEN b <> '' THEN 'bare_option' WHEN len(s) = 1 THEN 'explicit_answer_phrase' ELSE 'unextractable' END AS source FROM y""".replace("\\\\", "\\"),
)
def option_letters(spark, d):
    x = table(spark, d, "orders").selectExpr("o_orderkey", f"{OPTIONS} AS generated", f"{PARSED} AS parsed")
    letter, source = text.option_letter(F.col("parsed"), F.col("generated"))
    return x.select("o_orderkey", letter.alias("letter"), source.alias("source"))


@query("rescore_disagreements", "WITH x AS (SELECT p_brand, p_size % 3 AS stored, CAST(p_partkey % 2 AS INT) AS rescored FROM part) SELECT p_brand, count(*) FILTER (stored IN (0, 1) AND stored <> rescored) AS disagreements, count(*) FILTER (stored IN (0, 1)) AS comparable FROM x GROUP BY p_brand")
def rescore_disagreements(spark, d):
    x = table(spark, d, "part").selectExpr("p_brand", "p_size % 3 AS stored", "CAST(p_partkey % 2 AS INT) AS rescored")
    known = F.col("stored").isin(0, 1)
    return x.groupBy("p_brand").agg(F.count_if(known & (F.col("stored") != F.col("rescored"))).alias("disagreements"), F.count_if(known).alias("comparable"))


@query("position_labels", "SELECT DISTINCT l_discount, 'p' || lpad(CAST(CAST(round_even(l_discount * 12.5 * 100, 0) AS INT) AS VARCHAR), 3, '0') AS label FROM lineitem WHERE l_discount * 12.5 <= 1")
def position_labels(spark, d):
    x = table(spark, d, "lineitem").select("l_discount").where("l_discount * 12.5D <= 1").distinct()
    return x.select("l_discount", text.position_label(F.col("l_discount") * F.lit(12.5)).alias("label"))


CHAT = "array_sort(collect_list(struct(turn, role, text AS content)))"


@query(
    "merged_chats",
    """WITH c AS (SELECT conv_id, list(role ORDER BY turn, role, text) AS roles, list(text ORDER BY turn, role, text) AS texts FROM conversations GROUP BY conv_id)
 SELECT conv_id, CASE WHEN roles[1] = 'system' THEN CASE WHEN roles[2] = 'user' THEN len(roles) - 1 END ELSE len(roles) END AS n_messages,
  CASE WHEN roles[1] = 'system' THEN CASE WHEN roles[2] = 'user' THEN texts[1] || chr(10) || chr(10) || texts[2] END ELSE texts[1] END AS first_content FROM c""",
)
def merged_chats(spark, d):
    chats = table(spark, d, "conversations").groupBy("conv_id").agg(F.expr(CHAT).alias("c"))
    m = text.merge_system(F.transform("c", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))))
    return chats.select("conv_id", m.alias("m")).select("conv_id", F.when(F.col("m").isNotNull(), F.size("m")).cast("bigint").alias("n_messages"), F.get("m", F.lit(0))["content"].alias("first_content"))


@query("chat_roles", "WITH c AS (SELECT conv_id, list(role ORDER BY turn, role, text) AS roles FROM conversations GROUP BY conv_id) SELECT conv_id, array_to_string(roles, ',') AS roles, roles = ['system', 'user', 'assistant'] AS is_triple FROM c")
def chat_roles(spark, d):
    chats = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.expr(CHAT), lambda x: x["role"]).alias("r"))
    return chats.select("conv_id", F.array_join("r", ",").alias("roles"), (F.col("r") == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))).alias("is_triple"))


@query(
    "completion_masks",
    """WITH x AS (SELECT p_partkey, range(0, CAST(p_size AS BIGINT) % 7) AS prompt, CASE WHEN p_partkey % 10 = 3 THEN range(1, 9) ELSE range(0, 9) END AS full_ids FROM part)
 SELECT p_partkey, CASE WHEN full_ids[1:len(prompt)] = prompt THEN repeat('0', CAST(len(prompt) AS INT)) || repeat('1', CAST(len(full_ids) - len(prompt) AS INT)) END AS mask, CASE WHEN full_ids[1:len(prompt)] = prompt THEN true END AS is_suffix FROM x""",
)
def completion_masks(spark, d):
    seq = lambda n: f"transform(filter(sequence(0, 20), i -> i < {n}), i -> i)"
    x = table(spark, d, "part").selectExpr("p_partkey", f"{seq('p_size % 7')} AS prompt", "CASE WHEN p_partkey % 10 = 3 THEN sequence(1, 8) ELSE sequence(0, 8) END AS full_ids")
    x = x.withColumn("m", text.completion_mask(F.col("prompt"), F.col("full_ids")))
    return x.select("p_partkey", F.array_join(F.transform("m", lambda v: v.cast("string")), "").alias("mask"), text.is_suffix_mask(F.col("m")).alias("is_suffix"))


@query("assistant_payloads", """WITH x AS (SELECT item_id, text, ['answer', 'evidence_id', 'evidence'][item_id % 3 + 1] AS mode FROM benchmark)
 SELECT item_id, sha256('{"answer": ' || to_json(substr(text, 1, 9)) || ', "confidence": 1.0, "evidence_ids": ' || CASE WHEN mode <> 'answer' THEN '["e-' || item_id || '", "f"]' ELSE '[]' END || ', "evidence_quotes": ' || CASE WHEN mode = 'evidence' THEN '[' || to_json(text) || ']' ELSE '[]' END || '}') AS payload_sha256 FROM x""")
def assistant_payloads(spark, d):
    mode = F.element_at(F.array(F.lit("answer"), F.lit("evidence_id"), F.lit("evidence")), (F.col("item_id") % 3 + 1).cast("int"))
    p = text.assistant_payload(mode, F.substring("text", 1, 9), F.array(F.concat(F.lit("e-"), F.col("item_id").cast("string")), F.lit("f")), F.array("text"))
    return table(spark, d, "benchmark").select("item_id", F.sha2(p, 256).alias("payload_sha256"))


LATEX = "p_brand || '_50%\\&' || p_size"


@query("latex_labels", "SELECT p_partkey, replace(replace(replace(replace(replace(replace(" + LATEX + ", '\\', chr(1)), '&', '\\&'), '%', '\\%'), '#', '\\#'), '_', '\\_'), chr(1), '\\textbackslash{}') AS escaped FROM part")
def latex_labels(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.concat(F.col("p_brand"), F.lit("_50%\\&"), F.col("p_size").cast("string")).alias("x"))
    return x.select("p_partkey", text.latex_escape(F.col("x")).alias("escaped"))


@query("finite_values", "SELECT event_id, value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value) AS finite FROM events")
def finite_values(spark, d):
    return table(spark, d, "events").select("event_id", text.is_finite(F.col("value")).alias("finite"))


@query("continued_books", "SELECT a.doc_id, CASE WHEN length(b.text) > length(a.text) THEN sha256(a.text || substr(b.text, length(a.text) + 1)) END AS book_sha256 FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def continued_books(spark, d):
    a = table(spark, d, "documents").select("doc_id", F.col("text").alias("normal"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("normal").alias("long"))
    return a.join(b, "doc_id").select("doc_id", F.sha2(text.continued_book(F.col("normal"), F.col("long")), 256).alias("book_sha256"))


@query("fingerprints", "SELECT doc_id, sha256(text) AS text_sha256, sha256(to_json(text)) AS fingerprint, CAST('0x' || substr(sha256(source || chr(31) || doc_id), 1, 15) AS BIGINT) % 97 AS small_seed FROM documents")
def fingerprints(spark, d):
    seed = hashing.seed_of("source", F.col("doc_id").cast("string"))
    top = F.floor(seed / 16).cast("bigint")
    return table(spark, d, "documents").select("doc_id", hashing.stable_hash("text").alias("text_sha256"), hashing.fingerprint(F.col("text")).alias("fingerprint"), F.pmod(top, F.lit(97)).alias("small_seed"))


@query("safe_contexts", """SELECT conv_id, turn, CASE WHEN regexp_full_match(role, '[A-Za-z0-9_.:/+\\-]{1,128}') THEN role END AS role, CASE WHEN NOT regexp_full_match(role, '[A-Za-z0-9_.:/+\\-]{1,128}') THEN sha256(to_json(role)) END AS role_sha256,
 CASE WHEN regexp_full_match(text, '[A-Za-z0-9_.:/+\\-]{1,128}') THEN text END AS text, CASE WHEN NOT regexp_full_match(text, '[A-Za-z0-9_.:/+\\-]{1,128}') THEN sha256(to_json(text)) END AS text_sha256 FROM conversations""".replace("\\\\", "\\"))
def safe_contexts(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", *hashing.safe_context(["role", "text"]))


#: The folders of a made-up machine, and texts with its paths, look-alikes and credentials.
FOLDERS = ("/srv/tree", "/root/runtime", "/home/", "checkout", "pilot")
PATHS = (
    "concat('see ', CASE page_id % 7 WHEN 0 THEN '/srv/tree/a.py' WHEN 1 THEN '/home/ann/x/y/checkout/b.py' WHEN 2 THEN '/root/runtime/models/m1 /root/runtime/models/m2' WHEN 3 THEN '\"/root/runtime\"' "
    "WHEN 4 THEN '/root/runtime/pilot/c' WHEN 5 THEN 'x/root/y a/home/z /homes/b' ELSE '/srv/trees' END, ' in ', CASE page_id % 5 WHEN 0 THEN '/home/bob/notes' WHEN 1 THEN '/root/runtimes' WHEN 2 THEN '/root/runtime' WHEN 3 THEN '_/root/q' ELSE url END, "
    "CASE page_id % 11 WHEN 0 THEN ' PassWord : x' WHEN 1 THEN ' BEGIN OPENSSH PRIVATE KEY' WHEN 2 THEN ' BEGIN EC PRIVATE KEY' WHEN 3 THEN ' passwords = x' WHEN 4 THEN ' 密码：1' ELSE '' END)"
)
REWRITES_SQL = ((r"/srv/tree/", ""), (r"/root/runtime/pilot/", ""), (r"/home/[^/]+/(?:[^/]+/)*checkout/", ""), (r"/root/runtime/models/", "models/"), (r"/root/runtime(/|\s|[\"''{}]|$)", r"runtime\1"))


def rewritten_sql() -> str:
    """Texts t0 to t5 after each rewrite, and the rewrites so far."""
    out = f"t0 AS (SELECT page_id, {PATHS} AS raw, raw AS t, 0 AS n FROM pages)"
    for k, (pattern, new) in enumerate(REWRITES_SQL):
        out += f", t{k + 1} AS (SELECT page_id, raw, regexp_replace(t, '{pattern}', '{new}', 'g') AS t, n + len(regexp_extract_all(t, '{pattern}')) AS n FROM t{k})"
    return out + r""", x AS (SELECT *, regexp_matches(t, '(?:^|[^A-Za-z0-9_])/(?:root|home)/[^\s"''{}]+') AS path, regexp_matches(raw, '(?i)(?:password|密码)\s*[:：=]') OR regexp_matches(raw, 'BEGIN (?:RSA |OPENSSH )?PRIVATE KEY') AS secret FROM t5)"""


@query("sanitized_paths", f"WITH {rewritten_sql()} SELECT page_id, CASE WHEN NOT (path OR secret) THEN t END AS text, n::INT AS rewrites, path OR secret AS refused FROM x")
def sanitized_paths(spark, d):
    x = table(spark, d, "pages").selectExpr("page_id", f"{PATHS} AS t")
    t, n, refused = hashing.sanitize(F.col("t"), hashing.release_rewrites(*FOLDERS))
    return x.select("page_id", t.alias("text"), n.cast("int").alias("rewrites"), refused.alias("refused"))


@query("refused_texts", f"WITH {rewritten_sql()} SELECT path, secret, count(*) AS n FROM x GROUP BY path, secret")
def refused_texts(spark, d):
    """How many texts are refused, and why."""
    x = table(spark, d, "pages").selectExpr("page_id", f"{PATHS} AS t")
    secret = F.col("t").rlike(hashing.SECRETS[0]) | F.col("t").rlike(hashing.SECRETS[1])
    refused = hashing.sanitize(F.when(~secret, F.col("t")).otherwise(F.lit("")), hashing.release_rewrites(*FOLDERS))[2]
    free = hashing.sanitize(F.regexp_replace("t", "(?i)password|密码|PRIVATE", "x"), hashing.release_rewrites(*FOLDERS))[2]
    return x.select(free.alias("path"), secret.alias("secret"), refused.alias("r")).groupBy("path", "secret").agg(F.count(F.lit(1)).alias("n"))
