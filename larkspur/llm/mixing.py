"""Mixing sources to target weights: a temperature on token shares, met by bisection, realised by block permutations.

A source with share p of all tokens gets the weight p^a / sum(p^a).  The exponent a lies in [0, 1]: 1 keeps the shares,
0 makes all sources equal.  It is bisected to the largest a whose weights have the target entropy (a share of
log(number of sources)), or to the least a under which no source is repeated more often than a limit at the budget that
really goes out.  Each step of the search looks at 2^LEVELS parts of the bracket in one aggregation over the sources, that is LEVELS bisections at once.

The budget is `budget_ratio` times the tokens there are, or with None what the weights need for every source to be
used once at least.  A source whose budget is e times its tokens goes out in floor(e) whole permutations and a part of
a further one.  Every permutation orders the documents by a hash of (seed, pass, doc_id), cut into blocks of hash
ranges with about `block_docs` documents; the part takes whole blocks in order and, of the block in which the budget
ends, the documents before that end.  So a cumulative sum runs over the blocks of a source and within single blocks,
never over all documents of a source; a source with a third of all rows is as many blocks as others together.

All of it is DataFrame code.  To the driver come 2^LEVELS + 1 numbers for each round of the search.

Defined results: null sources are one source named ''; a document without words has weight 0 and goes with its hash order;
equal rows are ordered by doc_id and each is taken; null doc_ids share one key and come first among equals; one source has
weight 1; a very long text is counted whole and is one document of its block; an empty table gives no rows; the columns that are
added are those of ADDED, all others come back as they were, and where docs has one of these names it keeps its own column and the
added one is left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, table

LEVELS, ROUNDS = 6, 5
SEED = 17
BLOCK_DOCS = 1000
#: Blocks of a source whose running sum is taken at once; a source of 10^12 documents has 10^6 such runs.
RUN = 1000
ENTROPY = 0.97
MAX_REPEATS = 4.0
#: Up to so many sources their quotas (under 100 bytes each) are broadcast; beyond, they are joined, and Spark splits skewed keys.
BROADCAST_SOURCES = 20_000


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_shares(counted: DataFrame) -> DataFrame:
    """mix_source, tokens, docs, log share, for sources with tokens."""
    by = counted.groupBy("mix_source").agg(F.sum("mix_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    total = by.agg(F.sum("tokens").alias("total"), F.count_if(F.col("tokens") > 0).alias("sources"))
    return by.join(F.broadcast(total)).withColumn("log_share", F.when(F.col("tokens") > 0, F.log(F.col("tokens") / F.col("total"))))


def bracket(shares: DataFrame, low: float, high: float) -> list:
    """Entropy, largest repetition per budget of all tokens, and that under the covering budget, at 2^LEVELS + 1 exponents; one aggregation over the sources."""
    n = 1 << LEVELS
    grid = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.lit(low) + k * F.lit((high - low) / n))
    x = F.col("a") * F.col("log_share")
    e = shares.where("log_share is not null").select("log_share", F.explode(grid).alias("a"))
    s = e.groupBy("a").agg(F.sum(F.exp(x)).alias("z"), F.sum(F.exp(x) * x).alias("zx"), F.max(x - F.col("log_share")).alias("worst"), F.max(F.col("log_share") - x).alias("need"))
    return s.select("a", (F.log("z") - F.col("zx") / F.col("z")).alias("entropy"), (F.exp("worst") / F.col("z")).alias("repeats"), F.exp(F.col("worst") + F.col("need")).alias("covering_repeats")).orderBy("a").collect()


def find_exponent(shares: DataFrame, sources: int, entropy: float | None, max_repeats: float | None, ratio: float | None) -> float:
    """The largest exponent that reaches the entropy, raised as far as the repetition limit asks; ratio None is the covering budget."""
    found = []
    for limit in ("entropy", "repeats"):
        if (entropy if limit == "entropy" else max_repeats) is None or sources < 2:
            continue
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            rows = bracket(shares, low, high)
            # Entropy falls and the worst repetition falls as the exponent rises.
            if limit == "entropy":
                fine = [r.a for r in rows if r.entropy >= entropy * math.log(sources) - 1e-12]
                edge = max(fine, default=low)
            else:
                fine = [r.a for r in rows if (r.covering_repeats if ratio is None else r.repeats * ratio) <= max_repeats + 1e-12]
                edge = min(fine, default=high)
            step = (high - low) / (1 << LEVELS)
            low, high = (edge, min(high, edge + step)) if limit == "entropy" else (max(low, edge - step), edge)
        found.append(low if limit == "entropy" else high)
    if not found:
        return 1.0
    return found[0] if len(found) == 1 and entropy is not None else max(found)


def plan(counted: DataFrame, entropy: float | None = ENTROPY, max_repeats: float | None = MAX_REPEATS, budget_ratio: float | None = 1.0) -> tuple[DataFrame, int]:
    """A row for each source (mix_source, tokens, docs, exponent, weight, budget: the tokens to go out), and their number."""
    shares = cut(source_shares(counted))
    sources, rows = shares.agg(F.coalesce(F.max("sources"), F.lit(0)), F.count(F.lit(1))).first()
    a = find_exponent(shares, sources, entropy, max_repeats, budget_ratio)
    raw = F.when(F.col("log_share").isNotNull(), F.exp(F.lit(a) * F.col("log_share"))).otherwise(F.lit(0.0))
    total = shares.agg(F.sum(raw).alias("z"), F.max(F.try_divide(F.col("tokens").cast("double"), raw)).alias("need"), F.max("total").alias("all_tokens"))
    goal = F.coalesce(F.col("need") * F.col("z"), F.lit(0.0)) if budget_ratio is None else F.lit(float(budget_ratio)) * F.col("all_tokens")
    weight = F.coalesce(F.try_divide(raw, F.col("z")), F.lit(0.0))
    # A relative 1e-9 keeps a budget of exactly so many passes from losing its last document to rounding.
    budget = F.floor(weight * goal * F.lit(1 + 1e-9) + F.lit(0.5)).cast("bigint")
    return shares.join(F.broadcast(total)).select("mix_source", "tokens", "docs", F.lit(a).alias("exponent"), weight.alias("weight"), budget.alias("budget")), rows


def order_key(i: Column, seed: int) -> Column:
    """60 bits of a hash of (seed, pass, doc_id), as bigint."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("mix_pass").cast("string"), i.cast("string"))), 1, 15), 16, 10).cast("bigint")


ADDED = ("mix_source", "mix_pass", "mix_tokens", "mix_key")


def mix(docs: DataFrame, *, tokens: Column | None = None, entropy: float | None = ENTROPY, max_repeats: float | None = MAX_REPEATS, budget_ratio: float | None = 1.0, block_docs: int = BLOCK_DOCS, seed: int = SEED) -> DataFrame:
    """Rows of docs as often as the mixture takes them, with mix_pass, mix_tokens and mix_key (the order within a source)."""
    tokens = token_count(F.col("text")) if tokens is None else tokens
    taken = [c for c in docs.columns if c.lower() in ADDED]
    if taken:
        # Columns of these names travel under others and come back as they were; the added ones then go without.
        aside = {c: f"__larkspur_{c}" for c in taken}
        back = {v: k for k, v in aside.items()}
        out = mix(docs.withColumnsRenamed(aside), tokens=tokens, entropy=entropy, max_repeats=max_repeats, budget_ratio=budget_ratio, block_docs=block_docs, seed=seed)
        return out.drop(*(c for c in ADDED if c in {x.lower() for x in taken})).withColumnsRenamed(back)
    rows = docs.withColumn("mix_source", F.coalesce(F.col("source"), F.lit(""))).withColumn("mix_tokens", tokens)
    sources, n_sources = plan(rows.select("mix_source", "mix_tokens"), entropy, max_repeats, budget_ratio)
    quota = sources.select("mix_source", "budget", "tokens", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(1)).cast("bigint").alias("mix_full"), F.greatest(F.lit(1), F.ceil(F.col("docs") / F.lit(block_docs))).cast("bigint").alias("mix_blocks"))
    quota = cut(quota.withColumn("mix_rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("mix_full") * F.col("tokens")).otherwise(F.lit(0)).cast("bigint")).drop("budget", "tokens"))

    near = F.broadcast if n_sources <= BROADCAST_SOURCES else (lambda x: x)

    # The part of a pass: which blocks go out whole, and in which the budget ends.
    def keyed(x: DataFrame) -> DataFrame:
        key = order_key(F.col("doc_id"), seed)
        return x.withColumn("mix_key", key).withColumn("mix_block", F.floor(F.col("mix_key") / F.lit(float(1 << 60)) * F.col("mix_blocks")).cast("bigint"))

    light = rows.select("doc_id", "mix_source", "mix_tokens").join(near(quota), "mix_source")
    part = keyed(light.withColumn("mix_pass", F.col("mix_full")))
    blocks = part.groupBy("mix_source", "mix_block").agg(F.sum("mix_tokens").alias("block_tokens"), F.first("mix_rest").alias("mix_rest"))
    # Running sums over the blocks of a source, in two levels: over RUN blocks each, and over these runs.
    blocks = cut(blocks.withColumn("mix_run", F.floor(F.col("mix_block") / F.lit(RUN)).cast("bigint")))
    upto = lambda *by: Window.partitionBy("mix_source", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = blocks.groupBy("mix_source", "mix_run").agg(F.sum("block_tokens").alias("run_tokens"))
    runs = runs.withColumn("run_before", F.sum("run_tokens").over(upto("mix_run")) - F.col("run_tokens")).drop("run_tokens")
    blocks = blocks.join(runs, ["mix_source", "mix_run"]).withColumn("upto", F.col("run_before") + F.sum("block_tokens").over(upto("mix_run", "mix_block"))).withColumn("before", F.col("upto") - F.col("block_tokens"))
    # The block in which the budget ends is the first that does not fit whole; before it all go out.
    last = cut(blocks.where("upto > mix_rest").groupBy("mix_source").agg(F.min_by(F.struct("mix_block", "before"), "mix_block").alias("x")).select("mix_source", F.col("x.mix_block").alias("end_block"), F.col("x.before").alias("end_before")))
    inner = Window.partitionBy("mix_source", "mix_block").orderBy("mix_key", "doc_id", "mix_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = part.join(near(last), "mix_source").where("mix_block = end_block").withColumn("run", F.col("end_before") + F.sum("mix_tokens").over(inner))
    # The key of the first document that no longer fits; equal keys go by doc_id.
    edge = fits.where("run > mix_rest").groupBy("mix_source").agg(F.min(F.struct("mix_key", "doc_id")).alias("mix_edge"))
    quota = cut(quota.join(edge, "mix_source", "left"))

    spread = rows.join(near(quota), "mix_source").withColumn("mix_pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("mix_full"))))
    spread = spread.withColumn("mix_key", order_key(F.col("doc_id"), seed))
    whole = F.col("mix_pass") < F.col("mix_full")
    within = F.when(F.col("mix_edge").isNull(), F.col("mix_rest") > 0).otherwise(F.struct("mix_key", "doc_id") < F.col("mix_edge"))
    return spread.where(whole | (within & (F.col("mix_rest") > 0))).select(*docs.columns, "mix_source", "mix_pass", "mix_tokens", "mix_key")


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it: doc_id, source, pass, tokens, order key within its source and pass."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", token_count(F.col("text")).alias("n_tokens"))
    out = mix(docs, tokens=F.col("n_tokens"))
    return out.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_pass").alias("pass"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_key").alias("order_key"))


def sql(entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS, seed: int = SEED) -> str:
    """The same by plain bisection and one cumulative sum over each source."""
    steps = LEVELS * ROUNDS
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS n_tokens FROM documents
), s AS (
  SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens, sum(n_tokens) / sum(sum(n_tokens)) OVER () AS p FROM d GROUP BY source
), pos AS (SELECT ln(p) AS lp FROM s WHERE tokens > 0),
n AS (SELECT count(*) AS n FROM pos),
ent(k, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT k + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT k, lo, hi, (lo + hi) / 2 AS mid,
           (SELECT ln(sum(exp(((e.lo + e.hi) / 2) * lp))) - sum(exp(((e.lo + e.hi) / 2) * lp) * ((e.lo + e.hi) / 2) * lp) / sum(exp(((e.lo + e.hi) / 2) * lp)) FROM pos)
             >= {entropy} * ln((SELECT n FROM n)) - 1e-12 AS ok
    FROM ent e WHERE k < {steps})
), rep(k, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT k + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT k, lo, hi, (lo + hi) / 2 AS mid,
           (SELECT max(exp(((e.lo + e.hi) / 2 - 1) * lp)) / sum(exp(((e.lo + e.hi) / 2) * lp)) FROM pos) <= {max_repeats} + 1e-12 AS ok
    FROM rep e WHERE k < {steps})
), ends AS (
  SELECT (SELECT lo FROM ent WHERE k = {steps}) AS a1, (SELECT lo FROM rep WHERE k = {steps}) AS l2, (SELECT hi FROM rep WHERE k = {steps}) AS h2
), ex AS (
  SELECT greatest(a1, CASE WHEN l2 = 0 AND (SELECT max(exp(-lp)) / count(*) FROM pos) <= {max_repeats} + 1e-12 THEN 0.0 ELSE h2 END) AS a FROM ends
), w AS (
  SELECT source, tokens, CASE WHEN tokens > 0 THEN exp((SELECT a FROM ex) * ln(p)) ELSE 0.0 END AS raw FROM s
), b AS (
  SELECT source, tokens, CAST(floor(raw / (SELECT sum(raw) FROM w) * (SELECT sum(tokens) FROM w) * (1 + 1e-9) + 0.5) AS BIGINT) AS budget FROM w
), q AS (
  SELECT source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS full_passes, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM b
), e AS (
  SELECT d.*, q.full_passes, q.rest, unnest(range(0, q.full_passes + 1)) AS pass FROM d JOIN q USING (source)
), k AS (
  SELECT *, CAST(('0x' || substr(md5('{seed}:' || pass || ':' || doc_id), 1, 15)) AS BIGINT) AS order_key FROM e
), c AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source, pass ORDER BY order_key, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS run FROM k
), over_at AS (
  SELECT source, min(struct_pack(a := order_key, b := doc_id)) AS edge FROM c WHERE pass = full_passes AND run > rest GROUP BY source
)
SELECT c.doc_id, c.source, CAST(c.pass AS BIGINT) AS pass, c.n_tokens, c.order_key
FROM c LEFT JOIN over_at o USING (source)
WHERE c.pass < c.full_passes OR (c.rest > 0 AND (o.edge IS NULL OR struct_pack(a := c.order_key, b := c.doc_id) < o.edge))
"""


OP4_SQL = sql()
