"""Catalog of failures: row, group and cross-run categories, denominators, rates, privacy-safe examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import fingerprint
from ..lineage import cut

ROW, GROUP, CROSS = "row", "group", "cross_run"


def scored_flags(rows: DataFrame) -> DataFrame:
    """Plain booleans, and null quote flags where quotes do not apply; the support flag's default is the quote flag."""
    quote = F.coalesce("evidence_quotes_applicable", F.lit(True))
    support = F.coalesce(F.col("all_predicted_quotes_supported_applicable"), quote)
    false = F.lit(False)
    return rows.withColumns({"valid_json": F.coalesce("valid_json", false), "answer_correct": F.coalesce("answer_correct", false), "evidence_quotes_correct": F.when(quote, F.col("evidence_quotes_correct")), "all_predicted_quotes_supported": F.when(support, F.col("all_predicted_quotes_supported"))})


def chosen(**categories: Column) -> Column:
    return F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in categories.items()))))


def row_categories(rows: DataFrame) -> DataFrame:
    return scored_flags(rows).withColumn("category", chosen(**row_kinds()))


def row_kinds() -> dict[str, Column]:
    right, quote = F.col("answer_correct"), F.col("evidence_quotes_correct")
    return {"invalid_json": ~F.col("valid_json"), "answer_wrong": ~right, "answer_correct_quote_wrong": right & ~quote, "answer_wrong_quote_correct": ~right & quote, "generation_hit_length_cap": F.col("finish_reason") == "length"}


def group_categories(rows: DataFrame, order: str = "target_position", tie: str = "sample_id") -> DataFrame:
    """Groups of three rows or more: outcomes at the first and last position against those between, and changing answers."""
    return _groups(scored_flags(rows), order, tie).select("run_name", "group_id", chosen(**group_kinds()).alias("category"))


def _groups(flags: DataFrame, order: str, tie: str) -> DataFrame:
    """A row for each group of three or more.  The edges are found by minimum and maximum: no sort of a group."""
    place = F.struct(F.coalesce(F.col(order), F.lit(float("inf"))).alias("p"), F.col(tie).alias("t"), F.col("answer_correct").alias("right"))
    right = F.col("answer_correct").cast("int")
    g = flags.groupBy("run_name", "group_id").agg(F.count(F.lit(1)).alias("n"), F.sum(right).alias("hits"), F.min(place).alias("first"), F.max(place).alias("last"), F.count_distinct("answer").alias("answers"))
    edge = F.col("first.right").cast("int") + F.col("last.right").cast("int")
    return g.where("n >= 3").select("run_name", "group_id", (edge > 0).alias("edge_hit"), (edge < 2).alias("edge_miss"), (F.col("hits") > edge).alias("middle_hit"), (F.col("n") - 2 > F.col("hits") - edge).alias("middle_miss"), "answers")


def group_kinds() -> dict[str, Column]:
    return {"edge_success_middle_failure": F.col("edge_hit") & F.col("middle_miss"), "middle_success_edge_failure": F.col("middle_hit") & F.col("edge_miss"), "answer_changes_across_positions": F.col("answers") > 1}


def cross_run_categories(rows: DataFrame, base: str = "base", key: str = "sample_id") -> DataFrame:
    """Every other run against the base by sample; samples that the base lacks are left out."""
    return _pairs(scored_flags(rows), base, key).select("run_name", key, "group_id", chosen(**cross_kinds()).alias("category"))


def _pairs(flags: DataFrame, base: str, key: str) -> DataFrame:
    b = flags.where(F.col("run_name") == base).select(key, F.col("answer_correct").alias("base_right"), F.col("evidence_quotes_correct").alias("base_quote"))
    # The base is a whole run, whatever size the planner takes it for: no broadcast.
    return flags.where(F.col("run_name") != base).join(b.hint("merge"), key)


def cross_kinds() -> dict[str, Column]:
    right = F.col("answer_correct")
    return {"base_only_answer_success": F.col("base_right") & ~right, "treatment_only_answer_success": ~F.col("base_right") & right, "treatment_quote_recovery": ~F.col("base_quote") & F.col("evidence_quotes_correct")}


def catalog(rows: DataFrame, key: str = "sample_id") -> DataFrame:
    """All categories in one frame: scope, category, run_name, hashes of group and sample."""
    s = lambda c: fingerprint(F.col(c).cast("string"))
    r = row_categories(rows).select(F.lit(ROW).alias("scope"), "category", "run_name", s("group_id").alias("group_sha256"), s(key).alias("sample_sha256"))
    g = group_categories(rows, tie=key).select(F.lit(GROUP).alias("scope"), "category", "run_name", s("group_id").alias("group_sha256"), F.lit(None).cast("string").alias("sample_sha256"))
    c = cross_run_categories(rows, key=key).select(F.lit(CROSS).alias("scope"), "category", "run_name", s("group_id").alias("group_sha256"), s(key).alias("sample_sha256"))
    return r.unionByName(g).unionByName(c)


def _long(counts: DataFrame, scope: str, names: list[str]) -> DataFrame:
    """One row of counts (n, then one for each category) as rows (scope, category, count, denominator)."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("category"), F.col(k).alias("count")) for k in names)))
    return counts.select(F.lit(scope).alias("scope"), each.alias("x"), F.col("n").alias("denominator")).select("scope", "x.category", "x.count", "denominator")


def rates(rows: DataFrame, base: str = "base", key: str = "sample_id") -> DataFrame:
    """Counts and rates of the categories that occur, over rows, groups of three or more, and pairs with the base.

    Categories are counted as conditions in one aggregation for each scope: no row goes out for a failure, and nothing is hashed.
    """
    flags = scored_flags(rows)
    counted = lambda x, kinds: x.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(k) for k, c in kinds.items()))
    parts = ((ROW, flags, row_kinds()), (GROUP, _groups(flags, "target_position", key), group_kinds()), (CROSS, _pairs(flags, base, key), cross_kinds()))
    out = None
    for scope, x, kinds in parts:
        y = _long(counted(x, kinds), scope, list(kinds))
        out = y if out is None else out.unionByName(y)
    return out.where("count > 0").withColumn("rate", F.try_divide(F.col("count"), F.col("denominator")))


#: Fields that a catalog without raw text may not hold, at any depth.
FORBIDDEN = (
    "prompt", "question", "target", "generated_text", "parsed", "answer", "evidence_quote", "sample_id", "group_id", "case_id", "book_id",
    "generated_text_sha256", "parsed_answer_sha256", "base_generated_text_sha256", "treatment_generated_text_sha256",
)


#: Stored examples up to which they are broadcast.
LISTED = 100_000


def tampered(stored: DataFrame, rows: DataFrame, key: str = "sample_id") -> DataFrame:
    """Stored examples (scope, category, run_name, group_sha256, sample_sha256) that no source row gives when it is categorised and hashed again.

    The examples go to the rows and not the rows to the examples: up to LISTED of them are broadcast, and no row that is not among them is shuffled.
    """
    columns = ("scope", "category", "run_name", "group_sha256", "sample_sha256")
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns]
    stored = cut(stored)
    asked = stored.select(*columns).distinct()
    asked = asked.hint("broadcast" if stored.count() <= LISTED else "merge")
    found = catalog(rows, key).alias("f").join(asked.alias("q"), same("f", "q"), "left_semi").distinct()
    return stored.alias("s").join(found.hint("merge").alias("f"), same("s", "f"), "left_anti")


def catalog_problems(stored: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """Violations (rule, key) of a stored catalog (category, scope, count, rate, listed) against a recount of the rows.

    listed: how many examples the catalog lists.  A category that is only on one side, another count, scope or rate, or more
    examples than `most` or than were counted, are violations.
    """
    fresh = rates(rows).select("category", F.col("scope").alias("s"), F.col("count").alias("c"), F.col("rate").alias("r"))
    x = stored.join(fresh, "category", "full_outer")
    from .audits import violations

    both = F.col("c").isNotNull() & F.col("count").isNotNull()
    return violations(x, "category", in_both=both, same_scope=~both | (F.col("scope") == F.col("s")), same_count=~both | (F.col("count") == F.col("c")), same_rate=~both | (F.abs(F.col("rate") - F.col("r")) <= 1e-12), within_limit=~both | (F.col("listed") <= F.least(F.lit(most), F.col("c"))))


def examples(found: DataFrame, most: int) -> DataFrame:
    """The first `most` of each category, by run, group hash and sample hash."""
    w = Window.partitionBy("category").orderBy("run_name", "group_sha256", F.coalesce("sample_sha256", F.lit("")))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
