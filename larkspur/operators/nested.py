"""Nested JSON as rows: a walk to (path, value), and what audits and reports need of it.

A text is parsed once to a VARIANT.  Each step of the walk turns every container into its members in place and leaves the rest, so after
as many steps as the texts are deep all rows are leaves, in one pass without a shuffle.  Names come out of the parser, with escapes
decoded.  A text that does not parse, repeats a name within an object or is deeper than DEEPEST gives no leaves; `unreadable` finds it, and
every audit here counts it as a violation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEEPEST = 32
#: A text's strings, and what is no bracket.
STRING, PLAIN = r'"(?:[^"\\]|\\.)*+"', r"[^\[\]{}]"


def depth(json: Column) -> Column:
    """How deep brackets nest in a JSON text, those within strings aside."""
    marks = F.split(F.regexp_replace(F.regexp_replace(json, STRING, ""), PLAIN, ""), "")
    one = lambda m: F.when(m.isin("[", "{"), 1).when(m.isin("]", "}"), -1).otherwise(0)
    step = lambda a, m: F.struct((a["now"] + one(m)).alias("now"), F.greatest(a["most"], a["now"] + one(m)).alias("most"))
    return F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"])


def _parsed(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key, value (null if the text is not one JSON value and nothing else: it must parse as an element and as a field) and depth."""
    element = F.try_parse_json(F.concat(F.lit("["), F.col(json), F.lit("]")))
    field = F.try_parse_json(F.concat(F.lit('{"v":'), F.col(json), F.lit("}")))
    x = rows.select(F.col(key).alias("key"), element.alias("element"), field.alias("field"), depth(F.col(json)).alias("deep"))
    whole = F.when(F.col("element").isNotNull(), F.try_variant_get("field", "$.v", "variant"))
    return x.select("key", whole.alias("value"), "deep")


def unreadable(rows: DataFrame, key: str, json: str) -> DataFrame:
    """Keys of texts that are null, no JSON, ambiguous or too deep to walk."""
    return _parsed(rows, key, json).where(F.col("value").isNull() | (F.col("deep") > DEEPEST)).select("key")


def walk(rows: DataFrame, key: str, json: str, steps: int | None = None) -> DataFrame:
    """key, path and value of every leaf: a scalar, or an empty container.

    path: (name, place) of each step, the name within an object or the place within an array.  steps: how deep texts are at most, if that is known.
    """
    x = _parsed(rows, key, json).where(F.col("value").isNotNull() & (F.col("deep") <= DEEPEST))
    if steps is None:
        steps = x.agg(F.max("deep")).first()[0] or 0
    x = x.select("key", F.array().cast("array<struct<name: string, place: int>>").alias("path"), "value")
    for _ in range(steps):
        inner = rows.sparkSession.tvf.variant_explode_outer(F.col("value").outer())
        y = x.lateralJoin(inner.select(F.col("pos").alias("_pos"), F.col("key").alias("_name"), F.col("value").alias("_value")))
        leaf = F.col("_pos").isNull()
        place = F.struct(F.col("_name").alias("name"), F.when(F.col("_name").isNull(), F.col("_pos")).alias("place"))
        x = y.select("key", F.when(leaf, F.col("path")).otherwise(F.array_append("path", place)).alias("path"), F.when(leaf, F.col("value")).otherwise(F.col("_value")).alias("value"))
    return x


def forbidden_names(rows: DataFrame, key: str, json: str, names) -> DataFrame:
    """(key, name) of forbidden names at any depth, once for each text; a text that cannot be read has the name NULL."""
    held = F.explode(F.array_distinct(F.array_intersect(F.transform("path", lambda p: p["name"]), F.array(*map(F.lit, names)))))
    found = walk(rows, key, json).select("key", held.alias("name")).distinct()
    return found.unionByName(unreadable(rows, key, json).select("key", F.lit(None).cast("string").alias("name"))).withColumnRenamed("key", key)


def _name(k: int) -> Column:
    return F.try_element_at("path", F.lit(k))["name"]


def _number(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


#: The schemas of reports, and the names under which they keep run intervals and contrasts.
FACTORIAL, TRANSFER = "matched-factorial-analysis-v1", "natural-transfer-analysis-v1"


def flattened_estimands(reports: DataFrame, key: str, json: str) -> DataFrame:
    """key, kind, estimand, statistic and value of the estimates in analysis reports.

    A factorial report keeps them by run and statistic, and by contrast and then statistic; a transfer report by slice
    first.  Estimates that are null in a factorial report are left out.
    """
    x = walk(reports, key, json)
    kinds = x.where((F.size("path") == 1) & (_name(1) == "schema_version")).select("key", F.try_variant_get("value", "$", "string").alias("schema"))
    x = x.join(kinds, "key")
    run = lambda k: F.concat(F.lit("run:"), _name(k))
    contrast = lambda k: F.concat(F.lit("contrast:"), _name(k))
    size, last = F.size("path"), F.element_at("path", -1)["name"] == "estimate"
    pick = lambda estimand, statistic, kind: F.struct(F.lit(kind).alias("kind"), estimand.alias("estimand"), statistic.alias("statistic"))
    found = (
        F.when((F.col("schema") == FACTORIAL) & (size == 4) & (_name(1) == "run_summary_intervals"), pick(run(2), _name(3), "factorial"))
        .when((F.col("schema") == FACTORIAL) & (size == 5) & (_name(1) == "contrasts") & (_name(3) == "statistics"), pick(contrast(2), _name(4), "factorial"))
        .when((F.col("schema") == TRANSFER) & (size == 4) & (_name(1) == "run_intervals"), pick(run(3), _name(2), "natural_transfer"))
        .when((F.col("schema") == TRANSFER) & (size == 4) & (_name(1) == "contrasts"), pick(contrast(3), _name(2), "natural_transfer"))
    )
    y = x.withColumn("x", found).withColumn("number", _number(F.col("value"))).where("x is not null").where(last)
    return y.where("x.kind <> 'factorial' or number is not null").select(F.col("key").alias(key), "x.kind", "x.estimand", "x.statistic", F.col("number").alias("value"))


def position_profiles(reports: DataFrame, key: str, json: str) -> DataFrame:
    """key, run_name, task, target_tokens, position_label and answer_accuracy of the rows of a report's position profiles."""
    x = walk(reports, key, json).where((F.size("path") == 3) & (_name(1) == "position_profiles"))
    of = lambda f, kind: F.max(F.when(_name(3) == f, F.try_variant_get("value", "$", kind))).alias(f)
    g = x.groupBy("key", F.element_at("path", 2)["place"].alias("place")).agg(of("run_name", "string"), of("task", "string"), of("target_tokens", "bigint"), of("position_label", "string"), of("answer_accuracy", "double"))
    return g.drop("place").withColumnRenamed("key", key)


def report_problems(reports: DataFrame, key: str, json: str) -> DataFrame:
    """Violations (rule, key) of analysis reports that are to be aggregated over seeds.

    unreadable; unsupported_schema; several_kinds, for all reports of another kind than the least by name; missing_estimand, for a report without an
    estimand that another one has; null_estimate in a transfer report; repeated_profile and no_profile in a factorial one.
    """
    values = flattened_estimands(reports, key, json)
    named = lambda df, rule: df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))
    kinds = values.select(key, "kind").distinct()
    bad = unreadable(reports, key, json).withColumnRenamed("key", key)
    unsupported = reports.select(key).join(kinds, key, "left_anti").join(bad, key, "left_anti")
    n = reports.agg(F.count_distinct(key).alias("reports"))  # one row
    short = values.groupBy("estimand", "statistic").agg(F.count_distinct(key).alias("n"))
    rare = short.crossJoin(F.broadcast(n)).where("n < reports").select("estimand", "statistic")  # what some lack; usually none
    lacking = kinds.select(key).crossJoin(rare).join(values, [key, "estimand", "statistic"], "left_anti").select(key).distinct()
    least = kinds.agg(F.min("kind").alias("least"))  # one row
    other = kinds.crossJoin(F.broadcast(least)).where("kind <> least")
    cells = position_profiles(reports, key, json).groupBy(key, "run_name", "task", "target_tokens", "position_label").agg(F.count(F.lit(1)).alias("n"))
    again = cells.where("n > 1").select(key).distinct()
    none = kinds.where("kind = 'factorial'").join(cells.select(key).distinct(), key, "left_anti")
    parts = ((bad, "unreadable"), (unsupported, "unsupported_schema"), (other, "several_kinds"), (lacking, "missing_estimand"), (values.where("value is null").select(key).distinct(), "null_estimate"), (again, "repeated_profile"), (none, "no_profile"))
    out = None
    for df, rule in parts:
        out = named(df, rule) if out is None else out.unionByName(named(df, rule))
    return out


#: The scopes of a failure catalog.
SCOPES = ("row", "group", "cross_run")


def catalog_document_problems(catalogs: DataFrame, key: str, json: str, names) -> DataFrame:
    """Violations (rule, key) of stored failure catalogs, as JSON texts, each taken by itself.

    unreadable; forbidden_name; count_names, scope_names and rate_names, where counts, scopes and rates are not of the same categories, or no
    whole numbers of 0 or more; unknown_scope; denominators that are not just those of the scopes; wrong_rate, beyond 1e-15
    of count by denominator; limit, no positive whole number; example_scope, an example whose category or scope is not the catalog's;
    too_many, more examples of a category than the limit.
    """
    x = walk(catalogs, key, json)
    number, text = _number(F.col("value")), F.try_variant_get("value", "$", "string")
    whole = F.when(F.schema_of_variant("value") == "BIGINT", F.try_variant_get("value", "$", "bigint"))
    top = lambda name, size: (F.size("path") == size) & (_name(1) == name)
    of = lambda name, v, alias: F.max(F.when(F.col("part") == name, v)).alias(alias)
    parts = ("category_counts", "category_scopes", "category_rates")
    by_category = x.where((F.size("path") == 2) & _name(1).isin(*parts)).select("key", _name(1).alias("part"), _name(2).alias("category"), number.alias("number"), text.alias("text"), whole.alias("whole"))
    c = by_category.groupBy("key", "category").agg(of(parts[0], F.col("whole"), "count"), of(parts[1], F.col("text"), "scope"), of(parts[2], F.col("number"), "rate"))
    d = x.where(top("scope_denominators", 2)).select("key", _name(2).alias("scope"), whole.alias("denominator"))
    limits = x.where(top("max_examples_per_category", 1)).select("key", whole.alias("limit"))
    e = x.where(top("examples", 3)).groupBy("key", F.element_at("path", 2)["place"].alias("place")).agg(F.max(F.when(_name(3) == "category", text)).alias("category"), F.max(F.when(_name(3) == "scope", text)).alias("scope"))
    readable = x.select("key").distinct()
    known = F.col("scope").isin(*SCOPES)
    held = d.groupBy("key").agg(F.sort_array(F.collect_set("scope")).alias("scopes"), F.bool_and(F.coalesce(F.col("denominator") >= 0, F.lit(False))).alias("fine"))
    expected = F.array(*map(F.lit, sorted(SCOPES)))
    no_denominators = readable.join(held, "key", "left").where(~F.coalesce((F.col("scopes") == expected) & F.col("fine"), F.lit(False)))
    share = F.when(F.col("denominator") > 0, F.col("count") / F.col("denominator")).otherwise(F.lit(0.0))
    rates = c.join(d, ["key", "scope"]).where(F.abs(F.col("rate") - share) > 1e-15)
    odd = e.join(c.select("key", "category", F.col("scope").alias("told")), ["key", "category"], "left").where(~F.coalesce(F.col("scope") == F.col("told"), F.lit(False)))
    many = e.groupBy("key", "category").agg(F.count(F.lit(1)).alias("n")).join(limits, "key").where("n > limit")
    rules = (
        (unreadable(catalogs, key, json), "unreadable"),
        (forbidden_names(catalogs, key, json, names).where("name is not null").select(F.col(key).alias("key")), "forbidden_name"),
        (c.where(~F.coalesce(F.col("count") >= 0, F.lit(False))), "count_names"),
        (c.where("scope is null"), "scope_names"),
        (c.where("rate is null"), "rate_names"),
        (c.where(F.col("scope").isNotNull() & ~known), "unknown_scope"),
        (no_denominators, "denominators"),
        (rates, "wrong_rate"),
        (readable.join(limits.where("limit > 0"), "key", "left_anti"), "limit"),
        (odd, "example_scope"),
        (many, "too_many"),
    )
    out = None
    for df, rule in rules:
        y = df.select(F.lit(rule).alias("rule"), F.col("key").cast("string").alias("key")).distinct()
        out = y if out is None else out.unionByName(y)
    return out
