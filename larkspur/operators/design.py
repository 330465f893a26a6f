"""Selection and assignment: hash order, blocks, round robin, quotas, variants, exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import numbered


def ranked(rows: DataFrame, stratum: list[str], *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*stratum).orderBy(*order)))


def hash_order(seed: int, *parts: Column, prefix: str = "block96") -> Column:
    return F.sha2(F.concat_ws(":", F.lit(prefix), F.lit(str(seed)), *parts), 256)


def block_select(facts: DataFrame, stratum: list[str], fact: str, k: int, seed: int) -> DataFrame:
    """The first k facts of each stratum in the order of their hash, with that rank."""
    return ranked(facts, stratum, hash_order(seed, F.col(fact).cast("string")), fact).where(F.col("rank") <= k)


def short_strata(facts: DataFrame, stratum: list[str], k: int) -> DataFrame:
    return facts.groupBy(*stratum).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < k)


def round_robin(rows: DataFrame, stratum: list[str], order: str, n: int) -> DataFrame:
    """n rows, in turn from each stratum: by rank within the stratum, then by the strata's names."""
    r = ranked(rows, stratum, order).where(F.col("rank") <= n)  # so that no task gets more than n rows of a stratum from another
    return r.orderBy("rank", *(F.col(c).cast("string") for c in stratum)).limit(n)


def evenly_spread(rows: DataFrame, stratum: list[str], order: str, n: int) -> DataFrame:
    """Rows floor(i * N / n) for i below n, of each stratum in its order."""
    x = numbered(rows, stratum, [order], "_i", "_n").withColumn("_i", F.col("_i") - 1)
    # Row j is taken if some i has floor(i N / n) = j.
    i = F.ceil(F.col("_i") * F.lit(n) / F.col("_n"))
    taken = (F.floor(i * F.col("_n") / F.lit(n)) == F.col("_i")) & (i < n)
    return x.where(taken | (F.col("_n") <= n)).drop("_i", "_n")


def hash_split(groups: DataFrame, stratum: list[str], group: str, paired: int, independent: int, positions: list[str], seed: int) -> DataFrame:
    """First `paired` groups of each stratum by hash, then `independent` with one position each in turn."""
    x = ranked(groups, stratum, hash_order(seed, F.col(group).cast("string"), prefix="split"), group).where(F.col("rank") <= paired + independent)
    kind = F.when(F.col("rank") <= paired, "paired").when(F.col("rank") <= paired + independent, "independent")
    at = F.element_at(F.array(*map(F.lit, positions)), ((F.col("rank") - paired - 1) % len(positions) + 1).cast("int"))
    return x.withColumn("kind", kind).where("kind is not null").withColumn("position_label", F.when(F.col("kind") == "independent", at))


def latin_assignment(rows: DataFrame, stratum: list[str], fact: str, replica: str, positions: list[str], seed: int) -> DataFrame:
    """Independent: all replicas of a fact at one position, by the fact's rank in hash order.  Paired: each replica at its own.

    The hashed text is the seed, the stratum as a Python tuple and the fact.
    """
    quoted = [F.concat(F.lit("'"), F.col(c), F.lit("'")) if dict(rows.dtypes)[c] == "string" else F.col(c).cast("string") for c in stratum]
    text = F.concat(F.lit(f"{seed}:("), F.concat_ws(", ", *quoted), F.lit("):"), F.col(fact).cast("string"))
    # Facts are ranked, not rows: a stratum has one row a fact there.
    facts = numbered(rows.select(*stratum, fact).distinct(), stratum, [F.sha2(text, 256), fact], "_f").withColumn("_f", F.col("_f") - 1)
    x = rows.withColumn("_r", F.dense_rank().over(Window.partitionBy(*stratum, fact).orderBy(replica)) - 1)
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"f.{c}")) for c in (*stratum, fact)]
    label = lambda k: F.element_at(F.array(*map(F.lit, positions)), (k % len(positions) + 1).cast("int"))
    joined = x.alias("x").join(facts.alias("f"), same)
    return joined.select(*(F.col(f"x.{c}") for c in rows.columns), label(F.col("_f")).alias("independent_position"), label(F.col("_r")).alias("paired_position"))


def quota(total: int, keys: int, rank: Column) -> Column:
    """A balanced share of a total: the remainder goes to the first keys.  rank counts from 0."""
    return F.lit(total // keys) + (rank < total % keys).cast("int")


def to_chat(rows: DataFrame, variant: str, matched: bool = False) -> DataFrame:
    """Chat training rows: id = variant:sample_id, three messages, nested metadata.

    matched: rows of the matched design (v2), whose variant is <pairing>_<supervision> and which name fact and replica.
    """
    m = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    if matched:
        more = [F.col("fact_id"), F.col("replica_index"), F.lit(variant.split("_", 1)[0]).alias("pairing_mode"), F.lit(variant.split("_", 1)[1]).alias("supervision_mode"), F.lit("matched-position-v1").alias("training_design")]
    else:
        more = []
    return rows.select(F.lit("position-sft-v2" if matched else "position-sft-v1").alias("schema_version"), F.concat_ws(":", F.lit(variant), "sample_id").alias("id"), F.array(m("system", "system_prompt"), m("user", "prompt"), m("assistant", "answer")).alias("messages"), F.struct(F.lit(variant).alias("variant"), F.col("sample_id").alias("raw_sample_id"), "group_id", "position_label", *more).alias("metadata"))


def factors(run: str = "run_name") -> list[Column]:
    """Pairing and supervision of a run's name; nulls for base."""
    base = F.col(run) == "base"
    return [F.when(~base, F.substring_index(run, "_", 1)).alias("pairing"), F.when(~base, F.substring(F.col(run), F.instr(run, "_") + 1, F.length(run))).alias("supervision")]


def exposure_histogram(rows: DataFrame, fact: str) -> DataFrame:
    n = rows.groupBy(fact).agg(F.count(F.lit(1)).alias("exposures"))
    return n.groupBy("exposures").agg(F.count(F.lit(1)).alias("facts"))


def exposure_statistics(rows: DataFrame, by: str, fact: str, position: str, all_positions: int) -> DataFrame:
    g = rows.groupBy(by, fact).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(position).alias("p"))
    return g.groupBy(by).agg(F.count(F.lit(1)).alias("facts"), F.count_if(F.col("n") > 1).alias("multi"), F.count_if(F.col("p") > 1).alias("cross"), F.count_if(F.col("p") >= all_positions).alias("all_positions"), F.max("n").alias("max_exposures"), F.min("n").alias("min_exposures"))


def design_summary(rows: DataFrame, by: str, fact: str, tokens: str) -> DataFrame:
    e = rows.groupBy(by, fact).agg(F.count(F.lit(1)).alias("n"), F.sum(tokens).alias("t"))
    return e.groupBy(by).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("facts"), F.min("n").alias("min_exposures"), F.max("n").alias("max_exposures"), F.sum("t").alias("tokens"))


def design_histograms(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Rows by variant and by each value of some columns, in one aggregation over all of them."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns)))
    return rows.select(by, each.alias("x")).groupBy(by, "x.field", "x.value").agg(F.count(F.lit(1)).alias("rows"))


def choice_prompts(rows: DataFrame, i: Column, question: Column, choices: Column, answer: Column) -> DataFrame:
    """Padded id, the question with lettered choices, and the letter of the answer, which counts from 0."""
    letters = F.array(*map(F.lit, "ABCDEFGHIJ"))
    lines = F.array_join(F.transform(F.arrays_zip(F.slice(letters, F.lit(1), F.size(choices)).alias("l"), choices.alias("c")), lambda x: F.concat(x["l"], F.lit(". "), x["c"])), "\n")
    return rows.select(F.format_string("%05d", i).alias("id"), F.concat(question, F.lit("\n"), lines).alias("prompt"), F.element_at(letters, (answer + 1).cast("int")).alias("answer"))


def in_lists(rows: DataFrame, wanted: dict[str, list]) -> DataFrame:
    """Rows whose columns have one of the values wanted; an empty list asks for nothing."""
    for c, values in wanted.items():
        rows = rows.where(F.col(c).isin(values)) if values else rows
    return rows


def budget_gap(rows: DataFrame, by: str, tokens: str, most: float) -> DataFrame:
    """Relative gap of the variants' token sums, and whether it is within the limit."""
    s = rows.groupBy(by).agg(F.sum(tokens).alias("t"))
    gap = (F.max("t") - F.min("t")) / F.greatest(F.avg("t"), F.lit(1.0))
    return s.agg(F.round(gap, 9).alias("gap"), (gap <= most).alias("within"))


def short_datasets(rows: DataFrame, dataset: str, answers: str, n: int) -> DataFrame:
    """Violations of a source: fewer than n rows, or rows without an answer."""
    from .audits import violations

    g = rows.groupBy(dataset).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.trim(answers), F.lit("")) == "").alias("empty"))
    return violations(g, dataset, enough_rows=F.col("n") >= n, answers_given=F.col("empty") == 0)


def first_per_dataset(rows: DataFrame, dataset: str, order: str, n: int) -> DataFrame:
    return ranked(rows, [dataset], order).where(F.col("rank") <= n)


def family_histogram(rows: DataFrame, lists: str) -> DataFrame:
    return rows.select(F.explode(lists).alias("i")).groupBy(F.split_part("i", F.lit(":"), F.lit(1)).alias("family")).agg(F.count(F.lit(1)).alias("n"))


def repeated_cases(cases: DataFrame) -> DataFrame:
    """Case ids that occur more than once."""
    return cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def expand_cases(needles: DataFrame) -> DataFrame:
    """Every question and test of each needle (nested maps), with {i} placeholders filled in; leftovers come back flagged."""
    q = needles.select("id", "needle", F.explode("questions").alias("question_type", "question"), "tests")
    t = q.select("id", "needle", "question_type", "question", F.explode("tests").alias("test", "args"))
    places = F.when(F.size("args") > 0, F.sequence(F.lit(1), F.size("args"))).otherwise(F.array().cast("array<int>"))
    fill = lambda c: F.aggregate(places, F.col(c), lambda acc, i: F.replace(acc, F.concat(F.lit("{"), i.cast("string"), F.lit("}")), F.element_at("args", i)))
    x = t.withColumn("needle", fill("needle")).withColumn("question", fill("question"))
    return x.select(F.concat_ws("_", "id", "test", "question_type").alias("case_id"), "needle", "question", (F.col("needle").rlike(r"\{\d+\}") | F.col("question").rlike(r"\{\d+\}")).alias("unresolved"))
