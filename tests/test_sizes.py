"""What grows with the input: rows in a task before they multiply, joins that must not be broadcast, draws of a bootstrap."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larkspur.lineage import dealt
from larkspur.operators import audits, failures
from larkspur.plans import registry, views


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_file_of_one_split_is_dealt_out(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(views, "PARTS", 20)
    sizes = {r.p: r.units for r in views.grid(spark, sf_dir).groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("unit").alias("units")).collect()}
    assert sum(sizes.values()) == views.table(spark, sf_dir, "part").count()  # whole units
    assert len(sizes) > 5 and max(sizes.values()) <= 60
    assert dealt(spark.range(0), 10, "id").count() == 0


@pytest.mark.parametrize("name", ["cap_audit", "pairing_comparison"])
def test_cells_of_a_unit_stay_where_they_are(spark, sf_dir, name):
    """Grouping by the unit and more needs no shuffle of cells: the one of the parts comes first."""
    lines = plan(registry.queries()[name](spark, sf_dir)).splitlines()
    of_cells = [v for v in lines if "Exchange hashpartitioning(" in v and "REPARTITION" not in v and "unit" in v and "position_label" in v]
    assert not of_cells


@pytest.mark.parametrize("name", ["run_transitions", "ordered_identity_audit", "cross_run_failures", "failure_rates", "stored_catalog_audit"])
def test_runs_are_not_broadcast(spark, sf_dir, name):
    text = plan(registry.queries()[name](spark, sf_dir))
    assert "SortMergeJoin" in text
    for line in text.splitlines():
        # What may be broadcast is one row (whole), a few variants, or nothing.
        assert "BroadcastHashJoin" not in line or "category" in line, line


def test_stored_examples_go_to_the_rows(spark, sf_dir, monkeypatch):
    rows = spark.createDataFrame([("base", "1", f"1@{k}", 0.1 * k, k % 2 == 0) for k in range(6)], "run_name string, group_id string, sample_id string, target_position double, answer_correct boolean")
    rows = rows.selectExpr("*", "true AS valid_json", "cast(answer_correct AS string) AS answer", "true AS evidence_quotes_applicable", "true AS evidence_quotes_correct", "true AS all_predicted_quotes_supported_applicable", "true AS all_predicted_quotes_supported", "'stop' AS finish_reason")
    whole = failures.catalog(rows)
    wrong = whole.where("scope = 'row'").withColumn("run_name", F.lit("other"))
    stored = whole.unionByName(whole).unionByName(wrong)
    for most in (100_000, 0):
        monkeypatch.setattr(failures, "LISTED", most)
        got = failures.tampered(stored, rows)
        assert sorted(map(str, got.collect())) == sorted(map(str, wrong.collect()))
        # The catalog is never the broadcast side.
        assert ("BroadcastHashJoin" in plan(got)) == (most > 0)


@pytest.mark.parametrize("caps", [1, 2, 63, 64, 130])
def test_caps_as_bits(spark, caps):
    rows = [("all", c, "s") for c in range(caps)] + [("twice", c, "s") for c in [*range(1, caps), caps - 1]] + [("less", c, "s") for c in range(1, caps)] + [("other", c, f"s{c}") for c in range(caps)] + [("lost", c, None) for c in range(caps)]
    x = spark.createDataFrame(rows, "cell string, cap int, sample string")
    got = {(r.key, r.rule) for r in audits.balanced_prefix(x, ["cell"], "cap", "sample").collect()}
    want = {("lost", "one_sample")}
    want |= {("twice", "one_row_a_cap")} if caps > 1 else set()
    want |= {("less", "one_row_a_cap"), ("other", "one_sample")} if caps > 1 else set()
    assert got == want
    with_null = audits.balanced_prefix(x.unionByName(spark.createDataFrame([("null", None, "s")], x.schema)), ["cell"], "cap", "sample").where("rule = 'one_row_a_cap'")
    assert {r.key for r in with_null.collect()} == {"all", "twice", "other", "lost", "null"} | ({"less"} if caps > 1 else set())
    assert "Expand" not in plan(audits.balanced_prefix(x, ["cell"], "cap", "sample"))


@pytest.mark.parametrize("sent, counts, hashes", [(16, 50, 3), (1000, 2_000_000, 100_000), (7, 1, 1)])
def test_counts_sent_to_blocks_are_the_draws(spark, monkeypatch, sent, counts, hashes):
    from larkspur.operators import inference

    monkeypatch.setattr(inference, "SENT", sent)
    monkeypatch.setattr(inference, "COUNTS", counts)
    monkeypatch.setattr(inference, "HASHES", hashes)
    s = spark.createDataFrame([(t, u, g, u * 3 % 7, u % 2) for t, n in (("a", 1), ("b", 37), ("c", 130)) for u in range(n) for g in ("x", None, "y")[: 1 + u % 3]], "stratum string, unit int, g string, v long, w int")
    keys, values, b = ["stratum", "g"], ["v", "w"], 9
    few = inference.resample(s, "stratum", "unit", keys, values, b, 5)
    monkeypatch.setattr(inference, "BROADCAST_NUMBERS", 10)
    many = inference.resample(s, "stratum", "unit", keys, values, b, 5)
    drawn = inference.draws(inference.ordinals(s, "stratum", "unit"), "stratum", b, 5)
    rows = drawn.join(inference.ordinals(s, "stratum", "unit"), ["stratum", "idx"]).join(s, ["stratum", "unit"]).groupBy("replicate", *keys).agg(F.sum("v").alias("v"), F.sum("w").alias("w"))
    kept = rows.where("v <> 0 or w <> 0").count()
    as_rows = lambda df: sorted(str(r) for r in df.select("replicate", *keys, *values).where("v <> 0 or w <> 0").collect())
    assert len(as_rows(many)) == kept and as_rows(many) == as_rows(few) == as_rows(rows)
    # No row stands for a draw, and the sums are multiplied where their blocks are.
    assert "FlatMapCoGroupsInArrow" in plan(many) and "Generate explode(array" not in plan(many)
    totals = inference.draw_totals(s.groupBy("stratum").agg(F.count_distinct("unit").alias("n_units")), b, 5)
    want = drawn.groupBy("stratum", "replicate").agg(F.count(F.lit(1)).alias("draws"), F.count_distinct("idx").alias("distinct_units"), F.sum("idx").alias("index_sum"))
    assert sorted(map(str, totals.collect())) == sorted(map(str, want.collect()))


def test_token_counts_add_up(spark, sf_dir, monkeypatch):
    """What is counted of parts equals what is counted of whole prompts and contexts, also where a needle cuts a token."""
    from larkspur.functions.text import cuts_token, token_count
    from larkspur.operators import generate, needles

    g = spark.createDataFrame([(str(k), ("kv", "two_hop")[k % 2], ("neutral", "same_format", "answer_bearing")[k % 3], (20, 200, 384)[k % 3], f"f{k}", f"x{k}") for k in range(12)], "group_id string, task string, filler_type string, target_tokens int, fact_seed string, filler_seed string")
    s = generate.position_groups(g, (0.0, 0.25, 0.5, 1.0))
    whole = F.concat(F.lit(generate.SYSTEM + "\n\n"), "prompt")
    at = F.instr(whole, F.concat(F.lit("[Document "), F.col("evidence")[0]["id"], F.lit("]")))
    off = s.where((F.col("actual_tokens") != token_count(whole)) | (F.abs(F.col("actual_position") - token_count(F.substring(whole, F.lit(1), at - 1)) / token_count(whole)) > 1e-12))
    assert s.count() == 48 and off.count() == 0
    texts = ["ab cd-ef_g1 été " * 40, "x" * 300, "中文\U0001d7d8 a, b\nc " * 30, "line one\nline two\n" * 20, "! ?" * 50]
    books = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "book string, text string")
    cases = spark.createDataFrame([("c", "The needle, here.", "needle", "?")], "case_id string, needle string, answer string, question string")
    r = needles.needle_rows(books, cases, [40, 64, 200], [0.0, 0.25, 0.33, 0.5, 1.0])
    assert r.count() > 50 and r.where(F.col("actual_tokens") != token_count(F.col("context"))).count() == 0
    cut = spark.createDataFrame([("ab", 1, True), ("ab", 0, False), ("ab", 2, False), ("a-", 1, False), ("中_", 1, True), (" b", 1, False)], "t string, at int, want boolean")
    assert cut.where(cuts_token(F.col("t"), F.col("at")) != F.col("want")).count() == 0
    # Books are read once, and so are the cases.
    assert plan(r).count("Scan ExistingRDD") == 2


def test_no_more_candidates_than_may_fit(spark):
    from larkspur.operators import generate

    kinds = [(t, f) for t in ("kv", "two_hop") for f in ("neutral", "same_format", "answer_bearing")]
    g = spark.createDataFrame([(f"{t}{f}{k}", t, f, 380 + k, f"f{k}", f"x{k}") for t, f in kinds for k in range(5)], "group_id string, task string, filler_type string, target_tokens int, fact_seed string, filler_seed string")
    c = generate.filler_candidates(generate.facts(g).withColumn("base_tokens", F.lit(50)), 12)
    least = {r.filler_type: r.t for r in c.where("idx >= 0").groupBy("filler_type").agg(F.min("tokens").alias("t")).collect()}
    assert least["neutral"] == min(least.values()) == 12 + generate.FRAME
    per = c.groupBy("group_id").agg(F.sum("tokens").alias("all"), F.max("idx").alias("most"), F.first("target_tokens").alias("target"), F.first("filler_type").alias("kind"))
    assert per.where("50 + all <= target").count() == 0  # candidates never run out before the budget
    assert per.where("kind = 'neutral'").agg(F.max("most")).first()[0] <= 11


def test_ranges_of_replicates_are_dealt_evenly(spark, monkeypatch):
    from larkspur.operators import inference

    monkeypatch.setattr(inference, "COUNTS", 400)
    strata = spark.createDataFrame([("a", 100), ("b", 40), ("c", 1)], "_t string, n_units bigint")
    ranges = inference._ranges(strata, 200)
    sizes = [len(p) for p in ranges.rdd.glom().collect()]
    rows = sorted(tuple(r) for r in ranges.collect())
    assert len(rows) == 50 + 20 + 1 and all(r[3] - r[2] == {100: 4, 40: 10, 1: 200}[r[1]] for r in rows)
    assert max(sizes) - min(sizes) <= 1 and max(sizes) <= inference.RANGES


def test_groups_of_the_same_units_share_a_product():
    import numpy as np
    from larkspur.operators import inference

    places, sums = [np.arange(3), np.array([0, 2]), np.arange(3)], [np.array([[1], [2], [3]]), np.array([[4], [5]]), np.array([[6], [7], [8]])]
    found = inference._alike(places, sums, np.dtype(np.int64))
    assert [gs for _, _, gs in found] == [[0, 2], [1]] and found[0][1].tolist() == [[1, 6], [2, 7], [3, 8]]
    assert [gs for _, _, gs in inference._alike(places, sums, np.dtype(float))] == [[0], [1], [2]]


def test_words_of_a_book_are_counted_once(spark):
    from larkspur.functions.text import token_count
    from larkspur.operators import generate, needles

    texts = ["a-b c, d\ne  f " * 30, "été_1 中文 \U0001d7d8 !? " * 20, "one", "", None, "x.y.z " * 400]
    books = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "book string, text string")
    cases = spark.createDataFrame([("c", "The needle, here.", "needle", "?")], "case_id string, needle string, answer string, question string")
    assert plan(needles.needle_rows(books, cases, [40, 64], [0.0, 1.0]).select("group_id")).split("== Initial")[0].count("regexp_extract_all(concat(") == 0
    x = books.select("book", F.split("text", " ").alias("words"), F.lit("a needle.").alias("needle"))
    for target in (10, 40, 300):
        got = {r.book: r for r in generate.fit_prefix(x, "words", "needle", target).withColumn("again", token_count(F.concat("fitted", F.lit("\n"), "needle"))).collect()}
        for r in x.collect():
            count = lambda s: spark.range(1).select(token_count(F.lit(s))).first()[0]
            n, want = min(len(r.words or []), max(1, target - 3 - 16)), None
            for _ in range(3):
                text = None if r.words is None else " ".join(r.words[: max(n, 1)])
                c = None if text is None else count(text + "\na needle.")
                if c is not None and c <= target and n > 0:
                    want = (text, c)
                    break
                n -= max(1, (c or 0) - target + 8)
            assert (None if got[r.book].fitted is None else (got[r.book].fitted, got[r.book].fitted_tokens)) == want and (want is None or got[r.book].again == want[1])


@pytest.mark.parametrize("name", ["sibling_audit", "mechanism_records"])
def test_groups_within_a_unit_are_not_shuffled_again(spark, sf_dir, name):
    from larkspur.plans import registry

    found = plan(registry.queries()[name](spark, sf_dir)).split("== Initial")[0]
    assert found.count("Exchange hashpartitioning") == found.count("REPARTITION_BY_NUM") == 1 and "Expand" not in found


def test_siblings_of_null_fields(spark):
    from larkspur.operators import audits

    rows = [(k, m, h) for k, hs in (("same", "aaa"), ("other", "aab"), ("null", (None,) * 3), ("some", ("a", None, "a"))) for m, h in zip("xyz", hs)] + [("less", "x", "a"), ("twice", "x", "a"), ("twice", "x", "a"), ("twice", "y", "a")]
    got = {(r.key, r.rule) for r in audits.siblings(spark.createDataFrame(rows, "k string, supervision string, h string"), ["k"], ["h"], 3).collect()}
    assert got == {("other", "same_h"), ("null", "same_h"), ("less", "every_mode_once"), ("twice", "every_mode_once")}
