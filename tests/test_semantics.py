"""Hand-computed cases of the statistics, the scoring and the generation."""

from __future__ import annotations

import glob
import hashlib
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.operators import audits, cells, design, generate, inference, timeseries
from larkspur.schemas import GRID
from larkspur.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_holm(spark):
    t = spark.createDataFrame([(0, "f", 0.01), (1, "f", 0.03), (2, "f", 0.5)], "ordinal int, family string, p double")
    assert [round(r.p_holm, 9) for r in inference.holm(t, ["family"]).orderBy("ordinal").collect()] == [0.03, 0.06, 0.5]


def test_whole_series_are_smoothed(spark, sf_dir):
    from larkspur.plans import registry
    from larkspur.plans.views import history

    def brute(xs):
        y = xs[:1]
        for v in xs[1:]:
            y.append(2.0 / 11 * v + (1 - 2.0 / 11) * y[-1])
        return y

    # sf0.001 has about 200 steps a series: a longer one, of 9,000 steps from a large first value, and odd ones.
    series = {"long": [1e12, *((7919 * k % 1009) / 7 for k in range(9000))], "nan": [1.0, float("nan"), *[2.0] * 5000], "inf": [1.0, float("inf"), *[2.0] * 5000], "one": [3.0]}
    rows = spark.createDataFrame([(n, k, v) for n, xs in series.items() for k, v in enumerate(xs)], "variant string, step int, loss double")
    got = {(r.variant, r.step): r.smooth for r in timeseries.ewma(rows, "variant", "loss", "step", 10).collect()}
    assert len(got) == rows.count()
    assert all(got[n, k] == pytest.approx(v, rel=1e-9, nan_ok=True) for n, xs in series.items() for k, v in enumerate(brute(xs)))
    h = history(spark, sf_dir).where("loss is not null").orderBy("variant", "step").collect()
    out = {(r.variant, r.step): r.smooth for r in registry.queries()["smoothed_losses"](spark, sf_dir).collect()}
    for n in {r.variant for r in h}:
        mine = [r for r in h if r.variant == n]
        assert [out.pop((n, r.step)) for r in mine] == pytest.approx(brute([r.loss for r in mine]), abs=1e-7)
    assert not out


def test_metric_matrix_reads_every_row(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 1, 1.0), ("a", 2, 0.0), ("a", 3, 1.0), ("a", 4, None), ("a", 5, 2.0), ("b", 1, nan), ("b", 3, 1.0), ("b", 3, 1.0), ("b", 0, -1.0), ("b", None, inf)]
    x = spark.createDataFrame(rows, "variant string, step int, loss double")
    got = sorted((tuple(r) for r in timeseries.metric_matrix_problems(x, ["variant"], 3, "loss").collect()), key=str)
    a = [("a", 2, "not_positive"), ("a", 4, "not_finite"), ("a", 4, "unexpected_step"), ("a", 5, "unexpected_step")]
    b = [("b", 1, "not_finite"), ("b", 2, "missing"), ("b", 3, "duplicate_step"), ("b", 0, "not_positive"), ("b", 0, "unexpected_step"), ("b", None, "not_finite"), ("b", None, "unexpected_step")]
    assert got == sorted(a + b, key=str)
    longest = {tuple(r) for r in timeseries.metric_matrix_problems(x, ["variant"], None, "loss").collect()}
    assert longest >= {("b", 4, "missing"), ("b", 5, "missing"), ("a", 4, "not_finite")} and ("a", 5, "unexpected_step") not in longest
    assert timeseries.metric_matrix_problems(x.limit(0), ["variant"], None, "loss").count() == 0


def test_replicates_can_reach_significance(spark, sf_dir):
    from larkspur.plans import registry

    q = registry.queries()
    log = q["bootstrap_draws"](spark, sf_dir).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.min("replicate").alias("low"), F.max("replicate").alias("high")).collect()
    assert log and all((r.n, r.low, r.high) == (2000, 0, 1999) for r in log)
    # 2 (k + 1) / (B + 1), over six runs: at 100 replicates no adjusted p would be below 0.118.
    assert min(r.p_holm for r in q["effects_vs_base"](spark, sf_dir).collect()) < 0.05


def test_resample_ways_agree(spark, monkeypatch):
    s = spark.createDataFrame([("a" if k % 3 else "b", k, k * k, 1) for k in range(50)], "stratum string, unit int, v int, one int")
    few = sorted(map(tuple, inference.resample(s, "stratum", "unit", ["stratum"], ["v", "one"], 30, 7).collect()))
    monkeypatch.setattr(inference, "BROADCAST_NUMBERS", 0)
    assert few == sorted(map(tuple, inference.resample(s, "stratum", "unit", ["stratum"], ["v", "one"], 30, 7).collect()))
    sizes = {"a": 33, "b": 17}
    assert len(few) == 60 and all(r[3] == sizes[r[1]] for r in few)


def test_interaction(spark):
    v = spark.createDataFrame([("paired_evidence", 0.9), ("paired_answer", 0.6), ("independent_evidence", 0.7), ("independent_answer", 0.5)], "run_name string, value double")
    w = inference.weights(spark, [c for c in inference.contrasts_two_by_two() if "interaction" in c[0]])
    assert inference.weighted(v, [], "value", w).first().value == pytest.approx(0.1)
    missing = inference.weighted(v.where("run_name <> 'paired_answer'"), [], "value", w).first()
    assert missing.value is None


def test_contrast_definitions():
    d = inference.contrasts_two_by_three()
    assert len({c[0] for c in d}) == 16
    for name in {c[0] for c in d}:
        assert sum(c[2] for c in d if c[0] == name) == pytest.approx(0)


def test_token_f1(spark):
    f = lambda a, b: one(spark, text.token_f1(F.lit(a), F.lit(b)))
    assert f("New York", "New York City") == pytest.approx(0.8)
    assert f("The  new york!", "New York") == 1.0 and f("", "the") == 1.0 and f("", "x") == 0.0


@pytest.mark.parametrize("generated,letter,source", [('{"answer": "C", "evi', "C", "truncated_or_embedded_json"), ("answer is A, option B", None, "unextractable"), (" (b). ", "B", "bare_option"), ("The answer is D", "D", "explicit_answer_phrase")])
def test_options(spark, generated, letter, source):
    a, b = text.option_letter(F.lit(None).cast("string"), F.lit(generated))
    assert tuple(spark.range(1).select(a.alias("a"), b.alias("b")).first()) == (letter, source)


@pytest.mark.parametrize("value,valid", [("{}", True), ('{"a":1}x', False), ('{"a":1}],[{"b":1}', False), ("[1]", False), ('{"a":1} {"b":2}', False), ("", False), (None, False)])
def test_json_objects(spark, value, valid):
    assert one(spark, text.is_json_object(F.lit(value).cast("string"))) is valid


def test_intervals(spark):
    x = spark.createDataFrame([("a", 0.1), ("a", 0.3), ("b", 0.7)], "k string, estimate double")
    got = {r.k: r for r in inference.mean_intervals(x, ["k"]).collect()}
    assert got["a"]["mean"] == 0.2 and got["a"].low < -0.5 and got["a"].high > 1 and got["b"].low is None
    y = spark.createDataFrame([("a", 0.7), ("a", 0.7), ("b", 0.7), ("b", 0.71)], "k string, estimate double")
    assert {r.k: (r.consistent, r.estimate) for r in inference.fixed_base(y, ["k"]).collect()} == {"a": (True, 0.7), "b": (False, None)}


def test_null_metrics_fail_where_they_apply(spark):
    rows = [(True, None, True), (None, True, True), (False, True, None)]
    x = spark.createDataFrame(rows, "evidence_ids_applicable boolean, evidence_ids_correct boolean, valid_json boolean")
    r = x.agg(F.avg(cells.hit("evidence_ids_correct")).alias("a"), F.count(cells.hit("evidence_ids_correct")).alias("n"), F.avg(cells.hit("valid_json")).alias("v")).first()
    assert (r.a, r.n) == (0.5, 2) and r.v == pytest.approx(2 / 3)


def test_keep_last(spark):
    h = spark.createDataFrame([("v", 1, 1, 0.3), ("v", 2, 2, 0.9), ("v", 2, 3, 0.2)], "variant string, step int, seq int, loss double").withColumns({"eval_loss": F.lit(None), "learning_rate": F.lit(None)})
    assert [(r.step, r.loss) for r in timeseries.keep_last(h, ["variant", "step"], "seq").orderBy("step").collect()] == [(1, 0.3), (2, 0.2)]
    assert timeseries.duplicates(h, "variant", "step").first().duplicates == 1


@pytest.fixture(scope="module")
def bank(spark):
    rows = [(f"{t}-{f}-{k}", t, f, 512, f"fact-{t}", f"fill-{t}-{f}-{k}") for t in ("kv", "two_hop") for f in ("neutral", "answer_bearing") for k in range(3)]
    g = spark.createDataFrame(rows, "group_id string, task string, filler_type string, target_tokens int, fact_seed string, filler_seed string")
    return generate.position_groups(g, (0.0, 0.25, 0.5, 1.0)).cache()


@pytest.mark.parametrize("target", [8192, 32768])
def test_groups_reach_any_budget(spark, target):
    rows = [(f"{t}-{f}", t, f, target, f"fact-{t}", f"fill-{t}-{f}") for t in ("kv", "two_hop") for f in ("neutral", "same_format", "answer_bearing")]
    g = spark.createDataFrame(rows, "group_id string, task string, filler_type string, target_tokens int, fact_seed string, filler_seed string")
    out = generate.position_groups(g, (0.0, 0.5)).select("group_id", "task", "filler_type", "actual_tokens", "target_position", "actual_position", "prompt", "answer").collect()
    assert len(out) == 12 and all(abs(r.actual_tokens - target) <= 0.02 * target and abs(r.actual_position - r.target_position) <= 0.03 for r in out)
    assert all("filed under" in r.prompt for r in out if r.task == "two_hop") and not any("filed under" in r.prompt for r in out if r.task == "kv")
    assert all((r.prompt.count(r.answer) > 10) == (r.filler_type == "answer_bearing") for r in out)


def test_no_group_is_lost(spark):
    g = spark.createDataFrame([("a", "kv", "neutral", 20, "f", "s"), ("b", "two_hop", "neutral", 300, "f", "s")], "group_id string, task string, filler_type string, target_tokens int, fact_seed string, filler_seed string")
    s = generate.position_groups(g, (0.0, 1.0))
    assert {(r.group_id, r.filler_document_count > 0) for r in s.collect()} == {("a", False), ("b", True)}
    assert {r.key for r in audits.raw_samples(s).where("rule = 'room_for_fillers'").collect()} == {"a@p000", "a@p100"}


def test_replicas_share_facts_only(spark):
    f = spark.createDataFrame([("f1", "kv", "neutral", 200), ("f2", "two_hop", "same_format", 200)], "fact_id string, task string, filler_type string, target_tokens int")
    bank = generate.replicas(f, 3, 7)
    assert bank.select("group_id").distinct().count() == 6 and bank.select("fact_seed").distinct().count() == 2 and bank.select("filler_seed").distinct().count() == 6
    s = generate.position_groups(bank, (0.0, 1.0)).withColumn("fact", F.substring("group_id", 1, 2))
    assert audits.matched_bank(s, "fact", "group_id").count() == 0
    assert {r.rule for r in audits.matched_bank(s.withColumn("filler_fingerprint", F.lit("x")), "fact", "group_id").collect()} == {"distinct_fillers"}


def test_position_groups(bank):
    rows = bank.collect()
    assert len(rows) == 48
    for r in rows:
        assert all(e.text in r.prompt for e in r.evidence) and abs(r.actual_tokens - 512) < 40
    assert {r.rule for r in audits.raw_samples(bank, 0.1, 1.0).collect()} == set()
    again = {r.answer for r in rows if r.task == "kv"}
    assert len(again) == 1


def test_diagnostics(bank):
    got = {r.evaluation_mode: r["count"] for r in generate.derive(bank).groupBy("evaluation_mode").count().collect()}
    assert got == {"locate_only": 48, "oracle_long": 48, "oracle_short": 12}
    long = generate.derive(bank).where("evaluation_mode = 'oracle_long'").first()
    assert long.prompt.count(long.evidence[0].text) == 1


def test_blocks(spark):
    rows = [(t, f, k) for t in ("kv", "two_hop") for f in range(5) for k in range(4) if (t, f, k) != ("kv", 0, 3)]
    x = spark.createDataFrame(rows, "task string, fact int, replica int")
    bad = {(r.rule, r.key) for r in audits.blocks(x, ["task"], "fact", "replica", 4, 3).collect()}
    assert bad == {("complete_block", "0")}
    assert design.block_select(x.select("task", "fact").distinct(), ["task"], "fact", 3, 7).count() == 6


def test_first_newline_wins_ties(spark):
    assert one(spark, text.insertion_index(F.lit("ab\ncd\nef"), F.lit(0.5))) == 5
    assert one(spark, text.insertion_index(F.lit("a\nbcd\nf"), F.lit(0.5))) in (1, 5)
    assert one(spark, text.position_label(F.lit(0.125))) == "p012" and GRID[3] == "p050"


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "n int, a string")
    assert files.write_jsonl(df, f"{tmp_path}/x", "gzip") == 2
    assert files.read_jsonl(spark, f"{tmp_path}/x", "n int, a string").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n[2]\n{"a": 1} x\n')
    assert files.bad_lines(spark, f"{tmp_path}/bad.jsonl").count() == 2
    assert files.line_counts(spark, f"{tmp_path}/bad.jsonl").first().non_blank == 3
    m = files.manifest(spark, f"{tmp_path}", "*.jsonl")
    assert m.count() == 1 and files.folder_fingerprint(m, str(tmp_path)).first().fingerprint == hashlib.sha256(b"bad.jsonl\0" + (tmp_path / "bad.jsonl").read_bytes()).hexdigest()
    with pytest.raises(ValueError):
        files.read_runs(spark, {"base": "x"}, {"base", "other"})
    assert files.parse_seed_input("f:1:pilot:/p") == ("f", 1, "pilot", "/p")


HEALTH = "variant string, step int, loss double, grad_norm double, learning_rate double, mean_token_accuracy double"


def test_health_stream(spark, tmp_path):
    """Each record equals that of all rows so far, over files that come one by one, with a restart, repeats, late rows, NaN and nulls."""
    from larkspur.streaming import monitors

    r = random.Random(6)
    row = lambda v, k: (v, k, r.choice([0.5, 1.0, None]) if k % 7 else r.random(), r.random() * 9, None if k % 5 else 0.1, r.random())
    parts = [
        [("a", k, 1.0, 1.0, 0.1, 0.5) for k in range(100)] + [row("b", k) for k in range(30)],
        [("a", 100, 5000.0, 1.0, 0.1, 0.5), ("a", 101, 5000.0, 1.0, 0.1, None)],
        [row("b", k) for k in range(40, 180)] + [("a", 50, 9e9, 1.0, 0.1, 0.5)],  # a step again: the first counts
        [row("b", k) for k in range(30, 40)],  # late: no new checkpoint of b
        [("a", 102, float("nan"), None, None, None), ("c", 1, 0.5, 101.0, 0.1, 0.5), (None, 5, 0.5, 1.0, 0.1, 0.5)],
    ]
    seen, so_far = [], []

    def run(k):
        spark.createDataFrame(parts[k], HEALTH).coalesce(1).write.json(f"{tmp_path}/in{k}", ignoreNullFields=False)
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        for f in glob.glob(f"{tmp_path}/in{k}/*.json"):
            shutil.copy(f, f"{tmp_path}/in/{k}.json")
        stream = monitors.history_stream(spark, f"{tmp_path}/in", HEALTH, 1)
        sink = monitors.once_by_batch(f"{tmp_path}/out")
        monitors.watch_health(stream, lambda df, n: (sink(df, n), seen.append(sorted((str(x) for x in df.collect())))), f"{tmp_path}/cp").awaitTermination(120)

    steps: dict = {}
    for k, part in enumerate(parts):
        run(k)  # a new query each time: a restart
        known = {(v, s) for v, s, *_ in so_far}
        so_far += [x for x in part if x[2] is not None and (x[0], x[1]) not in known]
        want = timeseries.health_records(spark.createDataFrame(so_far, HEALTH).withColumn("step", F.col("step").cast("bigint")), "variant").collect()
        grown = [x for x in want if steps.get(x.variant, -1) < x.checkpoint_step]
        steps |= {x.variant: x.checkpoint_step for x in want}
        assert seen[k] == sorted(str(x) for x in grown), k
    assert len(seen) == 5 and not seen[3] and "loss_outlier_above_1000x_median" in seen[1][0]
    assert any("critical" in x for x in seen[4])
    told = [(x.variant, x.checkpoint_step) for x in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(told) == len(set(told)) == sum(map(len, seen))
    assert spark.read.parquet(f"{tmp_path}/cp/tails-0").groupBy("variant").count().agg(F.max("count")).first()[0] <= 100


def test_health_stream_replays_and_forgets(spark):
    from larkspur.streaming.monitors import merged_tails

    rows = lambda v, ks: spark.createDataFrame([(v, k, 1.0, 1.0, 0.1, 0.5) for k in ks], HEALTH)
    first = merged_tails(None, rows("a", range(9)), "variant", 4, 0, 2)
    assert sorted(r.step for r in first.collect()) == [5, 6, 7, 8]
    second = merged_tails(first, rows("b", [1, 1]), "variant", 4, 1, 2)
    assert sorted((r.variant, r.step, r.touched) for r in second.collect()) == [*(("a", k, 0) for k in (5, 6, 7, 8)), ("b", 1, 1)]
    assert {r.variant for r in merged_tails(second, rows("c", [1]), "variant", 4, 3, 2).collect()} == {"b", "c"}


def test_readers_refuse(spark, tmp_path):
    from larkspur.sources.files import numbered_bad_lines, read_csv, read_jsonl, read_runs, read_tagged, refuse_keys, write_csv

    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n[2]\n{"a": 1} x\n')
    assert [(r.line, r.value) for r in numbered_bad_lines(spark, f"{tmp_path}/bad.jsonl").orderBy("line").collect()] == [(3, "[2]"), (4, '{"a": 1} x')]
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST|FAILED_READ_FILE"):
        read_jsonl(spark, f"{tmp_path}/bad.jsonl", "a int").collect()
    good = '{"schema_version": "position-group-v1", "sample_id": "%s"}\n'
    (tmp_path / "good.jsonl").write_text(good % "s1" + good % "s2")
    assert read_tagged(spark, f"{tmp_path}/good.jsonl", "position-group-v1").count() == 2
    for text, tag in ((good % "s1" * 2, "position-group-v1"), (good % " ", "position-group-v1"), (good % "s1", "position-group-v2"), ('{"schema_version": "position-group-v1"}\n', "position-group-v1")):
        (tmp_path / "odd.jsonl").write_text(text)
        with pytest.raises(ValueError):
            read_tagged(spark, f"{tmp_path}/odd.jsonl", tag)
    runs = {"base": f"{tmp_path}/good.jsonl", "paired_answer": f"{tmp_path}/good.jsonl"}
    assert read_runs(spark, runs, set(runs), "sample_id string", key="sample_id").count() == 4
    (tmp_path / "odd.jsonl").write_text(good % "s1" * 2)
    with pytest.raises(ValueError):
        read_runs(spark, {"base": f"{tmp_path}/odd.jsonl"}, None, "sample_id string", key="sample_id")
    with pytest.raises(ValueError):
        refuse_keys(spark.createDataFrame([("a", None)], "k string, v string"), ["k", "v"])
    df = spark.createDataFrame([(1, 0.5, "x"), (2, None, "")], "step int, loss double, note string")
    write_csv(df, f"{tmp_path}/t.csv", ["step", "loss", "note"])
    assert [tuple(r) for r in read_csv(spark, f"{tmp_path}/t.csv", "step int, loss double, note string").orderBy("step").collect()] == [(1, 0.5, "x"), (2, None, None)]
    with pytest.raises(ValueError, match="eval_loss"):
        read_csv(spark, f"{tmp_path}/t.csv", "step int, eval_loss double")
    with pytest.raises(Exception):
        read_csv(spark, f"{tmp_path}/t.csv", "step int, loss int, note int").collect()


def test_sinks(spark, tmp_path):
    import json

    files.write_report(f"{tmp_path}/r.json", {"a": spark.createDataFrame([(1, "é")], "n int, t string")})
    files.write_report(f"{tmp_path}/r.json", {"a": spark.createDataFrame([(2, "é")], "n int, t string")})
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": [{"n": 2, "t": "é"}]} and [p.name for p in tmp_path.iterdir()] == ["r.json"]
    t = spark.createDataFrame([(0, [1, 2], [0, 1], "x"), (1, [3], [1], "y")], "row_index bigint, input_ids array<int>, completion_mask array<int>, more string")
    files.write_tokens(t, f"{tmp_path}/tokens")
    back = spark.read.parquet(f"{tmp_path}/tokens")
    assert back.columns == ["row_index", "input_ids", "completion_mask"]
    assert [r.row_index for r in files.select_rows(back, spark.createDataFrame([(1,), (1,), (9,)], "row_index bigint")).collect()] == [1]
    (tmp_path / "empty").mkdir()
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / "a.txt").write_text("abc")
    m = files.manifest(spark, f"{tmp_path}/full")
    assert tuple(files.manifest_totals(m).first()) == (1, 3)
    with pytest.raises(Exception, match="no files"):
        files.folder_fingerprint(m.limit(0), "x").collect()


def test_choices(spark):
    assert one(spark, text.target_option(F.lit(" b "))) == "B"
    with pytest.raises(Exception, match="not one option"):
        one(spark, text.target_option(F.lit("E")))
    plain = spark.createDataFrame([("s", None)], "sample_id string, metadata struct<case_id: string>")
    assert inference.cluster_choice(plain, True) == (None, None, None)
    needle = spark.range(1050).selectExpr("named_struct('case_id', cast(id % 10 AS string)) AS metadata")
    assert inference.cluster_choice(needle, True) == ("metadata.case_id", "task", 10) and inference.cluster_choice(needle, False)[2] is None
    text.register_counter("one", lambda c: F.lit(1))
    assert one(spark, text.count_tokens("one", F.lit("a b"))) == 1 and one(spark, text.count_tokens("blanks", F.lit(" a  b\n"))) == 2
    with pytest.raises(ValueError):
        text.count_tokens("none", F.lit("a"))


def test_lookup_refuses_repeats(spark):
    from larkspur.operators import align

    rows = spark.createDataFrame([(1,), (1,), (3,)], "k int")
    src = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert sorted((r.k, r.v) for r in align.look_up(rows, src.where("v <> 'c'"), "k", ["v"]).collect() if r.v) == [(1, "a"), (1, "a")]
    with pytest.raises(Exception, match="repeats"):
        align.look_up(rows.unionByName(spark.createDataFrame([(2,)], "k int")), src, "k", ["v"]).collect()
    both, bad = align.attach(spark.createDataFrame([(1, "x"), (3, None)], "k int, v string"), src, "k", "v")
    assert [tuple(r) for r in both.collect()] == [(1, "a")]
    assert {tuple(r) for r in bad.collect()} == {("missing_in_source", "3"), ("missing_in_rows", "2"), ("repeated_in_source", "2"), ("conflict", "1")}


def test_tail_warnings(spark):
    rows = [("low", k, k, 1e-6, 0.5) for k in range(1, 6)] + [("sure", k, k, 0.5, 0.9999) for k in range(1, 6)] + [("fine", k, k, 0.5, 0.9) for k in range(1, 6)] + [("fine", 5, 9, 0.4, 0.9)]
    x = spark.createDataFrame(rows, "variant string, step int, seq int, loss double, mean_token_accuracy double").withColumns({"eval_loss": F.lit(None), "learning_rate": F.lit(None)})
    assert {tuple(r) for r in timeseries.completeness(x, "variant", 5).collect()} == {("saturated_loss", "low", 5), ("saturated_accuracy", "sure", 5), ("repeated_steps", "fine", 1)}


def test_other_streams(spark, tmp_path):
    from larkspur.streaming import monitors

    schema = "run_name string, at timestamp, checkpoint int, used_mb int, busy double"
    rows = [("r", f"2026-01-01 00:00:{s:02d}", s // 10, s, 0.5) for s in range(0, 60, 2)]
    spark.createDataFrame(rows, "run_name string, at string, checkpoint int, used_mb int, busy double").write.json(f"{tmp_path}/in")
    stream = monitors.history_stream(spark, f"{tmp_path}/in", schema)
    seen = []
    monitors.watch_telemetry(stream, lambda df, n: seen.extend(df.collect()), f"{tmp_path}/c1", seconds=5).awaitTermination(60)
    assert sum(r.records for r in seen) <= 30 and len({r.at for r in seen}) == len(seen)
    q = monitors.progress_counts(stream, "run_name").writeStream.outputMode("complete").format("memory").queryName("larkspur_progress").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("larkspur_progress").first().rows == 30
    for _ in range(2):
        monitors.resume(stream, f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 30
