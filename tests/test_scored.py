"""Whole-row scores, canonical JSON, raw-sample rules and finished trainings against plain Python."""

from __future__ import annotations

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from larkspur.functions import hashing
from larkspur.operators import audits, scored, timeseries


def flags_of(generated, prompt, answers, ids, quotes, id_flag, quote_flag):
    try:
        parsed = json.loads(generated or "")
        valid = isinstance(parsed, dict)
    except json.JSONDecodeError:
        valid = False
    parsed = parsed if valid else {}
    score = float(any((parsed.get("answer") or "") == a for a in answers)) if valid else 0.0
    on_ids, on_quotes = bool(ids) if id_flag is None else id_flag, bool(quotes) if quote_flag is None else quote_flag
    got_ids, got_quotes = set(parsed.get("evidence_ids") or []), set(parsed.get("evidence_quotes") or [])
    return (
        valid,
        score,
        valid and score == 1.0,
        on_ids,
        (valid and set(ids or []) <= got_ids) if on_ids else None,
        on_quotes,
        (valid and set(quotes or []) <= got_quotes) if on_quotes else None,
        (valid and bool(got_quotes) and all(q in prompt for q in got_quotes)) if on_quotes else None,
    )


def test_scores_fall_back_to_what_is_expected(spark):
    outputs = ['{"answer": "a", "evidence_ids": ["e1", "e2"], "evidence_quotes": ["q"]}', '{"answer": "b"}', '{"evidence_ids": ["e1"], "answer": "a", "evidence_quotes": ["zz"]}', "[1]", '{"answer": "a"} x', "", None, "{}"]
    rows = [(g, "has q in it", ["a", "c"], ids, quotes, f, h) for g in outputs for ids in ([], ["e1"], None) for quotes in ([], ["q"]) for f in (None, True, False) for h in (None, True, False)]
    x = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, generated string, prompt string, answers array<string>, expected_ids array<string>, expected_quotes array<string>, evidence_id_applicable boolean, evidence_quote_applicable boolean")
    got = scored.score_rows(x.withColumn("answer_metric", F.lit(None).cast("string")))
    names = ["valid_json", "answer_score", "answer_correct", "evidence_ids_applicable", "evidence_ids_correct", "evidence_quotes_applicable", "evidence_quotes_correct", "all_predicted_quotes_supported"]
    found = {r.k: tuple(r)[1:] for r in got.select("k", *names).collect()}
    assert found == {k: flags_of(*r) for k, r in enumerate(rows)}


def test_canonical_json(spark):
    rows = [("é\"\n\\", 7, True, 0.5, [1, None], {"b": ["x"], "a": None, "é": []}, (2, "y")), (None, None, None, None, None, None, None), ("", -1, False, 1234.25, [], {}, (None, None))]
    x = spark.createDataFrame(rows, "s string, n bigint, t boolean, f double, l array<int>, m map<string, array<string>>, r struct<z: int, a: string>")
    columns = ["s", "n", "t", "f", "l", "m", "r"]
    got = x.select(hashing.record_fingerprint(x, columns).alias("h")).collect()
    named = [dict(zip(columns, r)) | {"r": None if r[6] is None else dict(zip("za", r[6]))} for r in rows]
    want = [hashlib.sha256(json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode()).hexdigest() for v in named]
    assert [r.h for r in got] == want
    with pytest.raises(Exception, match="no canonical form"):
        odd = spark.createDataFrame([(1e300,)], "f double")
        odd.select(hashing.record_fingerprint(odd, ["f"])).collect()
    with pytest.raises(TypeError):
        dated = x.withColumn("d", F.current_date())
        hashing.record_fingerprint(dated, ["d"])


def test_raw_samples_of_diagnostics(spark):
    row = lambda i, mode, tokens, quote, position=0.5: (i, "g", "a", "f", "kv", "neutral", 100, tokens, 0.5, position, f"p{i}", 10, "see [Document d]\nT and q", [("d", "T")], [quote], mode)
    kinds = "sample_id string, group_id string, answer string, filler_fingerprint string, task string, filler_type string, target_tokens int, actual_tokens int, target_position double, actual_position double, position_label string, base_tokens int, prompt string, evidence array<struct<id: string, text: string>>, quotes array<string>, evaluation_mode string"
    rows = [row("1", None, 100, "q"), row("2", None, 150, "q"), row("3", "oracle_long", 5, "q"), row("4", "oracle_long", 0, "q"), row("5", None, 100, "lost"), row("6", None, 100, "q", 0.6), row("7", None, 101, "q"), row("7", None, 101, "q")]
    got = {(r.rule, r.key) for r in audits.raw_samples(spark.createDataFrame(rows, kinds)).collect()}
    assert got == {("length_error", "2"), ("length_error", "4"), ("quotes_in_prompt", "5"), ("position_error", "6"), ("unique_id", "7"), ("unique_labels", "g")}


def test_finished_trainings(spark):
    nan = float("nan")
    rows = [(v, s, 1.0 / s, 0.5, None if s == 2 else s / 10, 0.1) for v in ("whole", "short", "unfinished", "odd") for s in range(1, 6) if (v, s) != ("short", 3)]
    rows = [(v, s, nan if (v, s) == ("odd", 5) else x, a, g, r) for v, s, x, a, g, r in rows] + [("whole", 6, None, 0.9, 9.0, 0.1)]
    x = spark.createDataFrame(rows, "variant string, step int, loss double, mean_token_accuracy double, grad_norm double, learning_rate double").repartition(3)
    done = spark.createDataFrame([("whole", 5, 2.5), ("short", 5, 2.5), ("unfinished", 4, 2.0), ("odd", 5, 1.0)], "variant string, global_step int, elapsed_seconds double")
    got = {r.variant: r for r in timeseries.completed_training(x, done, ["variant"], 5, 2).collect()}
    assert set(got) == {"whole", "odd"}
    w, o = got["whole"], got["odd"]
    assert (w.metric_rows, w.first_loss, w.final_loss, w.median_loss, w.all_finite, w.saturated) == (5, 1.0, 0.2, pytest.approx(1 / 3), True, False)
    assert w.median_loss_recent == pytest.approx((0.25 + 0.2) / 2) and w.median_grad_recent == pytest.approx(0.45)
    assert (o.final_loss, o.all_finite) == (0.25, False) and o.median_loss_recent == pytest.approx((0.25 + 1 / 3) / 2) and not math.isnan(o.median_loss)
