"""Scores of generated outputs against their targets, all flags of a row at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import answer_score, is_json_object, is_superset, quotes_supported

PARSED = "answer string, evidence_ids array<string>, evidence_quotes array<string>"


def applicable(flag: Column, expected: Column) -> Column:
    """Whether a metric applies: what the metadata say, or else whether something is expected."""
    return F.coalesce(flag, F.coalesce(F.size(expected), F.lit(0)) > 0)


def score_rows(rows: DataFrame) -> DataFrame:
    """Flags and score of rows (generated, prompt, answers, expected_ids, expected_quotes, answer_metric, evidence_id_applicable,
    evidence_quote_applicable): valid JSON, the answer by its metric, and evidence where it applies, null where it does not.

    An output that is no JSON object has score 0 and fails what applies.  A missing metric is exact match; evidence that an output leaves out is none.
    """
    valid = is_json_object(F.col("generated"))
    parsed = F.from_json(F.when(valid, F.col("generated")), PARSED)
    none = F.array().cast("array<string>")
    x = rows.withColumns({"valid_json": valid, "_p": parsed})
    ids, quotes = F.coalesce(F.col("_p.evidence_ids"), none), F.coalesce(F.col("_p.evidence_quotes"), none)
    metric = F.coalesce("answer_metric", F.lit("exact"))
    x = x.withColumn("answer_score", F.when(F.col("valid_json"), answer_score(metric, F.col("_p.answer"), F.col("answers"))).otherwise(F.lit(0.0)))
    on_ids, on_quotes = applicable(F.col("evidence_id_applicable"), F.col("expected_ids")), applicable(F.col("evidence_quote_applicable"), F.col("expected_quotes"))
    want = lambda c: F.coalesce(F.col(c), none)
    flags = {
        "answer_correct": F.col("valid_json") & (F.col("answer_score") == 1.0),
        "evidence_ids_applicable": on_ids,
        "evidence_ids_correct": F.when(on_ids, F.col("valid_json") & is_superset(ids, want("expected_ids"))),
        "evidence_quotes_applicable": on_quotes,
        "evidence_quotes_correct": F.when(on_quotes, F.col("valid_json") & is_superset(quotes, want("expected_quotes"))),
        "all_predicted_quotes_supported": F.when(on_quotes, F.col("valid_json") & quotes_supported(quotes, F.col("prompt"))),
    }
    return x.withColumns(flags).drop("_p")
