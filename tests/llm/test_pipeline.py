"""The pipeline's stages on the small tables: columns, decisions and the last stage's ids."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from larkspur.llm import circulant, lpf_dedup, repetition  # noqa: E402


def test_stages(spark, sf_dir):
    import sentencepiece

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    rules, near, suffix, mixed, ids = (f for _, f in corpus_pipeline.STAGES)
    kept = rules(spark, docs, sf_dir).cache()
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in repetition.verdicts(repetition.measure(docs)).where("kept").collect()}
    one = near(spark, kept, sf_dir).cache()
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in circulant.near_duplicates(kept, 5).where("kept").collect()}
    less = suffix(spark, one, sf_dir).cache()
    sizes = {r.doc_id: r.n_bytes - r.n_removed for r in lpf_dedup.dedup(one).collect()}
    rows = less.collect()
    assert len(rows) == len(sizes) and all(sizes[r.doc_id] <= len(r.text.encode()) <= sizes[r.doc_id] + 3 * 64 and r.n_chars == len(r.text) for r in rows)
    out = mixed(spark, less, sf_dir).cache()
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in rows}
    assert docs.columns == kept.columns == one.columns == less.columns == out.columns
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r.doc_id: r.text for r in rows}
    for r in ids(spark, out, sf_dir).collect():
        assert r.round_trip and np.frombuffer(r.ids, "<i4").tolist() == sp.encode(text[r.doc_id])


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def odd_documents(spark):
    r = random.Random(21)
    words = [f"w{k}" for k in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared, base = text(80), text(120)
    near = " ".join(w if k % 40 else "other" for k, w in enumerate(base.split()))
    rows = [(i, text(60 + i), "en", "a" if i % 3 else "b") for i in range(40)]
    rows += [(50, base, "en", "a"), (51, near, "en", "a"), (52, base, "en", "b"), (53, base, "en", None), (53, base, "en", None)]
    rows += [(60, text(70) + " " + shared, "en", "c"), (61, text(75) + " " + shared, None, "c"), (None, text(90), "en", "a"), (None, text(95), "en", "a")]
    rows += [(70, None, "en", "a"), (71, "", "en", "a"), (72, "too short", "en", "a"), (73, "again " * 300, "en", "a"), (74, text(20_000) + "\n é 日本", "en", "a")]
    full = [(i, t, lang, s, None if t is None else len(t), "clash", 5, b"x") for i, t, lang, s in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, block string, mix_key int, ids binary").repartition(4)


def test_stages_on_odd_rows(spark, sf_dir):
    import sentencepiece

    docs, out = odd_documents(spark).cache(), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir).cache()
        assert kept.columns == docs.columns, name
        before, after = docs.collect(), kept.collect()
        out[name] = collections.Counter(r.doc_id for r in after)
        assert set(out[name]) <= {r.doc_id for r in before} and all(r.block == "clash" and r.mix_key == 5 and r.ids == b"x" for r in after)
        docs = kept
    rules = out["quality_rules"]
    assert not {70, 71, 72, 73} & set(rules) and {*range(40), 50, 51, 52, 53, 60, 61, None, 74} <= set(rules)
    near = out["near_dedup"]
    assert near == collections.Counter({k: v for k, v in rules.items() if k not in (51, 52, 53)})
    assert out["suffix_dedup"] == near and set(out["source_mixing"]) == set(near) and all(out["source_mixing"][k] >= near[k] for k in near)
    text = collections.Counter((r.doc_id, r.text) for r in docs.collect())
    # The shared passage of 60 and 61 stays in the first of them only.
    long = {i: t for i, t in text if i in (60, 61)}
    assert len(long[61]) < len(long[60]) - 200
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    want = collections.Counter((i, tuple(sp.encode(t))) for (i, t), n in text.items() for _ in range(n))
    assert collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<i4").tolist())) for r in ids) == want and all(r.round_trip for r in ids)


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = odd_documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
