"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    score = sigmoid( b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j )

The pairwise sum takes linear time by the identity  1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ].

Features of a text: its words (lower-cased, hashed into BUCKETS, weighted by log(1 + count), scaled to length 1 together)
and word shapes (case and character classes, hashed likewise), structure statistics cut into bins (shares of symbols,
digits, capitals, repeated words and lines, word and line lengths) and, as metadata, the bin of n_chars where there is
that column.  doc_id, lang, source and labels are no features.

The model is fitted on the driver with a bounded sample: at most FIT_ROWS labelled rows, chosen by a hash of doc_id, each
with all its words, as in scoring; the driver holds 8 bytes for each distinct word of each of these texts (48 MB where they have 500).  It has BUCKETS * (RANK + 1) numbers, which is what is broadcast.  Scoring reads
every text whole, in one pass, without a shuffle.

Defined results: null and empty texts have structure features alone and get a score; repeated rows get equal
scores; a table without labelled rows gives the score 0.5 everywhere; an empty table gives no rows; null labels are left out;
a document with several labels counts once for each; a very long text is one row of features, one for each distinct word; a
null doc_id has no label and gets a score; other columns of either table are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freed, hash_sample, slices, table

BUCKETS, RANK = 1 << 15, 8
FIT_ROWS = 12_000
EPOCHS, RATE, DECAY, BATCH = 4, 0.08, 2e-6, 256
SYMBOLS = frozenset("#*$%&|<>!@^~_=+{}[]\\")
EDGES = np.array([0.0, 0.002, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 0.95])
SPACE = " \t\n\x0b\x0c\r"


def bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


def shape(word: str) -> str:
    """Classes of a word's characters, runs merged: Ab, AB, a#, a1 ..."""
    out = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "1" if c.isdigit() else c if c in SYMBOLS else "."
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


class Words:
    """Buckets of distinct words and of their shapes; a worker keeps the most recent ones."""

    most = 400_000

    def __init__(self):
        self.memo: dict[str, tuple[int, int, int]] = {}

    def of(self, word: str) -> tuple[int, int, int]:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) >= self.most:
                self.memo.clear()
            s = shape(word)
            kind = 2 if any(k in SYMBOLS for k in s) else 1 if len(word) > 1 and word.isupper() else 0
            got = self.memo[word] = (bucket("w:" + word.lower()), bucket("s:" + s), kind)
        return got


_WORDS = Words()


MARKS, DIGITS, STOPS = (np.frombuffer("".join(sorted(x)).encode(), np.uint8) for x in (SYMBOLS, "0123456789", ".!?"))


def structure(text: str, n_words: int, distinct: int, odd_words: int, upper_words: int, n_chars: int | None) -> list[int]:
    n = max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    # All characters that are counted are single bytes.
    seen = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    shares = {
        "digits": int(seen[DIGITS].sum()) / n,
        "symbols": int(seen[MARKS].sum()) / n,
        "bang": int(seen[ord("!")]) / max(1, n_words),
        "stops": int(seen[STOPS].sum()) / max(1, n_words),
        "odd": odd_words / max(1, n_words),
        "upper": upper_words / max(1, n_words),
        "repeat": 1 - distinct / max(1, n_words),
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
        "spaces": n_words / n,
        "pipes": int(seen[ord("|")]) / max(1, n_words),
    }
    out = [bucket(f"{k}:{int(i)}") for k, i in zip(shares, np.searchsorted(EDGES, list(shares.values())))]
    out.append(bucket(f"words:{int(np.log2(n_words + 1))}"))
    out.append(bucket(f"per_line:{int(np.log2(n_words / max(1, len(lines)) + 1))}"))
    out.append(bucket("chars:none" if n_chars is None else f"chars:{int(np.log2(max(0, n_chars) + 1))}"))
    return out


def features_many(texts: list[str], n_chars: list[int | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Indices and values of each text's features.  Words are told apart once for all texts and counted by sorting pairs of numbers."""
    words = [t.split() for t in texts]
    n, size = len(texts), np.array([len(w) for w in words], np.int64)
    flat = [w for x in words for w in x]
    codes, names = pd.factorize(np.array(flat, object)) if flat else (np.zeros(0, np.int64), [])
    known = np.array([_WORDS.of(w) for w in names], np.int64).reshape(-1, 3)
    many = max(1, len(names))
    pairs, count = np.unique(np.repeat(np.arange(n), size) * many + codes, return_counts=True)
    doc, word = pairs // many, pairs % many
    v = np.log1p(count)
    v /= np.sqrt(np.bincount(doc, v * v, n))[doc]
    shapes, at = np.unique(doc * BUCKETS + known[word, 1], return_inverse=True)
    shape_doc = shapes // BUCKETS
    sv = np.sqrt(np.bincount(at, count, len(shapes)) / np.maximum(1, size)[shape_doc])
    of_kind = lambda k: np.bincount(doc, count * (known[word, 2] == k), n).astype(int).tolist()
    st = [structure(t, *x) for t, *x in zip(texts, size.tolist(), np.bincount(doc, minlength=n).tolist(), of_kind(2), of_kind(1), n_chars)]
    each = len(st[0]) if st else 0
    own = np.r_[doc, shape_doc, np.repeat(np.arange(n), each)]
    order = np.argsort(own, kind="stable")
    idx = np.r_[known[word, 0], shapes % BUCKETS, np.array(st, np.int64).ravel()].astype(np.int32)[order]
    val = np.r_[v, sv, np.full(n * each, 0.5)].astype(np.float32)[order]
    ends = np.cumsum(np.bincount(own, minlength=n))
    return [(idx[i:j], val[i:j]) for i, j in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]


def features(text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    return features_many([text], [n_chars])[0]


def margins(rows: list[tuple[np.ndarray, np.ndarray]], bias: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The machine's output of each row, by the sum-of-squares identity."""
    idx = np.concatenate([r[0] for r in rows])
    val = np.concatenate([r[1] for r in rows])
    at = np.r_[0, np.cumsum([len(r[0]) for r in rows])[:-1]]
    lin = np.add.reduceat(w[idx] * val, at)
    vx = v[idx] * val[:, None]
    s = np.add.reduceat(vx, at, axis=0)
    q = np.add.reduceat(vx * vx, at, axis=0)
    return bias + lin + 0.5 * (s * s - q).sum(1)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 5) -> tuple[float, np.ndarray, np.ndarray]:
    """Adagrad on the logistic loss, by batches."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(BUCKETS, np.float32), (rng.standard_normal((BUCKETS, RANK)) * 0.02).astype(np.float32)
    if len(rows) == 0:
        return 0.0, w, np.zeros_like(v)
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    bias, gb = float(np.log(share / (1 - share))), 1e-6
    gw, gv = np.full(BUCKETS, 1e-6, np.float32), np.full((BUCKETS, RANK), 1e-6, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(rows), BATCH):
            part = [rows[i] for i in order[k : k + BATCH]]
            y = labels[order[k : k + BATCH]]
            idx = np.concatenate([r[0] for r in part])
            val = np.concatenate([r[1] for r in part])
            sizes = np.array([len(r[0]) for r in part])
            at = np.r_[0, np.cumsum(sizes)[:-1]]
            vx = v[idx] * val[:, None]
            s = np.add.reduceat(vx, at, axis=0)
            m = bias + np.add.reduceat(w[idx] * val, at) + 0.5 * (s * s - np.add.reduceat(vx * vx, at, axis=0)).sum(1)
            g = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y) / len(part)
            each = np.repeat(g, sizes)
            uniq, inv = np.unique(idx, return_inverse=True)
            dw = np.bincount(inv, each * val, len(uniq)).astype(np.float32) + DECAY * w[uniq]
            full = (each * val)[:, None] * (np.repeat(s, sizes, axis=0) - vx)
            dv = np.stack([np.bincount(inv, full[:, f], len(uniq)) for f in range(RANK)], 1).astype(np.float32) + DECAY * v[uniq]
            gw[uniq] += dw * dw
            gv[uniq] += dv * dv
            w[uniq] -= RATE * dw / np.sqrt(gw[uniq])
            v[uniq] -= 0.5 * RATE * dv / np.sqrt(gv[uniq])
            gb += float(g.sum()) ** 2
            bias -= RATE * float(g.sum()) / gb**0.5
    return bias, w, v


def fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, most=1_000_000):
        got = features_many(b.column(0).to_pylist(), b.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([b.column(2), pa.array([x[0].tobytes() for x in got], pa.binary()), pa.array([x[1].tobytes() for x in got], pa.binary())], names=["label", "idx", "val"])


def score_batches(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    bias, w, v = model.value
    for b in slices(batches, most=1_000_000):
        rows = features_many(b.column(1).to_pylist(), b.column(2).to_pylist())
        m = margins(rows, bias, w, v).astype(np.float64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(m, -30, 30))), pa.float64())], names=["doc_id", "score"])


def _n_chars(docs: DataFrame):
    return (F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.lit(None).cast("bigint")).alias("n_chars")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[float, np.ndarray, np.ndarray]:
    """labels: (doc_id, label) to learn from; at most FIT_ROWS of them are used."""
    known = labels.where(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("double").alias("label"))
    picked = hash_sample(known, FIT_ROWS, "doc_id", "label")
    # The sample has at most FIT_ROWS rows of two numbers, so it is broadcast.
    joined = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), _n_chars(docs)).join(F.broadcast(picked), "doc_id")
    got = joined.select("text", "n_chars", "label").mapInArrow(freed(fit_batches), "label double, idx binary, val binary").toPandas()
    if len(got) == 0:
        return 0.0, np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, RANK), np.float32)
    got = got.iloc[pd.Series([zlib.crc32(x) for x in got["idx"]]).argsort(kind="stable")]  # no order of arrival
    rows = [(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32)) for i, x in zip(got["idx"], got["val"])]
    return fit(rows, got["label"].to_numpy())


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), _n_chars(docs))
    return rows.mapInArrow(freed(lambda it: score_batches(it, sent)), "doc_id bigint, score double")


def held_out(i):
    return F.crc32(i.cast("string").cast("binary")) % 4 == 2


def op5_fm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out(F.col("doc_id")))
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
