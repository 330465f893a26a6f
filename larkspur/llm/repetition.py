"""Quality rules from repetition, found with suffix arrays over words.

Each document is a string of word ids.  The suffixes of all documents of a batch are sorted by prefix doubling (only
those still tied are sorted again), and the longest common prefix (LCP) of neighbours in that order is read off the ranks
of every doubling step.  A run of LCP values of at least m is an interval of suffixes that share m words: the
maximal repeated substrings.  The span that a suffix shares with its better neighbour is the longest that repeats
there; the union of these spans of `min_words` or more is what the document repeats.

A document is rejected if that union covers more than `max_covered` of its words, or if the longest repeat has more than
`max_longest` words.  Words in repeats of 8 lie in repeated windows of 3, so the base rule alone leaves a share of 0.5 at most.  The
limits lie beyond clean documents: of 3,243 that are labelled good and pass the base rule, none repeats more than 0.29 of its words
or more than 13 words in a row.

A very long text is one string: 4 bytes for each word and doubling step, and as many steps as the longest repeat has binary digits.

Defined results: a null or blank text has no words, counts 0, and fails the base rule; spans never cross documents;
equal rows give equal rows; an empty table gives no rows; other columns pass through `judge` and are ignored by `measure`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freed, slices, table, texts

SYMBOL = re.compile(r"[#*$%&|<>]")
SPACE = " \t\n\x0b\x0c\r"
#: Limits of the query and of the pipeline's stage.
LIMITS = {"min_words": 8, "max_covered": 0.4, "max_longest": 100}
FIELDS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat", "n_repeats")
SCHEMA = ", ".join(f"{c} bigint" for c in FIELDS)


def suffix_order(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order of the words of many documents, and the ranks after 1, 2, 4, ... words.

    ids: the word at each place, from 1; doc: its document.  A suffix ends with its document; what lies beyond has rank 0.
    """
    n = len(ids)
    last = np.flatnonzero(np.r_[doc[1:] != doc[:-1], True])
    end = last[doc - doc[0]] + 1 if n else last
    # Ties within one document only matter, so the document comes first.
    rank = ids.astype(np.int64)
    order = np.lexsort((rank, doc))
    new = np.r_[True, (rank[order][1:] != rank[order][:-1]) | (doc[order][1:] != doc[order][:-1])]
    first = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.r_[first, n])) + 1
    # Ranks are below the number of words of a batch, which is cut by bytes.
    ranks, h = [rank.astype(np.int32) if n < 1 << 31 else rank], 1
    while True:
        count = np.diff(np.r_[np.flatnonzero(new), n])
        tied = np.repeat(count > 1, count)
        if not tied.any():
            break
        at = np.flatnonzero(tied)
        i = order[at]
        j = i + h
        nxt = np.where(j < end[i], rank[np.minimum(j, n - 1)], 0)
        sub = np.lexsort((nxt, rank[i]))
        i, nxt = i[sub], nxt[sub]
        order[at] = i
        old = rank[i]
        fresh = np.r_[True, (old[1:] != old[:-1]) | (nxt[1:] != nxt[:-1])]
        new[at] = fresh
        begin = np.flatnonzero(fresh)
        rank = rank.copy()
        rank[i] = np.repeat(at[begin], np.diff(np.r_[begin, len(at)])) + 1
        ranks.append(rank.astype(ranks[0].dtype))
        h *= 2
    return order, ranks


def neighbour_lcp(order: np.ndarray, ranks: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
    """Words that each suffix in order shares with the one before it, 0 at a document's first."""
    n = len(order)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    last = np.flatnonzero(np.r_[doc[1:] != doc[:-1], True])
    end = last[doc - doc[0]] + 1
    at = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    i, j = order[at].copy(), order[at - 1].copy()
    ei = end[i]
    length = np.zeros(len(at), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        r = ranks[level]
        inside = (i < ei) & (j < ei)
        same = inside & (r[np.minimum(i, n - 1)] == r[np.minimum(j, n - 1)])
        step = same * (1 << level)
        i, j, length = i + step, j + step, length + step
    out[at] = length
    return out


def repeats(ids: np.ndarray, doc: np.ndarray, n_docs: int, min_words: int, window: int = 3) -> dict[str, np.ndarray]:
    """By document: words in repeated windows, words in repeats of min_words or more, the longest, the number of LCP intervals."""
    n = len(ids)
    zero = np.zeros(n_docs, np.int64)
    if n == 0:
        return {"n_repeat_words": zero, "n_covered": zero, "longest_repeat": zero, "n_repeats": zero}
    order, ranks = suffix_order(ids, doc)
    lcp = neighbour_lcp(order, ranks, doc)
    best = np.empty(n, np.int64)
    best[order] = np.maximum(lcp, np.r_[lcp[1:], 0])

    def covered(least: int, most: int | None) -> np.ndarray:
        at = np.flatnonzero(best >= least)
        span = best[at] if most is None else np.full(len(at), most)
        edge = np.bincount(at, minlength=n + 1) - np.bincount(at + span, minlength=n + 1)
        return np.bincount(doc[np.cumsum(edge)[:n] > 0], minlength=n_docs)

    longest = zero.copy()
    np.maximum.at(longest, doc, best)
    # An LCP interval of min_words begins where the LCP rises to it.
    high = lcp >= min_words
    begins = high & ~np.r_[False, high[:-1]]
    return {
        "n_repeat_words": covered(window, window),
        "n_covered": covered(min_words, None),
        "longest_repeat": np.where(longest >= min_words, longest, 0),
        "n_repeats": np.bincount(doc[order[begins]], minlength=n_docs),
    }


def duplicate_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


def measure_texts(values: list[str], min_words: int) -> dict[str, np.ndarray]:
    words = [t.encode("utf-8", "surrogatepass").split() for t in values]
    n_words = np.array([len(w) for w in words], np.int64)
    flat = [x for w in words for x in w]
    ids = pd.factorize(np.array(flat, object))[0].astype(np.int64) + 1 if flat else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(values)), n_words)
    # Ids of documents without words would leave holes in doc: number those that have some.
    has = n_words > 0
    dense = np.cumsum(has) - 1
    found = repeats(ids, dense[doc] if len(doc) else doc, int(has.sum()), min_words)
    out = {"n_words": n_words}
    out["word_chars"] = np.array([len(t) - sum(map(t.count, SPACE)) for t in values], np.int64)
    out["n_symbols"] = np.array([len(SYMBOL.findall(t)) for t in values], np.int64)
    out["n_dup_lines"] = np.array([duplicate_lines(t) for t in values], np.int64)
    for k, v in found.items():
        full = np.zeros(len(values), np.int64)
        full[has] = v
        out[k] = full
    return out


def measure_batches(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, most=1_000_000):
        got = measure_texts(b.column(1).to_pylist(), min_words)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[c], pa.int64()) for c in FIELDS[1:])], names=list(FIELDS))


def measure(docs: DataFrame, min_words: int = LIMITS["min_words"]) -> DataFrame:
    """The counts of every document, in one pass over its whole text and without a shuffle."""
    return texts(docs).mapInArrow(freed(lambda it: measure_batches(it, min_words)), SCHEMA)


def verdicts(measured: DataFrame, max_covered: float = LIMITS["max_covered"], max_longest: int = LIMITS["max_longest"]) -> DataFrame:
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = (F.col("n_covered") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return measured.withColumn("base_failed", base).withColumn("kept", ~base & fine)


def keep_batches(batches: Iterator[pa.RecordBatch], min_words: int, max_covered: float, max_longest: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, most=1_000_000):
        values = ["" if t is None else t for t in b.column(b.schema.get_field_index("text")).to_pylist()]
        m = measure_texts(values, min_words)
        base = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        fine = (m["n_covered"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_longest)
        yield b.filter(pa.array(~base & fine))


def keep(docs: DataFrame, **limits) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    at = LIMITS | limits
    return docs.mapInArrow(freed(lambda it: keep_batches(it, **at)), docs.schema)


def op3_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(measure(table(spark, sf_dir, "documents")))
