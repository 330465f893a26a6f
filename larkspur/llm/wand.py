"""Ranked lexical search of items in documents: WAND in document shards, whose heaps are merged.

Every item asks for its `top` best documents.  A first pass over all documents keeps what items can ask for: the number of
terms of a document and its occurrences of query terms, written as Parquet to the shared folder; N, L and the document
frequencies come from it.  Then a task reads its part of these postings shard by shard.  In a shard each query term has a
list of documents in order, with exact impacts and their maximum.  For an item the documents are walked in windows of doubling
length.  The pivot rule: terms are taken by ascending maximum, and as long as these sum to less than the heap's threshold, a
document that holds no further term cannot enter.  So only the lists from the pivot term on bring candidates; the lists before
it are never walked but probed at the candidates, from the largest maximum down, and a candidate goes as soon as what it has
plus what is left to probe falls below the threshold.  The heaps of an item pass from shard to shard of a task, and those of all tasks
meet in a ranking by item, which is limited before its shuffle.  Scores are exact 64-bit integers.

Items are worked on in blocks of about ITEM_BYTES of text each, which bounds what the driver and the broadcasts hold.

Defined results: a null or empty text has no terms, and a document without terms does not count; an item without terms has no rows; rows with one
item_id are items of their own, as are documents with one doc_id, each with its rank; null doc_ids come last among equal scores;
terms that more than half of the documents hold weigh less than nothing and lower scores; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, freed, new_dir, slices, table

#: Bytes of items' texts in a block, as expected: an item's block is a hash.
ITEM_BYTES = 4_000_000
#: Postings of a shard; a shard has one slice of documents at least.
SHARD = 2_000_000
FIRST_WINDOW = 256
TOP = 20
NO_ID = (1 << 63) - 1
#: Terms are runs of ASCII letters and digits and of all beyond ASCII; only A-Z are lower-cased.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

INDEX_SQL = "n_docs bigint, n_terms bigint, ids binary, lengths binary, sizes binary, terms binary, tfs binary"
TERMS_SQL = "uid bigint, item_id bigint, terms array<binary>, counts array<int>"
RANKED_SQL = "uid bigint, item_id bigint, doc_id bigint, score bigint"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def item_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        counted = [Counter(terms_of(t)) for t in b.column(2).cast(pa.binary()).to_pylist()]
        lists = [pa.array([list(c) for c in counted], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counted], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=["uid", "item_id", "terms", "counts"])


def index_batches(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> for each slice of documents their ids, numbers of terms, and numbers of query terms with these and their occurrences."""
    get = vocabulary.value.get
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 5]
    names = [x.split()[0] for x in INDEX_SQL.split(", ")]
    for b in slices(batches):
        ids, lengths, sizes, terms, tfs = [], [], [], [], []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            words = terms_of(text)
            if not words:
                continue
            found = Counter(map(get, words))
            found.pop(None, None)
            ids.append(NO_ID if doc_id is None else doc_id)
            lengths.append(len(words))
            sizes.append(len(found))
            terms.extend(found)
            tfs.extend(found.values())
        if ids:
            packed = [np.array(x, k).tobytes() for x, k in ((ids, "<i8"), (lengths, "<i8"), (sizes, "<i4"), (terms, "<i4"), (tfs, "<i4"))]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((len(ids), sum(lengths), *packed), kinds)], names=names)


def frequency_batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The documents that hold each term, summed over a task: a document has a term once."""
    df = np.zeros(n, np.int64)
    for b in batches:
        for raw in b.column(0).to_pylist():
            df += np.bincount(np.frombuffer(raw, "<i4"), minlength=n)
    at = np.flatnonzero(df)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["term", "df"])


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def norms(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    if int(lengths.max()) * 25 * n < 1 << 62:
        return 75 + 25 * lengths * n // total
    return np.array([75 + 25 * int(x) * n // total for x in lengths], np.int64)


class Shard:
    """Lists of documents by query term, with impacts and their maxima."""

    def __init__(self, ids, lengths, sizes, terms, tfs, weights: np.ndarray, n: int, total: int):
        m = norms(lengths, n, total)
        docs = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(terms, kind="stable")
        self.ids, self.docs = ids, docs[order].astype(np.int32)
        terms, tf = terms[order], tfs[order].astype(np.int64)
        self.impacts = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 12 * m[self.docs]))
        self.terms, starts = np.unique(terms, return_index=True)
        self.ends = np.r_[starts, len(terms)]
        # A document without a term has 0 from it, which is more than a negative impact.
        self.most = np.maximum(np.maximum.reduceat(self.impacts, starts), 0) if len(terms) else np.zeros(0, np.int64)

    def lists(self, terms: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(bound, count, start, end) of an item's lists here, by ascending bound."""
        at = np.searchsorted(self.terms, terms)
        here = np.flatnonzero(at < len(self.terms))
        here = here[self.terms[at[here]] == terms[here]]
        at, counts = at[here], counts[here]
        return sorted(zip((self.most[at] * counts).tolist(), counts.tolist(), self.ends[at].tolist(), self.ends[at + 1].tolist()))

    def search(self, terms: np.ndarray, counts: np.ndarray, heap: tuple[np.ndarray, np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray]:
        """heap: scores and ids found so far, best first; the heap after this shard."""
        lists = self.lists(terms, counts)
        if not lists or lists[-1][0] == 0:
            return heap
        bounds = np.cumsum([x[0] for x in lists])
        at, size, n = 0, FIRST_WINDOW, len(self.ids)
        while at < n:
            stop = min(n, at + size)
            least = int(heap[0][top - 1]) if len(heap[0]) == top else 1
            pivot = int(np.searchsorted(bounds, least))  # lists before the pivot sum to less than is needed
            if pivot == len(lists):
                break  # nothing here can enter, and the threshold never falls
            found, score = np.zeros(stop - at, bool), np.zeros(stop - at, np.int64)
            for k in range(pivot, len(lists)):
                _, count, start, end = lists[k]
                start, end = (start + int(x) for x in np.searchsorted(self.docs[start:end], (at, stop)))
                where = self.docs[start:end] - at
                score[where] += self.impacts[start:end] * count
                found[where] = True
            rest = int(bounds[pivot - 1]) if pivot else 0
            picked = np.flatnonzero(found & (score + rest >= least))
            score, picked = score[picked], picked + at
            for k in range(pivot - 1, -1, -1):
                if not len(picked):
                    break
                bound, count, start, end = lists[k]
                rest -= bound
                place = np.minimum(start + np.searchsorted(self.docs[start:end], picked), end - 1)
                score += np.where(self.docs[place] == picked, self.impacts[place] * count, 0)
                stay = score + rest >= least
                if not stay.all():
                    score, picked = score[stay], picked[stay]
            if len(picked):
                s, i = np.r_[heap[0], score], np.r_[heap[1], self.ids[picked]]
                best = np.lexsort((i, -s))[:top]
                heap = s[best], i[best]
            at, size = stop, size * 2
        return heap


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    kinds = ("<i8", "<i8", "<i4", "<i4", "<i4")
    held: list[list[np.ndarray]] = []
    size = 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            held.append([np.frombuffer(raw, k) for raw, k in zip(row, kinds)])
            size += len(held[-1][3])
            if size >= SHARD:
                yield [np.concatenate(x) for x in zip(*held)]
                held, size = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def rank_batches(batches: Iterator[pa.RecordBatch], sent, top: int) -> Iterator[pa.RecordBatch]:
    items, weights, n, total = sent.value
    heaps = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
    for arrays in shards(batches):
        shard = Shard(*arrays, weights, n, total)
        heaps = [shard.search(terms, counts, heap, top) for (_, _, terms, counts), heap in zip(items, heaps)]
    rows = [(uid, item_id, None if i == NO_ID else i, s) for (uid, item_id, _, _), heap in zip(items, heaps) for s, i in zip(heap[0].tolist(), heap[1].tolist())]
    for k in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + 10_000])], names=["uid", "item_id", "doc_id", "score"])


def rank_block(docs: DataFrame, items: list, top: int) -> DataFrame:
    """The best documents of each task for a block of items: uid, item_id, doc_id, score."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    asked = [(r.uid, r.item_id, np.array([vocabulary.setdefault(bytes(t), len(vocabulary)) for t in r.terms], np.int64), np.array(r.counts, np.int64)) for r in items]
    path = new_dir(spark, "postings")
    sent = spark.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows.mapInArrow(freed(lambda it: index_batches(it, sent)), INDEX_SQL).write.option("compression", "zstd").parquet(path)
    index = spark.read.parquet(path)
    n, total = (int(x or 0) for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    size = len(vocabulary)
    counted = index.select("terms").mapInArrow(lambda it: frequency_batches(it, size), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    weights = np.zeros(size, np.int64)
    for r in counted.collect():  # a row for each term of this block of items
        weights[r.term] = weight(n, r.df)
    told = spark.sparkContext.broadcast((asked, weights, n, total))
    return index.select("ids", "lengths", "sizes", "terms", "tfs").mapInArrow(freed(lambda it: rank_batches(it, told, top)), RANKED_SQL)


def rank(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the best documents of each row of items (item_id, text)."""
    spark = docs.sparkSession
    rows = items.select(F.monotonically_increasing_id().alias("uid"), F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    counted = cut(rows.mapInArrow(freed(item_batches), TERMS_SQL).where(F.size("terms") > 0))  # the ids of rows stay as they are
    size = counted.agg(F.sum(F.aggregate("terms", F.lit(0).cast("bigint"), lambda s, t: s + F.length(t) + 8))).first()[0] or 0
    blocks = int(-(-size // ITEM_BYTES))
    found = None
    for b in range(blocks):
        block = counted.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == b).collect()  # about ITEM_BYTES of terms
        if block:
            part = rank_block(docs, block, top)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    order = Window.partitionBy("uid").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_wand_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH word AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
     asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
     held AS (SELECT doc_id, count(*) AS n FROM word GROUP BY doc_id),
     total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM held),
     norm AS (SELECT doc_id, 100 - 25 + ((25 * n * docs) // l) AS m FROM held, total),
     tf AS (SELECT doc_id, term, count(*) AS tf FROM word WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
     weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, docs),
     scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
                FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN norm USING (doc_id) GROUP BY item_id, doc_id),
     ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
