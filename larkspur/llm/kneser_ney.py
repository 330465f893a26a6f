"""An interpolated modified Kneser-Ney model of word n-grams, counted in Spark and looked up in sorted hash arrays.

Tokens are lower-cased words and one end for each text; contexts at its start hold start marks, which are never predicted.  Level k holds
n-grams of k tokens: at the highest level with their counts c, below with the number of distinct tokens seen before them.  With the
discounts D of a level for counts of 1, 2 and 3 or more, which follow from its counts of counts,

    p(w | h) = (c(h w) - D(c(h w)) + (D1 N1(h) + D2 N2(h) + D3 N3(h)) p(w | h')) / c(h),

where N1, N2 and N3 tell how many tokens follow h once, twice and more often and h' lacks the first token of h; an unseen h gives p(w | h').
The lowest level is mixed with 1 / (V + 1) each for the V known tokens and one unknown, so all texts have a probability.

Counting: tasks sum the n-grams of some million tokens at a time and send them packed, with the words as hashes of 64 bits in a
dictionary of the pack.  An n-gram goes to the part of its context, so statistics of contexts are sums within a part; contexts that hold a
large share of all tokens, found in a pass before over all texts, are dealt out by the whole n-gram.  A part sums its n-grams, writes them as sorted
arrays of hashes to the shared folder, and sends on the n-grams of the level below and the statistics of its contexts.  What
goes on is checkpointed.  No task holds more than its part, and the driver gets some numbers for each part and the hot contexts.

Scoring: workers map the arrays into memory (`hash_arrays`) and look up the distinct n-grams of a batch of texts in the order of their hashes.
N-grams are told apart by 64 bits; among 10^9 of them two meet with a probability of about 0.03.

Defined results: a null or empty text is one end; a null doc_id is not held out; rows are texts of their own, also with one doc_id;
a very long text is scored whole; without training texts every token has the probability 1 of the one unknown; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, freed, new_dir, partitions, slices, table
from .hash_arrays import Arrays, write_part

#: The highest level of the query.  Trigrams take about five times the disk of the documents, bigrams under four (see the README).
ORDER = 2
#: Tokens whose n-grams a task sums at a time, and bytes of text that are scored at a time.
GATHER, BATCH = 1_500_000, 6_000_000
#: A context with this share of the tokens of a part is dealt out.
HOT_SHARE = 0.25
#: Counts of an n-gram are one byte; those from here on are in arrays of their own.
MANY = 255
#: Bits of an n-gram's key that tell its part.
HIGH = 20
LOW = np.uint64((1 << (64 - HIGH)) - 1)
START, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xA0761D6478BD642F)
#: Kinds of rows that a part sends on.
GRAMS, CONTEXTS, NUMBERS = 0, 1, 2
SENT_SQL = "kind int, part int, pack binary"
SENT = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("pack", pa.binary())])
UNIGRAM = np.dtype([("a", "<u8"), ("raw", "<u8")])
CONTEXT = np.dtype([("total", "<u8"), ("spare", "<f8")])
SCORE_SQL = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


# --- hashes


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def longer(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from those of its context and its last word; no words have the hash 0."""
    return mix(context * np.uint64(0x9E3779B97F4A7C15) + word)


def hash_of(words: list[np.ndarray]) -> np.ndarray:
    h = np.uint64(0)
    for w in words:
        h = longer(h, w)
    return h


def keys_of(context: np.ndarray, whole: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The leading bits of the context's hash, or of the whole n-gram's where the context is hot, and the rest of the n-gram's."""
    lead = np.where(np.isin(context, hot), whole, context)
    return (lead & ~LOW) | (whole & LOW)


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> np.uint64(64 - HIGH)) * np.uint64(parts) >> np.uint64(HIGH)).astype(np.int64)


def sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, a place of each, and the sums of values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], order[first], [np.add.reduceat(v[order], first) if len(first) else v for v in values]


# --- packs


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers, each in the least type that holds it."""
    out = [bytes([len(arrays)])]
    for x in arrays:
        top = int(x.max()) if len(x) else 0
        kind = next(k for k in (1, 2, 4, 8) if top < 1 << (8 * k))
        out += [bytes([kind]), len(x).to_bytes(8, "little"), x.astype(f"<u{kind}").tobytes()]
    return b"".join(out)


def unpack(raw: bytes) -> list[np.ndarray]:
    out, at = [], 1
    for _ in range(raw[0]):
        kind, n = raw[at], int.from_bytes(raw[at + 1 : at + 9], "little")
        out.append(np.frombuffer(raw, f"<u{kind}", n, at + 9).astype(np.uint64))
        at += 9 + kind * n
    return out


def dealt(kind: int, part: np.ndarray, arrays: list[np.ndarray], words: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows of packs by part.  The first `words` arrays are hashes of words and share a dictionary; the first of all is kept as runs."""
    order = np.argsort(part, kind="stable")
    arrays, cuts = [x[order] for x in arrays], np.flatnonzero(np.diff(part[order], prepend=-1, append=-1)).tolist()
    numbers = part[order][cuts[:-1]].tolist() if len(part) else []
    for number, i, j in zip(numbers, cuts, cuts[1:]):
        own = [x[i:j] for x in arrays]
        if words:
            found, back = np.unique(np.concatenate(own[:words]), return_inverse=True)
            lead, *rest = np.split(back, words)
            runs = np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]])
            own = [found, lead[runs], np.diff(np.r_[runs, len(lead)]), *rest, *own[words:]]
        yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([number], pa.int32()), pa.array([pack(*own)], pa.binary())], schema=SENT)


def gathered(packs: list[bytes], words: int) -> list[np.ndarray]:
    """The columns of some packs, one after the other."""
    rows = []
    for p in packs:
        got = unpack(p)
        if words:
            lead = np.repeat(got[1], got[2].astype(np.int64))
            got = [*(got[0][ix.astype(np.int64)] for ix in (lead, *got[3 : words + 2])), *got[words + 2 :]]
        rows.append(got)
    return [np.concatenate(x) for x in zip(*rows)]


# --- texts


class Grams:
    """The n-grams up to level n of some texts: at each place of the stream of tokens the number of the n-gram that ends there."""

    def __init__(self, found: pa.Array, n: int):
        import xxhash

        c = pa.compute
        split = c.ascii_split_whitespace(c.ascii_lower(found))
        sizes = c.list_value_length(split).to_numpy(zero_copy_only=False)
        flat = split.flatten()
        real = c.greater(c.binary_length(flat), 0)
        coded = flat.filter(real).dictionary_encode()
        self.counts = np.bincount(np.repeat(np.arange(len(found)), sizes)[real.to_numpy(zero_copy_only=False)], minlength=len(found))
        known = [xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()]
        self.words = np.r_[np.array(known, np.uint64), START, END]
        doc = np.repeat(np.arange(len(found)), self.counts)
        ends = np.cumsum(self.counts + n) - 1
        stream = np.full(len(doc) + n * len(found), len(known), np.int64)
        stream[np.arange(len(doc)) + (doc + 1) * (n - 1) + doc] = coded.indices.to_numpy(zero_copy_only=False)
        stream[ends] = len(known) + 1
        #: Places that are predicted, and where those of each text begin.
        self.at = np.ones(len(stream), bool)
        for k in range(n - 1):
            self.at[np.cumsum(self.counts + n) - (self.counts + n) + k] = False
        self.starts = np.cumsum(self.counts + 1) - (self.counts + 1)
        self.ids, self.hashes = [stream], [longer(np.uint64(0), self.words)]
        self.contexts, self.last = [np.zeros(len(self.words), np.int64)], [np.arange(len(self.words))]
        for _ in range(n - 1):
            both, back = np.unique(np.r_[0, self.ids[-1][:-1]] * len(self.words) + stream, return_inverse=True)
            context, last = np.divmod(both, len(self.words))
            self.ids.append(back)
            self.hashes.append(longer(self.hashes[-1][context], self.words[last]))
            self.contexts.append(context)
            self.last.append(last)

    def counted(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of level k that are predicted, and how often."""
        n = np.bincount(self.ids[k - 1][self.at], minlength=len(self.hashes[k - 1]))
        seen = np.flatnonzero(n)
        return seen, n[seen].astype(np.uint64)

    def spelt(self, k: int, which: np.ndarray) -> list[np.ndarray]:
        """The words of n-grams of level k, as hashes."""
        out = []
        for level in range(k - 1, -1, -1):
            out.append(self.words[self.last[level][which]])
            which = self.contexts[level][which]
        return out[::-1]


def chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.Array]:
    """Texts of about GATHER tokens."""
    held, size = [], 0
    for b in slices(batches, most=BATCH):
        held.append(b.column(column))
        size += b.column(column).nbytes
        if size >= 6 * GATHER:
            yield pa.concat_arrays(held)
            held, size = [], 0
    if held:
        yield pa.concat_arrays(held)


# --- counting


def share_batches(batches: Iterator[pa.RecordBatch], n: int, share: float) -> Iterator[pa.RecordBatch]:
    """(level, hash, tokens) of contexts with a share of a chunk's tokens, and the number of all tokens under level 0."""
    for text in chunks(batches, 0):
        g = Grams(text, max(1, n - 1))
        total = int(g.at.sum())
        rows = [(0, 0, total)]
        for k in range(1, n):
            seen, count = g.counted(k)
            hot = count >= share * total
            rows += [(k, h, c) for h, c in zip(g.hashes[k - 1][seen[hot]].view(np.int64).tolist(), count[hot].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64()))], names=["level", "hash", "n"])


def hot_contexts(rows: DataFrame, n: int, parts: int) -> list[np.ndarray]:
    """For each length the contexts with a large share of the tokens.

    A context with a share of all tokens has it in one chunk at least.  There are at most 2 parts / HOT_SHARE of a length.
    """
    if n == 1:
        return [np.zeros(0, np.uint64)]
    share = HOT_SHARE / parts
    found = cut(rows.mapInArrow(freed(lambda it: share_batches(it, n, share)), "level int, hash bigint, n bigint").groupBy("level", "hash").agg(F.sum("n").alias("n")))
    total = found.where("level = 0").agg(F.sum("n")).first()[0] or 0
    picked = found.where((F.col("level") > 0) & (F.col("n") >= share * total / 2)).collect()
    return [np.array([r.hash for r in picked if r.level == k], np.int64).view(np.uint64) for k in range(n)]


def count_batches(batches: Iterator[pa.RecordBatch], n: int, hot: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    for text in chunks(batches, 0):
        g = Grams(text, n)
        seen, count = g.counted(n)
        context = g.hashes[n - 2][g.contexts[n - 1][seen]] if n > 1 else np.zeros(len(seen), np.uint64)
        key = keys_of(context, g.hashes[n - 1][seen], hot) if n > 1 else g.hashes[0][seen]
        yield from dealt(GRAMS, part_of(key, parts), [*g.spelt(n, seen), count], n)


def level_batches(batches: Iterator[pa.RecordBatch], k: int, hot: list[np.ndarray], parts: int, path: str) -> Iterator[pa.RecordBatch]:
    """The packs of a part -> its sorted arrays, and packs for the level below and for contexts.  hot: contexts by their length."""
    packs: dict[int, list[bytes]] = {}
    for b in batches:
        for number, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            packs.setdefault(number, []).append(p)
    for number in sorted(packs):
        columns = gathered(packs.pop(number), k)
        words, a, raw = columns[:k], columns[k], columns[-1]  # at the highest level both are the count
        whole = hash_of(words)
        context = hash_of(words[:-1]) if k > 1 else np.zeros(len(whole), np.uint64)
        keys, first, (a, raw) = sums(keys_of(context, whole, hot[k - 1]) if k > 1 else whole, a, raw)
        words, context = [w[first] for w in words], context[first]
        if k == 1:
            values = np.zeros(len(keys), UNIGRAM)
            values["a"], values["raw"] = a, raw
        else:
            values, large = np.minimum(a, MANY).astype("<u1"), a >= MANY
            if large.any():
                write_part(f"{path}/large-{k}", number, keys[large], a[large].astype("<u8"))
        write_part(f"{path}/grams-{k}", number, keys, values)
        above = keys[a >= MANY][:1].tolist() if k > 1 else []
        numbers = [int(keys[0]), len(keys), int(a.sum()), int(raw.sum()), *(int((a == c).sum()) for c in (1, 2, 3, 4)), *above]
        yield pa.RecordBatch.from_arrays([pa.array([NUMBERS], pa.int32()), pa.array([number], pa.int32()), pa.array([pack(np.array(numbers, np.uint64))], pa.binary())], schema=SENT)
        if k > 1:
            below = hash_of(words[1:])
            found, first, (one, raw) = sums(below, np.ones(len(keys), np.uint64), raw)
            low = [w[first] for w in words[1:]]
            key = keys_of(hash_of(low[:-1]), found, hot[k - 2]) if k > 2 else found
            yield from dealt(GRAMS, part_of(key, parts), [*low, one, raw], k - 1)
            found, _, follows = sums(context, a, *((x).astype(np.uint64) for x in (a == 1, a == 2, a >= 3)))
            yield from dealt(CONTEXTS, part_of(found, parts), [found, *follows])


def context_batches(batches: Iterator[pa.RecordBatch], path: str, discounts: tuple) -> Iterator[pa.RecordBatch]:
    """Packs of contexts of a part -> sorted arrays of how often each is followed, and of what its discounts spare."""
    packs: dict[int, list[bytes]] = {}
    for b in batches:
        for number, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            packs.setdefault(number, []).append(p)
    for number in sorted(packs):
        found, *follows = gathered(packs.pop(number), 0)
        keys, _, (total, *n) = sums(found, *follows)
        values = np.zeros(len(keys), CONTEXT)
        values["total"], values["spare"] = total, sum(d * x for d, x in zip(discounts[1:], n))
        write_part(path, number, keys, values)
        yield pa.RecordBatch.from_arrays([pa.array([NUMBERS], pa.int32()), pa.array([number], pa.int32()), pa.array([pack(keys[:1])], pa.binary())], schema=SENT)


def discounts_of(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float, float]:
    """Of counts of 0, 1, 2 and more.  Where too few n-grams tell them, half of what they can be at most."""
    if min(n1, n2, n3) > 0:
        y = n1 / (n1 + 2 * n2)
        found = (0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        if all(0 < d < k for k, d in enumerate(found[1:], 1)):
            return found
    return (0.0, 0.5, 1.0, 1.5)


@dataclass
class Model:
    order: int
    hot: list[np.ndarray]
    #: Known tokens, their occurrences, and the sum of the counts of the lowest level.
    vocabulary: int = 0
    tokens: int = 0
    total: int = 0
    spare: float = 0.0
    grams: dict[int, Arrays] = field(default_factory=dict)
    large: dict[int, Arrays] = field(default_factory=dict)
    contexts: dict[int, Arrays] = field(default_factory=dict)
    discounts: dict[int, tuple] = field(default_factory=dict)

    def probabilities(self, g: Grams) -> tuple[np.ndarray, np.ndarray]:
        """At each place of the stream the probability, and how often the token is in the training texts."""
        keys, back = np.unique(g.hashes[0], return_inverse=True)
        got = self.grams[1].find(keys)[back]
        a, unknown = got["a"].astype(float), 1 / (self.vocabulary + 1)
        each = (a - np.take(self.discounts[1], np.minimum(got["a"], 3).astype(int)) + self.spare * unknown) / self.total if self.total else np.full(len(a), unknown)
        p = each[g.ids[0]]
        for k in range(2, self.order + 1):
            context = g.hashes[k - 2]
            keys, back = np.unique(context, return_inverse=True)
            told = self.contexts[k].find(keys)[back][g.contexts[k - 1]]
            keys, back = np.unique(keys_of(context[g.contexts[k - 1]], g.hashes[k - 1], self.hot[k - 1]), return_inverse=True)
            a = self.grams[k].find(keys).astype(np.uint64)
            a[a == MANY] = self.large[k].find(keys[a == MANY])
            a = a[back]
            total = np.maximum(told["total"], 1).astype(float)
            own = (a.astype(float) - np.take(self.discounts[k], np.minimum(a, 3).astype(int))) / total
            rest = np.where(told["total"] > 0, told["spare"] / total, 1.0)
            at = g.ids[k - 1]
            p = own[at] + rest[at] * p
        return p, got["raw"][g.ids[0]]


def train(docs: DataFrame, order: int = ORDER, path: str | None = None) -> Model:
    """The model of all texts of docs; its arrays stay in the shared folder, under `path`."""
    spark = docs.sparkSession
    path, parts = path or new_dir(spark, "ngrams"), partitions(spark)
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    hot = hot_contexts(rows, order, parts)
    model = Model(order, hot)
    sent = rows.mapInArrow(freed(lambda it: count_batches(it, order, hot[order - 1], parts)), SENT_SQL)
    for k in range(order, 0, -1):
        by_part = sent.where(F.col("kind") == GRAMS).repartitionById(parts, F.col("part"))
        sent = cut(by_part.mapInArrow(freed(lambda it, k=k: level_batches(it, k, hot, parts, path)), SENT_SQL))
        # A row for each part: its first key, sums, and the first of its keys with a large count, if there is one.
        told = sorted((int(x[0]), r.part, *(int(v) for v in x[1:])) for r in sent.where(F.col("kind") == NUMBERS).collect() for x in unpack(r.pack))
        types, total, raw, n1, n2, n3, n4 = (sum(x[i] for x in told) for i in range(2, 9))
        d = model.discounts[k] = discounts_of(n1, n2, n3, n4)
        model.grams[k] = Arrays(f"{path}/grams-{k}", UNIGRAM if k == 1 else "<u1", [(number, first) for first, number, *_ in told])
        if k > 1:
            model.large[k] = Arrays(f"{path}/large-{k}", "<u8", [(x[1], x[9]) for x in told if len(x) > 9])
            dealt_out = sent.where(F.col("kind") == CONTEXTS).repartitionById(parts, F.col("part"))
            written = dealt_out.mapInArrow(freed(lambda it, k=k, d=d: context_batches(it, f"{path}/contexts-{k}", d)), SENT_SQL).collect()  # a row for each part
            firsts = sorted((int(unpack(r.pack)[0][0]), r.part) for r in written)
            model.contexts[k] = Arrays(f"{path}/contexts-{k}", CONTEXT, [(number, first) for first, number in firsts])
        else:
            model.vocabulary, model.tokens, model.total, model.spare = types, raw, total, d[1] * n1 + d[2] * n2 + d[3] * (types - n1 - n2)
    return model


# --- scoring


def score_batches(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    model: Model = sent.value
    for b in slices(batches, most=BATCH):
        g = Grams(b.column(1), model.order)
        p, raw = model.probabilities(g)
        p, raw = np.log10(p[g.at]), raw[g.at].astype(np.int64)
        base = np.log10((raw + 1) / (model.tokens + model.vocabulary + 1))
        known, base, score = (np.add.reduceat(x, g.starts) for x in ((raw > 0).astype(np.int64), base, p))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in (g.counts + 1, known, base, score))], names=[x.split()[0] for x in SCORE_SQL.split(", ")])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Log10 probabilities of whole texts under the model, and under single tokens with one added to each count."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(freed(lambda it: score_batches(it, sent)), SCORE_SQL).withColumn("train_tokens", F.lit(model.tokens).cast("bigint"))


def held_out(i):
    return F.coalesce(F.crc32(i.cast("bigint").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op13_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs.where(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: Bigrams as the query counts them; a space stands for the start and an empty word for the end.
OP13_SQL = r"""
WITH byte AS (SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
     doc AS (SELECT row_number() OVER () AS d, doc_id,
                list_concat(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ['']) AS words,
                xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 2 AS held_out FROM documents, byte),
     word AS (SELECT d, held_out, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM doc),
     pair AS (SELECT d, held_out, w, lag(w, 1, ' ') OVER (PARTITION BY d ORDER BY i) AS v FROM word),
     two AS (SELECT v, w, count(*) AS c FROM pair WHERE NOT held_out GROUP BY v, w),
     one AS (SELECT w, sum(c)::BIGINT AS raw, count(*) AS c FROM two GROUP BY w),
     counts AS (SELECT 2 AS k, c FROM two UNION ALL SELECT 1, c FROM one),
     many AS (SELECT k, count(*) AS types, sum(c)::BIGINT AS total, count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, count(*) FILTER (c = 3) AS n3,
                count(*) FILTER (c = 4) AS n4 FROM counts GROUP BY k),
     told AS (SELECT *, n1 / (n1 + 2 * n2) AS y, 1 - 2 * y * n2 / n1 AS e1, 2 - 3 * y * n3 / n2 AS e2, 3 - 4 * y * n4 / n3 AS e3,
                least(n1, n2, n3) > 0 AND e1 > 0 AND e1 < 1 AND e2 > 0 AND e2 < 2 AND e3 > 0 AND e3 < 3 AS fine FROM many),
     spare AS (SELECT k, types, total, n1, n2, CASE WHEN fine THEN e1 ELSE 0.5 END AS d1, CASE WHEN fine THEN e2 ELSE 1 END AS d2, CASE WHEN fine THEN e3 ELSE 1.5 END AS d3 FROM told),
     low AS (SELECT types AS v, total, d1, d2, d3, (d1 * n1 + d2 * n2 + d3 * (types - n1 - n2)) / (types + 1) AS rest FROM spare WHERE k = 1),
     ctx AS (SELECT v, sum(c)::BIGINT AS total, (any_value(d1) * count(*) FILTER (c = 1) + any_value(d2) * count(*) FILTER (c = 2) + any_value(d3) * count(*) FILTER (c > 2))
                / sum(c)::BIGINT AS rest FROM two, spare WHERE k = 2 GROUP BY v),
     n AS (SELECT coalesce(sum(raw), 0)::BIGINT AS n, count(*) AS v FROM one),
     p AS (SELECT d, coalesce(one.raw, 0) AS raw, n.n, n.v AS known,
                (coalesce(one.c, 0) - CASE coalesce(one.c, 0) WHEN 0 THEN 0 WHEN 1 THEN low.d1 WHEN 2 THEN low.d2 ELSE low.d3 END + low.rest) / low.total AS p1,
                coalesce((coalesce(two.c, 0) - CASE coalesce(two.c, 0) WHEN 0 THEN 0 WHEN 1 THEN s.d1 WHEN 2 THEN s.d2 ELSE s.d3 END) / ctx.total, 0) AS own, coalesce(ctx.rest, 1) AS rest
           FROM pair LEFT JOIN one ON one.w = pair.w LEFT JOIN two ON two.v = pair.v AND two.w = pair.w LEFT JOIN ctx ON ctx.v = pair.v CROSS JOIN low CROSS JOIN n
                CROSS JOIN (SELECT * FROM spare WHERE k = 2) s),
     scored AS (SELECT d, count(*) AS n_tokens, count(*) FILTER (raw > 0) AS n_known, any_value(n) AS train_tokens, fsum(log10((raw + 1) / (n + known + 1))) AS base_score,
                fsum(log10(own + rest * p1)) AS score FROM p GROUP BY d)
SELECT doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score FROM scored JOIN doc USING (d)
"""
