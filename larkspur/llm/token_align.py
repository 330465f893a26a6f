"""Alignment of the tokens of two tokenizers by a transducer on dangling suffixes.

Both encodings of a text spell the same bytes.  The transducer reads their tokens in turn; its state is which side leads and
by which bytes the other side has not matched yet.  The side that lags gives the next token, which shortens the residual or takes
the lead with what dangles beyond it.  An empty residual is a byte offset where tokens of both sides end, so it closes a
group.  Transitions are memoised by state and token.  Links are all pairs of an A and a B token of one group; a group of many tokens is
counted by its distinct ids, never pair by pair.

Neither tokenizer joins what a space between two other characters than white space sets apart: A's splitting pattern begins a new
word there, and no piece of B holds a space behind another character.  So the texts of a batch fall into units at these places;
distinct units are encoded and aligned once, a text of any length is its units one after the other, and a worker remembers
some units between batches.

How many documents hold a linked pair of ids is counted over all documents: unique pairs of documents go to Parquet in the shared
folder, are summed in tasks and then by pair, and come back as sorted arrays mapped by the workers (`hash_arrays`).  There are at most as many
pairs as the product of both vocabularies, whatever the corpus.

Defined results: null and empty texts, and those whose tokens do not spell a space and the text (one with U+2581, say), have no tokens:
zeros, and '' for the hash.  Strings of special tokens are plain text.  Rows are documents of their own, also with one doc_id
or none.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, freed, new_dir, partitions, slices, table, texts
from .hash_arrays import Arrays, write_part
from .record_files import Encoder

#: Units in a generation of what a worker remembers, of at most LONGEST characters; two generations are held, about 100 MB.
MEMO, LONGEST = 100_000, 40
#: Transitions that a worker remembers.
TRANSITIONS = 500_000
#: Bytes of text that are aligned at a time.
BATCH = 2_000_000
#: Pairs that a task gathers before it sums them.
GATHER = 2_000_000
BLANK = "▁"
#: Where units part in texts with further white space.
PART = re.compile(r"(?<=\S) (?=\S)")
#: A unit whose tokens do not spell it.
BAD = (b"", (0, 0, 0, 0, 1), b"", b"")

ALIGNED_SQL = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary"
FOUND_SQL = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    """State 0 is the empty residual and takes a token of A; any other state takes one of the side that lags."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.bytes = {True: a_bytes, False: b_bytes}
        self.bits = max(len(a_bytes), len(b_bytes)).bit_length()
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple[bool, bytes]] = [(False, b"")]
        self.takes_a = [True]
        self.number = {(False, b""): 0}
        self.memo: dict[int, int] = {}

    def _learn(self, state: int, token: int) -> int:
        a_leads, residual = self.states[state]
        takes_a = self.takes_a[state]
        spelt = self.bytes[takes_a][token]
        if residual.startswith(spelt):
            key = (a_leads, residual[len(spelt) :])
        elif spelt.startswith(residual):
            key = (takes_a, spelt[len(residual) :])
        else:
            key = None
        if key is None:
            to = -1
        elif not key[1]:
            to = 0
        else:
            to = self.number.setdefault(key, len(self.states))
            if to == len(self.states):
                self.states.append(key)
                self.takes_a.append(not key[0])
        self.memo[state << self.bits | token] = to
        return to

    def groups(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """The ends of each group in both lists; None if they do not spell the same."""
        if len(self.memo) > TRANSITIONS:
            self._forget()
        get, takes_a, bits = self.memo.get, self.takes_a, self.bits
        ends: list[tuple[int, int]] = []
        i = j = state = 0
        n, m = len(a), len(b)
        while True:
            if takes_a[state]:
                if i == n:
                    break
                token = a[i]
                i += 1
            else:
                if j == m:
                    break
                token = b[j]
                j += 1
            to = get(state << bits | token)
            if to is None:
                to = self._learn(state, token)
            if to <= 0:
                if to:
                    return None
                ends.append((i, j))
            state = to
        return ends if state == 0 and i == n and j == m else None


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = Encoder(a_path)
        self.a.tok.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        a_bytes = [b""] * self.a.tok.get_vocab_size()
        for t, i in self.a.tok.get_vocab().items():
            a_bytes[i] = bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        assert not any(BLANK in p.lstrip(BLANK) for p in pieces)
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.a_bytes, self.n_b = a_bytes, len(b_bytes)
        self.sizes = np.array([len(x) for x in a_bytes])
        #: Strings of ids, and of groups of one token each.
        self.numbers = list(map(str, range(max(len(a_bytes), len(b_bytes)))))
        self.names: dict[int, str] = {}
        self.transducer = Transducer(a_bytes, b_bytes)
        self.memo: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def _name(self, a: list[int], b: list[int]) -> str:
        return ",".join(map(self.numbers.__getitem__, a)) + "|" + ",".join(map(self.numbers.__getitem__, b))

    def _aligned(self, a: list[int], b: list[int]) -> tuple:
        """(string of the groups, numbers, pairs of ids, times that each is linked, or nothing if that is once) of a unit."""
        ends = self.transducer.groups(a, b)
        if ends is None:
            return BAD
        names, pairs, times, i, j, n_b, known = [], [], None, 0, 0, self.n_b, self.names
        n = len(ends)
        if n == len(a) == len(b):  # groups of one token each
            pairs = [p * n_b + q for p, q in zip(a, b)]
            names = list(map(known.get, pairs))
            if None not in names:
                return ";".join(names).encode(), (n, n, n, n, 0), array("q", pairs).tobytes(), b""
            names, pairs = [], []
        for k, m in ends:
            if k - i == 1 == m - j:
                key = a[i] * n_b + b[j]
                name = known.get(key)
                if name is None:
                    if len(known) >= TRANSITIONS:
                        known.clear()
                    name = known[key] = f"{a[i]}|{b[j]}"
                names.append(name)
                pairs.append(key)
            else:
                x, y = a[i:k], b[j:m]
                names.append(self._name(x, y))
                if len(x) * len(y) < 64:
                    pairs += [p * n_b + q for p in x for q in y]
                else:
                    (p, s), (q, t) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
                    times = times or {}
                    for key, n in zip((p[:, None] * n_b + q).ravel().tolist(), (s[:, None] * t).ravel().tolist()):
                        times[len(pairs)] = n
                        pairs.append(key)
            i, j = k, m
        often = array("q", [times.get(k, 1) for k in range(len(pairs))]) if times else None
        return ";".join(names).encode(), (len(a), len(b), len(ends), sum(often) if often else len(pairs), 0), array("q", pairs).tobytes(), often.tobytes() if often else b""

    def _spells(self, units: list[str], ids: list[list[int]]) -> list[bool]:
        """Whether the tokens of A spell a space and the unit, as they do without a normalizer: all at once, or else one by one."""
        flat = np.fromiter((t for x in ids for t in x), np.int32)
        spelt = b"".join(pa.array([" " + u for u in units]).cast(pa.binary()).to_pylist())
        sizes = np.add.reduceat(self.sizes[flat], np.cumsum([0, *map(len, ids[:-1])])) if len(flat) and all(ids) else None
        if sizes is not None and sizes.tolist() == [len(u.encode()) + 1 for u in units] and b"".join(map(self.a_bytes.__getitem__, flat.tolist())) == spelt:
            return [True] * len(units)
        return [b"".join(map(self.a_bytes.__getitem__, x)) == b" " + u.encode() for u, x in zip(units, ids)]

    def units(self, units: list[str]) -> list[tuple]:
        memo, old = self.memo, self.old.get
        got = list(map(memo.get, units))
        fresh = [k for k, g in enumerate(got) if g is None]
        for k in fresh:
            got[k] = old(units[k])
        missing = [k for k in fresh if got[k] is None]
        one = [k for k in missing if " " not in units[k]]
        rest = [k for k in missing if " " in units[k]]
        for at, ids in ((one, self.a._spaced([units[k] for k in one])), (rest, self.a._raw([" " + units[k] for k in rest]))):
            if at:
                some, flat = [units[k] for k in at], np.frombuffer(b"".join(ids), self.a.kind).tolist()
                cuts = np.cumsum([0, *map(len, ids)]) // self.a.width
                a = [flat[i:j] for i, j in zip(cuts.tolist(), cuts[1:].tolist())]
                for k, fine, x, y in zip(at, self._spells(some, a), a, self.b.encode(some, num_threads=1)):
                    got[k] = self._aligned(x, y) if fine else BAD
        if len(memo) >= MEMO:
            self.old, self.memo = memo, {}
        self.memo.update((units[k], got[k]) for k in fresh if len(units[k]) <= LONGEST)
        return got

    def split(self, found: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct units, the unit of each occurrence, and where the occurrences of each text begin and end."""
        c = pa.compute
        odd = c.or_(c.match_substring_regex(found, Encoder.odd), c.or_(c.starts_with(found, " "), c.ends_with(found, " ")))
        split = c.split_pattern(found, " ")
        if c.any(odd).as_py():
            split = pa.array([PART.split(t) if o else t.split(" ") for t, o in zip(found.to_pylist(), odd.to_pylist())], pa.list_(pa.string()))
        flat = split.flatten().dictionary_encode()
        sizes = c.list_value_length(split).to_numpy(zero_copy_only=False)
        return flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(sizes)]

    def align(self, found: pa.Array) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, string of the groups, pairs, times) of each text."""
        units, at, cuts = self.split(found)
        got = self.units(units)
        strings = [g[0] for g in got]
        numbers = np.array([g[1] for g in got], np.int64).reshape(-1, 5)
        sizes = np.array([len(g[2]) // 8 for g in got])
        pairs = np.frombuffer(b"".join(g[2] for g in got), "<i8")
        times = np.ones(len(pairs), np.int64)
        for k, first in zip([k for k, g in enumerate(got) if g[3]], (np.cumsum(sizes) - sizes)[[k for k, g in enumerate(got) if g[3]]].tolist()):
            times[first : first + sizes[k]] = np.frombuffer(got[k][3], "<i8")
        doc = np.repeat(np.arange(len(found)), np.diff(cuts))
        # A unit counts once for each text, as often as it occurs there.
        both, often = np.unique(doc * len(units) + at, return_counts=True)
        doc_of, unit = np.divmod(both, max(1, len(units)))
        n = sizes[unit]
        where = np.repeat((np.cumsum(sizes) - sizes)[unit] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key_doc, key_pair, key_times = np.repeat(doc_of, n), pairs[where], times[where] * np.repeat(often, n)
        order = np.lexsort((key_pair, key_doc))
        key_doc, key_pair, key_times = key_doc[order], key_pair[order], key_times[order]
        first = np.flatnonzero(np.r_[True, (key_doc[1:] != key_doc[:-1]) | (key_pair[1:] != key_pair[:-1])]) if len(order) else np.zeros(0, np.int64)
        sums = np.add.reduceat(key_times, first) if len(first) else key_times
        key_doc, key_pair = key_doc[first], key_pair[first]
        ends = np.searchsorted(key_doc, np.arange(len(found) + 1)).tolist()
        out, cuts = [], cuts.tolist()
        totals = np.add.reduceat(numbers[at], cuts[:-1], axis=0) if len(at) else np.zeros((len(found), 5), np.int64)
        for k, (i, j, p, q) in enumerate(zip(cuts, cuts[1:], ends, ends[1:])):
            if totals[k, 4] or j == i + 1 and not units[at[i]]:
                out.append((0, 0, 0, 0, b"", b"", b""))
            else:
                named = b";".join(map(strings.__getitem__, at[i:j].tolist()))
                out.append((*totals[k, :4].tolist(), named, key_pair[p:q].tobytes(), sums[p:q].tobytes()))
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def align_batches(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    own = aligner(a_path, b_path)
    for b in slices(batches, most=BATCH):
        n_a, n_b, n_groups, n_links, named, pairs, times = zip(*own.align(b.column(1)))
        digests = [hashlib.sha256(s).hexdigest() if s else "" for s in named]
        kinds = [*[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()]
        columns = [pa.array(x, k) for x, k in zip((n_a, n_b, n_groups, n_links, digests, pairs, times), kinds)]
        yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[x.split()[0] for x in ALIGNED_SQL.split(", ")])


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by pair, summed over a task: a document holds a pair once."""
    keys, counts, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def merged():
        all_keys = np.concatenate([keys, *held])
        ones = np.ones(len(all_keys) - len(keys), np.int64)
        found, back = np.unique(all_keys, return_inverse=True)
        return found, np.bincount(back, np.r_[counts, ones], len(found)).astype(np.int64)

    for b in batches:
        for raw in b.column(0).to_pylist():
            held.append(np.frombuffer(raw, "<i8"))
            size += len(held[-1])
            if size >= GATHER + len(keys):
                keys, counts = merged()
                held, size = [], 0
    keys, counts = merged()
    for k in range(0, len(keys), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000]), pa.array(counts[k : k + 100_000])], names=["pair", "n"])


def write_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(pair, n, best), sorted by pair -> a part of the arrays: twice the count, plus one for the best of an A id."""
    from pyspark import TaskContext

    parts = [b for b in batches if b.num_rows]
    if parts:
        t = pa.Table.from_batches(parts)
        keys, values = t.column(0).to_numpy(), 2 * t.column(1).to_numpy() + t.column(2).to_numpy()
        number = TaskContext.get().partitionId()
        write_part(path, number, keys, values.astype("<i8"))
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([int(keys[0])], pa.int64())], names=["part", "first"])


def sum_batches(batches: Iterator[pa.RecordBatch], arrays) -> Iterator[pa.RecordBatch]:
    """What align_batches gives -> the columns of the result, with counts from the arrays."""
    for b in slices(batches, "pairs"):
        pairs, times = ([np.frombuffer(x, "<i8") for x in b.column(k).to_pylist()] for k in (6, 7))
        ends = np.cumsum([0, *map(len, pairs)])
        keys, back = np.unique(np.concatenate(pairs), return_inverse=True)
        values = arrays.value.find(keys.astype(np.uint64))[back]
        often = np.concatenate(times)
        sums = [np.r_[0, np.cumsum(x)][ends] for x in (often * (values & 1), often * (values >> 1))]
        n_best, count_sum = (pa.array(np.diff(s), pa.int64()) for s in sums)
        yield pa.RecordBatch.from_arrays([*b.columns[:5], n_best, count_sum, b.column(5)], names=[x.split()[0] for x in FOUND_SQL.split(", ")])


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Numbers of tokens, groups and links of every document, with the counts of its pairs over all documents."""
    import sentencepiece

    spark = docs.sparkSession
    path, arrays = new_dir(spark, "aligned"), new_dir(spark, "pairs")
    texts(docs).mapInArrow(freed(lambda it: align_batches(it, a_path, b_path)), ALIGNED_SQL).write.option("compression", "zstd").parquet(path)
    aligned = spark.read.parquet(path)
    n_b = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    summed = aligned.select("pairs").mapInArrow(freed(count_batches), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = cut(summed.withColumn("a", F.floor(F.col("pair") / n_b)))
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    marked = counts.join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("bigint").alias("best"))
    ordered = marked.repartitionByRange(partitions(spark), "pair").sortWithinPartitions("pair")
    parts = ordered.mapInArrow(freed(lambda it: write_batches(it, arrays)), "part int, first bigint").collect()  # a row for each part
    sent = spark.sparkContext.broadcast(Arrays(arrays, "<i8", sorted(((r.part, r.first) for r in parts), key=lambda p: p[1])))
    return aligned.mapInArrow(freed(lambda it: sum_batches(it, sent)), FOUND_SQL)


def op12_dangling_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
