"""SentencePiece encoding and decoding, with a max-plus scan over the chunks of giant documents.

The model file is a BPE one.  Its encoding of a text is the only path of pieces through the text in which every two
neighbours are compatible: merging their joint characters by the model's rules gives these two pieces again.  So encoding is
a best-path problem whose weights are 0 (compatible) or -inf, and gives the ids of the sentencepiece library.

A document is cut every CHUNK characters (a rest of under half a chunk goes with the chunk before it).  What is one chunk then is encoded
where it lies.  The chunks of a longer document are rows dealt out over the
tasks, each with PAD characters of its neighbours.  The state at a cut is the piece that ends there or spans it; both
sides list the same states from those characters.  A chunk yields its transfer matrix, the weight of the best path from
each left to each right state.  The matrices of a document are combined by max-plus products, in a tree, upwards and
downwards again, which gives the state at every cut on the best path; one task holds the matrices of a document, some KB for a chunk.  Then each chunk is traced back alone from its two states.

Pieces hold a blank only in front, so no piece spans the place between another character and a blank, nor a newline's sides.  There
paths are cut in any case: a chunk's matrix depends on its ends alone, and the distinct segments between such places are encoded
once for a batch, all at a time: in each turn every segment takes its best merge.  Nothing of it outlives the batch.

Decoding joins the pieces' bytes and drops the blank that encoding puts in front.  Each chunk is decoded and held against its text.

Defined results: a null text is empty and has no ids; U+2581 counts as a blank, as in the library, so that alone does not come
back from decoding; equal texts of a batch are encoded once and give a row each; rows of one doc_id, or with a null one, stay
apart; a text of any length is as many chunks as it needs; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, cut, freed, near, partitions, slices, table, texts

CHUNK, PAD = 16_384, 32
#: Segments of up to so many characters take the model's merges (quadratic), longer ones the path of compatible pieces (linear).
SHORT = 48
#: Pairs in a generation of what a worker remembers of compatibility; two generations are held.
PAIR_MEMO = 50_000
#: Bytes of text that are encoded at a time.
BATCH = 1_000_000
#: Stands between segments in the text that is split; texts that hold it are split one by one.
SEP = "\x01"
#: Tokens from here on are characters that are no pieces.
LOOSE = 1 << 21
BLANK = "▁"
NEVER = -np.inf


class Model:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes: list[bytes] = []
        self.byte_id = [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                piece = piece.replace(BLANK, " ")
                self.score[piece], self.id[piece] = sp.get_score(i), i
                self.bytes.append(piece.encode())
        self.longest = max(map(len, self.id))
        assert 2 * self.longest <= PAD and not any(" " in p.lstrip(" ") or "\n" in p for p in self.id)
        self.prefixes = {p[:k] for p in self.id for k in range(1, len(p) + 1)}
        self._tables()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.old_pairs: dict[tuple[str, str], bool] = {}

    # --- pieces and their compatibility

    def merge(self, text: str) -> list[str]:
        """The model's merges of a short text: always the best-scored pair, the leftmost of equals."""
        parts, get = list(text), self.score.get
        scores = [get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == NEVER:
                break
            k = scores.index(best)
            both = parts[k] + parts[k + 1]
            parts[k : k + 2] = [both]
            del scores[k]
            if k:
                scores[k - 1] = get(parts[k - 1] + both, NEVER)
            if k < len(scores):
                scores[k] = get(both + parts[k + 1], NEVER)
        return parts

    def fits(self, left: str, right: str) -> bool:
        key = (left, right)
        got = self.pairs.get(key)
        if got is None:
            got = self.old_pairs.get(key)
            if got is None:
                got = self.merge(left + right) == [left, right]
            if len(self.pairs) >= PAIR_MEMO:
                self.old_pairs, self.pairs = self.pairs, {}
            self.pairs[key] = got
        return got

    def chain(self, s: str, start: int, stop: int, before: str | None) -> dict[int, str | None]:
        """For each place that a compatible path from start reaches, its last piece.  There is one path to a place at most."""
        last: dict[int, str | None] = {start: before}
        ids, prefixes, fits, longest = self.id, self.prefixes, self.fits, self.longest
        for at in range(start, stop):
            if at not in last:
                continue
            u = last[at]
            for end in range(at + 1, min(stop, at + longest) + 1):
                t = s[at:end]
                if end > at + 1:
                    if t not in prefixes:
                        break
                    if t not in ids:
                        continue
                if end not in last and (u is None or fits(u, t)):
                    last[end] = t
        return last

    @staticmethod
    def trace(last: dict[int, str | None], start: int, stop: int) -> list[str]:
        out = []
        while stop > start:
            t = last[stop]
            out.append(t)
            stop -= len(t)
        return out[::-1]

    def ids_of(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            i = self.id.get(p)
            if i is None:
                out += [self.byte_id[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(i)
        return out

    # --- segments between forced cuts

    def _tables(self) -> None:
        """Pieces by character, merges by pair of tokens in a hash table, and the pieces' bytes, as arrays."""
        token = lambda t: self.id[t] if t in self.id else LOOSE + ord(t) if len(t) == 1 else None
        self.char = np.arange(LOOSE, LOOSE + 0x110000, dtype=np.int32)
        for p, i in self.id.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        merges = {}
        for p, score in self.score.items():
            for k in range(1, len(p)):
                x, y = token(p[:k]), token(p[k:])
                if x is not None and y is not None:
                    merges[x << 22 | y] = (self.id[p], score)
        keys = np.array(list(merges), np.int64)
        self.bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.slot_key, self.slot_row = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        row, at = np.arange(len(keys)), self.slot(keys)
        while len(row):
            _, first = np.unique(at, return_index=True)
            first = first[self.slot_key[at[first]] < 0]
            self.slot_key[at[first]], self.slot_row[at[first]] = keys[row[first]], row[first]
            rest = np.ones(len(row), bool)
            rest[first] = False
            row, at = row[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
        self.merged, self.merged_score = (np.array([m[j] for m in merges.values()], t) for j, t in ((0, np.int32), (1, np.float32)))
        self.piece_size = np.array([len(x) for x in self.bytes], np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(self.bytes), np.uint8)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rows of merged and merged_score for pairs of tokens, -1 for those that do not merge."""
        keys = left.astype(np.int64) << 22 | right
        at, out = self.slot(keys), np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            there = self.slot_key[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.slot_row[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def merge_all(self, texts: list[str]) -> list[bytes]:
        """Ids of many short texts by the model's merges, one of each text in a turn."""
        tok = self.char[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")]
        text = np.repeat(np.arange(len(texts), dtype=np.int32), list(map(len, texts)))
        # The merge of a token with the next one of its text: what it gives, and its score.
        into, score = np.full(len(tok), -1, np.int32), np.full(len(tok), NEVER, np.float32)

        def renew(k: np.ndarray) -> None:
            row = self.look(tok[k], tok[k + 1])
            into[k] = self.merged[row]
            score[k] = np.where(row >= 0, self.merged_score[row], NEVER)

        renew(np.flatnonzero(text[:-1] == text[1:]))
        done_tok, done_text = [], []
        while len(tok):
            begin = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            best = np.maximum.reduceat(score, begin)
            count = np.diff(np.r_[begin, len(tok)])
            alive = best > NEVER
            if not alive.all():
                ended = ~np.repeat(alive, count)
                done_tok.append(tok[ended])
                done_text.append(text[ended])
                ended = ~ended
                tok, text, into, score = tok[ended], text[ended], into[ended], score[ended]
                best, count = best[alive], count[alive]
                if not len(tok):
                    break
            at = np.flatnonzero(score == np.repeat(best, count))
            at = at[np.r_[True, text[at[1:]] != text[at[:-1]]]]
            tok[at] = into[at]
            score[at] = NEVER
            stay = np.ones(len(tok), bool)
            stay[at + 1] = False
            tok, text, into, score = tok[stay], text[stay], into[stay], score[stay]
            at -= np.arange(len(at))
            before = at[at > 0] - 1
            renew(before[text[before] == text[before + 1]])
            after = at[at + 1 < len(tok)]
            same = text[after] == text[after + 1]
            renew(after[same])
        if not done_tok:
            return [b""] * len(texts)
        tok, text = np.concatenate(done_tok), np.concatenate(done_text)
        order = np.argsort(text, kind="stable")
        tok, text = tok[order], text[order]
        loose = np.flatnonzero(tok >= LOOSE)
        if len(loose):
            # Characters that are no pieces go out as the pieces of their bytes.
            ids = [[self.byte_id[x] for x in chr(c - LOOSE).encode("utf-8", "surrogatepass")] for c in tok[loose].tolist()]
            many = np.ones(len(tok), np.int64)
            many[loose] = [len(x) for x in ids]
            tok, text = np.repeat(tok, many), np.repeat(text, many)
            tok[tok >= LOOSE] = [i for x in ids for i in x]
        raw, ends = tok.astype("<i4", copy=False).tobytes(), (4 * np.cumsum(np.bincount(text, minlength=len(texts)))).tolist()
        return [raw[i:j] for i, j in zip([0, *ends], ends)]

    def long_segment(self, s: str) -> bytes:
        """Ids of any number of blanks and what follows up to the next blank or newline."""
        parts = scan_text(self, s, CHUNK) if len(s) > CHUNK else self.trace(self.chain(s, 0, len(s), None), 0, len(s))
        return np.array(self.ids_of(parts), "<i4").tobytes()

    def segments(self, values: pa.Array) -> pa.Array:
        """Ids of distinct segments, as binary."""
        texts, long = values.to_pylist(), pa.compute.greater(pa.compute.utf8_length(values), SHORT)
        if not pa.compute.any(long).as_py():
            return pa.array(self.merge_all(texts), pa.binary())
        got = self.merge_all(["" if x else t for t, x in zip(texts, long.to_pylist())])
        return pa.array([self.long_segment(t) if x else i for t, i, x in zip(texts, got, long.to_pylist())], pa.binary())

    def plain_many(self, texts: pa.Array) -> pa.Array:
        """Ids of texts in which blanks stand for U+2581 and that begin and end at a forced cut; texts of about BATCH bytes at most."""
        c = pa.compute
        odd = c.or_(c.match_substring(texts, "  "), c.match_substring(texts, SEP)).to_pylist()
        split = c.split_pattern(c.replace_substring(c.replace_substring(texts, "\n", SEP + "\n" + SEP), " ", SEP + " "), SEP)
        if any(odd):
            split = pa.array([SEGMENT.findall(t) if o else x for o, t, x in zip(odd, texts.to_pylist(), split.to_pylist())], pa.list_(pa.string()))
        flat = split.flatten().dictionary_encode()
        ids = self.segments(flat.dictionary).take(flat.indices)
        ends = np.frombuffer(ids.buffers()[1], "<i4")[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, "<i4")
        at = np.r_[0, np.cumsum(c.list_value_length(split).to_numpy(zero_copy_only=False))]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(ends[at], "<i4").tobytes()), ids.buffers()[2] or pa.py_buffer(b"")])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian int32."""
        return self.encode_many(pa.array([text]))[0].as_py()

    def encode_many(self, texts: pa.Array) -> pa.Array:
        c = pa.compute
        spaced = c.binary_join_element_wise(" ", c.replace_substring(texts, BLANK, " "), "")
        return self.plain_many(c.if_else(c.equal(texts, ""), "", spaced))

    def raw_many(self, ids: pa.Array) -> tuple[bytes, np.ndarray]:
        """The bytes of all pieces, and where those of each row begin and end."""
        size = np.frombuffer(ids.buffers()[1], "<i4")[ids.offset : ids.offset + len(ids) + 1]
        flat = np.frombuffer(ids.buffers()[2], "<i4", (size[-1] - size[0]) // 4, size[0]) if size[-1] > size[0] else np.zeros(0, "<i4")
        n = self.piece_size[flat]
        end = np.r_[0, np.cumsum(n)]
        data = self.piece_bytes[np.arange(end[-1], dtype=np.int32) + np.repeat((self.piece_start[flat] - end[:-1]).astype(np.int32), n)]
        return data.tobytes(), end[(size - size[0]) // 4]

    def raw(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<i4").tolist()))

    def decode(self, ids: bytes) -> str:
        return self.raw(ids)[1:].decode("utf-8", "replace")


SEGMENT = re.compile(r"\n| *[^ \n]+| +")


def forced(s: str, p: int) -> bool:
    return p == 0 or p == len(s) or (s[p] == " " and s[p - 1] != " ") or s[p] == "\n" or s[p - 1] == "\n"


def states(model: Model, s: str, p: int) -> list[tuple[int, int]]:
    """Pieces that end at p or span it, as characters before and after p; [(0, 0)] at a forced cut."""
    if forced(s, p):
        return [(0, 0)]
    out = []
    for a in range(1, min(model.longest, p) + 1):
        for b in range(0, min(model.longest - a, len(s) - p) + 1):
            if (a == 1 and b == 0) or s[p - a : p + b] in model.id:
                out.append((a, b))
    return out


def first_forced(s: str, start: int, stop: int) -> int | None:
    for p in range(start, stop + 1):
        if forced(s, p):
            return p
    return None


def last_forced(s: str, start: int, stop: int) -> int | None:
    for p in range(stop, start - 1, -1):
        if forced(s, p):
            return p
    return None


def piece(s: str, p: int, state: tuple[int, int]) -> str | None:
    return None if state == (0, 0) else s[p - state[0] : p + state[1]]


def reaches(model: Model, s: str, last: dict, q: int, state: tuple[int, int]) -> bool:
    if state == (0, 0):
        return q in last
    begin = q - state[0]
    if begin not in last:
        return False
    u = last[begin]
    return u is None or model.fits(u, piece(s, q, state))


def transfer(model: Model, s: str, p: int, q: int) -> np.ndarray:
    """Max-plus matrix of the chunk s[p:q] of a padded string s: left states x right states."""
    left, right = states(model, s, p), states(model, s, q)
    out = np.full((len(left), len(right)), NEVER)
    lo, hi = p + model.longest, q - model.longest
    cut_at = first_forced(s, lo, hi)
    if cut_at is None:
        for i, a in enumerate(left):
            last = model.chain(s, p + a[1], q, piece(s, p, a))
            for j, b in enumerate(right):
                if reaches(model, s, last, q, b):
                    out[i, j] = 0.0
        return out
    # Any path passes a forced cut, so the matrix is the outer sum of a column and a row.
    row_from = last_forced(s, lo, hi)
    tail = model.chain(s, row_from, q, None)
    row = np.array([0.0 if reaches(model, s, tail, q, b) else NEVER for b in right])
    column = np.array([0.0 if cut_at in model.chain(s, p + a[1], cut_at, piece(s, p, a)) else NEVER for a in left])
    return column[:, None] + row[None, :]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def best_states(matrices: list[np.ndarray]) -> list[int]:
    """The state at each inner cut on the best path: products up a tree, then states down it."""
    if len(matrices) < 2:
        return []
    levels = [matrices]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([product(below[k], below[k + 1]) if k + 1 < len(below) else below[k] for k in range(0, len(below), 2)])
    ends = [(0, 0)]  # states at both ends of each node, from the root down
    if levels[-1][0][0, 0] == NEVER:
        raise ValueError("no compatible path")
    for below in reversed(levels[:-1]):
        new = []
        for k, (i, j) in enumerate(ends):
            if 2 * k + 1 == len(below):
                new.append((i, j))
                continue
            m = int(np.argmax(below[2 * k][i, :] + below[2 * k + 1][:, j]))
            new += [(i, m), (m, j)]
        ends = new
    return [j for _, j in ends[:-1]]


def trace_chunk(model: Model, s: str, p: int, q: int, left: tuple[int, int], right: tuple[int, int]) -> tuple[bytes, str, bytes]:
    """The pieces that begin in the chunk, between its two states: ids up to its first forced cut, the text up to its last one, ids from there."""
    start, stop, before = p + left[1], q + right[1], piece(s, p, left)
    first = first_forced(s, start, stop) if before is None else first_forced(s, start + (0 if forced(s, start) else 1), stop)
    ids = lambda a, b, u: np.array(model.ids_of(model.trace(model.chain(s, a, b, u), a, b)), "<i4").tobytes()
    if first is None or (last := last_forced(s, first, stop)) is None:
        return ids(start, stop, before), "", b""
    return (ids(start, first, before) if start < first else b""), s[first:last], (ids(last, stop, None) if last < stop else b"")


def scan_text(model: Model, s: str, size: int) -> list[str]:
    """The pieces of one long string by the chunked scan, in one process."""
    cuts = cuts_of(len(s), size)
    if len(cuts) < 3:
        return model.trace(model.chain(s, 0, len(s), None), 0, len(s))
    found = [states(model, s, p) for p in cuts]
    picks = [0, *best_states([transfer(model, s, p, q) for p, q in zip(cuts, cuts[1:])]), 0]
    out: list[str] = []
    for k, (p, q) in enumerate(zip(cuts, cuts[1:])):
        a, b = found[k][picks[k]], found[k + 1][picks[k + 1]]
        out += model.trace(model.chain(s, p + a[1], q + b[1], piece(s, p, a)), p + a[1], q + b[1])
    return out


_MODELS: dict[str, Model] = {}


def model_of(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


ENCODED_SQL = "doc_id bigint, ids binary, round_trip boolean"
CHUNK_SQL = "uid bigint, doc_id bigint, k int, pad int, size int, piece string"


def encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = model_of(path)
    for b in slices(batches, most=BATCH):
        coded = b.column(1).dictionary_encode()  # copies that a mixture took several times lie side by side
        ids = model.encode_many(coded.dictionary)
        raw, at = model.raw_many(ids)
        back = [raw[i + 1 : j] == t.replace(BLANK, " ").encode() for i, j, t in zip(at.tolist(), at[1:].tolist(), coded.dictionary.to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), ids.take(coded.indices), pa.array(back, pa.bool_()).take(coded.indices)], names=["doc_id", "ids", "round_trip"])


def chunk_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> the chunks of each row, under an id of the row."""
    from pyspark import TaskContext

    uid = TaskContext.get().partitionId() << 33
    names = ["uid", "doc_id", "k", "pad", "size", "piece"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    for b in slices(batches):
        rows = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            s = " " + text.replace(BLANK, " ")
            cuts = cuts_of(len(s), size)
            for k, (p, q) in enumerate(zip(cuts, cuts[1:])):
                pad = min(p, PAD)
                rows.append((uid, doc_id, k, pad, q - p, s[p - pad : q + PAD]))
                if len(rows) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows = []
            uid += 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def cuts_of(n: int, size: int) -> list[int]:
    """Where a string is cut; one chunk has under one and a half times the size."""
    return [*range(0, max(1, n - size // 2), size), n]


def matrix_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(uid, k, pad, size, piece) -> (uid, k, height, matrix)."""
    model = model_of(path)
    for b in slices(batches, "piece"):
        uid, k, pad, size, text = b.columns
        m = [transfer(model, t, p, p + n) for p, n, t in zip(pad.to_pylist(), size.to_pylist(), text.to_pylist())]
        yield pa.RecordBatch.from_arrays([uid, k, pa.array([x.shape[0] for x in m], pa.int32()), pa.array([x.tobytes() for x in m], pa.binary())], names=["uid", "k", "height", "matrix"])


def combine_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, matrices) -> states left and right of every chunk of each document."""
    for b in batches:
        for uid, parts in zip(b.column(0).to_pylist(), b.column(1)):
            parts = sorted(parts.as_py(), key=lambda p: p["k"])
            inner = best_states([np.frombuffer(p["matrix"], float).reshape(p["height"], -1) for p in parts])
            yield batch_of(PICKED, np.full(len(parts), uid), np.arange(len(parts), dtype=np.int32), np.array([0, *inner], np.int32), np.array([*inner, 0], np.int32))


PICKED = pa.schema([("uid", pa.int64()), ("k", pa.int32()), ("a", pa.int32()), ("b", pa.int32())])


def trace_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Chunks with their states -> ids of the pieces that begin in them, and whether these decode to the text between the states."""
    model = model_of(path)
    for b in slices(batches, "piece", BATCH):
        uid, doc_id, k, pad, size, text, left, right = b.columns
        parts, inner = [], []
        for p, n, t, i, j in zip(pad.to_pylist(), size.to_pylist(), text.to_pylist(), left.to_pylist(), right.to_pylist()):
            x, y = states(model, t, p)[i], states(model, t, p + n)[j]
            parts.append(trace_chunk(model, t, p, p + n, x, y))
            inner.append(t[p + x[1] : p + n + y[1]].encode())
        middle = model.plain_many(pa.array([m for _, m, _ in parts], pa.string())).to_pylist()
        ids = [a + m + z for (a, _, z), m in zip(parts, middle)]
        fine = [model.raw(i) == t for i, t in zip(ids, inner)]
        yield pa.RecordBatch.from_arrays([uid, doc_id, k, pa.array(ids, pa.binary()), pa.array(fine, pa.bool_())], names=["uid", "doc_id", "k", "ids", "fine"])


def join_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, parts, fine): the parts in the order of their chunks, as one."""
    for b in batches:
        doc, parts, fine = b.columns
        ids = [b"".join(p["ids"] for p in sorted(parts[i].as_py(), key=lambda p: p["k"])) for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([doc, pa.array(ids, pa.binary()), fine], names=["doc_id", "ids", "round_trip"])


def encode_chunked(rows: DataFrame, path: str, size: int) -> DataFrame:
    """rows: doc_id, text.  Their chunks are encoded wherever they lie; texts travel once, as chunks."""
    # The checkpoint holds the ids of rows, which name a row for what follows.
    chunks = cut(rows.mapInArrow(freed(lambda it: chunk_batches(it, size)), CHUNK_SQL).repartition("uid", "k"))
    matrices = chunks.select("uid", "k", "pad", "size", "piece").mapInArrow(freed(lambda it: matrix_batches(it, path)), "uid bigint, k int, height int, matrix binary")
    dealt = matrices.repartition(partitions(rows.sparkSession), "uid").groupBy("uid").agg(F.collect_list(F.struct("k", "height", "matrix")).alias("parts"))
    picks = near(cut(dealt.mapInArrow(freed(combine_batches), "uid bigint, k int, a int, b int")))
    traced = chunks.join(picks, ["uid", "k"]).select(*chunks.columns, "a", "b").mapInArrow(freed(lambda it: trace_batches(it, path)), "uid bigint, doc_id bigint, k int, ids binary, fine boolean")
    whole = traced.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("k", "ids")).alias("parts"), F.min("fine").alias("fine"))
    return whole.select("doc_id", "parts", "fine").mapInArrow(freed(join_batches), ENCODED_SQL)


def encode(docs: DataFrame, path: str, size: int = CHUNK) -> DataFrame:
    """doc_id, ids (int32, little-endian) and whether decoding gives the text back, of every document."""
    rows = texts(docs)
    one = F.length("text") + 1 <= size + size // 2  # a single chunk, with the blank in front
    return rows.where(one).mapInArrow(freed(lambda it: encode_batches(it, path)), ENCODED_SQL).unionByName(encode_chunked(rows.where(~one), path, size))


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", F.floor(F.length("ids") / 4).cast("bigint").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "round_trip")


def op6_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))
