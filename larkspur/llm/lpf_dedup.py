"""Suffix-array dedup: every byte that an L-byte string covers which also starts earlier is removed.

In terms of suffix arrays: position i starts such a string when its longest previous factor LPF[i] is L or more, and LPF[i]
is the larger of the LCPs of i with the nearest entries on either side of it in suffix order that hold a smaller position (the previous and next
smaller positions).  One suffix array over all documents would be one sequential object; this is the same answer from
pieces of it.

1.  Anchors.  Of the K-grams in every L-byte window the one with the least hash (the leftmost of equals) is the window's
    anchor.  It depends on the window's bytes alone, so equal windows have equal anchors at equal offsets, and only windows
    with the same anchor key need to be compared.  Neighbouring windows mostly share an anchor: about one anchor goes out for
    L - K + 1 over 2 windows, with its 64-bit key and a 96-bit BLAKE2b digest of the stretch that its windows cover.
2.  Stretches of one key and digest are the same bytes, neighbours in suffix order whose LCP is all they have: all but the earliest
    have LPF >= L everywhere.  Within a block of documents they are compared byte by byte, so a common passage leaves a block once.
    Over the blocks, one exchange by key, sorted by (key, digest, position), shows them to a task that holds one row at a time:
    a key has one row at most for each block and content, however common it is.
3.  Keys with several digests (the rims of repeated passages) send the bytes of the earliest stretch of each.  The stretches of a
    key meet in a task, which sorts their suffixes by prefix doubling to the depth of L, reads the LCPs of neighbours off the
    doubling steps, and takes LPF from the previous and next smaller positions.  The stretches of a key with more than HOT contents
    are dealt out anew by the windows' own digests, each window once for a block, and these are again met one row at a time, so no
    task gathers a very common passage.  Both go through one pass over the blocks and one exchange.
4.  Each block gets its removed windows back and takes the union of what they cover.

Documents travel once, packed into compressed blocks of about BLOCK_BYTES, which both joins reread from one exchange.  Only
block-sized things are collected; positions are (doc_id, block, offset) throughout.

Defined results: a null or empty text has no bytes and nothing removed; texts shorter than L keep all; a text of more than BLOCK_BYTES is a
block of its own; equal rows with one doc_id count as earlier and later in the order of their blocks; null doc_ids come first; an empty
table gives no rows; `remove` keeps all other columns and cuts whole code points only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_of, cut, freed, release, table, texts

L, K = 100, 32
BLOCK_BYTES, BLOCK_DOCS = 2_000_000, 8192
CHUNK = 1 << 18
HOT = 512
NO_ID = -(1 << 63)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
U = np.uint64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[U(1), np.full(n - 1, BASE, U)]), np.cumprod(np.r_[U(1), np.full(n - 1, INVERSE, U)])


_POW, _INV = _powers(CHUNK + 4 * L)


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(29))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(32))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    n = len(data)
    return np.r_[U(0), np.cumsum((data.astype(U) + U(1)) * _POW[:n])]


def spans_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return (prefix[stop] - prefix[start]) * _INV[start]


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    s = 1
    while 2 * s <= w:
        v = np.minimum(v[:-s], v[s:])
        s *= 2
    return np.minimum(v[: len(v) - (w - s)], v[w - s :]) if s < w else v


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a block: key, fingerprint, anchor, first and last window of every anchor, by position.  starts, ends: the documents."""
    found = []
    whole = len(data)
    step = CHUNK
    # Windows that lie in one document.
    fits = np.zeros(whole + 1, np.int32)
    long = ends - starts >= L
    np.add.at(fits, starts[long], 1)
    np.add.at(fits, ends[long] - L + 1, -1)
    fits = np.cumsum(fits)[:whole] > 0
    for base in range(0, max(0, whole - L + 1), step):
        part = data[base : base + step + L - 1 + 1]
        n_windows = min(step, whole - L + 1 - base)
        if not fits[base : base + n_windows].any():
            continue
        part = part[: n_windows + L - 1]
        with np.errstate(over="ignore"):
            prefix = prefix_hash(part)
            at = np.arange(len(part) - K + 1)
            h = mix64(spans_hash(prefix, at, at + K))
            low = sliding_min((h >> U(20) << U(20)) | at.astype(U), L - K + 1)
            own = (low & U((1 << 20) - 1)).astype(np.int64)
            ok = fits[base : base + n_windows]
            # Runs of windows with one anchor; a window outside documents ends a run.
            head = np.flatnonzero(ok & np.r_[True, (own[1:] != own[:-1]) | ~ok[:-1]])
            tail = np.flatnonzero(ok & np.r_[(own[1:] != own[:-1]) | ~ok[1:], True])
            a = own[head]
            # The reach of the first and the last window around the anchor belongs to the fingerprint.
            print_ = mix64(spans_hash(prefix, head, tail + L) + U(0x9E37) * (a - head).astype(U) + (tail - head).astype(U) * U(0x85EBCA6B))
        found.append((h[a], print_, a + base, head + base, tail + base))
    if not found:
        z = np.zeros(0, np.int64)
        return z.astype(U), z.astype(U), z, z, z
    return tuple(np.concatenate(x) for x in zip(*found))


class Block:
    def __init__(self, block: int, ids: bytes, sizes: bytes, blob: bytes):
        self.block = block
        self.ids = np.frombuffer(ids, "<i8")
        self.sizes = np.frombuffer(sizes, "<i8")
        self.raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(1, int(self.sizes.sum()))) if len(blob) else b""
        self.data = np.frombuffer(self.raw, np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")

    def reduced(self):
        """Stretches that no earlier one of the block equals (key, head, tail), and (head, tail) of the others."""
        key, print_, _, head, tail = anchors(self.data, self.starts, self.ends)
        if len(key) == 0:
            return (key, head, tail), (head, tail)
        doc = self.doc_of(head)
        # Earlier: a smaller doc_id, then the place in the block.
        order = np.lexsort((head, self.ids[doc], print_, key))
        first = np.r_[True, (key[order][1:] != key[order][:-1]) | (print_[order][1:] != print_[order][:-1])]
        # Equal fingerprints only nominate: bytes decide, and what differs stays.
        later, of = order[~first], order[first][(np.cumsum(first) - 1)[~first]]
        raw = self.raw
        equal = [raw[a : b + L] == raw[c : d + L] for a, b, c, d in zip(head[later].tolist(), tail[later].tolist(), head[of].tolist(), tail[of].tolist())]
        rest = np.sort(later[np.array(equal, bool)])
        keep = np.ones(len(key), bool)
        keep[rest] = False
        return (key[keep], head[keep], tail[keep]), (head[rest], tail[rest])


BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("blob", pa.binary()), ("rest", pa.binary())])
BLOCK_SQL = "block bigint, ids binary, sizes binary, blob binary, rest binary"


def pack_blocks(batches: Iterator[pa.RecordBatch], with_rest: bool) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, other columns) -> blocks.  Block ids: the task's partition and a running number."""
    from pyspark import TaskContext

    part, k = TaskContext.get().partitionId(), 0
    pack = zstandard.ZstdCompressor(level=3)
    ids, raws, rest, size = [], [], [], 0

    def done() -> pa.RecordBatch:
        blob = pack.compress(b"".join(raws))
        others = b""
        if with_rest:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest[0].schema) as w:
                for r in rest:
                    w.write_batch(r)
            others = pack.compress(sink.getvalue().to_pybytes())
        return batch_of(BLOCK, [(part << 32) | k], [np.array(ids, "<i8").tobytes()], [np.array([len(r) for r in raws], "<i8").tobytes()], [blob], [others])

    for b in batches:
        others, begin = b.select(b.schema.names[2:]), 0
        for n, (i, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()))):
            raw = t.as_py()
            if ids and (size + len(raw) > BLOCK_BYTES or len(ids) >= BLOCK_DOCS):
                if n > begin:
                    rest.append(others.slice(begin, n - begin))
                yield done()
                ids, raws, rest, size, k, begin = [], [], [], 0, k + 1, n
            ids.append(NO_ID if i is None else i)
            raws.append(raw)
            size += len(raw)
        if b.num_rows > begin:
            rest.append(others.slice(begin))
    if ids:
        yield done()


ANCHOR = pa.schema([("key", pa.int64()), ("d1", pa.int64()), ("d2", pa.int32()), ("doc", pa.int64()), ("block", pa.int64()), ("place", pa.int64())])
ANCHOR_SQL = "key bigint, d1 bigint, d2 int, doc bigint, block bigint, place bigint"


def place_of(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """First window and number of further windows (under L) in one number, in the order of positions."""
    return (head.astype(np.int64) << 7) | (tail - head).astype(np.int64)


def digests(raw: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """BLAKE2b digests of stretches, of 96 bits, as numbers d1 and d2."""
    of = hashlib.blake2b
    return np.frombuffer(b"".join([of(raw[a:b], digest_size=12).digest() for a, b in zip(begin.tolist(), end.tolist())]), [("d1", "<i8"), ("d2", "<i4")])


def anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            block = Block(*row)
            (key, head, tail), _ = block.reduced()
            if len(key):
                d = digests(block.raw, head, tail + L)
                yield batch_of(ANCHOR, key.view(np.int64), d["d1"], d["d2"], block.ids[block.doc_of(head)], np.full(len(key), block.block), place_of(head, tail))


#: What becomes of a stretch: an earlier one has the same bytes; it meets others of its key; its windows meet others one by one.
COPY, MEET, WINDOWS = 0, 1, 2
JUDGED = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("place", pa.int64()), ("kind", pa.int8())])
JUDGED_SQL = "key bigint, block bigint, place bigint, kind tinyint"


class Judge:
    """Stretches in the order (key, digest, position), batch by batch -> what becomes of those that are not alone under their key.

    It holds the last row, and of the key at hand the earliest stretch of each of the first HOT contents.
    """

    def __init__(self, hot: int):
        self.hot = hot
        self.last = None  # key and digest
        self.contents = 0  # so far under the key at hand
        self.first = np.zeros((0, 2), np.int64)  # block and place of the first stretches of these

    def feed(self, key: np.ndarray, d1: np.ndarray, d2: np.ndarray, block: np.ndarray, place: np.ndarray) -> pa.RecordBatch | None:
        hot = self.hot
        k0, x0, y0 = self.last or (None, None, None)
        same_key = np.r_[key[0] == k0, key[1:] == key[:-1]]
        same = same_key & np.r_[(d1[0] == x0) & (d2[0] == y0), (d1[1:] == d1[:-1]) & (d2[1:] == d2[:-1])]
        run = np.cumsum(~same_key)  # 0 goes on from the batch before
        at = np.flatnonzero(~same)
        own = run[at]
        total = np.bincount(own, minlength=run[-1] + 1)
        nth = np.arange(len(at)) - (np.cumsum(total) - total)[own] + 1
        before = self.contents
        nth[own == 0] += before
        total[0] += before
        shown = total[own] > 1
        parts = [(key[same], block[same], place[same], COPY), (key[at][shown & (nth <= hot)], block[at][shown & (nth <= hot)], place[at][shown & (nth <= hot)], MEET), (key[at][nth > hot], block[at][nth > hot], place[at][nth > hot], WINDOWS)]
        if before == 1 and total[0] > 1:  # the first content was held back, as it was alone
            parts.append((np.array([k0]), self.first[:, 0], self.first[:, 1], MEET))
        held = np.stack([block[at], place[at]], 1)
        for r in np.flatnonzero(total > hot).tolist():
            if r == 0 and before > hot:
                continue
            few = held[(own == r) & (nth <= hot)]
            if r == 0:
                few = np.concatenate([self.first, few])
            parts.append((np.full(len(few), key[np.searchsorted(run, r)]), few[:, 0], few[:, 1], WINDOWS))
        end = int(run[-1])
        last = held[(own == end) & (nth <= hot)]
        self.first = np.concatenate([self.first, last]) if end == 0 else last
        self.contents = int(total[end])
        self.last = (int(key[-1]), int(d1[-1]), int(d2[-1]))
        if not any(len(x[0]) for x in parts):
            return None
        return batch_of(JUDGED, *(np.concatenate([x[j] for x in parts]) for j in range(3)), np.concatenate([np.full(len(x[0]), x[3], np.int8) for x in parts]))


def judge_batches(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    judge = Judge(hot)
    for b in batches:
        if b.num_rows:
            out = judge.feed(*(b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("key", "d1", "d2", "block", "place")))
            if out is not None:
                yield out


STRETCH = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("d1", pa.int64()), ("d2", pa.int32()), ("doc", pa.int64()), ("block", pa.int64()), ("place", pa.int64()), ("bytes", pa.binary())])
STRETCH_SQL = "kind tinyint, key bigint, d1 bigint, d2 int, doc bigint, block bigint, place bigint, bytes binary"


def runs_of(heads: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of runs of neighbouring windows, which are under L long, within documents.  heads rise."""
    new = np.r_[True, (heads[1:] != heads[:-1] + 1) | (docs[1:] != docs[:-1])]
    at = np.arange(len(heads)) - np.maximum.accumulate(np.where(new, np.arange(len(heads)), 0))
    new |= at % L == 0
    return heads[new], heads[np.r_[new[1:], True]]


def stretch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the stretches asked of them -> the bytes of those that meet, and the windows of the others by their own digests."""

    def rows(kind: int, block: Block, key, d1, d2, head, tail, pieces) -> pa.RecordBatch:
        n = len(head)
        return batch_of(STRETCH, np.full(n, kind, np.int8), key, d1, d2, block.ids[block.doc_of(head)], np.full(n, block.block), place_of(head, tail), pieces)

    for b in batches:
        lists = b.column(b.num_columns - 1)
        for i, row in enumerate(zip(*(c.to_pylist() for c in b.columns[:-1]))):
            block, flat = Block(*row), lists.slice(i, 1).flatten()
            key, place, kind = (flat.field(j).to_numpy(zero_copy_only=False) for j in range(3))
            meet = np.flatnonzero(kind == MEET)
            if len(meet):
                head, tail, none = place[meet] >> 7, (place[meet] >> 7) + (place[meet] & 127), np.zeros(len(meet), np.int64)
                yield rows(MEET, block, key[meet], none, none, head, tail, [block.raw[x : y + L] for x, y in zip(head.tolist(), tail.tolist())])
            place = place[kind == WINDOWS]
            if not len(place):
                continue
            count = (place & 127) + 1
            head = np.unique(np.repeat(place >> 7, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            d, doc = digests(block.raw, head, head + L), block.doc_of(head)
            order = np.lexsort((head, block.ids[doc], d["d2"], d["d1"]))
            first = np.ones(len(head), bool)
            first[order[1:]] = d[order[1:]] != d[order[:-1]]
            at = np.flatnonzero(first)
            for k in range(0, len(at), 20_000):
                some = at[k : k + 20_000]
                yield rows(WINDOWS, block, d["d1"][some], d["d1"][some], d["d2"][some], head[some], head[some], [None] * len(some))
            if len(at) < len(head):
                x, y = runs_of(head[~first], doc[~first])
                none = np.zeros(len(x), np.int64)
                yield rows(COPY, block, d["d1"][np.searchsorted(head, x)], none, none, x, y, [None] * len(x))


def suffix_ranks(data: np.ndarray, depth: int) -> tuple[list[int], list[np.ndarray]]:
    """Ranks of all suffixes by their first bytes, by prefix doubling: the lengths compared in each step and the ranks after it.

    Equal ranks are equal strings, and ranks follow the order of bytes.  Zeros lie behind the end.
    """
    n = len(data)
    wide = np.r_[data.astype(np.int64) + 1, np.zeros(depth, np.int64)]
    # Seven bytes (of 1..256) make the first key.
    key, h = np.zeros(n, np.int64), 7
    for j in range(h):
        key = key * 257 + wide[j : j + n]
    lengths, ranks = [h], [dense(key)]
    while h < depth:
        step, rank = min(h, depth - h), ranks[-1]
        nxt = np.r_[rank[step:], np.zeros(min(step, n), np.int64)]
        h += step
        lengths.append(h)
        ranks.append(dense(rank * (n + 2) + nxt))
    return lengths, ranks


def common_prefix(data: np.ndarray, lengths: list[int], ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """LCP of pairs of suffixes, up to the depth of the last ranks."""
    out, depth, n = np.zeros(len(i), np.int64), lengths[-1], len(data)
    for h, rank in zip(reversed(lengths), reversed(ranks)):
        x, y = i + out, j + out
        inside = (x < n) & (y < n) & (out + h <= depth)
        out += h * (inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]))
    going = np.flatnonzero(out < depth)
    for _ in range(lengths[0]):
        x, y = i[going] + out[going], j[going] + out[going]
        same = (x < n) & (y < n) & (out[going] < depth) & (data[np.minimum(x, n - 1)] == data[np.minimum(y, n - 1)])
        going = going[same]
        out[going] += 1
    return out


def dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    s = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.r_[1, s[1:] != s[:-1]])
    return out


def previous_factors(position: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """LPF of the entries of a suffix order: the larger of their LCPs with the nearest entries on both sides that have a smaller position.

    lcp[i] is that of the entries i - 1 and i, 0 where a group begins.  A walk to a side ends there, or where the LCP
    falls under `least`; an LPF under `least` is given as 0.
    """
    n = len(position)
    out = np.zeros(n, np.int64)
    for side in (-1, 1):
        at = np.arange(n)
        beside, held = at + side, np.r_[lcp, 0][at + (side > 0)]
        while len(at):
            going = (held >= least) & (beside >= 0) & (beside < n)
            at, beside, held = at[going], beside[going], held[going]
            smaller = position[beside] < position[at]
            out[at[smaller]] = np.maximum(out[at[smaller]], held[smaller])
            at, beside, held = at[~smaller], beside[~smaller], held[~smaller]
            held = np.minimum(held, np.r_[lcp, 0][beside + (side > 0)])
            beside = beside + side
    return out


REMOVED = pa.schema([("block", pa.int64()), ("place", pa.int64())])


def resolve(key: np.ndarray, block: np.ndarray, place: np.ndarray, pieces: list[bytes]) -> pa.RecordBatch | None:
    """Stretches of whole keys in the order (key, position) -> runs of their windows with LPF >= L among the windows of the key."""
    head, count = place >> 7, (place & 127) + 1
    size = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    lengths, ranks = suffix_ranks(data, L)
    row = np.repeat(np.arange(len(key)), count)
    within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = (np.cumsum(size) - size)[row] + within
    group = np.cumsum(np.r_[0, key[1:] != key[:-1]])[row]
    order = np.lexsort((ranks[-1][at], group))
    lcp = np.r_[0, common_prefix(data, lengths, ranks, at[order[:-1]], at[order[1:]])]
    lcp[np.r_[True, group[order[1:]] != group[order[:-1]]]] = 0
    factor = np.empty(len(row), np.int64)
    factor[order] = previous_factors(order, lcp, L)  # entries came by position
    i = np.flatnonzero(factor >= L)
    if not len(i):
        return None
    run = np.r_[True, (i[1:] != i[:-1] + 1) | (row[i][1:] != row[i][:-1])]
    first, last = i[run], i[np.r_[run[1:], True]]
    return batch_of(REMOVED, block[row[first]], place_of(head[row[first]] + within[first], head[row[last]] + within[last]))


#: Stretches that are resolved at a time, in whole keys (which have HOT at most).
AT_ONCE = 4000


def resolve_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of STRETCH in the order (kind, key, digest, position) -> (block, place) of windows that also start earlier."""
    judge, waiting, held = Judge(1 << 62), [], 0

    def column(rows, name: str) -> np.ndarray:
        return rows.column(rows.schema.get_field_index(name)).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column(name).to_numpy()

    def resolved(rows: pa.Table) -> list[pa.RecordBatch]:
        out = resolve(*(column(rows, c) for c in ("key", "block", "place")), rows.column("bytes").to_pylist()) if rows.num_rows else None
        return [] if out is None else [out]

    for b in batches:
        kinds = column(b, "kind")
        for kind in np.unique(kinds).tolist():
            begin, end = np.searchsorted(kinds, [kind, kind + 1]).tolist()
            rows = b.slice(begin, end - begin)
            if kind == COPY:
                yield batch_of(REMOVED, column(rows, "block"), column(rows, "place"))
            elif kind == WINDOWS:
                out = judge.feed(*(column(rows, c) for c in ("key", "d1", "d2", "block", "place")))
                if out is not None and (same := column(out, "kind") == COPY).any():
                    yield batch_of(REMOVED, column(out, "block")[same], column(out, "place")[same])
            else:
                for k in range(0, rows.num_rows, AT_ONCE):
                    waiting.append(rows.slice(k, AT_ONCE))
                    held += waiting[-1].num_rows
                    if held >= AT_ONCE:
                        table = pa.Table.from_batches(waiting)
                        key = column(table, "key")
                        whole = int(np.searchsorted(key, key[-1]))  # the last key may go on
                        yield from resolved(table.slice(0, whole))
                        waiting, held = table.slice(whole).to_batches(), held - whole
    if waiting:
        yield from resolved(pa.Table.from_batches(waiting))


def covered(block: Block, places: np.ndarray) -> np.ndarray:
    """Which bytes of a block the removed windows cover: those given, and those that the block itself settles."""
    _, (head, tail) = block.reduced()
    head, tail = np.r_[head, places >> 7], np.r_[tail, (places >> 7) + (places & 127)]
    n = len(block.data)
    edge = np.bincount(head, minlength=n + 1) - np.bincount(tail + L, minlength=n + 1) if n else np.zeros(1, np.int64)
    return np.cumsum(edge)[:n] > 0


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
RESULT_SQL = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def digest(block: Block, gone: np.ndarray) -> pa.RecordBatch:
    n_gone = np.r_[0, np.cumsum(gone)]
    rows = []
    for i, s, e in zip(block.ids.tolist(), block.starts.tolist(), block.ends.tolist()):
        removed = int(n_gone[e] - n_gone[s])
        raw, spans = block.raw[s:e], 0
        if removed:
            g = gone[s:e]
            spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum())
            raw = block.data[s:e][~g].tobytes()
        rows.append((None if i == NO_ID else i, e - s, removed, spans, hashlib.sha256(raw).hexdigest()))
    return batch_of(RESULT, *zip(*rows))


def rewritten(block: Block, gone: np.ndarray, rest: bytes, names: list[str], null_text: str | None) -> pa.RecordBatch:
    """The block's rows as they came, without the removed bytes."""
    others = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(rest, max_output_size=1 << 31) if rest else b"").read_all().combine_chunks()
    text = [(whole_points(block.data[s:e], gone[s:e]) if gone[s:e].any() else block.raw[s:e]).decode("utf-8", "replace") for s, e in zip(block.starts.tolist(), block.ends.tolist())]
    columns = {n: others.column(n).combine_chunks() if others.num_rows else pa.array([]) for n in others.schema.names}
    if null_text is not None:
        text = [None if x else t for x, t in zip(columns.pop(null_text).to_pylist(), text)]
    if "n_chars" in columns and pa.types.is_integer(columns["n_chars"].type):
        old = columns["n_chars"].to_pylist()
        columns["n_chars"] = pa.array([n if n is None or t is None else len(t) for n, t in zip(old, text)], columns["n_chars"].type)
    columns["text"] = pa.array(text, pa.string())
    arrays = [columns[n].combine_chunks() if isinstance(columns[n], pa.ChunkedArray) else columns[n] for n in names]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def whole_points(data: np.ndarray, gone: np.ndarray) -> bytes:
    """What stays of a text when a code point goes only as a whole."""
    lead = (data & 0xC0) != 0x80
    point = np.cumsum(lead) - 1
    stays = np.zeros(int(point[-1]) + 1, bool)
    stays[point[~gone]] = True
    return data[stays[point]].tobytes()


def judged_anchors(blocks: DataFrame, hot: int) -> DataFrame:
    ordered = blocks.mapInArrow(freed(anchor_batches), ANCHOR_SQL).repartition("key").sortWithinPartitions("key", "d1", "d2", "doc", "block", "place")
    return ordered.mapInArrow(freed(lambda it: judge_batches(it, hot)), JUDGED_SQL)


def removed_windows(blocks: DataFrame, hot: int) -> DataFrame:
    """(block, place) of the windows that also start earlier, as far as a block alone does not settle it."""
    judged = cut(judged_anchors(blocks, hot))
    release(blocks.sparkSession)  # the exchange of all anchors is the largest there is, and done with

    # Two numbers for each anchor of a block: at most the block's size in windows.
    lists = judged.where(F.col("kind") != COPY).groupBy("block").agg(F.collect_list(F.struct("key", "place", "kind")).alias("asked"))
    stretches = blocks.join(lists, "block").select(*blocks.columns, "asked").mapInArrow(freed(stretch_batches), STRETCH_SQL)
    met = stretches.repartition("key").sortWithinPartitions("kind", "key", "d1", "d2", "doc", "block", "place")
    copies = judged.where(F.col("kind") == COPY).select("block", "place")
    return copies.unionByName(met.mapInArrow(freed(resolve_batches), "block bigint, place bigint"))


def place_batches(batches: Iterator[pa.RecordBatch], names: list[str] | None) -> Iterator[pa.RecordBatch]:
    """Blocks with their removed windows -> digests, or with names the rows that stay, with these columns."""
    for b in batches:
        for k in range(b.num_rows):
            row, rest, places = [b.column(i)[k].as_py() for i in range(4)], b.column(4)[k].as_py(), b.column(5)[k]
            block = Block(*row)
            gone = covered(block, places.values.to_numpy(zero_copy_only=False) if places.is_valid else np.zeros(0, np.int64))
            yield digest(block, gone) if names is None else rewritten(block, gone, rest, names, MISSING)


#: Marks null texts on their way through the blocks.
MISSING = "__larkspur_null_text"


def judged_blocks(rows: DataFrame, with_rest: bool, hot: int) -> DataFrame:
    blocks = cut(rows.mapInArrow(freed(lambda it: pack_blocks(it, with_rest)), BLOCK_SQL))
    gone = removed_windows(blocks.drop("rest"), hot).groupBy("block").agg(F.collect_list("place").alias("places"))
    return blocks.join(gone, "block", "left").select(*blocks.columns, "places")


def dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return judged_blocks(texts(docs), False, hot).mapInArrow(freed(lambda it: place_batches(it, None)), RESULT_SQL)


def remove(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """The documents without the bytes that also start earlier, with all their columns; n_chars, where there is one, follows the text."""
    names = docs.columns
    others = [F.col(f"`{c}`") for c in names if c != "text"]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("__larkspur_id"), F.coalesce("text", F.lit("")).alias("__larkspur_text"), *others, F.col("text").isNull().alias(MISSING))
    return judged_blocks(rows, True, hot).mapInArrow(freed(lambda it: place_batches(it, names)), docs.schema)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
