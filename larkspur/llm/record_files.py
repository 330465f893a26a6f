"""Token ids in files of length-delimited binary records, with an offset index for shuffled reads.

File format, little-endian.  A data file ``part-NNNNN.rec`` is a run of frames:

    uint64 length | uint32 masked checksum of those 8 bytes | payload | uint32 masked checksum of the payload

and a payload is ``int64 doc_id, uint32 n_tokens, uint8 width`` and n_tokens ids of `width` bytes each (2 where the
vocabulary fits, else 4).  A checksum is the CRC-32 of the bytes, rotated right by 15 bits plus 0xA282EAD8, so that
the checksum of data that holds checksums stays sound.  ``part-NNNNN.idx`` is the offset index: uint64 offset and uint64
token start within the file for every frame, so that any record can be read by one seek.

Documents are range-partitioned by doc_id and a hash of the text, so the sample that finds the ranges holds 16 bytes a row and an id
with very many rows is split.  The tasks encode and write them, each to a name of its own attempt that is
then renamed: a task that runs again leaves the same files.  That a rename replaces a file of an earlier attempt is asked of the folder's store.  The folder lies in the shared folder of the cluster.

Defined results: a null text is an empty document of only the end id; null doc_ids come first; rows with one doc_id
stay separate records in the order of that hash; a very long text is one record; the model's added tokens are
found in texts, as the library finds them; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, freed, new_dir, partitions, slices, table, texts

MASK_DELTA = 0xA282EAD8
FRAME = struct.Struct("<QI")
HEAD = struct.Struct("<qIB")
#: Units of at most LONGEST characters in a generation of what a worker remembers; two are held, under 200 MB.
MEMO, LONGEST = 400_000, 40
#: Units that are encoded in one string.
JOIN = 256
NO_ID = -(1 << 63)
WRITTEN = pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def masked(data) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def read_frames(stream) -> Iterator[bytes]:
    """Payloads of a data file; a wrong checksum or a cut file is an error."""
    while head := stream.read(FRAME.size):
        if len(head) < FRAME.size:
            raise ValueError("a frame's head is cut off")
        n, check = FRAME.unpack(head)
        if masked(head[:8]) != check:
            raise ValueError("the checksum of a length is wrong")
        payload = stream.read(n)
        tail = stream.read(4)
        if len(payload) < n or len(tail) < 4 or masked(payload) != struct.unpack("<I", tail)[0]:
            raise ValueError("a record is cut off or its checksum is wrong")
        yield bytes(payload)


def read_record(path: str, k: int) -> tuple[int, np.ndarray]:
    """Record k of a data file, by its index."""
    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at.removesuffix(".rec") + ".idx") as f:
        f.seek(16 * k)
        offset = struct.unpack("<Q", f.read(8))[0]
    with store.open_input_file(at) as f:
        f.seek(offset)
        return unpack(next(read_frames(f)))


def pack(doc_id: int, ids: np.ndarray, width: int) -> bytes:
    return HEAD.pack(doc_id, len(ids), width) + ids.astype("<u2" if width == 2 else "<u4").tobytes()


def unpack(payload: bytes) -> tuple[int, np.ndarray]:
    doc_id, n, width = HEAD.unpack_from(payload)
    return doc_id, np.frombuffer(payload, "<u2" if width == 2 else "<u4", n, HEAD.size)


class Encoder:
    """Ids of whole texts by the tokenizers library.

    Byte-level BPE never joins what its splitting pattern sets apart, and the pattern always splits before a space that
    follows another character than white space.  So a text falls into units (a space and what follows up to the next
    space), and the distinct units of a batch are encoded alone.  A text with a space before further white space, or
    with one of the added tokens, is encoded in one piece.
    """

    #: White space of any kind, which may be more than the pattern's.
    odd = r" [\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = ["\0", *(t.content for t in self.tok.get_added_tokens_decoder().values())]
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.kind = "<u2" if self.width == 2 else "<u4"
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # Tokens that begin with a space: in a string of units, each unit has one, at its start.
        self.starts = np.zeros(self.tok.get_vocab_size(), bool)
        self.starts[[i for t, i in self.tok.get_vocab().items() if t[:1] == "\u0120"]] = True

    def _spaced(self, pieces: list[str]) -> list[bytes]:
        """Ids of " " + piece for each piece; many pieces go into one call."""
        groups = [pieces[i : i + JOIN] for i in range(0, len(pieces), JOIN)]
        out: list[bytes] = []
        for group, e in zip(groups, self.tok.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            at = np.flatnonzero(self.starts[ids])
            if len(at) == len(group):
                raw, cut = ids.tobytes(), (at * self.width).tolist()
                out += [raw[a:b] for a, b in zip(cut, [*cut[1:], len(raw)])]
            else:
                out += self._raw([" " + p for p in group])
        return out

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units without their spaces; the first unit of a text has none and is told apart by a leading NUL."""
        memo, old = self.memo, self.old.get
        got = list(map(memo.get, units))
        fresh = [k for k, g in enumerate(got) if g is None]
        for k in fresh:
            got[k] = old(units[k])
        missing = [k for k in fresh if got[k] is None]
        first = [k for k in missing if units[k][:1] == "\0" or not units[k]]
        rest = [k for k in missing if units[k][:1] != "\0" and units[k]]
        for at, ids in ((first, self._raw([units[k][1:] if units[k] else " " for k in first])), (rest, self._spaced([units[k] for k in rest]))):
            for k, i in zip(at, ids):
                got[k] = i
        if len(memo) >= MEMO:
            self.old, self.memo = memo, {}
        self.memo.update((units[k], got[k]) for k in fresh if len(units[k]) <= LONGEST)
        return got

    def encode(self, texts: pa.Array) -> list[bytes]:
        c = pa.compute
        whole = c.match_substring_regex(texts, self.odd)
        for token in self.added:
            whole = c.or_(whole, c.match_substring(texts, token))
        split = c.split_pattern(c.binary_join_element_wise("\0", c.if_else(whole, "", texts), ""), " ")
        flat = split.flatten().dictionary_encode()
        ids = pa.array(self._units(flat.dictionary.to_pylist()), pa.binary()).take(flat.indices)
        at = np.r_[0, np.cumsum(c.list_value_length(split).to_numpy(zero_copy_only=False))]
        ends = np.r_[0, np.cumsum(c.binary_length(ids).to_numpy(zero_copy_only=False))][at].tolist()
        raw = ids.buffers()[2].to_pybytes() if ids.buffers()[2] else b""
        out = [raw[i:j] for i, j in zip(ends, ends[1:])]
        odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist()
        for k, i in zip(odd, self._raw([texts[k].as_py() for k in odd])):
            out[k] = i
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_shard(batches: Iterator[pa.RecordBatch], path: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
    end = np.array([end_id], enc.kind).tobytes()
    store, at = fs.FileSystem.from_uri(path)
    name, attempt = f"{at}/part-{shard:05d}", f"{at}/_attempt-{shard:05d}-{uuid.uuid4().hex}"
    n_docs = n_tokens = offset = 0
    data = index = None
    for b in slices(batches, most=8_000_000):
        if data is None:
            store.create_dir(at, recursive=True)
            data, index = store.open_output_stream(attempt + ".rec"), store.open_output_stream(attempt + ".idx")
        parts, where = [], []
        for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1))):
            ids += end
            n = len(ids) // enc.width
            f = frame(HEAD.pack(NO_ID if doc_id is None else doc_id, n, enc.width) + ids)
            where += (offset, n_tokens)
            parts.append(f)
            offset, n_tokens, n_docs = offset + len(f), n_tokens + n, n_docs + 1
        data.write(b"".join(parts))
        index.write(np.array(where, "<u8").tobytes())
    if data is not None:
        data.close()
        index.close()
        for kind in (".idx", ".rec"):
            store.move(attempt + kind, name + kind)
        yield batch_of(WRITTEN, [shard], [n_docs], [n_tokens])


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Encode texts(docs) and write the files; a row for each file: shard, n_docs, n_tokens.  It runs when acted upon."""
    spark = docs.sparkSession
    rows = texts(docs).withColumn("hash", F.xxhash64("text"))
    ordered = rows.repartitionByRange(partitions(spark), "doc_id", "hash").sortWithinPartitions("doc_id", "hash").drop("hash")
    return ordered.mapInArrow(freed(lambda it: write_shard(it, path, tokenizer, end_id)), "shard int, n_docs bigint, n_tokens bigint")


def read_shard(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    store, at = fs.FileSystem.from_uri(path)
    for b in batches:
        for shard, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            rows: list[tuple] = []
            with store.open_input_stream(f"{at}/part-{shard:05d}.rec", buffer_size=1 << 20) as f:
                for payload in read_frames(f):
                    doc_id, ids = unpack(payload)
                    rows.append((None if doc_id == NO_ID else doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield batch_of(READ, *zip(*rows))
                        rows = []
            if rows:
                yield batch_of(READ, *zip(*rows))


def read_shards(spark: SparkSession, path: str, shards: list[tuple[int, int]]) -> DataFrame:
    """A row for each record, from the files alone: doc_id, start, n_tokens, ids_crc32.  shards: (shard, ids before it)."""
    if not shards:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    named = spark.createDataFrame([(*x, k) for k, x in enumerate(shards)], "shard int, start bigint, k int").repartitionById(len(shards), F.col("k"))
    return named.mapInArrow(lambda it: read_shard(it, path), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_records(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write the records of all documents in ascending doc_id order, then read the files back."""
    spark = docs.sparkSession
    path = path or new_dir(spark, "records")
    start, shards = 0, []
    for r in sorted(write_shards(docs, path, tokenizer, end_id).collect()):  # one row for each file
        shards.append((r.shard, start))
        start += r.n_tokens
    return read_shards(spark, path, shards)


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_records(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
