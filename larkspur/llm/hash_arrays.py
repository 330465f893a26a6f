"""Sorted arrays of 64-bit keys with their values, in files of the shared folder that workers map into memory.

A part is two files: ``part-NNNNN.key``, unsigned 64-bit keys in ascending order without repeats, and ``part-NNNNN.val``, a value for
each of some NumPy type, all little-endian.  Parts hold ranges of keys, so a sorted run of keys is looked up part by part, each by
one binary search over neighbours.  What is mapped is the system's to drop: a worker's own memory does not grow with the arrays.  Where
the shared folder is no file system of the machine, a part is first copied to an unnamed file that goes with its worker.

A task writes a part under a name of its attempt and renames it.  Attempts of one task write the same bytes, so where a part is there
already the later attempt drops its own.
"""

from __future__ import annotations

import mmap
import tempfile
import uuid

import numpy as np
from pyarrow import fs

#: Parts that a worker holds mapped.
MAPPED = 8_192


def _store(path: str, raw: bytes) -> None:
    store, at = fs.FileSystem.from_uri(path)
    folder, _, name = at.rpartition("/")
    store.create_dir(folder, recursive=True)
    attempt = f"{folder}/_attempt-{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(attempt) as f:
        f.write(raw)
    try:
        store.move(attempt, at)
    except OSError:  # some stores do not rename onto a file
        if store.get_file_info(at).type != fs.FileType.File:
            raise
        store.delete_file(attempt)


def write_part(path: str, part: int, keys: np.ndarray, values: np.ndarray) -> None:
    _store(f"{path}/part-{part:05d}.val", values.tobytes())
    _store(f"{path}/part-{part:05d}.key", keys.astype("<u8").tobytes())


def mapped(path: str, kind) -> np.ndarray:
    store, at = fs.FileSystem.from_uri(path)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(at, kind, "r")
    with tempfile.TemporaryFile() as own, store.open_input_stream(path=at) as f:
        while piece := f.read(1 << 24):
            own.write(piece)
        own.flush()
        return np.frombuffer(mmap.mmap(own.fileno(), 0, access=mmap.ACCESS_READ), kind)


class Arrays:
    """Lookups in the parts of a folder.  parts: (number, first key) of every part, by ascending key."""

    def __init__(self, path: str, kind, parts: list[tuple[int, int]]):
        self.path, self.kind = path, np.dtype(kind)
        self.numbers = [p for p, _ in parts]
        self.firsts = np.array([k for _, k in parts], np.uint64)

    def _part(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        name = f"{self.path}/part-{self.numbers[k]:05d}"
        got = _HELD.pop(name, None)
        if got is None:
            got = mapped(name + ".key", "<u8"), mapped(name + ".val", self.kind)
            if len(_HELD) >= MAPPED:
                del _HELD[next(iter(_HELD))]
        _HELD[name] = got  # the latest used are last
        return got

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of ascending keys; 0 where there is none."""
        out = np.zeros(len(keys), self.kind)
        if not len(self.firsts) or not len(keys):
            return out
        cuts = np.r_[np.searchsorted(keys, self.firsts), len(keys)].tolist()
        for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if i < j:
                there, values = self._part(k)
                at = np.minimum(np.searchsorted(there, keys[i:j]), len(there) - 1)
                hit = there[at] == keys[i:j]
                out[i:j][hit] = values[at[hit]]
        return out


#: Mapped parts of this worker process.
_HELD: dict[str, tuple[np.ndarray, np.ndarray]] = {}
