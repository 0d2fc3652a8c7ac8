"""Helpers shared by the operators: shared storage, Arrow text buffers, vectorised word hashing and CSR gathers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_path, staged

MULT = np.uint64(0x9E3779B97F4A7C15)
#: A byte that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD = r"[^\x20\x09-\x0D]+"
__all__ = ["IS_SPACE", "MULT", "WORD", "Rolling", "csr", "fresh", "gather", "mix", "packed", "pieces", "powers", "release", "shared_path", "staged", "table", "text_buffer", "text_of", "unpacked", "words"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column has it."""
    out = []
    for n in names:
        while n.lower() in {c.lower() for c in (*columns, *out)}:
            n += "_"
        out.append(n)
    return out


def text_of(col: str = "text"):
    """The text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def text_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows back to back, and where each row starts (one more entry than rows). Null: empty."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays([c.cast(pa.large_binary()) for c in col.chunks]) if col.num_chunks else pa.array([], pa.large_binary())
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def pieces(batch: pa.RecordBatch | pa.Table, col: str = "text", most: int = 1 << 21) -> Iterator[pa.RecordBatch | pa.Table]:
    """Row slices of at most that many text bytes, or a single longer text: bounds the memory of what is derived."""
    sizes = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False) if batch.num_rows else np.zeros(0)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def release() -> None:
    """Gives free memory back to the system. Workers are used again by later stages, and keep what the largest task took otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = 0x100000001B3 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
#: Powers that a worker keeps; those for longer texts are made anew.
KEPT = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length()) if n <= KEPT else int(n)
        out = np.empty(size, np.uint64)
        out[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        have = out
        if size <= KEPT:
            _POWERS[base] = out
    return have[:n]


_SALT = mix(np.arange(1, 257, dtype=np.uint64) * MULT)


class Rolling:
    """Hashes of any substring of buf in constant time each."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_SALT[buf] * powers(_BASE, n), out=self.sums[1:])
        self.back = powers(_INVERSE, n + 1)

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Values whose high bits are mixed well enough for a table."""
        return (self.sums[end] - self.sums[start]) * self.back[start] * MULT

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])

    def windows(self, k: int) -> np.ndarray:
        return mix((self.sums[k:] - self.sums[:-k]) * self.back[: len(self.sums) - k])


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and of each row its first word's number (one more entry than rows)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    letter = ~IS_SPACE[buf]
    before = np.empty_like(letter)
    before[0], before[1:] = False, letter[:-1]
    first = off[:-1][off[:-1] < off[1:]]
    before[first] = False
    start = np.flatnonzero(letter & ~before)
    after = np.empty_like(letter)
    after[-1], after[:-1] = False, letter[1:]
    after[first[1:] - 1] = False
    end = np.flatnonzero(letter & ~after) + 1
    return start, end, np.searchsorted(start, off)


def gather(flat: np.ndarray, off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given rows of a CSR array, back to back, and their offsets."""
    start = off[rows]
    size = off[rows + 1] - start
    out = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    at = np.repeat(start - out[:-1], size)
    at += np.arange(out[-1])
    return flat[at], out


def csr(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    off = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(x) for x in rows], out=off[1:])
    return np.frombuffer(b"".join(rows), np.uint8), off


def packed(x: np.ndarray) -> bytes:
    """Numbers as bytes, all first bytes together, then all second bytes, and so on, compressed: sorted or small numbers shrink well."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b"", 1)


def unpacked(blobs: list[bytes], kind) -> np.ndarray:
    """The numbers of all blobs, one after the other."""
    size = np.dtype(kind).itemsize
    parts = [np.frombuffer(zstandard.decompress(b), np.uint8).reshape(size, -1).T for b in blobs]
    return np.ascontiguousarray(np.concatenate(parts)).view(kind).ravel() if parts else np.zeros(0, kind)
