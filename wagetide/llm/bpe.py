"""Byte-level BPE encoding and decoding.

Texts are cut by the tokenizer's pattern. Distinct pieces are put into length-bucketed padded numpy matrices, in which every row
merges its leftmost pair of minimum rank each round; pair ranks come from an open-addressing hash table held in arrays, rows that
are done are compacted away, and as every row loses one column a round, so does the matrix. Pieces longer than LONGEST bytes go
through a heap over a linked list, which makes the same merges in n log n steps. Decoding gathers the tokens' bytes.

Null text counts as empty: no tokens, the digests are those of nothing. Repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import csr, gather, pieces, release

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LONGEST = 512
#: Distinct pieces, and their characters, whose tokens a worker keeps; beyond, it begins anew.
CACHED = 250_000
CACHED_CHARS = 8_000_000
NONE = np.iinfo(np.int32).max


class Bpe:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern).findall
        self.size = max(self.ranks.values()) + 1
        tokens = [b""] * self.size
        for t, r in self.ranks.items():
            tokens[r] = t
        self.bytes, self.bytes_off = csr(tokens)
        self.digits, self.digits_off = csr([b"%d," % r for r in range(self.size)])
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs: dict[int, int] = {}
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                a, b = self.ranks.get(t[:i]), self.ranks.get(t[i:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = r
        self._index(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        self.known: dict[str, int] = {}
        self.held = 0
        self.flat, self.off = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _index(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot[left]] < 0
            _, firsts = np.unique(slot[left[free]], return_index=True)
            put = left[free][firsts]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that a and b make; NONE if they make none or one is padding (negative)."""
        shape, keys = a.shape, (a.astype(np.int64) * self.size + b).ravel()
        keys[(a < 0).ravel() | (b < 0).ravel()] = -2
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE).astype(np.int32)
        left = np.flatnonzero((found != keys) & (found >= 0) & (keys >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out.reshape(shape)

    def _matrix(self, m: np.ndarray, rows: np.ndarray, out: list) -> None:
        """Merges all rows of m, padded with -1 on the right, to the end; row i is the piece rows[i]."""
        ranks = self.rank(m[:, :-1], m[:, 1:])
        while len(m):
            if not ranks.shape[1]:
                best = np.full(len(m), NONE, np.int32)
            else:
                j = ranks.argmin(1)
                best = ranks[np.arange(len(m)), j]
            if (done := best == NONE).any():
                for i in np.flatnonzero(done):
                    row = m[i]
                    out[rows[i]] = row[row >= 0]
                more = ~done
                m, ranks, rows, best = m[more], ranks[more], rows[more], best[more]
                if not len(m):
                    return
                j = j[more]
            each, cols = np.arange(len(m)), np.arange(m.shape[1] - 1)
            m[each, j] = best
            m = np.take_along_axis(m, cols + (cols > j[:, None]), 1)
            cols = cols[:-1]
            ranks = np.take_along_axis(ranks, cols + (cols >= j[:, None]), 1)
            width = m.shape[1]
            for k in (j - 1, j):
                ok = (k >= 0) & (k < width - 1)
                at = each[ok]
                ranks[at, k[ok]] = self.rank(m[at, k[ok]], m[at, k[ok] + 1])

    def _long(self, piece: bytes) -> np.ndarray:
        """One long piece by a heap of (rank, place): the same merges in the same order."""
        ids = self.single[np.frombuffer(piece, np.uint8)].astype(np.int64)
        first = self.rank(ids[:-1].astype(np.int32), ids[1:].astype(np.int32))
        ids, n = ids.tolist(), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(r), i) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        at = self._pair
        while heap:
            r, i = heapq.heappop(heap)
            k = after[i]
            if ids[i] < 0 or k >= n or at(ids[i], ids[k]) != r:
                continue
            ids[i], ids[k] = r, -1
            after[i] = after[k]
            if after[i] < n:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (x := at(ids[p], ids[q])) != NONE:
                    heapq.heappush(heap, (x, p))
        return np.array([x for x in ids if x >= 0], np.int32)

    @lru_cache(maxsize=100_000)  # noqa: B019  the object lives as long as the worker
    def _pair(self, a: int, b: int) -> int:
        return int(self.rank(np.array([a], np.int32), np.array([b], np.int32))[0])

    def encode_pieces(self, found: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(found)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(found):
            if (r := self.ranks.get(p)) is not None:
                out[i] = np.array([r], np.int32)
            elif len(p) > LONGEST:
                out[i] = self._long(p)
            else:
                buckets.setdefault(int(len(p) - 1).bit_length(), []).append(i)
        for b, rows in buckets.items():
            width = 1 << b
            step = max(1, (1 << 19) // width)
            for s in range(0, len(rows), step):
                part = rows[s : s + step]
                buf, off = csr([found[i] for i in part])
                size = np.diff(off)
                m = np.full((len(part), width), -1, np.int32)
                m[np.arange(width) < size[:, None]] = self.single[buf]
                self._matrix(m, np.array(part), out)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids back to back, and their offsets."""
        found, ends = [], [0]
        for t in texts:
            found += self.find(t)
            ends.append(len(found))
        new = list(set(found) - self.known.keys())
        size = sum(map(len, new))
        if len(self.known) + len(new) > CACHED or self.held + size > CACHED_CHARS:
            self.known, self.flat, self.off, self.held = {}, np.zeros(0, np.int32), np.zeros(1, np.int64), 0
            new = list(set(found))
            size = sum(map(len, new))
        self.held += size
        if new:
            made = self.encode_pieces([p.encode() for p in new])
            n = len(self.known)
            self.known.update(zip(new, range(n, n + len(new)), strict=True))
            self.flat = np.concatenate([self.flat, *made])
            self.off = np.concatenate([self.off, self.off[-1] + np.cumsum([len(x) for x in made])])
        rows = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
        ids, off = gather(self.flat, self.off, rows)
        return ids, off[np.array(ends)]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        raw, at = gather(self.bytes, self.bytes_off, ids)
        raw, at = raw.tobytes(), at[off]
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def decimal(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        raw, at = gather(self.digits, self.digits_off, ids)
        raw, at = raw.tobytes(), at[off]
        return [raw[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:], strict=True)]


@lru_cache(maxsize=2)
def codec(path: str | None = None, pattern: str | None = None) -> Bpe:
    """A worker loads a vocabulary once. Default: the multilingual byte-level one of the installed public_tokenizers."""
    import public_tokenizers

    return Bpe(path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, token_ids (unless left out), ids_sha256, decoded_sha256 for each row, by whole text; no shuffle."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        release()
        bpe = codec(path, pattern)
        for batch in batches:
            for part in pieces(batch, text_col, 1 << 20):
                ids, off = bpe.encode([x or "" for x in part.column(text_col).to_pylist()])
                sha = lambda rows: pa.array([hashlib.sha256(x).hexdigest() for x in rows])
                cols = {id_col: part.column(id_col), "n_tokens": pa.array(np.diff(off))}
                if with_ids:
                    cols["token_ids"] = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_pydict(cols | {"ids_sha256": sha(bpe.decimal(ids, off)), "decoded_sha256": sha(bpe.decode(ids, off))})

    schema = f"`{id_col}` {kind}, n_tokens bigint, {'token_ids array<int>, ' * with_ids}ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
