"""Document fingerprints: invertible Bloom lookup tables over paragraphs.

A paragraph is a run of words that ends where a word's hash says so, so that an edit changes only the paragraphs that it touches: one
word in four ends one, and every line end, up to the 64th word; from there to the 256th half as many, and half as many again each time
that the place is four times as far. So a table grows with the square root of the text. A paragraph's digest is hashed into one cell of
each of PARTS parts of a table; a cell holds how many digests it got, their sum and the sum of their check values. Tables of two texts
subtract cell by cell, which leaves the digests in which they differ; cells that hold one digest give it up, it is taken out of its
other cells, and so on until all cells are empty. If that fails, both tables are made again twice as large.

A fingerprint is the smallest such table that gives up all of its own text's digests. So two fingerprints of whatever size tell exactly
in which digests their texts differ, and compared() finds from them alone the likeness that is returned: (all digests - differing
ones) / (all + differing ones), that is, shared digests doubled, by all digests that are in one text or the other, doubled.

The next document is that of the next smaller id (after the last: the first); rows are dealt out by ranges of the id, and each range
also gets the first row of the following one. Null text counts as empty. Rows with a null id come last. Rows of one id follow in the
order of their texts' hashes. A text without words has no digests: it is like another such text (1) and unlike all others (0). One row
is its own next. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, csr, gather, mix, text_of, words
from .near import labelled

CELLS, PARTS, EVERY, NEAR = 24, 3, 4, 64
#: Bytes of a range of ids, and keys sampled for each range to place its bounds: what the driver holds is 320 bytes for each of them.
RANGE, SAMPLED = 1 << 30, 20
PIECE = 1 << 20
NO_ID = -(1 << 63)


def paragraphs(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of each row's paragraphs, a repeated one told by its occurrence number; and the rows' offsets."""
    start, end, row = words(buf, off)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    roll, lines = Rolling(buf), np.r_[0, np.cumsum(buf == 10)]
    place = np.arange(len(start)) - np.repeat(row[:-1], np.diff(row))
    coarse = (np.uint64(1) << (np.maximum(0, np.log2(np.maximum(place, 1) / (NEAR / 4)) // 2)).astype(np.uint64)) - np.uint64(1)
    h = roll.of(start, end)
    last = (h & (coarse * np.uint64(EVERY) + np.uint64(EVERY - 1))) == 0
    last[:-1] |= (lines[start[1:]] > lines[end[:-1]]) & ((h[:-1] & coarse[:-1]) == 0)
    last[row[1:][np.diff(row) > 0] - 1] = True
    stop = np.flatnonzero(last)
    begin = np.r_[0, stop[:-1] + 1]
    out_off = np.searchsorted(stop, row)
    return labelled(roll.of(start[begin], end[stop]), out_off), out_off


def _cells(x: np.ndarray, size: int) -> np.ndarray:
    part = size // PARTS
    return np.stack([j * part + (mix(x + np.uint64(j + 1)) % np.uint64(part)).astype(np.int64) for j in range(PARTS)])


class Sketches:
    """Tables of several rows: counts, sums of digests, sums of check values."""

    def __init__(self, n: int, size: int):
        self.size = size
        self.count, self.key, self.check = np.zeros(n * size, np.int64), np.zeros(n * size, np.uint64), np.zeros(n * size, np.uint64)

    def add(self, row: np.ndarray, x: np.ndarray, sign: np.ndarray | int = 1) -> None:
        sign = np.broadcast_to(sign, x.shape)
        k, c = x * sign.astype(np.uint64), mix(x) * sign.astype(np.uint64)
        for cell in _cells(x, self.size):
            at = row * self.size + cell
            np.add.at(self.count, at, sign)
            np.add.at(self.key, at, k)
            np.add.at(self.check, at, c)

    @classmethod
    def of(cls, x: np.ndarray, off: np.ndarray, size: int) -> Sketches:
        out = cls(len(off) - 1, size)
        out.add(np.repeat(np.arange(len(off) - 1), np.diff(off)), x)
        return out

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(0, self.size)
        out.count, out.key, out.check = self.count - other.count, self.key - other.key, self.check - other.check
        return out

    def copy(self) -> Sketches:
        return self.minus(Sketches(len(self.count) // self.size, self.size))

    def peel(self) -> tuple[np.ndarray, np.ndarray]:
        """Digests recovered of each row, and whether they are all. Empties the tables as far as it can."""
        n = len(self.count) // self.size
        found = np.zeros(n, np.int64)
        look = np.arange(len(self.count))
        while len(look):
            at = look[np.abs(self.count[look]) == 1]
            x = self.key[at] * self.count[at].astype(np.uint64)
            pure = self.check[at] == mix(x) * self.count[at].astype(np.uint64)
            at, x = at[pure], x[pure]
            if not len(at):
                break
            row, sign = at // self.size, self.count[at]
            order = np.lexsort((x, row))
            once = order[np.r_[True, (x[order][1:] != x[order][:-1]) | (row[order][1:] != row[order][:-1])]]
            row, x, sign = row[once], x[once], sign[once]
            found += np.bincount(row, minlength=n)
            self.add(row, x, -sign)
            look = np.unique((row * self.size + _cells(x, self.size)).ravel())
            # a false pure cell could be put back and forth; no row has more rounds than this
            if found.max(initial=0) > 4 * self.size:
                break
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        return found, ~left.reshape(n, self.size).any(1)

    def row(self, i: int) -> str:
        """A row's table as text: its cells' counts, sums, and 32 bits of their check values."""
        at = slice(i * self.size, (i + 1) * self.size)
        cell = np.empty(self.size, _CELL)
        cell["n"], cell["x"], cell["c"] = self.count[at], self.key[at], self.check[at] & _LOW
        return base64.b64encode(cell.tobytes()).decode()


_LOW = np.uint64(0xFFFFFFFF)
_CELL = np.dtype([("n", "<i2"), ("x", "<u8"), ("c", "<u4")])


def fingerprint(x: np.ndarray, off: np.ndarray, size: int = CELLS) -> list[str]:
    """Each row's digests in the smallest table that gives them all up again."""
    out, rows = [""] * (len(off) - 1), np.arange(len(off) - 1)
    while len(rows):
        part, at = gather(x, off, rows)
        made = Sketches.of(part, at, size)
        whole = made.copy().peel()[1]
        for i in np.flatnonzero(whole):
            out[rows[i]] = made.row(i)
        rows, size = rows[~whole], size + max(PARTS, size // (2 * PARTS) * PARTS)
    return out


def digests(text: str) -> np.ndarray:
    """A fingerprint's digests, peeled out of it."""
    cell = np.frombuffer(base64.b64decode(text), _CELL)
    n, x, c = cell["n"].astype(np.int64), cell["x"].copy(), cell["c"].astype(np.uint64)
    found = []
    while len(at := np.flatnonzero((n == 1) & ((mix(x) & _LOW) == c))):
        d = np.unique(x[at])
        found.append(d)
        for where in _cells(d, len(cell)):
            np.subtract.at(n, where, 1)
            np.subtract.at(x, where, d)
            np.subtract.at(c, where, mix(d) & _LOW)
        c &= _LOW
    if n.any():
        raise ValueError("this is no fingerprint")
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def compared(a: str, b: str) -> float:
    """Likeness of two fingerprints, from them alone."""
    x, y = digests(a), digests(b)
    both = len(np.intersect1d(x, y))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def differences(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int = CELLS) -> np.ndarray:
    """How many digests each row of a and b (digests, offsets) differ in, by tables as large as need be."""
    n = len(a[1]) - 1
    out, rows = np.zeros(n, np.int64), np.arange(n)
    while len(rows):
        found, whole = Sketches.of(*gather(*a, rows), size).minus(Sketches.of(*gather(*b, rows), size)).peel()
        out[rows[whole]] = found[whole]
        rows, size = rows[~whole], size * 2
    return out


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int = CELLS) -> np.ndarray:
    total, apart = np.diff(a[1]) + np.diff(b[1]), differences(a, b, size)
    return np.where(total > 0, (total - apart) / np.maximum(1, total + apart), 1.0)


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by the beginning of the following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _stream(size: int):
    def rows(batches):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("id", "b", "halo", "t")), strict=True)

    def made(held):
        """Of all but the last of held, those followed by a row of their range."""
        texts = [r[3] or "" for r in held]
        pairs = [i for i in range(len(held) - 1) if not held[i][2] and held[i][1] == held[i + 1][1]]
        changed = [edited(texts[i], texts[i + 1]).encode() for i in pairs]
        own, new = paragraphs(*csr([t.encode() for t in texts])), paragraphs(*csr(changed))
        at = np.array(pairs, np.int64)
        mine, following = gather(*own, at), gather(*own, at + 1)
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([held[i][0] for i in pairs], pa.int64()), "n_chars": pa.array([len(texts[i]) for i in pairs], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in changed], pa.string()),
            "fingerprint": pa.array(fingerprint(*mine, size), pa.string()), "edited_fingerprint": pa.array(fingerprint(*new, size), pa.string()),
            "near_edited": pa.array(likeness(mine, new, size)), "near_next": pa.array(likeness(mine, following, size)),
        })

    def run(batches):
        held, total = [], 0
        for r in rows(batches):
            held.append(r)
            total += len(r[3] or "")
            if total > PIECE and len(held) > 1:
                yield made(held)
                held, total = held[-1:], len(r[3] or "")
        if len(held) > 1:
            yield made(held)

    return run


def _range(bounds: list[tuple[int, int]]):
    """The range of each key (z, k) among sorted bounds, counted downwards: how many bounds are larger."""
    bz, bk = (np.array([b[i] for b in bounds], np.int64) for i in range(2))

    @F.pandas_udf("int")
    def find(z: pd.Series, k: pd.Series) -> pd.Series:
        z, k = z.to_numpy(), k.to_numpy()
        lo, hi = np.searchsorted(bz, z, "left"), np.searchsorted(bz, z, "right")
        # among bounds of the same id the second part decides
        for v in np.unique(z[lo < hi]):
            own = z == v
            a, b = lo[own][0], hi[own][0]
            hi[own] = a + np.searchsorted(bk[a:b], k[own], "right")
        return pd.Series((len(bz) - hi).astype(np.int32))

    return find


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CELLS, most: int = RANGE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row. most: bytes of a range."""
    spark = docs.sparkSession
    text, id_ = text_of(f"`{text_col}`"), F.col(f"`{id_col}`").cast("long")
    rows = docs.select(id_.alias("id"), text.alias("t"), F.coalesce(id_, F.lit(NO_ID)).alias("z"), F.xxhash64(text).alias("k"))
    weight = F.octet_length("t") + 64
    total = rows.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // most))
    # a long text counts for its bytes, so that ranges hold about the same; the sample balances them and changes no result
    some = rows.filter(F.rand(1) < weight * (n * SAMPLED / max(1, total))).select("z", "k").orderBy("z", "k").collect()
    bounds = sorted({tuple(some[i * len(some) // n]) for i in range(1, n)}) if some else []
    rows = rows.withColumn("b", _range(bounds)("z", "k"))
    # one row a range
    tops = sorted(tuple(r) for r in rows.groupBy("b").agg(F.max(F.struct("z", "k")).alias("x")).select("b", "x.z", "x.k").collect())
    first = [(tops[i][0], *tops[(i + 1) % len(tops)][1:]) for i in range(len(tops))]
    halo = F.broadcast(spark.createDataFrame(first, "hb int, hz long, hk long"))
    extra = rows.join(halo, (F.col("z") == F.col("hz")) & (F.col("k") == F.col("hk"))).dropDuplicates(["hb"])
    both = rows.select("id", "t", "z", "k", "b", F.lit(False).alias("halo")).unionByName(extra.select("id", "t", "z", "k", F.col("hb").alias("b"), F.lit(True).alias("halo")))
    dealt = both.repartition(n, "b").sortWithinPartitions("b", "halo", F.desc("z"), F.desc("k"))
    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("id", "b", "halo", "t").mapInArrow(_stream(size), out)
