"""Near-duplicate groups by Order MinHash with banded alignment.

A text is its sequence of shingles of five words; a repeated shingle is labelled with its occurrence number. Each of SKETCHES hash
functions picks the PICK smallest labelled shingles and keeps them in text order; their hash names a bucket. Texts of at most SHORT
shingles pick SHORT_PICK, and texts that may be near both kinds pick both. Texts that share much, in the same order, share a bucket: at
similarity 0.8 all buckets miss long texts with a probability of 0.0002, 20 of 25 common shingles with 0.0004, and 8 of 10 or 4 of 5 with
less than 0.000001.

Similarity is that of an alignment: matched shingles / (all shingles of both - matched). Pairs at or above the threshold leave at
most (n1 + n2) * (1 - t) / (1 + t) shingles unmatched, so matches lie in a band of that width around the diagonal; the longest common
subsequence inside the band is found bit-parallel, after equal beginnings and ends are taken off.

Equal texts are one node, named by the smallest id. In each bucket all nodes are compared with the most central one (it meets most
others over all its buckets), which settles nearly all. Buckets that then still hold several components compare every node outside the
largest with all nodes of other components, in blocks of bounded size, behind a count of common shingles that no alignment can
exceed. So every pair that shares a bucket is either compared or already connected, and no pairs are written out.

Null and empty texts, and texts without words, have no shingles: they are near none but equal to each other. Texts of one to four
words are one shingle. Rows of one id belong together. Rows with a null id join the class of their text, or, if no row with an id has
it, the class null. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULT, Rolling, fresh, mix, pieces, staged, text_buffer, text_of, words
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES, PICK = 16, 4
SHORT, SHORT_PICK = 16, 2
BLOCK = 1024
_ODD = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * MULT) | np.uint64(1)


def shingles(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' shingles in text order, and their offsets."""
    start, end, row = words(buf, off)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    w = Rolling(buf).of(start, end)
    count = np.diff(row)
    size = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    out_off = np.r_[0, np.cumsum(size)]
    at = np.repeat(row[:-1] - out_off[:-1], size) + np.arange(out_off[-1])
    of = np.repeat(count, size)
    h = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        h = np.where(of > k, h * MULT + w[np.minimum(at + k, len(w) - 1)], h)
    return mix(h), out_off


def labelled(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Hashes of the shingles with their occurrence numbers."""
    row = np.repeat(np.arange(len(off) - 1, dtype=np.uint64), np.diff(off))
    key = mix(h + row * MULT)
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]] if len(h) else np.zeros(0, bool)
    nth = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    occurrence = np.empty(len(h), np.uint64)
    occurrence[order] = nth
    return mix(h + occurrence * np.uint64(0xC2B2AE3D27D4EB4F))


def _buckets(x: np.ndarray, pick: int) -> np.ndarray:
    if len(x) < pick:  # meets only its like
        picked = x[None, :]
    elif len(x) == pick:
        picked = np.tile(x, (SKETCHES, 1))
    else:
        at = np.argpartition(x[None, :] * _ODD[:, None], pick - 1, axis=1)[:, :pick]
        at.sort(axis=1)
        picked = x[at]
    out = _ODD[: len(picked)] + np.uint64(pick)
    for k in range(picked.shape[1]):
        out = mix(out * MULT + picked[:, k])
    return out


def sketch(x: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """A text's buckets from its labelled shingles. Two texts that are near have both picked few minima, or both many."""
    few = [_buckets(x, SHORT_PICK)] if len(x) * least <= SHORT + 1e-9 else []
    many = [_buckets(x, PICK)] if len(x) > SHORT else []
    return np.concatenate(few + many)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two shingle sequences by banded alignment; any value below least stands for itself or less."""
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    k = min(n, m)
    if k < least * max(n, m):
        return 0.0
    differs = np.flatnonzero(a[:k] != b[:k])
    head = int(differs[0]) if len(differs) else k
    differs = np.flatnonzero(a[n - k + head :][::-1] != b[m - k + head :][::-1])
    tail = int(differs[0]) if len(differs) else k - head
    mid_a, mid_b = a[head : n - tail].tolist(), b[head : m - tail].tolist()
    matched = head + tail
    if mid_a and mid_b:
        band = int((n + m) * (1 - least) / (1 + least)) + 1
        places: dict[int, int] = {}
        for i, c in enumerate(mid_a):
            places[c] = places.get(c, 0) | (1 << i)
        full = (1 << len(mid_a)) - 1
        v, window = full, (1 << (2 * band + 1)) - 1
        for j, c in enumerate(mid_b):
            if p := places.get(c):
                p &= window << (j - band) if j > band else window >> (band - j)
                u = v & p
                v = ((v + u) | (v - u)) & full
        matched += len(mid_a) - v.bit_count()
    return matched / (n + m - matched)


def _sketches(least: float):
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "t", 1 << 20):
                h, off = shingles(*text_buffer(part.column("t")))
                x = labelled(h, off)
                keys = [sketch(x[a:b], least) if b > a else np.zeros(0, np.uint64) for a, b in zip(off[:-1], off[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)), pa.array(np.concatenate(keys).view(np.int64)))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "h": part.column("h"), "n": pa.array(np.diff(off)), "keys": lists})

    return run


def _compare(least: float):
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "ta", 1 << 19):
                (ha, oa), (hb, ob) = (shingles(*text_buffer(part.column(c))) for c in ("ta", "tb"))
                s = np.array([similarity(ha[oa[i] : oa[i + 1]], hb[ob[i] : ob[i + 1]], least) for i in range(part.num_rows)], float)
                ok = pa.array(s >= least)
                yield pa.RecordBatch.from_pydict({"a": part.column("a").filter(ok), "b": part.column("b").filter(ok)})

    return run


def _settle(least: float):
    """Links between components among the members and the rest of a block."""

    def run(rows: pa.Table) -> pa.Table:
        h, off = shingles(*text_buffer(rows.column("t")))
        _, ids = np.unique(labelled(h, off), return_inverse=True)
        cid, root, rest = (rows.column(c).to_numpy() for c in ("cid", "root", "rest"))
        parent: dict[int, int] = {}

        def find(x):
            while (p := parent.get(x, x)) != x:
                x = p
            return x

        size = np.diff(off)
        mine = np.flatnonzero(~rest & (size > 0))
        flat = np.concatenate([ids[off[i] : off[i + 1]] for i in mine]) if len(mine) else ids[:0]
        heads = np.r_[0, np.cumsum(size[mine])][:-1]
        found = []
        flags = np.zeros(len(ids) + 1, np.int32)
        for i in np.flatnonzero(rest & (size > 0)) if len(mine) else ():
            own = ids[off[i] : off[i + 1]]
            flags[own] = 1
            common = np.add.reduceat(flags[flat], heads)
            flags[own] = 0
            both = size[i] + size[mine]
            for j in mine[(common >= least / (1 + least) * both - 1e-9) & (root[mine] != root[i])]:
                a, b = find(root[i]), find(root[j])
                if a != b and similarity(h[off[i] : off[i + 1]], h[off[j] : off[j + 1]], least) >= least:
                    parent[max(a, b)] = min(a, b)
                    found.append((cid[i], cid[j]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return run


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """doc_id, text_id (smallest id with an equal text), group_id (smallest id of the near-duplicate group) of each row."""
    text = text_of(text_col)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("h"), text.alias("t"))
    rows = staged(base.mapInArrow(_sketches(least), "doc_id long, h binary, n long, keys array<long>"), "sketches")
    classes = rows.groupBy("h").agg(F.min("doc_id").alias("cid"))
    named = staged(classes.select("h", "cid"), "classes")
    # one row for each different text, by its smallest id
    nodes = rows.filter("doc_id is not null and n > 0").join(named, "h").filter("doc_id = cid").select("cid", "n", F.explode("keys").alias("key"))
    crowded = nodes.groupBy("key").agg(F.count("*").alias("m"), F.min("cid").alias("_lo"), F.max("cid").alias("_hi")).filter("_lo < _hi").select("key", "m")
    # written first, these tables meet the crowded buckets in joins whose large partitions can be split
    crowded = staged(crowded, "crowded")
    met = staged(nodes.join(crowded, "key").select("key", "cid", "n", "m"), "buckets")
    central = met.groupBy("cid").agg(F.sum("m").alias("c"))
    leaders = met.join(central, "cid").groupBy("key").agg(F.max(F.struct("c", (-F.col("cid")).alias("lead"), "n")).alias("_l")).select("key", (-F.col("_l.lead")).alias("a"), F.col("_l.n").alias("na"))
    leaders = staged(leaders, "leaders")
    pairs = met.join(leaders, "key").filter("cid <> a").filter(F.least("n", "na") >= least * F.greatest("n", "na"))
    pairs = pairs.select(F.least("a", "cid").alias("a"), F.greatest("a", "cid").alias("b")).distinct()
    texts = base.filter("doc_id is not null").select(F.col("doc_id").alias("id"), "t")
    ta, tb = texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), texts.select(F.col("id").alias("b"), F.col("t").alias("tb"))
    links = staged(pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(_compare(least), "a long, b long"), "near-links")
    roots = components(links)
    placed = met.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", F.coalesce("root", "cid").alias("root"))
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("k"))
    open_ = sizes.groupBy("key").agg(F.sum("k").alias("m"), F.count("*").alias("_r"), F.max(F.struct("k", "root")).alias("_x")).filter("_r > 1 and m > 2")
    open_ = open_.select("key", F.col("_x.root").alias("main"), F.ceil(F.col("m") / block).alias("mb"), F.ceil((F.col("m") - F.col("_x.k")) / block).alias("rb"))
    open_ = staged(open_, "open-buckets")
    left = placed.join(open_, "key")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    own = lambda n: F.pmod(F.xxhash64("cid"), n)
    members = left.select("key", "cid", "root", F.lit(False).alias("rest"), own(F.col("mb")).alias("i"), spread(F.col("rb")).alias("j"))
    others = left.filter("root <> main").select("key", "cid", "root", F.lit(True).alias("rest"), spread(F.col("mb")).alias("i"), own(F.col("rb")).alias("j"))
    blocks = members.unionByName(others).join(texts.withColumnRenamed("id", "cid"), "cid")
    more = staged(blocks.groupBy("key", "i", "j").applyInArrow(_settle(least), "a long, b long"), "near-links")
    roots = components(links.unionByName(more))
    final = named.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("h", F.col("cid").alias("text_id"), F.coalesce("root", "cid").alias("group_id"))
    return rows.select("doc_id", "h").join(staged(final, "named-classes"), "h").select("doc_id", "text_id", "group_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Of each group only the document of smallest id, with all its columns; of several rows of that id, the one whose whole content has
    the smallest digest, so that reruns agree. Rows with a null id stay, once for each text, if no row with an id has their text."""
    found = staged(groups(docs, id_col, text_col, **how), "near-groups")
    own, digest, known_id = fresh(docs.columns, "__row", "__digest", "__kept")
    kept = found.filter("doc_id = group_id").groupBy(F.col("doc_id").alias(known_id)).agg(F.count("*").alias(digest))
    out = docs.join(kept.select(known_id), F.col(f"`{id_col}`") == F.col(known_id), "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])

    def one_of(rows: DataFrame, key: str) -> DataFrame:
        picked = rows.select(key, row.alias(own)).withColumn(digest, F.md5(F.to_json(own).cast("binary")))
        return picked.groupBy(key).agg(F.min_by(own, digest).alias(own)).select(f"`{own}`.*")

    if not kept.filter(F.col(digest) > 1).isEmpty():
        out = one_of(out.withColumn(known_id, F.col(f"`{id_col}`")), known_id)
    if found.filter("group_id is null").isEmpty():
        return out
    text = F.md5(text_of(f"`{text_col}`").cast("binary"))
    known = docs.filter(F.col(f"`{id_col}`").isNotNull()).select(text.alias(digest)).distinct()
    loose = docs.filter(F.col(f"`{id_col}`").isNull()).withColumn(known_id, text)
    return out.unionByName(one_of(loose.join(known, F.col(known_id) == F.col(digest), "left_anti"), known_id))
