"""Approximate nearest neighbours: low-dimensional stable projections in a kd-tree, with a chi-square stopping test.

Unit vectors are projected by DIMS Gaussian (2-stable) directions. The square of a projected distance is the square of the true one
times a chi-square variable of DIMS degrees; a part of the tree is left out when a vector nearer than the last one kept would lie in it
with a probability below 1 - CONFIDENCE. The tree has two levels:

1. top     kd splits of a sample of the projections, SAMPLE a region and MOST in all, cut space into regions of about BLOCK vectors.
           Every vector is in one region; the regions' boxes and splits are all that the driver holds and sends, 100 bytes each.
2. home    A region builds a kd-tree of its own. Each query searches the region that it is in, leaf by leaf in the order of their
           projected distance, verifies the leaves' vectors in full, and stops by the test.
3. others  A query goes on only to those regions whose boxes pass the test for the distance that it has reached; regions that many
           queries visit are searched in parts of at most PART queries. The best of all are merged.

So a query meets the regions that may hold its neighbours, and no others. Equal vectors are one, with their k + 1 smallest ids, from
the start: copies cost nothing. Which rows are sampled depends on the vectors alone, so results do not depend on the cluster.

Rows with a null id, and vectors that are null, zero, of another length than the most frequent (of two, the longer), or hold null or
non-finite components, take no part. Rows of one id are one query and one candidate, by whichever is nearest. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

DIMS, LEAF, CONFIDENCE = 8, 32, 0.97
BLOCK, PART = 65_536, 16_384
#: Sampled vectors for each region, and at most.
SAMPLE, MOST = 64, 1 << 20
#: Small tables are cut into so many regions at most, of SMALL vectors at least, whatever the cluster.
SPREAD, SMALL = 8, 2048
SEED = 7
_FOUND = "h string, reach double, score double, vec_id long"


def chi_square(x: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Distribution function for an even number of degrees."""
    h = np.minimum(x, 1e4) / 2
    return 1 - np.exp(-h) * sum(h**i / math.factorial(i) for i in range(dims // 2))


def directions(n: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((n, DIMS)).astype(np.float32)


def units(v: np.ndarray) -> np.ndarray:
    wide = v.astype(np.float64)
    return (wide / np.sqrt((wide * wide).sum(-1))[:, None]).astype(np.float32)


class Tree:
    """A kd-tree over p in arrays: the points in leaf order, leaves' bounds in it, and leaves' boxes."""

    def __init__(self, p: np.ndarray, leaf: int = LEAF):
        n = len(p)
        self.order, bounds = np.arange(n), np.array([0, n])
        while (np.diff(bounds) > leaf).any():
            at = p[self.order]
            spread = np.maximum.reduceat(at, bounds[:-1]) - np.minimum.reduceat(at, bounds[:-1])
            node = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            value = at[np.arange(n), spread.argmax(1)[node]]
            self.order = self.order[np.lexsort((value, node))]
            wide = np.diff(bounds) > leaf
            bounds = np.sort(np.r_[bounds, (bounds[:-1] + np.diff(bounds) // 2)[wide]])
        self.bounds = bounds
        self.low, self.high = np.minimum.reduceat(p[self.order], bounds[:-1]), np.maximum.reduceat(p[self.order], bounds[:-1])


class Top:
    """Splits of space into regions, from a sample: node i has children 2i + 1 and 2i + 2, a dimension and a value."""

    def __init__(self, p: np.ndarray, regions: int):
        self.depth = max(0, math.ceil(math.log2(max(1, regions))))
        self.dim, self.value = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, np.inf, np.float32)
        held = {0: p}
        for i in range(len(self.dim)):
            own = held.pop(i)
            if len(own):
                self.dim[i] = d = int((own.max(0) - own.min(0)).argmax())
                self.value[i] = np.partition(own[:, d], len(own) // 2)[len(own) // 2]
            left = own[:, self.dim[i]] < self.value[i]
            held[2 * i + 1], held[2 * i + 2] = own[left], own[~left]

    def region(self, p: np.ndarray) -> np.ndarray:
        at = np.zeros(len(p), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (p[np.arange(len(p)), self.dim[at]] >= self.value[at])
        return at - len(self.dim)


def distances(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distance of each query from each box."""
    out = np.zeros((len(q), len(low)), np.float32)
    for d in range(q.shape[1]):
        x = q[:, d, None]
        out += np.maximum(np.maximum(low[None, :, d] - x, x - high[None, :, d]), 0) ** 2
    return out


def search(unit: np.ndarray, queries: np.ndarray, keep: int, confidence: float = CONFIDENCE, reach: np.ndarray | None = None) -> np.ndarray:
    """Numbers of the keep nearest rows of unit for each query (-1: none), both of unit length. reach: squared distances that the queries
    have reached elsewhere; what is not nearer need not be found."""
    a = directions(unit.shape[1])
    tree = Tree(unit @ a)
    leaves = np.full((len(tree.bounds) - 1, int(np.diff(tree.bounds).max())), -1, np.int64)
    size = np.diff(tree.bounds)
    leaves[np.arange(leaves.shape[1]) < size[:, None]] = tree.order
    found = np.full((len(queries), keep), -1, np.int64)
    limit = np.full(len(queries), np.inf) if reach is None else np.maximum(reach, 1e-9)
    for s in range(0, len(queries), 256):
        q = queries[s : s + 256]
        far = distances(tree.low, tree.high, q @ a)
        visit = np.argsort(far, axis=1)
        far = np.take_along_axis(far, visit, 1)
        best, near = np.full((len(q), keep), -1, np.int64), np.full((len(q), keep), -2.0, np.float32)
        active = np.flatnonzero(chi_square(far[:, 0] / limit[s : s + 256]) <= confidence)
        for t in range(visit.shape[1]):
            if not len(active):
                break
            rows = leaves[visit[active, t]]
            cos = np.einsum("alv,av->al", unit[rows], q[active])
            cos[rows < 0] = -3
            cos, rows = np.concatenate([near[active], cos], 1), np.concatenate([best[active], rows], 1)
            top = np.argpartition(-cos, keep - 1, axis=1)[:, :keep]
            near[active], best[active] = np.take_along_axis(cos, top, 1), np.take_along_axis(rows, top, 1)
            if t + 1 == visit.shape[1]:
                break
            worst = near[active].min(1)
            bound = np.minimum(np.where(worst < -1.5, np.inf, np.maximum(2 - 2 * worst, 1e-9)), limit[s : s + 256][active])
            active = active[chi_square(far[active, t + 1] / bound) <= confidence]
        found[s : s + 256] = best
    return found


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _project(batches):
    """Projections of a sample."""
    for batch in batches:
        if batch.num_rows:
            v = _matrix(batch.column("v"))
            p = units(v) @ directions(v.shape[1])
            yield pa.RecordBatch.from_pydict({"p": pa.array(p.tolist(), pa.list_(pa.float32()))})


def _place(top: Top):
    """The region of each vector, and its projection."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"))
                p = units(v) @ directions(v.shape[1])
                made = {c: batch.column(c) for c in batch.schema.names}
                yield pa.RecordBatch.from_pydict(made | {"region": pa.array(top.region(p)), "p": pa.array(p.tolist(), pa.list_(pa.float32()))})

    return run


def _answer(members: pa.Table, queries: pa.Table, k: int, confidence: float, reach: np.ndarray | None) -> pa.Table:
    """For each query the k + 1 best (score, id) among the members, by the exact measure; reach is the last one's distance, and
    infinite where there are fewer."""
    out: dict[str, list] = {"h": [], "reach": [], "score": [], "vec_id": []}
    if members.num_rows and queries.num_rows:
        v, w, ids = _matrix(members.column("v")), _matrix(queries.column("v")).astype(np.float64), members.column("ids").to_pylist()
        wide = v.astype(np.float64)
        norm, own_norm = np.sqrt((wide * wide).sum(-1)), np.sqrt((w * w).sum(-1))
        found = search(units(v), (w / own_norm[:, None]).astype(np.float32), min(2 * k + 2, len(v)), confidence, reach)
        for i, (h, near) in enumerate(zip(queries.column("h").to_pylist(), found, strict=True)):
            near = near[near >= 0]
            score = (wide[near] * w[i]).sum(-1) / (norm[near] * own_norm[i])
            best = sorted((-s, c) for s, u in zip(score.tolist(), near.tolist(), strict=True) for c in ids[u])[: k + 1]
            out["h"] += [h] * len(best)
            out["reach"] += [max(0.0, 2 + 2 * best[k][0]) if len(best) > k else np.inf] * len(best)
            out["score"] += [-s for s, _ in best]
            out["vec_id"] += [c for _, c in best]
    return pa.table(out, schema=pa.schema([("h", pa.string()), ("reach", pa.float64()), ("score", pa.float64()), ("vec_id", pa.int64())]))


def _home(k: int, confidence: float):
    def run(rows: pa.Table) -> pa.Table:
        return _answer(rows, rows.filter(rows.column("q")), k, confidence, None)

    return run


def _visit(k: int, confidence: float):
    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        return _answer(members, queries, k, confidence, queries.column("reach").to_numpy() if queries.num_rows else None)

    return run


def _visits(low: np.ndarray, high: np.ndarray, regions: np.ndarray, confidence: float):
    """Other regions that may hold something nearer than a query has found at home."""

    def run(batches):
        for batch in batches:
            p, reach, home = _matrix(batch.column("p")) if batch.num_rows else np.zeros((0, DIMS)), batch.column("reach").to_numpy(), batch.column("region").to_numpy()
            for s in range(0, len(p), 1024):
                far = distances(low, high, p[s : s + 1024])
                go = (chi_square(far / np.maximum(reach[s : s + 1024], 1e-9)[:, None]) <= confidence) & (regions != home[s : s + 1024, None])
                at, which = np.nonzero(go)
                part = batch.slice(s, 1024).take(pa.array(at))
                yield pa.RecordBatch.from_pydict({"h": part.column("h"), "v": part.column("v"), "reach": part.column("reach"), "region": pa.array(regions[which])})

    return run


def _classes(rows: DataFrame, k: int, every: int) -> DataFrame:
    """h, v, ids (the k + 1 smallest), q (whether some id is a query) of each different vector. Only the smallest ids of a task go on to
    the shuffle, however many copies there are."""
    nth = F.row_number().over(Window.partitionBy("h").orderBy("id"))
    few = rows.select("h", "id").distinct().withColumn("nth", nth).filter(F.col("nth") <= k + 1).groupBy("h").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    few = rows.groupBy("h").agg(F.first("v").alias("v")).join(few, "h")
    asked = rows.filter(F.col("id") % every == 0).select(F.col("h").alias("_h")).distinct()
    return few.join(asked, F.col("h") == F.col("_h"), "left").select("h", "v", "ids", F.col("_h").isNotNull().alias("q"))


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", confidence: float = CONFIDENCE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine of each row whose id is divisible by every."""
    x = F.col(f"`{vector_col}`")
    sound = F.expr(f"not exists(`{vector_col}`, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(`{vector_col}`, x -> x <> 0)")
    rows = vectors.filter(F.col(f"`{id_col}`").isNotNull() & x.isNotNull() & sound).select(F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("v"), F.size(x).alias("n"))
    # one row, of the most frequent length
    most = rows.groupBy("n").agg(F.count("*").alias("rows")).agg(F.max(F.struct("rows", "n"))).first()[0]
    dims = most[1] if most else 0
    rows = rows.filter(F.col("n") == dims).select("id", "v", F.concat(F.hex(F.xxhash64("v")), F.hex(F.xxhash64(F.lit(1), "v"))).alias("h"))
    each = staged(_classes(rows, k, every), "vectors")
    count = each.count()
    regions = max(1, -(-count // block), min(SPREAD, -(-count // SMALL)))
    kind = each.schema["v"].dataType.simpleString()
    share = min(1.0, min(MOST, SAMPLE * regions) / max(1, count))
    some = each.filter(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v") if regions > 1 else each.limit(0).select("v")
    sample = np.array([r["p"] for r in some.mapInArrow(_project, "p array<float>").collect()], np.float32).reshape(-1, DIMS)
    top = Top(sample, regions if len(sample) else 1)
    placed = each.mapInArrow(_place(top), f"h string, v {kind}, ids array<long>, q boolean, region long, p array<float>")
    if top.depth:
        placed = staged(placed, "regions")
    found = staged(placed.groupBy("region").applyInArrow(_home(k, confidence), _FOUND), "found")
    if top.depth:
        corner = lambda f: [f(F.get("p", F.lit(i))) for i in range(DIMS)]
        boxes = placed.groupBy("region").agg(F.array(*corner(F.min)).alias("a"), F.array(*corner(F.max)).alias("z")).orderBy("region").collect()
        bound = found.groupBy("h").agg(F.min("reach").alias("reach"))
        asked = placed.filter("q").join(bound, "h", "left").select("h", "v", "p", "region", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
        visits = asked.mapInArrow(_visits(np.array([r["a"] for r in boxes], np.float32), np.array([r["z"] for r in boxes], np.float32), np.array([r["region"] for r in boxes], np.int64), confidence), f"h string, v {kind}, reach double, region long")
        visits = staged(visits, "visits")
        # as many parts of a region as its visits need; one row a region
        parts = visits.groupBy("region").agg(F.ceil(F.count("*") / PART).alias("parts"))
        parts = staged(parts, "parts")
        members = placed.select("v", "ids", "region").join(parts, "region").select("v", "ids", "region", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        queries = visits.join(parts, "region").select("h", "v", "reach", F.col("region").alias("r"), F.pmod(F.xxhash64("h"), F.col("parts")).alias("t"))
        found = found.unionByName(members.groupBy("region", "part").cogroup(queries.groupBy("r", "t")).applyInArrow(_visit(k, confidence), _FOUND))
    # of a vector's answers the k + 1 best stand for all its queries, of which each leaves itself out
    order = Window.partitionBy("h").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("h", "vec_id").agg(F.max("score").alias("score")).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1)
    asked = rows.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("h").alias("_h")).distinct()
    pairs = asked.join(best, F.col("h") == F.col("_h")).filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
