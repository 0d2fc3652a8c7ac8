import numpy as np
import pytest

from wagetide.llm import ann

KIND = "vec_id long, embedding array<float>"


def test_one_longer_vector_does_not_empty_the_result(spark):
    v = np.random.default_rng(3).normal(size=(200, 8)).round(3)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rank = lambda r: sorted(map(tuple, ann.nearest(spark.createDataFrame(r, KIND)).collect()))
    want = rank(rows)
    assert len(want) == 4 * 5 and rank(rows + [(1000, [1.0] * 9)]) == want


def test_recall_on_a_full_block():
    r = np.random.default_rng(5)
    centres = r.normal(size=(2000, 64))
    v = (centres[r.integers(0, 2000, ann.BLOCK)] + 0.3 * r.normal(size=(ann.BLOCK, 64))).astype(np.float32)
    v /= np.sqrt((v * v).sum(1))[:, None]
    q = v[:: ann.BLOCK // 64]
    best = np.argsort(-(q @ v.T), axis=1)[:, :6]
    found = ann.search(v, q, 12)
    recall = np.mean([len({*b} & {*f}) / 6 for b, f in zip(best.tolist(), found.tolist(), strict=True)])
    assert recall > 0.9


def test_regions(spark):
    """Many regions: recall against brute force, the same answers however tasks are cut, and queries that skip regions."""
    r = np.random.default_rng(9)
    centres = r.normal(size=(60, 32))
    v = (centres[r.integers(0, 60, 6000)] + 0.15 * r.normal(size=(6000, 32))).astype(np.float32)
    v[100:2100] = v[7]  # a third are copies of one vector
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], KIND)
    got = sorted(map(tuple, ann.nearest(df, block=256).collect()))
    assert got == sorted(map(tuple, ann.nearest(df.repartition(3), block=256).collect()))
    w = v.astype(float)
    n, hit = np.sqrt((w * w).sum(1)), 0
    by = {}
    for q, k, i, s in got:
        by.setdefault(q, []).append(i)
        assert s == pytest.approx((w[q] * w[i]).sum() / (n[q] * n[i]), abs=1e-12) and k == len(by[q])
    assert sorted(by) == list(range(0, 6000, 50)) and all(len(x) == 5 for x in by.values())
    for q, found in by.items():
        c = (w * w[q]).sum(-1) / (n * n[q])
        c[q] = -9
        hit += len(set(found) & set(np.lexsort((np.arange(6000), -c.round(12)))[:5].tolist()))
    assert hit >= 0.9 * 5 * len(by)


def test_top_tree_skips_regions():
    r = np.random.default_rng(2)
    p = (r.normal(size=(40, ann.DIMS)) * 10)[r.integers(0, 40, 4000)] + r.normal(size=(4000, ann.DIMS))
    p = p.astype(np.float32)
    top = ann.Top(p[::10], 16)
    at = top.region(p)
    assert at.min() >= 0 and at.max() < 16 and np.bincount(at, minlength=16).max() < 1200
    low, high = (np.array([f(p[at == i], axis=0) if (at == i).any() else np.full(ann.DIMS, 1e9) for i in range(16)]) for f in (np.min, np.max))
    far = ann.distances(low, high, p[:200])
    assert (far[np.arange(200), at[:200]] == 0).all() and (ann.chi_square(far / 1.0) > ann.CONFIDENCE).mean() > 0.5
