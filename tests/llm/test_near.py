import random

import numpy as np

from wagetide.llm import near


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            cur = row[j + 1]
            row[j + 1] = prev + 1 if x == y else max(row[j + 1], row[j])
            prev = cur
    return row[-1]


def shingles(t):
    w = (t or "").split()
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def alike(a, b):
    if not a or not b:
        return 0
    if min(len(a), len(b)) < 0.8 * max(len(a), len(b)) or len(set(a) & set(b)) < 0.3 * min(len(set(a)), len(set(b))):
        return 0
    m = lcs(a, b)
    return m / (len(a) + len(b) - m)


def brute(rows):
    """Group of each id by comparing all pairs."""
    by_text = {}
    for d, t in rows:
        if d is not None:
            by_text[t or ""] = min(d, by_text.get(t or "", d))
    names = sorted(by_text.items(), key=lambda x: x[1])
    parent = {d: d for _, d in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    s = {d: shingles(t) for t, d in names}
    for i, (_, a) in enumerate(names):
        for _, b in names[:i]:
            if alike(s[a], s[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {(d, (c := by_text.get(t or "")), c if c is None else find(c)) for d, t in rows}


def made(seed):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)] + ["à", "ß"]
    rows, n = [], 0
    for _ in range(12):
        base = [r.choice(vocab) for _ in range(r.choice([3, 6, 40, 120, 300]))]
        for _ in range(r.randint(1, 12)):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 60))):
                i = r.randrange(len(t) + 1)
                r.choice([lambda i=i: t.insert(i, r.choice(vocab)), lambda i=i: t.__delitem__(slice(i, i + 1))])()
            rows.append((n, " ".join(t)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "  "), (None, rows[3][1]), (None, "alone here"), (5, rows[5][1]), (n + 3, "a b c d"), (n + 4, "a  b\nc d"), (n + 5, "u " * 400), (n + 6, "u " * 380)]
    return rows


def test_like_brute_force(spark):
    rows = made(5)
    docs = spark.createDataFrame([(*x, "k", 1) for x in rows], "doc_id long, text string, key string, h int")
    for block in (near.BLOCK, 2):
        assert set(map(tuple, near.groups(docs, block=block).collect())) == brute(rows)
    kept = near.keep_one(docs).collect()
    want = brute(rows)
    assert sorted(str(r["doc_id"]) for r in kept) == sorted([str(d) for d, _, g in want if d is not None and d == g] + ["None"])
    assert near.groups(docs.limit(0)).count() == 0 and near.keep_one(docs.limit(0)).columns == docs.columns


def test_alignment_is_exact_above_threshold():
    r = np.random.default_rng(1)
    for _ in range(300):
        a = r.integers(0, 40, r.integers(0, 60)).astype(np.uint64)
        b = a.copy()
        for _ in range(r.integers(0, 8)):
            i = r.integers(0, len(b) + 1)
            b = np.insert(b, i, r.integers(0, 40)) if r.random() < 0.5 else np.delete(b, i) if i < len(b) else b
        m = lcs(a.tolist(), b.tolist())
        true = m / (len(a) + len(b) - m) if len(a) and len(b) else float(len(a) == len(b))
        got = near.similarity(a, b)
        assert (got >= 0.8) == (true >= 0.8) and (true < 0.8 or abs(got - true) < 1e-12)


def test_short_texts_share_a_bucket():
    r = np.random.default_rng(2)
    missed = {}
    for n in (5, 8, 10, 15, 16, 20, 25):
        for _ in range(400):
            a = r.integers(0, 1 << 63, n).astype(np.uint64)
            gone = r.choice(n, n // 5, replace=False)
            cut = np.delete(a, gone)
            assert near.similarity(a, cut) >= 0.8
            missed[n] = missed.get(n, 0) + (not set(near.sketch(a)) & set(near.sketch(cut)))
    assert sum(missed.values()) <= 3 and not any(missed[n] for n in (5, 8, 10, 15)), missed
