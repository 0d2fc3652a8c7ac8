import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from wagetide.llm import suffix


def brute(rows, length=50):
    first = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            key = suffix.LAST if d is None else d
            first[w] = min(first.get(w, key), key)
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (suffix.LAST if d is None else d):
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "on", "é", "ß", "an"]) for _ in range(r.randint(1, 4)))
    passage = [" ".join(word() for _ in range(r.randint(8, 60))) for _ in range(8)]
    rows = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(r.randint(0, 40)))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(passage), " ".join(word() for _ in range(r.randint(0, 9)))]
        rows.append((i if r.random() < 0.97 else None, r.choice(["", " "]).join(parts)))
    rows += [(500 + i, rows[i % 7][1]) for i in range(40)] + [(600, None), (601, ""), (3, rows[9][1]), (3, rows[9][1])]
    rows += [(700 + i, "ab " * (20 + i)) for i in range(5)] + [(710, "\0" * 120), (711, "x" + "\0" * 70)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    rows = made(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # smaller bounds send the same rows over the hot and the merging paths
    for hot, block in ((2000, 2 << 20), (3, 1500)):
        got = suffix.remove_repeats(docs, hot=hot, block=block).select("__id", "__bytes", "__removed", "__spans", "__sha").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)


def test_pure_steps():
    r = np.random.default_rng(3)
    for n, k in ((1, 2), (40, 2), (300, 3), (500, 1)):
        t = r.integers(0, k, n).astype(np.uint8)
        sa, key8 = suffix.suffix_array(t)
        b = t.tobytes()
        assert sa.tolist() == sorted(range(n), key=lambda i: b[i:])
        lcp = suffix.common_prefixes(t, sa, key8)
        for i in range(1, n):
            x, y = b[sa[i - 1] :], b[sa[i] :]
            assert lcp[i] == next((j for j in range(min(len(x), len(y))) if x[j] != y[j]), min(len(x), len(y)))


def test_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, __x string")
    assert suffix.remove_repeats(docs).count() == 0
    docs = spark.createDataFrame([(1, "a" * 80, "p", 5), (2, "a" * 80, None, None)], "doc_id long, text string, bucket string, chunk int")
    odd = suffix.remove_repeats(docs.withColumnsRenamed({"bucket": "__t", "chunk": "__id"}), carry=("__t", "__id")).orderBy("__id").collect()
    assert [tuple(r["__carry"]) for r in odd] == [("p", 5), (None, None)]
    got = suffix.remove_repeats(docs, with_text=True, carry=("bucket", "chunk")).orderBy("__id").collect()
    assert [(r["__carry"]["bucket"], r["__carry"]["chunk"], r["__removed"], r["__kept"]) for r in got] == [("p", 5, 0, "a" * 80), (None, None, 80, "")]


def test_hot_hashes_do_not_multiply_the_text():
    """Windows around a phrase that most texts have go on as runs; one by one they would be sent with 50 bytes each."""
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9)))
    texts = [" ".join([*(word() for _ in range(9)), "as a matter of course", *(word() for _ in range(9))]) for _ in range(400)]
    ids = pa.array(range(len(texts)))
    chunk = pa.table({"__id": ids, "__d": ids, "__k": ids, "__t": pa.array(texts), "__c": pa.array([0] * len(texts))})
    sent = {}
    for hot in (2000, 50):
        masks = suffix._shared(hot)(suffix._index(1, 50)(chunk))
        cut = suffix._cut(1, 1, 50)(chunk, masks)
        windows = sum(int(np.frombuffer(x, np.uint8).sum()) for x in cut.column("windows").to_pylist())
        sent[hot] = windows, sum(map(len, cut.column("raw").to_pylist()))
    assert sent[50][0] >= 0.9 * sent[2000][0] > 0 and sent[50][1] < 25 * sent[50][0]


def test_every_tier_is_like_brute_force(spark):
    rows = made(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (0, 1):
        got = suffix.remove_repeats(docs, hot=hot, block=1500).select("__id", "__bytes", "__removed", "__spans", "__sha").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)
