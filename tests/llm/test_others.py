import hashlib
import random

import duckdb
import numpy as np
import pytest

from wagetide.llm import ann, chat, lm, quality, sketches
from wagetide.llm.queries import ORACLES

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(got) > 40 and (got.predicted == got.quality).mean() > 0.9 and got.score.between(0, 1).all()
    empty = spark.createDataFrame([(1, None, 5.0), (1, "", 1.0), (None, "x " * 50_000, None)], "doc_id long, text string, score double")
    assert quality.classify(empty, labels).count() == 3 and quality.classify(empty.limit(0), labels.limit(0)).count() == 0


def test_quality_tables_by_hand():
    """A score is the logistic of the intercept and one entry of each table."""
    r = np.random.default_rng(4)
    x = r.normal(size=(500, 4))
    m = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float))
    for row, s in zip(x[:40], m.score(x[:40]), strict=True):
        total = m.base + sum(t[sum(c <= v for c in cut)] for cut, t, v in zip(m.cuts, m.tables, row, strict=True))
        total += sum(t[sum(c <= row[a] for c in m.coarse[a]), sum(c <= row[b] for c in m.coarse[b])] for (a, b), t in m.pairs.items())
        assert s == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_driver_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i % 7, f"words {i % 3} and more") for i in range(700)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)] * 3, "doc_id long, quality int")
    seen = []
    own, quality.fit = quality.fit, lambda x, y: seen.append(len(y)) or own(x, y)
    try:
        quality.train(docs, labels, sample=4)
    finally:
        quality.fit = own
    assert seen == [4]


def test_quality_fit_finds_interactions():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality.fit(x, y)
    assert ((m.score(x) > 0.5) == (y > 0)).mean() > 0.9 and (0, 1) in {tuple(sorted(p)) for p in m.pairs}


def test_language_model(spark):
    rows = [(i, t) for i, (t,) in enumerate(documents(spark).select("text").collect())] + [(None, None), (7, "ABC abc"), (7, "ABC abc"), (9001, "é" * 3000)]
    docs = spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id long, text string, score double")
    got = lm.score(docs).toPandas()
    assert len(got) == len(rows) and (got.score < 0).all()
    # the yardstick by brute force
    words = {}
    split = lambda t: ["".join(c.lower() if c.isascii() else c for c in w) for w in (t or "").split()] + [None]
    import zlib

    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 5 == 1
    for d, t in rows:
        if not held(d):
            for w in split(t):
                words[w] = words.get(w, 0) + 1
    n, v = sum(words.values()), len(words)
    want = sorted((len(split(t)), sum(w in words for w in split(t)), round(sum(np.log10((words.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in split(t)), 6)) for d, t in rows)
    assert sorted(zip(got.n_tokens, got.n_known, got.base_score.round(6), strict=True)) == want and (got.train_tokens == n).all()
    assert lm.score(docs.limit(0)).count() == 0


def test_language_model_is_a_distribution(spark):
    """The probabilities of all next bytes after a context add up to one, in both models."""
    model = lm.train(documents(spark).limit(60))
    g = lm.grams(np.frombuffer(b"the quick", np.uint8), np.array([0, 9]))[0]
    for x in g[[0, 3, 8]]:
        every = (x & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
        assert np.exp(model.logs(every)).sum(1) == pytest.approx([1, 1], abs=1e-6)


def test_neighbours(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(700, 16)).round(3)
    v[50:60] = v[3]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [None] + [1.0] * 15), (None, v[5].tolist()), (704, [1.0])]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, rank int")
    for block in (65_536, 100):
        got = {}
        for q in ann.nearest(df, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(q["query_id"], []).append((q["vec_id"], q["score"]))
        w = v.astype(np.float32).astype(float)
        n = np.sqrt((w * w).sum(1))
        hit = 0
        assert sorted(got) == list(range(0, 700, 50))
        for q, found in got.items():
            c = (w * w[q]).sum(-1) / (n * n[q])
            c[q] = -9
            best = np.lexsort((np.arange(700), -c))[:5]
            hit += len({x for x, _ in found} & set(best.tolist()))
            assert all(s == pytest.approx(c[x], abs=1e-12) for x, s in found)
        assert hit >= 0.9 * 5 * len(got)
        assert [x for x, _ in got[50]] == [3, 51, 52, 53, 54]
    assert ann.nearest(df.limit(0)).count() == 0 and ann.nearest(df.filter("vec_id = 0")).count() == 0


def test_sketches(spark):
    r = random.Random(3)
    rows = [(i * 3, " ".join(r.choice(["alpha", "beta", "gamma", "é", "x."]) for _ in range(r.randint(0, 200)))) for i in range(150)]
    rows += [(7, None), (7, "two rows of one id"), (None, "no id"), (900, rows[4][1]), (901, "a\nb\nc " * 40)]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, b int")
    got = sketches.fingerprints(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] not in (7, None)}
    ids = sorted(by, reverse=True)
    text = dict(rows)
    for a, b in zip(ids, ids[1:]):
        if {a, b} & {6, 9}:  # next to the id that comes twice
            continue
        n = len(text[a]) // 2
        e = text[a][: len(text[a]) - n] + text[b][:n]
        assert by[a]["n_chars"] == len(text[a]) and by[a]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        p = [sketches.paragraphs(*sketches.csr([x.encode()]))[0].tolist() for x in (text[a], e, text[b])]
        alike = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 1.0
        assert by[a]["near_edited"] == pytest.approx(alike(p[0], p[1])) and by[a]["near_next"] == pytest.approx(alike(p[0], p[2]))
        # what is returned follows from the fingerprints alone
        assert sketches.compared(by[a]["fingerprint"], by[a]["edited_fingerprint"]) == pytest.approx(by[a]["near_edited"])
        assert sketches.compared(by[a]["fingerprint"], by[b]["fingerprint"]) == pytest.approx(by[a]["near_next"])
    assert by[12]["fingerprint"] == by[900]["fingerprint"]
    # ranges of a few hundred bytes, among them many rows of one id
    same = spark.createDataFrame([(5, f"text {i} " * 9) for i in range(60)] + [(i, "x y z " * i) for i in range(6, 30)], "doc_id long, text string")
    narrow, wide = (sorted(map(tuple, sketches.fingerprints(same, most=m).collect())) for m in (500, 1 << 30))
    assert narrow == wide and len(narrow) == 84
    one = sketches.fingerprints(docs.filter("doc_id = 901")).first()
    assert one["near_next"] == 1.0 and sketches.fingerprints(docs.limit(0)).count() == 0


def test_snapshots(spark):
    t = [("user", "hi"), ("bot", "hello"), ("user", "bye"), ("bot", None)]
    rows = [(c, i, *t[i]) for c, n in ((1, 2), (2, 4), (3, 4), (4, 1), (None, 3)) for i in range(n)]
    rows += [(2, 0, "user", "hi"), (5, 0, "user", "other"), (6, None, None, None)]
    df = spark.createDataFrame([(*x, "p") for x in rows], "conv_id long, turn long, role string, text string, pos string")
    got = {r["conv_id"]: (r["n_turns"], r["copies"], r["text"]) for r in chat.render(df).collect()}
    whole = "".join(f"<|{a}|>\n{b or ''}<|end|>\n" for a, b in t)
    assert got == {2: (4, 2, whole), 5: (1, 1, "<|user|>\nother<|end|>\n"), 6: (1, 1, "<||>\n<|end|>\n")}
    parts = [r["text"] for r in chat.render(df, part=3).filter("conv_id = 2").orderBy("part").collect()]
    assert len(parts) == 2 and "".join(parts) == whole and chat.render(df.limit(0)).count() == 0
    c = spark.read.parquet(f"{SF}/conversations.parquet")
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = db.sql(ORACLES["op3_snapshot_collapse"]).fetchall()
    assert sorted(map(tuple, chat.render(c).collect())) == sorted(want)
