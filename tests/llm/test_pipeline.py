"""Each stage of the corpus pipeline against brute force, over rows with odd ids, texts and column names."""

import random

import pytest

import corpus_pipeline
from wagetide.llm import quality

from .test_near import brute

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long, __id string, __t long, _id long, __row int"


def odd(seed=4):
    r = random.Random(seed)
    text = lambda n: " ".join("w%d" % r.randint(0, 400) for _ in range(n))
    passage, texts = text(30), [text(r.randint(5, 60)) for _ in range(40)]
    texts += [f"{text(20)} {passage} {text(10)}" for _ in range(6)] + texts[:5] + ["", None, " ", text(8000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "another text of id three " * 3), (None, "no id here"), (None, "no id here"), (None, texts[1])]
    return [(i, t, "en", r.choice(["a", "a", "b", None]), len(t or ""), "k", 1, 2, None) for i, t in rows]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_near_stage(spark):
    data = odd()
    docs = spark.createDataFrame(data, KIND)
    got = corpus_pipeline.near_stage(spark, docs, SF)
    assert got.columns == docs.columns
    kept = got.collect()
    want = {d for d, _, g in brute([x[:2] for x in data]) if d is not None and d == g}
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(want)
    assert [r["text"] for r in kept if r["doc_id"] is None] == ["no id here"] and all(tuple(r) in data for r in kept)
    assert rows_of(got) == rows_of(corpus_pipeline.near_stage(spark, docs.repartition(5), SF))


def test_repeats_stage(spark):
    data = odd()
    docs = spark.createDataFrame(data, KIND)
    got = corpus_pipeline.repeats_stage(spark, docs, SF)
    first = {}
    order = lambda d: (d is None, d or 0)
    for d, t, *_ in sorted(data, key=lambda x: order(x[0])):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], order(d))
    want = []
    for d, t, *rest in data:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < order(d):
                gone[i : i + 50] = [True] * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        want.append((d, kept, rest[0], rest[1], len(kept), *rest[3:]))
    assert got.columns == docs.columns and rows_of(got) == sorted(want, key=repr)


def test_mixing_stage(spark):
    docs = spark.createDataFrame(odd(), KIND)
    got = corpus_pipeline.mixing_stage(spark, docs, SF)
    kept, every = rows_of(got), rows_of(docs)
    assert got.columns == docs.columns and set(kept) <= set(every) and all(kept.count(x) <= 3 * every.count(x) for x in kept)
    assert rows_of(corpus_pipeline.mixing_stage(spark, docs.repartition(4), SF)) == kept


def test_quality_and_tokens(spark):
    docs = spark.createDataFrame(odd(), KIND)
    got = corpus_pipeline.quality_stage(spark, docs, SF)
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = [x for x in rows_of(docs) if model.score(quality.np.array([quality.features(x[1] or "")]))[0] >= quality.THRESHOLD]
    assert got.columns == docs.columns and rows_of(got) == want
    tokens = corpus_pipeline.bpe_stage(spark, docs, SF)
    assert tokens.columns[:3] == ["doc_id", "n_tokens", "token_ids"] and tokens.count() == docs.count()


@pytest.mark.parametrize("k", range(5))
def test_empty(spark, k):
    docs = spark.createDataFrame([], KIND)
    out = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    assert out.count() == 0 and (k == 4 or out.columns == docs.columns)
