import random
import tracemalloc

import numpy as np
import pyarrow as pa

from wagetide.llm import lm


def test_no_context_is_thrown_away(spark):
    """Random texts that occur twice have several times as many decisions as a table of 4M slots; what followed each of them is known."""
    r = random.Random(4)
    texts = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=8000)) for _ in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts)], "doc_id long, text string")
    got = lm.score(docs).toPandas()
    held = set(got.doc_id[got.held_out])
    both = got[~got.doc_id.isin(held) & ~((got.doc_id + 150) % 300).isin(held)]
    assert len(both) > 100 and both.bits_per_byte.max() < 0.5


def test_scores_from_the_table_are_those_of_brute_force(spark):
    texts = ["The cat sat on the mat.", "the dog sat on the log", "", "a cat and a dog", "é" * 40] * 4
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = lm.score(docs).toPandas()
    held = dict(zip(got.doc_id, got.held_out, strict=True))
    model = lm.train(docs.filter(docs.doc_id.isin([i for i, h in held.items() if not h])))
    want = {}
    for i, t in enumerate(texts):
        buf = np.frombuffer(t.encode(), np.uint8)
        logs = model.logs(lm.grams(lm.LOWER[buf], np.array([0, len(buf)]))[0]).sum(1)
        want[i] = (np.logaddexp(*logs) - np.log(2)) / np.log(10)
    assert np.allclose(got.score, [want[i] for i in got.doc_id], atol=1e-4)


def test_refinement_follows_the_final_mixer(spark):
    """Contexts of 0 to 5 bytes; and the second table has what followed the averaged mixer's own probabilities."""
    assert lm.LENGTHS == (0, 1, 2, 3, 4, 5)
    model = lm.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60))
    want, total = np.zeros_like(model.mixer.seen), 0
    for r in model.counted.collect():
        g, c = lm.unpacked([r["g"]], np.uint64), lm.unpacked([r["c"]], np.int64).astype(float)
        total += c.sum()
        for b, (st, levels, bit) in enumerate(lm._inputs(g, c, model.low, 1)):
            gate = lm.Mixer.gate(levels)
            step = lm.Mixer.step(model.mixer.odds(st, levels, gate, b))
            np.add.at(want, (bit.astype(int), b, gate, step), c)
    assert np.allclose(model.mixer.seen, want) and np.allclose(want.sum((0, 2, 3)), total)


def _frequent_pair(rows, size):
    """Counted grams of one pair of bytes, as many tasks pass them on."""
    r = np.random.default_rng(6)
    every = (r.integers(0, 1 << 40, 2 * size).astype(np.uint64) << np.uint64(24)) | np.uint64(0x657200) | r.integers(97, 123, 2 * size).astype(np.uint64)
    parts = [np.unique(r.choice(every, size)) for _ in range(rows)]
    return pa.table({"bucket": [0] * rows, "g": [lm.packed(p) for p in parts], "c": [lm.packed(np.ones(len(p), np.uint32)) for p in parts]}), parts


def _peak(run):
    tracemalloc.start()
    out = run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_a_frequent_pair_is_added_up_in_bounded_memory():
    rows, parts = _frequent_pair(160, 50_000)
    out, peak = _peak(lambda: lm._add_grams(rows))
    want, count = np.unique(np.concatenate(parts), return_counts=True)
    assert np.array_equal(lm.unpacked(out.column("g").to_pylist(), np.uint64), want)
    assert np.array_equal(lm.unpacked(out.column("c").to_pylist(), np.int64), count)
    assert peak < 100e6


def test_a_frequent_pair_is_scored_in_bounded_memory():
    g = np.unique(np.concatenate(_frequent_pair(6, 400_000)[1]))
    c, low = np.ones(len(g)), [np.ones((2, 256)), np.ones((2, 65536))]
    got, peak = _peak(lambda: lm._logs(g, c, low, lm.Mixer()))
    assert len(g) > 500_000 and peak < 250 * len(g)
    # the same as with all contexts at once
    want = np.zeros(len(g))
    for b, (st, levels, bit) in enumerate(lm._inputs(g, c, low, 0)):
        p = 1 / (1 + np.exp(-lm.Mixer().odds(st, levels, lm.Mixer.gate(levels), b)))
        want += np.log(np.where(bit > 0, p, 1 - p))
    assert np.allclose(got[0], want)
