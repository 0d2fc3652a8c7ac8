"""Texts of more than a million bytes beside null, empty and short ones."""

import hashlib
import random

import pytest

from wagetide.llm import chat, lm, mixing, near, sketches, slots, suffix

TAIL = " and a tail of its own"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    vocab = ["".join(r.choice("abcdefghiéß") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    long = " ".join(r.choice(vocab) for _ in range(200_000))
    assert len(long.encode()) > 1 << 20
    return {1: long, 2: long + TAIL, 3: None, 4: "", 5: "a short text", 6: "x" * (1 << 20)}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(d, t, "s") for d, t in texts.items()], "doc_id long, text string, source string").cache()


def test_near(docs):
    found = {r["doc_id"]: r["group_id"] for r in near.groups(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6}


def test_repeats(docs, texts):
    got = {r["__id"]: (r["__bytes"], r["__removed"], r["__spans"], r["__sha"]) for r in suffix.remove_repeats(docs).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    size = {d: len((t or "").encode()) for d, t in texts.items()}
    want = {d: (size[d], 0, 0, sha(t)) for d, t in texts.items()} | {2: (size[2], size[1], 1, sha(TAIL))}
    assert got == want


def test_sizes(docs, texts):
    size = {d: len((t or "").encode()) + 1 for d, t in texts.items()}
    assert {r["doc_id"]: r["size"] for r in slots.shard(docs, 8).collect()} == size
    count = {d: len((t or "").split()) for d, t in texts.items()}
    assert {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()} == count


def test_language_model(docs, texts):
    got = {r["doc_id"]: r for r in lm.score(docs).collect()}
    assert {d: r["n_tokens"] for d, r in got.items()} == {d: len((t or "").split()) + 1 for d, t in texts.items()}
    assert all(r["score"] < 0 for r in got.values()) and got[1]["score"] < got[5]["score"]


def test_fingerprints(docs, texts):
    got = {r["doc_id"]: r for r in sketches.fingerprints(docs).collect()}
    assert {d: r["n_chars"] for d, r in got.items()} == {d: len(t or "") for d, t in texts.items()}
    assert got[3]["fingerprint"] == got[4]["fingerprint"] and got[2]["near_next"] > 0.9
    assert sketches.compared(got[2]["fingerprint"], got[1]["fingerprint"]) == pytest.approx(got[2]["near_next"])


def test_snapshots(spark, texts):
    turns = [(1, 0, "user", texts[1]), (2, 0, "user", texts[1]), (2, 1, "bot", texts[6]), (3, 0, "user", None)]
    got = {r["conv_id"]: r["text"] for r in chat.render(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {2: f"<|user|>\n{texts[1]}<|end|>\n<|bot|>\n{texts[6]}<|end|>\n", 3: "<|user|>\n<|end|>\n"}
