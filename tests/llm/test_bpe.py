import base64
import hashlib
import random

import pytest

from wagetide.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
import public_tokenizers  # noqa: E402


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(4)
    odd = ["", " ", "a" * 3000, "ab" * 900, "é" * 900, " " * 700 + "x", "\n\n  \t x", "日本語のテキスト" * 200, "<|endoftext|> 'S 'll"]
    return odd + ["".join(chr(r.randint(33, 0x2FFF)) for _ in range(2000)), "".join(r.choice("abcd") for _ in range(4000))] + [" ".join("".join(r.choice("étaoin shr") for _ in range(r.randint(1, 30))) for _ in range(50)) for _ in range(40)]


def test_like_the_library(library):
    codec, all_ = bpe.codec(), texts()
    ids, off = codec.encode(all_)
    for i, t in enumerate(all_):
        assert ids[off[i] : off[i + 1]].tolist() == library.encode_ordinary(t)
    assert codec.decode(ids, off) == [t.encode() for t in all_]


def test_long_pieces_merge_alike(library, monkeypatch):
    codec = bpe.Bpe(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    pieces = [b"a" * 40, "".join(random.Random(1).choice("abcdeé") for _ in range(300)).encode(), b"x"]
    matrix = codec.encode_pieces(pieces)
    monkeypatch.setattr(bpe, "LONGEST", 0)
    assert [x.tolist() for x in codec.encode_pieces(pieces)] == [x.tolist() for x in matrix]


def test_known_pieces_are_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_CHARS", 5000)
    codec = bpe.Bpe(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    for t in [c * n for n in range(900, 1000, 7) for c in "abé"]:
        ids, _ = codec.encode([t, "x y", t])
        assert ids.tolist() == library.encode_ordinary(t) + library.encode_ordinary("x y") + library.encode_ordinary(t)
        assert codec.held == sum(map(len, codec.known)) <= 5000


def test_rows(spark, library):
    rows = [(1, "hello world"), (1, "hello world"), (None, None), (3, "")]
    docs = spark.createDataFrame([(*x, 9) for x in rows], "doc_id long, text string, n_tokens int")
    got = sorted(bpe.encode(docs).collect(), key=str)
    assert len(got) == 4 and bpe.encode(docs.limit(0)).count() == 0
    for r in got:
        ids = library.encode_ordinary("hello world") if r["doc_id"] == 1 else []
        text = b"hello world" if ids else b""
        assert list(r["token_ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text).hexdigest()


def test_a_worker_keeps_few_pieces():
    """Workers of the pipeline share an executor's memory with what earlier stages left."""
    assert bpe.CACHED <= 250_000 and bpe.CACHED_CHARS <= 8_000_000
