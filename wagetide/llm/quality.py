"""Quality classifier: a generalised additive model with pairwise interactions.

Each text gives FEATURES numbers (lengths, shares of kinds of bytes, repetition, line shapes). Cyclic boosting visits one feature
after the other and fits a shallow tree of at most three splits to the logistic residuals of that feature's bins alone; the trees
of a feature add up to a lookup table. Then the pairs of features that explain most of what is left get tables over both features'
coarse bins, boosted likewise. A text's score is the logistic of the intercept and the looked-up table entries: vectorised bin
additions.

Only the fit is bounded: it takes at most SAMPLE labelled rows outside the held-out fold, those of smallest hash of the id. Every text
is scored whole. Null text counts as empty and gets a score like any other; labels that are null or belong to no document are not
learnt from; a document with several labels counts with each. Without labels of both kinds every score is the share of label 1 (0.5
without labels). Repeated rows each give a row; labels, language, source and id are no inputs.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of

SAMPLE = 20_000
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
BINS, COARSE, ROUNDS, PAIRS, RATE = 32, 8, 120, 8, 0.15
_KINDS = ("upper", "lower", "digit", "symbol", "exclaim", "bar", "break", "stop", "comma", "blank", "high", "markup")
_SETS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#$%&*^~+=_", b"!?", b"|", b"\n", b".", b",;:", b" ", bytes(range(128, 256)), b"<>{}[]()\\/@")
FEATURES = ("bytes", "words", "word_bytes", "distinct", "top_word", "repeats", "capitals", "all_capitals", "short", "long", "symbol_ends", "sentence_ends", "lines", "line_words", "distinct_lines", "top_line", "distinct_pairs", *_KINDS)
_KIND = np.full(256, len(_SETS), np.int64)
for _i, _s in enumerate(_SETS):
    _KIND[list(_s)] = _i


def features(text: str) -> list[float]:
    raw = text.encode()
    w, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, n_lines = max(1, len(w)), max(1, len(lines))
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=len(_SETS) + 1)[: len(_SETS)] / max(1, len(raw))
    counts = Counter(w)
    return [
        np.log1p(len(raw)), np.log1p(len(w)), len(raw) / n, len(counts) / n, max(counts.values(), default=0) / n,
        sum(a == b for a, b in zip(w, w[1:])) / n, sum(x[0].isupper() for x in w) / n, sum(map(str.isupper, w)) / n,
        sum(len(x) <= 3 for x in w) / n, sum(len(x) > 12 for x in w) / n, sum(x[-1] in "#$%&*!|" for x in w) / n, sum(x[-1] in ".?!" for x in w) / n,
        np.log1p(len(lines)), np.log1p(len(w) / n_lines), len(set(lines)) / n_lines, max(Counter(lines).values(), default=0) / n_lines, len(set(zip(w, w[1:]))) / n,
        *kinds,
    ]


class Model:
    """Cut points of each feature, tables over bins, tables over pairs of coarse bins, intercept."""

    def __init__(self, base: float):
        self.base, self.cuts, self.tables, self.coarse, self.pairs = base, [], [], [], {}

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if self.cuts:
            for f, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
                out += table[np.searchsorted(cut, x[:, f], "right")]
            for (a, b), table in self.pairs.items():
                out += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, splits: int = 3, least: float = 5.0) -> np.ndarray:
    """Step heights of a tree over consecutive bins: greedy splits by gain of the gradient sums g and weights h."""
    gs, hs = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    edges = [0, len(g)]
    for _ in range(splits):
        best = (1e-9, None)
        for lo, hi in zip(edges[:-1], edges[1:]):
            k = np.arange(lo + 1, hi)
            gl, hl, gr, hr = gs[k] - gs[lo], hs[k] - hs[lo], gs[hi] - gs[k], hs[hi] - hs[k]
            gain = np.where((hl >= least * 0.05) & (hr >= least * 0.05), gl**2 / (hl + 1) + gr**2 / (hr + 1) - (gs[hi] - gs[lo]) ** 2 / (hs[hi] - hs[lo] + 1), 0)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), int(k[gain.argmax()]))
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(g))
    for lo, hi in zip(edges[:-1], edges[1:]):
        out[lo:hi] = (gs[hi] - gs[lo]) / (hs[hi] - hs[lo] + 1)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    share = y.mean() if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        return Model(float(np.log((share * len(y) + 1) / ((1 - share) * len(y) + 1))) if len(y) else 0.0)
    m = Model(float(np.log(share / (1 - share))))
    cuts = lambda v, n: np.unique(np.quantile(v, np.arange(1, n) / n))
    m.cuts, m.coarse = [cuts(v, BINS) for v in x.T], [cuts(v, COARSE) for v in x.T]
    bins = [np.searchsorted(c, v, "right") for c, v in zip(m.cuts, x.T, strict=True)]
    m.tables = [np.zeros(len(c) + 1) for c in m.cuts]
    raw = np.full(len(y), m.base)

    def residual():
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            g, h = residual()
            n = len(m.tables[f])
            step = RATE * _tree(np.bincount(b, g, n), np.bincount(b, h, n))
            m.tables[f] += step
            raw += step[b]
    coarse = [np.searchsorted(c, v, "right") for c, v in zip(m.coarse, x.T, strict=True)]
    g, h = residual()
    size = COARSE + 1
    cell = lambda a, b: coarse[a] * size + coarse[b]
    gain = lambda a, b: (np.bincount(cell(a, b), g, size**2) ** 2 / (np.bincount(cell(a, b), h, size**2) + 1)).sum()
    found = sorted(((gain(a, b), a, b) for a in range(len(bins)) for b in range(a)), reverse=True)[:PAIRS]
    m.pairs = {(a, b): np.zeros((size, size)) for _, a, b in found}
    for _ in range(ROUNDS // 3):
        for (a, b), table in m.pairs.items():
            g, h = residual()
            c = cell(a, b)
            gs, hs = np.bincount(c, g, size**2).reshape(size, size), np.bincount(c, h, size**2).reshape(size, size)
            # a shallow tree on a, below each of its leaves one on b
            top, step = _tree(gs.sum(1), hs.sum(1), 1), np.zeros((size, size))
            for v in np.unique(top):
                rows = top == v
                step[rows] = RATE * _tree(gs[rows].sum(0), hs[rows].sum(0), 2)
            table += step
            raw += step.ravel()[c]
    return m


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Learns from at most sample labelled documents outside the held-out fold; of several rows of an id from the text of smallest
    digest. So at most sample rows come to the driver, however often ids repeat."""
    pick = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna().distinct()
    pick = pick.filter(F.crc32(F.col("_id").cast("string").cast("binary")) % FOLDS != HELD_OUT)
    # at most sample rows, so small enough to send to all tasks whatever the input
    pick = pick.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(f"`{text_col}`").alias("_t")).join(F.broadcast(pick), "_id")
    one = rows.groupBy("_id", "_y").agg(F.min_by("_t", F.md5(F.col("_t").cast("binary"))).alias("_t"))
    made = one.select("_id", "_y", _features("_t").alias("_x")).toPandas().sort_values(["_id", "_y"])
    return fit(np.array(made["_x"].tolist()).reshape(-1, len(FEATURES)), made["_y"].to_numpy(float))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts])


def score_column(model: Model, text_col: str = "text"):
    """The score of a text as a column."""

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t or "") for t in texts]).reshape(-1, len(FEATURES))))

    return score(F.col(text_col))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; no shuffle but for the sample."""
    model = train(docs, labels, id_col, text_col)
    out = docs.select(F.col(id_col).alias("doc_id"), score_column(model, text_col).alias("score"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
