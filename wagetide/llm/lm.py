"""Scoring texts by online logistic context mixing, and by a unigram model of words as a yardstick.

A text is its bytes, A-Z in lower case, and an end sign. Each byte is eight binary decisions; a decision is predicted from the counts
of zeros and ones after the last 0 to 5 bytes, and after the word so far. The predictions, as log odds, are combined by weights
that are gated by the decision's place, each context's confidence and that of the longest contexts: logistic mixing. The weights are learnt
online, in two passes, one small batch of decisions after the other, each decision predicted from counts that leave its own occurrence
out, and averaged over the buckets. A second table refines the final mixer's probability by what followed such probabilities; a pass of its
own fills it. For each text the plain and the refined model share the weight
according to how well each did so far, and so the score is the log of the mean of both probabilities of the whole text.

All training texts are counted: bytes with their contexts ("grams") are counted per task, dealt out by the hash of the last two context
bytes, and added up. Grams of held-out texts are among them, with a count of zero. A bucket has all that was counted after its contexts of
two bytes and more, so each distinct gram is scored there, once, from all counts, some contexts of three bytes at a time; the logs are dealt out by the gram's hash, and each chunk
of documents gets back those of its own grams. Words are counted in buckets of their hashes, and come back the same way. What is collected
and sent to all tasks is the weights and the counts of orders 0 and 1, whose number the alphabet bounds.

Null text counts as empty: one end token, one end sign. Documents whose id is null are held out. Repeated rows are all counted and
each scored. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, MULT, Rolling, mix, packed, pieces, release, staged, text_buffer, unpacked, words
from .suffix import CHUNK, by_bucket, chunked, ordered, spread, to_bytes

END = 0xFF
#: Bytes of the contexts; the last context is the word so far.
LENGTHS, WINDOW = (0, 1, 2, 3, 4, 5), 5
ORDERS = len(LENGTHS) + 1
FOLDS, HELD_OUT = 5, 1
LEVELS = 16
GATES = 2 * LEVELS
STEPS = 24
PASSES = 2
#: Bytes of text worked on at once, grams held by a task before it passes them on, and chunks that ask for grams together: the larger, the
#: fewer grams are asked for twice.
PIECE, HELD, TOGETHER = 1 << 19, 1_400_000, 3
#: Grams that a bucket adds up at once, that are scored at once, and that one mixer learns from, contexts of three bytes being kept whole.
ADDED, PART, LEARNT = 1 << 20, 1 << 17, 1 << 19
#: Bytes whose arrays fit a cache; the high 16 bits.
STEP, TOP16 = 1 << 16, np.uint64(0xFFFF << 48)
END_TOKEN = np.uint64(0x5851F42D4C957F2D)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_grams, in steps of some rows, whose arrays stay in the processor's cache; and the rows' offsets."""
    parts, row = [], 0
    while row < len(off) - 1:
        stop = max(row + 1, int(np.searchsorted(off, off[row] + STEP, "right")) - 1)
        parts.append(_grams(buf[off[row] : off[stop]], off[row : stop + 1] - off[row]))
        row = stop
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), off + np.arange(len(off))


def _grams(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each byte and each row's end one number: 16 bits of a hash of the word so far, the five bytes before, the byte."""
    n, rows = len(buf), len(off) - 1
    out_off = off + np.arange(rows + 1)
    # each row behind WINDOW end signs, so that no context reaches into another
    own = np.full(n + (WINDOW + 1) * rows + WINDOW, END, np.uint8)
    shift = (WINDOW + 1) * np.arange(rows) + WINDOW
    at = np.arange(n + rows) + np.repeat(shift - np.arange(rows), np.diff(out_off))
    is_end = np.zeros(n + rows, bool)
    is_end[out_off[1:] - 1] = True
    own[at[~is_end]] = buf
    w = own.astype(np.uint64)
    two = (w[:-1] << np.uint64(8)) | w[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    six = (four[:-2] << np.uint64(16)) | two[4:]
    start = np.zeros(len(own) + 1, np.int64)
    np.maximum.accumulate(np.where(IS_SPACE[own] | (own == END), np.arange(1, len(own) + 1), 0), out=start[1:])
    word = Rolling(own).raw(start[at], at) & TOP16
    return word | six[at - WINDOW]


def _log_odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.clip(np.log((n1 + 0.02) / (n0 + 0.02)), -7.9, 7.9)


def _level(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    n = n0 + n1
    return np.where(n <= 0, 0, np.minimum(7, np.log2(np.maximum(n, 1) + 1).astype(np.int64)) * 2 + ((n0 <= 0) | (n1 <= 0))).astype(np.uint8)


def _decision(g: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the 255 decisions about the byte is its b-th, and how it went."""
    s = g & np.uint64(255)
    return (s >> np.uint64(8 - b)) | np.uint64(1 << b), ((s >> np.uint64(7 - b)) & np.uint64(1)).astype(np.float64)


def _context(g: np.ndarray, order: int) -> np.ndarray:
    """The last bytes; of the highest order, the word so far and three bytes."""
    if order == ORDERS - 1:
        return ((g >> np.uint64(48)) << np.uint64(24)) | ((g >> np.uint64(8)) & np.uint64(0xFFFFFF))
    return (g >> np.uint64(8)) & np.uint64((1 << (8 * LENGTHS[order])) - 1)


class Mixer:
    """Weights by decision, order, confidence of the order, and gate; and what followed a gate's probabilities, where that is known."""

    def __init__(self, weights: np.ndarray | None = None, seen: np.ndarray | None = None):
        self.w = np.full((8, ORDERS, LEVELS, GATES), 0.2) if weights is None else weights
        self.seen = np.zeros((2, 8, GATES, STEPS)) if seen is None else seen
        middle = 1 / (1 + np.exp(-((np.arange(STEPS) + 0.5) * (24 / STEPS) - 12)))
        self.refine = np.clip((self.seen[1] + 2 * middle) / (self.seen.sum(0) + 2), 1e-6, 1 - 1e-6)

    @staticmethod
    def gate(levels: np.ndarray) -> np.ndarray:
        """Confidence of the word's context, and whether the longest bytes' context is well known."""
        return levels[ORDERS - 1].astype(np.int64) * 2 + (levels[ORDERS - 2] > 3)

    @staticmethod
    def places(levels: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return (np.arange(ORDERS)[:, None] * LEVELS + levels) * GATES + gate

    def odds(self, st: np.ndarray, levels: np.ndarray, gate: np.ndarray, b: int) -> np.ndarray:
        return np.clip((self.w[b].ravel()[self.places(levels, gate)] * st).sum(0), -11, 11)

    def learn(self, st: np.ndarray, levels: np.ndarray, bit: np.ndarray, weight: np.ndarray, b: int, size: int = 2048) -> np.ndarray:
        """Online passes over the b-th decisions; returns how much each weight was used. st, levels: orders x decisions."""
        gate = self.gate(levels)
        places = self.places(levels, gate).astype(np.int16)
        w = self.w[b].ravel()
        squares, used = np.full(w.size, 1e-3), sum(np.bincount(x, weight, w.size) for x in places)
        for a in [*range(0, st.shape[1], size)] * PASSES:
            i, x, c, y = places[:, a : a + size], st[:, a : a + size], weight[a : a + size], bit[a : a + size]
            odds = np.clip((w[i] * x).sum(0), -11, 11)
            g = np.bincount(i.ravel(), ((y - 1 / (1 + np.exp(-odds))) * c * x).ravel(), w.size)
            squares += g * g
            w += 0.05 * g / np.sqrt(squares)
        self.w[b] = w.reshape(self.w[b].shape)
        return used.reshape(self.w[b].shape)

    def watch(self, st: np.ndarray, levels: np.ndarray, bit: np.ndarray, weight: np.ndarray, b: int) -> np.ndarray:
        """What followed the probabilities of the b-th decisions: zeros and ones by gate and step."""
        gate = self.gate(levels)
        at = gate * STEPS + self.step(self.odds(st, levels, gate, b))
        return np.stack([np.bincount(at, weight * (bit == v), GATES * STEPS).reshape(GATES, STEPS) for v in range(2)])

    @staticmethod
    def step(odds: np.ndarray) -> np.ndarray:
        return np.clip(((odds + 12) * (STEPS / 24)).astype(np.int64), 0, STEPS - 1)

    def probabilities(self, odds: np.ndarray, gate: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a one: mixed, and refined."""
        p = 1 / (1 + np.exp(-odds))
        return p, (p + self.refine[b, gate, self.step(odds)]) / 2


class Model:
    """The mixer, the counts of orders 0 and 1, and the table of all counted grams, by bucket."""

    def __init__(self, mixer: Mixer, low: list[np.ndarray], counted: DataFrame, buckets: int):
        self.mixer, self.low, self.counted, self.buckets = mixer, low, counted, buckets

    def logs(self, g: np.ndarray) -> np.ndarray:
        """Natural log of each gram's last byte's probability, by the plain and the refined model. For a few grams: their buckets are
        collected."""
        own = _bucket(g, self.buckets)
        out = np.zeros((2, len(g)))
        for b in np.unique(own).tolist():
            at = np.flatnonzero(own == b)
            known = [(unpacked([r["g"]], np.uint64), unpacked([r["c"]], np.int64)) for r in self.counted.filter(F.col("bucket") == b).collect()]
            every = np.concatenate([g[at], *(x for x, _ in known)])
            count = np.concatenate([np.zeros(len(at)), *(c for _, c in known)])
            out[:, at] = _logs(every, count, self.low, self.mixer)[:, : len(at)]
        return out


def _bucket(g: np.ndarray, buckets: int) -> np.ndarray:
    """By the last two bytes of the context."""
    return ((mix(_context(g, 2) * MULT) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _runs(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and how often each is there."""
    g = np.sort(g)
    heads = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    return g[heads], np.diff(np.r_[heads, len(g)])


def _count_grams(buckets: int):
    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        for batch in batches:
            for part in pieces(batch, "t", PIECE):
                buf, off = text_buffer(part.column("t"))
                g, own = grams(LOWER[buf], off)
                out = np.repeat(part.column("held").to_numpy(zero_copy_only=False), np.diff(own))
                held.append(_runs(g[~out]))
                u = _runs(g[out])[0]
                held.append((u, np.zeros(len(u), np.int64)))
                if sum(len(x) for x, _ in held) > HELD:
                    held[:] = [_added(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield _packed(*held.pop(), buckets)
        if held:
            yield _packed(*_added(held), buckets)

    return run


def _packed(g: np.ndarray, c: np.ndarray, buckets: int) -> pa.RecordBatch:
    out: dict[str, list] = {"bucket": [], "g": [], "c": []}
    for b, at in by_bucket(_bucket(g, buckets).astype(np.uint64), buckets):
        out["bucket"].append(b)
        out["g"].append(packed(g[at]))
        out["c"].append(packed(c[at].astype(np.uint32)))
    return pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int64()), ("g", pa.binary()), ("c", pa.binary())]))


def _add_grams(rows: pa.Table) -> pa.Table:
    """Of a bucket, each distinct gram once. Its rows are taken one by one and added up whenever they would take half of what is held, as
    a frequent pair's grams come from every task."""
    held, last = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
    for x, y in zip(rows.column("g"), rows.column("c"), strict=True):
        held.append((unpacked([x.as_buffer()], np.uint64), unpacked([y.as_buffer()], np.uint32)))
        if sum(len(g) for g, _ in held) - last > max(ADDED, last):
            held[:] = [_added(held)]
            last = len(held[0][0])
    g, total = _added(held)
    release()
    return pa.table({"bucket": [rows.column("bucket")[0].as_py()], "g": [packed(g)], "c": [packed(total)]})


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, in order, and the sums of their counts."""
    g, c = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
    order = np.argsort(g)
    g = g[order]
    heads = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    return g[heads], np.add.reduceat(c[order], heads, dtype=np.int64)


def _low_counts(batches):
    """Counts of orders 0 and 1 over a task's grams."""
    counts = [np.zeros((2, 256)), np.zeros((2, 65536))]
    for batch in batches:
        for g, c in _grams_of(batch):
            for b in range(8):
                node, bit = _decision(g, b)
                for k in range(2):
                    at = ((_context(g, k) << np.uint64(8)) | node).astype(np.int64)
                    for v in range(2):
                        counts[k][v] += np.bincount(at, c * (bit == v), len(counts[k][v]))
    some = np.flatnonzero(np.concatenate([x.sum(0) for x in counts]))
    both = np.concatenate(counts, axis=1)[:, some]
    yield pa.RecordBatch.from_pydict({"at": pa.array(some), "n0": pa.array(both[0]), "n1": pa.array(both[1])})


def _grams_of(batch):
    for g, c in zip(batch.column("g").to_pylist(), batch.column("c").to_pylist(), strict=True):
        yield unpacked([g], np.uint64), unpacked([c], np.int64).astype(np.float64)


def _after(g: np.ndarray, c: np.ndarray, order: int):
    """For each of the eight decisions: zeros and ones after each gram's context. One sort by context and byte brings the grams of every
    decision together."""
    key = (_context(g, order) << np.uint64(8)) | (g & np.uint64(255))
    o = np.argsort(key)
    key, c, o = key[o], c[o], o.astype(np.int32)
    upto = np.r_[0, np.cumsum(c)]
    for b in range(8):
        group = key >> np.uint64(8 - b)
        heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        ends = np.r_[heads[1:], len(key)]
        ones = np.add.reduceat(c * ((key >> np.uint64(7 - b)) & np.uint64(1)), heads)
        zeros = upto[ends] - upto[heads] - ones
        n0, n1 = np.empty(len(g)), np.empty(len(g))
        n0[o], n1[o] = np.repeat(zeros, ends - heads), np.repeat(ones, ends - heads)
        yield n0, n1


def _pairs(g: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each gram's context of two bytes, and zeros and ones by that number and decision."""
    used, own = np.unique(_context(g, 2).astype(np.uint16), return_inverse=True)
    own = own.astype(np.int32) << 8
    table = np.zeros((2, len(used) << 8))
    for b in range(8):
        node, bit = _decision(g, b)
        at = own + node.astype(np.int32)
        ones = np.bincount(at, c * bit, table.shape[1])
        table += np.bincount(at, c, table.shape[1]) - ones, ones
    return own, table


def _slices(g: np.ndarray, c: np.ndarray, low: list[np.ndarray], own: int):
    """Places of about PART grams, all of each context of three bytes or none, and their _inputs, which the other grams do not change."""
    pair, table = _pairs(g, c)
    order = np.argsort(_context(g, 3).astype(np.uint32))
    three = _context(g[order], 3)
    heads = np.r_[np.flatnonzero(np.r_[True, three[1:] != three[:-1]]), len(g)] if len(g) else np.zeros(1, np.int64)
    i = 0
    while i < len(heads) - 1:
        j = max(i + 1, int(np.searchsorted(heads, heads[i] + PART, "right")) - 1)
        at = order[heads[i] : heads[j]]
        yield at, _inputs(g[at], c[at], low, own, (pair[at], table))
        i = j


def _inputs(g: np.ndarray, c: np.ndarray, low: list[np.ndarray], own: int, pairs: tuple[np.ndarray, np.ndarray] | None = None):
    """For each of the eight decisions: log odds, levels (orders x grams), and how it went; from all counts, less own occurrences.
    pairs: what _pairs gives, where grams after the same two bytes are left out."""
    pair, table = pairs or _pairs(g, c)
    sorts = {k: _after(g, c, k) for k in range(3, ORDERS)}
    for b in range(8):
        node, bit = _decision(g, b)
        st, levels = np.zeros((ORDERS, len(g)), np.float32), np.zeros((ORDERS, len(g)), np.uint8)
        for k in range(ORDERS):
            if k < 2:
                at = ((_context(g, k) << np.uint64(8)) | node).astype(np.int64)
                n0, n1 = low[k][0][at], low[k][1][at]
            elif k == 2:
                at = pair + node.astype(np.int32)
                n0, n1 = table[0][at], table[1][at]
            else:
                n0, n1 = next(sorts[k])
            if own:
                n0, n1 = n0 - own * (1 - bit), n1 - own * bit
            levels[k] = _level(n0, n1)
            st[k] = np.where(levels[k] > 0, _log_odds(n0, n1), 0)
        yield st, levels, bit


def _logs(g: np.ndarray, c: np.ndarray, low: list[np.ndarray], mixer: Mixer) -> np.ndarray:
    """Logs of each gram's last byte's probability, by both models, where all that was counted in their bucket is among the grams."""
    out = np.zeros((2, len(g)))
    for at, made in _slices(g, c, low, 0):
        part = np.zeros((2, len(at)))
        for b, (st, levels, bit) in enumerate(made):
            gate = Mixer.gate(levels)
            for i, p in enumerate(mixer.probabilities(mixer.odds(st, levels, gate, b), gate, b)):
                part[i] += np.log(np.where(bit > 0, p, 1 - p))
        out[:, at] = part
    return out


_LEARNT = pa.schema([("part", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
_LEARNT_DDL = "part long, a binary, b binary"


def _learn(low: list[np.ndarray]):
    """As parts 0 to 7, sums over a task's mixers of weights by use, and use."""

    def run(batches):
        w, used = np.zeros((8, ORDERS, LEVELS, GATES)), np.zeros((8, ORDERS, LEVELS, GATES))
        for batch in batches:
            for g, c in _grams_of(batch):
                g, c = _in_no_order(g, c)
                pair, table = _pairs(g, c)
                part = mix(_context(g, 3) * MULT) % np.uint64(max(1, -(-len(g) // LEARNT)))
                for k in np.unique(part):
                    at, mixer = np.flatnonzero(part == k), Mixer()
                    for b, (st, levels, bit) in enumerate(_inputs(g[at], c[at], low, 1, (pair[at], table))):
                        use = mixer.learn(st, levels, bit, c[at], b)
                        w[b], used[b] = w[b] + use * mixer.w[b], used[b] + use
                release()
        yield _parts(w, used)

    return run


def _watched(low: list[np.ndarray], mixer: Mixer):
    """As parts 0 to 7, zeros and ones that followed the final mixer's probabilities."""

    def run(batches):
        seen = np.zeros((2, 8, GATES, STEPS))
        for batch in batches:
            for g, c in _grams_of(batch):
                g, c = g[c > 0], c[c > 0]
                for at, made in _slices(g, c, low, 1):
                    for b, x in enumerate(made):
                        seen[:, b] += mixer.watch(*x, c[at], b)
        yield _parts(*seen)

    return run


def _parts(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": range(8), "a": [to_bytes(x) for x in a], "b": [to_bytes(x) for x in b]}, schema=_LEARNT)


def _in_no_order(g: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grams of training texts, in no order of their contexts."""
    g, c = g[c > 0], c[c > 0]
    order = np.argsort(mix(g))
    return g[order], c[order]


def _summed(rows: pa.Table) -> pa.Table:
    added = {k: to_bytes(sum(np.frombuffer(x) for x in rows.column(k).to_pylist())) for k in "ab"}
    return pa.table({"part": [rows.column("part")[0].as_py()], **{k: [v] for k, v in added.items()}}, schema=_LEARNT)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None) -> Model:
    """Learns from all documents given but those held out, whose grams are counted as zero. What comes back are weights and the counts of
    orders 0 and 1; all other counts stay a table in the shared folder, which grows with the input."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    buckets = max(1, -(-size // (8 << 20)))
    packed = docs.select(F.col(text_col).alias("t"), (F.lit(False) if held is None else held).alias("held")).mapInArrow(_count_grams(buckets), "bucket long, g binary, c binary")
    table = staged(packed.groupBy("bucket").applyInArrow(_add_grams, "bucket long, g binary, c binary"), "grams")
    counted = table.select("g", "c")
    low = [np.zeros((2, 256)), np.zeros((2, 65536))]
    for r in counted.mapInArrow(_low_counts, "at long, n0 double, n1 double").groupBy("at").agg(F.sum("n0"), F.sum("n1")).collect():
        k, at = (0, r[0]) if r[0] < 256 else (1, r[0] - 256)
        low[k][:, at] = r[1], r[2]
    w, seen = np.full((8, ORDERS, LEVELS, GATES), 0.2), np.zeros((2, 8, GATES, STEPS))
    summed = lambda run: counted.mapInArrow(run, _LEARNT_DDL).groupBy("part").applyInArrow(_summed, _LEARNT_DDL).collect()
    for r in summed(_learn(low)):
        b = r["part"]
        total, used = np.frombuffer(r["a"]).reshape(w[b].shape), np.frombuffer(r["b"]).reshape(w[b].shape)
        w[b] = np.where(used > 0, total / np.maximum(used, 1e-9), 0.2)
    for r in summed(_watched(low, Mixer(w))):
        for v in range(2):
            seen[v, r["part"]] = np.frombuffer(r["ab"[v]]).reshape(GATES, STEPS)
    return Model(Mixer(w, seen), low, table, buckets)


def _tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and one end token of each row, and the rows' offsets."""
    start, end, row = words(buf, off)
    out_off = row + np.arange(len(row))
    h = np.full(out_off[-1], END_TOKEN, np.uint64)
    at = np.ones(len(h), bool)
    at[out_off[1:] - 1] = False
    h[at] = Rolling(buf).of(start, end)
    return h, out_off


def _row_pieces(buf: np.ndarray, off: np.ndarray):
    """Bytes, in lower case, and offsets of some rows, until all rows are done."""
    row = 0
    while row < len(off) - 1:
        stop = max(row + 1, int(np.searchsorted(off, off[row] + PIECE, "right")) - 1)
        yield LOWER[buf[off[row] : off[stop]]], off[row : stop + 1] - off[row]
        row = stop


def _all_tokens(docs: pa.Table):
    docs, _, buf, off = ordered(docs)
    made = [_tokens(*x) for x in _row_pieces(buf, off)]
    out_off = np.r_[0, np.cumsum(np.concatenate([np.diff(o) for _, o in made]))]
    u, inv = np.unique(np.concatenate([h for h, _ in made]), return_inverse=True)
    return docs, buf, off, out_off, u, inv


def _words_of(n: int):
    def run(docs: pa.Table) -> pa.Table:
        docs, _, _, tok, u, inv = _all_tokens(docs)
        learn = np.repeat(~docs.column("__held").to_numpy(), np.diff(tok))
        count = np.bincount(inv, learn, len(u)).astype(np.int64)
        chunk = docs.column("__c")[0].as_py()
        rows = [(b, chunk, to_bytes(u[at]), packed(count[at])) for b, at in by_bucket(u, n)]
        kinds = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("h", pa.binary()), ("c", pa.binary())])
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return run


def _word_counts(rows: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, np.uint64) for x in rows.column("h").to_pylist()]
    u, inv = np.unique(np.concatenate(parts), return_inverse=True)
    count = np.bincount(inv, unpacked(rows.column("c").to_pylist(), np.int64)).astype(np.int64)
    back = [packed(x) for x in np.split(count[inv], np.cumsum([len(p) for p in parts])[:-1])]
    first = np.arange(len(parts)) == 0
    return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "c": pa.array(back, pa.binary()), "total": pa.array(first * count.sum()), "kinds": pa.array(first * (count > 0).sum())})


def _by_hash(u: np.ndarray, n: int):
    return by_bucket(mix(u) >> np.uint64(20), n)


def _asked(n: int):
    """A chunk's distinct grams, dealt out by their hashes."""

    def run(docs: pa.Table) -> pa.Table:
        docs, _, buf, off = ordered(docs)
        u, chunk = _runs(np.concatenate([_runs(grams(*x)[0])[0] for x in _row_pieces(buf, off)]))[0], docs.column("__c")[0].as_py()
        rows = [(b, chunk, packed(u[at])) for b, at in _by_hash(u, n)]
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ASKED, strict=True)], schema=_ASKED)

    return run


_ASKED = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("g", pa.binary())])
_BACK = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("c", pa.binary())])


def _gram_logs(low: list[np.ndarray], mixer: Mixer, n: int):
    """Both logs of each counted gram as one number of 64 bits, dealt out by the gram's hash."""

    def run(batches):
        for batch in batches:
            for g, c in _grams_of(batch):
                logs = np.ascontiguousarray(_logs(g, c, low, mixer).T.astype(np.float32)).view(np.uint64).ravel()
                out: dict[str, list] = {"bucket": [], "g": [], "logs": []}
                for b, at in _by_hash(g, n):
                    out["bucket"].append(b)
                    out["g"].append(packed(g[at]))
                    out["logs"].append(packed(logs[at]))
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int64()), ("g", pa.binary()), ("logs", pa.binary())]))

    return run


def _answers(n: int):
    """The logs of the grams asked for. Their buckets are numbered behind those of the words."""

    def run(asked: pa.Table, logs: pa.Table) -> pa.Table:
        g, value = (unpacked(logs.column(k).to_pylist(), np.uint64) for k in ("g", "logs"))
        order = np.argsort(g)
        g, value = g[order], value[order]
        back = []
        for x in asked.column("g").to_pylist():
            q = unpacked([x], np.uint64)
            at = np.searchsorted(g, q)
            if not np.array_equal(g[np.minimum(at, len(g) - 1)], q):
                raise ValueError("a text's gram was not counted")
            back.append(packed(value[at]))
        bucket = [n + b for b in asked.column("bucket").to_pylist()]
        return pa.table([pa.array(x, f.type) for x, f in zip((asked.column("chunk").to_pylist(), bucket, back), _BACK, strict=True)], schema=_BACK)

    return run


def _scored(n: int):
    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        docs, buf, off, tok, u, inv = _all_tokens(docs)
        c = np.zeros(len(u), np.int64)
        back = dict(zip(counts.column("bucket").to_pylist(), counts.column("c").to_pylist(), strict=True))
        for b, at in by_bucket(u, n):
            c[at] = unpacked([back[b]], np.int64)
        c = c[inv]
        per = lambda x: np.add.reduceat(x, tok[:-1])  # noqa: E731  each row has a token
        base = per(np.log10(c + 0.5))
        made = []
        for x in _row_pieces(buf, off):
            g, own = grams(*x)
            order = np.argsort(g)
            g = g[order]
            new = np.r_[True, g[1:] != g[:-1]]
            inv = np.empty(len(g), np.int32)
            inv[order] = np.cumsum(new, dtype=np.int32) - 1
            made.append((g[new], inv, own))
        known = _runs(np.concatenate([u for u, _, _ in made]))[0]
        value = np.zeros(len(known), np.uint64)
        for b, at in _by_hash(known, n):
            value[at] = unpacked([back[n + b]], np.uint64)
        value = value.view(np.float32).reshape(-1, 2)
        scores = []
        for u, inv, own in made:
            both = value[np.searchsorted(known, u)].T.astype(np.float64)
            logs = [np.add.reduceat(x[inv], own[:-1]) for x in both]
            scores.append((np.logaddexp(logs[0], logs[1]) - np.log(2)) / np.log(10))
        score = np.concatenate(scores)
        bits = -score / np.log10(2) / np.maximum(1, np.diff(off))
        return pa.table({
            "doc_id": docs.column("__id"), "held_out": docs.column("__held"), "n_tokens": pa.array(np.diff(tok)), "n_known": pa.array(per((c > 0).astype(np.int64))),
            "base_score": pa.array(base), "score": pa.array(score), "bits_per_byte": pa.array(bits),
        })

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each row."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))
    docs = docs.select(id_col, text_col, held.alias("__held"))
    own, n = chunked(docs, id_col, text_col, ("__held",))
    n = max(8, -(-n // TOGETHER))
    own = own.withColumn("__c", F.pmod("__c", F.lit(n)))
    model = train(docs, id_col, text_col, F.col("__held"))
    tasks = spread(docs, n * TOGETHER * CHUNK)
    by_chunk = own.repartition(tasks, "__c").groupBy("__c")
    asked = by_chunk.applyInArrow(_asked(n), "bucket long, chunk long, g binary").repartition(tasks, "bucket").groupBy("bucket")
    logs = model.counted.select("g", "c").mapInArrow(_gram_logs(model.low, model.mixer, n), "bucket long, g binary, logs binary").repartition(tasks, "bucket").groupBy("bucket")
    answers = asked.cogroup(logs).applyInArrow(_answers(n), "chunk long, bucket long, c binary")
    index = by_chunk.applyInArrow(_words_of(n), "bucket long, chunk long, h binary, c binary")
    counts = index.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_word_counts, "chunk long, bucket long, c binary, total long, kinds long")
    size = counts.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("train_tokens"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds"))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"
    both = counts.select("chunk", "bucket", "c").union(answers)
    made = by_chunk.cogroup(both.repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(_scored(n), schema)
    # the yardstick's denominator is one row of two sums
    made = made.crossJoin(F.broadcast(size))
    base = F.col("base_score") - F.col("n_tokens") * F.log10(F.col("train_tokens") + 0.5 * (F.col("kinds") + 1))
    return made.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", base.alias("base_score"), "score", "bits_per_byte")
