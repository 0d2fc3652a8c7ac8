"""Removing repeated passages with suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts in a document of smaller id. What can repeat is found first, so
that suffix arrays are built over candidates only:

1. index   Documents are dealt by hash into chunks. The windows (strings of LENGTH bytes) of a document fall into runs that share
           their least hash of K bytes. Each chunk sends the hashes of its runs, once each, to the hash's bucket.
2. shared  A bucket tells each chunk which of its hashes occur in two or more documents, and which occur in so many different
           surroundings (HOT) that their runs must be dealt out further.
3. cut     A chunk sends the text of the runs concerned, each different string once with its smallest document, to the shard of the
           run's hash. The windows of a hot hash fall into runs again, by their least hash of LONGER of their bytes, which few
           surroundings share; those of a hash HOTTER times as hot by the hash of all their bytes. Equal windows meet in a shard.
4. sort    A shard builds suffix arrays by Larsson-Sadakane refinement over blocks of its strings, common prefixes by Kasai's rule,
           and merges blocks by binary search of one's windows in the other. A window that occurs with a smaller id is removed.
5. drop    Chunks take the removed windows out of their documents.

Every step holds one chunk, bucket, block or document at a time; no group is collected, capped or sampled. Equal strings within a
chunk or shard are told by 64-bit hashes of them. The number of tasks follows the bytes, not only the session.

Null text counts as empty. A null id counts as larger than all others, and as smaller than none. Rows of one id do not remove each
other's text. Other columns are carried along only on request, in a struct, and may have any names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, gather, release, text_buffer

LENGTH, K, LONGER = 50, 16, 0.8
CHUNK, BLOCK, PIECE = 4 << 20, 2 << 20, (1 << 20) - 1
#: Bytes of text that a task deals with, one chunk after the other.
TASK = 64 << 20
#: A hash of up to HOT texts takes about a megabyte of a shard, and the parts of one of up to HOTTER times as many some blocks.
HOT, HOTTER, SPLIT = 16_384, 16, 64
LAST = np.iinfo(np.int64).max
LOW48 = np.uint64((1 << 48) - 1)


def suffix_array(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of t in order, and the first 8 bytes at each place as one number. Larsson and Sadakane: suffixes are sorted by
    8 bytes, then groups that are still equal by the rank of what follows, twice as far each round."""
    n = len(t)
    padded = np.concatenate([t, np.zeros(8, np.uint8)]).astype(np.uint64)
    key8 = np.zeros(n, np.uint64)
    for i in range(8):
        key8 |= padded[i : n + i] << np.uint64(56 - 8 * i)
    del padded
    sa = np.argsort(key8)
    head = np.ones(n, bool)
    head[1:] = key8[sa[1:]] != key8[sa[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h = 8
    while h < 2 * n:
        alone = head.copy()
        alone[:-1] &= head[1:]
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        sub = sa[open_]
        after = sub + h
        key = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, n - after)
        key += rank[sub] * (3 * n + 1)
        o = np.argsort(key)
        sub, key = sub[o], key[o]
        sa[open_] = sub
        new = np.ones(len(sub), bool)
        new[1:] = key[1:] != key[:-1]
        head[open_] = new
        rank[sub] = open_[np.maximum.accumulate(np.where(new, np.arange(len(sub)), 0))]
        h *= 2
    return sa, key8


def common_prefixes(t: np.ndarray, sa: np.ndarray, key8: np.ndarray) -> np.ndarray:
    """Of each suffix in order, the bytes that it shares with the one before. Kasai: if the two are preceded by the same byte, their
    value is one less than that of the suffix one byte earlier; only the others are compared, 8 bytes at a time."""
    n = len(t)
    prior = np.empty(n, np.int64)
    prior[sa[0]] = -1
    prior[sa[1:]] = sa[:-1]
    own = np.ones(n, bool)
    own[1:] = (prior[1:] <= 0) | (t[:-1] != t[np.maximum(prior[1:], 1) - 1])
    a = np.flatnonzero(own & (prior >= 0))
    b, plcp = prior[a], np.zeros(n, np.int64)
    at = a.copy()
    while len(a):
        x = key8[a] ^ key8[b]
        same = x == 0
        step = np.full(len(a), 8)
        if not same.all():
            d = x[~same]
            zero = np.zeros(len(d), np.int64)
            for i in range(1, 8):
                zero += (d >> np.uint64(64 - 8 * i)) == 0
            step[~same] = zero
        step = np.minimum(step, n - np.maximum(a, b))
        plcp[at] += step
        more = same & (step == 8) & (np.maximum(a, b) + 8 < n)
        a, b, at = a[more] + 8, b[more] + 8, at[more]
    j = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    return (plcp[j] - (np.arange(n) - j))[sa]


def _runs(buf: np.ndarray, off: np.ndarray, length: int, k: int = K) -> tuple[np.ndarray, ...]:
    """Runs of windows in a row that share their least hash of k bytes: first window, windows, that hash in 48 bits, hash of all their
    text, row."""
    parts, row = [], 0
    while row < len(off) - 1:
        stop = max(row + 1, int(np.searchsorted(off, off[row] + PIECE, "right")) - 1)
        a, n = off[row], int(off[stop] - off[row])
        if n >= length:
            own = off[row : stop + 1] - a
            roll = Rolling(buf[a : a + n])
            m = roll.windows(k)
            width, need = 1, length - k + 1
            while width * 2 <= need:
                m = np.minimum(m[:-width], m[width:])
                width *= 2
            if need > width:
                m = np.minimum(m[: len(m) - (need - width)], m[need - width :])
            m &= LOW48
            step = np.zeros(n + 1, np.int32)
            np.add.at(step, own[:-1], 1)
            np.add.at(step, np.maximum(own[:-1], own[1:] - length + 1), -1)
            ok = np.cumsum(step)[: len(m)] > 0
            first = ok.copy()
            first[1:] &= ~ok[:-1] | (m[1:] != m[:-1])
            lo = np.flatnonzero(first)
            last = ok.copy()
            last[:-1] &= ~ok[1:] | first[1:]
            count = np.flatnonzero(last) - lo + 1
            times = -(-count // SPLIT)
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            value = np.repeat(m[lo], times)
            count = np.minimum(SPLIT, np.repeat(count, times) - nth * SPLIT)
            lo = np.repeat(lo, times) + nth * SPLIT
            parts.append((lo + a, count, value, roll.of(lo, lo + count + length - 1), np.searchsorted(own, lo, "right") - 1 + row))
        row = stop
    if not parts:
        e = np.zeros(0, np.int64)
        return e, e, e.astype(np.uint64), e.astype(np.uint64), e
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def ordered(docs: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk in the same order each time it is read; its ids, bytes and row offsets."""
    docs = docs.take(pc.sort_indices(docs, [("__d", "ascending"), ("__k", "ascending")]))
    buf, off = text_buffer(docs.column("__t"))
    return docs, docs.column("__d").to_numpy(), buf, off


def by_bucket(u: np.ndarray, n: int):
    """Numbers of the entries of u in each bucket that has any."""
    bucket = (u % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    heads = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]]) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(heads, np.r_[heads[1:], len(order)], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def to_bytes(x) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def spread(docs: DataFrame, size: int) -> int:
    """Tasks for so many bytes: the session's partitions, and more where they would hold over TASK bytes each."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK))


def chunked(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """Rows with the number of their chunk, __c, of about CHUNK bytes of text; and the number of chunks."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    n = max(8, -(-total // CHUNK))
    id_ = F.col(id_col)
    own = docs.select(*carry, id_.alias("__id"), F.coalesce(id_.cast("long"), F.lit(int(LAST))).alias("__d"), F.col(text_col).alias("__t"), F.xxhash64(text_col).alias("__k"))
    return own.withColumn("__c", F.pmod(F.xxhash64("__d", "__k"), F.lit(n))), n


def _index(n: int, length: int):
    def run(docs: pa.Table) -> pa.Table:
        docs, ids, buf, off = ordered(docs)
        _, _, value, text, row = _runs(buf, off, length)
        out: dict[str, list] = {"bucket": [], "chunk": [], "hashes": [], "info": []}
        if len(value):
            order = np.lexsort((text, value))
            v, t, d = value[order], text[order], ids[row[order]]
            new = np.r_[True, v[1:] != v[:-1]]
            heads = np.flatnonzero(new)
            several = np.minimum.reduceat(d, heads) != np.maximum.reduceat(d, heads)
            texts = np.add.reduceat(new | np.r_[True, t[1:] != t[:-1]], heads)
            info = np.minimum(texts, 127).astype(np.uint8) | (several.astype(np.uint8) << 7)
            u, chunk = v[heads], docs.column("__c")[0].as_py()
            for b, at in by_bucket(u, n):
                out["bucket"].append(b)
                out["chunk"].append(chunk)
                out["hashes"].append(to_bytes(u[at].view(np.uint8).reshape(-1, 8)[:, :6]))
                out["info"].append(to_bytes(info[at]))
        return pa.table(out, schema=pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("info", pa.binary())]))

    return run


def _shared(hot: int):
    def run(rows: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x, np.uint8).reshape(-1, 6) for x in rows.column("hashes").to_pylist()]
        h = np.zeros((sum(map(len, blobs)), 8), np.uint8)
        h[:, :6] = np.concatenate(blobs)
        info = np.frombuffer(b"".join(rows.column("info").to_pylist()), np.uint8)
        u, inv = np.unique(h.view(np.uint64).ravel(), return_inverse=True)
        chunks, several, texts = np.bincount(inv), np.bincount(inv, info >> 7), np.bincount(inv, info & 127)
        state = ((chunks > 1) | (several > 0)).astype(np.uint8)
        state[(state > 0) & (texts > hot)] = 2
        state[(state > 0) & (texts > hot * HOTTER)] = 3
        ends = np.cumsum([len(b) for b in blobs])
        masks = [to_bytes(x) for x in np.split(state[inv], ends[:-1])]
        return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "mask": pa.array(masks, pa.binary())})

    return run


_CUT = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), *((k, pa.binary()) for k in ("doc", "windows", "raw", "members", "pos", "later"))])


def _cut(n: int, shards: int, length: int):
    def run(docs: pa.Table, masks: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in _CUT.names}
        if docs.num_rows and masks.num_rows:
            docs, ids, buf, off = ordered(docs)
            chunk = docs.column("__c")[0].as_py()
            lo, count, value, text, row = _runs(buf, off, length)
            u, inv = np.unique(value, return_inverse=True)
            state = np.zeros(len(u), np.uint8)
            mask = dict(zip(masks.column("bucket").to_pylist(), masks.column("mask").to_pylist(), strict=True))
            for b, at in by_bucket(u, n):
                if b in mask:
                    state[at] = np.frombuffer(mask[b], np.uint8)
            s = state[inv]
            parts = [(lo[s == 1], count[s == 1], row[s == 1], text[s == 1], value[s == 1])]
            for level, k in ((2, max(K, int(length * LONGER))), (3, length)):
                at = np.flatnonzero(s == level)
                if len(at):
                    hot, hot_off = buf[ranges(lo[at], count[at] + length - 1)], np.r_[0, np.cumsum(count[at] + length - 1)]
                    sub, sub_count, sub_value, sub_text, run = _runs(hot, hot_off, length, k)
                    parts.append((lo[at][run] + sub - hot_off[run], sub_count, row[at][run], sub_text, sub_value))
            lo, count, row, text, deal = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(lo):
                d = ids[row]
                order = np.lexsort((d, deal, count, text))
                lo, count, text, deal, d = lo[order], count[order], text[order], deal[order], d[order]
                new = np.r_[True, (text[1:] != text[:-1]) | (count[1:] != count[:-1]) | (deal[1:] != deal[:-1])]
                heads = np.flatnonzero(new)
                ends = np.r_[heads[1:], len(lo)]
                later = d > d[np.repeat(heads, ends - heads)]
                for b, at in by_bucket(deal[heads], shards):
                    mine, first = ranges(heads[at], ends[at] - heads[at]), heads[at]
                    raw = buf[ranges(lo[first], count[first] + length - 1)]
                    for k, v in zip(_CUT.names, (b, chunk, to_bytes(d[first]), to_bytes(count[first].astype(np.uint8)), to_bytes(raw), to_bytes((ends[at] - first).astype(np.int32)), to_bytes(lo[mine].astype(np.int32)), to_bytes(later[mine])), strict=True):
                        out[k].append(v)
        release()
        return pa.table(out, schema=_CUT)

    return run


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+size[0]-1, start[1] .. and so on."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _least(raw: np.ndarray, off: np.ndarray, windows: np.ndarray, doc: np.ndarray, length: int, block: int) -> np.ndarray:
    """Of each window of each string, the smallest document that has it."""
    out = np.empty(int(windows.sum()), np.int64)
    wins = np.r_[0, np.cumsum(windows)]
    found, a = [], 0
    while a < len(windows):
        b = max(a + 1, int(np.searchsorted(off, off[a] + block, "right")) - 1)
        t = raw[off[a] : off[b]]
        at = ranges(off[a:b] - off[a], windows[a:b])
        number = np.full(len(t), -1, np.int64)
        number[at] = np.arange(wins[a], wins[b])
        owner = np.repeat(doc[a:b], windows[a:b])
        sa, key8 = suffix_array(t)
        group = np.cumsum(common_prefixes(t, sa, key8) < length)
        is_window = number[sa] >= 0
        sa, group = sa[is_window], group[is_window]
        heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        least = np.minimum.reduceat(owner[number[sa] - wins[a]], heads)
        found.append((number[sa], np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(sa)])), least, t, sa[heads]))
        a = b
    if len(found) > 1:
        text = [np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(t, length)[at]).view(f"S{length}").ravel() for _, _, _, t, at in found]
        alone = [x[2].copy() for x in found]
        for i in range(len(found)):
            for j in range(len(found)):
                if i != j:
                    at = np.minimum(np.searchsorted(text[j], text[i]), len(text[j]) - 1)
                    same = np.flatnonzero(text[j][at] == text[i])
                    found[i][2][same] = np.minimum(found[i][2][same], alone[j][at[same]])
    for number, group, least, _, _ in found:
        out[number] = least[group]
    return out


def _sort(length: int, block: int):
    def run(rows: pa.Table) -> pa.Table:
        read = lambda k, kind: [np.frombuffer(x, kind) for x in rows.column(k).to_pylist()]
        docs, windows, members, pos, later = read("doc", np.int64), read("windows", np.uint8), read("members", np.int32), read("pos", np.int32), read("later", bool)
        doc, count = np.concatenate(docs), np.concatenate(windows).astype(np.int64)
        raw = np.concatenate(read("raw", np.uint8))
        off = np.r_[0, np.cumsum(count + length - 1)]
        roll, key = None, np.empty(len(doc), np.uint64)
        for a in range(0, len(doc), 1 << 13):
            b = min(len(doc), a + (1 << 13))
            roll = Rolling(raw[off[a] : off[b]])
            key[a:b] = roll.of(off[a:b] - off[a], off[a + 1 : b + 1] - off[a])
        del roll
        order = np.lexsort((doc, count, key))
        new = np.r_[True, (key[order][1:] != key[order][:-1]) | (count[order][1:] != count[order][:-1])]
        heads = order[np.flatnonzero(new)]
        inv = np.empty(len(doc), np.int64)
        inv[order] = np.cumsum(new) - 1
        text, text_off = gather(raw, off, heads)
        del raw
        least = _least(text, text_off, count[heads], doc[heads], length, block)
        win_off = np.r_[0, np.cumsum(count[heads])]
        chunks, starts, sizes = [], [], []
        begin = 0
        for c, d, m, p, late in zip(rows.column("chunk").to_pylist(), docs, members, pos, later, strict=True):
            own = inv[begin : begin + len(d)]
            begin += len(d)
            n = count[heads][own]
            value, off_w = gather(least, win_off, own)
            gone = value < np.repeat(d, n)
            edge = np.zeros(len(gone), bool)
            edge[off_w[:-1]] = True
            first = gone.copy()
            first[1:] &= ~gone[:-1] | edge[1:]
            last = gone.copy()
            last[:-1] &= ~gone[1:] | edge[1:]
            a, z = np.flatnonzero(first), np.flatnonzero(last)
            string = np.searchsorted(off_w, a, "right") - 1
            a, z = a - off_w[string], z - off_w[string]
            span_off = np.searchsorted(string, np.arange(len(d) + 1))
            which = np.repeat(np.arange(len(d)), m)
            whole, part = late, np.flatnonzero(~late)
            k = span_off[which[part] + 1] - span_off[which[part]]
            at = ranges(span_off[which[part]], k)
            starts.append(to_bytes(np.r_[p[whole], np.repeat(p[part], k) + a[at]].astype(np.int32)))
            sizes.append(to_bytes(np.r_[n[which[whole]] + length - 1, z[at] - a[at] + length].astype(np.int32)))
            chunks.append(c)
        release()
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "starts": pa.array(starts, pa.binary()), "sizes": pa.array(sizes, pa.binary())})

    return run


def _drop(carry: tuple[str, ...], with_text: bool):
    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        docs, _, buf, off = ordered(docs)
        step = np.zeros(len(buf) + 1, np.int32)
        for s, n in zip(spans.column("starts").to_pylist(), spans.column("sizes").to_pylist(), strict=True):
            s, n = np.frombuffer(s, np.int32), np.frombuffer(n, np.int32)
            np.add.at(step, s, 1)
            np.add.at(step, s + n, -1)
        gone = np.cumsum(step)[:-1] > 0
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        inner = off[(off > 0) & (off < len(buf))]
        first[inner] = gone[inner]
        count = lambda x: np.diff(np.r_[0, np.cumsum(x)][off])
        removed, kept = count(gone), buf[~gone].tobytes()
        ends = np.r_[0, np.cumsum(np.diff(off) - removed)]
        texts = [kept[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        out = {c: docs.column(c) for c in carry} | {"__id": docs.column("__id"), "__bytes": pa.array(np.diff(off)), "__removed": pa.array(removed), "__spans": pa.array(count(first))}
        out["__sha"] = pa.array([hashlib.sha256(x).hexdigest() for x in texts])
        if with_text:
            out["__kept"] = pa.array([x.decode("utf-8", "ignore") for x in texts])
        release()
        return pa.table(out)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False, carry: tuple[str, ...] = (), hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """__id, __bytes, __removed, __spans, __sha (of the remaining bytes) of each row; on request __kept, the remaining text without
    characters cut in two, and __carry, a struct of other columns, whatever their names."""
    packed = ("__carry",) if carry else ()
    rows = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"), *[F.struct(*[F.col(f"`{c}`") for c in carry]).alias(x) for x in packed])
    own, n = chunked(rows, "i", "t", packed)
    shards = 2 * n
    tasks = spread(docs, n * CHUNK)
    by_chunk = own.repartition(tasks, "__c").groupBy("__c")
    index = by_chunk.applyInArrow(_index(n, length), "bucket long, chunk long, hashes binary, info binary")
    masks = index.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_shared(hot), "chunk long, bucket long, mask binary")
    cut = by_chunk.cogroup(masks.repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(_cut(n, shards, length), "shard long, chunk long, doc binary, windows binary, raw binary, members binary, pos binary, later binary")
    spans = cut.repartition(tasks, "shard").groupBy("shard").applyInArrow(_sort(length, block), "chunk long, starts binary, sizes binary")
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in [*packed, "__id"]), "__bytes long, __removed long, __spans long, __sha string", *["__kept string"] * with_text])
    return by_chunk.cogroup(spans.repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(_drop(packed, with_text), schema)
