"""Sharding by fixed virtual slots.

A record hashes into one of N_SLOTS virtual slots by its id and its text's checksum, so rows of one id are spread, and only rows equal
in both share a slot. Bytes are summed per slot, and a versioned map gives each slot a shard: heaviest slot first to the lightest shard.
Rebalancing edits the last version: slots leave shards above the tolerance, or all shards in proportion when one is added, and all
others stay. A map has N_SLOTS rows at most, whatever the data's size, so the driver plans it and every executor may hold it.

Null text counts as no bytes, each record one byte more. Repeated rows are records of their own; other columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, text_of

N_SLOTS = 4096


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot."""
    text = text_of(f"`{text_col}`")
    crc = F.crc32(text.cast("binary"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), crc.alias("text_crc32"))
    # a digest that other engines have too: its first 32 bits
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_crc32").cast("binary"))
    return rows.withColumn("virtual_slot", (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % n_slots).cast("int"))


def plan(sizes: dict[int, int], n_shards: int, previous: dict[int, int] | None = None, tolerance: float = 0.02) -> dict[int, int]:
    """The shard of each slot in sizes. previous: the version to edit; only slots that have to move do."""
    load = [0] * n_shards
    out: dict[int, int] = {}
    loose = []
    for slot, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        shard = (previous or {}).get(slot)
        if shard is None or shard >= n_shards:
            loose.append((slot, size))
        else:
            out[slot] = shard
            load[shard] += size
    most = (1 + tolerance) * sum(sizes.values()) / n_shards
    for slot, size in sorted(((s, sizes[s]) for s in out), key=lambda x: (-x[1], x[0])):
        if load[out[slot]] > most and load[out[slot]] - size >= most * (1 - 2 * tolerance):
            load[out.pop(slot)] -= size
            loose.append((slot, size))
    heap = [(x, i) for i, x in enumerate(load)]
    heapq.heapify(heap)
    for slot, size in sorted(loose, key=lambda x: (-x[1], x[0])):
        x, i = heapq.heappop(heap)
        out[slot] = i
        heapq.heappush(heap, (x + size, i))
    return out


def slot_sizes(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot, N_SLOTS entries at most."""
    return {r[0]: (r[1], r[2]) for r in rows.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect()}


def store(spark: SparkSession, path: str, version: int, shards: dict[int, int], sizes: dict[int, tuple[int, int]]) -> None:
    """Writes a version of the map: each slot's shard, bytes, rows, and the rows of its shard in the slots before it."""
    before: dict[int, int] = {}
    rows = []
    for slot in sorted(shards):
        size, n = sizes[slot]
        rows.append((slot, shards[slot], size, n, before.get(shards[slot], 0)))
        before[shards[slot]] = before.get(shards[slot], 0) + n
    kind = "virtual_slot int, shard int, slot_bytes long, slot_rows long, rows_before long"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{path}/version={version}")


def load(spark: SparkSession, path: str, version: int) -> DataFrame:
    kind = "virtual_slot int, shard int, slot_bytes long, slot_rows long, rows_before long"
    return spark.read.schema(kind).parquet(f"{path}/version={version}")


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Each record's shard and its place in it, counted from 0 without gaps, in the order of slot, id, checksum and size."""
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("_n", F.row_number().over(within) - 1)
    return placed.join(F.broadcast(slot_map), "virtual_slot").withColumn("slot", F.col("rows_before") + F.col("_n"))


def grow(spark: SparkSession, path: str, version: int, n_shards: int, sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """Edits that version of the map for n_shards, stores the next one and returns it."""
    previous = {r["virtual_slot"]: r["shard"] for r in load(spark, path, version).select("virtual_slot", "shard").collect()}
    store(spark, path, version + 1, plan({k: v[0] for k, v in sizes.items()}, n_shards, previous), sizes)
    return load(spark, path, version + 1)


def shard_and_grow(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS, path: str | None = None) -> DataFrame:
    """shard(), and next_shard: where each record goes when the stored map is edited for one shard more, as version 2."""
    spark, rows = docs.sparkSession, records(docs, id_col, text_col, n_slots)
    sizes = slot_sizes(rows)
    path = path or shared_path(spark, "slot-map")
    store(spark, path, 1, plan({k: v[0] for k, v in sizes.items()}, n_shards), sizes)
    after = grow(spark, path, 1, n_shards + 1, sizes).select(F.col("virtual_slot").alias("_v"), F.col("shard").alias("next_shard"))
    both = load(spark, path, 1).join(after, F.col("virtual_slot") == F.col("_v")).drop("_v")
    return assign(rows, both).withColumn("map_version", F.lit(1))


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS, path: str | None = None) -> DataFrame:
    """Stores the first version of a map under path and applies it."""
    spark, rows = docs.sparkSession, records(docs, id_col, text_col, n_slots)
    sizes = slot_sizes(rows)
    path = path or shared_path(spark, "slot-map")
    store(spark, path, 1, plan({k: v[0] for k, v in sizes.items()}, n_shards), sizes)
    return assign(rows, load(spark, path, 1)).withColumn("map_version", F.lit(1))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions written to their end under path, oldest first."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "version=*/_SUCCESS")) or []
    return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in done)


def rebalance(docs: DataFrame, path: str, n_shards: int, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """Edits the last version of the map under path for the rows given and n_shards, stores the next version and applies it. Slots move
    only where plan() has to move them; n_slots must be that of the first version. Calls for one path must not overlap."""
    spark, rows = docs.sparkSession, records(docs, id_col, text_col, n_slots)
    known = versions(spark, path)
    if not known:
        raise ValueError(f"no version of a slot map in {path}")
    return assign(rows, grow(spark, path, known[-1], n_shards, slot_sizes(rows))).withColumn("map_version", F.lit(known[-1] + 1))
