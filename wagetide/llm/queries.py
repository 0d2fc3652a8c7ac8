"""One query for each operator, over its whole table, and SQL where it can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, lm, mixing, near, quality, sketches, slots, suffix
from .common import table


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.groups(table(spark, sf_dir, "documents"))


def op2_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("__id").alias("doc_id"), F.col("__bytes").alias("n_bytes"), F.col("__removed").alias("n_removed"), F.col("__spans").alias("n_spans"), F.col("__sha").alias("kept_sha256"))


def op3_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = slots.shard_and_grow(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version", "next_shard")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), with_ids=False)


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op7_stable_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op8_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bloom_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_order_minhash, op2_suffix_arrays, op3_snapshot_collapse, op4_virtual_slots, op5_bpe,
        op6_context_mixing, op7_stable_projections, op8_fair_queueing, op9_quality, op10_bloom_sketches,
    )
}

ORACLES = {
    "op2_suffix_arrays": r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT doc_id, b, octet_length(b) AS size FROM d),
w AS (SELECT doc_id, i, array_slice(b, i, i + 49) AS s FROM (SELECT doc_id, b, unnest(range(1, size - 48)) AS i FROM n WHERE size >= 50)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
gone AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true) AS fresh FROM w JOIN f USING (s) WHERE least < doc_id),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (SELECT *, sum(fresh::int) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM gone) GROUP BY doc_id, k),
gaps AS (
  SELECT n.doc_id, r.a, array_slice(b, coalesce(lag(r.z) OVER (PARTITION BY n.doc_id ORDER BY r.a), 1), r.a - 1) AS piece FROM n JOIN runs r USING (doc_id)
  UNION ALL SELECT n.doc_id, 1::bigint << 40, array_slice(b, coalesce(z, 1), size) FROM n LEFT JOIN (SELECT doc_id, max(z) AS z FROM runs GROUP BY doc_id) USING (doc_id)),
kept AS (SELECT doc_id, sha256(unhex(string_agg(hex(piece), '' ORDER BY a))) AS kept_sha256 FROM gaps GROUP BY doc_id),
sums AS (SELECT doc_id, sum(z - a)::bigint AS n_removed, count(*)::bigint AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, size::bigint AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0)::bigint AS n_spans, kept_sha256 FROM n JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
""",
    "op3_snapshot_collapse": r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT conv_id, turn, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line, text FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM s),
p AS (SELECT conv_id, pos, n_turns, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY pos) AS sofar FROM n),
w AS (SELECT sofar, min(conv_id) AS conv_id, max(n_turns) AS n_turns, count(*) AS copies FROM p WHERE pos = n_turns GROUP BY sofar),
cut AS (SELECT DISTINCT sofar, pos FROM p WHERE pos < n_turns)
SELECT conv_id, n_turns::bigint AS n_turns, copies::bigint AS copies, 0::int AS part, sofar AS text
FROM w ANTI JOIN cut ON w.sofar = cut.sofar AND w.n_turns = cut.pos
""",
    "op8_fair_queueing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size,
         md5('mix' || coalesce(doc_id::varchar, '')) AS o FROM documents),
per AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS r FROM per),
weighed AS (SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM ranked),
lev AS (
  SELECT *, 3 * source_size::double / w AS filled,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size::double / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::double
         / (sum(w) OVER (ORDER BY 3 * source_size::double / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::double AS level FROM weighed),
goal AS (
  SELECT source, source_size,
         CASE WHEN l IS NULL OR filled <= l THEN (3 * source_size)::double ELSE w * l END AS target
  FROM lev, (SELECT arg_min(level, filled) AS l FROM lev WHERE filled > level)),
placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY o, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING)::bigint AS e, row_number() OVER () AS k
  FROM d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
items AS (
  SELECT k, size, (n * source_size + e)::double / target AS f FROM placed, (SELECT unnest([0, 1, 2]) AS n) WHERE size > 0 AND target > 0),
summed AS (SELECT k, sum(size) OVER (ORDER BY f RANGE UNBOUNDED PRECEDING) AS upto FROM items WHERE f < 2),
took AS (SELECT k, count(*) AS copies FROM summed WHERE upto <= (SELECT sum(size) FROM d) GROUP BY k)
SELECT doc_id, size, source_size, target, coalesce(copies, 0)::int AS copies, (size * coalesce(copies, 0))::bigint AS taken
FROM placed LEFT JOIN took USING (k)
""",
}
