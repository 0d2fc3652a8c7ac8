"""Chat formatting: cumulative snapshots collapse to the longest conversations, which are rendered for training.

Logs often hold a conversation again after every turn. A rolling hash of the turns so far, 128 bits taken over place, role and text,
names every prefix; a conversation whose last hash is a proper prefix of another is a snapshot of it, and an anti-join on the distinct
prefixes drops it. Of equal conversations the one of smallest id stays. Text is shuffled once, after that.

Turns stand in the order of turn, role and text; equal rows of a conversation count once. Null roles and texts count as empty, null
turns come first, a null conversation id is a conversation like any other and the last among equals. Conversations are rendered in
parts of at most PART turns, so no task ever holds more of one; usually that is one part. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

PART = 256


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, h1, h2 (of role and text), pos, and p1, p2: the hash of the turns up to pos."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = conversations.select("conv_id", "turn", role.alias("role"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), text, role).alias("h2"))
    t = t.dropDuplicates(["conv_id", "turn", "role", "h1", "h2"])
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "h1", "h2")
    t = t.withColumn("pos", F.row_number().over(order) - 1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rolled = lambda h, s: F.bit_xor(F.xxhash64(F.lit(s), "pos", h)).over(upto)
    return t.withColumn("p1", rolled("h1", 2)).withColumn("p2", rolled("h2", 3))


def maximal(t: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies of each conversation that stays."""
    size = Window.partitionBy("conv_id")
    t = t.withColumn("n_turns", F.count("*").over(size))
    whole = t.filter("pos = n_turns - 1").groupBy("p1", "p2").agg(F.min(F.struct(F.col("conv_id").isNull().alias("z"), "conv_id")).alias("_c"), F.max("n_turns").alias("n_turns"), F.count("*").alias("copies"))
    prefixes = t.filter("pos < n_turns - 1").select("p1", "p2").distinct()
    return whole.join(prefixes, ["p1", "p2"], "left_anti").select("_c.conv_id", "n_turns", "copies")


def render(conversations: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, n_turns, copies, part, text of each conversation that stays: <|role|>, a line break, the text, <|end|>, a line break
    for each turn."""
    t = staged(turns(conversations), "turns")
    kept = staged(maximal(t), "conversations")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select(F.col("conv_id").alias("c"), F.col("turn").alias("n"), role.alias("r"), text.alias("x"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"))
    same = F.col("c").eqNullSafe(F.col("conv_id")) & F.col("n").eqNullSafe(F.col("turn")) & (F.col("a") == F.col("h1")) & (F.col("b") == F.col("h2"))
    places = t.join(kept.withColumnRenamed("conv_id", "k"), F.col("conv_id").eqNullSafe(F.col("k"))).select("conv_id", "turn", "h1", "h2", "pos", "n_turns", "copies")
    said = rows.join(places, same).groupBy("conv_id", "n_turns", "copies", F.floor(F.col("pos") / part).cast("int").alias("part"))
    # equal rows of a conversation meet in one place
    lines = said.agg(F.array_sort(F.collect_set(F.struct("pos", "r", "x"))).alias("l"))
    line = F.transform("l", lambda s: F.concat(F.lit("<|"), s["r"], F.lit("|>\n"), s["x"], F.lit("<|end|>\n")))
    return lines.select("conv_id", "n_turns", "copies", "part", F.array_join(line, "").alias("text"))
