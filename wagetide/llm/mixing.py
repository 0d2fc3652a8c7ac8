"""Mixing sources to target weights by weighted fair queueing.

Within its source each document, in shuffled order, gets the virtual finish time (words of the source up to its end) / (the source's
target); a source whose target exceeds its size comes round again, up to MOST times. The mix takes what finishes first, over all
sources, until the total budget is used: items are dealt into fixed ranges of virtual time, the range in which the budget ends is
found from the ranges' sums, and only that range is looked at item by item. Prefix sums run in two levels (source and bucket of
the shuffled order, then inside a bucket), so a source of any share is spread over all tasks.

Null text counts as no words, null is a source of its own and the last. Sources without words and documents without words take
nothing. Repeated rows are documents of their own, ordered by size; rows of one id and size are equal and may stand either way.
Items of equal finish time go in or stay out together. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, staged, text_of

WEIGHTS = (5, 2, 1)
MOST = 3
RANGES = 65536


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target. The sources stand in order of code points and weigh as given, in turn; all words are shared
    out by weight, none above most times its source's words: the source with the least room per weight fills up first."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("_r", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_r") % len(weights) + 1).cast("int"))
    room = F.lit(most) * F.col("source_size")
    fill = Window.orderBy(F.col("_full"), F.col("_r"))
    everything = Window.partitionBy()
    shared = (
        ranked.withColumn("_w", weight)
        .withColumn("_full", room / F.col("_w"))
        .withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_used", F.coalesce(F.sum(room).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_left", F.sum("_w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") - F.col("_used")) / F.col("_left"))
        .withColumn("_level", F.min(F.when(F.col("_full") > F.col("_level"), F.struct("_full", "_r", "_level"))).over(everything)["_level"])
    )
    target = F.when(F.col("_level").isNull() | (F.col("_full") <= F.col("_level")), room.cast("double")).otherwise(F.col("_w") * F.col("_level"))
    return shared.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of every document."""
    size = F.regexp_count(text_of(f"`{text_col}`"), F.lit(WORD)).cast("long")
    order = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"))
    rows = staged(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), size.alias("size"), order.alias("_o")).withColumn("_b", F.substring("_o", 1, 3)), "mix-sizes")
    goal = staged(targets(rows, weights, most), "mix-targets")
    sums = rows.groupBy("source", "_b").agg(F.sum("size").alias("_s"))
    earlier = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_s").over(earlier), F.lit(0))).select(F.col("source").alias("_src"), F.col("_b").alias("_bb"), "_before")
    within = Window.partitionBy("source", "_b").orderBy("_o", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_in", F.sum("size").over(within))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_b") == F.col("_bb")), "left")
    placed = placed.withColumn("_end", F.col("_before") + F.col("_in")).drop("_src", "_bb", "_before", "_in", "_b", "_o")
    goal = goal.withColumnRenamed("source", "_src")
    placed = staged(placed.join(goal, F.col("source").eqNullSafe(F.col("_src"))).drop("_src"), "mix-placed")
    finish = lambda e: (F.lit(e) * F.col("source_size") + F.col("_end")).cast("double") / F.when(F.col("target") > 0, F.col("target"))
    items = placed.filter("size > 0").select("size", F.explode(F.array(*map(finish, range(most)))).alias("_f")).filter("_f < 2")
    ranged = items.withColumn("_range", F.floor(F.col("_f") * (RANGES // 2)).cast("int"))
    budget = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("_budget"))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranged.groupBy("_range").agg(F.sum("size").alias("_s")).withColumn("_sum", F.sum("_s").over(upto)).crossJoin(F.broadcast(budget))
    over = ranges.filter("_sum > _budget").agg(F.min(F.struct("_range", (F.col("_sum") - F.col("_s")).alias("_sofar"), "_budget")).alias("_x")).select("_x.*")
    last = ranged.join(F.broadcast(over.withColumnRenamed("_range", "_r")), F.col("_range") == F.col("_r")).groupBy("_f", "_sofar", "_budget").agg(F.sum("size").alias("_s"))
    fits = last.withColumn("_sum", F.col("_sofar") + F.sum("_s").over(Window.orderBy("_f"))).filter("_sum <= _budget").agg(F.max("_f").alias("_fit"))
    # one row: taken is what finishes before the range in which the budget ends, and in that range up to _fit
    cut = over.select(F.col("_range").alias("_at")).crossJoin(F.broadcast(fits))
    in_time = lambda f: (f < 2) & (F.col("_at").isNull() | (f * (RANGES // 2) < F.col("_at")) | (f <= F.coalesce("_fit", F.lit(-1.0))))
    copies = sum((F.coalesce(in_time(finish(e)).cast("int"), F.lit(0)) for e in range(most)), F.lit(0))
    out = placed.crossJoin(F.broadcast(cut)).withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)))
    return out.select("doc_id", "size", "source_size", "target", F.col("copies").cast("int").alias("copies"), (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents that the mix takes, with all their columns, as often as it takes them; documents without words go. Repeated
    rows of one id and size all come as often as the most taken of them."""
    id_, size, times = fresh(docs.columns, "_id", "_size", "_times")
    kept = mix(docs, id_col, text_col, source_col, **how).filter("copies > 0").groupBy(F.col("doc_id").alias(id_), F.col("size").alias(size)).agg(F.max("copies").alias(times))
    words = F.regexp_count(text_of(f"`{text_col}`"), F.lit(WORD)).cast("long")
    own, own_size = fresh([*docs.columns, id_, size, times], "_row", "_words")
    rows = docs.select(F.col(f"`{id_col}`").alias(own), words.alias(own_size), *[F.col(f"`{c}`") for c in docs.columns])
    out = rows.join(kept, F.col(own).eqNullSafe(F.col(id_)) & (F.col(own_size) == F.col(size))).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
