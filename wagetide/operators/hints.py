"""Payslip anchors and the expected salary band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import AMOUNT
from .validation import parsed_amount

TOLERANCE = 0.20


def payslips(analyses: DataFrame) -> DataFrame:
    """analysis_id, hint_pos, month, amount, hint_id of each payslip hint."""
    h = analyses.select("analysis_id", F.posexplode("payslip_hints").alias("hint_pos", "h"))
    given = F.when(F.coalesce("h.hint_id", F.lit("")) != "", F.col("h.hint_id"))
    return h.select("analysis_id", "hint_pos", F.col("h.month").alias("month"), parsed_amount(F.col("h.amount")).alias("amount"), F.coalesce(given, F.concat_ws("_", F.lit("hint"), "h.month", "h.amount")).alias("hint_id"))


def anchors(credits: DataFrame, slips: DataFrame) -> DataFrame:
    """Credits of a hint's month with exactly its amount; ambiguous where a hint has several."""
    c = credits.select("analysis_id", "pos", F.col("id").alias("transaction_id"), F.date_format("date", "yyyy-MM").alias("month"), "amount")
    hit = slips.join(c, ["analysis_id", "month", "amount"])
    return hit.withColumn("ambiguous", F.count("*").over(Window.partitionBy("analysis_id", "hint_pos")) > 1)


def unmatched(slips: DataFrame, found: DataFrame) -> DataFrame:
    return slips.join(found.select("analysis_id", "hint_pos").distinct(), ["analysis_id", "hint_pos"], "left_anti")


def unmatched_warnings(missed: DataFrame, found: DataFrame) -> DataFrame:
    """Stage 3; only analyses in which another hint matched say so."""
    some = found.select("analysis_id").distinct()
    return missed.join(some, "analysis_id", "left_semi").select(
        "analysis_id", F.lit(3).alias("stage"), F.col("hint_pos").cast("long").alias("seq"), F.lit("hint_unmatched").alias("code"), F.lit("").alias("transaction_id"),
        F.concat(F.lit("no credit has the month and amount of payslip hint '"), "hint_id", F.lit("'")).alias("detail"),
    )


def flagged(credits: DataFrame, found: DataFrame) -> DataFrame:
    """Credits with is_anchor, the last hint that they match, whether it is ambiguous, and how many anchors they are."""
    by = found.groupBy("analysis_id", "pos").agg(F.max_by("hint_id", "hint_pos").alias("anchor_hint_id"), F.max("ambiguous").alias("anchor_ambiguous"), F.count("*").alias("n_anchors"))
    out = credits.join(by, ["analysis_id", "pos"], "left")
    return out.withColumns({"is_anchor": F.col("n_anchors").isNotNull(), "n_anchors": F.coalesce("n_anchors", F.lit(0))})


def expected(monthly: str, yearly: str, tolerance: str) -> str:
    """SQL of a struct of the expected monthly amount and its band, null without hints."""
    e, t = f"coalesce(cast({monthly} as double), cast({yearly} as double) / 12)", f"coalesce({tolerance}, {TOLERANCE}D)"
    return f"if({e} is null, null, named_struct('monthly', {e}, 'lower', {e} * (1 - {t}), 'upper', {e} * (1 + {t})))"


def band() -> Column:
    """The band of an analysis, from its salary_hints."""
    number = lambda f, kind=AMOUNT: f"try_cast(salary_hints.{f} as {kind})"
    return F.expr(expected(number("approx_monthly"), number("approx_yearly"), number("tolerance_pct", "double"))).alias("band")


def modifier(median: str, band: str) -> str:
    """SQL: 1 inside the band or without one; outside it falls to a half over one expected amount."""
    out = f"greatest({band}.lower - {median}, {median} - {band}.upper, 0D)"
    return f"if({band} is null or {out} <= 0, 1D, greatest(0.5D, least(1D, 1 - 0.5D * {out} / nullif({band}.monthly, 0D))))"
