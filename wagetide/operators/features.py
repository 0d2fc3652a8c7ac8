"""Normalised credits with their features: all columns of one table, built from expressions and one broadcast of the calendar."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text, workdays
from ..functions.literals import constant, lookup, strings
from .validation import CURRENCY

#: Lower ends of the amount bands; fixed values.
BANDS = ((0, "under_100"), (100, "100_to_500"), (500, "500_to_1500"), (1500, "1500_to_3000"), (3000, "3000_to_6000"), (6000, "over_6000"))
PAYROLL_HINTS = ("PAYROLL", "SALARY", "WAGES", "WAGE", "STAFF PAY", "MONTHLY PAY")
STRONG_HINTS = ("PAYROLL", "SALARY", "WAGES", "WAGE")


#: A caller's features: (normalised text, tokens, configuration) to columns by name, which replace or join those made here.
Extractor = Callable[[Column, Column, Config], dict[str, Column]]


def normalise(checked: DataFrame) -> DataFrame:
    """Accepted credits: typed columns, normalised text, tokens, skeleton."""
    rows = checked.filter("status is null").select(
        "analysis_id", "pos", "id", F.col("day").alias("date"), F.col("value").alias("amount"), F.lit("credit").alias("direction"), F.col("text").alias("description"),
        "reference", "counterparty_name", "transaction_code", "source_bank", F.coalesce("currency", F.lit(CURRENCY)).alias("currency"),
    )
    rows = rows.withColumn("normalised", text.normalised(F.col("description"))).withColumn("tokens", text.tokens(F.col("normalised")))
    return rows.withColumn("skeleton", text.skeleton(F.col("tokens")))


def _found(normal: Column, phrases: list[tuple[str, str]]) -> Column:
    """Those of the (kind, phrase) pairs that the text has, in their order."""
    kind = "array<struct<kind:string,phrase:string,words:int,ord:int,key:string>>"
    every = constant([{"kind": k, "phrase": p, "words": p.count(" ") + 1, "ord": i, "key": f" {p} "} for i, (k, p) in enumerate(phrases)], kind)
    padded = F.array(F.concat(F.lit(" "), normal, F.lit(" ")))
    return F.get(F.transform(padded, lambda t: F.filter(every, lambda p: t.contains(p["key"]))), F.lit(0))


def channel(normal: Column, config: Config) -> Column:
    """Struct of channel, confidence, matched phrases, other channels: the longest phrase wins, then the first."""
    hits = _found(normal, config.channel_phrases())
    first = lambda h: F.array_max(F.transform(h, lambda x: F.struct(x["words"].alias("words"), (-x["ord"]).alias("ord"), x["kind"].alias("kind"))))
    best, extra = first(hits), 0.05 if config.get("source_bank") is not None else 0.0
    sure = F.least(F.lit(1.0), 0.55 + 0.15 * (best["words"] - 1)) + extra
    confidence = F.when(normal == "", 0.0).when(best.isNull(), 0.30).otherwise(F.least(F.lit(1.0), sure))
    names = F.array_sort(F.array_distinct(F.transform(hits, lambda x: x["kind"])))
    return F.struct(
        F.coalesce(best["kind"], F.lit("unknown_credit")).alias("channel"),
        confidence.alias("confidence"),
        F.array_sort(F.array_distinct(F.transform(hits, lambda x: x["phrase"]))).alias("matched_tokens"),
        F.when(best.isNull(), names).otherwise(F.array_remove(names, best["kind"])).alias("alternative_channels"),
    )


def hints(normal: Column, toks: Column, config: Config) -> Column:
    """Salary hints, each once: longer phrases first, then single words as the text has them."""
    several = [x for x in config.hint_phrases() if " " in x[1]]
    single = [p for _, p in config.hint_phrases() if " " not in p]
    words = F.filter(F.array_distinct(toks), lambda t: text.among(t, single)) if single else F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.transform(_found(normal, several), lambda x: x["phrase"]), words))


def hint_strengths(found: Column, config: Config) -> Column:
    strengths = {}
    for s, p in config.hint_phrases():
        strengths[p] = s
    return F.map_from_arrays(found, F.transform(found, lambda h: lookup(strengths, h)))


def employers(toks: Column, found: Column, config: Config) -> Column:
    """Tokens that may name an employer, each once in text order."""
    pieces = {w for _, p in config.channel_phrases() for w in p.split(" ")}
    stop = {*text.STOP_WORDS, *text.CHANNEL_CODES, *text.ROLE_WORDS, *text.LEGAL_FORMS, *pieces}
    return F.filter(F.array_distinct(toks), lambda t: ~text.among(t, sorted(stop)) & ~F.array_contains(found, t) & ~t.rlike("^[0-9]+$") & (F.length(t) >= 2))


def band(amount: Column) -> Column:
    lows = constant([low for low, _ in BANDS], "array<int>")
    return F.get(strings(n for _, n in BANDS), F.size(F.filter(lows, lambda x: F.abs(amount) >= x)) - 1)


def extract(rows: DataFrame, config: Config, region: Column | None = None, calendar: workdays.Calendar | None = None, channels: Extractor | None = None, descriptions: Extractor | None = None) -> DataFrame:
    """All features of normalised credits. region: the analysis's region, on rows (column region) by default. Dates in years that the
    calendar does not have get no flags; Calendar.of finds the years. channels may replace channel_match (a struct like channel()'s),
    descriptions salary_hints, hint_strengths, negatives, negative_categories and employers."""
    n, t = F.col("normalised"), F.col("tokens")
    own = {**(channels(n, t, config) if channels else {}), **(descriptions(n, t, config) if descriptions else {})}
    rows = rows.withColumns({"channel_match": own.pop("channel_match") if "channel_match" in own else channel(n, config), "salary_hints": own.pop("salary_hints") if "salary_hints" in own else hints(n, t, config), "_neg": _found(n, config.negative_phrases())})
    rows = rows.withColumns({
        "channel": F.col("channel_match.channel"),
        "hint_strengths": hint_strengths(F.col("salary_hints"), config),
        "negatives": F.array_distinct(F.transform("_neg", lambda x: x["phrase"])),
        "negative_categories": F.array_distinct(F.transform("_neg", lambda x: x["kind"])),
        "employers": employers(t, F.col("salary_hints"), config),
        "amount_band": band(F.col("amount")),
        "amount_whole": F.abs(F.col("amount")).cast("long"),
        "month": F.trunc("date", "MM"),
        "day": F.dayofmonth("date"),
        "weekday": F.weekday("date"),
        "is_month_end": F.last_day("date") == F.col("date"),
        **own,
    }).drop("_neg")
    days, months = workdays.frames(rows.sparkSession, calendar)
    rows = rows.withColumn("_region", workdays.region(region if region is not None else F.col("region")))
    days = days.select(F.col("region").alias("_region"), F.col("d").alias("date"), F.col("adjacent").alias("_adjacent"))
    months = months.select(F.col("region").alias("_region"), "month", "last_working", "first_working")
    rows = rows.join(days, ["_region", "date"], "left").join(months, ["_region", "month"], "left")
    flags = {"is_last_working_day": F.col("date") == F.col("last_working"), "is_first_working_day": F.col("date") == F.col("first_working"), "is_holiday_adjacent": F.col("_adjacent")}
    return rows.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}).drop("_region", "_adjacent", "last_working", "first_working")
