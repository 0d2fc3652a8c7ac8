"""UK bank holidays by rule, and working days as two small dimension tables: their size is fixed by the years that they span, which
dates of the form YYYY-MM-DD bound."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_REGION, REGIONS

#: Years that every calendar has. Others are added as the data have them.
YEARS = (1990, 2040)
DAY = timedelta(days=1)


def easter(year: int) -> date:
    """Gregorian Easter Sunday from the golden number and the moon's age."""
    golden, century = year % 19, year // 100
    epact = (century - century // 4 - (8 * century + 13) // 25 + 19 * golden + 15) % 30
    moon = epact - (epact // 28) * (1 - (epact // 28) * (29 // (epact + 1)) * ((21 - golden) // 11))
    weekday = (year + year // 4 + moon + 2 - century + century // 4) % 7
    offset = moon - weekday
    month = 3 + (offset + 40) // 44
    return date(year, month, offset + 28 - 31 * (month // 4))


def _nth_monday(year: int, month: int, last: bool = False) -> date:
    d = date(year, month, 1)
    d += DAY * (-d.weekday() % 7)
    while last and (d + 7 * DAY).month == month:
        d += 7 * DAY
    return d


def holidays(year: int, region: str = DEFAULT_REGION) -> set[date]:
    """Bank holidays of a region with their substitute days. The rules are those in force since 1978; of earlier years only the first
    years of single holidays are known here."""
    fixed = [date(year, 1, 1)] if region == "Scotland" or year >= 1974 else []
    if region == "Scotland":
        fixed += [date(year, 1, 2)] + [date(year, 11, 30)] * (year >= 2007)
    if region == "NorthernIreland":
        fixed += [date(year, 3, 17), date(year, 7, 12)]
    fixed += [date(year, 12, 25)] + [date(year, 12, 26)] * (region != "Scotland" or year >= 1974)
    out = {easter(year) - 2 * DAY}
    if region != "Scotland":
        out.add(easter(year) + DAY)
    # moved and single holidays; fixed values
    if year >= 1978:
        out.add({1995: date(1995, 5, 8), 2020: date(2020, 5, 8)}.get(year, _nth_monday(year, 5)))
    out.add({1977: date(1977, 6, 6), 2002: date(2002, 6, 4), 2012: date(2012, 6, 4), 2022: date(2022, 6, 2)}.get(year, _nth_monday(year, 5, last=True)))
    out.add(_nth_monday(year, 8, last=region != "Scotland"))
    single = (date(1977, 6, 7), date(1981, 7, 29), date(1999, 12, 31), date(2002, 6, 3), date(2011, 4, 29), date(2012, 6, 5), date(2022, 6, 3), date(2022, 9, 19), date(2023, 5, 8))
    out |= {d for d in single if d.year == year}
    for d in fixed:  # a holiday on a weekend moves to the next free weekday
        while d in out or d.weekday() > 4:
            d += DAY
        out.add(d)
    return out


def _blocks(years: Iterable[int]) -> list[tuple[int, int]]:
    """Years in a row, as first and last."""
    out: list[tuple[int, int]] = []
    for y in sorted(set(years)):
        out = [*out[:-1], (out[-1][0], y)] if out and out[-1][1] == y - 1 else [*out, (y, y)]
    return out


class Calendar:
    """Holidays that regions gain and lose ({region: {add: [...], remove: [...]}}), and the years that the tables hold."""

    def __init__(self, overrides: dict[str, dict[str, list[str]]] | None = None, years: Iterable[int] = ()):
        self.overrides = overrides or {}
        self.blocks = _blocks([*range(YEARS[0], YEARS[1] + 1), *(y for y in years if 1 <= y <= 9999)])
        self.key = (repr(sorted(self.overrides.items())), tuple(self.blocks))

    @classmethod
    def of(cls, dates: DataFrame, keys: list[str], col: str, overrides: dict | None = None) -> Calendar:
        """With all years from the first to the last date of each group, so that no span has a gap. What is collected are years."""
        spans = dates.groupBy(*keys).agg(F.year(F.min(col)).alias("a"), F.year(F.max(col)).alias("z")).filter(F.col("a").isNotNull())
        years = spans.select("a", "z").distinct().select(F.explode(F.sequence("a", "z")).alias("y")).distinct()
        return cls(overrides, [r["y"] for r in years.collect()])


def _days(first: int, last: int, region: str, change: dict) -> pd.DataFrame:
    """Days of some years in a row, from what lies half a month around them too."""
    begin, end = date(first, 1, 1), date(last, 12, 31)
    around = [begin - k * DAY for k in range(min(16, begin.toordinal() - 1), 0, -1)]
    days = [*around, *(date.fromordinal(k) for k in range(begin.toordinal(), end.toordinal() + 1)), *(end + k * DAY for k in range(1, min(16, date.max.toordinal() - end.toordinal()) + 1))]
    off = {d for y in range(max(1, first - 1), min(9999, last + 1) + 1) for d in holidays(y, region)}
    off = (off | {date.fromisoformat(str(x)) for x in change.get("add", [])}) - {date.fromisoformat(str(x)) for x in change.get("remove", [])}
    n = pd.Series([d.toordinal() for d in days])
    t = pd.DataFrame({"region": region, "d": days, "n": n, "month": [d.replace(day=1) for d in days]})
    weekday, free = (n - 1) % 7 < 5, t.d.isin(off)
    t["holiday"], t["working"] = free, weekday & ~free
    on = n.where(t.working)
    t["prev"], t["next"] = on.ffill(), on.bfill()
    t["nearest"] = t.prev.where(~(n - t.prev > t.next - n), t.next)
    closed = weekday & free
    t["adjacent"] = closed.shift(1, fill_value=False) | closed.shift(-1, fill_value=False)
    return t[(t.d >= begin) & (t.d <= end)]


_TABLES: dict[tuple, tuple[pd.DataFrame, pd.DataFrame]] = {}


def tables(calendar: Calendar | None = None) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Days (region, d, working, prev, next, nearest, adjacent) and months (region, month, last_day, last_working, first_working)."""
    calendar = calendar or Calendar()
    if calendar.key in _TABLES:
        return _TABLES[calendar.key]
    as_date = lambda x: None if pd.isna(x) else date.fromordinal(int(x))
    made, months = [], []
    for region in REGIONS:
        t = pd.concat([_days(a, z, region, calendar.overrides.get(region) or {}) for a, z in calendar.blocks])
        by, open_ = t.groupby("month").n, t[t.working].groupby("month").n
        m = pd.DataFrame({"last_day": by.max(), "last_working": open_.max(), "first_working": open_.min()})
        months.append(pd.DataFrame({"region": region, "month": list(m.index), **{c: m[c].map(as_date).to_numpy() for c in m}}))
        made.append(t.assign(**{c: t[c].map(as_date) for c in ("prev", "next", "nearest")})[["region", "d", "holiday", "working", "prev", "next", "nearest", "adjacent"]])
    _TABLES[calendar.key] = pd.concat(made, ignore_index=True), pd.concat(months, ignore_index=True)
    return _TABLES[calendar.key]


_FRAMES: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def frames(spark: SparkSession, calendar: Calendar | None = None) -> tuple[DataFrame, DataFrame]:
    """The two tables as DataFrames, marked for broadcast: 1,096 and 36 rows a year, whatever the input."""
    calendar = calendar or Calendar()
    key = (spark.sparkContext.applicationId, calendar.key)
    if key not in _FRAMES:
        # written as Arrow, which takes a tenth of the time that rows take
        _FRAMES[key] = tuple(spark.createDataFrame(pa.Table.from_pandas(t, preserve_index=False)) for t in tables(calendar))
    days, months = _FRAMES[key]
    return F.broadcast(days), F.broadcast(months)


def region(c: Column) -> Column:
    """Unknown and missing regions count as England and Wales."""
    return F.when(c.isin(*REGIONS), c).otherwise(F.lit(DEFAULT_REGION))


def list_holidays(spark: SparkSession, region_name: str, year: int) -> DataFrame:
    days, _ = frames(spark, Calendar(years=[year]))
    return days.filter((F.col("region") == region_name) & (F.year("d") == year) & F.col("holiday")).select("d").orderBy("d")
