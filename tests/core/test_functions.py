import random
import unicodedata
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from wagetide.config import Config, ConfigError, bank_overlay, deep_merge
from wagetide.functions import text, workdays
from wagetide.operators import review, validation
from wagetide.operators.pool import Analysis, signature


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def by_hand(raw):
    s = "".join(c for c in unicodedata.normalize("NFKD", raw) if not unicodedata.combining(c)).upper()
    s = s.replace("PUBLIC LIMITED COMPANY", "PLC").replace("LIMITED", "LTD")
    return " ".join("".join(c if c.isascii() and (c.isalnum()) else " " for c in s).split())


def test_normalised_unicode(spark):
    raw = ["Zürich Straße ﬁn", "½ ﬁve № 9", "ÀÉÎõü ñandú", "ＦＵＬＬ　width", "ACME Public Limited Company", "x² ™ ª", "étude", "日本", "", "ĳ ŉ ﷺ", "\U0001d400CME \U0001d7d9", "a\u0903b c\u20ddd e\u0301\U0001e8d0f"]
    assert column(spark, raw, text.normalised) == [by_hand(x) for x in raw]


def test_skeleton(spark):
    raw = ["ACME LTD REF123456", "REF 123456", "WAGE 12", "ACME PAYMENT ONLINE", "PAY2024 A12345", "__EMPTY__", "...", "12345"]
    want = ["ACME LTD", "__EMPTY__", "WAGE 12", "ACME", "PAY A", "EMPTY", "__EMPTY__", "__EMPTY__"]
    sk = lambda c: text.skeleton(text.tokens(text.normalised(c)))
    first = column(spark, raw, sk)
    assert first == want
    assert column(spark, first[:5:2], sk) == first[:5:2]


def test_sequences_and_patterns(spark):
    r = random.Random(1)
    pairs = [[r.choices("abc", k=r.randint(0, 6)), r.choices("abc", k=r.randint(0, 6))] for _ in range(40)]

    def lcs(a, b):
        return 0 if not a or not b else 1 + lcs(a[:-1], b[:-1]) if a[-1] == b[-1] else max(lcs(a[:-1], b), lcs(a, b[:-1]))

    got = column(spark, pairs, lambda c: text.lcs_length(c[0], c[1]), "array<array<string>>")
    assert got == [lcs(a, b) for a, b in pairs]
    sets = [["SALARY ACME 1 UK", "SALARY ACME 22 UK", "other"], ["ab", "ac"], ["prefix long x", "prefix long y"], [], ["", None]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, s array<string>")
    out = {r["i"]: r["pattern"] for r in text.with_pattern(df, "s", 0.5, 8).collect()}
    assert out[0]["prefix"] + "*" + out[0]["suffix"] == "SALARY ACME * UK" == signature(sets[0], 0.5) and out[1] is out[3] is out[4] is None
    assert out[2]["prefix"] == "prefix long "
    assert text.longest_common_substring("xxabcdyy", "zabcdz") == "abcd" and text.longest_common_substring("a", "") == ""


def test_working_days():
    days, months = workdays.tables()
    by = {(r.region, r.d): r for r in days[days.d >= date(2024, 1, 1)].itertuples() if r.d.year == 2024}
    off = workdays.holidays(2024)
    for (region, d), r in by.items():
        if region != "EnglandAndWales" or not date(2024, 1, 10) < d < date(2024, 12, 20):
            continue
        works = lambda x: x.weekday() < 5 and x not in off
        back = next(d - timedelta(k) for k in range(60) if works(d - timedelta(k)))
        on = next(d + timedelta(k) for k in range(60) if works(d + timedelta(k)))
        assert (r.prev, r.next, r.nearest) == (back, on, back if d - back <= on - d else on)
        near = [x for x in (d - timedelta(1), d + timedelta(1)) if x.weekday() < 5 and not works(x)]
        assert r.adjacent == bool(near)
    assert date(2022, 9, 19) in workdays.holidays(2022, "Scotland") and date(2021, 12, 28) in workdays.holidays(2021)
    assert date(2024, 7, 12) in workdays.holidays(2024, "NorthernIreland") and date(2024, 4, 1) not in workdays.holidays(2024, "Scotland")
    other, _ = workdays.tables(workdays.Calendar({"Scotland": {"add": ["2024-06-03"], "remove": ["2024-01-02"]}}))
    s = other[other.region == "Scotland"].set_index("d").working
    assert not s[date(2024, 6, 3)] and s[date(2024, 1, 2)]


def test_calendar_of_any_years():
    c = workdays.Calendar(years=[1, 1985, 1986, 2043, 9999])
    assert c.blocks == [(1, 1), (1985, 1986), (1990, 2040), (2043, 2043), (9999, 9999)]
    days, months = workdays.tables(c)
    d = days[days.region == "EnglandAndWales"].set_index("d")
    assert d.loc[date(2043, 1, 31)].prev == date(2043, 1, 30) and not d.loc[date(2043, 12, 25)].working and d.loc[date(1986, 1, 1)].next == date(1986, 1, 2)
    m = months[months.region == "Scotland"].set_index("month")
    assert m.loc[date(1985, 8, 1)].last_working == date(1985, 8, 30) and len(m) == 12 * 56
    assert date(1977, 5, 2) not in workdays.holidays(1977) and date(1977, 6, 7) in workdays.holidays(1977)


def test_config():
    assert deep_merge({"a": [1, 2], "b": {"c": 1}}, {"a": [2, 3], "b": {"d": 2}}) == {"a": [1, 2, 3], "b": {"c": 1, "d": 2}}
    over = bank_overlay(Config().data, {"channels": {"chaps": {"positive_tokens": ["CHX"]}}, "weights": {"x": 1}})
    assert over["channels"]["chaps"]["positive_tokens"] == ["CHAPS", "CHP", "CHX"] and "x" not in over["weights"]
    c = Config(source_bank="b", overlays={"b": {"channels": {"new": {"positive_tokens": ["NEW CODE"]}}}})
    assert ("new", "NEW CODE") in c.channel_phrases() and c.get("source_bank") == "b"
    for bad in ({"weights": {"extra": 1}}, {"penalties": {"max_negative_signal_penalty": 0.1}}, {"calendar": {"default_region": "Mars"}}, {"amount": {"stable_pct_tolerance": "x"}}):
        with pytest.raises(ConfigError):
            Config(bad)


def test_row_rules(spark):
    fields = "id string, date string, description string, amount string, direction string, balance string"
    rows = [
        ("a", "2024-01-31", "x", "10", "credit", None), ("a", "2024-01-31", "x", "10", "credit", None), ("", "2024-01-31", "x", "10", "credit", None), ("b", "2024-01-31", "x", "ten", "credit", None),
        ("c", "2024-01-31", "x", "0", None, None), ("d", "20240131", "x", "1", "CR", None), ("e", "2024-02-30", "x", "1", "+", None), ("f", "2024-01-31", None, "-5", None, None), ("f", "2024-01-31", " ", "5", None, None),
        ("g", "2024-01-31", "x", "-5", "credit", None), ("h", "2024-01-31", "x", "5", "up", None), ("i", "2024-01-31", "  ", " 12.5 ", "cr", "1.5"), ("j", "2024-01-31", "x", "NaN", None, None), ("k", "2024-01-31", "x", "1", "dr", "bad"),
    ]
    df = spark.createDataFrame([("A", "lenient", i, *r) for i, r in enumerate(rows)], "analysis_id string, mode string, pos long, " + fields)
    got = validation.checked(df).orderBy("pos").collect()
    want = [None, "duplicate_id", *["row_invalid"] * 5, "non_credit_row_skipped", "duplicate_id", None, "row_invalid", None, "row_invalid", "row_invalid"]
    assert [r["status"] for r in got] == want
    assert float(got[9]["value"]) == 5 and got[11]["text"] == "__EMPTY__" and float(got[11]["value"]) == 12.5
    w = validation.row_warnings(validation.checked(df)).orderBy("seq").collect()
    assert len(w) == 11 and w[0]["detail"] == "an earlier row has the id 'a'; this one is left out"



def random_analysis(seed):
    """A row as pool.packed makes it."""
    r = random.Random(seed)
    n = r.randint(4, 25)
    days = [r.randint(0, 200) for _ in range(n)]
    employers = [r.choice([[0], [1], [0, 1], []]) for _ in range(n)]
    kinds = sorted({str(e) for e in employers})
    of = [kinds.index(str(e)) for e in employers]
    emitted = [k for k in range(len(kinds)) if of.count(k) >= 2]
    links = [{"a": b, "b": a} for a in range(n) for b in range(a) if r.random() < 0.15]
    return {
        "analysis_id": "a", "names": ["ACME", "BOLT"], "groups": [{"idx": k, "skeleton": kinds[k], "final": 0.6, "reason": "r"} for k in emitted], "employers": employers, "groups_of": [k if k in emitted else -1 for k in of],
        "links": links, "ids": [f"t{r.randint(0, 99):02d}_{i}" for i in range(n)], "days": days, "months": [d // 30 for d in days], "amounts": [float(r.choice([100, 101, 120, 500, 505, 900])) for _ in range(n)],
        "channels": ["unknown_credit"] * n, "anchors": [False] * n, "texts": ["x"] * n, "extras": [r.choice([0, 0, 1, 2]) for _ in range(n)],
    }


@pytest.mark.parametrize("seed", range(25))
def test_pool_folds(seed):
    t = random_analysis(seed)
    n = len(t["ids"])
    a = Analysis(t, 0.9, 0.10)
    parts = a.components()
    assert sorted(i for p in parts for i in p) == list(range(n))
    where = {i: k for k, p in enumerate(parts) for i in p}
    assert all(where[x["a"]] == where[x["b"]] for x in t["links"])
    first = [min(t["ids"][i] for i in p) for p in parts]
    assert first == sorted(first) and all(list(p) == sorted(p, key=lambda i: (t["days"][i], i)) for p in parts)
    for p in parts:
        groups = list(a.by_employer(p))
        assert sorted(i for g in groups for i in g) == sorted(p)
        assert sum(not t["employers"][g[0]] for g in groups) <= 1
    pool = a.merged(a.from_skeletons() + a.from_graph())
    for i, c in enumerate(pool):
        assert len(set(c.rows)) == len(c.rows) and c.own == sum(1 << x for x in c.rows)
        for d in pool[:i]:
            both = len(set(c.rows) & set(d.rows)) / min(len(c.rows), len(d.rows))
            assert both < 0.9 or c.sources or d.sources
    split = list(a.without_extras(pool))
    for c in split:
        if c.cid.endswith("_main"):
            assert not any(t["extras"][i] for i in c.rows) and len(c.rows) >= 2
    assert {i for c in split for i in c.rows} == {i for c in pool for i in c.rows}
    for b in a.buckets(list(range(n))):
        x = sorted(t["amounts"][i] for i in b)
        assert x[-1] <= 1.1 * 1.1 * x[len(x) // 2] + 1e-9


def test_review(spark):
    assert review.cost("gpt-4o", 1000, 1000) == 0.0125 and review.cost("none", 5, 5) == 0.0
    assert review.parse('```json\n{"a": 1}\n```') == {"a": 1} and review.parse(' {"a": 2} ') == {"a": 2}
    replies = spark.createDataFrame([("a", '```json\n{"selected_candidate_set_ids": ["x"], "confidence": 0.8, "reasoning": ["r"]}\n```'), ("b", "no json")], "analysis_id string, response_text string")
    got = {r["analysis_id"]: r for r in review.parsed_replies(replies).collect()}
    assert got["a"]["selected_candidate_set_ids"] == ["x"] and got["a"]["review_confidence"] == 0.8 and got["b"]["review_confidence"] == 0.0 and got["b"]["selected_candidate_set_ids"] == []
    with pytest.raises(ValueError):
        review.check_reply({"selected_candidate_set_ids": [], "rejected_candidate_set_ids": [], "confidence": 2, "reasoning": ["x"]})
