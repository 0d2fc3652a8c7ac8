"""Edge cases of the whole detection, in one job."""

import hashlib
import json
from datetime import date, timedelta

import pytest

from wagetide.plans.engine import Engine, Options
from wagetide.operators import features, review, validation
from wagetide.sources.payloads import RAW, from_dicts, from_json_text, read_json, write_results
from wagetide.streaming.batches import Detector

from .scenarios import SCENARIOS, made


def monthly(name, text, first, n, amount=2000, day=25, **more):
    dates = [date(2023 + (first + k - 1) // 12, (first + k - 1) % 12 + 1, day) for k in range(n)]
    return made(name, dates, text, [amount] * n, "credit", **more)[0]


def two_jobs(name, gap):
    """Paid by one employer up to June, then by another; gap days between the last and the first pay."""
    a, b = monthly(name, "FIRSTCO PAYROLL", 1, 6), monthly(name, "SECONDCO PAYROLL", 1, 6, amount=2600)
    start = date.fromisoformat(a["transactions"][-1]["date"]) + timedelta(gap)
    for i, t in enumerate(b["transactions"]):
        t |= {"id": f"b{i}", "date": str(start + timedelta(30 * i))}
    a["transactions"] += b["transactions"]
    return a


class Mock:
    def call(self, payload, *, model, max_tokens=4096):
        ids = [c["id"] for c in payload["candidate_sets"]]
        return review.Call("mock", model, {}, json.dumps({"selected_candidate_set_ids": ids[:1], "rejected_candidate_set_ids": ids[1:], "confidence": 0.9, "reasoning": ["m"]}), 256, 128)


@pytest.fixture(scope="module")
def tables(spark):
    fallback = monthly("opaque", "x", 1, 12)
    for i, t in enumerate(fallback["transactions"]):
        t["description"] = hashlib.md5(str(i).encode()).hexdigest()
    scattered = monthly("silent", "x", 1, 3)
    for i, t in enumerate(scattered["transactions"]):
        t |= {"description": f"{'QWXYZ'[i]}{'KJHGF'[i]}{'VBNMP'[i]}UU", "amount": 10 ** (i + 1)}
    bonus = monthly("bonus", "ACME PAYROLL", 1, 12)
    for i in (3, 9):
        bonus["transactions"].append({"id": f"x{i}", "date": f"2023-{i:02d}-26", "description": "ACME PAYROLL BONUS", "amount": 2000, "direction": "credit"})
    slips = monthly("slips", "ACME PAYROLL", 1, 12) | {"payslip_hints": [{"month": "2023-02", "amount": 2000}, {"month": "2023-03", "amount": 1, "hint_id": "lost"}], "salary_hints": {"approx_monthly": 2000}}
    alone = monthly("alone", "ACME PAYROLL", 1, 12) | {"payslip_hints": [{"month": "2023-03", "amount": 1, "hint_id": "lost"}]}
    cases = [
        fallback, scattered, bonus, slips, alone, two_jobs("near", 62), two_jobs("far", 63), {"analysis_id": "none", "scenario_description": "n", "transactions": None},
        monthly("strict", "ACME PAYROLL", 1, 3) | {"validation_mode": "strict"}, monthly("badhint", "ACME", 1, 3) | {"payslip_hints": [{"month": "2023-13", "amount": 1}]}, monthly("pension", "ACME PENSION", 1, 12),
    ]
    cases[8]["transactions"][1]["amount"] = "x"
    return Engine(spark, reviewer=Mock(), options=Options(enable_review=True, review_model="gpt-4o")).tables(from_dicts(spark, cases))


@pytest.fixture(scope="module")
def results(tables):
    return {r["analysis_id"]: r for r in tables.result.collect()}


def codes(r):
    return [w["code"] for w in r["warnings"]]


def test_fallback(results):
    top = results["opaque"]["candidate_sets"][0]
    assert top["candidate_set_id"].startswith("amount_date_") and top["candidate_type"] == "unknown_recurring_credit" and top["confidence"] <= 0.55 and "no_signal_detected" in codes(results["opaque"])
    assert results["silent"]["candidate_sets"] == [] and "no_signal_detected" in codes(results["silent"])


def test_bonus_rows_are_split_off(results):
    ids = {c["candidate_set_id"]: c for c in (*results["bonus"]["candidate_sets"], *results["bonus"]["rejected_or_near_miss_sets"])}
    extra = [c for k, c in ids.items() if "_bonus_" in k]
    assert extra and extra[0]["candidate_type"] == "bonus_or_extra_pay_candidate" and len(extra[0]["transactions"]) == 2


def test_hints(results):
    r = results["slips"]
    assert codes(r).count("hint_unmatched") == 1 and [a["transaction_id"] for a in r["applied_hints"]["anchors"]] == ["slips_02"]
    assert r["candidate_sets"][0]["score_breakdown"]["anchor_bonus"] == 0.05 and r["applied_hints"]["unmatched_hint_ids"] == ["lost"]
    assert "hint_unmatched" not in codes(results["alone"])


def test_transitions(results):
    assert "employment_transition_detected" in codes(results["near"]) and "employment_transition_detected" not in codes(results["far"])
    link = [c["metadata"]["possible_employment_transition"] for c in results["near"]["candidate_sets"] if c["metadata"]["possible_employment_transition"]]
    assert link[0][0]["gap_days"] == 62


def test_failures_stay_with_their_analysis(results):
    assert results["strict"]["status"] == results["badhint"]["status"] == "failed" and results["strict"]["candidate_sets"] == []
    assert "no_transactions" in codes(results["none"]) and results["none"]["status"] == "ok" and results["slips"]["status"] == "ok"
    assert results["pension"]["candidate_sets"][0]["candidate_type"] == "recurring_income_not_salary_candidate"


def test_review_and_audit(spark, tables, results):
    engine = Engine(spark, reviewer=Mock(), options=Options(enable_review=True, review_model="gpt-4o"))
    asked = {r["analysis_id"]: r for r in engine.review(tables).collect()}
    assert "silent" in asked and "slips" not in asked and asked["silent"]["cost_usd"] == review.cost("gpt-4o", 256, 128)
    payload = json.loads(review.payloads(tables.result).filter("analysis_id = 'slips'").first()["payload"])
    review.check_payload(payload)
    assert "description" not in payload["candidate_sets"][0]["transactions"][0] and list(payload) == sorted(payload)
    assert "features" in engine.audit(tables) and engine.audit(tables)["candidates"].isEmpty()
    tables = Engine(spark, reviewer=Mock(), options=Options(enable_review=True, review_model="gpt-4o", include_audit=True)).tables(from_dicts(spark, [monthly("a", "ACME PAYROLL", 1, 12), {"analysis_id": "z", "scenario_description": "z", "transactions": []}]))
    engine.review(tables)
    audit = engine.audit(tables)
    assert {"validate", "normalise", "feature_extraction", "llm_fallback"} <= {r["name"] for r in audit["steps"].collect()} and audit["candidates"].count() == 1
    assert audit["features"].count() == 12 and audit["llm_calls"].count() == 0


def test_files_and_streams(spark, tmp_path):
    whole = [p for p, _ in SCENARIOS[:2]]
    for i, p in enumerate(whole):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(p))
    (tmp_path / "in" / "bad.json").write_text("{not json")
    read = read_json(spark, str(tmp_path / "in"))
    assert [r["analysis_id"] for r in read.collect() if r["_corrupt"]] == [None] and len(read.collect()) == 3
    got = {r["analysis_id"]: r for r in Engine(spark).detect(read).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"s100": "ok", "s101": "ok", None: "failed"} and "no JSON" in got[None]["error"]
    rows = validation.exploded(read.filter("not _corrupt"))
    rows.filter("pos < 6").write.parquet(str(tmp_path / "rows" / "a"))
    rows.filter("pos >= 6").write.parquet(str(tmp_path / "rows" / "b"))
    detector = Detector(Engine(spark), str(tmp_path / "store"), str(tmp_path / "results"))
    for part in ("a", "b"):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "rows" / part))
        number = {"a": 0, "b": 1}[part]
        q = stream.writeStream.foreachBatch(lambda df, _, n=number: detector.batch(df, n)).option("checkpointLocation", str(tmp_path / f"ck{part}")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r["analysis_id"]: r for r in detector.latest().collect()}
    assert {k: len(r["candidate_sets"][0]["transactions"]) for k, r in got.items()} == {"s100": 12, "s101": 12}
    write_results(detector.latest(), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_refused(spark):
    """Payloads that share an id, that have none, that are no objects; and types that do not fit."""
    a = monthly("twice", "ACME PAYROLL", 1, 12)
    texts = [json.dumps(x) for x in (a, a, monthly("once", "ACME PAYROLL", 1, 12), {k: v for k, v in a.items() if k != "analysis_id"})] + ["[1]", "{bad", "", '{"analysis_id": "odd", "transactions": {"id": 1}, "options": 5}']
    read = from_json_text(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    got = sorted((str(r["analysis_id"]), r["status"], str(r["error"])) for r in Engine(spark).detect(read).collect())
    assert [x[:2] for x in got] == [("None", "failed")] * 3 + [("odd", "ok"), ("once", "ok"), ("salary_analysis", "ok")] + [("twice", "failed")] * 2
    assert got[-1][2] == "2 payloads have this analysis_id"


def test_contract(spark):
    bad = {
        "analysis_id": "", "scenario_description": 5, "colour": 1, "country_region": "Mars", "salary_hints": {"tolerance_pct": 2, "x": 1}, "options": {"enable_llm": "yes"},
        "transactions": [{"id": "a", "date": "1.1.2024", "amount": "12", "direction": "CREDIT", "description": None, "flag": 1}, 7], "payslip_hints": [{"month": "2024-1"}],
    }
    df = from_json_text(spark.createDataFrame([(json.dumps(bad),)], "t string"), "t")
    found = [(r["detail"], r["transaction_id"]) for r in df.select("*", validation.schema_faults(df).alias("s")).selectExpr("inline(s)").collect()]
    assert found == [
        ("[]: unknown property 'colour'", ""), ("['analysis_id']: must not be empty", ""), ("['country_region']: must be one of EnglandAndWales, Scotland, NorthernIreland, UnknownDefaultEnglandAndWales", ""),
        ("['options', 'enable_llm']: must be boolean", ""), ("['payslip_hints', 0]: 'amount' is missing", ""), (r"['payslip_hints', 0, 'month']: must match ^\d{4}-\d{2}$", ""),
        ("['salary_hints']: unknown property 'x'", ""), ("['salary_hints', 'tolerance_pct']: must not be above 1", ""), ("['scenario_description']: must be string", ""),
        ("['transactions', 0]: unknown property 'flag'", "a"), ("['transactions', 0, 'amount']: must be number", "a"), (r"['transactions', 0, 'date']: must match ^\d{4}-\d{2}-\d{2}$", "a"),
        ("['transactions', 0, 'description']: must be string", "a"), ("['transactions', 0, 'direction']: must be one of credit, debit", "a"), ("['transactions', 1]: must be object", ""),
    ]
    assert RAW in df.columns


def test_years_beyond_the_usual(spark):
    """The same payday model whatever the year."""
    made_ = []
    for y in (1985, 2023, 2043):
        a = monthly(f"y{y}", "ACME PAYROLL", 1, 12)
        for m, t in enumerate(a["transactions"], 1):
            t["date"] = str((date(y + m // 12, m % 12 + 1, 1)) - timedelta(1))
        made_.append(a)
    got = {r["analysis_id"]: r["candidate_sets"][0]["detected_pattern"]["payday_model"] for r in Engine(spark).detect(from_dicts(spark, made_)).collect()}
    assert set(got.values()) == {"last_calendar_day"}


def test_payload_options(spark):
    """The caller's settings come before the payload's, and those before the defaults."""
    cases = [monthly("on", "ACME PAYROLL", 1, 3) | {"options": {"enable_llm": True, "include_audit": True, "llm_model": "m"}}, monthly("off", "ACME PAYROLL", 1, 3)]
    silent = [{"analysis_id": n, "scenario_description": "x", "transactions": [], "options": {"enable_llm": x}} for n, x in (("ask", True), ("skip", False))]
    plain = Engine(spark, reviewer=Mock())
    t = plain.tables(from_dicts(spark, cases + silent))
    meta = {r["analysis_id"]: r["metadata"] for r in t.result.collect()}
    assert meta["on"]["enable_llm"] and meta["on"]["include_audit"] and meta["on"]["llm_model"] == "m" and not meta["off"]["enable_llm"]
    assert meta["off"]["return_threshold"] == 0.4 and {r["analysis_id"] for r in plain.audit(t)["features"].collect()} == {"on"}
    assert "skip" not in {r["analysis_id"] for r in plain.review(t).collect()}
    over = Engine(spark, options=Options(enable_review=False, include_audit=False, review_model="n")).detect(from_dicts(spark, cases))
    assert {(r["metadata"]["enable_llm"], r["metadata"]["include_audit"], r["metadata"]["llm_model"]) for r in over.collect()} == {(False, False, "n")}


def test_own_extractors(spark):
    import pyspark.sql.functions as F

    channels = lambda n, t, c: {"channel_match": features.channel(n, c).withField("channel", F.lit("chaps"))}
    got = Engine(spark, channels=channels, descriptions=lambda n, t, c: {"employers": F.array(F.lit("OWN"))}).detect(from_dicts(spark, [monthly("a", "ACME PAYROLL", 1, 12)])).first()
    p = got["candidate_sets"][0]["detected_pattern"]
    assert p["payment_channel"] == "chaps" and p["possible_employer_tokens"] == ["OWN"]
