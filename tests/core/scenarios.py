"""Seven incomes of 2024, with what detection has to find."""

from calendar import monthrange
from datetime import date, timedelta

OFF = {date(2024, 1, 1), date(2024, 3, 29), date(2024, 4, 1), date(2024, 5, 6), date(2024, 5, 27), date(2024, 8, 26), date(2024, 12, 25), date(2024, 12, 26)}


def last_day(m):
    return date(2024, m, monthrange(2024, m)[1])


def last_weekday(m, off=()):
    d = last_day(m)
    while d.weekday() > 4 or d in off:
        d -= timedelta(1)
    return d


def made(name, dates, text, amounts, direction=None, region="EnglandAndWales", **expected):
    rows = [{"id": f"{name}_{i:02d}", "date": str(d), "description": text, "amount": a} | ({"direction": direction} if direction else {}) for i, (d, a) in enumerate(zip(dates, amounts, strict=True), 1)]
    payload = {"analysis_id": name, "scenario_description": name, "validation_mode": "lenient", "transactions": rows}
    return payload | ({"country_region": region} if region else {}), expected


MONTHS = range(1, 13)
WEEKDAYS = [last_weekday(m) for m in MONTHS]
SCENARIOS = [
    made("s100", [last_day(m) for m in MONTHS], "Acme India", [3450] * 3 + [2450] * 9, "credit", model="last_calendar_day", amount="stable_with_step_change", final=0.8510, cid="graph_000"),
    made("s101", [date(2024, m, 25) for m in MONTHS], "APEX MONTHLY PAY", [3100] * 12, region=None, model="fixed_day_n", amount="stable", final=0.8910, cid="skeleton_000"),
    made("s102", [last_weekday(m, OFF) for m in MONTHS], "MERIDIAN PAYROLL", [4200] * 12, model="last_working_day", amount="stable", final=0.8925, cid="skeleton_000"),
    made("s106", [last_weekday(m, OFF) for m in MONTHS if m not in (3, 8)], "SUMMIT PAYROLL", [3350] * 10, model="last_working_day", amount="stable", final=0.8558, cid="skeleton_000", missing=["2024-03", "2024-08"]),
    made("s200", WEEKDAYS, "SOLARIS WAGES", [2500] * 12, model="last_working_day", amount="stable", final=0.8904, cid="skeleton_000"),
    made("s201", WEEKDAYS, "VERTEX PAYROLL", [2499.73] * 12, model="last_working_day", amount="stable", final=0.8904, cid="skeleton_000"),
    made("s202", WEEKDAYS, "ORBIT SALARY", [2453.10, 2547.60, 2500, 2490, 2510, 2480, 2520, 2500, 2495, 2505, 2500, 2515], model="last_working_day", final=0.8904, cid="skeleton_000"),
]
