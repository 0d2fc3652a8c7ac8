"""Input types, and the contract that a payload's JSON has to meet."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

TEXT_FIELDS = ("id", "date", "description", "amount", "direction", "balance", "reference", "counterparty_name", "transaction_code", "currency", "account_id", "raw_category", "source_bank", "booking_date", "value_date")
AMOUNT = "decimal(28,8)"


def _struct(text: tuple[str, ...] = (), **others: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(f, T.StringType()) for f in text] + [T.StructField(k, v) for k, v in others.items()])


#: Amounts, rates and switches stay text until they are parsed: decimals are exact, and a value of the wrong kind spoils no other.
TRANSACTION = _struct(TEXT_FIELDS)
ANALYSIS = _struct(
    ("analysis_id", "scenario_description"),
    scenario_tags=T.ArrayType(T.StringType()),
    jurisdiction=T.StringType(),
    country_region=T.StringType(),
    source_bank=T.StringType(),
    validation_mode=T.StringType(),
    transactions=T.ArrayType(TRANSACTION),
    payslip_hints=T.ArrayType(_struct(("month", "amount", "hint_id"))),
    salary_hints=_struct(("approx_monthly", "approx_yearly", "tolerance_pct")),
    options=_struct(("enable_llm", "include_audit", "llm_provider", "llm_model")),
    transactions_range=_struct(("start", "end")),
)


@dataclass(frozen=True)
class Rule:
    """What a property's value may be: its kinds, and for some a shortest length, a pattern, a list, bounds."""

    kinds: tuple[str, ...]
    shortest: int = 0
    pattern: str = ""
    among: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Shape:
    """An object: properties, which of them are needed, and whether it may have others."""

    rules: dict[str, Rule]
    needed: tuple[str, ...] = ()
    closed: bool = True
    lists: dict[str, Shape] = field(default_factory=dict)
    objects: dict[str, Shape] = field(default_factory=dict)


_TEXT, _MAYBE, _NUMBER, _MAYBE_NUMBER, _SWITCH = Rule(("string",)), Rule(("string", "null")), Rule(("number",)), Rule(("number", "null")), Rule(("boolean",))
_NAME, _LIST, _OBJECT, _COUNT = Rule(("string",), shortest=1), Rule(("array",)), Rule(("object",)), Rule(("integer",), low=0)

#: The input contract: names, kinds, lists and patterns are fixed values.
CONTRACT = Shape(
    {
        "analysis_id": _NAME, "scenario_description": _NAME, "scenario_tags": _LIST, "jurisdiction": _TEXT,
        "country_region": Rule(("string",), among=("EnglandAndWales", "Scotland", "NorthernIreland", "UnknownDefaultEnglandAndWales")),
        "source_bank": _MAYBE, "validation_mode": Rule(("string",), among=("lenient", "strict")), "transactions": _LIST, "payslip_hints": _LIST,
        "salary_hints": _OBJECT, "options": _OBJECT, "expected": _OBJECT,
    },
    ("analysis_id", "scenario_description", "transactions"),
    lists={
        "transactions": Shape(
            {
                "id": _NAME, "date": Rule(("string",), pattern=r"^\d{4}-\d{2}-\d{2}$"), "description": _TEXT, "amount": _NUMBER, "direction": Rule(("string",), among=("credit", "debit")),
                "balance": _MAYBE_NUMBER, "reference": _MAYBE, "counterparty_name": _MAYBE, "transaction_code": _MAYBE, "currency": _MAYBE, "account_id": _MAYBE, "raw_category": _MAYBE,
            },
            ("id", "date", "description", "amount", "direction"),
        ),
        "payslip_hints": Shape({"month": Rule(("string",), pattern=r"^\d{4}-\d{2}$"), "amount": _NUMBER, "hint_id": _TEXT}, ("month", "amount")),
    },
    objects={
        "salary_hints": Shape({"approx_monthly": _MAYBE_NUMBER, "approx_yearly": _MAYBE_NUMBER, "tolerance_pct": Rule(("number",), low=0, high=1)}),
        "options": Shape({"enable_llm": _SWITCH, "include_audit": _SWITCH, "llm_provider": Rule(("string",), among=("anthropic", "openai", "mock")), "llm_model": _TEXT}),
        "expected": Shape(
            {
                "candidate_count_min": _COUNT, "candidate_count_max": _COUNT, "top_candidate_type": _TEXT, "top_confidence_band": Rule(("string",), among=("high", "medium_high", "medium", "low", "very_low")),
                "must_contain_transaction_ids": _LIST, "must_not_classify_as_probable_salary": _SWITCH, "expected_payday_model": _TEXT, "expected_amount_model": _TEXT, "expected_warnings": _LIST,
            },
            closed=False,
        ),
    },
)
