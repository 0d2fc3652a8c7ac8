"""Lists and maps as one literal: a plan built of thousands of single ones takes seconds to make, whatever the data."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def constant(value: list | dict, kind: str) -> Column:
    """A value of that type, folded into the plan as one literal."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def strings(words: Iterable[str]) -> Column:
    return constant(list(words), "array<string>")


def lookup(pairs: dict[str, str | float], key: Column) -> Column:
    """What the key stands for, or null."""
    kind = "string" if all(isinstance(v, str) for v in pairs.values()) else "double"
    return F.try_element_at(constant(pairs, f"map<string,{kind}>"), key)


def text_sql(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def list_sql(words: Iterable[str]) -> str:
    return "array(" + ", ".join(map(text_sql, words)) + ")"


def lookup_sql(pairs: dict[str, str | float], key: str) -> str:
    """lookup as SQL text."""
    value = lambda v: text_sql(v) if isinstance(v, str) else f"{v}D"
    return f"try_element_at(map({', '.join(f'{text_sql(k)}, {value(v)}' for k, v in pairs.items())}), {key})"
