"""From analyses to valid credit rows and warnings. Row checks are expressions; only the first-occurrence rule needs a window, which
runs on the analysis that a row belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.literals import list_sql, text_sql
from ..functions.text import EMPTY
from ..schemas import AMOUNT, CONTRACT, TEXT_FIELDS, Rule, Shape
from ..sources.payloads import RAW, exploded

WARNING = "analysis_id string, stage int, seq long, code string, transaction_id string, detail string"
CURRENCY = "GBP"


def parsed_amount(c: Column) -> Column:
    return c.try_cast(AMOUNT)


def parsed_date(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def direction(raw: Column, amount: Column) -> Column:
    """credit, debit, or null if it cannot be told."""
    d = F.lower(raw)
    by_name = F.when(d.isin("credit", "cr", "+"), "credit").when(d.isin("debit", "dr", "-"), "debit")
    by_sign = F.when(amount > 0, "credit").when(amount < 0, "debit")
    return F.when(raw.isNotNull(), by_name).otherwise(by_sign)


def described(c: Column) -> Column:
    t = F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(c.isNull() | (t == ""), F.lit(EMPTY)).otherwise(t)


def row_checked(rows: DataFrame) -> DataFrame:
    """Rows with their parsed values and fault: the first rule that a row breaks, or null."""
    quoted = lambda c: F.concat(F.lit("'"), F.coalesce(c, F.lit("None")), F.lit("'"))
    amount = parsed_amount(F.col("amount"))
    way = direction(F.col("direction"), amount)
    day = parsed_date(F.col("date"))
    fault = F.coalesce(
        F.when(F.coalesce("id", F.lit("")) == "", F.lit("the row has no id")),
        F.when(amount.isNull(), F.concat(F.lit("no number in amount: "), quoted(F.col("amount")))),
        F.when(way.isNull() & F.col("direction").isNotNull(), F.concat(F.lit("neither credit nor debit: "), quoted(F.col("direction")))),
        F.when(way.isNull(), F.lit("no direction, and an amount of zero has no sign")),
        F.when(day.isNull(), F.concat(F.lit("no day of the form YYYY-MM-DD in date: "), quoted(F.col("date")))),
        F.when(F.col("balance").isNotNull() & parsed_amount(F.col("balance")).isNull(), F.concat(F.lit("no number in balance: "), quoted(F.col("balance")))),
    )
    return rows.withColumn("fault", fault).withColumns({"value": F.abs(amount), "way": way, "day": day, "text": described(F.col("description"))})


def checked(rows: DataFrame) -> DataFrame:
    """row_checked with status: row_invalid, duplicate_id, non_credit_row_skipped, or null."""
    out = row_checked(rows)
    nth = F.row_number().over(Window.partitionBy("analysis_id", "id", F.col("fault").isNull()).orderBy("pos"))
    out = out.withColumn("nth", nth)
    status = F.when(F.col("fault").isNotNull(), "row_invalid").when(F.col("nth") > 1, "duplicate_id").when(F.col("way") != "credit", "non_credit_row_skipped")
    return out.withColumn("status", status).drop("nth")


def row_warnings(rows: DataFrame) -> DataFrame:
    """From checked rows. Stage 2: row checks."""
    id_ = F.coalesce("id", F.lit(""))
    detail = (
        F.when(F.col("status") == "row_invalid", F.col("fault"))
        .when(F.col("status") == "duplicate_id", F.concat(F.lit("an earlier row has the id '"), id_, F.lit("'; this one is left out")))
        .otherwise(F.concat(F.lit("only credits are looked at; row '"), id_, F.lit("' is a "), F.col("way")))
    )
    return rows.filter("status is not null").select("analysis_id", F.lit(2).alias("stage"), F.col("pos").alias("seq"), F.col("status").alias("code"), id_.alias("transaction_id"), detail.alias("detail"))


#: What the type of a JSON value looks like, by kind.
KINDS = {"string": "STRING", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "integer": "BIGINT", "boolean": "BOOLEAN", "null": "VOID", "array": "ARRAY.*", "object": "OBJECT.*"}
_PATH = "array<struct<i:int,name:string>>"
_NONE = f"cast(array() as array<struct<path:{_PATH},text:string,id:string>>)"


def _fault(path: str, text: str, id_: str) -> str:
    return f"named_struct('path', {path}, 'text', {text}, 'id', {id_})"


def _step(name: str = "''", i: str = "-1") -> str:
    """A step of a path: a property's name, or a place in a list."""
    return f"array(named_struct('i', {i}, 'name', {name}))"


def _value_fault(value: str, rule: Rule) -> str:
    """SQL: what is wrong with a value that is there, or null."""
    text, number = f"try_variant_get({value}, '$', 'string')", f"try_variant_get({value}, '$', 'double')"
    tests = [(f"not schema_of_variant({value}) rlike '^({'|'.join(KINDS[k] for k in rule.kinds)})$'", "must be " + " or ".join(rule.kinds))]
    if rule.shortest:
        tests.append((f"length({text}) < {rule.shortest}", "must not be empty"))
    if rule.pattern:
        tests.append((f"not {text} rlike {text_sql(rule.pattern)}", f"must match {rule.pattern}"))
    if rule.among:
        tests.append((f"not array_contains({list_sql(rule.among)}, {text})", "must be one of " + ", ".join(rule.among)))
    if rule.low is not None:
        tests.append((f"{number} < {rule.low}", f"must not be below {rule.low}"))
    if rule.high is not None:
        tests.append((f"{number} > {rule.high}", f"must not be above {rule.high}"))
    return "case " + " ".join(f"when {t} then {text_sql(m)}" for t, m in tests) + " end"


def _object_faults(m: str, shape: Shape, path: str, id_: str = "''") -> str:
    """SQL: faults of an object (map of variants; null: no object) against its shape. id_: of the transaction that it is."""
    parts = []
    if shape.needed:
        missing = """concat("'", k, "' is missing")"""
        parts.append(f"transform(filter({list_sql(shape.needed)}, k -> not map_contains_key({m}, k)), k -> {_fault(path, missing, id_)})")
    for f, rule in shape.rules.items():
        found = _value_fault(f"try_element_at({m}, '{f}')", rule)
        at = f"concat({path}, {_step(text_sql(f))})"
        parts.append(f"if(map_contains_key({m}, '{f}'), transform(filter(array({found}), t -> t is not null), t -> {_fault(at, 't', id_)}), {_NONE})")
    if shape.closed:
        unknown = """concat("unknown property '", k, "'")"""
        parts.append(f"transform(filter(map_keys({m}), k -> not array_contains({list_sql(shape.rules)}, k)), k -> {_fault(path, unknown, id_)})")
    whole = text_sql("must be object")
    return f"if({m} is null, array({_fault(path, whole, id_)}), concat({', '.join(parts)}))"


def document_faults(raw: str) -> str:
    """SQL: all faults of a JSON document against the input contract, in the order of their paths: array of (path, text, id)."""
    objects = "map<string,variant>"
    parts = [_object_faults(f"from_json({raw}, '{objects}')", CONTRACT, f"cast(array() as {_PATH})")]
    for f, shape in CONTRACT.objects.items():
        inner = _object_faults("o", shape, _step(text_sql(f)))
        parts.append(f"coalesce(flatten(transform(filter(array(from_json({raw}, '{f} {objects}').{f}), o -> o is not null), o -> {inner})), {_NONE})")
    for f, shape in CONTRACT.lists.items():
        own = "coalesce(try_variant_get(try_element_at(o, 'id'), '$', 'string'), '')" if f == "transactions" else "''"
        inner = _object_faults("o", shape, f"concat({_step(text_sql(f))}, {_step(i='i')})", own)
        # an element that is no object is null here, and spoils no other
        each = f"transform(from_json({raw}, '{f} array<variant>').{f}, v -> try_variant_get(v, '$', '{objects}'))"
        parts.append(f"coalesce(flatten(transform({each}, (o, i) -> {inner})), {_NONE})")
    return f"array_sort(concat({', '.join(parts)}))"


def _shown(path: str) -> str:
    """['transactions', 0, 'amount'] and the like."""
    return f"""concat('[', array_join(transform({path}, p -> if(p.i >= 0, cast(p.i as string), concat("'", p.name, "'"))), ', '), ']')"""


def schema_faults(about: DataFrame) -> Column:
    """Faults of analyses against the input contract, as an array of (detail, transaction_id). Documents are checked whole, as they came;
    of analyses made from rows, whose columns have their types, only what is absent or unknown, and rows by row_faults."""
    if RAW in about.columns:
        return F.expr(f"transform({document_faults(RAW)}, f -> struct(concat({_shown('f.path')}, ': ', f.text) as detail, f.id as transaction_id))")
    top = [F.when(F.coalesce(c, F.lit("")) == "", F.lit(f"[]: '{c}' is missing")) for c in ("analysis_id", "scenario_description")]
    top += [F.when(~F.col("listed"), F.lit("[]: 'transactions' is missing")), F.when(F.col("transactions_range").isNotNull(), F.lit("[]: unknown property 'transactions_range'"))]
    top += [F.when(~F.col(c).isin(*CONTRACT.rules[c].among), F.lit(f"['{c}']: must be one of " + ", ".join(CONTRACT.rules[c].among))) for c in ("country_region", "validation_mode")]
    return F.transform(F.filter(F.array(*top), lambda x: x.isNotNull()), lambda x: F.struct(x.alias("detail"), F.lit("").alias("transaction_id")))


def row_faults() -> Column:
    """Faults of a transaction that came as a row, as an array of texts."""
    shape = CONTRACT.lists["transactions"]
    place = F.concat(F.lit("['transactions', "), F.col("pos"), F.lit("]: "))
    found = [F.when(F.col(c).isNull(), F.concat(place, F.lit(f"'{c}' is missing"))) for c in shape.needed]
    found += [F.when(F.col(c).isNotNull(), F.concat(place, F.lit(f"unknown property '{c}'"))) for c in TEXT_FIELDS if c not in shape.rules]
    found.append(F.when(~F.col("direction").isin(*shape.rules["direction"].among), F.concat(F.lit("['transactions', "), F.col("pos"), F.lit(", 'direction']: must be one of credit, debit"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def schema_warnings(about: DataFrame, rows: DataFrame) -> DataFrame:
    """Stage 0 and 1: every fault against the input contract, in the order of place. about, rows: with their faults in schema."""
    top = about.select("analysis_id", F.posexplode("schema").alias("seq", "f"))
    top = top.select("analysis_id", F.lit(0).alias("stage"), F.col("seq").cast("long").alias("seq"), F.lit("schema_violation").alias("code"), F.col("f.transaction_id").alias("transaction_id"), F.col("f.detail").alias("detail"))
    each = rows.select("analysis_id", "pos", F.coalesce("id", F.lit("")).alias("transaction_id"), F.posexplode("schema").alias("k", "detail"))
    return top.unionByName(each.select("analysis_id", F.lit(1).alias("stage"), (F.col("pos") * 16 + F.col("k")).alias("seq"), F.lit("schema_violation").alias("code"), "transaction_id", "detail"))


def failed(about: DataFrame, rows: DataFrame) -> DataFrame:
    """analysis_id, error: analyses that end without a result, for a fault in strict mode or malformed hints."""
    strict = rows.filter("status is not null and mode = 'strict'").groupBy("analysis_id").agg(F.min_by("fault", "pos").alias("_f"), F.min_by("status", "pos").alias("_s"))
    strict = strict.select("analysis_id", F.coalesce("_f", "_s").alias("error"))
    bad = F.exists("payslip_hints", lambda h: ~F.coalesce(h["month"].rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.lit(False)) | parsed_amount(h["amount"]).isNull())
    s = F.col("salary_hints")
    rate = s["tolerance_pct"].try_cast("double")
    wrong = (s["tolerance_pct"].isNotNull() & ~F.coalesce(rate.between(0, 1), F.lit(False))) | (s["approx_monthly"].isNotNull() & parsed_amount(s["approx_monthly"]).isNull()) | (s["approx_yearly"].isNotNull() & parsed_amount(s["approx_yearly"]).isNull())
    error = F.coalesce(F.when(bad, F.lit("malformed payslip hint")), F.when(wrong, F.lit("malformed salary hints")))
    hints = about.select("analysis_id", error.alias("error")).filter("error is not null and analysis_id is not null")
    return strict.unionByName(hints).groupBy("analysis_id").agg(F.min("error").alias("error"))


def no_transactions(about: DataFrame) -> DataFrame:
    """Stage 2 warnings of analyses that carry no list of transactions."""
    return about.filter(~F.col("listed")).select(
        "analysis_id", F.lit(2).alias("stage"), F.lit(0).cast("long").alias("seq"), F.lit("no_transactions").alias("code"), F.lit("").alias("transaction_id"), F.lit("the payload has no list of transactions").alias("detail")
    )
