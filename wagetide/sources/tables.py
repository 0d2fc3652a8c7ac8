"""Adapters that turn plain sales tables into bank credits, the same in Spark and in SQL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What an order's priority says in its description.
WORDS = {"1-URGENT": "PAYROLL", "2-HIGH": "BACS SALARY", "3-MEDIUM": "FPS", "4-NOT SPECIFIED": "PENSION"}
ELSE_WORD = "BONUS"
REGION = {0: "EnglandAndWales", 1: "Scotland", 2: "NorthernIreland"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer is an analysis, an order a transaction."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    word = F.lit(ELSE_WORD)
    for k, v in WORDS.items():
        word = F.when(F.col("o_orderpriority") == k, v).otherwise(word)
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return rows.select(
        F.col("o_custkey").cast("string").alias("analysis_id"), F.lit("lenient").alias("mode"), pos.cast("long").alias("pos"), F.concat(F.lit("o"), "o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.concat("c_mktsegment", F.lit(" LIMITED "), word, F.lit(" REF"), "o_orderkey").alias("description"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amount"),
        F.when(F.col("o_orderstatus") == "P", "debit").otherwise("credit").alias("direction"),
    )


def payroll_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer is paid each month of 2024: on the last day, on the 25th, every 28 days, or on a changing day; some get a rise in
    July, some miss March and August."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    m = c.select("*", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("m"))
    first = F.make_date(F.lit(2024), F.col("m") + 1, F.lit(1))
    k = F.col("c_custkey")
    day = (
        F.when(k % 4 == 0, F.last_day(first)).when(k % 4 == 1, F.date_add(first, 24)).when(k % 4 == 2, F.date_add(F.lit("2024-01-05").cast("date"), F.col("m") * 28))
        .otherwise(F.date_add(first, ((k * 7 + F.col("m") * 11) % 27).cast("int")))
    )
    # in pence, so that no rounding of decimals decides
    pence = 150_000 + F.floor(F.abs("c_acctbal") * 25) + F.when((k % 5 == 0) & (F.col("m") >= 6), 30_000).otherwise(0)
    amount = pence.cast("decimal(16,2)") * F.lit(Decimal("0.01"))
    word = F.when(k % 3 == 0, "PAYROLL").when(k % 3 == 1, "BACS SALARY").otherwise("WAGES")
    rows = m.filter(~((k % 7 == 0) & F.col("m").isin(2, 7)))
    return rows.select(
        k.cast("string").alias("analysis_id"), F.lit("lenient").alias("mode"), F.col("m").cast("long").alias("pos"), F.concat(F.lit("p"), k, F.lit("_"), "m").alias("id"), F.date_format(day, "yyyy-MM-dd").alias("date"),
        F.concat("c_mktsegment", F.lit(" LTD "), word, F.lit(" REF"), F.lpad(F.col("m").cast("string"), 5, "0")).alias("description"), amount.cast("decimal(18,2)").cast("string").alias("amount"), F.lit("credit").alias("direction"),
    )


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is an analysis, an event a transaction."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return e.select(F.col("user_id").cast("string").alias("analysis_id"), F.lit("lenient").alias("mode"), pos.cast("long").alias("pos"), F.concat(F.lit("e"), "event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_type").alias("description"), F.col("value").cast("decimal(18,2)").cast("string").alias("amount"), F.lit("credit").alias("direction"))


def customer_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The UK region that stands for a customer's nation."""
    c, n = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = F.col("n_regionkey") % 3
    region = F.when(r == 0, REGION[0]).when(r == 1, REGION[1]).otherwise(REGION[2])
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").cast("string").alias("analysis_id"), region.alias("country_region"))
