"""Operators applied to the adapters. Results are flat, rounded, and typed as the SQL next door types them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT_REGION, REGIONS, Config
from ..functions import text, workdays
from ..operators import amounts, features, graph, grouping, hints, linking, pool, recurrence, review, scoring, validation
from ..plans.engine import Engine
from ..sources import payloads, tables
from ..storage import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CONFIG = Config()


def query(f):
    QUERIES[f.__name__] = f
    return f


# inputs -----------------------------------------------------------------------------------------------------------------


def _padded(rows: DataFrame) -> DataFrame:
    from ..schemas import TEXT_FIELDS

    return rows.select("analysis_id", "mode", "pos", *[F.col(f) if f in rows.columns else F.lit(None).cast("string").alias(f) for f in TEXT_FIELDS])


def _dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with faults by key: no id, no number, no direction, a loose date, a repeated id, a sign for a direction."""
    r = _padded(tables.order_rows(spark, sf_dir))
    k = F.substring("id", 2, 20).cast("long")
    return r.withColumns({
        "id": F.when(k % 41 == 0, "").when(k % 37 == 0, "same").otherwise(F.col("id")), "amount": F.when(k % 31 == 0, "abc").when(k % 29 == 0, F.concat(F.lit("-"), "amount")).otherwise(F.col("amount")),
        "direction": F.when(k % 23 == 0, "sideways").when(k % 29 == 0, F.lit(None)).when(k % 19 == 0, "CR").otherwise(F.col("direction")), "date": F.when(k % 17 == 0, F.regexp_replace("date", "-", "")).otherwise(F.col("date")),
        "description": F.when(k % 13 == 0, "  ").otherwise(F.col("description")),
    })


def _credits(spark: SparkSession, sf_dir: str, kind: str = "orders") -> DataFrame:
    """Features of an adapter's credits, without hints."""
    rows = {"orders": tables.order_rows, "payroll": tables.payroll_rows, "events": tables.event_rows}[kind](spark, sf_dir)
    normal = features.normalise(validation.checked(_padded(rows)))
    out = features.extract(normal.withColumn("region", F.lit(DEFAULT_REGION)), CONFIG)
    return out.withColumns({"band": F.expr(hints.expected("null", "null", "null")), "is_anchor": F.lit(False), "n_anchors": F.lit(0).cast("long")})


def _slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payslip for every tenth order; every fifth of those has another amount."""
    r = tables.order_rows(spark, sf_dir)
    k = F.substring("id", 2, 20).cast("long")
    s = r.filter(k % 10 == 0).select("analysis_id", F.col("pos").alias("hint_pos"), F.substring("date", 1, 7).alias("month"), (F.col("amount").cast("decimal(28,8)") + F.when(k % 50 == 0, 1).otherwise(0)).cast("decimal(28,8)").alias("amount"), F.concat(F.lit("h"), k).alias("hint_id"))
    return s


def joined(c: Column) -> Column:
    return F.array_join(c, "|")


# validation -------------------------------------------------------------------------------------------------------------


@query
def v_row_status(spark, sf_dir):
    c = validation.checked(_dirty_orders(spark, sf_dir))
    return c.select("analysis_id", "pos", F.coalesce("status", F.lit("accepted")).alias("status"), F.col("value").cast("double").alias("value"), "way", "day")


@query
def v_warning_counts(spark, sf_dir):
    w = validation.row_warnings(validation.checked(_dirty_orders(spark, sf_dir)))
    return w.groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("analysis_id").alias("analyses"))


@query
def v_descriptions(spark, sf_dir):
    """Every description, also those that occur once."""
    c = validation.checked(_dirty_orders(spark, sf_dir)).filter("status is null")
    return c.groupBy("text").agg(F.count("*").alias("n"))


@query
def v_schema_violations(spark, sf_dir):
    r = _dirty_orders(spark, sf_dir).withColumn("direction", F.when(F.col("pos") % 3 == 0, F.lit(None)).otherwise(F.col("direction")))
    r = r.withColumn("source_bank", F.when(F.col("pos") % 5 == 0, "bank"))
    w = r.select("analysis_id", F.col("id").alias("transaction_id"), F.explode(validation.row_faults()).alias("detail"))
    return w.groupBy("analysis_id", "transaction_id", "detail").agg(F.count("*").alias("n"))


# text -------------------------------------------------------------------------------------------------------------------


@query
def n_normalised(spark, sf_dir):
    c = features.normalise(validation.checked(_padded(tables.order_rows(spark, sf_dir))))
    return c.select("analysis_id", "id", "normalised", joined(F.col("tokens")).alias("tokens"), "skeleton")


def _token_counts(docs: DataFrame) -> DataFrame:
    t = text.tokens(text.normalised(F.col("text")))
    return docs.select(F.explode(t).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query
def n_token_counts(spark, sf_dir):
    """Of all documents, whatever their script."""
    return _token_counts(tables.read(spark, sf_dir, "documents"))


@query
def n_unaccented(spark, sf_dir):
    d = tables.read(spark, sf_dir, "conversations")
    n = text.normalised(F.col("text"))
    return d.select("conv_id", "turn", F.length(n).alias("chars"), F.md5(n).alias("digest"))


@query
def n_lcs(spark, sf_dir):
    p = tables.read(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("t"))
    a, b = p.select(F.col("p_partkey").alias("k"), F.col("t").alias("ta")), p.select((F.col("p_partkey") - 1).alias("k"), F.col("t").alias("tb"))
    j = a.join(b, "k")
    return j.select(F.col("k").alias("p_partkey"), text.lcs_length(F.col("ta"), F.col("tb")).alias("lcs"), F.round(text.jaccard(F.col("ta"), F.col("tb")), 6).alias("jaccard"))


@query
def n_common_prefix(spark, sf_dir):
    c = features.normalise(validation.checked(_padded(tables.payroll_rows(spark, sf_dir))))
    g = c.groupBy("analysis_id").agg(F.collect_list("description").alias("d"))
    p = text.with_pattern(g, "d", 0.5, 8)
    return p.select("analysis_id", F.col("pattern.prefix").alias("prefix"), F.col("pattern.suffix").alias("suffix"))


# calendar ---------------------------------------------------------------------------------------------------------------


@query
def c_working_days(spark, sf_dir):
    days, _ = workdays.frames(spark)
    o = tables.read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return o.join(days.filter(F.col("region") == DEFAULT_REGION), "d").select("o_orderkey", "d", "working", "prev", "next", "nearest", "adjacent")


@query
def c_month_ends(spark, sf_dir):
    _, months = workdays.frames(spark)
    o = tables.read(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "MM").alias("month")).groupBy("month").agg(F.count("*").alias("orders"))
    return o.join(months, "month").select("region", "month", "last_day", "last_working", "first_working", "orders")


# features ---------------------------------------------------------------------------------------------------------------


@query
def f_channels(spark, sf_dir):
    c = _credits(spark, sf_dir)
    m = F.col("channel_match")
    return c.select("analysis_id", "id", m["channel"].alias("channel"), F.round(m["confidence"], 4).alias("confidence"), joined(m["matched_tokens"]).alias("matched"), joined(m["alternative_channels"]).alias("others"))


@query
def f_description(spark, sf_dir):
    c = _credits(spark, sf_dir)
    return c.select("analysis_id", "id", joined(F.col("salary_hints")).alias("hints"), joined(F.col("negatives")).alias("negatives"), joined(F.col("negative_categories")).alias("categories"), joined(F.col("employers")).alias("employers"))


@query
def f_amounts_dates(spark, sf_dir):
    c = _credits(spark, sf_dir)
    return c.select("analysis_id", "id", "amount_band", "amount_whole", "day", "weekday", "is_month_end", "is_last_working_day", "is_first_working_day", "is_holiday_adjacent")


# hints ------------------------------------------------------------------------------------------------------------------


@query
def h_anchors(spark, sf_dir):
    a = hints.anchors(_credits(spark, sf_dir), _slips(spark, sf_dir))
    return a.select("analysis_id", "hint_id", "transaction_id", "month", F.col("amount").cast("double").alias("amount"), "ambiguous")


@query
def h_unmatched(spark, sf_dir):
    s = _slips(spark, sf_dir)
    a = hints.anchors(_credits(spark, sf_dir), s)
    w = hints.unmatched_warnings(hints.unmatched(s, a), a)
    return w.select("analysis_id", "detail")


@query
def h_band_modifier(spark, sf_dir):
    c = tables.read(spark, sf_dir, "customer").select("c_custkey", F.abs("c_acctbal").alias("m"))
    b = hints.expected("if(c_custkey % 2 = 0, 4000D, null)", "if(c_custkey % 3 = 0, 60000D, null)", "if(c_custkey % 5 = 0, 0.1D, null)")
    c = c.selectExpr("*", f"{b} as b")
    return c.selectExpr("c_custkey", "round(b.lower, 4) as lower", "round(b.upper, 4) as upper", f"round({hints.modifier('m', 'b')}, 9) as modifier")


# groups and graph -------------------------------------------------------------------------------------------------------


def _groups(spark, sf_dir, kind):
    return grouping.plausibility(grouping.groups(_credits(spark, sf_dir, kind)), CONFIG)


@query
def g_plausibility(spark, sf_dir):
    g = _groups(spark, sf_dir, "payroll")
    return g.select("analysis_id", "skeleton", "idx", "n", F.round("date_part", 6).alias("date_part"), F.round("amount_part", 6).alias("amount_part"), F.round("negative_share", 6).alias("negative_share"), F.round("final", 4).alias("final"), "emitted")


@query
def g_ranked_orders(spark, sf_dir):
    g = _groups(spark, sf_dir, "orders").filter("emitted")
    r = F.row_number().over(Window.partitionBy("analysis_id").orderBy(F.desc("final"), "skeleton"))
    return g.withColumn("rank", r).select("analysis_id", "skeleton", "n", F.round("final", 4).alias("final"), "rank")


@query
def e_pairs(spark, sf_dir):
    p = graph.pairs(graph.blocks(_credits(spark, sf_dir)))
    return p.select("analysis_id", "id_a", "id_b", F.round("date", 4).alias("date"), F.round("amount", 4).alias("amount"), F.round("channel", 4).alias("channel"), F.round("counterparty", 4).alias("counterparty"), F.round("conflict", 4).alias("conflict"))


@query
def e_description(spark, sf_dir):
    p = graph.pairs(graph.blocks(_credits(spark, sf_dir)))
    return p.select("analysis_id", "id_a", "id_b", "description", "final")


def _assembled(spark, sf_dir, kind):
    c = staged(_credits(spark, sf_dir, kind), "credits")
    g = grouping.plausibility(grouping.groups(c), CONFIG)
    return pool.assembled(c, g, graph.edges(graph.pairs(graph.blocks(c)), CONFIG), CONFIG), c


@query
def d_pool(spark, sf_dir):
    m, c = _assembled(spark, sf_dir, "orders")
    ids = joined(F.transform("p", lambda x: x["id"]))
    return pool.with_credits(m, c).select("analysis_id", "cid", "source", F.size("p").alias("n"), "prior", "channel", joined(F.col("employers")).alias("employers"), joined(F.coalesce("merged_sources", F.array("source"))).alias("sources"), "coverage", ids.alias("ids"))


@query
def b_unaccounted(spark, sf_dir):
    m, c = _assembled(spark, sf_dir, "orders")
    taken = pool.members(pool.with_credits(m.filter(F.col("source") != pool.FALLBACK), c)).select("analysis_id", "pos")
    left = c.join(taken, ["analysis_id", "pos"], "left_anti")
    return left.groupBy("analysis_id").agg(F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total"))


# series -----------------------------------------------------------------------------------------------------------------


def _series(spark, sf_dir):
    rows = tables.payroll_rows(spark, sf_dir)
    s = rows.groupBy(F.col("analysis_id")).agg(F.array_sort(F.collect_list(F.struct(F.to_date("date").alias("date"), "pos", F.col("amount").cast("double").alias("amount")))).alias("s"))
    return s.select("analysis_id", F.col("analysis_id").alias("cid"), F.transform("s", lambda x: x["amount"]).alias("amounts"), F.transform("s", lambda x: x["date"]).alias("dates"), F.transform(F.array_sort(F.transform("s", lambda x: F.struct(x["pos"], x["date"].alias("date")))), lambda x: F.dayofmonth(x["date"])).alias("days"))


@query
def a_stats(spark, sf_dir):
    s = amounts.with_stats(_series(spark, sf_dir), "amounts", "st")
    return s.select("analysis_id", *[F.col(f"st.{c}").alias(c) for c in ("count", "mean", "median", "min", "max", "cv", "mad")])


@query
def a_regimes(spark, sf_dir):
    s = amounts.fitted(_series(spark, sf_dir), "amounts", CONFIG)
    return s.select("analysis_id", F.col("amount_fit.model").alias("model"), F.col("amount_fit.score").alias("score"), (-F.col("amount_step.k")).alias("split"), F.round("amount_step.delta", 6).alias("delta"))


@query
def r_monthly(spark, sf_dir):
    s = _series(spark, sf_dir).selectExpr("*", f"{recurrence.most_common('days')} as n")
    m = recurrence.monthly(s, ["analysis_id", "cid"], list(REGIONS))
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("model"), F.col(x).alias("f")) for x in recurrence.MONTHLY])).alias("e")
    return m.select("analysis_id", "region", joined(F.col("missing")).alias("missing"), each).select("analysis_id", "region", "missing", F.col("e.model").alias("model"), F.col("e.f.fit").alias("fit"), F.col("e.f.coverage").alias("coverage"), F.col("e.f.deviation").alias("deviation"), F.col("e.f.matched").alias("matched"), F.col("e.f.expected").alias("expected"))


@query
def r_periodic(spark, sf_dir):
    s = recurrence.with_periods(_series(spark, sf_dir))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.col(m).alias("f")) for m, p in recurrence.PERIODS.items()])).alias("e")
    return s.select("analysis_id", each).select("analysis_id", F.col("e.period").alias("period"), F.col("e.f.fit").alias("fit"), F.col("e.f.coverage").alias("coverage"), F.col("e.f.deviation").alias("deviation"), F.col("e.f.expected").alias("expected"))


@query
def r_best(spark, sf_dir):
    b = recurrence.best(_series(spark, sf_dir), ["analysis_id", "cid"], list(REGIONS))
    return b.select("analysis_id", "region", F.col("best.model").alias("model"), F.col("best.fit").alias("fit"), F.col("best.matched").alias("matched"))


# whole detection --------------------------------------------------------------------------------------------------------


def _detected(spark, sf_dir, kind="payroll"):
    """Detection over an adapter's rows, each analysis with the region of its customer's nation."""
    rows = (tables.payroll_rows if kind == "payroll" else tables.order_rows)(spark, sf_dir)
    about = tables.customer_regions(spark, sf_dir).withColumn("scenario_description", F.lit("adapter"))
    if kind == "payroll":  # every third analysis leaves its region open
        about = about.withColumn("country_region", F.when(F.col("analysis_id").cast("long") % 3 != 0, F.col("country_region")))
    return Engine(spark).tables(payloads.of_rows(rows, about))


@query
def k_scores(spark, sf_dir):
    c = _detected(spark, sf_dir).candidates
    return c.select("analysis_id", "cid", "n", *[F.col(f"score.{x}").alias(x) for x in ("date_pattern_score", "description_similarity_score", "amount_consistency_score", "payment_channel_score", "coverage_score", "context_bonus", "final_score")], "confidence_band", "candidate_type", joined(F.col("gap_summary.missing_months")).alias("missing"))


@query
def l_regions(spark, sf_dir):
    t = _detected(spark, sf_dir)
    return t.regions.select("analysis_id", joined(F.col("inferred")).alias("inferred"), "conflict")


def _spans(spark, sf_dir):
    """A customer's orders of one priority as a candidate."""
    o = tables.read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("analysis_id"), F.col("o_orderpriority").alias("cid"), F.to_date("o_orderdate").alias("d"), "o_orderkey")
    c = o.groupBy("analysis_id", "cid").agg(F.array_sort(F.collect_list("d")).alias("dates"), (F.sum("o_orderkey") % 100 / 100).alias("confidence"))
    c = c.withColumn("pool_ord", F.row_number().over(Window.partitionBy("analysis_id").orderBy("cid")))
    return c.withColumns({"employers": F.array("cid"), "candidate_type": F.when(F.size("dates") >= 2, "probable_salary").otherwise("possible_salary")})


@query
def l_transitions(spark, sf_dir):
    return linking.transitions(_spans(spark, sf_dir)).select("analysis_id", "cid_a", "cid_b", "gap_days", joined(F.col("transition_months")).alias("months"), "same_month")


@query
def z_ranked(spark, sf_dir):
    c = linking.ranked(_spans(spark, sf_dir), 0.40, 2, 2)
    return c.select("analysis_id", "cid", "confidence", "rank", F.coalesce("placed", F.lit("none")).alias("placed"), F.expr(scoring.band("confidence")).alias("band"))


@query
def z_results(spark, sf_dir):
    r = _detected(spark, sf_dir).result
    return r.select("analysis_id", "status", F.col("input_summary.transaction_count").alias("transactions"), F.col("input_summary.credit_count").alias("credits"), F.size("candidate_sets").alias("returned"), F.size("rejected_or_near_miss_sets").alias("near_misses"), F.size("warnings").alias("warnings"))


@query
def z_placed(spark, sf_dir):
    c = _detected(spark, sf_dir, "orders").candidates
    return c.select("analysis_id", "cid", "confidence", "candidate_type", "rank", F.coalesce("placed", F.lit("none")).alias("placed"))


@query
def m_trigger(spark, sf_dir):
    return review.trigger(_detected(spark, sf_dir).result)


@query
def m_payload(spark, sf_dir):
    """What a reviewer reads, parsed back from the payload's JSON."""
    p = review.payloads(_detected(spark, sf_dir).result)
    one = "struct<candidate_sets:array<struct<id:string,confidence:double,transactions:array<struct<transaction_id:string>>>>,country_region:string,metadata:struct<input_summary:struct<credit_count:bigint,date_range_start:string,date_range_end:string>>>"
    p = p.select("analysis_id", F.from_json("payload", one).alias("j")).selectExpr("analysis_id", "j.*").selectExpr("analysis_id", "metadata.input_summary.*", "candidate_sets", "country_region")
    return p.selectExpr(
        "analysis_id", "credit_count", "date_range_start", "date_range_end", "array_join(transform(candidate_sets, c -> concat(c.id, '=', cast(cast(c.confidence as decimal(6,4)) as string))), '|') as sets",
        "aggregate(candidate_sets, 0L, (s, c) -> s + size(c.transactions)) as listed", "country_region",
    )


__all__ = ["QUERIES", "scoring", "linking"]
