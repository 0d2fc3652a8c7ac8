"""SQL of the same results, for DuckDB over the same tables."""

from __future__ import annotations

from ..config import REGIONS, Config
from ..functions import text, workdays
from ..operators import features, recurrence
from ..sources import tables
from . import detection

_C = Config()


def _values(rows) -> str:
    lit = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(words)) + "]"


_WORD = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tables.WORDS.items()) + f" ELSE '{tables.ELSE_WORD}' END"
ORDERS = f"""orow AS (
  SELECT o_custkey::varchar AS analysis_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::bigint AS pos, o_orderkey AS k,
         'o' || o_orderkey AS id, o_orderdate::date AS date, c_mktsegment || ' LIMITED ' || {_WORD} || ' REF' || o_orderkey AS description,
         o_totalprice::decimal(18,2) AS amount, CASE WHEN o_orderstatus = 'P' THEN 'debit' ELSE 'credit' END AS direction
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
PAYROLL = """prow AS (
  SELECT c_custkey::varchar AS analysis_id, m::bigint AS pos, 'p' || c_custkey || '_' || m AS id,
         CASE c_custkey % 4 WHEN 0 THEN last_day(make_date(2024, (m + 1)::int, 1)) WHEN 1 THEN make_date(2024, (m + 1)::int, 25)
           WHEN 2 THEN DATE '2024-01-05' + (m * 28)::int ELSE make_date(2024, (m + 1)::int, 1) + ((c_custkey * 7 + m * 11) % 27)::int END AS date,
         c_mktsegment || ' LTD ' || CASE c_custkey % 3 WHEN 0 THEN 'PAYROLL' WHEN 1 THEN 'BACS SALARY' ELSE 'WAGES' END || ' REF' || lpad(m::varchar, 5, '0') AS description,
         ((150000 + floor(abs(c_acctbal) * 25)::bigint + CASE WHEN c_custkey % 5 = 0 AND m >= 6 THEN 30000 ELSE 0 END)::decimal(16,2) * 0.01)::decimal(18,2) AS amount, 'credit' AS direction
  FROM customer, range(12) AS t(m) WHERE NOT (c_custkey % 7 = 0 AND m IN (2, 7)))"""
_STOP = _list(text.STOP_WORDS)


def _normal(source: str) -> str:
    """Normalised credits of a row table, as n."""
    return rf"""n0 AS (
  SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(upper(description), '\bLIMITED\b', 'LTD', 'g'), '[^A-Z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS normalised
  FROM {source} WHERE direction = 'credit'),
n1 AS (SELECT *, [t FOR t IN string_split(normalised, ' ') IF t <> ''] AS tokens FROM n0),
n2 AS (SELECT *, [regexp_replace(t, '([A-Z])\d{{2,}}$', '\1') FOR t IN tokens IF NOT regexp_matches(t, '^\d{{4,}}$') AND NOT list_contains({_STOP}, t)] AS cut FROM n1),
n AS (SELECT * EXCLUDE cut, coalesce(nullif(array_to_string([t FOR t IN cut IF t <> '' AND NOT list_contains({_STOP}, t)], ' '), ''), '__EMPTY__') AS skeleton FROM n2)"""



def _folded(c: str) -> str:
    """Normalised text. Accents go; the one letter of these tables that becomes two is named."""
    upper = f"replace(upper(strip_accents(replace(coalesce({c}, ''), 'ß', 'ss'))), 'ẞ', 'SS')"
    legal = rf"regexp_replace(regexp_replace({upper}, '\bPUBLIC LIMITED COMPANY\b', 'PLC', 'g'), '\bLIMITED\b', 'LTD', 'g')"
    return f"trim(regexp_replace(regexp_replace({legal}, '[^A-Z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


def _phrase_table(name: str, rows) -> str:
    body = _values((i, k, p, p.count(" ") + 1) for i, (k, p) in enumerate(rows))
    return f"{name} AS (SELECT * FROM {body} AS t(ord, kind, phrase, words))"


_HAS = "contains(' ' || n.normalised || ' ', ' ' || p.phrase || ' ')"
_several = [x for x in _C.hint_phrases() if " " in x[1]]
_single = [p for _, p in _C.hint_phrases() if " " not in p]
_pieces = {w for _, p in _C.channel_phrases() for w in p.split(" ")}
_NOT_EMPLOYER = _list(sorted({*text.STOP_WORDS, *text.CHANNEL_CODES, *text.ROLE_WORDS, *text.LEGAL_FORMS, *_pieces}))


def _features(source: str) -> str:
    """Features of a row table's credits, as f."""
    return f"""{_normal(source)},
{_phrase_table("channels", _C.channel_phrases())},
{_phrase_table("several", _several)},
{_phrase_table("negative", _C.negative_phrases())},
ch AS (SELECT n.analysis_id, n.id, arg_max(p.kind, p.words * 1000 - p.ord) AS best, max(p.words) AS words, list_sort(list(DISTINCT p.phrase)) AS matched, list_sort(list(DISTINCT p.kind)) AS kinds
  FROM n JOIN channels p ON {_HAS} GROUP BY ALL),
hp AS (SELECT n.analysis_id, n.id, list(p.phrase ORDER BY p.ord) AS found FROM n JOIN several p ON {_HAS} GROUP BY ALL),
np AS (SELECT n.analysis_id, n.id, list(p.phrase ORDER BY p.ord) AS found, list(p.kind ORDER BY p.ord) AS kinds FROM n JOIN negative p ON {_HAS} GROUP BY ALL),
f0 AS (
  SELECT n.*, coalesce(ch.best, 'unknown_credit') AS channel, ch.words, coalesce(ch.matched, []) AS matched, coalesce([k FOR k IN ch.kinds IF k <> ch.best], []) AS others,
         list_concat(coalesce(hp.found, []), list_distinct_ordered) AS hints, coalesce(np.found, []) AS negatives, coalesce(np.kinds, []) AS neg_kinds
  FROM (SELECT *, [t FOR t, i IN tokens IF list_contains({_list(_single)}, t) AND list_position(tokens, t) = i] AS list_distinct_ordered FROM n) n
  LEFT JOIN ch USING (analysis_id, id) LEFT JOIN hp USING (analysis_id, id) LEFT JOIN np USING (analysis_id, id)),
f AS (SELECT *, [t FOR t, i IN tokens IF list_position(tokens, t) = i AND NOT list_contains({_NOT_EMPLOYER}, t) AND NOT list_contains(hints, t) AND NOT regexp_matches(t, '^[0-9]+$') AND length(t) >= 2] AS employers FROM f0)"""


def _calendar(first: int, last: int) -> str:
    rows = [(r, str(d)) for r in REGIONS for y in range(first - 1, last + 2) for d in sorted(workdays.holidays(y, r))]
    return f"""holiday AS (SELECT region, d::date AS d FROM {_values(rows)} AS t(region, d)),
day0 AS (SELECT r.region, g.d::date AS d, isodow(g.d) < 6 AND h.d IS NULL AS working, isodow(g.d) < 6 AND h.d IS NOT NULL AS closed
  FROM (SELECT unnest({_list(REGIONS)}) AS region) r, (SELECT unnest(generate_series(DATE '{first - 1}-12-01', DATE '{last + 1}-01-31', INTERVAL 1 DAY)) AS d) g
  LEFT JOIN holiday h ON h.region = r.region AND h.d = g.d::date),
cal0 AS (SELECT *, max(CASE WHEN working THEN d END) OVER (PARTITION BY region ORDER BY d) AS prev, min(CASE WHEN working THEN d END) OVER (PARTITION BY region ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next,
  coalesce(lag(closed) OVER (PARTITION BY region ORDER BY d), false) OR coalesce(lead(closed) OVER (PARTITION BY region ORDER BY d), false) AS adjacent FROM day0),
cal AS (SELECT *, CASE WHEN d - prev <= next - d THEN prev ELSE next END AS nearest FROM cal0 WHERE d BETWEEN DATE '{first}-01-01' AND DATE '{last}-12-31'),
mon AS (SELECT region, date_trunc('month', d)::date AS month, max(d) AS last_day, max(CASE WHEN working THEN d END) AS last_working, min(CASE WHEN working THEN d END) AS first_working FROM cal GROUP BY ALL)"""


_DIRTY = f"""{ORDERS},
dirty AS (
  SELECT analysis_id, pos, k, CASE WHEN k % 41 = 0 THEN '' WHEN k % 37 = 0 THEN 'same' ELSE id END AS id,
         CASE WHEN k % 31 = 0 THEN NULL WHEN k % 29 = 0 THEN -amount ELSE amount END AS amount,
         CASE WHEN k % 23 = 0 THEN 'bad' WHEN k % 29 = 0 THEN NULL WHEN k % 19 = 0 THEN 'credit' ELSE direction END AS direction,
         CASE WHEN k % 17 = 0 THEN NULL ELSE date END AS date, CASE WHEN k % 13 = 0 THEN '__EMPTY__' ELSE description END AS description FROM orow),
way AS (SELECT * EXCLUDE direction, CASE WHEN direction = 'bad' THEN NULL WHEN direction IS NOT NULL THEN direction WHEN amount > 0 THEN 'credit' WHEN amount < 0 THEN 'debit' END AS way FROM dirty),
ok AS (SELECT *, id <> '' AND amount IS NOT NULL AND way IS NOT NULL AND date IS NOT NULL AS valid FROM way),
st AS (SELECT *, CASE WHEN NOT valid THEN 'row_invalid' WHEN row_number() OVER (PARTITION BY analysis_id, id, valid ORDER BY pos) > 1 THEN 'duplicate_id' WHEN way <> 'credit' THEN 'non_credit_row_skipped' ELSE 'accepted' END AS status FROM ok)"""

_GROUPS = """g0 AS (SELECT *, lag(date) OVER (PARTITION BY analysis_id, skeleton ORDER BY date, pos) AS before, median(amount::double) OVER (PARTITION BY analysis_id, skeleton) AS mid FROM f),
g1 AS (
  SELECT analysis_id, skeleton, count(*)::int AS n, count(DISTINCT date_trunc('month', date)) AS months, datediff('month', date_trunc('month', min(date)), date_trunc('month', max(date))) + 1 AS span,
         count(CASE WHEN date - before BETWEEN 26 AND 32 THEN 1 END)::double AS good, count(CASE WHEN date - before <> 0 THEN 1 END)::double AS gaps,
         CASE WHEN avg(amount::double) = 0 THEN 0 ELSE round(stddev_pop(amount::double) / avg(amount::double), 6) END AS cv,
         avg(CASE WHEN len(negatives) > 0 THEN 1.0::double ELSE 0.0::double END) AS negative_share FROM g0 GROUP BY ALL),
g2 AS (
  SELECT *, CASE WHEN n < 2 THEN 0.0::double ELSE round(0.5::double * least(1.0::double, months::double / span) + 0.5::double * CASE WHEN gaps > 0 THEN good / gaps ELSE 0.0::double END, 6) END AS date_part,
         round(CASE WHEN cv <= 0.02 THEN 1.0::double WHEN cv >= 0.20 THEN 0.0::double ELSE 1 - (cv - 0.02::double) / 0.18::double END, 6) AS amount_part FROM g1),
g AS (SELECT *, round(0.40::double * date_part + 0.30::double * amount_part + 0.15::double * (1 - negative_share), 4) AS final,
  (row_number() OVER (PARTITION BY analysis_id ORDER BY skeleton) - 1)::int AS idx FROM g2)"""

_SERIES = f"""{PAYROLL},
s AS (SELECT *, amount::double AS x, row_number() OVER (PARTITION BY analysis_id ORDER BY date, pos) AS i, count(*) OVER (PARTITION BY analysis_id) AS n FROM prow)"""

_FITS = f"""dom AS (SELECT analysis_id, arg_max(d, c * 1000 - p) AS nday FROM (SELECT analysis_id, day(date) AS d, count(*) AS c, min(pos) AS p FROM s GROUP BY ALL) GROUP BY ALL),
spine AS (SELECT analysis_id, unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH))::date AS month FROM s GROUP BY analysis_id),
pre AS (SELECT spine.analysis_id, m.region, spine.month, m.last_day, m.last_working, m.first_working, c.d AS fixed, c.prev, c.next, c.nearest
  FROM spine JOIN dom USING (analysis_id) JOIN mon m ON m.month = spine.month JOIN cal c ON c.region = m.region AND c.d = spine.month + (least(nday, day(m.last_day)) - 1)::int),
guess AS (UNPIVOT pre ON last_day, last_working, first_working, fixed, prev, next, nearest INTO NAME which VALUE day),
dev AS (SELECT g.analysis_id, g.region, g.which, g.month, min(abs(s.date - g.day))::double AS off FROM guess g LEFT JOIN s ON s.analysis_id = g.analysis_id AND date_trunc('month', s.date) = g.month GROUP BY ALL),
fit AS (
  SELECT analysis_id, region, CASE which {" ".join(f"WHEN '{w}' THEN '{m}'" for w, m in zip(("last_day", "last_working", "first_working", "fixed", "prev", "next", "nearest"), recurrence.MONTHLY, strict=True))} END AS model,
         coalesce(string_agg(CASE WHEN off IS NULL THEN strftime(month, '%Y-%m') END, '|' ORDER BY month), '') AS missing,
         round(0.60::double * CASE WHEN avg(off) IS NULL THEN 0.0::double ELSE greatest(0.0::double, 1 - avg(off) / 7) END + 0.40::double * (count(off)::double / count(*)), 6) AS fit,
         round(count(off)::double / count(*), 6) AS coverage, coalesce(round(avg(off), 4), 999.0::double) AS deviation, count(off)::int AS matched, count(*)::int AS expected
  FROM dev GROUP BY analysis_id, region, which)"""

_MONTHLY = f"{_SERIES}, {_calendar(2024, 2025)}, {_FITS}"
_PERIODIC = """per7 AS (
  SELECT analysis_id, period, n, avg(abs(gap - period))::double AS off, any_value(steady) AS steady, greatest(1, floor((max(date) - min(date))::double / period)::int + 1) AS expected
  FROM (SELECT s.*, (date - lag(date) OVER (PARTITION BY analysis_id ORDER BY i))::double AS gap FROM s), (SELECT unnest([7, 14, 28]) AS period),
       (SELECT analysis_id AS a, max(c)::double / sum(c) AS steady FROM (SELECT analysis_id, isodow(date) AS w, count(*) AS c FROM s GROUP BY ALL) GROUP BY analysis_id) WHERE a = analysis_id GROUP BY analysis_id, period, n),
pf AS (SELECT analysis_id, period::int AS period, round(0.55::double * CASE WHEN off <= 2 THEN 1.0::double ELSE greatest(0.0::double, 1 - (off - 2) / period) END + 0.25::double * steady + 0.20::double * least(1.0::double, n::double / expected), 6) AS fit,
  round(least(1.0::double, n::double / expected), 6) AS coverage, round(off, 4) AS deviation, n::int AS matched, expected::int AS expected FROM per7)"""

_SLIPS = """slip AS (SELECT analysis_id, strftime(date, '%Y-%m') AS month, (amount + CASE WHEN k % 50 = 0 THEN 1 ELSE 0 END)::decimal(18,2) AS amount, 'h' || k AS hint_id FROM orow WHERE k % 10 = 0),
hit AS (SELECT s.*, o.id AS transaction_id, count(*) OVER (PARTITION BY s.hint_id) > 1 AS ambiguous FROM slip s JOIN orow o ON o.analysis_id = s.analysis_id AND strftime(o.date, '%Y-%m') = s.month AND o.amount = s.amount AND o.direction = 'credit')"""

_PAIRS = """blk AS (SELECT *, CASE WHEN len(employers) > 0 THEN employers ELSE ['__skel__::' || skeleton] END AS blocks FROM f),
pr AS (SELECT a.analysis_id, a.id AS id_a, b.id AS id_b, a.date AS da, b.date AS db, a.amount::double AS xa, b.amount::double AS xb, a.channel AS ca, b.channel AS cb, len(a.negatives) > 0 AS na, len(b.negatives) > 0 AS nb, a.tokens AS ta, b.tokens AS tb
  FROM blk a JOIN blk b ON a.analysis_id = b.analysis_id AND a.pos < b.pos AND list_has_any(a.blocks, b.blocks)),
psc AS (SELECT *, abs(da - db) AS gap, abs(xa - xb) / greatest(xa, xb) AS rel FROM pr),
e AS (SELECT *, CASE WHEN gap = 0 THEN 0.0 WHEN gap BETWEEN 26 AND 32 OR gap BETWEEN 12 AND 16 OR gap BETWEEN 5 AND 9 THEN 1.0 WHEN gap BETWEEN 24 AND 34 OR gap BETWEEN 10 AND 18 OR gap BETWEEN 3 AND 11 THEN 0.6
    WHEN date_trunc('month', da) = date_trunc('month', db) THEN 0.3 ELSE 0.1 END::double AS date,
  round(CASE WHEN rel <= 0.10 THEN 1.0::double ELSE greatest(0.0::double, 1 - (rel - 0.10::double)) END, 4) AS amount,
  CASE WHEN ca = 'unknown_credit' OR cb = 'unknown_credit' THEN 0.5 WHEN ca = cb THEN 1.0 ELSE 0.2 END::double AS channel, 0.5::double AS counterparty, CASE WHEN na <> nb THEN -0.20 ELSE 0.0 END::double AS conflict FROM psc)"""

_BANDS = "CASE " + " ".join(f"WHEN amount >= {low} THEN '{name}'" for low, name in reversed(features.BANDS)) + " END"
_LEVELS = """st AS (SELECT analysis_id, n, median(x) AS mid, CASE WHEN avg(x) = 0 THEN 0 ELSE round(stddev_pop(x) / avg(x), 6) END AS cv FROM s GROUP BY ALL),
mad AS (SELECT s.analysis_id, median(abs(x - mid)) AS mad FROM s JOIN st USING (analysis_id) GROUP BY ALL),
o AS (SELECT s.*, st.cv, s.n >= 4 AND CASE WHEN mad = 0 THEN x <> mid ELSE abs(x - mid) / mad >= 3.0 END AS isout FROM s JOIN st USING (analysis_id) JOIN mad USING (analysis_id)),
oo AS (SELECT analysis_id, count(CASE WHEN isout THEN 1 END) AS k, max(CASE WHEN isout THEN i END) AS place, round(stddev_pop(CASE WHEN NOT isout THEN x END) / avg(CASE WHEN NOT isout THEN x END), 6) AS rest FROM o GROUP BY ALL),
sp AS (
  SELECT s.analysis_id, k, median(CASE WHEN i <= k THEN x END) AS lm, median(CASE WHEN i > k THEN x END) AS rm, stddev_pop(CASE WHEN i <= k THEN x END) / avg(CASE WHEN i <= k THEN x END) AS lc, stddev_pop(CASE WHEN i > k THEN x END) / avg(CASE WHEN i > k THEN x END) AS rc
  FROM s, range(2, 1000) AS t(k) WHERE n >= 4 AND k <= n - 2 GROUP BY s.analysis_id, k),
bs AS (SELECT analysis_id, min(k) AS split, max(delta) AS delta FROM (SELECT *, abs(rm - lm) / lm AS delta, max(abs(rm - lm) / lm) OVER (PARTITION BY analysis_id) AS top FROM sp WHERE lc <= 0.10 AND rc <= 0.10 AND abs(rm - lm) / lm >= 0.05) WHERE delta = top GROUP BY analysis_id),
m AS (
  SELECT st.analysis_id, CASE WHEN cv <= 0.02 THEN 'stable' WHEN oo.k = 1 AND rest <= 0.10 AND place IN (1, st.n) THEN 'one_off_final_pay_outlier' WHEN oo.k = 1 AND rest <= 0.10 THEN 'bonus_or_extra_pay_outlier'
    WHEN split IS NOT NULL THEN 'stable_with_step_change' WHEN cv <= 0.10 THEN 'stable_with_minor_variation' WHEN cv <= 0.30 THEN 'variable_but_recurring' ELSE 'too_variable' END AS model, cv, split, delta
  FROM st JOIN oo USING (analysis_id) LEFT JOIN bs USING (analysis_id))"""
_REGIME = f"{_SERIES}, {_LEVELS}"

_SPECIFICITY = _values((m, x, i) for i, (m, x) in enumerate(recurrence.MODELS))
_REGION = "CASE n_regionkey % 3 WHEN 0 THEN 'EnglandAndWales' WHEN 1 THEN 'Scotland' ELSE 'NorthernIreland' END"


def _detected(rows: str, source: str, first: int, last: int, explicit: str) -> str:
    """The whole detection over an adapter's rows, up to placed, rg and wn."""
    parts = (
        rows, _features(source), _GROUPS, _PAIRS, detection.EDGES, detection.POOL, detection.SERIES, _calendar(first, last), _FITS, _PERIODIC, _LEVELS, detection.best(_SPECIFICITY, _list(REGIONS)),
        f"about AS (SELECT c_custkey::varchar AS analysis_id, CASE WHEN {explicit} THEN {_REGION} ELSE 'EnglandAndWales' END AS region, {explicit} AS explicit FROM customer JOIN nation ON c_nationkey = n_nationkey)", detection.SCORES, detection.REGIONS,
    )
    return "WITH RECURSIVE " + ",\n".join(parts)


_PAY = _detected(PAYROLL, "prow", 2024, 2025, "c_custkey % 3 <> 0")
_ORD = _detected(ORDERS, "orow", 1992, 2002, "true")
_BAND = "CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.70 THEN 'medium_high' WHEN confidence >= 0.55 THEN 'medium' WHEN confidence >= 0.40 THEN 'low' ELSE 'very_low' END"
_TOP = """t AS (SELECT analysis_id, list(confidence ORDER BY confidence DESC) AS cs FROM placed WHERE placed = 'returned' GROUP BY ALL),
r AS (SELECT wn.analysis_id, CASE WHEN cs IS NULL AND silent THEN 'no_signal_detected' WHEN cs IS NULL THEN 'no_candidates_no_warning' WHEN cs[1] < 0.55 THEN 'low_top_confidence' WHEN len(cs) > 1 AND cs[1] - cs[2] <= 0.05 THEN 'tied_candidates' ELSE 'clear_winner' END AS reason
  FROM wn LEFT JOIN t USING (analysis_id))"""
_SPANS = """sp AS (SELECT o_custkey::varchar AS analysis_id, o_orderpriority AS cid, min(o_orderdate::date) AS first, max(o_orderdate::date) AS last, count(*) AS n, (sum(o_orderkey) % 100)::double / 100 AS confidence FROM orders GROUP BY ALL)"""

ORACLES = {
    "n_lcs": f"""WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS t FROM part)
SELECT a.p_partkey, ({detection.lcs("a.t", "b.t")})::int AS lcs, round({detection.jaccard("a.t", "b.t")}, 6) AS jaccard FROM p a JOIN p b ON b.p_partkey = a.p_partkey + 1""",
    "n_common_prefix": f"""WITH {PAYROLL}, x AS (SELECT analysis_id, min(description) AS a, max(description) AS z, min(reverse(description)) AS ra, max(reverse(description)) AS rz FROM prow GROUP BY ALL)
SELECT analysis_id, left(a, list_max([k FOR k IN range(0, least(length(a), length(z)) + 1) IF left(a, k) = left(z, k)])::bigint) AS prefix,
reverse(left(ra, list_max([k FOR k IN range(0, least(length(ra), length(rz)) + 1) IF left(ra, k) = left(rz, k)])::bigint)) AS suffix FROM x""",
    "e_description": f"WITH {ORDERS}, {_features('orow')}, {_PAIRS}, {detection.EDGES} SELECT analysis_id, id_a, id_b, description, final FROM ed",
    "d_pool": f"""WITH RECURSIVE {ORDERS}, {_features("orow")}, {_GROUPS}, {_PAIRS}, {detection.EDGES}, {detection.POOL},
ids AS (SELECT analysis_id, cid, string_agg(id, '|' ORDER BY pos) AS ids FROM mem GROUP BY ALL)
SELECT analysis_id, cid, source, len(rows)::int AS n, prior, channel, array_to_string(employers, '|') AS employers, array_to_string(sources, '|') AS sources, coverage, ids FROM pl JOIN ids USING (analysis_id, cid)""",
    "b_unaccounted": f"""WITH RECURSIVE {ORDERS}, {_features("orow")}, {_GROUPS}, {_PAIRS}, {detection.EDGES}, {detection.POOL}
SELECT analysis_id, count(*)::bigint AS n, sum(amount)::decimal(18,2)::double AS total FROM fo ANTI JOIN taken USING (analysis_id, pos) GROUP BY ALL""",
    "k_scores": f"""{_PAY} SELECT analysis_id, cid, n, round(date_fit, 4) AS date_pattern_score, round(words, 4) AS description_similarity_score, round(money, 4) AS amount_consistency_score, round(way, 4) AS payment_channel_score,
round(coverage, 4) AS coverage_score, round(context, 4) AS context_bonus, confidence AS final_score, {_BAND} AS confidence_band, candidate_type, gone AS missing FROM placed""",
    "l_regions": f"{_PAY} SELECT analysis_id, inferred, conflict FROM rg",
    "z_results": f"""{_PAY}, c AS (SELECT analysis_id, count(CASE WHEN placed = 'returned' THEN 1 END) AS returned, count(CASE WHEN placed IN ('cap_overflow', 'below_threshold') THEN 1 END) AS near_misses FROM placed GROUP BY ALL),
x AS (SELECT analysis_id, count(*) AS rows FROM f GROUP BY ALL)
SELECT analysis_id, 'ok' AS status, rows::bigint AS transactions, rows::bigint AS credits, coalesce(returned, 0)::int AS returned, coalesce(near_misses, 0)::int AS near_misses, warnings::int AS warnings FROM wn JOIN x USING (analysis_id) LEFT JOIN c USING (analysis_id)""",
    "z_placed": f"{_ORD} SELECT analysis_id, cid, confidence, candidate_type, rank, placed FROM placed",
    "m_trigger": f"{_PAY}, {_TOP} SELECT analysis_id, reason IN ('no_signal_detected', 'low_top_confidence', 'tied_candidates') AS invoke, reason FROM r",
    "m_payload": f"""{_PAY}, x AS (SELECT analysis_id, count(*) AS rows, strftime(min(date), '%Y-%m-%d') AS a, strftime(max(date), '%Y-%m-%d') AS z FROM f GROUP BY ALL),
l AS (SELECT analysis_id, string_agg(cid || '=' || confidence::decimal(6,4), '|' ORDER BY rank) AS sets, sum(n) AS listed FROM placed WHERE placed = 'returned' GROUP BY ALL)
SELECT analysis_id, rows::bigint AS credit_count, a AS date_range_start, z AS date_range_end, coalesce(sets, '') AS sets, coalesce(listed, 0)::bigint AS listed, coalesce(region, 'EnglandAndWales') AS country_region FROM x LEFT JOIN l USING (analysis_id) JOIN about USING (analysis_id)""",
    "l_transitions": f"""WITH {_SPANS} SELECT a.analysis_id, a.cid AS cid_a, b.cid AS cid_b, (b.first - a.last)::int AS gap_days, strftime(a.last, '%Y-%m') || '|' || strftime(b.first, '%Y-%m') AS months, date_trunc('month', a.last) = date_trunc('month', b.first) AS same_month
FROM sp a JOIN sp b ON a.analysis_id = b.analysis_id AND a.cid <> b.cid AND a.n >= 2 AND b.n >= 2 AND b.first >= a.first AND b.first - a.last BETWEEN 0 AND 62""",
    "z_ranked": f"""WITH {_SPANS}, r AS (SELECT *, row_number() OVER (PARTITION BY analysis_id, confidence >= 0.40 ORDER BY confidence DESC, cid)::int AS rank, count(CASE WHEN confidence >= 0.40 THEN 1 END) OVER (PARTITION BY analysis_id) AS above FROM sp)
SELECT analysis_id, cid, confidence, rank, CASE WHEN confidence >= 0.40 AND rank <= 2 THEN 'returned' WHEN confidence >= 0.40 AND rank <= 4 THEN 'cap_overflow' WHEN confidence < 0.40 AND rank <= greatest(0, 2 - greatest(0, above - 2)) THEN 'below_threshold' ELSE 'none' END AS placed,
CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.70 THEN 'medium_high' WHEN confidence >= 0.55 THEN 'medium' WHEN confidence >= 0.40 THEN 'low' ELSE 'very_low' END AS band FROM r""",
    "v_row_status": f"WITH {_DIRTY} SELECT analysis_id, pos, status, abs(amount)::double AS value, way, date AS day FROM st",
    "v_warning_counts": f"WITH {_DIRTY} SELECT status AS code, count(*)::bigint AS n, count(DISTINCT analysis_id)::bigint AS analyses FROM st WHERE status <> 'accepted' GROUP BY ALL",
    "v_descriptions": f"WITH {_DIRTY} SELECT description AS text, count(*)::bigint AS n FROM st WHERE status = 'accepted' GROUP BY ALL",
    "v_schema_violations": f"""WITH {_DIRTY}, w AS (SELECT o.analysis_id, o.pos, d.id, CASE WHEN o.pos % 3 = 0 OR o.k % 23 <> 0 AND o.k % 29 = 0 THEN NULL WHEN o.k % 23 = 0 THEN 'sideways' WHEN o.k % 19 = 0 THEN 'CR' ELSE o.direction END AS direction FROM orow o JOIN dirty d USING (k)),
f AS (SELECT analysis_id, id, pos, 1 AS kind FROM w WHERE direction IS NULL UNION ALL SELECT analysis_id, id, pos, 2 FROM w WHERE pos % 5 = 0 UNION ALL SELECT analysis_id, id, pos, 3 FROM w WHERE direction NOT IN ('credit', 'debit'))
SELECT analysis_id, id AS transaction_id, '[''transactions'', ' || pos || CASE kind WHEN 1 THEN ']: ''direction'' is missing' WHEN 2 THEN ']: unknown property ''source_bank''' ELSE ', ''direction'']: must be one of credit, debit' END AS detail, count(*)::bigint AS n FROM f GROUP BY ALL""",
    "n_normalised": f"WITH {ORDERS}, {_normal('orow')} SELECT analysis_id, id, normalised, array_to_string(tokens, '|') AS tokens, skeleton FROM n",
    "n_token_counts": f"""WITH d AS (SELECT {_folded("text")} AS t FROM documents), t AS (SELECT unnest(string_split(t, ' ')) AS token FROM d)
SELECT token, count(*)::bigint AS n FROM t WHERE token <> '' GROUP BY ALL""",
    "n_unaccented": f"SELECT conv_id, turn, length(t)::int AS chars, md5(t) AS digest FROM (SELECT conv_id, turn, {_folded('text')} AS t FROM conversations)",
    "c_working_days": f"WITH {_calendar(1994, 2002)} SELECT o_orderkey, d, working, prev, next, nearest, adjacent FROM orders JOIN cal ON d = o_orderdate::date WHERE region = 'EnglandAndWales'",
    "c_month_ends": f"WITH {_calendar(1994, 2002)} SELECT region, month, last_day, last_working, first_working, count(*)::bigint AS orders FROM orders JOIN mon ON month = date_trunc('month', o_orderdate) GROUP BY ALL",
    "f_channels": f"WITH {ORDERS}, {_features('orow')} SELECT analysis_id, id, channel, round(CASE WHEN words IS NULL THEN 0.30 ELSE least(1.0, 0.55 + 0.15 * (words - 1)) END::double, 4) AS confidence, array_to_string(matched, '|') AS matched, array_to_string(others, '|') AS others FROM f",
    "f_description": f"WITH {ORDERS}, {_features('orow')} SELECT analysis_id, id, array_to_string(hints, '|') AS hints, array_to_string(negatives, '|') AS negatives, array_to_string(list_distinct(neg_kinds), '|') AS categories, array_to_string(employers, '|') AS employers FROM f",
    "f_amounts_dates": f"""WITH {ORDERS}, {_calendar(1994, 2002)} SELECT analysis_id, id, {_BANDS} AS amount_band, floor(amount)::bigint AS amount_whole, day(date)::int AS day, (isodow(date) - 1)::int AS weekday, last_day(date) = date AS is_month_end,
 m.last_working = date AS is_last_working_day, m.first_working = date AS is_first_working_day, c.adjacent AS is_holiday_adjacent
 FROM orow JOIN cal c ON c.d = date AND c.region = 'EnglandAndWales' JOIN mon m ON m.month = date_trunc('month', date) AND m.region = 'EnglandAndWales' WHERE direction = 'credit'""",
    "h_anchors": f"WITH {ORDERS}, {_SLIPS} SELECT analysis_id, hint_id, transaction_id, month, amount::double AS amount, ambiguous FROM hit",
    "h_unmatched": f"WITH {ORDERS}, {_SLIPS} SELECT analysis_id, 'no credit has the month and amount of payslip hint ''' || hint_id || '''' AS detail FROM slip WHERE hint_id NOT IN (SELECT hint_id FROM hit) AND analysis_id IN (SELECT analysis_id FROM hit)",
    "h_band_modifier": """WITH b AS (SELECT c_custkey, abs(c_acctbal) AS m, CASE WHEN c_custkey % 2 = 0 THEN 4000.0::double WHEN c_custkey % 3 = 0 THEN 60000.0::double / 12 END AS e, CASE WHEN c_custkey % 5 = 0 THEN 0.1::double ELSE 0.2::double END AS t FROM customer),
x AS (SELECT *, e * (1 - t) AS lo, e * (1 + t) AS hi FROM b)
SELECT c_custkey, round(lo, 4) AS lower, round(hi, 4) AS upper, round(CASE WHEN e IS NULL OR m BETWEEN lo AND hi THEN 1.0::double ELSE greatest(0.5::double, 1 - 0.5::double * greatest(lo - m, m - hi) / e) END, 9) AS modifier FROM x""",
    "g_plausibility": f"WITH {PAYROLL}, {_features('prow')}, {_GROUPS} SELECT analysis_id, skeleton, idx, n, date_part, amount_part, round(negative_share, 6) AS negative_share, final, n >= 2 AND final >= 0.45 AS emitted FROM g",
    "g_ranked_orders": f"WITH {ORDERS}, {_features('orow')}, {_GROUPS} SELECT analysis_id, skeleton, n, final, row_number() OVER (PARTITION BY analysis_id ORDER BY final DESC, skeleton)::int AS rank FROM g WHERE n >= 2 AND final >= 0.45",
    "e_pairs": f"WITH {ORDERS}, {_features('orow')}, {_PAIRS} SELECT analysis_id, id_a, id_b, date, amount, channel, counterparty, conflict FROM e",
    "a_stats": f"WITH {_SERIES}, c AS (SELECT *, median(x) OVER (PARTITION BY analysis_id) AS mid FROM s) SELECT analysis_id, count(*)::int AS count, round(avg(x), 2) AS mean, round(median(x), 2) AS median, round(min(x), 2) AS min, round(max(x), 2) AS max, round(stddev_pop(x) / avg(x), 6) AS cv, round(median(abs(x - mid)), 2) AS mad FROM c GROUP BY analysis_id",
    "a_regimes": f"WITH {_REGIME} SELECT analysis_id, model, (CASE model WHEN 'stable' THEN 1.0 WHEN 'stable_with_step_change' THEN 0.85 WHEN 'stable_with_minor_variation' THEN 0.80 WHEN 'one_off_final_pay_outlier' THEN 0.80 WHEN 'bonus_or_extra_pay_outlier' THEN 0.75 WHEN 'variable_but_recurring' THEN 0.55 ELSE 0.20 END)::double AS score, CASE WHEN model NOT IN ('stable', 'one_off_final_pay_outlier', 'bonus_or_extra_pay_outlier') THEN split::int END AS split, CASE WHEN model NOT IN ('stable', 'one_off_final_pay_outlier', 'bonus_or_extra_pay_outlier') THEN round(delta, 6) END AS delta FROM m",
    "r_monthly": f"WITH {_MONTHLY} SELECT analysis_id, region, missing, model, fit, coverage, deviation, matched, expected FROM fit",
    "r_periodic": f"WITH {_SERIES}, {_PERIODIC} SELECT analysis_id, period, fit, coverage, deviation, expected FROM pf",
    "r_best": f"""WITH {_MONTHLY}, {_PERIODIC},
spec(model, spec, ord) AS (SELECT * FROM {_values((m, s, i) for i, (m, s) in enumerate(recurrence.MODELS))} AS t(model, spec, ord)),
al AS (SELECT analysis_id, region, model, fit, matched FROM fit
  UNION ALL SELECT analysis_id, region, CASE period WHEN 7 THEN 'weekly_same_weekday' WHEN 14 THEN 'fortnightly_same_weekday' ELSE 'four_weekly' END, fit, matched FROM pf, (SELECT unnest({_list(REGIONS)}) AS region)
  UNION ALL SELECT DISTINCT analysis_id, region, 'irregular_salary_like', 0.30::double, n::int FROM s, (SELECT unnest({_list(REGIONS)}) AS region))
SELECT analysis_id, region, model, fit, matched FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id, region ORDER BY fit DESC, spec DESC, matched DESC, ord) AS r FROM al JOIN spec USING (model)) WHERE r = 1""",
}
