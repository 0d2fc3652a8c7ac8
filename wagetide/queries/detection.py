"""SQL of the whole detection, for DuckDB: pool, scores, regions and placing. Folds that depend on order are recursive; a candidate is a
series named analysis_id/cid, so the SQL of one series serves for all.

What the adapters' rows cannot have is left out and said here: there are no payslips, bands or counterparties; all credits of an analysis
name the same customer segment, so no component is split by employer; no token names an expense."""

from __future__ import annotations


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two lists: the usual table, row by row."""
    best = f"list_max([coalesce(acc[k - 1], 0) + 1 FOR k IN range(1, j + 1) IF {b}[k] = {a}[e[1]]])"
    return f"coalesce(list_max(list_reduce([[i] FOR i IN range(1, len({a}) + 1)], lambda acc, e: [greatest(acc[j], coalesce({best}, 0)) FOR j IN range(1, len({b}) + 1)], [0::bigint FOR j IN range(1, len({b}) + 1)])), 0)"


def jaccard(a: str, b: str) -> str:
    return f"(len(list_distinct(list_intersect({a}, {b})))::double / nullif(len(list_distinct(list_concat({a}, {b}))), 0))"


def sequence(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 1.0::double ELSE {lcs(a, b)}::double / greatest(len({a}), len({b})) END"


#: From e (pairs): the score of the descriptions, and of the whole.
EDGES = f"""ew AS (SELECT *, round(0.9::double * {jaccard("ta", "tb")} + 0.1::double * {sequence("ta", "tb")}, 6) AS words, CASE WHEN rel <= 0.10 THEN 1.0::double ELSE greatest(0.0::double, 1 - (rel - 0.10::double)) END AS money FROM e),
ed AS (SELECT analysis_id, id_a, id_b, round(words, 4) AS description, round(words * 0.35::double + date * 0.25::double + money * 0.15::double + channel * 0.15::double + counterparty * 0.10::double + conflict, 4) AS final FROM ew)"""

_COMMON = "list_sort(list_reduce(list(employers), lambda x, y: list_intersect(x, y)))"

#: From f (features), g (groups), ed: the pool as pl (analysis_id, cid, source, prior, channel, employers, sources, coverage, rows) and mem, one row a credit.
POOL = f"""fo AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY date, pos) AS o FROM f),
link AS (SELECT analysis_id, id_a AS a, id_b AS b FROM ed WHERE final >= 0.55 UNION ALL SELECT analysis_id, id_b, id_a FROM ed WHERE final >= 0.55),
reach AS (SELECT analysis_id, id AS a, id AS b FROM fo UNION SELECT r.analysis_id, r.a, l.b FROM reach r JOIN link l ON l.analysis_id = r.analysis_id AND l.a = r.b),
comp AS (SELECT analysis_id, a AS id, min(b) AS head FROM reach GROUP BY ALL),
cno AS (SELECT *, dense_rank() OVER (PARTITION BY analysis_id ORDER BY head) - 1 AS idx FROM comp),
sets AS (
  SELECT analysis_id, 'skeleton_' || lpad(g.idx::varchar, 3, '0') AS cid, 'skeleton_grouping' AS source, g.final AS prior, fo.* EXCLUDE (analysis_id) FROM fo JOIN g USING (analysis_id, skeleton) WHERE g.n >= 2 AND g.final >= 0.45
  UNION ALL SELECT analysis_id, 'graph_' || lpad(c.idx::varchar, 3, '0'), 'graph_clustering', NULL, fo.* EXCLUDE (analysis_id) FROM fo JOIN cno c USING (analysis_id, id)),
chan AS (SELECT analysis_id, cid, arg_max(channel, c * 100000 - o) AS channel FROM (SELECT analysis_id, cid, channel, count(*) AS c, min(o) AS o FROM sets GROUP BY ALL) GROUP BY ALL),
made AS (
  SELECT analysis_id, cid, source, count(*) AS n, coalesce(max(prior), round(least(1.0::double, 0.50::double + 0.25::double * least(1.0::double, count(*) / 12.0::double)), 4)) AS prior, {_COMMON} AS employers, list_sort(list(pos)) AS rows,
         count(*) || '_credits' || CASE source WHEN 'skeleton_grouping' THEN '_across_' || count(DISTINCT date_trunc('month', date)) || '_months' ELSE '' END AS coverage
  FROM sets GROUP BY analysis_id, cid, source HAVING count(*) >= 2),
cand AS (
  SELECT analysis_id, row_number() OVER (PARTITION BY analysis_id ORDER BY n DESC, prior DESC, cid) AS k,
         {{'cid': cid, 'source': source, 'prior': prior, 'channel': channel, 'employers': employers, 'coverage': coverage, 'rows': rows, 'sources': [source]}} AS c FROM made JOIN chan USING (analysis_id, cid)),
fold AS (
  SELECT analysis_id, 1::bigint AS k, [c] AS kept FROM cand WHERE k = 1
  UNION ALL SELECT analysis_id, k, CASE WHEN len(hits) = 0 THEN list_append(kept, c) ELSE list_append([s FOR s IN kept IF NOT list_contains([h.cid FOR h IN hits], s.cid)], {{
      'cid': lead.cid, 'source': lead.source, 'prior': list_max([x.prior FOR x IN grp]), 'channel': lead.channel, 'employers': lead.employers, 'coverage': lead.coverage,
      'rows': list_sort(list_distinct(flatten([x.rows FOR x IN grp]))), 'sources': [x.source FOR x IN grp]}}) END
  FROM (SELECT *, list_sort([{{'n': len(x.rows), 'prior': x.prior, 'cid': x.cid, 'x': x}} FOR x IN grp], 'DESC')[1].x AS lead
    FROM (SELECT *, list_prepend(c, hits) AS grp FROM (SELECT d.analysis_id, d.k, d.c, f.kept, [s FOR s IN f.kept IF len(list_intersect(s.rows, d.c.rows)) >= 0.9 * least(len(s.rows), len(d.c.rows))] AS hits
      FROM fold f JOIN cand d ON d.analysis_id = f.analysis_id AND d.k = f.k + 1)))),
merged AS (SELECT analysis_id, unnest(arg_max(kept, k)) AS c FROM fold GROUP BY analysis_id),
extra AS (SELECT analysis_id, list(pos) AS extras FROM fo WHERE list_contains(tokens, 'BONUS') GROUP BY ALL),
parted AS (SELECT analysis_id, c, [p FOR p IN c.rows IF NOT list_contains(coalesce(extras, []), p)] AS rest, [p FOR p IN c.rows IF list_contains(coalesce(extras, []), p)] AS gone FROM merged LEFT JOIN extra USING (analysis_id)),
counted AS (SELECT *, len(gone) > 0 AND len(rest) >= 2 AS splits, sum((len(gone) > 0 AND len(rest) >= 2)::int) OVER (PARTITION BY analysis_id ORDER BY c.prior DESC, c.cid) - 1 AS no FROM parted),
named AS (
  SELECT analysis_id, c.cid AS cid, c.rows AS rows, c FROM counted WHERE NOT splits UNION ALL SELECT analysis_id, c.cid || '_main', rest, c FROM counted WHERE splits
  UNION ALL SELECT analysis_id, c.cid || '_bonus_' || lpad(no::varchar, 2, '0'), gone, c FROM counted WHERE splits),
taken AS (SELECT analysis_id, unnest(rows) AS pos FROM named),
loose AS (SELECT analysis_id, pos, amount::double AS x, row_number() OVER (PARTITION BY analysis_id ORDER BY amount, pos) AS k, count(*) OVER (PARTITION BY analysis_id) AS m FROM fo ANTI JOIN taken USING (analysis_id, pos)),
pile AS (
  SELECT analysis_id, k, [{{'xs': [x], 'ps': [pos]}}] AS piles FROM loose WHERE k = 1 AND m >= 4
  UNION ALL SELECT analysis_id, k, CASE WHEN spot IS NULL THEN list_append(piles, {{'xs': [x], 'ps': [pos]}})
      ELSE [CASE WHEN i = spot THEN {{'xs': list_append(piles[i].xs, x), 'ps': list_append(piles[i].ps, pos)}} ELSE piles[i] END FOR i IN range(1, len(piles) + 1)] END
  FROM (SELECT l.analysis_id, l.k, l.x, l.pos, p.piles, list_min([i FOR i IN range(1, len(p.piles) + 1) IF abs(l.x - p.piles[i].xs[len(p.piles[i].xs) // 2 + 1]) <= 0.10 * p.piles[i].xs[len(p.piles[i].xs) // 2 + 1]]) AS spot
    FROM pile p JOIN loose l ON l.analysis_id = p.analysis_id AND l.k = p.k + 1)),
last AS (SELECT analysis_id, arg_max(piles, k) AS piles FROM pile GROUP BY ALL),
back AS (SELECT analysis_id, i, piles[i].ps AS rows FROM (SELECT analysis_id, piles, unnest(range(1, len(piles) + 1)) AS i FROM last) WHERE len(piles[i].ps) >= 4),
pl AS (
  SELECT analysis_id, cid, c.source AS source, c.prior AS prior, c.channel AS channel, c.employers AS employers, c.sources AS sources, c.coverage AS coverage, rows FROM named
  UNION ALL SELECT analysis_id, 'amount_date_' || lpad((i - 1)::varchar, 3, '0'), 'amount_date_fallback', 0.0, 'unknown_credit', [], ['amount_date_fallback'], '', rows FROM back),
mem AS (SELECT analysis_id, cid, source, fo.* EXCLUDE (analysis_id) FROM (SELECT analysis_id, cid, source, unnest(rows) AS pos FROM pl) JOIN fo USING (analysis_id, pos))"""

#: From mem: the series of all candidates, under one name each.
SERIES = "s AS (SELECT analysis_id || '/' || cid AS analysis_id, date, pos, amount::double AS x, row_number() OVER (PARTITION BY analysis_id, cid ORDER BY date, pos) AS i, count(*) OVER (PARTITION BY analysis_id, cid) AS n FROM mem)"


def best(specificity: str, regions: str) -> str:
    """From fit and pf: the best model of each series in each region, as bm."""
    period = "CASE period WHEN 7 THEN 'weekly_same_weekday' WHEN 14 THEN 'fortnightly_same_weekday' ELSE 'four_weekly' END"
    return f"""spec(model, spec, ord) AS (SELECT * FROM {specificity} AS t(model, spec, ord)),
two AS (SELECT DISTINCT analysis_id FROM s WHERE n >= 2),
al AS (SELECT analysis_id, region, model, fit, coverage, matched, expected, missing FROM fit SEMI JOIN two USING (analysis_id)
  UNION ALL SELECT analysis_id, region, {period}, fit, coverage, matched, expected, '' FROM pf SEMI JOIN two USING (analysis_id), (SELECT unnest({regions}) AS region)
  UNION ALL SELECT DISTINCT analysis_id, region, 'irregular_salary_like', CASE WHEN n >= 3 THEN 0.30 ELSE 0 END::double, CASE WHEN n >= 3 THEN 1 ELSE 0 END::double, CASE WHEN n >= 3 THEN n ELSE 0 END::int, CASE WHEN n >= 3 THEN n ELSE 0 END::int, '' FROM s, (SELECT unnest({regions}) AS region)),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id, region ORDER BY fit DESC, spec DESC, matched DESC, ord) AS r FROM al JOIN spec USING (model)) WHERE r = 1)"""


#: From mem, bm, m (regimes), about (analysis_id, region, explicit): every candidate's score, as sc.
SCORES = f"""duo AS (SELECT a.analysis_id, a.cid, {jaccard("a.tokens", "b.tokens")} AS j FROM mem a JOIN mem b ON a.analysis_id = b.analysis_id AND a.cid = b.cid AND a.pos < b.pos),
alike AS (SELECT analysis_id, cid, round(avg(j), 6) AS j FROM duo GROUP BY ALL),
mch AS (SELECT analysis_id, cid, arg_max(channel, c * 100000 - p) AS channel FROM (SELECT analysis_id, cid, channel, count(*) AS c, min(pos) AS p FROM mem GROUP BY ALL) GROUP BY ALL),
ev AS (
  SELECT analysis_id, cid, any_value(source) AS source, count(*)::int AS n, min(date) AS a, max(date) AS z, count(CASE WHEN len(employers) > 0 THEN 1 END) AS with_name, len(list_reduce(list(employers), lambda x, y: list_intersect(x, y))) AS shared,
         bool_or(list_has_any(hints, ['PAYROLL', 'SALARY', 'WAGES', 'WAGE', 'STAFF PAY', 'MONTHLY PAY'])) AS payroll, avg(list_has_any(hints, ['PAYROLL', 'SALARY', 'WAGES', 'WAGE'])::int) AS strong, avg((len(negatives) > 0)::int)::double AS other
  FROM mem GROUP BY ALL),
pt AS (
  SELECT ev.*, d.fit AS date_fit, d.coverage, d.model AS payday, d.missing, l.fit AS local_fit, m.model AS regime, about.region, explicit,
         CASE WHEN ev.n < 2 THEN 0 WHEN with_name >= 2 AND shared > 0 THEN round(least(1, j + 0.05::double), 6) ELSE j END::double AS words,
         CASE m.model WHEN 'stable' THEN 1.0 WHEN 'stable_with_step_change' THEN 0.85 WHEN 'stable_with_minor_variation' THEN 0.80 WHEN 'one_off_final_pay_outlier' THEN 0.80 WHEN 'bonus_or_extra_pay_outlier' THEN 0.75 WHEN 'variable_but_recurring' THEN 0.55 ELSE 0.20 END::double AS money,
         CASE mch.channel WHEN 'bacs_or_direct_credit' THEN CASE WHEN payroll THEN 0.95 ELSE 0.65 END WHEN 'faster_payment' THEN CASE WHEN payroll THEN 0.80 ELSE 0.55 END ELSE CASE WHEN payroll THEN 0.40 ELSE 0.30 END END::double AS way,
         round(CASE WHEN with_name >= 0.8 * ev.n THEN 0.02 ELSE 0 END + CASE WHEN strong >= 0.5 THEN 0.03 ELSE 0 END, 4)::double AS context, round(-0.20::double * other, 6) AS penalty
  FROM ev JOIN about USING (analysis_id) LEFT JOIN alike USING (analysis_id, cid) JOIN mch USING (analysis_id, cid) JOIN bm d ON d.analysis_id = ev.analysis_id || '/' || ev.cid AND d.region = 'EnglandAndWales'
  JOIN bm l ON l.analysis_id = d.analysis_id AND l.region = about.region JOIN m ON m.analysis_id = d.analysis_id),
su AS (SELECT *, round(greatest(0.0::double, least(1.0::double, 0.30::double * date_fit + 0.25::double * words + 0.20::double * money + 0.10::double * way + 0.10::double * coverage + 0.05::double * context + 0 + penalty)), 4) AS whole FROM pt
  WHERE source <> 'amount_date_fallback' OR local_fit >= 0.60 AND n >= 4),
sc AS (
  SELECT *, CASE source WHEN 'amount_date_fallback' THEN least(whole, 0.55::double) ELSE whole END AS confidence,
         CASE WHEN source = 'amount_date_fallback' THEN 'unknown_recurring_credit' WHEN other >= 0.5 THEN 'recurring_income_not_salary_candidate' WHEN regime = 'one_off_final_pay_outlier' THEN 'final_pay_candidate'
           WHEN regime = 'bonus_or_extra_pay_outlier' THEN 'bonus_or_extra_pay_candidate' WHEN regime = 'too_variable' AND way <= 0.50 AND with_name > 0 THEN 'expense_reimbursement_candidate' WHEN whole >= 0.70 THEN 'probable_salary'
           WHEN whole >= 0.55 THEN 'possible_salary' ELSE 'unknown_recurring_credit' END AS kind,
         CASE WHEN payday IN ('weekly_same_weekday', 'fortnightly_same_weekday', 'four_weekly', 'irregular_salary_like') THEN '' ELSE missing END AS gone FROM su),
pc AS (
  SELECT *, CASE WHEN cid LIKE '%\\_bonus\\___' ESCAPE '\\' THEN 'bonus_or_extra_pay_candidate' ELSE kind END AS candidate_type,
         row_number() OVER (PARTITION BY analysis_id, confidence >= 0.40 ORDER BY confidence DESC, cid)::int AS rank, count(CASE WHEN confidence >= 0.40 THEN 1 END) OVER (PARTITION BY analysis_id) AS above FROM sc),
placed AS (SELECT *, CASE WHEN confidence >= 0.40 AND rank <= 10 THEN 'returned' WHEN confidence >= 0.40 AND rank <= 20 THEN 'cap_overflow' WHEN confidence < 0.40 AND rank <= greatest(0, 10 - greatest(0, above - 10)) THEN 'below_threshold' ELSE 'none' END AS placed FROM pc)"""

#: From sc, bm: regions that fit the candidates of analyses without one, as rg; warnings of each analysis, as wn.
REGIONS = """rf AS (
  SELECT sc.analysis_id, sc.cid, b.region, CASE WHEN b.model IN ('weekly_same_weekday', 'fortnightly_same_weekday', 'four_weekly', 'irregular_salary_like') THEN 0 ELSE b.fit END::double AS fit
  FROM sc JOIN bm b ON b.analysis_id = sc.analysis_id || '/' || sc.cid WHERE NOT explicit AND n >= 2 AND payday NOT IN ('weekly_same_weekday', 'fortnightly_same_weekday', 'four_weekly', 'irregular_salary_like')),
near AS (SELECT * FROM (SELECT *, max(fit) OVER (PARTITION BY analysis_id, cid) AS top, count(*) OVER () AS q FROM rf) WHERE top > 0 AND top - fit <= 0.05),
per AS (SELECT analysis_id, region, count(*) AS k FROM near GROUP BY ALL),
tot AS (SELECT analysis_id, count(DISTINCT cid) AS c FROM near GROUP BY ALL),
rg AS (SELECT analysis_id, string_agg(region, '|' ORDER BY region) AS inferred, any_value(c) >= 2 AND max(k) < any_value(c) AS conflict FROM per JOIN tot USING (analysis_id) GROUP BY analysis_id),
wn AS (
  SELECT a.analysis_id, (coalesce(x.named, 0) = 0)::int + coalesce(rg.conflict::int, 0) + coalesce(x.gaps, 0) AS warnings, coalesce(x.named, 0) = 0 AS silent
  FROM (SELECT DISTINCT analysis_id FROM f) a LEFT JOIN (SELECT analysis_id, count(CASE WHEN source <> 'amount_date_fallback' THEN 1 END) AS named, count(CASE WHEN len(gone) > 7 THEN 1 END) AS gaps FROM sc GROUP BY ALL) x USING (analysis_id) LEFT JOIN rg USING (analysis_id))"""
