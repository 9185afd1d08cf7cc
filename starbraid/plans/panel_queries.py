"""Bindings of the panel analyses, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel as P
from .registry import query
from .tables import MARKET_SQL, PANEL_SQL, market_prices, price_panel, table
from .trip_queries import mean

BASE = 1996 * 12 + 1
BREAK = 1998 * 12 + 4
IDX = "CAST({0} // 10000 * 12 + {0} // 100 % 100 AS INTEGER)"
M = IDX.format("month_key")
RUN = "ROWS UNBOUNDED PRECEDING"


@query("a6_chained_index", f"""
WITH {MARKET_SQL}, s AS (SELECT *, {M} AS m, lag(price) OVER w AS prev, lag({M}) OVER w AS prev_m FROM market WHERE price > 0 WINDOW w AS (PARTITION BY category, state, commodity ORDER BY month_key)),
x AS (SELECT *, coalesce(prev > 0 AND price > 0 AND prev_m >= m - 3, false) AS matched FROM s),
g AS (SELECT category, m, month_key, count(*) FILTER (matched) AS matched_cells, count(*) AS cells_reporting, max(CASE WHEN matched THEN m - prev_m END) AS longest_bridge_months,
  {mean('CASE WHEN matched THEN ln(price / prev) END', 12)} AS log_link, {mean('price')} AS mean_price FROM x GROUP BY ALL),
b AS (SELECT *, matched_cells < 3 AS brk, sum((matched_cells < 3)::INT) OVER (PARTITION BY category ORDER BY m {RUN}) AS seg FROM g),
l AS (SELECT *, CAST(sum(CAST(CASE WHEN brk THEN 0 ELSE log_link END AS DECIMAL(18,12))) OVER (PARTITION BY category, seg ORDER BY m {RUN}) AS DOUBLE) AS lev FROM b),
c AS (SELECT *, max(CASE WHEN m = {BASE} THEN seg END) OVER (PARTITION BY category) AS bseg, max(CASE WHEN m = {BASE} THEN lev END) OVER (PARTITION BY category) AS blev, max(CASE WHEN m = {BASE} THEN mean_price END) OVER (PARTITION BY category) AS bmean FROM l),
d AS (SELECT *, coalesce(seg = bseg, false) AS linked, CASE WHEN coalesce(seg = bseg, false) THEN 100.0::DOUBLE * exp(lev - blev) END AS idx, 100.0::DOUBLE * mean_price / bmean AS naive FROM c)
SELECT category, month_key, matched_cells, cells_reporting, longest_bridge_months, brk AS is_chain_break, CAST(seg AS BIGINT) AS chain_segment, linked AS is_linked_to_base,
  round(CASE WHEN linked AND NOT brk THEN exp(log_link) END, 6) AS monthly_link_relative, round(CASE WHEN linked AND NOT brk THEN 100.0::DOUBLE * (exp(log_link) - 1) END, 4) AS pct_change_since_prior_observation, round(idx, 3) AS chained_index, round(naive, 6) AS naive_mean_index, round(mean_price, 6) AS naive_mean_price, round(naive - idx, 3) AS naive_minus_chained FROM d""")
def a6(spark, sf):
    return P.chained_index(market_prices(spark, sf), ["state", "commodity"], "category", BASE)


LABEL = "printf('%04d-%02d', CAST(({0} - 1) // 12 AS INTEGER), CAST(({0} - 1) % 12 + 1 AS INTEGER))"
STAPLES = ("Brand#1", "Brand#2", "Brand#3")


@query("a7_structural_break", f"""
WITH {MARKET_SQL}, obs AS (SELECT *, {M} AS m FROM market WHERE category IN {STAPLES} AND price > 0), win AS (SELECT * FROM obs WHERE m BETWEEN {BREAK} - 3 AND {BREAK} + 4),
fixed AS (SELECT state, any_value(zone) AS parent FROM win GROUP BY state HAVING count(DISTINCT m) = 8),
summary AS (SELECT count(*) AS panel_markets, count(DISTINCT parent) AS panel_states, array_to_string(list_sort(list_distinct(list(parent))), '; ') AS panel_state_list, array_to_string(list_sort(list(parent || ': ' || state)), '; ') AS panel_market_list FROM fixed),
priced AS (SELECT win.* FROM win JOIN fixed USING (state)),
cells AS (SELECT state, commodity, round({mean(f'CASE WHEN m > {BREAK} THEN ln(price) END', 12)} - {mean(f'CASE WHEN m <= {BREAK} THEN ln(price) END', 12)}, 9) AS ch FROM priced GROUP BY ALL),
lc AS (SELECT count(ch) AS cells_on_both_sides, round(100.0::DOUBLE * (exp({mean('ch', 9)}) - 1), 4) AS lvl, round(100.0::DOUBLE * (exp(quantile_cont(ch, 0.25)) - 1), 4) AS p25, round(100.0::DOUBLE * (exp(quantile_cont(ch, 0.75)) - 1), 4) AS p75 FROM cells),
rel AS (SELECT *, lag(price) OVER w AS prev, lag(m) OVER w AS prev_m FROM priced WINDOW w AS (PARTITION BY state, commodity ORDER BY m)),
links AS (SELECT m, count(*) FILTER (prev > 0 AND prev_m >= m - 3) AS matched_cells, {mean('CASE WHEN prev > 0 AND prev_m >= m - 3 THEN ln(price / prev) END', 12)} AS link, count(*) AS cells_reporting, count(DISTINCT state) AS markets_reporting FROM rel GROUP BY m),
chained AS (SELECT *, sum((matched_cells < 3)::INT) OVER (ORDER BY m {RUN}) AS seg FROM links),
lev AS (SELECT *, CAST(sum(CAST(CASE WHEN matched_cells < 3 THEN 0 ELSE link END AS DECIMAL(18,12))) OVER (PARTITION BY seg ORDER BY m {RUN}) AS DOUBLE) AS lv FROM chained),
anch AS (SELECT *, m - {BREAK} AS t, max(CASE WHEN m = {BREAK} THEN lv END) OVER () AS blv, max(CASE WHEN m = {BREAK} THEN seg END) OVER () AS bseg FROM lev),
wnd AS (SELECT {LABEL.format('m')} AS year_month, t, matched_cells, cells_reporting, markets_reporting, round(100.0::DOUBLE * exp(lv - blv), 6) AS ix, CASE WHEN t <= 0 THEN 'pre' ELSE 'post' END AS segment FROM anch WHERE blv IS NOT NULL AND seg = bseg),
mo AS (SELECT segment, count(*) AS n, min(year_month) AS fm, max(year_month) AS lm, count(*)::DOUBLE AS k, sum(t)::DOUBLE AS st, sum(t * t)::DOUBLE AS tt, CAST(sum(CAST(ix AS DECIMAL(18,6))) AS DOUBLE) AS sy, CAST(sum(CAST(ix AS DECIMAL(18,6)) * t) AS DOUBLE) AS ty, CAST(sum(CAST(ix AS DECIMAL(18,6)) * CAST(ix AS DECIMAL(18,6))) AS DOUBLE) AS yy FROM wnd GROUP BY segment),
f0 AS (SELECT *, (k * ty - st * sy) / (k * tt - st * st) AS slope, (k * ty - st * sy) * (k * ty - st * sy) / nullif((k * tt - st * st) * (k * yy - sy * sy), 0) AS r2 FROM mo), fit AS (SELECT *, (sy - slope * st) / k AS icpt FROM f0),
k AS (SELECT max(slope) FILTER (segment = 'post') - max(slope) FILTER (segment = 'pre') AS sc, max(icpt) FILTER (segment = 'post') - max(icpt) FILTER (segment = 'pre') AS ls FROM fit)
SELECT year_month, t AS months_since_break, segment, markets_reporting, matched_cells, cells_reporting, round(ix, 4) AS staple_index, round(slope, 6) AS segment_slope_per_month, round(icpt, 6) AS segment_fitted_at_break, round(r2, 6) AS segment_r2, n AS segment_n_months, fm AS segment_first_month, lm AS segment_last_month,
  round(icpt + slope * t, 6) AS fitted_index, round(sc, 6) AS slope_change_per_month, round(ls, 6) AS level_shift_at_break, lvl AS within_cell_level_change_pct, p25 AS within_cell_change_p25_pct, p75 AS within_cell_change_p75_pct, cells_on_both_sides, summary.*,
  4 AS window_months_each_side, {LABEL.format(BREAK)} AS break_month FROM wnd JOIN fit USING (segment), k, lc, summary""")
def a7(spark, sf):
    """Markets are states, their parents zones: the panel is chosen by market, the list says both."""
    prices = market_prices(spark, sf).where(F.col("category").isin(*STAPLES))
    return P.structural_break(prices, "state", "zone", ["commodity"], BREAK)


@query("a8_price_dispersion", f"""
WITH {MARKET_SQL}, g AS (SELECT zone, commodity, month_key, count(DISTINCT state) AS k, count(*) AS n, {mean('price')} AS mean, median(price) AS med, min(price) AS lo, max(price) AS hi,
  CAST(sum(CAST(price AS DECIMAL(18,4))) AS DOUBLE) AS s, CAST(sum(CAST(CAST(price AS DECIMAL(38,4)) * CAST(price AS DECIMAL(38,4)) AS DECIMAL(38,8))) AS DOUBLE) AS q FROM market WHERE price > 0 AND zone IS NOT NULL GROUP BY ALL),
d AS (SELECT *, CASE WHEN n > 1 THEN sqrt(greatest((q - s * s / n) / (n - 1), 0)) END AS sd FROM g), c AS (SELECT *, round(sd / mean, 4) AS cv FROM d)
SELECT zone, commodity, month_key, k AS reporting_markets, round(mean, 6) AS mean_price, round(med, 6) AS median_price, round(sd, 4) AS sd_price, lo AS min_price, hi AS max_price, cv AS coefficient_of_variation, round(100.0::DOUBLE * round(sd, 4) / mean, 3) AS cv_pct,
  round(hi / lo, 6) AS max_min_price_ratio, k >= 3 AS meets_market_threshold, round(cv - lag(cv, 12) OVER (PARTITION BY zone, commodity ORDER BY month_key), 4) AS cv_change_vs_12_rows_ago FROM c""")
def a8(spark, sf):
    return P.dispersion(market_prices(spark, sf), "zone", "commodity", "state")


CH = "SELECT *, {M} AS m, lag(price) OVER w AS p, lag({M}) OVER w AS pm FROM {t} WHERE price > 0 WINDOW w AS (PARTITION BY {c} ORDER BY month_key)"


def sums(x: str, y: str, d: str, tag: str) -> str:
    t = lambda c: f"CAST(sum(CAST({c} AS DECIMAL({d}))) AS DOUBLE)"
    return f"count(*)::DOUBLE * {t(f'{x} * {y}')} - {t(x)} * {t(y)} AS {tag}t, count(*)::DOUBLE * {t(f'{x} * {x}')} - {t(x)} * {t(x)} AS {tag}x, count(*)::DOUBLE * {t(f'{y} * {y}')} - {t(y)} * {t(y)} AS {tag}y"


@query("a9_pass_through", f"""
WITH {MARKET_SQL}, {PANEL_SQL.split('),', 1)[1]},
fo AS (SELECT state, m, count(CASE WHEN pm = m - 1 THEN ln(price / p) END) AS cells, round({mean('CASE WHEN pm = m - 1 THEN ln(price / p) END', 12)}, 9) AS food, round({mean('price')}, 4) AS food_level FROM ({CH.format(M=M, t='market', c='state, commodity')}) GROUP BY ALL),
fu AS (SELECT state, zone, m, round(ln(price / p), 9) AS fuel, round(price, 4) AS fuel_level FROM ({CH.format(M=M, t='panel', c='state')}) WHERE pm = m - 1),
pr AS (SELECT fo.*, fu.zone AS zone, fu.fuel, fu.fuel_level, k AS lag_months FROM fo, (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS k) JOIN fu ON fo.state = fu.state AND fo.m - k = fu.m WHERE cells > 0),
bo AS (SELECT *, zone AS z FROM pr UNION ALL SELECT *, 'ALL ZONES' FROM pr),
g AS (SELECT z AS zone, lag_months, count(*) AS n_pairs, count(DISTINCT state) AS n_states, count(DISTINCT m) AS n_months, min(m) AS first_month, max(m) AS last_month, {sums('food', 'fuel', '30,18', 'd')}, {sums('food_level', 'fuel_level', '38,8', 'l')},
  round(100.0::DOUBLE * {mean('food', 9)}, 6) AS mean_food_pct_change, round(100.0::DOUBLE * {mean('fuel', 9)}, 6) AS mean_fuel_pct_change, round({mean('cells')}, 3) AS mean_matched_cells_per_pair FROM bo GROUP BY ALL),
cv AS (SELECT count(DISTINCT state) AS states_in_overlap, array_to_string(list_sort(list_distinct(list(state))), ', ') AS l, (SELECT count(DISTINCT state) FROM panel WHERE price > 0) AS states_with_fuel_data, (SELECT count(DISTINCT state) FROM market WHERE price > 0) AS states_with_food_data, (SELECT count(*) FROM nation) AS federating_units_total FROM pr)
SELECT zone, lag_months, n_pairs, n_states, n_months, {LABEL.format('first_month')} AS first_food_month, {LABEL.format('last_month')} AS last_food_month, CASE WHEN n_pairs >= 6 AND dx > 0 AND dy > 0 THEN round(dt / (sqrt(dx) * sqrt(dy)), 6) END AS corr_log_changes,
  CASE WHEN n_pairs >= 6 AND lx > 0 AND ly > 0 THEN round(lt / (sqrt(lx) * sqrt(ly)), 6) END AS corr_levels_spurious_prone, n_pairs >= 6 AS meets_pair_threshold, 6 AS min_pairs_required, mean_food_pct_change, mean_fuel_pct_change, mean_matched_cells_per_pair,
  states_in_overlap, states_with_fuel_data, states_with_food_data, federating_units_total, round(100.0::DOUBLE * states_in_overlap / federating_units_total, 2) AS pct_of_federating_units,
  'association, not cause; markets of ' || l || ' only: ' || states_in_overlap || ' of ' || federating_units_total || ' units' AS interpretation_note FROM g, cv""")
def a9(spark, sf):
    return P.pass_through(market_prices(spark, sf), price_panel(spark, sf), table(spark, sf, "nation"), "state", "zone", "commodity")


AVG = "CAST(sum(CAST(price AS DECIMAL(18,4))) OVER ({0}) AS DOUBLE) / count(*) OVER ({0})"
GEO_SQL = f"""{PANEL_SQL}, r0 AS (SELECT *, {AVG.format('PARTITION BY month_key')} AS nm, {AVG.format('PARTITION BY month_key, zone')} AS zm, count(*) OVER (PARTITION BY month_key) AS reporting,
  rank() OVER (PARTITION BY month_key ORDER BY price DESC) + (count(*) OVER (PARTITION BY month_key, price) - 1) / 2.0::DOUBLE AS price_rank FROM panel),
ra AS (SELECT *, 100.0::DOUBLE * (price / nm - 1) AS premium, 100.0::DOUBLE * (price / zm - 1) AS premium_zone, price > nm AS above, lag(price) OVER w AS price_prev, lag(price_rank) OVER w AS rank_prev, first_value(price_rank) OVER w AS rank_first FROM r0 WINDOW w AS (PARTITION BY state ORDER BY month_key))"""


@query("a12a_geography", f"""WITH {GEO_SQL} SELECT month_key, state, zone, round(price, 2) AS price, round(nm, 2) AS national_mean, round(premium, 4) AS premium_vs_national_pct, round(zm, 2) AS zone_mean, round(premium_zone, 4) AS premium_vs_zone_pct, price_rank AS rank_most_expensive_first, rank_prev AS rank_previous_month,
  above AS above_national_mean, round(100.0::DOUBLE * (price / price_prev - 1), 4) AS state_mom_pct, reporting AS states_reporting FROM ra""")
def a12a(spark, sf):
    return P.geography(price_panel(spark, sf))


def corr(x: str, y: str) -> str:
    p, q = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    n = f"count({p})::DOUBLE"
    top = f"({n} * sum({x} * {y}) - sum({p}) * sum({q}))"
    low = f"(({n} * sum(CASE WHEN {y} IS NOT NULL THEN {x} * {x} END) - sum({p}) * sum({p})) * ({n} * sum(CASE WHEN {x} IS NOT NULL THEN {y} * {y} END) - sum({q}) * sum({q})))"
    return f"CASE WHEN count({p}) >= 2 AND {low} > 0 THEN {top} / sqrt({low}) END"


SQUARES = "CAST(sum(CAST({0} AS DECIMAL(38,6)) * CAST({0} AS DECIMAL(38,6))) AS DOUBLE)"


@query("a12b_national", f"""
WITH {GEO_SQL}, g AS (SELECT month_key, count(*) AS states_reporting, {mean('price')} AS mean, quantile_cont(price, [0.25, 0.5, 0.75]) AS q, min(price) AS lo, max(price) AS hi, {SQUARES.format('round(price - nm, 6)')} AS ss, {SQUARES.format('round(zm - nm, 6)')} AS bt,
  arg_min(state, (price, state)) AS cheapest_state, arg_max(state, (price, state)) AS dearest_state, {corr('price_rank', 'rank_prev')} AS rp, {corr('price_rank', 'rank_first')} AS rf FROM ra GROUP BY month_key)
SELECT month_key, states_reporting, round(mean, 2) AS national_mean, round(q[2], 2) AS national_median, round(100.0::DOUBLE * (mean / first_value(mean) OVER w), 4) AS index_first_month_100, round(100.0::DOUBLE * (mean / lag(mean) OVER w - 1), 4) AS mom_pct, round(100.0::DOUBLE * (mean / lag(mean, 12) OVER w - 1), 4) AS yoy_pct,
  round(avg(round(mean, 6)) OVER (ORDER BY month_key ROWS 2 PRECEDING), 2) AS rolling_3m_mean, round(lo, 2) AS min_state_price, cheapest_state, round(hi, 2) AS max_state_price, dearest_state, round(hi - lo, 2) AS range, round(hi / lo, 4) AS max_min_ratio, round(q[1], 2) AS p25, round(q[3], 2) AS p75, round(q[3] - q[1], 2) AS iqr,
  round(sqrt(ss / states_reporting), 4) AS sd_population, round(100.0::DOUBLE * (sqrt(ss / states_reporting) / mean), 4) AS cv_pct, round(100.0::DOUBLE * bt / ss, 4) AS zone_share_of_variance_pct, round(rp, 6) AS spearman_vs_previous_month, round(rf, 6) AS spearman_vs_first_month,
  mean = max(mean) OVER () AS is_peak_month, mean = min(mean) OVER () AS is_trough_month FROM g WINDOW w AS (ORDER BY month_key)""")
def a12b(spark, sf):
    return P.national(price_panel(spark, sf))


@query("a12c_states", f"""
WITH {GEO_SQL}, s AS (SELECT *, {M} AS m, round(premium, 6) AS pct FROM ra),
i AS (SELECT *, m - row_number() OVER (PARTITION BY state, above ORDER BY m) AS island FROM s), r AS (SELECT state, above, island, count(*) AS n FROM i GROUP BY ALL),
l AS (SELECT state, coalesce(max(n) FILTER (above), 0) AS longest_run_above, coalesce(max(n) FILTER (NOT above), 0) AS longest_run_below FROM r GROUP BY state),
t AS (SELECT state, zone, count(*) AS months, count(*) FILTER (above) AS months_above, round({mean('price')}, 6) AS mean_price, {mean('pct', 6)} AS mp, round(median(pct), 4) AS median_premium_pct, round(stddev_samp(pct), 4) AS sd_premium,
  round(min(pct), 4) AS min_premium_pct, round(max(pct), 4) AS max_premium_pct, round({mean('price_rank')}, 3) AS mean_rank, round(stddev_pop(price_rank), 3) AS sd_rank, min(price_rank) AS highest_rank, max(price_rank) AS lowest_rank FROM s GROUP BY ALL)
SELECT CAST(rank() OVER (ORDER BY mp DESC) AS INTEGER) AS premium_rank, round(mp, 4) AS mean_premium_pct, * EXCLUDE (mp), months - months_above AS months_at_or_below, round(months_above / months, 4) AS share_above,
  CASE WHEN months_above / months >= 0.8 THEN 'persistent premium' WHEN (months - months_above) / months >= 0.8 THEN 'persistent discount' ELSE 'no persistent position' END AS persistence, 0.8::DOUBLE AS persistence_threshold_share FROM t JOIN l USING (state)""")
def a12c(spark, sf):
    return P.states(price_panel(spark, sf))


@query("a12d_zone_months", f"""
WITH {GEO_SQL}, g AS (SELECT zone, month_key, count(*) AS states_in_zone, {mean('price')} AS mean, min(price) AS lo, max(price) AS hi, any_value(nm) AS nm, sqrt({SQUARES.format('round(price - zm, 6)')} / count(*)) AS sd FROM ra GROUP BY ALL), p AS (SELECT *, 100.0::DOUBLE * (mean / nm - 1) AS pr FROM g)
SELECT zone, month_key, states_in_zone, round(mean, 2) AS zone_mean, round(nm, 2) AS national_mean, round(pr, 4) AS zone_premium_vs_national_pct, round(100.0::DOUBLE * (sd / mean), 4) AS within_zone_cv_pct, round(lo, 2) AS zone_min_state_price, round(hi, 2) AS zone_max_state_price,
  CAST(rank() OVER (PARTITION BY month_key ORDER BY mean DESC) AS INTEGER) AS zone_rank_most_expensive_first, round(CAST(sum(CAST(round(pr, 6) AS DECIMAL(18,6))) OVER (PARTITION BY zone) AS DOUBLE) / count(*) OVER (PARTITION BY zone), 4) AS zone_mean_premium_over_period_pct FROM p""")
def a12d(spark, sf):
    return P.zone_months(price_panel(spark, sf))


@query("a15_flagged_series", f"""
WITH {PANEL_SQL}, g AS (SELECT month_key, round({mean('price')}, 6) AS national_mean, count(*) AS n_states FROM panel GROUP BY ALL)
SELECT *, CASE WHEN month_key < 20000101 THEN 'train' ELSE 'test' END AS "window", round(100.0::DOUBLE * national_mean / lag(national_mean) OVER (ORDER BY month_key) - 100, 4) AS mom_pct_change FROM g""")
def a15(spark, sf):
    return P.flagged_series(price_panel(spark, sf), 20000101)


@query("a16_dense_months", f"""
WITH {PANEL_SQL}, d AS (SELECT strptime(CAST(month_key AS VARCHAR), '%Y%m%d')::DATE AS d FROM panel), c AS (SELECT CAST(year(x) * 10000 + month(x) * 100 + 1 AS INTEGER) AS month_key FROM (SELECT unnest(generate_series(min(d)::TIMESTAMP, max(d)::TIMESTAMP, INTERVAL 1 MONTH)) AS x FROM d)),
s AS (SELECT DISTINCT state FROM panel) SELECT s.state, c.month_key, p.price FROM s CROSS JOIN c LEFT JOIN panel p ON p.state = s.state AND p.month_key = c.month_key""")
def a16(spark, sf):
    return P.dense_months(price_panel(spark, sf), "state", "price")


QCOLS = ", ".join(f"round({mean(f'CASE WHEN q = {i} THEN price END')}, 6) AS q{i}" for i in (1, 2, 3, 4))


@query("a16b_pivot", f"WITH {PANEL_SQL}, x AS (SELECT *, (month_key // 100 % 100 + 2) // 3 AS q FROM panel WHERE month_key // 10000 = 1998) SELECT state, {QCOLS} FROM x GROUP BY state")
def a16b(spark, sf):
    return P.pivoted(price_panel(spark, sf), "state", 1998)
