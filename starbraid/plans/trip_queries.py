"""Bindings of the trip analyses to the driver tables, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import trip_analyses as A
from ..operators.dims import calendar
from ..sources.io import inventory
from .registry import query
from .tables import TRIPS_SQL, market_prices, price_panel, table, trips, zones, MARKET_SQL, PANEL_SQL

MEAN = "CAST(sum(CAST({0} AS DECIMAL(18,{1}))) AS DOUBLE) / nullif(CAST(count({0}) AS DOUBLE), 0)"


def mean(c: str, scale: int = 4) -> str:
    return MEAN.format(c, scale)


def tot(c: str, scale: int = 4) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(18,{scale}))) AS DOUBLE)"


RIDES = "WITH e AS (SELECT user_id % 27 AS pickup_zone, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS date_key, CAST(hour(ts) AS INTEGER) AS pickup_hour, value AS total, CAST(user_id % 50 AS DOUBLE) AS distance, CASE WHEN event_id % 11 > 0 THEN CAST(event_id % 3600 AS DOUBLE) END AS seconds FROM events)"


def rides(spark, sf):
    """Events as rides with integer keys; some zones are in no dimension, some rides have no duration."""
    c = F.col
    return table(spark, sf, "events").select(
        (c("user_id") % 27).alias("pickup_zone"), E.date_key("ts").alias("date_key"), F.hour("ts").alias("pickup_hour"), c("value").alias("total"), (c("user_id") % 50).cast("double").alias("distance"),
        F.when(c("event_id") % 11 > 0, (c("event_id") % 3600).cast("double")).alias("seconds"),
    )


@query("a1_demand_profile", f"""
{RIDES}, z AS (SELECT n_nationkey AS zone_key, coalesce(CASE WHEN n_nationkey <> 24 THEN r_name END, 'Unattributed') AS borough FROM nation JOIN region ON n_regionkey = r_regionkey),
d AS (SELECT CAST(strftime(x, '%Y%m%d') AS INTEGER) AS date_key, CAST(isodow(x) AS INTEGER) AS day_of_week FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-12-31', INTERVAL 1 DAY)) AS x) WHERE x <> TIMESTAMP '2024-01-05'),
b AS (SELECT borough, day_of_week, pickup_hour, count(*) AS trip_count, round({mean('total')}, 4) AS avg_total_amount, round({mean('distance')}, 4) AS avg_distance, round({mean('seconds')} / 60.0::DOUBLE, 3) AS avg_duration_minutes FROM e JOIN z ON zone_key = pickup_zone JOIN d USING (date_key) GROUP BY ALL)
SELECT borough, day_of_week, dayname(DATE '2024-01-01' + CAST(day_of_week - 1 AS INTEGER)) AS day_name, pickup_hour, trip_count, avg_total_amount, avg_distance, avg_duration_minutes,
  round(100.0::DOUBLE * trip_count / sum(trip_count) OVER (PARTITION BY borough), 6) AS pct_of_borough_trips, round(100.0::DOUBLE * trip_count / sum(trip_count) OVER (), 6) AS pct_of_all_trips,
  CAST(rank() OVER (PARTITION BY borough, day_of_week ORDER BY trip_count DESC) AS INTEGER) AS hour_rank_in_day FROM b""")
def a1(spark, sf):
    """A calendar of one year without one of its days, and a zone without a borough."""
    zone = zones(spark, sf).withColumn("borough", F.when(F.col("zone_key") != 24, F.col("borough")))
    dates = calendar(spark, "2024-01-01", "2024-12-31").where("date_key <> 20240105")
    return A.demand_profile(rides(spark, sf), zone, dates, {"avg_total_amount": ("total", 1.0, 4), "avg_distance": ("distance", 1.0, 4), "avg_duration_minutes": ("seconds", 60.0, 3)})


@query("a2_od_corridors", f"""
WITH {TRIPS_SQL}, e AS (SELECT * FROM trip WHERE pickup_zone NOT IN (0, 7) AND dropoff_zone NOT IN (0, 7)),
b AS (SELECT pickup_zone, dropoff_zone, count(*) AS trip_count, round({mean('fare')}, 6) AS mean_fare, round(median(fare), 6) AS median_fare,
  round({mean('total', 6)}, 6) AS mean_total_amount, round({mean('distance')}, 6) AS mean_distance, round({mean('days')}, 6) AS mean_days,
  round(median(days::DOUBLE), 6) AS median_days, round(100.0::DOUBLE * {mean('tip / nullif(fare, 0)', 12)}, 6) AS mean_tip_pct_of_fare FROM e GROUP BY ALL),
r AS (SELECT *, round(100.0::DOUBLE * trip_count / sum(trip_count) OVER (), 6) AS pct_of_eligible_trips, CAST(rank() OVER (ORDER BY trip_count DESC) AS INTEGER) AS corridor_rank FROM b)
SELECT corridor_rank, p.zone AS pickup_name, p.borough AS pickup_borough, d.zone AS dropoff_name, d.borough AS dropoff_borough, pickup_zone = dropoff_zone AS is_intra_zone,
  trip_count, mean_fare, median_fare, mean_total_amount, mean_distance, mean_days, median_days, mean_tip_pct_of_fare, round(mean_distance / nullif(mean_days, 0), 6) AS implied_speed, pct_of_eligible_trips
FROM r JOIN zone p ON pickup_zone = p.zone_key JOIN zone d ON dropoff_zone = d.zone_key WHERE corridor_rank <= 25""")
def a2(spark, sf):
    return A.corridors(trips(spark, sf), zones(spark, sf), [0, 7])


@query("a3_congestion", f"""
WITH {TRIPS_SQL}, t AS (SELECT borough, CAST(isodow(pickup_ts) AS INTEGER) AS dow, CAST(month(pickup_ts) AS INTEGER) AS month, distance, days, CASE WHEN days > 0 THEN distance / days END AS s
  FROM trip JOIN zone ON pickup_zone = zone_key),
u AS (SELECT *, CASE WHEN s > 0 AND s <= 5 THEN s END AS speed, s IS NULL OR s <= 0 OR s > 5 AS bad FROM t)
SELECT CASE WHEN grouping(dow) = 0 THEN 'borough_weekday' WHEN grouping(month) = 0 THEN 'borough_month' ELSE 'borough' END AS grouping_level,
  borough, dow, CASE WHEN month IS NOT NULL THEN printf('M%02d', month) END AS month_label, count(*) AS trip_count, count(*) FILTER (bad) AS excluded_implausible_speed,
  round({mean('speed', 8)}, 6) AS mean_speed, round(quantile_cont(speed, 0.25), 6) AS p25_speed, round(quantile_cont(speed, 0.5), 6) AS median_speed, round(quantile_cont(speed, 0.75), 6) AS p75_speed,
  round({tot('CASE WHEN NOT bad THEN distance END')} / nullif({tot('CASE WHEN NOT bad THEN days END')}, 0), 6) AS weighted_speed, round({mean('CASE WHEN NOT bad THEN distance END')}, 6) AS mean_distance
FROM u GROUP BY GROUPING SETS ((borough, dow), (borough, month), (borough))""")
def a3(spark, sf):
    return A.congestion(trips(spark, sf), zones(spark, sf), 5.0)


@query("a4_tipping", f"""
WITH {TRIPS_SQL}, t AS (SELECT payment, borough, CASE WHEN distance <= 10 THEN 'to 10' WHEN distance <= 25 THEN 'to 25' WHEN distance <= 40 THEN 'to 40' ELSE 'over 40' END AS distance_band,
  fare, tip, rate, tip > 0 AS tipped, 100.0::DOUBLE * tip / nullif(fare, 0) AS tip_pct FROM trip JOIN zone ON pickup_zone = zone_key)
SELECT payment, borough, distance_band, count(*) AS trip_count, count(*) FILTER (fare = 0) AS zero_fare_trips, count(*) FILTER (rate IN ('F')) AS prearranged_trips, count(*) FILTER (tipped) AS trips_with_recorded_tip,
  round({mean('fare')}, 6) AS mean_fare, round({mean('tip', 6)}, 6) AS mean_tip, round({mean('tip_pct', 8)}, 6) AS mean_tip_pct, round(median(tip_pct), 6) AS median_tip_pct,
  round({mean('CASE WHEN tipped THEN tip_pct END', 8)}, 6) AS mean_tip_pct_given_tipped, round(100.0::DOUBLE * {tot('tip', 6)} / {tot('fare')}, 6) AS aggregate_tip_pct_of_fare,
  payment IN ('1-URGENT', '2-HIGH') AS is_interpretable, CASE distance_band WHEN 'to 10' THEN 1 WHEN 'to 25' THEN 2 WHEN 'to 40' THEN 3 ELSE 4 END AS distance_band_order,
  round(100.0::DOUBLE * count(*) FILTER (tipped) / count(*), 6) AS pct_trips_with_recorded_tip FROM t GROUP BY payment, borough, distance_band""")
def a4(spark, sf):
    return A.tipping(trips(spark, sf), zones(spark, sf), [10, 25, 40], ["to 10", "to 25", "to 40", "over 40"], ["1-URGENT", "2-HIGH"], ["F"])


@query("a5_revenue_concentration", f"""
WITH {TRIPS_SQL}, b AS (SELECT pickup_zone, count(*) AS trip_count, sum(CAST(total AS DECIMAL(18,6))) AS revenue, {tot('distance')} AS total_distance FROM trip GROUP BY ALL),
w AS (SELECT *, row_number() OVER o AS rn, CAST(sum(revenue) OVER () AS DOUBLE) AS whole, CAST(sum(revenue) OVER (ORDER BY revenue DESC, pickup_zone ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS upto,
  sum(trip_count) OVER (ORDER BY revenue DESC, pickup_zone ROWS UNBOUNDED PRECEDING) AS trips_upto, sum(trip_count) OVER () AS trips_all, count(*) OVER () AS n FROM b WINDOW o AS (ORDER BY revenue DESC, pickup_zone))
SELECT trip_count, CAST(rn AS INTEGER) AS revenue_rank, round(CAST(revenue AS DOUBLE), 4) AS total_revenue, round(CAST(revenue AS DOUBLE) / trip_count, 6) AS mean_revenue_per_trip, total_distance,
  round(100.0::DOUBLE * CAST(revenue AS DOUBLE) / whole, 6) AS pct_of_revenue, round(100.0::DOUBLE * upto / whole, 6) AS cumulative_pct_revenue,
  round(100.0::DOUBLE * trips_upto / trips_all, 6) AS cumulative_pct_trips, round(100.0::DOUBLE * rn / n, 6) AS cumulative_pct_zones, round(100.0::DOUBLE * upto / whole, 6) <= 80 AS within_top_share, zone, borough
FROM w JOIN zone ON pickup_zone = zone_key""")
def a5(spark, sf):
    return A.concentration(trips(spark, sf), zones(spark, sf))


@query("a10_grain_comparison", f"""
WITH {MARKET_SQL}, panel AS (SELECT DISTINCT state, month_key FROM market),
g AS (SELECT 'line items' AS fact_table, 'one row per order line' AS grain_statement, 'shipping' AS context, count(*) AS row_count, count(DISTINCT CAST(l_shipdate AS DATE)) AS distinct_date_members, count(DISTINCT l_suppkey) AS distinct_geo_members, count(DISTINCT l_returnflag) AS distinct_mode_members, count(DISTINCT l_partkey) AS distinct_other_members, 3 AS foreign_key_count, 4 AS measure_count FROM lineitem
UNION ALL SELECT 'orders', 'one row per order', 'shipping', count(*), count(DISTINCT CAST(o_orderdate AS DATE)), count(DISTINCT o_custkey), count(DISTINCT o_orderpriority), NULL, 1, 1 FROM orders
UNION ALL SELECT 'market prices', 'one row per state, brand and month', 'prices', count(*), count(DISTINCT month_key), count(DISTINCT state), NULL, count(DISTINCT commodity), 3, 2 FROM market
UNION ALL SELECT 'price panel', 'one row per state and month', 'prices', count(*), count(DISTINCT month_key), count(DISTINCT state), NULL, NULL, 2, 1 FROM panel)
SELECT *, round(CAST(row_count AS DOUBLE) / min(row_count) OVER (), 6) AS rows_vs_coarsest_fact FROM g""")
def a10(spark, sf):
    facts = stored_facts(spark, sf)
    facts["market prices"] = {"rows": market_prices(spark, sf), "date": "month_key", "geo": "state", "other": "commodity", "grain": "one row per state, brand and month", "context": "prices", "keys": ["month_key", "state", "commodity"], "measures": ["price", "n"]}
    facts["price panel"] = {"rows": price_panel(spark, sf), "date": "month_key", "geo": "state", "grain": "one row per state and month", "context": "prices", "keys": ["month_key", "state"], "measures": ["price"]}
    facts["weather"] = {"rows": None}
    return A.grain(facts)


def stored_facts(spark, sf):
    day = lambda t, c: table(spark, sf, t).withColumn("d", F.to_date(c))
    return {
        "line items": {"rows": day("lineitem", "l_shipdate"), "date": "d", "geo": "l_suppkey", "mode": "l_returnflag", "other": "l_partkey", "grain": "one row per order line", "context": "shipping", "keys": ["l_orderkey", "l_partkey", "l_suppkey"], "measures": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]},
        "orders": {"rows": day("orders", "o_orderdate"), "date": "d", "geo": "o_custkey", "mode": "o_orderpriority", "grain": "one row per order", "context": "shipping", "keys": ["o_custkey"], "measures": ["o_totalprice"]},
    }


@query("a10c_grain_bytes")
def a10c(spark, sf):
    """The comparison with bytes and bytes a row of the stored facts; sizes come from the file listing."""
    facts = stored_facts(spark, sf)
    return A.grain(facts, inventory(spark, {name: f"{sf}/{t}.parquet" for name, t in (("line items", "lineitem"), ("orders", "orders"))}))


@query("a10b_national_month", f"""
WITH {PANEL_SQL} SELECT 'line items' AS fact, strftime(l_shipdate, '%Y-%m') AS year_month, count(*) AS n, round({tot('l_extendedprice')}, 4) AS value FROM lineitem GROUP BY ALL
UNION ALL SELECT 'price panel', printf('%04d-%02d', month_key // 10000, month_key // 100 % 100), count(*), round({mean('price')}, 4) FROM panel GROUP BY ALL""")
def a10b(spark, sf):
    line, panel = table(spark, sf, "lineitem"), price_panel(spark, sf)
    one = line.groupBy(E.year_month("l_shipdate").alias("year_month")).agg(F.count(F.lit(1)).alias("n"), E.rounded(E.total("l_extendedprice"), 4).alias("value"))
    two = panel.groupBy(F.date_format(F.to_date(F.col("month_key").cast("string"), "yyyyMMdd"), "yyyy-MM").alias("year_month")).agg(F.count(F.lit(1)).alias("n"), E.rounded(E.mean("price"), 4).alias("value"))
    return one.select(F.lit("line items").alias("fact"), "*").unionByName(two.select(F.lit("price panel").alias("fact"), "*"))


def labelled(spark, sf):
    docs, labels = table(spark, sf, "documents").select("doc_id", "lang", "source"), table(spark, sf, "labels")
    return docs.join(labels, "doc_id", "left").withColumn("toxic", F.when(F.col("doc_id") % 5 != 0, F.col("toxic")))


LABELLED_SQL = "d AS (SELECT doc_id, lang, source, quality, CASE WHEN doc_id % 5 <> 0 THEN toxic END AS toxic FROM documents LEFT JOIN labels USING (doc_id))"


@query("a11_missingness", f"""
WITH {LABELLED_SQL}, p AS (SELECT 'pattern' AS record_type, NULL::VARCHAR AS source, NULL::VARCHAR AS lang, (CASE WHEN quality IS NULL THEN 'Q' ELSE '.' END) || (CASE WHEN toxic IS NULL THEN 'T' ELSE '.' END) AS missingness_pattern,
  CAST((quality IS NULL)::INT + (toxic IS NULL)::INT AS INTEGER) AS fields_missing, count(*) AS trip_count, NULL::DOUBLE AS quality_missing_pct, NULL::DOUBLE AS toxic_missing_pct, NULL::DOUBLE AS all_missing_pct FROM d GROUP BY ALL),
g AS (SELECT 'group', source, lang, NULL::VARCHAR, NULL::INTEGER, count(*) AS trip_count, round(100.0::DOUBLE * count(*) FILTER (quality IS NULL) / count(*), 6), round(100.0::DOUBLE * count(*) FILTER (toxic IS NULL) / count(*), 6), round(100.0::DOUBLE * count(*) FILTER (quality IS NULL AND toxic IS NULL) / count(*), 6)
  FROM d GROUP BY source, lang HAVING count(*) >= 10)
SELECT *, round(100.0::DOUBLE * trip_count / sum(trip_count) OVER (), 6) AS pct_of_trips FROM p UNION ALL SELECT *, round(100.0::DOUBLE * trip_count / sum(trip_count) OVER (), 6) FROM g""")
def a11(spark, sf):
    return A.missingness(labelled(spark, sf), ["quality", "toxic"], ["source", "lang"], 10)


@query("a11b_pattern_scaffold", f"""
WITH {LABELLED_SQL}, g AS (SELECT (i & 1) = 1 AS q, (i & 2) = 2 AS t FROM range(4) r(i)),
s AS (SELECT quality IS NULL AS q, toxic IS NULL AS t, count(*) AS n, array_to_string(list_sort(list(DISTINCT source)), '|') AS l FROM d GROUP BY ALL)
SELECT q AS quality_missing, t AS toxic_missing, coalesce(n, 0) AS row_count, coalesce(l, '') AS labels FROM g LEFT JOIN s USING (q, t)""")
def a11b(spark, sf):
    return A.pattern_scaffold(labelled(spark, sf), ["quality", "toxic"], "source")


@query("a11c_co_missing", f"""
WITH {LABELLED_SQL}, c AS (SELECT source, lang, count(*) AS row_count, count(*) FILTER (quality IS NULL AND toxic IS NULL) AS all_missing FROM d GROUP BY ALL),
p AS (SELECT *, round(100.0::DOUBLE * all_missing / row_count, 6) AS all_missing_pct FROM c)
SELECT *, round(max(all_missing_pct) OVER (PARTITION BY source) - min(all_missing_pct) OVER (PARTITION BY source), 6) AS range_pct FROM p""")
def a11c(spark, sf):
    return A.co_missing(labelled(spark, sf), ["quality", "toxic"], "source", "lang")


@query("a13_gated_profile", """
WITH g AS (SELECT * FROM events WHERE value >= 0 AND value < 100 AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-25')
SELECT event_type, CAST(isodow(ts) AS INTEGER) AS day_of_week, CAST(hour(ts) AS INTEGER) AS pickup_hour, count(*) AS trip_count FROM g GROUP BY ALL""")
def a13(spark, sf):
    """The demand profile with the gate applied to raw rows at query time."""
    kept = table(spark, sf, "events").where("value >= 0 AND value < 100 AND ts >= TIMESTAMP_NTZ '2024-01-03 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-25 00:00:00'")
    return kept.groupBy("event_type", E.iso_dow("ts").alias("day_of_week"), F.hour("ts").alias("pickup_hour")).agg(F.count(F.lit(1)).alias("trip_count"))


@query("a14_scale_union", """
WITH u AS (SELECT ts FROM events UNION ALL SELECT CAST(o_orderdate AS TIMESTAMP) FROM orders UNION ALL SELECT CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) FROM lineitem)
SELECT CAST(isodow(ts) AS INTEGER) AS day_of_week, CAST(hour(ts) AS INTEGER) AS pickup_hour, count(*) AS trip_count FROM u GROUP BY ALL""")
def a14(spark, sf):
    line = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d"))
    return A.unioned_scale([(table(spark, sf, "events"), "ts"), (table(spark, sf, "orders"), "o_orderdate"), (line, "d")])


@query("a17_top_groups", f"SELECT p_brand, {tot('l_extendedprice')} AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL ORDER BY total DESC, p_brand LIMIT 10")
def a17(spark, sf):
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return A.top_groups(line.join(part, line.l_partkey == part.p_partkey), "p_brand", "l_extendedprice", 10)


@query("a18_composition", """SELECT borough AS country, 'zone' AS admin_level, count(*) AS members, count(DISTINCT left(zone, 1)) AS initials FROM
  (SELECT n_name AS zone, r_name AS borough FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY ALL""")
def a18(spark, sf):
    return zones(spark, sf).groupBy(F.col("borough").alias("country"), F.lit("zone").alias("admin_level")).agg(F.count(F.lit(1)).alias("members"), F.count_distinct(F.substring("zone", 1, 1)).alias("initials"))
