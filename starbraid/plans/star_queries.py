"""Bindings of sources, cleansing, cell tables, dimensions, facts and quality rules, with oracle SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import cells as X
from ..operators import clean as C
from ..operators import dims as D
from ..operators import quality as Q
from ..sources import io as S
from .registry import query
from .tables import PANEL_SQL, TRIPS_SQL, price_panel, table, trips, zones
from .trip_queries import mean, tot

LO, HI = "1996-01-01", "2000-01-01"
MOST_SECONDS = 900 * 86400
REASON = f"""CASE WHEN pickup_ts IS NULL OR dropoff_ts IS NULL THEN 'missing_timestamp' WHEN date_diff('second', pickup_ts, dropoff_ts) <= 0 THEN 'no_duration'
  WHEN date_diff('second', pickup_ts, dropoff_ts) > {MOST_SECONDS} THEN 'too_long' WHEN distance IS NULL OR distance < 0 THEN 'no_distance'
  WHEN distance > 45 THEN 'too_far' WHEN fare < 0 OR total < 0 THEN 'negative_amount' WHEN passengers < 0 OR passengers > 6 THEN 'implausible_passengers' WHEN pickup_zone IS NULL OR dropoff_zone IS NULL THEN 'unknown_zone' END"""
GATED_SQL = f"{TRIPS_SQL}, judged AS (SELECT *, {REASON} AS reject_reason, pickup_ts < TIMESTAMP '{LO}' OR pickup_ts >= TIMESTAMP '{HI}' AS outside FROM trip)"


def gated(spark, sf):
    rows = C.judged(trips(spark, sf), C.trip_rules(MOST_SECONDS, 45, 6))
    return rows.withColumn("outside", (F.col("pickup_ts") < F.lit(LO).cast("timestamp_ntz")) | (F.col("pickup_ts") >= F.lit(HI).cast("timestamp_ntz")))


@query("c1_c4_gate_summary", f"""WITH {GATED_SQL} SELECT coalesce(reject_reason, 'accepted') AS reject_reason, count(*) AS row_count, count(*) FILTER (outside) AS outside_window_rows, min(distance) AS min_distance, max(distance) AS max_distance,
  min(round(total, 6)) AS min_total, max(round(total, 6)) AS max_total FROM judged GROUP BY ALL""")
def c1(spark, sf):
    return C.reject_summary(gated(spark, sf), "distance", "total", "outside")


@query("c2_c3_derived_and_id", f"""WITH {TRIPS_SQL}, t AS (SELECT *, date_diff('second', pickup_ts, dropoff_ts) AS sec FROM trip)
SELECT md5(concat_ws('|', order_key, line_no, strftime(pickup_ts, '%Y%m%d'), strftime(dropoff_ts, '%Y%m%d'), CAST(distance AS DECIMAL(18,4)), CAST(fare AS DECIMAL(18,4)), payment, vendor, rate)) AS trip_id, order_key, line_no,
  CAST(sec AS BIGINT) AS duration_seconds, pickup_ts < TIMESTAMP '{LO}' OR pickup_ts >= TIMESTAMP '{HI}' AS is_outside_declared_window, CASE WHEN sec > 0 THEN round(distance * 3600.0::DOUBLE / sec, 8) END AS avg_speed,
  pickup_zone IN (3, 9) OR dropoff_zone IN (3, 9) AS is_airport_trip, tip > 0 AS has_tip,
  CASE WHEN order_key % 3 = 0 THEN false ELSE order_key % 2 > 0 END AS has_toll FROM t""")
def c2(spark, sf):
    c = F.col
    tolls = F.when(c("order_key") % 3 == 0, F.lit(None)).otherwise(c("order_key") % 2)
    rows = C.derived(trips(spark, sf).withColumn("tolls", tolls), LO, HI, [3, 9])
    key = C.content_id([c("order_key"), c("line_no"), F.date_format("pickup_ts", "yyyyMMdd"), F.date_format("dropoff_ts", "yyyyMMdd"), E.exact("distance"), E.exact("fare"), c("payment"), c("vendor"), c("rate")])
    return rows.select(key.alias("trip_id"), "order_key", "line_no", "duration_seconds", "is_outside_declared_window", "avg_speed", "is_airport_trip", "has_tip", "has_toll")


@query("c5_reject_sample", f"WITH {GATED_SQL} SELECT order_key, line_no, part_key, reject_reason FROM judged WHERE reject_reason IS NOT NULL ORDER BY order_key, line_no, part_key LIMIT 200")
def c5(spark, sf):
    return C.reject_sample(gated(spark, sf), ["order_key", "line_no", "part_key"], 200)


PRICE_REASON = """CASE WHEN state IS NULL OR state = '' THEN 'unknown_state' WHEN zone IS NULL THEN 'state_without_zone' WHEN price IS NULL THEN 'no_price' WHEN price < 1000 THEN 'below_floor' WHEN price > 4000 THEN 'above_ceiling' END"""
# Some months lose their state, one zone its place in the map, and some prices are missing: defects the tables lack.
DEFECT_PANEL = """fuel AS (SELECT CASE WHEN month_key // 100 % 23 = 0 THEN NULL ELSE state END AS state, nullif(zone, 'ASIA') AS zone, month_key, CASE WHEN month_key // 100 % 19 = 0 THEN NULL ELSE price END AS price FROM panel)"""


def judged_panel(spark, sf):
    month = F.floor(F.col("month_key") / 100)
    rows = price_panel(spark, sf).withColumns({"state": F.when(month % 23 != 0, F.col("state")), "zone": F.nullif("zone", F.lit("ASIA")), "price": F.when(month % 19 != 0, F.col("price"))})
    return C.judged(rows, C.fuel_rules(1000, 4000))


@query("c10_fuel_judge", f"WITH {PANEL_SQL}, {DEFECT_PANEL} SELECT coalesce({PRICE_REASON}, 'accepted') AS reason, count(*) AS row_count, min(price) AS lo, max(price) AS hi FROM fuel GROUP BY ALL")
def c10(spark, sf):
    return judged_panel(spark, sf).groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("row_count"), F.min("price").alias("lo"), F.max("price").alias("hi"))


@query("c6_price_judge", """WITH r AS (SELECT CASE WHEN l_orderkey % 41 = 0 THEN NULL ELSE l_shipdate END AS observation_date, CASE l_orderkey % 37 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE s_name END AS market, CASE WHEN l_orderkey % 31 = 0 THEN '' ELSE p_brand END AS commodity,
  CASE l_orderkey % 29 WHEN 0 THEN NULL WHEN 1 THEN 0.0::DOUBLE ELSE l_extendedprice END AS price, CASE WHEN n_nationkey <> 5 THEN n_name END AS state, r_name AS zone, p_type FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
j AS (SELECT *, CASE WHEN observation_date IS NULL THEN 'unparsable_date' WHEN market IS NULL OR market = '' THEN 'missing_market' WHEN commodity IS NULL OR commodity = '' THEN 'missing_commodity' WHEN price IS NULL THEN 'no_price' WHEN price <= 0 THEN 'price_not_positive' WHEN state IS NULL THEN 'unknown_state' END AS reason FROM r)
SELECT CASE WHEN state IS NOT NULL THEN zone END AS zone, coalesce(reason, 'accepted') AS reason, commodity IN ('Brand#11', 'Brand#12') AS is_fuel, contains(p_type, 'BRASS') AS is_non_food, count(*) AS row_count FROM j GROUP BY ALL""")
def c6(spark, sf):
    line, supplier, part = (table(spark, sf, t) for t in ("lineitem", "supplier", "part"))
    k, states = F.col("l_orderkey"), zones(spark, sf).where("zone_key <> 5").toDF("zone_key", "state", "zone")
    rows = line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(part, line.l_partkey == part.p_partkey).join(states, F.col("s_nationkey") == F.col("zone_key"), "left").withColumns({
        "observation_date": F.when(k % 41 != 0, F.col("l_shipdate")), "market": F.when(k % 37 == 0, F.lit("")).when(k % 37 != 1, F.col("s_name")), "commodity": F.when(k % 31 == 0, F.lit("")).otherwise(F.col("p_brand")),
        "price": F.when(k % 29 == 1, F.lit(0.0)).when(k % 29 != 0, F.col("l_extendedprice")),
    })
    flags = [F.col("commodity").isin("Brand#11", "Brand#12").alias("is_fuel"), F.contains("p_type", F.lit("BRASS")).alias("is_non_food")]
    return C.judged(rows, C.market_rules()).groupBy("zone", F.coalesce("reject_reason", F.lit("accepted")).alias("reason"), *flags).agg(F.count(F.lit(1)).alias("row_count"))


@query("c7_distinct_map", """WITH l AS (SELECT DISTINCT CASE c_custkey % 5 WHEN 0 THEN n_name WHEN 1 THEN '  ' || lower(n_name) || ' State ' WHEN 2 THEN replace(n_name, ' ', '-') WHEN 3 THEN 'Total' ELSE n_name || ' and others' END AS raw_label, CASE WHEN c_custkey % 5 < 3 THEN n_name END AS state, c_custkey % 5 = 3 AS is_aggregate_label
  FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT * FROM l""")
def c7(spark, sf):
    """The map is built over distinct values only and joined back by its users."""
    n, k = F.col("zone"), F.col("c_custkey") % 5
    raw = F.when(k == 0, n).when(k == 1, F.concat(F.lit("  "), F.lower(n), F.lit(" State "))).when(k == 2, F.replace(n, F.lit(" "), F.lit("-"))).when(k == 3, F.lit("Total")).otherwise(F.concat(n, F.lit(" and others")))
    rows = table(spark, sf, "customer").join(zones(spark, sf), F.col("c_nationkey") == F.col("zone_key")).select(raw.alias("raw_label"))
    return X.canonical_map(rows, "raw_label", variants(spark, sf), ["total", "average"])


@query("c8_market_register", "SELECT p_brand, p_type, min(p_partkey) AS p_partkey FROM part GROUP BY ALL")
def c8(spark, sf):
    rows = table(spark, sf, "part").select("p_brand", "p_type", "p_partkey")
    return C.first_per_key(rows, ["p_brand", "p_type"], [F.col("p_partkey")])


@query("c9_zone_conform", """WITH z AS (SELECT n_nationkey AS zone_key, CASE WHEN n_nationkey % 11 = 0 THEN ' ' ELSE n_name END AS raw, n_regionkey FROM nation)
SELECT zone_key, nullif(trim(raw), '') AS zone, nullif(trim(raw), '') IS NULL OR n_regionkey = 0 AS is_non_geographic FROM z""")
def c9(spark, sf):
    n = table(spark, sf, "nation")
    raw = F.when(F.col("n_nationkey") % 11 == 0, F.lit(" ")).otherwise(F.col("n_name"))
    rows = n.union(n).select(F.col("n_nationkey").alias("zone_key"), F.nullif(F.trim(raw), F.lit("")).alias("zone"), "n_regionkey")
    return C.first_per_key(rows, ["zone_key"], [F.col("zone")]).select("zone_key", "zone", (F.col("zone").isNull() | (F.col("n_regionkey") == 0)).alias("is_non_geographic"))


@query("c11_lagged_changes", f"""WITH {PANEL_SQL}, l AS (SELECT state, month_key, price, lag(price) OVER w AS prev_month, lag(price, 12) OVER w AS prev_year FROM panel WINDOW w AS (PARTITION BY state ORDER BY month_key))
SELECT *, round(100.0::DOUBLE * (price - prev_month) / prev_month, 6) AS mom_pct_change, round(100.0::DOUBLE * (price - prev_year) / prev_year, 6) AS yoy_pct_change FROM l""")
def c11(spark, sf):
    return C.lagged_changes(price_panel(spark, sf).select("state", "month_key", "price"), "state", "month_key", "price")


@query("c11b_calendar_changes", f"""WITH {PANEL_SQL}, m AS (SELECT *, month_key // 10000 * 12 + month_key // 100 % 100 AS m FROM panel)
SELECT a.state, a.month_key, a.price, b.price AS prev_year, round(100.0::DOUBLE * (a.price - b.price) / b.price, 6) AS yoy_pct_change FROM m a LEFT JOIN m b ON a.state = b.state AND a.m = b.m + 12""")
def c11b(spark, sf):
    return C.lagged_changes_by_calendar(price_panel(spark, sf).select("state", "month_key", "price"), "state", "month_key", "price")


@query("c12_typed_dates", """SELECT CAST(ts AS DATE) AS observation_date, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS date_key, CAST(props::JSON ->> 'k' AS INTEGER) AS k, count(*) AS n FROM events GROUP BY ALL""")
def c12(spark, sf):
    rows = table(spark, sf, "events").select(F.to_date("ts").alias("observation_date"), E.date_key("ts").alias("date_key"), F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    return rows.groupBy("observation_date", "date_key", "k").agg(F.count(F.lit(1)).alias("n"))


@query("c13_national_mean", f"WITH {PANEL_SQL} SELECT month_key, round({mean('price')}, 2) AS national_mean, count(*) AS reporting_states FROM panel GROUP BY ALL")
def c13(spark, sf):
    return price_panel(spark, sf).groupBy("month_key").agg(E.rounded(E.mean("price"), 2).alias("national_mean"), F.count(F.lit(1)).alias("reporting_states"))


@query("c14_reconciliation", f"""WITH {GATED_SQL}, {PANEL_SQL.split('),', 1)[0].replace('zonal', 'zonal2')}), {PANEL_SQL}, {DEFECT_PANEL}, p AS (SELECT {PRICE_REASON} AS reject_reason FROM fuel),
u AS (SELECT 'trips' AS source, reject_reason, count(*) AS n FROM judged GROUP BY ALL UNION ALL SELECT 'panel', reject_reason, count(*) FROM p GROUP BY ALL)
SELECT source, CAST(sum(n) AS BIGINT) AS raw_rows_in, CAST(sum(CASE WHEN reject_reason IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS rows_rejected, CAST(sum(CASE WHEN reject_reason IS NULL THEN n ELSE 0 END) AS BIGINT) AS rows_loaded,
  coalesce(array_to_string(list_sort(list(reject_reason || '=' || n) FILTER (reject_reason IS NOT NULL)), '; '), '') AS reject_reasons, round(100.0::DOUBLE * sum(CASE WHEN reject_reason IS NULL THEN n ELSE 0 END) / sum(n), 6) AS retention_pct FROM u GROUP BY source""")
def c14(spark, sf):
    return C.reconciliation({"trips": gated(spark, sf).select("reject_reason"), "panel": judged_panel(spark, sf).select("reject_reason")})


@query("c15_external_check", f"""WITH {PANEL_SQL}, s AS (SELECT month_key, round({mean('price')}, 2) AS assembled, count(*) AS reporting_states FROM panel GROUP BY ALL), t AS (SELECT * FROM (VALUES (19960101, 2100.0::DOUBLE), (19970601, 2000.5::DOUBLE), (20300101, 1.0::DOUBLE)) v(month_key, published))
SELECT t.month_key, published, assembled, round(assembled - published, 4) AS delta, 150.0::DOUBLE AS tolerance, coalesce(abs(round(assembled - published, 4)) <= 150, false) AS within_tolerance, coalesce(reporting_states, 0) AS reporting_states FROM t LEFT JOIN s ON s.month_key = t.month_key""")
def c15(spark, sf):
    targets = spark.createDataFrame([(19960101, 2100.0), (19970601, 2000.5), (20300101, 1.0)], "month_key int, published double")
    return C.external_check(c13(spark, sf).withColumnRenamed("national_mean", "assembled"), targets, 150.0)


@query("d1_calendar", """WITH b AS (SELECT min(ts)::DATE - 5 AS lo, max(ts)::DATE + 400 AS hi FROM events), d AS (SELECT CAST(unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS d FROM b)
SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, d AS full_date, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month_number, monthname(d) AS month_name, CAST(day(d) AS INTEGER) AS day_of_month,
  CAST(isodow(d) AS INTEGER) AS day_of_week, dayname(d) AS day_name, isodow(d) >= 6 AS is_weekend, CAST(week(d) AS INTEGER) AS week_of_year, strftime(d, '%Y-%m') AS year_month, last_day(d) = d AS is_month_end FROM d
UNION ALL SELECT -1, NULL, NULL, NULL, NULL, 'Unknown', NULL, NULL, 'Unknown', NULL, NULL, 'Unknown', NULL""")
def d1(spark, sf):
    span = table(spark, sf, "events").agg(F.date_sub(F.min(F.to_date("ts")), 5).alias("lo"), F.date_add(F.max(F.to_date("ts")), 400).alias("hi")).first()
    return D.calendar(spark, str(span["lo"]), str(span["hi"]))


FLAGS_SQL = "flags AS (SELECT CAST(row_number() OVER (ORDER BY vendor, rate, has_tip, late) AS INTEGER) AS flag_key, * FROM (SELECT DISTINCT vendor, rate, tip > 0 AS has_tip, CASE WHEN days <> 0 THEN days > 0 END AS late FROM trip) ORDER BY ALL)".replace("ORDER BY vendor, rate, has_tip, late)", "ORDER BY vendor NULLS LAST, rate NULLS LAST, has_tip NULLS LAST, late NULLS LAST)")


def flag_rows(spark, sf):
    late = F.when(F.col("days") != 0, F.col("days") > 0)
    return trips(spark, sf).withColumns({"has_tip": F.col("tip") > 0, "late": late})


@query("d3_commodity_dim", """SELECT CAST(row_number() OVER (ORDER BY p_brand, p_type) AS INTEGER) AS commodity_key, p_brand, p_type, upper(regexp_replace(trim(p_brand || ' ' || p_type), '[^A-Za-z0-9]+', '_', 'g')) AS commodity_code, contains(upper(p_type), 'BRASS') AS is_fuel FROM (SELECT DISTINCT p_brand, p_type FROM part)
UNION ALL SELECT -1, 'Unknown', 'Unknown', 'UNKNOWN', false""")
def d3(spark, sf):
    rows = table(spark, sf, "part").select("p_brand", "p_type", D.slug(F.concat_ws(" ", "p_brand", "p_type")).alias("commodity_code"), F.upper("p_type").contains("BRASS").alias("is_fuel"))
    return D.keyed(rows, ["p_brand", "p_type"], "commodity_key", {"p_brand": "Unknown", "p_type": "Unknown", "commodity_code": "UNKNOWN", "is_fuel": False})


@query("d4_junk_dim", f"WITH {TRIPS_SQL}, {FLAGS_SQL} SELECT * FROM flags")
def d4(spark, sf):
    return D.keyed(flag_rows(spark, sf).select("vendor", "rate", "has_tip", "late"), ["vendor", "rate", "has_tip", "late"], "flag_key")


GEO_MEMBERS = """g AS (SELECT 'N' || n_nationkey AS geo_code, n_name AS geo_name, 'zone' AS admin_level, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'R' || r_regionkey, r_name, 'region', 'World' FROM region)"""


def geo_members(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    zone = n.join(r, n.n_regionkey == r.r_regionkey).select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("geo_code"), F.col("n_name").alias("geo_name"), F.lit("zone").alias("admin_level"), F.col("r_name").alias("parent"))
    region = r.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("geo_code"), F.col("r_name").alias("geo_name"), F.lit("region").alias("admin_level"), F.lit("World").alias("parent"))
    city = zone.limit(0).unionByName(zone.where("geo_code = 'N3'").withColumn("geo_name", F.lit("later source")))
    return D.assembled([zone, region, city], ["geo_code", "admin_level"])


@query("d5_geography", f"WITH {GEO_MEMBERS} SELECT * FROM g")
def d5(spark, sf):
    return geo_members(spark, sf)


MERGE_SQL = f"""{GEO_MEMBERS}, base AS (SELECT CAST(row_number() OVER (ORDER BY geo_code, admin_level) AS INTEGER) AS geo_key, * FROM g UNION ALL SELECT -1, 'Unknown', 'Unknown', 'Unknown', 'Unknown'),
inc AS (SELECT geo_code, geo_name, admin_level, CASE WHEN length(geo_code) = 3 THEN 'Moved' ELSE parent END AS parent FROM g WHERE geo_code <> 'R0' UNION ALL SELECT 'N99', 'New', 'zone', NULL),
j AS (SELECT i.*, b.geo_key AS old_key, b.geo_key IS NULL OR i.parent IS DISTINCT FROM b.parent OR i.geo_name IS DISTINCT FROM b.geo_name AS fresh FROM inc i LEFT JOIN base b ON i.geo_code = b.geo_code AND i.admin_level = b.admin_level),
ch AS (SELECT old_key FROM j WHERE fresh AND old_key IS NOT NULL),
m AS (SELECT b.geo_key, b.geo_code, b.geo_name, b.admin_level, b.parent, DATE '2016-01-01' AS valid_from, CASE WHEN old_key IS NOT NULL THEN DATE '2026-05-31' ELSE DATE '9999-12-31' END AS valid_to, old_key IS NULL AS is_current, CASE WHEN old_key IS NOT NULL THEN 'closed' ELSE 'unchanged' END AS action FROM base b LEFT JOIN ch ON geo_key = old_key
  UNION ALL SELECT CAST((SELECT max(geo_key) FROM base) + row_number() OVER (ORDER BY geo_code, admin_level) AS INTEGER), geo_code, geo_name, admin_level, parent, DATE '2026-06-01', DATE '9999-12-31', true, CASE WHEN old_key IS NULL THEN 'inserted' ELSE 'reopened' END FROM j WHERE fresh)"""


def merged_geography(spark, sf):
    base = D.first_load(geo_members(spark, sf), ["geo_code", "admin_level"])
    incoming = geo_members(spark, sf).where("geo_code <> 'R0'").withColumn("parent", F.when(F.length("geo_code") == 3, "Moved").otherwise(F.col("parent")))
    new = geo_members(spark, sf).where("geo_code = 'N1'").select(F.lit("N99").alias("geo_code"), F.lit("New").alias("geo_name"), "admin_level", F.lit(None).cast("string").alias("parent"))
    return D.scd2_merge(base, incoming.unionByName(new), ["geo_code", "admin_level"], ["geo_name", "parent"], "2026-06-01")


@query("d6_scd2_merge", f"WITH {MERGE_SQL} SELECT * FROM m")
def d6(spark, sf):
    return merged_geography(spark, sf)


@query("d7_merge_outcome", f"WITH {MERGE_SQL} SELECT count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action = 'reopened') AS versioned, count(*) FILTER (action = 'unchanged' AND is_current) AS unchanged FROM m")
def d7(spark, sf):
    return D.merge_outcome(merged_geography(spark, sf))


@query("d7b_version_profile", f"WITH {MERGE_SQL} SELECT admin_level, count(*) AS versions, count(*) FILTER (is_current) AS current_members FROM m GROUP BY ALL")
def d7b(spark, sf):
    return D.version_profile(merged_geography(spark, sf), ["admin_level"])


@query("d8_d9_resolved_fact", f"""WITH {TRIPS_SQL}, {FLAGS_SQL}, pay AS (SELECT * FROM (VALUES (1, '1-URGENT'), (2, '2-HIGH'), (3, '3-MEDIUM')) v(pk, code)),
f AS (SELECT coalesce(pk, -1) AS payment_key, coalesce(flag_key, -1) AS flag_key, CAST(strftime(pickup_ts, '%Y%m') AS INTEGER) AS pickup_month, CAST(strftime(dropoff_ts, '%Y%m') AS INTEGER) AS dropoff_month, fare FROM trip t LEFT JOIN pay ON payment = code
  LEFT JOIN flags f ON t.vendor IS NOT DISTINCT FROM f.vendor AND t.rate IS NOT DISTINCT FROM f.rate AND (t.tip > 0) IS NOT DISTINCT FROM f.has_tip AND (CASE WHEN days <> 0 THEN days > 0 END) IS NOT DISTINCT FROM f.late)
SELECT payment_key, flag_key, pickup_month, dropoff_month, count(*) AS trips, {tot('fare')} AS fare FROM f GROUP BY ALL""")
def d8(spark, sf):
    pay = D.static_dimension(spark, [(1, "1-URGENT"), (2, "2-HIGH"), (3, "3-MEDIUM")], "payment_key int, code string", (-1, "Unknown"))
    rows = D.resolved(flag_rows(spark, sf), pay, [("payment", "code")], "payment_key", "payment_fk")
    rows = D.resolved(rows, d4(spark, sf), [("vendor", "vendor"), ("rate", "rate"), ("has_tip", "has_tip"), ("late", "late")], "flag_key", "flag_fk")
    return rows.groupBy(F.col("payment_fk").alias("payment_key"), F.col("flag_fk").alias("flag_key"), F.floor(E.date_key("pickup_ts") / 100).cast("int").alias("pickup_month"), F.floor(E.date_key("dropoff_ts") / 100).cast("int").alias("dropoff_month")).agg(F.count(F.lit(1)).alias("trips"), E.total("fare").alias("fare"))


TRIP_FACT_SQL = f"""{TRIPS_SQL}, geo AS (SELECT n_nationkey + 10 AS geo_key, n_nationkey AS geo_code FROM nation WHERE n_nationkey <> 7),
flag AS (SELECT CAST(row_number() OVER (ORDER BY stored, is_airport_trip, has_tip, has_toll) AS INTEGER) AS flag_key, * FROM (SELECT * FROM (VALUES (true), (false), (NULL)) a(stored), (VALUES (true), (false)) b(is_airport_trip), (VALUES (true), (false)) c(has_tip), (VALUES (true), (false)) d(has_toll))),
src AS (SELECT *, CASE order_key % 3 WHEN 0 THEN NULL ELSE order_key % 3 = 1 END AS stored, pickup_zone IN (3, 9) OR dropoff_zone IN (3, 9) AS is_airport_trip, tip > 0 AS has_tip, CASE WHEN order_key % 3 = 0 THEN false ELSE order_key % 2 > 0 END AS has_toll,
  CASE WHEN pickup_ts::DATE BETWEEN DATE '1995-06-01' AND DATE '2000-12-31' THEN CAST(strftime(pickup_ts, '%Y%m%d') AS INTEGER) ELSE -1 END AS pd, CASE WHEN dropoff_ts::DATE BETWEEN DATE '1995-06-01' AND DATE '2000-12-31' THEN CAST(strftime(dropoff_ts, '%Y%m%d') AS INTEGER) ELSE -1 END AS dd FROM trip)"""


@query("d8_trip_fact", f"""WITH {TRIP_FACT_SQL}
SELECT CASE WHEN pd > 0 THEN pd // 100 ELSE -1 END AS pickup_month, CASE WHEN dd > 0 THEN dd // 100 ELSE -1 END AS dropoff_month, coalesce(p.geo_key, -1) AS pickup_geo_key, coalesce(d.geo_key, -1) AS dropoff_geo_key, CASE vendor WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE -1 END AS vendor_key, CASE payment WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE -1 END AS payment_key,
  CASE rate WHEN 'O' THEN 1 ELSE -1 END AS rate_key, flag_key, count(*) AS trips, {tot('fare')} AS fare FROM src LEFT JOIN geo p ON pickup_zone = p.geo_code LEFT JOIN geo d ON dropoff_zone = d.geo_code
  LEFT JOIN flag f ON src.stored IS NOT DISTINCT FROM f.stored AND src.is_airport_trip = f.is_airport_trip AND src.has_tip = f.has_tip AND src.has_toll = f.has_toll GROUP BY ALL""")
def d8_trip(spark, sf):
    """All eight lookups. Zone 7 is no member, each third zone has an old version, and the calendar is short at both ends."""
    c, nation = F.col, table(spark, sf, "nation")
    now = nation.where("n_nationkey <> 7").select((c("n_nationkey") + 10).alias("geo_key"), c("n_nationkey").alias("geo_code"), F.lit(True).alias("is_current"))
    old = now.where("geo_code % 3 = 0").select((c("geo_key") + 100).alias("geo_key"), "geo_code", F.lit(False).alias("is_current"))
    codes = lambda rows, name: D.static_dimension(spark, rows, f"{name}_key int, {name}_id string", (-1, "Unknown"))
    grid = [(s, a, t, o) for s in (None, False, True) for a in (False, True) for t in (False, True) for o in (False, True)]
    flags = D.keyed(spark.createDataFrame(grid, "stored boolean, is_airport_trip boolean, has_tip boolean, has_toll boolean"), ["stored", "is_airport_trip", "has_tip", "has_toll"], "flag_key")
    tolls = F.when(c("order_key") % 3 == 0, F.lit(None)).otherwise(c("order_key") % 2)
    rows = C.derived(trips(spark, sf).withColumn("tolls", tolls), LO, HI, [3, 9]).withColumn("stored", F.when(c("order_key") % 3 != 0, c("order_key") % 3 == 1))
    out = D.trip_fact(rows, D.calendar(spark, "1995-06-01", "2000-12-31"), now.union(old), codes([(1, "A"), (2, "N")], "vendor"), codes([(1, "1-URGENT"), (2, "2-HIGH"), (3, "3-MEDIUM")], "payment"), codes([(1, "O")], "rate"), flags)
    month = lambda k: F.floor(c(k) / 100).cast("int")
    keys = [F.when(c(f"{r}_date_key") > 0, month(f"{r}_date_key")).otherwise(-1).alias(f"{r}_month") for r in ("pickup", "dropoff")]
    return out.groupBy(*keys, "pickup_geo_key", "dropoff_geo_key", "vendor_key", "payment_key", "rate_key", "flag_key").agg(F.count(F.lit(1)).alias("trips"), E.total("fare").alias("fare"))


@query("d10_market_fact", f"""SELECT CAST(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + 1 AS INTEGER) AS month_key, CASE WHEN s_nationkey = 7 THEN -1 ELSE s_nationkey + 10 END AS geo_key, CASE WHEN p_brand <= 'Brand#33' AND p_size % 2 = 1 THEN CAST(substr(p_brand, 7, 2) AS INTEGER) ELSE -1 END AS commodity_key,
  l_returnflag AS price_type, CASE WHEN p_size % 2 = 1 THEN 'kg' ELSE 'unspecified' END AS unit, round({mean('l_extendedprice')}, 4) AS mean_price, count(*) AS observation_count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def d10(spark, sf):
    c = F.col
    line, supplier, part, nation = (table(spark, sf, t) for t in ("lineitem", "supplier", "part", "nation"))
    geo = nation.where("n_nationkey <> 7").select((c("n_nationkey") + 10).alias("geo_key"), c("n_nationkey").alias("geo_code"), F.lit(True).alias("is_current"))
    dim = part.where("p_brand <= 'Brand#33'").select("p_brand").distinct().select(F.substring("p_brand", 7, 2).cast("int").alias("commodity_key"), c("p_brand").alias("commodity_name"), F.lit("kg").alias("unit"))
    rows = line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(part, line.l_partkey == part.p_partkey)
    prices = rows.select(E.month_key("l_shipdate").alias("month_key"), c("s_nationkey").alias("market"), c("p_brand").alias("commodity"), F.when(c("p_size") % 2 == 1, F.lit("kg")).alias("unit"), c("l_returnflag").alias("price_type"), c("l_extendedprice").alias("price"))
    return D.market_fact(prices, geo, dim)


@query("d11_fuel_fact", f"WITH {PANEL_SQL}, k AS (SELECT n_nationkey AS geo_key, n_name FROM nation WHERE n_nationkey <> 5) SELECT month_key, coalesce(geo_key, -1) AS geo_key, price FROM panel LEFT JOIN k ON state = n_name")
def d11(spark, sf):
    dim = table(spark, sf, "nation").where("n_nationkey <> 5")
    return D.resolved(price_panel(spark, sf), dim, [("state", "n_name")], "n_nationkey", "geo_key").select("month_key", "geo_key", "price")


@query("d14_weather_fact", "SELECT CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS date_key, 0 AS geo_key, round(max(value), 6) AS hi, round(min(value), 6) AS lo FROM events GROUP BY ALL")
def d14(spark, sf):
    city = spark.createDataFrame([(0, "City")], "geo_key int, name string")
    days = table(spark, sf, "events").groupBy(E.date_key("ts").alias("date_key")).agg(E.rounded(F.max("value")).alias("hi"), E.rounded(F.min("value")).alias("lo")).withColumn("place", F.lit("City"))
    return D.resolved(days, city, [("place", "name")], "geo_key", "geo_fk").select("date_key", F.col("geo_fk").alias("geo_key"), "hi", "lo")


def fact(spark, sf):
    speed = F.when(F.col("days") > 0, F.col("distance") / F.col("days"))
    return trips(spark, sf).withColumns({"date_key": E.date_key("pickup_ts"), "mode_key": F.col("line_no") % 3, "seconds": F.col("days").cast("double") * 86400, "speed": speed})


@query("d12_daily_aggregate", f"""WITH {TRIPS_SQL}, f AS (SELECT *, days::DOUBLE * 86400 AS seconds, CASE WHEN days > 0 THEN distance / days END AS speed FROM trip)
SELECT CAST(strftime(pickup_ts, '%Y%m%d') AS INTEGER) AS date_key, pickup_zone, CAST(line_no % 3 AS INTEGER) AS mode_key, count(*) AS trip_count, round({tot('distance')}, 4) AS total_distance, round({tot('total', 6)}, 4) AS total_revenue,
  round({mean('fare')}, 4) AS avg_fare, round(median(fare), 4) AS median_fare, round({mean('seconds')}, 2) AS avg_duration_seconds, round({mean('speed', 8)}, 4) AS avg_speed FROM f GROUP BY ALL""")
def d12(spark, sf):
    return D.daily_aggregate(fact(spark, sf))


@query("d13_aggregate_navigation", f"""WITH {TRIPS_SQL} SELECT CAST(strftime(pickup_ts, '%Y%m') AS INTEGER) AS month, pickup_zone, CAST(count(*) AS BIGINT) AS trips, round({tot('total', 6)}, 2) AS revenue, true AS aggregate_agrees FROM trip GROUP BY ALL""")
def d13(spark, sf):
    """The same answer from the atomic fact and from the daily aggregate."""
    atomic = D.rolled_up(fact(spark, sf), F.lit(1), F.col("total"))
    agg = D.rolled_up(D.daily_aggregate(fact(spark, sf)), F.col("trip_count"), F.col("total_revenue")).toDF("month", "pickup_zone", "t2", "r2")
    both = atomic.join(agg, ["month", "pickup_zone"], "full")
    return both.select("month", "pickup_zone", "trips", "revenue", (F.col("trips").eqNullSafe(F.col("t2")) & (F.abs(F.col("revenue") - F.col("r2")) <= 0.011)).alias("aggregate_agrees"))


RULES = [
    {"id": "rows", "type": "row_count", "table": "lineitem", "severity": "FAIL", "params": {"min": 100}},
    {"id": "nulls", "type": "null_rate", "table": "lineitem", "column": "l_shipdate", "severity": "FAIL", "params": {"max_pct": 0.0}},
    {"id": "qty", "type": "range", "table": "lineitem", "column": "l_quantity", "severity": "WARN", "params": {"min": 5, "max": 45}},
    {"id": "flag", "type": "domain", "table": "lineitem", "column": "l_returnflag", "severity": "FAIL", "params": {"allowed": ["A", "N"]}},
    {"id": "expr", "type": "expression", "table": "lineitem", "severity": "WARN", "params": {"predicate": "l_discount <= 0.05"}},
    {"id": "scoped", "type": "range", "table": "lineitem", "column": "l_tax", "severity": "WARN", "params": {"max": 0.05, "where": "l_linestatus = 'O'"}},
    {"id": "surplus", "type": "unique", "table": "lineitem", "severity": "FAIL", "params": {"columns": ["l_orderkey", "l_linenumber"]}},
    {"id": "dupes", "type": "duplicates", "table": "lineitem", "severity": "FAIL", "params": {"columns": ["l_orderkey", "l_linenumber"]}},
    {"id": "parent", "type": "referential_integrity", "table": "keyed", "column": "fk", "severity": "FAIL", "params": {"parent": "supplier", "parent_key": "s_suppkey", "max_unknown_pct": 1.0}},
    {"id": "absent", "type": "row_count", "table": "nowhere", "severity": "FAIL"},
]


def quality_report(spark, sf):
    line = table(spark, sf, "lineitem")
    broken = line.select(F.when(F.col("l_orderkey") % 97 == 0, F.lit(None)).when(F.col("l_orderkey") % 89 == 0, F.lit(-1)).otherwise(F.col("l_suppkey")).alias("fk"))
    parents = table(spark, sf, "supplier").select("s_suppkey").unionByName(spark.createDataFrame([(-1,)], "s_suppkey long"))
    return Q.run(spark, RULES, {"lineitem": line, "keyed": broken, "supplier": parents})


QUALITY_SQL = """c AS (SELECT count(*) AS n, count(*) FILTER (l_shipdate IS NULL) AS a, count(*) FILTER (l_quantity < 5 OR l_quantity > 45) AS b, count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS d, count(*) FILTER (NOT l_discount <= 0.05) AS e,
  count(*) FILTER (l_linestatus = 'O') AS gn, count(*) FILTER (l_linestatus = 'O' AND l_tax > 0.05) AS g FROM lineitem), u AS (SELECT CAST(sum(k - 1) AS BIGINT) AS s FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber)),
p AS (SELECT count(*) FILTER (l_orderkey % 97 = 0 OR NOT l_orderkey % 89 = 0 AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier)) AS f, count(*) FILTER (l_orderkey % 97 <> 0 AND l_orderkey % 89 = 0) AS w FROM lineitem),
q AS (SELECT 'rows' AS rule_id, n AS rows_checked, 0::BIGINT AS rows_failed, NULL::BIGINT AS unknown_member_rows, CASE WHEN n < 100 THEN 'FAIL' ELSE 'PASS' END AS status FROM c UNION ALL SELECT 'nulls', n, a, NULL, CASE WHEN a > 0 THEN 'FAIL' ELSE 'PASS' END FROM c
UNION ALL SELECT 'qty', n, b, NULL, CASE WHEN b > 0 THEN 'WARN' ELSE 'PASS' END FROM c UNION ALL SELECT 'flag', n, d, NULL, CASE WHEN d > 0 THEN 'FAIL' ELSE 'PASS' END FROM c UNION ALL SELECT 'expr', n, e, NULL, CASE WHEN e > 0 THEN 'WARN' ELSE 'PASS' END FROM c
UNION ALL SELECT 'scoped', gn, g, NULL, CASE WHEN g > 0 THEN 'WARN' ELSE 'PASS' END FROM c UNION ALL SELECT 'surplus', n, s, NULL, CASE WHEN s > 0 THEN 'FAIL' ELSE 'PASS' END FROM c, u UNION ALL SELECT 'dupes', n, s, NULL, CASE WHEN s > 0 THEN 'WARN' ELSE 'PASS' END FROM c, u
UNION ALL SELECT 'parent', n, f, w, CASE WHEN f > 0 THEN 'FAIL' WHEN 100.0 * w / n > 1 THEN 'WARN' ELSE 'PASS' END FROM c, p UNION ALL SELECT 'absent', 0, 0, NULL, 'SKIP')"""


@query("q1_q10_rules", f"WITH {QUALITY_SQL} SELECT * FROM q")
def q1(spark, sf):
    return quality_report(spark, sf).select("rule_id", "rows_checked", "rows_failed", "unknown_member_rows", "status")


@query("q11_gate", f"WITH {QUALITY_SQL} SELECT count(*) FILTER (status = 'PASS') AS pass, count(*) FILTER (status = 'WARN') AS warn, count(*) FILTER (status = 'FAIL') AS fail, count(*) FILTER (status = 'SKIP') AS skip, CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'BLOCKED' ELSE 'CLEAR' END AS gate FROM q")
def q11(spark, sf):
    return Q.summary(quality_report(spark, sf))


@query("q12_report_rates", f"WITH {QUALITY_SQL} SELECT rule_id, CASE WHEN rows_checked > 0 THEN round(100.0::DOUBLE * rows_failed / rows_checked, 4) ELSE 0.0::DOUBLE END AS failure_pct, CASE WHEN rows_checked > 0 THEN round(100.0::DOUBLE * unknown_member_rows / rows_checked, 4) ELSE NULL END AS unknown_member_pct FROM q")
def q12(spark, sf):
    return quality_report(spark, sf).select("rule_id", E.rounded(F.col("failure_pct"), 4).alias("failure_pct"), E.rounded(F.col("unknown_member_pct"), 4).alias("unknown_member_pct"))


@query("s1_union_by_name", """SELECT 'customer' AS source, count(*) AS n, count(c_acctbal) AS with_customer, 0::BIGINT AS with_supplier, round(""" + tot("c_acctbal") + """, 4) AS balance FROM customer UNION ALL SELECT 'supplier', count(*), 0, count(s_acctbal), round(""" + tot("s_acctbal") + ", 4) FROM supplier")
def s1(spark, sf):
    rows = S.parquet_union(spark, [f"{sf}/customer.parquet", f"{sf}/supplier.parquet"])
    return rows.groupBy(F.regexp_extract("source_file", r"/(\w+)\.parquet", 1).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count("c_acctbal").alias("with_customer"), F.count("s_acctbal").alias("with_supplier"), E.rounded(E.total(F.coalesce("c_acctbal", "s_acctbal")), 4).alias("balance"))


def scratch(spark) -> str:
    """A new folder under the shared one."""
    return f"{S.shared_dir(spark)}/star-{uuid.uuid4().hex}"


@query("s2_s13_partitioned_roundtrip", "SELECT CAST(year(o_orderdate) AS SMALLINT) AS year, CAST(month(o_orderdate) AS TINYINT) AS month, count(*) AS n, round(" + tot("o_totalprice") + ", 4) AS total FROM orders GROUP BY ALL")
def s2(spark, sf):
    """Written twice, so a rerun that added rows would show."""
    rows, path = table(spark, sf, "orders").withColumns({"year": F.year("o_orderdate"), "month": F.month("o_orderdate")}), scratch(spark)
    S.write_partitioned(rows, path)
    S.write_partitioned(rows.where("year = 1996"), path)
    return S.partitioned(spark, path).groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"), E.rounded(E.total("o_totalprice"), 4).alias("total"))


@query("s3_s4_csv_roundtrip", "SELECT CAST(n_nationkey AS INTEGER) AS key, n_name AS name, CAST(n_regionkey * 1.5 AS DOUBLE) AS ratio FROM nation WHERE n_nationkey % 5 <> 0")
def s3(spark, sf):
    n, path = table(spark, sf, "nation"), scratch(spark)
    text = n.select(F.when(F.col("n_nationkey") % 5 == 0, F.lit("#key")).otherwise(F.concat(F.lit(" "), F.col("n_nationkey").cast("string"))).alias("key"), F.concat(F.col("n_name"), F.lit(" ")).alias("name"), (F.col("n_regionkey") * F.lit(1.5)).cast("string").alias("ratio"))
    S.write_csv({"main": text}, path)
    return S.csv_typed(spark, f"{path}/main", {"key": "int", "name": "string", "ratio": "double"}, ("key", "#")).drop("source_file")


FILED_SQL = f"{TRIPS_SQL}, filed AS (SELECT CASE WHEN line_no = 5 THEN '' ELSE strftime(dropoff_ts, '%Y-%m') END AS file_month, CASE WHEN line_no <> 4 THEN pickup_ts END AS pickup_ts, CASE WHEN line_no <> 3 THEN dropoff_ts END AS dropoff_ts FROM trip)"


@query("s7_file_profile", f"""WITH {FILED_SQL} SELECT file_month, CASE WHEN file_month = '' THEN 'trips_undated.parquet' ELSE 'trips_' || file_month || '.parquet' END AS source_file, count(*) AS raw_rows, min(pickup_ts) AS pickup_min, max(pickup_ts) AS pickup_max, min(dropoff_ts) AS dropoff_min, max(dropoff_ts) AS dropoff_max,
  count(*) FILTER (pickup_ts < TIMESTAMP '{LO}' OR pickup_ts >= TIMESTAMP '{HI}') AS pickup_out_of_window, count(*) FILTER (file_month <> strftime(pickup_ts, '%Y-%m')) AS pickup_month_mismatch, count(*) FILTER (pickup_ts IS NULL) AS null_pickup, count(*) FILTER (dropoff_ts IS NULL) AS null_dropoff FROM filed GROUP BY ALL""")
def s7(spark, sf):
    """Trips filed by month of arrival: most were picked up in another month, some have no pickup, some files no month."""
    rows, path = trips(spark, sf), scratch(spark)
    name = F.concat(F.lit("trips_"), F.when(F.col("line_no") == 5, "undated").otherwise(E.year_month("dropoff_ts")), F.lit(".parquet"))
    filed = rows.select(name.alias("file"), F.when(F.col("line_no") != 4, F.col("pickup_ts")).alias("pickup_ts"), F.when(F.col("line_no") != 3, F.col("dropoff_ts")).alias("dropoff_ts"))
    filed.repartition("file").write.partitionBy("file").parquet(path)
    return S.file_profile(S.parquet_union(spark, [path]), "pickup_ts", "dropoff_ts", LO, HI)


@query("s8_compared_counts", """WITH e AS (SELECT o_orderkey AS k, CAST(1 + o_orderkey % 4 AS BIGINT) AS expected FROM orders), o AS (SELECT l_orderkey AS k, count(*) AS observed FROM lineitem GROUP BY ALL)
SELECT k, expected, observed, observed - expected AS delta, CASE WHEN observed IS NULL THEN 'missing' ELSE 'mismatch' END AS status FROM e LEFT JOIN o USING (k) WHERE observed IS NULL OR observed <> expected""")
def s8(spark, sf):
    expected = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (1 + F.col("o_orderkey") % 4).alias("expected"))
    observed = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("observed"))
    return S.compared_counts(observed, expected, "k")


@query("s9_schema_drift", """SELECT f AS file, missing, unexpected, CAST(n AS INTEGER) AS column_count FROM (SELECT DISTINCT CASE WHEN year(o_orderdate) < 1998 THEN 'early' WHEN year(o_orderdate) < 2000 THEN 'middle' ELSE 'late' END AS f FROM orders) JOIN
  (VALUES ('early', []::VARCHAR[], []::VARCHAR[], 3), ('middle', []::VARCHAR[], ['zone'], 4), ('late', ['airport_fee'], []::VARCHAR[], 2)) v(f, missing, unexpected, n) USING (f)""")
def s9(spark, sf):
    """Files whose fee column changes its letters, gains a neighbour and goes; their parts have one schema a folder."""
    drift = S.schema_drift(spark, [drifting_files(spark, sf)], ["Ride_ID", "AIRPORT_FEE", "day"])
    return drift.select(F.regexp_extract("file", r"/(early|middle|late)/", 1).alias("file"), "missing", "unexpected", "column_count").distinct()


@query("s10_panel_profile", f"""WITH {PANEL_SQL}, m AS (SELECT month_key, count(DISTINCT state) AS n FROM panel GROUP BY ALL), l AS (SELECT list_sort(list(DISTINCT zone)) AS zone_list, list_sort(list(DISTINCT state)) AS state_list, min(month_key) FILTER (zone = 'ASIA') AS subset_first_month,
  max(month_key) FILTER (zone = 'ASIA') AS subset_last_month, count(DISTINCT month_key) FILTER (zone = 'ASIA') AS subset_months FROM panel),
g AS (SELECT min(n) AS min_units, max(n) AS max_units, min(n) < max(n) AS panel_is_unbalanced, min(month_key) AS first_month, max(month_key) AS last_month, count(*) AS months FROM m) SELECT * FROM g, l""")
def s10(spark, sf):
    return S.panel_profile(price_panel(spark, sf), "month_key", "state", ["zone", "state"], F.col("zone") == "ASIA")


ALL_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query("s11_provenance")
def s11(spark, sf):
    return S.provenance(spark, [f"{sf}/{t}.parquet" for t in ALL_TABLES])


@query("s11b_provenance_rows", " UNION ALL ".join(f"SELECT '{t}' AS relation, count(*) AS row_count FROM {t}" for t in ALL_TABLES))
def s11b(spark, sf):
    """The rows of the provenance records, by table (a table may be a folder of files)."""
    parts = [S.provenance(spark, [f"{sf}/{t}.parquet"]).agg(F.sum("row_count").alias("row_count")).select(F.lit(t).alias("relation"), "row_count") for t in ALL_TABLES]
    return reduce(DataFrame.unionByName, parts)


@query("s16_inventory")
def s16(spark, sf):
    return S.inventory(spark, {t: f"{sf}/{t}.parquet" for t in ALL_TABLES})


@query("s16b_inventory_rows", " UNION ALL ".join(f"SELECT '{t}' AS relation, count(*) AS row_count, true AS has_bytes FROM {t}" for t in ALL_TABLES))
def s16b(spark, sf):
    return s16(spark, sf).select("relation", "row_count", (F.col("bytes") > 0).alias("has_bytes"))


def weather_payload(spark, sf):
    """Days of events as one object of parallel arrays; the last of `wind` is missing and there is no `snow`."""
    days = table(spark, sf, "events").groupBy(F.to_date("ts").cast("string").alias("time")).agg(E.rounded(F.max("value")).alias("hi"), E.rounded(F.min("value")).alias("lo"))
    rows = F.array_sort(F.collect_list(F.struct("time", "hi", "lo")))
    each = lambda c: F.transform("r", lambda x: x[c]).alias(c)
    wind = F.transform(F.slice("r", F.lit(1), F.size("r") - 1), lambda x: x["hi"]).alias("wind")
    path = scratch(spark)
    days.agg(rows.alias("r")).select(F.struct(each("time"), each("hi"), each("lo"), wind).alias("daily")).coalesce(1).write.json(path)
    return path


@query("s5_columnar_json", "SELECT CAST(ts AS DATE) AS observation_date, round(max(value), 6) AS hi, round(min(value), 6) AS lo FROM events GROUP BY ALL")
def s5(spark, sf):
    return S.columnar_json(spark, weather_payload(spark, sf), "daily", "time").select("observation_date", "hi", "lo")


@query("s6_ragged_arrays", """WITH d AS (SELECT CAST(count(DISTINCT CAST(ts AS DATE)) AS INTEGER) AS n FROM events) SELECT v AS variable, CASE v WHEN 'wind' THEN n - 1 WHEN 'snow' THEN NULL ELSE n END AS observed_len, n AS expected_len, v = 'wind' AS is_ragged, v = 'snow' AS is_missing FROM d, (SELECT unnest(['hi', 'lo', 'wind', 'snow']) AS v)""")
def s6(spark, sf):
    return S.ragged(spark.read.json(weather_payload(spark, sf), multiLine=True), "daily", "time", ["hi", "lo", "wind", "snow"])


@query("s12_dataset_roundtrip", "SELECT * FROM customer")
def s12(spark, sf):
    path = scratch(spark)
    S.write_dataset(table(spark, sf, "customer"), path)
    return spark.read.parquet(path)


@query("s15_views", f"SELECT r_name AS zone, count(*) AS suppliers, round({tot('s_acctbal')}, 4) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def s15(spark, sf):
    S.as_views({t: table(spark, sf, t) for t in ("supplier", "nation", "region")}, "gold")
    return spark.sql("SELECT r_name AS zone, count(*) AS suppliers, floor(CAST(sum(CAST(s_acctbal AS DECIMAL(18,4))) AS DOUBLE) * 10000 + 0.5D) / 10000D AS balance FROM gold_supplier JOIN gold_nation ON s_nationkey = n_nationkey JOIN gold_region ON n_regionkey = r_regionkey GROUP BY r_name")


def drifting_files(spark, sf):
    """Orders in three folders: Airport_fee, then airport_fee and zone, then no fee."""
    path, y, c = scratch(spark), F.year("o_orderdate"), F.col
    rows = table(spark, sf, "orders").select(c("o_orderkey").alias("ride_id"), c("o_totalprice").alias("fee"), F.to_date("o_orderdate").alias("day"), c("o_orderpriority").alias("zone"), y.alias("y"))
    rows.where("y < 1998").select("ride_id", c("fee").alias("Airport_fee"), "day").write.parquet(f"{path}/early")
    rows.where("y >= 1998 AND y < 2000").select("ride_id", "day", c("fee").alias("airport_fee"), "zone").write.parquet(f"{path}/middle")
    rows.where("y >= 2000").select("ride_id", "day").write.parquet(f"{path}/late")
    return path


@query("s1b_drifting_columns", f"""SELECT CASE WHEN year(o_orderdate) < 1998 THEN 'early' WHEN year(o_orderdate) < 2000 THEN 'middle' ELSE 'late' END AS source, count(*) AS n, count(*) FILTER (year(o_orderdate) < 2000) AS with_fee, round({tot('CASE WHEN year(o_orderdate) < 2000 THEN o_totalprice END')}, 4) AS fees,
  count(DISTINCT CASE WHEN year(o_orderdate) BETWEEN 1998 AND 1999 THEN o_orderpriority END) AS zones, CAST(min(o_orderdate) AS DATE) AS first_day FROM orders GROUP BY ALL""")
def s1b(spark, sf):
    rows = S.parquet_union(spark, [drifting_files(spark, sf)])
    return rows.groupBy(F.regexp_extract("source_file", r"/(early|middle|late)/", 1).alias("source")).agg(
        F.count(F.lit(1)).alias("n"), F.count("Airport_fee").alias("with_fee"), E.rounded(E.total("Airport_fee"), 4).alias("fees"), F.count_distinct("zone").alias("zones"), F.min("day").alias("first_day")
    )


@query("s1c_drifting_case", "SELECT 'customer' AS source, count(*) AS n, CAST(NULL AS DOUBLE) AS least FROM customer UNION ALL SELECT 'supplier', count(*), min(s_acctbal) FROM supplier")
def s1c(spark, sf):
    """A column that has other letters in one table and is absent from the other."""
    parts = [S.drifting(table(spark, sf, t), "S_ACCTBAL", "double").agg(F.count(F.lit(1)).alias("n"), F.min("S_ACCTBAL").alias("least")).select(F.lit(t).alias("source"), "n", "least") for t in ("customer", "supplier")]
    return parts[0].unionByName(parts[1])


@query("s11c_digests", "SELECT n_regionkey AS region, count(*) AS n_lines, CAST(sum(length(n_name) + 1) AS BIGINT) AS bytes, sha256(string_agg(n_name || chr(10), '' ORDER BY n_name)) AS sha256 FROM nation GROUP BY ALL")
def s11c(spark, sf):
    """Digests of files whose content a table states: the nations of a region, a line each."""
    path = scratch(spark)
    n = table(spark, sf, "nation").select(F.col("n_regionkey").cast("int").alias("region"), "n_name")
    n.repartition(1).sortWithinPartitions("region", "n_name").write.partitionBy("region").text(path)
    files = S.digests(S.listed(spark, [path]).where(F.col("path").endswith(".txt"))).withColumn("region", F.regexp_extract("path", r"/region=(\d+)/", 1).cast("int"))
    lines = n.groupBy("region").agg(F.count(F.lit(1)).alias("n_lines"))
    return files.join(lines, "region").select("region", "n_lines", F.col("length").alias("bytes"), "sha256")


@query("s13_partition_report", "SELECT CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month, n * CASE WHEN y = 1996 AND m = 3 THEN 2 ELSE 1 END AS row_count, true AS has_bytes FROM (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ALL)")
def s13(spark, sf):
    """Rows and bytes a month after one month was built anew with its rows twice."""
    rows, path = table(spark, sf, "orders").withColumns({"year": F.year("o_orderdate"), "month": F.month("o_orderdate")}), scratch(spark)
    S.write_partitioned(rows, path)
    S.rebuild_month(rows.unionByName(rows), path, 1996, 3)
    return S.partition_report(spark, path).select("year", "month", "row_count", (F.col("bytes") > 0).alias("has_bytes"))


def cell_table(spark, sf):
    """Each zone a file with a sheet a year: a header, its states by month, a total row, a note and a repeated block.

    Panel and cells are written: the kinds of cells and the parts of panel() all read them, and Spark would else move
    filters on month texts down to the line items. Both hold rows by state and month, however many line items there are."""
    p = S.written(price_panel(spark, sf)).withColumns({"mon": (F.floor(F.col("month_key") / 100) % 100).cast("int"), "year": F.floor(F.col("month_key") / 10000).cast("int")})
    row = (F.dense_rank().over(Window.partitionBy("zone", "year").orderBy("state")) + 3).cast("int")
    base = p.withColumns({"row": row, "file": F.col("zone"), "sheet": F.concat(F.lit("s"), F.col("year"))})
    price = F.format_number("price", 4)
    body = base.select("file", "sheet", "row", (F.col("mon") + 1).alias("col"), F.concat(F.lit(" "), price).alias("value"))
    names = base.select("file", "sheet", "row", F.lit(1).alias("col"), F.concat(F.initcap("state"), F.lit("  State ")).alias("value")).distinct()
    day = F.to_date(F.col("month_key").cast("string"), "yyyyMMdd")
    text = F.when(F.col("mon") % 4 == 0, F.date_format(day, "MMMM yyyy")).when(F.col("mon") % 4 == 1, F.concat(F.lit("Price, "), F.date_format(day, "MMM"), F.lit(". "), F.date_format(day, "yyyy"))).otherwise(F.date_format(day, "yyyy-MM"))
    text = F.when(F.col("mon") % 4 == 3, F.concat(F.date_format(day, "MM"), F.lit("/"), F.date_format(day, "yyyy"))).otherwise(text)
    heads = base.select("file", "sheet", F.lit(3).alias("row"), (F.col("mon") + 1).alias("col"), text.alias("value")).distinct()
    sheets = base.select("file", "sheet").distinct()
    fixed = sheets.select("file", "sheet", F.inline(F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(v).alias("value")) for r, c, v in ((1, 1, "Prices"), (3, 1, "STATES"), (90, 1, "Average"), (90, 2, "7"), (95, 1, "Note: provisional"))])))
    again = names.select("file", "sheet", (F.col("row") + 100).alias("row"), "col", "value").union(body.select("file", "sheet", (F.col("row") + 100).alias("row"), "col", F.lit("1").alias("value")))
    return S.written(body.union(names).union(heads).union(fixed).union(again))


def variants(spark, sf):
    return zones(spark, sf).select(X.normalised(F.col("zone")).alias("variant"), F.col("zone").alias("canonical"), F.col("borough").alias("zone"))


@query("x1_x7_cell_panel", f"WITH {PANEL_SQL} SELECT printf('%04d-%02d', month_key // 10000, month_key // 100 % 100) AS month, state, price, zone AS file, 's' || month_key // 10000 AS sheet, month_key = max(month_key) OVER (PARTITION BY zone, month_key // 10000) AS is_current_month FROM panel")
def x1(spark, sf):
    return X.deduplicated(X.panel(cell_table(spark, sf), variants(spark, sf), ["average", "total"], years=(1990, 2100)))


@query("x5_block_ends", f"WITH {PANEL_SQL} SELECT DISTINCT zone AS file, 's' || month_key // 10000 AS sheet, 95 AS stop_row, 'Note: provisional' AS trigger_label FROM panel")
def x5(spark, sf):
    at = cell_table(spark, sf).where("row > 3 AND col = 1").select("file", "sheet", "row", F.col("value").alias("label"))
    return X.block_ends(X.resolved(at, "label", variants(spark, sf), ["average"]), "note")


@query("x6_excluded_labels", f"WITH {PANEL_SQL} SELECT unnest(['Average', 'Note: provisional']) AS label, count(DISTINCT (zone, month_key // 10000)) AS n FROM panel")
def x6(spark, sf):
    at = cell_table(spark, sf).where("row > 3 AND col = 1").select(F.col("value").alias("label"))
    return X.excluded_labels(X.resolved(at, "label", variants(spark, sf), ["average"]))


@query("x8_missing_months", f"WITH {PANEL_SQL}, k AS (SELECT DISTINCT month_key FROM panel WHERE month_key // 100 % 7 <> 0), c AS (SELECT unnest(generate_series((SELECT min(strptime(month_key::VARCHAR, '%Y%m%d')) FROM k), (SELECT max(strptime(month_key::VARCHAR, '%Y%m%d')) FROM k), INTERVAL 1 MONTH)) AS d) SELECT strftime(d, '%Y-%m') AS month FROM c WHERE CAST(strftime(d, '%Y%m%d') AS INTEGER) NOT IN (SELECT month_key FROM k)")
def x8(spark, sf):
    rows = price_panel(spark, sf).where(F.floor(F.col("month_key") / 100) % 7 != 0)
    return X.missing_months(rows.select(F.date_format(F.to_date(F.col("month_key").cast("string"), "yyyyMMdd"), "yyyy-MM").alias("month")), "month")


@query("x11_diagnostics", f"""WITH {PANEL_SQL}, p AS (SELECT * FROM panel) SELECT 'claimed_not_observed' AS metric, 1::BIGINT AS value UNION ALL SELECT 'observed_not_claimed', 0 UNION ALL SELECT 'implausible_prices', count(*) FILTER (price < 1500 OR price > 3000) FROM p
UNION ALL SELECT 'distinct_months', count(DISTINCT month_key) FROM p UNION ALL SELECT 'distinct_units', count(DISTINCT state) FROM p""")
def x11(spark, sf):
    return X.diagnostics(x1(spark, sf), ["1990-05"], 1500, 3000)
