"""Bindings of features, splits, the ladder and inference, with oracle SQL where SQL can say it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import features as M
from ..operators import inference as I
from ..operators import ladder as L
from ..operators.boosting import Size
from ..sources.io import shared_dir, written
from .registry import query
from .tables import PANEL_SQL, TRIPS_SQL, price_panel, table, trips
from .trip_queries import mean, tot

TEST = 20000101
D = "CAST(sum(CAST({0} AS DECIMAL(18,{1}))) OVER ({2}) AS DOUBLE)"
PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def prior(x: str, over: str, scale: int = 4) -> str:
    return f"CAST(sum({x}) OVER ({over} {PRIOR}) AS DOUBLE)"


TARGET_SQL = f"{PANEL_SQL}, tg AS (SELECT * FROM (SELECT state, zone, month_key, price, lead(price) OVER (PARTITION BY state ORDER BY month_key) AS target FROM panel) WHERE target IS NOT NULL)"


def targets(spark, sf):
    return M.next_target(price_panel(spark, sf), "state", "month_key", "price")


@query("m1_next_target", f"WITH {TARGET_SQL} SELECT * FROM tg")
def m1(spark, sf):
    return targets(spark, sf)


@query("m2_leaky_mean", f"WITH {PANEL_SQL} SELECT *, round({D.format('price', 4, 'PARTITION BY state')} / count(price) OVER (PARTITION BY state), 6) AS leaky FROM panel")
def m2(spark, sf):
    return M.leaky_mean(price_panel(spark, sf), ["state"], "price", "leaky")


W3 = f"PARTITION BY state ORDER BY month_key {PRIOR}"


@query("m3_prior_mean", f"WITH {PANEL_SQL} SELECT *, round({D.format('price', 4, W3)} / nullif(CAST(count(price) OVER ({W3}) AS DOUBLE), 0), 6) AS pit FROM panel")
def m3(spark, sf):
    return M.prior_mean(price_panel(spark, sf), "state", "month_key", "price", "pit")


CELLS = "(SELECT {k} month_key, CAST(sum(s) OVER ({p} ORDER BY month_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) AS s, CAST(sum(n) OVER ({p} ORDER BY month_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) AS n FROM (SELECT {k} month_key, sum(CAST({v} AS DECIMAL(18,4))) AS s, count({v}) AS n FROM {t} GROUP BY ALL))"


@query("m4_prior_cell_mean", f"""WITH {TRIPS_SQL}, t AS (SELECT order_key, line_no, pickup_zone, CAST(isodow(pickup_ts) AS INTEGER) AS dow, CAST(strftime(pickup_ts, '%Y%m01') AS INTEGER) AS month_key, CAST(days AS DOUBLE) AS y FROM trip),
c AS {CELLS.format(k='pickup_zone, dow,', p='PARTITION BY pickup_zone, dow', v='y', t='t')} SELECT t.*, round(c.s / c.n, 6) AS cell_mean FROM t JOIN c USING (pickup_zone, dow, month_key)""")
def m4(spark, sf):
    rows = trips(spark, sf).select("order_key", "line_no", "pickup_zone", E.iso_dow("pickup_ts").alias("dow"), E.month_key("pickup_ts").alias("month_key"), F.col("days").cast("double").alias("y"))
    return M.prior_cell_mean(rows, ["pickup_zone", "dow"], "month_key", "y", "cell_mean")


@query("m5_prior_encoding", f"""WITH {PANEL_SQL}, c AS {CELLS.format(k='state,', p='PARTITION BY state', v='price', t='panel')}, g AS {CELLS.format(k='', p='', v='price', t='panel')}, o AS (SELECT {mean('price')} AS o FROM panel)
SELECT panel.*, round((coalesce(c.s, 0) + 10.0::DOUBLE * coalesce(g.s / g.n, o)) / (coalesce(c.n, 0) + 10.0::DOUBLE), 6) AS encoded FROM panel JOIN c USING (state, month_key) JOIN g ON g.month_key = panel.month_key, o""")
def m5(spark, sf):
    return M.prior_encoding(price_panel(spark, sf), "state", "month_key", "price", 10.0, "encoded")


@query("m6_one_hot", f"WITH {PANEL_SQL}, t AS (SELECT DISTINCT zone FROM panel WHERE zone <> 'ASIA') SELECT state, month_key, CASE WHEN panel.zone IN (SELECT zone FROM t) THEN CAST((SELECT count(*) FROM t WHERE t.zone < panel.zone) AS INTEGER) ELSE -1 END AS hot_index FROM panel WHERE month_key >= {TEST}")
def m6(spark, sf):
    from pyspark.ml.functions import vector_to_array

    train, test = M.split_at(price_panel(spark, sf), "month_key", TEST)
    _, hot = M.one_hot(train.where("zone <> 'ASIA'"), test, "zone", "v")
    return hot.select("state", "month_key", (F.array_position(vector_to_array("v"), F.lit(1.0)) - 1).cast("int").alias("hot_index"))


@query("m7_m8_splits", f"""WITH {PANEL_SQL} SELECT CASE WHEN month_key < {TEST} THEN 'train' ELSE 'test' END AS side, count(*) AS n, min(month_key) AS first_month, max(month_key) AS last_month FROM panel GROUP BY ALL
UNION ALL SELECT CASE WHEN month_key // 100 % 100 <= 6 THEN 'train 1998' ELSE 'test 1998' END, count(*), min(month_key), max(month_key) FROM panel WHERE month_key // 10000 = 1998 GROUP BY ALL""")
def m7(spark, sf):
    rows = price_panel(spark, sf).withColumns({"year": F.floor(F.col("month_key") / 10000), "month": F.floor(F.col("month_key") / 100) % 100})
    train, test = M.split_at(rows, "month_key", TEST)
    a, b = M.split_months(rows, 1998, [1, 2, 3, 4, 5, 6], [7, 8, 9, 10, 11, 12])
    M.assert_order(train, test, "month_key")
    M.assert_order(a, b, "month_key")
    one = lambda df, s: df.agg(F.count(F.lit(1)).alias("n"), F.min("month_key").alias("first_month"), F.max("month_key").alias("last_month")).select(F.lit(s).alias("side"), "*")
    return reduce(DataFrame.unionByName, [one(train, "train"), one(test, "test"), one(a, "train 1998"), one(b, "test 1998")])


@query("m9_sampling", "WITH b AS (SELECT CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 17 AS INTEGER) AS bucket FROM orders) SELECT bucket, count(*) AS n FROM b GROUP BY ALL")
def m9(spark, sf):
    rows = table(spark, sf, "orders").select(M.bucket_of(F.md5(F.col("o_orderkey").cast("string"))).alias("bucket"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("m10_folds", f"""WITH {PANEL_SQL}, m AS (SELECT month_key, row_number() OVER (ORDER BY month_key) - 1 AS i, count(*) OVER () AS c FROM (SELECT DISTINCT month_key FROM panel)), f AS (SELECT unnest(range(0, 100)) AS k)
SELECT CAST(k AS INTEGER) AS fold, month_key, CASE WHEN i < 15 + 2 * k THEN 'train' ELSE 'validation' END AS side FROM f, m WHERE 15 + 2 * k + 2 <= c AND i < 17 + 2 * k""")
def m10(spark, sf):
    months = [r["month_key"] for r in price_panel(spark, sf).select("month_key").distinct().collect()]
    return M.folds(spark, months, 15, 2)


#: The panel task: 25 months of training rows, 5 of test rows.
FROM, UNTIL = 19971201, 20000501
CANDIDATES = [
    Size(7, 0.10, 5), Size(7, 0.10, 20, 1.0, 1.0), Size(7, 0.03, 5), Size(15, 0.05, 10), Size(15, 0.05, 20, 1.0, 1.0), Size(15, 0.10, 30, 0.5, 0.5), Size(31, 0.05, 20, 1.0, 1.0), Size(31, 0.10, 50, 1.0, 1.0),
]
ORIGINAL, CONTROLLED, SEEDS = (Size(31, 0.05, 20), 300), "capacity_controlled", list(range(1, 21))
LADDER = ["V0", "V1", "V2", "V3a", "V3b", "V4a", "V4b"]


def ladder_rows(spark, sf):
    """(rung, state, month_key, is_train, y, features): the panel task's rows with the features of each rung.

    V0 and V1 read the price (before and after a gate that rejects nothing), V2 adds zone and month of the year, V3a a mean
    that leaks, V3b the mean of earlier months, V4a the state as indicators, V4b the state as an encoding of earlier months."""
    rows = targets(spark, sf).where(F.col("month_key").between(FROM, UNTIL))
    rows = M.prior_encoding(M.prior_mean(M.leaky_mean(rows, ["state"], "price", "leaky"), "state", "month_key", "price", "pit"), "state", "month_key", "target", 10.0, "encoded")
    whole = Window.partitionBy()  # a few hundred rows of months by states
    names = F.array_sort(F.collect_set("state").over(whole))
    rows = rows.withColumns({"states": names, "zone_no": F.array_position(F.array_sort(F.collect_set("zone").over(whole)), F.col("zone")).cast("double"), "month_no": (F.floor(F.col("month_key") / 100) % 100).cast("double")})
    price, shared = F.array("price"), F.array("price", "zone_no", "month_no")
    pit = F.concat(shared, F.array("pit"))
    hot = F.transform("states", lambda x: (x == F.col("state")).cast("double"))
    by = {"V0": price, "V1": price, "V2": shared, "V3a": F.concat(shared, F.array("leaky")), "V3b": pit, "V4a": F.concat(pit, hot), "V4b": F.concat(pit, F.array("encoded"))}
    rungs = F.array(*[F.struct(F.lit(k).alias("rung"), v.alias("features")) for k, v in by.items()])
    return rows.select("state", "month_key", (F.col("month_key") < TEST).alias("is_train"), F.col("target").alias("y"), F.inline(rungs))


def search_fits(spark, sf):
    rows = ladder_rows(spark, sf).where("is_train AND rung = 'V0'").drop("is_train")
    months = [r["month_key"] for r in rows.select("month_key").distinct().collect()]
    return L.searched(rows, M.folds(spark, months, 15, 2), ["state"], "month_key", CANDIDATES)


@query("m11_selection")
def m11(spark, sf):
    """All candidates on all folds of 15 months and more, in steps of 2, with early stopping."""
    return L.selected(search_fits(spark, sf))


def ladder_errors(spark, sf):
    """The stored errors of all rungs, both capacities and all seeds; fits are made once for the same rows."""
    rows = written(ladder_rows(spark, sf))
    path = L.store_of(spark, shared_dir(spark), rows, CANDIDATES, ORIGINAL, SEEDS)
    specs = [(v, r, s) for v in ("original", CONTROLLED) for r in LADDER for s in SEEDS]
    fits = rows.where("is_train AND rung = 'V0'").drop("is_train")
    months = [r["month_key"] for r in fits.select("month_key").distinct().collect()]
    best = L.selected(L.searched(fits, M.folds(spark, months, 15, 2), ["state"], "month_key", CANDIDATES)).where("is_best").first()
    sizes = {"original": ORIGINAL, CONTROLLED: (CANDIDATES[best["candidate"]], best["frozen_trees"])} if best else {"original": ORIGINAL, CONTROLLED: ORIGINAL}
    return L.error_store(rows, specs, sizes, ["state", "month_key"], path)


@query("m12_m13_references", f"""WITH {TRIPS_SQL}, d AS (SELECT *, CAST(strftime(pickup_ts, '%Y%m01') AS INTEGER) AS month_key FROM trip WHERE days > 0), k AS (SELECT {mean('days')} AS m, {tot('distance')} / {tot('days')} AS v FROM d WHERE month_key < {TEST}),
p AS (SELECT days, round(m, 6) AS pm, round(distance / v, 6) AS ps FROM d, k WHERE month_key >= {TEST})
SELECT 'mean' AS reference, count(*) AS n, round({mean('abs(days - pm)', 6)}, 6) AS mae, round(100.0::DOUBLE * {mean('CASE WHEN days <> 0 THEN abs(days - pm) / abs(days) END', 9)}, 6) AS mape FROM p UNION ALL
SELECT 'speed', count(*), round({mean('abs(days - ps)', 6)}, 6), round(100.0::DOUBLE * {mean('CASE WHEN days <> 0 THEN abs(days - ps) / abs(days) END', 9)}, 6) FROM p""")
def m12(spark, sf):
    rows = trips(spark, sf).where("days > 0").withColumn("month_key", E.month_key("pickup_ts"))
    train, test = M.split_at(rows, "month_key", TEST)
    out = L.references(train, test, "days", "distance", "days")
    long = out.select("days", F.inline(F.array(F.struct(F.lit("mean").alias("reference"), F.col("pred_mean").alias("p")), F.struct(F.lit("speed").alias("reference"), F.col("pred_speed").alias("p")))))
    return L.scores(long, ["reference"], "days", "p")


@query("m12b_carried_forward", f"""WITH {PANEL_SQL}, p AS (SELECT price, lag(price) OVER (PARTITION BY state ORDER BY month_key) AS p, month_key FROM panel)
SELECT 'carried forward' AS reference, count(*) AS n, round({mean('abs(price - p)', 6)}, 6) AS mae, round(100.0::DOUBLE * {mean('CASE WHEN price <> 0 THEN abs(price - p) / abs(price) END', 9)}, 6) AS mape FROM p WHERE month_key >= {TEST} AND p IS NOT NULL""")
def m12b(spark, sf):
    rows = L.carried_forward(price_panel(spark, sf), "state", "month_key", "price").where((F.col("month_key") >= TEST) & F.col("pred_carried").isNotNull())
    return L.scores(rows.withColumn("reference", F.lit("carried forward")), ["reference"], "price", "pred_carried")


@query("m14_m16_rungs")
def m14(spark, sf):
    """Seven rungs, two capacities and twenty seeds on the panel task: their errors by row."""
    return ladder_errors(spark, sf)


LEAKY = ["V3a"]


@query("m17b_fitted_repeats")
def m17b(spark, sf):
    return L.repeats(L.scored(ladder_errors(spark, sf)))


@query("m18b_fitted_paired")
def m18b(spark, sf):
    return L.paired(L.scored(ladder_errors(spark, sf)), list(zip(LADDER, LADDER[1:])))


@query("m19c_fitted_best")
def m19c(spark, sf):
    return L.best_rung(m17b(spark, sf), LEAKY)


@query("m32b_fitted_gap")
def m32b(spark, sf):
    """Each variant's best rung against the last value carried forward on the same test rows."""
    rows = ladder_rows(spark, sf).where("NOT is_train AND rung = 'V0'")
    carried = rows.agg(E.rounded(E.mean(F.abs(F.col("y") - F.element_at("features", 1)), 6)).alias("reference_mae")).select(F.lit("carried forward").alias("reference"), "reference_mae")
    return L.reference_gap(m17b(spark, sf), carried, LEAKY)


@query("m34c_fitted_steps")
def m34c(spark, sf):
    return L.against_base(m17b(spark, sf), "V0")


@query("m15_feature_pull", f"""WITH {TRIPS_SQL} SELECT order_key, line_no, borough, CAST(isodow(pickup_ts) AS INTEGER) AS dow, distance, days FROM trip JOIN zone ON pickup_zone = zone_key
WHERE pickup_ts >= TIMESTAMP '1998-01-01' AND pickup_ts < TIMESTAMP '1998-07-01' AND ('0x' || substr(md5(CAST(order_key AS VARCHAR)), 1, 8))::BIGINT % 17 = 3""")
def m15(spark, sf):
    from .tables import zones

    rows = trips(spark, sf).where((F.col("pickup_ts") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("pickup_ts") < F.lit("1998-07-01").cast("timestamp_ntz")))
    rows = rows.where(M.bucket_of(F.md5(F.col("order_key").cast("string"))) == 3)
    return rows.join(zones(spark, sf), F.col("pickup_zone") == F.col("zone_key")).select("order_key", "line_no", "borough", E.iso_dow("pickup_ts").alias("dow"), "distance", "days")


@query("m15b_gated_pull", f"""WITH {TRIPS_SQL}, w AS (SELECT day(ts) AS day_of_month, round(max(value), 6) AS hi, round(min(value), 6) AS lo FROM events WHERE day(ts) <> 7 GROUP BY ALL)
SELECT order_key, line_no, borough, CAST(isodow(pickup_ts) AS INTEGER) AS dow, isodow(pickup_ts) >= 6 AS is_weekend, CAST(year(pickup_ts) AS INTEGER) AS year, CAST(month(pickup_ts) AS INTEGER) AS month, hi, lo, distance, days FROM trip JOIN zone ON pickup_zone = zone_key LEFT JOIN w ON day(pickup_ts) = day_of_month
WHERE pickup_ts >= TIMESTAMP '1998-01-01' AND pickup_ts < TIMESTAMP '1998-07-01' AND ('0x' || substr(md5(CAST(order_key AS VARCHAR)), 1, 8))::BIGINT % 17 = 3 AND days BETWEEN 1 AND 900 AND distance <= 45""")
def m15b(spark, sf):
    """The gated pull: accepted trips with their zone, calendar columns and the weather of the day, where there is any."""
    from .tables import zones

    c = F.col
    rows = trips(spark, sf).where((c("pickup_ts") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (c("pickup_ts") < F.lit("1998-07-01").cast("timestamp_ntz")) & c("days").between(1, 900) & (c("distance") <= 45))
    rows = rows.where(M.bucket_of(F.md5(c("order_key").cast("string"))) == 3).join(zones(spark, sf), c("pickup_zone") == c("zone_key"))
    weather = table(spark, sf, "events").where(F.dayofmonth("ts") != 7).groupBy(F.dayofmonth("ts").alias("day_of_month")).agg(E.rounded(F.max("value")).alias("hi"), E.rounded(F.min("value")).alias("lo"))
    out = rows.join(weather, F.dayofmonth("pickup_ts") == c("day_of_month"), "left")
    return out.select("order_key", "line_no", "borough", E.iso_dow("pickup_ts").alias("dow"), (E.iso_dow("pickup_ts") >= 6).alias("is_weekend"), F.year("pickup_ts").alias("year"), F.month("pickup_ts").alias("month"), "hi", "lo", "distance", "days")


# Error frames that need no fitting, so that the statistics over them have an oracle: four rungs of simple predictors,
# five "seeds" by content bucket.
ERR_SQL = f"""{TARGET_SQL}, ft AS (SELECT *, round({D.format('price', 4, W3)} / nullif(CAST(count(price) OVER ({W3}) AS DOUBLE), 0), 6) AS pit, round({D.format('price', 4, 'PARTITION BY zone, month_key')} / count(*) OVER (PARTITION BY zone, month_key), 6) AS zm,
  round({D.format('price', 4, 'PARTITION BY state')} / count(*) OVER (PARTITION BY state), 6) AS lk FROM tg),
er AS (SELECT 'panel' AS variant, r.rung, CAST(('0x' || substr(md5(state), 1, 8))::BIGINT % 5 AS INTEGER) AS seed, state, zone, month_key, target, r.p AS prediction, round(abs(target - r.p), 6) AS abs_error
  FROM ft, LATERAL (SELECT unnest(['V0', 'V1', 'V2', 'V3']) AS rung, unnest([price, coalesce(pit, price), zm, lk]) AS p) r WHERE month_key >= {TEST}),
rs AS (SELECT variant, rung, seed, round({mean('abs_error', 6)}, 6) AS mae, round(100.0::DOUBLE * {mean('CASE WHEN target <> 0 THEN abs_error / target END', 9)}, 6) AS mape FROM er GROUP BY ALL)"""


def errors(spark, sf):
    rows = M.leaky_mean(M.prior_mean(targets(spark, sf), "state", "month_key", "price", "pit"), ["state"], "price", "lk")
    rows = M.leaky_mean(rows, ["zone", "month_key"], "price", "zm").where(F.col("month_key") >= TEST)
    rungs = F.array(*[F.struct(F.lit(n).alias("rung"), c.alias("prediction")) for n, c in (("V0", F.col("price")), ("V1", F.coalesce("pit", "price")), ("V2", F.col("zm")), ("V3", F.col("lk")))])
    seed = M.bucket_of(F.md5("state"), 5)
    return rows.select(F.lit("panel").alias("variant"), seed.alias("seed"), "state", "zone", "month_key", "target", F.inline(rungs)).withColumn("abs_error", E.rounded(F.abs(F.col("target") - F.col("prediction"))))


def results(spark, sf):
    rows = errors(spark, sf)
    return rows.groupBy("variant", "rung", "seed").agg(E.rounded(E.mean("abs_error", 6)).alias("mae"), E.rounded(F.lit(100.0) * E.mean(F.when(F.col("target") != 0, F.col("abs_error") / F.col("target")), 9)).alias("mape"))


@query("m16_error_frame", f"WITH {ERR_SQL} SELECT * FROM er")
def m16(spark, sf):
    return errors(spark, sf)


SUM_SQL = f"""{ERR_SQL}, sm AS (SELECT variant, rung, round({mean('mae', 6)}, 6) AS mae_mean, round(stddev_samp(mae), 4) AS mae_sd, min(mae) AS mae_min, max(mae) AS mae_max, round({mean('mape', 6)}, 6) AS mape_mean, round(stddev_samp(mape), 4) AS mape_sd, min(mape) AS mape_min, max(mape) AS mape_max,
  count(*) AS n_repeats, arg_min(mae, seed) AS mae_first_seed, array_to_string(list_sort(list(seed)), ',') AS seeds FROM rs GROUP BY variant, rung)"""


@query("m17_repeats", f"WITH {SUM_SQL} SELECT * FROM sm")
def m17(spark, sf):
    return L.repeats(results(spark, sf))


@query("m18_paired", f"""WITH {ERR_SQL}, d AS (SELECT a.variant, seed, a.rung AS rung_a, b.rung AS rung_b, b.mae - a.mae AS d FROM rs a JOIN rs b USING (variant, seed) WHERE (a.rung, b.rung) IN (('V0', 'V1'), ('V0', 'V2'), ('V1', 'V3'))),
g AS (SELECT variant, rung_a, rung_b, count(*) AS n, {mean('d', 6)} AS m, stddev_samp(d) AS s, min(d) AS lo, max(d) AS hi, count(*) FILTER (d > 0) AS up, count(*) FILTER (d < 0) AS down,
  string_agg(CAST(CAST(d AS DECIMAL(18,4)) AS VARCHAR), ';' ORDER BY seed) AS per_seed_diffs FROM d GROUP BY ALL)
SELECT variant, rung_a, rung_b, n AS n_repeats, round(m, 6) AS mean_diff_mae, round(s, 4) AS sd_diff_mae, round(lo, 6) AS min_diff, round(hi, 6) AS max_diff, round(m / s, 3) AS mean_over_sd, CASE WHEN m > 0 THEN up WHEN m < 0 THEN down ELSE 0 END AS n_same_direction,
  CASE WHEN m > 0 THEN up WHEN m < 0 THEN down ELSE 0 END = n AS direction_consistent, CASE WHEN m > 0 THEN rung_a WHEN m < 0 THEN rung_b ELSE 'tie' END AS better_rung, per_seed_diffs FROM g""")
def m18(spark, sf):
    return L.paired(results(spark, sf), [("V0", "V1"), ("V0", "V2"), ("V1", "V3")])


@query("m19_best_rung", f"WITH {SUM_SQL} SELECT variant, arg_min(rung, (mae_mean, rung)) AS best_rung, min(mae_mean) AS best_mae FROM sm WHERE rung NOT IN ('V3') GROUP BY variant")
def m19(spark, sf):
    return L.best_rung(L.repeats(results(spark, sf)), ["V3"])


@query("m19b_adjacent", f"WITH {SUM_SQL} SELECT * FROM (SELECT variant, rung AS rung_a, lead(rung) OVER (PARTITION BY variant ORDER BY rung) AS rung_b FROM sm) WHERE rung_b IS NOT NULL")
def m19b(spark, sf):
    return L.adjacent(L.repeats(results(spark, sf)))


KEY = ["state", "zone", "month_key"]


def diffs(spark, sf, a="V0", b="V1"):
    rows = errors(spark, sf)
    pick = lambda r: rows.where(F.col("rung") == r).select(*KEY, "abs_error")
    return I.differences(pick(a), pick(b), KEY)


DIFF_SQL = f"{ERR_SQL}, df AS (SELECT a.state, a.zone, a.month_key, b.abs_error - a.abs_error AS d FROM er a JOIN er b USING (state, month_key) WHERE a.rung = 'V0' AND b.rung = 'V1')"


RESAMPLES = 10_000


def draw_sql(k: str, b: str, seed: int = 1) -> tuple[str, str, str]:
    """The three steps of inference.draw as SQL over a column x."""
    return (f"({k} * 48271 + {b} * 69621 + {seed * 16807 + 1}) % {I.P}", f"(x * x + 40692 * x + {b}) % {I.P}", f"(x * x + 40014 * x + {k}) % {I.P}")


D1, D2, D3 = draw_sql("k", "b")
WEIGHT = "CASE " + " ".join(f"WHEN x < {t} THEN {i}" for i, t in enumerate(I.POISSON)) + " ELSE 9 END"


@query("m20_paired_bootstrap", f"""WITH {DIFF_SQL}, r AS (SELECT ('0x' || substr(md5(concat_ws('|', state, zone, month_key)), 1, 7))::BIGINT AS k, CAST(floor(d * 1000000 + 0.5) AS BIGINT) AS d FROM df),
x1 AS (SELECT k, d, b, {D1} AS x FROM r, (SELECT CAST(unnest(range(1, {RESAMPLES} + 1)) AS BIGINT) AS b)), x2 AS (SELECT k, d, b, {D2} AS x FROM x1), x3 AS (SELECT k, d, b, {D3} AS x FROM x2), w AS (SELECT b, d, {WEIGHT} AS w FROM x3),
m AS (SELECT round(CAST(sum(w * d) AS DOUBLE) / sum(w) / 1000000, 9) AS m FROM w GROUP BY b HAVING sum(w) > 0)
SELECT count(*) AS resamples, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high, (SELECT {mean('d', 6)} FROM df) AS mean_diff, (SELECT count(*) FROM df) AS n_pairs FROM m""")
def m20(spark, sf):
    return I.paired_bootstrap(diffs(spark, sf), KEY, RESAMPLES)


def cluster_sql(c: str) -> str:
    return f"""SELECT count(*) AS resamples, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high, any_value(g) AS n_clusters, '{c}' AS cluster FROM (
SELECT b, any_value(g) AS g, round(CAST(sum(CAST(s AS DECIMAL(18,6))) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 9) AS m FROM (SELECT b, g, {D3} % g AS i FROM (SELECT b, g, k, {D2} AS x FROM (SELECT b, g, k, {D1} AS x FROM
(SELECT CAST(unnest(range(1, {RESAMPLES} + 1)) AS BIGINT) AS b), (SELECT count(*) AS g, CAST(unnest(range(1, count(*) + 1)) AS BIGINT) AS k FROM cs_{c})))) JOIN cs_{c} USING (i) GROUP BY b)"""


CLUSTER_ROWS = ", ".join(f"cs_{c} AS (SELECT row_number() OVER (ORDER BY {c}) - 1 AS i, {tot('d', 6)} AS s, count(*) AS n FROM df GROUP BY {c})" for c in ("state", "month_key"))


@query("m21_cluster_bootstrap", f"WITH {DIFF_SQL}, {CLUSTER_ROWS} {cluster_sql('state')} UNION ALL {cluster_sql('month_key')}")
def m21(spark, sf):
    parts = [I.cluster_bootstrap(I.clusters(diffs(spark, sf), [c]), RESAMPLES).withColumn("cluster", F.lit(c)) for c in ("state", "month_key")]
    return parts[0].unionByName(parts[1])


@query("m21b_cluster_sums", f"WITH {DIFF_SQL} SELECT month_key, {tot('d', 6)} AS s, count(*) AS n, round({tot('d * d', 6)}, 3) AS q FROM df GROUP BY ALL")
def m21b(spark, sf):
    return I.clusters(diffs(spark, sf), ["month_key"]).withColumn("q", E.rounded(F.col("q"), 3))


CL = f"{DIFF_SQL}, cl AS (SELECT month_key, {tot('d', 6)} AS s, count(*) AS n, {tot('d * d', 6)} AS q FROM df GROUP BY ALL), tt AS (SELECT sum(n)::DOUBLE AS n, count(*)::DOUBLE AS g, sum(s) AS s, sum(q) AS q FROM cl)"


@query("m22_moments", f"""WITH {CL}, r AS (SELECT any_value(tt.n) AS n, any_value(g) AS g, any_value(tt.s) AS s, any_value(tt.q) AS q, sum((cl.s - cl.n * tt.s / tt.n) ** 2) AS r FROM cl, tt),
e AS (SELECT s / n AS m, sqrt((q - s * s / n) / (n - 1) / n) AS se, sqrt(g / (g - 1) * r) / n AS cse FROM r)
SELECT round(m, 4) AS mean_diff, round(m - 1.959964 * se, 4) AS iid_low, round(m + 1.959964 * se, 4) AS iid_high, round(cse / se, 3) AS se_ratio, ((m - 1.959964 * se) * (m + 1.959964 * se) > 0) <> ((m - 1.959964 * cse) * (m + 1.959964 * cse) > 0) AS conclusion_changed FROM e""")
def m22(spark, sf):
    return I.moments(I.clusters(diffs(spark, sf), ["month_key"]))


@query("m23_occurrences", """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem), r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem WHERE l_quantity > 10)
SELECT l_orderkey, l_linenumber, CAST(k AS INTEGER) AS k, l_partkey FROM l JOIN r USING (l_orderkey, l_linenumber, k)""")
def m23(spark, sf):
    line = table(spark, sf, "lineitem")
    key, order = ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"]
    left, right = I.occurrences(line, key, order), I.occurrences(line.where("l_quantity > 10"), key, order)
    return left.select(*key, "k", "l_partkey").join(right.select(*key, "k"), [*key, "k"])


def tail_sql(source: str) -> str:
    """CTEs that end in tails(k, t, n, p): the two-sided Student-t tails of source(k, t, n), by the recurrence of exprs.t_tail."""
    gamma = lambda x: f"(({x} + 8 - 0.5) * ln({x} + 8) - ({x} + 8) + 0.9189385332046727 + 1 / (12 * ({x} + 8)) - 1 / (360 * ({x} + 8) ** 3) + 1 / (1260 * ({x} + 8) ** 5) - ln({' * '.join(f'({x} + {i})' for i in range(8))}))"
    solid = lambda c: f"CASE WHEN abs({c}) < 1e-300 THEN 1e-300 ELSE {c} END"
    return f"""b0 AS (SELECT k, t, n::DOUBLE AS n, n::DOUBLE / (n + t * t) AS x0 FROM {source} WHERE t IS NOT NULL AND n > 0), b1 AS (SELECT *, x0 > (n / 2 + 1) / (n / 2 + 2.5) AS sw FROM b0),
b2 AS (SELECT *, CASE WHEN sw THEN 0.5::DOUBLE ELSE n / 2 END AS a, CASE WHEN sw THEN n / 2 ELSE 0.5::DOUBLE END AS b, CASE WHEN sw THEN 1 - x0 ELSE x0 END AS x FROM b1),
st AS (SELECT k, a, b, x, 0 AS i, 1.0::DOUBLE AS c, 1 / {solid('(1 - (a + b) * x / (a + 1))')} AS d, 1 / {solid('(1 - (a + b) * x / (a + 1))')} AS h FROM b2 UNION ALL
  SELECT k, a, b, x, i, c2, d2, h * d2 * c2 FROM (SELECT k, a, b, x, i, h, {solid('(1 + e / c)')} AS c2, 1 / {solid('(1 + e * d)')} AS d2 FROM (SELECT k, a, b, x, i + 1 AS i, c, d, h, (i + 2) // 2 AS m,
    CASE WHEN (i + 1) % 2 = 1 THEN ((i + 2) // 2) * (b - (i + 2) // 2) * x / ((a + 2 * ((i + 2) // 2) - 1) * (a + 2 * ((i + 2) // 2))) ELSE -(a + (i + 2) // 2) * (a + b + (i + 2) // 2) * x / ((a + 2 * ((i + 2) // 2)) * (a + 2 * ((i + 2) // 2) + 1)) END AS e FROM st WHERE i < {E.TAIL_STEPS}))),
tails AS (SELECT b2.k, t, n, CASE WHEN sw THEN 1 - f * h ELSE f * h END AS p FROM (SELECT *, exp({gamma('(a + b)')} - {gamma('a')} - {gamma('b')} + a * ln(greatest(x, 1e-300)) + b * ln(greatest(1 - x, 1e-300))) / a AS f FROM b2) b2 JOIN st ON st.k = b2.k WHERE st.i = {E.TAIL_STEPS})"""


def reference_diffs(spark, sf):
    """Each rung's error minus that of the last value carried forward (V0), by row and seed."""
    rows = errors(spark, sf)
    ref = rows.where("rung = 'V0'").select(*KEY, F.col("abs_error").alias("ref"))
    return rows.where("rung <> 'V0'").join(ref, KEY).select("variant", "rung", "seed", *KEY, (F.col("abs_error") - F.col("ref")).alias("d"))


REF_SQL = f"""{ERR_SQL}, rd AS (SELECT a.variant, a.rung, a.seed, a.state, a.month_key, a.abs_error - b.abs_error AS d FROM er a JOIN er b USING (state, zone, month_key) WHERE a.rung <> 'V0' AND b.rung = 'V0')"""
SQ = "CAST(sum(CAST({0} AS DECIMAL(38,6)) * CAST({0} AS DECIMAL(38,6))) AS DOUBLE)"
DM_SQL = f"""{REF_SQL}, dg AS (SELECT variant, rung, seed, count(d)::DOUBLE AS n, {tot('d', 6)} AS s, {SQ.format('d')} AS q FROM rd GROUP BY ALL), dv AS (SELECT *, s / n AS m, CASE WHEN n > 1 THEN (q - s * s / n) / (n - 1) END AS v FROM dg),
dt AS (SELECT *, CASE WHEN v > 0 THEN m / sqrt(v / n) END AS dm, variant || rung || seed AS k FROM dv), dk AS (SELECT k, dm AS t, n - 1 AS n FROM dt), {tail_sql('dk')},
dp AS (SELECT variant, rung, seed, CAST(dt.n AS BIGINT) AS n, round(m, 4) AS mean_diff, round(dm, 4) AS dm, CAST(dt.n - 1 AS BIGINT) AS df, round(p, 6) AS p_value, m < 0 AS beats_reference, coalesce(round(p, 6) < 0.05, false) AS is_significant FROM dt LEFT JOIN tails USING (k))"""


@query("m24_diebold_mariano", f"WITH RECURSIVE {DM_SQL} SELECT * FROM dp")
def m24(spark, sf):
    return I.diebold_mariano(reference_diffs(spark, sf), ["variant", "rung", "seed"])


@query("m24c_dm_summary", f"""WITH RECURSIVE {DM_SQL} SELECT variant, rung, min(n) AS n_per_seed, count(*) AS n_seeds, round({mean('dm')}, 4) AS mean_dm, round(stddev_samp(dm), 4) AS sd_dm, round({mean('p_value', 6)}, 6) AS mean_p_value, count(*) FILTER (beats_reference) AS n_seeds_beating, count(*) FILTER (is_significant) AS n_seeds_significant FROM dp GROUP BY ALL""")
def m24c(spark, sf):
    return I.dm_summary(m24(spark, sf), ["variant", "rung"])


@query("m24b_dm_statistic", f"WITH {DIFF_SQL}, g AS (SELECT count(d)::DOUBLE AS n, {tot('d', 6)} AS s, {SQ.format('d')} AS q FROM df) SELECT 'V1-V0' AS pair, CAST(n AS BIGINT) AS n, round(s / n, 4) AS mean_diff, round((s / n) / sqrt(((q - s * s / n) / (n - 1)) / n), 4) AS dm, CAST(n - 1 AS BIGINT) AS df FROM g")
def m24b(spark, sf):
    return I.diebold_mariano(diffs(spark, sf).withColumn("pair", F.lit("V1-V0")), ["pair"]).select("pair", "n", "mean_diff", "dm", "df")


def cluster_part(c: str) -> str:
    return f"""{c}0 AS (SELECT rung, {c}, {tot('d', 6)} AS s, count(*) AS n FROM rd GROUP BY ALL), {c}1 AS (SELECT *, s - n * CAST(sum(CAST(s AS DECIMAL(18,6))) OVER (PARTITION BY rung) AS DOUBLE) / sum(n) OVER (PARTITION BY rung) AS r FROM {c}0),
{c}2 AS (SELECT rung, count(*)::DOUBLE AS g, sum(n)::DOUBLE AS n, CAST(sum(CAST(s AS DECIMAL(18,6))) AS DOUBLE) AS s, CAST(sum(CAST(round(r * r, 6) AS DECIMAL(30,6))) AS DOUBLE) AS r2 FROM {c}1 GROUP BY rung), {c}3 AS (SELECT rung, '{c}' AS kind, g, (s / n) / (sqrt(g / (g - 1) * r2) / n) AS t FROM {c}2)"""


@query("m25_cluster_dm", f"""WITH RECURSIVE {REF_SQL}, {cluster_part('month_key')}, {cluster_part('state')},
g0 AS (SELECT rung, 'lag0' AS kind, n AS g, (s / n) / sqrt(((q - s * s / n) / (n - 1)) / n) AS t, s / n AS m FROM (SELECT rung, count(d)::DOUBLE AS n, {tot('d', 6)} AS s, {SQ.format('d')} AS q FROM rd GROUP BY rung)),
al AS (SELECT rung, kind, g, t FROM g0 UNION ALL SELECT * FROM month_key3 UNION ALL SELECT * FROM state3), dk AS (SELECT rung || kind AS k, t, g - 1 AS n FROM al), {tail_sql('dk')}
SELECT g0.rung, CAST(g0.g AS BIGINT) AS n_observations, round(m, 4) AS mean_loss_diff, round(g0.t, 4) AS dm_lag0_stat, CAST(g0.g - 1 AS BIGINT) AS dm_lag0_df, round(p0.p, 6) AS dm_lag0_p, {', '.join(f"round(c_{c}.t, 3) AS dm_{c}_cluster_stat, CAST(c_{c}.g - 1 AS BIGINT) AS dm_{c}_cluster_df, round(p_{c}.p, 6) AS dm_{c}_cluster_p, CAST(c_{c}.g AS BIGINT) AS n_{c}_clusters" for c in ('month_key', 'state'))}
FROM g0 JOIN tails p0 ON p0.k = g0.rung || 'lag0' {' '.join(f"JOIN {c}3 c_{c} ON c_{c}.rung = g0.rung JOIN tails p_{c} ON p_{c}.k = g0.rung || '{c}'" for c in ('month_key', 'state'))}""")
def m25(spark, sf):
    return I.cluster_diebold_mariano(reference_diffs(spark, sf), ["rung"], ["month_key", "state"])


WIDE = ", ".join(f"""round({mean(f"CASE WHEN rung = '{r}' THEN abs_error END", 6)}, 6) AS "{r}" """ for r in ("V0", "V1", "V2"))


@query("m26_errors_by_month", f"""WITH {ERR_SQL}, w AS (SELECT month_key, {WIDE} FROM er GROUP BY month_key) SELECT *, "V0" < "V1" AS "reference_beats_V1", "V0" < "V2" AS "reference_beats_V2" FROM w""")
def m26(spark, sf):
    return I.errors_by(errors(spark, sf), "month_key", ["V0", "V1", "V2"], "V0")


@query("m27_support", f"""WITH {PANEL_SQL}, b AS (SELECT CAST(floor(price / 100) AS INTEGER) AS band, month_key < {TEST} AS tr, price > 3000 AS hi FROM panel), s AS (SELECT CAST(unnest(range(min(band), max(band) + 1)) AS INTEGER) AS band FROM b)
SELECT s.band, s.band * 100.0::DOUBLE AS band_from, count(*) FILTER (tr) AS train_rows, count(*) FILTER (tr AND hi) AS train_rows_above_ceiling, count(*) FILTER (NOT tr) AS test_rows, count(*) FILTER (NOT tr AND hi) AS test_rows_above_ceiling FROM s LEFT JOIN b USING (band) GROUP BY s.band""")
def m27(spark, sf):
    return I.support(*M.split_at(price_panel(spark, sf), "month_key", TEST), "price", 100.0, 3000.0)


@query("m28_ranges", f"WITH {ERR_SQL} SELECT rung, min(target) AS y_min, max(target) AS y_max, min(prediction) AS prediction_min, max(prediction) AS prediction_max, round({mean('target')}, 6) AS y_mean, round({mean('prediction', 6)}, 6) AS prediction_mean, max(prediction) < max(target) AS undershoots FROM er GROUP BY rung")
def m28(spark, sf):
    return I.ranges(errors(spark, sf), "rung", "target", "prediction")


@query("m28b_pooled_ceilings", f"""WITH {ERR_SQL}, sd AS (SELECT rung, seed, min(prediction) AS lo, max(prediction) AS hi FROM er GROUP BY ALL), pl AS (SELECT rung, count(*) AS n_seeds, min(lo) AS lo, max(hi) AS hi, string_agg(printf('seed%d:[%.2f,%.2f]', seed, round(lo, 2), round(hi, 2)), ';' ORDER BY seed) AS per_seed_pred_min_max FROM sd GROUP BY rung),
te AS (SELECT min(target) AS lo, max(target) AS hi, count(*) AS n FROM tg WHERE month_key >= {TEST}), tr AS (SELECT min(target) AS lo, max(target) AS hi FROM tg WHERE month_key < {TEST}), ab AS (SELECT rung, count(*) FILTER (target > pl.hi) AS above FROM pl, tg WHERE month_key >= {TEST} GROUP BY rung)
SELECT rung, n_seeds, te.n AS n_test_rows, round(pl.lo, 4) AS pooled_pred_min, round(pl.hi, 4) AS pooled_pred_max, round(tr.lo, 4) AS train_target_min, round(tr.hi, 4) AS train_target_max, round(te.lo, 4) AS test_target_min, round(te.hi, 4) AS test_target_max, round(tr.hi - pl.hi, 4) AS pred_max_below_train_max_by, round(te.hi - pl.hi, 4) AS pred_max_below_test_max_by,
  above AS n_test_actuals_above_pooled_pred_max, round(100.0::DOUBLE * above / te.n, 4) AS pct_test_actuals_above_pooled_pred_max, round(CASE WHEN above > 0 THEN te.hi - pl.hi ELSE 0 END, 4) AS max_actual_missed_by, per_seed_pred_min_max FROM pl JOIN ab USING (rung), te, tr""")
def m28b(spark, sf):
    train, test = M.split_at(targets(spark, sf), "month_key", TEST)
    return I.pooled_ceilings(errors(spark, sf), train, test, "rung", "seed", "target", "prediction")


RUNGS = ["V0", "V1", "V2", "V3"]


@query("m28c_monthly_means", f"""WITH {ERR_SQL} SELECT month_key, count(DISTINCT state) AS n_units, round({mean("CASE WHEN rung = 'V0' THEN target END")}, 6) AS actual_mean, {', '.join(f"""round({mean(f"CASE WHEN rung = '{r}' THEN prediction END", 6)}, 6) AS "pred_{r}_mean" """ for r in RUNGS)} FROM er GROUP BY month_key""")
def m28c(spark, sf):
    return I.monthly_means(errors(spark, sf), "month_key", "rung", RUNGS, "target", "prediction", "state")


@query("m29_window_profile", f"""WITH w AS (SELECT CASE WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'train' ELSE 'test' END AS "window", CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 17 AS INTEGER) AS bucket, count(*) AS row_count, min(o_totalprice) AS y_min, max(o_totalprice) AS y_max FROM orders GROUP BY ALL)
SELECT *, CAST(row_count AS DOUBLE) / CAST(sum(row_count) OVER (PARTITION BY "window") AS DOUBLE) AS realised_fraction FROM w""")
def m29(spark, sf):
    orders = table(spark, sf, "orders")
    window = F.when(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"), "train").otherwise("test")
    return I.window_profile(orders, window, M.bucket_of(F.md5(F.col("o_orderkey").cast("string"))), "o_totalprice")


@query("m29b_sampling_report", """WITH o AS (SELECT CASE WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'train' ELSE 'test' END AS w, CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 17 AS INTEGER) AS bucket, o_totalprice AS y FROM orders),
t AS (SELECT w, count(*) AS window_rows, min(y) AS target_min, max(y) AS target_max FROM o GROUP BY w), s AS (SELECT w, bucket, count(*) AS n_rows FROM o WHERE bucket < 5 GROUP BY ALL)
SELECT w AS "window", bucket + 1 AS seed, bucket, n_rows, window_rows, target_min, target_max, round(n_rows / window_rows::DOUBLE, 6) AS realised_fraction, round(1.0::DOUBLE / 17, 6) AS target_fraction, round(100.0::DOUBLE * (n_rows / window_rows::DOUBLE / (1.0::DOUBLE / 17) - 1), 4) AS deviation_pct FROM s JOIN t USING (w)""")
def m29b(spark, sf):
    orders = table(spark, sf, "orders")
    window = F.when(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"), "train").otherwise("test")
    return I.sampling_report(orders, window, M.bucket_of(F.md5(F.col("o_orderkey").cast("string"))), "o_totalprice", {s: s - 1 for s in range(1, 6)}, 1.0 / 17)


@query("m29c_fold_boundaries", f"""WITH {TARGET_SQL}, r AS (SELECT month_key, count(*) AS n FROM tg WHERE month_key < {TEST} GROUP BY month_key), m AS (SELECT *, row_number() OVER (ORDER BY month_key) - 1 AS i, count(*) OVER () AS c FROM r), f AS (SELECT CAST(unnest(range(0, 100)) AS INTEGER) AS fold),
x AS (SELECT fold, month_key, n, i < 15 + 2 * fold AS tr FROM f, m WHERE 15 + 2 * fold + 2 <= c AND i < 17 + 2 * fold)
SELECT fold, min(month_key) FILTER (tr) AS train_start, max(month_key) FILTER (tr) AS train_end, count(*) FILTER (tr) AS n_train_months, CAST(sum(n) FILTER (tr) AS BIGINT) AS n_train_rows, min(month_key) FILTER (NOT tr) AS validation_start, max(month_key) FILTER (NOT tr) AS validation_end, count(*) FILTER (NOT tr) AS n_validation_months, CAST(sum(n) FILTER (NOT tr) AS BIGINT) AS n_validation_rows FROM x GROUP BY fold""")
def m29c(spark, sf):
    rows = targets(spark, sf).where(F.col("month_key") < TEST)
    months = [r["month_key"] for r in rows.select("month_key").distinct().collect()]
    return I.fold_boundaries(M.folds(spark, months, 15, 2), rows, "month_key")


@query("m30_composition", f"""WITH {ERR_SQL}, v AS (SELECT {mean("CASE WHEN rung = 'V2' THEN abs_error END", 6)} AS a, {mean("CASE WHEN rung = 'V1' AND target < 3000 THEN abs_error END", 6)} AS o, {mean("CASE WHEN rung = 'V2' AND target < 3000 THEN abs_error END", 6)} AS s FROM er)
SELECT round(a - o, 4) AS improvement_all_rows, round(s - o, 4) AS improvement_same_rows, round(100.0::DOUBLE * ((a - o) - (s - o)) / (a - o), 3) AS composition_share_pct FROM v""")
def m30(spark, sf):
    rows = errors(spark, sf)
    gated = rows.where("rung = 'V1' AND target < 3000")
    return I.composition(rows.where("rung = 'V2'"), gated, gated, KEY)


@query("m31_matched", f"WITH {SUM_SQL} SELECT variant, rung, CASE WHEN rung <> 'V3' THEN mae_mean END AS ours, CASE WHEN rung <> 'V0' THEN CASE WHEN rung = 'V2' THEN mae_mean + 1 ELSE mae_mean END END AS published, CASE rung WHEN 'V3' THEN 'published only' WHEN 'V0' THEN 'ours only' ELSE 'both' END AS presence, rung = 'V1' AS is_match FROM sm")
def m31(spark, sf):
    s = L.repeats(results(spark, sf)).select("variant", "rung", "mae_mean")
    other = s.where("rung <> 'V0'").withColumn("mae_mean", F.when(F.col("rung") == "V2", F.col("mae_mean") + 1).otherwise(F.col("mae_mean")))
    return L.matched(s.where("rung <> 'V3'"), other, ["variant", "rung"], "mae_mean")


def refs(spark):
    return spark.createDataFrame([("low", 100.0), ("high", 5000.0)], "reference string, reference_mae double")


REFS = "rf AS (SELECT * FROM (VALUES ('low', 100.0::DOUBLE), ('high', 5000.0::DOUBLE)) v(reference, reference_mae))"


@query("m32_reference_gap", f"""WITH {SUM_SQL}, {REFS}, b AS (SELECT variant, arg_min(rung, (mae_mean, rung)) AS best_rung, min(mae_mean) AS best_mae FROM sm WHERE rung <> 'V3' GROUP BY variant)
SELECT variant, best_rung, best_mae, reference, reference_mae, round(100.0::DOUBLE * (best_mae - reference_mae) / reference_mae, 6) AS gap_pct, CASE WHEN best_mae < reference_mae THEN 'beats reference' ELSE 'does not beat reference' END AS verdict FROM b, rf""")
def m32(spark, sf):
    return L.reference_gap(L.repeats(results(spark, sf)), refs(spark), ["V3"])


@query("m33_seeds_beating", f"WITH {ERR_SQL}, rf AS (SELECT * FROM (VALUES ('low', 900.0::DOUBLE), ('high', 5000.0::DOUBLE)) v(reference, reference_mae)) SELECT variant, rung, reference, count(*) AS n_seeds, count(*) FILTER (mae < reference_mae) AS n_beating FROM rs, rf GROUP BY ALL")
def m33(spark, sf):
    return L.seeds_beating(results(spark, sf), spark.createDataFrame([("low", 900.0), ("high", 5000.0)], "reference string, reference_mae double"))


@query("m34_against_base", f"""WITH {SUM_SQL} SELECT variant, rung, mae_mean, round(100.0::DOUBLE * (first_value(mae_mean) OVER w - mae_mean) / first_value(mae_mean) OVER w, 6) AS pct_vs_base, CASE WHEN mae_mean <> lag(mae_mean) OVER w THEN mae_mean < lag(mae_mean) OVER w END AS step_improves FROM sm WINDOW w AS (PARTITION BY variant ORDER BY rung)""")
def m34(spark, sf):
    return L.against_base(L.repeats(results(spark, sf)), "V0")


@query("m34b_consistency", f"""WITH {SUM_SQL}, s AS (SELECT variant, mae_mean < lag(mae_mean) OVER (PARTITION BY variant ORDER BY rung) AS f FROM sm) SELECT variant, count(*) FILTER (f) AS consistent, count(*) FILTER (NOT f) AS inconsistent FROM s GROUP BY variant""")
def m34b(spark, sf):
    return L.count_consistent(L.against_base(L.repeats(results(spark, sf)), "V0"), F.col("step_improves"), "variant")
