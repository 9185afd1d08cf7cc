"""Hand-made rows for the boundaries of definitions: zero, negative, missing, the crossing row."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from starbraid.functions import exprs as E
from starbraid.operators import cells as X
from starbraid.operators import clean as C
from starbraid.operators import ladder as L
from starbraid.operators import panel as P
from starbraid.operators import trip_analyses as A
from starbraid.sources import io as S

T = dt.datetime(2024, 3, 1, 8)


def test_trip_gate_boundaries(spark):
    base = {"pickup_ts": T, "dropoff_ts": T + dt.timedelta(hours=1), "distance": 1.0, "fare": 5.0, "total": 6.0, "passengers": 1, "pickup_zone": 1, "dropoff_zone": 2}
    cases = [
        ({}, None), ({"dropoff_ts": T}, "no_duration"), ({"dropoff_ts": T - dt.timedelta(seconds=1)}, "no_duration"), ({"dropoff_ts": None}, "missing_timestamp"), ({"dropoff_ts": T + dt.timedelta(seconds=7200)}, None),
        ({"dropoff_ts": T + dt.timedelta(seconds=7201)}, "too_long"), ({"distance": 0.0}, None), ({"distance": -0.1}, "no_distance"), ({"distance": None}, "no_distance"), ({"distance": 30.0}, None), ({"distance": 30.1}, "too_far"),
        ({"fare": 0.0}, None), ({"fare": -1.0}, "negative_amount"), ({"total": -1.0}, "negative_amount"), ({"fare": None}, None), ({"passengers": -1}, "implausible_passengers"), ({"passengers": 0}, None), ({"passengers": None}, None), ({"passengers": 7}, "implausible_passengers"),
        ({"pickup_zone": None}, "unknown_zone"), ({"distance": -1.0, "fare": -1.0}, "no_distance"),
    ]
    rows = [(i, *(base | c).values()) for i, (c, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, pickup_ts timestamp_ntz, dropoff_ts timestamp_ntz, distance double, fare double, total double, passengers int, pickup_zone int, dropoff_zone int")
    got = {r.i: r.reject_reason for r in C.judged(df, C.trip_rules(7200, 30.0, 6)).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_flags_of_missing_amounts_are_false(spark):
    df = spark.createDataFrame([(T, T, 1.0, 1, 2, None, None), (T, T, 1.0, 1, 2, 1.0, 0.5)], "pickup_ts timestamp_ntz, dropoff_ts timestamp_ntz, distance double, pickup_zone int, dropoff_zone int, tip double, tolls double")
    assert sorted((r.has_tip, r.has_toll) for r in C.derived(df, "2024-01-01", "2025-01-01", [9]).collect()) == [(False, False), (True, True)]


@pytest.fixture(scope="module")
def zone(spark):
    return spark.createDataFrame([(1, "Z1", "B"), (2, "Z2", "B"), (3, "Z3", "B")], "zone_key int, zone string, borough string")


def test_trips_without_a_speed_count_as_excluded(spark, zone):
    rows = [(1, T, 10.0, 2), (1, T, 10.0, 0), (1, T, 0.0, 2), (1, T, 100.0, 2), (1, T, None, 2), (1, T, 8.0, 2)]
    got = A.congestion(spark.createDataFrame(rows, "pickup_zone int, pickup_ts timestamp_ntz, distance double, days int"), zone, 20.0).where("grouping_level = 'borough'").first()
    assert (got.trip_count, got.excluded_implausible_speed, got.mean_speed, got.median_speed, got.weighted_speed) == (6, 4, 4.5, 4.5, 4.5)


def test_tips_on_zero_and_negative_fares(spark, zone):
    rows = [("c", 1, 1.0, 10.0, 1.0, "R"), ("c", 1, 1.0, 0.0, 1.0, "N"), ("c", 1, 1.0, -10.0, 2.0, "N")]
    got = A.tipping(spark.createDataFrame(rows, "payment string, pickup_zone int, distance double, fare double, tip double, rate string"), zone, [5], ["near", "far"], ["c"], ["N"]).first()
    assert (got.zero_fare_trips, got.mean_tip_pct, got.median_tip_pct, got.prearranged_trips) == (1, -5.0, -5.0, 2)


def test_the_zone_that_crosses_the_share_is_outside(spark, zone):
    rows = [(1, 80.0, 1.0), (2, 15.0, 1.0), (3, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "pickup_zone int, total double, distance double")
    got = lambda d: {r.zone: r.within_top_share for r in A.concentration(d, zone).collect()}
    assert got(df) == {"Z1": True, "Z2": False, "Z3": False}
    assert got(df.withColumn("total", F.when(F.col("pickup_zone") == 1, 81.0).otherwise(F.col("total"))))["Z1"] is False


def test_markets_count_once_and_prices_of_zero_do_not(spark):
    rows = [("Z", "rice", 20240101, "m1", 10.0), ("Z", "rice", 20240101, "m1", 14.0), ("Z", "rice", 20240101, "m2", 0.0), (None, "rice", 20240101, "m3", 5.0)]
    got = P.dispersion(spark.createDataFrame(rows, "zone string, commodity string, month_key int, market string, price double"), "zone", "commodity", "market").collect()
    assert [(r.zone, r.reporting_markets, r.mean_price, r.meets_market_threshold) for r in got] == [("Z", 1, 12.0, False)]


def test_a_run_that_never_occurs_is_zero(spark):
    rows = [(s, "z", m, p) for m in (20240101, 20240201) for s, p in (("a", 12.0), ("b", 8.0))]
    got = {r.state: r for r in P.states(spark.createDataFrame(rows, "state string, zone string, month_key int, price double")).collect()}
    assert (got["a"].longest_run_above, got["a"].longest_run_below, got["a"].mean_premium_pct, got["a"].premium_rank, got["a"].persistence) == (2, 0, 20.0, 1, "persistent premium")
    assert (got["b"].longest_run_above, got["b"].longest_run_below, got["b"].persistence) == (0, 2, "persistent discount")


def test_equal_rungs_tie(spark):
    rows = [("v", r, s, 1.0 + (r == "c") * s) for r in "abc" for s in (1, 2)]
    got = {r.rung_b: r for r in L.paired(spark.createDataFrame(rows, "variant string, rung string, seed int, mae double"), [("a", "b"), ("a", "c")]).collect()}
    assert (got["b"].better_rung, got["b"].n_same_direction, got["b"].direction_consistent) == ("tie", 0, False)
    assert (got["c"].better_rung, got["c"].per_seed_diffs) == ("a", "1.0000;2.0000")


def test_exact_quantiles_match_sorting(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    values = {"a": rng.integers(0, 40, 500) / 7, "b": np.array([3.0]), "c": np.concatenate([np.zeros(900), rng.normal(size=99) * 1e6])}
    df = spark.createDataFrame([(g, float(v)) for g, x in values.items() for v in x] + [(None, 1.0), (None, 2.0), ("a", None)], "g string, v double")
    got = {r.g: r.q for r in E.exact_quantiles(df.groupBy("g", "v").agg(F.count("*").alias("n")), ["g"], "v", "n", [0.25, 0.5, 0.975]).collect()}
    for g, x in [*values.items(), (None, np.array([1.0, 2.0]))]:
        assert got[g] == pytest.approx(np.quantile(x, [0.25, 0.5, 0.975]), rel=1e-9)


def test_month_cells(spark):
    cases = {"Price November 2023": "2023-11", "Nov. 2023": "2023-11", "Nov'23": "2023-11", "Nov-23": "2023-11", "2023-11-01 00:00:00": "2023-11", "2023/7": "2023-07", "11/2023": "2023-11", "45231": "2023-11", "Sept 2022": "2022-09", "sum of May, 2024": "2024-05", "1850-01": None, "13/2023": None, "Novel 2023": None, "": None, "12345": None}
    df = spark.createDataFrame([(c,) for c in cases], "v string").select("v", X.parsed_month(F.col("v")).alias("m"))
    assert {r.v: r.m for r in df.collect()} == cases


def test_labels_lose_accents_and_find_their_name(spark):
    cases = {"Ẹdo State": "edo", "Ọyọ": "oyo", "  KANO  ": "kano", "Niger State": "niger", "Bórno.": "borno", "ÀÉÎõü": "aeiou", "Cross\u00a0 River": "cross river", "e\u0323do": "edo", "State": "state"}
    df = spark.createDataFrame([(c,) for c in cases], "v string").select("v", X.normalised(F.col("v")).alias("n"))
    assert {r.v: r.n for r in df.collect()} == cases
    variants = spark.createDataFrame([("akwa ibom", "Akwa Ibom", "SS"), ("nassarawa", "Nasarawa", "NC"), ("oyo", "Oyo", "SW")], "variant string, canonical string, zone string")
    rows = spark.createDataFrame([("Akwa-Ibom",), ("NASSARAWA state",), ("Ọyọ",), ("Grand Total",), ("Price - Oyo",), (None,)], "label string")
    got = {r.label: (r.state, r.is_aggregate_label) for r in X.canonical_map(rows, "label", variants, ["grand total"]).collect()}
    assert got["Akwa-Ibom"][0] == "Akwa Ibom" and got["NASSARAWA state"][0] == "Nasarawa" and got["Ọyọ"][0] == "Oyo"
    assert got["Grand Total"] == (None, True) and got["Price - Oyo"][0] is None and got[None][0] is None


def test_a_sheet_without_a_header_row_falls_back_or_is_reported(spark):
    cells = [("f", "s1", 2, 2, "Nov 2023"), ("f", "s1", 3, 1, "Oyo"), ("f", "s1", 3, 2, "650"), ("f", "notes", 1, 1, "read me")]
    df = spark.createDataFrame(cells, "file string, sheet string, row int, col int, value string")
    variants = spark.createDataFrame([("oyo", "Oyo", "SW")], "variant string, canonical string, zone string")
    assert [(r.month, r.state, r.price) for r in X.panel(df, variants, []).collect()] == [("2023-11", "Oyo", 650.0)]
    assert [(r.sheet, r.n_cells) for r in X.unread_sheets(df, variants).collect()] == [("notes", 1)]


def test_an_absent_optional_source_is_none(spark, tmp_path):
    assert S.columnar_json(spark, str(tmp_path / "nowhere.json"), "daily", "time") is None
    (tmp_path / "other.json").write_text('{"x": 1}')
    assert S.columnar_json(spark, str(tmp_path / "other.json"), "daily", "time") is None


def test_digests_of_any_file_are_those_of_its_bytes(spark, tmp_path):
    """A file above 1 GiB (sparse), a compressed one and one with a name that needs care; a file without content is not listed."""
    import gzip
    import hashlib

    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate((1 << 30) + 12345)
        f.seek(1 << 30)
        f.write(b"tail")
    (tmp_path / "z.csv.gz").write_bytes(gzip.compress(b"a,b\n1,2\n"))
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "odd name%20+é.txt").write_bytes(b"\xef\xbb\xbfx")
    want = {}
    for p in tmp_path.iterdir():
        with open(p, "rb") as f:
            want[p.name] = (p.stat().st_size, hashlib.file_digest(f, "sha256").hexdigest())
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in S.digests(S.listed(spark, [str(tmp_path)])).collect()}
    assert got == {k: v for k, v in want.items() if v[0]}


def test_provenance_equals_hashlib_and_the_tables(spark):
    import hashlib

    paths = [f"/root/testdata/sf0.001/{t}.parquet" for t in ("orders", "nation", "documents")]
    got = {r.filename: (r.sha256, r.row_count) for r in S.provenance(spark, paths).collect()}
    assert got == {p.rsplit("/", 1)[1]: (hashlib.sha256(open(p, "rb").read()).hexdigest(), spark.read.parquet(p).count()) for p in paths}


def test_a_month_built_anew_leaves_the_others(spark, tmp_path):
    import os

    path = str(tmp_path / "fact")
    rows = spark.createDataFrame([(i, y, m) for i, (y, m) in enumerate([(2024, 1), (2024, 1), (2024, 2), (2002, 12)])], "id int, year int, month int")
    S.write_partitioned(rows, path)
    seen = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = seen()
    S.rebuild_month(rows.limit(3), path, 2024, 1)
    after = seen()
    kept = {f for f in before if "month=1/" not in f}
    assert all(after[f] == before[f] for f in kept) and all(f in kept or "month=1/" in f for f in after)
    report = {(r.year, r.month): r for r in S.partition_report(spark, path).collect()}
    assert {k: r.row_count for k, r in report.items()} == {(2024, 1): 2, (2024, 2): 1, (2002, 12): 1}
    assert all(r.bytes == sum(os.path.getsize(f) for f in after if f"year={y}/month={m}/" in f) for (y, m), r in report.items())


def test_files_of_other_spelling_and_width_unite(spark, tmp_path):
    spark.createDataFrame([(1, 2.5)], "id int, Airport_fee double").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(2, 3, "x")], "id long, airport_fee int, zone string").write.parquet(str(tmp_path / "b"))
    spark.createDataFrame([(3,)], "ID long").write.parquet(str(tmp_path / "c"))
    got = S.parquet_union(spark, [str(tmp_path)])
    assert sorted(got.columns) == ["Airport_fee", "ID", "source_file", "zone"]
    assert sorted((r.ID, r.Airport_fee, r.zone) for r in got.collect()) == [(1, 2.5, None), (2, 3.0, "x"), (3, None, None)]
    drift = {r.file.split("/")[-2]: (r.missing, r.unexpected) for r in S.schema_drift(spark, [str(tmp_path)], ["id", "AIRPORT_FEE"]).collect()}
    assert drift == {"a": ([], []), "b": ([], ["zone"]), "c": (["airport_fee"], [])}


def test_the_month_of_a_file_is_that_of_its_name(spark):
    rows = [("x/trips_2024-01.parquet", T, T), ("x/trips_2024-03.parquet", T, T), ("x/trips_2024-03.parquet", None, T), ("x/trips.parquet", T, None)]
    df = spark.createDataFrame(rows, "source_file string, a timestamp_ntz, b timestamp_ntz")
    got = {r.source_file: (r.file_month, r.raw_rows, r.pickup_month_mismatch, r.null_pickup, r.null_dropoff) for r in S.file_profile(df, "a", "b", "2024-01-01", "2025-01-01").collect()}
    assert got == {"trips_2024-01.parquet": ("2024-01", 1, 1, 0, 0), "trips_2024-03.parquet": ("2024-03", 2, 0, 1, 0), "trips.parquet": ("", 1, 1, 0, 1)}


def test_student_tails_are_the_tabulated_ones(spark):
    import math

    cases = [(2.0, 10, 0.0733880), (12.706205, 1, 0.05), (1.0, 1, 0.5), (0.0, 7, 1.0), (-4.303, 2, 0.0499931), (1.959964, 100_000_000, 0.05), (30.0, 200, 0.0), (2.0, 4, 0.1161165)]
    df = spark.createDataFrame([(i, t, n) for i, (t, n, _) in enumerate(cases)] + [(90, None, 5), (91, 1.0, 0), (92, 1.0, None)], "i int, t double, n long")
    got = {r.i: r.p for r in df.select("i", E.t_tail(F.col("t"), F.col("n")).alias("p")).collect()}
    assert all(math.isclose(got[i], p, abs_tol=2e-6) for i, (_, _, p) in enumerate(cases)) and got[90] is got[91] is got[92] is None
    # Two degrees of freedom have a closed form.
    exact = {t: 1 - t / math.sqrt(2 + t * t) for t in (0.1, 0.5, 1.5, 3.0, 8.0)}
    rows = spark.createDataFrame([(t,) for t in exact], "t double").select("t", E.t_tail(F.col("t"), F.lit(2)).alias("p")).collect()
    assert all(math.isclose(r.p, exact[r.t], abs_tol=1e-12) for r in rows)


@pytest.fixture(scope="module")
def petrol(spark):
    prices = {("Kano", "NW"): (600.0, 640.0, 640.0), ("Oyo", "SW"): (500.0, 500.0, 650.0), ("Osun", "SW"): (550.0, 540.0, 610.0), ("Edo", "SS"): (590.0, 600.0, 600.0)}
    return spark.createDataFrame([(s, z, m, p) for (s, z), x in prices.items() for m, p in zip((20240101, 20240201, 20240301), x)], "state string, zone string, month_key int, price double")


def test_premiums_are_percent_of_the_mean_and_balance(petrol):
    rows = P.geography(petrol).collect()
    for m in (20240101, 20240201, 20240301):
        own = [r for r in rows if r.month_key == m]
        assert abs(sum(r.premium_vs_national_pct for r in own)) < 1e-3 and {r.states_reporting for r in own} == {4}
    first = {r.state: r for r in rows if r.month_key == 20240101}
    assert first["Kano"].premium_vs_national_pct == 7.1429 and first["Oyo"].premium_vs_zone_pct == -4.7619 and first["Kano"].premium_vs_zone_pct == 0.0
    zones = {(r.zone, r.month_key): r for r in P.zone_months(petrol).collect()}
    assert zones["SW", 20240101].zone_premium_vs_national_pct == -6.25 and zones["NW", 20240101].zone_rank_most_expensive_first == 1
    mean = sum(100 * (p / n - 1) for p, n in ((525, 560), (520, 570), (630, 625))) / 3
    assert zones["SW", 20240201].zone_mean_premium_over_period_pct == pytest.approx(mean, abs=1e-4) and zones["SW", 20240301].zone_max_state_price == 650.0
    last = P.national(petrol).where("month_key = 20240301").first()
    assert (last.range, last.max_min_ratio, last.dearest_state, last.min_state_price) == (50.0, 1.0833, "Oyo", 600.0)


def test_the_break_panel_is_chosen_by_market_and_listed(spark):
    months = [(2023, m) for m in range(3, 11)]
    row = lambda mk, st, co, y, m, p: (mk, st, co, y * 10000 + m * 100 + 1, p)
    rows = [row("A", "S1", c, y, m, 100.0 + 10 * (m > 6)) for c in ("rice", "yam", "beans") for y, m in months]
    rows += [row("B", "S2", "rice", y, m, 50.0) for y, m in months[:-1]]  # not in every month
    rows += [row("C", "S3", "rice", y, m, 0.0) for y, m in months] + [row(None, "S4", "rice", y, m, 9.0) for y, m in months]
    got = P.structural_break(spark.createDataFrame(rows, "market string, parent string, commodity string, month_key int, price double"), "market", "parent", ["commodity"], 2023 * 12 + 6).orderBy("months_since_break").collect()
    assert [r.months_since_break for r in got] == list(range(-3, 5)) and [r.staple_index for r in got] == [100.0] * 4 + [110.0] * 4
    assert {(r.panel_markets, r.panel_states, r.panel_state_list, r.panel_market_list) for r in got} == {(1, 1, "S1", "S1: A")}
    assert {(r.within_cell_level_change_pct, r.cells_on_both_sides, r.break_month) for r in got} == {(10.0, 3, "2023-06")}


def test_pass_through_carries_its_coverage(spark):
    prices = lambda f: [("s1", "Z1", "rice", 20240000 + m * 100 + 1, f(m)) for m in range(1, 9)]
    food = spark.createDataFrame(prices(lambda m: 10.0 * 1.1 ** (m % 3)), "state string, zone string, commodity string, month_key int, price double")
    fuel = spark.createDataFrame(prices(lambda m: 20.0 * 1.1 ** (m % 3)), "state string, zone string, commodity string, month_key int, price double").unionByName(food.limit(1).withColumn("state", F.lit("s2")))
    units = spark.range(4).select(F.col("id").alias("unit"))
    got = {(r.zone, r.lag_months): r for r in P.pass_through(food, fuel, units, "state", "zone", "commodity").collect()}
    assert got["ALL ZONES", 0].corr_log_changes == 1.0 and got["Z1", 0].corr_levels_spurious_prone == 1.0 and got["Z1", 3].corr_levels_spurious_prone is None
    assert {(r.states_in_overlap, r.states_with_fuel_data, r.states_with_food_data, r.federating_units_total, r.pct_of_federating_units) for r in got.values()} == {(1, 2, 1, 4, 25.0)}


def test_months_not_assembled_have_no_units(spark):
    series = spark.createDataFrame([(20240101, 600.0, 37)], "month_key int, assembled double, reporting_states long")
    targets = spark.createDataFrame([(20240101, 601.0), (20240201, 1.0)], "month_key int, published double")
    got = {r.month_key: (r.delta, r.within_tolerance, r.reporting_states) for r in C.external_check(series, targets, 1.0).collect()}
    assert got == {20240101: (-1.0, True, 37), 20240201: (None, False, 0)}


def test_ties_and_flat_differences_have_no_statistic(spark):
    from starbraid.operators import inference as I

    df = spark.createDataFrame([("flat", "s1", i, 1.0) for i in range(4)] + [("v", f"s{i % 2}", i, float(i - 1)) for i in range(6)], "rung string, state string, month_key int, d double")
    got = {r.rung: r for r in I.diebold_mariano(df, ["rung"]).collect()}
    assert (got["flat"].dm, got["flat"].p_value, got["flat"].is_significant, got["flat"].beats_reference) == (None, None, False, False)
    wide = {r.rung: r for r in I.cluster_diebold_mariano(df, ["rung"], ["state", "month_key"]).collect()}
    assert (wide["flat"].n_state_clusters, wide["flat"].dm_state_cluster_stat) == (1, None) and wide["v"].n_month_key_clusters == 6
    # A row a cluster: the clustered variance is the plain one times (n - 1) / n twice over.
    assert wide["v"].dm_month_key_cluster_stat == pytest.approx(wide["v"].dm_lag0_stat, abs=2e-3)


def test_the_profile_leaves_unknown_keys_out_and_names_zones_without_a_borough(spark):
    from starbraid.operators.dims import calendar

    rows = [(1, 20240101, 8, 10.0, 60.0), (1, 20240108, 8, 20.0, None), (2, 20240101, 9, 5.0, 30.0), (2, 20240102, 9, None, 90.0), (9, 20240101, 8, 99.0, 1.0), (1, 20300101, 8, 99.0, 1.0), (1, -1, 8, 99.0, 1.0)]
    df = spark.createDataFrame(rows, "pickup_zone int, date_key int, pickup_hour int, total double, seconds double")
    zone = spark.createDataFrame([(1, "Z1", "B"), (2, "Z2", None)], "zone_key int, zone string, borough string")
    dates = calendar(spark, "2024-01-01", "2024-12-31").where("date_key > 0")
    got = {(r.borough, r.day_of_week, r.pickup_hour): r for r in A.demand_profile(df, zone, dates, {"avg_total": ("total", 1.0, 4), "avg_minutes": ("seconds", 60.0, 3)}).collect()}
    assert set(got) == {("B", 1, 8), ("Unattributed", 1, 9), ("Unattributed", 2, 9)}
    one = got["B", 1, 8]
    assert (one.trip_count, one.avg_total, one.avg_minutes, one.day_name, one.pct_of_borough_trips, one.pct_of_all_trips, one.hour_rank_in_day) == (2, 15.0, 1.0, "Monday", 100.0, 50.0, 1)
    assert got["Unattributed", 2, 9].avg_total is None and got["Unattributed", 2, 9].pct_of_borough_trips == 50.0


def test_corridors_keep_ties_and_have_exact_medians(spark, zone):
    rows = [(1, 2, 10.0, 1), (1, 2, 20.0, 2), (1, 2, 60.0, 9), (2, 1, 7.0, 4), (2, 1, 9.0, 4), (3, 3, 1.0, 1), (3, 3, 2.0, None), (3, 1, 5.0, 5), (1, 1, 1.0, 1), (0, 1, 1.0, 1), (0, 1, 1.0, 1), (0, 1, 1.0, 1)]
    df = spark.createDataFrame(rows, "pickup_zone int, dropoff_zone int, fare double, days int").withColumns({"total": F.col("fare"), "distance": F.lit(2.0), "tip": F.lit(1.0)})
    got = {(r.pickup_name, r.dropoff_name): r for r in A.corridors(df, zone, [0], 2).collect()}
    assert {k: r.corridor_rank for k, r in got.items()} == {("Z1", "Z2"): 1, ("Z2", "Z1"): 2, ("Z3", "Z3"): 2}
    assert [(got[k].median_fare, got[k].median_days) for k in (("Z1", "Z2"), ("Z2", "Z1"), ("Z3", "Z3"))] == [(20.0, 2.0), (8.0, 4.0), (1.5, 1.0)]
    assert got["Z1", "Z2"].pct_of_eligible_trips == pytest.approx(100 * 3 / 9, abs=1e-6) and got["Z3", "Z3"].is_intra_zone


def test_grain_leaves_absent_facts_out_and_counts_keys(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "b", 3.0)], "d int, g string, x double")
    got = {r.fact_table: r for r in A.grain({"fact": {"rows": rows, "date": "d", "geo": "g", "grain": "a row", "keys": ["d", "g"], "measures": ["x"]}, "small": {"rows": rows.limit(1), "date": "d"}, "none": {"rows": None}}).collect()}
    assert set(got) == {"fact", "small"} and got["fact"].rows_vs_coarsest_fact == 3.0 and got["small"].distinct_geo_members is None
    assert (got["fact"].foreign_key_count, got["fact"].measure_count, got["fact"].distinct_date_members, got["fact"].grain_statement) == (2, 1, 2, "a row")
