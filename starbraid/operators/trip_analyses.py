"""Analyses over a trip fact: demand, corridors, congestion, tipping, concentration, grain and missingness.

All aggregate on keys first and join labels last, so the big shuffle carries integers only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..sources.io import written


def demand_profile(rows: DataFrame, zones: DataFrame, dates: DataFrame, measures: dict[str, tuple[str, float, int]]) -> DataFrame:
    """A1: borough x ISO weekday x hour: count, means, shares of the borough and of all, rank of the hour in its day.

    rows: (pickup_zone, date_key, pickup_hour, measures). measures: name -> (column, divisor of the mean, digits). Rows are
    added up on their integer keys first; zones and dates meet those sums, names come last. Rows whose zone or date is in
    no dimension are left out; a zone without a borough is Unattributed."""
    by_key = rows.groupBy("pickup_zone", "date_key", "pickup_hour").agg(
        F.count(F.lit(1)).alias("n"), *[x for name, (c, _, _) in measures.items() for x in (F.sum(E.exact(c)).alias(f"{name}_sum"), F.count(c).alias(f"{name}_n"))],
    )
    of_zone = zones.select(F.col("zone_key").alias("pickup_zone"), F.coalesce("borough", F.lit("Unattributed")).alias("borough"))
    both = by_key.join(of_zone, "pickup_zone").join(dates.select("date_key", "day_of_week"), "date_key")
    mean = lambda name, by, digits: E.rounded(F.try_divide(F.sum(f"{name}_sum").cast("double"), F.sum(f"{name}_n").cast("double")) / F.lit(by), digits)
    base = both.groupBy("borough", "day_of_week", "pickup_hour").agg(F.sum("n").alias("trip_count"), *[mean(name, by, digits).alias(name) for name, (_, by, digits) in measures.items()])
    in_borough, in_day = Window.partitionBy("borough"), Window.partitionBy("borough", "day_of_week")
    # Windows over the aggregate: at most boroughs x 168 rows.
    out = base.withColumns({
        "pct_of_borough_trips": E.percent(F.col("trip_count"), F.sum("trip_count").over(in_borough)), "pct_of_all_trips": E.percent(F.col("trip_count"), F.sum("trip_count").over(Window.partitionBy())),
        "hour_rank_in_day": F.rank().over(in_day.orderBy(F.desc("trip_count"))),
    })
    return out.join(F.broadcast(dates.where("date_key > 0").select("day_of_week", "day_name").distinct()), "day_of_week")  # 7 names


def corridors(trips: DataFrame, zones: DataFrame, excluded: list[int], k: int = 25) -> DataFrame:
    """A2: the k most used directed zone pairs (rank <= k, ties kept), labels joined after the ranking.

    Pairs are ranked on counts first; only trips of the pairs that are kept are read again, as counts of distinct values,
    for the exact medians."""
    pair = ["pickup_zone", "dropoff_zone"]
    eligible = trips.where(~F.col("pickup_zone").isin(excluded) & ~F.col("dropoff_zone").isin(excluded))
    base = eligible.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("trip_count"), E.rounded(E.mean("fare")).alias("mean_fare"), E.rounded(E.mean("total", 6)).alias("mean_total_amount"), E.rounded(E.mean("distance")).alias("mean_distance"),
        E.rounded(E.mean("days")).alias("mean_days"), E.rounded(F.lit(100.0) * E.mean(E.ratio(F.col("tip"), F.col("fare")), 12)).alias("mean_tip_pct_of_fare"),
    )
    # Mean distance over mean duration of all eligible trips, as published means.
    base = base.withColumn("implied_speed", E.rounded(F.try_divide("mean_distance", "mean_days")))
    shares = base.withColumn("pct_of_eligible_trips", E.percent(F.col("trip_count"), F.sum("trip_count").over(Window.partitionBy())))
    # A row a pair of zones.
    top = written(shares.withColumn("corridor_rank", F.rank().over(Window.orderBy(F.desc("trip_count")))).where(F.col("corridor_rank") <= k))
    measures = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in ("fare", "days")])
    kept = eligible.join(top.select(*pair), pair, "left_semi").select(*pair, F.inline(measures))
    counts = written(kept.groupBy(*pair, "measure", "value").agg(F.count(F.lit(1)).alias("n")))
    q = E.exact_quantiles(counts, [*pair, "measure"], "value", "n", [0.5]).groupBy(*pair).agg(*[E.rounded(F.max(F.when(F.col("measure") == c, F.element_at("q", 1)))).alias(f"median_{c}") for c in ("fare", "days")])
    a, b = zones.alias("a"), zones.alias("b")
    return (
        top.join(q, pair, "left").join(a, F.col("pickup_zone") == F.col("a.zone_key"))
        .join(b, F.col("dropoff_zone") == F.col("b.zone_key"))
        .select(
            "corridor_rank", F.col("a.zone").alias("pickup_name"), F.col("a.borough").alias("pickup_borough"), F.col("b.zone").alias("dropoff_name"), F.col("b.borough").alias("dropoff_borough"),
            (F.col("pickup_zone") == F.col("dropoff_zone")).alias("is_intra_zone"), *base.columns[2:], "median_fare", "median_days", "pct_of_eligible_trips",
        )
    )


def congestion(trips: DataFrame, zones: DataFrame, ceiling: float) -> DataFrame:
    """A3: speed by (borough, weekday), (borough, month) and (borough), all from one table of counts by speed.

    All trips count; those without a speed, or with one of 0 or less or above the ceiling, count as excluded and leave the
    speeds. Trips are counted by zone, day, month and speed before zones get their borough, once; means, sums and exact
    quartiles of all three groupings come from those counts, and no task holds a borough's speeds."""
    speed = F.when(F.col("days") > 0, F.col("distance") / F.col("days"))
    fit = F.coalesce((speed > 0) & (speed <= ceiling), F.lit(False))
    rows = trips.select("pickup_zone", E.iso_dow("pickup_ts").alias("dow"), F.month("pickup_ts").alias("month"), *[F.when(fit, c).alias(n) for c, n in ((F.col("distance"), "distance"), (F.col("days"), "days"), (speed, "speed"))])
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(E.exact(c, d)).alias(f"{c}_sum") for c, d in (("speed", 8), ("distance", 4), ("days", 4))]]
    by_zone = rows.groupBy("pickup_zone", "dow", "month", "speed").agg(*sums)
    again = [F.sum(c).alias(c) for c in ("n", "speed_sum", "distance_sum", "days_sum")]
    values = written(by_zone.join(zones, F.col("pickup_zone") == F.col("zone_key")).groupBy("borough", "dow", "month", "speed").agg(*again))
    b, d, m, v = F.col("borough"), F.col("dow"), F.col("month"), F.col("speed")
    level = (F.grouping("dow") * 2 + F.grouping("month")).alias("level")
    fits = F.sum(F.when(v.isNotNull(), F.col("n")))
    part = lambda c, n: F.try_divide(F.sum(c).cast("double"), n.cast("double"))
    out = values.groupingSets([[b, d], [b, m], [b]], b, d, m).agg(
        level, F.sum("n").alias("trip_count"), F.coalesce(F.sum(F.when(v.isNull(), F.col("n"))), F.lit(0)).alias("excluded_implausible_speed"),
        E.rounded(part("speed_sum", fits)).alias("mean_speed"), E.rounded(part("distance_sum", fits)).alias("mean_distance"), E.rounded(part("distance_sum", F.sum("days_sum"))).alias("weighted_speed"),
    )
    key = ["borough", "dow", "month", "level"]
    counts = values.where("speed IS NOT NULL").groupingSets([[b, d, v], [b, m, v], [b, v]], b, d, m, v).agg(level, F.sum("n").alias("n"))
    q = E.exact_quantiles(counts, key, "speed", "n", [0.25, 0.5, 0.75]).toDF(*[f"{c}_" for c in key], "q")
    out = out.join(q, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in key]), "left")
    name = F.when(F.col("level") == 1, "borough_weekday").when(F.col("level") == 2, "borough_month").otherwise("borough")
    return out.select(
        name.alias("grouping_level"), "borough", "dow", F.when(m.isNotNull(), F.format_string("M%02d", m)).alias("month_label"), "trip_count", "excluded_implausible_speed", "mean_speed",
        E.rounded(F.element_at("q", 1)).alias("p25_speed"), E.rounded(F.element_at("q", 2)).alias("median_speed"), E.rounded(F.element_at("q", 3)).alias("p75_speed"), "weighted_speed", "mean_distance",
    )


def tipping(trips: DataFrame, zones: DataFrame, bounds: list[float], names: list[str], interpretable: list[str], prearranged: list[str]) -> DataFrame:
    """A4: payment x borough x distance band: conditional means, medians of ratios and the ratio of sums.

    The share of the fare is missing where the fare is 0 only; negative fares count. All columns, the exact median
    included, come from one table of counts by distinct share."""
    key, tipped = ["payment", "borough", "distance_band"], F.col("tip") > 0
    rows = trips.withColumns({"distance_band": E.banded("distance", bounds, names), "tip_pct": E.ratio(F.lit(100.0) * F.col("tip"), F.col("fare")), "tipped": F.coalesce(tipped, F.lit(False))})
    sums = [
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("fare") == 0).alias("zero_fare_trips"), F.count_if(F.col("rate").isin(prearranged)).alias("prearranged_trips"), F.count("fare").alias("fares"), F.count("tip").alias("tips"),
        F.sum(E.exact("fare")).alias("fare_sum"), F.sum(E.exact("tip", 6)).alias("tip_sum"), F.sum(E.exact("tip_pct", 8)).alias("pct_sum"),
    ]
    by_zone = rows.groupBy("payment", "pickup_zone", "distance_band", "tipped", "tip_pct").agg(*sums)
    measures = by_zone.columns[5:]
    values = written(by_zone.join(zones, F.col("pickup_zone") == F.col("zone_key")).groupBy(*key, "tipped", "tip_pct").agg(*[F.sum(c).alias(c) for c in measures]))
    shares = F.when(F.col("tip_pct").isNotNull(), F.col("n"))
    total = lambda c: F.sum(c).cast("double")
    out = values.groupBy(*key).agg(
        F.sum("n").alias("trip_count"), F.sum("zero_fare_trips").alias("zero_fare_trips"), F.coalesce(F.sum(F.when(F.col("tipped"), F.col("n"))), F.lit(0)).alias("trips_with_recorded_tip"),
        E.rounded(F.try_divide(total("fare_sum"), total("fares"))).alias("mean_fare"), E.rounded(F.try_divide(total("tip_sum"), total("tips"))).alias("mean_tip"), E.rounded(F.try_divide(total("pct_sum"), total(shares))).alias("mean_tip_pct"),
        F.sum("prearranged_trips").alias("prearranged_trips"), E.rounded(F.try_divide(total(F.when(F.col("tipped"), F.col("pct_sum"))), total(F.when(F.col("tipped"), shares)))).alias("mean_tip_pct_given_tipped"),
        E.rounded(F.try_divide(F.lit(100.0) * total("tip_sum"), total("fare_sum"))).alias("aggregate_tip_pct_of_fare"),
    )
    counts = values.groupBy(*key, "tip_pct").agg(F.sum("n").alias("n"))
    median = E.exact_quantiles(counts, key, "tip_pct", "n", [0.5]).select(*[F.col(c).alias(f"{c}_") for c in key], E.rounded(F.element_at("q", 1)).alias("median_tip_pct"))
    out = out.join(median, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in key]), "left").drop(*[f"{c}_" for c in key])
    order = reduce(lambda c, i: c.when(F.col("distance_band") == names[i], i + 1), range(len(names)), F.when(F.lit(False), 0))
    return out.withColumns({"is_interpretable": F.col("payment").isin(interpretable), "distance_band_order": order, "pct_trips_with_recorded_tip": E.percent(F.col("trips_with_recorded_tip"), F.col("trip_count"))})


def concentration(trips: DataFrame, zones: DataFrame, share: float = 80.0) -> DataFrame:
    """A5: zones by revenue with running shares; inside are the zones whose running share, rounded as published, is at
    most the share: the row that crosses it is outside."""
    base = trips.groupBy("pickup_zone").agg(F.count(F.lit(1)).alias("trip_count"), F.sum(E.exact("total", 6)).alias("revenue"), E.total("distance").alias("total_distance"))
    order = Window.orderBy(F.desc("revenue"), "pickup_zone")
    everything, upto = Window.partitionBy(), E.running(order)
    whole = F.sum("revenue").over(everything).cast("double")
    ranked = base.select(
        "pickup_zone", "trip_count", F.row_number().over(order).alias("revenue_rank"), E.rounded(F.col("revenue").cast("double"), 4).alias("total_revenue"),
        E.rounded(F.col("revenue").cast("double") / F.col("trip_count")).alias("mean_revenue_per_trip"), "total_distance",
        E.percent(F.col("revenue"), whole).alias("pct_of_revenue"), E.percent(F.sum("revenue").over(upto), whole).alias("cumulative_pct_revenue"),
        E.percent(F.sum("trip_count").over(upto), F.sum("trip_count").over(everything)).alias("cumulative_pct_trips"),
        E.percent(F.row_number().over(order), F.count(F.lit(1)).over(everything)).alias("cumulative_pct_zones"),
        (E.percent(F.sum("revenue").over(upto), whole) <= share).alias("within_top_share"),
    )
    return ranked.join(zones, F.col("pickup_zone") == F.col("zone_key")).drop("zone_key", "pickup_zone")


def grain(facts: dict[str, dict], sizes: DataFrame | None = None) -> DataFrame:
    """A10: per fact its grain and context, rows, distinct members of each kind of dimension, how many foreign keys and
    measures it has, and rows relative to the coarsest fact.

    facts: name -> rows (None where the fact is absent: it is left out), date, and, where there are any, geo, mode, other
    (columns), grain, context (texts), keys, measures (lists of columns). sizes: the inventory (relation, bytes)."""
    none = F.lit(None).cast("long")
    members = ("date", "geo", "mode", "other")
    parts = [
        f["rows"].agg(F.count(F.lit(1)).alias("row_count"), *[(F.count_distinct(F.col(f[m])) if f.get(m) else none).alias(f"distinct_{m}_members") for m in members]).select(
            F.lit(name).alias("fact_table"), F.lit(f.get("grain")).alias("grain_statement"), F.lit(f.get("context")).alias("context"), "*", F.lit(len(f.get("keys", []))).alias("foreign_key_count"), F.lit(len(f.get("measures", []))).alias("measure_count")
        )
        for name, f in facts.items()
        if f["rows"] is not None
    ]
    out = reduce(DataFrame.unionByName, parts)
    if sizes is not None:
        out = out.join(sizes.select(F.col("relation").alias("fact_table"), "bytes"), "fact_table", "left").withColumn("bytes_per_row", E.rounded(E.ratio(F.col("bytes"), F.col("row_count")), 2))
    return out.withColumn("rows_vs_coarsest_fact", E.rounded(E.ratio(F.col("row_count"), F.min("row_count").over(Window.partitionBy()))))


def missing_pattern(fields: list[str]) -> Column:
    """A string with a field's first letter where it is missing, '.' where it is present."""
    return F.concat(*[F.when(F.col(f).isNull(), F.lit(f[0].upper())).otherwise(F.lit(".")) for f in fields])


def missingness(rows: DataFrame, fields: list[str], by: list[str], least: int) -> DataFrame:
    """Pattern counts and by-group missing rates (groups of `least` rows or more), as two record types of one table."""
    n_missing = reduce(lambda a, b: a + b, [F.col(f).isNull().cast("int") for f in fields])
    everything = Window.partitionBy()
    label = [F.lit(None).cast("string").alias(c) for c in by]
    every = reduce(lambda a, b: a & b, [F.col(f).isNull() for f in fields])
    rates = [E.percent(F.count_if(x), F.count(F.lit(1))).alias(f"{n}_missing_pct") for n, x in [*((f, F.col(f).isNull()) for f in fields), ("all", every)]]
    rated = [f"{f}_missing_pct" for f in [*fields, "all"]]
    patterns = rows.groupBy(missing_pattern(fields).alias("missingness_pattern"), n_missing.alias("fields_missing")).agg(F.count(F.lit(1)).alias("trip_count"))
    one = patterns.select(F.lit("pattern").alias("record_type"), *label, "missingness_pattern", "fields_missing", "trip_count", *[F.lit(None).cast("double").alias(c) for c in rated])
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("trip_count"), *rates).where(F.col("trip_count") >= least)
    two = groups.select(F.lit("group").alias("record_type"), *[F.col(c).cast("string").alias(c) for c in by], F.lit(None).cast("string").alias("missingness_pattern"), F.lit(None).cast("int").alias("fields_missing"), "trip_count", *rated)
    share = lambda df: df.withColumn("pct_of_trips", E.percent(F.col("trip_count"), F.sum("trip_count").over(everything)))
    return share(one).unionByName(share(two))


def pattern_scaffold(rows: DataFrame, fields: list[str], label: str) -> DataFrame:
    """All 2^k patterns, also those that never occur, with the labels in which each occurs."""
    seen = rows.groupBy(*[F.col(f).isNull().alias(f) for f in fields]).agg(F.count(F.lit(1)).alias("rows"), F.array_join(F.array_sort(F.collect_set(label)), "|").alias("labels"))
    grid = rows.sparkSession.range(2 ** len(fields)).select(*[(F.shiftright("id", i) % 2 == 1).alias(f) for i, f in enumerate(fields)])
    out = grid.join(seen, fields, "left")
    return out.select(*[F.col(f).alias(f"{f}_missing") for f in fields], F.coalesce("rows", F.lit(0)).alias("row_count"), F.coalesce("labels", F.lit("")).alias("labels"))


def co_missing(rows: DataFrame, fields: list[str], by: str, within: str) -> DataFrame:
    """Share of rows with all fields missing, by (by, within), and its range over `within` for each `by`."""
    every = reduce(lambda a, b: a & b, [F.col(f).isNull() for f in fields])
    cells = rows.groupBy(by, within).agg(F.count(F.lit(1)).alias("row_count"), F.count_if(every).alias("all_missing")).withColumn("all_missing_pct", E.percent(F.col("all_missing"), F.col("row_count")))
    span = Window.partitionBy(by)
    return cells.withColumn("range_pct", E.rounded(F.max("all_missing_pct").over(span) - F.min("all_missing_pct").over(span)))


def top_groups(rows: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """The n groups with the largest totals, ties by name."""
    return rows.groupBy(group).agg(E.total(value).alias("total")).orderBy(F.desc("total"), group).limit(n)


def unioned_scale(parts: list[tuple[DataFrame, str]]) -> DataFrame:
    """One demand aggregate over many tables whose timestamps differ in type and name."""
    rows = reduce(DataFrame.unionByName, [df.select(F.col(ts).cast("timestamp_ntz").alias("ts")) for df, ts in parts])
    return rows.groupBy(E.iso_dow("ts").alias("day_of_week"), F.hour("ts").alias("pickup_hour")).agg(F.count(F.lit(1)).alias("trip_count"))
