"""Gated cleansing: every rejected row carries exactly one reason, by the order of the rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E


def judged(rows: DataFrame, rules: list[tuple[str, Column]], name: str = "reject_reason") -> DataFrame:
    """The first rule that holds names the row's reason; NULL conditions never reject."""
    first, *rest = rules
    reason = reduce(lambda c, r: c.when(r[1], F.lit(r[0])), rest, F.when(first[1], F.lit(first[0])))
    return rows.withColumn(name, reason)


def trip_rules(ceiling_seconds: int, ceiling_distance: float, ceiling_passengers: int) -> list[tuple[str, Column]]:
    """The eight ordered reasons of the trip gate. A distance of 0 passes, a missing one does not; a missing amount or
    passenger count passes."""
    c = F.col
    seconds = F.expr("timestampdiff(SECOND, pickup_ts, dropoff_ts)")
    return [
        ("missing_timestamp", c("pickup_ts").isNull() | c("dropoff_ts").isNull()),
        ("no_duration", seconds <= 0),
        ("too_long", seconds > ceiling_seconds),
        ("no_distance", c("distance").isNull() | (c("distance") < 0)),
        ("too_far", c("distance") > ceiling_distance),
        ("negative_amount", (c("fare") < 0) | (c("total") < 0)),
        ("implausible_passengers", (c("passengers") < 0) | (c("passengers") > ceiling_passengers)),
        ("unknown_zone", c("pickup_zone").isNull() | c("dropoff_zone").isNull()),
    ]


def market_rules() -> list[tuple[str, Column]]:
    """The six ordered reasons of the market price gate, over (observation_date, market, commodity, price, state)."""
    c = F.col
    blank = lambda n: c(n).isNull() | (c(n) == "")
    return [("unparsable_date", c("observation_date").isNull()), ("missing_market", blank("market")), ("missing_commodity", blank("commodity")), ("no_price", c("price").isNull()), ("price_not_positive", c("price") <= 0), ("unknown_state", c("state").isNull())]


def fuel_rules(floor: float, ceiling: float) -> list[tuple[str, Column]]:
    """The five ordered reasons of the fuel price gate, over (state, zone, price)."""
    c = F.col
    return [("unknown_state", c("state").isNull() | (c("state") == "")), ("state_without_zone", c("zone").isNull()), ("no_price", c("price").isNull()), ("below_floor", c("price") < floor), ("above_ceiling", c("price") > ceiling)]


def derived(trips: DataFrame, lo: str, hi: str, airports: list[int]) -> DataFrame:
    """Duration, window flag, speed and the airport, tip and toll flags."""
    seconds = F.expr("timestampdiff(SECOND, pickup_ts, dropoff_ts)")
    return trips.withColumns({
        "duration_seconds": seconds, "is_outside_declared_window": (F.col("pickup_ts") < F.lit(lo).cast("timestamp_ntz")) | (F.col("pickup_ts") >= F.lit(hi).cast("timestamp_ntz")),
        "avg_speed": F.when(seconds > 0, E.rounded(F.col("distance") * 3600.0 / seconds, 8)),
        "is_airport_trip": F.col("pickup_zone").isin(airports) | F.col("dropoff_zone").isin(airports), "has_tip": F.coalesce("tip", F.lit(0)) > 0, "has_toll": F.coalesce("tolls", F.lit(0)) > 0,
    })


def content_id(columns: list[Column]) -> Column:
    """MD5 over the columns' text, NULLs skipped. Doubles must come as decimals: their text differs by engine."""
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]))


def reject_summary(judged_rows: DataFrame, distance: str, total: str, outside: str) -> DataFrame:
    """C4: rows, out-of-window rows and extremes by reason; what passed is 'accepted'."""
    return judged_rows.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reject_reason")).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(outside).alias("outside_window_rows"), F.min(distance).alias("min_distance"), F.max(distance).alias("max_distance"),
        F.min(E.rounded(F.col(total))).alias("min_total"), F.max(E.rounded(F.col(total))).alias("max_total"),
    )


def reject_sample(judged_rows: DataFrame, key: list[str], n: int) -> DataFrame:
    """A bounded sample of rejects, the first n by key."""
    return judged_rows.where(F.col("reject_reason").isNotNull()).select(*key, "reject_reason").orderBy(*key).limit(n)


def first_per_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first by order."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("n_", n).where("n_ = 1").drop("n_")


def lagged_changes(panel: DataFrame, unit: str, time: str, value: str) -> DataFrame:
    """C11: change on the row before and on the twelfth row before (rows, not months)."""
    w = Window.partitionBy(unit).orderBy(time)
    one, twelve = F.lag(value).over(w), F.lag(value, 12).over(w)
    change = lambda p: E.rounded(F.try_divide(F.lit(100.0) * (F.col(value) - p), p))
    return panel.select("*", one.alias("prev_month"), change(one).alias("mom_pct_change"), twelve.alias("prev_year"), change(twelve).alias("yoy_pct_change"))


def lagged_changes_by_calendar(panel: DataFrame, unit: str, time_key: str, value: str) -> DataFrame:
    """C11, calendar-safe: the year before is twelve months back, whatever rows are missing."""
    rows = panel.withColumn("m_", E.index_of_key(time_key))
    before = rows.select(F.col(unit).alias("u_"), (F.col("m_") + 12).alias("m2_"), F.col(value).alias("prev_year"))
    joined = rows.join(before, (F.col(unit) == F.col("u_")) & (F.col("m_") == F.col("m2_")), "left")
    return joined.select(*panel.columns, "prev_year", E.rounded(F.try_divide(F.lit(100.0) * (F.col(value) - F.col("prev_year")), F.col("prev_year"))).alias("yoy_pct_change"))


def reconciliation(sources: dict[str, DataFrame]) -> DataFrame:
    """C14: per source raw rows, rejects by reason, loaded rows and retention, from judged rows in one pass each."""

    def one(name: str, rows: DataFrame) -> DataFrame:
        counts = rows.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))
        rejected = F.sum(F.when(F.col("reject_reason").isNotNull(), F.col("n")).otherwise(0))
        reasons = F.array_join(F.array_sort(F.collect_list(F.when(F.col("reject_reason").isNotNull(), F.concat_ws("=", "reject_reason", "n")))), "; ")
        return counts.agg(F.sum("n").alias("raw_rows_in"), rejected.alias("rows_rejected"), (F.sum("n") - rejected).alias("rows_loaded"), reasons.alias("reject_reasons")).select(
            F.lit(name).alias("source"), "*", E.percent(F.col("rows_loaded"), F.col("raw_rows_in")).alias("retention_pct")
        )

    return reduce(DataFrame.unionByName, [one(n, r) for n, r in sources.items()])


def external_check(series: DataFrame, targets: DataFrame, tolerance: float) -> DataFrame:
    """Assembled value by month against a published one, with the tolerance and how many units report.

    series: (month_key, assembled, reporting_states); targets: (month_key, published), a handful of rows. A month that is
    not assembled is outside the tolerance and has 0 units."""
    both = targets.join(series, "month_key", "left")
    delta = E.rounded(F.col("assembled") - F.col("published"), 4)
    return both.select("month_key", "published", "assembled", delta.alias("delta"), F.lit(float(tolerance)).alias("tolerance"), F.coalesce(F.abs(delta) <= tolerance, F.lit(False)).alias("within_tolerance"), F.coalesce("reporting_states", F.lit(0)).alias("reporting_states"))
