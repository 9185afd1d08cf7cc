"""Dimensions, a Type 2 geography and facts with resolved keys. Unknown members have key -1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as E

EPOCH, HIGH = "2016-01-01", "9999-12-31"


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row a day with ISO weekday and week, plus the Unknown member."""
    d = F.col("d")
    days = spark.sql("SELECT 1 AS one").select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("d")).select(
        E.date_key("d").alias("date_key"), d.alias("full_date"), F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month_number"), F.date_format(d, "MMMM").alias("month_name"), F.dayofmonth(d).alias("day_of_month"),
        E.iso_dow("d").alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"), (F.weekday(d) >= 5).alias("is_weekend"), F.weekofyear(d).alias("week_of_year"), F.date_format(d, "yyyy-MM").alias("year_month"), (F.last_day(d) == d).alias("is_month_end"),
    )
    unknown = days.limit(1).select(*[F.lit({"date_key": E.UNKNOWN, "month_name": "Unknown", "day_name": "Unknown", "year_month": "Unknown"}.get(f.name)).cast(f.dataType).alias(f.name) for f in days.schema])
    return days.unionByName(unknown)


def static_dimension(spark: SparkSession, rows: list[tuple], schema: str, unknown: tuple) -> DataFrame:
    """Published codes as literal rows with their Unknown member."""
    return spark.createDataFrame([*rows, unknown], schema)


def keyed(members: DataFrame, natural: list[str], key: str, unknown: dict[str, object] | None = None) -> DataFrame:
    """Dense surrogate keys over distinct members in the order of their natural key (nulls last).

    The numbering runs in one task, so it is for dimensions (thousands of members), never for facts."""
    distinct = members.dropDuplicates(natural)
    order = Window.orderBy(*[F.col(c).asc_nulls_last() for c in natural])
    out = distinct.withColumn(key, F.row_number().over(order)).select(key, *members.columns)
    if unknown is None:
        return out
    row = members.limit(0).sparkSession.range(1).select(F.lit(E.UNKNOWN).alias(key), *[F.lit(unknown.get(f.name)).cast(f.dataType).alias(f.name) for f in members.schema])
    return out.unionByName(row)


def slug(c: Column) -> Column:
    """A code of upper-case letters, digits and underscores."""
    return F.upper(F.regexp_replace(F.trim(c), r"[^A-Za-z0-9]+", "_"))


def assembled(sources: list[DataFrame], natural: list[str]) -> DataFrame:
    """Members of several sources, the first source winning for each natural key."""
    parts = [s.withColumn("priority_", F.lit(i)) for i, s in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, parts)
    others = [F.col(c) for c in sources[0].columns if c not in natural]
    n = F.row_number().over(Window.partitionBy(*natural).orderBy("priority_", *others))
    return rows.withColumn("n_", n).where("n_ = 1").drop("n_", "priority_")


def first_load(incoming: DataFrame, natural: list[str], key: str = "geo_key") -> DataFrame:
    """An empty target takes all members from the epoch on, and the Unknown row."""
    names = {c: "Unknown" for c in incoming.columns}
    rows = keyed(incoming, natural, key, names)
    return rows.withColumns({"valid_from": F.lit(EPOCH).cast("date"), "valid_to": F.lit(HIGH).cast("date"), "is_current": F.lit(True)})


def scd2_merge(target: DataFrame, incoming: DataFrame, natural: list[str], tracked: list[str], effective: str, key: str = "geo_key") -> DataFrame:
    """Type 2 merge with an action column (closed, reopened, inserted, unchanged).

    Changed members (compared null-safely) close the day before and reopen with new keys after the largest; members
    absent from incoming stay current; history is untouched. Write the result to a new path, never over its input."""
    now = target.where("is_current")
    at = reduce(lambda a, b: a & b, [F.col(f"t.{c}").eqNullSafe(F.col(f"i.{c}")) for c in natural])
    same = reduce(lambda a, b: a & b, [F.col(f"t.{c}").eqNullSafe(F.col(f"i.{c}")) for c in tracked])
    both = incoming.alias("i").join(now.alias("t"), at, "left")
    fresh = both.where(F.col(f"t.{key}").isNull() | ~same).select(*[F.col(f"i.{c}").alias(c) for c in incoming.columns], F.when(F.col(f"t.{key}").isNull(), "inserted").otherwise("reopened").alias("action"))
    changed = both.where(F.col(f"t.{key}").isNotNull() & ~same).select(F.col(f"t.{key}").alias("changed_"))
    day = F.lit(effective).cast("date")
    old = target.join(changed, target[key] == F.col("changed_"), "left")
    closed = F.col("changed_").isNotNull()
    kept = old.select(
        *[F.when(closed, F.date_sub(day, 1)).otherwise(F.col(c)).alias(c) if c == "valid_to" else (F.col(c) & ~closed).alias(c) if c == "is_current" else F.col(c) for c in target.columns], F.when(closed, "closed").otherwise("unchanged").alias("action"),
    )
    top = target.agg(F.max(key).alias("top_"))
    number = F.row_number().over(Window.orderBy(*[F.col(c).asc_nulls_last() for c in natural]))
    added = fresh.withColumn("n_", number).crossJoin(top).withColumns({key: (F.greatest(F.col("top_"), F.lit(0)) + F.col("n_")).cast("int"), "valid_from": day, "valid_to": F.lit(HIGH).cast("date"), "is_current": F.lit(True)})
    return kept.unionByName(added.select(*kept.columns))


def merge_outcome(merged: DataFrame) -> DataFrame:
    """Inserted, versioned and unchanged members of a merge."""
    return merged.agg(F.count_if(F.col("action") == "inserted").alias("inserted"), F.count_if(F.col("action") == "reopened").alias("versioned"), F.count_if((F.col("action") == "unchanged") & F.col("is_current")).alias("unchanged"))


def version_profile(merged: DataFrame, by: list[str]) -> DataFrame:
    """Versions and current members by group."""
    return merged.groupBy(*by).agg(F.count(F.lit(1)).alias("versions"), F.count_if("is_current").alias("current_members"))


def resolved(fact: DataFrame, dim: DataFrame, on: list[tuple[str, str]], key: str, name: str) -> DataFrame:
    """One foreign key by a null-safe left join on the natural key; what does not resolve is Unknown."""
    d = dim.select(F.col(key).alias("k_"), *[F.col(b).alias(f"n_{i}") for i, (_, b) in enumerate(on)])
    cond = reduce(lambda x, y: x & y, [F.col(a).eqNullSafe(F.col(f"n_{i}")) for i, (a, _) in enumerate(on)])
    return fact.join(d, cond, "left").withColumn(name, F.coalesce("k_", F.lit(E.UNKNOWN))).drop("k_", *[f"n_{i}" for i in range(len(on))])


def current(dim: DataFrame) -> DataFrame:
    """The current version of each member."""
    return dim.where("is_current")


def trip_fact(trips: DataFrame, dates: DataFrame, geography: DataFrame, vendors: DataFrame, payments: DataFrame, rates: DataFrame, flags: DataFrame) -> DataFrame:
    """Eight key lookups over accepted trips; date and geography play two roles each, of geography only current
    versions are met, and what does not resolve is Unknown. All dimensions are small; none is broadcast by hand."""
    out = trips.withColumns({"pickup_day_": F.to_date("pickup_ts"), "dropoff_day_": F.to_date("dropoff_ts")})
    geo = current(geography)
    for role in ("pickup", "dropoff"):
        out = resolved(out, dates, [(f"{role}_day_", "full_date")], "date_key", f"{role}_date_key")
        out = resolved(out, geo, [(f"{role}_zone", "geo_code")], "geo_key", f"{role}_geo_key")
    for dim, column, code, key in ((vendors, "vendor", "vendor_id", "vendor_key"), (payments, "payment", "payment_id", "payment_key"), (rates, "rate", "rate_id", "rate_key")):
        out = resolved(out, dim, [(column, code)], key, key)
    flag = ["stored", "is_airport_trip", "has_tip", "has_toll"]
    return resolved(out, flags, [(c, c) for c in flag], "flag_key", "flag_key").withColumn("pickup_hour", F.hour("pickup_ts")).drop("pickup_day_", "dropoff_day_")


def market_fact(prices: DataFrame, geography: DataFrame, commodities: DataFrame) -> DataFrame:
    """Month x market x commodity x price type x unit: mean price and observations; unresolved keys are Unknown.

    prices: (month_key, market, commodity, unit, price_type, price); a missing unit is 'unspecified'."""
    rows = prices.withColumn("unit", F.coalesce("unit", F.lit("unspecified")))
    rows = resolved(rows, current(geography), [("market", "geo_code")], "geo_key", "geo_key")
    rows = resolved(rows, commodities, [("commodity", "commodity_name"), ("unit", "unit")], "commodity_key", "commodity_key")
    return rows.groupBy("month_key", "geo_key", "commodity_key", "price_type", "unit").agg(E.rounded(E.mean("price"), 4).alias("mean_price"), F.count(F.lit(1)).alias("observation_count"))


def daily_aggregate(fact: DataFrame) -> DataFrame:
    """Date x zone x mode: count, sums, and, for reading only (means don't add up), means and the exact median.

    fact: (date_key, pickup_zone, mode_key, distance, total, fare, seconds, speed)."""
    r = E.rounded
    return fact.groupBy("date_key", "pickup_zone", "mode_key").agg(
        F.count(F.lit(1)).alias("trip_count"), r(E.total("distance"), 4).alias("total_distance"), r(E.total("total", 6), 4).alias("total_revenue"), r(E.mean("fare"), 4).alias("avg_fare"), r(F.median("fare"), 4).alias("median_fare"),
        r(E.mean("seconds"), 2).alias("avg_duration_seconds"), r(E.mean("speed", 8), 4).alias("avg_speed"),
    )


def rolled_up(rows: DataFrame, count: Column, revenue: Column) -> DataFrame:
    """Month x zone counts and revenue, from the atomic fact or from the daily aggregate (sums of sums only)."""
    month = F.floor(F.col("date_key") / 100).cast("int")
    return rows.groupBy(month.alias("month"), "pickup_zone").agg(F.sum(count).alias("trips"), E.rounded(F.sum(revenue.cast("decimal(18,6)")).cast("double"), 2).alias("revenue"))
