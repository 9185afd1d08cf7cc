"""The driver tables in the roles of the star schema, as DataFrames and as the same CTEs for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zone_key, zone, borough)."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("zone_key"), F.col("n_name").alias("zone"), F.col("r_name").alias("borough")
    )


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trips: ordered in the supplier's nation, shipped to the customer's."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    supplier, customer = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    return (
        line.join(orders, line.l_orderkey == orders.o_orderkey)
        .join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("part_key"),
            F.col("o_orderdate").alias("pickup_ts"), F.col("l_shipdate").alias("dropoff_ts"),
            F.col("l_quantity").alias("distance"), F.col("l_extendedprice").alias("fare"),
            (F.col("l_extendedprice") * F.col("l_discount")).alias("tip"),
            (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")) * (F.lit(1.0) + F.col("l_tax"))).alias("total"),
            F.col("s_nationkey").alias("pickup_zone"), F.col("c_nationkey").alias("dropoff_zone"),
            F.col("o_orderpriority").alias("payment"), F.col("l_returnflag").alias("vendor"), F.col("l_linestatus").alias("rate"),
            F.col("l_linenumber").alias("passengers"),
            F.datediff("l_shipdate", "o_orderdate").alias("days"),
        )
    )


TRIPS_SQL = """trip AS (
  SELECT l_orderkey AS order_key, l_linenumber AS line_no, l_partkey AS part_key, o_orderdate AS pickup_ts, l_shipdate AS dropoff_ts,
         l_quantity AS distance, l_extendedprice AS fare, l_extendedprice * l_discount AS tip,
         l_extendedprice * (1.0::DOUBLE - l_discount) * (1.0::DOUBLE + l_tax) AS total,
         s_nationkey AS pickup_zone, c_nationkey AS dropoff_zone, o_orderpriority AS payment, l_returnflag AS vendor,
         l_linestatus AS rate, l_linenumber AS passengers, CAST(date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS INTEGER) AS days
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
), zone AS (SELECT n_nationkey AS zone_key, n_name AS zone, r_name AS borough FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def unit_price() -> Column:
    """Price of a unit in whole ten-thousandths (integer division), as a double with four exact decimals."""
    cents = F.sum((E.exact("l_extendedprice", 2) * 100).cast("long"))
    return F.call_function("div", cents * 100, F.sum(F.col("l_quantity").cast("long"))).cast("double") / 10000.0


def price_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(state, zone, month_key, price): supplier nation by ship month, mean price of a unit."""
    line, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    cells = (
        line.join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey", E.month_key("l_shipdate").alias("month_key"))
        .agg(unit_price().alias("price"))
    )
    return cells.join(zones(spark, sf_dir), F.col("s_nationkey") == F.col("zone_key")).select(F.col("zone").alias("state"), F.col("borough").alias("zone"), "month_key", "price")


PANEL_SQL = """zonal AS (SELECT n_nationkey AS zone_key, n_name AS zone, r_name AS borough FROM nation JOIN region ON n_regionkey = r_regionkey),
panel AS (
  SELECT zone AS state, borough AS zone, month_key,  price FROM (
    SELECT s_nationkey, CAST(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + 1 AS INTEGER) AS month_key,
           CAST(CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT)) * 100 AS BIGINT) // CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS DOUBLE) / 10000.0::DOUBLE AS price
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) p JOIN zonal ON s_nationkey = zone_key)"""


def market_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(state, zone, commodity, category, month_key, price, n): supplier nation x brand x ship month."""
    line, supplier, part = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "part"))
    cells = (
        line.join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("s_nationkey", "p_brand", E.month_key("l_shipdate").alias("month_key"))
        .agg(unit_price().alias("price"), F.count(F.lit(1)).alias("n"))
    )
    return cells.join(zones(spark, sf_dir), F.col("s_nationkey") == F.col("zone_key")).select(
        F.col("zone").alias("state"), F.col("borough").alias("zone"), F.col("p_brand").alias("commodity"), F.substring("p_brand", 1, 7).alias("category"), "month_key", "price", "n"
    )


MARKET_SQL = """zonal AS (SELECT n_nationkey AS zone_key, n_name AS zone, r_name AS borough FROM nation JOIN region ON n_regionkey = r_regionkey),
market AS (
  SELECT zone AS state, borough AS zone, p_brand AS commodity, substr(p_brand, 1, 7) AS category, month_key, price, n FROM (
    SELECT s_nationkey, p_brand, CAST(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + 1 AS INTEGER) AS month_key,
           CAST(CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT)) * 100 AS BIGINT) // CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS DOUBLE) / 10000.0::DOUBLE AS price, count(*) AS n
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL) p JOIN zonal ON s_nationkey = zone_key)"""
