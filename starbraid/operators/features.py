"""Targets, point-in-time features, encodings, splits, sampling and folds."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as E


class SplitOrderError(Exception):
    """A training row is not older than every test row, or a side is empty."""


def next_target(rows: DataFrame, entity: str, time: str, value: str) -> DataFrame:
    """M1: the entity's next value as target; the last row of each entity goes."""
    w = Window.partitionBy(entity).orderBy(time)
    return rows.withColumn("target", F.lead(value).over(w)).where("target IS NOT NULL")


def leaky_mean(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """M2: the group mean over all rows, the future included (deliberately)."""
    w = Window.partitionBy(*keys)
    return rows.withColumn(name, E.rounded(F.sum(E.exact(value)).over(w).cast("double") / F.count(value).over(w)))


def prior_mean(rows: DataFrame, entity: str, time: str, value: str, name: str) -> DataFrame:
    """M3: the mean of strictly earlier rows; NULL on the first."""
    w = E.prior(Window.partitionBy(entity).orderBy(time))
    return rows.withColumn(name, E.rounded(F.try_divide(F.sum(E.exact(value)).over(w).cast("double"), F.count(value).over(w).cast("double"))))


def prior_cells(rows: DataFrame, keys: list[str], bucket: str, value: str) -> DataFrame:
    """(keys, bucket, s, n): sums and counts of strictly earlier buckets, from one row a bucket."""
    cells = rows.groupBy(*keys, bucket).agg(F.sum(E.exact(value)).alias("s1"), F.count(value).alias("n1"))
    w = E.prior((Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(bucket))
    return cells.select(*keys, bucket, F.sum("s1").over(w).cast("double").alias("s"), F.sum("n1").over(w).cast("double").alias("n"))


def prior_cell_mean(rows: DataFrame, keys: list[str], bucket: str, value: str, name: str) -> DataFrame:
    """M4: the cell's mean over earlier buckets (rows of one bucket never see each other)."""
    cells = prior_cells(rows, keys, bucket, value)
    return rows.join(cells, [*keys, bucket]).withColumn(name, E.rounded(F.try_divide(F.col("s"), F.col("n")))).drop("s", "n")


def prior_encoding(rows: DataFrame, category: str, bucket: str, target: str, smoothing: float, name: str) -> DataFrame:
    """M5: smoothed target encoding from earlier buckets; the first bucket's global prior is the overall mean."""
    own = prior_cells(rows, [category], bucket, target)
    everyone = prior_cells(rows, [], bucket, target).select(bucket, F.try_divide("s", "n").alias("g"))
    overall = rows.agg(E.mean(target).alias("o"))  # one row
    both = rows.join(own, [category, bucket]).join(everyone, bucket).crossJoin(F.broadcast(overall))
    g, n, s = F.coalesce("g", "o"), F.coalesce("n", F.lit(0.0)), F.coalesce("s", F.lit(0.0))
    return both.withColumn(name, E.rounded((s + F.lit(smoothing) * g) / (n + F.lit(smoothing)))).drop("s", "n", "g", "o")


def one_hot(train: DataFrame, test: DataFrame, column: str, name: str) -> tuple[DataFrame, DataFrame]:
    """M6: categories of the training side only; what the test side adds is all zeros."""
    index = StringIndexer(inputCol=column, outputCol=f"{name}_index", handleInvalid="keep", stringOrderType="alphabetAsc").fit(train)
    hot = OneHotEncoder(inputCol=f"{name}_index", outputCol=name, dropLast=True).fit(index.transform(train))
    return tuple(hot.transform(index.transform(df)).drop(f"{name}_index") for df in (train, test))


def split_at(rows: DataFrame, key: str, boundary: int) -> tuple[DataFrame, DataFrame]:
    """M7: before the boundary, and from it on."""
    return rows.where(F.col(key) < boundary), rows.where(F.col(key) >= boundary)


def split_months(rows: DataFrame, year: int, train: list[int], test: list[int]) -> tuple[DataFrame, DataFrame]:
    """M7: by month lists within one year; other years are dropped."""
    own = rows.where(F.col("year") == year)
    return own.where(F.col("month").isin(train)), own.where(F.col("month").isin(test))


def assert_order(train: DataFrame, test: DataFrame, time: str) -> None:
    """M8: raise unless both sides have rows and every training row is older than every test row."""
    a, b = train.agg(F.max(time).alias("t")).first()["t"], test.agg(F.min(time).alias("t")).first()["t"]
    if a is None or b is None or a >= b:
        raise SplitOrderError(f"training ends at {a}, test starts at {b}")


def bucket_of(key: Column, n: int = 17) -> Column:
    """M9: a content-addressed bucket: the first 8 hexadecimal digits of a hexadecimal id, modulo n."""
    return (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % n).cast("int")


def folds(spark: SparkSession, months: list[int], least: int, block: int) -> DataFrame:
    """Expanding-window folds (fold, month, side); none when there are too few months."""
    held, rows, cut, k = sorted(set(months)), [], least, 0
    while cut + block <= len(held):
        rows += [(k, m, "train") for m in held[:cut]] + [(k, m, "validation") for m in held[cut : cut + block]]
        cut, k = cut + block, k + 1
    return spark.createDataFrame(rows, "fold int, month_key int, side string")
