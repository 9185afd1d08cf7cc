"""The model ladder: reference predictors, scores, rungs on Spark ML, and comparisons between rungs."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from .boosting import Size, boosted


def references(train: DataFrame, test: DataFrame, y: str, distance: str, time: str) -> DataFrame:
    """Test rows with the training mean and distance over the training speed (ratio of sums) as predictions."""
    facts = train.agg(E.mean(y).alias("pred_mean"), F.try_divide(E.total(distance), E.total(time)).alias("speed"))  # one row
    out = test.crossJoin(F.broadcast(facts))
    return out.withColumns({"pred_mean": E.rounded(F.col("pred_mean")), "pred_speed": E.rounded(F.try_divide(F.col(distance), F.col("speed")))}).drop("speed")


def carried_forward(rows: DataFrame, unit: str, time: str, y: str) -> DataFrame:
    """The last value carried forward: each row's prediction is its unit's value in the row before."""
    return rows.withColumn("pred_carried", F.lag(y).over(Window.partitionBy(unit).orderBy(time)))


def scores(rows: DataFrame, by: list[str], y: str, prediction: str) -> DataFrame:
    """MAE, and MAPE without the rows where y is zero."""
    err = F.abs(F.col(y) - F.col(prediction))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), E.rounded(E.mean(err, 6)).alias("mae"), E.rounded(F.lit(100.0) * E.mean(F.when(F.col(y) != 0, err / F.abs(F.col(y))), 9)).alias("mape"))


def imputed(rows: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Trees here take no NaN: a missing feature becomes 0 with a flag beside it."""
    cols = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features} | {f"{f}_missing": F.col(f).isNull().cast("double") for f in features}
    return rows.withColumns(cols), [*features, *[f"{f}_missing" for f in features]]


def fitted(train: DataFrame, features: list[str], y: str, seed: int, trees: int = 20, depth: int = 4):  # noqa: ANN201
    """One gradient-boosted model over imputed features."""
    rows, names = imputed(train, features)
    gbt = GBTRegressor(featuresCol="x_", labelCol=y, maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="x_"), gbt]).fit(rows)


def rung(train: DataFrame, test: DataFrame, name: str, features: list[str], y: str, seeds: list[int], key: list[str], **size: int) -> DataFrame:
    """The error frame (key, rung, seed, abs_error) of one rung."""
    def one(seed: int) -> DataFrame:
        rows, _ = imputed(test, features)
        out = fitted(train, features, y, seed, **size).transform(rows)
        return out.select(*key, F.lit(name).alias("rung"), F.lit(seed).alias("seed"), F.abs(F.col(y) - F.col("prediction")).alias("abs_error"))

    return reduce(DataFrame.unionByName, [one(s) for s in seeds])


#: Training rows that one task may hold; larger training sets are fitted by Spark ML (rung).
SAMPLE = 200_000

FIT = "n_train int, n_valid int, mae double, best_iteration int"


def fit_group(rows: pd.DataFrame, size: Size, seed: int, rounds: int, patience: int | None) -> tuple[np.ndarray, int, float]:
    """One model over the rows of a group, in the order of their key so that every run gives the same model."""
    x = np.array(rows["features"].tolist(), float)
    return boosted(x, rows["y"].to_numpy(float), rows["is_train"].to_numpy(bool), size, seed, rounds, patience)


def bounded(rows: DataFrame, by: list[str]) -> None:
    """Raise where the training rows of a group do not fit a task."""
    most = rows.where("is_train").groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if most > SAMPLE:
        raise ValueError(f"a group has {most} training rows, more than the {SAMPLE} of a task: sample, or fit with Spark ML")


def searched(rows: DataFrame, folds: DataFrame, key: list[str], month: str, candidates: list[Size], seed: int = 1, rounds: int = 1000, patience: int = 30) -> DataFrame:
    """Every candidate on every forward-chaining fold, side by side: (candidate, fold, n_train, n_valid, mae,
    best_iteration). rows: (*key, month, y, features); folds: (fold, month, side). Validation rows stop the boosting."""
    tagged = rows.join(folds, month).select("fold", (F.col("side") == "train").alias("is_train"), *[c for c in dict.fromkeys([*key, month])], "y", "features")
    bounded(tagged, ["fold"])
    each = tagged.withColumn("candidate", F.explode(F.array(*[F.lit(i) for i in range(len(candidates))])))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([*key, month])
        c, n = int(group["candidate"].iloc[0]), int(group["is_train"].sum())
        if not 0 < n < len(group):
            return pd.DataFrame([], columns=["candidate", "fold", "n_train", "n_valid", "mae", "best_iteration"])
        _, used, error = fit_group(group, candidates[c], seed, rounds, patience)
        return pd.DataFrame([(c, int(group["fold"].iloc[0]), n, len(group) - n, error, used)], columns=["candidate", "fold", "n_train", "n_valid", "mae", "best_iteration"])

    return each.groupBy("candidate", "fold").applyInPandas(fit, f"candidate int, fold int, {FIT}")


def selected(fits: DataFrame) -> DataFrame:
    """(candidate, mean_cv_mae, n_folds_used, median_best_iteration, frozen_trees, is_best) from the table of fits.

    The frozen tree count is the mean of the best iterations of the two folds with the largest training windows, cut to a
    whole number; the best candidate has the least mean error, the first among equals."""
    largest = F.row_number().over(Window.partitionBy("candidate").orderBy(F.desc("n_train"), F.desc("fold"))) <= 2
    out = fits.withColumn("largest", largest).groupBy("candidate").agg(
        E.rounded(E.mean("mae", 9)).alias("mean_cv_mae"), F.count(F.lit(1)).alias("n_folds_used"), F.floor(F.median("best_iteration")).cast("int").alias("median_best_iteration"),
        F.greatest(F.floor(F.avg(F.when(F.col("largest"), F.col("best_iteration")))).cast("int"), F.lit(1)).alias("frozen_trees"),
    )
    return out.withColumn("is_best", F.row_number().over(Window.orderBy("mean_cv_mae", "candidate")) == 1)  # a row a candidate


def store_of(spark: SparkSession, root: str, rows: DataFrame, *what: object) -> str:
    """The folder of an error store: named by the content of its rows and by what is fitted, so other data has another."""
    mark = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)"))).first()
    return f"{root}/ladder-{hashlib.sha256(repr((tuple(map(str, mark)), what)).encode()).hexdigest()[:24]}"


def error_store(rows: DataFrame, specs: list[tuple[str, str, int]], sizes: dict[str, tuple[Size, int]], key: list[str], path: str) -> DataFrame:
    """(variant, rung, seed, *key, y, prediction, abs_error) of the test rows of every spec (variant, rung, seed),
    stored at path by variant, rung and seed. Fits that the store has are not made again; the rest are made side by side.

    rows: (rung, *key, is_train, y, features); sizes: variant -> (capacity, trees)."""
    spark = rows.sparkSession
    schema = f"variant string, rung string, seed int, {', '.join(f'`{c}` {dict(rows.dtypes)[c]}' for c in key)}, y double, prediction double, abs_error double"
    try:
        held = {tuple(r) for r in spark.read.schema(schema).parquet(path).select("variant", "rung", "seed").distinct().collect()}  # names of fits
    except AnalysisException:  # no store yet
        held = set()
    todo = [s for s in specs if s not in held]
    if todo:
        bounded(rows, ["rung"])
        wanted = spark.createDataFrame(todo, "variant string, rung string, seed int")
        each = rows.join(F.broadcast(wanted), "rung")  # a row a fit

        def fit(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(key)
            variant, name, seed = group["variant"].iloc[0], group["rung"].iloc[0], int(group["seed"].iloc[0])
            size, trees = sizes[variant]
            group["prediction"] = fit_group(group, size, seed, trees, None)[0]
            out = group[~group["is_train"].to_numpy(bool)].copy()
            out["abs_error"] = (out["y"] - out["prediction"]).abs()
            return out[["variant", "rung", "seed", *key, "y", "prediction", "abs_error"]]

        made = each.groupBy("variant", "rung", "seed").applyInPandas(fit, schema)
        made.write.mode("append").partitionBy("variant", "rung", "seed").parquet(path)
    asked = spark.createDataFrame(specs, "variant string, rung string, seed int")
    return spark.read.schema(schema).parquet(path).join(F.broadcast(asked), ["variant", "rung", "seed"], "left_semi")


def scored(errors: DataFrame) -> DataFrame:
    """(variant, rung, seed, mae, mape) of an error store."""
    share = F.when(F.col("y") != 0, F.col("abs_error") / F.abs(F.col("y")))
    return errors.groupBy("variant", "rung", "seed").agg(E.rounded(E.mean("abs_error", 6)).alias("mae"), E.rounded(F.lit(100.0) * E.mean(share, 9)).alias("mape"))


def repeats(results: DataFrame) -> DataFrame:
    """(variant, rung): spread of the scores over seeds. results: (variant, rung, seed, mae, mape)."""
    spread = lambda c: [E.rounded(E.mean(c, 6)).alias(f"{c}_mean"), E.rounded(F.stddev_samp(c), 4).alias(f"{c}_sd"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return results.groupBy("variant", "rung").agg(*spread("mae"), *spread("mape"), F.count(F.lit(1)).alias("n_repeats"), F.min_by("mae", "seed").alias("mae_first_seed"), F.array_join(F.array_sort(F.collect_list("seed")), ",").alias("seeds"))


def paired(results: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """rung_b minus rung_a within each seed: mean, spread, sign agreement, the better rung or a tie, and the seeds'
    differences in the seeds' order. A difference of 0 agrees with nothing."""
    spark = results.sparkSession
    wanted = spark.createDataFrame(pairs, "rung_a string, rung_b string")
    a, b = results.select("variant", "seed", F.col("rung").alias("rung_a"), F.col("mae").alias("mae_a")), results.select("variant", "seed", F.col("rung").alias("rung_b"), F.col("mae").alias("mae_b"))
    same = F.when(F.col("m") > 0, F.col("up")).when(F.col("m") < 0, F.col("down")).otherwise(0)
    diffs = a.join(F.broadcast(wanted), "rung_a").join(b, ["variant", "seed", "rung_b"]).withColumn("d", F.col("mae_b") - F.col("mae_a"))
    return diffs.groupBy("variant", "rung_a", "rung_b").agg(
        F.count(F.lit(1)).alias("n_repeats"), E.mean("d", 6).alias("m"), F.stddev_samp("d").alias("s"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"),
        F.transform(F.array_sort(F.collect_list(F.struct("seed", F.col("d").cast("decimal(18,4)").cast("string").alias("d")))), lambda x: x["d"]).alias("by_seed"),
    ).select(
        "variant", "rung_a", "rung_b", "n_repeats", E.rounded(F.col("m")).alias("mean_diff_mae"), E.rounded(F.col("s"), 4).alias("sd_diff_mae"), E.rounded(F.col("lo")).alias("min_diff"), E.rounded(F.col("hi")).alias("max_diff"), E.rounded(F.try_divide("m", "s"), 3).alias("mean_over_sd"),
        same.alias("n_same_direction"), (same == F.col("n_repeats")).alias("direction_consistent"), F.when(F.col("m") > 0, F.col("rung_a")).when(F.col("m") < 0, F.col("rung_b")).otherwise("tie").alias("better_rung"),
        F.array_join("by_seed", ";").alias("per_seed_diffs"),
    )


def adjacent(summary: DataFrame) -> DataFrame:
    """Each rung with the next one of its variant."""
    w = Window.partitionBy("variant").orderBy("rung")
    return summary.select("variant", F.col("rung").alias("rung_a"), F.lead("rung").over(w).alias("rung_b")).where("rung_b IS NOT NULL")


def best_rung(summary: DataFrame, ignored: list[str]) -> DataFrame:
    """The rung with the least mean MAE, leaky and reference rungs left out."""
    return summary.where(~F.col("rung").isin(ignored)).groupBy("variant").agg(F.min_by("rung", F.struct("mae_mean", "rung")).alias("best_rung"), F.min("mae_mean").alias("best_mae"))


def matched(a: DataFrame, b: DataFrame, key: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """A table against a published one, cell by cell, with where each row was found."""
    left, right = a.select(*key, F.col(value).alias("ours")), b.select(*key, F.col(value).alias("published"))
    presence = F.when(F.col("ours").isNull(), "published only").when(F.col("published").isNull(), "ours only").otherwise("both")
    return left.join(right, key, "full").select(*key, "ours", "published", presence.alias("presence"), F.coalesce(F.abs(F.col("ours") - F.col("published")) < tolerance, F.lit(False)).alias("is_match"))


def reference_gap(summary: DataFrame, refs: DataFrame, ignored: list[str]) -> DataFrame:
    """The best rung of each variant against each reference (reference, reference_mae)."""
    best = best_rung(summary, ignored)
    out = best.crossJoin(F.broadcast(refs))  # a few rows by a few
    gap = F.lit(100.0) * (F.col("best_mae") - F.col("reference_mae")) / F.col("reference_mae")
    return out.select("variant", "best_rung", "best_mae", "reference", "reference_mae", E.rounded(gap).alias("gap_pct"), F.when(gap < 0, "beats reference").otherwise("does not beat reference").alias("verdict"))


def seeds_beating(results: DataFrame, refs: DataFrame) -> DataFrame:
    """By rung and reference, in how many seeds the rung is better."""
    return results.crossJoin(F.broadcast(refs)).groupBy("variant", "rung", "reference").agg(F.count(F.lit(1)).alias("n_seeds"), F.count_if(F.col("mae") < F.col("reference_mae")).alias("n_beating"))


def against_base(summary: DataFrame, base: str) -> DataFrame:
    """Improvement on the base rung, and whether the step into each rung helped (an exact tie says nothing)."""
    b = summary.where(F.col("rung") == base).select("variant", F.col("mae_mean").alias("base_mae"))
    step = F.lag("mae_mean").over(Window.partitionBy("variant").orderBy("rung"))
    return summary.join(b, "variant").select("variant", "rung", "mae_mean", E.rounded(F.lit(100.0) * (F.col("base_mae") - F.col("mae_mean")) / F.col("base_mae")).alias("pct_vs_base"), F.when(F.col("mae_mean") != step, F.col("mae_mean") < step).alias("step_improves"))


def count_consistent(table: DataFrame, flag: Column, by: str) -> DataFrame:
    """Consistent and inconsistent steps by task."""
    return table.groupBy(by).agg(F.count_if(flag).alias("consistent"), F.count_if(~flag).alias("inconsistent"))
