"""Inference over per-row errors: bootstraps by hashed draws, Diebold-Mariano tests, support and composition tables.

Resampling weights are functions of (row or cluster, resample, seed) by hash, so a lost task recomputes the same draws.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E


def occurrences(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The k-th occurrence of each key, so that repeated ids of two row sets can be matched one to one."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def differences(a: DataFrame, b: DataFrame, key: list[str], value: str = "abs_error") -> DataFrame:
    """Paired differences b - a on the key."""
    return a.withColumnRenamed(value, "ea").join(b.select(*key, F.col(value).alias("eb")), key).withColumn("d", F.col("eb") - F.col("ea"))


P = 2**31 - 1
#: Poisson(1) by inversion: a draw below the k-th bound weighs k; beyond 8 the chance is 1e-6.
POISSON = [int(P * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(9)]


def row_number_of(*key: Column | str) -> Column:
    """A number from the content of the key, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 7), 16, 10).cast("long")


def draw(k, b, seed: int):  # noqa: ANN001, ANN201
    """A number in [0, P) for row k and resample b: two squarings modulo a prime. Columns, arrays and integers alike."""
    x = (k * 48271 + b * 69621 + seed * 16807 + 1) % P
    x = (x * x + 40692 * x + b) % P
    return (x * x + 40014 * x + k) % P


def interval(draws: DataFrame, by: list[str], value: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return draws.groupBy(*by).agg(F.count(F.lit(1)).alias("resamples"), q.alias("q")).select(*by, "resamples", E.rounded(F.element_at("q", 1)).alias("ci_low"), E.rounded(F.element_at("q", 2)).alias("ci_high"))


def paired_bootstrap(diffs: DataFrame, key: list[str], resamples: int, seed: int = 1) -> DataFrame:
    """Percentile interval of the mean difference; Poisson weights.

    Each partition adds its rows to one vector of resample sums (in whole millionths, so the order of the rows does not
    matter): what travels is `resamples` rows a partition, not rows times resamples."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.arange(1, resamples + 1, dtype=np.int64)[None, :]
        s, w = np.zeros(resamples, np.int64), np.zeros(resamples, np.int64)
        for batch in batches:
            k, d = (batch.column(i).to_numpy() for i in (0, 1))
            for lo in range(0, len(k), 64):
                weight = np.searchsorted(POISSON, draw(k[lo : lo + 64, None], at, seed), side="right")
                s += d[lo : lo + 64] @ weight
                w += weight.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(s), pa.array(w)], names=["b", "s", "w"])

    rows = diffs.select(row_number_of(*key).alias("k"), F.floor(F.col("d") * 1000000 + 0.5).cast("long").alias("d"))
    drawn = rows.mapInArrow(sums, "b long, s long, w long").groupBy("b").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    means = drawn.where("w > 0").select(E.rounded(F.col("s") / F.col("w") / 1000000, 9).alias("m"))
    return interval(means, [], "m").crossJoin(diffs.agg(E.mean("d", 6).alias("mean_diff"), F.count(F.lit(1)).alias("n_pairs")))  # one row each


def clusters(diffs: DataFrame, by: list[str]) -> DataFrame:
    """The sufficient statistics of each cluster."""
    return diffs.groupBy(*by).agg(F.sum(E.exact("d", 6)).cast("double").alias("s"), F.count(F.lit(1)).alias("n"), F.sum(E.exact(F.col("d") * F.col("d"), 6)).cast("double").alias("q"))


def cluster_bootstrap(stats: DataFrame, resamples: int, seed: int = 1) -> DataFrame:
    """G clusters drawn with replacement from G; only cluster rows are shuffled, numbered in the order of their name."""
    g = stats.count()
    numbered = stats.withColumn("i", (F.row_number().over(Window.orderBy(*[c for c in stats.columns if c not in ("s", "n", "q")])) - 1).cast("long"))
    draws = stats.sparkSession.range(1, resamples + 1).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(max(g, 1)).cast("long"))).alias("k")).withColumn("i", draw(F.col("k"), F.col("b"), seed) % F.lit(max(g, 1)))
    means = draws.join(numbered, "i").groupBy("b").agg(E.rounded(F.try_divide(F.sum(E.exact("s", 6)).cast("double"), F.sum("n").cast("double")), 9).alias("m"))
    return interval(means, [], "m").withColumn("n_clusters", F.lit(g))


def moments(stats: DataFrame) -> DataFrame:
    """Mean, iid interval and cluster-robust standard error from cluster sums."""
    n, g = F.sum("n").cast("double"), F.count(F.lit(1)).cast("double")
    one = stats.agg(n.alias("n"), g.alias("g"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    whole = stats.crossJoin(F.broadcast(one.select("n", "g", "s", "q").toDF("tn", "tg", "ts", "tq")))
    robust = whole.agg(F.first("tn").alias("n"), F.first("tg").alias("g"), F.first("ts").alias("s"), F.first("tq").alias("q"), F.sum(F.pow(F.col("s") - F.col("n") * F.col("ts") / F.col("tn"), F.lit(2.0))).alias("r"))
    se = F.sqrt((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1) / F.col("n"))
    cse = F.sqrt(F.col("g") / (F.col("g") - 1) * F.col("r")) / F.col("n")
    low, high = mean - 1.959964 * se, mean + 1.959964 * se
    changed = (low * high > 0) != ((mean - 1.959964 * cse) * (mean + 1.959964 * cse) > 0)
    return robust.select(E.rounded(mean, 4).alias("mean_diff"), E.rounded(low, 4).alias("iid_low"), E.rounded(high, 4).alias("iid_high"), E.rounded(cse / se, 3).alias("se_ratio"), changed.alias("conclusion_changed"))


def diebold_mariano(diffs: DataFrame, by: list[str], level: float = 0.05) -> DataFrame:
    """Lag-0 statistic of the loss differences of each group, with its tail probability and whether it is significant.

    Differences without any spread have no statistic and are not significant."""
    n = F.count("d").cast("double")
    s, q = F.sum(E.exact("d", 6)).cast("double"), F.sum(E.exact("d", 6) * E.exact("d", 6)).cast("double")
    out = diffs.groupBy(*by).agg(n.alias("n"), (s / n).alias("m"), F.when(n > 1, (q - s * s / n) / (n - 1)).alias("v"))
    t = F.when(F.col("v") > 0, F.col("m") / F.sqrt(F.col("v") / F.col("n")))
    p = E.rounded(E.t_tail(F.col("t"), F.col("n") - 1))
    return out.withColumn("t", t).select(
        *by, F.col("n").cast("long").alias("n"), E.rounded(F.col("m"), 4).alias("mean_diff"), E.rounded(F.col("t"), 4).alias("dm"), (F.col("n") - 1).cast("long").alias("df"), p.alias("p_value"),
        (F.col("m") < 0).alias("beats_reference"), F.coalesce(p < level, F.lit(False)).alias("is_significant"),
    )


def dm_summary(tests: DataFrame, by: list[str]) -> DataFrame:
    """Per-seed tests of a group in one row: mean and spread of the statistics, mean p and how many seeds say what."""
    n, s, q = F.count("dm").cast("double"), F.sum(E.exact("dm")).cast("double"), F.sum(E.exact("dm") * E.exact("dm")).cast("double")
    return tests.groupBy(*by).agg(
        F.min("n").alias("n_per_seed"), F.count(F.lit(1)).alias("n_seeds"), E.rounded(E.mean("dm"), 4).alias("mean_dm"), E.rounded(F.when(n > 1, F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)))), 4).alias("sd_dm"),
        E.rounded(E.mean("p_value", 6)).alias("mean_p_value"), F.count_if("beats_reference").alias("n_seeds_beating"), F.count_if("is_significant").alias("n_seeds_significant"),
    )


def cluster_diebold_mariano(diffs: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """One row a group: the lag-0 statistic beside one for each kind of cluster, whose variance adds up residuals of a
    cluster before squaring; g - 1 degrees of freedom, tail probabilities. All kinds come from one pass over cluster sums."""
    base = diebold_mariano(diffs, by).select(*by, F.col("n").alias("n_observations"), F.col("mean_diff").alias("mean_loss_diff"), F.col("dm").alias("dm_lag0_stat"), F.col("df").alias("dm_lag0_df"), F.col("p_value").alias("dm_lag0_p"))
    long = diffs.select(*by, "d", F.inline(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("member")) for c in names])))
    cells, whole = clusters(long, [*by, "kind", "member"]), Window.partitionBy(*by, "kind")
    resid = F.col("s") - F.col("n") * F.sum(E.exact("s", 6)).over(whole).cast("double") / F.sum("n").over(whole)
    g, n = F.col("g"), F.col("n")
    one = cells.withColumn("r2", E.rounded(resid * resid)).groupBy(*by, "kind").agg(F.count(F.lit(1)).cast("double").alias("g"), F.sum("n").cast("double").alias("n"), F.sum(E.exact("s", 6)).cast("double").alias("s"), F.sum(F.col("r2").cast("decimal(30,6)")).cast("double").alias("r2"))
    t = F.when((g > 1) & (F.col("r2") > 0), (F.col("s") / n) / (F.sqrt(g / (g - 1) * F.col("r2")) / n))
    one = one.withColumn("t", t).withColumn("p", E.t_tail(F.col("t"), g - 1))
    pick = lambda k, c: F.max(F.when(F.col("kind") == k, c))
    wide = one.groupBy(*by).agg(*[x for k in names for x in (E.rounded(pick(k, F.col("t")), 3).alias(f"dm_{k}_cluster_stat"), pick(k, (g - 1).cast("long")).alias(f"dm_{k}_cluster_df"), E.rounded(pick(k, F.col("p"))).alias(f"dm_{k}_cluster_p"), pick(k, g.cast("long")).alias(f"n_{k}_clusters"))])
    return base.join(wide, by)


def errors_by(errors: DataFrame, unit: str, rungs: list[str], reference: str) -> DataFrame:
    """Mean error of each rung by unit, wide, and whether the reference is better than each."""
    wide = errors.groupBy(unit).pivot("rung", rungs).agg(E.rounded(E.mean("abs_error", 6)))
    return wide.select("*", *[(F.col(reference) < F.col(r)).alias(f"reference_beats_{r}") for r in rungs if r != reference])


def support(train: DataFrame, test: DataFrame, y: str, width: float, ceiling: float) -> DataFrame:
    """Rows of both sides by band of the target, bands between the extremes included, and rows above a ceiling."""
    band = F.floor(F.col(y) / width).cast("int")
    count = lambda df, name: df.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias(name), F.count_if(F.col(y) > ceiling).alias(f"{name}_above_ceiling"))
    both = train.select(band.alias("b")).union(test.select(band.alias("b"))).agg(F.min("b").alias("lo"), F.max("b").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("band"))
    out = both.join(count(train, "train_rows"), "band", "left").join(count(test, "test_rows"), "band", "left")
    return out.select("band", (F.col("band") * width).alias("band_from"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("train_rows", "train_rows_above_ceiling", "test_rows", "test_rows_above_ceiling")])


def ranges(rows: DataFrame, by: str, y: str, prediction: str) -> DataFrame:
    """How far predictions reach compared with the target, and the means of both."""
    return rows.groupBy(by).agg(F.min(y).alias("y_min"), F.max(y).alias("y_max"), F.min(prediction).alias("prediction_min"), F.max(prediction).alias("prediction_max"), E.rounded(E.mean(y)).alias("y_mean"), E.rounded(E.mean(prediction, 6)).alias("prediction_mean"), (F.max(prediction) < F.max(y)).alias("undershoots"))


def pooled_ceilings(predictions: DataFrame, train: DataFrame, test: DataFrame, by: str, seed: str, y: str, prediction: str) -> DataFrame:
    """Per variant the extremes of all seeds' predictions against the target's range in training and test, how many
    test targets lie above all predictions, and each seed's own extremes."""
    own = predictions.groupBy(by, seed).agg(F.min(prediction).alias("lo"), F.max(prediction).alias("hi"))
    span = F.format_string("seed%s:[%.2f,%.2f]", F.col(seed).cast("string"), E.rounded(F.col("lo"), 2), E.rounded(F.col("hi"), 2))
    pooled = own.groupBy(by).agg(F.count(F.lit(1)).alias("n_seeds"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seed, span.alias("s")))), lambda x: x["s"]), ";").alias("per_seed_pred_min_max"))
    edges = train.agg(F.min(y).alias("train_lo"), F.max(y).alias("train_hi")).crossJoin(test.agg(F.min(y).alias("test_lo"), F.max(y).alias("test_hi"), F.count(F.lit(1)).alias("n_test_rows")))  # one row each
    # A row a variant meets the test rows: counts of targets above each ceiling in one pass.
    above = test.select(y).crossJoin(F.broadcast(pooled.select(by, "hi"))).groupBy(by).agg(F.count_if(F.col(y) > F.col("hi")).alias("above"))
    r, c = E.rounded, F.col
    return pooled.join(above, by).crossJoin(F.broadcast(edges)).select(
        by, "n_seeds", "n_test_rows", r(c("lo"), 4).alias("pooled_pred_min"), r(c("hi"), 4).alias("pooled_pred_max"), r(c("train_lo"), 4).alias("train_target_min"), r(c("train_hi"), 4).alias("train_target_max"), r(c("test_lo"), 4).alias("test_target_min"), r(c("test_hi"), 4).alias("test_target_max"),
        r(c("train_hi") - c("hi"), 4).alias("pred_max_below_train_max_by"), r(c("test_hi") - c("hi"), 4).alias("pred_max_below_test_max_by"), c("above").alias("n_test_actuals_above_pooled_pred_max"), E.percent(c("above"), c("n_test_rows"), 4).alias("pct_test_actuals_above_pooled_pred_max"),
        r(F.when(c("above") > 0, c("test_hi") - c("hi")).otherwise(0.0), 4).alias("max_actual_missed_by"), "per_seed_pred_min_max",
    )


def monthly_means(predictions: DataFrame, month: str, by: str, names: list[str], y: str, prediction: str, unit: str) -> DataFrame:
    """Mean target of a month beside the mean prediction of each variant, wide, with how many units it rests on."""
    wide = predictions.groupBy(month).pivot(by, names).agg(E.rounded(E.mean(prediction, 6)))
    actual = predictions.where(F.col(by) == names[0]).groupBy(month).agg(E.rounded(E.mean(y)).alias("actual_mean"), F.count_distinct(unit).alias("n_units"))
    return actual.join(wide, month).select(month, "n_units", "actual_mean", *[F.col(n).alias(f"pred_{n}_mean") for n in names])


def window_profile(rows: DataFrame, window: Column, bucket: Column, y: str) -> DataFrame:
    """Rows, target range and the realised share of each sampling bucket by window."""
    cells = rows.groupBy(window.alias("window"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("row_count"), F.min(y).alias("y_min"), F.max(y).alias("y_max"))
    return cells.withColumn("realised_fraction", E.ratio(F.col("row_count"), F.sum("row_count").over(Window.partitionBy("window"))))


def sampling_report(rows: DataFrame, window: Column, bucket: Column, y: str, seeds: dict[int, int], target: float) -> DataFrame:
    """Per window and seed (seed -> its bucket) the realised share of the window against the target share."""
    cells = window_profile(rows, window, bucket, y)
    named = reduce(lambda c, s: c.when(F.col("bucket") == s[1], s[0]), seeds.items(), F.when(F.lit(False), 0))
    whole = rows.groupBy(window.alias("window")).agg(F.count(F.lit(1)).alias("window_rows"), F.min(y).alias("target_min"), F.max(y).alias("target_max"))
    return cells.withColumn("seed", named).where("seed IS NOT NULL").join(whole, "window").select(
        "window", "seed", "bucket", F.col("row_count").alias("n_rows"), "window_rows", "target_min", "target_max", E.rounded(F.col("realised_fraction")).alias("realised_fraction"), E.rounded(F.lit(target)).alias("target_fraction"),
        E.rounded(F.lit(100.0) * (F.col("realised_fraction") / F.lit(target) - 1), 4).alias("deviation_pct"),
    )


def fold_boundaries(folds: DataFrame, rows: DataFrame, month: str) -> DataFrame:
    """First and last month, months and rows of both sides of each fold. folds: (fold, month, side)."""
    by_month = rows.groupBy(month).agg(F.count(F.lit(1)).alias("n"))
    side = lambda s, c: F.when(F.col("side") == s, F.col(c))
    parts = [x for s in ("train", "validation") for x in (F.min(side(s, month)).alias(f"{s}_start"), F.max(side(s, month)).alias(f"{s}_end"), F.count(side(s, month)).alias(f"n_{s}_months"), F.coalesce(F.sum(side(s, "n")), F.lit(0)).alias(f"n_{s}_rows"))]
    return folds.join(by_month, month, "left").groupBy("fold").agg(*parts)


def composition(base: DataFrame, other: DataFrame, gated: DataFrame, key: list[str]) -> DataFrame:
    """The improvement on all rows, on identical rows only, and the share that composition explains."""
    b, o = base.agg(E.mean("abs_error", 6).alias("base_all")), other.agg(E.mean("abs_error", 6).alias("other"))
    same = base.join(gated.select(*key).distinct(), key, "left_semi").agg(E.mean("abs_error", 6).alias("base_same"))
    out = b.crossJoin(o).crossJoin(same)  # one row each
    whole, identical = F.col("base_all") - F.col("other"), F.col("base_same") - F.col("other")
    return out.select(E.rounded(whole, 4).alias("improvement_all_rows"), E.rounded(identical, 4).alias("improvement_same_rows"), E.rounded(F.try_divide(F.lit(100.0) * (whole - identical), whole), 3).alias("composition_share_pct"))
