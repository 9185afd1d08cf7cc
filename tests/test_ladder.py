"""The search, the error store and the bounded boosting behind them."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from starbraid.operators import features as M
from starbraid.operators import ladder as L
from starbraid.operators.boosting import Size, boosted


def split(spark, months, least, block):
    out = {}
    for r in M.folds(spark, months, least, block).collect():
        out.setdefault(r.fold, {"train": [], "validation": []})[r.side].append(r.month_key)
    return out


def test_folds_only_look_forward_and_grow(spark):
    folds = split(spark, [3, 1, 2, 2, 5, 4, 10, 9, 8, 7, 6, 1], 6, 1)
    assert len(folds) == 4 and [len(f["train"]) for _, f in sorted(folds.items())] == [6, 7, 8, 9]
    for f in folds.values():
        assert max(f["train"]) < min(f["validation"]) and not set(f["train"]) & set(f["validation"]) and set(f["train"]) | set(f["validation"]) <= set(range(1, 11))
    assert split(spark, [1, 2, 3], 6, 1) == {} and len(split(spark, list(range(25)), 15, 2)) == 5


def wave(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    return x, 3 * x[:, 0] + np.where(x[:, 1] > 0.3, 2.0, -1.0) + rng.normal(size=n) * 0.05


def test_boosting_learns_a_step_and_a_slope_and_stays_inside_the_targets():
    x, y = wave(900)
    train = np.arange(900) < 700
    flat = np.abs(y[~train] - y[train].mean()).mean()
    pred, used, error = boosted(x, y, train, Size(15, 0.1, 5), 3, 150)
    assert used == 150 and error < 0.15 * flat and pred.max() < y[train].max() + 0.2
    again = boosted(x, y, train, Size(15, 0.1, 5), 3, 150)[0]
    assert (again == pred).all() and (boosted(x, y, train, Size(15, 0.1, 5), 4, 150)[0] != pred).any()


def test_missing_values_and_constant_features_are_no_obstacle():
    x, y = wave(400)
    x[::3, 0], x[:, 2] = np.nan, 7.0
    train = np.arange(400) < 300
    _, _, error = boosted(x, y, train, Size(15, 0.1, 5), 1, 100)
    assert error < np.abs(y[~train] - y[train].mean()).mean()
    x[:, 1] = np.nan
    assert np.isfinite(boosted(x[:, 1:], y, train, Size(7, 0.1, 5), 1, 10)[0]).all()
    few = np.arange(400) < 3
    assert np.allclose(boosted(x, y, few, Size(7, 0.1, 20), 1, 10)[0], y[:3].mean())


def test_early_stopping_keeps_the_best_iteration():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(300, 2)), rng.normal(size=300)  # nothing to learn
    train = np.arange(300) < 200
    _, used, error = boosted(x, y, train, Size(31, 0.3, 2), 1, 1000, 10)
    assert used < 30 and error <= np.abs(y[~train] - y[train].mean()).mean()


def panel(spark, n=30, months=20, noise=0.0):
    rng = np.random.default_rng(2)
    rows = [(f"s{s}", m, float(a := rng.normal()), float(rng.normal()), 10 + 4 * a + noise * float(rng.normal())) for s in range(n) for m in range(1, months + 1)]
    return spark.createDataFrame(rows, "state string, month_key int, a double, b double, y double")


def test_the_search_prefers_the_capacity_that_fits(spark):
    rows = panel(spark).select("state", "month_key", "y", F.array("a", "b").alias("features"))
    candidates = [Size(2, 0.01, 200), Size(15, 0.1, 5)]
    fits = L.searched(rows, M.folds(spark, list(range(1, 21)), 14, 2), ["state"], "month_key", candidates, rounds=60, patience=10)
    table = {(r.candidate, r.fold): r for r in fits.collect()}
    assert set(table) == {(c, f) for c in (0, 1) for f in (0, 1, 2)} and table[1, 2].n_train == 30 * 18 and table[1, 2].n_valid == 60
    best = {r.candidate: r for r in L.selected(fits).collect()}
    assert best[1].is_best and not best[0].is_best and best[1].n_folds_used == 3
    assert best[1].frozen_trees == max(1, (table[1, 1].best_iteration + table[1, 2].best_iteration) // 2)
    assert L.searched(rows, M.folds(spark, [1, 2], 14, 2), ["state"], "month_key", candidates).count() == 0


def test_finished_fits_are_not_made_again(spark, tmp_path):
    base = panel(spark).withColumn("is_train", F.col("month_key") <= 15)
    rows = base.select("state", "month_key", "is_train", "y", F.inline(F.array(F.struct(F.lit("V0").alias("rung"), F.array("b").alias("features")), F.struct(F.lit("V1").alias("rung"), F.array("a", "b").alias("features")))))
    sizes = {"original": (Size(7, 0.1, 5), 40), "small": (Size(3, 0.1, 5), 10)}
    path = L.store_of(spark, str(tmp_path), rows, "one")
    assert path == L.store_of(spark, str(tmp_path), rows.repartition(3), "one") != L.store_of(spark, str(tmp_path), rows.limit(10), "one")
    some = [("original", r, s) for r in ("V0", "V1") for s in (1, 2)]
    first = L.error_store(rows, some, sizes, ["state", "month_key"], path)
    assert first.count() == 4 * 30 * 5
    files = {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    every = [*some, ("original", "V1", 3), ("small", "V1", 1)]
    both = L.error_store(rows, every, sizes, ["state", "month_key"], path)
    after = {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    assert both.count() == 6 * 30 * 5 and all(after[f] == t for f, t in files.items()) and len(after) > len(files)
    assert L.error_store(rows, some[:1], sizes, ["state", "month_key"], path).count() == 30 * 5
    scores = {(r.variant, r.rung, r.seed): r.mae for r in L.scored(both).collect()}
    assert scores["original", "V1", 1] < 0.5 * scores["original", "V0", 1] and scores["original", "V1", 1] < scores["small", "V1", 1]
    assert len({scores["original", "V1", s] for s in (1, 2, 3)}) == 3
    assert all(r.abs_error == pytest.approx(abs(r.y - r.prediction)) for r in both.limit(50).collect())


def test_a_group_beyond_a_task_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE", 100)
    rows = panel(spark).select(F.lit("V0").alias("rung"), "state", "month_key", F.lit(True).alias("is_train"), "y", F.array("a").alias("features"))
    with pytest.raises(ValueError, match="more than the 100"):
        L.error_store(rows, [("v", "V0", 1)], {"v": (Size(), 1)}, ["state"], str(tmp_path / "x"))


def test_the_best_rung_leaves_the_leaky_one_and_seeds_spread(spark):
    rows = [("v", r, s, m + s) for r, m in (("V0", 100.0), ("V3a", 1.0), ("V4a", 90.0)) for s in range(1, 6)]
    results = spark.createDataFrame(rows, "variant string, rung string, seed int, mae double").withColumn("mape", F.lit(1.0))
    summary = L.repeats(results)
    row = {r.rung: r for r in summary.collect()}["V0"]
    assert (row.mae_mean, row.mae_min, row.mae_max, row.mae_first_seed, row.n_repeats, row.seeds) == (103.0, 101.0, 105.0, 101.0, 5, "1,2,3,4,5") and row.mae_sd == pytest.approx(np.std([1, 2, 3, 4, 5], ddof=1), abs=1e-4)
    assert [r.best_rung for r in L.best_rung(summary, ["V3a"]).collect()] == ["V4a"]
    assert [(r.rung_a, r.rung_b) for r in L.adjacent(summary).collect()] == [("V0", "V3a"), ("V3a", "V4a")]
