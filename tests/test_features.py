import pytest

from starbraid.functions import exprs as E
from starbraid.operators import cells as X
from starbraid.operators import clean as C
from starbraid.operators import features as M
from starbraid.operators import inference as I
from pyspark.sql import functions as F


def test_prior_mean_never_sees_the_jump(spark):
    rows = spark.createDataFrame([("NG-X", 20230101 + 100 * i, p) for i, p in enumerate((100.0, 100.0, 100.0, 1000.0))], "geo_key string, month_key int, price double")
    leaky = M.leaky_mean(rows, ["geo_key"], "price", "m").orderBy("month_key").collect()
    pit = M.prior_mean(rows, "geo_key", "month_key", "price", "m").orderBy("month_key").collect()
    assert leaky[2].m == 325 and pit[2].m == 100 and pit[0].m is None


def test_prior_cell_mean_is_safe_for_ties(spark):
    rows = spark.createDataFrame([(7, 8, m, t) for m, t in ((1, 300.0), (1, 300.0), (2, 300.0), (2, 300.0), (3, 3000.0), (3, 3000.0))], "z int, h int, m int, t double")
    out = {r.m: r.c for r in M.prior_cell_mean(rows, ["z", "h"], "m", "t", "c").collect()}
    assert out == {1: None, 2: 300, 3: 300}


def test_prior_encoding(spark):
    rows = spark.createDataFrame([(s, m, p) for s, ps in (("X", (100.0,) * 4), ("Y", (100.0, 100.0, 100.0, 10000.0))) for m, p in enumerate(ps, 1)], "state string, month_key int, price double")
    out = M.prior_encoding(rows, "state", "month_key", "price", 1.0, "e").where("state = 'Y' AND month_key = 3").first()
    assert out.e == 100


def test_buckets_partition_the_ids_whatever_the_order(spark):
    ids = spark.range(20000).select(F.md5(F.col("id").cast("string")).alias("trip_id"))
    a = {r.trip_id: r.b for r in ids.withColumn("b", M.bucket_of(F.col("trip_id"))).collect()}
    b = {r.trip_id: r.b for r in ids.orderBy(F.desc("trip_id")).withColumn("b", M.bucket_of(F.col("trip_id"))).collect()}
    assert a == b and set(a.values()) == set(range(17))


def test_folds_move_forward_and_need_enough_months(spark):
    rows = M.folds(spark, [3, 1, 2, 2, 4, 5], 2, 1).collect()
    for k in {r.fold for r in rows}:
        assert max(r.month_key for r in rows if (r.fold, r.side) == (k, "train")) < min(r.month_key for r in rows if (r.fold, r.side) == (k, "validation"))
    assert M.folds(spark, [1, 2], 2, 1).count() == 0


def test_overlapping_split_raises(spark):
    a, b = spark.createDataFrame([(1,), (2,), (5,)], "t int"), spark.createDataFrame([(4,), (6,)], "t int")
    with pytest.raises(M.SplitOrderError):
        M.assert_order(a, b, "t")
    with pytest.raises(M.SplitOrderError):
        M.assert_order(a.limit(0), b, "t")


@pytest.mark.parametrize(("text", "want"), [("2023-11-05", "2023-11"), ("45231", "2023-11"), ("November 2023", "2023-11"), ("Nov-23", "2023-11"), ("7/2024", "2024-07"), ("total", None), ("12345", None)])
def test_month_headers(spark, text, want):
    assert spark.createDataFrame([(text,)], "v string").select(X.parsed_month(F.col("v")).alias("m")).first().m == want


@pytest.mark.parametrize(("text", "want"), [("1,234.50", 1234.5), (" 77 ", 77.0), ("-", None), ("N/A", None)])
def test_prices(spark, text, want):
    assert spark.createDataFrame([(text,)], "v string").select(X.parsed_price(F.col("v")).alias("p")).first().p == want


def test_one_reason_a_row_and_null_never_rejects(spark):
    rows = spark.createDataFrame([(1, -1.0), (2, None), (None, -1.0)], "a int, b double")
    out = C.judged(rows, [("first", F.col("a").isNull()), ("second", F.col("b") < 0)]).collect()
    assert [r.reject_reason for r in out] == ["second", None, "first"]


def test_t_tail_matches_known_values(spark):
    rows = spark.createDataFrame([(2.228, 10.0), (0.0, 5.0), (1.96, 1e6)], "t double, df double")
    a, b, c = (r.p for r in rows.select(E.t_tail(F.col("t"), F.col("df")).alias("p")).collect())
    assert abs(a - 0.05) < 1e-4 and abs(b - 1) < 1e-9 and abs(c - 0.05) < 1e-4


def test_bootstrap_covers_the_mean_and_repeats(spark):
    rows = spark.range(400).select(F.col("id").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 10.0).alias("d"))
    one, two = I.paired_bootstrap(rows, ["k"], 200).first(), I.paired_bootstrap(rows.repartition(7), ["k"], 200).first()
    assert one.ci_low < one.mean_diff < one.ci_high
    assert abs(one.ci_low - two.ci_low) < 1e-9
