"""The six scenarios of a Type 2 merge."""

from pyspark.sql import functions as F

from starbraid.operators import dims as D

NATURAL, TRACKED = ["geo_code", "country", "admin_level"], ["geo_name", "parent_geo_name", "region_group"]
SCHEMA = "geo_code string, geo_name string, country string, admin_level string, parent_geo_name string, region_group string"


def members(spark, group="South West", extra=()):
    rows = [("42", "Mile 12", "Nigeria", "market", "Lagos", group), ("Lagos", "Lagos", "Nigeria", "state", "Nigeria", "South West"), ("132", "JFK Airport", "United States", "zone", "Queens", "Airports"), *extra]
    return spark.createDataFrame(rows, SCHEMA)


def merge(target, incoming, day="2026-06-01"):
    return D.scd2_merge(target, incoming, NATURAL, TRACKED, day)


def outcome(df):
    return tuple(D.merge_outcome(df).first())


def test_first_load_takes_all_members_from_the_epoch(spark):
    t = D.first_load(members(spark), NATURAL)
    assert t.count() == 4 and t.where("geo_key = -1").count() == 1
    assert t.where("valid_from = '2016-01-01' AND is_current").count() == 4


def test_idempotent_reload(spark):
    t = D.first_load(members(spark), NATURAL)
    m = merge(t, members(spark))
    assert outcome(m) == (0, 0, 4) and m.count() == 4


def test_changed_attribute_closes_and_reopens(spark):
    m = merge(D.first_load(members(spark), NATURAL), members(spark, None))
    assert outcome(m)[:2] == (0, 1)
    old, new = m.where("geo_code = '42'").orderBy("valid_from").collect()
    assert (str(old.valid_to), old.is_current) == ("2026-05-31", False) and (str(new.valid_from), new.geo_key) == ("2026-06-01", 4)


def test_successive_changes_keep_one_current_row(spark):
    t = D.first_load(members(spark), NATURAL)
    for i, g in enumerate(("a", "b", "c")):
        t = merge(t, members(spark, g), f"2026-0{6 + i}-01").drop("action")
    assert t.where("geo_code = '42'").count() == 4
    assert t.groupBy(*NATURAL).agg(F.count_if("is_current").alias("c")).where("c <> 1").count() == 0
    assert t.select("geo_key").distinct().count() == t.count()


def test_new_and_absent_members(spark):
    t = D.first_load(members(spark), NATURAL)
    m = merge(t, members(spark, extra=[("7", "New", "Nigeria", "market", None, None)]).where("geo_code <> '132'"))
    assert outcome(m)[0] == 1
    assert m.where("geo_code = '132' AND is_current").count() == 1
