"""How often the queries on cell tables read what they are made from."""

import pytest
from pyspark.sql import functions as F

from starbraid import plans
from starbraid.operators import cells as X
from starbraid.plans import star_queries as Q

SF = "/root/testdata/sf0.001"


def counted(df, reads):
    """df, counting in an accumulator each time that one of its rows is made."""

    def passed(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    return df.mapInArrow(passed, df.schema)


@pytest.mark.parametrize("name", ["x1_x7_cell_panel", "x5_block_ends", "x6_excluded_labels", "x11_diagnostics"])
def test_cell_queries_make_the_panel_once(spark, monkeypatch, name):
    reads, panel = spark.sparkContext.accumulator(0), Q.price_panel
    n = panel(spark, SF).count()
    monkeypatch.setattr(Q, "price_panel", lambda *a: counted(panel(*a), reads))
    plans.QUERIES[name](spark, SF).collect()
    assert n > 0 and reads.value == n


def test_diagnostics_read_their_rows_once(spark):
    reads = spark.sparkContext.accumulator(0)
    rows = [("2023-01", "a", 5.0), ("2023-04", "a", 50.0), ("2023-04", "b", None), (None, "b", 0.5), ("2023-06", None, 7.0)]
    df = counted(spark.createDataFrame(rows, "month string, state string, price double"), reads)
    got = {r.metric: r.value for r in X.diagnostics(df, ["2023-02", "2022-12"], 1, 10).collect()}
    assert got == {"claimed_not_observed": 1, "observed_not_claimed": 2, "implausible_prices": 2, "distinct_months": 3, "distinct_units": 2}
    assert reads.value == len(rows)


def test_missing_months_read_their_rows_once(spark):
    reads = spark.sparkContext.accumulator(0)
    df = counted(spark.createDataFrame([("2023-11",), ("2024-02",), (None,), ("2024-02",)], "month string"), reads)
    assert sorted(r.month for r in X.missing_months(df, "month").collect()) == ["2023-12", "2024-01"]
    assert reads.value == 4
    empty = df.where(F.lit(False))
    assert X.missing_months(empty, "month").collect() == []
