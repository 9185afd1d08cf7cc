"""Column expressions that the operators share. All are lazy and stay inside Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

UNKNOWN = -1
DIGITS = 6


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def date_key(c: Column | str) -> Column:
    """YYYYMMDD as int; NULL stays NULL."""
    return F.date_format(col(c), "yyyyMMdd").cast("int")


def month_key(c: Column | str) -> Column:
    """YYYYMM01 as int."""
    return (F.year(col(c)) * 10000 + F.month(col(c)) * 100 + 1).cast("int")


def month_index(c: Column | str) -> Column:
    """A dense month number, year * 12 + month."""
    return (F.year(col(c)) * 12 + F.month(col(c))).cast("int")


def index_of_key(c: Column | str) -> Column:
    """month_index of a YYYYMM01 key."""
    return (F.floor(col(c) / 10000) * 12 + F.floor(col(c) / 100) % 100).cast("int")


def year_month(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def iso_dow(c: Column | str) -> Column:
    """Monday 1 ... Sunday 7."""
    return (F.weekday(col(c)) + 1).cast("int")


def exact(c: Column | str, scale: int = 4) -> Column:
    """A decimal whose sums do not depend on the order of the rows."""
    return col(c).cast(f"decimal(18,{scale})")


def total(c: Column | str, scale: int = 4) -> Column:
    return F.sum(exact(c, scale)).cast("double")


def mean(c: Column | str, scale: int = 4) -> Column:
    """Order-independent mean; NULL without values."""
    return F.try_divide(F.sum(exact(c, scale)).cast("double"), F.count(col(c)).cast("double"))


def rounded(c: Column, digits: int = DIGITS) -> Column:
    """Half-up rounding in plain double steps, so that every engine with IEEE doubles gets the same result."""
    scale = float(10**digits)
    return F.floor(c.cast("double") * scale + 0.5).cast("double") / scale


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent(a: Column, b: Column, digits: int = DIGITS) -> Column:
    return rounded(F.try_divide(F.lit(100.0) * a.cast("double"), b.cast("double")), digits)


def banded(c: Column | str, bounds: list[float], names: list[str]) -> Column:
    """The name of the first bound that c does not exceed, the last name beyond all of them; NULL for NULL."""
    out = F.when(col(c).isNull(), F.lit(None).cast("string"))
    for b, n in zip(bounds, names):
        out = out.when(col(c) <= b, F.lit(n))
    return out.otherwise(F.lit(names[-1]))


def tie_rank(order: Column, value: Column | str, partition: list[str]) -> Column:
    """Average rank of ties: rank plus half of the ties beyond the first."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*partition, col(value)))
    return F.rank().over(Window.partitionBy(*partition).orderBy(order)) + (ties - 1) / F.lit(2.0)


def safe_corr(x: Column, y: Column, least: int = 2) -> Column:
    """Pearson correlation; NULL below `least` pairs or where a side is constant (ANSI division would fail)."""
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    varies = (F.min(px) < F.max(px)) & (F.min(py) < F.max(py)) & (F.count(px) >= least)
    n = F.count(px).cast("double")
    sx, sy = F.sum(px), F.sum(py)
    top = n * F.sum(px * py) - sx * sy
    low = (n * F.sum(px * px) - sx * sx) * (n * F.sum(py * py) - sy * sy)
    return F.when(varies & (low > 0), F.try_divide(top, F.sqrt(F.greatest(low, F.lit(0.0)))))


#: Half-steps of the continued fraction of a tail probability.
TAIL_STEPS = 800


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series, eight steps up the recurrence."""
    y = x + 8
    below = reduce(lambda a, b: a * b, [x + i for i in range(8)])
    return (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - F.ln(below)


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided Student-t tail: the continued fraction of the incomplete beta function as a fold, without Python. NULL for
    NULL and for degrees of freedom of 0 or less."""
    n = F.when(df > 0, df.cast("double"))
    x0 = n / (n + t * t)
    swap = x0 > (n / 2 + 1) / (n / 2 + 2.5)
    a, b, x = F.when(swap, 0.5).otherwise(n / 2), F.when(swap, n / 2).otherwise(0.5), F.when(swap, 1 - x0).otherwise(x0)
    solid = lambda c: F.when(F.abs(c) < 1e-300, 1e-300).otherwise(c)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(F.greatest(x, F.lit(1e-300))) + b * F.ln(F.greatest(1 - x, F.lit(1e-300)))) / a
    start = F.struct(a.alias("a"), b.alias("b"), x.alias("x"), F.lit(1.0).alias("c"), (1 / solid(1 - (a + b) * x / (a + 1))).alias("d"), (1 / solid(1 - (a + b) * x / (a + 1))).alias("h"))

    def step(s: Column, k: Column) -> Column:
        m, a, b, x = F.floor((k + 1) / 2).cast("double"), s["a"], s["b"], s["x"]
        odd, even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        part = F.when(k % 2 == 1, odd).otherwise(even)
        d, c = 1 / solid(1 + part * s["d"]), solid(1 + part / s["c"])
        return F.struct(a.alias("a"), b.alias("b"), x.alias("x"), c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    tail = front * F.aggregate(F.sequence(F.lit(1), F.lit(TAIL_STEPS)), start, step, lambda s: s["h"])
    return F.when(swap, 1 - tail).otherwise(tail)


def prior(w: WindowSpec) -> WindowSpec:
    """Strictly earlier rows."""
    return w.rowsBetween(Window.unboundedPreceding, -1)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def exact_quantiles(counts: DataFrame, by: list[str], value: str, n: str, shares: list[float], blocks: int = 1024) -> DataFrame:
    """(*by, q): exact quantiles with linear interpolation, from rows (*by, value, n) of distinct values and their counts.

    Groups may be of any size: values are numbered inside blocks that keep their order (equal slices of the group's range),
    and the blocks' starts come from a table of at most `blocks` rows a group. NULL values are left out."""
    rows = counts.where(F.col(value).isNotNull())
    span = rows.groupBy(*by).agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"), F.sum(n).alias("all_"))
    same = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by])
    slice_ = F.floor(F.try_divide(F.col(value) - F.col("lo_"), F.col("hi_") - F.col("lo_")) * (blocks - 1))
    cut = rows.alias("r").join(span.alias("s"), same).select(*[F.col(f"r.{c}").alias(c) for c in by], value, F.col(n).alias("n_"), "all_", F.coalesce(slice_, F.lit(0)).cast("int").alias("block_"))
    sizes = cut.groupBy(*by, "block_").agg(F.sum("n_").alias("size_"))
    starts = sizes.withColumn("start_", F.sum("size_").over(running(Window.partitionBy(*by).orderBy("block_"))) - F.col("size_")).drop("size_")
    here = reduce(lambda a, b: a & b, [F.col(f"c.{c}").eqNullSafe(F.col(f"t.{c}")) for c in [*by, "block_"]])
    both = cut.alias("c").join(starts.alias("t"), here).select(*[F.col(f"c.{c}").alias(c) for c in [*by, "block_"]], value, "n_", "all_", "start_")
    upto = F.col("start_") + F.sum("n_").over(running(Window.partitionBy(*by, "block_").orderBy(value)))
    placed = both.withColumn("upto_", upto).withColumn("from_", F.col("upto_") - F.col("n_"))
    at = [F.lit(p) * (F.col("all_") - 1) for p in shares]
    inside = lambda r: (F.col("from_") <= r) & (r < F.col("upto_"))
    picked = [x for i, r in enumerate(at) for x in (F.max(F.when(inside(F.floor(r)), F.col(value))).alias(f"a{i}_"), F.max(F.when(inside(F.ceil(r)), F.col(value))).alias(f"b{i}_"))]
    out = placed.groupBy(*by).agg(F.max("all_").alias("all_"), *picked)
    q = [F.col(f"a{i}_") + (F.col(f"b{i}_") - F.col(f"a{i}_")) * (r - F.floor(r)) for i, r in enumerate(at)]
    return out.select(*by, F.array(*q).alias("q"))
