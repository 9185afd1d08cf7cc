"""Panel econometrics over (unit, month, price) tables: chained indices, breaks, dispersion, pass-through, geography.

Per-unit windows partition by the unit; windows without a natural partition run only over month-level aggregates.
Logarithms are summed as decimals, so results do not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E

LOG = 12


def chained_index(prices: DataFrame, cell: list[str], category: str, base: int, gap: int = 3, least: int = 3) -> DataFrame:
    """Chained matched-model index by category, bridging up to `gap` months, next to the naive mean index.

    base is a month_index. A month with fewer than `least` matched cells breaks the chain; only the segment that holds
    the base month is published. Prices of 0 or less are left out first, so they neither report nor break a lag.
    """
    prices = prices.where("price > 0")
    own = Window.partitionBy(category, *cell).orderBy("m")
    steps = prices.withColumn("m", E.index_of_key("month_key")).withColumns({"prev": F.lag("price").over(own), "prev_m": F.lag("m").over(own)})
    matched = (F.col("prev") > 0) & (F.col("price") > 0) & (F.col("prev_m") >= F.col("m") - gap)
    months = steps.withColumn("matched", F.coalesce(matched, F.lit(False))).groupBy(category, "m", "month_key").agg(
        F.count_if("matched").alias("matched_cells"), F.count(F.lit(1)).alias("cells_reporting"),
        F.max(F.when(F.col("matched"), F.col("m") - F.col("prev_m"))).alias("longest_bridge_months"),
        E.mean(F.when(F.col("matched"), F.ln(F.col("price") / F.col("prev"))), LOG).alias("log_link"), E.mean("price").alias("mean_price"),
    )
    w = Window.partitionBy(category).orderBy("m")
    broken = months.withColumn("is_chain_break", F.col("matched_cells") < least).withColumn("chain_segment", F.sum(F.col("is_chain_break").cast("int")).over(E.running(w)))
    inside = E.running(Window.partitionBy(category, "chain_segment").orderBy("m"))
    level = broken.withColumn("log_level", F.sum(E.exact(F.when(F.col("is_chain_break"), F.lit(0.0)).otherwise(F.col("log_link")), LOG)).over(inside).cast("double"))
    whole = Window.partitionBy(category)
    at = lambda c: F.max(F.when(F.col("m") == base, F.col(c))).over(whole)
    linked = level.withColumn("is_linked_to_base", F.coalesce(F.col("chain_segment") == at("chain_segment"), F.lit(False)))
    index = F.when(F.col("is_linked_to_base"), F.lit(100.0) * F.exp(F.col("log_level") - at("log_level")))
    naive = F.try_divide(F.lit(100.0) * F.col("mean_price"), at("mean_price"))
    relative = F.when(F.col("is_linked_to_base") & ~F.col("is_chain_break"), F.exp("log_link"))
    return linked.select(
        category, "month_key", "matched_cells", "cells_reporting", "longest_bridge_months", "is_chain_break", "chain_segment", "is_linked_to_base",
        E.rounded(relative).alias("monthly_link_relative"), E.rounded(F.lit(100.0) * (relative - 1), 4).alias("pct_change_since_prior_observation"), E.rounded(index, 3).alias("chained_index"),
        E.rounded(naive).alias("naive_mean_index"), E.rounded(F.col("mean_price")).alias("naive_mean_price"), E.rounded(naive - index, 3).alias("naive_minus_chained"),
    )


def fixed_panel(prices: DataFrame, market: str, break_month: int, w: int) -> DataFrame:
    """Rows of the window break-w+1 ... break+w whose market reports in every month of it, with m and t = m - break."""
    window = prices.withColumn("m", E.index_of_key("month_key")).where(F.col("m").between(break_month - w + 1, break_month + w))
    full = window.groupBy(market).agg(F.count_distinct("m").alias("k")).where(F.col("k") == 2 * w).select(market)
    return window.join(full, market, "left_semi").withColumn("t", F.col("m") - break_month)


def structural_break(prices: DataFrame, market: str, parent: str, cell: list[str], break_month: int, w: int = 4, gap: int = 3, least: int = 3) -> DataFrame:
    """Chained index of a fixed panel of markets around a break, anchored at it, with one regression line a segment, the
    contrast of the lines, the change within cells and, on every row, the panel it rests on.

    prices: (market, its parent, the other cell columns, month_key, price); prices of 0 or less and unknown markets are left
    out before markets are chosen. Only months linked to the break's chain segment are published."""
    known = prices.where((F.col("price") > 0) & F.col(market).isNotNull())
    panel = fixed_panel(known, market, break_month, w)
    own = Window.partitionBy(market, *cell).orderBy("m")
    steps = panel.withColumns({"prev": F.lag("price").over(own), "prev_m": F.lag("m").over(own)})
    matched = F.coalesce((F.col("prev") > 0) & (F.col("prev_m") >= F.col("m") - gap), F.lit(False))
    months = steps.withColumn("matched", matched).groupBy("t", "m").agg(
        F.count_if("matched").alias("matched_cells"), F.count(F.lit(1)).alias("cells_reporting"), F.count_distinct(market).alias("markets_reporting"),
        E.mean(F.when(F.col("matched"), F.ln(F.col("price") / F.col("prev"))), LOG).alias("link"),
    )
    order, everything = Window.orderBy("t"), Window.partitionBy()  # 2 * w rows
    broken = months.withColumn("chain_segment", F.sum((F.col("matched_cells") < least).cast("int")).over(E.running(order)))
    inside = E.running(Window.partitionBy("chain_segment").orderBy("t"))
    level = F.sum(E.exact(F.when(F.col("matched_cells") >= least, F.col("link")).otherwise(F.lit(0.0)), LOG)).over(inside).cast("double")
    at = lambda c: F.max(F.when(F.col("t") == 0, F.col(c))).over(everything)
    placed = broken.withColumn("level", level).withColumns({"break_level": at("level"), "break_segment": at("chain_segment")})
    linked = placed.where("break_level IS NOT NULL AND chain_segment = break_segment")
    label = lambda c: F.format_string("%04d-%02d", F.floor((c - 1) / 12).cast("int"), ((c - 1) % 12 + 1).cast("int"))
    index = linked.select("t", label(F.col("m")).alias("year_month"), "markets_reporting", "matched_cells", "cells_reporting", E.rounded(F.lit(100.0) * F.exp(F.col("level") - F.col("break_level"))).alias("staple_index"), F.when(F.col("t") <= 0, "pre").otherwise("post").alias("segment"))
    y, t, n = E.exact("staple_index", 6), F.col("t"), F.count(F.lit(1)).cast("double")
    s = {"t": F.sum("t"), "tt": F.sum(t * t), "y": F.sum(y), "ty": F.sum(y * t), "yy": F.sum(y * y)}
    moments = index.groupBy("segment").agg(n.alias("n_"), *[c.cast("double").alias(k) for k, c in s.items()], F.count(F.lit(1)).alias("n"), F.min("year_month").alias("first"), F.max("year_month").alias("last"))
    xy, xx, vy = F.expr("n_ * ty - t * y"), F.expr("n_ * tt - t * t"), F.expr("n_ * yy - y * y")
    lines = moments.withColumn("slope", F.try_divide(xy, xx)).select("segment", "n", "first", "last", "slope", ((F.col("y") - F.col("slope") * F.col("t")) / F.col("n_")).alias("intercept"), F.try_divide(xy * xy, xx * vy).alias("r2"))
    log_price = F.ln("price")
    sides = panel.groupBy(market, *cell).agg(E.mean(F.when(F.col("t") <= 0, log_price), LOG).alias("pre"), E.mean(F.when(F.col("t") > 0, log_price), LOG).alias("post")).withColumn("change", E.rounded(F.col("post") - F.col("pre"), 9))
    grown = lambda c: E.rounded(F.lit(100.0) * (F.exp(c) - 1), 4)
    within = sides.agg(
        F.count("change").alias("cells_on_both_sides"), grown(E.mean("change", 9)).alias("within_cell_level_change_pct"),
        grown(F.percentile("change", F.lit(0.25))).alias("within_cell_change_p25_pct"), grown(F.percentile("change", F.lit(0.75))).alias("within_cell_change_p75_pct"),
    )
    side = lambda c, x: F.max(F.when(F.col("segment") == x, F.col(c)))
    contrast = lines.agg((side("slope", "post") - side("slope", "pre")).alias("slope_change"), (side("intercept", "post") - side("intercept", "pre")).alias("level_shift"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "; ")
    members = panel.select(market, parent).distinct().agg(
        F.count(F.lit(1)).alias("panel_markets"), F.count_distinct(parent).alias("panel_states"), listed(parent).alias("panel_state_list"), listed(F.concat(F.col(parent), F.lit(": "), F.col(market))).alias("panel_market_list"),
    )
    # Tables of two rows and one row each.
    out = index.join(lines, "segment").crossJoin(F.broadcast(contrast)).crossJoin(F.broadcast(within)).crossJoin(F.broadcast(members))
    r = E.rounded
    return out.select(
        "year_month", F.col("t").alias("months_since_break"), "segment", "markets_reporting", "matched_cells", "cells_reporting", r(F.col("staple_index"), 4).alias("staple_index"),
        r(F.col("slope")).alias("segment_slope_per_month"), r(F.col("intercept")).alias("segment_fitted_at_break"), r(F.col("r2")).alias("segment_r2"), F.col("n").alias("segment_n_months"), F.col("first").alias("segment_first_month"), F.col("last").alias("segment_last_month"),
        r(F.col("intercept") + F.col("slope") * F.col("t")).alias("fitted_index"), r(F.col("slope_change")).alias("slope_change_per_month"), r(F.col("level_shift")).alias("level_shift_at_break"),
        "within_cell_level_change_pct", "within_cell_change_p25_pct", "within_cell_change_p75_pct", "cells_on_both_sides", "panel_markets", "panel_states", "panel_state_list", "panel_market_list",
        F.lit(w).alias("window_months_each_side"), label(F.lit(break_month)).alias("break_month"),
    )


def dispersion(prices: DataFrame, zone: str, commodity: str, market: str, least: int = 3, lag: int = 12) -> DataFrame:
    """Spread across the markets of zone x commodity x month: prices above 0 in known zones. A market counts once,
    however many prices it reports. Thin cells stay and are flagged; the change looks `lag` rows back, which is `lag`
    months only where no month is missing."""
    stats = prices.where((F.col("price") > 0) & F.col(zone).isNotNull()).groupBy(zone, commodity, "month_key").agg(
        F.count_distinct(market).alias("reporting_markets"), F.count(F.lit(1)).alias("prices"), E.mean("price").alias("mean"), F.median("price").alias("median"), F.min("price").alias("min_price"), F.max("price").alias("max_price"),
        F.sum(E.exact("price")).cast("double").alias("s"), F.sum((E.exact("price") * E.exact("price")).cast("decimal(38,8)")).cast("double").alias("q"),
    )
    n = F.col("prices").cast("double")
    sd = F.when(n > 1, F.sqrt(F.greatest((F.col("q") - F.col("s") * F.col("s") / n) / (n - 1), F.lit(0.0))))
    cv = E.rounded(F.try_divide(sd, F.col("mean")), 4)
    base = stats.withColumns({"sd": E.rounded(sd, 4), "cv": cv})
    w = Window.partitionBy(zone, commodity).orderBy("month_key")
    return base.select(
        zone, commodity, "month_key", "reporting_markets", E.rounded(F.col("mean")).alias("mean_price"), E.rounded(F.col("median")).alias("median_price"), F.col("sd").alias("sd_price"), "min_price", "max_price",
        F.col("cv").alias("coefficient_of_variation"), E.rounded(F.try_divide(F.lit(100.0) * F.col("sd"), F.col("mean")), 3).alias("cv_pct"), E.rounded(F.try_divide(F.col("max_price"), F.col("min_price"))).alias("max_min_price_ratio"),
        (F.col("reporting_markets") >= least).alias("meets_market_threshold"), E.rounded(F.col("cv") - F.lag("cv", lag).over(w), 4).alias("cv_change_vs_12_rows_ago"),
    )


def log_changes(prices: DataFrame, cell: list[str], name: str) -> DataFrame:
    """ln(price / previous) where the month before is there, NULL elsewhere. Prices of 0 or less are left out first."""
    w = Window.partitionBy(*cell).orderBy("m")
    rows = prices.where("price > 0").withColumn("m", E.index_of_key("month_key")).withColumns({"p": F.lag("price").over(w), "pm": F.lag("m").over(w)})
    return rows.withColumn(name, F.when(F.col("pm") == F.col("m") - 1, F.ln(F.col("price") / F.col("p"))))


def pass_through(food: DataFrame, fuel: DataFrame, units: DataFrame, state: str, zone: str, commodity: str, lags: int = 3, least: int = 6) -> DataFrame:
    """Correlation of food and lagged fuel log-changes, and of their levels, by the fuel's zone and over all zones.

    Correlations are suppressed below `least` pairs; the coverage they rest on stands on every row. units: all units."""
    foods = log_changes(food, [state, commodity], "d").groupBy(state, "m").agg(E.rounded(E.mean("d", LOG), 9).alias("food"), F.count("d").alias("cells"), E.rounded(E.mean("price"), 4).alias("food_level")).where("cells > 0")
    fuels = log_changes(fuel, [state], "d").where("d IS NOT NULL").select(F.col(state).alias("fuel_state"), F.col(zone).alias("zone_"), F.col("m").alias("fuel_m"), E.rounded(F.col("d"), 9).alias("fuel"), E.rounded(F.col("price"), 4).alias("fuel_level"))
    lagged = foods.withColumn("lag_months", F.explode(F.sequence(F.lit(0), F.lit(lags))))
    pairs = lagged.join(fuels, (F.col(state) == F.col("fuel_state")) & (F.col("m") - F.col("lag_months") == F.col("fuel_m")))
    both = pairs.withColumn("z", F.explode(F.array(F.col("zone_"), F.lit("ALL ZONES"))))
    dec = lambda c: F.sum(c.cast("decimal(30,18)")).cast("double")
    low = lambda c: F.sum(c.cast("decimal(38,8)")).cast("double")
    n = F.count(F.lit(1)).cast("double")

    def parts(x: str, y: str, total, tag: str) -> list:  # noqa: ANN001
        x, y = F.col(x), F.col(y)
        return [(n * total(x * y) - total(x) * total(y)).alias(f"{tag}t"), (n * total(x * x) - total(x) * total(x)).alias(f"{tag}x"), (n * total(y * y) - total(y) * total(y)).alias(f"{tag}y")]

    sums = both.groupBy(F.col("z").alias("zone"), "lag_months").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_distinct(state).alias("n_states"), F.count_distinct("m").alias("n_months"), F.min("m").alias("first_month"), F.max("m").alias("last_month"),
        *parts("food", "fuel", dec, "d"), *parts("food_level", "fuel_level", low, "l"),
        E.rounded(F.lit(100.0) * E.mean("food", 9)).alias("mean_food_pct_change"), E.rounded(F.lit(100.0) * E.mean("fuel", 9)).alias("mean_fuel_pct_change"), E.rounded(E.mean("cells"), 3).alias("mean_matched_cells_per_pair"),
    )
    enough = F.col("n_pairs") >= least
    corr = lambda t: F.when(enough & (F.col(f"{t}x") > 0) & (F.col(f"{t}y") > 0), E.rounded(F.col(f"{t}t") / (F.sqrt(f"{t}x") * F.sqrt(f"{t}y"))))
    coverage = pairs.agg(F.count_distinct(state).alias("states_in_overlap"), F.array_join(F.array_sort(F.collect_set(state)), ", ").alias("overlap_state_list"))
    known = lambda df, name: df.where("price > 0").agg(F.count_distinct(state).alias(name))
    whole = coverage.crossJoin(known(fuel, "states_with_fuel_data")).crossJoin(known(food, "states_with_food_data")).crossJoin(units.agg(F.count(F.lit(1)).alias("federating_units_total")))  # one row each
    label = lambda c: F.format_string("%04d-%02d", F.floor((F.col(c) - 1) / 12).cast("int"), ((F.col(c) - 1) % 12 + 1).cast("int"))
    return sums.crossJoin(F.broadcast(whole)).select(
        "zone", "lag_months", "n_pairs", "n_states", "n_months", label("first_month").alias("first_food_month"), label("last_month").alias("last_food_month"), corr("d").alias("corr_log_changes"), corr("l").alias("corr_levels_spurious_prone"),
        enough.alias("meets_pair_threshold"), F.lit(least).alias("min_pairs_required"), "mean_food_pct_change", "mean_fuel_pct_change", "mean_matched_cells_per_pair", "states_in_overlap", "states_with_fuel_data", "states_with_food_data", "federating_units_total",
        E.percent(F.col("states_in_overlap"), F.col("federating_units_total"), 2).alias("pct_of_federating_units"),
        F.concat(F.lit("association, not cause; markets of "), "overlap_state_list", F.lit(" only: "), F.col("states_in_overlap").cast("string"), F.lit(" of "), F.col("federating_units_total").cast("string"), F.lit(" units")).alias("interpretation_note"),
    )


def ranked(panel: DataFrame) -> DataFrame:
    """Each state against the mean of the nation and of its zone in percent, with average-tie ranks. Means and premiums
    stay unrounded here; premium_6 and the gaps are rounded to six digits for sums that do not depend on the rows' order."""
    month, zone, own = Window.partitionBy("month_key"), Window.partitionBy("month_key", "zone"), Window.partitionBy("state").orderBy("month_key")
    avg = lambda w: F.sum(E.exact("price")).over(w).cast("double") / F.count(F.lit(1)).over(w)
    above = lambda c: F.lit(100.0) * (F.try_divide(F.col("price"), F.col(c)) - 1)
    rows = panel.withColumns({"national_mean": avg(month), "states_reporting": F.count(F.lit(1)).over(month), "zone_mean": avg(zone), "price_rank": E.tie_rank(F.desc("price"), "price", ["month_key"])})
    rows = rows.withColumns({
        "premium": above("national_mean"), "premium_zone": above("zone_mean"), "is_above": F.col("price") > F.col("national_mean"), "previous_price": F.lag("price").over(own), "previous_rank": F.lag("price_rank").over(own), "first_rank": F.first("price_rank").over(own),
    })
    gap = lambda x, y: E.rounded(F.col(x) - F.col(y))
    return rows.withColumns({"premium_6": E.rounded(F.col("premium")), "gap": gap("price", "national_mean"), "zone_gap": gap("zone_mean", "national_mean"), "gap_in_zone": gap("price", "zone_mean")})


def geography(panel: DataFrame) -> DataFrame:
    """State by month: premiums on the nation and the zone in percent, ranks, the change on the month before."""
    r = E.rounded
    return ranked(panel).select(
        "month_key", "state", "zone", r(F.col("price"), 2).alias("price"), r(F.col("national_mean"), 2).alias("national_mean"), r(F.col("premium"), 4).alias("premium_vs_national_pct"), r(F.col("zone_mean"), 2).alias("zone_mean"), r(F.col("premium_zone"), 4).alias("premium_vs_zone_pct"),
        F.col("price_rank").alias("rank_most_expensive_first"), F.col("previous_rank").alias("rank_previous_month"), F.col("is_above").alias("above_national_mean"), r(F.lit(100.0) * (F.try_divide("price", "previous_price") - 1), 4).alias("state_mom_pct"), "states_reporting",
    )


def national(panel: DataFrame) -> DataFrame:
    """Month-level spread, extremes, index, changes, rolling mean, rank correlations and the zones' share of variance."""
    rows, n = ranked(panel), F.count(F.lit(1)).cast("double")
    q = F.percentile("price", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    squares = lambda c: F.sum(E.exact(c, 6) * E.exact(c, 6)).cast("double")
    base = rows.groupBy("month_key").agg(
        F.count(F.lit(1)).alias("states_reporting"), E.mean("price").alias("mean"), q.alias("q"), F.min("price").alias("lo"), F.max("price").alias("hi"), F.sqrt(squares("gap") / n).alias("sd"),
        F.min_by("state", F.struct("price", "state")).alias("cheapest_state"), F.max_by("state", F.struct("price", "state")).alias("dearest_state"),
        E.safe_corr(F.col("price_rank"), F.col("previous_rank")).alias("rho_previous"), E.safe_corr(F.col("price_rank"), F.col("first_rank")).alias("rho_first"), F.try_divide(F.lit(100.0) * squares("zone_gap"), squares("gap")).alias("between"),
    )
    w, whole, c, r = Window.orderBy("month_key"), Window.partitionBy(), F.col, E.rounded  # one row a month
    change = lambda k: r(F.lit(100.0) * (F.try_divide(c("mean"), F.lag("mean", k).over(w)) - 1), 4)
    q1, q2, q3 = (F.element_at("q", i) for i in (1, 2, 3))
    return base.select(
        "month_key", "states_reporting", r(c("mean"), 2).alias("national_mean"), r(q2, 2).alias("national_median"), r(F.lit(100.0) * F.try_divide(c("mean"), F.first("mean").over(w)), 4).alias("index_first_month_100"), change(1).alias("mom_pct"), change(12).alias("yoy_pct"),
        r(F.avg(r(c("mean"))).over(w.rowsBetween(-2, 0)), 2).alias("rolling_3m_mean"), r(c("lo"), 2).alias("min_state_price"), "cheapest_state", r(c("hi"), 2).alias("max_state_price"), "dearest_state", r(c("hi") - c("lo"), 2).alias("range"), r(F.try_divide("hi", "lo"), 4).alias("max_min_ratio"),
        r(q1, 2).alias("p25"), r(q3, 2).alias("p75"), r(q3 - q1, 2).alias("iqr"), r(c("sd"), 4).alias("sd_population"), r(F.lit(100.0) * F.try_divide("sd", "mean"), 4).alias("cv_pct"), r(c("between"), 4).alias("zone_share_of_variance_pct"),
        r(c("rho_previous")).alias("spearman_vs_previous_month"), r(c("rho_first")).alias("spearman_vs_first_month"), (c("mean") == F.max("mean").over(whole)).alias("is_peak_month"), (c("mean") == F.min("mean").over(whole)).alias("is_trough_month"),
    )


def states(panel: DataFrame, share: float = 0.8) -> DataFrame:
    """Per state the premium on the nation in percent, the spread of its rank, the longest runs above the mean and
    at or below it (gaps and islands; 0 where none) and a persistence class."""
    rows = ranked(panel).withColumns({"m": E.index_of_key("month_key"), "side": F.when(F.col("is_above"), "above").otherwise("below")})
    island = F.col("m") - F.row_number().over(Window.partitionBy("state", "side").orderBy("m"))
    runs = rows.withColumn("island", island).groupBy("state", "side", "island").agg(F.count(F.lit(1)).alias("length"))
    longest = runs.groupBy("state").agg(*[F.coalesce(F.max(F.when(F.col("side") == s, F.col("length"))), F.lit(0)).alias(f"longest_run_{s}") for s in ("above", "below")])
    n, s, q = F.count(F.lit(1)).cast("double"), F.sum(E.exact("premium_6", 6)).cast("double"), F.sum(E.exact("premium_6", 6) * E.exact("premium_6", 6)).cast("double")
    sr, qr = F.sum(E.exact("price_rank", 1)).cast("double"), F.sum(E.exact("price_rank", 1) * E.exact("price_rank", 1)).cast("double")
    r = E.rounded
    stats = rows.groupBy("state", "zone").agg(
        F.count(F.lit(1)).alias("months"), F.count_if("is_above").alias("months_above"), r(E.mean("price")).alias("mean_price"), E.mean("premium_6", 6).alias("mean_premium"), r(F.median("premium_6"), 4).alias("median_premium_pct"),
        r(F.when(n > 1, F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)))), 4).alias("sd_premium"), r(F.min("premium_6"), 4).alias("min_premium_pct"), r(F.max("premium_6"), 4).alias("max_premium_pct"),
        r(E.mean("price_rank"), 3).alias("mean_rank"), r(F.sqrt(F.greatest((qr - sr * sr / n) / n, F.lit(0.0))), 3).alias("sd_rank"), F.min("price_rank").alias("highest_rank"), F.max("price_rank").alias("lowest_rank"),
    )
    above = F.col("months_above") / F.col("months")
    below = (F.col("months") - F.col("months_above")) / F.col("months")
    kind = F.when(above >= share, "persistent premium").when(below >= share, "persistent discount").otherwise("no persistent position")
    rank = F.rank().over(Window.orderBy(F.desc("mean_premium")))  # one row a state
    out = stats.join(longest, "state").withColumns({"premium_rank": rank, "mean_premium_pct": r(F.col("mean_premium"), 4), "months_at_or_below": F.col("months") - F.col("months_above"), "share_above": r(above, 4), "persistence": kind, "persistence_threshold_share": F.lit(float(share))})
    return out.drop("mean_premium")


def zone_months(panel: DataFrame) -> DataFrame:
    """A12d: zone means by month with their premium on the nation in percent, spread and extremes within, rank among zones
    and the mean of the monthly premiums over the whole period."""
    base = ranked(panel).groupBy("zone", "month_key").agg(
        F.count(F.lit(1)).alias("states_in_zone"), E.mean("price").alias("mean"), F.min("price").alias("lo"), F.max("price").alias("hi"), F.max("national_mean").alias("nation"), F.sqrt(F.sum(E.exact("gap_in_zone", 6) * E.exact("gap_in_zone", 6)).cast("double") / F.count(F.lit(1))).alias("sd"),
    )
    premium, r, c = F.lit(100.0) * (F.try_divide("mean", "nation") - 1), E.rounded, F.col
    base, whole = base.withColumn("premium", premium), Window.partitionBy("zone")
    return base.select(
        "zone", "month_key", "states_in_zone", r(c("mean"), 2).alias("zone_mean"), r(c("nation"), 2).alias("national_mean"), r(c("premium"), 4).alias("zone_premium_vs_national_pct"), r(F.lit(100.0) * F.try_divide("sd", "mean"), 4).alias("within_zone_cv_pct"), r(c("lo"), 2).alias("zone_min_state_price"), r(c("hi"), 2).alias("zone_max_state_price"),
        F.rank().over(Window.partitionBy("month_key").orderBy(F.desc("mean"))).alias("zone_rank_most_expensive_first"), r(F.sum(E.exact(r(c("premium")), 6)).over(whole).cast("double") / F.count(F.lit(1)).over(whole), 4).alias("zone_mean_premium_over_period_pct"),
    )


def flagged_series(panel: DataFrame, first_test: int) -> DataFrame:
    """National mean by month with the split it falls in and the change on the month before."""
    base = panel.groupBy("month_key").agg(E.rounded(E.mean("price")).alias("national_mean"), F.count(F.lit(1)).alias("n_states"))
    w = Window.orderBy("month_key")
    return base.select("*", F.when(F.col("month_key") < first_test, "train").otherwise("test").alias("window"), E.rounded(F.try_divide(F.lit(100.0) * F.col("national_mean"), F.lag("national_mean").over(w)) - 100, 4).alias("mom_pct_change"))


def dense_months(panel: DataFrame, key: str, value: str) -> DataFrame:
    """Every calendar month between the first and the last for each key; a gap shows as NULL."""
    day = F.to_date(F.col("month_key").cast("string"), "yyyyMMdd")
    span = panel.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("d"))
    grid = panel.select(key).distinct().crossJoin(F.broadcast(span.select(E.month_key("d").alias("month_key"))))
    return grid.join(panel.select(key, "month_key", value), [key, "month_key"], "left")


def pivoted(panel: DataFrame, key: str, month: int) -> DataFrame:
    """State by calendar quarter, mean price, as columns q1 ... q4 for one year."""
    rows = panel.where(F.floor(F.col("month_key") / 10000) == month).withColumn("q", F.concat(F.lit("q"), F.ceil(F.floor(F.col("month_key") / 100) % 100 / 3).cast("string")))
    return rows.groupBy(key).pivot("q", ["q1", "q2", "q3", "q4"]).agg(E.rounded(E.mean("price")))
