"""Cell tables (file, sheet, row, col, value string) to panels, as joins and windows over all sheets at once."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import written

SHEET = ["file", "sheet"]
# Month names by number.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


NAMED = r"(?i)\b(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b[\s,._/-]*'?(\d{2}|\d{4})\b"


def header_rows(cells: DataFrame, prefix: str = "state", scan_rows: int = 25, scan_cols: int = 4, variants: DataFrame | None = None) -> DataFrame:
    """The first of the leading rows with a cell in its first columns that starts with the prefix; without one, and
    with variants (see resolved), the row before the first whose first cell names a known unit; else NULL."""
    hit = (F.col("row") <= scan_rows) & (F.col("col") <= scan_cols) & F.lower(F.trim("value")).startswith(prefix)
    found = cells.groupBy(*SHEET).agg(F.min(F.when(hit, F.col("row"))).alias("header_row"))
    if variants is None:
        return found
    labels = resolved(cells.where((F.col("row") <= scan_rows) & (F.col("col") == 1)), "value", variants, [])
    known = labels.where("state IS NOT NULL").groupBy(*SHEET).agg(F.greatest(F.min("row") - 1, F.lit(1)).alias("before_"))
    return found.join(known, SHEET, "left").select(*SHEET, F.coalesce("header_row", "before_").alias("header_row"))


def unread_sheets(cells: DataFrame, variants: DataFrame) -> DataFrame:
    """The sheets in which no header row is found, with their cells: what panel() leaves out."""
    head = header_rows(cells, variants=variants).where("header_row IS NULL")
    return cells.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n_cells")).join(head.select(*SHEET), SHEET)


def parsed_month(value: Column, years: tuple[int, int] = (2000, 2100)) -> Column:
    """X2: 'YYYY-MM' of a cell that is an Excel serial number or holds, anywhere, a month's name and a year ("Price
    November 2023", "Nov. 2023", "Nov'23": two digits are of this century), 'yyyy-mm' or 'mm/yyyy' within the years;
    in this order; else NULL."""
    v = F.trim(value)
    serial = F.when(v.rlike(r"^\d{5}(\.0+)?$"), F.regexp_extract(v, r"^(\d{5})", 1).cast("int"))
    excel = F.when(serial.between(40000, 60000), F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), serial), "yyyy-MM"))
    name, year = F.regexp_extract(v, NAMED, 1), F.regexp_extract(v, NAMED, 2)
    number = F.array_position(F.lit(MONTHS), F.lower(F.substring(name, 1, 3))).cast("int")
    named = F.when(name != "", F.concat(F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year), F.lit("-"), F.lpad(number.cast("string"), 2, "0")))

    def numeric(pattern: str, y: int, m: int) -> Column:
        year, month = (F.regexp_extract(v, pattern, g).try_cast("int") for g in (y, m))
        return F.when(year.between(*years) & month.between(1, 12), F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0")))

    return F.coalesce(excel, named, numeric(r"\b(\d{4})[-/](\d{1,2})\b", 1, 2), numeric(r"\b(\d{1,2})[-/](\d{4})\b", 2, 1))


def parsed_price(value: Column) -> Column:
    """The first number after commas and blanks are gone; dashes and n/a are NULL."""
    v = F.regexp_replace(value, r"[,\s]", "")
    return F.when(~F.lower(v).isin("", "-", "--", "n/a", "na"), F.regexp_extract(v, r"-?\d+(\.\d+)?", 0).try_cast("double"))


def accents() -> tuple[str, str]:
    """Lower-case Latin letters with marks and the letters below them, by Unicode decomposition, then the marks alone
    (which have no counterpart: translate() drops them)."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    plain = [(c, d[0]) for c, d in pairs if c == c.lower() and d[0].isascii() and all(map(unicodedata.combining, d[1:]))]
    return "".join(c for c, _ in plain) + "".join(map(chr, range(0x300, 0x370))), "".join(d for _, d in plain)


def normalised(label: Column) -> Column:
    """Accents off, lower case, blanks collapsed, ' state' and outer blanks and punctuation (.,;:-) dropped."""
    plain = F.translate(F.lower(label), *accents())
    return F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(plain, r"[\s\x{A0}]+", " ")), r" state$", ""), r"^[ .,;:-]+|[ .,;:-]+$", "")


def resolved(cells: DataFrame, label: str, variants: DataFrame, aggregates: list[str]) -> DataFrame:
    """Canonical name through a small variants table (variant, canonical, zone), as it is or with blanks for
    hyphens; aggregate labels resolve to NULL."""
    rows = cells.withColumn("norm_", normalised(F.col(label)))
    loose = variants.select(F.col("variant").alias("loose_"), F.col("canonical").alias("canonical2_"), F.col("zone").alias("zone2_"))
    out = rows.join(variants.withColumnRenamed("variant", "norm_"), "norm_", "left").join(loose, F.replace("norm_", F.lit("-"), F.lit(" ")) == F.col("loose_"), "left")
    agg = F.col("norm_").isin(aggregates)
    name, zone = F.coalesce("canonical", "canonical2_"), F.when(F.col("canonical").isNotNull(), F.col("zone")).otherwise(F.col("zone2_"))
    return out.withColumns({"is_aggregate_label": agg, "state": F.when(~agg, name), "zone": F.when(~agg, zone)}).drop("norm_", "canonical", "loose_", "canonical2_", "zone2_")


def canonical_map(rows: DataFrame, label: str, variants: DataFrame, aggregates: list[str]) -> DataFrame:
    """(label, state, is_aggregate_label) of the distinct labels only; users join it back."""
    return resolved(rows.select(label).distinct(), label, variants, aggregates).select(label, "state", "is_aggregate_label")


def block_ends(body: DataFrame, banner: str) -> DataFrame:
    """Per sheet the first row that repeats an earlier state or holds a banner, with what triggered it.

    body: (file, sheet, row, label, state)."""
    nth = F.row_number().over(Window.partitionBy(*SHEET, "state").orderBy("row"))
    marked = body.withColumn("stop_", (F.col("state").isNotNull() & (nth > 1)) | F.lower("label").startswith(banner))
    return marked.where("stop_").groupBy(*SHEET).agg(F.min("row").alias("stop_row"), F.min_by("label", "row").alias("trigger_label"))


def panel(cells: DataFrame, variants: DataFrame, aggregates: list[str], banner: str = "note", years: tuple[int, int] = (2000, 2100)) -> DataFrame:
    """(month, state, price, file, sheet, is_current_month) of every sheet's first block."""
    head = header_rows(cells, variants=variants)
    at = cells.join(head, SHEET).where("header_row IS NOT NULL")
    months = at.where("row = header_row").select(*SHEET, "col", parsed_month(F.col("value"), years).alias("month")).where("month IS NOT NULL")
    labels = resolved(at.where("row > header_row AND col = 1").select(*SHEET, "row", F.col("value").alias("label")), "label", variants, aggregates)
    stop = block_ends(labels, banner)
    kept = labels.join(stop, SHEET, "left").where(F.col("stop_row").isNull() | (F.col("row") < F.col("stop_row"))).where("state IS NOT NULL").select(*SHEET, "row", "state")
    body = at.where("row > header_row AND col > 1").select(*SHEET, "row", "col", parsed_price(F.col("value")).alias("price"))
    current = F.max("month").over(Window.partitionBy(*SHEET))
    months = months.withColumn("is_current_month", F.col("month") == current)
    return body.join(kept, [*SHEET, "row"]).join(months, [*SHEET, "col"]).select("month", "state", "price", *SHEET, "is_current_month")


def excluded_labels(labels: DataFrame) -> DataFrame:
    """Unresolved labels counted, not dropped silently."""
    return labels.where("state IS NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def deduplicated(panel_rows: DataFrame) -> DataFrame:
    """One row a (month, state): the sheet's current month first, then the latest file."""
    n = F.row_number().over(Window.partitionBy("month", "state").orderBy(F.desc("is_current_month"), F.desc("file"), F.desc("sheet")))
    return panel_rows.withColumn("n_", n).where("n_ = 1").drop("n_")


def missing_months(rows: DataFrame, month: str) -> DataFrame:
    """Months between the first and the last that do not occur ('YYYY-MM')."""
    day = F.to_date(F.concat(F.col(month), F.lit("-01")))
    every = F.transform(F.sequence(F.min(day), F.max(day), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))
    found = rows.select(month).distinct().agg(F.array_except(every, F.collect_set(month)).alias("m_"))  # a value a month
    return found.select(F.explode("m_").alias(month))


def diagnostics(panel_rows: DataFrame, claimed_gaps: list[str], lo: float, hi: float) -> DataFrame:
    """X11: (metric, value): gaps claimed but not observed and the reverse, implausible prices, months and units."""
    panel_rows = written(panel_rows.select("month", "state", "price"))  # the gaps and the counts read it
    observed = missing_months(panel_rows.select("month"), "month").agg(F.collect_set("month").alias("o"))
    claimed = F.lit(claimed_gaps).cast("array<string>")
    stats = panel_rows.agg(F.count_if((F.col("price") < lo) | (F.col("price") > hi)).alias("bad"), F.count_distinct("month").alias("months"), F.count_distinct("state").alias("units"))
    one = observed.crossJoin(stats)  # one row each
    pairs = [("claimed_not_observed", F.size(F.array_except(claimed, "o"))), ("observed_not_claimed", F.size(F.array_except(F.col("o"), claimed))), ("implausible_prices", F.col("bad")), ("distinct_months", F.col("months")), ("distinct_units", F.col("units"))]
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("long").alias("value")) for n, c in pairs])))
