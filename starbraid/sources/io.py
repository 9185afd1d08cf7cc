"""Sources, sinks and provenance. Readers are lazy; only file lists and one-row summaries reach the driver."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a local session sets one of its own, once; on a cluster that is an error, since a folder of one
    machine is not seen by the others."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back, for a table that several parts of a plan read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length) of all files with content under the paths, from the listing; contents stay unread."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "length")


def located(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The Arrow file system of a listed path: local, HDFS or an object store."""
    local = re.match(r"^file:(?://)?(/.*)$", path)
    return (pa.fs.LocalFileSystem(), local[1]) if local else pa.fs.FileSystem.from_uri(path)


def by_file(files: DataFrame) -> DataFrame:
    """Listed files dealt out to tasks by path; at most 4,096 tasks."""
    return files.repartition(max(1, min(4096, files.count())), "path")


#: Bytes of a file that a task holds at a time.
BUFFER = 8 << 20


def digests(files: DataFrame) -> DataFrame:
    """(path, length, sha256) of listed files of any size: each is streamed through one task's buffer, no row holds content."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                fs, at = located(path)
                sha = hashlib.sha256()
                with fs.open_input_stream(at, compression=None) as f:
                    while data := f.read(BUFFER):
                        sha.update(data)
                out.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=["path", "length", "sha256"])

    return by_file(files).mapInArrow(digest, "path string, length long, sha256 string")


FOOTER = pa.schema([("path", pa.string()), ("row_count", pa.int64()), ("row_groups", pa.int32()), ("columns", pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())])))])


def footers(files: DataFrame) -> DataFrame:
    """(path, row_count, row_groups, columns) of Parquet files: only footers are read, in parallel tasks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                fs, at = located(path)
                with fs.open_input_file(at) as f:
                    own = pa.parquet.ParquetFile(f)
                    out.append({"path": path, "row_count": own.metadata.num_rows, "row_groups": own.metadata.num_row_groups, "columns": [{"name": c.name, "type": str(c.type)} for c in own.schema_arrow]})
            yield pa.RecordBatch.from_pylist(out, FOOTER)

    named = by_file(files.where(F.col("path").rlike(r"\.parquet$")))
    return named.mapInArrow(read, "path string, row_count long, row_groups int, columns array<struct<name: string, type: string>>")


def parquet_union(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of drifting schema, united by name whatever the letters' case, with the file each row came from.

    Footers tell which files share a schema; each such group is one scan whose columns take the name that sorts first among
    its spellings, and the scans are united. Columns that a group lacks are NULL there; widths are the widest."""
    named = footers(listed(spark, paths)).select("path", F.transform("columns", lambda c: c["name"]).alias("names"), F.transform("columns", lambda c: c["type"]).alias("types"))
    groups = named.groupBy("names", "types").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy(F.array_min("paths")).collect()  # file names only
    spelled: dict[str, str] = {}
    for name in sorted({n for g in groups for n in g["names"]}, reverse=True):
        spelled[name.lower()] = name
    parts = [spark.read.parquet(*g["paths"]).select(*[F.col(f"`{n}`").alias(spelled[n.lower()]) for n in g["names"]], F.col("_metadata.file_path").alias("source_file")) for g in groups]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def drifting(df: DataFrame, name: str, kind: str) -> DataFrame:
    """A column whose case varies from file to file, as `name`; NULL where no file has it."""
    own = next((c for c in df.columns if c.lower() == name.lower()), None)
    return df.withColumn(name, F.lit(None).cast(kind)) if own is None else df.withColumnRenamed(own, name)


def partitioned(spark: SparkSession, root: str) -> DataFrame:
    """A Hive-partitioned dataset with typed partition columns."""
    df = spark.read.parquet(root)
    return df.withColumns({c: F.col(c).cast(t) for c, t in (("year", "smallint"), ("month", "tinyint")) if c in df.columns})


def csv_typed(spark: SparkSession, path: str, types: dict[str, str], tag: tuple[str, str] | None = None) -> DataFrame:
    """A CSV read as strings, trimmed and try-cast; tag rows (column, leading mark) and blanks there go."""
    schema = ", ".join(f"`{c}` string" for c in types)
    rows = spark.read.csv(path, schema=schema, header=True, enforceSchema=False)
    if tag is not None:
        rows = rows.where(F.coalesce(F.trim(tag[0]), F.lit("")) != "").where(~F.trim(tag[0]).startswith(tag[1]))
    return rows.select(*[F.trim(c).try_cast(t).alias(c) for c, t in types.items()], F.col("_metadata.file_name").alias("source_file"))


def columnar_json(spark: SparkSession, path: str, body: str, time: str) -> DataFrame | None:
    """An object of parallel arrays as rows; None where the optional source is absent."""
    try:
        raw = spark.read.json(path, multiLine=True)
    except AnalysisException:  # an optional source: no such path, or nothing readable in it
        return None
    if body not in raw.columns:
        return None
    names = [f.name for f in raw.schema[body].dataType]
    return raw.select(F.explode(F.arrays_zip(*[F.col(f"{body}.{n}").alias(n) for n in names])).alias("r")).select(F.col(f"r.{time}").cast("date").alias("observation_date"), *[F.col(f"r.{n}").cast("double").alias(n) for n in names if n != time])


def ragged(raw: DataFrame, body: str, time: str, expected: list[str]) -> DataFrame:
    """Observed and expected length of each array of a columnar payload."""
    names = {f.name for f in raw.schema[body].dataType}
    size = F.size(f"{body}.{time}")
    rows = [F.struct(F.lit(n).alias("variable"), (F.size(f"{body}.{n}") if n in names else F.lit(None).cast("int")).alias("observed_len"), size.alias("expected_len")) for n in expected]
    return raw.select(F.inline(F.array(*rows))).select("*", (F.coalesce("observed_len", "expected_len") != F.col("expected_len")).alias("is_ragged"), F.col("observed_len").isNull().alias("is_missing"))


#: The month in a file's name, as it is published.
FILE_MONTH = r"([0-9]{4}-[0-9]{2})\.parquet"


def file_profile(rows: DataFrame, start: str, stop: str, lo: str, hi: str, file: str = "source_file") -> DataFrame:
    """Per file rows, extremes of both timestamps, rows outside the window, rows whose start is not in the month that
    the file's name states (every dated row where the name states none) and nulls."""
    low, high = F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz")
    month = F.regexp_extract(file, FILE_MONTH, 1)
    return rows.groupBy(month.alias("file_month"), F.regexp_extract(file, r"([^/=]+\.parquet)", 1).alias("source_file")).agg(
        F.count(F.lit(1)).alias("raw_rows"), F.min(start).alias("pickup_min"), F.max(start).alias("pickup_max"), F.min(stop).alias("dropoff_min"), F.max(stop).alias("dropoff_max"),
        F.count_if((F.col(start) < low) | (F.col(start) >= high)).alias("pickup_out_of_window"), F.count_if(month != E.year_month(start)).alias("pickup_month_mismatch"), F.count_if(F.col(start).isNull()).alias("null_pickup"), F.count_if(F.col(stop).isNull()).alias("null_dropoff"),
    )


def compared_counts(observed: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Observed against expected counts by key, only where they differ."""
    both = expected.join(observed, key, "left")
    status = F.when(F.col("observed").isNull(), "missing").when(F.col("observed") != F.col("expected"), "mismatch")
    return both.select(key, "expected", "observed", (F.col("observed") - F.col("expected")).alias("delta"), status.alias("status")).where("status IS NOT NULL")


def schema_drift(spark: SparkSession, paths: list[str], contract: list[str]) -> DataFrame:
    """Missing and unexpected columns of each Parquet file under the paths, whatever their case, from the footers."""
    want = F.array(*[F.lit(c.lower()) for c in sorted(contract, key=str.lower)])
    have = F.transform("columns", lambda c: F.lower(c["name"]))
    return footers(listed(spark, paths)).select(F.col("path").alias("file"), F.array_sort(F.array_except(want, have)).alias("missing"), F.array_sort(F.array_except(have, want)).alias("unexpected"), F.size("columns").alias("column_count"))


def panel_profile(rows: DataFrame, month: str, unit: str, lists: list[str] | None = None, subset: Column | None = None) -> DataFrame:
    """Units by month, whether the panel is balanced, its first and last month, the sorted distinct values of the
    columns in `lists` (dimension members, few) and the months of a subset of the rows."""
    more = [F.array_sort(F.collect_set(c)).alias(f"{c}_list") for c in lists or []]
    if subset is not None:
        own = F.when(subset, F.col(month))
        more += [F.min(own).alias("subset_first_month"), F.max(own).alias("subset_last_month"), F.count_distinct(own).alias("subset_months")]
    out = _panel_months(rows, month, unit)
    return out.join(F.broadcast(rows.agg(*more))) if more else out  # one row each


def _panel_months(rows: DataFrame, month: str, unit: str) -> DataFrame:
    months = rows.groupBy(month).agg(F.count_distinct(unit).alias("n"))
    return months.agg(F.min("n").alias("min_units"), F.max("n").alias("max_units"), (F.min("n") < F.max("n")).alias("panel_is_unbalanced"), F.min(month).alias("first_month"), F.max(month).alias("last_month"), F.count(F.lit(1)).alias("months"))


def provenance(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Name, bytes, SHA-256 and rows of each Parquet file, rows from the footers; files of any size have a digest."""
    files = listed(spark, paths)
    base = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    rows = footers(files).select("path", "row_count")
    return digests(files).join(rows, "path", "left").select(base(F.col("path")).alias("filename"), F.col("length").alias("bytes"), "sha256", F.coalesce("row_count", F.lit(0)).alias("row_count"))


def write_dataset(df: DataFrame, path: str) -> None:
    """One ZSTD Parquet dataset."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = ("year", "month")) -> None:
    """A partitioned dataset; a rerun replaces the partitions it writes and no others.

    The hash of a few columns spreads each partition over several tasks, so a hot month is not one task."""
    spread = df.repartition(*by, F.pmod(F.xxhash64(*df.columns[:3]), F.lit(8)))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)


def partition_report(spark: SparkSession, path: str, by: tuple[str, ...] = ("year", "month")) -> DataFrame:
    """(*by, row_count, bytes) of each partition of a dataset: counts from footers, bytes from the listing."""
    files = listed(spark, [path])
    part = [F.regexp_extract("path", rf"/{c}=([^/]+)/", 1).try_cast("int").alias(c) for c in by]
    rows = footers(files).select("path", "row_count").withColumnRenamed("path", "p")
    return files.join(rows, F.col("path") == F.col("p")).groupBy(*part).agg(F.sum("row_count").alias("row_count"), F.sum("length").alias("bytes"))


def rebuild_month(df: DataFrame, path: str, year: int, month: int) -> None:
    """Write one month anew from rows with year and month; the files of all other months stay untouched."""
    write_partitioned(df.where((F.col("year") == year) & (F.col("month") == month)), path)


def write_csv(outputs: dict[str, DataFrame], folder: str) -> None:
    """One CSV file set for each named output of an analysis."""
    for name, df in outputs.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def as_views(tables: dict[str, DataFrame], prefix: str) -> list[str]:
    """Named views over a layer."""
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}_{name}")
    return [f"{prefix}_{name}" for name in tables]


def inventory(spark: SparkSession, datasets: dict[str, str]) -> DataFrame:
    """Rows, bytes and bytes a row of each dataset; sizes come from the listing, not from content."""
    def one(name: str, path: str) -> DataFrame:
        size = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
        return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count")).crossJoin(size).select(F.lit(name).alias("relation"), "row_count", "bytes", E.rounded(E.ratio(F.col("bytes"), F.col("row_count"))).alias("bytes_per_row"))

    return reduce(DataFrame.unionByName, [one(n, p) for n, p in datasets.items()])
