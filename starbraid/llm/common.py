"""Helpers that the training-data operators share: text access, lineage cuts and byte-level hashing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import shared_dir  # noqa: F401  read by the operators

#: Characters of the texts whose chunks are looked up together.
GULP = 4 << 20


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: a lineage cut that survives lost executors.

    Unlike checkpoint(), the last stage runs once, not twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/starbraid-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, *more) with null texts as empty strings; extra columns, whatever their names, are left behind."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def ascii_lower(text: Column) -> Column:
    """Lower-case for word matching; the Kelvin sign, the one non-ASCII letter that lowers to ASCII, is kept apart."""
    return F.lower(F.replace(text, F.lit("K"), F.lit("ĸ")))


def gulps(texts: pa.Array, size: int = GULP) -> Iterator[pa.Array]:
    """Consecutive slices of about `size` characters; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, side="right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def chunks_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct chunks between blanks, chunk number by position, chunks of each text). No text is null."""
    parts = pc.split_pattern(texts.cast(pa.large_string()), " ")
    coded = parts.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def spelled(values: list[bytes], kind: str, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values (arrays of `kind` as bytes) that `at` names, end to end, and how many entries each text has."""
    taken = pa.array(values, pa.large_binary()).take(pa.array(at))
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[: len(at) + 1]
    flat = np.frombuffer(taken.buffers()[2] or b"", "u1")[offsets[0] : offsets[-1]].view(kind)
    edges = offsets[np.concatenate([[0], np.cumsum(sizes)])]
    return flat, np.diff(edges) // flat.itemsize


def remembered(make: Callable[[str], object]) -> Callable[[str], object]:
    """One object a worker and path, kept from task to task."""
    held: dict[str, object] = {}

    def get(path: str) -> object:
        if path not in held:
            held[path] = make(path)
        return held[path]

    return get
