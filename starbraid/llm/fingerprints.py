"""Document fingerprints by locally consistent parsing.

A text is parsed level by level. At each level runs of one symbol become one symbol, deterministic coin tossing turns
neighbouring (now different) symbols into labels 0 to 5 that still differ from their neighbours, and a phrase starts at
each local maximum of the labels. Equal phrases get equal names, and the names are the next level's symbols. Where a
phrase starts depends on a few symbols around it only, so equal substrings have the same phrases inside, wherever they
stand. The fingerprint is the minima of SKETCH hash functions over the names of the last level; the likeness of two
fingerprints is the share of equal minima, an estimate of the phrase sets' Jaccard similarity.

The next document (for the edited text) comes with the range its predecessor is in: documents are dealt to ranges of
(doc_id, hash of the text), as many as the rows ask for, and the first document of each range is copied to the range
before (the very first to the last). Spark's range partitioning of the keys alone gives the bounds; a row finds its
range in two steps of about the square root of their number. Ranges stream; none is held whole, and an id that many
documents share is spread over ranges by their texts.

Defined results: null text is empty; an empty text has the empty fingerprint, which is like itself only; documents are
ordered by doc_id (null first), then a hash of the text, so repeated rows follow each other; a lone document is its own next; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

LEVELS = 3
SKETCH = 64
#: Documents of a range, about (the driver holds one bound for each).
RANGE = 20_000
#: Characters that are parsed together.
CHUNK = 1 << 20

ORACLE_SQL = None  # hierarchical phrase names; tests hold locality and brute-force likeness

_RNG = np.random.default_rng(10)
_MULTIPLIERS = _RNG.integers(1, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _RNG.integers(0, 2**63, SKETCH, dtype=np.uint64)
_POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def tossed(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing: twice the lowest bit where a symbol differs from its left neighbour, plus that bit."""
    left = np.roll(x, 1)
    left[first] = ~x[first]
    d = x ^ left
    low = d & (~d + x.dtype.type(1))
    at = np.bitwise_count(low - x.dtype.type(1)).astype(np.uint8)
    return at * np.uint8(2) + ((x & low) != 0)


def parse(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of many texts (starts: where each begins; none is empty) -> phrase names and their starts."""
    head = np.zeros(len(x), bool)
    head[starts] = True
    begins = np.flatnonzero(head | np.concatenate([[True], x[1:] != x[:-1]]))
    run = np.diff(begins, append=len(x))
    y, first = x[begins].astype(np.uint64), head[begins]
    long = run > 1
    y[long] = mixed(y[long] + run[long].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    label = tossed(y, first)
    for _ in range(3):
        label = tossed(label, first)
    before, after = np.roll(label, 1), np.roll(label, -1)
    last = np.roll(first, -1)
    top = (label > before) & ((label > after) | last) & ~np.roll(first, 1)
    cut = np.flatnonzero(first | (top & ~first))
    inside = np.arange(len(y)) - np.repeat(cut, np.diff(cut, append=len(y)))
    names = mixed(np.add.reduceat(mixed(y + np.uint64(0x632BE59BD9B4E019)) * _POWERS[inside], cut))
    return names, np.flatnonzero(first[cut])


def fingerprints(texts: list[str], levels: int = LEVELS, sketch: int = SKETCH) -> np.ndarray:
    """A row of minima for each text; rows of empty texts are zero."""
    out = np.zeros((len(texts), sketch), np.uint32)
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK):
            size += len(texts[hi])
            hi += 1
        lengths = np.array([len(t) for t in texts[lo:hi]])
        full = np.flatnonzero(lengths)
        if len(full):
            x = np.frombuffer("".join(texts[lo:hi]).encode("utf-32-le", "surrogatepass"), "<u4")
            starts = (np.cumsum(lengths) - lengths)[full]
            for _ in range(levels):
                x, starts = parse(x, starts)
            for k in range(sketch):
                out[lo + full, k] = np.minimum.reduceat((x * _MULTIPLIERS[k] + _ADDENDS[k]) >> np.uint64(32), starts).astype(np.uint32)
        lo = hi
    return out


def text_form(minima: np.ndarray, empty: bool) -> str:
    """16 bits of each minimum in hexadecimal."""
    return "" if empty else (minima & np.uint32(0xFFFF)).astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, empty_a: bool, empty_b: bool) -> float:
    return float(empty_a and empty_b) if empty_a or empty_b else float(np.mean((a & 0xFFFF) == (b & 0xFFFF)))


def edited(text: str, following: str) -> str:
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int, str]], str]]:
    """Runs of consecutive documents with the text that follows the run. Rows come by range, copies at its end."""
    run: list[tuple[int, str]] = []
    place, closed, size = None, False, 0
    for batch in batches:
        for r, copy, doc, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
            if r != place:
                place, closed = r, False
            if copy:
                if not closed and run:
                    yield run, text
                run, closed, size = [], True, 0
                continue
            if len(run) >= 400 or size >= 4 * CHUNK:
                yield run, text
                run, size = [], 0
            run.append((doc, text))
            size += len(text)


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    for run, following in pairs(batches):
        texts = [t for _, t in run] + [following]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        own, new = fingerprints(texts), fingerprints(changed)
        rows = [
            (d, len(t), hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest(), text_form(own[i], not t), text_form(new[i], not c), likeness(own[i], new[i], not t, not c), likeness(own[i], own[i + 1], not t, not texts[i + 1]))
            for i, ((d, t), c) in enumerate(zip(run, changed))
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def range_of(key: Column, bounds: list[tuple[int | None, int]]) -> Column:
    """The number of bounds (id, tie; sorted, null ids first) up to the key: a coarse step, then one inside its stride."""
    if not bounds:
        return F.lit(0)
    stride = math.isqrt(len(bounds)) + 1
    entry = "array<struct<id:bigint,tie:bigint>>"
    coarse = F.lit([b[0] for b in bounds[::stride]]).cast("array<bigint>"), F.lit([b[1] for b in bounds[::stride]])
    fine = [bounds[i : i + stride] for i in range(0, len(bounds), stride)]
    ids, ties = F.array(*[F.lit([b[0] for b in f]).cast("array<bigint>") for f in fine]), F.array(*[F.lit([b[1] for b in f]) for f in fine])
    upto = lambda i, t: F.size(F.filter(F.arrays_zip(i.alias("id"), t.alias("tie")).cast(entry), lambda b: b <= key))
    first = upto(*coarse)
    at = F.greatest(first, F.lit(1))
    return F.when(first == 0, 0).otherwise((first - 1) * stride + upto(F.element_at(ids, at), F.element_at(ties, at)))


def with_next(docs: DataFrame, rows_a_range: int = RANGE) -> DataFrame:
    """(range, copy, doc_id, tie, text), each range sorted and closed by a copy of the document after its last."""
    flat = text_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    keys = flat.select("doc_id", "tie")
    ranges = max(1, math.ceil(keys.count() / rows_a_range))
    key = F.struct(F.col("doc_id").alias("id"), "tie")
    lows = keys.repartitionByRange(ranges, F.col("doc_id").asc_nulls_first(), "tie").groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("low")).collect()
    # One row a range: the key of its first document. Spark never splits equal keys.
    order = sorted(((r["low"]["id"], r["low"]["tie"]) for r in lows), key=lambda b: (b[0] is not None, b[0] or 0, b[1]))
    n = max(1, len(order))
    placed = flat.withColumn("range", range_of(key, order[1:]))
    if not order:
        return placed.select("range", F.lit(0).alias("copy"), "doc_id", "tie", "text")
    starts = F.broadcast(docs.sparkSession.createDataFrame([(i, *b) for i, b in enumerate(order)], "range int, first_id long, first_tie long"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie"))
    homes = F.array_compact(F.array(F.struct(F.col("range").alias("r"), F.lit(0).alias("copy")), F.when(is_first, F.struct(F.pmod(F.col("range") - 1, F.lit(n)).alias("r"), F.lit(1).alias("copy")))))
    return (
        placed.join(starts, "range")
        .select(F.explode(homes).alias("h"), "doc_id", "tie", "text")
        .select(F.col("h.r").alias("range"), "h.copy", "doc_id", "tie", "text")
        .repartition("range")
        .sortWithinPartitions("range", "copy", F.col("doc_id").asc_nulls_first(), "tie")
    )


def fingerprinted(docs: DataFrame) -> DataFrame:
    return with_next(docs).mapInArrow(
        compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def op10_consistent_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(spark.read.parquet(f"{sf_dir}/documents.parquet"))
