"""Ranked lexical search by scanning documents with an automaton of all item terms; no document index is built.

Items are the queries: every distinct term of the items goes, between two blanks that guard its boundaries, into one
Aho-Corasick automaton. A document's bytes are mapped (A-Z to lower case, everything between terms to a blank), and one
pass of the automaton over them counts each item term's occurrences; the number of all terms comes from the same bytes.
That pass keeps one short row a document: its term count and the item terms found. Corpus counts are aggregates of those
rows, and a second pass turns them into scores by mapping automaton outputs to items, keeping the best K of an item inside
each task, so what is shuffled is at most K rows an item and task.

Items of any number are taken in blocks whose distinct terms hold at most BLOCK bytes (one item alone may be larger, by its
own text); the blocks' sizes are measured before use, and each block scans all documents. Only a block's terms, their
weights and item numbers are sent to tasks.

Defined results: a null or empty text, or one of separators only, has no terms, is not counted and never ranked; an item
without terms, and an item none of whose terms occurs, has no rows; items are told apart by item_id, so rows that share an
id (null too) are one item with the terms of all of them; every row of documents is a document, also with a repeated or
null doc_id; equal scores rank by doc_id, nulls first; empty tables give no rows; a text of any length is scanned whole,
with memory of a few times its own size; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, gulps, text_of

#: A term, and A-Z, the only letters that are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes as the automaton reads them: every byte that is in no term is a blank.
READ = np.array([c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)], "u1")
K = 10
#: Bytes of the terms of a block, with a term's share of the automaton.
BLOCK = 16 << 20
OVERHEAD = 64
#: Cells of the table that documents are scored in together, and candidates held before all but the best K of an item go.
CELLS = 1 << 20
HELD = 1 << 17


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once."""
    lower = F.translate("text", UPPER, LOWER)
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))).alias("term")).distinct()


def blocked(terms: DataFrame, bound: int = BLOCK) -> tuple[DataFrame, int]:
    """Terms with a block number by item; no block of several items holds more than `bound` bytes."""
    sizes = terms.groupBy("item_id").agg(F.sum(F.octet_length("term") + OVERHEAD).alias("bytes"))
    n = max(1, -(-(sizes.agg(F.sum("bytes")).first()[0] or 0) // bound))
    block = lambda: F.pmod(F.xxhash64("item_id"), F.lit(n))
    while n > 1 and (sizes.groupBy(block()).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("k")).where("k > 1").agg(F.max("b")).first()[0] or 0) > bound:
        n *= 2
    return terms.withColumn("block", block()), n


class Vocabulary:
    """The terms of a block in order, and its items as lists of term numbers."""

    def __init__(self, pairs: list[tuple[int | None, str]]):
        self.key = uuid.uuid4().hex
        self.terms = sorted({t for _, t in pairs})
        number = {t: i for i, t in enumerate(self.terms)}
        own: dict[int | None, list[int]] = {}
        for item, term in pairs:
            own.setdefault(item, []).append(number[term])
        self.items = sorted(own, key=lambda i: (i is not None, i or 0))
        self.flat = np.array([t for i in self.items for t in own[i]], np.int64)
        self.starts = np.cumsum([0, *(len(own[i]) for i in self.items)])[:-1]


built: dict[str, ahocorasick.Automaton] = {}


def automaton(v: Vocabulary) -> ahocorasick.Automaton:
    """The guarded terms of a block; a worker keeps that of one block."""
    if v.key not in built:
        built.clear()
        a = ahocorasick.Automaton()
        for i, term in enumerate(v.terms):
            a.add_word(f" {term} ", i)
        a.make_automaton()
        built[v.key] = a
    return built[v.key]


def read(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(mapped bytes of all texts end to end, where each begins and the last ends)."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return READ[np.frombuffer(texts.buffers()[2] or b"", "u1")[offsets[0] : offsets[-1]]], offsets - offsets[0]


def term_counts(mapped: np.ndarray, edges: np.ndarray) -> np.ndarray:
    inside = mapped != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = edges[:-1][edges[:-1] < edges[1:]]
    first[starts] = inside[starts]
    return np.diff(np.concatenate([[0], np.cumsum(first)])[edges])


def scanner(v: Vocabulary):  # noqa: ANN201
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, which = automaton(v), itemgetter(1)
        for batch in batches:
            at = 0
            for texts in gulps(batch.column(1)):
                mapped, edges = read(texts)
                found = [Counter(map(which, own.iter(f" {mapped[a:b].tobytes().decode()} "))) for a, b in zip(edges.tolist(), edges[1:].tolist())]
                sizes = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                lists = [pa.ListArray.from_arrays(sizes, pa.array([x for c in found for x in part(c)], pa.int32())) for part in (Counter.keys, Counter.values)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(term_counts(mapped, edges), pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])
                at += len(texts)

    return scan


def scanned(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """(doc_id, n, terms, tfs): how many terms each document has, and its item terms with their counts."""
    return text_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scanner(v), "doc_id long, n long, terms array<int>, tfs array<int>")


def weights(found: DataFrame, v: Vocabulary, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) by term number; one row a term of the block reaches the driver."""
    df = np.zeros(len(v.terms), np.int64)
    for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r[0]] = r[1]
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def best(item: np.ndarray, score: np.ndarray, absent: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Which candidates are among the best k of their item."""
    order = np.lexsort((doc, ~absent, -score, item))
    first = np.concatenate([[True], item[order][1:] != item[order][:-1]])
    rank = np.arange(len(order)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    return order[rank < k]


def scorer(v: Vocabulary, w: np.ndarray, n_docs: int, all_terms: int, k: int):  # noqa: ANN201
    """Rows of scanned() -> (item_id, doc_id, score), the best k of each item in this task."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64)]
        least = np.ones(len(v.items), np.int64)
        step = max(1, CELLS // (len(v.terms) + len(v.flat)))
        for batch in batches:
            for lo in range(0, len(batch), step):
                rows = batch.slice(lo, step)
                terms, tf = (rows.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3))
                row = np.repeat(np.arange(len(rows)), rows.column(2).value_lengths().to_numpy().astype(np.int64))
                m = 10 + np.array([90 * x * n_docs // all_terms for x in rows.column(1).to_pylist()], np.int64)
                parts = np.zeros((len(rows), len(v.terms)), np.int64)
                parts[row, terms] = w[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
                scores = np.add.reduceat(parts[:, v.flat], v.starts, axis=1)
                doc, item = np.nonzero(scores >= least)
                ids = rows.column(0)
                absent = ids.is_null().to_numpy(zero_copy_only=False)
                held = [np.concatenate(x) for x in zip(held, (item, scores[doc, item], absent[doc], ids.fill_null(0).to_numpy()[doc]))]
                if len(held[0]) > HELD + k * len(v.items):
                    keep = best(*held, k)
                    held = [x[keep] for x in held]
                    full = np.bincount(held[0], minlength=len(least)) == k
                    worst = np.full(len(least), np.iinfo(np.int64).max)
                    np.minimum.at(worst, held[0], held[1])
                    least = np.where(full, worst, 1)
        item, points, absent, doc = (x[best(*held, k)] for x in held) if len(held[0]) else held
        yield pa.RecordBatch.from_arrays([pa.array([v.items[i] for i in item.tolist()], pa.int64()), pa.array(doc, pa.int64(), mask=absent), pa.array(points, pa.int64())], names=["item_id", "doc_id", "score"])

    return score


def ranked(docs: DataFrame, items: DataFrame, k: int = K, bound: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0."""
    terms, n_blocks = blocked(cut(item_terms(items)), bound)
    schema, out = "item_id long, doc_id long, score long", []
    for b in range(n_blocks):
        v = Vocabulary([tuple(r) for r in terms.where(F.col("block") == b).select("item_id", "term").collect()])
        if not v.terms:
            continue
        found = cut(scanned(docs, v))
        n_docs, all_terms = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if n_docs:
            out.append(found.where("n > 0").mapInArrow(scorer(v, weights(found, v, n_docs), n_docs, all_terms, k), schema))
    if not out:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    # Groups of tasks rank among themselves first, so an item's last ranking reads few rows at any number of tasks.
    near = reduce(DataFrame.unionByName, out).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
c AS (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM t WHERE len(terms) > 0),
s AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM c),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM c) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f, s GROUP BY term, big_n),
p AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN w USING (term), s GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM p WHERE score > 0)
SELECT * FROM k WHERE rank <= {K}"""


def op11_automaton_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
