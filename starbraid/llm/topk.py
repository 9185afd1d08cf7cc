"""Exact top-k inner-product search as a Voronoi kNN join.

Pivots (about the square root of the rows, spread over a bounded sample) split the directions of the space into cells; every vector
goes to the pivot at the least angle. Summaries of each cell (rows, angles and norms by ring around the pivot) are all
that the driver sees; queries far from their pivot form query cells of their own. With t the angle between two pivots,
[b, c] the angles of a query cell's queries to their pivot, and a the angle of a vector x to its own pivot, any query q
of the cell is at an angle between near = max(0, t - c, b - t) and far = t + c to x's pivot, so
    |x| cos(far + a) <= q.x / |q| <= |x| cos(max(0, near - a, a - far)).
The lower bounds of whole rings give each query cell a value that its k-th neighbour reaches for certain. A vector whose
upper bound stays below that for every query cell of a group is not replicated to the group, and a query goes only to
the blocks of data cells that its own cell's bound admits. Groups are runs of near query cells, blocks runs of near data
cells; a large one is dealt to parts by hash, so no task holds a whole hot cell. Each (group part, block part) is solved
locally, and the k best of all blocks are merged by query.

Defined results: vectors that are null, empty or hold null or non-finite components, and rows without an id, take no
part; shorter vectors count as padded with zeros; ties go to the smaller vec_id; with fewer than k candidates all are
returned; an empty table gives no rows; extra columns are ignored. Scores are exact integers: double arithmetic is used
only where all sums stay below 2**53, else integers. Components and scores beyond the range of a long stop at its ends
(and then tie); tables with such norms are searched without bounds. Queries of zeros score 0 with every row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

TOP = 20
EVERY = 20
SCALE = 64
#: The driver's tables hold at most PIVOTS * PIVOTS * RINGS / WIDE routes (about 400,000) and PIVOTS * RINGS summaries,
#: whatever the rows.
PIVOTS, RINGS, WIDE = 256, 24, 4
#: Pivots are picked from a sample this many times as large.
OVER = 4
#: Rows of a data block and queries of a group.
BLOCK, GROUP = 16384, 2048
#: What angles and bounds are widened by, against rounding.
SLACK = 1e-6
LARGEST = float(2**31)

ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.c, x.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""


def vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>): the usable vectors in integer form."""
    e = F.col("embedding")
    fit = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(fit, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v")
    )


def matrix(column, width: int) -> np.ndarray:  # noqa: ANN001
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def cells(found: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add cell (the pivot at the least angle), angle (to it) and norm. pivots have length 1."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 4096):
                batch = whole.slice(lo, 4096)
                m = matrix(batch.column(1).to_pylist(), pivots.shape[1]).astype(float)
                norm = np.sqrt((m * m).sum(1))
                unit = m / np.where(norm > 0, norm, 1)[:, None]
                cell = (unit @ pivots.T).argmax(1)
                angle = np.where(norm > 0, 2 * np.arcsin(np.minimum(1, np.sqrt(((unit - pivots[cell]) ** 2).sum(1)) / 2)), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(angle), pa.array(norm)], names=["vec_id", "v", "cell", "angle", "norm"])

    return found.mapInArrow(assign, "vec_id long, v array<long>, cell int, angle double, norm double")


def spread(points: np.ndarray, n: int) -> np.ndarray:
    """n of the points, each the farthest from those before: every part of the sample has a pivot near it."""
    if len(points) <= n:
        return points
    chosen, closest = [0], points @ points[0]
    while len(chosen) < n:
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, points @ points[chosen[-1]])
    return points[chosen]


def walk(members: list[int], apart: np.ndarray) -> list[int]:
    """The cells from neighbour to neighbour."""
    left, out = np.zeros(len(apart), bool), []
    left[members] = True
    at = members[0] if members else 0
    while len(out) < len(members):
        at = int(np.where(left, apart[at], np.inf).argmin()) if out else at
        left[at] = False
        out.append(at)
    return out


def runs(order: list[int], size: dict[int, int], limit: int) -> tuple[dict[int, int], list[int]]:
    """(cell -> run, parts of each run): runs of at most `limit` rows; a larger cell is a run of several parts."""
    of, sizes = {}, []
    for c in order:
        if not sizes or sizes[-1] + size[c] > limit:
            sizes.append(0)
        of[c] = len(sizes) - 1
        sizes[-1] += size[c]
    return of, [max(1, math.ceil(n / limit)) for n in sizes]


def gaps(apart: np.ndarray, pivot: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """(near, far): how close and how far the queries of a cell can be to each pivot."""
    return np.maximum(0, np.maximum(apart[pivot] - high, low - apart[pivot]) - SLACK), apart[pivot] + high + SLACK


def sure_scores(apart: np.ndarray, rings: list[tuple], asked: list[tuple[int, float, float]], k: int) -> list[float]:
    """For each query cell a score (for queries of length 1) that k rows besides the query reach for certain.

    rings: (cell, rows, least angle, widest angle, least norm, largest norm); asked: (pivot, least angle, widest angle)."""
    cell, n, _, widest, least, most = (np.array(x) for x in zip(*rings))
    out = []
    for query_cell in asked:
        c = np.cos(np.minimum(np.pi, gaps(apart, *query_cell)[1][cell] + widest))
        low = np.where(c >= 0, least * c, most * c)
        order = np.argsort(-low, kind="stable")
        at = int(np.searchsorted(np.cumsum(n[order]), k + 1))  # one of them may be the query itself
        out.append(float(low[order[at]] - SLACK * most.max()) if at < len(order) else -math.inf)
    return out


def routes(apart: np.ndarray, rings: list[tuple], asked: list[tuple[int, float, float]], sure: list[float], group: dict[int, int], block: dict[int, int]) -> tuple[list[tuple], list[tuple]]:
    """(query cell, block) that the bounds admit, and (data cell, group, [(near, far, sure score) of its query cells])."""
    cell, _, narrow, widest, least, most = (np.array(x) for x in zip(*rings))
    to_blocks, reach = set(), {}
    for q, query_cell in enumerate(asked):
        near, far = gaps(apart, *query_cell)
        c = np.cos(np.maximum(0, np.maximum(near[cell] - widest, narrow - far[cell])))
        admits = np.unique(cell[np.where(c >= 0, most * c, least * c) >= sure[q]]).tolist()
        to_blocks.update((q, block[x]) for x in admits)
        for x in admits:
            reach.setdefault((x, group[query_cell[0]]), []).append((float(near[x]), float(far[x]), sure[q]))
    return sorted(to_blocks), [(x, g, r) for (x, g), r in sorted(reach.items())]


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    top = max(int(q.max(initial=0)), -int(q.min(initial=0))) * max(int(x.max(initial=0)), -int(x.min(initial=0))) * max(1, q.shape[1])
    if top < 2**53:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    if top < 2**63:
        return q @ x.T
    exact = q.astype(object) @ x.astype(object).T
    return np.minimum(np.maximum(exact, -(2**63)), 2**63 - 1).astype(np.int64)


def best(ids: np.ndarray, scores: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, then smaller id) of one query; ids ascend."""
    keep = ids != own
    ids, scores = ids[keep], scores[keep]
    if len(ids) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        over = np.flatnonzero(scores > edge)
        at = np.concatenate([over, np.flatnonzero(scores == edge)[: k - len(over)]])
        ids, scores = ids[at], scores[at]
    return ids, scores


def solver(k: int):  # noqa: ANN201
    def solve(part: pd.DataFrame) -> pd.DataFrame:
        q, x = part[part.is_query], part[~part.is_query].sort_values("vec_id")
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        width = max(map(len, part.v))
        ids, data, asks, own = x.vec_id.to_numpy(), matrix(x.v, width), matrix(q.v, width), q.vec_id.to_numpy()
        out = []
        for lo in range(0, len(own), 128):
            scores = products(asks[lo : lo + 128], data)
            for row, me in zip(scores, own[lo : lo + 128]):
                found, got = best(ids, row, me, k)
                out.append((np.full(len(found), me), found, got))
        return pd.DataFrame({n: np.concatenate([o[i] for o in out]).astype(np.int64) for i, n in enumerate(("query_id", "vec_id", "score"))})

    return solve


EMPTY = "query_id long, rank int, vec_id long, score long"


def replicated(rows: DataFrame, is_query: Column, k: int = TOP, pivots: int = PIVOTS, block: int = BLOCK, group: int = GROUP) -> tuple[DataFrame, DataFrame] | None:
    """(usable vectors with their cells; rows of the units of work: g, gp, b, bp, is_query, vec_id, v)."""
    spark = rows.sparkSession
    found = vectors(rows)
    shape = found.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w")).first()
    if not shape["n"]:
        return None
    wanted = min(pivots, math.isqrt(shape["n"]) + 1)
    sample = [r["v"] for r in found.orderBy(F.xxhash64("vec_id"), "vec_id").limit(OVER * wanted).collect()]
    points = matrix(sample, shape["w"]).astype(float)
    length = np.sqrt((points * points).sum(1))
    points = spread(np.unique(points[length > 0] / length[length > 0][:, None], axis=0), wanted) if (length > 0).any() else np.eye(1, shape["w"])
    held = cut(cells(found, points))
    asks = is_query & (F.col("norm") > 0)
    ring = F.floor(F.col("angle") * (RINGS / math.pi)).cast("int")
    summary = held.groupBy("cell", ring.alias("ring")).agg(
        F.count(F.lit(1)).alias("n"), F.min("angle").alias("narrow"), F.max("angle").alias("widest"), F.min("norm").alias("least"), F.max("norm").alias("most"),
        F.count_if(asks).alias("nq"), F.min(F.when(asks, F.col("angle"))).alias("q0"), F.max(F.when(asks, F.col("angle"))).alias("q1"),
    ).collect()
    rings = [(s["cell"], s["n"], s["narrow"], s["widest"], s["least"], s["most"]) for s in summary]
    size, queries, of_query = {}, {}, {}
    for s in summary:
        size[s["cell"]] = size.get(s["cell"], 0) + s["n"]
        if s["nq"]:
            queries[s["cell"]] = queries.get(s["cell"], 0) + s["nq"]
            q0, q1 = of_query.get((s["cell"], s["ring"] // WIDE), (s["q0"], s["q1"]))
            of_query[s["cell"], s["ring"] // WIDE] = (min(q0, s["q0"]), max(q1, s["q1"]))
    asked = [(c, *of_query[c, w]) for c, w in sorted(of_query)]
    apart = np.arccos(np.clip(points @ points.T, -1, 1))
    sure = sure_scores(apart, rings, asked, k)
    if max(s["most"] for s in summary) > LARGEST:
        sure = [-math.inf] * len(sure)
    of_group, group_parts = runs(walk(sorted(queries), apart), queries, group)
    of_block, block_parts = runs(walk(sorted(size), apart), size, block)
    to_blocks, to_groups = routes(apart, rings, asked, sure, of_group, of_block)
    # Both tables are bounded by PIVOTS, see above.
    cell_of, wide_of = zip(*sorted(of_query)) if of_query else ((), ())
    ways = F.broadcast(spark.createDataFrame([(cell_of[q], wide_of[q], of_group[cell_of[q]], group_parts[of_group[cell_of[q]]], b, block_parts[b]) for q, b in to_blocks], "cell int, wide int, g int, gps int, b int, bps int"))
    wants = F.broadcast(spark.createDataFrame([(c, g, group_parts[g], of_block[c], block_parts[of_block[c]], near) for c, g, near in to_groups], "cell int, g int, gps int, b int, bps int, near array<struct<near:double,far:double,score:double>>"))
    part = lambda seed, n: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = held.where(asks).withColumn("wide", F.floor(ring / WIDE).cast("int")).join(ways, ["cell", "wide"]).select("g", part(7, "gps").alias("gp"), "b", each("bps").alias("bp"), F.lit(True).alias("is_query"), "vec_id", "v")
    least = lambda w: F.greatest(F.lit(0.0), w["near"] - F.col("angle"), F.col("angle") - w["far"])
    admitted = F.exists("near", lambda w: F.col("norm") * F.cos(least(w)) >= w["score"])
    copies = held.join(wants, "cell").where(admitted).select("g", each("gps").alias("gp"), "b", part(11, "bps").alias("bp"), F.lit(False).alias("is_query"), "vec_id", "v")
    return held, own.unionByName(copies)


def search(rows: DataFrame, is_query: Column, k: int = TOP, pivots: int = PIVOTS, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score) for every usable row with is_query, against all usable rows but itself."""
    both = replicated(rows, is_query, k, pivots, block, group)
    if both is None:
        return rows.sparkSession.createDataFrame([], EMPTY)
    held, units = both
    near = units.groupBy("g", "gp", "b", "bp").applyInPandas(solver(k), "query_id long, vec_id long, score long")
    # A query of zeros scores 0 with all rows: its neighbours are the k smallest other ids.
    first = [r["vec_id"] for r in held.select("vec_id").orderBy("vec_id").limit(k + 1).collect()]
    zero = held.where(is_query & (F.col("norm") == 0)).select(F.col("vec_id").alias("query_id"), F.explode(F.lit(first).cast("array<bigint>")).alias("vec_id"), F.lit(0).cast("long").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = near.unionByName(zero.where("query_id <> vec_id")).withColumn("rank", rank.cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_voronoi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % EVERY == 0)
