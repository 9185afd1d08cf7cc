"""Sharding by fixed virtual slots [native: DataFrame functions only].

Every record hashes into one of a fixed number of virtual slots. Bytes are summed by slot, and a small versioned map
says which shard holds which slot. Rebalancing edits that map and nothing else: records keep their slots, so only the
records of moved slots travel. Version 1 deals the slots out in turn; version 2 is version 1 edited until the shards'
bytes are as near equal as moving and swapping slots can make them. Both versions are stored; an edit starts from the
latest stored version, and records are placed by the version that is read back.

Records that are equal in id and text are counted before anything is dealt out, and dealt out again by the number of the
copy: a record hashes by id, text and that number, so a row repeated any number of times, with or without an id, is spread
over all slots like different rows. A count beyond STEP is written out by several tasks.

Defined results: null text counts as empty (size 16, CRC of no bytes); copies get the numbers 0, 1, ..., so more copies of a
row leave the slots of the earlier ones as they are; equal rows of a slot take neighbouring positions; texts of any length
are read once for their size and digests and not carried; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, text_of

SLOTS = 8192
SHARDS = 40
OVERHEAD = 16
#: Copies of a row that one task writes out.
STEP = 1 << 16
#: Editing stops when the heaviest and the lightest shard differ by this share of the mean, or no edit helps.
TOLERANCE = 0.0005

ORACLE_SQL = None  # the map is a balancing search; tests hold the laws of the result instead


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every row; equal rows meet as counts only."""
    text = F.col("text")
    own = text_of(docs).select("doc_id", (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    counts = own.groupBy("doc_id", "size", "text_crc32", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    step = F.lit(STEP).cast("long")
    few = counts.where(F.col("copies") <= step).select("*", upto(F.col("copies")).alias("copy"))
    parts = counts.where(F.col("copies") > step).select("*", upto(F.ceil(F.col("copies") / step)).alias("part")).repartition("doc_id", "text_hash", "part")
    many = parts.select("*", upto(F.least(step, F.col("copies") - F.col("part") * step)).alias("at")).select(*counts.columns, (F.col("part") * step + F.col("at")).alias("copy"))
    slot = F.pmod(F.xxhash64("doc_id", "text_hash", "copy"), F.lit(slots)).cast("int")
    return few.unionByName(many).select("doc_id", "size", "text_crc32", slot.alias("virtual_slot"))


def slot_weights(sized: DataFrame) -> dict[int, tuple[int, int]]:
    """slot -> (bytes, rows); at most one entry a slot, so the driver holds a bounded table."""
    rows = sized.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return {r["virtual_slot"]: (r["b"], r["n"]) for r in rows}


def first_map(slots: int, shards: int) -> list[int]:
    """Version 1: slots dealt out in turn."""
    return [s % shards for s in range(slots)]


def rebalance(held: list[int], weights: dict[int, tuple[int, int]], shards: int) -> list[int]:
    """The next version of the map: move a slot, or swap two, between the heaviest shard and a lighter one.

    Each edit lowers the larger of two loads, so the search ends; all its input is the bounded slot table.
    """
    out = list(held)
    load = [0] * shards
    own: list[dict[int, int]] = [{} for _ in range(shards)]
    for s, shard in enumerate(out):
        w = weights.get(s, (0, 0))[0]
        if w:
            load[shard] += w
            own[shard][s] = w
    least = max(1.0, TOLERANCE * sum(load) / shards)
    while max(load) - min(load) > least:
        top = max(range(shards), key=lambda i: (load[i], -i))
        best = None
        for low in sorted(range(shards), key=lambda i: (load[i], i))[:4]:
            gap = load[top] - load[low]
            if gap < 2:
                continue
            moves = [(abs(gap - 2 * w), s, -1) for s, w in own[top].items() if 0 < w < gap]
            if own[low]:
                theirs = sorted((w, s) for s, w in own[low].items())
                for s, w in own[top].items():
                    lo, hi = 0, len(theirs)
                    while lo < hi:
                        mid = (lo + hi) // 2
                        lo, hi = (mid + 1, hi) if theirs[mid][0] < w - gap / 2 else (lo, mid)
                    moves += [(abs(gap - 2 * (w - v)), s, t) for v, t in theirs[max(lo - 1, 0) : lo + 1] if 0 < w - v < gap]
            if moves and (best is None or min(moves) < best[0]):
                best = (min(moves), low)
        if best is None:
            break
        (_, s, t), low = best
        for slot, a, b in ((s, top, low), (t, low, top)):
            if slot >= 0:
                w = own[a].pop(slot)
                own[b][slot] = w
                load[a] -= w
                load[b] += w
                out[slot] = b
    return out


def save_map(spark: SparkSession, held: list[int], version: int, path: str) -> None:
    """Store one version of the map as (version, virtual_slot, shard); older versions stay readable."""
    rows = spark.range(len(held)).select(F.col("id").cast("int").alias("virtual_slot"), F.element_at(F.lit(held), (F.col("id") + 1).cast("int")).alias("shard"))
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]]:
    """(version, the shard of each slot) of one version, or of the latest; at most one row a slot."""
    rows = spark.read.parquet(path)
    last = rows.agg(F.max("version")).first()[0] if version is None else version
    return last, [r["shard"] for r in rows.where(F.col("version") == last).orderBy("virtual_slot").collect()]


def edited(spark: SparkSession, path: str, weights: dict[int, tuple[int, int]], shards: int) -> int:
    """Rebalance the latest stored version by the slots' bytes and store the result as the next one; its version.

    A map that is even enough stays as it is, without a new version."""
    version, held = load_map(spark, path)
    after = rebalance(held, weights, shards)
    if after == held:
        return version
    save_map(spark, after, version + 1, path)
    return version + 1


def place(sized: DataFrame, held: list[int], weights: dict[int, tuple[int, int]]) -> DataFrame:
    """Add shard and slot (a gapless position in the shard): rows are numbered inside their virtual slot only, and the
    start of each virtual slot inside its shard comes from the slot table, so no task ever sees a whole shard."""
    start, filled = [0] * len(held), {}
    for s, shard in enumerate(held):
        start[s] = filled.get(shard, 0)
        filled[shard] = start[s] + weights.get(s, (0, 0))[1]
    at = (F.col("virtual_slot") + 1).cast("int")
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return sized.select(
        "*",
        F.element_at(F.lit(held), at).cast("int").alias("shard"),
        (F.element_at(F.array(*map(F.lit, start[:1])) if len(start) == 1 else F.lit(start), at) + F.row_number().over(inside) - 1).cast("long").alias("slot"),
    )


def sharded(docs: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Every record with its shard by the latest map stored at path; the map is made (version 1) or edited first."""
    spark = docs.sparkSession
    sized = slotted(docs, slots)
    weights = slot_weights(sized)
    try:
        load_map(spark, path)
    except AnalysisException:  # no map yet
        save_map(spark, first_map(slots, shards), 1, path)
    version, held = load_map(spark, path, edited(spark, path, weights, shards))
    return place(sized, held, weights).withColumn("map_version", F.lit(version))


def op6_virtual_slots(spark: SparkSession, sf_dir: str, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = sharded(docs, f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}", shards, slots)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
