"""Near-duplicate detection by MinHash: many universal hash minima with banding, signature verification, an exact check
on full shingle sets, and connected components by alternating large-star and small-star.

1. Each document becomes its set of five-word shingles (64-bit hashes), BANDS * ROWS minima and one key for each band.
2. Documents with equal sets form a class; only its smallest id goes on, so copies never meet each other again.
3. In each bucket (equal band key) every member is paired with the smallest member: as many pairs as members, however
   large the bucket. Pairs pass the signature test, then the exact test on full sets; components of these links follow.
4. Only links between different components can still change the result. In the buckets that hold more than one
   component, all pairs across components are tested, in blocks of about BLOCK members, each pair in the first bucket
   that it shares: by signature, then on full sets. A component of BLOCK members or more has blocks of its own, which
   never meet each other; smaller ones share blocks. Only links leave the task, and are joined to the components.
So the only links that can be missed are those of documents that share no bucket or differ in more minima than chance
allows: at similarity 0.75 about (1 - 0.75 ** ROWS) ** BANDS and a normal tail, five in a million each; far fewer above.
The exact way (exact=True) is the same job with other buckets: a set of n shingles is in one bucket for each of its
n - ceil(0.75 n) + 1 smallest shingle hashes, of which two sets of similarity 0.75 share at least one; no signature test.

Defined results: null or blank text has no shingles and is linked with nothing; one to four words are one shingle; rows
without an id are linked with nothing (component null, kept); rows that share an id are one document whose texts both
count; of equally near documents none is preferred, the smallest id names them all; texts of any length are shingled whole
(a set takes 8 bytes a shingle); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, text_of

WIDTH = 5
PERCENT = 75
BANDS, ROWS = 32, 4
#: A pair goes on if this share of its minima is equal: 0.75 less more than four standard deviations.
SIGNATURE = 0.58
BLOCK = 512
REMEMBERED = 200_000

ORACLE_SQL = None  # transitive closure over a similarity join; tests hold it against brute force

_RNG = np.random.default_rng(3)
_A = (_RNG.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)[:, None]
_ODD = _RNG.integers(0, 2**63, max(WIDTH, ROWS) + BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = WordHash()


def tidy() -> None:
    """At a task's end: a worker serves other operators next, so it gives back what it remembered."""
    _WORDS.clear()
    pa.default_memory_pool().release_unused()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes: bytes.lower() and bytes.split() touch A-Z and the six ASCII blanks only."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    x = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        x = mixed(x + h[i : len(h) - n + 1 + i] * _ODD[i])
    return np.unique(x)


def minima(sets: np.ndarray) -> np.ndarray:
    x = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 2048):
        np.minimum(out, (_A * x[None, lo : lo + 2048] + _B).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys of (documents, BANDS * ROWS) minima."""
    m = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(_ODD[-BANDS:], (len(sig), BANDS)).copy()
    for i in range(ROWS):
        out = mixed(out + (m[:, :, i] + np.uint64(1)) * _ODD[i])
    return out.view(np.int64)


def prefix(s: np.ndarray) -> np.ndarray:
    """The least hashes of a sorted set, one of which every set of enough similarity shares."""
    return s[: len(s) - (PERCENT * len(s) + 99) // 100 + 1].view(np.int64) if len(s) else s.view(np.int64)


def sketch(batches: Iterator[pa.RecordBatch], exact: bool = False) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_shingles, k1, k2, sig, bands): k1, k2 name the set; sig holds the low byte of each minimum."""
    for batch in batches:
        n, k1, k2, sig, heads = [], [], [], np.zeros((len(batch), BANDS * ROWS), np.uint32), []
        for i, text in enumerate(batch.column(1).to_pylist()):
            s = shingles(text)
            n.append(len(s))
            k1.append(int(mixed(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
            k2.append(int(mixed(s * _ODD[0] + _ODD[1]).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
            if len(s) and not exact:
                sig[i] = minima(s)
            if exact:
                heads.append(prefix(s))
        keys = np.concatenate([*heads, np.zeros(0, np.int64)]) if exact else band_keys(sig)
        at = pa.array(np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32) if exact else np.arange(len(n) + 1, dtype=np.int32) * BANDS)
        low = (sig & np.uint32(0xFF)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array([r.tobytes() for r in low], pa.binary()), pa.ListArray.from_arrays(at, pa.array(keys.ravel()))],
            names=["doc_id", "n_shingles", "k1", "k2", "sig", "bands"],
        )
    tidy()


def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, s, raw): the sorted set of 64-bit shingle hashes, as an array and as bytes."""
    for batch in batches:
        sets = [shingles(t) for t in batch.column(1).to_pylist()]
        at = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "s", "raw"])
    tidy()


def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The signature test of pairs (a, b, sig_a, sig_b)."""
    for batch in batches:
        if len(batch):
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(len(batch), -1) for i in (2, 3))
            yield batch.filter(pa.array((x == y).mean(axis=1) >= SIGNATURE)).select(["a", "b"])


def across(batches: Iterator[pa.RecordBatch], signature: float = SIGNATURE) -> Iterator[pa.RecordBatch]:
    """Rows (band, i, j, side, id, root, sig, bands, raw) sorted by (band, i, j) -> links across components.

    side 0 is block i, side 1 block j (none where i = j). A pair is tested in the first band that it shares: signature,
    then the full sets, by exact counts. A link joins its components at once, so further pairs between them need no test."""

    def solve(group: list[tuple]) -> list[tuple[int, int]]:
        left = [g for g in group if g[3] == 0]
        right = [g for g in group if g[3] == 1] or left
        band, out, parent = group[0][0], [], {g[5]: g[5] for g in group}

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        ids = np.array([g[4] for g in right])
        sigs, bands = np.frombuffer(b"".join(g[6] for g in right), np.uint8).reshape(len(right), -1), np.array([g[7] for g in right])
        sets = [np.frombuffer(g[8], np.uint64) for g in right]
        for k, (_, _, _, _, me, root, sig, own_bands, raw) in enumerate(left):
            roots = np.array([top(g[5]) for g in right])
            at = np.flatnonzero((roots != top(root)) & (np.arange(len(ids)) > k if right is left else ids != me))
            like = (sigs[at] == np.frombuffer(sig, np.uint8)).mean(axis=1)
            at, like = at[like >= signature], like[like >= signature]
            if len(at):
                first = bands[at, (bands[at] == np.array(own_bands)).argmax(axis=1)] == band
                at, like = at[first], like[first]
            mine = np.frombuffer(raw, np.uint64)
            for x in at[np.argsort(-like, kind="stable")]:
                if top(right[x][5]) == top(root):
                    continue
                both, total = len(np.intersect1d(mine, sets[x], assume_unique=True)), len(mine) + len(sets[x])
                if 100 * both >= PERCENT * (total - both):
                    out.append((min(me, int(ids[x])), max(me, int(ids[x]))))
                    parent[top(right[x][5])] = top(root)
        return out

    held: list[tuple] = []
    for batch in batches:
        found: list[tuple[int, int]] = []
        for row in zip(*(batch.column(i).to_pylist() for i in range(9))):
            if held and row[:3] != held[0][:3]:
                found += solve(held)
                held = []
            held.append(row)
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])
    if held:
        found = solve(held)
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= PERCENT * union, on full sets."""
    one, two = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    both = pairs.join(one, "a").join(two, "b")
    return both.where(100 * common >= PERCENT * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of the component.

    Alternating large-star and small-star until the edges stand still; each round is written to the shared folder.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = (e.select("a", "b").union(e.select("b", "a")).toDF("u", "v")) if large else e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        # Written, so that the join below can split a hub with very many neighbours.
        root = cut(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        out = near.join(root, "u")
        if large:
            return out.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")

    held, before = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), None
    while True:
        held = cut(star(star(held, True).where("a <> b"), False).where("a <> b").distinct())
        now = held.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (now["n"], now["x"]) == before:
            break
        before = (now["n"], now["x"])
    roots = held.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return held.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def across_blocks(named: DataFrame, block: int) -> DataFrame:
    """(band, i, j, side, id, root) of the bucket members (band, id, root) for every pair of blocks that holds two roots.

    A block is (root, part) for a root of `block` members or more in the bucket, and (-1, part) where smaller roots are
    put together by hash. Blocks of one large root never meet, so a bucket of one component and a few others costs its
    members once a block of the others. By counts only: no task holds a bucket."""
    sizes = named.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    large = F.col("n") >= block
    shape = sizes.groupBy("band").agg(
        F.count(F.lit(1)).alias("roots"), F.ceil(F.sum(F.when(large, 0).otherwise(F.col("n"))) / block).cast("int").alias("shared"),
        F.collect_list(F.when(large, F.struct("root", F.ceil(F.col("n") / block).cast("int").alias("parts")))).alias("large"),
    )
    rows = named.join(cut(shape.where("roots > 1").drop("roots")), "band")
    own = F.get(F.filter("large", lambda r: r["root"] == F.col("root")), F.lit(0))
    key = lambda root, part: F.struct(root.cast("long").alias("root"), part.cast("int").alias("part"))
    mine = F.when(own.isNull(), key(F.lit(-1), F.pmod(F.xxhash64("root"), F.greatest("shared", F.lit(1))))).otherwise(key(F.col("root"), F.pmod(F.xxhash64("id", "band"), own["parts"])))
    parts = lambda root, n: F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda p: key(root, p))
    others = F.concat(parts(F.lit(-1), F.col("shared")), F.flatten(F.transform(F.filter("large", lambda r: r["root"] != F.col("root")), lambda r: parts(r["root"], r["parts"]))))
    cells = F.transform(others, lambda o: F.struct(F.least(F.col("mine"), o).alias("i"), F.greatest(F.col("mine"), o).alias("j"), F.when(F.col("mine") <= o, 0).otherwise(1).alias("side")))
    return rows.withColumn("mine", mine).select("band", "id", "root", F.inline(cells)).select("band", "i", "j", "side", "id", "root")


def classes(docs: DataFrame, block: int = BLOCK, exact: bool = False) -> DataFrame:
    """One row per row of docs: (doc_id, n_shingles, component_id, kept)."""
    texts = text_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = cut(texts.mapInArrow(partial(sketch, exact=exact), "doc_id long, n_shingles long, k1 long, k2 long, sig binary, bands array<long>"))
    live = held.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # Written, so that the join can split a set that very many documents share.
    same = cut(live.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("first")))
    member = cut(live.select("doc_id", "k1", "k2", "n_shingles").join(same, ["k1", "k2", "n_shingles"]).select("doc_id", F.col("first").alias("id")).distinct())
    reps = live.join(member.where("doc_id = id").select("doc_id"), "doc_id", "left_semi")
    banded = reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last")
    buckets = cut(banded.join(hubs.select("band", "hub"), "band"))
    wanted = buckets.select(F.col("id").alias("doc_id")).distinct()
    sigs = cut(reps.join(wanted, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "sig", "bands"))
    sets = cut(texts.join(wanted, "doc_id", "left_semi").mapInArrow(full_sets, "id long, s array<long>, raw binary"))

    sig = sigs.select("id", "sig")
    first = buckets.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    if not exact:
        first = first.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(alike, "a long, b long")
    copies = member.where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    starred = cut(confirmed(first, sets))
    roots = components(starred)

    named = buckets.join(roots.toDF("id", "root"), "id", "left").select("band", "id", F.coalesce("root", "id").alias("root"))
    cells = across_blocks(named, block).join(sigs, "id").join(sets.select("id", "raw"), "id")
    # Exact buckets are of no fixed number: there a pair is tested in each that it shares.
    dealt = cells.select("band", "i", "j", "side", "id", "root", "sig", F.array("band").alias("bands") if exact else F.col("bands"), "raw")
    rest = dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(partial(across, signature=0.0 if exact else SIGNATURE), "a long, b long")
    late = cut(confirmed(rest.distinct(), sets))
    # The links of both steps, and those of equal sets, make the components.
    all_roots = components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).union(late).union(copies))
    return held.join(all_roots.toDF("doc_id", "root"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"), F.coalesce(F.coalesce("root", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def op3_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
