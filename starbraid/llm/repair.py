"""Conversation structure repair: cheapest edits by bidirectional Dijkstra over the lattice of rows and grammar states.

A node of the lattice is (rows taken, state of `(s?(ua)+)?`); edits are its edges. Forward and reverse heaps settle nodes by
cost, at equal cost in the order in which free edges lead, so a node's least audit is known when it is settled. When the
two fronts meet, both go on until their sum exceeds the best cost: then every cheapest path has an edge or node between a
forward-settled and a reverse-settled node, and the least of all concatenated audits is taken. (No two cheapest paths to
one node have audits of which one begins the other, so least parts make a least whole.)

Damage and faults are DataFrame functions. Equal rows of a conversation are counted first, not carried; later copies can
only be deleted. Rows are then sorted over range partitions, which split a conversation of any size. A task solves each
conversation that lies inside it whole; of one that reaches a task's edge, or has more than BLOCK rows, it solves blocks
between all pairs of states and chains them, so a conversation's parts need one short row each, whose audits are joined in
order. Those few conversations are then streamed once more to hash their repaired rows, with one batch in memory: the digest
of a conversation and its audit string (a character a row) are by nature one value of one task.

Defined results: damage reads a null conv_id or turn as one space in its key, and a null role or text is one space; rows of
one turn are in the order of role, then text; null conv_ids are one conversation; repeated rows are rows, and all but the
first are duplicates; an empty role has no initial that the grammar takes, so it is never kept; a conversation without rows
after damage has zeros, an empty audit and the digest of an empty string; an empty table gives no rows; texts of any length
are hashed whole, a row at a time; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: States of the grammar (nothing yet, after s, after u, after a) and its moves.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
MOVES = [(NOTHING, "s", SYSTEM), (NOTHING, "u", USER), (SYSTEM, "u", USER), (ASSISTANT, "u", USER), (USER, "a", ASSISTANT)]
NEXT = {(a, letter): b for a, letter, b in MOVES}
ENDS = (NOTHING, ASSISTANT)
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
#: Rows, or characters of texts, of a block.
BLOCK = 256
BLOCK_TEXT = 8 << 20
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
SPACE = " \t\n\x0b\x0c\r"

ORACLE_SQL = None  # shortest paths with ties by audit; tests hold an exhaustive table of all edits

#: A lattice item: (initial, extra cost if kept or reroled) of a row, or (None, n) for n rows that must go.
Item = tuple[str | None, int]


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows after damage; a dropped row leaves its conv_id with nulls and 0 copies."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    base = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    stays = lambda c: F.when(F.col("kind") != 0, c)
    return base.select("conv_id", stays(F.col("turn")).alias("turn"), stays(F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))).alias("role"), stays(text).alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def judged(rows: DataFrame) -> DataFrame:
    """Equal rows once, with their number and the fault of the first of them."""
    twin = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256).alias("twin")
    firsts = rows.where("copies > 0").groupBy("conv_id", twin).agg(F.min(F.struct("turn")).alias("first"))
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("twin", twin)
    both = once.alias("o").join(firsts.alias("f"), F.col("o.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("o.twin") == F.col("f.twin")), "left")
    body = F.rtrim("text", F.lit(SPACE))
    fault = F.when(F.length(body) == 0, BLANK).when(~F.col("turn").eqNullSafe(F.col("first")["turn"]), DUPLICATE).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(NO_FAULT)
    return both.select("o.conv_id", "turn", "role", "text", "copies", F.when(F.col("copies") > 0, fault).alias("fault"))


def counted(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated) of judged rows."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    fault, copies = F.col("fault"), F.col("copies")
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    return rows.groupBy("conv_id").agg(
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), n(F.when(fault == BLANK, copies)).alias("blank"),
        n(F.when(fault == DUPLICATE, copies).when(fault != BLANK, copies - 1)).alias("duplicate"), n(F.when(fault == TRUNCATED, 1)).alias("truncated"),
    )


def out_of(item: Item, state: int) -> Iterator[tuple[int, int, str]]:
    """Edits that take an item, from a state: (state after, cost, initial). Rows that must go count as one D here."""
    initial, extra = item
    if initial is None:
        yield state, DELETE * extra, "D"
        return
    yield state, DELETE, "D"
    if (state, initial) in NEXT:
        yield NEXT[state, initial], extra, "K"
    for letter in NAMES:
        if (state, letter) in NEXT:
            yield NEXT[state, letter], REROLE + extra, "R"


INSERTS = [(a, b) for a, letter, b in MOVES if letter in NAMES]


def cheapest(items: list[Item], entry: int, exit_: int) -> tuple[int, str] | None:
    """(cost, least audit) from (0, entry) to (all items, exit_); None where no edits lead there."""
    n = len(items)
    ahead = [{s: list(out_of(item, s)) for s in range(4)} for item in items]
    behind = [{s: [(a, c, e) for a in range(4) for b, c, e in steps[a] if b == s] for s in range(4)} for steps in ahead]

    def edges(node: tuple[int, int], forth: bool) -> Iterator[tuple[tuple[int, int], int, str]]:
        i, s = node
        for a, b in INSERTS:
            if (a if forth else b) == s:
                yield (i, b if forth else a), INSERT, "I"
        if forth and i < n:
            for b, c, e in ahead[i][s]:
                yield (i + 1, b), c, e
        if not forth and i:
            for a, c, e in behind[i - 1][s]:
                yield (i - 1, a), c, e

    best: list[dict[tuple[int, int], tuple[int, str]]] = [{(0, entry): (0, "")}, {(n, exit_): (0, "")}]
    settled: list[set[tuple[int, int]]] = [set(), set()]
    heaps = [[(0, 0, entry)], [(0, -n, exit_)]]
    least = float("inf")
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= least:
        for side, sign in ((0, 1), (1, -1)):
            if not heaps[side]:
                continue
            cost, i, s = heapq.heappop(heaps[side])
            node = (sign * i, s)
            if node in settled[side]:
                continue
            settled[side].add(node)
            audit = best[side][node][1]
            if node in best[1 - side]:
                least = min(least, cost + best[1 - side][node][0])
            for to, c, e in edges(node, side == 0):
                new = (cost + c, audit + e if side == 0 else e + audit)
                old = best[side].get(to)
                if old is None or new < old:
                    best[side][to] = new
                    if old is None or new[0] < old[0]:
                        heapq.heappush(heaps[side], (new[0], sign * to[0], to[1]))
    if least == float("inf"):
        return None
    whole = []
    for node in settled[0]:
        cost, audit = best[0][node]
        if node in settled[1] and cost + best[1][node][0] == least:
            whole.append(audit + best[1][node][1])
        for to, c, e in edges(node, True):
            if to in settled[1] and cost + c + best[1][to][0] == least:
                whole.append(audit + e + best[1][to][1])
    return int(least), written_out(min(whole), items)


def written_out(audit: str, items: list[Item]) -> str:
    """The audit with a D for each row of the runs that must go."""
    out, at = [], iter(items)
    for e in audit:
        initial, extra = ("", 0) if e == "I" else next(at)
        out.append(e * extra if initial is None else e)
    return "".join(out)


Chain = dict[tuple[int, int], tuple[int, str]]


def solved(items: list[Item]) -> Chain:
    """Cheapest edits of a block between all pairs of states."""
    found = {(a, b): cheapest(items, a, b) for a in range(4) for b in range(4)}
    return {k: v for k, v in found.items() if v is not None}


def chained(one: Chain, two: Chain) -> Chain:
    out: Chain = {}
    for (a, b), (c, x) in one.items():
        for (d, e), (f, y) in two.items():
            if b == d and ((a, e) not in out or (c + f, x + y) < out[a, e]):
                out[a, e] = (c + f, x + y)
    return out


def picked(ways: Chain) -> tuple[int, str]:
    """The cheapest whole repair. Deleting every row always leads to an end."""
    return min(ways[NOTHING, e] for e in ENDS if (NOTHING, e) in ways)


class Lines:
    """Repaired rows of a conversation, hashed one by one as rows come and the audit says."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.any = audit, 0, NOTHING, hashlib.sha256(), False

    def put(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any, self.state = True, NEXT[self.state, role[0]]

    def owed(self) -> str:
        return "u" if (self.state, "u") in NEXT else "a"

    def inserts(self) -> None:
        while self.audit.startswith("I", self.at):
            self.put(NAMES[self.owed()], "")
            self.at += 1

    def row(self, role: str, text: str, copies: int) -> None:
        """A row and its copies; all but the first are deleted, and no insertion stands before a deletion."""
        for _ in range(min(copies, 1)):
            self.inserts()
            edit, self.at = self.audit[self.at], self.at + 1
            if edit != "D":
                self.put(role if edit == "K" else NAMES[self.owed()], text)
        left = copies - 1
        while left > 0:
            self.inserts()
            same = min(left, len(self.audit) - self.at)
            gone = next((i for i in range(same) if self.audit[self.at + i] != "D"), same)
            self.at, left = self.at + gone, left - gone

    def digest(self) -> str:
        self.inserts()
        return self.sha.hexdigest()


class Part:
    """What a task has read of one conversation: the block at hand and the chain of those before."""

    def __init__(self, conv: int | None):
        self.conv, self.rows, self.items, self.chain, self.size = conv, [], [], None, 0
        self.first = self.last = None
        self.illegal = 0

    def add(self, role: str, text: str, copies: int, fault: int) -> None:
        if len(self.items) >= BLOCK or self.size >= BLOCK_TEXT:
            self.close()
        initial = role[:1]
        self.illegal += (self.last is not None and self.last + initial not in LEGAL) + (copies - 1) * (initial * 2 not in LEGAL)
        self.first, self.last = initial if self.first is None else self.first, initial
        lost = copies if fault in (BLANK, DUPLICATE) else copies - 1
        if fault not in (BLANK, DUPLICATE):
            self.items.append((initial, CUT_SHORT if fault == TRUNCATED else 0))
        if lost:
            if self.items and self.items[-1][0] is None:
                self.items[-1] = (None, self.items[-1][1] + lost)
            else:
                self.items.append((None, lost))
        self.rows.append((role, text, copies))
        self.size += len(text)

    def close(self) -> None:
        block = solved(self.items)
        self.chain = block if self.chain is None else chained(self.chain, block)
        self.rows, self.items, self.size = [], [], 0

    def result(self, inner: bool) -> dict:
        out = {"conv_id": self.conv, "whole": inner and self.chain is None, "illegal": self.illegal, "first": self.first, "last": self.last, "cost": None, "audit": None, "digest": None, "ways": []}
        if out["whole"]:
            found = [x for e in ENDS if (x := cheapest(self.items, NOTHING, e)) is not None]
            out["cost"], out["audit"] = min(found)
            lines = Lines(out["audit"])
            for r in self.rows:
                lines.row(*r)
            out["digest"] = lines.digest()
            return out
        if self.items or self.chain is None:
            self.close()
        out["ways"] = [{"a": a, "b": b, "cost": c, "audit": x} for (a, b), (c, x) in self.chain.items()]
        return out


PARTS = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("digest", pa.string()),
    ("ways", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
])
PARTS_SQL = "conv_id long, part long, whole boolean, illegal long, first string, last string, cost long, audit string, digest string, ways array<struct<a int, b int, cost long, audit string>>"


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for lo in range(0, len(batch), 1024):
            yield from zip(*(c.to_pylist() for c in batch.slice(lo, 1024).columns))


def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (part, conv_id, role, text, copies, fault) of a range -> a row for each conversation in it."""
    now, number, out, seen = None, 0, [], 0
    for number, conv, role, text, copies, fault in rows_of(batches):
        if now is None or now.conv != conv:
            if now is not None:
                out.append(now.result(seen > 1) | {"part": number})
            now, seen = Part(conv), seen + 1
        if copies:
            now.add(role, text, copies, fault)
        if len(out) >= 512:
            yield pa.RecordBatch.from_pylist(out, PARTS)
            out = []
    if now is not None:
        out.append(now.result(False) | {"part": number})
    if out:
        yield pa.RecordBatch.from_pylist(out, PARTS)


JOINED = pa.schema([("conv_id", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])


def join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts (conv_id, illegal, first, last, ways) in order -> the repair of each conversation."""
    conv, ways, illegal, last, any_ = None, {}, 0, None, False

    def done() -> pa.RecordBatch:
        cost, audit = picked(ways)
        return pa.RecordBatch.from_pylist([{"conv_id": conv, "illegal": illegal, "cost": cost, "audit": audit}], JOINED)

    for batch in batches:
        for row in range(len(batch)):
            own, bad, first, end, steps = (batch.column(c)[row].as_py() for c in range(5))
            if not any_ or own != conv:
                if any_:
                    yield done()
                conv, ways, illegal, last, any_ = own, {(NOTHING, NOTHING): (0, "")}, 0, None, True
            ways = chained(ways, {(w["a"], w["b"]): (w["cost"], w["audit"]) for w in steps})
            illegal += bad + (last is not None and first is not None and last + first not in LEGAL)
            last = last if end is None else end
    if any_:
        yield done()


HASHED = pa.schema([*JOINED, ("digest", pa.string())])


def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repair of a conversation (kind 0), then its rows in order (kind 1) -> the repair with its digest."""
    held = lines = None
    for kind, conv, role, text, copies, illegal, cost, audit in rows_of(batches):
        if kind == 0:
            if held is not None:
                yield pa.RecordBatch.from_pylist([held | {"digest": lines.digest()}], HASHED)
            held, lines = {"conv_id": conv, "illegal": illegal, "cost": cost, "audit": audit}, Lines(audit)
        elif copies:
            lines.row(role, text, copies)
    if held is not None:
        yield pa.RecordBatch.from_pylist([held | {"digest": lines.digest()}], HASHED)


def repaired(conversations: DataFrame, spoil: bool = True) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row a conversation.

    spoil=False repairs the rows as they are."""
    rows = damaged(conversations) if spoil else conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(1).cast("long").alias("copies"))
    rows = cut(judged(rows))
    order = ["conv_id", "turn", "role", "text"]
    # The ranges' bounds are a sample of keys on the driver, so texts count with their beginning there.
    ranged = rows.repartitionByRange("conv_id", "turn", F.substring("role", 1, 16), F.substring("text", 1, 32)).sortWithinPartitions(*order)
    parts = cut(ranged.select(F.spark_partition_id().cast("long").alias("part"), "conv_id", "role", "text", "copies", "fault").mapInArrow(solve, PARTS_SQL))
    whole = parts.where("whole").select("conv_id", "illegal", "cost", "audit", "digest")
    split = parts.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "illegal", "first", "last", "ways")
    joined = cut(split.mapInArrow(join_parts, "conv_id long, illegal long, cost long, audit string"))
    own = rows.alias("r").join(joined.select(F.col("conv_id").alias("c")), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    null = lambda t: F.lit(None).cast(t)
    heads = joined.select(F.lit(0).alias("kind"), "conv_id", null("long").alias("turn"), null("string").alias("role"), null("string").alias("text"), null("long").alias("copies"), "illegal", "cost", "audit")
    body = own.select(F.lit(1).alias("kind"), "conv_id", "turn", "role", "text", "copies", null("long").alias("illegal"), null("long").alias("cost"), null("string").alias("audit"))
    both = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text").drop("turn")
    hashed = both.mapInArrow(hash_rows, "conv_id long, illegal long, cost long, audit string, digest string")
    found = whole.unionByName(hashed).alias("f")
    out = counted(rows).alias("n").join(found, F.col("n.conv_id").eqNullSafe(F.col("f.conv_id")))
    return out.select("n.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("digest").alias("repaired_sha256"))


def op13_edit_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
