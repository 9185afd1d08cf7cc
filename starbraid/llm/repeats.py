"""Suffix-array deduplication by the common-prefix interval tree of an enhanced suffix array.

A byte goes if a LENGTH-byte string that covers it also starts earlier (smaller doc_id, or earlier in the document).

Which suffixes are sorted. Every LENGTH-byte window holds LENGTH - GRAM + 1 byte grams; the one with the least hash is
its anchor. Equal windows have equal anchors at equal places, so a window can repeat only if its anchor's gram does.
Each anchor owns the stretch of consecutive windows that it is the anchor of. Stretches are brought together by gram:
    * a gram that occurs once owns no repeat, and its suffixes are dropped;
    * stretches with equal content are one leaf of the gram's tree with several occurrences: all but the earliest go;
    * different stretches of one gram may agree in part: the suffixes of their windows make a bucket.
In each bucket the suffixes are sorted, the common prefixes of neighbours computed, and a stack scan lists the intervals
of the common-prefix tree of depth LENGTH or more. An interval whose occurrences are preceded by different bytes (or lie
at the edge of a stretch) is a maximal repeat; its group has all the suffixes of the interval, not only neighbours. In
each group all occurrences but the earliest go.

Hot grams: each partition keeps the earliest copy of a stretch and reports its other copies at once, so a passage in a
third of all documents is one row a partition. A bucket of more than HOT different stretches is dealt out anew by the
first LENGTH bytes of its suffixes (a tree interval of that depth never spans two of those), again with one row for
each partition and equal prefix.

Documents are told apart by (doc, tie). tie is a hash of the text, so rows that share an id but not the text are
documents of their own, in the order of that hash. Rows without an id are each a document: their tie is made of the
text's hash and the row's number, so they are spread over the tasks, and one row of equal ones stays.

Defined results: null or short text loses nothing; rows equal in id and text are judged alike, as one; null ids come
before all others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, text_of

LENGTH = 100
GRAM = 32
CHUNK = 1 << 20
#: Stretches that a partition holds before it emits them.
HELD = 2_000_000
HOT = 4000
NULL_ID = -(2**63)

ORACLE_SQL = None  # byte ranges over repeated substrings; tests hold it against brute force

_U = np.uint64
_C = np.random.default_rng(8).integers(0, 2**63, 8, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def stretches(parts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text number, first window, end of the last window, gram hash, content hash) of every stretch."""
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    raw = b"".join(parts) + bytes(8)
    n = len(raw) - 8
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none
    eight = mixed(np.ndarray((n - 7,), "<u8", raw, strides=(1,)) * _C[0] + _C[1])
    grams = n - gram + 1
    h = np.zeros(grams, np.uint64)
    for i, at in enumerate([*range(0, gram - 7, 8)]):
        h += eight[at : at + grams] * _C[2 + i % 6]
    h = mixed(h)
    bits = _U(max(22, int(n).bit_length()))
    low = (h >> bits << bits) | np.arange(grams, dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    owner = (low & ((_U(1) << bits) - _U(1))).astype(np.int64)
    step = np.zeros(len(owner) + 1, np.int8)
    fit = sizes >= length
    np.add.at(step, begins[fit], 1)
    np.add.at(step, ends[fit] - length + 1, -1)
    owner[np.cumsum(step[:-1], dtype=np.int8) == 0] = -1
    edge = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    last = np.append(edge[1:], len(owner)) - 1
    keep = owner[edge] >= 0
    s1, s2 = edge[keep], last[keep]
    p = owner[s1]
    powers = np.cumprod(np.concatenate([[_U(1)], np.full(n - 8, _U(_BASE))]))
    sums = np.concatenate([[_U(0)], np.cumsum(eight * powers)])
    back = np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, _U(_INVERSE))]))
    content = (sums[s2 + length - 7] - sums[s1]) * back[s1]
    content = mixed(content + (p - s1).astype(np.uint64) * _C[6] + (s2 - s1).astype(np.uint64) * _C[7])
    text = np.searchsorted(ends, s1, side="right")
    return text, s1 - begins[text], s2 + length - begins[text], h[p].view(np.int64), content.view(np.int64)


def stretched(parts: list[bytes], chunk: int | None = None, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """The stretches of texts of any length, about `chunk` bytes at a time.

    A long text is taken in pieces: of all but its last piece the last stretch is left out, since it may go on, and the next
    piece begins with that stretch. An anchor depends on its window only, so the stretches are those of the whole text."""
    chunk = chunk or CHUNK
    lo = 0
    while lo < len(parts):
        if len(parts[lo]) > chunk:
            at, raw = 0, parts[lo]
            while True:
                ends = at + chunk >= len(raw)
                text, start, stop, h, c = stretches([raw[at : at + chunk]])
                keep = slice(None) if ends else slice(0, -1)
                yield tuple(x[keep] for x in (text + lo, start + at, stop + at, h, c))
                if ends:
                    break
                at += int(start[-1])
            lo += 1
            continue
        hi, size = lo, 0
        while hi < len(parts) and len(parts[hi]) <= chunk and size < chunk:
            size += len(parts[hi])
            hi += 1
        text, start, stop, h, c = stretches(parts[lo:hi])
        yield text + lo, start, stop, h, c
        lo = hi


def packed(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << 32) | stop.astype(np.int64)


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    docs, ties, parts, size = [], [], [], 0
    for doc, text, tie in zip(*(batch.column(i).to_pylist() for i in range(3))):
        raw = text.encode("utf-8", "surrogatepass")
        docs.append(doc)
        ties.append(tie)
        parts.append(raw)
        size += len(raw)
        if size >= CHUNK:
            yield docs, ties, parts
            docs, ties, parts, size = [], [], [], 0
    if docs:
        yield docs, ties, parts


def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, tie) -> (h, c, doc, tie, span, copy) of the stretches: the earliest of each (h, c) here, and the other ones as copies."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> pa.RecordBatch:
        h, c, doc, tie, span = (np.concatenate([x[i] for x in held]) for i in range(5))
        order = np.lexsort((span, tie, doc, c, h))
        h, c, doc, tie, span = h[order], c[order], doc[order], tie[order], span[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(h) else np.zeros(0, bool)
        first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.zeros(0, int)
        again = ~new & ((doc != doc[first]) | (tie != tie[first]) | (span != span[first]))
        use = new | again
        # A copy needs its document only; it is dealt out by that.
        key = np.where(again, mixed((doc ^ tie).view(np.uint64) * _C[0]).view(np.int64), h)
        return pa.RecordBatch.from_arrays([pa.array(x[use]) for x in (key, np.where(again, 0, c), doc, tie, span, again)], names=["h", "c", "doc", "tie", "span", "copy"])

    for batch in batches:
        for docs, ties, parts in chunks(batch):
            for text, start, stop, h, c in stretched(parts):
                held.append((h, c, np.array(docs, np.int64)[text], np.array(ties, np.int64)[text], packed(start, stop)))
                if sum(len(x[0]) for x in held) >= HELD:
                    yield flush()
                    held.clear()
    if held:
        yield flush()
    held.clear()
    pa.default_memory_pool().release_unused()  # the worker serves other tasks next


def sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by (h, c, doc, tie, span): copies (h null) and, where a gram has different stretches, those (with h).

    Equal stretches are one leaf of the gram's tree, whose occurrences but the earliest go; a gram with several leaves is
    open for the interval scan. Only the earliest row of the last leaf is kept from batch to batch, so a gram may have
    any number of stretches."""
    last: list | None = None  # h, c, doc, tie, span of the open leaf's earliest row
    several = False  # whether its gram has shown several leaves (then that row has gone out)
    for batch in batches:
        h, c, doc, tie, span, copy = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        out = [(doc[copy], tie[copy], span[copy], np.zeros(copy.sum(), np.int64), np.zeros(copy.sum(), bool))]
        real = ~copy
        h, c, doc, tie, span = (x[real] for x in (h, c, doc, tie, span))
        if len(h):
            if last is not None:
                h, c, doc, tie, span = (np.concatenate([[a], x]) for a, x in zip(last, (h, c, doc, tie, span)))
            new_h = np.concatenate([[True], h[1:] != h[:-1]])
            new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
            first = np.flatnonzero(new_c)[np.cumsum(new_c) - 1]
            again = ~new_c & ((doc != doc[first]) | (tie != tie[first]) | (span != span[first]))
            grams = np.flatnonzero(new_h)
            leaves = np.add.reduceat(new_c.astype(np.int64), grams)
            if several:
                leaves[0] += 1
            opened = new_c & (np.repeat(leaves, np.diff(grams, append=len(h))) > 1)
            at = int(first[-1])
            last = [x[at] for x in (h, c, doc, tie, span)]
            if several and len(h):
                opened[0] = False
            several = bool(leaves[-1] > 1)
            for rows, is_copy in ((again, True), (opened, False)):
                out.append((doc[rows], tie[rows], span[rows], np.zeros(rows.sum(), np.int64) if is_copy else h[rows], np.full(rows.sum(), not is_copy)))
        doc, tie, span, h, is_open = (np.concatenate([o[i] for o in out]) for i in range(5))
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tie), pa.array(span), pa.array(h, mask=~is_open)], names=["doc", "tie", "span", "h"])


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, tie, text, opens of span, h, hot) -> bucket rows (bucket, doc, tie, start, windows, bytes) and copies (bucket null)."""
    seen: dict[bytes, tuple[int, int, int]] = {}
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]

        def put(*row) -> None:  # noqa: ANN002, B023
            for c, x in zip(out, row):  # noqa: B023
                c.append(x)

        for doc, tie, text, opens in zip(*(batch.column(i).to_pylist() for i in range(4))):
            raw = text.encode("utf-8", "surrogatepass")
            for o in opens:
                start, stop = o["span"] >> 32, o["span"] & 0xFFFFFFFF
                if stop > len(raw):
                    continue
                if not o["hot"]:
                    put(o["h"], doc, tie, start, stop - start - LENGTH + 1, raw[start:stop])
                    continue
                again: list[int] = []
                for s in range(start, stop - LENGTH + 1):
                    prefix = xxhash.xxh3_128_digest(raw[s : s + LENGTH])
                    at = seen.get(prefix)
                    if at is not None and at < (doc, tie, s):
                        again.append(s)
                    elif at != (doc, tie, s):
                        if len(seen) >= HELD // 4:
                            seen.clear()
                        seen[prefix] = (doc, tie, s)
                        put(int.from_bytes(prefix[:8], "little", signed=True), doc, tie, s, 1, raw[s:stop])
                for a, b in joined((s, s + LENGTH) for s in again):
                    put(None, doc, tie, a, b - a - LENGTH + 1, b"")
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["bucket", "doc", "tie", "start", "windows", "bytes"])


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def maximal_repeats(rows: list[tuple[int, int, int, bytes]], length: int = LENGTH) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(repeat length, occurrences as (doc, start)) of every left-diverse interval of the bucket's common-prefix tree.

    rows: (doc, start, windows, bytes). The stack holds open intervals (depth, first suffix, left byte or None once the
    left bytes differ); a suffix at the edge of its stretch has an unknown left byte, which counts as different.
    """
    suffixes = sorted((raw[i:], doc, start + i, raw[i - 1] if i else -1) for doc, start, windows, raw in rows for i in range(windows))
    for lo, hi in runs(suffixes, length):
        lcp = [common_prefix(suffixes[i][0], suffixes[i + 1][0]) for i in range(lo, hi)] + [0]
        stack: list[list] = []
        for i, depth in enumerate(lcp, lo):
            left, first = suffixes[i][3], i
            left = None if left < 0 else left
            while stack and stack[-1][0] > depth:
                top_depth, first, top_left = stack.pop()
                left = left if left == top_left else None
                if left is None:
                    yield top_depth, [(s[1], s[2]) for s in suffixes[first : i + 1]]
            if depth >= length:
                if stack and stack[-1][0] == depth:
                    stack[-1][2] = left if stack[-1][2] == left else None
                else:
                    stack.append([depth, first, left])


def runs(suffixes: list[tuple], length: int) -> Iterator[tuple[int, int]]:
    """The stretches of the sorted suffixes that share their first `length` bytes, two or more in each."""
    lo = 0
    for i in range(1, len(suffixes) + 1):
        if i == len(suffixes) or suffixes[i][0][:length] != suffixes[i - 1][0][:length]:
            if i - lo > 1:
                yield lo, i - 1
            lo = i


def joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans as maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif a < b:
            out.append((a, b))
    return out


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket rows sorted by bucket -> (doc, tie, span) of what every occurrence of a maximal repeat but its earliest covers.

    An occurrence lies in nested intervals; the longest repeat in which it is not the earliest says all about it, and
    what the occurrences of one document cover is joined, so a bucket gives about a row a stretch."""

    def solve(bucket: list[tuple]) -> list[tuple[int, int, int]]:
        if bucket[0][0] is None:
            return [(*doc, start << 32 | start + windows - 1 + LENGTH) for _, doc, start, windows, _ in bucket]
        ends: dict[tuple[tuple[int, int], int], int] = {}
        for size, places in maximal_repeats([b[1:] for b in bucket]):
            first = min(places)
            for p in places:
                if p != first and ends.get(p, 0) < p[1] + size:
                    ends[p] = p[1] + size
        by_doc: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for (doc, start), stop in sorted(ends.items()):
            by_doc.setdefault(doc, []).append((start, stop))
        return [(*doc, a << 32 | b) for doc, spans in by_doc.items() for a, b in joined(spans)]

    held: list[tuple] = []
    for batch in batches:
        out: list[tuple[int, int, int]] = []
        for bucket, doc, tie, *rest in zip(*(batch.column(i).to_pylist() for i in range(6))):
            row = (bucket, (doc, tie), *rest)
            if held and (row[0] != held[0][0] or row[0] is None and len(held) >= 10_000):
                out += solve(held)
                held = []
            held.append(row)
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], names=["doc", "tie", "span"])
    if held:
        out = solve(held)
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], names=["doc", "tie", "span"])


def merged(spans: list[int] | None, size: int) -> list[tuple[int, int]]:
    """Packed spans as maximal runs inside a text of that size."""
    return joined((x >> 32, min(x & 0xFFFFFFFF, size)) for x in sorted(spans or []))


def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of (doc_id, text, spans)."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for doc, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
            raw = text.encode("utf-8", "surrogatepass")
            gone = merged(spans, len(raw))
            edges = [0, *(x for s in gone for x in s), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])) if gone else raw
            for c, x in zip(out, (doc, len(raw), sum(b - a for a, b in gone), len(gone), kept)):
                c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in removed(batches):
        sha = pa.array([hashlib.sha256(k).hexdigest() for k in batch.column(4).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], sha], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def told_apart(flat: DataFrame) -> DataFrame:
    """flat with doc and tie, a document's identity. Rows without an id are written once, so that their numbers hold."""
    hashed = F.xxhash64("text")
    named = flat.where("doc_id IS NOT NULL").withColumns({"doc": F.col("doc_id").cast("long"), "tie": hashed})
    upper = F.shiftleft(F.shiftright(hashed, 32), 32)
    number = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit(0xFFFFFFFF))
    nameless = cut(flat.where("doc_id IS NULL").withColumns({"doc": F.lit(NULL_ID), "tie": upper.bitwiseOR(number)}))
    return named.unionByName(nameless)


def with_spans(docs: DataFrame, hot: int = HOT, carry: Column | None = None) -> DataFrame:
    """(doc_id, text, spans array<long>[, carried]): each text with the packed byte spans that go."""
    also = [] if carry is None else ["carried"]
    flat = told_apart(text_of(docs, *([] if carry is None else [carry.alias("carried")])))
    rows = flat.select("doc", "text", "tie").mapInArrow(anchored, "h long, c long, doc long, tie long, span long, copy boolean")
    found = cut(rows.repartition("h").sortWithinPartitions("h", "c", "doc", "tie", "span").mapInArrow(sorted_out, "doc long, tie long, span long, h long"))
    opens = found.where("h IS NOT NULL")
    # Written, so that the join can split a gram with very many stretches.
    busy = cut(opens.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("h", F.lit(True).alias("hot")))
    asked = opens.join(busy, "h", "left").groupBy("doc", "tie").agg(F.collect_list(F.struct("span", "h", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("opens"))
    # Both joins below read one exchange of the texts.
    texts = flat.select("doc_id", "doc", "tie", "text", *also).repartition("doc", "tie")
    buckets = texts.join(asked, ["doc", "tie"]).select("doc", "tie", "text", "opens").mapInArrow(contexts, "bucket long, doc long, tie long, start long, windows int, bytes binary")
    # Copies carry no bucket: they are dealt out by their document.
    dealt = buckets.repartition(F.coalesce("bucket", F.xxhash64("doc", "tie"))).sortWithinPartitions("bucket")
    spans = found.where("h IS NULL").select("doc", "tie", "span").union(dealt.mapInArrow(scanned, "doc long, tie long, span long"))
    return texts.join(spans.groupBy("doc", "tie").agg(F.collect_list("span").alias("spans")), ["doc", "tie"], "left").select("doc_id", "text", "spans", *also)


def cleaned(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary)."""
    return with_spans(docs).mapInArrow(removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans, carried) -> (carried, text without its spans); incomplete characters go with them."""
    for batch in batches:
        texts = [k.decode("utf-8", "ignore") for part in removed(iter([batch])) for k in part.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(texts, pa.string())], names=["carried", "text"])


def cut_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs with shortened texts (null texts become empty) and n_chars, where docs has it, in step."""
    rest = [c for c in docs.columns if c != "text"]
    spans = with_spans(docs, carry=F.struct(*rest))
    out = spans.mapInArrow(rewritten, f"carried {spans.schema['carried'].dataType.simpleString()}, text string")
    return out.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("text") if c == "text" else F.col("carried")[c].alias(c) for c in docs.columns])


def op8_interval_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return with_spans(docs).mapInArrow(digested, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

