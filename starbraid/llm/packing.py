"""Sequence packing by minimum bin slack.

Each document's ids (an end id appended) are cut every 2,048; full pieces fill a sequence of their own. What remains of
each document is a piece of 1 to 2,047 ids. How many pieces have each length is all that packing needs to know, so the
search runs on a table of at most 2,047 counts, whatever the corpus: the largest remaining length opens a window, a
bitset dynamic program over the remaining lengths (with their counts) finds the reachable sums, the reachable sum
closest to the capacity is taken, and backtracking through the bitsets gives the count of each length. That pattern is
laid out as often as the counts allow, and the next window is searched on what is left. The plan is a list of
(pattern, times), a few thousand entries at most. Spark then hands the pieces out: pieces of one length are numbered
inside hashed buckets (a hot length never sits in one task), and a piece's number says which window and place it has.

Defined results: null or empty text has one piece, the end id alone; repeated rows and null ids are documents of their
own; pieces of one length are interchangeable, whichever takes a place; texts of any length are encoded whole, some
millions of characters at a time; a sequence holds at most 2,048 ids and is padded to 2,048 unless its ids number a power
of two; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import chunks_of, cut, gulps, remembered, spelled, text_of

CAPACITY = 2048
END_ID = 1
#: Words whose ids a task remembers: at most about 80 MB, dropped at its end (the worker goes on to other work).
REMEMBERED = 400_000
#: Pieces of one length in a bucket, about.
BUCKET = 1000

#: Letters whose lower case and normal form are the same everywhere, then punctuation that the vocabulary always parts
#: from them: all of ASCII but the apostrophe (contractions) and "<" (special tokens).
PLAIN = r"^(?P<word>[A-Za-zß-öø-ÿÀ-ÖØ-Þ]*)(?P<mark>[!-&(-/:;=-@\[-`{-~]*)$"

ORACLE_SQL = None  # tokenizer ids and a packing search; tests hold exactness and padding


class WordIds:
    """Chunk of text without blanks -> its ids as little-endian bytes.

    The vocabulary's pre-tokenizer never joins text across white space, so a text's ids are its chunks' ids in turn. A
    chunk of plain letters and the punctuation after it are two words to it: a word meets the merges once, whatever its
    case and punctuation. New words are encoded together, joined by blanks; each ends at its one id of an end of word.
    All other chunks go through the tokenizer as they are.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {"": b""}

    def learn(self, words: list[str]) -> None:
        if len(self.words) + len(words) > REMEMBERED:
            self.words = {"": b""}
        for lo in range(0, len(words), 4096):
            some = words[lo : lo + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            raw, at = ids.tobytes(), 0
            for word, stop in zip(some, (4 * cut).tolist(), strict=True):
                self.words[word] = raw[at:stop]
                at = stop

    def of_words(self, words: list[str]) -> list[bytes]:
        new = [w for w in words if w not in self.words]
        if new:
            if len(self.words) + len(new) > REMEMBERED:
                self.words, new = {"": b""}, [w for w in words if w]
            self.learn(new)
        return list(map(self.words.__getitem__, words))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, how many each text has). A chunk is a word and a mark, or odd and whole."""
        for blank in "\n\t\r":
            texts = pc.replace_substring(texts, blank, " ")
        distinct, at, sizes = chunks_of(texts)
        plain = pc.extract_regex(distinct, PLAIN)
        is_odd = pc.is_null(plain).to_numpy(zero_copy_only=False)
        words, marks = (pc.fill_null(pc.struct_field(plain, i), "").dictionary_encode() for i in (0, 1))
        lower = pc.utf8_lower(words.dictionary).dictionary_encode()
        values = self.of_words([*lower.dictionary.to_pylist(), *marks.dictionary.to_pylist()])
        word = lower.indices.to_numpy()[words.indices.to_numpy()].astype(np.int64)
        mark = marks.indices.to_numpy().astype(np.int64) + len(lower.dictionary)
        odd = np.flatnonzero(is_odd)
        word[odd] = len(values) + np.arange(len(odd))
        mark[odd] = len(values) + len(odd)
        for lo in range(0, len(odd), 1024):
            for e in self.tokenizer.encode_batch_fast(distinct.take(pa.array(odd[lo : lo + 1024])).to_pylist(), add_special_tokens=False):
                values.append(np.array(e.ids, "<u4").tobytes())
        values.append(b"")
        return spelled(values, "<u4", np.column_stack([word[at], mark[at]]).ravel(), 2 * sizes)


word_ids = remembered(WordIds)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): the documents' ids cut at every multiple of the capacity."""
    schema = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in batches:
            docs_left = iter(batch.column(0).to_pylist())
            for texts in gulps(batch.column(1)):
                ids, n = words.ids(texts)
                raw, stop = ids.tobytes(), 0
                cols: list[list] = [[], [], [], [], [], []]
                for size, doc in zip(n.tolist(), docs_left):
                    own = raw[4 * stop : 4 * (stop + size)] + end
                    stop += size
                    for first in range(0, size + 1, capacity):
                        part = own[4 * first : 4 * (first + capacity)]
                        for c, x in zip(cols, (doc, first, len(part) // 4, zlib.crc32(part), size + 1, part)):
                            c.append(x)
                arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
                if with_ids:
                    flat = pa.array(np.frombuffer(b"".join(cols[5]), "<i4"))
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(cols[2])]).astype(np.int32)), flat))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(arrays)])
        words.words = {"": b""}

    texts = text_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(encode, schema)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of remaining lengths whose sum is the largest that fits: bitset subset sums, counts by backtracking.

    A length's count is split into powers of two, so each length costs the logarithm of its count in shifts.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length)
        part = 1
        while left:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(length -> count, times) of every window; bounded by the number of lengths, not of pieces."""
    left, out = {k: v for k, v in counts.items() if v}, []
    if capacity in left:
        out.append(({capacity: 1}, left.pop(capacity)))
    while left:
        largest = max(left)
        left[largest] -= 1
        used = fill({k: v for k, v in left.items() if v and k <= capacity - largest}, capacity - largest)
        left[largest] += 1
        used[largest] = used.get(largest, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        out.append((used, times))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def layout(windows: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, last number + 1, count in a window, first sequence, offset of the length in it)."""
    rows, given, sequence = [], {}, 0
    for used, times in windows:
        offset = 0
        for length in sorted(used, reverse=True):
            n, first = used[length], given.get(length, 0)
            rows.append((length, first, first + n * times, n, sequence, offset))
            given[length] = first + n * times
            offset += n * length
        sequence += times
    return rows


def pack(parts: DataFrame, capacity: int = CAPACITY, bucket: int = BUCKET) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, start, length, ...); their other columns travel along."""
    spark = parts.sparkSession
    held = cut(parts)
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = layout(plan(counts, capacity))
    if not rows:
        return held.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    # As many buckets for each length as its pieces ask for; one entry a length.
    buckets = [math.ceil(counts.get(n, 1) / bucket) for n in range(1, capacity + 1)]
    spread = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.element_at(F.lit(buckets), F.col("length"))).cast("int")
    numbered = held.withColumn("bucket_", spread).withColumn(
        "in_bucket_", F.row_number().over(Window.partitionBy("length", "bucket_").orderBy("doc_id", "start", "ids_crc32"))
    )
    order = Window.partitionBy("length").orderBy("bucket_")
    sizes = held.withColumn("bucket_", spread).groupBy("length", "bucket_").agg(F.count(F.lit(1)).alias("n_"))
    starts = sizes.select("length", "bucket_", (F.sum("n_").over(order) - F.col("n_")).alias("before_"))
    ranked = numbered.join(starts, ["length", "bucket_"]).withColumn("number_", F.col("before_") + F.col("in_bucket_") - 1)
    # The plan: a few thousand rows, bounded by the capacity; each length holds the sorted starts of its number ranges.
    by_length: dict[int, list[tuple]] = {}
    for length, *rest in rows:
        by_length.setdefault(length, []).append(tuple(rest))
    table = spark.createDataFrame(
        [(k, v) for k, v in by_length.items()], "length int, ranges_ array<struct<lo:long,hi:long,n:long,sequence:long,offset:long>>"
    )
    mine = F.element_at(F.filter("ranges_", lambda r: (r["lo"] <= F.col("number_")) & (F.col("number_") < r["hi"])), 1)
    placed = ranked.join(F.broadcast(table), "length").withColumn("r_", mine)
    inside = F.col("number_") - F.col("r_.lo")
    return placed.select(
        *held.columns,
        (F.col("r_.sequence") + F.floor(inside / F.col("r_.n"))).cast("long").alias("sequence_id"),
        (F.col("r_.offset") + inside % F.col("r_.n") * F.col("length")).cast("long").alias("offset"),
    )


def packed(docs: DataFrame, path: str | None = None) -> DataFrame:
    parts = pieces(docs, path or public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return pack(parts).select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
