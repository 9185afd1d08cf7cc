"""Byte-level BPE encoding and decoding through a table of distinct words.

Texts are split into words where the vocabulary's pre-tokenizer always splits: before a blank that precedes a
non-blank, around other runs of white space, and between letters or digits and the punctuation after them. Documents are
dealt to blocks of about BLOCK characters (a scan partition, cut where it is larger). Every block emits its distinct
words; Spark brings equal words of all blocks together, a word of several blocks is encoded once, and its ids go back to
the blocks that asked. There each document's words, in their positions, take their ids from the block's table. A word
that only one block has is encoded by that block, once. What travels is the distinct words of a block, not its word
occurrences, and the texts once, compressed.

Decoding joins the ids, in their positions, to the id-to-piece table. For a table of coded documents, decode() does so as
a Spark join with a row a token. In the query that would be many times the corpus, so there each block's task joins its
ids to the same table (bounded by the vocabulary) as arrays: a map-side join by id, in the order of the positions.

A word that a block's table lacks (rows that came in another order on a second read) is encoded on the spot, so a
recomputed partition gives the same result. A block's table is bounded by the block's own size.

Defined results: null or empty text has 0 tokens and the digest of an empty string; a text that holds a special token's
string, or white space on which splitters disagree, is one word and so is encoded whole; repeated rows and null ids are
rows of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import chunks_of, gulps, remembered, spelled, text_of

#: Characters of a block, and distinct words that a scan or an encoder holds before it emits them.
BLOCK = 16 << 20
FLUSH = 400_000
#: Characters of the texts that are compressed together.
PACK = 4 << 20
LEVEL = 9

WORD = re.compile(r" ?[^\s]+|\s+(?!\S)|\s+")
#: A word of plain letters or digits and the punctuation behind it, which the pre-tokenizer always parts from it.
PLAIN = r"^(?P<word> ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+|)(?P<mark> ?[!-&(-/:;=-@\[-`{-~]+|)$"
PLAIN_WORD = re.compile(PLAIN)
LED = re.compile(r" [A-Za-zÀ-ÖØ-öø-ÿ]+")
#: A blank before white space or the end: there words are not chunks, and the text is split by WORD instead.
LOOSE = "^ (?:$|[\\s\\v\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}])"
ODD = "\x1c-\x1f\x85\u180e\u200b\ufeff"

ORACLE_SQL = None  # a tokenizer's merges; tests hold an exact round trip and the library's own ids


def tokenizer(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def specials(t: Tokenizer) -> list[str]:
    return [x.content for x in t.get_added_tokens_decoder().values()]


def split(text: str, special: list[str]) -> list[str]:
    """The words of one text."""
    if not text:
        return []
    return [text] if re.search(f"[{ODD}]", text) or any(s in text for s in special) else WORD.findall(text)


def atoms(word: str) -> list[str]:
    """A word as plain letters and the punctuation after them, if it is of that form."""
    m = PLAIN_WORD.fullmatch(word)
    return [x for x in m.groups() if x] if m else [word]


class Parsed:
    """Texts as numbers of distinct chunks (cut before each blank), and the chunks as words and marks.

    odd chunks are split by WORD; the texts in `loose` (row numbers) are split as a whole, without their chunks."""

    def __init__(self, texts: pa.Array, special: list[str]):
        found, at, self.sizes = chunks_of(texts)
        code = at * 2
        code[np.cumsum(self.sizes) - self.sizes] += 1
        present = np.zeros(2 * len(found), bool)
        present[code] = True
        own = np.flatnonzero(present)
        self.at = (np.cumsum(present) - 1)[code]
        bare = found.take(pa.array(own >> 1))
        self.chunks = pc.if_else(pa.array(own & 1 == 1), bare, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), bare, pa.scalar("", pa.large_string())))
        plain = pc.extract_regex(self.chunks, PLAIN)
        self.odd = np.flatnonzero(pc.is_null(plain).to_numpy(zero_copy_only=False))
        self.words, self.marks = (pc.fill_null(pc.struct_field(plain, i), "").dictionary_encode() for i in (0, 1))
        apart = pc.match_substring_regex(self.chunks, "|".join([LOOSE, f"[{ODD}]", *map(re.escape, special)])).to_numpy(zero_copy_only=False)
        hit = np.concatenate([[0], np.cumsum(apart[self.at])])
        ends = np.cumsum(self.sizes)
        self.loose = np.flatnonzero(hit[ends] > hit[ends - self.sizes])
        self.loose_words = [split(texts[int(i)].as_py(), special) for i in self.loose]
        self.odd_words = [[a for w in WORD.findall(c) for a in atoms(w)] for c in self.chunks.take(pa.array(self.odd)).to_pylist()]

    def distinct(self) -> set[str]:
        out = {*self.words.dictionary.to_pylist(), *self.marks.dictionary.to_pylist()}
        out.update(*self.odd_words)
        for words in self.loose_words:
            out.update(a for w in words for a in atoms(w))
        out.discard("")
        return out


class Encoder:
    """Words -> their ids as arrays of `kind`; blank-led words of letters are encoded together and part at their blanks."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.special = specials(self.tokenizer)
        vocabulary = self.tokenizer.get_vocab()
        self.kind = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        self.led = np.zeros(max(vocabulary.values()) + 1, bool)
        self.led[[i for piece, i in vocabulary.items() if piece.startswith("Ġ")]] = True

    def encode(self, words: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        led = [w for w in words if LED.fullmatch(w)]
        for lo in range(0, len(led), 4096):
            some = led[lo : lo + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, np.int64)
            edges, raw = np.append(np.flatnonzero(self.led[ids]), len(ids)) * np.dtype(self.kind).itemsize, ids.astype(self.kind).tobytes()
            for word, a, b in zip(some, edges.tolist(), edges[1:].tolist(), strict=False):
                out[word] = raw[a:b]
        rest = [w for w in words if w not in out]
        for lo in range(0, len(rest), 1024):
            some = rest[lo : lo + 1024]
            for word, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                out[word] = np.array(e.ids, self.kind).tobytes()
        return out


encoders = remembered(Encoder)


class Table(dict):
    """atom -> its ids; atoms that the table lacks are encoded together."""

    def __init__(self, encoder: Encoder):
        super().__init__({"": b""})
        self.encoder = encoder

    def of(self, words: list[str]) -> list[bytes]:
        if new := [w for w in words if w not in self]:
            self.update(self.encoder.encode(new))
        return list(map(self.__getitem__, words))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, how many each text has)."""
        p = Parsed(texts, self.encoder.special)
        self.of([w for own in (*p.odd_words, *([a for x in words for a in atoms(x)] for words in p.loose_words)) for w in own])
        values = self.of([*p.words.dictionary.to_pylist(), *p.marks.dictionary.to_pylist()])
        word, mark = p.words.indices.to_numpy().astype(np.int64), p.marks.indices.to_numpy() + np.int64(len(p.words.dictionary))
        word[p.odd] = len(values) + np.arange(len(p.odd))
        mark[p.odd] = len(values) + len(p.odd)
        values += [*(b"".join(map(self.__getitem__, own)) for own in p.odd_words), b""]
        flat, n = spelled(values, self.encoder.kind, np.column_stack([word[p.at], mark[p.at]]).ravel(), 2 * p.sizes)
        if not len(p.loose):
            return flat, n
        parts = np.split(flat, np.cumsum(n)[:-1])
        for i, words in zip(p.loose.tolist(), p.loose_words):
            parts[i] = np.frombuffer(b"".join(self[a] for w in words for a in atoms(w)), self.encoder.kind)
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)


def piece_bytes(t: Tokenizer) -> dict[int, bytes]:
    """The id-to-piece table: a byte-level vocabulary writes each byte as one printable character."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in printable}
    char |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    special = t.get_added_tokens_decoder()
    out = {}
    for piece, i in t.get_vocab().items():
        out[i] = special[i].content.encode() if i in special else bytes(char[c] for c in piece)
    return out


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece binary); bounded by the vocabulary."""
    return spark.createDataFrame(sorted(piece_bytes(tokenizer(path)).items()), "id int, piece binary")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) -> (doc_id, text): ids by position joined to their pieces. doc_id is a key here."""
    spark = coded.sparkSession
    at = coded.select("doc_id", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(vocabulary(spark, path)), "id")
    joined = at.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("piece")))).alias("p"))
    text = F.try_to_binary(F.array_join(F.transform("p", lambda x: x["piece"]), ""), F.lit("hex"))
    return coded.select("doc_id").distinct().join(joined, "doc_id", "left").select("doc_id", F.coalesce(F.decode(text, "UTF-8"), F.lit("")).alias("text"))


def numbered(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of the batches (partition, doc_id, text) with their block: a partition's rows, cut every `block` characters."""
    size = 0
    for batch in batches:
        ends = size + np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(batch):
            number = size // block
            hi = max(lo + 1, int(np.searchsorted(ends, (number + 1) * block)) + 1)
            yield (batch.column(0)[0].as_py() << 20) + number, batch.slice(lo, hi - lo)
            size, lo = int(ends[min(hi, len(batch)) - 1]), hi


def block_words(path: str, block: int):  # noqa: ANN201
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special, seen, held = encoders(path).special, set(), None

        def out() -> pa.RecordBatch:
            words = sorted(seen)
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(words), held, np.int64)), pa.array(words, pa.string())], names=["block", "word"])

        for number, rows in numbered(batches, block):
            if held != number and seen:
                yield out()
            held = number
            for texts in gulps(rows.column(2)):
                seen |= Parsed(texts, special).distinct()
                if len(seen) >= FLUSH:
                    yield out()
        if seen:
            yield out()

    return emit


def packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as w:
        w.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpacked(value: bytes) -> pa.Table:
    with pa.ipc.open_stream(value) as r:
        return r.read_all()


def parcels(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["block", "kind", "parcel"])


def packed_texts(block: int):  # noqa: ANN201
    """Texts of a block, some hundreds at a time, as one compressed parcel of kind 1."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in numbered(batches, block):
            at = 0
            for texts in gulps(rows.column(2), PACK):
                yield parcels([(number, 1, packed(rows.slice(at, len(texts)).select(["doc_id", "text"])))])
                at += len(texts)

    return pack


def encoder(path: str):  # noqa: ANN201
    """Words in order, equal ones of all blocks side by side -> parcels of kind 0 for the blocks that asked.

    A word that two or more blocks asked for is encoded here, once, for all of them. A word of a single block is left to
    that block, which then is the one place that encodes it, so it need not travel back."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """(words that several blocks have, word number and block of each asking)."""
        words, blocks = pa.array([], pa.large_string()), np.zeros(0, np.int64)

        def runs(words: pa.Array, blocks: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
            new = np.concatenate([[True], pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)])
            first = np.flatnonzero(new)
            many = np.diff(first, append=len(words)) > 1
            keep = np.repeat(many, np.diff(first, append=len(words)))
            return words.take(pa.array(first[many])), (np.cumsum(many) - 1)[np.cumsum(new) - 1][keep], blocks[keep]

        for batch in batches:
            words = pa.concat_arrays([words, batch.column(1).cast(pa.large_string())])
            blocks = np.concatenate([blocks, batch.column(0).to_numpy()])
            if len(words) < FLUSH:
                continue
            same = np.flatnonzero(pc.not_equal(words, words[-1]).to_numpy(zero_copy_only=False))
            edge = int(same[-1]) + 1 if len(same) else 0
            if edge:
                yield runs(words[:edge], blocks[:edge])
                words, blocks = pa.concat_arrays([words[edge:]]), blocks[edge:]
        if len(words):
            yield runs(words, blocks)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoders(path)
        for words, which, blocks in shared(batches):
            if not len(words):
                continue
            named = words.to_pylist()
            ids = pa.array(list(map(own.encode(named).__getitem__, named)), pa.binary())
            order = np.lexsort((which, blocks))
            which, blocks = which[order], blocks[order]
            edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            out = []
            for a, b in zip(edges, edges[1:]):
                at = pa.array(which[a:b])
                out.append((int(blocks[a]), 0, packed(pa.RecordBatch.from_arrays([words.take(at), ids.take(at)], names=["word", "ids"]))))
            yield parcels(out)

    return encode


def joiner(path: str):  # noqa: ANN201
    """Parcels by (block, kind): the block's table first, then its texts, whose words take their ids by position."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoders(path)
        block, table = None, Table(own)
        decimal = [b"%d," % i for i in range(len(own.led))]
        by_id = piece_bytes(own.tokenizer)
        pieces = [by_id.get(i, b"") for i in range(len(own.led))]
        for batch in batches:
            for i in range(len(batch)):
                b, kind, parcel = (batch.column(k)[i].as_py() for k in range(3))
                if b != block:
                    table, block = Table(own), b
                part = unpacked(parcel).combine_chunks()
                if kind == 0:
                    table.update(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
                    continue
                docs, at = part.column(0).combine_chunks(), 0
                for texts in gulps(part.column(1).combine_chunks()):
                    ids, n = table.ids(texts)
                    digests = []
                    for values, less in ((decimal, 1), (pieces, 0)):
                        raw, sizes = spelled(values, "u1", ids, n)
                        raw, edges = memoryview(raw), [0, *np.cumsum(sizes).tolist()]
                        digests.append(pa.array([hashlib.sha256(raw[a : max(a, z - less)]).hexdigest() for a, z in zip(edges, edges[1:])], pa.string()))
                    yield pa.RecordBatch.from_arrays([docs.slice(at, len(texts)), pa.array(n), *digests], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                    at += len(texts)

    return join


def coded(docs: DataFrame, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    texts = text_of(docs).select(F.spark_partition_id().cast("long").alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = texts.mapInArrow(block_words(path, block), "block long, word string").repartition("word").sortWithinPartitions("word")
    parcel = "block long, kind int, parcel binary"
    table, bodies = asked.mapInArrow(encoder(path), parcel), texts.mapInArrow(packed_texts(block), parcel)
    both = table.unionByName(bodies).repartition("block").sortWithinPartitions("block", "kind")
    return both.mapInArrow(joiner(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
