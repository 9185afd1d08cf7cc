"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a piece (a match of the public pattern) has exactly one encoding, hence exactly one last token. A token may
end a prefix if and only if merging the bytes of the token before it and its own gives just these two; so the last token of
each prefix follows from those of shorter ones, in one pass and without running the merges over the piece (an automaton of the
tokens names those that end at each byte). The table of
last tokens is the encoding of all prefixes at once: an append goes on from its end, an edit starts at the first changed
byte and stops as soon as as many last tokens as the longest token has bytes agree with the old table again.

The query walks a document as chunks between blanks; a worker remembers the ids of pieces, up to a bound, so a frequent word
is encoded once, and no rows are shuffled. prefixes() stores the table of each document and revised() applies edits to it.

Defined results: null or empty text has 0 tokens and the digest of an empty string; strings that look like special tokens
are ordinary text; repeated rows and null ids are rows of their own; an empty table gives no rows; extra columns are
ignored. A text longer than a gulp is taken in slices that end before a blank between two other characters, where pieces
always part; without such a place, the rest is one slice (its table is linear in its length).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GULP, chunks_of, gulps, remembered, spelled, text_of

#: Pieces that a worker remembers (twice: those met since it last filled up, and the filling before), and token pairs.
PIECES = 250_000
PAIRS = 400_000
#: No token yet, and the place before the first token.
NONE, START = -2, -1
#: A chunk that begins so may hang together with the one before, so its text is split as a whole.
LOOSE = "^ (?:$|[\\s\\v\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}])"
PLACE = regex.compile(r"(?<=\S) (?=\S)")

ORACLE_SQL = None  # a tokenizer's merges; tests hold the library's own ids and an exact round trip


def ranges(chars: set[int]) -> str:
    """A character class's inside."""
    out, points = [], sorted(chars)
    edges = [0, *[i for i in range(1, len(points)) if points[i] != points[i - 1] + 1], len(points)]
    for a, b in zip(edges, edges[1:]):
        out.append(f"\\U{points[a]:08x}-\\U{points[b - 1]:08x}")
    return "".join(out)


class Splitter:
    """The public pattern with the character classes of the library that defines the ids.

    Unicode versions differ between regular expression engines: a text with a character on whose class they disagree is
    split by explicit classes, as the library has them."""

    def __init__(self):
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        single = {bytes([b]): b for b in range(256)}
        exact, odd = public_tokenizers.PATTERN, set()
        for kind in ("L", "N"):
            theirs = tiktoken.Encoding("class", pat_str=rf"\p{{{kind}}}", mergeable_ranks=single, special_tokens={})
            held = set(map(ord, bytes(theirs.encode_ordinary(every)).decode()))
            odd |= held ^ set(map(ord, regex.findall(rf"\p{{{kind}}}", every)))
            inside = ranges(held)
            exact = exact.replace(r"[^\s\p{L}\p{N}]", r"[^\s@L@N]").replace(rf"\p{{{kind}}}+", f"[{inside}]+").replace(f"@{kind}", inside)
        self.plain, self.exact = regex.compile(public_tokenizers.PATTERN), regex.compile(exact)
        self.odd = regex.compile(f"[{ranges(odd)}]") if odd else None

    def pattern(self, text: str) -> regex.Pattern:
        return self.exact if self.odd is not None and not text.isascii() and self.odd.search(text) else self.plain


class Ranks:
    """A vocabulary of ranked tokens, with what a worker remembers of it."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.rank.values()) + 1
        self.token = [b""] * self.size
        self.ends = ahocorasick.Automaton()
        for t, i in self.rank.items():
            self.token[i] = t
            self.ends.add_word(t.decode("latin-1"), (i, len(t)))
        self.ends.make_automaton()
        self.longest = max(map(len, self.rank))
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.split = Splitter()
        self.follows: dict[int, bool] = {}
        self.spines: dict[int, list[int] | None] = {}
        self.recent: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def merged(self, data: bytes, until: int = 1) -> list[bytes]:
        """The merges themselves, for the bytes of a token or two, down to `until` parts."""
        parts, never = [data[i : i + 1] for i in range(len(data))], self.size
        while len(parts) > until:
            least, at = min((self.rank.get(a + b, never), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if least == never:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, token: int, side: int) -> list[int] | None:
        """The pieces at the first (side 0) or last (1) byte of a token while it is merged, byte to token.

        None where a part has a higher rank than the whole, so that ranks don't tell when a piece appears."""
        key = token * 2 + side
        if key not in self.spines:
            data, out = self.token[token], [token]
            if len(data) > 1:
                parts = self.merged(data, 2)
                ids = [self.rank[p] for p in parts]
                below = [self.spine(i, side) for i in ids] if len(ids) == 2 and max(ids) < token else [None]
                out = None if None in below else [*below[side], token]
            self.spines[key] = out
        return self.spines[key]

    def parted(self, before: int, token: int) -> bool:
        """Whether no merge crosses from one token into the next: each pair of pieces that meet at the border, in the
        order of the ranks, must change on its left or right before its own merge is due (left ones first among equals)."""
        a, b = self.spine(before, 1), self.spine(token, 0)
        if a is None or b is None:
            pair = [self.token[before], self.token[token]]
            return self.merged(b"".join(pair)) == pair
        i = j = 0
        while True:
            left, right = (x[k + 1] if k + 1 < len(x) else self.size for x, k in ((a, i), (b, j)))
            due = self.rank.get(self.token[a[i]] + self.token[b[j]])
            if due is not None and due < left and due <= right:
                return False
            if left == right == self.size:
                return True
            if left <= right:
                i += 1
            else:
                j += 1

    def may_follow(self, before: int, token: int) -> bool:
        key = before * self.size + token
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) >= PAIRS:
                self.follows.clear()
            alone = self.token[token]
            known = self.follows[key] = self.merged(alone) == [alone] if before == START else self.parted(before, token)
        return known

    def lasts(self, piece: bytes, old: bytes = b"", was: list[int] | None = None) -> tuple[list[int], int]:
        """(last token of each prefix of the piece, how many were computed), given those of an earlier form of it."""
        was, n = was or [], len(piece)
        same = next((i for i, (a, b) in enumerate(zip(piece, old)) if a != b), min(n, len(old)))
        tail = next((i for i, (a, b) in enumerate(zip(reversed(piece[same:]), reversed(old[same:]))) if a != b), min(n, len(old)) - same)
        last, shift, agree, done = [START, *was[:same], *[NONE] * (n - same)], n - len(old), 0, same
        from_ = max(0, same - self.longest)
        for end, (token, size) in self.ends.iter(piece[from_:].decode("latin-1")):
            end += from_ + 1
            if end > done + 1:  # place done + 1 is settled
                done += 1
                if tail and done > n - tail:
                    agree = agree + 1 if last[done] == was[done - shift - 1] else 0
                    if agree >= self.longest:
                        return [*last[1 : done + 1], *was[done - shift :]], done - same
            if last[end] == NONE and end - size >= from_ and self.may_follow(last[end - size], token):
                last[end] = token
        return last[1:], n - same

    def of_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of many pieces as bytes, from one pass over all of them; a mark that no token holds parts the pieces."""
        last, follows, size, may = [], self.follows, self.size, self.may_follow
        for p in pieces:
            last += [START, *[NONE] * len(p)]
        for end, (token, n) in self.ends.iter("\u0100" + "\u0100".join(p.decode("latin-1") for p in pieces)):
            if last[end] == NONE:
                before = last[end - n]
                known = follows.get(before * size + token)
                if may(before, token) if known is None else known:
                    last[end] = token
        out, at, own, token, kind = [], len(last) - 1, [], self.token, self.kind
        while at >= 0:
            t = last[at]
            if t == START:
                out.append(np.array(own[::-1], kind).tobytes())
                own, at = [], at - 1
            else:
                own.append(t)
                at -= len(token[t])
        return out[::-1]

    def walked(self, piece: bytes, last: list[int]) -> list[int]:
        """The ids of a piece, back from its end."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        out, at = [], len(piece)
        while at:
            out.append(last[at - 1])
            at -= len(self.token[out[-1]])
        return out[::-1]

    def coded(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks as bytes; short pieces are remembered, and those not met for long are forgotten."""
        rank, kind, recent, before = self.rank, self.kind, self.recent, self.before
        split = [[p.encode() for p in self.split.pattern(c).findall(c)] for c in chunks]
        known: dict[bytes, bytes] = {}
        rest = []
        for piece in {p for pieces in split for p in pieces}:
            ids = recent.get(piece)
            if ids is None:
                ids = before.get(piece)
                if ids is None:
                    if piece not in rank:
                        rest.append(piece)
                        continue
                    ids = np.array([rank[piece]], kind).tobytes()
                if len(piece) <= 64:
                    recent[piece] = ids
            known[piece] = ids
        new = list(zip(rest, self.of_pieces(rest)))
        known.update(new)
        recent.update((p, ids) for p, ids in new if len(p) <= 64)
        if len(recent) > PIECES:
            self.before, self.recent = recent, {}
        return [b"".join(map(known.__getitem__, pieces)) for pieces in split]

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, how many each has)."""
        found, at, sizes = chunks_of(texts)
        code = at * 2
        code[np.cumsum(sizes) - sizes] += 1
        used, at = np.unique(code, return_inverse=True)
        bare = found.take(pa.array(used >> 1))
        chunks = pc.if_else(pa.array(used & 1 == 1), bare, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), bare, pa.scalar("", pa.large_string())))
        loose = pc.match_substring_regex(chunks, LOOSE).to_numpy(zero_copy_only=False)
        tight = np.flatnonzero(~loose)
        values = np.full(len(loose), b"", object)
        values[tight] = np.array(self.coded(chunks.take(pa.array(tight)).to_pylist()), object)
        flat, n = spelled(values.tolist(), self.kind, at, sizes)
        hit, ends = np.concatenate([[0], np.cumsum(loose[at])]), np.cumsum(sizes)
        whole = np.flatnonzero(hit[ends] > hit[ends - sizes])
        if not len(whole):
            return flat, n
        parts = np.split(flat, np.cumsum(n)[:-1])
        for i in whole.tolist():
            text = texts[i].as_py()
            parts[i] = np.frombuffer(b"".join(self.coded(self.split.pattern(text).findall(text))), self.kind)
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)


vocabularies = remembered(Ranks)


def slices(text: str, size: int = GULP) -> Iterator[str]:
    """A long text in parts whose pieces are the text's pieces."""
    lo = 0
    while len(text) - lo > size:
        place = PLACE.search(text, lo + size)
        if place is None:
            break
        yield text[lo : place.start()]
        lo = place.start()
    yield text[lo:]


def spread(own: Ranks, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids end to end, how many each row has); a long text comes as several parts with the same row."""
    at = 0
    for some in gulps(texts):
        if len(some) == 1 and len(some[0].as_py()) > GULP:
            for part in slices(some[0].as_py()):
                yield at, *own.of_texts(pa.array([part], pa.large_string()))
        else:
            yield at, *own.of_texts(some)
        at += len(some)


def digests(path: str):  # noqa: ANN201
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabularies(path)
        spellings = [([b"%d," % i for i in range(own.size)], 1), (own.token, 0)]
        for batch in batches:
            counts = np.zeros(len(batch), np.int64)
            shas = [[None] * len(batch) for _ in spellings]
            for row, ids, n in spread(own, batch.column(1)):
                for held, (values, less) in zip(shas, spellings):
                    raw, sizes = spelled(values, "u1", ids, n)
                    raw, edges = memoryview(raw), [0, *np.cumsum(sizes).tolist()]
                    for i, (a, z) in enumerate(zip(edges, edges[1:]), row):
                        if held[i] is None:
                            held[i] = hashlib.sha256(raw[a : max(a, z - less)])
                        elif z > a:  # a further part of a long text
                            held[i].update(b"," * less)
                            held[i].update(raw[a : z - less])
                counts[row : row + len(n)] += n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), *(pa.array([h.hexdigest() for h in held], pa.string()) for held in shas)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def coded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of docs: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    texts = text_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(digests(path or default_path()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>): the ids themselves."""
    path = path or default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabularies(path)
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(len(batch))]
            for row, ids, n in spread(own, batch.column(1)):
                for i, x in enumerate(np.split(ids, np.cumsum(n)[:-1]), row):
                    parts[i].append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.concatenate(x) for x in parts], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return text_of(docs).mapInArrow(encode, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) -> (doc_id, data binary); ids that the vocabulary lacks are nothing."""
    path = path or default_path()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = vocabularies(path).token
        for batch in batches:
            data = [b"".join(token[i] for i in x or () if i is not None and 0 <= i < len(token)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return ids.select("doc_id", "ids").mapInArrow(decode, f"doc_id {dict(ids.dtypes)['doc_id']}, data binary")


class Prefixes:
    """A text with the ends of its pieces (characters) and the last token of each prefix of each piece (a byte each)."""

    def __init__(self, own: Ranks, text: str = "", ends: list[int] | None = None, last: list[int] | None = None):
        self.own, self.text, self.ends, self.last, self.computed = own, "", [], [], 0
        if ends is None:
            self.edit(0, 0, text)
        else:
            self.text, self.ends, self.last = text, ends, last

    def edit(self, start: int, stop: int, put: str) -> None:
        """Replace characters start to stop; only pieces that the edit can reach are split and computed anew."""
        own, old, delta = self.own, self.text, len(put) - (stop - start)
        text = old[:start] + put + old[stop:]
        pattern = own.split.pattern(text)
        # A piece's end depends on at most two characters after it.
        kept = 0 if pattern is not own.split.pattern(old) else sum(e + 2 <= start for e in self.ends)
        began = [0, *self.ends]
        sizes = [len(old[a:b].encode()) for a, b in zip(began, self.ends)]
        at = np.concatenate([[0], np.cumsum(sizes)]).astype(int).tolist()
        number = {e: i for i, e in enumerate(self.ends)} if pattern is own.split.pattern(old) else {}
        ends, last, self.computed, rest = self.ends[:kept], self.last[: at[kept]], 0, len(self.ends)
        for k, m in enumerate(pattern.finditer(text, ends[-1] if ends else 0)):
            piece, before = m[0].encode(), b""
            if k == 0 and kept < len(self.ends):
                before = old[began[kept] : self.ends[kept]].encode()
            fresh, n = own.lasts(piece, before, self.last[at[kept] : at[kept + 1]] if before else [])
            self.computed += n
            ends.append(m.end())
            last += fresh
            if m.end() >= start + len(put) and m.end() - delta in number:
                rest = number[m.end() - delta] + 1
                break
        self.text, self.ends, self.last = text, ends + [e + delta for e in self.ends[rest:]], last + self.last[at[rest] :]

    def append(self, put: str) -> None:
        self.edit(len(self.text), len(self.text), put)

    def ids(self) -> list[int]:
        out, a, at = [], 0, 0
        for b in self.ends:
            piece = self.text[a:b].encode()
            out += self.own.walked(piece, self.last[at : at + len(piece)])
            a, at = b, at + len(piece)
        return out


STORED = "text string, ends array<int>, last array<int>"


def stored_rows(ids: pa.Array, tables: list[Prefixes], *more: tuple[str, pa.Array]) -> pa.RecordBatch:
    columns = [ids, pa.array([t.text for t in tables], pa.string()), *(pa.array([getattr(t, c) for t in tables], pa.list_(pa.int32())) for c in ("ends", "last")), *(x for _, x in more)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "ends", "last", *(n for n, _ in more)])


def prefixes(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text, ends, last): the table of each document, to be written and edited later."""
    path = path or default_path()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabularies(path)
        for batch in batches:
            for i in range(len(batch)):
                yield stored_rows(batch.column(0).slice(i, 1), [Prefixes(own, batch.column(1)[i].as_py())])

    return text_of(docs).mapInArrow(build, f"doc_id {dict(docs.dtypes)['doc_id']}, {STORED}")


def revised(stored: DataFrame, edits: DataFrame, path: str | None = None) -> DataFrame:
    """Stored tables after edits (doc_id, start, stop, put: characters start to stop become put), by a join on doc_id.

    Documents without an edit stay as they are, with 0 computed; several edits of a document give a row each. Positions
    beyond the text mean its end, a null position 0 or the end, a null put nothing."""
    path = path or default_path()

    def revise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabularies(path)
        for batch in batches:
            for i, r in enumerate(batch.to_pylist()):
                table = Prefixes(own, r["text"], r["ends"], r["last"])
                if r["edited"]:
                    start = min(max(r["start"] or 0, 0), len(r["text"]))
                    stop = len(r["text"]) if r["stop"] is None else min(max(r["stop"], start), len(r["text"]))
                    table.edit(start, stop, r["put"] or "")
                yield stored_rows(batch.column(0).slice(i, 1), [table], ("computed", pa.array([table.computed], pa.int64())))

    own = edits.select("doc_id", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), F.col("put").cast("string").alias("put"), F.lit(True).alias("edited"))
    both = stored.select("doc_id", "text", "ends", "last").join(own, "doc_id", "left")
    return both.mapInArrow(revise, f"doc_id {dict(stored.dtypes)['doc_id']}, {STORED}, computed long")


def op12_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
