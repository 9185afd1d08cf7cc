"""Secret scan: pattern matches plus a randomness test battery with length-aware false-discovery control.

The battery looks at every token of 20 or more characters that mixes letters and digits. It infers the token's encoding
(hexadecimal, base 32 or base 64), maps it to symbol numbers and runs three tests of the hypothesis "symbols are drawn
uniformly and independently": chi-squared uniformity over as many equal slices of the alphabet as the length supports,
a runs test about the middle of the alphabet, and lag-1 serial correlation. The smallest of the three p-values, times
three, is the token's p-value. Two controls follow, over the whole corpus and separately for each encoding and length
class (a short token's tests have little power, so it competes only with its like):
    * Benjamini-Hochberg at level Q rejects the tokens that are structured; they are out.
    * What is left is reported only while the estimated share of structured tokens among the reported stays at most
      REPORTED. Random tokens' p-values are uniform, so the tokens with p-values above half, twice, estimate the random
      ones (Storey); tokens with p-values of t or more number N(t), of which about (1 - t) times that estimate are
      random. The threshold t is the least at which the rest of N(t) is at most REPORTED of it. A class whose tokens are
      nearly all random keeps all that the first control left; one with many structured tokens keeps the upper end only.
Words and numbers put together ("release-notes-2024-docs", "ModelTrainIndex7") are no symbols of an encoding: tokens
whose parts between "-", "_", "/" and "+" are all letters with a short number behind or numbers are not candidates, nor
are capitalised words in a row, nor tokens of one letter case with fewer than four digits that are not hexadecimal or
base 32.

P-values are kept as steps of a logarithmic grid, so the corpus-wide step needs only one count for each (encoding,
length class, step): a few thousand rows whatever the corpus.

Defined results: null or empty text has no spans and the digest of an empty string; repeated rows and null ids are kept
as rows of their own; tokens of one step of the grid are reported or dropped together; texts of any length are scanned
whole, one at a time; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, text_of

#: Level of the control on structured tokens, and the largest estimated share of them among the reported.
Q, REPORTED = 0.05, 0.1
MIN_TOKEN = 20
STEPS, STEP = 240, 0.05
LENGTH_CLASSES = (24, 32, 48, 64, 128)
KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What joins the parts of a name, a part (letters, then a short number; or a number), and capitalised words in a row.
JOINTS = re.compile(r"[-_/+]")
PART = re.compile(r"[A-Za-z]*[0-9]{0,4}|[0-9]{1,8}")
TITLED = re.compile(r"(?:[A-Z][a-z]{2,}){2,}[0-9]{0,4}")

ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
INDEX = {name: {c: i for i, c in enumerate(letters)} for name, letters in ALPHABETS.items()}
ENCODINGS = tuple(ALPHABETS)

SCAN_SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:int,kind:int,stop:int>>, "
    "tokens array<struct<start:int,stop:int,encoding:int,length_class:int,step:int,inside:boolean>>"
)
ORACLE_SQL = None  # code-point spans and a test battery; tests hold it against brute force


def encoding_of(token: str) -> str | None:
    """The narrowest alphabet that holds a token of letters and digits; None for plain words, plain numbers and the two
    put together."""
    letters = any(c.isalpha() for c in token)
    if not letters or not any(c.isdigit() for c in token):
        return None
    parts = JOINTS.split(token)
    if len(parts) > 1 and all(map(PART.fullmatch, parts)) or TITLED.fullmatch(token):
        return None
    if set(token) <= INDEX["hex"].keys() or set(token.lower()) <= INDEX["hex"].keys() and token.isupper():
        return "hex"
    if set(token) <= INDEX["base32"].keys():
        return "base32"
    if (token == token.lower() or token == token.upper()) and sum(c.isdigit() for c in token) < 4:
        return None
    return "base64"


def chi_squared_tail(x: float, df: int) -> float:
    """P(chi-squared with df > x), by the Wilson-Hilferty cube root."""
    if x <= 0:
        return 1.0
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(symbols: list[int], size: int) -> tuple[float, float, float]:
    """P-values of uniformity, runs and serial correlation for symbols drawn from range(size)."""
    n = len(symbols)
    slices = max(2, min(size, n // 4))
    seen = [0] * slices
    for s in symbols:
        seen[s * slices // size] += 1
    widths = [0] * slices
    for s in range(size):
        widths[s * slices // size] += 1
    x = sum((o - n * w / size) ** 2 / (n * w / size) for o, w in zip(seen, widths))
    uniform = chi_squared_tail(x, slices - 1)
    high = [s >= size / 2 for s in symbols]
    changes = sum(a != b for a, b in zip(high, high[1:]))
    runs = math.erfc(abs(changes - (n - 1) / 2) / math.sqrt((n - 1) / 4) / math.sqrt(2))
    middle, spread = (size - 1) / 2, (size * size - 1) / 12
    r = sum((a - middle) * (b - middle) for a, b in zip(symbols, symbols[1:])) / spread / math.sqrt(n - 1)
    return uniform, runs, math.erfc(abs(r) / math.sqrt(2))


def step_of(p: float) -> int:
    """The grid step whose upper edge is the next p-value up: 10 ** (-STEP * step)."""
    return min(STEPS, max(0, int(-math.log10(max(p, 1e-300)) / STEP)))


def judge(token: str) -> tuple[int, int, int] | None:
    """(encoding, length class, step) of a candidate token."""
    name = encoding_of(token)
    if name is None:
        return None
    index = INDEX[name]
    plain = token.lower() if name == "hex" else token.replace("-", "+").replace("_", "/")
    p = min(1.0, 3 * min(battery([index[c] for c in plain], len(index))))
    return ENCODINGS.index(name), sum(len(token) >= x for x in LENGTH_CLASSES), step_of(p)


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int, int, bool]]]:
    """(base spans as (start, kind, stop), candidate tokens). Access keys and hexadecimal runs lie in long runs only."""
    base = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    runs = [m.span() for m in RUN.finditer(text)]
    for a, b in runs:
        part = text[a:b]
        base += [(a + m.start(), 1, a + m.end()) for m in ACCESS.finditer(part) if m.end() - m.start() >= 20]
        base += [(a + m.start(), 2, a + m.end()) for m in HEX.finditer(part)]
    base.sort()
    tokens = []
    for a, b in runs:
        if (found := judge(text[a:b])) is not None:
            tokens.append((a, b, *found, any(s < b and a < e for s, _, e in base)))
    return base, tokens


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
    token = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("encoding", pa.int32()), ("length_class", pa.int32()), ("step", pa.int32()), ("inside", pa.bool_())]))
    for batch in batches:
        counts, digests, bases, tokens = ([], [], []), [], [], []
        for text in batch.column(1).to_pylist():
            base, found = find(text)
            for k in range(3):
                counts[k].append(sum(x[1] == k for x in base))
            digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest())
            bases.append([dict(zip(("start", "kind", "stop"), x)) for x in base])
            tokens.append([dict(zip(("start", "stop", "encoding", "length_class", "step", "inside"), x)) for x in found])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(bases, span), pa.array(tokens, token), *batch.columns[2:]],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "tokens", *batch.schema.names[2:]],
        )


def thresholds(scanned: DataFrame, q: float = Q, reported: float = REPORTED) -> dict[tuple[int, int], int]:
    """By (encoding, length class), the first step that is not reported. At most 18 entries.

    Step s holds p-values from 10 ** (-STEP * (s + 1)) to 10 ** (-STEP * s)."""
    counts = scanned.select(F.explode("tokens").alias("t")).groupBy("t.encoding", "t.length_class", "t.step").agg(F.count(F.lit(1)).alias("n"))
    stratum = Window.partitionBy("encoding", "length_class")
    total = F.sum("n").over(stratum)
    structured = F.pow(F.lit(10.0), -STEP * F.col("step")) <= q * F.sum("n").over(stratum.orderBy(F.desc("step"))) / total
    half = int(-math.log10(0.5) / STEP)
    above = 10.0 ** (-STEP * half)
    # Random tokens in all, estimated from the p-values above half (never more than there are tokens).
    random = F.least(F.sum(F.when(F.col("step") < half, F.col("n")).otherwise(0)).over(stratum) / (1 - above), total)
    held = F.sum("n").over(stratum.orderBy("step"))
    least = F.pow(F.lit(10.0), -STEP * (F.col("step") + 1))
    fits = (held - random * (1 - least) <= reported * held) & ~structured
    rows = counts.select("encoding", "length_class", "step", fits.alias("fits")).groupBy("encoding", "length_class").agg(F.max(F.when(F.col("fits"), F.col("step") + 1)).alias("step")).collect()
    return {(r["encoding"], r["length_class"]): r["step"] or 0 for r in rows}


def scan(docs: DataFrame, q: float = Q, carry: Column | None = None) -> DataFrame:
    """One row per row of docs: counts, digest of the base spans and all spans, the method's included[, carried]."""
    also = [] if carry is None else ["carried"]
    texts = text_of(docs, *([] if carry is None else [carry.alias("carried")])).select(F.col("doc_id").cast("long").alias("doc_id"), "text", *also)
    more_schema = "".join(f", {c} {texts.schema[c].dataType.simpleString()}" for c in also)
    scanned = cut(texts.mapInArrow(scan_batches, SCAN_SCHEMA + more_schema))
    limits = thresholds(scanned, q)

    def random(t: Column) -> Column:
        step = F.lit(0)
        for (encoding, length_class), first in limits.items():
            step = F.when((t["encoding"] == encoding) & (t["length_class"] == length_class), F.lit(first)).otherwise(step)
        return t["step"] < step

    more = F.transform(F.filter("tokens", lambda t: random(t) & ~t["inside"]), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["stop"].alias("stop")))
    spans = F.array_sort(F.concat("base", more))
    named = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.lit(list(KINDS)), s["kind"] + 1), s["start"], s["stop"]))
    return scanned.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(named, ",").alias("spans"),
        F.size(more).cast("long").alias("n_random"), F.size("tokens").cast("long").alias("n_tested"), spans.alias("span_list"), *also,
    )


def op1_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("span_list")


def masked(text: Column, spans: Column, mask: str) -> Column:
    """text with every span replaced; overlapping spans share one mask. spans are sorted by start, in code points."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["stop"]).alias("at"),
        )

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
