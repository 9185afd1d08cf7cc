"""Toxicity by a classifier chain.

The categories are predicted one after the other by logistic regressions; each later model also sees the earlier
categories' probabilities. For training these probabilities are out-of-fold (each row's comes from models that did not
see it), so the later models learn from what they will meet. Features are the presence of a word and of its first four
and five letters, in whole texts, hashed to 32 bits; each fit picks its FEATURES most telling ones.

The labels table has two columns, so the chain's categories are low_quality (quality = 0), toxic (toxic = 1) and severe
(both), in this order. A document is rejected where the probability of toxic reaches THRESHOLD.

Training uses a bounded sample: at most SAMPLE labelled documents of each class of toxic, those with the least hash of
doc_id. Both classes are counted over all labels, and a sampled document stands for its class's count by the number
sampled, so the models keep the class ratio of the labels at any size. Only the two ratios count: they are divided by
the smaller one, so that the ridge stays what it is for a sample. Without a cut all documents weigh 1. Only this sample
reaches the driver, as sets of hashes; every document is scored, in Arrow batches.

Defined results: null or empty text has no features; null labels and labels without a document are left out; of several
labels of a document the toxic one counts, then the one of highest quality, and of several texts the smallest; with fewer
than two labelled documents of a class, the category's probability is its smoothed frequency (0 without any labels);
documents repeat as they come; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, gulps, text_of

CATEGORIES = ("low_quality", "toxic", "severe")
SAMPLE = 3000
FEATURES = 400
FOLDS = 3
RIDGE = 0.3
THRESHOLD = 0.4
REMEMBERED = 150_000

#: Characters of a long text whose words are listed at once.
STRETCH = 1 << 20

WORD = re.compile(r"[^\W\d_]+")
ORACLE_SQL = None  # fitted models; tests hold held-out accuracy


def features_of(word: str) -> tuple[int, ...]:
    names = {f"w{word}", f"4{word[:4]}", f"5{word[:5]}"} if len(word) >= 4 else {f"w{word}"}
    return tuple(zlib.crc32(n.encode()) for n in names)


def words_of(text: str) -> set[str]:
    """The distinct lower-case words of a whole text; a long text is listed stretch by stretch, each ending at a blank."""
    text = text.lower()
    out: set[str] = set()
    lo = 0
    while len(text) - lo > STRETCH:
        hi = text.rfind(" ", lo, lo + STRETCH)
        if hi <= lo:
            break
        out.update(WORD.findall(text, lo, hi))
        lo = hi
    out.update(WORD.findall(text, lo))
    return out


def feature_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, f): the distinct feature hashes as little-endian bytes."""
    for batch in batches:
        found = []
        for text in batch.column(1).to_pylist():
            own: set[int] = set()
            for w in words_of(text):
                own.update(features_of(w))
            found.append(np.array(sorted(own), "<u4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "f"])


class Linear:
    """A ridge logistic regression over chosen hashed features and the chain's earlier probabilities."""

    def __init__(self, sets: list[np.ndarray], before: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.chosen, self.weights, self.chain = np.zeros(0, np.uint32), np.zeros(0), np.zeros(before.shape[1])
        n, positive = len(y), int(y.sum())
        weighed, whole = float(weight @ y), float(weight.sum())
        self.bias = float(np.log((weighed + 0.5) / (whole - weighed + 0.5))) if n else -50.0
        if min(positive, n - positive) < 2:
            return
        flat = np.concatenate(sets)
        share = weighed / whole
        off = weight * (y - share)
        names, at = np.unique(flat, return_inverse=True)
        total = np.bincount(at, minlength=len(names)).astype(float)
        excess = np.bincount(at, np.repeat(off, [len(s) for s in sets]), minlength=len(names))
        spread = total * np.mean(off**2) * np.maximum(1 - total / n, 1e-3) + 0.5
        telling = np.where(total >= 3, np.abs(excess) / np.sqrt(spread), 0)
        pick = np.argsort(-telling, kind="stable")[:FEATURES]
        self.chosen = np.sort(names[pick[telling[pick] > 2]])
        x = np.hstack([self.matrix(sets), before, np.ones((n, 1))])
        w = np.zeros(x.shape[1])
        ridge = np.full(x.shape[1], RIDGE)
        ridge[-1] = 1e-3
        w[-1] = self.bias
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (weight * (p - y)) + ridge * w
            step = np.linalg.solve((x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag(ridge), slope)
            w -= step / max(1.0, np.abs(step).max() / 4)
            if np.abs(step).max() < 1e-3:
                break
        k = len(self.chosen)
        self.weights, self.chain, self.bias = w[:k], w[k:-1], float(w[-1])

    def matrix(self, sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(self.chosen)))
        for i, s in enumerate(sets):
            out[i, np.searchsorted(self.chosen, s[np.isin(s, self.chosen, assume_unique=True)])] = 1
        return out

    def predict(self, sets: list[np.ndarray], before: np.ndarray) -> np.ndarray:
        z = self.matrix(sets) @ self.weights + before @ self.chain + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_chain(sets: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, folds: int = FOLDS) -> list[Linear]:
    """One model a category; earlier probabilities are out-of-fold during training."""
    before, models = np.zeros((len(sets), 0)), []
    fold = np.arange(len(sets)) % folds
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        models.append(Linear(sets, before, y, weight))
        held_out = np.zeros(len(sets))
        for f in range(folds):
            own, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            if len(own):
                held_out[own] = Linear([sets[i] for i in rest], before[rest], y[rest], weight[rest]).predict([sets[i] for i in own], before[own])
        before = np.column_stack([before, held_out])
    return models


def training(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(feature sets, labels by category, weights) of the bounded sample, in the order of the hash."""
    order = F.xxhash64("doc_id")
    usable = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.struct((F.col("toxic") == 1).alias("toxic"), "quality").alias("label"))
    judged = cut(usable.groupBy("doc_id").agg(F.max("label").alias("label")).select("doc_id", "label.*"))
    count = {r["toxic"]: r["count"] for r in judged.groupBy("toxic").count().collect()}
    rows = {c: judged.where(F.col("toxic") if c else ~F.col("toxic")).orderBy(order, "doc_id").limit(sample).collect() for c in sorted(count)}
    known = {r["doc_id"]: (int(r["quality"] == 0), int(c)) for c in rows for r in rows[c]}
    stands_for = {int(c): count[c] / max(1, len(rows[c])) for c in rows}
    # At most 2 * sample ids: this bound is what makes the broadcast safe.
    ids = docs.sparkSession.createDataFrame([(i,) for i in known], "doc_id long")
    texts = text_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    # Of texts that share an id the smallest counts, so that the fit can be repeated.
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
    found = {r["doc_id"]: np.frombuffer(r["f"], "<u4") for r in texts.mapInArrow(feature_sets, "doc_id long, f binary").collect()}
    kept = sorted((d for d in known if d in found), key=lambda d: (zlib.crc32(str(d).encode()), d))
    y = np.array([(*known[d], known[d][0] & known[d][1]) for d in kept]).reshape(len(kept), len(CATEGORIES))
    weight = np.array([stands_for[known[d][1]] for d in kept]) / min(stands_for.values(), default=1.0)
    return [found[d] for d in kept], y, weight


class WordHits(dict):
    """word -> its features that some model uses; nearly always none."""

    def __init__(self, used: frozenset[int]):
        super().__init__()
        self.used = used

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        hit = self[word] = tuple(f for f in features_of(word) if f in self.used)
        return hit


def scorer(models: list[Linear]):  # noqa: ANN201
    weights = [dict(zip(m.chosen.tolist(), m.weights.tolist())) for m in models]
    used = frozenset().union(*weights)
    tails = [(m.chain.tolist(), m.bias) for m in models]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits_of = WordHits(used)
        for batch in batches:
            out: list[list[float]] = [[] for _ in weights]
            for text in (t for texts in gulps(batch.column(1)) for t in texts.to_pylist()):
                own: set[int] = set()
                for w in words_of(text or ""):
                    if hit := hits_of[w]:
                        own.update(hit)
                before: list[float] = []
                for w, (chain, bias) in zip(weights, tails):
                    z = bias + sum(w.get(f, 0.0) for f in sorted(own)) + sum(c * p for c, p in zip(chain, before))
                    before.append(float(1 / (1 + np.exp(-min(30.0, max(-30.0, z))))))
                for c, p in zip(out, before):
                    c.append(p)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.float64()) for c in out)], names=[*batch.schema.names, *(f"p_{c}" for c in CATEGORIES)])

    return score


def scored(docs: DataFrame, labels: DataFrame, labelled_docs: DataFrame | None = None, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(carried, p_low_quality, p_toxic, p_severe, rejected): a row of docs, as a struct, with its probabilities."""
    sets, y, weight = training(docs if labelled_docs is None else labelled_docs, labels, sample)
    others = [c for c in docs.columns if c != "text"]
    # The text travels once, beside the other columns.
    rows = docs.select(F.struct(*others).alias("carried"), "text")
    schema = f"carried {rows.schema['carried'].dataType.simpleString()}, text string, " + ", ".join(f"p_{c} double" for c in CATEGORIES)
    found = rows.mapInArrow(scorer(fit_chain(sets, y, weight)), schema)
    whole = F.struct(*[F.col("text") if c == "text" else F.col("carried")[c].alias(c) for c in docs.columns])
    return found.select(whole.alias("carried"), *(f"p_{c}" for c in CATEGORIES), (F.col("p_toxic") >= threshold).alias("rejected"))


def op4_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    # Only id and text go through the scoring step.
    found = scored(docs.select("doc_id", "text"), labels)
    return found.select("carried.doc_id", *(f"p_{c}" for c in CATEGORIES), "rejected")
