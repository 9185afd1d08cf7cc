"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, repeated passages are cut,
secrets are masked, and what is left is packed into training sequences.

Every stage works on all documents that the one before kept and returns the columns of documents; the last returns the
packed pieces. Texts change in two stages: cutting works on bytes, and bytes of a character that a cut left incomplete
go with it; n_chars is kept in step. Rows with a null doc_id are linked with nothing, so near-duplicates keep them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starbraid.llm import neardup, packing, repeats, secrets, toxicity
from starbraid.llm.common import shared_dir

MASK = "[secret]"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that op4's chain rejects go."""
    labels, all_docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "documents"))
    return toxicity.scored(docs, labels, all_docs).where(~F.col("rejected")).select("carried.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id."""
    dropped = neardup.classes(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 100 or more that occur earlier go."""
    return repeats.cut_repeats(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is masked in place; documents stay. Rows go through the scan whole, so spans stay with their text."""
    found = secrets.scan(docs, carry=F.struct(*docs.columns))
    whole = F.col("carried")["text"]
    out = found.select("carried", F.when(F.size("span_list") > 0, secrets.masked(whole, F.col("span_list"), MASK)).otherwise(whole).alias("text"))
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col("text") if c == "text" else F.col("carried")[c].alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("repeats", repeats_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # fitted models, closures and searches; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{folder}/{k}-{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
