"""From raw documents to packed training sequences: each stage calls one operator on all that the stage before kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, neardup, packing, pii, toxicity
from tidemark.llm.common import discard, free_name, shared_dir, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model does not reject; it learns from `labels`."""
    score = free_name(docs, "tox_score")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays, that of the smallest doc_id; rows without doc_id come last."""
    return neardup.without_copies(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with personal data in its text replaced by its kind; n_chars is that of the new text."""
    clean = pii.find(docs, pii.train(pii.labelled_table(spark)), redact=True)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row once at least; small sources' rows up to one and a half times on average."""
    mixed = mixing.mix_sources(docs, target_entropy=0.95, repetition_limit=1.5, budget=None)
    return mixed.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their places in sequences; a row that the mix repeats is packed each time."""
    pieces = written(packing.numbered(packing.tokenizer_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))), "pieces")
    return packing.pack(pieces)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned scores, sampled signatures and subset sums have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over `documents`; each stage's rows are written as Parquet and read by the next, and then deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            discard(before)
        before = docs
    return docs
