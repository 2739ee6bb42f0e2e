"""The corpus pipeline: toxicity filter, line deduplication, one document per group of near copies, personal data masked,
packing into windows.  ``STAGES`` are applied in order, each to all that the one before kept.

All stages but the last return the columns of documents, whatever they are called.  Null and empty texts are never toxic,
have no lines to lose, are near to nothing and end as sequences of the end id alone.  Rows with a null doc_id or one that
other rows share are documents of their own; of an empty table every stage makes an empty one."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import lines, ngram_join, packing, pii, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model (learnt from the labelled ones) does not predict to be toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal or near to an earlier one leave their documents; documents that lose everything go."""
    return lines.dedup_lines(docs, exact_words=1)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return ngram_join.one_per_class(docs)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.mask(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents, packed into windows."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_copies),
    ("pii", mask_private),
    ("packing", pack_windows),
]

#: Models and byte-level BPE are beyond SQL; tests/llm/test_pipeline.py holds every stage's rows against what they must be.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``; each stage is written to the shared folder and read again."""
    from tallyforge.llm.graph import shared_folder

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
