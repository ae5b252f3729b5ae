"""From raw documents to packed training windows, in five stages.

Each stage takes what the one before kept, written as Parquet and read again, and its decisions
take effect: toxic documents go, one document of each near-duplicate class stays, secrets are
blanked, sources are taken up to their target weights (repeats and the cut at a source's budget
included), and the mix is packed. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from lodestream.llm import dartminhash, mixing, packing, secrets, toxicity
from lodestream.llm.common import read, remove, shared_dir


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted to the labelled ones among them, scores below 0.7."""
    return toxicity.clean_documents(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the smallest id."""
    return dartminhash.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what is secret in their texts replaced by a mark."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: a row for each time a document is taken."""
    return mixing.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row of the mix, with the window each lies in and where."""
    return packing.pack(packing.pieces(docs, packing.default_tokenizer()))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Neither the model of the first stage nor tokens can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. What lies between two stages is removed once
    the next has been written, and all of it should a stage fail; the last result stays in the shared
    folder for whoever reads it."""
    docs, before = read(spark, sf_dir, "documents"), None
    top = f"{shared_dir(spark)}/pipeline-{uuid4().hex}"
    try:
        for name, stage in STAGES:
            path = f"{top}/{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    except BaseException:
        remove(spark, top)
        raise
    return docs
