"""The corpus pipeline: four stages over `documents`, each written as Parquet and read again by the next.

    toxicity       rejects documents that the n-gram classifier marks as toxic
    quality        rejects documents that the factorisation machine marks as low quality
    near_dedup     keeps one document of each group of near duplicates
    packing        packs what is left into sequences of 4096 tokens

Every stage works on all rows that its predecessor kept; all but the last return the columns of documents. In all of
them other columns are carried along whatever their names, an empty table gives no rows, and a text of any length is
taken whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import bpe, common, near_dedup, packing, quality_classifier
from sparkloom.llm import toxicity as tox

#: SQL can express none of the stages: two are learned models, one hashes sets, one runs a tokenizer.
ORACLE_SQL = None



def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5. A null or empty text has the score of the bias alone, which is low where few
    labelled documents are toxic. Repeated rows are scored each; a null doc_id is a document like others."""
    return tox.reject_toxic(docs, tox.train(docs, _labels(spark, sf_dir)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more. A null or empty text is scored by its statistics, all zero. Repeated rows are
    scored each; a null doc_id is a document like others."""
    return quality_classifier.reject_low_quality(docs, quality_classifier.train(docs, _labels(spark, sf_dir)))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates, once where it is repeated. Documents without words are in
    no group and stay; another text under a dropped document's doc_id stays; a null doc_id is the smallest only of a group of nulls."""
    return near_dedup.drop_near_duplicates(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence. A null or empty text is its end id alone; repeated rows are packed each."""
    return packing.packing(docs, bpe.vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity_stage), ("quality", quality_stage), ("near_dedup", near_dedup_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
