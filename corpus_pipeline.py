"""From documents to packed training sequences: five stages, each written as Parquet and read by the next.

Toxic documents go, boilerplate lines go, one document of each group of near-duplicates stays (by SimHash
links, and by near copies of five-word shingles at a similarity of 0.8), documents that hold benchmark items
go, and the rest is packed into token sequences. All stages but the last return the columns of documents.
Each works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelog.llm.common import Scratch, table
from pagelog.llm.decontaminate import decontaminate
from pagelog.llm.line_dedup import dedup_lines
from pagelog.llm.nearcopies import drop_near_copies
from pagelog.llm.packing import pack_documents
from pagelog.llm.queries import default_tokenizer
from pagelog.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs).drop("n_removed")


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, default_tokenizer())


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near-duplicates", simhash), ("decontamination", decontamination), ("packing", packing)]

#: SQL can't express the classifier, the fingerprints and the packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
