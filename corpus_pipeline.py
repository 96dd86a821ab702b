"""The training-corpus pipeline: stages over documents, each written as Parquet and read again by the next.

1. quality: the weak-label classifier; documents that it rejects go.
2. near_duplicates: the n-gram Jaccard join; the document of smallest id of each group stays.
3. repeated_spans: sentences inside non-first repeated spans are cut from the texts.
4. decontaminate: documents that hold a benchmark window go.
5. mix: sources are brought to target weights; what has no part in the mix goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate as contamination
from plumbline.llm.common import cut, table
from plumbline.llm.jaccard_join import jaccard_components
from plumbline.llm.mixing import mixed
from plumbline.llm.quality import kept
from plumbline.llm.span_dedup import span_dedup

#: Ids of documents to drop are broadcast only when they have been counted to be no more.
BROADCAST_ROWS = 2_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_components(docs, links=False)
    gone = cut(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    few = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return span_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs).where("taken > 0")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_spans", repeated_spans), ("decontaminate", decontaminate), ("mix", mix)]

#: SQL cannot express the stages (expectation maximisation, a trained scorer); tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
