"""From raw documents to packed training sequences.

Stages: documents judged toxic go; documents without an identified language go; one document of each near-duplicate
component stays; what is left is packed. Each stage is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pollgauge.llm.language import keep_identified, page_evidence
from pollgauge.llm.packing import pack_documents
from pollgauge.llm.registry import ship, table
from pollgauge.llm.simhash import keep_one
from pollgauge.llm.toxicity import drop_toxic, fit_toxicity
from pollgauge.session import configure, materialise

SHINGLE = 5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop toxic documents; the model is fitted on labelled documents among those given."""
    ship(configure(spark))
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is undetermined or not one of the list."""
    ship(configure(spark))
    return keep_identified(docs, page_evidence(table(spark, sf_dir, "pages")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near-duplicates: texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

    Candidates are SimHash components, by the operator of op8, and MinHash bands."""
    ship(configure(spark))
    return keep_one(docs, shingle=SHINGLE)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences."""
    ship(configure(spark))
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("language", language), ("near_duplicates", near_duplicates), ("packing", packing)]
# The model fits and the similarity join have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
