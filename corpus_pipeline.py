"""From raw documents to packed training batches, in stages of the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from seekspark.llm import decontam, packing, pii, simhash, toxicity
from seekspark.llm._shared import shared_folder, table
from seekspark.llm.queries import PII_KEY

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The toxicity model can't be said in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; null and empty texts have the prior's score, repeated rows and rows without an id one each. An empty table stays empty."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays, one without an id only if none has one; of equal rows one. Texts without words are one group. An empty table stays empty."""
    return simhash.one_of_each(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; a null text holds none, repeated rows stay. An empty table, of either kind, removes nothing."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to surrogates; ``n_chars`` follows the text, and is null where that is. No row goes, repeated ones neither."""
    return pii.replace(docs, PII_KEY, found_col=None).selectExpr("doc_id", "text", "lang", "source", "cast(length(text) AS bigint) AS n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its place in a batch of its length bucket; null and empty texts have no tokens and a place all the same. An empty table has no batches."""
    return packing.pack(docs, carry=("text",)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("pii_surrogates", replace_private),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. What lies between them is written below the folder that all executors share, under a name of this run's own."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
