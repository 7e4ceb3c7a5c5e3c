"""A training-data pipeline over `documents`: each stage works on all that the one before kept, written as Parquet and read again.

Toxic and anomalous documents go, passages that earlier documents hold are cut out of later ones (n_chars follows the edited
text; a document of which nothing is left stays as an empty text until near-duplicates are merged), one document of each
near-duplicate group stays, and what is left is packed into token windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.llm import catalog, line_dedup, packing, quality, simhash, toxicity
from quillmask.llm._base import drop, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, catalog.table(spark, sf_dir, "labels")))


def drop_anomalous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, catalog.table(spark, sf_dir, "labels"), short=False)  # the base rule's bound on words would drop short clean documents


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    edited = line_dedup.edit_documents(docs).drop("_n_deleted")
    return edited.withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, catalog.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_anomalous),
    ("line dedup", drop_passages),
    ("SimHash near-dedup", drop_near_duplicates),
    ("packing", pack_windows),
]

#: The stages fit models and align texts, which SQL can't express; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalog.table(spark, sf_dir, "documents")
    before = None
    for n, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = stored(docs)
            if before is not None:  # nothing reads it any more
                drop(before)
            before = docs
    return docs
