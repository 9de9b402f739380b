"""From raw documents to packed training sequences, in stages that are written and read again.

Empty tables pass through all stages. Columns besides those of documents are kept until the last stage; no name clashes
with those that the stages add and drop. Texts are read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm import common, decontam, linededup, nearcopies, packing, quality

#: SQL cannot express the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier does not reject, each judged by its own text; null and empty texts are judged as empty ones."""
    common.small_batches(spark)
    return quality.accepted(docs, common.table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without later occurrences of passages of three lines; n_chars is counted anew where a text changes.

    Null texts stay null. Rows equal in doc_id and text are one document: neither is the other's later occurrence.
    """
    found = linededup.remove_repeats(docs)
    size = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", size).select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by doc_id, of each group of near copies: five-word shingles, Jaccard similarity 0.8 or more.

    Null and blank texts are one group. A null doc_id comes last. Rows equal in doc_id and text are one document and
    stay or go together; rows with one doc_id and different texts are documents of their own.
    """
    common.small_batches(spark)
    first = nearcopies.near_copies(docs).where("stays").select(F.col("doc_id").alias("_doc"), F.col("tid").alias("_tid")).distinct()
    text = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(first, docs["doc_id"].eqNullSafe(first["_doc"]) & (text == first["_tid"]), "left_semi")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text holds no benchmark item. Null and empty texts stay."""
    return decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. A null or empty text is its end id alone."""
    common.small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's result is written to the shared folder and read by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        to = f"{common.shared_dir(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(to)
        docs = spark.read.parquet(to)
    return docs
