"""The corpus pipeline: quality, near copies, benchmark passages, secrets, packing.

Each stage takes the documents that its predecessor kept and returns documents with the same columns; the
last one returns the pieces of packed sequences. Between stages the rows are written as Parquet and read
again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feltgrid.llm import decontaminate, jaccard, packing, quality, secrets
from feltgrid.operators.stage import stage
from feltgrid.shipping import ship

NEAR_COPY = jaccard.Link(words=5, part=80, whole=100)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier keeps."""
    ship(spark)
    return quality.quality(docs).filter("keep").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles, the one with the smallest id."""
    ship(spark)
    return jaccard.first_of_each_group(docs, NEAR_COPY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    ship(spark)
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(~F.col("contaminated")).select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking secrets replaced and ``n_chars`` brought up to date."""
    cleaned = secrets.redact(docs)
    return cleaned.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of power-of-two lengths."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: No SQL expresses the classifier and the tokenizer; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
