"""Processed-table scans, schema checks, word lists and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feltgrid import domain
from feltgrid.functions.text import as_column, normalise_province, strip


def schema_issues(df: DataFrame, required: Sequence[str], table: str) -> DataFrame:
    """One row per required column that ``df`` lacks."""
    missing = [(table, c, f"{table} missing column: {c}") for c in required if c not in df.columns]
    return df.sparkSession.createDataFrame(missing, "table string, column string, issue string")


def require_columns(df: DataFrame, required: Sequence[str], table: str = "table") -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{table} misses required columns: {missing}")
    return df


def existing_ids(spark: SparkSession, path: str, fmt: str = "parquet", key: str = "post_id") -> DataFrame:
    """Only the ids of an earlier output; parquet reads no other column."""
    df = spark.read.format(fmt).option("header", True).load(path)
    return df.select(F.col(key).cast("string").alias(key))


def first_rows(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


# --- Dashboard coercion ---------------------------------------------------------------------


def to_number(value: Column | str) -> Column:
    """Leading number of a text, 0 when there is none or it is not finite."""
    text = F.regexp_extract(
        strip(as_column(value).cast("string")), r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1
    )
    number = text.try_cast("double")
    huge = F.abs(number) == float("inf")
    return F.when(number.isNull() | huge, 0.0).otherwise(number)


def to_flag(value: Column | str) -> Column:
    return F.lower(F.coalesce(as_column(value).cast("string"), F.lit(""))) == "true"


def to_emotion(value: Column | str) -> Column:
    key = strip(as_column(value).cast("string"))
    return F.when(key.isin(domain.EMOTIONS), key).otherwise("neutral")


def coerce_table(
    df: DataFrame,
    numbers: Sequence[str] = (),
    flags: Sequence[str] = (),
    emotions: Sequence[str] = (),
    provinces: Sequence[str] = (),
    integers: Sequence[str] = (),
) -> DataFrame:
    """Typed dashboard rows from text: blank rows dropped, header trimmed, defaults for bad cells."""
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    filled = [F.length(strip(F.coalesce(F.col(c).cast("string"), F.lit("")))) > 0 for c in df.columns]
    some = filled[0]
    for flag in filled[1:]:
        some = some | flag
    typed = {}
    typed.update({c: to_number(c) for c in numbers})
    typed.update({c: to_number(c).cast("bigint") for c in integers})
    typed.update({c: to_flag(c) for c in flags})
    typed.update({c: to_emotion(c) for c in emotions})
    typed.update({c: normalise_province(c) for c in provinces})
    return df.filter(some).withColumns({c: e for c, e in typed.items() if c in df.columns})


# --- Word lists -----------------------------------------------------------------------------


def stop_words(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Built-in stop words united with the non-comment lines of a file."""
    words = spark.createDataFrame([(w,) for w in domain.STOP_WORDS], "word string")
    if path is None:
        return words
    lines = spark.read.text(path).select(strip(F.col("value")).alias("word"))
    lines = lines.filter((F.col("word") != "") & ~F.col("word").startswith("#"))
    return words.union(lines).distinct()


def noise_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in domain.NOISE_WORDS], "word string")


# --- Sinks ----------------------------------------------------------------------------------


def write_panel(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), files: int | None = None
) -> None:
    """Overwrite a table. ``files`` compacts a small panel; leave it unset for post-level tables."""
    out = df if files is None else df.repartition(files)
    writer = out.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def run_summary(df: DataFrame) -> str:
    """JSON text of a one-row summary table."""
    row = df.select(F.to_json(F.struct("*")).alias("summary")).first()
    return row.summary if row else "{}"
