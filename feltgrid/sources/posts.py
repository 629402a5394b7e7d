"""Scans of the raw inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feltgrid import domain
from feltgrid.functions.text import strip
from feltgrid.sources.splitcsv import read_csv

MONTH_IN_PATH = r"/(\d{4}-\d{2})(?:\.csv)?(?:/[^/]*)?$"


def month_files(spark: SparkSession, directory: str) -> DataFrame:
    """CSV files below ``directory`` named ``<month>.csv`` or inside a ``<month>/`` folder."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .load(directory)
        .select("path")
    )
    month = F.regexp_extract("path", MONTH_IN_PATH, 1)
    return files.withColumn("month", month).filter(F.col("month") != "")


def missing_months(
    spark: SparkSession, directory: str, months: Sequence[str] = domain.POST_MONTHS
) -> DataFrame:
    """Expected months without a file, as ``(month, issue)``."""
    expected = spark.createDataFrame([(m,) for m in months], "month string")
    return (
        expected.join(month_files(spark, directory), "month", "left_anti")
        .withColumn("issue", F.concat(F.lit("MISSING: "), "month", F.lit(".csv")))
    )


def read_posts(
    spark: SparkSession, directory: str, months: Sequence[str] = domain.POST_MONTHS
) -> DataFrame:
    """Raw posts of the months that exist, with ``file_month`` and the row's ``position``.

    A month is one CSV file or a folder of part files; both are read in byte ranges. Positions rise in file
    order, and by file name within a folder.
    """
    wanted = month_files(spark, directory).filter(F.col("month").isin(list(months)))
    # One path per month file; the list is as short as the folder listing.
    paths = sorted(row.path for row in wanted.collect())
    if not paths:
        raise FileNotFoundError(f"no monthly post files in {directory}")
    df = read_csv(spark, paths, position="position", path="_path")
    df = df.withColumn("file_month", F.regexp_extract("_path", MONTH_IN_PATH, 1)).drop("_path")
    if "geo_info" not in df.columns:
        df = df.withColumn("geo_info", F.lit(None).cast("string"))
    return df


def select_users(df: DataFrame, provinces: Sequence[str] = domain.PROVINCES, position: str | None = None) -> DataFrame:
    """White-listed users, trimmed, the first row of each ``user_id``.

    Without ``position`` the order is that of the tasks, which is the table's own for one file only.
    """
    columns = set(df.columns)
    order = F.col(position) if position else F.monotonically_increasing_id()
    users = df.select(
        *[
            strip(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c)
            if c in columns else F.lit("").alias(c)
            for c in ("user_id", "province", "city", "gender")
        ],
        order.alias("_position"),
    ).filter(F.col("province").isin(list(provinces)))
    # row_number = 1 is pruned on the map side, so copies of one user never pile up in a task.
    first = W.partitionBy("user_id").orderBy("_position")
    return (
        users.withColumn("_row", F.row_number().over(first))
        .filter("_row = 1")
        .drop("_row", "_position")
    )


def read_users(spark: SparkSession, path: str, provinces: Sequence[str] = domain.PROVINCES) -> DataFrame:
    return select_users(read_csv(spark, path, position="_place"), provinces, "_place")


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Human-labelled texts from a JSON array, or from tab-separated text."""
    schema = ", ".join(f"{c} string" for c in domain.BENCHMARK_COLUMNS)
    first = spark.read.text(path).select(F.ltrim(F.translate("value", "﻿", "")).alias("v"))
    first = first.filter("v <> ''").limit(1)
    if not first.filter(F.col("v").startswith("[") | F.col("v").startswith("{")).isEmpty():
        return spark.read.schema(schema).option("multiLine", True).json(path)
    df = spark.read.option("header", True).option("sep", "\t").csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    return df.select(*[c for c in domain.BENCHMARK_COLUMNS if c in df.columns])
