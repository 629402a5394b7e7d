"""Export bundle: panel files plus a manifest that describes each of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feltgrid.sources.files import FORMAT, LISTED, FileSource

ENTRY = "path string, source string, hash string, row_count bigint, size_bytes bigint"

# The bundle's table names, required first, then optional keyword tables.
REQUIRED_TABLES = [
    "emotion_panel_weekly", "emotion_panel_monthly", "emotion_national_timeline",
    "province_emotion_vectors", "anomaly_detection", "cluster_labels", "monthly_cluster_labels",
]
KEYWORD_TABLES = ["nlp_keywords_by_week", "nlp_emotion_keywords", "nlp_global_vocabulary"]


def export_bundle(
    tables: Mapping[str, DataFrame], directory: str, formats: Mapping[str, str] | None = None, required: Sequence[str] = ()
) -> None:
    """Write each table below ``directory/<name>`` as the files of its tasks, listed by the writers.

    A name in ``required`` without a table is an error, and nothing is written then.
    """
    missing = [name for name in required if name not in tables]
    if missing:
        raise ValueError(f"the bundle misses tables: {missing}")
    formats = formats or {}
    for name, df in tables.items():
        df.sparkSession.dataSource.register(FileSource)
        df.write.format(FORMAT).mode("overwrite").option("kind", formats.get(name, "csv")).option("path", f"{directory}/{name}").save()


def manifest(spark: SparkSession, directory: str) -> DataFrame:
    """One row per exported file: path, table, short SHA-256, rows and bytes.

    Files that ``export_bundle`` wrote were described by their writers; other files are read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    # As long as the folder listing.
    paths = [r.path for r in found.option("pathGlobFilter", f"{{*.csv,*.json,{LISTED}}}").load(directory).select("path").collect()]
    lists = [p for p in paths if p.endswith(f"/{LISTED}")]
    listed = {p.rsplit("/", 1)[0] for p in lists}
    other = [p for p in paths if p.rsplit("/", 1)[0] not in listed]
    entries = spark.read.schema(ENTRY).json(lists) if lists else spark.createDataFrame([], ENTRY)
    return entries.unionByName(describe_files(spark, other)) if other else entries


def describe_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The manifest rows of files that others wrote; each is read whole.

    Rows are lines less the header for CSV; for JSON the length of the list, of the ``weeks``,
    ``emotions`` or ``vocabulary`` member, or the number of lines of a JSON-lines file.
    """
    files = spark.read.format("binaryFile").load(list(paths))
    content = F.decode("content", "UTF-8")
    text = F.trim(content)
    lines = F.regexp_count(F.regexp_replace(content, r"\n+$", ""), F.lit("\n")) + 1
    lines = F.when(F.length(text) == 0, 0).otherwise(lines)
    keyed = F.coalesce(
        F.size(F.json_object_keys(F.get_json_object(text, "$.weeks"))),
        F.json_array_length(F.get_json_object(text, "$.weeks")),
        F.size(F.json_object_keys(F.get_json_object(text, "$.emotions"))),
        F.json_array_length(F.get_json_object(text, "$.vocabulary")),
    )
    json_rows = (
        F.when(text.startswith("["), F.json_array_length(text))
        .when(keyed.isNotNull() & (keyed >= 0), keyed)
        .otherwise(lines)
    )
    is_csv = F.col("path").endswith(".csv")
    table = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return files.select(
        F.regexp_replace("path", r"^.*/([^/]+/[^/]+)$", "$1").alias("path"),
        table.alias("source"),
        F.substring(F.sha2("content", 256), 1, 12).alias("hash"),
        F.when(is_csv, F.greatest(lines - 1, F.lit(0))).otherwise(json_rows).cast("bigint").alias("row_count"),
        F.col("length").alias("size_bytes"),
    )


def bundle_status(
    entries: DataFrame,
    required: Sequence[str] = REQUIRED_TABLES,
    optional: Sequence[str] = KEYWORD_TABLES,
) -> DataFrame:
    """Missing required tables and whether all keyword tables are there, in one row."""
    found = F.collect_set("source")
    wanted = F.array(*map(F.lit, required))
    extra = F.array(*map(F.lit, optional))
    return entries.agg(
        F.transform(F.array_except(wanted, found), lambda t: F.concat(F.lit("MISSING: "), t)).alias("errors"),
        (F.size(F.array_except(extra, found)) == 0).alias("nlp_keywords_available"),
    )
