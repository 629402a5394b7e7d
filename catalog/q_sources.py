"""Raw inputs: tables written as the files that the scans expect, and read back."""

from pyspark.sql import functions as F

from catalog import query
from catalog import views as v
from feltgrid import domain
from feltgrid.functions import text
from feltgrid.operators import enrich, validate
from feltgrid.operators.stage import new_path
from feltgrid.sources import manifest as bundle
from feltgrid.sources import posts, tables

# Documents as posts of thirteen months, the source as author.
MONTH_SQL = "CASE WHEN doc_id % 13 = 0 THEN '2019-12' ELSE '2020-' || lpad(CAST(doc_id % 13 AS VARCHAR), 2, '0') END"
ONE_LINE_SQL = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


def month():
    number = F.col("doc_id") % 13
    return F.when(number == 0, "2019-12").otherwise(F.format_string("2020-%02d", number))


def written_posts(spark, d):
    """The folder of one sub-folder of CSV files per month; texts keep their line breaks."""
    folder = new_path(spark)
    rows = v.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("_id"), F.col("source").alias("user_id"), F.col("text").alias("content"), month().alias("month"),
    )
    for name in domain.POST_MONTHS:
        rows.filter(F.col("month") == name).drop("month").write.option("header", True).option("escape", '"').csv(f"{folder}/{name}")
    return folder


@query(f"""
SELECT CAST(doc_id AS VARCHAR) AS post_id, source AS user_id, {MONTH_SQL} AS file_month, CAST(length(text) AS BIGINT) AS chars FROM documents""")
def post_scan(spark, d):
    found = posts.read_posts(spark, written_posts(spark, d))
    return found.select(F.col("_id").alias("post_id"), "user_id", "file_month", F.length("content").cast("bigint").alias("chars"))


@query(f"""
SELECT CAST(doc_id AS VARCHAR) AS post_id, {MONTH_SQL} AS file_month FROM documents
QUALIFY row_number() OVER (PARTITION BY file_month ORDER BY doc_id) <= 7""")
def first_rows_of_files(spark, d):
    """The tables lie in the order of their ids, and so do the files written from them."""
    folder = new_path(spark)
    rows = v.table(spark, d, "documents").select(F.col("doc_id").alias("_id"), F.col("source").alias("user_id"), month().alias("month"))
    for name in domain.POST_MONTHS:
        part = rows.filter(F.col("month") == name).drop("month").orderBy("_id")
        part.write.option("header", True).csv(f"{folder}/{name}")
    found = enrich.first_rows_per_month(posts.read_posts(spark, folder), domain.POST_MONTHS, 7)
    return found.select(F.col("_id").alias("post_id"), "file_month")


LABEL_SQL = "CASE item_id % 7 WHEN 0 THEN 'happy' WHEN 1 THEN 'angry' WHEN 2 THEN 'sad' WHEN 3 THEN 'fear' WHEN 4 THEN 'surprise' WHEN 5 THEN 'neutral' ELSE 'other' END"


def written_benchmark(spark, d):
    labels = F.array(*map(F.lit, ["happy", "angry", "sad", "fear", "surprise", "neutral", "other"]))
    folder = new_path(spark)
    v.table(spark, d, "benchmark").select(
        F.col("item_id").alias("id"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("content"),
        F.element_at(labels, (F.col("item_id") % 7 + 1).cast("int")).alias("label"),
    ).write.option("header", True).option("sep", "\t").option("quote", "").csv(folder)
    return folder


@query(f"SELECT CAST(item_id AS VARCHAR) AS id, {ONE_LINE_SQL} AS content, {LABEL_SQL} AS label FROM benchmark")
def benchmark_scan(spark, d):
    return posts.read_benchmark(spark, written_benchmark(spark, d))


@query("""
SELECT CAST(item_id AS VARCHAR) AS id, ['喜悦', '愤怒', '悲伤', '恐惧', '惊讶', '中性'][item_id % 7 + 1] AS label_cn
FROM benchmark WHERE item_id % 7 < 6""")
def label_map(spark, d):
    return validate.map_labels(posts.read_benchmark(spark, written_benchmark(spark, d))).select("id", "label_cn")


@query("SELECT CAST(doc_id AS VARCHAR) AS post_id FROM documents")
def existing_ids(spark, d):
    folder = new_path(spark)
    v.table(spark, d, "documents").select(F.col("doc_id").alias("post_id"), F.col("text").alias("content")).write.parquet(folder)
    return tables.existing_ids(spark, folder)


BUILT_IN = ", ".join(f"('{w}')" for w in domain.STOP_WORDS)


@query(f"SELECT DISTINCT word FROM (SELECT n_name AS word FROM nation UNION ALL SELECT * FROM (VALUES {BUILT_IN}) w(word))")
def stop_words(spark, d):
    """The built-in list with the nations of a file that has comments, blank lines and blanks."""
    folder = new_path(spark)
    lines = F.explode(F.array(F.lit("# a comment"), F.lit(""), F.concat(F.lit("  "), "n_name", F.lit(" "))))
    v.table(spark, d, "nation").select(lines).write.text(folder)
    return tables.stop_words(spark, folder)


@query(f"SELECT doc_id, substr(text, 1, {domain.RAW_TEXT_LENGTH}) AS content_raw FROM documents")
def truncate_raw(spark, d):
    return v.table(spark, d, "documents").select("doc_id", text.truncate_raw("text").alias("content_raw"))


@query("""
SELECT 'documents' AS "table", c AS column, 'documents missing column: ' || c AS issue
FROM (VALUES ('joy'), ('post_id'), ('user_id')) v(c) WHERE (SELECT count(*) FROM documents) > 0""")
def schema_issues(spark, d):
    required = ["doc_id", "text", "post_id", "user_id", "joy"]
    return tables.schema_issues(v.table(spark, d, "documents"), required, "documents")


@query("""
SELECT 'MISSING: cluster_labels, MISSING: monthly_cluster_labels, MISSING: province_emotion_vectors' AS errors, false AS nlp_keywords_available""")
def bundle_status(spark, d):
    """A bundle of four of the seven tables: the other three are reported."""
    folder = new_path(spark)
    rows = v.table(spark, d, "region").select("r_name")
    names = ["emotion_panel_weekly", "emotion_panel_monthly", "emotion_national_timeline", "anomaly_detection"]
    bundle.export_bundle({name: rows for name in names}, folder)
    status = bundle.bundle_status(bundle.manifest(spark, folder))
    return status.select(F.array_join(F.array_sort("errors"), ", ").alias("errors"), "nlp_keywords_available")
