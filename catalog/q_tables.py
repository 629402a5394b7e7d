"""End-to-end mini data set, dashboard coercion, the export bundle and the scoring stream."""

import contextlib

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from catalog import query
from catalog import views as v
from catalog.q_cleaning import MARKED, clean_sql, letters_sql, marked
from catalog.q_panels import monthly, weekly
from catalog.q_scoring import LEXICON, SCORED, docs
from feltgrid.operators import panels, sampling, scoring
from feltgrid.operators.stage import new_path, stage
from feltgrid.plans import build
from feltgrid.sources import manifest as bundle
from feltgrid.sources import tables
from feltgrid.streaming.scoring_stream import read_post_stream, read_scored, score_stream, score_stream_by_id

WEEK_OF_DOC = "CAST(7 * (CASE WHEN doc_id % 200 = 0 THEN 20 ELSE doc_id % 20 END) AS INTEGER)"
MINI_TARGETS = {f"2020-{m:02d}": 100 * m for m in range(1, 7)}

JUDGED = f"""
raw AS (SELECT doc_id, 'p' || doc_id AS _id, DATE '2020-01-06' + {WEEK_OF_DOC} AS day, {MARKED} AS content, doc_id % 1500 AS user_key
        FROM documents),
sampled AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY strftime(day, '%Y-%m')
              ORDER BY ((doc_id % 1000003) * 2654435761 % 2147483647), _id) <= 100 * CAST(strftime(day, '%m') AS INT)),
judged AS (
  SELECT _id AS post_id, user_key::VARCHAR AS user_id, CASE WHEN doc_id % 19 <> 0 THEN strftime(day, '%G-W%V') END AS date_week,
         coalesce(n_name, '未知') AS province, {clean_sql("content")} AS cleaned
  FROM sampled LEFT JOIN (SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 10 <> 0)
    ON c_custkey = user_key),
reasons AS (SELECT *, {letters_sql("cleaned")} AS word_count,
                   CASE WHEN date_week IS NULL THEN 'bad_date' WHEN {letters_sql("cleaned")} < 10 THEN 'too_short'
                        WHEN province = '未知' THEN 'unknown_province' END AS reason FROM judged)"""


@query(v.with_(JUDGED, select="""
SELECT post_id, user_id, date_week, province, md5(cleaned) AS digest, word_count, coalesce(reason, 'kept') AS reason FROM reasons"""))
def mini_dataset(spark, d):
    """Sampling, cleaning, user look-up and rejection of raw posts in one plan."""
    table = v.table(spark, d, "documents")
    key = F.col("doc_id")
    day = F.date_add(F.lit("2020-01-06").cast("date"), (F.when(key % 200 == 0, 20).otherwise(key % 20) * 7).cast("int"))
    posts = table.select(
        key.alias("doc_id"),
        F.concat(F.lit("p"), key.cast("string")).alias("_id"),
        F.when(key % 19 == 0, "").otherwise(day.cast("string")).alias("created_at"),
        F.date_format(day, "yyyy-MM").alias("file_month"),
        marked(table).alias("content"),
        (key % 1500).cast("string").alias("user_id"),
    )
    known = v.table(spark, d, "customer").filter("c_custkey % 10 <> 0").join(
        v.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    users = known.select(F.col("c_custkey").cast("string").alias("user_id"), F.col("n_name").alias("province"),
                         F.lit("").alias("city"), F.lit("").alias("gender"))
    sampled = stage(sampling.exact_sample(posts, MINI_TARGETS, key="_id", order=v.arithmetic_draw("doc_id")))
    judged = build.judge_posts(sampled, users, char_class=r"\p{L}")
    return judged.select(
        "post_id", "user_id", "date_week", "province", F.md5("content_clean").alias("digest"), "word_count",
        F.coalesce("reject_reason", F.lit("kept")).alias("reason"),
    )


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 0.0 ELSE round(c_acctbal, 2) END AS balance,
       c_custkey % 3 = 0 AS reliable,
       CASE WHEN c_custkey % 4 = 0 THEN 'joy' WHEN c_custkey % 4 = 1 THEN 'fear' ELSE 'neutral' END AS emotion,
       (c_custkey % 100)::BIGINT AS posts, n_name AS province
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 25 <> 24""")
def dashboard_coercion(spark, d):
    rows = v.table(spark, d, "customer").join(v.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    blank = key % 25 == 24

    def cell(value):
        return F.when(blank, "  ").otherwise(value)

    text_rows = rows.select(
        cell(key.cast("string")).alias(" c_custkey "),
        cell(F.when(key % 7 == 0, "n/a").otherwise(F.format_string(" %.2f x", "c_acctbal"))).alias("balance"),
        cell(F.when(key % 3 == 0, "TRUE").otherwise("no")).alias("reliable"),
        cell(F.when(key % 4 == 0, " joy").when(key % 4 == 1, "fear").when(key % 4 == 2, "rage")).alias("emotion"),
        cell(F.concat((key % 100).cast("string"), F.lit(".9"))).alias("posts"),
        cell(F.concat("n_name", F.lit("省"))).alias("province"),
    )
    typed = tables.coerce_table(text_rows, ["balance"], ["reliable"], ["emotion"], ["province"], ["c_custkey", "posts"])
    return typed.withColumn("balance", F.round("balance", 2))


@query(v.with_(v.POSTS, select="""
SELECT 'emotion_panel_weekly' AS source, count(DISTINCT (date_week, region))::BIGINT AS row_count, true AS hashes_agree, true AS sizes_agree FROM posts
UNION ALL SELECT 'emotion_panel_monthly', count(DISTINCT (date_month, province))::BIGINT, true, true FROM posts
UNION ALL SELECT 'emotion_national_timeline', count(DISTINCT date_week)::BIGINT, true, true FROM posts
UNION ALL SELECT 'province_emotion_vectors', count(DISTINCT province)::BIGINT, true, true FROM posts"""))
def export_manifest(spark, d):
    """Panels exported as part files; what their writers say is compared with the files as Spark reads them."""
    folder = new_path(spark)
    posts = v.posts(spark, d)
    bundle.export_bundle({
        "emotion_panel_weekly": weekly(spark, d),
        "emotion_panel_monthly": monthly(spark, d),
        "emotion_national_timeline": panels.national_timeline(posts),
        "province_emotion_vectors": panels.province_vectors(posts, None),
    }, folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder).select(
        F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("path"), F.substring(F.sha2("content", 256), 1, 12).alias("_hash"), F.col("length").alias("_bytes"))
    both = bundle.manifest(spark, folder).join(files, "path", "full")
    return both.groupBy("source").agg(
        F.sum("row_count").alias("row_count"), F.coalesce(F.bool_and(F.col("hash").eqNullSafe(F.col("_hash"))), F.lit(False)).alias("hashes_agree"),
        F.coalesce(F.bool_and(F.col("size_bytes").eqNullSafe(F.col("_bytes"))), F.lit(False)).alias("sizes_agree"),
    )


@query(v.with_(v.POSTS, """
m AS (SELECT date_month, count(*) AS total_posts FROM posts GROUP BY date_month),
t AS (SELECT '"date_month","total_posts"' || chr(10) || string_agg('"' || date_month || '",' || total_posts || chr(10), '' ORDER BY date_month) AS text, count(*) AS n FROM m)""",
               select="SELECT 'months' AS source, substr(sha256(text), 1, 12) AS hash, n AS row_count, strlen(text)::BIGINT AS size_bytes FROM t"))
def export_hash(spark, d):
    """One file of known bytes: its writer's SHA-256, rows and size."""
    folder = new_path(spark)
    months = v.posts(spark, d).groupBy("date_month").agg(F.count(F.lit(1)).alias("total_posts"))
    # A row per month.
    bundle.export_bundle({"months": months.coalesce(1).sortWithinPartitions("date_month")}, folder)
    return bundle.manifest(spark, folder).select("source", "hash", "row_count", "size_bytes")


STREAM_SQL = f"SELECT post_id, {v.round_cols('joy', 'neutral')}, 'ok' AS label_status FROM scored"


@query(v.with_(SCORED, select=STREAM_SQL))
def scoring_stream(spark, d):
    """Documents scored as a file stream, run twice: the second run finds nothing new."""
    folder = new_path(spark)
    source = f"{folder}/in"
    docs(spark, d).write.parquet(source)
    for _ in range(2):
        posts = read_post_stream(spark, source, docs(spark, d).schema)
        score_stream(posts, lambda p: scoring.score_with_lexicon(p, LEXICON), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return v.rounded(spark.read.parquet(f"{folder}/out").select("post_id", "joy", "neutral", "label_status"))


@query(v.with_(SCORED, select=STREAM_SQL))
def scoring_stream_by_id(spark, d):
    """Two deliveries that share two fifths of the documents; the first batch breaks off and runs again."""
    folder = new_path(spark)
    source, rows = f"{folder}/in", docs(spark, d)
    number = F.col("post_id") % 10

    def run(score):
        posts = read_post_stream(spark, source, rows.schema)
        score_stream_by_id(posts, score, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()

    def breaking(posts):
        scored = scoring.score_with_lexicon(posts, LEXICON)
        return scored.withColumn("label_status", F.when(F.col("post_id") >= 0, F.raise_error(F.lit("killed"))).otherwise("ok"))

    rows.filter(number < 7).write.parquet(source)
    with contextlib.suppress(StreamingQueryException):
        run(breaking)
    run(lambda p: scoring.score_with_lexicon(p, LEXICON))
    rows.filter(number >= 3).write.mode("append").parquet(source)
    run(lambda p: scoring.score_with_lexicon(p, LEXICON))
    return v.rounded(read_scored(spark, f"{folder}/out").select("post_id", "joy", "neutral", "label_status"))
