"""User look-ups, coverage profiles and grid counts."""

from pyspark.sql import functions as F

from catalog import query
from catalog import views as v
from feltgrid.operators import enrich
from feltgrid.sources.posts import select_users

# Raw posts: text columns as they come from the monthly files. One user id in fifty is blank, one
# date in thirteen unreadable, and the file month is the post's own month.
RAW = """
raw AS (SELECT o_orderkey AS post_id, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS user_key,
               strftime(o_orderdate, '%Y-%m') AS file_month,
               CASE WHEN o_orderkey % 13 <> 0 THEN strftime(o_orderdate, '%G-W%V') END AS date_week,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority || o_orderstatus END AS content,
               CASE WHEN o_orderkey % 3 = 0 THEN 'geo' END AS geo_info
        FROM orders),
users AS (SELECT c_custkey AS user_key, n_name AS province FROM customer JOIN nation ON c_nationkey = n_nationkey
          WHERE c_custkey % 10 <> 0)"""


def raw_posts(spark, d):
    key = F.col("o_orderkey")
    return v.table(spark, d, "orders").select(
        key.alias("post_id"),
        F.when(key % 50 == 0, " ").otherwise(F.col("o_custkey").cast("string")).alias("user_id"),
        F.date_format("o_orderdate", "yyyy-MM").alias("file_month"),
        F.when(key % 13 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("created_at"),
        F.when(key % 17 != 0, F.concat("o_orderpriority", "o_orderstatus")).alias("content"),
        F.when(key % 3 == 0, "geo").alias("geo_info"),
    )


def users(spark, d):
    """Customers, each twice: the second copy has another province and must lose."""
    known = v.table(spark, d, "customer").filter("c_custkey % 10 <> 0").join(
        v.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    copies = known.select("c_custkey", "n_name", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    rows = copies.select(
        F.concat(F.lit(" "), F.col("c_custkey").cast("string")).alias("user_id"),
        F.when(F.col("copy") == 0, F.col("n_name")).otherwise("NATION_0").alias("province"),
        "copy",
    )
    return select_users(rows, v.NATIONS, "copy")


@query(v.with_(RAW, select="SELECT user_key::VARCHAR AS user_id, province FROM users"))
def user_scan(spark, d):
    return users(spark, d).select("user_id", "province")


@query(v.with_(RAW, select="""
SELECT post_id, coalesce(province, '未知') AS province, '' AS city, '' AS gender
FROM raw LEFT JOIN users USING (user_key)"""))
def user_region_lookup(spark, d):
    return enrich.attach_province(raw_posts(spark, d), users(spark, d)).select("post_id", "province", "city", "gender")


def counts(spark, d):
    return enrich.province_counts(raw_posts(spark, d), users(spark, d))


COUNTS = """
matched AS (SELECT file_month, date_week, coalesce(province, '未知') AS province, province IS NOT NULL AS hit
            FROM raw LEFT JOIN users USING (user_key) WHERE user_key IS NOT NULL)"""


@query(v.with_(RAW, COUNTS, select="""
SELECT province, file_month, date_week, hit, count(*)::BIGINT AS posts FROM matched GROUP BY ALL"""))
def province_week_counts(spark, d):
    return counts(spark, d)


@query(v.with_(RAW, COUNTS, select="""
SELECT count(*)::BIGINT AS total_rows, count(*) FILTER (hit)::BIGINT AS join_hits, round(avg(hit::INT), 6) AS join_rate,
       count(*) FILTER (province <> '未知')::BIGINT AS valid_province_count,
       round(avg((province <> '未知')::INT), 6) AS valid_province_rate FROM matched"""))
def join_coverage(spark, d):
    return v.rounded(enrich.join_coverage(counts(spark, d), v.NATIONS))


@query(v.with_(RAW, select="""
SELECT file_month, count(*)::BIGINT AS sampled, round(avg((date_week IS NOT NULL)::INT), 6) AS created_at_parse_rate,
       round(avg((content IS NOT NULL)::INT), 6) AS content_non_null_rate,
       round(avg((user_key IS NOT NULL)::INT), 6) AS user_id_non_null_rate,
       round(avg((geo_info IS NOT NULL)::INT), 6) AS geo_info_non_null_rate,
       round(avg(length(regexp_replace(content, '[^\\p{L}]', '', 'g'))), 6) AS chinese_char_mean,
       round(median(length(regexp_replace(content, '[^\\p{L}]', '', 'g'))), 6) AS chinese_char_median
FROM raw GROUP BY file_month"""))
def quality_profile(spark, d):
    return v.rounded(enrich.quality_profile(raw_posts(spark, d), char_class=r"\p{L}"))


MIN_WEEKLY = 2


@query(v.with_(RAW, COUNTS, f"""
cells AS (SELECT province, date_week, count(*) AS posts FROM matched
          WHERE province <> '未知' AND date_week IS NOT NULL GROUP BY 1, 2),
medians AS (SELECT province, median(posts) AS m FROM cells GROUP BY 1),
f AS (SELECT (SELECT avg(hit::INT) FROM matched) AS join_rate,
             (SELECT avg((province <> '未知')::INT) FROM matched) AS valid_rate,
             (SELECT count(*) FILTER (m >= {MIN_WEEKLY}) FROM medians)::BIGINT AS good,
             (SELECT count(*) FROM medians)::BIGINT AS total,
             (SELECT avg(posts) FROM cells) AS avg_w, (SELECT median(posts) FROM cells) AS med_w)""", select=f"""
SELECT valid_rate >= 0.8 AND good >= 20 AS can_do_province,
       CASE WHEN valid_rate >= 0.8 AND good >= 20 AND med_w >= {MIN_WEEKLY} THEN 'weekly_province'
            WHEN valid_rate >= 0.8 AND good >= 20 THEN 'monthly_province' ELSE 'national_timeline_only' END AS recommended_geo_granularity,
       good AS good_provinces_count, total AS total_provinces_count, round(avg_w, 1) AS avg_weekly_per_province,
       round(med_w, 1) AS median_weekly_per_province,
       concat_ws('; ', CASE WHEN join_rate < 0.8 THEN printf('join_rate=%.3f', join_rate) END,
         CASE WHEN NOT valid_rate >= 0.8 THEN printf('valid_province_rate=%.3f', valid_rate) END,
         CASE WHEN NOT good >= 20 THEN 'good_provinces=' || good END,
         CASE WHEN valid_rate >= 0.8 AND good >= 20 AND NOT med_w >= {MIN_WEEKLY} THEN 'granularity=monthly' END,
         CASE WHEN NOT (valid_rate >= 0.8 AND good >= 20) THEN 'granularity=national' END) AS warnings FROM f"""))
def feasibility(spark, d):
    row = enrich.feasibility(counts(spark, d), v.NATIONS, MIN_WEEKLY)
    return row.withColumn("warnings", F.array_join("warnings", "; "))


LABELLED = "labelled AS (SELECT * FROM posts WHERE post_id % 3 = 0)"


def mini_and_labelled(spark, d):
    posts = v.posts(spark, d)
    return posts, posts.filter("post_id % 3 = 0")


@query(v.with_(v.POSTS, LABELLED, select="SELECT post_id FROM posts WHERE post_id NOT IN (SELECT post_id FROM labelled)"))
def unlabelled(spark, d):
    return enrich.unlabelled(*mini_and_labelled(spark, d)).select("post_id")


@query(v.with_(v.POSTS, LABELLED, select="SELECT post_id FROM posts WHERE post_id IN (SELECT post_id FROM labelled)"))
def already_labelled(spark, d):
    return enrich.already_labelled(*mini_and_labelled(spark, d)).select("post_id")


GRID = """
grid AS (SELECT date_month, n_name AS province FROM (SELECT DISTINCT date_month FROM posts), nation),
grid_counts AS (
  SELECT date_month, province, count(post_id) FILTER (post_id % 3 = 0)::BIGINT AS existing_labeled,
         count(post_id) FILTER (post_id % 3 <> 0)::BIGINT AS available_candidates
  FROM grid LEFT JOIN posts USING (date_month, province) GROUP BY 1, 2)"""


@query(v.with_(v.POSTS, GRID, select="SELECT * FROM grid_counts"))
def grid_counts(spark, d):
    return enrich.grid_counts(*mini_and_labelled(spark, d), v.NATIONS)


def cells_sql(cap: str, extra: str = "") -> str:
    return f"""
week_cells AS (
  SELECT *, least(gap, candidates_available) AS to_sample, gap - least(gap, candidates_available) AS shortage
  FROM (SELECT *, greatest({cap} - current_labeled, 0)::BIGINT AS gap
        FROM (SELECT date_week, province, count(*) FILTER (post_id % 3 = 0)::BIGINT AS current_labeled,
                     count(*) FILTER (post_id % 3 <> 0)::BIGINT AS candidates_available
              FROM posts GROUP BY 1, 2){extra}))"""


@query(v.with_(v.POSTS, cells_sql(str(v.CAP)), select="SELECT * FROM week_cells"))
def cell_status(spark, d):
    return enrich.cell_status(*mini_and_labelled(spark, d), v.CAP, v.NATIONS)
