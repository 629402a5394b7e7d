"""Post-like views over the driver tables, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feltgrid.domain import EMOTIONS
from feltgrid.functions import dates

NATIONS = [f"NATION_{i}" for i in range(25)]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
MIN_POSTS = 5
NATIONAL_MIN = 30
CAP = 10


@lru_cache(maxsize=64)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The scan of a table; kept, so that a query which reads it twice lists its files once."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """All double columns rounded, so that summation order does not show."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, special.get(c, digits)) for c in doubles})


def _scores(key: Column, user: Column, nation: Column) -> dict[str, Column]:
    weights = [
        1 + (key * 7 + user * 3 + nation * 11) % 97,
        1 + (key * 13 + user * 5) % 53,
        1 + (key * 17 + nation * 29) % 41,
        1 + (key * 19 + user) % 23,
        1 + (key * 23) % 31,
        1 + (key * 29 + nation) % 113,
    ]
    total = sum(weights[1:], weights[0])
    return {e: w.cast("double") / total for e, w in zip(EMOTIONS, weights)}


@lru_cache(maxsize=8)
def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as posts of customers, nations as provinces."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    joined = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    key, user, n = F.col("o_orderkey"), F.col("o_custkey"), F.col("n_nationkey").cast("bigint")
    return joined.select(
        key.alias("post_id"),
        user.alias("user_id"),
        F.col("o_orderdate").alias("created_at"),
        dates.iso_week("o_orderdate").alias("date_week"),
        dates.month_key("o_orderdate").alias("date_month"),
        F.col("n_name").alias("province"),
        F.col("r_name").alias("region"),
        (key % 140 + 10).alias("word_count"),
        *[s.alias(e) for e, s in _scores(key, user, n).items()],
    )


@lru_cache(maxsize=8)
def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts in 21 week buckets, the last one small."""
    docs = table(spark, sf_dir, "documents")
    key, chars = F.col("doc_id"), F.col("n_chars")
    bucket = F.when(key % 200 == 0, 20).otherwise(key % 20).cast("int")
    created = F.date_add(F.lit("2020-01-06").cast("date"), bucket * 7)
    return docs.select(
        key.alias("post_id"),
        F.col("source").alias("province"),
        F.col("text").alias("content_clean"),
        "lang",
        chars.alias("n_chars"),
        dates.iso_week(created).alias("date_week"),
        *[s.alias(e) for e, s in _scores(key, chars, F.lit(0).cast("bigint")).items()],
    )


def arithmetic_draw(key: str = "post_id") -> Column:
    """Draw that SQL can repeat, in place of the hash."""
    return (F.col(key) % 1000003) * 2654435761 % 2147483647


DRAW_SQL = "((post_id % 1000003) * 2654435761 % 2147483647)"

# --- SQL ------------------------------------------------------------------------------------

_RATIO = ", ".join(
    f"CAST(w{i} AS DOUBLE)/(w1+w2+w3+w4+w5+w6) AS {e}" for i, e in enumerate(EMOTIONS, 1)
)


def _weights_sql(key: str, user: str, nation: str) -> str:
    return f"""
         1 + ({key}*7  + {user}*3 + {nation}*11) % 97 AS w1,
         1 + ({key}*13 + {user}*5) % 53 AS w2,
         1 + ({key}*17 + {nation}*29) % 41 AS w3,
         1 + ({key}*19 + {user}) % 23 AS w4,
         1 + ({key}*23) % 31 AS w5,
         1 + ({key}*29 + {nation}) % 113 AS w6"""


POSTS = f"""
posts_w AS (
  SELECT o_orderkey AS post_id, o_custkey AS user_id, o_orderdate AS created_at,
         n_name AS province, r_name AS region, o_orderkey % 140 + 10 AS word_count,
         {_weights_sql("o_orderkey", "o_custkey", "n_nationkey")}
  FROM orders JOIN customer ON o_custkey = c_custkey
              JOIN nation ON c_nationkey = n_nationkey
              JOIN region ON n_regionkey = r_regionkey),
posts AS (
  SELECT post_id, user_id, created_at, strftime(created_at,'%G-W%V') AS date_week,
         strftime(created_at,'%Y-%m') AS date_month, province, region, word_count, {_RATIO}
  FROM posts_w)"""

TEXTS = f"""
texts_w AS (
  SELECT doc_id AS post_id, source AS province, text AS content_clean, lang, n_chars,
         strftime(DATE '2020-01-06' + CAST(7 * (CASE WHEN doc_id % 200 = 0 THEN 20 ELSE doc_id % 20 END) AS INTEGER),
                  '%G-W%V') AS date_week,
         {_weights_sql("doc_id", "n_chars", "0")}
  FROM documents),
texts AS (SELECT post_id, province, content_clean, lang, n_chars, date_week, {_RATIO} FROM texts_w)"""


def dominant_sql(suffix: str = "_mean") -> str:
    cols = [f"{e}{suffix}" for e in EMOTIONS]
    whens = " ".join(f"WHEN {c} THEN '{e}'" for c, e in zip(cols, EMOTIONS))
    return f"CASE greatest({', '.join(cols)}) {whens} END"


def display_dominant_sql(suffix: str = "_mean") -> str:
    order = [EMOTIONS[5], *EMOTIONS[:5]]
    whens = " ".join(f"WHEN {e}{suffix} THEN '{e}'" for e in order)
    return f"CASE greatest({', '.join(e + suffix for e in EMOTIONS)}) {whens} END"


LABELS_SQL = "CASE dominant_emotion_key WHEN 'joy' THEN '喜悦' WHEN 'sadness' THEN '悲伤' WHEN 'anger' THEN '愤怒' WHEN 'fear' THEN '恐惧' WHEN 'surprise' THEN '惊讶' WHEN 'neutral' THEN '中性' END"

MEANS_SQL = ", ".join(f"avg({e}) AS {e}_mean" for e in EMOTIONS)
STDS_SQL = ", ".join(f"stddev_samp({e}) AS {e}_std" for e in EMOTIONS)
POSITIVE_SQL = "joy_mean / (sadness_mean + anger_mean + fear_mean + 0.01)"
RATIO_SQL = "fear_mean / (joy_mean + 0.01)"

NATIONAL = f"""
national_m AS (SELECT date_week, count(post_id)::BIGINT AS total_posts, {MEANS_SQL}, {STDS_SQL}
               FROM posts GROUP BY date_week),
national AS (SELECT *, {dominant_sql()} AS dominant_emotion_key, {POSITIVE_SQL} AS positive_index,
                    {RATIO_SQL} AS fear_joy_ratio, 1 - neutral_mean AS emotional_intensity
             FROM national_m)"""

WEEKLY = f"""
weekly_m AS (SELECT date_week, region AS province, count(post_id)::BIGINT AS total_posts,
                    avg(word_count) AS avg_word_count, {MEANS_SQL}, {STDS_SQL}
             FROM posts GROUP BY date_week, region),
weekly AS (SELECT *, {dominant_sql()} AS dominant_emotion_key, {POSITIVE_SQL} AS positive_index,
                  {RATIO_SQL} AS fear_joy_ratio, 1 - neutral_mean AS emotional_intensity,
                  greatest({", ".join(e + "_mean" for e in EMOTIONS)}) AS dominant_score,
                  total_posts >= {MIN_POSTS} AS reliable
           FROM weekly_m)"""

MONTHLY = f"""
monthly_m AS (SELECT date_month, province, count(post_id)::BIGINT AS total_posts, {MEANS_SQL},
                     stddev_samp(joy) AS joy_std, stddev_samp(fear) AS fear_std
              FROM posts GROUP BY date_month, province),
monthly AS (SELECT *, {dominant_sql()} AS dominant_emotion_key, 1 - neutral_mean AS emotional_intensity,
                   greatest({", ".join(e + "_mean" for e in EMOTIONS)}) AS dominant_score,
                   total_posts >= {MIN_POSTS} AS reliable
            FROM monthly_m)"""

VECTORS = f"""
vectors AS (SELECT province, count(post_id)::BIGINT AS total_posts_all,
                   {", ".join(f"avg({e}) AS {e}_mean_all" for e in EMOTIONS)},
                   1 - avg(neutral) AS emotional_intensity_mean,
                   var_samp(fear) AS fear_variance, var_samp(joy) AS joy_variance
            FROM posts GROUP BY province)"""

ZSERIES = f"""
zlong AS (SELECT date_week, e.emotion, CASE e.emotion WHEN 'fear' THEN fear_mean WHEN 'anger' THEN anger_mean ELSE joy_mean END AS value
          FROM national, (VALUES ('fear'), ('anger'), ('joy')) AS e(emotion) WHERE total_posts >= {NATIONAL_MIN}),
zbase AS (SELECT *, CASE WHEN count(value) OVER w >= 2 THEN avg(value) OVER w END AS rolling_mean,
                 CASE WHEN count(value) OVER w >= 2 THEN stddev_samp(value) OVER w END AS rolling_std
          FROM zlong WINDOW w AS (PARTITION BY emotion ORDER BY date_week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
zseries AS (SELECT *, (value - rolling_mean) / (rolling_std + 1e-8) AS z_score FROM zbase)"""


def deviation_sql(value: str, expected: str) -> str:
    pct = f"(({value}) - ({expected})) / abs({expected}) * 100"
    return (
        f"CASE WHEN {expected} IS NULL OR abs({expected}) < 1e-8 THEN 'N/A' ELSE "
        f"(CASE WHEN {pct} < 0 THEN '-' ELSE '+' END) || CAST(CAST(abs(round_even({pct}, 0)) AS BIGINT) AS VARCHAR) || '%' END"
    )


def severity_sql(z: str) -> str:
    return (
        f"CASE WHEN abs({z}) >= 3 AND abs({z}) < 3.5 THEN 'severe' "
        f"WHEN abs({z}) >= 3.5 AND abs({z}) < 100 THEN 'extreme' ELSE 'moderate' END"
    )


EVENTS = f"""
events_z AS (SELECT date_week, emotion, round(z_score, 2) AS z_score, round(value, 4) AS national_value,
                  round(rolling_mean, 4) AS expected_value,
                  {deviation_sql("value", "rolling_mean")} AS deviation_pct,
                  {severity_sql("z_score")} AS severity
           FROM zseries WHERE abs(z_score) > 2.5)"""


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + select


def round_cols(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


ALL_MEANS = [f"{e}_mean" for e in EMOTIONS]
ALL_STDS = [f"{e}_std" for e in EMOTIONS]
ALL_VECTOR = [f"{e}_mean_all" for e in EMOTIONS] + ["emotional_intensity_mean", "fear_variance", "joy_variance"]
