"""Dashboard look-ups."""

from pyspark.sql import functions as F

from catalog import query
from catalog import views as v
from catalog.q_anomaly import PERIOD_DELTA, events, series
from catalog.q_panels import monthly, weekly
from feltgrid.domain import EMOTIONS
from feltgrid.functions import dates, metrics
from feltgrid.operators import dashboard, panels
from feltgrid.operators.stage import stage


def national(spark, d):
    return panels.national_timeline(v.posts(spark, d))


def vectors(spark, d):
    return panels.province_vectors(v.posts(spark, d), None)


def _day(expr: str) -> str:
    return f"month({expr}) || '月' || day({expr}) || '日'"


def _full(expr: str) -> str:
    return f"year({expr}) || '年' || {_day(expr)}"


def monday_sql(week: str) -> str:
    year, number = f"CAST(substr({week}, 1, 4) AS INT)", f"CAST(substr({week}, 7, 2) AS INT)"
    return f"(CAST(date_trunc('week', make_date({year}, 1, 4)) AS DATE) + ({number} - 1) * 7)"


def short_range_sql(week: str) -> str:
    start = monday_sql(week)
    end = f"({start} + 6)"
    return (
        f"CASE WHEN year({start}) <> year({end}) THEN {_full(start)} || '-' || {_full(end)} "
        f"WHEN month({start}) = month({end}) THEN {_day(start)} || '-' || day({end}) || '日' "
        f"ELSE {_day(start)} || '-' || {_day(end)} END"
    )


POSITIVE_SCORE = "joy_mean_all + surprise_mean_all * 0.5 - sadness_mean_all - anger_mean_all - fear_mean_all"


@query(v.with_(v.POSTS, v.NATIONAL, v.VECTORS, PERIOD_DELTA, select=f"""
SELECT (SELECT sum(total_posts) FROM national)::BIGINT AS total_posts,
       (SELECT min(date_week) FROM national) AS first_week, (SELECT max(date_week) FROM national) AS last_week,
       (SELECT round(avg(emotional_intensity), 6) FROM national) AS avg_intensity,
       (SELECT date_week FROM national ORDER BY round(fear_mean, 12) DESC, date_week LIMIT 1) AS fear_peak_week,
       (SELECT count(*) FROM vectors)::BIGINT AS province_count,
       (SELECT province FROM vectors ORDER BY round({POSITIVE_SCORE}, 12) DESC, province LIMIT 1) AS most_positive,
       (SELECT province FROM vectors ORDER BY round({POSITIVE_SCORE}, 12), province LIMIT 1) AS most_negative,
       (SELECT round(positive_delta, 6) FROM period_delta) AS positive_delta,
       (SELECT {short_range_sql("w")} FROM (SELECT min(date_week) AS w FROM national)) || ' - ' ||
       (SELECT {short_range_sql("w")} FROM (SELECT max(date_week) AS w FROM national)) AS week_range"""))
def dashboard_metrics(spark, d):
    return v.rounded(dashboard.dashboard_metrics(stage(national(spark, d)), vectors(spark, d)))


SEVERITY_RANK = "CASE severity WHEN 'extreme' THEN 3 WHEN 'severe' THEN 2 WHEN 'moderate' THEN 1 ELSE 0 END"


@query(v.with_(v.POSTS, v.NATIONAL, v.ZSERIES, v.EVENTS, select=f"""
SELECT * FROM events_z ORDER BY {SEVERITY_RANK} DESC, abs(z_score) DESC, date_week, emotion LIMIT 5"""))
def top_anomalies(spark, d):
    return dashboard.top_anomalies(events(spark, d))


@query(v.with_(v.POSTS, v.NATIONAL, select=f"""
SELECT date_week, emotion, round(value, 6) AS value, rank::INT AS rank, rank <= 3 AS top3,
       {v.round_cols("positive", "negative", "neutral_part")}
FROM (SELECT date_week, e.emotion,
             CASE e.i {" ".join(f"WHEN {i} THEN {e}_mean" for i, e in enumerate(EMOTIONS))} END AS value,
             joy_mean + surprise_mean * 0.5 AS positive, fear_mean + anger_mean + sadness_mean AS negative,
             neutral_mean AS neutral_part, row_number() OVER (ORDER BY round(value, 12) DESC, e.i) AS rank
      FROM (SELECT * FROM national ORDER BY date_week DESC LIMIT 1),
           (VALUES {", ".join(f"({i}, '{e}')" for i, e in enumerate(EMOTIONS))}) AS e(i, emotion))"""))
def latest_composition(spark, d):
    return v.rounded(dashboard.latest_composition(national(spark, d)))


@query(v.with_(v.POSTS, v.NATIONAL, v.ZSERIES, v.EVENTS, select="""
SELECT * FROM events_z WHERE emotion = 'fear' AND severity = 'extreme'"""))
def event_filter(spark, d):
    return dashboard.filter_events(events(spark, d), "fear", "extreme")


@query(v.with_(v.POSTS, v.WEEKLY, select=f"""
SELECT date_week, province, total_posts, {v.round_cols(*v.ALL_MEANS)} FROM weekly WHERE province = 'ASIA'"""))
def province_series(spark, d):
    return v.rounded(dashboard.province_series(weekly(spark, d), "ASIA").select(
        "date_week", "province", "total_posts", *v.ALL_MEANS))


@query(v.with_(v.POSTS, v.VECTORS, select="SELECT province, total_posts_all FROM vectors"))
def province_list(spark, d):
    return dashboard.province_list(vectors(spark, d))


@query(v.with_(v.POSTS, v.VECTORS, select=f"""
SELECT province, total_posts_all, emotion, round(value, 6) AS value, rank::INT AS rank, total_posts_all < 10 AS low_sample
FROM (SELECT *, row_number() OVER (PARTITION BY province ORDER BY round(value, 12) DESC, i) AS rank
      FROM (SELECT province, total_posts_all, e.emotion, e.i,
                   CASE e.i {" ".join(f"WHEN {i} THEN {e}_mean_all" for i, e in enumerate(EMOTIONS))} END AS value
            FROM vectors, (VALUES {", ".join(f"({i}, '{e}')" for i, e in enumerate(EMOTIONS))}) AS e(i, emotion)))
WHERE rank <= 3"""))
def province_top_emotions(spark, d):
    return v.rounded(dashboard.province_top_emotions(vectors(spark, d)))


BUCKET = "CASE WHEN emotional_intensity <= 0.15 THEN 0 WHEN emotional_intensity <= 0.3 THEN 1 WHEN emotional_intensity <= 0.45 THEN 2 WHEN emotional_intensity <= 0.6 THEN 3 ELSE 4 END"


@query(v.with_(v.POSTS, v.MONTHLY, v.VECTORS, f"""
month_rows AS (SELECT province, 'month' AS source, total_posts, {", ".join(v.ALL_MEANS)}, emotional_intensity
               FROM monthly WHERE reliable AND date_month = (SELECT max(date_month) FROM monthly)),
map_rows AS (SELECT * FROM month_rows UNION ALL
             SELECT province, 'whole', total_posts_all, {", ".join(e + "_mean_all" for e in EMOTIONS)}, emotional_intensity_mean
             FROM vectors WHERE (SELECT count(*) FROM month_rows) = 0)""", select=f"""
SELECT province, source, total_posts, {v.round_cols(*v.ALL_MEANS, "emotional_intensity")},
       {v.display_dominant_sql()} AS dominant, {BUCKET} AS bucket FROM map_rows"""))
def map_dataset(spark, d):
    return v.rounded(dashboard.map_dataset(stage(monthly(spark, d)), vectors(spark, d)))


@query(v.with_(v.POSTS, v.VECTORS, """
shares AS (SELECT province, (joy_mean_all + 0.5 * surprise_mean_all) / (1 - neutral_mean_all + 0.01) AS value FROM vectors)""",
               select="""
SELECT province, round(value, 6) AS value,
       round(CASE WHEN max(value) OVER () = min(value) OVER () THEN 50.0
             ELSE (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) * 100 END, 6) AS normalized
FROM shares"""))
def map_normalised(spark, d):
    return v.rounded(dashboard.map_normalised(vectors(spark, d)))


@query(v.with_(v.TEXTS, f"""
text_scores AS (UNPIVOT (SELECT post_id, province, {", ".join(EMOTIONS)} FROM texts
                         WHERE length(trim(content_clean)) > 0 AND length(trim(province)) > 0)
                ON {", ".join(EMOTIONS)} INTO NAME emotion VALUE score)""", select="""
SELECT r.post_id, r.province, r.emotion, round(score, 6) AS score, r.rank::INT AS rank, date_week, md5(content_clean) AS content,
       round(CASE r.emotion WHEN 'joy' THEN sadness ELSE joy END, 6) AS other_score
FROM (SELECT *, row_number() OVER (PARTITION BY province, emotion ORDER BY score DESC, post_id) AS rank FROM text_scores) r
JOIN texts USING (post_id) WHERE r.rank <= 5"""))
def top_posts_per_region_emotion(spark, d):
    top = dashboard.top_posts(v.texts(spark, d))
    other = F.when(F.col("emotion") == "joy", F.col("scores")["sadness"]).otherwise(F.col("scores")["joy"])
    return v.rounded(top.select(
        "post_id", "province", "emotion", "score", "rank", "date_week", F.md5("content").alias("content"),
        other.alias("other_score"),
    ))


@query(v.with_(v.POSTS, v.NATIONAL, select="""
(SELECT 'fear' AS emotion, date_week FROM national ORDER BY round(fear_mean, 12) DESC, date_week LIMIT 1)
UNION ALL (SELECT 'joy', date_week FROM national ORDER BY round(joy_mean, 12) DESC, date_week LIMIT 1)"""))
def peak_weeks(spark, d):
    return dashboard.peak_weeks(national(spark, d))


@query(v.with_(v.POSTS, select="""
SELECT province, count(*)::BIGINT AS posts FROM posts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6"""))
def largest_provinces(spark, d):
    return dashboard.largest_provinces(v.posts(spark, d))


START = monday_sql("date_week")


@query(v.with_(v.POSTS, select=f"""
SELECT DISTINCT date_week, date_month,
       {_full(START)} || '-' || CASE WHEN year({START}) = year({START} + 6) THEN {_day(f"({START} + 6)")} ELSE {_full(f"({START} + 6)")} END AS full_range,
       {short_range_sql("date_week")} AS short_range,
       strftime({START}, '%m.%d') || '-' || strftime({START} + 6, '%m.%d') AS axis_range,
       substr(date_month, 1, 4) || '年' || CAST(substr(date_month, 6, 2) AS INT) || '月' AS month_label,
       CAST(substr(date_month, 6, 2) AS INT) || '月' AS month_short
FROM posts"""))
def week_range_labels(spark, d):
    keys = v.posts(spark, d).select("date_week", "date_month").distinct()
    return keys.select(
        "date_week", "date_month",
        dates.week_full_range("date_week").alias("full_range"),
        dates.week_short_range("date_week").alias("short_range"),
        dates.week_axis_range("date_week").alias("axis_range"),
        dates.month_label("date_month").alias("month_label"),
        dates.month_short_label("date_month").alias("month_short"),
    )


_Z = "round(z_score, 6)"
_DEVIATION = v.deviation_sql("value", "rolling_mean")
_NAMES = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(metrics.CLUSTER_NAMES))


@query(v.with_(v.POSTS, v.NATIONAL, v.ZSERIES, f"""
zdev AS (SELECT *, {_DEVIATION} AS deviation FROM zseries)""", select=f"""
SELECT date_week, emotion, {v.severity_sql(_Z)} AS severity,
       CASE {v.severity_sql(_Z)} WHEN 'extreme' THEN '极端异常' WHEN 'severe' THEN '强烈异常' ELSE '轻微异常' END AS severity_text,
       CASE WHEN abs({_Z}) >= 4 THEN '极端异常' WHEN abs({_Z}) >= 3 THEN '强烈异常' WHEN abs({_Z}) >= 2.5 THEN '明显偏高' ELSE '轻微波动' END AS z_text,
       deviation,
       CASE WHEN deviation = 'N/A' THEN 'N/A' WHEN CAST(replace(deviation, '%', '') AS DOUBLE) > 0
            THEN '比过去 4 周高出 ' || replace(substr(deviation, 2), '%', '') || '%'
            ELSE '比过去 4 周低 ' || replace(substr(deviation, 2), '%', '') || '%' END AS sentence,
       CASE WHEN value <= 0.15 THEN 0 WHEN value <= 0.3 THEN 1 WHEN value <= 0.45 THEN 2 WHEN value <= 0.6 THEN 3 ELSE 4 END AS bucket,
       CASE (CAST(substr(date_week, 7, 2) AS INT) % 8) {_NAMES} ELSE 'Cluster ' || (CAST(substr(date_week, 7, 2) AS INT) % 8) END AS cluster_name
FROM zdev"""))
def metric_bands(spark, d):
    z = F.round("z_score", 6)
    return series(spark, d).select(
        "date_week", "emotion",
        metrics.severity(z).alias("severity"),
        metrics.severity_text(metrics.severity(z)).alias("severity_text"),
        metrics.z_text(z).alias("z_text"),
        metrics.deviation_pct("value", "rolling_mean").alias("deviation"),
        metrics.deviation_sentence(metrics.deviation_pct("value", "rolling_mean")).alias("sentence"),
        metrics.map_bucket("value").alias("bucket"),
        metrics.cluster_name(F.substring("date_week", 7, 2).cast("int") % 8).alias("cluster_name"),
    )


@query(v.with_(v.POSTS, v.VECTORS, """
cluster_labels AS (SELECT n_name || '省' AS province, n_nationkey % 4 AS cluster_label FROM nation WHERE n_nationkey % 6 <> 0)""",
               select="""
SELECT v.province, total_posts_all, cluster_label
FROM vectors v LEFT JOIN cluster_labels c ON v.province || '省' = c.province"""))
def vector_clusters(spark, d):
    nation = v.table(spark, d, "nation").filter("n_nationkey % 6 <> 0")
    labels = nation.select(F.concat("n_name", F.lit("省")).alias("province"), (F.col("n_nationkey") % 4).alias("cluster_label"))
    return dashboard.attach_clusters(vectors(spark, d), labels).select("province", "total_posts_all", "cluster_label")


@query(v.with_(v.POSTS, v.NATIONAL, v.VECTORS, PERIOD_DELTA, select=f"""
SELECT {short_range_sql("n.date_week")} AS week_range, {v.display_dominant_sql()} AS dominant,
       round(emotional_intensity * 100, 1) AS intensity_pct,
       (SELECT province FROM vectors ORDER BY round(emotional_intensity_mean, 12) DESC, province LIMIT 1) AS province,
       p.trend FROM national n JOIN period_delta p ON n.date_week = p.date_week"""))
def story(spark, d):
    return dashboard.story(stage(national(spark, d)), vectors(spark, d))


@query(v.with_(v.POSTS, v.NATIONAL, select=f"""
SELECT date_week, strftime({START}, '%m.%d') || '-' || strftime({START} + 6, '%m.%d') AS date_label,
       round(emotional_intensity, 6) AS intensity, round(positive_index, 6) AS positive,
       round(fear_mean + anger_mean + sadness_mean, 6) AS negative FROM national"""))
def weekly_pressure(spark, d):
    return v.rounded(dashboard.weekly_pressure(national(spark, d)))
