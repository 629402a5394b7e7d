"""Panels and profiles."""

from pyspark.sql import functions as F

from catalog import query
from catalog import views as v
from feltgrid.domain import EMOTIONS
from feltgrid.operators import moments, panels
from feltgrid.operators.merge import group_size_stats
from feltgrid.operators.stage import stage


def weekly(spark, d):
    return panels.weekly_panel(v.posts(spark, d).drop("province").withColumnRenamed("region", "province"), None, v.MIN_POSTS)


def monthly(spark, d):
    return panels.monthly_panel(v.posts(spark, d), None, v.MIN_POSTS)


@query(v.with_(v.POSTS, v.NATIONAL, select=f"""
SELECT date_week, total_posts, {v.round_cols(*v.ALL_MEANS, *v.ALL_STDS, "positive_index", "fear_joy_ratio", "emotional_intensity")},
       dominant_emotion_key, {v.LABELS_SQL} AS dominant_emotion FROM national"""))
def national_weekly(spark, d):
    return v.rounded(panels.national_timeline(v.posts(spark, d)))


@query(v.with_(v.POSTS, v.WEEKLY, select=f"""
SELECT date_week, province, total_posts, reliable, dominant_emotion_key, {v.LABELS_SQL} AS dominant_emotion,
       {v.round_cols("avg_word_count", *v.ALL_MEANS, *v.ALL_STDS, "positive_index", "fear_joy_ratio", "emotional_intensity", "dominant_score")}
FROM weekly"""))
def weekly_region_panel(spark, d):
    return v.rounded(weekly(spark, d))


@query(v.with_(v.POSTS, v.MONTHLY, select=f"""
SELECT date_month, province, total_posts, reliable, dominant_emotion_key, {v.LABELS_SQL} AS dominant_emotion,
       {v.round_cols(*v.ALL_MEANS, "joy_std", "fear_std", "emotional_intensity", "dominant_score")}
FROM monthly"""))
def monthly_province_panel(spark, d):
    return v.rounded(monthly(spark, d))


@query(v.with_(v.POSTS, v.VECTORS, select=f"""
SELECT province, total_posts_all, {v.round_cols(*v.ALL_VECTOR)} FROM vectors"""))
def province_vectors(spark, d):
    return v.rounded(panels.province_vectors(v.posts(spark, d), None))


@query(v.with_(v.POSTS, v.NATIONAL, v.WEEKLY, v.MONTHLY, select="""
SELECT (SELECT count(*) FROM national)::BIGINT AS national_weeks,
       (SELECT dominant_emotion_key FROM national GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS national_dominant_emotion,
       (SELECT count(*) FROM weekly)::BIGINT AS weekly_rows,
       (SELECT round(avg(reliable::INT) * 100, 1) FROM weekly) AS weekly_reliable_pct,
       (SELECT count(*) FROM weekly WHERE reliable)::BIGINT AS weekly_reliable_count,
       (SELECT count(*) FROM monthly)::BIGINT AS monthly_rows,
       (SELECT round(avg(reliable::INT) * 100, 1) FROM monthly) AS monthly_reliable_pct,
       (SELECT count(*) FROM monthly WHERE reliable)::BIGINT AS monthly_reliable_count,
       (SELECT count(DISTINCT province) FROM posts)::BIGINT AS provinces"""))
def panel_summary(spark, d):
    posts = v.posts(spark, d)
    return panels.panel_summary(weekly(spark, d), monthly(spark, d), panels.national_timeline(posts), posts)


@query(v.with_(v.POSTS, select="""
SELECT count(*)::BIGINT AS total_posts, count(DISTINCT date_month)::BIGINT AS months,
       count(DISTINCT date_week)::BIGINT AS weeks, count(DISTINCT province)::BIGINT AS provinces,
       min(date_week) AS first_week, max(date_week) AS last_week,
       round(avg(word_count), 6) AS avg_word_count, round(median(word_count), 6) AS median_word_count
FROM posts"""))
def dataset_profile(spark, d):
    return v.rounded(panels.dataset_profile(v.posts(spark, d)))


@query(v.with_(v.POSTS, select="""
SELECT date_month, province, count(*)::BIGINT AS count FROM posts GROUP BY date_month, province"""))
def stratum_distribution(spark, d):
    return panels.stratum_distribution(v.posts(spark, d))


@query(v.with_(v.POSTS, select="\nUNION ALL\n".join(
    f"SELECT '{e}' AS emotion, round(avg({e}), 6) AS mean, round(stddev_samp({e}), 6) AS std FROM posts" for e in EMOTIONS)))
def emotion_distribution(spark, d):
    return v.rounded(panels.emotion_distribution(v.posts(spark, d)))


@query(v.with_(v.POSTS, select=f"""
SELECT {v.dominant_sql("")} AS dominant_emotion, count(*)::BIGINT AS count FROM posts GROUP BY 1"""))
def dominant_distribution(spark, d):
    return panels.dominant_distribution(v.posts(spark, d))


@query(v.with_(v.POSTS, """
cells AS (SELECT date_week, province, count(*) AS n FROM posts GROUP BY 1, 2)""", select="""
SELECT count(*)::BIGINT AS grid_count, min(n)::BIGINT AS grid_min, max(n)::BIGINT AS grid_max,
       round(median(n), 1) AS grid_median FROM cells"""))
def group_sizes(spark, d):
    return group_size_stats(v.posts(spark, d), ["date_week", "province"], "grid")


# --- Panels over stored states: an expansion adds posts and replaces the scores of some --------


def expanded_state(posts):
    """A state of two thirds of the posts, some with earlier scores, brought up to all posts without reading those again."""
    swapped = F.col("post_id") % 30 == 1
    old = posts.filter("post_id % 3 <> 0").withColumns({"joy": F.when(swapped, F.col("sadness")).otherwise(F.col("joy")), "sadness": F.when(swapped, F.col("joy")).otherwise(F.col("sadness"))})
    stored = stage(moments.post_moments(old))
    gone = moments.negative(moments.post_moments(old.filter(swapped)))
    new = moments.post_moments(posts.filter((F.col("post_id") % 3 == 0) | swapped))
    return stage(moments.merge_moments(stored, gone, new))


def by_region(spark, d):
    return v.posts(spark, d).drop("province").withColumnRenamed("region", "province")


@query(v.with_(v.POSTS, v.WEEKLY, select=f"""
SELECT date_week, province, total_posts, reliable, dominant_emotion_key, {v.LABELS_SQL} AS dominant_emotion,
       {v.round_cols("avg_word_count", *v.ALL_MEANS, *v.ALL_STDS, "positive_index", "fear_joy_ratio", "emotional_intensity", "dominant_score")}
FROM weekly"""))
def expanded_weekly_panel(spark, d):
    return v.rounded(moments.weekly_panel(expanded_state(by_region(spark, d)), None, v.MIN_POSTS))


@query(v.with_(v.POSTS, v.MONTHLY, select=f"""
SELECT date_month, province, total_posts, reliable, dominant_emotion_key, {v.LABELS_SQL} AS dominant_emotion,
       {v.round_cols(*v.ALL_MEANS, "joy_std", "fear_std", "emotional_intensity", "dominant_score")}
FROM monthly"""))
def expanded_monthly_panel(spark, d):
    return v.rounded(moments.monthly_panel(expanded_state(v.posts(spark, d)), None, v.MIN_POSTS))


@query(v.with_(v.POSTS, v.NATIONAL, select=f"""
SELECT date_week, total_posts, {v.round_cols(*v.ALL_MEANS, *v.ALL_STDS, "positive_index", "fear_joy_ratio", "emotional_intensity")},
       dominant_emotion_key, {v.LABELS_SQL} AS dominant_emotion FROM national"""))
def expanded_national(spark, d):
    return v.rounded(moments.national_timeline(expanded_state(v.posts(spark, d))))


@query(v.with_(v.POSTS, v.VECTORS, select=f"""
SELECT province, total_posts_all, {v.round_cols(*v.ALL_VECTOR)} FROM vectors"""))
def expanded_vectors(spark, d):
    return v.rounded(moments.province_vectors(expanded_state(v.posts(spark, d)), None))


@query(v.with_(v.POSTS, select="\nUNION ALL\n".join(
    f"SELECT '{e}' AS emotion, round(avg({e}), 6) AS mean, round(stddev_samp({e}), 6) AS std FROM posts" for e in EMOTIONS)))
def expanded_emotions(spark, d):
    return v.rounded(moments.emotion_distribution(expanded_state(v.posts(spark, d))))
