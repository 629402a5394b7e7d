"""Anomalous weeks."""

from pyspark.sql import functions as F

from catalog import query
from catalog import views as v
from catalog.q_panels import weekly
from feltgrid.operators import anomaly, panels
from feltgrid.operators.stage import stage


def series(spark, d):
    return anomaly.zscore_series(panels.national_timeline(v.posts(spark, d)), min_posts=v.NATIONAL_MIN)


def events(spark, d):
    return anomaly.anomaly_events(series(spark, d))


@query(v.with_(v.POSTS, v.NATIONAL, v.ZSERIES, select="""
SELECT date_week, emotion, round(value, 6) AS value, round(rolling_mean, 6) AS rolling_mean,
       round(rolling_std, 6) AS rolling_std, round(z_score, 4) AS z_score FROM zseries"""))
def zscore_series(spark, d):
    return v.rounded(series(spark, d), z_score=4)


@query(v.with_(v.POSTS, v.NATIONAL, v.ZSERIES, v.EVENTS, select="SELECT * FROM events_z"))
def anomaly_events(spark, d):
    return events(spark, d)


CONTRIBUTIONS = f"""
weekly_long AS (UNPIVOT (SELECT date_week, province, total_posts, joy_mean AS joy, anger_mean AS anger, fear_mean AS fear
                         FROM weekly WHERE total_posts >= {v.MIN_POSTS})
                ON joy, anger, fear INTO NAME emotion VALUE value),
contributions AS (
  SELECT e.date_week, e.emotion, province, round(value, 4) AS value, total_posts AS posts,
         row_number() OVER (PARTITION BY e.date_week, e.emotion
           ORDER BY round(CASE WHEN z_score < 0 THEN value ELSE -value END, 12), province) AS rank
  FROM events_z e JOIN weekly_long w ON e.date_week = w.date_week AND e.emotion = w.emotion
  QUALIFY rank <= 5)"""


@query(v.with_(v.POSTS, v.NATIONAL, v.ZSERIES, v.EVENTS, v.WEEKLY, CONTRIBUTIONS, select="""
SELECT date_week, emotion, rank::INT AS rank, province, value, posts FROM contributions"""))
def anomaly_contributors(spark, d):
    return anomaly.contributions(events(spark, d), weekly(spark, d), v.MIN_POSTS)


@query(v.with_(v.POSTS, v.NATIONAL, v.ZSERIES, v.EVENTS, v.WEEKLY, CONTRIBUTIONS, select=f"""
SELECT e.date_week, e.emotion, e.severity,
       coalesce(string_agg(c.province, ',' ORDER BY rank), '') AS top_provinces,
       CASE WHEN count(c.province) > 0 THEN NULL
            WHEN e.date_week NOT IN (SELECT date_week FROM weekly) THEN 'no_weekly_panel_data'
            ELSE 'no_province_with_posts_gte_{v.MIN_POSTS}' END AS reason
FROM events_z e LEFT JOIN contributions c ON e.date_week = c.date_week AND e.emotion = c.emotion
GROUP BY e.date_week, e.emotion, e.severity"""))
def anomaly_event_lists(spark, d):
    lists = anomaly.with_contributors(stage(events(spark, d)), stage(weekly(spark, d)), v.MIN_POSTS)
    return lists.select(
        "date_week", "emotion", "severity",
        F.array_join(F.transform("top_provinces", lambda p: p.province), ",").alias("top_provinces"),
        F.col("top_provinces_reason").alias("reason"),
    )


PERIOD_DELTA = """
lagged AS (SELECT date_week, lag(date_week) OVER w AS previous_week,
                  coalesce(positive_index - lag(positive_index) OVER w, 0) AS positive_delta,
                  emotional_intensity - lag(emotional_intensity) OVER w AS intensity_delta
           FROM national WINDOW w AS (ORDER BY date_week)),
period_delta AS (SELECT *, CASE WHEN intensity_delta > 0.05 THEN '明显升高' WHEN intensity_delta > 0.02 THEN '小幅升高'
         WHEN intensity_delta > -0.02 THEN '基本稳定' WHEN intensity_delta > -0.05 THEN '小幅下降' ELSE '明显下降' END AS trend
       FROM lagged ORDER BY date_week DESC LIMIT 1)"""


@query(v.with_(v.POSTS, v.NATIONAL, PERIOD_DELTA, select=f"""
SELECT date_week, previous_week, {v.round_cols("positive_delta", "intensity_delta")}, trend FROM period_delta"""))
def period_delta(spark, d):
    return v.rounded(anomaly.period_delta(panels.national_timeline(v.posts(spark, d))))
