"""Anomalous weeks: lagged rolling z-scores, severity and contributing provinces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feltgrid import domain
from feltgrid.functions import metrics


def zscore_series(
    national: DataFrame,
    emotions: Sequence[str] = domain.ANOMALY_EMOTIONS,
    window: int = domain.ROLLING_WINDOW,
    min_rows: int = domain.ROLLING_MIN_ROWS,
    min_posts: int = domain.MIN_POSTS_RELIABLE,
) -> DataFrame:
    """Long series ``(date_week, emotion, value, rolling_mean, rolling_std, z_score)``.

    Weeks with few posts are dropped first. The baseline is the ``window`` previous kept rows,
    not calendar weeks, so a gap widens it. The input has one row per week, and one window per
    emotion serves all weeks.
    """
    kept = national.filter(F.col("total_posts") >= min_posts)
    long = kept.select("date_week", *[F.col(f"{e}_mean").alias(e) for e in emotions]).unpivot(
        ["date_week"], list(emotions), "emotion", "value"
    )
    past = W.partitionBy("emotion").orderBy("date_week").rowsBetween(-window, -1)
    enough = F.count("value").over(past) >= min_rows
    series = long.withColumns({
        "rolling_mean": F.when(enough, F.avg("value").over(past)),
        "rolling_std": F.when(enough, F.stddev_samp("value").over(past)),
    })
    z = (F.col("value") - F.col("rolling_mean")) / (F.col("rolling_std") + 1e-8)
    return series.withColumn("z_score", z)


def anomaly_events(series: DataFrame, threshold: float = domain.Z_THRESHOLD) -> DataFrame:
    """Weeks whose |z| exceeds the threshold."""
    return series.filter(F.abs("z_score") > threshold).select(
        "date_week",
        "emotion",
        F.round("z_score", 2).alias("z_score"),
        F.round("value", 4).alias("national_value"),
        F.round("rolling_mean", 4).alias("expected_value"),
        metrics.deviation_pct("value", "rolling_mean").alias("deviation_pct"),
        metrics.severity("z_score").alias("severity"),
    )


def contributions(
    events: DataFrame,
    weekly: DataFrame,
    min_posts: int = domain.MIN_POSTS_RELIABLE,
    top: int = 5,
    region: str = "province",
) -> DataFrame:
    """One row per event and contributing province: the highest values of a spike, the lowest
    of a dip, ranked 1 to ``top``."""
    long = (
        weekly.filter(F.col("total_posts") >= min_posts)
        .select("date_week", region, "total_posts",
                *[F.col(f"{e}_mean").alias(e) for e in domain.EMOTIONS])
        .unpivot(["date_week", region, "total_posts"], domain.EMOTIONS, "emotion", "value")
    )
    direction = F.when(F.col("z_score") < 0, 1.0).otherwise(-1.0)
    rank = F.row_number().over(
        W.partitionBy("date_week", "emotion").orderBy(F.round(direction * F.col("value"), 12), region)
    )
    return (
        events.select("date_week", "emotion", "z_score")
        .join(long, ["date_week", "emotion"])
        .withColumn("rank", rank)
        .filter(F.col("rank") <= top)
        .select("date_week", "emotion", "rank", F.col(region).alias("province"),
                F.round("value", 4).alias("value"), F.col("total_posts").alias("posts"))
    )


def with_contributors(
    events: DataFrame,
    weekly: DataFrame,
    min_posts: int = domain.MIN_POSTS_RELIABLE,
    top: int = 5,
    region: str = "province",
) -> DataFrame:
    """Events with ``top_provinces``, and the reason where the list is empty."""
    keys = ["date_week", "emotion"]
    ranked = contributions(events, weekly, min_posts, top, region)
    lists = ranked.groupBy(keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "province", "value", "posts"))),
            lambda r: F.struct(r.province.alias("province"), r.value.alias("value"), r.posts.alias("posts")),
        ).alias("top_provinces")
    )
    known_weeks = weekly.select("date_week").distinct().withColumn("_known", F.lit(True))
    reason = F.when(F.col("_known").isNull(), "no_weekly_panel_data").otherwise(
        f"no_province_with_posts_gte_{min_posts}"
    )
    empty = F.array().cast("array<struct<province:string,value:double,posts:bigint>>")
    return (
        events.join(lists, keys, "left")
        .join(known_weeks, "date_week", "left")
        .withColumn("top_provinces_reason", F.when(F.col("top_provinces").isNull(), reason))
        .withColumn("top_provinces", F.coalesce("top_provinces", empty))
        .drop("_known")
    )


def period_delta(national: DataFrame) -> DataFrame:
    """Latest against previous week: positive index and intensity change, with trend text."""
    latest = national.orderBy(F.col("date_week").desc()).limit(2)
    # Two rows at most reach this window.
    w = W.orderBy("date_week")
    with_previous = latest.select(
        "date_week",
        F.lag("date_week").over(w).alias("previous_week"),
        (F.col("positive_index") - F.lag("positive_index").over(w)).alias("positive_delta"),
        (F.col("emotional_intensity") - F.lag("emotional_intensity").over(w)).alias("intensity_delta"),
    )
    return (
        with_previous.orderBy(F.col("date_week").desc()).limit(1)
        .withColumn("trend", metrics.trend_text("intensity_delta"))
        .withColumn("positive_delta", F.coalesce("positive_delta", F.lit(0.0)))
    )
