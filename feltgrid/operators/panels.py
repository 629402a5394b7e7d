"""Panels: posts rolled up by week, month and province, plus profiles of posts and panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feltgrid import domain
from feltgrid.functions import metrics
from feltgrid.functions.metrics import MEANS
from feltgrid.operators.rows import beside


def _valid(posts: DataFrame, provinces: Sequence[str] | None, region: str) -> DataFrame:
    return posts if provinces is None else posts.filter(F.col(region).isin(list(provinces)))


def _means() -> list:
    return [F.avg(e).alias(f"{e}_mean") for e in domain.EMOTIONS]


def _stds(emotions: Sequence[str] = domain.EMOTIONS) -> list:
    return [F.stddev_samp(e).alias(f"{e}_std") for e in emotions]


def _dominant(panel: DataFrame) -> DataFrame:
    key = metrics.dominant(MEANS)
    return panel.withColumn("dominant_emotion_key", key).withColumn(
        "dominant_emotion", metrics.emotion_label("dominant_emotion_key")
    )


def _ratios(panel: DataFrame) -> DataFrame:
    return panel.withColumns({
        "positive_index": metrics.positive_index("joy_mean", "sadness_mean", "anger_mean", "fear_mean"),
        "fear_joy_ratio": metrics.fear_joy_ratio("fear_mean", "joy_mean"),
    })


def weekly_panel(
    posts: DataFrame,
    provinces: Sequence[str] | None = domain.PROVINCES,
    min_posts: int = domain.MIN_POSTS_RELIABLE,
    region: str = "province",
) -> DataFrame:
    """Week × province: counts, means, sample deviations and derived measures."""
    panel = _valid(posts, provinces, region).groupBy("date_week", region).agg(
        F.count("post_id").alias("total_posts"),
        F.avg("word_count").alias("avg_word_count"),
        *_means(),
        *_stds(),
    )
    return weekly_measures(panel, min_posts)


def weekly_measures(panel: DataFrame, min_posts: int = domain.MIN_POSTS_RELIABLE) -> DataFrame:
    """A week's counts, means and deviations with the measures derived from them."""
    return _ratios(_dominant(panel)).withColumns({
        "dominant_score": F.greatest(*MEANS),
        "emotional_intensity": metrics.intensity("neutral_mean"),
        "reliable": F.col("total_posts") >= min_posts,
    })


def monthly_panel(
    posts: DataFrame,
    provinces: Sequence[str] | None = domain.PROVINCES,
    min_posts: int = domain.MIN_POSTS_RELIABLE,
    region: str = "province",
) -> DataFrame:
    """Month × province."""
    panel = _valid(posts, provinces, region).groupBy("date_month", region).agg(
        F.count("post_id").alias("total_posts"), *_means(), *_stds(["joy", "fear"])
    )
    return monthly_measures(panel, min_posts)


def monthly_measures(panel: DataFrame, min_posts: int = domain.MIN_POSTS_RELIABLE) -> DataFrame:
    return _dominant(panel).withColumns({
        "dominant_score": F.greatest(*MEANS),
        "emotional_intensity": metrics.intensity("neutral_mean"),
        "reliable": F.col("total_posts") >= min_posts,
    })


def national_timeline(posts: DataFrame) -> DataFrame:
    """Week, over all posts whatever their province."""
    return national_measures(posts.groupBy("date_week").agg(F.count("post_id").alias("total_posts"), *_means(), *_stds()))


def national_measures(panel: DataFrame) -> DataFrame:
    return _ratios(_dominant(panel)).withColumn("emotional_intensity", metrics.intensity("neutral_mean"))


def province_vectors(
    posts: DataFrame, provinces: Sequence[str] | None = domain.PROVINCES, region: str = "province"
) -> DataFrame:
    """Whole-period feature vector of each province."""
    return _valid(posts, provinces, region).groupBy(region).agg(
        F.count("post_id").alias("total_posts_all"),
        *[F.avg(e).alias(f"{e}_mean_all") for e in domain.EMOTIONS],
        (1 - F.avg("neutral")).alias("emotional_intensity_mean"),
        F.var_samp("fear").alias("fear_variance"),
        F.var_samp("joy").alias("joy_variance"),
    )


def panel_summary(weekly: DataFrame, monthly: DataFrame, national: DataFrame, posts: DataFrame) -> DataFrame:
    """One row of panel sizes, reliable shares and the most frequent national emotion."""
    n = F.count(F.lit(1))

    def reliable(name: str) -> list:
        flag = F.col("reliable").cast("double")
        return [
            n.alias(f"{name}_rows"),
            F.round(F.avg(flag) * 100, 1).alias(f"{name}_reliable_pct"),
            F.count(F.when(F.col("reliable"), 1)).alias(f"{name}_reliable_count"),
        ]

    row = national.agg(
        n.alias("national_weeks"),
        F.coalesce(F.mode("dominant_emotion_key", True), F.lit("N/A")).alias("national_dominant_emotion"),
    )
    return beside(
        row,
        weekly.agg(*reliable("weekly")),
        monthly.agg(*reliable("monthly")),
        posts.agg(F.countDistinct("province").alias("provinces")),
    )


def stratum_distribution(posts: DataFrame, keys: Sequence[str] = ("date_month", "province")) -> DataFrame:
    return posts.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def dataset_profile(posts: DataFrame) -> DataFrame:
    """Rows, distinct months, weeks and provinces, week range, mean and median word count."""
    # Counted per (month, week, province, word count) first: one combined shuffle instead of one
    # expansion per distinct count.
    cells = posts.groupBy("date_month", "date_week", "province", "word_count").agg(
        F.count(F.lit(1)).alias("n")
    )
    return cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_posts"),
        F.size(F.collect_set("date_month")).cast("bigint").alias("months"),
        F.size(F.collect_set("date_week")).cast("bigint").alias("weeks"),
        F.size(F.collect_set("province")).cast("bigint").alias("provinces"),
        F.min("date_week").alias("first_week"),
        F.max("date_week").alias("last_week"),
        F.try_divide(
            F.sum(F.col("word_count") * F.col("n")),
            F.sum(F.when(F.col("word_count").isNotNull(), F.col("n"))),
        ).alias("avg_word_count"),
        F.percentile("word_count", 0.5, F.col("n")).alias("median_word_count"),
    )


def emotion_distribution(posts: DataFrame) -> DataFrame:
    """Mean and sample deviation of each emotion over all posts."""
    return emotion_rows(posts.agg(*_means(), *_stds()))


def emotion_rows(wide: DataFrame) -> DataFrame:
    """One row per emotion from one row of means and deviations."""
    pairs = [
        F.struct(F.lit(e).alias("emotion"), F.col(f"{e}_mean").alias("mean"), F.col(f"{e}_std").alias("std"))
        for e in domain.EMOTIONS
    ]
    return wide.select(F.inline(F.array(*pairs)))


def dominant_distribution(posts: DataFrame) -> DataFrame:
    key = metrics.dominant(domain.EMOTIONS)
    return posts.groupBy(key.alias("dominant_emotion")).agg(F.count(F.lit(1)).alias("count"))
