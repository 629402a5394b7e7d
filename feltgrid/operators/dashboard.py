"""Look-ups over the panels: headline figures, rankings, filters and map data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feltgrid import domain
from feltgrid.functions import dates, metrics, text
from feltgrid.functions.metrics import MEANS
from feltgrid.operators import anomaly
from feltgrid.operators.rows import beside
from feltgrid.operators.stage import stage

MEANS_ALL = [f"{e}_mean_all" for e in domain.EMOTIONS]


def _positive_score():
    return metrics.positive_score(
        "joy_mean_all", "sadness_mean_all", "anger_mean_all", "fear_mean_all", "surprise_mean_all"
    )


def dashboard_metrics(national: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of headline figures."""
    def peak(measure, key, sign):
        # The earliest key wins among equal values.
        return F.min_by(key, F.struct(sign * F.round(measure, 12), F.col(key)))

    weeks = national.agg(
        F.coalesce(F.sum("total_posts"), F.lit(0)).alias("total_posts"),
        F.min("date_week").alias("first_week"),
        F.max("date_week").alias("last_week"),
        F.coalesce(F.avg("emotional_intensity"), F.lit(0.0)).alias("avg_intensity"),
        peak(F.col("fear_mean"), "date_week", -1).alias("fear_peak_week"),
    )
    provinces = vectors.agg(
        F.count(F.lit(1)).alias("province_count"),
        peak(_positive_score(), "province", -1).alias("most_positive"),
        peak(_positive_score(), "province", 1).alias("most_negative"),
    )
    delta = anomaly.period_delta(national).agg(
        F.coalesce(F.max("positive_delta"), F.lit(0.0)).alias("positive_delta")
    )
    week_range = F.concat(
        dates.week_short_range("first_week"), F.lit(" - "), dates.week_short_range("last_week")
    )
    return beside(weeks, provinces, delta).withColumn("week_range", week_range)


def top_anomalies(events: DataFrame, count: int = 5) -> DataFrame:
    return events.orderBy(
        metrics.severity_rank("severity").desc(), F.abs("z_score").desc(), "date_week", "emotion"
    ).limit(count)


def latest_composition(national: DataFrame) -> DataFrame:
    """Six values of the latest week with their rank, beside its positive, negative and neutral parts."""
    latest = national.orderBy(F.col("date_week").desc()).limit(1)
    parts = latest.select(
        "date_week",
        (F.col("joy_mean") + F.col("surprise_mean") * 0.5).alias("positive"),
        metrics.negative_pressure("fear_mean", "anger_mean", "sadness_mean").alias("negative"),
        F.col("neutral_mean").alias("neutral_part"),
        F.inline(F.array(*[
            F.struct(F.lit(e).alias("emotion"), F.lit(i).alias("_order"), F.col(f"{e}_mean").alias("value"))
            for i, e in enumerate(domain.EMOTIONS)
        ])),
    )
    # Six rows reach this window.
    rank = F.row_number().over(W.partitionBy("date_week").orderBy(F.round("value", 12).desc(), "_order"))
    return parts.withColumn("rank", rank).withColumn("top3", F.col("rank") <= 3).drop("_order")


def filter_events(events: DataFrame, emotion: str = "all", severity: str = "all") -> DataFrame:
    """Events of one emotion and severity, by week, the more severe first."""
    if emotion != "all":
        events = events.filter(F.col("emotion") == emotion)
    if severity != "all":
        events = events.filter(F.col("severity") == severity)
    return events.orderBy("date_week", metrics.severity_rank("severity").desc(), "emotion")


def top_posts(
    posts: DataFrame, top: int = 5, region: str = "province", key: str = "post_id", content: str = "content_clean"
) -> DataFrame:
    """The ``top`` posts of each region and emotion by that emotion's score.

    Ids and scores alone are ranked, and the small literal bound prunes them before the shuffle.
    Content is looked up afterwards for the chosen posts, which are few, so the texts themselves
    are not shuffled.
    """
    # A search for one solid character ends early, whatever the length of the text.
    usable = posts.filter(text.has_text(region) & text.has_text(content))
    long = usable.select(key, region, *domain.EMOTIONS).unpivot(
        [key, region], domain.EMOTIONS, "emotion", "score"
    )
    rank = F.row_number().over(W.partitionBy(region, "emotion").orderBy(F.col("score").desc(), key))
    chosen = stage(long.withColumn("rank", rank).filter(F.col("rank") <= top))
    scores = F.create_map(*[x for e in domain.EMOTIONS for x in (F.lit(e), F.col(e))])
    details = [c for c in ("date_week", "date_month") if c in posts.columns]
    looked_up = usable.select(key, *details, F.col(content).alias("content"), scores.alias("scores"))
    return looked_up.join(chosen, key)


def province_series(weekly: DataFrame, province: str, region: str = "province") -> DataFrame:
    return weekly.filter(F.col(region) == province).orderBy("date_week")


def province_list(vectors: DataFrame) -> DataFrame:
    return vectors.orderBy(F.col("total_posts_all").desc(), "province").select("province", "total_posts_all")


def province_top_emotions(vectors: DataFrame, top: int = 3) -> DataFrame:
    """Strongest emotions of each province with the low-sample flag."""
    long = vectors.select(
        "province", "total_posts_all", *[F.col(m).alias(e) for e, m in zip(domain.EMOTIONS, MEANS_ALL)]
    ).unpivot(["province", "total_posts_all"], domain.EMOTIONS, "emotion", "value")
    order = F.array_position(F.array(*map(F.lit, domain.EMOTIONS)), F.col("emotion"))
    rank = F.row_number().over(W.partitionBy("province").orderBy(F.round("value", 12).desc(), order))
    return long.withColumn("rank", rank).filter(F.col("rank") <= top).withColumn(
        "low_sample", F.col("total_posts_all") < domain.LOW_SAMPLE_POSTS
    )


def map_dataset(monthly: DataFrame, vectors: DataFrame, month: str | None = None) -> DataFrame:
    """Reliable rows of the chosen (default latest) month, or whole-period rows if there are none."""
    chosen = F.lit(month) if month else monthly.agg(F.max("date_month")).scalar()
    month_rows = monthly.filter((F.col("date_month") == chosen) & F.col("reliable")).select(
        "province", F.lit("month").alias("source"), "total_posts", *MEANS, "emotional_intensity"
    )
    whole = vectors.select(
        "province", F.lit("whole").alias("source"), F.col("total_posts_all").alias("total_posts"),
        *[F.col(a).alias(m) for a, m in zip(MEANS_ALL, MEANS)],
        F.col("emotional_intensity_mean").alias("emotional_intensity"),
    )
    n_month = month_rows.agg(F.count(F.lit(1))).scalar()
    both = month_rows.unionByName(whole.filter(n_month == 0))
    return both.withColumn("dominant", metrics.dominant_for_display(MEANS)).withColumn(
        "bucket", metrics.map_bucket("emotional_intensity")
    )


def map_normalised(vectors: DataFrame) -> DataFrame:
    """Positive share of each province on a scale of 0 to 100 (50 when all are equal)."""
    values = vectors.select(
        "province",
        metrics.positive_share("joy_mean_all", "surprise_mean_all", "neutral_mean_all").alias("value"),
    )
    bounds = values.agg(F.min("value").alias("_min"), F.max("value").alias("_max"))
    width = F.col("_max") - F.col("_min")
    return beside(values, bounds).select(
        "province", "value",
        F.when(width == 0, 50.0).otherwise((F.col("value") - F.col("_min")) / F.nullif(width, F.lit(0.0)) * 100)
        .alias("normalized"),
    )


def peak_weeks(national: DataFrame) -> DataFrame:
    """Weeks with the highest mean fear and joy."""
    def peak(emotion: str):
        return F.min_by("date_week", F.struct(-F.round(f"{emotion}_mean", 12), F.col("date_week")))

    row = national.agg(peak("fear").alias("fear"), peak("joy").alias("joy"))
    return row.unpivot([], ["fear", "joy"], "emotion", "date_week")


def largest_provinces(posts: DataFrame, top: int = 6, region: str = "province") -> DataFrame:
    counts = posts.groupBy(region).agg(F.count(F.lit(1)).alias("posts"))
    return counts.orderBy(F.col("posts").desc(), region).limit(top)


def attach_clusters(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """Vectors with their cluster, matched on the normalised province name; null without one."""
    keyed = labels.select(text.normalise_province("province").alias("province"), "cluster_label")
    return vectors.withColumn("province", text.normalise_province("province")).join(keyed, "province", "left")


def story(national: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: latest week, display emotion, trend and the province with the highest intensity."""
    latest = national.orderBy(F.col("date_week").desc()).limit(1).select(
        dates.week_short_range("date_week").alias("week_range"),
        metrics.dominant_for_display(MEANS).alias("dominant"),
        F.round(F.col("emotional_intensity") * 100, 1).alias("intensity_pct"),
    )
    top = vectors.agg(
        F.min_by("province", F.struct(-F.round("emotional_intensity_mean", 12), F.col("province"))).alias("province")
    )
    trend = anomaly.period_delta(national).select("trend")
    return beside(latest, top, trend)


def weekly_pressure(national: DataFrame) -> DataFrame:
    """Intensity, positive index and negative pressure series with axis labels."""
    return national.select(
        "date_week",
        dates.week_axis_range("date_week").alias("date_label"),
        F.col("emotional_intensity").alias("intensity"),
        F.col("positive_index").alias("positive"),
        metrics.negative_pressure("fear_mean", "anger_mean", "sadness_mean").alias("negative"),
    )
