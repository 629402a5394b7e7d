"""From raw posts to the published tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feltgrid import domain
from feltgrid.functions import dates, text
from feltgrid.operators import anomaly, cluster, enrich, keywords, merge, moments, panels, sampling, validate
from feltgrid.operators.stage import stage
from feltgrid.sources.tables import require_columns, write_panel


def judge_posts(sampled: DataFrame, users: DataFrame, keep_unknown: bool = False,
                char_class: str = text.ZH_CHARS) -> DataFrame:
    """Sampled raw posts in the mini layout, with a ``reject_reason`` (null for kept posts)."""
    stamp = F.col("_stamp")
    prepared = sampled.select(
        text.strip(F.col("_id")).alias("post_id"),
        F.coalesce(text.strip(F.col("user_id")), F.lit("")).alias("_user"),
        text.blank_to_null("user_id").alias("user_id"),
        text.strip(F.col("created_at")).alias("created_at"),
        dates.parse_created_at("created_at").alias("_stamp"),
        text.strip(F.coalesce("content", F.lit(""))).alias("_content"),
    ).withColumn("content_clean", text.clean_text("_content"))
    joined = enrich.attach_province(prepared, users)
    return joined.select(
        "post_id",
        F.col("_user").alias("user_id"),
        "created_at",
        dates.iso_week(stamp).alias("date_week"),
        dates.month_key(stamp).alias("date_month"),
        "province", "city", "gender", "content_clean",
        text.truncate_raw("_content").alias("content_raw"),
        text.count_chars("content_clean", char_class).alias("word_count"),
        text.reject_reason(stamp, "content_clean", "province", char_class, keep_unknown=keep_unknown)
        .alias("reject_reason"),
    )


def mini_dataset(
    posts: DataFrame,
    users: DataFrame,
    targets: Mapping[str, int] = domain.MONTH_TARGETS,
    keep_unknown: bool = False,
    char_class: str = text.ZH_CHARS,
) -> tuple[DataFrame, DataFrame]:
    """``(kept posts, rows per reject reason)``. Sampling comes before the filters.

    The sample is bounded by its targets and several steps read it, so it is materialised.
    """
    sampled = stage(sampling.exact_sample(posts, targets, key="_id"))
    judged = judge_posts(sampled, users, keep_unknown, char_class)
    kept = judged.filter("reject_reason is null").drop("reject_reason")
    log = judged.filter("reject_reason is not null").groupBy("reject_reason").agg(
        F.count(F.lit(1)).alias("count")
    )
    return kept, log


def gated_mini_dataset(
    posts: DataFrame, users: DataFrame, feasibility: DataFrame, targets: Mapping[str, int] = domain.MONTH_TARGETS,
    char_class: str = text.ZH_CHARS,
) -> tuple[DataFrame, DataFrame]:
    """``mini_dataset`` whose rule for unknown provinces follows the one-row feasibility table.

    Where only a national timeline is feasible, posts without a province are kept.
    """
    national = feasibility.first().recommended_geo_granularity == "national_timeline_only"
    return mini_dataset(posts, users, targets, keep_unknown=national, char_class=char_class)


def build_validation(benchmark: DataFrame, score: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """Scores of a human-labelled benchmark compared with its labels, from mapped labels to summaries."""
    mapped = validate.map_labels(benchmark).withColumn("content_clean", text.clean_text("content"))
    scored = stage(score(mapped).filter("label_status = 'ok'").select(
        F.col("label_cn").alias("label_true"), validate.predicted_label().alias("predicted")
    ))
    names = list(domain.BENCHMARK_LABELS.values())
    report = validate.class_report(scored, names)
    return {"confusion": validate.confusion_counts(scored, names), "class_report": report, "summary": validate.f1_summary(scored, names)}


def build_expansion(old: DataFrame, new: DataFrame, directory: str) -> dict[str, DataFrame]:
    """A labelled set extended by new labels: merged table, quality report and release recommendation."""
    path = f"{directory}/merged"
    write_panel(merge.merge_best_status(old, new), path)
    merged = old.sparkSession.read.parquet(path)
    report = stage(merge.quality_report(merged, old, new))
    return {"merged": merged, "quality_report": report, "recommendation": merge.release_recommendation(report)}


def build_panels(labelled: DataFrame, directory: str, provinces: Sequence[str] | None = domain.PROVINCES,
                 min_posts: int = domain.MIN_POSTS_RELIABLE) -> dict[str, DataFrame]:
    """Write the four panels and return them as read back, so later steps start from small tables."""
    require_columns(labelled, domain.LABELLED_REQUIRED, "labelled posts")
    tables = {
        "emotion_panel_weekly": panels.weekly_panel(labelled, provinces, min_posts),
        "emotion_panel_monthly": panels.monthly_panel(labelled, provinces, min_posts),
        "emotion_national_timeline": panels.national_timeline(labelled),
        "province_emotion_vectors": panels.province_vectors(labelled, provinces),
    }
    spark = labelled.sparkSession
    for name, df in tables.items():
        write_panel(df, f"{directory}/{name}")
    return {name: spark.read.parquet(f"{directory}/{name}") for name in tables}


def expand_panels(
    state: DataFrame | None, new: DataFrame, directory: str, replaced: DataFrame | None = None,
    provinces: Sequence[str] | None = domain.PROVINCES, min_posts: int = domain.MIN_POSTS_RELIABLE,
) -> dict[str, DataFrame]:
    """The four panels after an expansion, from the stored state of the earlier posts, the new posts and the earlier rows of posts that are replaced.

    Earlier posts are not read. The new state is written to ``directory/moments``, which must not be where ``state`` lies.
    """
    require_columns(new, domain.LABELLED_REQUIRED, "labelled posts")
    states = [moments.post_moments(new)] + ([state] if state is not None else [])
    if replaced is not None:
        states.append(moments.negative(moments.post_moments(replaced)))
    write_panel(moments.merge_moments(*states), f"{directory}/moments")
    spark = new.sparkSession
    merged = spark.read.parquet(f"{directory}/moments")
    tables = {
        "emotion_panel_weekly": moments.weekly_panel(merged, provinces, min_posts),
        "emotion_panel_monthly": moments.monthly_panel(merged, provinces, min_posts),
        "emotion_national_timeline": moments.national_timeline(merged),
        "province_emotion_vectors": moments.province_vectors(merged, provinces),
    }
    for name, df in tables.items():
        write_panel(df, f"{directory}/{name}")
    return {"moments": merged, **{name: spark.read.parquet(f"{directory}/{name}") for name in tables}}


def build_anomalies(tables: Mapping[str, DataFrame], min_posts: int = domain.MIN_POSTS_RELIABLE) -> DataFrame:
    series = anomaly.zscore_series(tables["emotion_national_timeline"])
    events = anomaly.anomaly_events(series)
    return anomaly.with_contributors(events, tables["emotion_panel_weekly"], min_posts)


def build_keywords(labelled: DataFrame, directory: str, dictionary: DataFrame | None = None,
                   min_posts: int = domain.MIN_POSTS_PER_KEYWORD_WEEK) -> dict[str, DataFrame]:
    """Write the term counts once, then derive every keyword table from them."""
    spark = labelled.sparkSession
    path = f"{directory}/week_term_counts"
    write_panel(keywords.week_term_counts(keywords.tokenise(labelled, dictionary=dictionary)), path)
    counts = spark.read.parquet(path)
    weights = stage(keywords.tfidf(counts))
    status = keywords.week_status(labelled, min_posts)
    week = stage(keywords.week_keywords(weights, status))
    emotions = keywords.week_emotions(labelled)
    return {
        "week_keywords": week,
        "keyword_lists": keywords.keyword_lists(week),
        "nlp_emotion_keywords": keywords.emotion_keywords(week, emotions),
        "nlp_global_vocabulary": keywords.global_vocabulary(weights),
        "week_status": status,
    }


def build_clusters(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Whole-period and monthly cluster tables."""
    labels, scores, best = cluster.cluster_provinces(tables["province_emotion_vectors"])
    aligned = cluster.align_by_risk(cluster.monthly_ward(tables["emotion_panel_monthly"]))
    return {
        "cluster_labels": best,
        "silhouette_scores": scores,
        "cluster_stability": cluster.label_stability(labels, "province", range(2, 7)),
        "monthly_cluster_labels": cluster.evolution_matrix(aligned),
    }
