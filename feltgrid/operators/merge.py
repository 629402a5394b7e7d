"""Merging labelled sets, and the checks that decide whether a merged set is released."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feltgrid import domain
from feltgrid.functions import metrics
from feltgrid.operators.rows import beside
from feltgrid.operators.stage import stage


def _merge(old: DataFrame, new: DataFrame, order: Sequence[Column], key: str) -> DataFrame:
    union = old.withColumn("_source", F.lit(0)).unionByName(
        new.withColumn("_source", F.lit(1)), allowMissingColumns=True
    )
    # row_number = 1 is pruned per task before the shuffle, so copies of an id do not pile up.
    first = W.partitionBy(key).orderBy(*order)
    return (
        union.withColumn("_row", F.row_number().over(first)).filter("_row = 1").drop("_row", "_source")
    )


def merge_best_status(old: DataFrame, new: DataFrame, key: str = "post_id") -> DataFrame:
    """One row per id: status ``ok`` before any other, then the old set before the new one."""
    columns = set(old.columns) | set(new.columns)
    order = [F.col("_source")]
    if "label_status" in columns:
        order.insert(0, F.coalesce(F.col("label_status") == "ok", F.lit(False)).desc())
    return _merge(old, new, order, key)


def merge_last(old: DataFrame, new: DataFrame, key: str = "post_id") -> DataFrame:
    """One row per id: the new set before the old one."""
    return _merge(old, new, [F.col("_source").desc()], key)


def id_overlap(old: DataFrame, new: DataFrame, key: str = "post_id") -> DataFrame:
    return old.select(key).intersect(new.select(key))


def duplicate_report(df: DataFrame, key: str = "post_id") -> DataFrame:
    """Rows, distinct ids and rows that repeat an id."""
    per_id = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return per_id.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("distinct_ids"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def drop_duplicates(df: DataFrame, order: Column | str, key: str = "post_id") -> DataFrame:
    """First row of each id by ``order``."""
    first = W.partitionBy(key).orderBy(order)
    return df.withColumn("_row", F.row_number().over(first)).filter("_row = 1").drop("_row")


def plan_check(plan: DataFrame, labelled: DataFrame, order: Column | str = "post_id", key: str = "post_id") -> DataFrame:
    """Plan without repeated and without already labelled ids."""
    return drop_duplicates(plan, order, key).join(labelled.select(key), key, "left_anti")


def merge_summary(old: DataFrame, new: DataFrame, merged: DataFrame, key: str = "post_id") -> DataFrame:
    """One row: sizes, shared ids, share of ok rows and share of valid score sums."""
    ok = F.lit(1.0)
    if "label_status" in merged.columns:
        ok = F.coalesce(
            F.round(F.avg(F.coalesce(F.col("label_status") == "ok", F.lit(False)).cast("double")), 4), F.lit(0.0)
        )
    row = merged.agg(
        F.count(F.lit(1)).alias("merged_rows"),
        ok.alias("ok_rate"),
        metrics.sum_valid_rate().alias("emotion_sum_valid_rate"),
    )
    n = F.count(F.lit(1))
    return beside(
        row,
        old.agg(n.alias("old_rows")),
        new.agg(n.alias("new_rows")),
        id_overlap(old, new, key).agg(n.alias("duplicate_post_ids")),
    )


def emotion_drift(merged: DataFrame, old: DataFrame) -> DataFrame:
    """Per emotion: mean of the merged and the old set and their difference, rounded to 4."""

    def means(df: DataFrame, name: str) -> DataFrame:
        wide = df.agg(*[F.avg(e).alias(e) for e in domain.EMOTIONS])
        return wide.unpivot([], domain.EMOTIONS, "emotion", name)

    return means(merged, "merged").join(means(old, "old"), "emotion").select(
        "emotion",
        F.round("merged", 4).alias("merged_mean"),
        F.round("old", 4).alias("old_mean"),
        F.round(F.col("merged") - F.col("old"), 4).alias("drift"),
    )


def group_size_stats(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """Number, smallest, largest and median size of the groups, in one row."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(
        F.count(F.lit(1)).alias(f"{prefix}_count"),
        F.coalesce(F.min("_n"), F.lit(0)).alias(f"{prefix}_min"),
        F.coalesce(F.max("_n"), F.lit(0)).alias(f"{prefix}_max"),
        F.coalesce(F.round(F.median("_n"), 1), F.lit(0.0)).alias(f"{prefix}_median"),
    )


def quality_report(
    merged: DataFrame,
    old: DataFrame,
    new: DataFrame,
    plan_rows: int = 0,
    provinces: Sequence[str] = domain.PROVINCES,
    key: str = "post_id",
) -> DataFrame:
    """One row of counts, score validity, distributions and drift of a merged set.

    The merge runs once: ids, weeks, provinces and scores are materialised, and so is a week-province cell
    table of counts and sums, from which every distribution, rate and mean is taken. Scores out of range are
    counted, not removed.
    """
    merged = stage(merged.select(key, "date_week", "province", *domain.EMOTIONS))
    n = F.count(F.lit(1))

    def sums() -> list[Column]:
        return [F.sum(e).alias(f"{e}_sum") for e in domain.EMOTIONS] + [
            F.count(e).alias(f"{e}_n") for e in domain.EMOTIONS
        ]

    def mean(e: str) -> Column:
        return F.try_divide(F.sum(f"{e}_sum"), F.sum(f"{e}_n"))

    def zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0))

    def median(c: str) -> Column:
        return F.coalesce(F.round(F.median(c), 1), F.lit(0.0))

    cells = stage(merged.groupBy("date_week", "province").agg(
        n.alias("_n"),
        F.count(F.when(metrics.sum_is_valid(), 1)).alias("_valid"),
        F.count(F.when(metrics.out_of_range(), 1)).alias("_out"),
        *sums(),
    ))
    grid = cells.filter(F.col("province").isin(list(provinces)))
    by_province = grid.groupBy("province").agg(F.sum("_n").alias("_n"))
    by_week = cells.filter("date_week is not null").groupBy("date_week").agg(F.sum("_n").alias("_n"))
    main = cells.agg(
        zero(F.sum("_n")).alias("merged_total_rows"),
        F.round(F.try_divide(F.sum("_valid"), F.sum("_n")), 4).alias("emotion_sum_valid_rate"),
        zero(F.sum("_out")).alias("out_of_range_rows"),
        *[mean(e).alias(f"{e}_mean") for e in domain.EMOTIONS],
    ).withColumn("plan_rows", F.lit(plan_rows).cast("bigint"))
    old_row = old.agg(n.alias("old_merged_rows"), *sums()).select(
        "old_merged_rows",
        *[F.try_divide(f"{e}_sum", f"{e}_n").alias(f"_{e}_old") for e in domain.EMOTIONS],
    )
    province_row = by_province.agg(
        zero(F.min("_n")).alias("province_sample_min"), zero(F.max("_n")).alias("province_sample_max"),
        median("_n").alias("province_sample_median"), n.alias("province_count"),
    )
    week_row = by_week.agg(
        n.alias("week_count"), zero(F.min("_n")).alias("week_sample_min"),
        zero(F.max("_n")).alias("week_sample_max"),
    )
    grid_row = grid.agg(
        n.alias("grid_non_empty_cells"),
        (F.countDistinct("date_week") * F.countDistinct("province")).alias("grid_total_cells_theoretical"),
        F.count(F.when(F.col("_n") >= 15, 1)).alias("grid_cells_gte_15"),
        F.count(F.when(F.col("_n") >= 30, 1)).alias("grid_cells_gte_30"),
        zero(F.min("_n")).alias("grid_cell_min"), zero(F.max("_n")).alias("grid_cell_max"),
        median("_n").alias("grid_cell_median"),
    )
    report = beside(
        main,
        old_row,
        new.agg(n.alias("new_labeled_rows")),
        id_overlap(old, new, key).agg(n.alias("duplicate_post_ids_removed")),
        duplicate_report(merged, key).select(F.col("duplicate_rows").alias("duplicate_post_ids_remaining")),
        province_row,
        week_row,
        grid_row,
    )
    drifts = [F.abs(F.round(F.col(f"{e}_mean") - F.col(f"_{e}_old"), 4)) for e in domain.EMOTIONS]
    return (
        report.withColumn("max_emotion_drift", F.coalesce(F.round(F.greatest(*drifts), 4), F.lit(0.0)))
        .withColumns({f"{e}_mean": F.round(f"{e}_mean", 4) for e in domain.EMOTIONS})
        .drop(*[f"_{e}_old" for e in domain.EMOTIONS])
    )


def release_recommendation(
    report: DataFrame, min_valid_rate: float = 0.95, max_drift: float = 0.05
) -> DataFrame:
    """Issues of a quality report, as ``code=value``, and whether the merged set may replace the published one."""
    limits = {
        "duplicate_post_ids": (F.col("duplicate_post_ids_remaining") > 0, F.col("duplicate_post_ids_remaining")),
        "out_of_range_rows": (F.col("out_of_range_rows") > 0, F.col("out_of_range_rows")),
        "sum_valid_rate": (F.col("emotion_sum_valid_rate") < min_valid_rate, F.col("emotion_sum_valid_rate")),
        "emotion_drift": (F.col("max_emotion_drift") > max_drift, F.format_string("%.4f", "max_emotion_drift")),
    }
    issues = F.array_compact(F.array(*[
        F.when(broken, F.concat(F.lit(f"{code}="), value)) for code, (broken, value) in limits.items()
    ]))
    return report.select(
        F.array_join(issues, "; ").alias("issues"), (F.size(issues) == 0).alias("recommend_replace")
    )
