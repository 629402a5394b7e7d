"""Joining posts to users, and quality, coverage and feasibility profiles of the raw data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feltgrid import domain
from feltgrid.functions import dates, text
from feltgrid.operators.rows import beside
from feltgrid.operators.skew import salted_left_join, smallest_per_group
from feltgrid.operators.stage import stage
POSITION_BITS = 22  # bytes of a bucket when the first rows of a month are looked for


def attach_province(
    posts: DataFrame, users: DataFrame, key: str = "user_id", row_id: str = "post_id", salted: bool = True
) -> DataFrame:
    """Posts with their author's province, city and gender.

    A post without a matching user gets the unknown province and empty city and gender. ``users``
    holds one row per user. ``salted`` spreads prolific authors and blank ids over many tasks.
    """
    attributes = [c for c in ("province", "city", "gender") if c in users.columns]
    right = users.select(key, *attributes)
    if salted:
        joined = salted_left_join(posts, right, key, row_id)
    else:
        joined = posts.join(right, key, "left")
    defaults = {"province": domain.UNKNOWN_PROVINCE, "city": "", "gender": ""}
    return joined.withColumns({c: F.coalesce(c, F.lit(defaults[c])) for c in attributes})


def unlabelled(mini: DataFrame, labelled: DataFrame, key: str = "post_id") -> DataFrame:
    return mini.join(labelled.select(key), key, "left_anti")


def already_labelled(mini: DataFrame, labelled: DataFrame, key: str = "post_id") -> DataFrame:
    return mini.join(labelled.select(key), key, "left_semi")


def full_grid(mini: DataFrame, provinces: Sequence[str] = domain.PROVINCES, period: str = "date_month") -> DataFrame:
    """Every period of ``mini`` with every listed province, without a join."""
    return mini.select(period).distinct().withColumn(
        "province", F.explode(F.array(*map(F.lit, sorted(provinces))))
    )


def grid_counts(
    mini: DataFrame,
    labelled: DataFrame,
    provinces: Sequence[str] = domain.PROVINCES,
    period: str = "date_month",
) -> DataFrame:
    """Labelled and still unlabelled posts of every grid cell, 0 where there are none.

    One pass over ``mini``: each post is marked by a left join, and both counts come from one
    aggregate that is combined before its shuffle.
    """
    marks = labelled.select("post_id").distinct().withColumn("_labelled", F.lit(1))
    valid = mini.filter(text.is_valid_province("province", provinces))
    cells = (
        valid.join(marks, "post_id", "left")
        .groupBy(period, "province")
        .agg(
            F.count("_labelled").alias("existing_labeled"),
            F.count(F.when(F.col("_labelled").isNull(), 1)).alias("available_candidates"),
        )
    )
    return full_grid(valid, provinces, period).join(cells, [period, "province"], "left").na.fill(
        0, ["existing_labeled", "available_candidates"]
    )


def cell_status(
    mini: DataFrame, labelled: DataFrame, cap: int, provinces: Sequence[str] = domain.PROVINCES
) -> DataFrame:
    """Week-province cells of ``mini``: labelled posts, candidates, gap to the cap, sample size.

    All labelled posts of a cell count, whether or not they are in ``mini``.
    """
    keys = ["date_week", "province"]
    mini = mini.filter(F.col("province").isin(list(provinces)))
    labelled = labelled.filter(F.col("province").isin(list(provinces)))
    marks = labelled.select("post_id").distinct().withColumn("_labelled", F.lit(1))
    cells = (
        mini.join(marks, "post_id", "left")
        .groupBy(keys)
        .agg(F.count(F.when(F.col("_labelled").isNull(), 1)).alias("candidates_available"))
    )
    current = labelled.groupBy(keys).agg(F.count(F.lit(1)).alias("current_labeled"))
    gap = F.greatest(F.lit(cap) - F.col("current_labeled"), F.lit(0))
    return (
        cells.join(current, keys, "left")
        .na.fill(0, ["current_labeled"])
        .withColumn("gap", gap)
        .withColumn("to_sample", F.least("gap", "candidates_available"))
        .withColumn("shortage", F.col("gap") - F.col("to_sample"))
        .select(*keys, "current_labeled", "candidates_available", "gap", "to_sample", "shortage")
    )


def _rate(flag: Column) -> Column:
    return F.avg(F.coalesce(flag, F.lit(False)).cast("double"))


def quality_profile(posts: DataFrame, month: str = "file_month", char_class: str = text.ZH_CHARS) -> DataFrame:
    """Per month: rows, parse and fill rates, mean and median character counts of filled texts."""
    filled = F.col("content").isNotNull() & ~F.col("content").isin("", "nan")
    chars = F.when(filled, text.count_chars("content", char_class))
    return posts.groupBy(month).agg(
        F.count(F.lit(1)).alias("sampled"),
        _rate(dates.parse_created_at("created_at").isNotNull()).alias("created_at_parse_rate"),
        _rate(filled).alias("content_non_null_rate"),
        _rate(text.blank_to_null("user_id").isNotNull()).alias("user_id_non_null_rate"),
        _rate(text.blank_to_null("geo_info").isNotNull()).alias("geo_info_non_null_rate"),
        F.coalesce(F.avg(chars), F.lit(0.0)).alias("chinese_char_mean"),
        F.coalesce(F.median(chars), F.lit(0.0)).alias("chinese_char_median"),
    )


def province_counts(posts: DataFrame, users: DataFrame, month: str = "file_month") -> DataFrame:
    """Posts per user province, file month and week, with a ``hit`` flag for matched users.

    Posts are counted per user, month and week before they meet the user table, so a prolific
    author is a few rows by then. Posts with a blank user id are left out; ``date_week`` is null
    where the date cannot be read.
    """
    per_user = (
        posts.withColumn("user_id", text.blank_to_null("user_id"))
        .filter("user_id is not null")
        .withColumn("date_week", dates.iso_week(dates.parse_created_at("created_at")))
        .groupBy("user_id", month, "date_week")
        .agg(F.count(F.lit(1)).alias("posts"))
    )
    known = users.select("user_id", F.col("province").alias("_province"))
    return (
        per_user.join(known, "user_id", "left")
        .withColumn("hit", F.col("_province").isNotNull())
        .withColumn("province", F.coalesce("_province", F.lit(domain.UNKNOWN_PROVINCE)))
        .groupBy("province", month, "date_week", "hit")
        .agg(F.sum("posts").alias("posts"))
    )


def join_coverage(counts: DataFrame, provinces: Sequence[str] = domain.PROVINCES) -> DataFrame:
    """One row: joined posts, hits, valid provinces and both rates."""
    total = F.sum("posts")
    hits = F.coalesce(F.sum(F.when(F.col("hit"), F.col("posts"))), F.lit(0))
    valid = F.coalesce(F.sum(F.when(F.col("province").isin(list(provinces)), F.col("posts"))), F.lit(0))
    return counts.agg(
        F.coalesce(total, F.lit(0)).alias("total_rows"),
        hits.alias("join_hits"),
        F.coalesce(F.try_divide(hits, total), F.lit(0.0)).alias("join_rate"),
        valid.alias("valid_province_count"),
        F.coalesce(F.try_divide(valid, total), F.lit(0.0)).alias("valid_province_rate"),
    )


def feasibility(
    counts: DataFrame,
    provinces: Sequence[str] = domain.PROVINCES,
    min_weekly: int = domain.MIN_POSTS_RELIABLE,
    min_provinces: int = 20,
    min_rate: float = 0.80,
) -> DataFrame:
    """One row: can province panels be built, at which granularity, and the warnings.

    ``counts`` comes from ``province_counts``; it is small, read three times and so materialised.
    """
    counts = stage(counts)
    cells = (
        counts.filter(F.col("province").isin(list(provinces)) & F.col("date_week").isNotNull())
        .groupBy("province", "date_week")
        .agg(F.sum("posts").alias("posts"))
    )
    per_province = cells.groupBy("province").agg(F.median("posts").alias("median_posts"))
    good = per_province.agg(
        F.count(F.when(F.col("median_posts") >= min_weekly, 1)).alias("good_provinces_count"),
        F.count(F.lit(1)).alias("total_provinces_count"),
    )
    overall = cells.agg(
        F.coalesce(F.avg("posts"), F.lit(0.0)).alias("avg_weekly"),
        F.coalesce(F.median("posts"), F.lit(0.0)).alias("median_weekly"),
    )
    rates = join_coverage(counts, provinces).select("join_rate", "valid_province_rate")
    row = beside(rates, overall, good)
    valid_ok = F.col("valid_province_rate") >= min_rate
    enough = F.col("good_provinces_count") >= min_provinces
    weekly_ok = F.col("median_weekly") >= min_weekly
    can_do = valid_ok & enough
    warnings = F.array_compact(F.array(
        F.when(F.col("join_rate") < 0.8, F.concat(F.lit("join_rate="), F.format_string("%.3f", "join_rate"))),
        F.when(~valid_ok, F.concat(F.lit("valid_province_rate="), F.format_string("%.3f", "valid_province_rate"))),
        F.when(~enough, F.concat(F.lit("good_provinces="), F.col("good_provinces_count"))),
        F.when(can_do & ~weekly_ok, F.lit("granularity=monthly")),
        F.when(~can_do, F.lit("granularity=national")),
    ))
    return row.select(
        can_do.alias("can_do_province"),
        F.when(can_do & weekly_ok, "weekly_province").when(can_do, "monthly_province")
        .otherwise("national_timeline_only").alias("recommended_geo_granularity"),
        "good_provinces_count",
        "total_provinces_count",
        F.round("avg_weekly", 1).alias("avg_weekly_per_province"),
        F.round("median_weekly", 1).alias("median_weekly_per_province"),
        warnings.alias("warnings"),
    )


def first_rows_per_month(posts: DataFrame, months: Sequence[str], n: int, month: str = "file_month") -> DataFrame:
    """The first ``n`` rows of each month in file order, for quick profiles."""
    position = F.col("position")
    return smallest_per_group(
        posts, month, {m: n for m in months}, position, F.shiftright(position, POSITION_BITS), "position"
    )
