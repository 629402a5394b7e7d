"""Reproducible exact-size samples, stratified labelling plans and cap sweeps.

Selections order rows by a *draw*: a hash of seed and id in ``[0, 2**31)``. The same ids and seed
always give the same sample, whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feltgrid import domain
from feltgrid.operators import enrich
from feltgrid.operators.skew import smallest_per_group
from feltgrid.operators.stage import stage

SEED = 42
DRAW_BITS = 31
BUCKET_BITS = 20


def draw(key: Column | str = "post_id", seed: int = SEED) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 64 - DRAW_BITS)


def exact_sample(
    posts: DataFrame,
    targets: Mapping[str, int] = domain.MONTH_TARGETS,
    month: str = "file_month",
    key: str = "post_id",
    order: Column | None = None,
) -> DataFrame:
    """Uniform sample of exactly ``targets[m]`` posts per month (all, where fewer exist)."""
    order = draw(key) if order is None else order
    return smallest_per_group(
        posts, month, targets, order, F.shiftright(order, DRAW_BITS - BUCKET_BITS), key
    )


def _pick(mini: DataFrame, labelled: DataFrame, cells: DataFrame, keys: Sequence[str], wanted: str, cap: int,
          order: Column, key: str = "post_id") -> DataFrame:
    """The ``wanted`` first unlabelled rows by draw of each cell.

    Only ids and cell keys are shuffled and ranked; the texts are looked up for the chosen ids.
    No cell wants more than ``cap`` rows, and that literal bound lets Spark prune every task to
    ``cap`` rows per cell before the shuffle (up to its own limit on such bounds). Ids are unique
    in ``mini``; see ``merge.drop_duplicates``.
    """
    candidates = enrich.unlabelled(mini.select(key, *keys), labelled, key)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("_draw", key))
    ranked = (
        candidates.withColumn("_draw", order).withColumn("_rank", rank).filter(F.col("_rank") <= cap)
    )
    wanting = cells.filter(F.col(wanted) > 0).select(*keys, F.col(wanted).alias("_wanted"))
    chosen = stage(ranked.join(wanting, list(keys)).filter("_rank <= _wanted").select(key))
    return mini.join(chosen, key, "left_semi")


def month_cap_cells(
    mini: DataFrame,
    labelled: DataFrame,
    cap: int = 30,
    provinces: Sequence[str] = domain.PROVINCES,
    reliable: int = domain.MIN_POSTS_RELIABLE,
) -> DataFrame:
    """Plan per month and province over the full grid."""
    gap = F.greatest(F.lit(cap) - F.col("existing_labeled"), F.lit(0))
    expected = F.col("existing_labeled") + F.col("planned_new")
    return (
        enrich.grid_counts(mini, labelled, provinces)
        .withColumn("cap", F.lit(cap).cast("bigint"))
        .withColumn("gap", gap)
        .withColumn("planned_new", F.least("gap", "available_candidates"))
        .withColumn("shortage", F.col("gap") - F.col("planned_new"))
        .withColumn("expected_total", expected)
        .withColumn("reliable_after", F.col("expected_total") >= reliable)
        .select("date_month", "province", "existing_labeled", "cap", "gap", "available_candidates",
                "planned_new", "shortage", "expected_total", "reliable_after")
    )


def month_cap_plan(
    mini: DataFrame,
    labelled: DataFrame,
    cap: int = 30,
    provinces: Sequence[str] = domain.PROVINCES,
    order: Column | None = None,
) -> DataFrame:
    """Unlabelled posts that fill each month-province cell up to the cap."""
    cells = month_cap_cells(mini, labelled, cap, provinces)
    valid = mini.filter(F.col("province").isin(list(provinces)))
    return _pick(valid, labelled, cells, ["date_month", "province"], "planned_new", cap,
                 draw() if order is None else order)


def week_cap_plan(
    mini: DataFrame,
    labelled: DataFrame,
    cap: int = 35,
    provinces: Sequence[str] = domain.PROVINCES,
    order: Column | None = None,
) -> DataFrame:
    """Unlabelled posts that fill each existing week-province cell up to the cap."""
    cells = enrich.cell_status(mini, labelled, cap, provinces)
    valid = F.col("province").isin(list(provinces))
    return _pick(mini.filter(valid), labelled.filter(valid), cells, ["date_week", "province"], "to_sample", cap,
                 draw() if order is None else order)


def plan_summary(cells: DataFrame, reliable: int = domain.MIN_POSTS_RELIABLE) -> DataFrame:
    """Coverage, reliable cells and shortages before and after a month-province plan."""

    def cells_with(flag: Column) -> Column:
        return F.count(F.when(flag, 1))

    total = F.count(F.lit(1))
    before, after = cells_with(F.col("existing_labeled") >= reliable), cells_with(F.col("reliable_after"))
    return cells.agg(
        F.coalesce(F.sum("existing_labeled"), F.lit(0)).alias("existing_labeled_rows"),
        F.coalesce(F.sum("available_candidates"), F.lit(0)).alias("candidate_unlabeled_rows"),
        F.coalesce(F.sum("planned_new"), F.lit(0)).alias("planned_new_rows"),
        F.coalesce(F.sum("expected_total"), F.lit(0)).alias("expected_total_after_labeling"),
        cells_with(F.col("existing_labeled") > 0).alias("before_month_province_coverage"),
        cells_with(F.col("expected_total") > 0).alias("after_month_province_coverage"),
        total.alias("total_month_province_cells"),
        before.alias("before_reliable_cells_count"),
        after.alias("after_reliable_cells_count"),
        F.coalesce(F.round(F.try_divide(before * 100.0, total), 1), F.lit(0.0)).alias("before_reliable_pct"),
        F.coalesce(F.round(F.try_divide(after * 100.0, total), 1), F.lit(0.0)).alias("after_reliable_pct"),
        cells_with(F.col("shortage") > 0).alias("shortage_cells_count"),
        F.coalesce(F.sum("shortage"), F.lit(0)).alias("shortage_total_missing"),
    )


def cap_sweep(
    mini: DataFrame,
    labelled: DataFrame,
    caps: Sequence[int] = domain.SWEEP_CAPS,
    provinces: Sequence[str] = domain.PROVINCES,
    target_range: tuple[int, int] = (30000, 40000),
) -> DataFrame:
    """Effect of each cap on the week-province grid, with the recommended cap marked.

    The posts are counted per cell once; the caps are tried on the cell table. Recommended is the
    cap with the most new posts whose total lies in the target range, otherwise the total closest
    to the middle of the range (the smaller cap on ties).
    """
    low, high = target_range
    cells = enrich.cell_status(mini, labelled, 0, provinces).select(
        "current_labeled", "candidates_available", F.explode(F.array(*map(F.lit, caps))).alias("cap")
    )
    gap = F.greatest(F.col("cap") - F.col("current_labeled"), F.lit(0))
    added = F.least(gap, F.col("candidates_available"))
    cells = cells.select("cap", added.alias("added"), (gap - added).alias("short"),
                         (F.col("current_labeled") + added).alias("size"))
    n_labelled = labelled.filter(F.col("province").isin(list(provinces))).agg(F.count(F.lit(1))).scalar()
    sweep = cells.groupBy("cap").agg(
        F.sum("added").alias("new_samples"),
        F.count(F.when(F.col("short") > 0, 1)).alias("shortage_cells"),
        F.sum("short").alias("total_shortage"),
        F.min("size").alias("cell_min"),
        F.max("size").alias("cell_max"),
        F.round(F.median("size"), 1).alias("cell_median"),
        F.count(F.when(F.col("size") >= 15, 1)).alias("cells_gte_15"),
        F.count(F.when(F.col("size") >= 30, 1)).alias("cells_gte_30"),
        F.count(F.lit(1)).alias("total_cells"),
    ).withColumn("total_after_merge", n_labelled + F.col("new_samples"))
    total = F.col("total_after_merge")
    sweep = sweep.withColumn("in_target_range", total.between(low, high)).withColumn(
        "within_limit", total <= high
    )
    # One row per cap: an all-rows window over at most len(caps) rows.
    best = W.orderBy(
        F.col("in_target_range").desc(),
        F.when(F.col("in_target_range"), -F.col("new_samples")).otherwise(F.abs(total - (low + high) // 2)),
        "cap",
    )
    return sweep.withColumn("recommended", F.row_number().over(best) == 1)


def shuffled_prefix(df: DataFrame, n: int | None, key: str = "post_id", order: Column | None = None) -> DataFrame:
    """First ``n`` rows of one fixed shuffle, so smaller prefixes lie within larger ones."""
    if n is None:
        return df
    order = draw(key) if order is None else order
    return df.orderBy(order, key).limit(n)


PREFIX_SIZES = {"smoke": 300, "pilot": 3000, "full": None}


def rows_for_mode(df: DataFrame, mode: str, key: str = "post_id", order: Column | None = None) -> DataFrame:
    return shuffled_prefix(df, PREFIX_SIZES[mode], key, order)


def spread_sample(
    plan: DataFrame, size: int = 60, per_province: int = 2, key: str = "post_id", order: Column | None = None
) -> DataFrame:
    """Up to ``size`` rows spread over provinces and weeks.

    At most ``per_province`` rows of one province, each from another week, then other rows in draw
    order until ``size`` is reached.
    """
    order = draw(key) if order is None else order
    rows = plan.withColumn("_draw", order)
    narrow = rows.select(key, "_draw", "province", "date_week")
    # All three ranks are cut by small literals, so Spark prunes rows before each shuffle.
    per_cell = W.partitionBy("province", "date_week").orderBy("_draw", key)
    per_prov = W.partitionBy("province").orderBy("_draw", key)
    spread = (
        narrow.withColumn("_row", F.row_number().over(per_cell)).filter("_row = 1")
        .withColumn("_row", F.row_number().over(per_prov)).filter(F.col("_row") <= per_province)
        .orderBy("_row", "_draw", key).limit(size)
        .select(key, F.lit(0).alias("_class"), "_draw")
    )
    # Enough rows in draw order to fill up whatever the spread part leaves open.
    extra = narrow.orderBy("_draw", key).limit(size * 2).select(key, F.lit(1).alias("_class"), "_draw")
    chosen = (
        spread.unionByName(extra).groupBy(key)
        .agg(F.min("_class").alias("_class"), F.first("_draw").alias("_draw"))
        .orderBy("_class", "_draw", key).limit(size)
        .select(key)
    )
    # At most ``size`` ids.
    return plan.join(F.broadcast(chosen), key, "left_semi")


def bounded_sample(df: DataFrame, n: int = 500, key: str = "id", order: Column | None = None) -> DataFrame:
    """All rows, or ``n`` of them by draw when there are more."""
    return shuffled_prefix(df, n, key, order)
