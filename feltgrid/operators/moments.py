"""Panels that take in new posts without reading the old ones.

A state holds, for each week, month and province, the number of posts and for each value its count, mean and
sum of squared deviations. States of disjoint posts are merged by the rule for parallel variances, a post whose
scores were replaced is taken out by a state of negative counts, and every panel is a view over a state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feltgrid import domain
from feltgrid.operators import panels
from feltgrid.operators.rows import beside

KEYS = ["date_week", "date_month", "province"]
VALUES = [*domain.EMOTIONS, "word_count"]


def post_moments(posts: DataFrame, keys: Sequence[str] = KEYS, values: Sequence[str] = VALUES) -> DataFrame:
    """The state of ``posts``: one aggregate, combined before its shuffle."""
    parts = [F.count("post_id").alias("posts"), F.count(F.lit(1)).alias("rows")]
    for v in values:
        parts += [
            F.count(v).alias(f"{v}_n"), F.coalesce(F.avg(v), F.lit(0.0)).alias(f"{v}_m"),
            F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias(f"{v}_s"),
        ]
    return posts.groupBy(*keys).agg(*parts)


def negative(state: DataFrame) -> DataFrame:
    """The state that takes the posts of ``state`` out of another one."""
    turned = [c for c in state.columns if c in ("posts", "rows") or c.endswith(("_n", "_s"))]
    return state.withColumns({c: -F.col(c) for c in turned})


def _values(state: DataFrame) -> list[str]:
    return [c.removesuffix("_m") for c in state.columns if c.endswith("_m")]


def roll_up(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``state`` merged to coarser keys; keys whose rows were all taken out are dropped.

    Deviations are taken from the merged means, not from sums of squares, so no digits are lost.
    """
    values, keys = _values(state), list(keys)
    sums = [F.sum("posts").alias("posts"), F.sum("rows").alias("rows")]
    for v in values:
        sums += [F.sum(f"{v}_n").alias(f"{v}_n"), F.coalesce(F.try_divide(F.sum(F.col(f"{v}_n") * F.col(f"{v}_m")), F.sum(f"{v}_n")), F.lit(0.0)).alias(f"{v}_m")]
    merged = state.groupBy(*keys).agg(*sums).filter("rows > 0")
    means = merged.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(f"{v}_m").alias(f"_{v}") for v in values])
    gaps = [F.sum(F.col(f"{v}_s") + F.col(f"{v}_n") * F.pow(F.col(f"{v}_m") - F.col(f"_{v}"), F.lit(2.0))).alias(f"{v}_s") for v in values]

    def same(left: DataFrame, names: Sequence[str]):
        on = F.lit(True)
        for k, name in zip(keys, names):
            on = on & left[k].eqNullSafe(F.col(name))
        return on

    if not keys:
        return beside(merged, beside(state, means).agg(*gaps))
    spread = state.join(means, same(state, [f"_{k}" for k in keys])).groupBy(*keys).agg(*gaps)
    spread = spread.select(*[F.col(k).alias(f"_{k}") for k in keys], *[f"{v}_s" for v in values])
    return merged.join(spread, same(merged, [f"_{k}" for k in keys])).drop(*[f"_{k}" for k in keys])


def merge_moments(state: DataFrame, *more: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The state of the posts of all states together."""
    for other in more:
        state = state.unionByName(other)
    return roll_up(state, keys)


def _mean(v: str, name: str):
    return F.when(F.col(f"{v}_n") > 0, F.col(f"{v}_m")).alias(name)


def _std(v: str, name: str, squared: bool = False):
    # A sum of squares that rounding left below zero counts as zero.
    variance = F.greatest(F.col(f"{v}_s"), F.lit(0.0)) / (F.col(f"{v}_n") - 1)
    return F.when(F.col(f"{v}_n") > 1, variance if squared else F.sqrt(variance)).alias(name)


def _emotions(*deviations: str) -> list:
    return [_mean(e, f"{e}_mean") for e in domain.EMOTIONS] + [_std(e, f"{e}_std") for e in deviations]


def _listed(state: DataFrame, provinces: Sequence[str] | None) -> DataFrame:
    return state if provinces is None else state.filter(F.col("province").isin(list(provinces)))


def weekly_panel(state: DataFrame, provinces: Sequence[str] | None = domain.PROVINCES, min_posts: int = domain.MIN_POSTS_RELIABLE) -> DataFrame:
    """``panels.weekly_panel`` of the posts in ``state``."""
    rows = roll_up(_listed(state, provinces), ["date_week", "province"])
    wide = rows.select("date_week", "province", F.col("posts").alias("total_posts"), _mean("word_count", "avg_word_count"), *_emotions(*domain.EMOTIONS))
    return panels.weekly_measures(wide, min_posts)


def monthly_panel(state: DataFrame, provinces: Sequence[str] | None = domain.PROVINCES, min_posts: int = domain.MIN_POSTS_RELIABLE) -> DataFrame:
    rows = roll_up(_listed(state, provinces), ["date_month", "province"])
    return panels.monthly_measures(rows.select("date_month", "province", F.col("posts").alias("total_posts"), *_emotions("joy", "fear")), min_posts)


def national_timeline(state: DataFrame) -> DataFrame:
    rows = roll_up(state, ["date_week"])
    return panels.national_measures(rows.select("date_week", F.col("posts").alias("total_posts"), *_emotions(*domain.EMOTIONS)))


def province_vectors(state: DataFrame, provinces: Sequence[str] | None = domain.PROVINCES) -> DataFrame:
    return roll_up(_listed(state, provinces), ["province"]).select(
        "province", F.col("posts").alias("total_posts_all"), *[_mean(e, f"{e}_mean_all") for e in domain.EMOTIONS],
        (1 - _mean("neutral", "_")).alias("emotional_intensity_mean"), _std("fear", "fear_variance", True), _std("joy", "joy_variance", True),
    )


def emotion_distribution(state: DataFrame) -> DataFrame:
    return panels.emotion_rows(roll_up(state, []).select(*_emotions(*domain.EMOTIONS)))
