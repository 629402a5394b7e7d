"""Joins and per-group selections that stay balanced when one key holds much of the data."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feltgrid.operators.stage import stage

HOT_SHARE = 0.001
SALTS = 64
TRACKED = 16  # keys that the sketch follows for each one it may name


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold at least ``share`` of the rows; never more than ``1 / share`` of them."""
    counts = df.groupBy(key).count()
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.filter((F.col("count") >= total * share) & F.col(key).isNotNull()).select(key)


def stage_with_hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> tuple[DataFrame, list]:
    """``df`` staged, and the keys that hold about ``share`` of its rows or more, from the same pass.

    A mergeable heavy-hitter sketch rides on the write, so nothing is read twice. It may name a key that is
    somewhat rarer, never miss one; the list is bounded by ``1 / share``.
    """
    seen, most = Observation(), math.ceil(1 / share)
    top = F.call_function("approx_top_k", F.col(key), F.lit(most), F.lit(TRACKED * most))
    staged = stage(df.observe(seen, top.alias("top"), F.count(F.lit(1)).alias("rows")))
    found = seen.get
    return staged, [r["item"] for r in found["top"] or [] if r["item"] is not None and r["count"] >= share * found["rows"]]


def salted_left_join(
    left: DataFrame, right: DataFrame, key: str, row_id: str, share: float = HOT_SHARE, salts: int = SALTS
) -> DataFrame:
    """Left join that spreads each hot key, and null keys, over ``salts`` tasks.

    ``left`` is computed once. Only the rows of ``right`` that match a hot key are repeated.
    """
    left, keys = stage_with_hot_keys(left, key, share)
    hot = F.col(key).isin(keys) if keys else F.lit(False)
    draw = F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int")
    salted_left = left.withColumn("_salt", F.when(hot | F.col(key).isNull(), draw).otherwise(0))
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_right = right.withColumn("_salt", F.explode(copies))
    return salted_left.join(salted_right, [key, "_salt"], "left").drop("_salt")


def smallest_per_group(
    df: DataFrame, group: str, sizes: Mapping[str, int] | int, order: Column, bucket: Column, tie: str
) -> DataFrame:
    """Exactly the ``sizes[g]`` rows of each group ``g`` that are smallest by ``(order, tie)``.

    ``bucket`` must not decrease with ``order``. Bucket counts, combined on the map side, give
    each group's last needed bucket; only rows up to it are ranked, so a group of any size sends
    little more than ``sizes[g]`` rows to one task. One number as ``sizes`` holds for every group.
    """
    if isinstance(sizes, int):
        rows, size, few = df.filter(F.col(group).isNotNull()), F.lit(sizes), False
    else:
        targets = F.create_map(*[F.lit(v) for kv in sizes.items() for v in kv])
        rows, size, few = df.filter(F.col(group).isin(list(sizes))), F.try_element_at(targets, F.col(group)), True
    rows = rows.withColumns({"_order": order, "_bucket": bucket})
    counts = rows.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(group).orderBy("_bucket")) - F.col("_n")
    cut = (
        counts.withColumn("_before", before)
        .filter(F.col("_before") < size)
        .groupBy(group)
        .agg(F.max("_bucket").alias("_last"))
    )
    # A row per named group: a shuffle by group instead would send all rows of a group to one task.
    near = rows.join(F.broadcast(cut) if few else cut, group).filter(F.col("_bucket") <= F.col("_last"))
    rank = F.row_number().over(W.partitionBy(group).orderBy("_order", tie))
    return (
        near.withColumn("_rank", rank)
        .filter(F.col("_rank") <= size)
        .drop("_order", "_bucket", "_last", "_rank")
    )
