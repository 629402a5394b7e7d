"""Putting one-row results side by side without a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beside(df: DataFrame, *one_row: DataFrame) -> DataFrame:
    """``df`` with the columns of each one-row table added to every row.

    Each table becomes one scalar subquery that returns a struct, so nothing is shuffled or
    joined; a table with more than one row is an error at run time.
    """
    parts = [
        part.select(F.struct(*part.columns)).scalar().alias(f"_part{i}") for i, part in enumerate(one_row)
    ]
    flat = [
        F.col(f"_part{i}.{c}").alias(c) for i, part in enumerate(one_row) for c in part.columns
    ]
    return df.select("*", *parts).select(*df.columns, *flat)
