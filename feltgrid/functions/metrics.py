"""Derived measures, bands and labels of emotion scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from feltgrid import domain
from feltgrid.functions.text import as_column

MEANS = [f"{e}_mean" for e in domain.EMOTIONS]


def stable_round(value: Column, digits: int) -> Column:
    """Half-up rounding that the last bits of a sum, and so its order, cannot change."""
    return F.round(value.cast("decimal(28,12)"), digits).cast("double")


def _argmax(columns: Sequence[Column | str], keys: Sequence[str]) -> Column:
    columns = [as_column(c) for c in columns]
    top = F.greatest(*columns)
    out = F.when(columns[0] == top, keys[0])
    for column, key in zip(columns[1:], keys[1:]):
        out = out.when(column == top, key)
    return out


def dominant(columns: Sequence[Column | str] = tuple(MEANS)) -> Column:
    """Emotion with the highest score; the first in emotion order wins a tie."""
    return _argmax(columns, domain.EMOTIONS)


def dominant_for_display(columns: Sequence[Column | str] = tuple(MEANS)) -> Column:
    """As ``dominant``, but another emotion must be strictly above neutral to replace it."""
    order = [5, 0, 1, 2, 3, 4]
    return _argmax([columns[i] for i in order], [domain.EMOTIONS[i] for i in order])


def emotion_label(key: Column | str) -> Column:
    pairs = [F.lit(v) for kv in domain.EMOTION_LABELS.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), as_column(key))


def positive_index(joy, sadness, anger, fear) -> Column:
    """Panel form: joy against the three negative emotions."""
    joy, sadness, anger, fear = map(as_column, (joy, sadness, anger, fear))
    return joy / (sadness + anger + fear + 0.01)


def positive_share(joy, surprise, neutral) -> Column:
    """Post and map form: positive part of the non-neutral score."""
    joy, surprise, neutral = map(as_column, (joy, surprise, neutral))
    return (joy + 0.5 * surprise) / (1 - neutral + 0.01)


def positive_score(joy, sadness, anger, fear, surprise) -> Column:
    joy, sadness, anger, fear, surprise = map(as_column, (joy, sadness, anger, fear, surprise))
    return joy + surprise * 0.5 - sadness - anger - fear


def intensity(neutral) -> Column:
    return 1 - as_column(neutral)


def fear_joy_ratio(fear, joy) -> Column:
    return as_column(fear) / (as_column(joy) + 0.01)


def negative_pressure(fear, anger, sadness) -> Column:
    return as_column(fear) + as_column(anger) + as_column(sadness)


def severity(z) -> Column:
    """Band of |z|. From 100 on the band is moderate again, as published."""
    size = F.abs(as_column(z))
    return (
        F.when((size >= 3.0) & (size < 3.5), "severe")
        .when((size >= 3.5) & (size < 100), "extreme")
        .otherwise("moderate")
    )


def severity_rank(name) -> Column:
    name = as_column(name)
    return F.when(name == "extreme", 3).when(name == "severe", 2).when(name == "moderate", 1).otherwise(0)


def severity_text(name) -> Column:
    name = as_column(name)
    return (
        F.when(name == "extreme", "极端异常")
        .when(name == "severe", "强烈异常")
        .when(name == "moderate", "轻微异常")
        .otherwise(name)
    )


def deviation_pct(value, expected) -> Column:
    """Signed whole percentage, halves to even; ``N/A`` without a usable expectation."""
    value, expected = as_column(value), as_column(expected)
    usable = expected.isNotNull() & (F.abs(expected) >= 1e-8)
    pct = (value - expected) / F.abs(F.when(usable, expected)) * 100
    sign = F.when(pct < 0, "-").otherwise("+")
    digits = F.abs(F.bround(pct, 0)).cast("decimal(38,0)").cast("string")
    return F.when(usable, F.concat(sign, digits, F.lit("%"))).otherwise("N/A")


def deviation_sentence(pct_text) -> Column:
    pct_text = as_column(pct_text)
    number = F.regexp_extract(pct_text, r"([+-]?\d+(\.\d+)?)", 1).try_cast("double")
    digits = F.floor(F.abs(number) + 0.5).cast("string")
    return (
        F.when(number.isNull(), pct_text)
        .when(number > 0, F.concat(F.lit("比过去 4 周高出 "), digits, F.lit("%")))
        .otherwise(F.concat(F.lit("比过去 4 周低 "), digits, F.lit("%")))
    )


def z_text(z) -> Column:
    size = F.abs(as_column(z))
    return (
        F.when(size >= 4, "极端异常")
        .when(size >= 3, "强烈异常")
        .when(size >= 2.5, "明显偏高")
        .otherwise("轻微波动")
    )


def map_bucket(value) -> Column:
    """Colour step 0-4 of a map value."""
    value = as_column(value)
    return (
        F.when(value <= 0.15, 0).when(value <= 0.30, 1).when(value <= 0.45, 2).when(value <= 0.60, 3)
        .otherwise(4)
    )


def trend_text(delta) -> Column:
    delta = as_column(delta)
    return (
        F.when(delta > 0.05, "明显升高")
        .when(delta > 0.02, "小幅升高")
        .when(delta > -0.02, "基本稳定")
        .when(delta > -0.05, "小幅下降")
        .otherwise("明显下降")
    )


# Display names of cluster labels 0-5.
CLUSTER_NAMES = ["高情绪强度型", "稳定中性型", "积极恢复型", "高焦虑型", "情绪波动型", "低表达型"]


def cluster_name(label) -> Column:
    label = as_column(label)
    known = F.try_element_at(F.array(*map(F.lit, CLUSTER_NAMES)), label.cast("int") + 1)
    return F.when(label.between(0, 5), known).otherwise(F.concat(F.lit("Cluster "), label.cast("string")))


def score_error(columns: Sequence[Column | str] = tuple(domain.EMOTIONS)) -> Column:
    """Reason why six scores are unusable, null when they are valid."""
    columns = [as_column(c) for c in columns]
    out = None
    for key, score in zip(domain.EMOTIONS, columns):
        bad = score.isNull() | F.isnan(score) | ~score.between(0, 1)
        text = F.concat(F.lit(f"score_out_of_range:{key}="), F.coalesce(score.cast("string"), F.lit("None")))
        out = F.when(bad, text) if out is None else out.when(bad, text)
    total = sum(columns[1:], columns[0])
    return out.when(
        F.abs(total - 1.0) > domain.SUM_TOLERANCE, F.format_string("sum_error:%.3f", total)
    )


def sum_is_valid(columns: Sequence[Column | str] = tuple(domain.EMOTIONS)) -> Column:
    """Whether six scores sum to about one; missing scores count as 0."""
    total = sum((F.coalesce(as_column(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    return F.abs(total - 1.0) < domain.SUM_VALID_TOLERANCE


def sum_valid_rate(columns: Sequence[Column | str] = tuple(domain.EMOTIONS)) -> Column:
    """Aggregate: share of rows with a valid score sum."""
    return F.round(F.avg(sum_is_valid(columns).cast("double")), 4)


def out_of_range(columns: Sequence[Column | str] = tuple(domain.EMOTIONS)) -> Column:
    flags = [(as_column(c) < 0) | (as_column(c) > 1) for c in columns]
    out = F.coalesce(flags[0], F.lit(False))
    for flag in flags[1:]:
        out = out | F.coalesce(flag, F.lit(False))
    return out
