"""Agreement of predicted with human labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feltgrid import domain
from feltgrid.functions import metrics
from feltgrid.operators import panels
from feltgrid.operators.rows import beside


def map_labels(benchmark: DataFrame) -> DataFrame:
    """Add the mapped label; rows with an unknown label are dropped."""
    pairs = [F.lit(v) for kv in domain.BENCHMARK_LABELS.items() for v in kv]
    mapped = F.try_element_at(F.create_map(*pairs), F.col("label"))
    return benchmark.withColumn("label_cn", mapped).filter(F.col("label_cn").isNotNull())


def predicted_label() -> Column:
    return metrics.emotion_label(metrics.dominant(domain.EMOTIONS))


def confusion_counts(df: DataFrame, labels: Sequence[str], true: str = "label_true", predicted: str = "predicted") -> DataFrame:
    """Long confusion matrix over all label pairs, 0 where a pair does not occur."""
    names = F.array(*map(F.lit, labels))
    grid = df.sparkSession.range(1).select(F.explode(names).alias(true)).withColumn(predicted, F.explode(names))
    counts = df.groupBy(true, predicted).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, [true, predicted], "left").na.fill(0, ["n"])


def confusion_matrix(df: DataFrame, labels: Sequence[str], true: str = "label_true", predicted: str = "predicted") -> DataFrame:
    """One row per true label, one column per predicted label."""
    long = confusion_counts(df, labels, true, predicted)
    return long.groupBy(true).pivot(predicted, list(labels)).agg(F.sum("n"))


def class_report(df: DataFrame, labels: Sequence[str], true: str = "label_true", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support of each label; undefined values are 0.

    Each counted pair contributes to its true label and to its predicted label, so one small
    aggregate serves all labels.
    """
    sides = F.array(
        F.struct(F.col(true).alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("said")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("said")),
    )
    counts = confusion_counts(df, labels, true, predicted)
    per_label = (
        counts.withColumn("_hit", F.when(F.col(true) == F.col(predicted), F.col("n")).otherwise(0))
        .select("_hit", F.inline(sides))
        .groupBy("label")
        # A hit is seen from both of its sides.
        .agg(F.sum("support").alias("support"), F.sum("said").alias("said"), (F.sum("_hit") / 2).alias("hits"))
    )

    def share(c: Column, of: Column) -> Column:
        return F.coalesce(F.try_divide(c, of), F.lit(0.0))

    precision, recall = share(F.col("hits"), F.col("said")), share(F.col("hits"), F.col("support"))
    return per_label.select(
        "label",
        precision.alias("precision"),
        recall.alias("recall"),
        share(2 * F.col("hits"), F.col("said") + F.col("support")).alias("f1"),
        "support",
    )


def f1_summary(df: DataFrame, labels: Sequence[str], true: str = "label_true", predicted: str = "predicted") -> DataFrame:
    """One row: accuracy, micro F1, and macro and support-weighted averages.

    Accuracy counts all rows; micro F1 counts those whose labels are in ``labels``.
    """
    report = class_report(df, labels, true, predicted)
    names = ("precision", "recall", "f1")
    averages = report.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in names],
        *[
            F.coalesce(F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")), F.lit(0.0))
            .alias(f"weighted_{m}")
            for m in names
        ],
    )
    in_list = F.col(true).isin(list(labels)).cast("int")
    said_in_list = F.col(predicted).isin(list(labels)).cast("int")
    hit = (F.col(true) == F.col(predicted)).cast("int")
    totals = df.agg(
        F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.try_divide(2 * F.sum(hit * in_list), F.sum(in_list) + F.sum(said_in_list)), F.lit(0.0)).alias("micro_f1"),
        F.count(F.lit(1)).alias("rows"),
    )
    return beside(totals, averages)


def pearson_r(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of the finite pairs; null below two pairs or without variance."""
    x, y = F.col(x).cast("double"), F.col(y).cast("double")

    def finite(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    # ``corr`` itself fails in ANSI mode when a variance is 0.
    r = F.try_divide(F.covar_pop("x", "y"), F.sqrt(F.var_pop("x") * F.var_pop("y")))
    return df.filter(finite(x) & finite(y)).select(x.alias("x"), y.alias("y")).agg(
        F.count(F.lit(1)).alias("pairs"), F.when(F.count(F.lit(1)) >= 2, r).alias("pearson_r")
    )


def comparison_sample(scored: DataFrame, second: Column, n: int = 500, key: str = "post_id") -> DataFrame:
    """First ``n`` posts with the second scorer's value beside the positive share."""
    columns = [key, "content_clean", *domain.EMOTIONS]
    # The ids come first, so only the texts of the chosen posts are scored; ``n`` bounds the broadcast.
    chosen = F.broadcast(scored.select(key).orderBy(key).limit(n))
    return scored.select(*columns).join(chosen, key, "left_semi").select(
        *columns,
        second.alias("second_score"),
        metrics.positive_share("joy", "surprise", "neutral").alias("positive_idx"),
    )


def validation_tables(posts: DataFrame) -> dict[str, DataFrame]:
    return {
        "emotion_distribution_summary": panels.emotion_distribution(posts),
        "dominant_emotion_distribution": panels.dominant_distribution(posts),
    }
