"""Resumable scoring as a file-source stream.

The checkpoint records which files were scored, so a stopped or failed run continues where it
ended and each input row reaches the sink once. ``score_stream_by_id`` also knows the posts that earlier
batches scored, whatever file brings them again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from feltgrid.operators.scoring import pending_posts


def read_post_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def score_stream(posts: DataFrame, score: Callable[[DataFrame], DataFrame], output: str, checkpoint: str) -> StreamingQuery:
    """Score everything that has arrived since the last run, append it to ``output``, then stop."""
    return (
        score(posts)
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def read_scored(spark: SparkSession, output: str) -> DataFrame:
    """All batches of ``score_stream_by_id``; ``batch`` tells which one scored a post."""
    return spark.read.parquet(output)


def score_stream_by_id(
    posts: DataFrame, score: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, key: str = "post_id"
) -> StreamingQuery:
    """Score each post once, by id: posts that an earlier batch scored ``ok`` are left out, failed ones are tried again.

    A batch overwrites the folder of its own number, so one that was killed and runs again leaves no copies. Of
    several rows of a post in a batch one is scored.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        if _exists(spark, output):
            # Folders from this number on are left from a run that did not end.
            schema = f"`{key}` {batch.schema[key].dataType.simpleString()}, label_status string, batch int"
            earlier = spark.read.schema(schema).parquet(output).filter((F.col("batch") < number) & (F.col("label_status") == "ok"))
            rows = pending_posts(rows, earlier, key=key)
        score(rows).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return posts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
