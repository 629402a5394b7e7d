"""Materialising an intermediate result that several later steps read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def stage_folder(spark: SparkSession) -> str:
    """The folder for staged tables: the one in ``spark.checkpoint.dir``, else the warehouse.

    Both have to be folders that all executors share. The warehouse is by default one on the driver's own disk, where a
    cluster's staged tables would be lost, so that is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir")
        if folder.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{folder.rstrip('/')}/feltgrid/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{stage_folder(spark)}/{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the cluster's shared folder and read back.

    No later step repeats the work before it, and lost executors cost nothing that was staged.
    The table's size is known, so Spark's own size limit decides whether a join broadcasts it.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_stage(spark: SparkSession) -> bool:
    """Delete everything this application has staged; call it when no result that rests on it is read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(stage_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
