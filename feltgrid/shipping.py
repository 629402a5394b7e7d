"""Making the library importable in the Python workers of any cluster."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@functools.lru_cache(maxsize=4)
def ship(spark: SparkSession, packages: tuple[str, ...] = ("feltgrid",)) -> None:
    """Send archives of ``packages`` to the workers, wherever the driver was started."""
    for package in packages:
        name = os.path.join(tempfile.mkdtemp(prefix="feltgrid-ship-"), package)
        spark.sparkContext.addPyFile(shutil.make_archive(name, "zip", ROOT, package))
