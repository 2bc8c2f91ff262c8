"""Python workers must import this package too."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def reach(spark: SparkSession) -> None:
    """Put the folder of this package on the path of workers that are started from now on.

    Where executors have no such folder this changes nothing; there the package is shipped or installed."""
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
