"""Python workers that can import this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def prepare_workers(spark: SparkSession) -> None:
    """Add the library's folder to the search path of the session's Python workers.

    Enough where workers see the folder (a local master, a shared image). On
    other clusters the package is submitted with ``--py-files``; the entry is
    then ignored.
    """
    environment = spark.sparkContext.environment
    path = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in path:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *path])
