"""What every Python task needs from the session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session (they need not have it on their path)."""
    sc = spark.sparkContext
    if getattr(sc, "_furrow_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    at = os.path.join(tempfile.mkdtemp(prefix="furrow-"), "furrow.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, files in os.walk(os.path.join(top, "furrow")):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), top))
    sc.addPyFile(at)
    sc._furrow_shipped = True
