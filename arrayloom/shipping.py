"""Make this package importable by Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_arrayloom_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="arrayloom-"), "arrayloom_modules.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(_PACKAGE.rglob("*.py")):
            archive.write(path, path.relative_to(_PACKAGE.parent))
    sc.addPyFile(target)
    sc._arrayloom_shipped = True
