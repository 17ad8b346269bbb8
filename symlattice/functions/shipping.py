"""Sending this package to the executors, whose Python workers have to import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package, once for each Spark context; the archive is only the driver's copy of what it sends."""
    sc = spark.sparkContext
    if getattr(sc, "_symlattice_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(at))
    sc._symlattice_shipped = True
