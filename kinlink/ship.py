"""Sending this package to the Python workers, for sessions whose workers can't import it from their own path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package as a zip to the session's Python files, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_kinlink_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="kinlink-zip-")) / "kinlink.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"kinlink/{p.relative_to(root)}")
    sc.addPyFile(str(target))
    sc._kinlink_shipped = True
    return spark
