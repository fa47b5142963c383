"""Executors import this package from a copy that Spark sends them."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's source to the executors once per context, so that workers can import it anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestar_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    # Spark serves the file from the driver; the folder is needed only while it is being registered.
    target = Path(tempfile.mkdtemp(prefix="lodestar-")) / f"{root.name}-src.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._lodestar_shipped = True
    return spark
