"""Sessions: shipping this package to Python workers that don't have it on their path."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the workers, once per context; Spark's own file server hands it out."""
    sc = spark.sparkContext
    if getattr(sc, "_gridwarden_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="gridwarden-package-")) / "gridwarden_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(HERE.rglob("*.py")):
            z.write(f, Path(HERE.name) / f.relative_to(HERE))
    sc.addPyFile(str(path))
    atexit.register(shutil.rmtree, path.parent, ignore_errors=True)
    sc._gridwarden_shipped = True
