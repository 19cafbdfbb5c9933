"""Makes this package importable on executors that don't have it installed."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent


def ensure_on_executors(spark: SparkSession) -> SparkSession:
    """Sends the package as a zip file, once per Spark application. Returns the session."""
    sc = spark.sparkContext
    if getattr(sc, "_quernstone_shipped", False):
        return spark
    folder = tempfile.mkdtemp(prefix="package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    at = os.path.join(folder, "quernstone.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, str(Path(_ROOT.name) / p.relative_to(_ROOT)))
    sc.addPyFile(at)  # copied to Spark's own file server at once
    sc._quernstone_shipped = True
    return spark
