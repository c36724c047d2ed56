"""Makes the package importable in Python workers that were not started with it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the Spark application, once, unless PYTHONPATH has it already."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = Path(tempfile.mkdtemp(prefix="leadloom-")) / "leadloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((ROOT / "leadloom").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)
