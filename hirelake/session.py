"""Sessions that can run the package's Python functions on their executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once per application, unless PYTHONPATH already names its folder."""
    root = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        if str(root.parent) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
            path = Path(tempfile.mkdtemp(prefix="hirelake-")) / "hirelake.zip"
            with zipfile.ZipFile(path, "w") as z:
                for f in sorted(root.rglob("*.py")):
                    z.write(f, f.relative_to(root.parent))
            spark.sparkContext.addPyFile(str(path))
        _SHIPPED.add(app)
    return spark
