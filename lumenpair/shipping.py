"""Sends this package to the executors, for the few functions that run in Python workers."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package's sources to the job once for each application; executors that start later fetch them too."""
    sc = spark.sparkContext
    if getattr(sc, "_lumenpair_shipped", False):
        return spark
    root, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    path = os.path.join(tempfile.mkdtemp(), "lumenpair.zip")  # on the driver, which serves it to the executors
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)
    sc._lumenpair_shipped = True
    return spark
