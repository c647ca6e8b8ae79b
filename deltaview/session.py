"""Makes the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application; they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    _SENT.add(sc.applicationId)
    here = Path(__file__).resolve().parent
    if not here.is_dir():
        return  # it runs from an archive that was sent already
    path = os.path.join(tempfile.mkdtemp(prefix="deltaview-ship-"), "deltaview.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(p.relative_to(here.parent)))
    sc.addPyFile(path)
