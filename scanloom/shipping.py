"""Makes this package importable in Spark's Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_PARENT = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers, once, unless they find it by PYTHONPATH or in the working folder."""
    context = spark.sparkContext
    known = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [os.getcwd()]
    if getattr(context, "_scanloom_shipped", False) or str(_PARENT) in (os.path.realpath(p) for p in known):
        return
    base = Path(tempfile.mkdtemp(prefix="scanloom-")).resolve() / "scanloom"
    context.addPyFile(shutil.make_archive(str(base), "zip", _PARENT, "scanloom"))
    context._scanloom_shipped = True
