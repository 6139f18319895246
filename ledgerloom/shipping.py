"""Makes this package importable in Python workers that do not share the driver's path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once, unless PYTHONPATH or the working folder already gives it to them."""
    home = str(ROOT.parent)
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    context = spark.sparkContext
    if any(os.path.realpath(p) == home for p in known if p) or getattr(context, "_ledgerloom_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="ledgerloom-")) / "ledgerloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in ROOT.rglob("*.py"):
            out.write(path, path.relative_to(ROOT.parent))
    context.addPyFile(str(archive))
    context._ledgerloom_shipped = True
