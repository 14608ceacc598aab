"""Sending this package to executors that don't have it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once, unless PYTHONPATH already leads to it."""
    root = Path(__file__).resolve().parents[1]
    if any(p and Path(p).resolve() == root for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return
    if spark.conf.get("cartulary.shipped", None) == spark.sparkContext.applicationId:
        return
    target = Path(tempfile.mkdtemp(prefix="cartulary-code-")) / "cartulary.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "cartulary").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    spark.conf.set("cartulary.shipped", spark.sparkContext.applicationId)
