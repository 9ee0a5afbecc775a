"""Making the package importable where functions run."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]
_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the workers, once an application, unless they find it by path already."""
    app = spark.sparkContext.applicationId
    paths = {os.path.abspath(p or ".") for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if app in _DONE or str(ROOT) in paths or os.getcwd() == str(ROOT):
        return
    _DONE.add(app)
    out = Path(tempfile.mkdtemp(prefix="quadloom-")) / "quadloom.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted((ROOT / "quadloom").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(out))


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query`` after ``ship``."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
