"""Makes the package importable in Python workers that do not find it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]

_shipped: set[str] = set()


def reachable() -> bool:
    """Whether workers started by this process see the package: through PYTHONPATH or the working folder."""
    paths = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    return any(p and Path(p).resolve() == ROOT for p in paths)


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip file to the application, once; nothing if workers see it already."""
    app = spark.sparkContext.applicationId
    if app in _shipped or reachable():
        return
    path = Path(tempfile.mkdtemp(prefix="tidelog-")) / "tidelog.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted((ROOT / "tidelog").rglob("*.py")):
            z.write(file, file.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
