"""Sends this package to the executors, for sessions whose Python workers can't import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the context's Python files, once per application; skipped where PYTHONPATH already has it."""
    root = Path(__file__).resolve().parent
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    app = spark.sparkContext.applicationId
    if app in _sent or str(root.parent) in on_path:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*")):
            if path.suffix in (".py", ".json"):
                out.write(path, str(path.relative_to(root.parent)))
    spark.sparkContext.addPyFile(archive)
    _sent.add(app)
