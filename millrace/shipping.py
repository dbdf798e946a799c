"""Brings this package to Python workers that don't have it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024


def ship(spark: SparkSession) -> None:
    """Adds the package, zipped, to the application's files, once an application. Also, where the session says
    nothing else, rows go to Python in batches of ROWS, so that long texts fill neither side's memory."""
    sc = spark.sparkContext
    if sc.getConf().get(BATCH) is None and spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, ROWS)
    if getattr(sc, "_millrace_shipped", False):
        return
    here = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="millrace-")) / "millrace.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(here.rglob("*.py")):
            out.write(f, f.relative_to(here.parent).as_posix())
    sc.addPyFile(str(path))
    sc._millrace_shipped = True
