"""Sending this package to the executors, whose Python may not find it otherwise."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Bytes of an Arrow batch, where the session doesn't say.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once, and bound the bytes of Arrow batches lower than Spark does, unless the
    session sets a bound: a worker and its task hold several copies of a batch of texts. No other setting changes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_lantern_shipped", False):
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "lantern_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    sc.addPyFile(archive)
    sc._lantern_shipped = True
