"""The session, and the package's way to the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def session(name: str = "docloom", **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; ``conf`` goes on top, with ``__`` for dots."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    return b.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python once for each application, wherever it is installed."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        folder = tempfile.mkdtemp(prefix="docloom-zip-")  # the driver serves the file from here until it ends
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, "docloom.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for f in sorted(_PACKAGE.rglob("*.py")):
                out.write(f, str(f.relative_to(_PACKAGE.parent)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark
