"""Session helpers: shipping this package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset and all is local."""
    if told := spark.conf.get("spark.checkpoint.dir", None):
        return told.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tidewright-")
    return "file://" + _OWN[app]


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}-{tag}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors (once per application)."""
    sc = spark.sparkContext
    package = os.path.dirname(os.path.abspath(__file__))
    if sc.applicationId in _SHIPPED or not os.path.isdir(package):
        return
    _SHIPPED.add(sc.applicationId)
    folder = tempfile.mkdtemp(prefix="ship-")
    archive = os.path.join(folder, "tidewright.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for where, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(where, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    before = list(sys.path)
    sc.addPyFile(archive)
    sys.path[:] = before
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
