"""What a session needs: the package on executors and a folder that all of them share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application.

    Spark serves the archive from the driver, so workers can import the
    package whatever their working folder is.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), "strata_package.zip")
    root = os.path.dirname(_PACKAGE)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(_PACKAGE):
            for name in sorted(names):
                if name.endswith((".py", ".json")):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the folder that driver and executors share, ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a folder of its own; on a
    cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/data/{label}-{uuid.uuid4().hex}"
