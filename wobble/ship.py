"""The package, sent from the driver to executors that don't have it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Executors get the package from the driver, once per context: they needn't have it, nor share a folder with the driver."""
    context = spark.sparkContext
    if getattr(context, "_wobble_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="wobble-"), "wobble.zip")  # Spark copies it from here
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "wobble")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), root))
    context.addPyFile(path)
    context._wobble_shipped = True
