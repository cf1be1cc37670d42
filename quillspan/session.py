"""Sessions, and sending this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def session(master: str = "local[8]", app: str = "quillspan", partitions: int = 8, memory: str = "12g", **conf: str) -> SparkSession:
    """A session with the settings that the queries expect: adaptive plans, UTC, ANSI."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    spark = SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable on the executors (once for each application, as a small archive) and keep Arrow
    batches short."""
    context = spark.sparkContext
    if context.applicationId not in _SENT:
        root = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="quillspan-code-"), "quillspan.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.join("quillspan", os.path.relpath(path, root)))
        context.addPyFile(archive)
        _SENT.add(context.applicationId)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # the default: texts can be long, so batches are kept short on both sides
        spark.conf.set(key, "1000")
    return spark
