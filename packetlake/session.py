"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings every job relies on; a cluster adds its own sizing on top.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # No call-site capture per column expression; it slows building wide plans.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # The decoded record has more leaf fields than the default limit of 100.
    "spark.sql.codegen.maxFields": "200",
}


def build_session(app: str = "packetlake", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the library defaults; extra settings override them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, visible to every executor.

    A cluster has to name that folder. Only on a local master, where all tasks
    share one disk, is a temporary one made and recorded in the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="packetlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Small Arrow batches, in rows and in bytes, so that wide values do not pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application.

    Needed where the job was not submitted with the package (``--py-files``).
    """
    context = spark.sparkContext
    if getattr(context, "_packetlake_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="packetlake-code-"), "packetlake_code")
    path = shutil.make_archive(archive, "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(path)
    context._packetlake_shipped = True
