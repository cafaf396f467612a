"""What a session needs before the engine's Python kernels run on executors."""

from __future__ import annotations

import io
import os
import threading
import uuid
import zipfile

from pyspark.sql import SparkSession

from .tables import shared_dir

ARROW_ROWS, ARROW_BYTES = "512", "16m"
_SHIPPED: set[str] = set()
_LOCK = threading.Lock()


def _stored(spark: SparkSession, raw: bytes) -> str:
    """Path of the archive in the shared folder."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}/consensa.zip"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(raw))
    out.close()
    return path


def _archive() -> bytes:
    """The package as a zip file."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    return raw.getvalue()


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package to the executors once an application; keep Arrow batches small, since rows can be long texts."""
    app = spark.sparkContext.applicationId
    with _LOCK:
        if app not in _SHIPPED:
            spark.sparkContext.addPyFile(_stored(spark, _archive()))
            _SHIPPED.add(app)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark
