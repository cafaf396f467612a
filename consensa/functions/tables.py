"""Tables between steps: written once in the shared folder, and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession

_OWN: dict[str, str] = {}
_LOCK = threading.Lock()
_NOW: ContextVar[Scope | None] = ContextVar("scope", default=None)


class Scope:
    """The tables that one call has made with ``keep``; calls in other threads have scopes of their own."""

    def __init__(self) -> None:
        self.made: list[str] = []
        self.spared: set[str] = set()

    def spare(self, *tables: DataFrame) -> None:
        """Leave ``tables`` when the scope ends: they go on to the scope around it, or stay if there is none."""
        self.spared |= {t._consensa_path for t in tables if hasattr(t, "_consensa_path")}


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Tables kept inside are deleted at its end, errors included, but for those it spares."""
    own, around = Scope(), _NOW.get()
    token = _NOW.set(own)
    try:
        yield own
    except BaseException:
        own.spared.clear()
        raise
    finally:
        _NOW.reset(token)
        for path in own.made:
            if path not in own.spared:
                _delete(spark, path)
            elif around is not None:
                around.made.append(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the session names, else one in the warehouse.

    Only where driver and executors are one process (tests, the bench) it is a temporary folder, removed at exit.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    with _LOCK:
        if app not in _OWN:
            _OWN[app] = _folder(spark)
    return _OWN[app]


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.master == "local" or context.master.startswith("local["):
        folder = tempfile.mkdtemp(prefix="consensa-")
        atexit.register(shutil.rmtree, folder, True)
        return f"file://{folder}"
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_consensa/{context.applicationId}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back: lineage is cut there, and the table survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._consensa_path = path
    own = _NOW.get()
    if own is not None:
        own.made.append(path)
    return out


#: Rows that a task sorts, so that its memory does not grow with the table.
PART_ROWS = 1_000_000


def parts(*tables: DataFrame, times: int = 1) -> int:
    """Into how many partitions the rows of stored ``tables`` go, each row ``times`` over: by their number, at least as many as the session names."""
    rows = sum(t.count() for t in tables) * times
    return max(int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))


def dealt(df: DataFrame, n: int | None, *keys: str | Column) -> DataFrame:
    """``df`` in ``n`` partitions by ``keys``; as it is without ``n``."""
    return df if n is None else df.repartition(n, *keys)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(*tables: DataFrame) -> None:
    """Delete tables of ``keep`` that no later step reads."""
    own = _NOW.get()
    for df in tables:
        path = getattr(df, "_consensa_path", None)
        if path:
            _delete(df.sparkSession, path)
            if own is not None and path in own.made:
                own.made.remove(path)
