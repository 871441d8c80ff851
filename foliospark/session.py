"""Session helpers: where shared intermediates go, and how executors find this package."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import functools
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_DATABASE = "foliospark_work"
_OURS = {  # unless the session says otherwise: what Python is given at a time, and filters that reach sources written in it
    "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20,
    "spark.sql.python.filterPushdown.enabled": True,
}


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from the same path as the driver; bounds what they are given at a time."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    said = spark._jsparkSession.sessionState().conf()
    for name, value in _OURS.items():
        if not said.contains(name):
            spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine a local folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="foliospark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over all tasks: for rows that are small to read and dear to work on, of which one split of a file has many."""
    return df.repartition(max(partitions(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism), *keys)


class Scope:
    """The intermediates of one piece of work, which go when it is closed."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._written: list[tuple[str, str | None]] = []  # folders, and the tables over them

    def add(self, path: str, table: str | None = None) -> None:
        self._written.append((path, table))

    def close(self) -> None:
        while self._written:
            path, table = self._written.pop()
            if table:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    @contextlib.contextmanager
    def entered(self) -> Iterator[Scope]:
        """What is written meanwhile belongs to this scope; it stays open."""
        token = _current.set(self)
        try:
            yield self
        finally:
            _current.reset(token)


_current: contextvars.ContextVar[Scope | None] = contextvars.ContextVar("scope", default=None)
_rest: dict[str, Scope] = {}  # by application: what no scope holds, until the program ends


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """A scope that closes at the end of the block; results are written before it does."""
    own = Scope(spark)
    try:
        with own.entered():
            yield own
    finally:
        own.close()


def _holder(spark: SparkSession) -> Scope:
    held = _current.get()
    if held is not None:
        return held
    name = spark.sparkContext.applicationId
    if name not in _rest:
        _rest[name] = Scope(spark)
        atexit.register(_last, _rest[name])
    return _rest[name]


def _last(held: Scope) -> None:
    with contextlib.suppress(Exception):  # the session may have gone
        held.close()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes with the scope it is made in."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _holder(spark).add(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: a cut in the lineage that survives lost executors."""
    path = work_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``f`` in a scope of its own: its result is written to the scope it is called in, and all its intermediates go.

    For results that are small beside what is read, as a row of digests for each row.
    """

    @functools.wraps(f)
    def run(df: DataFrame, *args: object, **options: object) -> DataFrame:
        spark = prepare(df.sparkSession)
        outer = _holder(spark)
        with scope(spark):
            found = f(df, *args, **options)
            with outer.entered():
                return materialize(found, f.__name__)

    return run


def materialize_bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As :func:`materialize`, laid out in sorted buckets of ``key`` so that later joins on it move only their other side.

    ``df`` is grouped by ``key``: its partitions already are the buckets. The table is in a database of its own.
    """
    spark = df.sparkSession
    folder = f"{name}_{uuid.uuid4().hex}"
    path, table = f"{shared_dir(spark)}/{folder}", f"{_DATABASE}.{folder}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_DATABASE} LOCATION '{shared_dir(spark)}/{_DATABASE}'")
    _holder(spark).add(path, table)
    (df.write.option("path", path).option("compression", "zstd")
       .bucketBy(partitions(spark), key).sortBy(key).format("parquet").saveAsTable(table))
    return spark.table(table)
