"""Table access and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Lock
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Where the tables that materialize() has returned are written, and what is open in this thread, innermost last.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_OPEN: ContextVar[tuple[Scratch, ...]] = ContextVar("open", default=())
#: Whether Spark deletes the shuffle files of an action once it is over, and not only when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For each session how many threads are in cleaned_up(), and what was set before the first of them.
_CLEANED: WeakKeyDictionary[SparkSession, tuple[int, str | None]] = WeakKeyDictionary()
_LOCK = Lock()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only a session in one process may do without."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="assetloom-")
    return _OWN[app]


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Actions that begin inside leave no shuffle files; the session's setting is put back behind the last thread."""
    with _LOCK:
        n, before = _CLEANED.get(spark, (0, spark.conf.get(CLEANUP, None)))
        _CLEANED[spark] = n + 1, before
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            n, before = _CLEANED.pop(spark)
            if n > 1:
                _CLEANED[spark] = n - 1, before
            elif before is None:
                spark.conf.unset(CLEANUP)
            else:
                spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: cuts lineage and survives lost executors. Its shuffle files
    go with the write, so that the rounds of a job don't pile up on the executors' disks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with cleaned_up(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    if _OPEN.get():
        _OPEN.get()[-1].paths.append(path)
    return out


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(df: DataFrame) -> None:
    """Deletes the table of a DataFrame that materialize() returned; nothing for others. What is read from it must be written."""
    path = _PATHS.pop(df, None)
    if path:
        delete(df.sparkSession, path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that path, in whatever store it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in store.listStatus(at)] if store.exists(at) else []


class Scratch:
    """The tables that materialize() writes while this is open (``with``), the innermost one where several are. Whoever opened
    it deletes them, once nothing is left to be read from them."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        self._before = _OPEN.set((*_OPEN.get(), self))
        return self

    def __exit__(self, *_: object) -> None:
        _OPEN.reset(self._before)

    def delete(self, spark: SparkSession, but_for: DataFrame | None = None) -> None:
        """Deletes the tables, those excepted that ``but_for`` reads."""
        read = but_for.inputFiles() if but_for is not None else []
        for path in self.paths:
            if not any(path.rsplit("/", 1)[1] in file for file in read):
                delete(spark, path)
        self.paths = []
