"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
_kept: dict[tuple, str] = {}


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="plenum-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only a session in one process may go without.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _local_folder()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Deletes what this process has put into the shared folder, and says how many paths; to be called when no result that reads them is needed any more."""
    gone = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is put into the shared folder inside is deleted at the end; results must be written before, to a path made outside."""
    outer = _made[:]
    _made.clear()
    try:
        yield
    finally:
        clear(spark)
        _made.extend(outer)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` to the shared folder and reads it back."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by its keys to a fixed number of tasks, for work in Python whose time the bytes don't tell: Spark would join small partitions to one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def kept(name: str, source: DataFrame, build: Callable[[str], None]) -> str:
    """The path of what ``build`` has put there from ``source``; built anew when a file of ``source`` has changed or the path has gone."""
    spark = source.sparkSession
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    exists = lambda p: path_of(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path_of(p))

    def state(file: str) -> tuple[str, int, int]:
        s = path_of(file).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path_of(file))
        return file, s.getLen(), s.getModificationTime()

    key = (name, spark.sparkContext.applicationId, *sorted(map(state, source.inputFiles())))
    if key not in _kept or not exists(_kept[key]):
        path = shared_folder(spark, name)
        build(path)
        _kept[key] = path
    return _kept[key]
