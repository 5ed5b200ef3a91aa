"""Intermediate tables in the folder that the cluster shares."""

import atexit
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from gradeframe.session import fresh_path, reliable_checkpoint  # noqa: F401

_WRITTEN: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _remove_all() -> None:
    for spark, path in _WRITTEN:
        try:
            _remove(spark, path)
        except Exception:  # the session may have ended first; the folder is the cluster's scratch space
            return


@contextmanager
def scratch(*kept: str) -> Iterator[None]:
    """Tables that are written inside are removed at the end, but for those with a label in ``kept``.

    Use it around steps whose result no longer reads them: one that was written and is kept.
    """
    before = len(_WRITTEN)
    try:
        yield
    finally:
        inside = _WRITTEN[before:]
        stay = [x for x in inside if x[1].rpartition("/")[2].rpartition("-")[0] in kept]
        _WRITTEN[before:] = stay
        for spark, path in inside:
            if (spark, path) not in stay:
                _remove(spark, path)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session that holds for what runs inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """The table written as Parquet below ``spark.checkpoint.dir`` and read back.

    Lost executors cost no recomputation, and columns that a later step leaves out are not read. The
    folder is removed when the driver ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(_remove_all)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)
