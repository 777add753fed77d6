"""Intermediate tables of iterative jobs, on the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Folders made up in local mode, by application; Spark does not take the setting once a session runs.
_MADE_UP: dict[str, str] = {}
_SCOPE: ContextVar[str | None] = ContextVar("scratch folder", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, which driver and executors must share: ``spark.checkpoint.dir``, or a folder in it
    inside ``scratch``.

    Only in local mode, where all run on one machine, an unset name is made up; elsewhere it is an error.
    """
    found = _SCOPE.get() or spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _MADE_UP.get(app) or _MADE_UP.setdefault(app, tempfile.mkdtemp(prefix="evalspark-"))
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there, by the file system that its name asks for."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables of this thread lie in a folder of their own, which is deleted at the end.

    A result is lazy and may read such tables: write or collect it before the end.
    """
    path = f"{scratch_dir(spark)}/scratch-{uuid.uuid4().hex}"
    token = _SCOPE.set(path)
    try:
        yield path
    finally:
        _SCOPE.reset(token)
        delete(spark, path)


class Tables:
    """Writes a table under ``spark.checkpoint.dir`` and reads it again: lineage ends there, and executors may be lost."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{scratch_dir(spark)}/tables-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes saved tables that nothing reads any more."""
        for df in frames:
            delete(self.spark, df.scratch_path)
