"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders written since the innermost scoped() function began.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only where it is unset, as in tests on one machine, a temporary folder is made and set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "tidemark-shared")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder, read again: lineage ends there, and lost executors cost only what reads it."""
    path = fresh_path(df.sparkSession, name)
    if (scope := _scope.get()) is not None:
        scope.append(path)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def remove(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes the files of tables made by written()."""
    _delete(spark, sorted({f.rsplit("/", 1)[0] for df in frames for f in df.inputFiles()}))


def scoped(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f with its result written as a table, and all tables that it wrote on the way deleted."""

    @functools.wraps(f)
    def run(*args, **kw) -> DataFrame:
        made: list[str] = []
        outer = _scope.set(made)
        spark = next(a for a in (*args, *kw.values()) if isinstance(a, DataFrame)).sparkSession
        try:
            out = f(*args, **kw)
            _scope.reset(outer)
            return written(out, f.__name__)
        finally:
            if _scope.get() is made:
                _scope.reset(outer)
            _delete(spark, made)

    return run
