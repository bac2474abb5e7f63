"""Tables that cut lineage, written where every executor can read them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Where a local session, as in tests, keeps its tables if it names no shared folder.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints/timberline"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a session whose executors run in the driver's process may leave it
    unset; on a cluster other executors couldn't read what one writes to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_CHECKPOINTS).rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    return f"{shared_dir(spark)}/timberline-{spark.sparkContext.applicationId}"


#: Folders of the calls of settled() that run, innermost last.
_scopes: list[str] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    What reads the result again after an executor is lost reads files, not a recomputed plan, and the optimiser sees
    the true size of the table when it picks a join.
    """
    path = f"{_scopes[-1] if _scopes else session_dir(df.sparkSession)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(df: DataFrame) -> None:
    """Delete a table that materialise() wrote, once nothing reads it any more. Other DataFrames are left alone."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if session_dir(spark) in folder:
            _delete(spark, folder)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The written result of make(); the tables that it wrote on its way are deleted."""
    inside = f"{session_dir(spark)}/{uuid.uuid4().hex}"
    _scopes.append(inside)
    try:
        out = make()
        _scopes.pop()
        return materialise(out, name)
    finally:
        if inside in _scopes:
            _scopes.remove(inside)
        _delete(spark, inside)


def clear(spark: SparkSession) -> None:
    """Delete this application's tables; DataFrames that read them can't be used after."""
    _delete(spark, session_dir(spark))
