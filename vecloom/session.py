"""Where intermediate tables live, and how lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SCRATCH: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests, local use)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="vecloom-")
        atexit.register(shutil.rmtree, _OWN[sc.applicationId], ignore_errors=True)
    return _OWN[sc.applicationId]


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df once to the shared folder and returns the table read back, so that a lost executor costs no recomputation of what is before it.

    The tables of an application are in a folder of its own, which clean_up() deletes.
    """
    made = read_back(df, f"{_own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}")
    if _SCRATCH:
        _SCRATCH[-1].append(made)
    return made


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/vecloom-{spark.sparkContext.applicationId}"


@contextmanager
def scratch():
    """Tables that are materialized inside are deleted at the end, but for the one that is handed to the function it gives."""
    _SCRATCH.append([])
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        for df in _SCRATCH.pop():
            if not any(df is k for k in kept):
                discard(df)
            elif _SCRATCH:
                _SCRATCH[-1].append(df)


def clean_up(spark: SparkSession) -> None:
    """Deletes all intermediate tables of the application. Results that have not been written or collected can not be read after it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read_back(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._vecloom_path = path
    return back


def discard(df: DataFrame) -> None:
    """Deletes a table made by materialize() when nothing reads it any more."""
    path = getattr(df, "_vecloom_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
