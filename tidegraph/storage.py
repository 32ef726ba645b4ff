"""Storage that driver and executors share; where loops cut their lineage."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Schemes of Spark's that pyarrow knows by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Only a session of one process may do without: it gets a folder of its own."""
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    if named.isDefined():
        return str(named.get())
    conf = spark.conf.get("spark.checkpoint.dir", "")
    if not conf:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        import tempfile

        conf = f"file://{tempfile.mkdtemp(prefix='tidegraph-')}"
    sc.setCheckpointDir(conf)
    return str(sc._jsc.sc().getCheckpointDir().get())


def fresh_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def saved(df: DataFrame, what: str = "step") -> DataFrame:
    """df, written as Parquet in the shared folder and read again: its lineage ends there, and a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes up to which a table may go through the driver to be joined; larger ones are shuffled, so what the driver gets doesn't grow with them.
SENT = 64 << 10


@contextmanager
def little_sent(spark: SparkSession) -> Iterator[None]:
    """Inside, joins broadcast tables of SENT bytes at most, or those that ask for it; the session's own bounds return in the end."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    was = [spark.conf.get(name, None) for name in names]
    for name in names:
        spark.conf.set(name, str(SENT))
    try:
        yield
    finally:
        for name, value in zip(names, was, strict=True):
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


_open: list[list[str]] = []


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """What is saved inside is deleted in the end, except what the given function saves; where nothing was, it needn't save anything."""
    _open.append([])

    def keep(df: DataFrame, what: str = "result") -> DataFrame:
        if not _open[-1]:
            return df
        mine = _open.pop()
        try:
            return saved(df, what)  # belongs to the scratch space around this one, if there is any
        finally:
            _open.append(mine)

    try:
        yield keep
    finally:
        for path in _open.pop():
            delete(spark, path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are saved and whose DataFrames are gone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system of a folder, and the path in it. Spark's names of schemes are understood, a path without one is local; hdfs needs libhdfs on every machine."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    files, path = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")
    return files, path.rstrip("/")


def salted(rows: DataFrame, other: DataFrame, keys: list[str], by: list[str], salts: int = 64, how: str = "inner") -> DataFrame:
    """rows joined with other (one row a key at most), where a key may hold a large share of the rows: each key's rows are dealt over salts by other columns, and its partner is copied to those salts that occur."""
    from pyspark.sql import functions as F

    dealt = rows.withColumn("salt_", F.pmod(F.xxhash64(*by), F.lit(salts)))
    places = dealt.select(*keys, "salt_").distinct().join(other, keys, how)
    return dealt.join(places, [*keys, "salt_"]).drop("salt_")
