"""Storage that driver and executors share, for frames that are used more than once."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the context's checkpoint folder. Where both are unset a temporary folder serves a
    local master, as in tests; on a cluster that is an error, as executors and driver would each see another folder."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or getattr(spark, "_ravelin_dir", None)
    if not root:
        if not re.match(r"local(\[[^,]*(,\s*\d+)?\])?$", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = spark._ravelin_dir = f"file://{tempfile.mkdtemp(prefix='ravelin-')}"
    return root


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _sweep() -> None:
    for spark, path in _written:
        try:
            remove(spark, path.rsplit("/", 1)[0])
        except Exception:  # the JVM has gone; the folder's owner clears it
            return


_sweeping: list[bool] = []


def materialise(df: DataFrame, name: str = "frame") -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors, gives real sizes."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/ravelin/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    if not _sweeping:  # registered after Spark's own exit work, and so done before it
        _sweeping.append(True)
        atexit.register(_sweep)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._ravelin_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete what materialise() wrote, once nothing reads it any more."""
    remove(df.sparkSession, df._ravelin_path.rsplit("/", 1)[0])
    _written[:] = [x for x in _written if x[1] != df._ravelin_path]


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str = "frame") -> DataFrame:
    """The frame that make() builds, written, without what stands behind it: frames that were written on the way are deleted, and
    shuffle files go, which Spark keeps until the driver happens to collect the plans that refer to them."""
    before = {p for _, p in _written}
    out = materialise(make(), name)
    for session, path in [x for x in _written if x[1] not in before and x[1] != out._ravelin_path]:
        remove(session, path.rsplit("/", 1)[0])
        _written.remove((session, path))
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


@contextmanager
def scratch(spark: SparkSession):
    """Deletes, at its end, what was written to the shared folder inside: for a caller that writes a query's result and then needs
    none of the frames behind it.

        with scratch(spark):
            query(spark, folder).write.parquet(out)
    """
    before = {p for _, p in _written}
    try:
        yield
    finally:
        mine = [(s, p) for s, p in _written if p not in before]
        for session, path in mine:
            remove(session, path.rsplit("/", 1)[0])
        _written[:] = [x for x in _written if x[1] in before]
