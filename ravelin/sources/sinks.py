"""Sinks that commit: predictions of a run, versions of a table, and a submission in a template's rows."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cells import exact_quantiles, value_counts
from ..operators.keys import require_unique


def write_predictions(df: DataFrame, root: str, run_id: str) -> None:
    """Predictions under root/run_id=...; a run's own folder is replaced, and only once the new files are all there. A write that breaks
    off leaves what was there before, and readers of other runs are not disturbed."""
    named = df.withColumn("run_id", F.lit(run_id))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(root)


def write_table(df: DataFrame, path: str) -> str:
    """A new version of a table: files in a folder of their own, and then, by one rename, a manifest that names the folder. Readers
    see the old version or the new one whole. Returns the version's folder; older ones stay for those who still read them."""
    spark, jvm = df.sparkSession, df.sparkSession.sparkContext._jvm
    name = f"version-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{path}/{name}")
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # A name that no reader takes for a manifest, until the rename.
    part, manifest = jvm.org.apache.hadoop.fs.Path(where, f"_part-{name}"), jvm.org.apache.hadoop.fs.Path(where, f"_manifest-{name}")
    store.create(part, True).close()
    if not store.rename(part, manifest):
        raise OSError(f"the manifest of {path} could not be written")
    return f"{path}/{name}"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The last version that was written whole."""
    return spark.read.parquet(f"{path}/{_versions(spark, path)[-1]}")


def _versions(spark: SparkSession, path: str) -> list[str]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in (store.listStatus(where) if store.exists(where) else [])]
    found = sorted(n.removeprefix("_manifest-") for n in names if n.startswith("_manifest-"))
    if not found:
        raise FileNotFoundError(f"{path} has no version")
    return found


def drop_versions(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Deletes all but the last versions, and what broken writes left; the names that went."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = _versions(spark, path)
    kept, gone = set(whole[-keep:]), []
    for s in store.listStatus(where):
        name = s.getPath().getName()
        version = name.removeprefix("_manifest-").removeprefix("_part-")
        if version.startswith("version-") and version not in kept and version < max(kept):
            store.delete(s.getPath(), True)
            gone.append(name)
    return sorted(gone)


def on_template(template: DataFrame, predictions: DataFrame, key: str, pred: str, most_missing: float = 0.001) -> DataFrame:
    """The template's rows with predictions; missing ones take the median if they are at most that share, else it is an error."""
    joined = template.select(key).join(require_unique(predictions.select(key, pred), key), key, "left")
    missing, n = joined.agg(F.count(F.when(F.col(pred).isNull(), 1)), F.count("*")).first()
    if missing > most_missing * n:
        raise ValueError(f"{missing} of {n} rows have no prediction")
    median = exact_quantiles(value_counts(predictions, [], pred), [], pred, {"__median": 0.5}).select("__median").scalar()
    return joined.select(key, F.coalesce(F.col(pred), median).alias(pred))
