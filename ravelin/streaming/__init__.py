"""Streaming forms of a few operators: not in the batch catalogue, for sources that keep growing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rates(events: DataFrame, at: str, keys: list[str], width: str, slide: str, late: str) -> DataFrame:
    """Events an hour in sliding windows; a window is final when the watermark passes its end."""
    seconds = F.unix_seconds("window.end") - F.unix_seconds("window.start")
    counted = events.withWatermark(at, late).groupBy(F.window(at, width, slide), *keys).agg(F.count("*").alias("n"))
    return counted.select(*keys, F.col("window.end").alias("until"), "n", (F.col("n") * 3600 / seconds).alias("per_hour"))


def sessions(events: DataFrame, at: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Islands of events that lie closer than a gap."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("session_window.start").alias("since"), F.col("session_window.end").alias("until"), "n")


def incremental_counts(path: str, keys: list[str], flag: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: counts and hits per key of each batch, written under the batch's number, so that a repeated batch
    replaces itself. The state is the sum over batches."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(flag).cast("long")).alias("hits")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def summed_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """The state: sums over the batches that incremental_counts wrote."""
    return df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
