"""Gaps and islands: segments of a track, and the events that end them. Tracks are worked on in pieces (`tracks`)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tracks

#: Gaps that a bucket of a track is wide.
WIDE = 64


def _segments(points: DataFrame, track: str, at: str, ground: str, gap: int, tie: str) -> DataFrame:
    """points with their neighbours, whether they start a segment (__s), and its number."""
    rows = tracks.neighbours(points, track, at, tie, WIDE * gap, [ground])
    before = F.col("__before")
    starts = F.col(ground) & (before.isNull() | ~F.coalesce(before[ground], F.lit(False)) | (F.col(at) - before[at] >= gap))
    return tracks.running_sum(rows.withColumn("__s", starts.cast("int")), track, at, tie, "__s", "segment").withColumn("segment", F.when(F.col(ground), F.col("segment")))


def ground_segments(points: DataFrame, track: str, at: str, ground: str, gap: int, tie: str) -> DataFrame:
    """points with the number of their ground segment in the track (null in the air). A segment breaks at an air point and
    where `gap` or more lies between points."""
    return _segments(points, track, at, ground, gap, tie).select(*points.columns, "segment")


def takeoffs(points: DataFrame, track: str, at: str, ground: str, gap: int, within: int, tie: str, slow: str | None = None, first: Sequence[str] = (), mean: Sequence[str] = ()) -> DataFrame:
    """For each ground point that an air point of its track follows in less than `within`: the segment's first point, its
    number of points, its widest gap, its first point under the condition of `slow`, and the time of leaving; of the columns in
    `first` the first point's value (first_x), of those in `mean` the mean (mean_x)."""
    rows = _segments(points, track, at, ground, gap, tie).filter(ground)
    starts, after = F.col("__s") == 1, F.col("__after")
    leaves = ~after[ground] & (after[at] - F.col(at) < within)
    moving = F.min(F.when(F.expr(slow), F.col(at))) if slow else F.min(at)
    out = rows.groupBy(track, "segment").agg(
        F.min(at).alias("first_ground"), moving.alias("first_moving"), F.count("*").alias("n"), F.max(F.when(~starts, F.col(at) - F.col("__before")[at])).alias("widest_gap"), F.max(F.when(leaves, after[at])).alias("takeoff"),
        *[F.min(F.when(starts, F.col(c))).alias(f"first_{c}") for c in first], *[F.avg(c).alias(f"mean_{c}") for c in mean],
    )
    return out.filter(F.col("takeoff").isNotNull())
