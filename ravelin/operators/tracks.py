"""Tracks in pieces: what stands before and after a point on its track, without a task that holds a track.

A track's points are laid into buckets of time. What a bucket needs to know of the others (the last state before it, the first one
after it, a sum over all before) comes from a table with one row for each bucket, and that in turn from one with a row for
each `SPAN` buckets, the only one that is read track by track. Points themselves are put in order by track and bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cells import _null_safe

SPAN = 4096


def in_buckets(points: DataFrame, at: str, width: int) -> DataFrame:
    """points with the number of their bucket, __b."""
    return points.withColumn("__b", F.floor(F.col(at) / width))


def carried(points: DataFrame, track: str, last: dict[str, Column] | None = None, first: dict[str, Column] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """(track, __b, names): for each bucket the last non-null value of the aggregates in `last` in buckets before it, the first of
    those in `first` in buckets after it, and the sum of those in `sums` over the buckets before it."""
    last, first, sums = last or {}, first or {}, sums or {}
    names = [*last, *first, *sums]

    def over(keys: Sequence[str], by: str) -> list[Column]:
        w = W.partitionBy(*keys).orderBy(by)
        before, after = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing)
        found = [F.last(n, ignorenulls=True).over(before).alias(f"{n}_c") for n in last] + [F.first(n, ignorenulls=True).over(after).alias(f"{n}_c") for n in first]
        return found + [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_c") for n in sums]

    buckets = points.groupBy(track, "__b").agg(*[c.alias(n) for n, c in {**last, **first, **sums}.items()]).withColumn("__u", F.floor(F.col("__b") / SPAN))
    whole = buckets.groupBy(track, "__u").agg(
        *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("__b"))).alias(n) for n in last], *[F.min_by(n, F.when(F.col(n).isNotNull(), F.col("__b"))).alias(n) for n in first], *[F.sum(n).alias(n) for n in sums]
    )
    tops = whole.select(track, "__u", *over([track], "__u")).withColumnsRenamed({f"{n}_c": f"{n}_t" for n in names})
    inner = buckets.select(track, "__u", "__b", *over([track, "__u"], "__b"))
    both = _null_safe(inner, tops, [track, "__u"])
    return both.select(track, "__b", *[F.coalesce(f"{n}_c", f"{n}_t").alias(n) for n in [*last, *first]], *[(F.col(f"{n}_c") + F.col(f"{n}_t")).alias(n) for n in sums])


def neighbours(points: DataFrame, track: str, at: str, tie: str, width: int, columns: Sequence[str]) -> DataFrame:
    """points with __b, and with the columns (and time and tie) of the point before and the one after on the track, as structs __before
    and __after, null at its ends."""
    rows = in_buckets(points, at, width)
    state = F.struct(F.col(at), *[F.col(c) for c in dict.fromkeys([tie, *columns]) if c != at])
    w = W.partitionBy(track, "__b").orderBy(at, tie)
    own = rows.withColumns({"__before": F.lag(state).over(w), "__after": F.lead(state).over(w)})
    edges = carried(rows, track, {"__last": F.max(state)}, {"__first": F.min(state)})
    got = _null_safe(own, edges, [track, "__b"])
    return got.withColumns({"__before": F.coalesce("__before", "__last"), "__after": F.coalesce("__after", "__first")}).drop("__last", "__first")


def running_sum(points: DataFrame, track: str, at: str, tie: str, value: str, out: str) -> DataFrame:
    """points, which have __b, with the sum of value over the track up to and with the point."""
    inner = F.sum(value).over(W.partitionBy(track, "__b").orderBy(at, tie).rowsBetween(W.unboundedPreceding, 0))
    got = _null_safe(points.withColumn("__in", inner), carried(points, track, sums={"__upto": F.sum(value)}), [track, "__b"])
    return got.withColumn(out, F.col("__in") + F.col("__upto")).drop("__in", "__upto")


def last_known(points: DataFrame, track: str, at: str, tie: str, width: int, value: str, out: str) -> DataFrame:
    """points with the last non-null value on the track, the point's own included."""
    rows = in_buckets(points, at, width)
    inner = F.last(value, ignorenulls=True).over(W.partitionBy(track, "__b").orderBy(at, tie).rowsBetween(W.unboundedPreceding, 0))
    heard = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(at, tie)))
    got = _null_safe(rows.withColumn("__in", inner), carried(rows, track, {"__heard": heard}), [track, "__b"])
    return got.withColumn("__in", F.coalesce("__in", "__heard")).drop("__b", "__heard").drop(*[out]).withColumnRenamed("__in", out)
