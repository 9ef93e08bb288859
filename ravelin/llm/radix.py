"""Exact running sums in groups, by histograms of a binary key's digits instead of a sort of everything.

A key is so many bytes, ordered as unsigned bytes. Rows are counted by the key's first `depth` bytes; those counts are added up
to ever shorter prefixes. On the way down, a prefix's sum over its smaller siblings (256 at most) is added to its parent's, so
no window holds more than a digit's values. Rows of one cell are then added up in their order. Where a cell holds more than
`most` rows, the cells get a byte longer, until none does: equal rows have been collapsed to one with a count before.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, partitions, release


def long_bytes(column) -> F.Column:
    """A long's nine bytes, in its order; null before all others."""
    plain = F.unhex(F.lpad(F.hex(F.col(column).cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    return F.when(F.col(column).isNull(), F.unhex(F.lit("00" * 9))).otherwise(F.concat(F.unhex(F.lit("01")), plain))


def _before(weight: str, within: list, by: str):
    """The sum over the smaller ones of a window."""
    return F.coalesce(F.sum(weight).over(Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def running_sums(rows: DataFrame, group: str, key: str, weight: str, out: str, depth: int | None = None, most: int = 4096) -> DataFrame:
    """rows, written to the shared folder, with `out` in the place of `key`: the sum of `weight` (longs from 0 up) over what stands
    before a row in its group, in order of `key`. Keys are binary, of one length and not null, groups not null; rows of a group
    with equal keys are equal in all columns, and any order serves for them. The first cells have `depth` bytes of the key, or as
    many as it takes for `most` rows a cell if keys are spread evenly."""
    columns, rest = rows.columns, [c for c in rows.columns if c != key]
    alike = materialise(rows.groupBy(*columns).agg(F.count("*").alias("__n")), "alike")
    low, high, length, n = alike.agg(F.min(key), F.max(key), F.max(F.length(key)), F.count("*")).first()
    if low is None:
        release(alike)
        return materialise(rows.drop(key).withColumn(out, F.lit(0).cast("long")), "summed")
    top = next((i for i in range(length) if low[i] != high[i]), length)  # bytes that all keys share
    depth = min(max(depth or top + ceil(log(max(n / most, 2), 256)), top), length)
    while True:
        cells = alike.groupBy(group, F.substring(key, 1, depth).alias("__cell")).agg(F.sum(F.col(weight) * F.col("__n")).alias("__w"), F.count("*").alias("__rows"))
        cells = materialise(cells, "cells")
        if depth >= length or (cells.agg(F.max("__rows")).first()[0] or 0) <= most:
            break
        release(cells)
        depth += 1
    levels = {depth: cells.select(group, "__cell", "__w")}
    for d in range(depth - 1, top, -1):
        levels[d] = levels[d + 1].groupBy(group, F.substring("__cell", 1, d).alias("__cell")).agg(F.sum("__w").alias("__w"))
    above = None
    for d in range(min(top + 1, depth), depth + 1):
        parent = F.substring("__cell", 1, d - 1)
        now = levels[d].select(group, "__cell", parent.alias("__parent"), _before("__w", [group, parent], "__cell").alias("__at"))
        if above is not None:
            up = above.select(group, F.col("__cell").alias("__parent"), F.col("__at").alias("__up"))
            now = now.join(up, [group, "__parent"]).withColumn("__at", F.col("__at") + F.col("__up"))
        above = now.select(group, "__cell", "__at")
    above = materialise(above, "before")
    release(cells)
    # Rows meet their cell's sum where they are ordered: both stand by group and cell.
    celled = alike.withColumns({"__cell": F.substring(key, 1, depth), "__w": F.col(weight) * F.col("__n")})
    inner = celled.withColumn("__in", _before("__w", [group, "__cell"], key))
    placed = inner.join(above, [group, "__cell"])
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("__copy")
    placed = placed.select(*rest, (F.col("__at") + F.col("__in")).alias("__first"), copies)
    done = materialise(placed.select(*rest, (F.col("__first") + F.col("__copy") * F.col(weight)).cast("long").alias(out)), "summed")
    release(alike)
    release(above)
    return done


def value_ranks(values: DataFrame, column: str, out: str, nulls_first: bool) -> DataFrame:
    """(column, out): the distinct values, and how many are smaller; strings in order of their UTF-8 bytes. Values are dealt out
    by ranges, a window counts inside a range, and the ranges' sizes are added up."""
    order = F.asc_nulls_first(column) if nulls_first else F.asc_nulls_last(column)
    parts = partitions(values.sparkSession)
    ranged = values.select(column).distinct().repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id())
    ranged = materialise(ranged, "ranged")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    sizes = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inner = ranged.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1)
    done = materialise(inner.join(sizes, "__part").select(column, (F.col("__before") + F.col("__in")).cast("long").alias(out)), "ranks")
    release(ranged)
    return done
