"""Splits by month, blind views, and predictions of several members on common rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split(df: DataFrame, month: str | Column, name: str, months: Mapping[str, Sequence[int]]) -> DataFrame:
    """The rows of a named split, which is a list of months; on a partition column the scan prunes the other files."""
    if name not in months:
        raise KeyError(f"no such split: {name}")
    return df.filter((F.col(month) if isinstance(month, str) else month).isin(list(months[name])))


def disjoint(months: Mapping[str, Sequence[int]], *names: str) -> bool:
    """Whether no month stands in two of the splits."""
    every = [m for n in names for m in months[n]]
    return len(every) == len(set(every))


def blind(df: DataFrame, hidden: Column, columns: Sequence[str], truth: str, out: str = "y_true") -> DataFrame:
    """df with the columns nulled where rows are hidden, and their truth in a column of its own."""
    kept = df.withColumn(out, F.when(hidden, F.col(truth)))
    return kept.withColumns({c: F.when(~hidden, F.col(c)) for c in columns})


def member_mean(members: Sequence[DataFrame], key: str, pred: str) -> DataFrame:
    """(key, mean of the members' predictions); each member must have each key once, or it is an error."""
    rows = None
    for i, m in enumerate(members):
        part = m.select(key, F.col(pred).alias(pred), F.lit(i).alias("__member"))
        rows = part if rows is None else rows.unionByName(part)
    got = rows.groupBy(key).agg(F.avg(pred).alias(pred), F.count("*").alias("__n"), F.countDistinct("__member").alias("__d"))
    n = len(members)
    return got.select(key, F.when((F.col("__n") == n) & (F.col("__d") == n), F.col(pred)).otherwise(F.raise_error(F.lit("members don't have the same rows"))).alias(pred))


def align_categories(df: DataFrame, reference: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values that the reference lacks become null."""
    from .cells import cap_values

    for c in columns:
        df = cap_values(df, reference.select(c).filter(F.col(c).isNotNull()).distinct(), c, None)
    return df
