"""Ordered category statistics: a row's category as the mean target of the category's rows before it in a random order.

A model that learns from a category's mean target must not see its own row's target in it. In an order drawn for the rows, each
row sees the rows before it only; rows that are predicted see all. Means are drawn to the mean of all by `strength` rows of it.

Sums over what stands before are running sums in buckets of the order, to which the sums of the buckets before are added. So a
category with a third of all rows is spread over its buckets, and no window holds more than a bucket or a category's buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import materialise

#: Buckets that a category's rows are laid into.
BUCKETS = 1024


def earlier_sums(df: DataFrame, category: str, y: str, order: str, top: int, ties: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """df with __n and __s, the count and the sum of y over the category's rows before the row. order has numbers from 0 to before
    top, spread evenly; ties go by the columns in `ties`. Null is a category; a null y counts for no one."""
    spread = df.withColumn("__bucket", F.floor(F.col(order) * F.lit(buckets) / F.lit(top)).cast("int"))
    sums = spread.groupBy(F.col(category).alias("__c"), F.col("__bucket").alias("__b")).agg(F.count(y).alias("__bn"), F.sum(y).alias("__bs"))
    before = W.partitionBy("__c").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c, over: F.coalesce(F.sum(c).over(over), F.lit(0))
    sums = sums.select("__c", "__b", zero("__bn", before).alias("__en"), zero("__bs", before).alias("__es"))
    inner = W.partitionBy(category, "__bucket").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, -1)
    counted = spread.withColumns({"__in": zero(F.when(F.col(y).isNotNull(), 1), inner), "__is": zero(y, inner)})
    got = counted.join(sums, F.col(category).eqNullSafe(F.col("__c")) & (F.col("__bucket") == F.col("__b")))
    return got.withColumns({"__n": F.col("__en") + F.col("__in"), "__s": F.col("__es") + F.col("__is")}).drop("__bucket", "__b", "__c", "__en", "__es", "__in", "__is")


def shrunk(s: Column, n: Column, prior: float, strength: float) -> Column:
    return (F.coalesce(s, F.lit(0.0)) + strength * prior) / (F.coalesce(n, F.lit(0)) + strength)


@dataclass
class Encoder:
    """Statistics of some categories, learned from a table."""

    categories: Sequence[str]
    target: str
    prior: float
    strength: float
    whole: dict[str, DataFrame]

    @property
    def names(self) -> list[str]:
        return [f"__o_{c}" for c in self.categories]

    @classmethod
    def fit(cls, df: DataFrame, categories: Sequence[str], target: str, strength: float = 10.0) -> Encoder:
        prior = df.agg(F.avg(target)).first()[0] or 0.0
        whole = {c: materialise(df.groupBy(F.col(c).alias("__c")).agg(F.count(target).alias("__n"), F.sum(target).alias("__s")), "whole") for c in categories}
        return cls(categories, target, prior, strength, whole)

    def __call__(self, df: DataFrame) -> DataFrame:
        """df with each category's mean over all rows learned from; an unseen value has the mean of all."""
        for c, name in zip(self.categories, self.names, strict=True):
            got = df.join(self.whole[c], F.col(c).eqNullSafe(F.col("__c")), "left")
            df = got.withColumn(name, shrunk(F.col("__s"), F.col("__n"), self.prior, self.strength)).drop("__c", "__n", "__s")
        return df

    def earlier(self, df: DataFrame, order: str, top: int, ties: Sequence[str] = ()) -> DataFrame:
        """The rows learned from, with each category's mean over the rows before."""
        for c, name in zip(self.categories, self.names, strict=True):
            got = earlier_sums(df, c, self.target, order, top, ties)
            df = got.withColumn(name, shrunk(F.col("__s"), F.col("__n"), self.prior, self.strength)).drop("__n", "__s")
        return df
