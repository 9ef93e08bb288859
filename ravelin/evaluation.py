"""Evaluation: sliced errors, paired bootstrap by day, exact gain decomposition, rank statistics and gates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .operators.cells import _null_safe, exact_quantiles, value_counts, value_ranks


def rmse(error: Column) -> Column:
    return F.sqrt(F.avg(error * error))


def sliced_rmse(df: DataFrame, y: str, pred: str, slices: dict[str, Column], by: str | None = None) -> DataFrame:
    """One row (slice, rmse, n) for each slice and, with `by`, for each of its values; one pass for the slices."""
    e = F.col(pred) - F.col(y)
    parts = df.agg(*[F.struct(rmse(F.when(m, e)).alias("rmse"), F.count(F.when(m, e)).alias("n")).alias(name) for name, m in slices.items()])
    out = parts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("slice"), F.col(n)["rmse"].alias("rmse"), F.col(n)["n"].alias("n")) for n in slices])).alias("s")).select("s.*")
    if by:
        out = out.unionByName(df.groupBy(F.concat(F.lit(f"{by}="), F.col(by)).alias("slice")).agg(rmse(e).alias("rmse"), F.count(e).alias("n")))
    return out


def day_sums(df: DataFrame, y: str, base: str, new: str, day: str, extra: Sequence[str] = ()) -> DataFrame:
    """Per day: rows and the two sums of squared errors; all that the bootstrap needs."""
    sq = lambda c: F.sum((F.col(c) - F.col(y)) ** 2)
    return df.groupBy(day, *extra).agg(F.count("*").alias("n"), sq(base).alias("sse_base"), sq(new).alias("sse_new"))


@dataclass(frozen=True)
class Gain:
    gain: float
    low: float
    high: float
    days: int


def hashed_draw(seed: int) -> Callable[[Column, Column, Column], Column]:
    """Which of k days is the j-th of a draw, by a hash of the seed, the draw and j."""
    return lambda draw, j, k: F.pmod(F.xxhash64(F.lit(seed), draw, j), k)


def bootstrap(df: DataFrame, y: str, base: str, new: str, day: str, by: Sequence[str] = (), mask: Column | None = None, weight: str | None = None, draws: int = 1000, pick: Callable | None = None) -> DataFrame:
    """(by, gain, low, high, days): the gain in (weighted) RMSE, or the part of it that the rows under the mask make, with a 95 %
    interval over days drawn with replacement; all groups in one plan.

    Rows are summed up by day first. A draw is a list of day numbers; `pick` tells the j-th of a draw among k."""
    pick = pick or hashed_draw(0)
    w = F.col(weight) if weight else F.lit(1.0)
    rows = contributions(df, y, base, new, weight).withColumn("__d", F.col("gain_sq") if mask is None else F.when(mask, F.col("gain_sq")).otherwise(0.0))
    sums = rows.groupBy(*by, day).agg(F.sum(w).alias("__w"), F.sum(w * (F.col(base) - F.col(y)) ** 2).alias("__b"), F.sum(w * (F.col(new) - F.col(y)) ** 2).alias("__n"), F.sum("__d").alias("__d"))
    parts = ("__w", "__b", "__n", "__d")
    closed = lambda w, b, n, d: d / w / (F.sqrt(b / w) + F.sqrt(n / w))
    whole = W.partitionBy(*by)
    numbered = sums.withColumns({"__i": F.row_number().over(whole.orderBy(day)) - 1, "__k": F.count("*").over(whole)})
    each = numbered.groupBy(*by, "__k").agg(*[F.sum(p).alias(p) for p in parts])
    drawn = each.select(*by, "__k", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("__draw"))
    drawn = drawn.withColumn("__j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__k") - 1))).withColumn("__i", pick(F.col("__draw"), F.col("__j"), F.col("__k")).cast("int"))
    got = _null_safe(drawn.drop("__k"), numbered.select(*by, "__i", *parts), [*by, "__i"]).groupBy(*by, "__draw").agg(closed(*[F.sum(p) for p in parts]).alias("__g"))
    bounds = got.groupBy(*by).agg(F.percentile("__g", 0.025).alias("low"), F.percentile("__g", 0.975).alias("high"))  # `draws` values a group
    point = each.select(*by, closed(*[F.col(p) for p in parts]).alias("gain"), F.col("__k").alias("days"))
    if by:
        return _null_safe(point, bounds, list(by)).select(*by, "gain", "low", "high", "days")
    both = bounds.select(F.struct("low", "high")).scalar()
    return point.select("gain", both["low"].alias("low"), both["high"].alias("high"), "days")


def as_gain(row) -> Gain:
    return Gain(row["gain"], row["low"], row["high"], row["days"])


def paired_bootstrap(df: DataFrame, y: str, base: str, new: str, day: str, draws: int = 1000, seed: int = 0) -> Gain:
    """RMSE(base) - RMSE(new) with a 95 % interval."""
    rows = bootstrap(df, y, base, new, day, draws=draws, pick=hashed_draw(seed)).collect()
    return as_gain(rows[0]) if rows else Gain(float("nan"), float("nan"), float("nan"), 0)


def bootstrap_by(df: DataFrame, y: str, base: str, new: str, day: str, group: str, draws: int = 1000, seed: int = 0) -> dict[str, Gain]:
    """The same for each value of a column: one job, and a row for each comes back."""
    rows = bootstrap(df, y, base, new, day, [group], draws=draws, pick=hashed_draw(seed)).orderBy(group).collect()
    return {r[group]: as_gain(r) for r in rows}


def contributions(df: DataFrame, y: str, base: str, new: str, weight: str | None = None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1.0)
    return df.withColumn("gain_sq", w * ((F.col(base) - F.col(y)) ** 2 - (F.col(new) - F.col(y)) ** 2))


def top_gains(df: DataFrame, k: int, tie: str) -> DataFrame:
    """The k rows that contribute most."""
    return df.orderBy(F.desc("gain_sq"), tie).limit(k)


def gain_without_top(df: DataFrame, y: str, base: str, new: str, k: int, tie: str) -> DataFrame:
    """One row: the gain without the k rows that contribute most."""
    rows = contributions(df, y, base, new)
    rest = rows.join(F.broadcast(top_gains(rows, k, tie).select(F.col(tie).alias("__t"))), F.col(tie) == F.col("__t"), "left_anti")  # k rows
    return rest.agg((rmse(F.col(base) - F.col(y)) - rmse(F.col(new) - F.col(y))).alias("gain"), F.count("*").alias("n"))


def share_of_top(df: DataFrame, y: str, base: str, new: str, k: int, tie: str, weight: str | None = None) -> DataFrame:
    """One row: what part of the whole squared gain the top k rows make."""
    rows = contributions(df, y, base, new, weight)
    top = top_gains(rows, k, tie).agg(F.sum("gain_sq").alias("top"))
    return rows.agg(F.sum("gain_sq").alias("whole")).join(top).select(F.try_divide("top", "whole").alias("share"))


def gain_decomposition(df: DataFrame, y: str, base: str, new: str, masks: dict[str, Column], weight: str | None = None) -> DataFrame:
    """(part, gain): parts that add up exactly to the gain in (weighted) RMSE, which is the row 'all'.

    sqrt(B/W) - sqrt(N/W) = (B - N) / (W * (sqrt(B/W) + sqrt(N/W))), and B - N is a sum over rows."""
    w = F.col(weight) if weight else F.lit(1.0)
    rows = contributions(df, y, base, new, weight)
    whole = rows.agg(F.sum(w).alias("w"), F.sum(w * (F.col(base) - F.col(y)) ** 2).alias("b"), F.sum(w * (F.col(new) - F.col(y)) ** 2).alias("n"), *[F.sum(F.when(m, F.col("gain_sq")).otherwise(0.0)).alias(f"p_{k}") for k, m in masks.items()])
    scale = F.col("w") * (F.sqrt(F.col("b") / F.col("w")) + F.sqrt(F.col("n") / F.col("w")))
    items = [F.struct(F.lit("all").alias("part"), ((F.col("b") - F.col("n")) / scale).alias("gain")), *[F.struct(F.lit(k).alias("part"), (F.col(f"p_{k}") / scale).alias("gain")) for k in masks]]
    return whole.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: the area under the curve by rank sums, ties at average ranks. Distinct scores are ranked range by range, so no
    task sorts all rows."""
    rows = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).select(F.col(score).alias("s"), F.col(label).cast("double").alias("l"))
    ranks = value_ranks(rows, [], "s")
    hits = rows.groupBy("s").agg(F.sum("l").alias("pos"))
    total = ranks.join(hits, "s").agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p1"), F.sum(F.col("n") - F.col("pos")).alias("p0"))
    return total.select(F.try_divide(F.col("r") - F.col("p1") * (F.col("p1") + 1) / 2, F.col("p1") * F.col("p0")).alias("auc"))


def importance_weights(df: DataFrame, p: str, q: float = 0.95, out: str = "w") -> DataFrame:
    """p / (1 - p), clipped at its quantile, with mean 1."""
    rows = df.withColumn("__r", F.try_divide(F.col(p), 1 - F.col(p)))
    top = exact_quantiles(value_counts(rows, [], "__r"), [], "__r", {"__top": q}).select("__top").scalar()
    rows = rows.withColumn("__r", F.least(F.col("__r"), top))
    return rows.withColumn(out, F.col("__r") / rows.agg(F.avg("__r")).scalar()).drop("__r")


def ceiling_gain(df: DataFrame, y: str, base: str, oracle: str, n_total: int, rmse_total: float) -> DataFrame:
    """What the whole's RMSE would gain if these rows had the oracle's error instead of the base's."""
    s = df.agg(F.sum((F.col(base) - F.col(y)) ** 2).alias("b"), F.sum((F.col(oracle) - F.col(y)) ** 2).alias("o"))
    return s.select((F.lit(rmse_total) - F.sqrt(F.greatest(F.lit(0.0), F.lit(rmse_total**2) - (F.col("b") - F.col("o")) / n_total))).alias("gain"))


# Gates


def verdict(all_rows: Gain, without_top: float, months: Sequence[Gain], least: float = 10.0) -> str:
    """better, fragile or unproven."""
    if all_rows.gain < least or not all_rows.low > 0:
        return "unproven"
    return "better" if without_top > 0 and all(m.gain > 0 for m in months) else "fragile"


def halves(days: Sequence, seed: int = 0) -> dict:
    """Days, shuffled by a seed, dealt in turn to halves A and B."""
    order = np.random.default_rng(seed).permutation(len(days))
    return {sorted(days)[i]: "AB"[k % 2] for k, i in enumerate(order)}


def halves_gate(a: Gain, b: Gain, every: Gain, full: float, least: float = 0.3, drop: float = -0.5) -> bool:
    """Chosen on A, confirmed on B, sure over all days, and no loss on everything."""
    return a.gain >= least and a.low > 0 and b.gain > 0 and every.low > 0 and full >= drop


def transfer_gate(body: Gain, top_share: float, weighted_body: float) -> bool:
    return body.gain > 0 and body.low > 0 and top_share < 2.0 and weighted_body > 0
