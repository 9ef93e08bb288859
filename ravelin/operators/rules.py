"""Rule columns: labels, weights, feasible windows, mixtures and ordered post-rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def copied(block_us: Column, sched_us: Column, tolerance_s: int = 60) -> Column:
    """Whether the block time is a copy of the schedule; null is no copy."""
    return F.coalesce(F.abs(block_us - sched_us) <= tolerance_s * 1_000_000, F.lit(False))


def mixture(p: Column, ms: Column, reg: Column) -> Column:
    """p * ms + (1 - p) * reg, reg where ms is null, not below 0."""
    x = F.when(ms.isNull(), reg).otherwise(p * ms + (1 - p) * reg)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def classifier_weight(df: DataFrame, ms: str, kind: str = "abs", centre: float = 900.0, least: float = 60.0, out: str = "weight") -> DataFrame:
    """Weight |ms - centre|, at least `least`, or its square; null is 0; the positive weights' mean is 1."""
    if kind not in ("abs", "quad"):
        raise ValueError(kind)
    d = F.greatest(F.abs(F.col(ms) - centre), F.lit(least))
    raw = F.when(F.col(ms).isNull(), 0.0).otherwise(d if kind == "abs" else d * d)
    rows = df.withColumn("__w", raw)
    mean = rows.agg(F.avg(F.when(F.col("__w") > 0, F.col("__w"))).alias("__mean"))
    return rows.join(F.broadcast(mean)).withColumn(out, F.col("__w") / F.coalesce("__mean", F.lit(1.0))).drop("__w", "__mean")  # one row


def feasible_window(mvt_us: Column, lobt_us: Column, half_s: int = 3606) -> tuple[Column, Column]:
    """Bounds in seconds around the plan; null (no bound) without a plan."""
    middle = (mvt_us - lobt_us) / 1_000_000
    return middle - half_s, middle + half_s


def project(pred: Column, low: Column, high: Column) -> Column:
    """pred moved into [low, high], null bounds ignored, and not below 0."""
    return F.when(pred.isNotNull(), F.greatest(F.lit(0.0), F.least(high, F.greatest(low, pred))))


def edge_distances(pred: Column, low: Column, high: Column) -> dict[str, Column]:
    """How far a prediction lies above the window's lower edge and below its upper one."""
    return {"dist_low": pred - low, "dist_high": high - pred}


def copy_possible(p: Column, ms: Column, low: Column, high: Column) -> Column:
    """p, or 0 where the schedule lies outside of the window."""
    return F.when((ms < low) | (ms > high), F.lit(0.0)).otherwise(p)


def rule_rows(no_plan: Column, ms: Column, threshold: float, has_line: Column) -> Column:
    return F.coalesce(no_plan & (ms > threshold) & has_line, F.lit(False))


def between_rows(no_plan: Column, ms: Column, airport: Column, code: str, low_h: float = 15, high_h: float = 30) -> Column:
    """Rows of one airport without a plan whose schedule lies low_h (exclusive) to high_h hours back."""
    return F.coalesce(no_plan & (airport == code) & (ms > low_h * 3600) & (ms <= high_h * 3600), F.lit(False))


POST_RULES: dict[str, Callable[[Column, Column], Column]] = {}


def post_rule(name: str):
    def add(f):
        POST_RULES[name] = f
        return f

    return add


@post_rule("late_line")
def _late_line(rows: Column, ms: Column) -> Column:
    """A fixed line for the rows of between_rows()."""
    return F.when(rows, 54310.76 + 0.38 * ms)


def apply_rules(pred: Column, rules: Sequence[str], rows: Column, ms: Column) -> Column:
    """The rules in order; each replaces the value where it applies. An unknown rule is an error."""
    for name in rules:
        if name not in POST_RULES:
            raise KeyError(f"no such rule: {name}")
        pred = F.coalesce(POST_RULES[name](rows, ms), pred)
    return pred


def near_plan(y: Column, refs: Sequence[Column], within_s: float = 300) -> Column:
    """Whether a value is within so many seconds of any reference; nulls are not."""
    out = F.lit(False)
    for r in refs:
        out = out | F.coalesce(F.abs(y - r) <= within_s, F.lit(False))
    return out


def lottery(y: Column, refs: Sequence[Column], above_s: float = 3 * 3600) -> Column:
    return F.coalesce(y > above_s, F.lit(False)) & ~near_plan(y, refs)


def plan_distances(pred: Column, refs: dict[str, Column]) -> dict[str, Column]:
    """pred - ref for each reference, the least absolute distance, the number of references, and of those over an hour."""
    every = F.array(*refs.values())
    return {f"dist_{n}": pred - r for n, r in refs.items()} | {
        "dist_min": F.array_min(F.transform(every, lambda r: F.abs(pred - r))),
        "dist_n": F.size(F.filter(every, lambda r: r.isNotNull())),
        "dist_over_hour": F.size(F.filter(every, lambda r: r > 3600)),
    }


def final_value(base: Column, correction: Column, rule: Column, low: Column, high: Column) -> Column:
    """The base on rule rows, else base plus correction, moved into the window."""
    return F.when(rule, base).otherwise(project(base + F.coalesce(correction, F.lit(0.0)), low, high))
