"""Cross-fitting: out-of-fold predictions, the residual corrector on them, pseudo-labels, drift, and the last fit."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import evaluation
from ..operators import autofeatures, cells, rules
from . import boosting
from .base import Config, Ensemble, Predictor, averaged, boosted, fit, fit_slots, scaled
from .boosting import Slot

#: Fits that run at once. Their jobs share the executors; a fair scheduler (spark.scheduler.mode) gives each its turn.
AT_ONCE = 4


def side_by_side(spark, work: Sequence[Callable[[], object]], at_once: int = AT_ONCE) -> list:
    """The results of functions that run Spark jobs, some at a time, each in a pool of its own with the caller's local properties."""

    def pooled(i: int, f: Callable[[], object]):
        def run():
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit{i % at_once}")
            return f()

        return inheritable_thread_target(spark)(run)

    if len(work) < 2 or at_once < 2:
        return [f() for f in work]
    with ThreadPoolExecutor(at_once) as threads:
        return [t.result() for t in [threads.submit(pooled(i, f)) for i, f in enumerate(work)]]


def month_blocks(month: str, size: int = 2):
    """Blocks of neighbouring months."""
    return F.floor((F.col(month) - 1) / size).cast("int")


def blocks_of(df: DataFrame, block: str) -> list:
    return [r[0] for r in df.select(block).distinct().orderBy(block).collect()]  # a dozen


def _folds(df: DataFrame, block: str, c: Config, out: str, save: Callable[[DataFrame], DataFrame], blind: Callable[[DataFrame], DataFrame]) -> list[Callable[[], DataFrame]]:
    def one(b) -> Callable[[], DataFrame]:
        return lambda: save(fit(df.filter(F.col(block) != b), c)(blind(df.filter(F.col(block) == b)), out))

    return [one(b) for b in blocks_of(df, block)]


def out_of_fold(df: DataFrame, block: str, c: Config, out: str, save: Callable[[DataFrame], DataFrame], blind: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Each block's rows, as blind() shows them, predicted by a model of all other blocks. save() keeps the result, since
    as many models stand behind it as there are blocks."""
    return _union(side_by_side(df.sparkSession, _folds(df, block, c, out, save, blind)))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def correct(df: DataFrame, base: str, c: Config, weight: str | None = None, skip: str | None = None) -> Ensemble:
    """The corrector of target - base, learned from rows that no rule decides."""
    rows = df.filter(~F.col(skip)) if skip else df
    return Ensemble(c).fit(rows.withColumn("__res", F.col(c.target) - F.col(base)), "__res", weight)


def corrected(model: Predictor, df: DataFrame, base: str, out: str, rule: str | None = None, window: bool = True) -> DataFrame:
    """Base plus correction in the window; rule rows keep the base."""
    low, high = rules.feasible_window(F.col("mvt_us"), F.col("lobt_us"))
    none = F.lit(None).cast("double")
    got = model(df, "__cor")
    value = rules.final_value(F.col(base), F.col("__cor"), F.col(rule) if rule else F.lit(False), low if window else none, high if window else none)
    return got.withColumn(out, value).drop("__cor")


def out_of_fold_correction(df: DataFrame, day: str, base: str, c: Config, k: int, out: str, save) -> DataFrame:
    """Days dealt to k folds; each fold corrected by a corrector of the others."""
    rows = cells.day_folds(df, day, k, "__fold")

    def one(f: int) -> Callable[[], DataFrame]:
        return lambda: save(corrected(correct(rows.filter(F.col("__fold") != f), base, c), rows.filter(F.col("__fold") == f), base, out).drop("__fold"))

    return _union(side_by_side(df.sparkSession, [one(f) for f in range(k)]))


def simulate(df: DataFrame, holdout: DataFrame, block: str, c: Config, corrector: Config, save) -> DataFrame:
    """The whole: out-of-fold base, corrector on it, base on the holdout, corrected holdout (columns base and pred)."""
    *parts, whole = side_by_side(df.sparkSession, [*_folds(df, block, c, "base", save, lambda d: d), lambda: fit(df, c)])
    model = correct(_union(parts), "base", corrector)
    return corrected(model, whole(holdout, "base"), "base", "pred")


def body(df: DataFrame, pseudo: str, base: str, rule: str, cut: float) -> DataFrame:
    """Rows that may serve as pseudo-labelled: with a plan, decided by no rule, and not moved further than cut."""
    return df.filter(~F.col("no_plan") & ~F.col(rule) & (F.abs(F.col(pseudo) - F.col(base)) <= cut))


def with_pseudo(train: DataFrame, extra: DataFrame, vocabularies: Sequence[str], weight: float = 0.3) -> DataFrame:
    """Labelled rows with weight 1 and pseudo-labelled ones with less; categories that training lacks become null."""
    for column in vocabularies:
        extra = cells.cap_values(extra, train.select(column).filter(F.col(column).isNotNull()).distinct(), column, None)
    return train.withColumn("weight", F.lit(1.0)).unionByName(extra.withColumn("weight", F.lit(weight)), allowMissingColumns=True)


def adversarial(old: DataFrame, new: DataFrame, key: str, c: Config, save) -> tuple[DataFrame, DataFrame]:
    """((key, w) for the old rows, one row with the AUC): how far old rows look like new ones, by a classifier in two folds."""
    rows = old.withColumn("__new", F.lit(0.0)).unionByName(new.withColumn("__new", F.lit(1.0)), allowMissingColumns=True).withColumn("__fold", F.pmod(F.xxhash64(key), F.lit(2)))
    rows = rows.withColumns({f"__w{f}": (F.col("__fold") != f).cast("double") for f in (0, 1)})
    models = fit_slots(rows, c, [Slot("__new", f"__w{f}", "logistic", c.seed) for f in (0, 1)])
    scored = save(models(rows, "__all").select(key, "__new", F.when(F.col("__fold") == 0, F.col("__all")[0]).otherwise(F.col("__all")[1]).alias("p")))
    return evaluation.importance_weights(scored.filter("__new = 0"), "p").select(key, "w"), evaluation.auc(scored, "__new", "p")


def last_fit(df: DataFrame, configs: Sequence[Config], post_rules: Sequence[str] = (), rule_rows: Column | None = None, ms: str = "ms") -> Predictor:
    """Each base on all rows with more rounds, averaged; equal bases are fitted once. Post-rules then decide the rows that are
    theirs, in their order."""
    mean = averaged([fit(df, scaled(c)) for c in dict.fromkeys(configs)])
    if not post_rules:
        return mean
    return lambda rows, out: mean(rows, out).withColumn(out, rules.apply_rules(F.col(out), post_rules, rule_rows, F.col(ms)))


def rest_model(df: DataFrame, total: str, known: str, c: Config, out: str) -> Predictor:
    """A model of total - known, given back as known + prediction (one airport's decomposition of taxi time)."""
    inner = fit(df.withColumn("__rest", F.col(total) - F.col(known)), replace(c, target="__rest", model="single"))
    return lambda rows, name=out: inner(rows, name).withColumn(name, F.col(known) + F.col(name))


def _screened(df: DataFrame, features: Sequence[str], base: Config, residual: str, block: str, new: DataFrame | None = None) -> tuple[dict[str, float], dict[str, float]]:
    """({feature: what it alone gains in RMSE on the last block, learned from the others}, {feature: how well it tells new rows from
    old ones}). Rows are read once, whatever the number of features: models and errors follow from counts and sums by bin."""
    held = blocks_of(df, block)[-1]
    p = replace(boosted(replace(base, numeric=tuple(features), categorical=(), reference=())), row_share=1.0, feature_share=1.0)
    rows = df.select(*features, F.col(residual).alias("__r"), F.when(F.col(block) == held, 1).when(F.col(block).isNotNull(), 0).alias("__part"))
    if new is not None:
        rows = rows.unionByName(new.select(*features, F.lit(None).cast("double").alias("__r"), F.lit(2).alias("__part")))
    sums = boosting.bin_sums(rows.filter("__r IS NOT NULL OR __part = 2"), p, "__r", "__part", 3, boosting.fit_bins(rows.filter("__part <> 1"), p))
    gains, drifts, total = {}, {}, sums.n[1, 0].sum() if features else 0.0
    for i, f in enumerate(features):
        pred = boosting.boost_on_bins(sums.n[0, i], sums.s[0, i], p)
        less = float((2 * pred * sums.s[1, i] - pred**2 * sums.n[1, i]).sum())
        gains[f] = float(np.sqrt(sums.squares[1] / total) - np.sqrt(max(sums.squares[1] - less, 0.0) / total)) if total else 0.0
        old, fresh = sums.n[:2, i, 1:].sum(axis=0), sums.n[2, i, 1:]  # nulls have no place in the order
        both = old.sum() * fresh.sum()
        area = float((fresh * (np.cumsum(old) - old / 2)).sum() / both) if both else 0.5
        drifts[f] = max(area, 1 - area)
    return gains, drifts


def screen(df: DataFrame, features: Sequence[str], base: Config, residual: str, block: str) -> list[tuple[str, float]]:
    """What each feature alone gains on the residual of the last block, learned from the others; best first."""
    gains, _ = _screened(df, features, base, residual, block)
    return sorted(gains.items(), key=lambda x: (-x[1], x[0]))


@dataclass(frozen=True)
class Screened:
    feature: str
    gain: float
    drift: float  # how well the feature alone tells the new rows from the old, 0.5 if not at all
    chosen: bool


def screen_with_gates(df: DataFrame, new: DataFrame, features: Sequence[str], base: Config, residual: str, block: str, key: str, save, placebos: int = 2, most_drift: float = 0.9) -> list[Screened]:
    """screen(), with two gates: a feature must gain more than any of some placebos (its values dealt to other rows), and must
    not tell the new rows from the old ones better than most_drift (an area under the curve, with ties in a bin)."""
    fakes = []
    for n in range(placebos):
        df = save(autofeatures.placebo(df, features[n % len(features)], key, n, f"__placebo{n}"))
        fakes.append(f"__placebo{n}")
    gains, drifts = _screened(df, [*features, *fakes], base, residual, block, new.withColumns({f: F.lit(None).cast("double") for f in fakes}))
    band = max([0.0, *(gains[f] for f in fakes)])
    return [Screened(f, gains[f], drifts[f], gains[f] > band and drifts[f] <= most_drift) for f in sorted(features, key=lambda f: (-gains[f], f))]
