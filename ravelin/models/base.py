"""Regressors by name: single trees, the two-stage mixture, lines for rows without a plan, seed averages, windows.

A frame has an id, features, the target, `ms` (seconds from schedule to movement), `copied`, and `no_plan`. Trees are those of
`boosting`: nulls have a learned side, and all of a model's parts (classifier, regressors, seeds) are slots of one fit. Fitted
models are functions from frame to frame that add one column, so predictions stay lazy and are joined by nothing but the row
itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import cells, ordered, rules
from . import boosting
from .boosting import Slot


@dataclass(frozen=True)
class Config:
    model: str = "single"
    numeric: Sequence[str] = ()
    categorical: Sequence[str] = ()
    rounds: int = 20
    depth: int = 4
    rate: float = 0.2
    leaves: int = 15
    least_rows: int = 20
    #: What each tree sees of rows and features, drawn by the seed.
    row_share: float = 0.8
    feature_share: float = 0.8
    seed: int = 7
    target: str = "y"
    clip: float = 7200.0
    key: str = "airport"
    key_rows: int = 20_000
    line_rows: int = 50
    line_from: float = 7200.0
    weighting: str | None = None
    seeds: Sequence[int] = ()
    window: bool = False
    bins: int = 64
    #: Levels of keys, finest first, whose low quantile of the target is a feature, learned from the training table.
    reference: Sequence[Sequence[str]] = ()
    #: Called as report(slot, round, loss, valid loss) as rounds end.
    report: Callable[[int, int, float, float | None], None] | None = None


REFERENCE = "__ref"


@dataclass
class Prepared:
    """Features as bins: vocabularies are fixed, unseen values share a bin, null has its own, and reference cells are those of the
    training table, whatever table is prepared."""

    config: Config
    levels: Sequence[tuple[Sequence[str], DataFrame]] = ()
    binner: boosting.Binner | None = None

    def with_reference(self, df: DataFrame) -> DataFrame:
        return cells.fallback(df, self.levels, [REFERENCE], "") if self.levels else df

    def __call__(self, df: DataFrame) -> DataFrame:
        bins = boosting.bin_column(self.binner, boosted(self.config))
        return self.with_reference(df).withColumn("features", bins).drop(REFERENCE)


def _numeric(c: Config) -> list[str]:
    return [*c.numeric, *([REFERENCE] if c.reference else [])]


def boosted(c: Config) -> boosting.Params:
    return boosting.Params(_numeric(c), c.categorical, c.rounds, c.rate, c.leaves, c.depth, c.bins, least_rows=c.least_rows, row_share=c.row_share, feature_share=c.feature_share)


def vocabulary(frames: Sequence[DataFrame], column: str) -> DataFrame:
    """(column): every value that any of the frames has, each once."""
    out = frames[0].select(column)
    for f in frames[1:]:
        out = out.unionByName(f.select(column))
    return out.filter(F.col(column).isNotNull()).distinct()


def prepare(train: DataFrame, c: Config, others: Sequence[DataFrame] = ()) -> Prepared:
    """Reference cells and edges from the training table; vocabularies from it and the other frames that are to be predicted."""
    levels = [(list(k), cells.quantile_cells(train.filter(F.col(c.target).isNotNull()), list(k), c.target, out=REFERENCE)) for k in c.reference]
    ready = Prepared(c, levels)
    ready.binner = boosting.fit_bins(ready.with_reference(train), boosted(c), others)
    return ready


Predictor = Callable[[DataFrame, str], DataFrame]


def _seeds(c: Config) -> Sequence[int]:
    return c.seeds or (c.seed,)


def fit_slots(train: DataFrame, c: Config, slots: Sequence[Slot], others: Sequence[DataFrame] = ()) -> Callable[[DataFrame, str], DataFrame]:
    """The slots' models over one table; they add an array of their predictions."""
    prepared = prepare(train, c, others)
    models = boosting.fit(prepared.with_reference(train), boosted(c), slots, c.report, prepared.binner)
    return lambda df, out: prepared.with_reference(df).withColumn(out, models.column()).drop(REFERENCE)


def mean_of(array: str, places: Sequence[int]) -> Column:
    return sum((F.col(array)[i] for i in places[1:]), F.col(array)[places[0]]) / len(places)


def fit_single(train: DataFrame, c: Config) -> Predictor:
    """One boosted regressor on squared error, averaged over seeds."""
    models = fit_slots(train, c, [Slot(c.target, seed=s) for s in _seeds(c)])
    return lambda df, out: models(df, "__all").withColumn(out, mean_of("__all", range(len(_seeds(c))))).drop("__all")


def learning_curve(train: DataFrame, test: DataFrame, c: Config) -> list[tuple[int, float]]:
    """(rounds, squared error on the test rows) after each round of a single model, told by the fit as it goes."""
    prepared = prepare(train, c)
    columns = [*dict.fromkeys([*c.numeric, *c.categorical, *(k for level in c.reference for k in level), c.target])]
    both = train.select(*columns).withColumn("__test", F.lit(0.0)).unionByName(test.select(*columns).withColumn("__test", F.lit(1.0)))
    told: list[tuple[int, float]] = []
    boosting.fit(prepared.with_reference(both), boosted(c), [Slot(c.target, seed=c.seed, valid="__test")], lambda _, n, __, held: told.append((n, held)), prepared.binner)
    return told[1:]


def large_keys(df: DataFrame, c: Config) -> list:
    """Keys (airports) with rows enough for models of their own."""
    return sorted(r[0] for r in df.groupBy(c.key).count().filter((F.col("count") >= c.key_rows) & F.col(c.key).isNotNull()).collect())


def fit_two_stage(train: DataFrame, c: Config) -> Predictor:
    """P(copy of the schedule) and a regressor on the rest, mixed; airports with many rows also have regressors of their
    own, which count half. All of them, for all seeds, are fitted in the same passes."""
    rows = train.filter(F.col(c.target).isNotNull()).withColumn("__label", F.col("copied").cast("double"))
    if c.weighting:
        rows = rules.classifier_weight(rows, "ms", c.weighting, out="__weight")
    rows = rows.withColumn("__y", F.when(~F.col("copied"), F.least(F.lit(c.clip), F.greatest(F.lit(0.0), F.col(c.target)))))
    large = large_keys(rows.filter("__y IS NOT NULL"), c)
    rows = rows.withColumns({f"__k{i}": (F.col(c.key) == k).cast("double") for i, k in enumerate(large)})
    seeds = _seeds(c)
    slots = [Slot("__label", "__weight" if c.weighting else None, "logistic", s) for s in seeds] + [Slot("__y", seed=s) for s in seeds]
    slots += [Slot("__y", f"__k{i}", seed=s) for i in range(len(large)) for s in seeds]
    models, n = fit_slots(rows, c, slots), len(seeds)

    def predict(df: DataFrame, out: str) -> DataFrame:
        x, parts = models(df, "__all"), []
        for s in range(n):
            reg = F.col("__all")[n + s]
            for i, k in enumerate(large):
                reg = F.when(F.col(c.key) == k, (F.col("__all")[n + s] + F.col("__all")[2 * n + i * n + s]) / 2).otherwise(reg)
            parts.append(rules.mixture(F.col("__all")[s], F.col("ms"), reg))
        return x.withColumn(out, sum(parts[1:], parts[0]) / n).drop("__all")

    return predict


def fit_two_stage_lines(train: DataFrame, c: Config) -> Predictor:
    """Two-stage; rows without a plan and far from schedule take their airport's line, and don't train the trees."""
    no_plan = train.filter("no_plan")
    lines = cells.lines(no_plan, c.key, "ms", c.target, c.line_rows)
    known = lines.select(F.col(c.key).alias("__key")).filter("__key IS NOT NULL").withColumn("__has", F.lit(True))

    def marked(df: DataFrame) -> DataFrame:
        got = df.join(F.broadcast(known), F.col(c.key) == F.col("__key"), "left")  # one row for each airport
        return got.withColumn("__rule", rules.rule_rows(F.col("no_plan"), F.col("ms"), c.line_from, F.coalesce("__has", F.lit(False)))).drop("__key", "__has")

    base = fit_two_stage(marked(train).filter("NOT __rule").drop("__rule"), c)

    def predict(df: DataFrame, out: str) -> DataFrame:
        got = cells.apply_lines(marked(base(df, out)), lines, c.key, "ms", "__line")
        return got.withColumn(out, F.when(F.col("__rule"), F.col("__line")).otherwise(F.col(out))).drop("__rule", "__line")

    return predict


MODELS: dict[str, Callable[[DataFrame, Config], Predictor]] = {"single": fit_single, "two_stage": fit_two_stage, "two_stage_lines": fit_two_stage_lines}


def averaged(members: Sequence[Predictor]) -> Predictor:
    def predict(df: DataFrame, out: str) -> DataFrame:
        for i, m in enumerate(members):
            df = m(df, f"__m{i}")
        names = [f"__m{i}" for i in range(len(members))]
        return df.withColumn(out, sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)).drop(*names)

    return predict


def windowed(member: Predictor) -> Predictor:
    """Predictions moved into the window that the plan leaves."""
    low, high = rules.feasible_window(F.col("mvt_us"), F.col("lobt_us"))
    return lambda df, out: member(df, out).withColumn(out, rules.project(F.col(out), low, high))


def fit(train: DataFrame, c: Config) -> Predictor:
    """The configured model: by name, averaged over seeds if there are several, in a window if asked."""
    if c.model not in MODELS:
        raise KeyError(f"no such model: {c.model}")
    found = MODELS[c.model](train, c)
    return windowed(found) if c.window else found


def scaled(c: Config, factor: float = 1.2) -> Config:
    """More rounds for the last fit on all rows."""
    return replace(c, rounds=max(1, round(c.rounds * factor)))


@dataclass
class Ensemble:
    """A residual corrector, the mean of three: trees over all rows; trees per key where there are enough rows, those over all rows
    elsewhere; and trees that read categories as ordered statistics of the residual."""

    config: Config
    trees: Callable[[DataFrame, str], DataFrame] | None = None
    statistics: Predictor | None = None
    keys: list = field(default_factory=list)

    def fit(self, df: DataFrame, residual: str, weight: str | None = None) -> Ensemble:
        c = replace(self.config, target=residual)
        self.keys = large_keys(df, c)
        own = {f"__k{i}": F.when(F.col(c.key) == k, F.col(weight) if weight else F.lit(1.0)) for i, k in enumerate(self.keys)}
        self.trees = fit_slots(df.withColumns(own), c, [Slot(residual, weight, seed=c.seed), *(Slot(residual, k, seed=c.seed) for k in own)])
        self.statistics = fit_ordered(df, c, weight)
        return self

    def __call__(self, df: DataFrame, out: str) -> DataFrame:
        got = self.statistics(self.trees(df, "__all"), "__ordered")
        mine = F.col("__all")[0]  # a key that was not seen takes the trees over all rows
        for i, k in enumerate(self.keys):
            mine = F.when(F.col(self.config.key) == k, F.col("__all")[1 + i]).otherwise(mine)
        return got.withColumn(out, (F.col("__all")[0] + mine + F.col("__ordered")) / 3).drop("__all", "__ordered")


def fit_ordered(train: DataFrame, c: Config, weight: str | None = None) -> Predictor:
    """Trees that read each category as the mean target of the rows before in a random order, and of all rows where they predict."""
    rows = train.filter(F.col(c.target).isNotNull())
    draw = F.xxhash64(F.lit(c.seed), *[F.col(x) for x in dict.fromkeys([*c.numeric, *c.categorical, c.target])])
    encoder = ordered.Encoder.fit(rows, c.categorical, c.target)
    coded = encoder.earlier(rows.withColumn("__at", F.shiftrightunsigned(draw, 33)), "__at", 1 << 31)
    plain = replace(c, numeric=(*c.numeric, *encoder.names), categorical=(), seeds=())
    models = fit_slots(coded, plain, [Slot(c.target, weight, seed=c.seed)])
    return lambda df, out: models(encoder(df), "__one").withColumn(out, F.col("__one")[0]).drop("__one", *encoder.names)
