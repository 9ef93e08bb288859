"""An algebra of automatic features: specifications, their names, their Columns, and candidates to screen."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cells import EPS, _null_safe, group_stats, value_ranks

Spec = tuple
PAIRWISE = {"ratio": lambda a, b: F.when(F.abs(b) > EPS, a / b), "diff": lambda a, b: a - b, "prod": lambda a, b: a * b}
#: Group statistics of a column; cmean and rsd are those of the group against those of all, which stay put when a level drifts.
GROUPED = ("mean", "sd", "dev", "z", "pos", "count", "cmean", "rsd")


def name(spec: Spec) -> str:
    kind, a, b = spec
    return f"fe_{kind}__{a}__{b if isinstance(b, str) else '_'.join(b)}"


def column(spec: Spec) -> Column:
    """The Column of a specification (kind, a, b) over a frame that with_stats() made: a pairwise kind of two columns, or a grouped
    kind of a column and keys."""
    kind, a, b = spec
    x = F.col(a)
    if kind in PAIRWISE:
        return PAIRWISE[kind](x, F.col(b))
    if kind not in GROUPED:
        raise KeyError(kind)
    of = lambda s: F.col(f"__{s}_{a}__{'_'.join(b)}")
    every = lambda s: F.col(f"__every.__{s}_{a}")
    if kind == "pos":
        return F.when(x.isNotNull(), F.try_divide(of("p"), of("n")))
    return {
        "mean": lambda: of("m"), "sd": lambda: of("s"), "count": lambda: of("n"), "dev": lambda: x - of("m"), "z": lambda: F.when(of("s") > EPS, (x - of("m")) / of("s")),
        "cmean": lambda: of("m") - every("m"), "rsd": lambda: F.when(every("s") > EPS, of("s") / every("s")),
    }[kind]()


def with_stats(df: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """df with what its grouped specifications need: one aggregate and one join for each set of keys, ranks by ranges, one row for
    the whole. No group is gathered in a task."""
    grouped = [s for s in specs if s[0] not in PAIRWISE]
    for keys in dict.fromkeys(tuple(b) for _, _, b in grouped):
        tag = "_".join(keys)
        xs = list(dict.fromkeys(a for _, a, b in grouped if tuple(b) == keys))
        stats = group_stats(df, xs, keys).drop("r_")
        df = _null_safe(df, stats.withColumnsRenamed({f"{s}_{x}": f"__{s}_{x}__{tag}" for x in xs for s in "msn"}), list(keys))
        for x in dict.fromkeys(a for kind, a, b in grouped if kind == "pos" and tuple(b) == keys):
            ranks = value_ranks(df.select(*keys, x), keys, x).select(*keys, x, F.col("rank").alias(f"__p_{x}__{tag}"))
            df = _null_safe(df, ranks, [*keys, x])
    if whole := list(dict.fromkeys(a for kind, a, _ in grouped if kind in ("cmean", "rsd"))):
        every = df.agg(F.struct(*[a for x in whole for a in (F.avg(x).alias(f"__m_{x}"), F.stddev_pop(x).alias(f"__s_{x}"))])).scalar()
        df = df.withColumn("__every", every)
    return df


def candidates(numeric: Sequence[str], keys: Sequence[Sequence[str]], pairs: bool = True) -> list[Spec]:
    """All pairwise specifications of the numeric columns and all grouped ones, without repeats."""
    out: list[Spec] = []
    if pairs:
        for a, b in combinations(numeric, 2):
            out += [(kind, a, b) for kind in PAIRWISE]
    for x in numeric:
        for key in keys:
            out += [(kind, x, tuple(key)) for kind in GROUPED if kind != "count"]
    return out + [("count", numeric[0], tuple(k)) for k in keys] if numeric else out


def add_features(df: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """df with the columns of the specifications."""
    return with_stats(df, specs).select(*df.columns, *[column(s).alias(name(s)) for s in specs])


def correlation_screen(df: DataFrame, specs: Sequence[Spec], target: str) -> DataFrame:
    """(feature, r, n) for each candidate in one pass over the featured table."""
    rows = add_features(df, specs)
    aggs = []
    for s in specs:
        x, both = F.col(name(s)), F.col(name(s)).isNotNull() & F.col(target).isNotNull()
        a, b = F.when(both, x), F.when(both, F.col(target))
        r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))  # null for a constant, where corr() fails
        aggs.append(F.struct(r.alias("r"), F.count(F.when(both, 1)).alias("n")).alias(name(s)))
    one = rows.agg(*aggs)
    items = [F.struct(F.lit(name(s)).alias("feature"), F.col(name(s))["r"].alias("r"), F.col(name(s))["n"].alias("n")) for s in specs]
    return one.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def survivors(scores: DataFrame, placebo: float, drift: DataFrame | None, most_drift: float, k: int) -> DataFrame:
    """Candidates above the placebo band and below the drift limit, best first."""
    got = scores.filter(F.abs("r") > placebo)
    if drift is not None:
        got = got.join(drift, "feature").filter(F.col("auc") <= most_drift)
    return got.orderBy(F.desc(F.abs("r")), "feature").limit(k)


def sample_by_hash(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows without replacement, the same for the same seed: those with the smallest hash."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(k)


def placebo(df: DataFrame, column_name: str, key: str, seed: int, out: str) -> DataFrame:
    """A column's values dealt to other rows: both sides are numbered, range by range, in orders that a hash gives."""
    h = lambda s: F.xxhash64(F.lit(s), F.col(key))
    parts = 64
    a = df.select(key, h(seed).alias("h")).withColumn("p", F.pmod("h", F.lit(parts)))
    b = df.select(F.col(column_name).alias(out), h(seed + 1).alias("h2"), F.pmod(h(seed), F.lit(parts)).alias("p"))
    left = a.withColumn("r", F.row_number().over(W.partitionBy("p").orderBy("h", key))).select(key, "p", "r")
    right = b.withColumn("r", F.row_number().over(W.partitionBy("p").orderBy("h2"))).select("p", "r", out)
    return df.join(left.join(right, ["p", "r"]).select(key, out), key)
