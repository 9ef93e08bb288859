"""Hierarchical cells: aggregates per key, coarser keys where a cell is thin, leave-own-block-out, shrunk rates, lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import materialise

#: Deviations and divisors of this size or less divide nothing.
EPS = 1e-6


def value_counts(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """(keys, x, n): how often each value stands in each group; nulls and null keys are left out."""
    return df.select(*keys, x).dropna().groupBy(*keys, x).agg(F.count("*").alias("n"))


def _octave(x: str) -> Column:
    """The range of a value, a sixteenth of an octave. Never null, so that a join on it adds no filter that Catalyst would push to
    the scan, with all that the value is computed from."""
    v = F.col(x).cast("double")
    return F.coalesce(F.floor(F.signum(v) * F.log2(1 + F.abs(v)) * 16), F.lit(0).cast("long"))


def exact_quantiles(counts: DataFrame, keys: Sequence[str], x: str, qs: dict[str, float], n: str = "n") -> DataFrame:
    """(keys, total, and for each name in qs the quantile, interpolated, and name_rows, how many rows are not above it), from (keys,
    x, n) with each value of a group once.

    Values are laid into ranges of a sixteenth of an octave; running totals of the ranges tell which of them hold a quantile,
    and only their values are put in order. So no task holds a group's values, whatever its size."""
    laid = counts.filter(F.col(x).isNotNull()).withColumn("__p", _octave(x))
    ranges = laid.groupBy(*keys, "__p").agg(F.sum(n).alias("__pn"))
    earlier = W.partitionBy(*keys).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select(*keys, "__p", "__pn", F.coalesce(F.sum("__pn").over(earlier), F.lit(0)).alias("__before"), F.sum("__pn").over(W.partitionBy(*keys)).alias("total"))
    at = {name: q * (F.col("total") - 1) for name, q in qs.items()}
    wanted = F.lit(False)
    for place in at.values():
        wanted = wanted | (F.col("__before") <= F.ceil(place)) & (F.col("__before") + F.col("__pn") > F.floor(place))
    held = laid.join(ranges.filter(wanted).drop("__pn"), [*keys, "__p"])
    inside = F.sum(n).over(W.partitionBy(*keys, "__p").orderBy(x).rowsBetween(W.unboundedPreceding, 0))
    return _interpolated(held.withColumn("__end", F.col("__before") + inside), keys, x, qs)


def _interpolated(held: DataFrame, keys: Sequence[str], x: str, qs: dict[str, float], extra: Sequence[Column] = (), names: Sequence[str] = ()) -> DataFrame:
    """exact_quantiles' columns from values with their group's total and how many rows end with them; and further aggregates."""
    firsts, at = [], {name: q * (F.col("total") - 1) for name, q in qs.items()}
    for name, place in at.items():
        for side, index in (("l", F.floor(place)), ("h", F.ceil(place))):
            beyond = F.col("__end") > index
            firsts += [F.min(F.when(beyond, F.col(x))).alias(f"__{side}_{name}"), F.min(F.when(beyond, F.col("__end"))).alias(f"__{side}n_{name}")]
    got = held.groupBy(*keys).agg(F.max("total").alias("total"), *firsts, *extra)
    out = []
    for name, place in at.items():
        low, high = F.col(f"__l_{name}"), F.col(f"__h_{name}")
        value = low + (high - low) * (place - F.floor(place))
        out += [value.alias(name), F.when(value < high, F.col(f"__ln_{name}")).otherwise(F.col(f"__hn_{name}")).alias(f"{name}_rows")]
    return got.select(*keys, "total", *out, *names)


def cell_quantiles(counts: DataFrame, x: str, qs: dict[str, float], extra: Sequence[Column] = (), names: Sequence[str] = (), most: int = 50_000) -> DataFrame:
    """exact_quantiles of written counts (cell, x, n), with further aggregates over the cells' counts. Cells of `most` different values
    or fewer, all as a rule, are put in order as they are, after one shuffle; larger ones by ranges."""
    large = counts.groupBy("cell").agg(F.count("*").alias("__values")).filter(F.col("__values") > most).select("cell")
    small, whole = counts, W.partitionBy("cell")
    some = not large.isEmpty()
    if some:  # as many as the counts' rows by `most`
        small = counts.join(large, "cell", "left_anti")
    held = small.withColumns({"total": F.sum("n").over(whole), "__end": F.sum("n").over(whole.orderBy(x).rowsBetween(W.unboundedPreceding, 0))})
    out = _interpolated(held, ["cell"], x, qs, extra, names)
    if some:
        rest = counts.join(large, "cell", "left_semi")
        ranged = exact_quantiles(rest, ["cell"], x, qs)
        out = out.unionByName(ranged.join(rest.groupBy("cell").agg(*extra), "cell") if extra else ranged)
    return out


def quantile_cells(train: DataFrame, keys: Sequence[str], y: str, q: float = 0.1, least: int = 10, out: str = "ref") -> DataFrame:
    """The exact quantile of y per key, for keys with `least` rows at or below it. Rows with a null key are left out."""
    got = exact_quantiles(value_counts(train, keys, y), keys, y, {out: q})
    return got.filter(F.col(f"{out}_rows") >= least).select(*keys, out)


def stat_cells(train: DataFrame, keys: Sequence[str], y: str, least: int = 10, low: float = 0.0, high: float = 7200.0) -> DataFrame:
    """Median, P90, sample deviation and count of y, clipped to [low, high], for keys with `least` rows."""
    rows = clipped(train, keys, y, low, high)
    thick = rows.groupBy(*keys).agg(F.stddev_samp("__y").alias("sd"), F.count("*").alias("n")).filter(F.col("n") >= least)
    middle = exact_quantiles(value_counts(rows, keys, "__y"), keys, "__y", {"median": 0.5, "p90": 0.9})
    return thick.join(middle, list(keys)).select(*keys, "median", "p90", "sd", "n")


def clipped(train: DataFrame, keys: Sequence[str], y: str, low: float, high: float) -> DataFrame:
    """(keys, __y) without nulls."""
    v = F.when(F.col(y).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), F.col(y))))
    return train.select(*keys, v.alias("__y")).dropna()


def _cell(levels: Sequence[Sequence[str]]) -> Column:
    """An array with a row's cell on each level, null where one of the level's keys is. A cell is its level and all keys, those of
    other levels null, so that all levels' cells are of one type and can stand in one column."""
    every = list(dict.fromkeys(k for keys in levels for k in keys))

    def one(i: int, keys: Sequence[str]) -> Column:
        known = F.lit(True)
        for k in keys:
            known = known & F.col(k).isNotNull()
        # A key that a level lacks is null there, of the key's type.
        return F.when(known, F.struct(F.lit(i).alias("level"), *[(F.col(k) if k in keys else F.when(F.lit(False), F.col(k))).alias(k) for k in every]))

    return F.array(*[one(i, keys) for i, keys in enumerate(levels)])


def level_counts(train: DataFrame, levels: Sequence[Sequence[str]], y: Column) -> DataFrame:
    """(cell, y, n), written: how often each value stands in each cell of each level. The table is read once, and counted by all keys;
    the levels' counts are sums of those."""
    every = list(dict.fromkeys(k for keys in levels for k in keys))
    finest = train.select(*every, y.alias("y")).filter("y IS NOT NULL").groupBy(*every, "y").agg(F.count("*").alias("n"))
    each = finest.select(F.explode(_cell(levels)).alias("cell"), "y", "n").filter("cell IS NOT NULL")
    return materialise(each.groupBy("cell", "y").agg(F.sum("n").alias("n")), "counts")


def quantile_levels(train: DataFrame, levels: Sequence[Sequence[str]], y: str, q: float = 0.1, least: int | Sequence[int] = 10, out: str = "ref", most: int = 50_000) -> DataFrame:
    """(cell, out): quantile_cells of all levels in one plan; `least` is one number or one for each level."""
    each = [least] * len(levels) if isinstance(least, int) else list(least)
    got = cell_quantiles(level_counts(train, levels, F.col(y)), "y", {out: q}, most=most)
    enough = F.get(F.array(*[F.lit(n) for n in each]), F.col("cell.level"))
    return got.filter(F.col(f"{out}_rows") >= enough).select("cell", out)


def stat_levels(train: DataFrame, levels: Sequence[Sequence[str]], y: str, least: int = 10, low: float = 0.0, high: float = 7200.0, most: int = 50_000) -> DataFrame:
    """(cell, median, p90, sd, n): stat_cells of all levels in one plan, from one table of counts."""
    v = F.when(F.col(y).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), F.col(y))))
    counts = level_counts(train, levels, v)
    # Deviations are summed up from a whole number in the middle, so that nothing is lost where a cell's values are alike.
    d = F.col("y") - F.lit(float(round((low + high) / 2)))
    sums = [F.sum(d * F.col("n")).alias("__s"), F.sum(d * d * F.col("n")).alias("__ss")]
    got = cell_quantiles(counts, "y", {"median": 0.5, "p90": 0.9}, sums, ["__s", "__ss"], most).filter(F.col("total") >= least)
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("__ss") - F.col("__s") * F.col("__s") / F.col("total")) / (F.col("total") - 1))
    return got.select("cell", "median", "p90", F.when(F.col("total") > 1, sd).alias("sd"), F.col("total").alias("n"))


def best_level(df: DataFrame, levels: Sequence[Sequence[str]], cells: DataFrame, values: Sequence[str], prefix: str = "cel_", level: str | None = None) -> DataFrame:
    """df with the values of the first level that has a cell for the row, as fallback() gives them. The level is looked up once for
    each combination of keys, and rows are joined once."""
    every = list(dict.fromkeys(k for keys in levels for k in keys))
    asked = df.select(*every).distinct()
    found = asked.select(*every, F.explode(_cell(levels)).alias("cell")).join(cells, "cell")
    best = found.groupBy(*every).agg(F.min(F.struct(F.col("cell.level").alias("__level"), *[F.col(v).alias(f"{prefix}{v}") for v in values])).alias("__best"))
    got = _null_safe(df, best, every)
    extra = [F.col("__best.__level").alias(level)] if level else []
    return got.select(*df.columns, *[F.col(f"__best.{prefix}{v}").alias(f"{prefix}{v}") for v in values], *extra)


def block_stat_cells(train: DataFrame, block: str, keys: Sequence[str], y: str, least: int = 10, low: float = 0.0, high: float = 7200.0) -> DataFrame:
    """(block, keys, median, p90, n) from all blocks but the own, for cells with `least` rows. Values are counted by block first;
    what is copied to the other blocks, a dozen at most, are these counts."""
    counts = value_counts(clipped(train, [block, *keys], y, low, high), [block, *keys], "__y")
    others = by_block(counts, block, counts).groupBy(block, *keys, "__y").agg(F.sum("n").alias("n"))
    got = exact_quantiles(others, [block, *keys], "__y", {"median": 0.5, "p90": 0.9}).filter(F.col("total") >= least)
    return got.select(block, *keys, "median", "p90", F.col("total").alias("n"))


def other_block_means(df: DataFrame, block: str, keys: Sequence[str], x: str, out: str = "mean") -> DataFrame:
    """(block, keys, mean, n) of x over all blocks but the own, for every block and key: the whole less the block."""
    own = df.groupBy(block, *keys).agg(F.sum(x).alias("__s"), F.count(x).alias("__n"))
    whole = own.groupBy(*keys).agg(F.sum("__s").alias("__ws"), F.sum("__n").alias("__wn"))
    blocks = own.agg(F.collect_set(block)).scalar()  # the blocks of a split, a dozen at most
    every = whole.withColumn(block, F.explode(blocks))
    got = _null_safe(every, own, [block, *keys])
    n = F.col("__wn") - F.coalesce("__n", F.lit(0))
    return got.select(block, *keys, ((F.col("__ws") - F.coalesce("__s", F.lit(0.0))) / n).alias(out), n.alias("n")).filter(F.col("n") > 0)


def fallback(df: DataFrame, levels: Sequence[tuple[Sequence[str], DataFrame]], values: Sequence[str], prefix: str = "cel_", level: str | None = None) -> DataFrame:
    """df with the values of the first level that has a cell for the row. Which level it was goes to `level`."""
    out = df
    for i, (keys, cells) in enumerate(levels):
        out = out.join(cells.select(*keys, F.struct(F.lit(i).alias("level"), *values).alias(f"__c{i}")), list(keys), "left")
    best = F.coalesce(*[F.col(f"__c{i}") for i in range(len(levels))])
    extra = [best["level"].alias(level)] if level else []
    return out.select(*df.columns, *[best[v].alias(f"{prefix}{v}") for v in values], *extra)


def by_block(train: DataFrame, block: str, blocks: DataFrame) -> DataFrame:
    """Each training row once for every other block, under that block's number: aggregates per (block, key) then are what
    the block may know, in one table."""
    held = blocks.select(F.col(block).alias("__held")).distinct()
    numbers = held.agg(F.array_sort(F.collect_set("__held"))).scalar()  # the blocks of a split, a dozen at most
    return train.withColumn("__for", F.explode(numbers)).filter(F.col("__for") != F.col(block)).drop(block).withColumnRenamed("__for", block)


def leave_own_block_out(history: DataFrame, queries: DataFrame, keys: Sequence[str], parent: Sequence[str], block: str, n: str, hits: str, strength: float = 20.0, out: str = "rate") -> DataFrame:
    """(hits + strength * parent rate) / (n + strength) over all blocks but the row's own; null where the parent has no
    history. history has counts n and hits for each (keys, block); parent is a subset of keys."""
    def totals(by: Sequence[str], p: str) -> tuple[DataFrame, DataFrame]:
        whole = history.groupBy(*by).agg(F.sum(n).alias(f"{p}n"), F.sum(hits).alias(f"{p}h"))
        own = history.groupBy(*by, block).agg(F.sum(n).alias(f"{p}on"), F.sum(hits).alias(f"{p}oh"))
        return whole, own

    out_df = queries
    for by, p in ((list(keys), "__k"), (list(parent), "__p")):
        whole, own = totals(by, p)
        out_df = out_df.join(whole, by, "left").join(own, [*by, block], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n_key, h_key = zero("__kn") - zero("__kon"), zero("__kh") - zero("__koh")
    n_parent, h_parent = zero("__pn") - zero("__pon"), zero("__ph") - zero("__poh")
    rate = F.try_divide(h_parent, n_parent)
    return out_df.select(*queries.columns, ((h_key + strength * rate) / (n_key + strength)).alias(out))


def lines(train: DataFrame, key: str, x: str, y: str, least: int = 50) -> DataFrame:
    """(key, slope, intercept) by least squares for keys with `least` rows; the row of a null key is the line of all."""
    rows = train.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    fit = [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")]
    each = rows.groupBy(key).agg(*fit, F.count("*").alias("n")).filter((F.col("n") >= least) & F.col(key).isNotNull() & F.col("slope").isNotNull()).drop("n")
    return each.unionByName(rows.agg(*fit).select(F.lit(None).cast(each.schema[key].dataType).alias(key), "slope", "intercept"))


def apply_lines(df: DataFrame, fitted: DataFrame, key: str, x: str, out: str) -> DataFrame:
    """The key's line at x, else the line of all, not below 0; null where x is."""
    own = fitted.filter(F.col(key).isNotNull()).withColumnsRenamed({"slope": "__s", "intercept": "__i"})
    rest = fitted.filter(F.col(key).isNull()).select(F.col("slope").alias("__gs"), F.col("intercept").alias("__gi"))
    got = df.join(own, key, "left").join(F.broadcast(rest), how="left")  # one row
    value = F.coalesce("__i", "__gi") + F.coalesce("__s", "__gs") * F.col(x)
    return got.select(*df.columns, F.when(F.col(x).isNotNull() & value.isNotNull(), F.greatest(value, F.lit(0.0))).alias(out))


def value_ranks(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """(keys, x, n, rank): each distinct value of each group with its count and average rank. Values are numbered in ranges of a
    sixteenth of an octave, with the ranges' totals added, so that a group of any size is spread over tasks."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("n"))
    counts = counts.withColumn("__p", _octave(x))
    sums = counts.groupBy(*keys, "__p").agg(F.sum("n").alias("__pn"))
    before = F.coalesce(F.sum("__pn").over(W.partitionBy(*keys).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("__before", before).drop("__pn")
    inner = F.coalesce(F.sum("n").over(W.partitionBy(*keys, "__p").orderBy(x).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    got = _null_safe(counts.withColumn("__in", inner), sums, [*keys, "__p"])
    return got.select(*keys, x, "n", (F.col("__before") + F.col("__in") + (F.col("n") + 1) / 2).alias("rank"))


def places(df: DataFrame, x: str, tie: str, out: str = "place", descending: bool = False) -> DataFrame:
    """df with each row's place, from 0, in order of x, ties by `tie`, a number from 0 up; neither is null. Values are numbered by
    value_ranks(); rows of one value are laid into ranges of `tie`, whose totals are added up, so that neither many values
    nor one that most rows have are put in order in one task."""
    by = F.col(x).cast("double")
    rows = df.withColumns({"__x": -by if descending else by, "__t": _octave(tie)})
    values = value_ranks(rows, [], "__x").select(F.col("__x").alias("__vx"), (F.col("rank") - (F.col("n") + 1) / 2).cast("long").alias("__vb"))
    ranges = rows.groupBy("__x", "__t").agg(F.count("*").alias("__rn"))
    earlier = F.coalesce(F.sum("__rn").over(W.partitionBy("__x").orderBy("__t").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(F.col("__x").alias("__rx"), F.col("__t").alias("__rt"), earlier.alias("__rb")).join(values, F.col("__rx") == F.col("__vx"))
    inner = F.row_number().over(W.partitionBy("__x", "__t").orderBy(tie)) - 1
    got = rows.withColumn("__i", inner).join(ranges, (F.col("__x") == F.col("__rx")) & (F.col("__t") == F.col("__rt")))
    return got.select(*df.columns, (F.col("__vb") + F.col("__rb") + F.col("__i")).alias(out))


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys where null equals null; the right side's keys go."""
    r = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(r, on, "left").drop(*[f"__r_{k}" for k in keys])


def group_stats(df: DataFrame, xs: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, and for each x its mean m_x, population deviation s_x, null for one row, and count n_x), with the rows r_."""
    aggs = [a for x in xs for a in (F.avg(x).alias(f"m_{x}"), F.when(F.count(x) > 1, F.stddev_pop(x)).alias(f"s_{x}"), F.count(x).alias(f"n_{x}"))]
    return df.groupBy(*keys).agg(*aggs, F.count("*").alias("r_"))


def group_features(df: DataFrame, x: str, keys: Sequence[str], prefix: str = "g_", rank: bool = True) -> DataFrame:
    """Mean, population deviation (null for one row), difference, z, count, mean less the mean of all, deviation in deviations of
    all, and, if asked for, percentile rank with average ties, in groups where a null key is a group of its own. Groups are
    aggregated and joined back, never gathered."""
    stats = group_stats(df, [x], keys).withColumnsRenamed({f"m_{x}": "__m", f"s_{x}": "__s", f"n_{x}": "__n"}).drop("r_")
    every = df.agg(F.struct(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"))).scalar()
    got = _null_safe(df, stats, list(keys)).withColumn("__e", every)
    n, mean, sd, v, all_mean, all_sd = F.col("__n"), F.col("__m"), F.col("__s"), F.col(x), F.col("__e.m"), F.col("__e.s")
    columns = {"mean": mean, "sd": sd, "n": n, "diff": v - mean, "z": F.when(sd > EPS, (v - mean) / sd), "cmean": mean - all_mean, "rsd": F.when(all_sd > EPS, sd / all_sd)}
    if rank:
        ranks = value_ranks(df.select(*keys, x), keys, x).select(*keys, x, F.col("rank").alias("__rank"))
        got = _null_safe(got, ranks, [*keys, x])
        columns["pos"] = F.when(v.isNotNull(), F.try_divide(F.col("__rank"), n))
    return got.withColumns({f"{prefix}{c}": e for c, e in columns.items()}).drop("__m", "__s", "__n", "__rank", "__e")


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values, ties by value."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(n).select(column)


def cap_values(df: DataFrame, vocabulary: DataFrame, column: str, other: str | None = "other", out: str | None = None) -> DataFrame:
    """Values outside of the vocabulary become `other` (or null); null stays null."""
    known = vocabulary.select(F.col(column).alias("__v")).distinct()
    got = df.join(known, F.col(column) == F.col("__v"), "left")
    value = F.when(F.col(column).isNull(), F.lit(None)).when(F.col("__v").isNotNull(), F.col(column)).otherwise(F.lit(other))
    return got.withColumn(out or column, value).drop("__v")


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, rate) in one pass."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column", "rate")


def leaky_columns(train: DataFrame, other: DataFrame, columns: Sequence[str], most_train: float = 0.5, least_other: float = 0.95) -> DataFrame:
    """Columns that are mostly there in one table and mostly null in the other."""
    a, b = null_rates(train, columns), null_rates(other, columns).withColumnRenamed("rate", "other_rate")
    return a.join(b, "column").filter((F.col("rate") < most_train) & (F.col("other_rate") > least_other))


def day_folds(df: DataFrame, day: str, k: int, out: str = "fold") -> DataFrame:
    """Days numbered in their order, round robin over k folds. Days are few; the table of days is what is ranked."""
    days = df.select(F.col(day).alias("__d")).distinct()
    ranked = days.withColumn(out, (F.dense_rank().over(W.orderBy("__d")) - 1) % k)
    return df.join(ranked, F.col(day) == F.col("__d"), "left").drop("__d")


def consistency(planned: Column, actual: Column) -> dict[str, Column]:
    """Difference and ratio of durations; the ratio only for a positive plan."""
    return {"nm_diff": actual - planned, "nm_ratio": F.when(planned > 0, actual / planned)}
