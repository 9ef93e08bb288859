"""Point-process windows: aggregates of events around query instants, per group, with exact bounds.

Two kernels serve all of them.

`range_aggregate` is for frames of fixed width. Queries and events are laid into time buckets at least as wide as the
widest frame; an event is copied into the neighbouring buckets that a frame could reach from. A group that holds a
third of all rows is thereby spread over as many tasks as it has buckets. A frame's sum is the difference of two running
sums from its bucket's beginning, which a window with an open lower end adds up once; so the cost is that of the rows,
however many events a frame holds. Sums of whole numbers are exact, and of doubles as near as the bucket's sum allows.

`totals_until` is for bounds that differ from row to row: the sum of event weights up to an instant. Running sums are
taken inside buckets; the totals of the buckets before come from a small table. Differences of two such sums give counts
over any interval, with open or closed ends (an end is moved by one unit of the integer clock).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERY = "__q"


Frame = tuple[str, str | None, int, int]


def range_aggregate(events: DataFrame, queries: DataFrame, by: Sequence[str], at: str, frames: dict[str, Frame], query_id: str, bucket: int | None = None) -> DataFrame:
    """(query_id, one column for each frame). A frame is (kind, value, low, high): the count, sum or mean of an events' column
    where it isn't null (a value of None counts events) over events with t + low <= event.t <= t + high on the integer clock
    `at`. A sum or a mean over nothing is null. Rows whose key is null in any column of `by` match nothing."""
    reach = max(max(abs(lo), abs(hi)) for _, _, lo, hi in frames.values())
    width = bucket or max(4 * reach, 1)
    if width < reach:
        raise ValueError("a bucket must be as wide as the widest frame reaches")
    whole = F.floor(F.col(at) / width)
    back, ahead = any(lo < 0 for _, _, lo, _ in frames.values()), any(hi > 0 for _, _, _, hi in frames.values())
    copies = [F.lit(0)]
    if back:  # a later query may look back at it
        copies.append(F.when(F.pmod(F.col(at), F.lit(width)) >= width - reach, F.lit(1)))
    if ahead:
        copies.append(F.when(F.pmod(F.col(at), F.lit(width)) <= reach, F.lit(-1)))
    known = F.col(at).isNotNull()
    for k in by:
        known = known & F.col(k).isNotNull()
    values = sorted({v for _, v, _, _ in frames.values() if v is not None})
    weighed = {f"__v_{v}": F.col(v) for v in values} | {f"__n_{v}": F.col(v).isNotNull().cast("long") for v in values} | {"__n_": F.lit(1).cast("long")}
    copied = events.filter(known).select(*by, at, *[c.alias(n) for n, c in weighed.items()], F.explode(F.array_compact(F.array(*copies))).alias("__shift"))
    copied = copied.withColumn("__b", whole + F.col("__shift")).drop("__shift").withColumn(QUERY, F.lit(False))
    asked = queries.filter(known).select(query_id, *by, at).withColumn("__b", whole).withColumn(QUERY, F.lit(True))
    rows = copied.unionByName(asked, allowMissingColumns=True)
    running = W.partitionBy(*by, "__b").orderBy(at)

    def until(column: str, bound: int) -> Column:
        return F.coalesce(F.sum(column).over(running.rangeBetween(W.unboundedPreceding, bound)), F.lit(0))

    def result(kind: str, value: str | None, low: int, high: int) -> Column:
        n = until(f"__n_{value or ''}", high) - until(f"__n_{value or ''}", low - 1)
        if kind == "count":
            return n
        total = until(f"__v_{value}", high) - until(f"__v_{value}", low - 1)
        return F.when(n > 0, total / n if kind == "mean" else total)

    return rows.select(query_id, QUERY, *[result(*frame).alias(name) for name, frame in frames.items()]).filter(QUERY).drop(QUERY)


def totals_until(events: DataFrame, probes: DataFrame, by: Sequence[str], at: str, weights: dict[str, str], probe_id: Sequence[str], bucket: int) -> DataFrame:
    """(probe_id..., sums): for each probe the sums of the events' weights with event.t <= probe.t in its group.

    Events and probes have the columns by and at; weights maps result names to weight columns. Probes with a null key or
    time give no row."""
    known = F.col(at).isNotNull()
    for k in by:
        known = known & F.col(k).isNotNull()
    b = F.floor(F.col(at) / bucket)
    own = events.filter(known).select(*by, at, *[F.col(w).alias(f"__w_{n}") for n, w in weights.items()]).withColumn("__b", b).withColumn(QUERY, F.lit(False))
    asked = probes.filter(known).select(*dict.fromkeys([*by, at, *probe_id])).withColumn("__b", b).withColumn(QUERY, F.lit(True))
    # What earlier buckets hold: one row for each group and bucket that has events or probes.
    totals = own.select(*by, "__b", *[f"__w_{n}" for n in weights]).unionByName(asked.select(*by, "__b").distinct(), allowMissingColumns=True)
    totals = totals.groupBy(*by, "__b").agg(*[F.sum(f"__w_{n}").alias(f"__w_{n}") for n in weights])
    earlier = W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*by, "__b", *[F.coalesce(F.sum(f"__w_{n}").over(earlier), F.lit(0)).alias(f"__t_{n}") for n in weights])
    running = W.partitionBy(*by, "__b").orderBy(at).rangeBetween(W.unboundedPreceding, 0)
    rows = own.unionByName(asked, allowMissingColumns=True)
    rows = rows.select(*dict.fromkeys([*by, "__b", QUERY, *probe_id]), *[F.coalesce(F.sum(f"__w_{n}").over(running), F.lit(0)).alias(f"__s_{n}") for n in weights]).filter(QUERY)
    return rows.join(totals, [*by, "__b"]).select(*probe_id, *[(F.col(f"__s_{n}") + F.col(f"__t_{n}")).alias(n) for n in weights])


def interval_sums(events: DataFrame, queries: DataFrame, by: Sequence[str], query_id: str, event_at: str, bounds: dict[str, tuple[str, Column, Column]], bucket: int) -> DataFrame:
    """(query_id, sums): for each result name (weight column, low, high) the sum over low < event.t <= high, with bounds
    that are columns of the queries. Null bounds give null; for an open upper end pass high - 1, for a closed lower one
    low - 1."""
    events = events.withColumn("__t", F.col(event_at))
    out = queries.select(query_id)
    probes = None
    for name, (_, low, high) in bounds.items():
        for sign, bound in ((-1, low), (1, high)):
            part = queries.select(*by, F.col(query_id), bound.cast("long").alias("__t"), F.lit(name).alias("__name"), F.lit(sign).alias("__sign"))
            probes = part if probes is None else probes.unionByName(part)
    columns = sorted({w for w, _, _ in bounds.values()})
    sums = totals_until(events, probes, by, "__t", {w: w for w in columns}, [query_id, "__name", "__sign"], bucket)
    aggs = []
    for name, (weight, _, _) in bounds.items():
        mine = F.col("__name") == name
        aggs.append(F.when(F.count(F.when(mine, 1)) == 2, F.sum(F.when(mine, F.col("__sign") * F.col(weight)))).alias(name))
    return out.join(sums.groupBy(query_id).agg(*aggs), query_id, "left")


def previous_instant(events: DataFrame, queries: DataFrame, by: Sequence[str], at: str, query_id: str, n: int) -> DataFrame:
    """(query_id, t): the instant of the n-th event strictly before each query; no row if there are fewer.

    Events are numbered in their group by bucket offsets and places within; the query's number comes from a strict count."""
    bucket = 86_400 * 1_000_000
    one = events.withColumn("__one", F.lit(1))
    probes = queries.select(*by, query_id, (F.col(at) - 1).alias(at))
    before = totals_until(one, probes, by, at, {"before": "__one"}, [query_id, *by], bucket)
    b = F.floor(F.col(at) / bucket)
    totals = one.groupBy(*by, b.alias("__b")).agg(F.count("*").alias("__n"))
    totals = totals.withColumn("__start", F.coalesce(F.sum("__n").over(W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    numbered = one.withColumn("__b", b).withColumn("__r", F.row_number().over(W.partitionBy(*by, "__b").orderBy(at))).join(totals, [*by, "__b"])
    numbered = numbered.select(*by, (F.col("__start") + F.col("__r")).alias("__no"), F.col(at).alias("t"))
    return before.withColumn("__no", F.col("before") - n + 1).join(numbered, [*by, "__no"]).select(query_id, "t")


def decayed_sum(events: DataFrame, queries: DataFrame, by: Sequence[str], at: str, query_id: str, half_life: float, cut: int, chunk: int, unit: int, out: str) -> DataFrame:
    """(query_id, out): sum of 2^-(age / half_life) over events with t - cut <= event.t < t; at, cut and chunk are on an
    integer clock with `unit` ticks to one half-life second. Weights are taken from the chunk's origin, so they stay small."""
    origin = F.floor(F.col(at) / chunk)
    known = F.col(at).isNotNull()
    for k in by:
        known = known & F.col(k).isNotNull()
    copied = events.filter(known).withColumn("__c", F.explode(F.array(origin, origin + 1))).withColumn(QUERY, F.lit(False)).drop(query_id)
    asked = queries.filter(known).select(query_id, *by, at).withColumn("__c", origin).withColumn(QUERY, F.lit(True))
    rows = copied.select(*by, at, "__c", QUERY).unionByName(asked, allowMissingColumns=True)
    age = (F.col(at) - F.col("__c") * chunk) / unit / half_life
    rows = rows.withColumn("__g", F.when(~F.col(QUERY), F.pow(F.lit(2.0), age)))
    # Running sums: weights grow towards the query, so the difference loses nothing that counts.
    upto = lambda bound: F.coalesce(F.sum("__g").over(W.partitionBy(*by, "__c").orderBy(at).rangeBetween(W.unboundedPreceding, bound)), F.lit(0.0))
    return rows.select(query_id, QUERY, ((upto(-1) - upto(-cut - 1)) * F.pow(F.lit(2.0), -age)).alias(out)).filter(QUERY).drop(QUERY)
