"""One-to-one matching, greedy by priority and distance: of listed pairs as rounds of mutually best ones, of all pairs of a time band
in pieces of time, without listing them."""

from __future__ import annotations

from bisect import bisect_left, insort
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def candidates_around(left: DataFrame, right: DataFrame, by: list[str], at: str, right_at: str, left_id: str, right_id: str, tolerance: int) -> DataFrame:
    """(left_id, right_id, distance): the last right row at or before each left row and the first at or after it."""
    from .asof import asof

    parts = []
    for direction in ("backward", "forward"):
        got = asof(left, right, by, at, right_at, tolerance, [right_id], right_id, direction, "m_").filter(F.col(f"m_{right_id}").isNotNull())
        parts.append(got.select(left_id, F.col(f"m_{right_id}").alias(right_id), F.abs(F.col(f"m_{right_at}") - F.col(at)).alias("distance")))
    return parts[0].unionByName(parts[1]).distinct()


def greedy_match(pairs: DataFrame, left_id: str, right_id: str, order: list[str], save, finish: int = 100_000) -> DataFrame:
    """The pairs that taking them one by one in their order (ties by ids) would take, each id once.

    A pair that is the first of all pairs of both its ids would be taken whatever else happens; taking all such pairs and
    dropping those that share an id with them is one round. When `finish` pairs or fewer are left, one task takes them one by
    one, so long chains of pairs that wait for each other cost no rounds. `save` writes a frame to storage and returns it read
    back, so that plans stay short."""
    ranks = [*order, left_id, right_id]
    rest, taken = save(pairs.distinct()), None
    while rest.count() > finish:
        best = rest.withColumn("__l", F.row_number().over(W.partitionBy(left_id).orderBy(*ranks))).withColumn("__r", F.row_number().over(W.partitionBy(right_id).orderBy(*ranks)))
        now = save(best.filter("__l = 1 AND __r = 1").drop("__l", "__r"))
        taken = now if taken is None else taken.unionByName(now)
        rest = save(rest.join(now.select(left_id), left_id, "left_anti").join(now.select(right_id), right_id, "left_anti"))

    def one_by_one(batches):
        left, right = set(), set()
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(left_id).to_pylist(), batch.column(right_id).to_pylist(), strict=True):
                keep.append(a not in left and b not in right)
                if keep[-1]:
                    left.add(a)
                    right.add(b)
            yield batch.filter(pa.array(keep, pa.bool_()))

    last = rest.repartition(1).sortWithinPartitions(*ranks).mapInArrow(one_by_one, rest.schema)  # `finish` pairs at most
    return last if taken is None else taken.unionByName(last)


def repeats(df: DataFrame, key: str) -> bool:
    """Whether an id stands twice, or is null."""
    return bool(df.groupBy(key).count().filter((F.col("count") > 1) | F.col(key).isNull()).limit(1).count())


def _settle(t: list, side: list, ids: list, low: float, high: float, below: int) -> tuple[list, list]:
    """([(left place, right place, distance)], places left open) of one piece's points, sorted by time, side and id; points outside lie
    before `low`, or at `high` or after.

    The nearest pair of all that are left is always one of neighbours, so neighbours wait in a heap. A pair is certain if neither
    a point outside nor one that is itself unsure lies as near to either of its points; else both are unsure from then on."""
    at, own, first, end = [], [], [], []  # points of a time and side stand together, in the order of their ids
    for i, (x, s) in enumerate(zip(t, side, strict=True)):
        if at and at[-1] == x and own[-1] == s:
            end[-1] = i + 1
        else:
            at.append(x)
            own.append(s)
            first.append(i)
            end.append(i + 1)
    n = len(at)
    before, after, unsure = list(range(-1, n - 1)), [*range(1, n), n], [False] * n
    doubt: dict[bool, list] = {True: [], False: []}  # the times of what is unsure, by side

    def pair(a: int, b: int) -> tuple:
        l, r = (a, b) if own[a] else (b, a)  # noqa: E741
        return at[b] - at[a], ids[first[l]], ids[first[r]], a, b, first[l], first[r]

    def near(k: int, d: int) -> bool:
        times = doubt[not own[k]]
        i = bisect_left(times, at[k] - d)
        return d >= min(at[k] - low, high - at[k]) or i < len(times) and times[i] <= at[k] + d

    heap = [pair(a, a + 1) for a in range(n - 1) if own[a] != own[a + 1] and at[a + 1] - at[a] < below]
    heapify(heap)
    taken = []
    while heap:
        d, _, _, a, b, l, r = heappop(heap)  # noqa: E741
        if after[a] != b or before[b] != a or l != first[a if own[a] else b] or r != first[b if own[a] else a]:
            continue
        if unsure[a] or unsure[b] or near(a, d) or near(b, d):
            for k in (a, b):
                if not unsure[k]:
                    unsure[k] = True
                    insort(doubt[own[k]], at[k])
            continue
        taken.append((l, r, d))
        first[a] += 1
        first[b] += 1
        p, q = a, b
        if first[a] == end[a]:
            p = before[a]
            before[b] = p
            if p >= 0:
                after[p] = b
            after[a] = -2
        if first[b] == end[b]:
            q = after[b]
            left = p if first[a] == end[a] else a
            if left >= 0:
                after[left] = q
            if q < n:
                before[q] = left
            before[b] = -2
        # Neighbours that are new, or whose first point is.
        for x, y in {(p, q), (before[p], p) if p >= 0 else (-1, 0), (q, after[q]) if q < n else (0, n)}:
            if x >= 0 and y < n and own[x] != own[y] and at[y] - at[x] < below:
                heappush(heap, pair(x, y))
    alive = [k for k in range(n) if first[k] < end[k]]
    return taken, [i for k in alive if unsure[k] or near(k, below - 1) for i in range(first[k], end[k])]


def greedy_band(left: DataFrame, right: DataFrame, by: list[str], at: str, right_at: str, left_id: str, right_id: str, below: int, save, finish: int = 1000) -> DataFrame:
    """(left_id, right_id, distance): what greedy_match takes of all pairs of equal keys less than `below` apart, nearest first (ties by
    ids), without listing the pairs. Ids must not repeat.

    Points are dealt to pieces of time, and each piece settles what no point outside can change. What stays open, near the pieces'
    borders, goes on in pieces twice as wide with borders elsewhere; `finish` points or fewer stay in one piece for each key."""
    known = F.lit(True)
    for k in [*by, "__t"]:
        known = known & F.col(k).isNotNull()
    sides = [d.select(*by, F.col(x).alias("__t"), F.col(i).alias("__id"), F.lit(s).alias("__left")) for d, x, i, s in ((left, at, left_id, True), (right, right_at, right_id, False))]
    points = sides[0].unionByName(sides[1]).filter(known)
    columns, keys = points.columns, [*by, "__b"]
    schema = points.withColumns({"__other": F.lit(None).cast(points.schema["__id"].dataType), "__d": F.lit(None).cast("long")}).schema
    rest, taken, step, few = points, [], 0, False
    while True:
        width = None if few or step > 20 else 4 * below << step
        shift = 0 if width is None else int(width * (0.382 * step % 1))
        piece = F.lit(0).cast("long") if width is None else F.floor((F.col("__t") + shift) / width)

        def run(batches, width=width, shift=shift):
            def settled(part: pa.Table) -> pa.Table:
                b = part.column("__b")[0].as_py()
                low, high = (-np.inf, np.inf) if width is None else (b * width - shift, (b + 1) * width - shift)
                got, open_ = _settle(*[part.column(c).to_pylist() for c in ("__t", "__left", "__id")], low, high, below)
                ids, own = part.column("__id"), part.select(columns)
                l, r, d = ([x[i] for x in got] for i in range(3))  # noqa: E741
                hit = own.take(pa.array(l, pa.int64())).append_column("__other", ids.take(pa.array(r, pa.int64()))).append_column("__d", pa.array(d, pa.int64()))
                lost = own.take(pa.array(open_, pa.int64()))
                return pa.concat_tables([hit, lost.append_column("__other", pa.nulls(len(open_), ids.type)).append_column("__d", pa.nulls(len(open_), pa.int64()))])

            held = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
                new = np.zeros(held.num_rows - 1, dtype=bool)
                for k in keys:
                    c = held.column(k).combine_chunks()
                    new |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
                made = [settled(held.slice(i, j - i)) for i, j in zip(cuts, cuts[1:], strict=False)]
                held = held.slice(cuts[-1])
                if made:
                    yield from pa.concat_tables(made).combine_chunks().to_batches()
            if held is not None:
                yield from settled(held).combine_chunks().to_batches()

        dealt = rest.withColumn("__b", piece).repartition(*keys).sortWithinPartitions(*keys, "__t", "__left", "__id")
        out = save(dealt.mapInArrow(run, schema))
        taken.append(out.filter("__other IS NOT NULL").select(F.col("__id").alias(left_id), F.col("__other").alias(right_id), F.col("__d").alias("distance")))
        rest, step = out.filter("__other IS NULL").select(columns), step + 1
        left_over = rest.count()
        if not left_over:
            break
        few = left_over <= finish
    got = taken[0]
    for x in taken[1:]:
        got = got.unionByName(x)
    return got
