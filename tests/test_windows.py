"""Window kernels against their definitions, row by row."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ravelin.operators import runway, windows

DAY = 86_400


def frame(spark, seed, n=300, groups=3, span=5000):
    rng = random.Random(seed)
    return [(i, rng.choice("abc"[:groups]) if rng.random() > 0.05 else None, rng.randrange(span), rng.choice([None, *range(100)])) for i in range(n)]


@pytest.mark.parametrize("bucket", [None, 400, 10_000])
def test_range_aggregate_is_its_definition(spark, bucket):
    ev, q = frame(spark, 1), frame(spark, 2)
    events = spark.createDataFrame(ev, "eid int, k string, t long, v int").drop("eid")
    queries = spark.createDataFrame(q, "id int, k string, t long, v int")
    frames = {"past": ("count", None, -300, -1), "future": ("sum", "v", 1, 200), "upto": ("mean", "v", -99, 0), "known": ("count", "v", -99, 0)}
    got = {r.id: r for r in windows.range_aggregate(events, queries.select("id", "k", "t"), ["k"], "t", frames, "id", bucket).collect()}
    for i, k, t, _ in q:
        if k is None:
            assert i not in got
            continue
        near = [(e[2], e[3]) for e in ev if e[1] == k]
        future = [v for s, v in near if t < s <= t + 200 and v is not None]
        upto = [v for s, v in near if t - 99 <= s <= t and v is not None]
        assert got[i].past == sum(t - 300 <= s < t for s, _ in near)
        assert got[i].future == (sum(future) if future else None)
        assert got[i].known == len(upto)
        assert got[i].upto == pytest.approx(sum(upto) / len(upto)) if upto else got[i].upto is None


def test_counts_exclude_what_happens_at_the_same_second(spark):
    events = spark.createDataFrame([("a", 100), ("a", 100), ("a", 40), ("a", 160)], "k string, t long")
    q = spark.createDataFrame([(1, "a", 100)], "id int, k string, t long")
    r = windows.range_aggregate(events, q, ["k"], "t", {"prev": ("count", None, -60, -1), "next": ("count", None, 1, 60)}, "id").first()
    assert (r.prev, r.next) == (1, 1)


@pytest.mark.parametrize("bucket", [100, 1000, 100_000])
def test_interval_sums_are_their_definition(spark, bucket):
    rng = random.Random(5)
    ev = [(rng.choice("ab"), rng.randrange(3000), rng.randrange(1, 9)) for _ in range(400)]
    q = [(i, rng.choice("ab"), *sorted((rng.randrange(-50, 3100), rng.randrange(-50, 3100)))) for i in range(200)] + [(999, "a", None, 5), (1000, "z", 0, 10)]
    events = spark.createDataFrame(ev, "k string, t long, w int")
    queries = spark.createDataFrame(q, "id int, k string, lo long, hi long")
    got = {r.id: r.s for r in windows.interval_sums(events, queries, ["k"], "id", "t", {"s": ("w", F.col("lo"), F.col("hi"))}, bucket).collect()}
    for i, k, lo, hi in q:
        assert got[i] == (None if lo is None else sum(w for k2, t, w in ev if k2 == k and lo < t <= hi))


def test_previous_instant_counts_ties_out(spark):
    events = spark.createDataFrame([("a", t) for t in (1, 1, 2, 2, 5)], "k string, t long")
    q = spark.createDataFrame([(1, "a", 5), (2, "a", 2), (3, "a", 6)], "id int, k string, t long")
    got = {r.id: r.t for r in windows.previous_instant(events, q, ["k"], "t", "id", 3).collect()}
    assert got == {1: 1, 3: 2}


def test_span_of_twenty_departures(spark):
    minute = 60_000_000
    events = spark.createDataFrame([("a", i * minute) for i in range(25)], "k string, t long")
    q = spark.createDataFrame([(1, "a", 24 * minute), (2, "a", 19 * minute)], "id int, k string, t long")
    got = {r.id: r.t for r in windows.previous_instant(events, q, ["k"], "t", "id", 20).collect()}
    assert (24 * minute - got[1]) / 1_000_000 == 1200
    assert 2 not in got


def test_decayed_sum_crosses_a_chunk(spark):
    events = spark.createDataFrame([("a", 21_000), ("a", 20_400), ("a", 14_000), ("a", 21_600)], "k string, t long")
    q = spark.createDataFrame([(1, "a", 21_600)], "id int, k string, t long")
    r = windows.decayed_sum(events, q, ["k"], "t", "id", 600.0, 7200, 21_600, 1, "g").first()
    assert r.g == pytest.approx(0.5 + 0.25)


def moves(spark, rows):
    return spark.createDataFrame([(i, "X", p, r, b * 600_000_000) for i, (p, r, b) in enumerate(rows)], "mvt_id int, airport string, phase string, runway string, mvt_us long")


def test_configuration_and_its_bounds(spark):
    rows = moves(spark, [("DEP", "07", 103), ("DEP", "25", 100), ("ARR", "16L", 105), ("DEP", "99", 106), ("DEP", "98", 99), ("ARR", "97", 99)])
    got = runway.configuration(rows, rows.filter("mvt_id = 0"), "mvt_id").first()
    assert got.config == "X|D:07+25 A:16L"
    assert (got.n_dep_rwy, got.n_arr_rwy, got.dominant, got.share) == (2, 1, 1, 0.5)
    assert got.changed is None


def test_an_empty_configuration_is_one(spark):
    rows = moves(spark, [("DEP", "07", 100), ("DEP", "07", 110), ("DEP", "25", 116)])
    got = {r.mvt_id: r.changed for r in runway.configuration(rows, rows, "mvt_id").collect()}
    assert got == {0: None, 1: 1, 2: 1}


def test_frames_cost_no_more_where_events_are_dense(spark):
    """Running sums: no frame of the plan slides, so nothing is added up anew for each row."""
    events = spark.range(1000).selectExpr("id % 3 AS k", "id AS t", "id AS v")
    asked = events.withColumnRenamed("v", "q")
    for got in (windows.range_aggregate(events, asked, ["k"], "t", {"a": ("count", None, -300, -1), "b": ("mean", "v", 1, 200)}, "q"), windows.decayed_sum(events, asked, ["k"], "t", "q", 60.0, 600, 3600, 1, "g")):
        frames = re.findall(r"specifiedwindowframe\(RangeFrame, ([^,]+),", got._jdf.queryExecution().executedPlan().toString())
        assert frames and set(frames) == {"unboundedpreceding$()"}
