"""As-of joins against pandas, greedy matching against the sequential one, islands by hand."""

import random

import pandas as pd
import pytest

from ravelin.operators import asof, islands, keys, matching
from ravelin.sources.storage import materialise


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("seed", [1, 2])
def test_asof_is_that_of_pandas(spark, direction, seed):
    rng = random.Random(seed)
    left = pd.DataFrame([(i, rng.choice("ab"), rng.randrange(500)) for i in range(150)], columns=["id", "k", "t"]).sort_values(["t", "id"])
    right = pd.DataFrame([(i, rng.choice("ab"), rng.randrange(500)) for i in range(80)], columns=["no", "k", "s"]).sort_values(["s", "no"])
    want = pd.merge_asof(left, right, left_on="t", right_on="s", by="k", direction=direction, tolerance=12).set_index("id")
    got = asof.asof(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", "s", 12, ["no"], "no", direction).toPandas().set_index("id")
    assert len(got) == len(left)
    for i in got.index:
        a, b = got.loc[i, "r_no"], want.loc[i, "no"]
        assert (pd.isna(a) and pd.isna(b)) or a == b, (i, got.loc[i], want.loc[i])


def test_asof_keeps_rows_without_key_or_time(spark):
    left = spark.createDataFrame([(1, None, 5), (2, "a", None), (3, "a", 5)], "id int, k string, t long")
    right = spark.createDataFrame([("a", 5, 7)], "k string, s long, v int")
    got = {r.id: r.r_v for r in asof.asof(left, right, ["k"], "t", "s", 0, ["v"], "v").collect()}
    assert got == {1: None, 2: None, 3: 7}


def test_cascade_only_asks_for_what_is_unmatched(spark):
    left = spark.createDataFrame([(1, "x", "c1", 1000), (2, "x", "c2", 1000), (3, "x", "c3", 5000)], "id int, apt string, call string, t long")
    right = spark.createDataFrame([("x", "c1", 1480, 1), ("x", "zz", 1030, 2)], "apt string, call string, s long, no int")
    got = {r.id: (r.r_no, r.step) for r in asof.cascade(left, right, [(["apt", "call"], 600), (["apt"], 90)], "t", "s", ["no"], "no").collect()}
    assert got == {1: (1, 0), 2: (2, 1), 3: (None, None)}


def test_band_join_is_strict(spark):
    left = spark.createDataFrame([(1, "a", 1000)], "id int, k string, t long")
    right = spark.createDataFrame([("a", 700, 1), ("a", 701, 2), ("a", 1299, 3), ("a", 1300, 4), ("b", 1000, 5)], "k string, s long, no int")
    assert sorted(r.r_no for r in asof.band_join(left, right, ["k"], "t", "s", 300, ["no"]).collect()) == [2, 3]


def test_band_join_lays_pairs_of_equal_times_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(asof, "PIECE", 100, raising=False)
    rng = random.Random(3)
    left, right = [(i, "a", rng.randrange(12) * 7 * 10**6 + 3) for i in range(400)], [("a", rng.randrange(12) * 7 * 10**6, i) for i in range(400)]
    left, right = left + [(400, None, 3), (401, "a", None)], right + [(None, 3, 400), ("a", None, 401)]
    want = sorted((i, no, abs(t - s)) for i, k, t in left for c, s, no in right if k and k == c and None not in (t, s) and abs(t - s) < 30 * 10**6)
    got = asof.band_join(spark.createDataFrame(left, "id long, k string, t long"), spark.createDataFrame(right, "k string, s long, no long"), ["k"], "t", "s", 30 * 10**6, ["no"])
    assert got.columns == ["k", "id", "t", "r_no", "r_s"]
    got.selectExpr("id", "r_no", "abs(t - r_s) AS apart").write.parquet(f"{tmp_path}/pairs")
    rows = [tuple(r) for f in sorted(tmp_path.glob("pairs/*.parquet")) for r in pd.read_parquet(f).itertuples(index=False)]
    assert sorted(rows) == want
    assert sum(a[2] != b[2] for a, b in zip(rows, rows[1:])) < len(rows) / 100
    assert sum(f.stat().st_size for f in tmp_path.glob("pairs/*.parquet")) < len(rows) / 2


def test_band_join_deals_rows_out_by_their_number(spark, tmp_path, monkeypatch):
    """A file of many pairs sees few ids, however few the shuffle partitions; times apart or equal, on both sides of zero."""
    monkeypatch.setattr(asof, "SHARE", 200, raising=False)
    monkeypatch.setattr(asof, "PIECE", 3)
    monkeypatch.setattr(asof, "LEFT", 5, raising=False)
    rng = random.Random(4)
    left, right = ([(i, k, rng.randrange(-600, 600) * step) for i in range(1500) for k, step in [rng.choice([("a", 1), ("b", 3), ("c", 7)])]] for _ in range(2))
    want = sorted((i, t, no, s) for i, k, t in left for no, c, s in right if k == c and abs(t - s) < 25)
    got = asof.band_join(spark.createDataFrame(left, "id long, k string, t long"), spark.createDataFrame(right, "no long, k string, s long"), ["k"], "t", "s", 25, ["no", "s"])
    assert got.columns == ["k", "id", "t", "r_no", "r_s"]
    got.write.parquet(f"{tmp_path}/pairs")
    files = [f for f in (pd.read_parquet(f) for f in tmp_path.glob("pairs/*.parquet")) if len(f)]
    assert sorted(tuple(r) for f in files for r in f[["id", "t", "r_no", "r_s"]].itertuples(index=False)) == want
    assert len(files) > 8 and max(f["id"].nunique() for f in files) < 375


@pytest.mark.parametrize("seed", range(3))
def test_greedy_matching_is_sequential_greedy(spark, seed):
    rng = random.Random(seed)
    pairs = list({(rng.randrange(30), rng.randrange(30)): (rng.randrange(2), rng.randrange(20)) for _ in range(150)}.items())
    rows = [(a, b, p, d) for (a, b), (p, d) in pairs]
    used_a, used_b, want = set(), set(), set()
    for a, b, p, d in sorted(rows, key=lambda r: (r[2], r[3], r[0], r[1])):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            want.add((a, b))
    got = matching.greedy_match(spark.createDataFrame(rows, "a int, b int, priority int, distance int"), "a", "b", ["priority", "distance"], materialise)
    assert {(r.a, r.b) for r in got.collect()} == want


def test_matching_nothing_is_empty(spark):
    assert matching.greedy_match(spark.createDataFrame([], "a int, b int, distance int"), "a", "b", ["distance"], materialise).count() == 0


def test_takeoff_after_a_ground_segment(spark):
    rows = [("x", t, True) for t in (800, 900, 1000, 1880)] + [("x", 1900, False)] + [("y", 0, True), ("y", 240, False)]
    points = spark.createDataFrame(rows, "icao string, t long, ground boolean")
    got = islands.takeoffs(points, "icao", "t", "ground", 900, 120, "t").collect()
    assert [(r.icao, r.takeoff, r.first_ground, r.n, r.widest_gap) for r in got] == [("x", 1900, 800, 4, 880)]


def test_a_gap_breaks_a_segment(spark):
    points = spark.createDataFrame([("x", t, True) for t in (0, 100, 700, 750)] + [("x", 800, False), ("x", 850, True)], "icao string, t long, ground boolean")
    got = [r.segment for r in islands.ground_segments(points, "icao", "t", "ground", 600, "t").orderBy("t").collect()]
    assert got == [1, 1, 2, 2, None, 3]


def test_id_joins_refuse_duplicates_and_gaps(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, 5), (1, 6)], "id int, v int")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("keys"))
    spark.sparkContext.setJobGroup("keys", "")
    twice, gaps = keys.join_by_id(a, b, "id"), keys.join_by_id(a, b.limit(1), "id", complete=True)
    assert jobs() == 0  # plans are built without running any
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for columns in (["id"], ["v"]):
        with pytest.raises(Exception, match="not a key"):
            twice.select(*columns).collect()
    with pytest.raises(Exception, match="no match on id"):
        gaps.collect()
    with pytest.raises(Exception, match="not a key"):
        keys.require_unique(spark.createDataFrame([(None, 1)], "id int, v int"), "id").collect()
    assert keys.join_by_id(a, b.limit(1), "id").count() == 2
    assert keys.require_unique(b, ["id", "v"]).count() == 2 and keys.require_unique(b, ["id", "v"]).columns == ["id", "v"]


def test_families_of_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "apt_a int, apt_b int, rwy_c int")
    assert keys.select_features(df, ["apt_"], drop=["apt_a"]) == ["apt_b"]
    with pytest.raises(KeyError):
        keys.select_features(df, ["apt_"], drop=["nope"])


def test_long_chains_of_pairs_need_no_rounds(spark):
    """Pairs that wait for each other in a line, by rounds and at once; nothing is capped."""
    greedy_match = matching.greedy_match
    chain = [(i // 2 + i % 2, i // 2, 1000 - i) for i in range(1000)]  # (left, right, order): each shares an id with the next
    df = spark.createDataFrame(chain, "l long, r long, d long")
    want, left, right = set(), set(), set()
    for a, b, _ in sorted(chain, key=lambda p: (p[2], p[0], p[1])):
        if a not in left and b not in right:
            want.add((a, b))
            left.add(a)
            right.add(b)
    got = greedy_match(df, "l", "r", ["d"], materialise)
    assert {(x.l, x.r) for x in got.collect()} == want and got.count() == len(want)
    some = df.filter("d > 994")
    assert {(x.l, x.r) for x in greedy_match(some, "l", "r", ["d"], materialise, finish=0).collect()} == {(x.l, x.r) for x in greedy_match(some, "l", "r", ["d"], materialise).collect()}
    assert greedy_match(df.limit(0), "l", "r", ["d"], materialise, finish=0).count() == 0


def test_blocks_are_put_together_by_id(spark):
    base = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id int, a double")
    one, two = spark.createDataFrame([(2, "x")], "id int, b string"), spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "id int, c int")
    assert sorted(tuple(r) for r in keys.assemble(base, [one, two], "id").collect()) == [(1, 1.0, None, 5), (2, 2.0, "x", 6)]
    for bad in (base, two.union(two)):
        with pytest.raises(Exception, match="stand in several|not a key"):
            keys.assemble(base, [bad], "id").collect()
    order = spark.createDataFrame([(2, 0), (1, 1)], "id int, place int")
    assert sorted((r.place, r.a) for r in keys.in_order(base, order, "id", "place").collect()) == [(0, 2.0), (1, 1.0)]
    for bad in (order.union(order), spark.createDataFrame([(9, 0)], "id int, place int")):
        with pytest.raises(Exception, match="not a key|no match"):
            keys.in_order(base, bad, "id", "place").collect()


def test_a_frame_of_blocks(spark):
    from ravelin.operators.frame import corrector_frame

    base, one = spark.createDataFrame([(1, 5.0), (2, 7.0)], "id int, pred double"), spark.createDataFrame([(1, 8.0, 1)], "id int, m double, n int")
    got = corrector_frame(base, {"a": one, "b": one.select("id", "n")}, "id", "pred", ["a_m"], without=["b_n", "elsewhere"], require=["a_n"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, 5.0, 8.0, 1, 3.0), (2, 7.0, None, None, None)] and got.columns == ["id", "pred", "a_m", "a_n", "a_m_less_pred"]
    with pytest.raises(KeyError):
        corrector_frame(base, {}, "id", "pred", require=["nope"])


def test_a_band_is_matched_without_its_pairs(spark):
    """Ties, equal times, nulls and borders of pieces: what one by one takes of all pairs; no frame is larger than the points."""
    import random

    rng, written = random.Random(3), []

    def save(df):
        written.append(materialise(df))
        return written[-1]

    points = [(i, rng.choice(["x", "x", "y", None]), None if i % 50 == 49 else rng.randint(0, 1000)) for i in range(900)]
    left = spark.createDataFrame([p for p in points if p[0] % 3], "l long, k string, t long").repartition(3)
    right = spark.createDataFrame([p for p in points if p[0] % 3 == 0], "r long, k string, u long")
    for finish in (0, 1000):
        written.clear()
        got = matching.greedy_band(left, right, ["k"], "t", "u", "l", "r", 40, save, finish).collect()
        pairs = [(abs(a[2] - b[2]), a[0], b[0]) for a in points for b in points if a[0] % 3 and b[0] % 3 == 0 and a[1] and a[1] == b[1] and None not in (a[2], b[2]) and abs(a[2] - b[2]) < 40]
        want, taken = set(), set()
        for d, a, b in sorted(pairs):
            if not taken & {a, b}:
                want.add((a, b, d))
                taken |= {a, b}
        assert {tuple(x) for x in got} == want and len(got) == len(want)
        assert len(pairs) > 3 * len(points) and max(x.count() for x in written) <= len(points)
    assert matching.greedy_band(left.limit(0), right, ["k"], "t", "u", "l", "r", 40, save).count() == 0


def test_the_matching_query_writes_no_pairs(spark, tmp_path, monkeypatch):
    """300 departures and 200 arrivals of one callsign within an hour: 60,000 pairs that wait for few."""
    from pyspark.sql import functions as F

    from ravelin.plans import window_queries

    rows = spark.range(500).select(F.col("id").alias("event_id"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 7919 % 3600)").alias("ts"), F.lit(0).cast("long").alias("user_id"), F.expr("IF(id % 5 < 3, 'view', 'error')").alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    written = []
    monkeypatch.setattr(window_queries, "materialise", lambda df, *a: written.append(materialise(df, *a)) or written[-1])
    got = window_queries.greedy_one_to_one(spark, str(tmp_path)).collect()
    assert len(got) == len({x.mvt_id for x in got}) == len({x.event_no for x in got}) == 200
    assert max(x.count() for x in written) <= 500
