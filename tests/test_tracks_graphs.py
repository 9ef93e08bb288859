"""Tracks in pieces, graphs by rounds and places by ranges, against plain versions."""

import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from ravelin.operators import cells, graph, islands, traces, tracks


def track_rows(seed, n=300):
    rng = random.Random(seed)
    return [(i, rng.choice(["hot", "hot", "b", None]), rng.randint(-500, 3000), rng.random() < 0.7, rng.choice([None, None, "X", "Y"]), rng.randint(0, 4)) for i in range(n)]


@pytest.mark.parametrize(("width", "span"), [(1, 3), (40, 4), (10_000, 4096)])
def test_neighbours_sums_and_last_known(spark, monkeypatch, width, span):
    monkeypatch.setattr(tracks, "SPAN", span)
    rows = track_rows(width)
    df = spark.createDataFrame(rows, "id long, icao string, t long, ground boolean, callsign string, v int").repartition(4)
    got = tracks.neighbours(df, "icao", "t", "id", width, ["v"])
    summed = {r["id"]: r for r in tracks.running_sum(got, "icao", "t", "id", "v", "upto").collect()}
    heard = {r["id"]: r["callsign"] for r in traces.with_callsigns(df, "icao", "t", "id", width).collect()}
    for name in ("hot", "b", None):
        own = sorted((r for r in rows if r[1] == name), key=lambda r: (r[2], r[0]))
        total, last = 0, None
        for before, r, after in zip([None, *own[:-1]], own, [*own[1:], None], strict=True):
            total, last = total + r[5], r[4] or last
            s = summed[r[0]]
            told = lambda x: None if x is None else (x["t"], x["id"], x["v"])
            plain = lambda x: None if x is None else (x[2], x[0], x[5])
            assert (told(s["__before"]), told(s["__after"]), s["upto"], heard[r[0]]) == (plain(before), plain(after), total, last)
    assert len(summed) == len(heard) == len(rows)


@pytest.mark.parametrize("wide", [1, 64])
def test_segments_and_takeoffs_by_hand(spark, monkeypatch, wide):
    monkeypatch.setattr(islands, "WIDE", wide)
    monkeypatch.setattr(tracks, "SPAN", 3)
    rows = [r for r in track_rows(7, 400) if r[1]]
    df = spark.createDataFrame(rows, "id long, icao string, t long, ground boolean, callsign string, v int")
    got = {(r["icao"], r["segment"]): (r["first_ground"], r["n"], r["widest_gap"], r["takeoff"], r["first_v"]) for r in islands.takeoffs(df, "icao", "t", "ground", 30, 9, "id", first=["v"]).collect()}
    numbers = {r["id"]: r["segment"] for r in islands.ground_segments(df, "icao", "t", "ground", 30, "id").collect()}
    want = {}
    for name in ("hot", "b"):
        own, seg, before = sorted((r for r in rows if r[1] == name), key=lambda r: (r[2], r[0])), 0, None
        for r, after in zip(own, [*own[1:], None], strict=True):
            if r[3] and (before is None or not before[3] or r[2] - before[2] >= 30):
                seg += 1
                want[name, seg] = [r[2], 0, None, None, r[5]]
            elif r[3]:
                x = want[name, seg]
                x[2] = max(x[2] or 0, r[2] - before[2])
            assert numbers[r[0]] == (seg if r[3] else None)
            if r[3]:
                want[name, seg][1] += 1
                if after and not after[3] and after[2] - r[2] < 9:
                    want[name, seg][3] = after[2]
            before = r
    assert got == {k: tuple(v) for k, v in want.items() if v[3] is not None}


def test_no_points_are_dealt_by_track_alone(spark):
    df = spark.createDataFrame(track_rows(1), "id long, icao string, t long, ground boolean, callsign string, v int")
    plan = islands.takeoffs(df, "icao", "t", "ground", 30, 9, "id")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    alone = [i for i, line in enumerate(plan) if "Window [" in line and re.search(r"\], \[icao#\d+\], \[", line)]
    assert alone and any("Window [" in line and "__b" in line for line in plan)
    for i in alone:  # only sums over SPAN buckets are
        below = next(line for line in plan[i + 1 :] if "Aggregate" in line or "Window" in line or "Join" in line)
        assert "Aggregate [icao" in below and "__u" in below


def dijkstra(edges, source):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    done, heap = {}, [(0.0, source)]
    while heap:
        d, x = heapq.heappop(heap)
        if x in done:
            continue
        done[x] = d
        for y, w in near.get(x, []):
            heapq.heappush(heap, (d + w, y))
    return done


@pytest.mark.parametrize("main", [False, True])
def test_shortest_paths_and_components(spark, main):
    rng = random.Random(6)
    edges = {g: [(f"n{rng.randint(0, 40):02}", f"n{rng.randint(0, 40):02}", float(rng.randint(1, 9))) for _ in range(m)] for g, m in (("p", 45), ("q", 25), ("r", 1))}
    edges["chain"] = [(f"c{i:02}", f"c{i + 1:02}", 1.0) for i in range(30)]
    df = spark.createDataFrame([(g, *e) for g, es in edges.items() for e in es], "g string, a string, b string, w double")
    names = {g: sorted({x for a, b, _ in es for x in (a, b)}) for g, es in edges.items()}
    sources = [(g, n) for g, ns in names.items() for n in ns[::2]] + [("p", "nowhere"), ("none", "n01")]
    targets = [(g, n) for g, ns in names.items() for n in ns[:3]] + [("p", "nowhere")]
    node = lambda rows: spark.createDataFrame(rows + rows[:2], "g string, node string")
    comps = {g: {n: min(dijkstra(es, n)) for n in names[g]} for g, es in edges.items()}
    assert {(r["g"], r["node"]): r["root"] for r in graph.components(df, "g").collect()} == {(g, n): c for g, x in comps.items() for n, c in x.items()}
    keep = {g: min(set(x.values()), key=lambda c: (-list(x.values()).count(c), c)) for g, x in comps.items()}
    assert {(r["g"], r["node"]) for r in graph.main_nodes(df, "g").collect()} == {(g, n) for g, x in comps.items() for n, c in x.items() if c == keep[g]}
    inside = lambda g, n: g in comps and n in comps[g] and (not main or comps[g][n] == keep[g])
    want = {(g, s, t): dijkstra(edges[g], t)[s] for g, t in targets if inside(g, t) for h, s in sources if h == g and inside(g, s) and s in dijkstra(edges[g], t)}
    got = graph.shortest_paths(df, node(sources), node(targets), "g", only_main=main)
    assert {(r["g"], r["source"], r["target"]): r["dist"] for r in got.collect()} == want
    assert graph.shortest_paths(df.limit(0), node(sources), node(targets), "g").count() == 0


def test_nearest_nodes_by_a_grid(spark):
    """Clusters, ties, single nodes, nodes all in one place, points far outside, groups without nodes."""
    rng = random.Random(8)
    nodes = [("a", f"n{i:02}", rng.gauss(0, 1) + rng.choice([0, 500]), rng.gauss(0, 1)) for i in range(40)] + [("a", "tie1", 50.0, 50.0), ("a", "tie0", 50.0, 50.0), ("b", "only", 3.0, 4.0), ("c", "x", 7.0, 7.0), ("c", "w", 7.0, 7.0)]
    points = [(i, rng.choice("aaabcd"), rng.uniform(-100, 600), rng.uniform(-200, 200)) for i in range(200)] + [(900, "a", 50.0, 51.0), (901, "b", 1e6, -1e6), (902, "a", None, 1.0)]
    got = graph.nearest_nodes(spark.createDataFrame([(g, i, x, y) for i, g, x, y in points], "g string, id long, x double, y double"), spark.createDataFrame(nodes, "g string, node string, x double, y double"), "g", "id")
    want = {}
    for i, g, x, y in points:
        own = [((x - a) * (x - a) + (y - b) * (y - b), n) for h, n, a, b in nodes if h == g and x is not None]
        if own:
            want[i] = min(own)
    assert {r["id"]: (r["d2"], r["node"]) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # what was found is written, round by round


def test_places(spark):
    rng = random.Random(2)
    rows = [(i * 3, rng.choice([5.0, 5.0, 5.0, rng.uniform(-9, 9)])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, x double").repartition(5)
    for down in (False, True):
        order = sorted(rows, key=lambda r: (-r[1] if down else r[1], r[0]))
        assert {r["id"]: r["place"] for r in cells.places(df, "x", "id", descending=down).collect()} == {i: k for k, (i, _) in enumerate(order)}
    assert cells.places(df.limit(0), "x", "id").count() == 0


def test_matching_by_rounds_in_the_query():
    import inspect

    from ravelin.plans import window_queries

    assert "finish=1000" in inspect.getsource(window_queries.greedy_one_to_one)
