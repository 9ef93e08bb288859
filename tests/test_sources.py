import gzip
import io
import json
import tarfile
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ravelin import functions as fn
from ravelin.operators import autofeatures as fe
from ravelin.operators import graph, traces
from ravelin.sources import readers, registry, sinks, storage


def test_observations(spark, tmp_path):
    (tmp_path / "m.csv").write_text("station,valid,tmpf,gust,wx\nLIRF,2025-01-01 00:20,50.0,null,FG\nLIRF,2025-01-01 00:50,M,12.5,M\nLIRF,bad,1,2,RA\n")
    got = readers.read_observations(spark, [str(tmp_path / "m.csv")], ["tmpf", "gust"]).orderBy("tmpf").collect()
    assert [(r.tmpf, r.gust, r.wx) for r in got] == [(None, 12.5, None), (1.0, 2.0, "RA"), (50.0, None, "FG")]
    assert got[1].valid is None


def test_series_keep_empty_days_null(spark, tmp_path):
    (tmp_path / "a.csv").write_text("day,apt,n\n1,X,50\n1,X,\n2,X,\n")
    (tmp_path / "b.csv").write_text("day,apt,n\n3,X,7\n")
    got = {r.day: r.n for r in readers.read_series(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], ["day", "apt"], ["n"]).collect()}
    assert got == {"1": 50.0, "2": None, "3": 7.0}


def test_months_ranges_and_typed_lines(spark, tmp_path):
    assert readers.month_files(["a_2025-01.parquet", "a_202502.parquet", "x"], [1]) == ["a_2025-01.parquet"]
    spark.sql("SELECT '2025-01-01 10:00:00' AS t, 1 AS v UNION ALL SELECT 'junk', 2").write.parquet(str(tmp_path / "p"))
    df = readers.read_months(spark, [str(tmp_path / "p")], ["t"])
    assert sorted(str(r.t) for r in df.collect())[-1] == "None"
    df.write.parquet(str(tmp_path / "q"))
    import datetime

    at = datetime.datetime(2025, 1, 1, 10, 30)
    assert readers.read_range(spark, str(tmp_path / "q"), "t", at, at, 3600, ["v"]).collect()[0].v == 1
    assert readers.read_range(spark, str(tmp_path / "q"), "t", at, at, 60).count() == 0
    (tmp_path / "apt.dat").write_text("I\n100 30 1\n1201 41.8 12.2 both 7\n\n1202 7 8 twoway\n99\n")
    got = readers.read_typed_lines(spark, [str(tmp_path / "apt.dat")], ["1201", "1202"]).orderBy("line").collect()
    assert [(r.kind, r.words[1]) for r in got] == [("1201", "41.8"), ("1202", "7")]


def test_trace_archives_skip_broken_members(spark, tmp_path):
    good = {"icao": "abc", "r": "EI-X", "t": "A320", "timestamp": 1000.0, "trace": [[0, 41.80, 12.25, "ground", 3.0, 0, 0, 0, {"flight": "AZA1 "}, "adsb"], [60, 41.80, 12.25, 1500, 150.0], [120, 50.0, 5.0, 1000, 150.0], [180, 41.80, 12.25, 9000, 300.0]]}
    with tarfile.open(tmp_path / "d.tar", "w") as tar:
        for name, raw in (("a.json", gzip.compress(json.dumps(good).encode())), ("b.json", b"\x1f\x8bbroken"), ("c.json", b"{}")):
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))
    points = traces.explode_points(readers.read_trace_archives(spark, [str(tmp_path / "d.tar")]))
    near = traces.near_airports(points, {"LIRF": (41.80, 12.24)}).orderBy("t").collect()
    assert [(r.t, r.ground, r.callsign, r.apt) for r in near] == [(1000.0, True, "AZA1", "LIRF"), (1060.0, False, "AZA1", "LIRF")]


def test_catalogue_reads_only_files_in_range(spark, tmp_path):
    day = lambda d, h=0: datetime(2025, 1, d, h)
    files = []
    for d in (1, 3, 5):
        path = str(tmp_path / f"d{d}")
        spark.createDataFrame([(day(d, h), h) for h in range(0, 24, 4)], "at timestamp, h int").coalesce(1).write.parquet(path)
        files.append((day(d), day(d, 23), path))
    known = readers.FileCatalogue(tuple(files))
    assert known.paths(day(3, 2), day(3, 4)) == [files[1][2]] and known.paths(day(3, 2), day(3, 4), timedelta(days=2)) == [files[0][2], files[1][2]]
    assert {r.h for r in known.read(spark, "at", day(3, 10), day(3, 11), timedelta(hours=2), timedelta(hours=2), ["h"]).collect()} == {8, 12}
    with pytest.raises(FileNotFoundError):
        known.read(spark, "at", day(20), day(21))
    df = readers.read_available(spark, [files[0][2]], ["h", "none"], ["a"])
    assert df.columns == ["h", "at"]
    assert readers.read_months(spark, [files[0][2]], ["at"]).filter("at > '2025-01-01 10:00'").count() == 3


def test_archives_in_parts(spark, tmp_path):
    whole = io.BytesIO()
    with tarfile.open(fileobj=whole, mode="w") as tar:
        for i in range(50):
            body = gzip.compress(json.dumps({"icao": f"a{i}", "timestamp": 100.0 + i, "trace": [[0, 1.0, 2.0, "ground", 3, 0, 0, 0, {"flight": "AB1 "}, "src"], [5, 1, 2]]}).encode())
            body = body[:9] if i == 7 else body
            info = tarfile.TarInfo(f"{i}.json")
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    raw = whole.getvalue()
    cut = len(raw) // 3
    for n, part in enumerate((raw[:cut], raw[cut : 2 * cut], raw[2 * cut :])):
        (tmp_path / f"day.tar.a{'abc'[n]}").write_bytes(part)
    (tmp_path / "other.tar").write_bytes(raw)
    for held in (1 << 30, 10):  # through Spark's reader, and streamed
        got = readers.read_trace_archives(spark, [str(tmp_path)], held=held).collect()
        assert sorted(r.icao for r in got) == sorted(2 * [f"a{i}" for i in range(50) if i != 7])
    first = next(r for r in got if r.icao == "a0")
    assert first.points[0].ground and first.points[0].alt is None and first.points[0].callsign == "AB1" and first.points[1].alt is None and first.start == 100.0


def archive(n, broken=()):
    whole = io.BytesIO()
    with tarfile.open(fileobj=whole, mode="w") as tar:
        for i in range(n):
            body = json.dumps({"icao": f"a{i}", "timestamp": 100.0 + i, "trace": [[0, 1.0, 2.0, "ground", 3]], "r": "x" * (i % 300)}).encode()
            info = tarfile.TarInfo(f"{'long/' * (30 if i % 9 == 0 else 1)}{i}.json")  # long names have headers of their own
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    return whole.getvalue()


@pytest.mark.parametrize("letters", [False, True])
def test_twelve_parts_are_read_in_the_order_of_their_numbers(spark, tmp_path, letters):
    raw = archive(200)
    step = -(-len(raw) // 12)
    for i in range(12):
        end = f"{'a'}{'abcdefghijkl'[i]}" if letters else str(i)
        (tmp_path / f"day.tar.{end}").write_bytes(raw[i * step : (i + 1) * step])
    got = readers.read_trace_archives(spark, [str(tmp_path)], piece=20_000)
    assert sorted(r.icao for r in got.collect()) == sorted(f"a{i}" for i in range(200))
    # Several tasks read one archive.
    assert got.groupBy(F.spark_partition_id()).count().count() >= 2
    (tmp_path / ("day.tar.ac" if letters else "day.tar.2")).unlink()
    with pytest.raises(Exception, match="lacks a part"):
        readers.read_trace_archives(spark, [str(tmp_path)]).count()


@pytest.mark.parametrize("held", [1 << 30, 10])
def test_an_archive_that_breaks_off_is_an_error(spark, tmp_path, held):
    raw = archive(60)
    second = raw.index(b'"a40"') - 200  # within a header or a file
    for cut in (second, second + 300):
        (tmp_path / "d.tar").write_bytes(raw[:cut])
        with pytest.raises(Exception, match="breaks off"):
            readers.read_trace_archives(spark, [str(tmp_path / "d.tar")], held=held).count()
        kept = readers.read_trace_archives(spark, [str(tmp_path / "d.tar")], held=held, keep_broken=True).collect()
        assert 35 <= len(kept) <= 40 and {r.icao for r in kept} == {f"a{i}" for i in range(len(kept))}
    (tmp_path / "d.tar").write_bytes(gzip.compress(raw))
    assert readers.read_trace_archives(spark, [str(tmp_path / "d.tar")], held=held).count() == 60
    (tmp_path / "d.tar").write_bytes(gzip.compress(raw)[:-500])
    with pytest.raises(Exception, match="breaks off"):
        readers.read_trace_archives(spark, [str(tmp_path / "d.tar")], held=held).count()


def failing(spark):
    """Rows, of which one fails after others were written."""
    return spark.range(0, 40, 1, 8).select(F.when(F.col("id") == 35, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id"))


def test_a_write_that_breaks_off_leaves_what_was_there(spark, tmp_path):
    root = str(tmp_path / "preds")
    sinks.write_predictions(spark.range(3), root, "r1")
    sinks.write_predictions(spark.range(5), root, "r2")
    with pytest.raises(Exception, match="broken"):
        sinks.write_predictions(failing(spark), root, "r1")
    counts = lambda: {r.run_id: r["count"] for r in spark.read.parquet(root).groupBy("run_id").count().collect()}
    assert counts() == {"r1": 3, "r2": 5}
    sinks.write_predictions(spark.range(7), root, "r1")
    assert counts() == {"r1": 7, "r2": 5}

    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        sinks.read_table(spark, path)
    sinks.write_table(spark.range(3), path)
    held = sinks.read_table(spark, path)
    with pytest.raises(Exception, match="broken"):
        sinks.write_table(failing(spark), path)
    assert sinks.read_table(spark, path).count() == 3
    sinks.write_table(spark.range(9), path)
    assert (sinks.read_table(spark, path).count(), held.count()) == (9, 3)  # a reader keeps the version that it began with
    assert len(sinks.drop_versions(spark, path)) == 3 and sinks.read_table(spark, path).count() == 9

    cache = str(tmp_path / "cache")
    with pytest.raises(Exception, match="broken"):
        registry.cached(spark, cache, {"x": 1}, lambda: failing(spark))
    assert [p for p in Path(cache).glob("*") if not p.name.startswith(".")] == []
    assert registry.cached(spark, cache, {"x": 1}, lambda: spark.range(4)).count() == 4
    # Another one builds the same and is first: its frame stays.
    both = lambda: registry.cached(spark, cache, {"x": 2}, lambda: spark.range(6)) and spark.range(1)
    assert registry.cached(spark, cache, {"x": 2}, both).count() == 6
    assert len([p for p in Path(cache).glob("*") if not p.name.startswith(".")]) == 2


def test_cached_frames_of_other_settings_are_evicted(spark, tmp_path):
    root = str(tmp_path / "cache")
    for x in (1, 2, 3):
        registry.cached(spark, root, {"x": x}, lambda: spark.range(1))
    (tmp_path / "cache" / "notes").mkdir()
    assert registry.evict(spark, root, [{"x": 2}]) == sorted(registry.content_key({"x": x}) for x in (1, 3))
    assert sorted(p.name for p in (tmp_path / "cache").iterdir()) == sorted([registry.content_key({"x": 2}), "notes"])
    assert registry.evict(spark, str(tmp_path / "none"), []) == []


def test_registry_and_cache(spark, tmp_path):
    path = str(tmp_path / "r.jsonl")
    for e in ({"id": "a", "v": 1}, {"id": "b", "v": 2}, {"id": "a", "v": 3}):
        registry.append_entry(path, e)
    df = registry.read_registry(spark, path, "id string, v int")
    assert {r.id: r.v for r in registry.first_entry(df, "id", "line").collect()} == {"a": 1, "b": 2}
    assert {r.id: r.v for r in registry.last_entry(df, "id", "line").collect()} == {"a": 3, "b": 2}
    assert registry.content_key({"a": 1, "b": 2}) == registry.content_key({"b": 2, "a": 1}) != registry.content_key({"a": 1})
    built = []
    build = lambda: built.append(1) or spark.range(3)
    for _ in range(2):
        assert registry.cached(spark, str(tmp_path / "c"), {"x": 1}, build).count() == 3
    assert len(built) == 1
    champion = registry.new_champion([{"base": "b1", "s": 1}, {"base": "b2", "s": 1}], ["late_line"])
    registry.save_champion(str(tmp_path / "champ.json"), champion)
    assert registry.load_champion(str(tmp_path / "champ.json"))["bases"] == ["b1", "b2"]
    with pytest.raises(ValueError):
        registry.new_champion([{"base": "b"}, {"base": "b"}], [])
    sinks.write_predictions(spark.range(2), str(tmp_path / "preds"), "r1")
    assert spark.read.parquet(str(tmp_path / "preds")).select("run_id").distinct().collect()[0].run_id == "r1"


def test_graph(spark):
    edges = spark.createDataFrame([("X", "S1", "n", 1.0), ("X", "n", "R", 2.0), ("X", "S2", "n", 5.0), ("X", "S2", "R", 9.0), ("X", "lone", "lone2", 1.0)], "apt string, a string, b string, w double")
    stands = spark.createDataFrame([("X", "S1"), ("X", "S2"), ("X", "lone")], "apt string, node string")
    runways = spark.createDataFrame([("X", "R")], "apt string, node string")
    table = graph.shortest_paths(edges, stands, runways, "apt", only_main=True)
    assert {(r.source, r.dist) for r in table.collect()} == {("S1", 3.0), ("S2", 7.0)}
    df = spark.createDataFrame([(1, "X", "s-1", "R"), (2, "X", "S2", "R"), (3, "X", "S9", "R")], "id int, apt string, stand string, rwy string")
    got = {r.id: (r.map_dist, r.map_extra) for r in graph.distance_columns(df, table, "apt", "stand", "rwy").collect()}
    assert got == {1: (3.0, 0.0), 2: (7.0, 0.0), 3: (None, None)}
    assert {r.id: r.map_dmin for r in graph.distance_columns(df, table, "apt", "stand", "rwy").collect()} == {1: 3.0, 2: 7.0, 3: None}
    points = spark.createDataFrame([(1, "X", 0.0, 0.0)], "id int, apt string, x double, y double")
    nodes = spark.createDataFrame([("X", "a", 1.0, 1.0), ("X", "b", -1.0, 0.5)], "apt string, node string, x double, y double")
    assert graph.nearest_nodes(points, nodes, "apt", "id").first().node == "b"


def test_nearest_nodes_of_the_main_component(spark):
    edges = spark.createDataFrame([("X", "a", "b", 1.0), ("X", "b", "c", 1.0), ("X", "far", "off", 1.0)], "apt string, a string, b string, w double")
    nodes = spark.createDataFrame([("X", "a", 5.0, 0.0), ("X", "b", 6.0, 0.0), ("X", "c", 9.0, 9.0), ("X", "far", 0.1, 0.0), ("X", "off", 3.0, 0.0)], "apt string, node string, x double, y double")
    points = spark.createDataFrame([(1, "X", 0.0, 0.0)], "id int, apt string, x double, y double")
    assert graph.nearest_nodes(points, nodes, "apt", "id").first().node == "far"
    assert graph.nearest_nodes(points, nodes, "apt", "id", edges).first().node == "a"


def test_stands_by_the_numbers_they_end_in(spark):
    """An exact name comes first; of stands that end alike the first in order; a letter before the number counts."""
    rows = [("X", s, "R1", d) for s, d in (("T1A23", 1.0), ("T2B23", 2.0), ("B23", 3.0), ("GATE7L", 4.0), ("Z9", 5.0))] + [("X", "Z9", "R2", 4.5)]
    table = spark.createDataFrame(rows, "apt string, source string, target string, dist double")
    names = {(r.alias): r.source for r in graph.stand_aliases(table, "apt").collect()}
    assert (names["B23"], names["A23"], names["23"], names["7L"], names["Z9"], names["9"]) == ("B23", "T1A23", "B23", "GATE7L", "Z9", "Z9")
    df = spark.createDataFrame([(1, "X", "a-23", "r1"), (2, "X", "7L", "R1"), (3, "X", "z9", "R2"), (4, "X", "z9", "none"), (5, "Y", "Z9", "R1")], "id int, apt string, stand string, rwy string")
    got = {r.id: (r.map_dist, r.map_dmin, r.map_extra) for r in graph.distance_columns(df, table, "apt", "stand", "rwy").collect()}
    assert got == {1: (1.0, 1.0, 0.0), 2: (4.0, 4.0, 0.0), 3: (4.5, 4.5, 0.0), 4: (None, 4.5, None), 5: (None, None, None)}


def test_metres_on_the_globe(spark):
    x, y = fn.flat_metres(F.lit(60.0), F.lit(1.0), 60.0)
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert r.y == pytest.approx(60 * 111_194.9266, rel=1e-8) and r.x == pytest.approx(111_194.9266 / 2, rel=1e-8)


class Elsewhere:
    """A session whose master is no local one and that names no shared folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)


def test_storage_needs_a_shared_folder_on_a_cluster(spark):
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        Elsewhere.sparkContext.master = master
        with pytest.raises(RuntimeError):
            storage.shared_root(Elsewhere())
    Elsewhere.sparkContext.master = "local[4]"
    assert storage.shared_root(Elsewhere()).startswith("file:")


def test_released_frames_are_gone(spark):
    frame = storage.materialise(spark.range(5), "five")
    assert frame.count() == 5 and any(p == frame._ravelin_path for _, p in storage._written)
    storage.release(frame)
    assert not any(p == frame._ravelin_path for _, p in storage._written)
    assert not Path(frame._ravelin_path.removeprefix("file://")).exists()


def test_scalar_functions(spark):
    df = spark.createDataFrame([("AZA12", "b12-(A)", "FG")], "flight string, stand string, wx string")
    r = df.select(fn.airline(F.col("flight")).alias("a"), fn.stand_prefix(F.col("stand")).alias("s"), fn.plain_name(F.col("stand")).alias("p"), fn.weather_flags(F.col("wx"))["fog"].alias("f")).first()
    assert tuple(r) == ("AZA", "b", "B12", 1)
    us = F.lit(1_736_000_100_000_000)  # 2025-01-04 14:15:00, a Saturday
    r = df.select(fn.hour_of_day(us).alias("h"), fn.weekday(us).alias("d"), fn.rounding_score(us).alias("r"), fn.rounding_score(us + 60_000_000).alias("r1"), fn.rounding_score(us + 1_000_000).alias("r0")).first()
    assert tuple(r) == (14.25, 5, 2, 1, 1)  # second and minute count by themselves


def test_auto_features(spark):
    specs = fe.candidates(["x", "y"], [["k"]])
    assert len({fe.name(s) for s in specs}) == len(specs) == 3 + 2 * (len(fe.GROUPED) - 1) + 1
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i), float(i * i % 7)) for i in range(20)], "id int, k string, x double, y double")
    assert fe.add_features(df, specs).count() == 20
    assert fe.sample_by_hash(df, "id", 5, 1).collect() == fe.sample_by_hash(df, "id", 5, 1).collect()
    dealt = fe.placebo(df, "x", "id", 3, "x2")
    assert sorted(r.x2 for r in dealt.collect()) == sorted(float(i) for i in range(20))
    scores = fe.correlation_screen(df, specs, "x")
    assert fe.survivors(scores, 0.1, None, 1, 3).count() == 3


def test_a_settled_frame_leaves_nothing_behind_it(spark):
    from pyspark.sql import functions as F

    from ravelin.sources import storage

    def make():
        inner = storage.materialise(spark.range(100), "inner")
        return inner.groupBy((F.col("id") % 7).alias("k")).count()

    before = set(storage._written)
    got = storage.settled(spark, make, "outer")
    assert {r["k"]: r["count"] for r in got.collect()} == {k: 15 if k < 2 else 14 for k in range(7)}
    new = set(storage._written) - before
    assert [p for _, p in new] == [got._ravelin_path]
    storage.release(got)
