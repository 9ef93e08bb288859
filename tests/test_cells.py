import math
import random

import pytest
from pyspark.sql import functions as F

from ravelin.operators import cells, rules


def test_thin_cells_fall_back_and_outliers_are_clipped(spark):
    rows = [("A", "S1", "R", 600.0)] * 9 + [("A", "S2", "R", 600.0)] * 10 + [("A", "S2", "R", 86_400.0)]
    train = spark.createDataFrame(rows, "airport string, stand string, runway string, y double")
    levels = [(k, cells.stat_cells(train, k, "y")) for k in (["airport", "stand", "runway"], ["airport", "runway"])]
    ask = spark.createDataFrame([(1, "A", "S1", "R"), (2, "A", "S2", "R"), (3, "Z", "S1", "R"), (4, "A", None, "R")], "id int, airport string, stand string, runway string")
    got = {r.id: r for r in cells.fallback(ask, levels, ["median", "p90", "sd", "n"], "cel_", "level").collect()}
    assert (got[1].level, got[1].cel_n) == (1, 20)
    assert (got[2].level, got[2].cel_median, got[2].cel_n) == (0, 600.0, 11)
    assert got[2].cel_sd == pytest.approx(6600 / math.sqrt(11))
    assert got[3].cel_median is None and got[3].level is None
    assert got[4].level == 1


@pytest.mark.parametrize("most", [50_000, 3])
def test_levels_in_one_plan_are_the_levels_one_by_one(spark, most):
    """Also where cells are so large that their values are put in order by ranges."""
    rng = random.Random(1)
    rows = [(i, rng.choice(["A", "A", "B", None]), rng.choice(["S1", "S2", None]), rng.choice(["x", "y"]), None if i % 17 == 0 else float(rng.choice([5, 60, 600, 9000, rng.randint(0, 700)]))) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, airport string, stand string, wake string, y double")
    for levels in ((["airport", "stand", "wake"], ["airport", "stand"], ["airport"]), (["stand", "wake"], ["airport"])):
        values = ["median", "p90", "sd", "n"]
        old = cells.fallback(df, [(k, cells.stat_cells(df, k, "y", 40)) for k in levels], values, "cel_", "level")
        new = cells.best_level(df, levels, cells.stat_levels(df, levels, "y", 40, most=most), values, "cel_", "level")
        assert new.columns == old.columns
        key = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
        assert {r.id: key(r) for r in new.collect()} == {r.id: key(r) for r in old.collect()}
        old = cells.fallback(df, [(k, cells.quantile_cells(df, k, "y")) for k in levels], ["ref"], "")
        new = cells.best_level(df, levels, cells.quantile_levels(df, levels, "y", most=most), ["ref"], "")
        assert {r.id: r.ref for r in new.collect()} == {r.id: r.ref for r in old.collect()}


def test_levels_read_their_table_once(spark, tmp_path):
    spark.createDataFrame([(i, "A", f"S{i % 3}", float(i)) for i in range(60)], "id int, airport string, stand string, y double").write.parquet(f"{tmp_path}/t")
    train = spark.read.parquet(f"{tmp_path}/t")
    levels = (["airport", "stand"], ["airport"])
    found = cells.stat_levels(train, levels, "y")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert f"{tmp_path}" not in plan and "Join" not in plan  # counts were written; no join while all cells are small
    assert found.count() == 4


def test_p10_needs_rows_at_or_below_it(spark):
    train = spark.createDataFrame([("a", float(i)) for i in range(50)] + [("b", float(i)) for i in range(100)], "k string, y double")
    got = {r.k: r.ref for r in cells.quantile_cells(train, ["k"], "y").collect()}
    assert got == {"b": pytest.approx(9.9)}


def test_rates_without_the_own_block(spark):
    history = spark.createDataFrame([("X", "AA", 1, 4, 2), ("X", "AA", 2, 8, 8), ("X", "BB", 2, 4, 0)], "apt string, cia string, block int, n int, h int")
    ask = spark.createDataFrame([(1, "X", "AA", 1), (2, "X", "AA", 2), (3, "X", "ZZ", 1), (4, "Q", "AA", 1)], "id int, apt string, cia string, block int")
    got = {r.id: r.rate for r in cells.leave_own_block_out(history, ask, ["apt", "cia"], ["apt"], "block", "n", "h").collect()}
    assert got[1] == pytest.approx((8 + 20 * 2 / 3) / 28)
    assert got[2] == pytest.approx((2 + 20 * 0.5) / 24)
    assert got[3] == pytest.approx(2 / 3)
    assert got[4] is None


def test_own_block_does_not_move_its_rate(spark):
    ask = spark.createDataFrame([(1, "X", "AA", 1)], "id int, apt string, cia string, block int")
    rate = lambda h: cells.leave_own_block_out(spark.createDataFrame([("X", "AA", 1, 9, h), ("X", "AA", 2, 8, 3)], "apt string, cia string, block int, n int, h int"), ask, ["apt", "cia"], ["apt"], "block", "n", "h").first().rate
    assert rate(0) == rate(9)


def test_blocks_know_the_others_only(spark):
    rows = spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 30.0), (3, 40.0)], "block int, y double")
    got = {r.block: r.s for r in cells.by_block(rows, "block", rows).groupBy("block").agg(F.sum("y").alias("s")).collect()}
    assert got == {1: 70.0, 2: 70.0, 3: 60.0}


def test_lines_and_their_fallback(spark):
    rows = [("a", float(x), 2.0 * x + 1) for x in range(60)] + [("b", float(x), 0.0) for x in range(5)] + [("a", None, 5.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    fitted = cells.lines(df, "k", "x", "y")
    assert {r.k for r in fitted.collect()} == {"a", None}
    ask = spark.createDataFrame([(1, "a", 100.0), (2, "b", 1.0), (3, "a", None), (4, "a", -100.0)], "id int, k string, x double")
    got = {r.id: r.line for r in cells.apply_lines(ask, fitted, "k", "x", "line").collect()}
    assert got[1] == pytest.approx(201) and got[2] > 0 and got[3] is None and got[4] == 0


def test_group_features(spark):
    df = spark.createDataFrame([(1, "a", 10.0), (2, "a", 20.0), (3, "b", 5.0), (4, None, 1.0), (5, None, 1.0), (6, "a", None)], "id int, k string, x double")
    got = {r.id: r for r in cells.group_features(df, "x", ["k"]).collect()}
    assert (got[1].g_mean, got[1].g_sd, got[1].g_pos) == (15.0, 5.0, 0.5)
    assert got[2].g_pos == 1.0 and got[3].g_sd is None and got[6].g_pos is None
    assert (got[4].g_n, got[4].g_pos) == (2, 0.75)


def test_vocabulary(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "b", "a", "a", "c", None]], "v string")
    top = cells.top_values(df, "v", 2)
    assert [r.v for r in top.collect()] == ["a", "b"]
    assert sorted(str(r.v) for r in cells.cap_values(df, top, "v").collect()) == ["None", "a", "a", "b", "b", "other"]


def test_leaky_columns(spark):
    train = spark.createDataFrame([(1, 1), (2, None)], "good int, bad int")
    other = spark.createDataFrame([(1, None), (2, None)], "good int, bad int")
    assert [r["column"] for r in cells.leaky_columns(train, other, ["good", "bad"], 0.6).collect()] == ["bad"]


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'string' if isinstance(v, str) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in values.values())], schema).select(column.alias("x")).first().x


def test_rules(spark):
    c = F.col
    assert one(spark, rules.mixture(c("p"), c("ms"), c("reg")), p=0.5, ms=100, reg=300) == 200
    assert one(spark, rules.mixture(c("p"), c("ms"), c("reg")), p=0.5, ms=None, reg=300) == 300
    assert one(spark, rules.mixture(c("p"), c("ms"), c("reg")), p=1.0, ms=-50, reg=300) == 0
    assert one(spark, rules.project(c("p"), c("lo"), c("hi")), p=5, lo=10, hi=20) == 10
    assert one(spark, rules.project(c("p"), c("lo"), c("hi")), p=5, lo=None, hi=None) == 5
    assert one(spark, rules.project(c("p"), c("lo"), c("hi")), p=None, lo=1, hi=2) is None
    assert one(spark, rules.copy_possible(c("p"), c("ms"), c("lo"), c("hi")), p=0.7, ms=5, lo=10, hi=20) == 0
    assert one(spark, rules.copied(c("a"), c("b")), a=60e6, b=0.0) is True
    assert one(spark, rules.copied(c("a"), c("b")), a=None, b=0.0) is False
    line = rules.between_rows(c("n"), c("ms"), c("a"), "X")
    assert [one(spark, line, n=True, ms=h * 3600, a="X") for h in (15, 16, 30, 31)] == [False, True, True, False]
    with pytest.raises(KeyError):
        rules.apply_rules(c("p"), ["nope"], c("n"), c("ms"))


def test_weights_have_mean_one(spark):
    df = spark.createDataFrame([(900.0,), (1900.0,), (None,)], "ms double")
    got = [r.weight for r in rules.classifier_weight(df, "ms").collect()]
    assert got[2] == 0 and sum(got) / 2 == pytest.approx(1) and got[1] / got[0] == pytest.approx(1000 / 60)


def test_exact_quantiles_are_those_of_all_values(spark):
    import random

    import numpy as np

    rng = random.Random(3)
    groups = {"few": [5.0], "ties": [1.0] * 30 + [2.0] * 10, "signed": [rng.gauss(0, 1e3) for _ in range(400)], "whole": [float(rng.randrange(50)) for _ in range(301)], "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-9, 12) for _ in range(200)], "zero": [0.0] * 7}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [(None, 1.0), ("few", None)], "k string, y double")
    qs = {"low": 0.0, "p10": 0.1, "mid": 0.5, "p90": 0.9, "high": 1.0}
    got = {r.k: r for r in cells.exact_quantiles(cells.value_counts(df, ["k"], "y"), ["k"], "y", qs).collect()}
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        assert got[k].total == len(vs)
        for name, q in qs.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, q), rel=1e-12, abs=1e-9)
            assert got[k][f"{name}_rows"] == sum(v <= got[k][name] for v in vs)
    whole = cells.exact_quantiles(cells.value_counts(df.filter("k IS NOT NULL"), [], "y"), [], "y", {"mid": 0.5}).first()
    assert whole.mid == pytest.approx(np.quantile([v for vs in groups.values() for v in vs], 0.5))
    assert cells.exact_quantiles(cells.value_counts(df.limit(0), ["k"], "y"), ["k"], "y", qs).count() == 0


def test_quantiles_hold_no_group_in_a_task(spark):
    df = spark.createDataFrame([("a", 1.0)], "k string, y double")
    for got in (cells.quantile_cells(df, ["k"], "y"), cells.stat_cells(df, ["k"], "y"), cells.block_stat_cells(df, "y", ["k"], "y")):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "percentile" not in plan and "collect_list" not in plan


def test_means_and_cells_of_the_other_blocks(spark):
    rows = spark.createDataFrame([(1, "a", 10.0), (1, "a", 20.0), (2, "a", 30.0), (3, "b", 40.0), (2, "b", None)], "block int, k string, y double")
    got = {(r.block, r.k): (r["mean"], r.n) for r in cells.other_block_means(rows, "block", ["k"], "y").collect()}
    assert got == {(1, "a"): (30.0, 1), (2, "a"): (15.0, 2), (3, "a"): (20.0, 3), (1, "b"): (40.0, 1), (2, "b"): (40.0, 1)}
    got = {(r.block, r.k): (r.median, r.n) for r in cells.block_stat_cells(rows, "block", ["k"], "y", least=1).collect()}
    assert got == {(1, "a"): (30.0, 1), (2, "a"): (15.0, 2), (3, "a"): (20.0, 3), (1, "b"): (40.0, 1), (2, "b"): (40.0, 1)}


def test_features_against_the_whole(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", 20.0), ("b", 40.0), ("b", None), (None, 50.0)], "k string, x double")
    got = {(r.k, r.x): r for r in cells.group_features(df, "x", ["k"]).collect()}
    assert got["a", 10.0].g_cmean == pytest.approx(-15.0) and got["b", None].g_cmean == pytest.approx(10.0)
    assert got["a", 20.0].g_rsd == pytest.approx(5 / 250**0.5) and got["b", 40.0].g_rsd is None and got[None, 50.0].g_pos == 1.0
    same = cells.group_features(spark.createDataFrame([("a", 1.0), ("a", 1.0)], "k string, x double"), "x", ["k"]).first()
    assert same.g_z is None and same.g_rsd is None
