"""Histogram trees against an exhaustive search, with missing values, categories and several slots at once."""

import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from ravelin.models import boosting
from ravelin.models.boosting import Params, Slot
from ravelin.sources.storage import materialise


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        a = None if rng.random() < 0.3 else float(rng.randint(0, 30))
        b, c = float(rng.randint(0, 12)), rng.choice(["u", "v", "w", "x", None])
        y = (40.0 if a is None else 10.0 if a < 9 else 25.0) + (15 if c in ("u", "x") else 0) + b + rng.gauss(0, 1)
        rows.append((i, a, float("nan") if i % 7 == 0 else b, c, y, float(i % 3), 1.0 + i % 2, float(y > 35)))
    return materialise(spark.createDataFrame(rows, "id long, a double, b double, c string, y double, block double, w double, label double").repartition(4), "table")


P = Params(numeric=("a", "b"), categorical=("c",), rounds=6, rate=0.5, leaves=6, depth=4, least_rows=10)


def error(df, pred):
    return df.agg(F.sqrt(F.avg((F.col(pred) - F.col("y")) ** 2))).first()[0]


def exhaustive(rows, leaves, depth, least, l2, smooth):
    """Best-first growth where every cut of every feature is tried on the rows themselves: the leaves' rows."""
    mean = np.mean([r["y"] for r in rows])
    miss = lambda v: v is None or v != v

    def best(part):
        g, n = sum(mean - r["y"] for r in part), len(part)
        found = (1e-9, None)
        for f in ("a", "b", "c"):
            seen = [r for r in part if not miss(r[f])]
            gone = [r for r in part if miss(r[f])]
            if f == "c":
                order = sorted({r[f] for r in seen}, key=lambda v: (sum(mean - r["y"] for r in seen if r[f] == v) / (sum(r[f] == v for r in seen) + smooth), v))
            else:
                order = sorted({r[f] for r in seen})
            for k in range(len(order)):
                for with_gone in (False, True) if gone else (False,):
                    left = [r for r in seen if r[f] in order[: k + 1]] + (gone if with_gone else [])
                    if min(len(left), n - len(left)) < least:
                        continue
                    gl = sum(mean - r["y"] for r in left)
                    gain = gl**2 / (len(left) + l2) + (g - gl) ** 2 / (n - len(left) + l2) - g**2 / (n + l2)
                    if gain > found[0] * (1 + 1e-9):
                        ids = {r["id"] for r in left}
                        found = (gain, [r["id"] for r in part if r["id"] in ids], [r["id"] for r in part if r["id"] not in ids])
        return found

    by_id = {r["id"]: r for r in rows}
    open_ = [(0, best(rows), [r["id"] for r in rows])]
    while len(open_) < leaves:
        able = [x for x in open_ if x[0] < depth and x[1][1] is not None]
        if not able:
            break
        node = max(able, key=lambda x: x[1][0])
        open_.remove(node)
        for ids in node[1][1:]:
            part = [by_id[i] for i in ids]
            open_.append((node[0] + 1, best(part), ids))
    return {tuple(sorted(ids)) for _, _, ids in open_}


@pytest.mark.parametrize(("leaves", "depth"), [(2, 6), (5, 6), (9, 3)])
def test_trees_are_those_of_an_exhaustive_search(table, leaves, depth):
    some = table.filter("id < 260")
    p = Params(numeric=("a", "b"), categorical=("c",), rounds=1, rate=1.0, leaves=leaves, depth=depth, least_rows=10)
    got = boosting.fit(some, p, [Slot("y")])
    rows = [r.asDict() for r in some.collect()]
    leaf = {}
    for r in got.predict(some, "p").select("id", "p").collect():
        leaf.setdefault(r["p"], []).append(r["id"])
    assert {tuple(sorted(x)) for x in leaf.values()} == exhaustive(rows, leaves, depth, 10, p.l2, p.cat_smooth)


def test_missing_values_are_learned_and_not_replaced(spark):
    """Nulls that behave like high values: trees that learn their side are better than as deep ones with a number in their place."""
    rng = random.Random(8)
    rows = []
    for _ in range(800):
        a, b = None if rng.random() < 0.4 else float(rng.randint(0, 30)), float(rng.randint(0, 12))
        rows.append((a, b, (40.0 if (a is None or a > 20) and b > 6 else 0.0) + rng.gauss(0, 1)))
    df = materialise(spark.createDataFrame(rows, "a double, b double, y double").withColumn("id", F.monotonically_increasing_id()), "planted")
    train, test = df.filter("id % 4 <> 0"), df.filter("id % 4 = 0")
    got = boosting.fit(train, Params(numeric=("a", "b"), rounds=2, rate=1.0, leaves=3, depth=2), [Slot("y")]).predict(test, "p")
    filled = lambda df: VectorAssembler(inputCols=["v", "b"], outputCol="features").transform(df.withColumn("v", F.coalesce("a", F.lit(-1e7))))
    plain = GBTRegressor(labelCol="y", maxIter=2, maxDepth=2, stepSize=1.0, seed=1).fit(filled(train)).transform(filled(test))
    assert error(got, "p") < 0.8 * error(plain, "prediction")
    nulls = got.filter("a IS NULL AND b > 6")
    assert abs(nulls.agg(F.avg("p") - F.avg("y")).first()[0]) < 4


def test_slots_are_models_of_their_own(table):
    """Fitted together they are the models that fits one by one give; the same trees come out of other partitions."""
    df = table.withColumn("not0", (F.col("block") != 0).cast("double")).withColumn("not1", (F.col("block") != 1).cast("double")).withColumn("half", F.when(F.col("id") % 2 == 0, F.col("y")))
    slots = [Slot("y", "not0"), Slot("y", "not1", seed=3), Slot("half", "w"), Slot("label", loss="logistic")]
    p = Params(numeric=("a", "b"), categorical=("c",), rounds=3, leaves=6, depth=3, keep=2, row_share=0.8)
    values = lambda m: {r["id"]: list(r["v"]) for r in df.select("id", m.column().alias("v")).collect()}
    first = values(boosting.fit(df, p, slots))
    assert values(boosting.fit(df.repartition(7), p, slots)) == first
    for i in (1, 2):
        alone = values(boosting.fit(df, p, [slots[i]]))
        assert all(v[0] == first[k][i] for k, v in alone.items())
    assert all(0 < v[3] < 1 for v in first.values())
    blind = boosting.fit(df.withColumn("y", F.when(F.col("block") == 0, F.col("y") + 100).otherwise(F.col("y"))), p, slots[:1])
    assert {k: v[0] for k, v in values(blind).items()} == {k: v[0] for k, v in first.items()}


def test_reports_while_it_runs_and_stops(table):
    df = table.withColumn("test", (F.col("id") % 3 == 0).cast("double"))
    told = []
    p = Params(numeric=("b",), rounds=25, rate=1.0, leaves=12, least_rows=1, patience=2)
    got = boosting.fit(df, p, [Slot("y", valid="test")], report=lambda *x: told.append(x))
    rounds = [r for _, r, _, _ in told]
    assert rounds == list(range(len(told))) and 3 <= len(told) < 25
    losses = [v for *_, v in told]
    assert len(got.trees[0]) == int(np.argmin(losses)) and told[-1][2] <= told[0][2]
    assert got.curve[0] == [x[1:] for x in told]


def test_classifier_and_unseen_values(table):
    got = boosting.fit(table, P, [Slot("label", "w", loss="logistic")])
    rows = got.predict(table, "p")
    assert rows.agg(F.avg(F.abs(F.col("p") - F.col("label")))).first()[0] < 0.25
    new = table.limit(3).withColumn("c", F.lit("new")).withColumn("a", F.lit(None).cast("double"))
    assert got.predict(new, "p").filter("p > 0 AND p < 1").count() == 3


def test_nothing_to_learn_from(table):
    p = Params(numeric=("a",), rounds=2)
    none = table.withColumn("y", F.lit(None).cast("double"))
    assert boosting.fit(none, p, [Slot("y")]).predict(table.limit(2), "p").filter("p = 0").count() == 2
    assert boosting.fit(table.limit(0), p, [Slot("y")]).predict(table.limit(2), "p").filter("p = 0").count() == 2
    one = boosting.fit(table.withColumn("y", F.lit(5.0)), p, [Slot("y")]).predict(table.limit(2), "p")
    assert one.filter("p = 5").count() == 2
    with pytest.raises(ValueError):
        boosting.fit(table, Params(numeric=("a",), bins=300), [Slot("y")])


def test_every_pass_is_spread_and_a_slot_looks_at_its_own_rows(spark, table, monkeypatch):
    """A table of one partition is dealt to all cores before the passes, and gradients are made of rows that a slot learns from."""
    dealt = []
    monkeypatch.setattr(boosting, "materialise", lambda df, *a: dealt.append(materialise(df, *a)) or dealt[-1])
    monkeypatch.setattr(boosting, "release", lambda df: None)
    one = table.withColumn("own", (F.col("block") == 1).cast("double")).coalesce(1)
    slots = [Slot("y"), Slot("y", "own")]
    models = boosting.fit(one, P, slots)
    assert dealt[-1].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    alone = boosting.fit(one.filter("block = 1"), P, [Slot("y", "own")], binner=models.binner)
    got = table.withColumns({"a1": models.column([1])[0], "a2": alone.column()[0]})
    assert got.filter("abs(a1 - a2) > 1e-9").count() == 0


def test_trees_by_columns_are_those_by_rows():
    rng = np.random.default_rng(4)
    tree = boosting.Tree()
    for node in (0, 1, 2, 4, 5, 8):
        left = rng.random(boosting.BINS + 1) < 0.5
        tree.split(node, int(rng.integers(3)), left, (float(rng.random()), float(rng.random())))
    bins = rng.integers(0, 60, (500, 3)).astype(np.uint8)
    want = []
    for row in bins:
        node = 0
        while tree.feature[node] >= 0:
            node = tree.children[node][0 if tree.left[node][row[tree.feature[node]]] else 1]
        want.append(node)
    assert tree.node_of(bins).tolist() == want
    assert tree.predict(bins).tolist() == [tree.value[n] for n in want]
    assert boosting.Tree().node_of(bins).tolist() == [0] * 500
