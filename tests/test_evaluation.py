import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin import evaluation as ev
from ravelin.evaluation import Gain
from ravelin.sources.sinks import on_template


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(900, 200, 2000)
    rows = [(i, float(v), float(v + rng.normal(0, 100)), float(v + rng.normal(0, 80)), int(i % 20), float(1 + i % 3)) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "id int, y double, base double, new double, day int, w double").cache()


def test_gain_parts_add_up(pairs):
    got = {r.part: r.gain for r in ev.gain_decomposition(pairs, "y", "base", "new", {"a": F.col("id") < 700, "b": F.col("id") >= 700}, "w").collect()}
    p = pairs.toPandas()
    err = lambda c: np.sqrt((p.w * (p[c] - p.y) ** 2).sum() / p.w.sum())
    assert got["all"] == pytest.approx(err("base") - err("new"), rel=1e-9)
    assert got["a"] + got["b"] == pytest.approx(got["all"], rel=1e-9)


def test_bootstrap_finds_the_gain(pairs):
    g = ev.paired_bootstrap(pairs, "y", "base", "new", "day")
    assert g.low < g.gain < g.high and g.low > 0 and g.days == 20
    assert ev.paired_bootstrap(pairs, "y", "base", "new", "day") == g
    assert ev.paired_bootstrap(pairs, "y", "base", "base", "day").gain == 0
    assert np.isnan(ev.paired_bootstrap(pairs.limit(0), "y", "base", "new", "day").gain)


def test_gain_without_top_is_less(pairs):
    all_rows = ev.paired_bootstrap(pairs, "y", "base", "new", "day", draws=2).gain
    r = ev.gain_without_top(pairs, "y", "base", "new", 10, "id").first()
    assert r.n == 1990 and r.gain < all_rows
    assert 0 < ev.share_of_top(pairs, "y", "base", "new", 20, "id").first().share


def test_auc_has_average_ranks(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (0, None)], "label int, s double")
    assert ev.auc(df, "label", "s").first().auc == pytest.approx(3.5 / 4)


def test_auc_of_many_is_that_of_numpy(spark):
    rng = np.random.default_rng(0)
    label, s = rng.integers(0, 2, 3000), np.round(rng.normal(size=3000), 2)
    s = s + label * 0.5
    pos, neg = s[label == 1], s[label == 0]
    want = (np.greater.outer(pos, neg).mean() + 0.5 * np.equal.outer(pos, neg).mean())
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(label, s, strict=True)], "label int, s double")
    assert ev.auc(df, "label", "s").first().auc == pytest.approx(want)


def test_importance_weights(spark):
    df = spark.createDataFrame([(p / 100,) for p in range(1, 100)], "p double")
    w = [r.w for r in ev.importance_weights(df, "p").collect()]
    assert np.mean(w) == pytest.approx(1) and max(w) == w[-1] == w[-2]


def test_gates():
    good, poor = Gain(12, 5, 20, 30), Gain(12, -1, 20, 30)
    assert ev.verdict(good, 3, [good, good]) == "better"
    assert ev.verdict(good, -1, [good]) == "fragile"
    assert ev.verdict(poor, 3, [good]) == "unproven"
    assert ev.verdict(Gain(9, 5, 20, 30), 3, [good]) == "unproven"
    assert ev.halves_gate(good, good, good, 0.0) and not ev.halves_gate(good, Gain(-1, 0, 0, 3), good, 0.0)
    assert ev.transfer_gate(good, 1.5, 0.1) and not ev.transfer_gate(good, 2.5, 0.1)
    halves = ev.halves(range(10))
    assert sorted(halves.values()) == ["A"] * 5 + ["B"] * 5 and halves == ev.halves(range(10))


def test_template_is_filled_or_refused(spark):
    template = spark.range(2000).withColumnRenamed("id", "k")
    preds = template.filter("k > 0").select("k", F.col("k").cast("double").alias("p"))
    assert on_template(template, preds, "k", "p").filter("k = 0").first().p == 1000.0
    with pytest.raises(ValueError):
        on_template(template, preds.filter("k > 100"), "k", "p")


def test_bootstrap_of_groups_and_parts(spark):
    """All groups in one frame, the same as each by itself; parts under masks add up to the whole."""
    import random

    rng = random.Random(7)
    rows = [(d % 2, d, float(y := rng.gauss(600, 200)), y + rng.gauss(0, 60), y + rng.gauss(0, 50), 1 + rng.randrange(3)) for d in range(20) for _ in range(40)]
    df = spark.createDataFrame(rows, "g int, day int, y double, base double, new double, w int")
    got = ev.bootstrap_by(df, "y", "base", "new", "day", "g", draws=300, seed=3)
    for g in (0, 1):
        alone = ev.paired_bootstrap(df.filter(f"g = {g}"), "y", "base", "new", "day", draws=300, seed=3)
        assert (got[g].gain, got[g].low, got[g].high, got[g].days) == (pytest.approx(alone.gain), pytest.approx(alone.low), pytest.approx(alone.high), alone.days)
    assert all(x.low < x.gain < x.high and x.days == 10 for x in got.values())
    part = lambda mask: ev.bootstrap(df, "y", "base", "new", "day", mask=mask, weight="w", draws=50).first()
    whole, even, odd = part(None), part(F.col("day") % 3 == 0), part(F.col("day") % 3 != 0)
    assert even.gain + odd.gain == pytest.approx(whole.gain, rel=1e-9)
    plain = ev.paired_bootstrap(spark.createDataFrame(rows[:0], df.schema), "y", "base", "new", "day")
    assert plain.days == 0
