"""Models on small frames: better than the mean, and blind to what they must not see."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ravelin import evaluation as ev
from ravelin.models import base, crossfit
from ravelin.sources.storage import materialise

CFG = base.Config(numeric=("x", "ms"), categorical=("airport",), rounds=4, depth=3, key_rows=10**9)


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(600).select(
        F.col("id").cast("int").alias("id"), F.concat(F.lit("A"), F.col("id") % 3).alias("airport"), (F.col("id") * 37 % 100).cast("double").alias("x"), (F.col("id") * 53 % 7000).cast("double").alias("ms"), (F.col("id") % 5).alias("block"), (F.col("id") % 10).alias("day"),
        (F.col("id") % 9 == 0).alias("no_plan"), (F.col("id") % 4 == 0).alias("copied"), (F.col("id") * 1_000_000_000).alias("mvt_us"),
    )
    df = df.withColumn("y", F.when(F.col("copied"), F.col("ms")).otherwise(300 + 10 * F.col("x"))).withColumn("lobt_us", F.when(~F.col("no_plan"), F.col("mvt_us") - F.lit(1_800_000_000)))
    return materialise(df, "rows")


def error(df, pred="pred"):
    return df.agg(ev.rmse(F.col(pred) - F.col("y"))).first()[0]


@pytest.mark.parametrize("model", ["single", "two_stage", "two_stage_lines"])
def test_models_beat_the_mean(rows, model):
    got = base.fit(rows, replace(CFG, model=model))(rows, "pred")
    spread = rows.agg(F.stddev_pop("y")).first()[0]
    assert got.count() == 600 and set(got.columns) == {*rows.columns, "pred"} and error(got) < spread


def test_options(rows):
    with pytest.raises(KeyError):
        base.fit(rows, replace(CFG, model="nope"))
    got = base.fit(rows, replace(CFG, seeds=(1, 2), window=True))(rows, "pred")
    assert got.filter("NOT no_plan AND (pred > 1800 + 3606 OR pred < 0)").count() == 0
    assert base.scaled(replace(CFG, rounds=10)).rounds == 12
    own = base.fit(rows, replace(CFG, model="two_stage", key_rows=50))(rows, "pred")
    assert own.count() == 600 and own.filter("pred IS NULL").count() == 0


def test_out_of_fold_does_not_see_its_block(rows):
    few = replace(CFG, rounds=2, depth=2)
    one = crossfit.out_of_fold(rows, "block", few, "pred", materialise)
    changed = rows.withColumn("y", F.when(F.col("block") == 2, F.col("y") + 5000).otherwise(F.col("y")))
    two = crossfit.out_of_fold(changed, "block", few, "pred", materialise)
    both = one.filter("block = 2").select("id", "pred").join(two.select("id", F.col("pred").alias("p2")), "id")
    assert both.count() == 120 and both.filter("abs(pred - p2) > 1e-9").count() == 0


def test_corrector_helps_and_spares_rule_rows(rows):
    weak = rows.withColumn("base", F.lit(900.0)).withColumn("rule", F.col("no_plan"))
    model = crossfit.correct(weak, "base", replace(CFG, key_rows=100), skip="rule")
    got = crossfit.corrected(model, weak, "base", "pred", rule="rule", window=False)
    assert error(got) < error(weak, "base")
    assert got.filter("rule AND pred <> 900").count() == 0
    fresh = got.limit(3).withColumn("airport", F.lit("new")).drop("pred")
    assert crossfit.corrected(model, fresh, "base", "pred", window=False).filter("pred IS NULL").count() == 0


def test_pseudo_rows_weigh_less_and_lose_unknown_categories(rows):
    extra = rows.limit(10).withColumn("airport", F.lit("new"))
    got = crossfit.with_pseudo(rows, extra, ["airport"])
    assert got.count() == 610 and got.filter("weight = 0.3 AND airport IS NULL").count() == 10


def test_drift_and_last_fit(rows):
    weights, auc = crossfit.adversarial(rows.filter("x < 40"), rows.filter("x >= 40"), "id", CFG, materialise)
    assert auc.first().auc > 0.9 and weights.agg(F.avg("w")).first()[0] == pytest.approx(1)
    assert crossfit.last_fit(rows, [CFG, CFG])(rows, "pred").count() == 600
    best = crossfit.screen(rows.withColumn("res", F.col("x") - 50), ["x", "ms"], CFG, "res", "block")
    assert best[0][0] == "x"
    rest = crossfit.rest_model(rows.withColumn("g", F.lit(100.0)), "y", "g", CFG, "pred")(rows.withColumn("g", F.lit(100.0)), "pred")
    assert error(rest) < rows.agg(F.stddev_pop("y")).first()[0]


def test_queries_use_the_operators_defaults():
    from ravelin.plans.model_queries import CONFIG

    plain = base.Config(numeric=CONFIG.numeric, categorical=CONFIG.categorical, target="y")
    assert plain == CONFIG and CONFIG.key_rows == 20_000


def test_reference_cells_are_those_of_training(rows):
    c = replace(CFG, reference=(("airport", "block"), ("airport",)))
    half = rows.filter("id < 500")
    ready = base.prepare(half, c)
    both = [{r.id: tuple(r.features) for r in ready(df).select("id", "features").collect()} for df in (rows, rows.withColumn("y", F.col("y") + 1000))]
    assert both[0] == both[1] and len(both[0]) == 600
    got = base.fit(half, c)(rows, "pred")
    assert got.count() == 600 and set(got.columns) == {*rows.columns, "pred"}


def test_vocabularies_over_frames(rows):
    new = rows.limit(5).withColumn("airport", F.lit("new"))
    assert {r.airport for r in base.vocabulary([rows, new], "airport").collect()} == {"A0", "A1", "A2", "new"}
    alone, joint = base.prepare(rows, CFG), base.prepare(rows, CFG, [new])
    code = lambda p: {tuple(r.features)[-1] for r in p(new).select("features").collect()}
    assert code(alone) == {4} == code(joint)  # the value after all others, and the last in order
    assert code(base.prepare(rows, CFG, [new.withColumn("airport", F.lit("A00"))])) == {5}


def test_progress_and_post_rules(rows):
    curve = base.learning_curve(rows, rows, replace(CFG, rounds=5))
    assert [n for n, _ in curve] == [1, 2, 3, 4, 5] and curve[-1][1] < curve[0][1]
    got = crossfit.last_fit(rows, [CFG], ["late_line"], F.col("no_plan") & (F.col("ms") > 3000))(rows, "pred")
    assert got.filter("no_plan AND ms > 3000 AND abs(pred - (54310.76 + 0.38 * ms)) > 1e-6").count() == 0
    assert got.filter("NOT no_plan AND pred > 20000").count() == 0


def test_screening_has_a_placebo_band_and_a_drift_gate(rows):
    df = rows.select("id", "x", "ms", "block", "day", (F.col("x") - 50).alias("res"), F.col("x").alias("x2"))
    new = df.withColumn("x2", F.col("x2") + 500)
    got = {s.feature: s for s in crossfit.screen_with_gates(df, new, ["x", "x2", "ms"], CFG, "res", "block", "id", materialise)}
    assert got["x"].chosen and not got["x2"].chosen and not got["ms"].chosen
    assert got["x2"].drift == 1.0 and got["x"].drift == pytest.approx(0.5) and got["x"].gain > got["ms"].gain


def test_screening_reads_rows_once_and_equals_single_fits(rows, spark):
    """Gains are those of a fit for each feature; forty features take as many jobs as two."""
    df = materialise(rows.select("id", "block", "x", "ms", F.when(F.col("id") % 6 > 0, F.col("x") % 7).alias("part"), (F.col("id") * 31 % 17).alias("noise"), (F.col("x") - 50 + F.col("id") % 5).alias("res")), "screened")
    features, last = ["x", "ms", "part", "noise"], df.agg(F.max("block")).first()[0]
    single = {}
    for f in features:
        c = replace(CFG, numeric=(f,), categorical=(), target="res", row_share=1.0, feature_share=1.0)
        got = base.fit(df.filter(F.col("block") != last), c)(df.filter(F.col("block") == last), "g")
        single[f] = got.agg(F.sqrt(F.avg(F.col("res") ** 2)) - F.sqrt(F.avg((F.col("res") - F.col("g")) ** 2))).first()[0]
    found = crossfit.screen(df, features, CFG, "res", "block")
    assert [f for f, _ in found] == sorted(features, key=lambda f: -single[f])
    assert all(g == pytest.approx(single[f], abs=1e-6) for f, g in found)
    jobs = []
    for n in (2, 40):
        wide = df.withColumns({f"f{i}": F.col("ms") % (i + 2) for i in range(n)})
        spark.sparkContext.setJobGroup(f"screen{n}", "")
        crossfit.screen(wide, [f"f{i}" for i in range(n)], CFG, "res", "block")
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"screen{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_fits_run_side_by_side(rows, spark):
    """Two fits' jobs overlap in time, each in its pool, and the predictions are those of one after another."""
    import time

    def work(n):
        def run():
            spark.sparkContext.setJobGroup(f"side{n}", "")
            slow = F.udf(lambda x: time.sleep(0.5) or x, "long")
            return spark.range(2, numPartitions=2).select(slow("id").alias("x")).agg(F.sum("x")).first()[0], spark.sparkContext.getLocalProperty("spark.scheduler.pool"), spark.sparkContext.getLocalProperty("callers.own")

        return run

    spark.sparkContext.setLocalProperty("callers.own", "kept")
    assert crossfit.side_by_side(spark, [work(0), work(1)]) == [(1, "fit0", "kept"), (1, "fit1", "kept")]
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    store, spans = spark.sparkContext._jsc.sc().statusStore(), []
    for n in (0, 1):
        jobs = [store.job(i) for i in spark.sparkContext.statusTracker().getJobIdsForGroup(f"side{n}")]
        spans.append((min(j.submissionTime().get().getTime() for j in jobs), max(j.completionTime().get().getTime() for j in jobs)))
    assert max(a for a, _ in spans) < min(b for _, b in spans)
    few = replace(CFG, rounds=2, depth=2)
    one = crossfit.out_of_fold(rows, "block", few, "pred", materialise)
    alone = crossfit._union(crossfit.side_by_side(spark, [lambda b=b: base.fit(rows.filter(F.col("block") != b), few)(rows.filter(F.col("block") == b), "pred") for b in crossfit.blocks_of(rows, "block")], 1))
    values = lambda df: {r.id: r.pred for r in df.select("id", "pred").collect()}
    assert values(one) == values(alone)


def test_categories_are_coded_by_rows_before(spark):
    from ravelin.operators import ordered

    data = [(i, None if i % 11 == 0 else f"c{i % 3 if i % 2 else 0}", None if i % 13 == 0 else float(i % 10), (i * 7919) % 1009) for i in range(300)]
    df = spark.createDataFrame(data, "id long, c string, y double, at long").repartition(5)
    for buckets in (1, 7, 1024):
        got = {r["id"]: (r["__n"], r["__s"]) for r in ordered.earlier_sums(df, "c", "y", "at", 1009, ["id"], buckets).collect()}
        for i, c, _, at in data:
            before = [y for j, d, y, b in data if d == c and (b, j) < (at, i) and y is not None]
            assert got[i] == (len(before), sum(before))
    code = ordered.Encoder.fit(df, ["c"], "y", strength=5.0)
    prior = [y for *_, y, _ in data if y is not None]
    prior = sum(prior) / len(prior)
    mine = [y for _, c, y, _ in data if c is None and y is not None]
    new = spark.createDataFrame([(1, None), (2, "unseen")], "id long, c string")
    got = {r["id"]: r["__o_c"] for r in code(new).collect()}
    assert got[1] == pytest.approx((sum(mine) + 5 * prior) / (len(mine) + 5)) and got[2] == pytest.approx(prior)
    early = code.earlier(df, "at", 1009).orderBy("at").first()
    assert early["__o_c"] == pytest.approx(prior)


def test_body_leaves_out_rules_and_far_moves(rows):
    df = rows.withColumn("base", F.lit(500.0)).withColumn("p", F.lit(500.0) + F.col("x")).withColumn("rule", F.col("id") % 2 == 0)
    got = crossfit.body(df, "p", "base", "rule", 30.0)
    assert got.count() > 0 and got.filter("no_plan OR rule OR x > 30").count() == 0
    assert got.count() == df.filter("NOT no_plan AND NOT rule AND x <= 30").count()


def test_out_of_fold_correction_does_not_see_its_fold(rows):
    df = rows.withColumn("base", F.lit(900.0))
    one = crossfit.out_of_fold_correction(df, "day", "base", replace(CFG, rounds=2, depth=2), 2, "pred", materialise)
    first = {r.day for r in df.select("day").distinct().orderBy("day").collect()[::2]}  # the days of one fold
    moved = df.withColumn("y", F.when(F.col("day").isin(first), F.col("y") + 4000).otherwise(F.col("y")))
    two = crossfit.out_of_fold_correction(moved, "day", "base", replace(CFG, rounds=2, depth=2), 2, "pred", materialise)
    both = one.filter(F.col("day").isin(first)).select("id", "pred").join(two.select("id", F.col("pred").alias("p2")), "id")
    assert one.count() == 600 and both.count() > 0 and both.filter("abs(pred - p2) > 1e-9").count() == 0


def test_the_whole_fit_runs_beside_the_folds(rows, monkeypatch):
    """The base on all rows waits for no fold, and the results are those of one fit after another."""
    few, asked, run = replace(CFG, rounds=1, depth=1), [], crossfit.side_by_side
    monkeypatch.setattr(crossfit, "side_by_side", lambda spark, work, *a: asked.append(len(work)) or run(spark, work, *a))
    got = crossfit.simulate(rows.filter("block < 2"), rows.filter("block >= 2"), "block", few, few, materialise).select("id", "base", "pred")
    want = base.fit(rows.filter("block < 2"), few)(rows.filter("block >= 2"), "b").select("id", "b")
    assert asked == [3]
    assert got.join(want, "id").filter("abs(base - b) < 1e-9 AND pred IS NOT NULL").count() == rows.filter("block >= 2").count()
