"""Phases with executors' peaks, reports while a fit goes on, and scratch folders that end empty."""

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ravelin.models import base
from ravelin.monitor import Monitor
from ravelin.sources import storage


def test_phases_and_reports_during_a_fit(spark, tmp_path):
    df = storage.materialise(spark.range(400).select("id", (F.col("id") % 30).cast("double").alias("x"), F.lit("A").alias("airport"), (F.col("id") % 30 * 7).cast("double").alias("y")), "rows")
    rounds, samples = [], []
    watch = Monitor(spark, 0.05, samples.append)
    with watch.phase("read"):
        assert df.count() == 400
    c = base.Config(numeric=("x",), rounds=3, depth=2, report=lambda *x: rounds.append((time.time(), x)))
    with watch.phase("fit"):
        base.fit(df, c)
    with pytest.raises(Exception, match="broken"), watch.phase("fails"):
        df.select(F.raise_error(F.lit("broken"))).collect()
    read, fit, fails = watch.record(str(tmp_path / "phases.jsonl"))
    assert read["jobs"] >= 1 and read["tasks"] >= 1 and read["error"] is None and fit["jobs"] > 6 and fit["tasks"] > read["tasks"] and fit["shuffle_mb"] > 0
    assert "broken" in fails["error"] and fails["failed"] >= 1
    assert [json.loads(x)["name"] for x in Path(tmp_path / "phases.jsonl").read_text().splitlines()] == ["read", "fit", "fails"]
    during = [s for s in samples if s["phase"] == "fit"]
    assert during and any(s["jobs"] for s in during) and any(s["tasks"] >= s["done"] >= 0 and s["stages"] for s in during)
    assert [x[1] for _, x in rounds] == [0, 1, 2, 3] and during[0]["time"] < rounds[-1][0]  # both told before the fit's end
    deadline = time.time() + 30
    while not watch.executors() and time.time() < deadline:  # heartbeats come every ten seconds
        time.sleep(0.5)
    assert all(p["heap"] > 0 for p in watch.executors().values()) and watch.executors()


def test_scratch_ends_empty(spark):
    root = Path(storage.shared_root(spark).removeprefix("file://")) / "ravelin"
    outside = storage.materialise(spark.range(3), "outside")
    before = set(root.iterdir())
    with pytest.raises(RuntimeError), storage.scratch(spark):
        one = storage.materialise(spark.range(4), "one")
        two = storage.materialise(one, "two")
        storage.release(two)
        assert len(set(root.iterdir()) - before) == 1 and one.count() == 4
        raise RuntimeError
    assert set(root.iterdir()) == before and outside.count() == 3
