import json

import pytest
from pyspark.sql import functions as F

from ravelin import governance as gov
from ravelin.operators import splits


def test_only_the_best_on_a_is_confirmed():
    options = gov.proposals(["m1", "m2"], "n")
    assert dict(options) == {"swap:m1": ("n", "m2"), "swap:m2": ("m1", "n"), "add": ("m1", "m2", "n"), "alone": ("n",)}
    gains = {("n", "m2"): 1.0, ("m1", "n"): 2.0, ("m1", "m2", "n"): 3.0, ("n",): 9.0}
    asked = []
    got = gov.choose(options, gains.get, lambda m: len(m) > 1, lambda m: asked.append(m) or True)
    assert got == ("add", ("m1", "m2", "n")) and asked == [("m1", "m2", "n")]
    assert gov.choose(options, gains.get, lambda m: True, lambda m: False) is None
    assert gov.choose(options, gains.get, lambda m: False, lambda m: True) is None


def test_refusals_and_records(tmp_path):
    assert gov.leaked({"source_months": [1, 2]}, [1, 7]) and not gov.leaked({"source_months": [2]}, [1, 7])
    assert gov.may_promote({"id": "r", "base": "b"}, {"bases": ["b"]}, [1]) and not gov.may_promote({"id": "r", "base": "x"}, {"bases": ["b"]}, [1])
    path = str(tmp_path / "r.jsonl")
    with gov.Run("exp", {"a": 1}, path) as run:
        with run.phase("fit"):
            pass
        run.metric(rmse=3.5)
    with pytest.raises(ZeroDivisionError), gov.Run("exp", {"a": 2}, path):
        1 / 0
    one, two = (json.loads(x) for x in open(path))
    assert one["state"] == "done" and one["metrics"] == {"rmse": 3.5} and "fit" in one["phases"] and one["driver_mb"] > 0
    assert two["state"] == "failed" and two["id"] != one["id"]


def test_splits_blind_rows_and_members(spark):
    df = spark.createDataFrame([(1, 1, True, 10.0, 5.0), (2, 7, False, 20.0, 6.0), (3, 3, True, 30.0, 7.0)], "id int, month int, dep boolean, block double, y double")
    months = {"train": [3], "holdout": [1, 7]}
    assert sorted(r.id for r in splits.split(df, "month", "holdout", months).collect()) == [1, 2]
    assert splits.disjoint(months, "train", "holdout") and not splits.disjoint({"a": [1], "b": [1]}, "a", "b")
    with pytest.raises(KeyError):
        splits.split(df, "month", "nope", months)
    got = {r.id: r for r in splits.blind(df, F.col("dep"), ["block", "y"], "y").collect()}
    assert (got[1].block, got[1].y, got[1].y_true) == (None, None, 5.0) and (got[2].block, got[2].y, got[2].y_true) == (20.0, 6.0, None)
    a = df.select("id", F.col("y").alias("p"))
    assert splits.member_mean([a, a.withColumn("p", F.col("p") + 2)], "id", "p").filter("id = 1").first().p == 6.0
    with pytest.raises(Exception, match="same rows"):
        splits.member_mean([a, a.limit(2)], "id", "p").collect()
