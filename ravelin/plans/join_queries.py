"""Joins to own blocks and members, range scans, alignment, and halves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import evaluation as ev
from ..operators import asof, cells, matching, splits
from ..sources import movements as mv
from ..sources import readers
from ..sources.movements import SECOND
from ..sources.movements import SQL as MV
from .catalogue import query
from .stat_queries import _PAIRS, departures, pairs


@query("""SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-03-01 00:00:00' - INTERVAL 6 HOUR AND o_orderdate <= TIMESTAMP '1997-04-01 00:00:00' + INTERVAL 6 HOUR""")
def time_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A time range with a margin; filter and columns reach the scan."""
    low, high = F.expr("TIMESTAMP_NTZ '1997-03-01 00:00:00'"), F.expr("TIMESTAMP_NTZ '1997-04-01 00:00:00'")
    return readers.read_range(spark, f"{sf_dir}/orders.parquet", "o_orderdate", low, high, 6 * 3600, ["o_orderkey", "o_totalprice"])


@query("SELECT o_orderkey, month(o_orderdate)::INTEGER AS month FROM orders WHERE month(o_orderdate) IN (1, 7)")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a split that is a list of months."""
    df = mv.table(spark, sf_dir, "orders").select("o_orderkey", F.month("o_orderdate").alias("month"))
    return splits.split(df, "month", "holdout", {"holdout": [1, 7], "train": [m for m in range(1, 13) if m not in (1, 7)]})


@query(f"""WITH {MV}, d AS (SELECT mvt_id, airport, (day % 30) // 5 AS block, least(7200.0, greatest(0.0, taxi_s)) AS y FROM mv WHERE phase = 'DEP'),
c AS (SELECT b.block, d.airport, quantile_cont(d.y, 0.5) AS median, count(*) AS n FROM (SELECT DISTINCT block FROM d) b JOIN d ON d.block <> b.block
GROUP BY 1, 2 HAVING count(*) >= 10)
SELECT d.mvt_id, round(c.median, 6) AS cel_median, c.n::BIGINT AS cel_n FROM d LEFT JOIN c USING (block, airport)""")
def own_block_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each departure with the cell that its own block of days may know."""
    dep = departures(spark, sf_dir).withColumn("block", F.floor(F.col("day") % 30 / 5))
    table = cells.block_stat_cells(dep, "block", ["airport"], "taxi_s")
    got = cells.fallback(dep.select("mvt_id", "block", "airport"), [(["block", "airport"], table)], ["median", "n"])
    return got.select("mvt_id", F.round("cel_median", 6).alias("cel_median"), "cel_n")


@query(_PAIRS + " SELECT mvt_id, round((base + new) / 2, 9) AS pred FROM p")
def member_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of two members' predictions on the same rows."""
    rows = pairs(spark, sf_dir)
    members = [rows.select("mvt_id", F.col(c).alias("pred")) for c in ("base", "new")]
    return splits.member_mean(members, "mvt_id", "pred").select("mvt_id", F.round("pred", 9).alias("pred"))


@query(f"""WITH {MV}, r AS (SELECT DISTINCT stand, airport FROM mv WHERE phase = 'ARR') SELECT mvt_id, CASE WHEN stand IN (SELECT stand FROM r
WHERE stand IS NOT NULL) THEN stand END AS stand, CASE WHEN airport IN (SELECT airport FROM r) THEN airport END AS airport FROM mv WHERE phase = 'DEP'""")
def aligned_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the departures that the arrivals lack become null."""
    rows = mv.load(spark, sf_dir)
    return splits.align_categories(rows.filter("phase = 'DEP'").select("mvt_id", "stand", "airport"), rows.filter("phase = 'ARR'"), ["stand", "airport"])


@query(_PAIRS + """, d AS (SELECT day, (row_number() OVER (ORDER BY day) - 1) % 2 AS half FROM (SELECT DISTINCT day FROM p))
SELECT half::INTEGER AS half, round(sqrt(avg((base - y) ** 2)) - sqrt(avg((new - y) ** 2)), 6) AS gain, count(DISTINCT day)::BIGINT AS days FROM p
JOIN d USING (day) GROUP BY half""")
def halves_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gain on each of two halves of the days."""
    rows = cells.day_folds(pairs(spark, sf_dir), "day", 2, "half")
    err = lambda c: ev.rmse(F.col(c) - F.col("y"))
    return rows.groupBy(F.col("half").cast("int").alias("half")).agg(F.round(err("base") - err("new"), 6).alias("gain"), F.countDistinct("day").alias("days"))


@query(f"""WITH {MV}, dp AS (SELECT mvt_id, airport, mvt_us AS t FROM mv WHERE phase = 'DEP'), ev AS (SELECT airport, block_us AS t, mvt_id AS eid
FROM mv WHERE phase = 'ARR'),
j AS (SELECT dp.mvt_id, e.eid, e.t, row_number() OVER (PARTITION BY dp.mvt_id
ORDER BY abs(e.t - dp.t), e.t, CASE WHEN e.t <= dp.t THEN -e.eid ELSE e.eid END) AS r FROM dp
JOIN ev e ON e.airport = dp.airport AND abs(e.t - dp.t) <= 1800000000)
SELECT dp.mvt_id, j.eid, (j.t - dp.t) / 1e6 AS apart FROM dp LEFT JOIN j ON j.mvt_id = dp.mvt_id AND j.r = 1""")
def nearest_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest arrival at the airport within half an hour, the earlier one if two are as near."""
    rows = mv.load(spark, sf_dir)
    left = rows.filter("phase = 'DEP'").select("mvt_id", "airport", F.col("mvt_us").alias("t"))
    right = rows.filter("phase = 'ARR'").select("airport", F.col("block_us").alias("at"), F.col("mvt_id").alias("eid"))
    got = asof.asof(left, right, ["airport"], "t", "at", 1800 * SECOND, ["eid"], "eid", "nearest")
    return got.select("mvt_id", F.col("r_eid").alias("eid"), ((F.col("r_at") - F.col("t")) / SECOND).alias("apart"))


@query(f"""WITH {MV}, dp AS (SELECT mvt_id, airport, mvt_us AS t FROM mv WHERE phase = 'DEP'), ev AS (SELECT airport, block_us AS t, mvt_id AS eid
FROM mv WHERE phase = 'ARR'),
b AS (SELECT dp.mvt_id, e.eid, abs(e.t - dp.t) AS d, row_number() OVER (PARTITION BY dp.mvt_id ORDER BY e.t DESC, e.eid DESC) AS r FROM dp
JOIN ev e ON e.airport = dp.airport AND e.t <= dp.t AND e.t >= dp.t - 1800000000),
f AS (SELECT dp.mvt_id, e.eid, abs(e.t - dp.t) AS d, row_number() OVER (PARTITION BY dp.mvt_id ORDER BY e.t, e.eid) AS r FROM dp
JOIN ev e ON e.airport = dp.airport AND e.t >= dp.t AND e.t <= dp.t + 1800000000)
SELECT DISTINCT mvt_id, eid AS event_no, d AS distance FROM (SELECT * FROM b WHERE r = 1 UNION ALL SELECT * FROM f WHERE r = 1)""")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arrival before and the one after each departure, within half an hour."""
    rows = mv.load(spark, sf_dir)
    left = rows.filter("phase = 'DEP'").select("mvt_id", "airport", "mvt_us")
    right = rows.filter("phase = 'ARR'").select("airport", "block_us", F.col("mvt_id").alias("event_no"))
    return matching.candidates_around(left, right, ["airport"], "mvt_us", "block_us", "mvt_id", "event_no", 1800 * SECOND)


@query(f"""WITH {MV}, r AS (SELECT DISTINCT airport, runway FROM mv WHERE phase = 'ARR' AND flight_id IS NULL) SELECT (SELECT count(*) FROM mv
WHERE phase = 'DEP' AND (airport, runway) IN (SELECT airport, runway FROM r))::BIGINT AS n_in, (SELECT count(*) FROM mv
WHERE phase = 'DEP' AND (airport, runway) NOT IN (SELECT airport, runway FROM r))::BIGINT AS n_out""")
def semi_and_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departures from places where an arrival had no plan, and from others."""
    rows = mv.load(spark, sf_dir).select("flight_id", "phase", "airport", "runway")
    dep, keys = rows.filter("phase = 'DEP'"), rows.filter("phase = 'ARR' AND flight_id IS NULL").select("airport", "runway")
    inside = dep.join(keys, ["airport", "runway"], "left_semi").agg(F.count("*").alias("n_in"))
    return inside.crossJoin(F.broadcast(dep.join(keys, ["airport", "runway"], "left_anti").agg(F.count("*").alias("n_out"))))  # one row each
