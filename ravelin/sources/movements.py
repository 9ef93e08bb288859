"""The movements view: departures and arrivals derived from `events` by integer arithmetic.

Times are microseconds since the epoch (longs), so that open and closed bounds are exact. Nothing here depends on the
session's time zone: `events.ts` has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECOND = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_us(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without time zone."""
    since = ts - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    return (since.cast("interval second").cast("decimal(18,6)") * SECOND).cast("long")


def movements(events: DataFrame) -> DataFrame:
    """One row for each event: identity, phase, place, and the planned and actual times."""
    e, us = F.col("event_id"), F.col("mvt_us")
    departs = F.col("event_type").isin("view", "click", "purchase")
    base = events.select(
        e.alias("mvt_id"), epoch_us(F.col("ts")).alias("mvt_us"), F.when(departs, "DEP").otherwise("ARR").alias("phase"), F.when(e % 13 != 0, e + 1_000_000).alias("flight_id"),
        F.concat(F.lit("A"), F.col("user_id") % 10).alias("airport"), F.concat(F.lit("R"), F.expr("(user_id div 10) % 4")).alias("runway"), F.when(e % 17 != 0, F.concat(F.lit("S"), e % 23)).alias("stand"),
        F.floor(F.col("value") * 20).alias("span"), F.element_at(F.array(F.lit("H"), F.lit("J"), F.lit("L"), F.lit("M"), F.lit(None).cast("string")), (e % 5 + 1).cast("int")).alias("wake"),
        "user_id", "event_type", "value", e.alias("event_id"),
    )
    sched = us - SECOND * (e * 7919 % 14400)
    block = F.when(~departs, us + SECOND * F.col("span")).when(e % 10 == 3, sched).otherwise(us - SECOND * F.col("span"))
    aobt = F.when(departs & F.col("flight_id").isNotNull(), us - SECOND * (e * 31 % 2400))
    out = base.withColumns({"sched_us": sched, "block_us": block, "aobt_us": aobt})
    out = out.withColumn("eobt_us", F.col("aobt_us") - SECOND * (e * 17 % 3600))
    out = out.withColumns({"lobt_us": F.col("eobt_us") + 60 * SECOND * (e % 3), "iobt_us": F.col("eobt_us") - 30 * SECOND * (e % 7)})
    taxi = F.when(F.col("phase") == "DEP", us - F.col("block_us")).otherwise(F.col("block_us") - us) / SECOND
    return out.withColumn("taxi_s", taxi.cast("double")).withColumn("sec", F.floor(us / SECOND)).withColumn("day", F.floor(us / 86_400_000_000)).drop("span")


#: The same view for DuckDB, as the first common table expression of a query.
SQL = """
base AS (
  SELECT event_id AS mvt_id, event_id, user_id, event_type, value, epoch_us(ts) AS mvt_us,
    CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'DEP' ELSE 'ARR' END AS phase,
    CASE WHEN event_id % 13 <> 0 THEN event_id + 1000000 END AS flight_id,
    'A' || (user_id % 10) AS airport, 'R' || ((user_id // 10) % 4) AS runway,
    CASE WHEN event_id % 17 <> 0 THEN 'S' || (event_id % 23) END AS stand, floor(value * 20)::BIGINT AS span,
    CASE event_id % 5 WHEN 0 THEN 'H' WHEN 1 THEN 'J' WHEN 2 THEN 'L' WHEN 3 THEN 'M' END AS wake
  FROM events
), timed AS (
  SELECT *, mvt_us - 1000000 * ((event_id * 7919) % 14400) AS sched_us,
    CASE WHEN phase = 'DEP' AND flight_id IS NOT NULL THEN mvt_us - 1000000 * ((event_id * 31) % 2400) END AS aobt_us FROM base
), mv AS (
  SELECT *, aobt_us - 1000000 * ((event_id * 17) % 3600) AS eobt_us, aobt_us - 1000000 * ((event_id * 17) % 3600) + 60000000 * (event_id % 3) AS lobt_us,
    aobt_us - 1000000 * ((event_id * 17) % 3600) - 30000000 * (event_id % 7) AS iobt_us,
    CASE WHEN phase = 'DEP' THEN mvt_us - block_us ELSE block_us - mvt_us END / 1000000.0::DOUBLE AS taxi_s, mvt_us // 1000000 AS sec, mvt_us // 86400000000 AS day
  FROM (SELECT *, CASE WHEN phase = 'ARR' THEN mvt_us + 1000000 * span WHEN event_id % 10 = 3 THEN sched_us ELSE mvt_us - 1000000 * span END AS block_us FROM timed)
)
"""


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movements(table(spark, sf_dir, "events"))
