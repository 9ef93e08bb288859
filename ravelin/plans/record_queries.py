"""Reading by time and by column, joins by id, categories, records inside records, traces, and rules at the end of a model."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..models import base, crossfit
from ..operators import autofeatures, keys, rules, traces
from ..sources import movements as mv
from ..sources import readers
from ..sources.movements import SECOND
from ..sources.movements import SQL as MV
from .catalogue import query


def departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mv.load(spark, sf_dir).filter("phase = 'DEP'")


@query("""SELECT o_orderkey, epoch_us(o_orderdate) AS at_us, o_orderstatus = 'F' AS closed FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-01-01' OR o_orderdate IS NULL""")
def month_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several files as one table with its times as times; a filter on them reaches the scan."""
    rows = readers.read_months(spark, [f"{sf_dir}/orders.parquet"], ["o_orderdate", "none"])
    rows = rows.filter(F.col("o_orderdate").isNull() | (F.col("o_orderdate") >= F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")))
    return rows.select("o_orderkey", mv.epoch_us(F.col("o_orderdate")).alias("at_us"), (F.col("o_orderstatus") == "F").alias("closed"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem
WHERE l_shipdate BETWEEN TIMESTAMP '1996-05-01' - INTERVAL 6 HOUR AND TIMESTAMP '1996-06-01' + INTERVAL 1 DAY""")
def catalogue_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A time range out of a catalogue of files; those that cover other times aren't listed."""
    known = readers.FileCatalogue((
        (datetime(1992, 1, 1), datetime(2002, 12, 31), f"{sf_dir}/lineitem.parquet"),
        (datetime(1980, 1, 1), datetime(1990, 12, 31), f"{sf_dir}/lineitem-before.parquet"),
    ))
    span = datetime(1996, 5, 1), datetime(1996, 6, 1)
    return known.read(spark, "l_shipdate", *span, timedelta(hours=6), timedelta(days=1), ["l_orderkey", "l_linenumber"])


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def available_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wanted columns that a table has, and those with a prefix; what it lacks is left out."""
    return readers.read_available(spark, [f"{sf_dir}/supplier.parquet"], ["s_suppkey", "s_name", "s_elsewhere"], ["s_nation", "s_acct"])


@query(f"""WITH {MV}, t AS (SELECT user_id, count(*)::BIGINT AS moves, max(taxi_s) AS longest FROM mv WHERE wake = 'H' GROUP BY user_id)
SELECT mvt_id, moves, longest, (SELECT count(*) FROM mv e WHERE e.user_id = mv.user_id AND e.phase = 'DEP')::BIGINT AS departures FROM mv LEFT
JOIN t USING (user_id) WHERE phase = 'DEP'""")
def joined_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns looked up by a unique id: heavy movements, which some lack, and departures, which all must have."""
    rows = mv.load(spark, sf_dir)
    some = rows.filter("wake = 'H'").groupBy("user_id").agg(F.count("*").alias("moves"), F.max("taxi_s").alias("longest"))
    every = rows.groupBy("user_id").agg(F.count(F.when(F.col("phase") == "DEP", 1)).alias("departures"))
    dep = rows.filter("phase = 'DEP'").select("mvt_id", "user_id")
    return keys.join_by_id(keys.join_by_id(dep, some, "user_id"), every, "user_id", complete=True).drop("user_id")


@query(f"""WITH {MV}, v AS (SELECT stand FROM mv WHERE phase = 'DEP' UNION SELECT stand FROM mv
WHERE phase = 'ARR'), c AS (SELECT stand, row_number() OVER (ORDER BY stand) - 1 AS code FROM v WHERE stand IS NOT NULL)
SELECT mvt_id, code FROM mv LEFT JOIN c USING (stand)""")
def category_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of categories in the order of their names, over the values of several frames."""
    rows = mv.load(spark, sf_dir)
    values = base.vocabulary([rows.filter("phase = 'DEP'"), rows.filter("phase = 'ARR'")], "stand")
    codes = values.withColumn("code", F.row_number().over(W.orderBy("stand")) - 1)  # a vocabulary, which a model holds whole
    return rows.select("mvt_id", "stand").join(codes, "stand", "left").select("mvt_id", F.col("code").cast("long").alias("code"))


@query("""SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, ((props::JSON ->> '$.k')::BIGINT % 10)::INTEGER AS last_digit,
sha256(event_type || '|' || coalesce(props, '?')) AS digest FROM events""")
def record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a JSON column, and a digest of a composite key."""
    rows = mv.table(spark, sf_dir, "events").select("event_id", "event_type", "props", F.from_json("props", "k long")["k"].alias("k"))
    digest = F.sha2(keys.joint_key(["event_type", "props"]).cast("binary"), 256)
    return rows.select("event_id", "k", (F.col("k") % 10).cast("int").alias("last_digit"), digest.alias("digest"))


#: Airports of made-up tracks, and where their points lie.
PLACES = {"AAA": (40.05, 12.05), "BBB": (40.15, 12.2)}
_LAT, _LON = "40 + (event_id % 200) / 1000.0::DOUBLE", "12 + (event_id % 300) / 1000.0::DOUBLE"


def _inside(name: str) -> str:
    from math import cos, radians

    lat, lon = PLACES[name]
    half = 4.0 / 111.32
    return f"abs(lat - {lat}) <= {half!r} AND abs(lon - {lon}) <= {half / cos(radians(lat))!r}"


@query(f"""WITH p AS (SELECT event_id, user_id, {_LAT} AS lat, {_LON} AS lon, event_id % 5 = 0 AS ground, (event_id * 37 % 6000)::DOUBLE AS alt,
CASE WHEN event_id % 4 = 0 THEN 'C' || (event_id % 9) END AS callsign FROM events),
q AS (SELECT *, last_value(callsign IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS known FROM p)
SELECT event_id::DOUBLE AS t, known AS callsign, CASE WHEN {_inside("AAA")} THEN 'AAA' ELSE 'BBB' END AS apt FROM q
WHERE (({_inside("AAA")}) OR ({_inside("BBB")})) AND (ground OR alt <= 3000)""")
def trace_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of tracks that are low and near an airport, with the last callsign that was heard."""
    e = F.col("event_id")
    points = mv.table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").cast("string").alias("icao"), e.cast("double").alias("t"), (40 + e % 200 / 1000).alias("lat"), (12 + e % 300 / 1000).alias("lon"), (e % 5 == 0).alias("ground"), (e * 37 % 6000).cast("double").alias("alt"),
        F.when(e % 4 == 0, F.concat(F.lit("C"), e % 9)).alias("callsign"),
    )
    heard = traces.with_callsigns(points, "icao", "event_id", "event_id", 2000)
    return traces.near_airports(heard, PLACES, 4.0, 3000.0).select("t", "callsign", "apt")


_FINAL = "(event_id * 13) % 5400"


@query(f"""WITH {MV}, x AS (SELECT mvt_id, {_FINAL} AS base, CASE WHEN event_id % 8 > 0 THEN (event_id * 29) % 4000 - 2000 END AS correction,
event_id % 11 = 0 AS ruled, (mvt_us - lobt_us) / 1e6 AS m FROM mv WHERE phase = 'DEP')
SELECT mvt_id, CASE WHEN ruled THEN base ELSE greatest(0.0, least(m + 3606, greatest(m - 3606, base + coalesce(correction, 0)))) END::DOUBLE AS final
FROM x""")
def final_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base plus correction in the window, the base alone on rows that a rule decides."""
    e = F.col("event_id")
    low, high = rules.feasible_window(F.col("mvt_us"), F.col("lobt_us"))
    correction = F.when(e % 8 > 0, e * 29 % 4000 - 2000).cast("double")
    return departures(spark, sf_dir).select("mvt_id", rules.final_value(F.expr(_FINAL).cast("double"), correction, e % 11 == 0, low, high).alias("final"))


@query(f"""WITH {MV} SELECT mvt_id FROM mv
WHERE phase = 'DEP' AND flight_id IS NOT NULL AND NOT coalesce(flight_id IS NULL AND (mvt_us - sched_us) / 1e6 > 7200,
false) AND abs((mvt_us - aobt_us) / 1e6 - {_FINAL}) <= 900""")
def body_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose pseudo-label may teach: with a plan, decided by no rule, and near the base."""
    dep = departures(spark, sf_dir).select(
        "mvt_id", F.col("flight_id").isNull().alias("no_plan"), ((F.col("mvt_us") - F.col("aobt_us")) / SECOND).alias("pseudo"), F.expr(_FINAL).cast("double").alias("base"), ((F.col("mvt_us") - F.col("sched_us")) / SECOND).alias("ms"),
    )
    dep = dep.withColumn("ruled", rules.rule_rows(F.col("no_plan"), F.col("ms"), 7200, F.lit(True)))
    return crossfit.body(dep, "pseudo", "base", "ruled", 900).select("mvt_id")


@query(f"""WITH {MV}, d AS (SELECT taxi_s AS y, (mvt_us - sched_us) / 1e6 AS ms, (mvt_us - aobt_us) / 1e6 AS p FROM mv WHERE phase = 'DEP'),
f AS (SELECT y, ms - p AS a, ms * p AS b, CASE WHEN abs(p) > 1e-6 THEN ms / p END AS c FROM d),
s AS (SELECT 'fe_diff__ms__plan_s' AS feature, corr(y, a) AS r, count(a) AS n FROM f UNION ALL SELECT 'fe_prod__ms__plan_s', corr(y, b), count(b)
FROM f UNION ALL SELECT 'fe_ratio__ms__plan_s', corr(y, c), count(c) FROM f)
SELECT feature, round(r, 6) AS r, n::BIGINT AS n FROM s WHERE abs(r) > 0.001 ORDER BY abs(r) DESC, feature LIMIT 2""")
def feature_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two candidates that correlate best with the outcome, if above a band."""
    rows = departures(spark, sf_dir).select(F.col("taxi_s").alias("y"), ((F.col("mvt_us") - F.col("sched_us")) / SECOND).alias("ms"), ((F.col("mvt_us") - F.col("aobt_us")) / SECOND).alias("plan_s"))
    scores = autofeatures.correlation_screen(rows, [(kind, "ms", "plan_s") for kind in ("diff", "prod", "ratio")], "y")
    return autofeatures.survivors(scores, 0.001, None, 1.0, 2).select("feature", F.round("r", 6).alias("r"), "n")
