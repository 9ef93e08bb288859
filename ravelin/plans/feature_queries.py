"""Projections, predicates and rules over the movements view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import cells, rules
from ..operators.cells import consistency
from ..operators.keys import assemble, in_order, joint_key, strict_key
from ..operators.splits import blind
from ..sources import movements as mv
from ..sources.movements import SQL as MV
from ..sources.movements import table
from .catalogue import query

REFS = ("sched", "lobt", "iobt", "eobt", "aobt")


def departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mv.load(spark, sf_dir).filter("phase = 'DEP'")


_FEATURE_SQL = ", ".join(
    [f"round((mvt_us - {r}_us) / 1e6, 6) AS to_takeoff_from_{r}" for r in REFS]
    + [f"round(({a}_us - {b}_us) / 1e6, 6) AS gap_{a}_{b}" for i, a in enumerate(REFS) for b in REFS[i + 1 :]]
    + [f"(CASE WHEN {r}_us IS NOT NULL THEN (({r}_us // 1000000) % 60 = 0)::INTEGER + (({r}_us // 60000000) % 5 = 0)::INTEGER END)::INTEGER AS round_{r}" for r in REFS]
)


@query(f"""WITH {MV} SELECT mvt_id, ((mvt_us // 60000000) % 1440) // 60 + (((mvt_us // 60000000) % 1440) % 60) / 60.0::DOUBLE AS hour,
((mvt_us // 86400000000 + 3) % 7)::BIGINT AS dow, (flight_id IS NULL)::INTEGER AS nm_missing, {_FEATURE_SQL} FROM mv WHERE phase = 'DEP'""")
def base_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock, plan distances, gaps between plans and rounding scores of each departure."""
    us = lambda r: F.col(f"{r}_us")
    columns = {"hour": fn.hour_of_day(F.col("mvt_us")), "dow": fn.weekday(F.col("mvt_us")), "nm_missing": F.col("flight_id").isNull().cast("int")}
    columns |= {f"to_takeoff_from_{r}": F.round((F.col("mvt_us") - us(r)) / mv.SECOND, 6) for r in REFS}
    columns |= {f"gap_{a}_{b}": F.round((us(a) - us(b)) / mv.SECOND, 6) for i, a in enumerate(REFS) for b in REFS[i + 1 :]}
    columns |= {f"round_{r}": fn.rounding_score(us(r)) for r in REFS}
    return departures(spark, sf_dir).select("mvt_id", *[c.alias(n) for n, c in columns.items()])


@query(f"""WITH {MV} SELECT airport, coalesce(stand, '?') || '|' || runway AS key_joint, count(*)::BIGINT AS n, count(stand)::BIGINT AS n_strict,
min(CASE WHEN stand IS NOT NULL THEN stand || '|' || runway END) AS key_strict FROM mv GROUP BY 1, 2""")
def composite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null in a key either stands as a mark or makes the key null."""
    df = mv.load(spark, sf_dir).select("airport", joint_key(["stand", "runway"]).alias("key_joint"), strict_key(["stand", "runway"]).alias("key_strict"))
    return df.groupBy("airport", "key_joint").agg(F.count("*").alias("n"), F.count("key_strict").alias("n_strict"), F.min("key_strict").alias("key_strict"))


@query(f"""WITH {MV} SELECT mvt_id, phase, CASE WHEN phase = 'ARR' THEN block_us END AS block_us, CASE WHEN phase = 'ARR' THEN taxi_s END AS taxi_s,
CASE WHEN phase = 'DEP' THEN taxi_s END AS y_true FROM mv WHERE mvt_us >= 1705276800000000""")
def blind_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a time range as they look when departures' outcomes are hidden; the truth apart."""
    rows = mv.load(spark, sf_dir).filter(F.col("mvt_us") >= 1_705_276_800_000_000)
    return blind(rows, F.col("phase") == "DEP", ["block_us", "taxi_s"], "taxi_s").select("mvt_id", "phase", "block_us", "taxi_s", "y_true")


@query(f"WITH {MV} SELECT mvt_id, coalesce(abs(block_us - sched_us) <= 60000000, false) AS copied FROM mv WHERE phase = 'DEP'")
def copy_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return departures(spark, sf_dir).select("mvt_id", rules.copied(F.col("block_us"), F.col("sched_us")).alias("copied"))


_PRED = "(event_id * 13) % 5400"


@query(f"""WITH {MV}, w AS (SELECT mvt_id, {_PRED} AS pred, (mvt_us - lobt_us) / 1e6 AS m FROM mv WHERE phase = 'DEP')
SELECT mvt_id, m - 3606 AS low, m + 3606 AS high, greatest(0.0, least(m + 3606, greatest(m - 3606, pred)))::DOUBLE AS clipped,
pred - (m - 3606) AS dist_low, m + 3606 - pred AS dist_high FROM w""")
def lobt_window_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction moved into the window that the plan leaves, unbounded without a plan, and its distance to the edges."""
    low, high = rules.feasible_window(F.col("mvt_us"), F.col("lobt_us"))
    df = departures(spark, sf_dir).select("mvt_id", F.expr(_PRED).cast("double").alias("pred"), low.alias("low"), high.alias("high"))
    bounds = F.col("pred"), F.col("low"), F.col("high")
    return df.select("mvt_id", "low", "high", rules.project(*bounds).alias("clipped"), *[c.alias(n) for n, c in rules.edge_distances(*bounds).items()])


@query(f"""WITH {MV}, x AS (SELECT mvt_id, CASE WHEN event_id % 9 <> 0 THEN (mvt_us - sched_us) / 1e6 END AS ms,
((event_id * 37) % 100) / 100.0::DOUBLE AS p, {_PRED} AS reg, (mvt_us - lobt_us) / 1e6 AS m FROM mv WHERE phase = 'DEP'),
y AS (SELECT *, CASE WHEN ms < m - 3606 OR ms > m + 3606 THEN 0.0 ELSE p END AS p2 FROM x)
SELECT mvt_id, round(p2, 6) AS p_possible, round(greatest(0.0, CASE WHEN ms IS NULL THEN reg ELSE p2 * ms + (1 - p2) * reg END), 6) AS expected FROM y""")
def mixture_expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-stage expectation, with copies ruled out where the window excludes the schedule."""
    low, high = rules.feasible_window(F.col("mvt_us"), F.col("lobt_us"))
    df = departures(spark, sf_dir).select("mvt_id", F.when(F.col("event_id") % 9 != 0, (F.col("mvt_us") - F.col("sched_us")) / mv.SECOND).alias("ms"), ((F.col("event_id") * 37 % 100) / 100).alias("p"), F.expr(_PRED).cast("double").alias("reg"), low.alias("low"), high.alias("high"))
    df = df.withColumn("p2", rules.copy_possible(F.col("p"), F.col("ms"), F.col("low"), F.col("high")))
    return df.select("mvt_id", F.round("p2", 6).alias("p_possible"), F.round(rules.mixture(F.col("p2"), F.col("ms"), F.col("reg")), 6).alias("expected"))


def _weight_sql(kind: str) -> str:
    d = "greatest(abs(ms - 900), 60)"
    return f"""WITH {MV}, x AS (SELECT mvt_id, CASE WHEN event_id % 9 <> 0 THEN (mvt_us - sched_us) / 1e6 END AS ms FROM mv WHERE phase = 'DEP'),
y AS (SELECT mvt_id, CASE WHEN ms IS NULL THEN 0.0 ELSE {d if kind == "abs" else f"{d} * {d}"} END AS w FROM x)
SELECT mvt_id, round(w / (SELECT avg(w) FROM y WHERE w > 0), 6) AS weight FROM y"""


def _weights(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    df = departures(spark, sf_dir).select("mvt_id", F.when(F.col("event_id") % 9 != 0, (F.col("mvt_us") - F.col("sched_us")) / mv.SECOND).alias("ms"))
    return rules.classifier_weight(df, "ms", kind).select("mvt_id", F.round("weight", 6).alias("weight"))


@query(_weight_sql("abs"))
def classifier_weight_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir, "abs")


@query(_weight_sql("quad"))
def classifier_weight_quad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir, "quad")


@query(f"""WITH {MV}, x AS (SELECT mvt_id, airport, flight_id IS NULL AS no_plan, (mvt_us - sched_us) / 1e6 * 8 AS ms, {_PRED} AS pred FROM mv
WHERE phase = 'DEP'),
y AS (SELECT *, coalesce(no_plan AND ms > 7200 AND airport <> 'A9', false) AS line_row,
coalesce(no_plan AND airport = 'A3' AND ms > 54000 AND ms <= 108000, false) AS fixed_row FROM x)
SELECT mvt_id, line_row, fixed_row, round(CASE WHEN fixed_row THEN 54310.76 + 0.38 * ms ELSE pred END, 6) AS ruled FROM y""")
def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that rules decide, and the ordered post-rules on a prediction."""
    df = departures(spark, sf_dir).select("mvt_id", "airport", F.col("flight_id").isNull().alias("no_plan"), ((F.col("mvt_us") - F.col("sched_us")) / mv.SECOND * 8).alias("ms"), F.expr(_PRED).cast("double").alias("pred"))
    fixed = rules.between_rows(F.col("no_plan"), F.col("ms"), F.col("airport"), "A3")
    df = df.withColumn("line_row", rules.rule_rows(F.col("no_plan"), F.col("ms"), 7200, F.col("airport") != "A9")).withColumn("fixed_row", fixed)
    return df.select("mvt_id", "line_row", "fixed_row", F.round(rules.apply_rules(F.col("pred"), ["late_line"], F.col("fixed_row"), F.col("ms")), 6).alias("ruled"))


_REF_S = {r: f"(mvt_us - {r}_us) / 1e6" for r in REFS}
_MIN = ", ".join(f"abs({_PRED} - {x})" for x in _REF_S.values())


@query(f"""WITH {MV} SELECT mvt_id, {", ".join(f"{_PRED} - {x} AS dist_{r}" for r, x in _REF_S.items())}, least({_MIN}) AS dist_min,
({" + ".join(f"({x} IS NOT NULL)::INTEGER" for x in _REF_S.values())})::INTEGER AS dist_n,
({" + ".join(f"coalesce(({x} > 3600)::INTEGER, 0)" for x in _REF_S.values())})::INTEGER AS dist_over_hour,
{" OR ".join(f"coalesce(abs(taxi_s - {x}) <= 300, false)" for x in _REF_S.values())} AS near_plan,
taxi_s > 10800 AND NOT ({" OR ".join(f"coalesce(abs(taxi_s - {x}) <= 300, false)" for x in _REF_S.values())}) AS lottery FROM mv WHERE phase = 'DEP'""")
def plan_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of a prediction to each plan, and whether the outcome lies near one."""
    refs = {r: (F.col("mvt_us") - F.col(f"{r}_us")) / mv.SECOND for r in REFS}
    columns = rules.plan_distances(F.expr(_PRED), refs) | {"near_plan": rules.near_plan(F.col("taxi_s"), list(refs.values())), "lottery": rules.lottery(F.col("taxi_s"), list(refs.values()))}
    return departures(spark, sf_dir).select("mvt_id", *[c.alias(n) for n, c in columns.items()])


#: Pairs of places and types as flown and as planned; the planned ones are made up.
_PAIRED = {"adep": ("airport", "'A' || ((event_id + user_id) % 10)"), "stand": ("stand", "'S' || (event_id % 19)"), "runway": ("runway", "'R' || (event_id % 4)"), "wake": ("wake", "CASE WHEN event_id % 3 = 0 THEN 'M' WHEN event_id % 3 = 1 THEN 'H' END")}


@query(f"""WITH {MV} SELECT mvt_id, (mvt_us - eobt_us) / 1e6 AS nm_plan, (mvt_us - aobt_us) / 1e6 AS nm_actual,
(mvt_us - aobt_us) / 1e6 - (mvt_us - eobt_us) / 1e6 AS nm_diff,
round(CASE WHEN mvt_us - eobt_us > 0 THEN (mvt_us - aobt_us)::DOUBLE / (mvt_us - eobt_us) END, 9) AS nm_ratio,
{", ".join(f"coalesce({a} = {b}, false)::INTEGER AS same_{n}" for n, (a, b) in _PAIRED.items())},
CASE upper(wake[1]) WHEN 'J' THEN 2.0 WHEN 'H' THEN 1.6 WHEN 'M' THEN 1.0 WHEN 'L' THEN 0.7 ELSE 1.0 END::DOUBLE AS wake_weight,
coalesce(wake IN ('J', 'H'), false)::INTEGER AS heavy FROM mv WHERE phase = 'DEP'""")
def plan_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned and actual durations, their difference and ratio, whether flown and planned agree, and wake weights."""
    planned, actual = (F.col("mvt_us") - F.col("eobt_us")) / mv.SECOND, (F.col("mvt_us") - F.col("aobt_us")) / mv.SECOND
    both = consistency(planned, actual)
    flags = [fn.same(F.col(a), F.expr(b)).alias(f"same_{n}") for n, (a, b) in _PAIRED.items()]
    return departures(spark, sf_dir).select("mvt_id", planned.alias("nm_plan"), actual.alias("nm_actual"), both["nm_diff"].alias("nm_diff"), F.round(both["nm_ratio"], 9).alias("nm_ratio"), *flags, fn.wake_weight(F.col("wake")).alias("wake_weight"), fn.heavy(F.col("wake")).alias("heavy"))


_AROUND = """(SELECT count(*) FROM mv e
WHERE e.phase = '{phase}' AND e.airport = d.airport{more} AND e.sec >= d.sec - 3600 AND e.sec <= d.sec + 3600 AND e.sec {side} d.sec)::BIGINT"""
_QUEUE = {"dep_prev60": ("DEP", "", "<"), "dep_next60": ("DEP", "", ">"), "arr_prev60": ("ARR", "", "<"), "arr_next60": ("ARR", "", ">"), "rwy_prev60": ("DEP", " AND e.runway = d.runway", "<"), "rwy_next60": ("DEP", " AND e.runway = d.runway", ">")}
_QUEUE_SQL = ", ".join(f"{_AROUND.format(phase=p, more=m, side=s)} AS {n}" for n, (p, m, s) in _QUEUE.items())


@query(f"""WITH {MV}, q AS (SELECT d.mvt_id, d.airport, d.runway, d.stand, {_QUEUE_SQL} FROM mv d WHERE d.phase = 'DEP')
SELECT mvt_id, {", ".join(_QUEUE)}, rwy_prev60 + rwy_next60 AS rwy_hours, airport || '|' || runway AS apt_rwy,
airport || '|' || coalesce(nullif(regexp_extract(stand, '^([A-Za-z]+|\\d)', 1), ''), '?') AS apt_stand FROM q""")
def queue_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue block: counts of an hour around each departure, the runway's two hours together, and categories of place."""
    from .window_queries import congestion_counts

    places = departures(spark, sf_dir).select("mvt_id", joint_key(["airport", "runway"]).alias("apt_rwy"), F.concat_ws("|", "airport", F.coalesce(fn.stand_prefix(F.col("stand")), F.lit("?"))).alias("apt_stand"))
    return congestion_counts(spark, sf_dir).select("mvt_id", *_QUEUE, (F.col("rwy_prev60") + F.col("rwy_next60")).alias("rwy_hours")).join(places, "mvt_id")


@query(f"""WITH {MV}, d AS (SELECT *, {_PRED} AS pred, (mvt_us - lobt_us) / 1e6 AS m FROM mv WHERE phase = 'DEP')
SELECT mvt_id, pred::DOUBLE AS pred, pred - (m - 3606) AS dist_low, m + 3606 - pred AS dist_high,
{", ".join(f"round((mvt_us - {r}_us) / 1e6, 6) AS to_takeoff_from_{r}" for r in REFS)},
coalesce(wake = (CASE WHEN event_id % 3 = 0 THEN 'M' WHEN event_id % 3 = 1 THEN 'H' END), false)::INTEGER AS same_wake, (SELECT count(*) FROM mv e
WHERE e.phase = 'DEP' AND e.airport = d.airport AND e.mvt_us >= d.mvt_us - 1800000000 AND e.mvt_us < d.mvt_us)::BIGINT * 2 AS rate FROM d""")
def corrector_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corrector's input: a prediction with window edges, plan distances, consistency and traffic, each a block of its own, joined
    by id."""
    from .window_queries import dep_rate_30m

    base = departures(spark, sf_dir).select("mvt_id", F.expr(_PRED).cast("double").alias("pred"))
    plans = base_features(spark, sf_dir).select("mvt_id", *[f"to_takeoff_from_{r}" for r in REFS])
    blocks = [lobt_window_clip(spark, sf_dir).select("mvt_id", "dist_low", "dist_high"), plans, plan_consistency(spark, sf_dir).select("mvt_id", "same_wake"), dep_rate_30m(spark, sf_dir)]
    return assemble(base, blocks, "mvt_id")


@query(f"""WITH {MV}, o AS (SELECT mvt_id, row_number() OVER (ORDER BY taxi_s DESC, mvt_id) - 1 AS place FROM mv WHERE phase = 'ARR')
SELECT o.mvt_id, o.place, mv.airport, mv.taxi_s FROM o JOIN mv USING (mvt_id)""")
def rows_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the places that a list of ids gives them."""
    rows = mv.load(spark, sf_dir).filter("phase = 'ARR'")
    places = cells.places(rows.select("mvt_id", "taxi_s"), "taxi_s", "mvt_id", descending=True).select("mvt_id", "place")
    return in_order(rows.select("mvt_id", "airport", "taxi_s"), places, "mvt_id", "place")


@query("""WITH x AS (SELECT event_id, value AS tmpf, value - (event_id % 20) AS dwpf,
CASE event_id % 6 WHEN 0 THEN 'FG' WHEN 1 THEN '-SN' WHEN 2 THEN 'RA BR' WHEN 3 THEN 'TSRA' WHEN 4 THEN 'FZDZ' END AS wx FROM events
WHERE event_type = 'error'),
y AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN (tmpf - 32) * 5 / 9 END AS t, (dwpf - 32) * 5 / 9 AS d, coalesce(regexp_matches(wx, 'FG|BR'),
false)::INTEGER AS fog, coalesce(regexp_matches(wx, 'SN|SG|PL'), false)::INTEGER AS snow,
coalesce(regexp_matches(wx, 'RA|DZ'), false)::INTEGER AS rain, coalesce(regexp_matches(wx, 'TS'), false)::INTEGER AS thunder,
coalesce(regexp_matches(wx, 'FZ'), false)::INTEGER AS freezing FROM x)
SELECT event_id, round(t, 6) AS temp_c, round(t - d, 6) AS spread_c, fog, snow, rain, thunder, freezing,
CASE WHEN t IS NOT NULL THEN (((t <= 3) AND coalesce(snow = 1 OR rain = 1 OR t - d <= 2, false)) OR freezing = 1)::INTEGER END AS deicing FROM y""")
def weather_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fahrenheit to Celsius, spread, present-weather flags and a de-icing proxy."""
    e = F.col("event_id")
    wx = F.when(e % 6 == 0, "FG").when(e % 6 == 1, "-SN").when(e % 6 == 2, "RA BR").when(e % 6 == 3, "TSRA").when(e % 6 == 4, "FZDZ")
    df = table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", F.when(e % 7 != 0, fn.celsius(F.col("value"))).alias("t"), fn.celsius(F.col("value") - e % 20).alias("d"), *[c.alias(n) for n, c in fn.weather_flags(wx).items()])
    spread = F.col("t") - F.col("d")
    return df.select("event_id", F.round("t", 6).alias("temp_c"), F.round(spread, 6).alias("spread_c"), "fog", "snow", "rain", "thunder", "freezing", fn.deicing_likely(F.col("t"), F.col("snow"), F.col("rain"), spread, F.col("freezing")).alias("deicing"))


@query("""SELECT p_partkey, coalesce(nullif(regexp_extract(upper(p_name), '^([A-Z]{2,3})', 1), ''), '?') AS airline,
nullif(regexp_extract(upper(p_brand), '([A-Z]?\\d+[A-Z]?)$', 1), '') AS suffix, nullif(regexp_extract(p_brand, '^([A-Za-z]+|\\d)', 1), '') AS prefix,
regexp_replace(regexp_replace(upper(trim(p_name)), '-\\(.\\)$', ''), '[^A-Z0-9]', '', 'g') AS plain,
CASE WHEN p_size > 10 THEN p_retailprice / p_size END AS ratio FROM part""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String functions on names: leading codes, prefixes, normal forms."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", fn.airline(F.upper("p_name")).alias("airline"), fn.numeric_suffixes(F.upper("p_brand"))[0].alias("suffix"), fn.stand_prefix(F.col("p_brand")).alias("prefix"), fn.plain_name(F.col("p_name")).alias("plain"), F.when(size > 10, fn.safe_ratio(F.col("p_retailprice"), size)).alias("ratio"))
