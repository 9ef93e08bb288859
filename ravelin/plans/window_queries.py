"""Point-process windows, as-of joins, matching and islands over the movements view."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import asof, islands, matching, runway, tracks, windows
from ..sources import movements as mv
from ..sources.movements import SECOND
from ..sources.movements import SQL as MV
from ..sources.storage import materialise
from .catalogue import query

DAY = 86_400 * SECOND
PRED = "(event_id * 13) % 1800"


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = mv.load(spark, sf_dir)
    return rows, rows.filter("phase = 'DEP'"), rows.filter("phase = 'ARR'")


# Frames of fixed width

_W1 = {f"{side}{m}": (f"e.sec >= d.sec - {60 * m} AND e.sec < d.sec" if side == "prev" else f"e.sec > d.sec AND e.sec <= d.sec + {60 * m}") for m in (10, 20, 30, 60) for side in ("prev", "next")}


def _w1_sql() -> str:
    parts = []
    for name, phase, keys in (("dep", "DEP", "e.airport = d.airport"), ("arr", "ARR", "e.airport = d.airport"), ("rwy", "DEP", "e.airport = d.airport AND e.runway = d.runway")):
        counts = ", ".join(f"count(*) FILTER (WHERE {c})::BIGINT AS {name}_{n}" for n, c in _W1.items())
        parts.append(f"SELECT d.mvt_id, {counts} FROM mv d LEFT JOIN mv e ON {keys} AND e.phase = '{phase}' AND e.sec BETWEEN d.sec - 3600 AND d.sec + 3600 WHERE d.phase = 'DEP' GROUP BY d.mvt_id")
    return f"WITH {MV} SELECT * FROM ({parts[0]}) JOIN ({parts[1]}) USING (mvt_id) JOIN ({parts[2]}) USING (mvt_id)"


@query(_w1_sql())
def congestion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements before and after each departure in frames of 10 to 60 minutes; those of the same second count on neither side."""
    rows, dep, _ = both(spark, sf_dir)
    is_dep = F.col("phase") == "DEP"
    moves = rows.select("airport", "runway", "sec", F.when(is_dep, 1).alias("dep"), F.when(~is_dep, 1).alias("arr"))
    spans = {f"prev{m}": (-60 * m, -1) for m in (10, 20, 30, 60)} | {f"next{m}": (1, 60 * m) for m in (10, 20, 30, 60)}
    at_airport = {f"{kind}_{n}": ("count", kind, *span) for kind in ("dep", "arr") for n, span in spans.items()}
    on_runway = {f"rwy_{n}": ("count", None, *span) for n, span in spans.items()}
    out = windows.range_aggregate(moves, dep, ["airport"], "sec", at_airport, "mvt_id")
    return dep.select("mvt_id").join(out, "mvt_id", "left").join(windows.range_aggregate(moves.filter("dep = 1"), dep, ["airport", "runway"], "sec", on_runway, "mvt_id"), "mvt_id", "left").na.fill(0)


def _taxi_sql(keys: str, p: str) -> str:
    v = "least(3600.0, greatest(0.0, e.taxi_s))"
    cols = ", ".join(f"round(avg({v}) FILTER (WHERE e.sec > d.sec - {60 * m}), 6) AS {p}_mean{m}, count(e.taxi_s) FILTER (WHERE e.sec > d.sec - {60 * m})::BIGINT AS {p}_n{m}" for m in (15, 60))
    return f"""(SELECT d.mvt_id, {cols} FROM mv d LEFT JOIN mv e ON {keys} AND e.phase = 'ARR' AND e.sec > d.sec - 3600 AND e.sec <= d.sec
WHERE d.phase = 'DEP' GROUP BY d.mvt_id)"""


@query(f"""WITH {MV} SELECT * FROM {_taxi_sql('e.airport = d.airport', 'apt')}
JOIN {_taxi_sql('e.airport = d.airport AND e.runway = d.runway', 'rwy')} USING (mvt_id)""")
def arrival_taxi_in_ctx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean clipped taxi-in and count of the arrivals of the last 15 and 60 minutes, at the airport and on the runway."""
    _, dep, arr = both(spark, sf_dir)
    arr = arr.withColumn("v", F.greatest(F.lit(0.0), F.least(F.lit(3600.0), F.col("taxi_s"))))
    out = dep.select("mvt_id")
    for p, by in (("apt", ["airport"]), ("rwy", ["airport", "runway"])):
        frames = {f"{p}_{short}{m}": (kind, "v", -60 * m + 1, 0) for m in (15, 60) for short, kind in (("mean", "mean"), ("n", "count"))}
        got = windows.range_aggregate(arr, dep, by, "sec", frames, "mvt_id")
        out = out.join(got.select("mvt_id", *[F.round(c, 6).alias(c) if "mean" in c else F.col(c) for c in frames]), "mvt_id", "left")
    return out.na.fill(0, [c for c in out.columns if "_n" in c])


_PROXY = "CASE WHEN mvt_us - aobt_us BETWEEN 0 AND 7200000000 THEN (mvt_us - aobt_us) / 1e6 END"


@query(f"""WITH {MV}, p AS (SELECT *, {_PROXY} AS proxy FROM mv WHERE phase = 'DEP'), x AS (
SELECT d.mvt_id, d.proxy, avg(e.proxy) FILTER (WHERE e.airport = d.airport AND e.sec < d.sec) AS apt_past,
avg(e.proxy) FILTER (WHERE e.sec > d.sec) AS apt_future,
avg(e.proxy) FILTER (WHERE e.runway = d.runway AND e.sec < d.sec) AS rwy_past,
avg(e.proxy) FILTER (WHERE e.runway = d.runway AND e.sec > d.sec) AS rwy_future
FROM p d LEFT JOIN p e ON e.airport = d.airport AND e.sec BETWEEN d.sec - 3600 AND d.sec + 3600 GROUP BY d.mvt_id, d.proxy)
SELECT mvt_id, round(apt_past, 6) AS apt_past, round(apt_future, 6) AS apt_future, round(rwy_past, 6) AS rwy_past, round(rwy_future, 6) AS rwy_future,
round(proxy - apt_past, 6) AS own_less_past, round(proxy - apt_future, 6) AS own_less_future FROM x""")
def neighbour_proxy_ctx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean off-block-to-take-off time of the neighbours in the hour before and after, and the own value against it."""
    _, dep, _ = both(spark, sf_dir)
    dep = dep.withColumn("proxy", F.expr(_PROXY).cast("double"))
    out = dep.select("mvt_id", F.col("proxy").alias("own"))
    for p, by in (("apt", ["airport"]), ("rwy", ["airport", "runway"])):
        frames = {f"{p}_past": ("mean", "proxy", -3600, -1), f"{p}_future": ("mean", "proxy", 1, 3600)}
        out = out.join(windows.range_aggregate(dep, dep, by, "sec", frames, "mvt_id"), "mvt_id", "left")
    names = ["apt_past", "apt_future", "rwy_past", "rwy_future"]
    return out.select("mvt_id", *[F.round(c, 6).alias(c) for c in names], F.round(F.col("own") - F.col("apt_past"), 6).alias("own_less_past"), F.round(F.col("own") - F.col("apt_future"), 6).alias("own_less_future"))


@query(f"""WITH {MV} SELECT d.mvt_id, count(e.mvt_id)::BIGINT * 2 AS rate FROM mv d LEFT
JOIN mv e ON e.airport = d.airport AND e.phase = 'DEP' AND e.mvt_us >= d.mvt_us - 1800000000 AND e.mvt_us < d.mvt_us WHERE d.phase = 'DEP'
GROUP BY d.mvt_id""")
def dep_rate_30m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departures an hour, from the last 30 minutes."""
    _, dep, _ = both(spark, sf_dir)
    got = windows.range_aggregate(dep.select("airport", "mvt_us"), dep, ["airport"], "mvt_us", {"rate": ("count", None, -1800 * SECOND, -1)}, "mvt_id")
    return got.select("mvt_id", (2 * F.col("rate")).alias("rate"))


def _delay_sql(seconds: int) -> str:
    return f"""WITH {MV} SELECT d.mvt_id, round(avg((e.aobt_us - e.sched_us) / 1e6), 6) AS recent_delay
FROM mv d LEFT JOIN mv e ON e.airport = d.airport AND e.aobt_us >= d.aobt_us - {seconds}000000 AND e.aobt_us < d.aobt_us
WHERE d.phase = 'DEP' AND d.aobt_us IS NOT NULL GROUP BY d.mvt_id"""


def _delay(spark: SparkSession, sf_dir: str, seconds: int) -> DataFrame:
    _, dep, _ = both(spark, sf_dir)
    pushed = dep.filter("aobt_us IS NOT NULL").withColumn("delay_us", F.col("aobt_us") - F.col("sched_us"))
    got = windows.range_aggregate(pushed, pushed, ["airport"], "aobt_us", {"d": ("mean", "delay_us", -seconds * SECOND, -1)}, "mvt_id")
    return got.select("mvt_id", F.round(F.col("d") / SECOND, 6).alias("recent_delay"))


@query(_delay_sql(900))
def recent_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean push delay of the airport in the 15 minutes before each push."""
    return _delay(spark, sf_dir, 900)


@query(_delay_sql(5400))
def recent_delay_90m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over 90 minutes, in which the test tables' sparse pushes have more company."""
    return _delay(spark, sf_dir, 5400)


_RATE = 3600 * log(2) / 600


@query(f"""WITH {MV} SELECT d.mvt_id, round({_RATE!r} * coalesce(sum(pow(2.0, (e.mvt_us - d.aobt_us) / 1e6 / 600)), 0), 6) AS ewma FROM mv d LEFT
JOIN mv e ON e.airport = d.airport AND e.phase = 'DEP' AND e.mvt_us >= d.aobt_us - 7200000000 AND e.mvt_us < d.aobt_us
WHERE d.phase = 'DEP' AND d.aobt_us IS NOT NULL GROUP BY d.mvt_id""")
def ewma_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departures an hour at each push, with weights halving every 600 seconds and cut at two hours."""
    _, dep, _ = both(spark, sf_dir)
    events = dep.select("airport", F.col("mvt_us").alias("t"))
    asked = dep.filter("aobt_us IS NOT NULL").select("airport", "mvt_id", F.col("aobt_us").alias("t"))
    got = windows.decayed_sum(events, asked, ["airport"], "t", "mvt_id", 600.0, 7200 * SECOND, 21_600 * SECOND, SECOND, "g")
    return got.select("mvt_id", F.round(F.col("g") * _RATE, 6).alias("ewma"))


# Bounds that differ from row to row


@query(f"""WITH {MV}, w AS (SELECT *, CASE wake WHEN 'J' THEN 20 WHEN 'H' THEN 16 WHEN 'M' THEN 10 WHEN 'L' THEN 7 ELSE 10 END AS weight,
(coalesce(wake IN ('J', 'H'), false))::INTEGER AS heavy FROM mv WHERE phase = 'DEP')
SELECT d.mvt_id, CASE WHEN d.aobt_us IS NOT NULL THEN greatest(0, coalesce(sum(e.weight), 0) - d.weight) / 10.0::DOUBLE END AS queue,
CASE WHEN d.aobt_us IS NOT NULL THEN greatest(0, coalesce(sum(e.heavy), 0) - d.heavy)::BIGINT END AS heavies
FROM w d LEFT JOIN w e ON e.airport = d.airport AND e.runway = d.runway AND e.mvt_us > d.aobt_us AND e.mvt_us <= d.mvt_us
GROUP BY d.mvt_id, d.aobt_us, d.weight, d.heavy""")
def queue_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wake-weighted departures of the own runway between own push and own take-off, without oneself."""
    _, dep, _ = both(spark, sf_dir)
    dep = dep.withColumn("w10", F.round(fn.wake_weight(F.col("wake")) * 10).cast("long")).withColumn("heavy", fn.heavy(F.col("wake")).cast("long"))
    span = (F.col("aobt_us"), F.col("mvt_us"))
    sums = windows.interval_sums(dep, dep, ["airport", "runway"], "mvt_id", "mvt_us", {"q": ("w10", *span), "h": ("heavy", *span)}, DAY)
    less = lambda c, own: F.when(F.col("aobt_us").isNotNull(), F.greatest(F.lit(0), F.col(c) - F.col(own)))
    return dep.join(sums, "mvt_id").select("mvt_id", (less("q", "w10") / 10).alias("queue"), less("h", "heavy").alias("heavies"))


def counts_at(population: DataFrame, queries: DataFrame, by: list[str], plus: str, minus: str, at: str, out: str) -> DataFrame:
    """(mvt_id, out): how many of the population have plus <= t but not minus <= t, at each query's t."""
    ends = population.select(*by, F.col(plus).alias("t"), F.lit(1).alias("w")).unionByName(population.select(*by, F.col(minus).alias("t"), F.lit(-1).alias("w")))
    probes = queries.select(*by, "mvt_id", F.col(at).alias("t"))
    return windows.totals_until(ends, probes, by, "t", {out: "w"}, ["mvt_id"], DAY)


def _overdue(keys: str) -> str:
    return f"""(SELECT count(*) FROM v e WHERE {keys} AND e.eobt_us <= d.aobt_us)::BIGINT - (SELECT count(*) FROM v e
WHERE {keys} AND e.aobt_us <= d.aobt_us)::BIGINT"""


@query(f"""WITH {MV}, v AS (SELECT * FROM mv WHERE phase = 'DEP' AND aobt_us - eobt_us >= 0 AND aobt_us - eobt_us < 7200000000 AND mvt_us >= aobt_us)
SELECT d.mvt_id, {_overdue('e.airport = d.airport AND e.runway = d.runway')} AS overdue_rwy, {_overdue('e.airport = d.airport')} AS overdue_apt
FROM mv d WHERE d.phase = 'DEP' AND d.aobt_us IS NOT NULL""")
def overdue_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departures that were due to push but had not, at each push."""
    _, dep, _ = both(spark, sf_dir)
    valid = dep.filter(f"aobt_us - eobt_us >= 0 AND aobt_us - eobt_us < {7200 * SECOND} AND mvt_us >= aobt_us")
    asked = dep.filter("aobt_us IS NOT NULL")
    rwy = counts_at(valid, asked, ["airport", "runway"], "eobt_us", "aobt_us", "aobt_us", "overdue_rwy")
    return rwy.join(counts_at(valid, asked, ["airport"], "eobt_us", "aobt_us", "aobt_us", "overdue_apt"), "mvt_id")


@query(f"""WITH {MV}, v AS (SELECT * FROM mv WHERE phase = 'DEP' AND aobt_us IS NOT NULL AND mvt_us >= aobt_us)
SELECT d.mvt_id, greatest(0, (SELECT count(*) FROM v e
WHERE e.airport = d.airport AND e.runway = d.runway AND e.aobt_us <= d.aobt_us) - (SELECT count(*) FROM v e
WHERE e.airport = d.airport AND e.runway = d.runway AND e.mvt_us <= d.aobt_us) - 1)::BIGINT AS active FROM v d""")
def active_runway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departures under way to the own runway at each push, without oneself."""
    _, dep, _ = both(spark, sf_dir)
    valid = dep.filter("aobt_us IS NOT NULL AND mvt_us >= aobt_us")
    got = counts_at(valid, valid, ["airport", "runway"], "aobt_us", "mvt_us", "aobt_us", "n")
    return got.select("mvt_id", F.greatest(F.lit(0), F.col("n") - 1).alias("active"))


@query(f"""WITH {MV}, d AS (SELECT *, {PRED} AS taxi, mvt_us - 1000000 * ({PRED}) AS o FROM mv WHERE phase = 'DEP'),
a AS (SELECT airport, mvt_us AS l, block_us AS b FROM mv WHERE phase = 'ARR' AND block_us >= mvt_us),
x AS (SELECT q.mvt_id, q.taxi, greatest(0, (SELECT count(*) FROM d e WHERE e.airport = q.airport AND e.o <= q.o) - (SELECT count(*) FROM d e
WHERE e.airport = q.airport AND e.mvt_us <= q.o) - (q.taxi > 0)::INTEGER)::BIGINT AS dep_taxiing,
(SELECT count(*) FROM d e WHERE e.airport = q.airport AND e.mvt_us > q.o AND e.mvt_us < q.mvt_us)::BIGINT AS off_apt, (SELECT count(*) FROM d e
WHERE e.airport = q.airport AND e.runway = q.runway AND e.mvt_us > q.o AND e.mvt_us < q.mvt_us)::BIGINT AS off_rwy,
(SELECT count(*) FROM a WHERE a.airport = q.airport AND a.l <= q.o AND a.b > q.o)::BIGINT AS arr_taxiing, (SELECT count(*) FROM a
WHERE a.airport = q.airport AND a.l > q.o AND a.l < q.mvt_us)::BIGINT AS landings FROM d q)
SELECT mvt_id, dep_taxiing, off_apt, off_rwy, arr_taxiing, landings, round(CASE WHEN taxi > 0 THEN off_rwy / (taxi / 60.0) END, 6) AS off_rwy_per_min,
round(CASE WHEN taxi > 0 THEN off_apt / (taxi / 60.0) END, 6) AS off_apt_per_min, round(CASE WHEN taxi > 0 THEN landings / (taxi / 60.0) END,
6) AS landings_per_min FROM x""")
def surface_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface traffic during a predicted taxi: who taxies at push, who leaves and lands before own take-off, and how fast."""
    _, dep, arr = both(spark, sf_dir)
    dep = dep.withColumn("taxi", F.expr(PRED)).withColumn("o", F.col("mvt_us") - SECOND * F.col("taxi"))
    arr = arr.filter("block_us >= mvt_us")
    one, none = F.lit(1), F.lit(0)
    event = lambda df, at, out, taxied, off, landed: df.select("airport", "runway", F.col(at).alias("t"), out.alias("taxi_out"), taxied.alias("taxi_in"), off.alias("off"), landed.alias("landed"))
    # One event stream: who begins and ends to taxi, takes off, lands. One table of instants: at push, and just before take-off.
    events = event(dep, "o", one, none, none, none).unionByName(event(dep, "mvt_us", -one, none, one, none)).unionByName(event(arr, "mvt_us", none, one, none, one)).unionByName(event(arr, "block_us", none, -one, none, none))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("o").alias("t")), F.struct(F.lit(1).alias("end"), F.greatest(F.col("o"), F.col("mvt_us") - 1).alias("t"))))
    probes = dep.select("mvt_id", "airport", "runway", ends.alias("e")).select("mvt_id", "airport", "runway", "e.end", "e.t")
    at = lambda c, end: F.sum(F.when(F.col("end") == end, F.col(c)))
    apt = windows.totals_until(events, probes, ["airport"], "t", {c: c for c in ("taxi_out", "taxi_in", "off", "landed")}, ["mvt_id", "end"], DAY)
    apt = apt.groupBy("mvt_id").agg(at("taxi_out", 0).alias("n"), at("taxi_in", 0).alias("arr_taxiing"), (at("off", 1) - at("off", 0)).alias("off_apt"), (at("landed", 1) - at("landed", 0)).alias("landings"))
    rwy = windows.totals_until(events.filter("off = 1"), probes, ["airport", "runway"], "t", {"off": "off"}, ["mvt_id", "end"], DAY)
    out = dep.select("mvt_id", "taxi").join(apt, "mvt_id", "left").join(rwy.groupBy("mvt_id").agg((at("off", 1) - at("off", 0)).alias("off_rwy")), "mvt_id", "left")
    rate = lambda c: F.round(F.try_divide(F.col(c), F.col("taxi") / 60), 6).alias(f"{c}_per_min")
    return out.select("mvt_id", F.greatest(F.lit(0), F.col("n") - (F.col("taxi") > 0).cast("int")).alias("dep_taxiing"), "off_apt", "off_rwy", "arr_taxiing", "landings", rate("off_rwy"), rate("off_apt"), rate("landings"))


@query(f"WITH {MV} SELECT mvt_id, (mvt_us - lag(mvt_us, 20) OVER (PARTITION BY airport ORDER BY mvt_us)) / 1e6 AS span20 FROM mv WHERE phase = 'DEP'")
def span20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds since the 20th departure before; null if there are fewer."""
    _, dep, _ = both(spark, sf_dir)
    got = windows.previous_instant(dep.select("airport", "mvt_us"), dep, ["airport"], "mvt_us", "mvt_id", 20)
    return dep.select("mvt_id", "mvt_us").join(got, "mvt_id", "left").select("mvt_id", ((F.col("mvt_us") - F.col("t")) / SECOND).alias("span20"))


# Runway configuration

_BINS = f"""WITH {MV}, m AS (SELECT *, mvt_us // 600000000 AS b FROM mv), f AS (SELECT airport, min(b) AS first FROM m GROUP BY airport),
q AS (SELECT mvt_id, airport, runway, b FROM m WHERE phase = 'DEP'),
act AS (SELECT q.mvt_id, s.back, e.phase, e.runway, count(*) AS n FROM q CROSS JOIN (VALUES (0), (6)) s(back)
JOIN m e ON e.airport = q.airport AND e.b BETWEEN q.b - s.back - 3 AND q.b - s.back + 2 GROUP BY ALL),
cfg AS (SELECT mvt_id, back, 'D:' || coalesce(string_agg(runway, '+'
ORDER BY runway) FILTER (WHERE phase = 'DEP'), '-') || ' A:' || coalesce(string_agg(runway, '+'
ORDER BY runway) FILTER (WHERE phase = 'ARR'), '-') AS c FROM act GROUP BY mvt_id, back),
per AS (SELECT mvt_id, count(*) FILTER (WHERE phase = 'DEP') AS n_dep_rwy, count(*) FILTER (WHERE phase = 'ARR') AS n_arr_rwy,
sum(n) FILTER (WHERE phase = 'DEP') AS total, max(n) FILTER (WHERE phase = 'DEP') AS most FROM act WHERE back = 0 GROUP BY mvt_id),
own AS (SELECT a.mvt_id, a.n FROM act a JOIN q ON q.mvt_id = a.mvt_id AND q.runway = a.runway WHERE a.phase = 'DEP' AND a.back = 0)
"""


@query(_BINS + "SELECT q.mvt_id, q.airport || '|' || c.c AS config FROM q JOIN cfg c ON c.mvt_id = q.mvt_id AND c.back = 0")
def runway_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runways in use around each departure."""
    rows, dep, _ = both(spark, sf_dir)
    return runway.configuration(rows, dep, "mvt_id").select("mvt_id", "config")


@query(_BINS + "SELECT q.mvt_id, CASE WHEN q.b - 6 >= f.first THEN (c.c <> coalesce(p.c, 'D:- A:-'))::INTEGER END AS changed FROM q JOIN f USING (airport) JOIN cfg c ON c.mvt_id = q.mvt_id AND c.back = 0 LEFT JOIN cfg p ON p.mvt_id = q.mvt_id AND p.back = 6")
def runway_config_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the configuration is another than six bins before; null before the airport's first bin."""
    rows, dep, _ = both(spark, sf_dir)
    return runway.configuration(rows, dep, "mvt_id").select("mvt_id", "changed")


@query(_BINS + "SELECT q.mvt_id, n_dep_rwy::BIGINT AS n_dep_rwy, n_arr_rwy::BIGINT AS n_arr_rwy, CASE WHEN total > 0 THEN (coalesce(own.n, 0) >= most)::INTEGER END AS dominant, round(coalesce(own.n, 0)::DOUBLE / total, 9) AS share FROM q JOIN per USING (mvt_id) LEFT JOIN own USING (mvt_id)")
def dominant_runway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many runways are active, and the own runway's part."""
    rows, dep, _ = both(spark, sf_dir)
    return runway.configuration(rows, dep, "mvt_id").select("mvt_id", "n_dep_rwy", "n_arr_rwy", "dominant", F.round("share", 9).alias("share"))


# As-of joins


@query(f"""WITH {MV}, a AS (SELECT airport, stand, block_us, taxi_s, mvt_id FROM mv WHERE phase = 'ARR' AND stand IS NOT NULL), j AS (
SELECT d.mvt_id, d.mvt_us, a.block_us, a.taxi_s, row_number() OVER (PARTITION BY d.mvt_id ORDER BY a.block_us DESC, a.mvt_id DESC) AS r FROM mv d LEFT
JOIN a ON a.airport = d.airport AND a.stand = d.stand AND a.block_us <= d.mvt_us AND a.block_us >= d.mvt_us - 86400000000 WHERE d.phase = 'DEP')
SELECT mvt_id, (mvt_us - block_us) / 1e6 AS age, taxi_s AS last_taxi_in FROM j WHERE r = 1""")
def stand_last_arrival_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age and taxi-in of the last arrival at the own stand within a day."""
    _, dep, arr = both(spark, sf_dir)
    got = asof.asof(dep.select("mvt_id", "airport", "stand", "mvt_us"), arr, ["airport", "stand"], "mvt_us", "block_us", DAY, ["taxi_s"], "mvt_id")
    return got.select("mvt_id", ((F.col("mvt_us") - F.col("r_block_us")) / SECOND).alias("age"), F.col("r_taxi_s").alias("last_taxi_in"))


@query(f"""WITH {MV}, j AS (SELECT d.mvt_id, d.aobt_us, d.user_id AS own, d.wake AS w, a.block_us, a.user_id AS theirs, a.wake AS w2,
row_number() OVER (PARTITION BY d.mvt_id ORDER BY a.block_us DESC, a.mvt_id DESC) AS r
FROM mv d LEFT
JOIN mv a ON a.phase = 'ARR' AND a.airport = d.airport AND a.stand = d.stand AND a.block_us <= d.aobt_us AND a.block_us >= d.aobt_us - 86400000000
WHERE d.phase = 'DEP')
SELECT mvt_id, (aobt_us - block_us) / 1e6 AS age, CASE WHEN block_us IS NOT NULL THEN coalesce(own = theirs, false)::INTEGER END AS same_operator,
CASE WHEN block_us IS NOT NULL THEN coalesce(w = w2, false)::INTEGER END AS same_type FROM j WHERE r = 1""")
def rotation_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arrival that each departure's aircraft may have come with: age, same operator, same type."""
    _, dep, arr = both(spark, sf_dir)
    got = asof.asof(dep.select("mvt_id", "airport", "stand", "aobt_us", "user_id", "wake"), arr, ["airport", "stand"], "aobt_us", "block_us", DAY, ["user_id", "wake"], "mvt_id")
    equal = lambda a, b: F.when(F.col("r_block_us").isNotNull(), F.coalesce(F.col(a) == F.col(b), F.lit(False)).cast("int"))
    return got.select("mvt_id", ((F.col("aobt_us") - F.col("r_block_us")) / SECOND).alias("age"), equal("user_id", "r_user_id").alias("same_operator"), equal("wake", "r_wake").alias("same_type"))


_OBS = "FROM mv WHERE event_type = 'error'"


@query(f"""WITH {MV}, o AS (SELECT airport, mvt_us AS t, value, mvt_id AS oid {_OBS}),
j AS (SELECT d.mvt_id, d.mvt_us, o.t, o.value, row_number() OVER (PARTITION BY d.mvt_id ORDER BY o.t DESC, o.oid DESC) AS r FROM mv d LEFT
JOIN o ON o.airport = d.airport AND o.t <= d.mvt_us AND o.t >= d.mvt_us - 7200000000 WHERE d.phase = 'DEP')
SELECT mvt_id, (mvt_us - t) / 1e6 AS obs_age, value AS obs FROM j WHERE r = 1""")
def weather_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last observation of the airport, at most two hours old; one of the same instant counts."""
    rows, dep, _ = both(spark, sf_dir)
    obs = rows.filter("event_type = 'error'").select("airport", F.col("mvt_us").alias("t"), "value", F.col("mvt_id").alias("oid"))
    got = asof.asof(dep.select("mvt_id", "airport", "mvt_us"), obs, ["airport"], "mvt_us", "t", 7200 * SECOND, ["value"], "oid")
    return got.select("mvt_id", ((F.col("mvt_us") - F.col("r_t")) / SECOND).alias("obs_age"), F.col("r_value").alias("obs"))


def _nearest_sql(left: str, keys: str, tol: int) -> str:
    return f"""SELECT d.mvt_id, d.t, e.t AS et, e.eid, row_number() OVER (PARTITION BY d.mvt_id
ORDER BY abs(e.t - d.t), e.t, CASE WHEN e.t <= d.t THEN -e.eid ELSE e.eid END) AS r FROM {left} d JOIN ev e ON {keys} AND abs(e.t - d.t) <= {tol}"""


def _cascade_sql(near: int, far: int) -> str:
    one, two = _nearest_sql("dp", "e.airport = d.airport AND e.callsign = d.callsign", near * SECOND), _nearest_sql("rest", "e.airport = d.airport", far * SECOND)
    return f"""WITH {MV}, dp AS (SELECT mvt_id, airport, user_id % 30 AS callsign, mvt_us AS t FROM mv WHERE phase = 'DEP'),
ev AS (SELECT airport, user_id % 30 AS callsign, block_us AS t, mvt_id AS eid FROM mv WHERE phase = 'ARR'),
one AS ({one}), rest AS (SELECT * FROM dp WHERE mvt_id NOT IN (SELECT mvt_id FROM one)), two AS ({two})
SELECT dp.mvt_id, coalesce(one.et, two.et) AS matched_us, CASE WHEN one.et IS NOT NULL THEN 0 WHEN two.et IS NOT NULL THEN 1 END AS step
FROM dp LEFT JOIN one ON one.mvt_id = dp.mvt_id AND one.r = 1 LEFT JOIN two ON two.mvt_id = dp.mvt_id AND two.r = 1"""


def _cascade(spark: SparkSession, sf_dir: str, near: int, far: int) -> DataFrame:
    _, dep, arr = both(spark, sf_dir)
    call = (F.col("user_id") % 30).alias("callsign")
    left = dep.select("mvt_id", "airport", call, F.col("mvt_us").alias("t"))
    right = arr.select("airport", call, F.col("block_us").alias("at"), F.col("mvt_id").alias("eid"))
    got = asof.cascade(left, right, [(["airport", "callsign"], near * SECOND), (["airport"], far * SECOND)], "t", "at", [], "eid")
    return got.select("mvt_id", F.col("r_at").alias("matched_us"), "step")


@query(_cascade_sql(600, 90))
def nearest_asof_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest arrival by airport and callsign within ten minutes, and for the rest by airport within 90 seconds."""
    return _cascade(spark, sf_dir, 600, 90)


@query(_cascade_sql(21_600, 900))
def nearest_asof_cascade_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within six hours and 15 minutes: more matches in the test tables' sparse traffic."""
    return _cascade(spark, sf_dir, 21_600, 900)


def _band_sql(seconds: int) -> str:
    return f"""WITH {MV} SELECT d.mvt_id, e.mvt_id AS event_no, abs(d.mvt_us - e.block_us) / 1e6 AS apart
FROM mv d
JOIN mv e ON d.phase = 'DEP' AND e.phase = 'ARR' AND e.airport = d.airport AND e.user_id % 30 = d.user_id % 30 AND abs(d.mvt_us - e.block_us) < {seconds}000000"""


def _band(spark: SparkSession, sf_dir: str, seconds: int) -> DataFrame:
    _, dep, arr = both(spark, sf_dir)
    call = (F.col("user_id") % 30).alias("callsign")
    got = asof.band_join(dep.select("mvt_id", "airport", call, "mvt_us"), arr.select("airport", call, "block_us", F.col("mvt_id").alias("no")), ["airport", "callsign"], "mvt_us", "block_us", seconds * SECOND, ["no"])
    return got.select("mvt_id", F.col("r_no").alias("event_no"), (F.abs(F.col("mvt_us") - F.col("r_block_us")) / SECOND).alias("apart"))


@query(_band_sql(300))
def band_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of equal airport and callsign less than 300 seconds apart."""
    return _band(spark, sf_dir, 300)


@query(_band_sql(21_600))
def band_match_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, less than six hours apart: more pairs in the test tables' sparse traffic."""
    return _band(spark, sf_dir, 21_600)


_GREEDY = f"""WITH RECURSIVE {MV}, dp AS (SELECT mvt_id, airport, user_id % 30 AS c, mvt_us AS t FROM mv WHERE phase = 'DEP'),
ev AS (SELECT airport, user_id % 30 AS c, block_us AS t, mvt_id AS eid FROM mv WHERE phase = 'ARR'),
near AS (SELECT dp.mvt_id, e.eid, abs(e.t - dp.t) AS d, row_number() OVER (PARTITION BY dp.mvt_id
ORDER BY CASE WHEN e.t <= dp.t THEN e.t END DESC NULLS LAST, e.eid DESC) AS back,
  row_number() OVER (PARTITION BY dp.mvt_id ORDER BY CASE WHEN e.t >= dp.t THEN e.t END NULLS LAST, e.eid) AS ahead, e.t <= dp.t AS before,
e.t >= dp.t AS after FROM dp JOIN ev e ON e.airport = dp.airport AND abs(e.t - dp.t) <= 3600000000),
every AS (SELECT dp.mvt_id, e.eid, abs(e.t - dp.t) AS d, 0 AS p FROM dp
JOIN ev e ON e.airport = dp.airport AND e.c = dp.c AND abs(e.t - dp.t) < 7200000000
  UNION ALL SELECT mvt_id, eid, d, 1 FROM near WHERE back = 1 AND before OR ahead = 1 AND after),
pairs AS (SELECT mvt_id, eid, min(p) AS p, min(d) AS d FROM every GROUP BY 1, 2),
-- A round takes the pairs that are first of all that are left for both their ids, and drops those that share an id with them.
walk AS (
  SELECT mvt_id, eid, p, d, false AS hit FROM pairs
  UNION ALL
  SELECT mvt_id, eid, p, d, hit FROM (SELECT *, bool_or(hit) OVER (PARTITION BY mvt_id) AS l, bool_or(hit) OVER (PARTITION BY eid) AS r FROM (
    SELECT mvt_id, eid, p, d, row_number() OVER (PARTITION BY mvt_id ORDER BY p, d, eid) = 1 AND row_number() OVER (PARTITION BY eid
ORDER BY p, d, mvt_id) = 1 AS hit FROM walk WHERE NOT hit))
  WHERE hit OR NOT l AND NOT r
)
SELECT mvt_id, eid AS event_no, p AS priority, d AS distance FROM walk WHERE hit"""


@query(_GREEDY)
def greedy_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departures and arrivals of an airport matched one to one: callsign pairs first, then by distance."""
    _, dep, arr = both(spark, sf_dir)
    call = (F.col("user_id") % 30).alias("callsign")
    left = dep.select("mvt_id", "airport", call, "mvt_us")
    right = arr.select("airport", call, "block_us", F.col("mvt_id").alias("event_no"))
    if matching.repeats(left, "mvt_id") or matching.repeats(right, "event_no"):  # points of one id in several places
        same = asof.band_join(left, right, ["airport", "callsign"], "mvt_us", "block_us", 7200 * SECOND, ["event_no"])
        same = same.select("mvt_id", F.col("r_event_no").alias("event_no"), F.abs(F.col("mvt_us") - F.col("r_block_us")).alias("distance"), F.lit(0).alias("priority"))
        taken, free, free_events = None, left, right.select("event_no")
    else:  # callsign pairs come before all others, and so can be taken by themselves
        taken = matching.greedy_band(left, right, ["airport", "callsign"], "mvt_us", "block_us", "mvt_id", "event_no", 7200 * SECOND, materialise).withColumn("priority", F.lit(0))
        free, free_events = left.join(taken.select("mvt_id"), "mvt_id", "left_anti"), right.select("event_no").join(taken.select("event_no"), "event_no", "left_anti")
    near = matching.candidates_around(free, right, ["airport"], "mvt_us", "block_us", "mvt_id", "event_no", 3600 * SECOND).withColumn("priority", F.lit(1))
    near = near.join(free_events, "event_no", "left_semi") if taken is not None else same.unionByName(near)
    pairs = near.groupBy("mvt_id", "event_no").agg(F.min("priority").alias("priority"), F.min("distance").alias("distance"))
    rest = matching.greedy_match(pairs, "mvt_id", "event_no", ["priority", "distance"], materialise, finish=1000)
    return (rest if taken is None else rest.unionByName(taken)).select("mvt_id", "event_no", "priority", "distance")


# Islands


@query(f"""WITH {MV}, l AS (SELECT mvt_id, user_id, airport, mvt_us, lag(block_us) OVER w AS before_us, lag(airport) OVER w AS before_apt
FROM mv WINDOW w AS (PARTITION BY user_id ORDER BY mvt_us, mvt_id))
SELECT mvt_id, (mvt_us - before_us) / 1e6 AS ground_time, CASE WHEN before_apt IS NOT NULL THEN (before_apt = airport)::INTEGER END AS same_airport
FROM l""")
def lag_ground_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time since the previous movement of the same aircraft ended."""
    rows, _, _ = both(spark, sf_dir)
    rows = tracks.neighbours(rows.select("user_id", "mvt_id", "mvt_us", "block_us", "airport"), "user_id", "mvt_us", "mvt_id", 86_400 * SECOND, ["block_us", "airport"])
    before: Column = F.col("__before.airport")
    return rows.select("mvt_id", ((F.col("mvt_us") - F.col("__before.block_us")) / SECOND).alias("ground_time"), F.when(before.isNotNull(), (before == F.col("airport")).cast("int")).alias("same_airport"))


def _islands_sql(gap: int, within: int) -> str:
    return f"""WITH {MV}, p AS (SELECT user_id, sec, mvt_id, event_type <> 'purchase' AS g, value, airport FROM mv),
a AS (SELECT *, lag(sec) OVER w AS ps, lag(g) OVER w AS pg, lead(sec) OVER w AS ns, lead(g) OVER w AS ng FROM p WINDOW w AS (PARTITION BY user_id
ORDER BY sec, mvt_id)),
b AS (SELECT *, sum((g AND (ps IS NULL OR NOT pg OR sec - ps >= {gap}))::INTEGER) OVER (PARTITION BY user_id ORDER BY sec, mvt_id) AS seg FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id, seg ORDER BY sec, mvt_id) AS i FROM b WHERE g)
SELECT user_id, seg::BIGINT AS segment, min(sec) AS first_ground, min(CASE WHEN mvt_id % 2 = 0 THEN sec END) AS first_moving, count(*)::BIGINT AS n,
max(CASE WHEN i > 1 THEN sec - ps END) AS widest_gap,
max(CASE WHEN NOT ng AND ns - sec < {within} THEN ns END) AS takeoff, min(CASE WHEN i = 1 THEN value END) AS first_value,
min(CASE WHEN i = 1 THEN airport END) AS first_airport, round(avg((mvt_id % 2)::DOUBLE), 9) AS mean_odd
FROM c GROUP BY user_id, seg HAVING takeoff IS NOT NULL"""


def _islands(spark: SparkSession, sf_dir: str, gap: int, within: int) -> DataFrame:
    rows, _, _ = both(spark, sf_dir)
    points = rows.select("user_id", "sec", "mvt_id", (F.col("event_type") != "purchase").alias("ground"), "value", "airport", (F.col("mvt_id") % 2).alias("odd"))
    got = islands.takeoffs(points, "user_id", "sec", "ground", gap, within, "mvt_id", "mvt_id % 2 = 0", ["value", "airport"], ["odd"])
    return got.withColumn("mean_odd", F.round("mean_odd", 9))


@query(_islands_sql(600, 120))
def ground_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a track on the ground, broken at gaps of ten minutes, and the take-offs that end them within two: with the first
    point's values and a mean."""
    return _islands(spark, sf_dir, 600, 120)


@query(_islands_sql(86_400, 43_200))
def ground_segments_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with gaps of a day and take-offs within half of one: longer segments in the test tables' sparse tracks."""
    return _islands(spark, sf_dir, 86_400, 43_200)
