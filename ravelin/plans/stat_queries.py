"""Aggregates, cells, encodings, evaluation, ranking, set operations and registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import evaluation as ev
from ..operators import cells, windows
from ..sources import movements as mv
from ..sources import registry
from ..sources.movements import SECOND, table
from ..sources.movements import SQL as MV
from .catalogue import query


def departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mv.load(spark, sf_dir).filter("phase = 'DEP'")


LEVELS = (["airport", "stand", "runway"], ["airport", "runway"], ["airport"])


def _p10_sql() -> str:
    ctes, joins = [], []
    for i, keys in enumerate(LEVELS):
        k = ", ".join(keys)
        known = " AND ".join(f"{x} IS NOT NULL" for x in keys)
        on = " AND ".join(f"t.{x} = d.{x}" for x in keys)
        ctes.append(f"q{i} AS (SELECT {k}, quantile_cont(taxi_s, 0.1) AS ref FROM d WHERE {known} GROUP BY {k}), r{i} AS (SELECT t.* FROM q{i} t JOIN d ON {on} AND d.taxi_s <= t.ref GROUP BY ALL HAVING count(*) >= 10)")
        joins.append(f"LEFT JOIN r{i} ON " + " AND ".join(f"r{i}.{x} = d.{x}" for x in keys))
    return f"""WITH {MV}, d AS (SELECT * FROM mv WHERE phase = 'DEP'), {', '.join(ctes)}
SELECT d.mvt_id, round(coalesce(r0.ref, r1.ref, r2.ref), 6) AS ref FROM d {' '.join(joins)}"""


@query(_p10_sql())
def ref_p10_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tenth percentile of taxi time at the finest of three cells that is thick enough."""
    dep = departures(spark, sf_dir)
    found = cells.quantile_levels(dep, LEVELS, "taxi_s")
    got = cells.best_level(dep.select("mvt_id", "airport", "stand", "runway"), LEVELS, found, ["ref"], "")
    return got.select("mvt_id", F.round("ref", 6).alias("ref"))


CELL_LEVELS = (["airport", "stand", "runway", "wake"], ["airport", "stand", "runway"], ["airport", "runway"], ["airport"])


def _cells_sql() -> str:
    ctes, joins = [], []
    for i, keys in enumerate(CELL_LEVELS):
        k = ", ".join(keys)
        known = " AND ".join(f"{x} IS NOT NULL" for x in keys)
        ctes.append(f"c{i} AS (SELECT {k}, quantile_cont(y, 0.5) AS median, quantile_cont(y, 0.9) AS p90, stddev_samp(y) AS sd, count(*) AS n FROM d WHERE {known} GROUP BY {k} HAVING count(*) >= 10)")
        joins.append(f"LEFT JOIN c{i} ON " + " AND ".join(f"c{i}.{x} = d.{x}" for x in keys))
    pick = lambda c: "CASE " + " ".join(f"WHEN c{i}.n IS NOT NULL THEN c{i}.{c}" for i in range(4)) + " END"
    level = "CASE " + " ".join(f"WHEN c{i}.n IS NOT NULL THEN {i}" for i in range(4)) + " END"
    return f"""WITH {MV}, d AS (SELECT *, least(7200.0, greatest(0.0, taxi_s)) AS y FROM mv WHERE phase = 'DEP'), {', '.join(ctes)}
SELECT d.mvt_id, round({pick('median')}, 6) AS cel_median, round({pick('p90')}, 6) AS cel_p90, round({pick('sd')}, 6) AS cel_sd,
{pick('n')}::BIGINT AS cel_n, ({level})::INTEGER AS level FROM d {' '.join(joins)}"""


@query(_cells_sql())
def cell_stats_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, P90, deviation and count of the finest of four cells with ten rows, and which it was."""
    dep = departures(spark, sf_dir)
    found = cells.stat_levels(dep, CELL_LEVELS, "taxi_s")
    got = cells.best_level(dep.select("mvt_id", "airport", "stand", "runway", "wake"), CELL_LEVELS, found, ["median", "p90", "sd", "n"], "cel_", "level")
    return got.select("mvt_id", *[F.round(f"cel_{c}", 6).alias(f"cel_{c}") for c in ("median", "p90", "sd")], "cel_n", "level")


@query(f"""WITH {MV}, d AS (SELECT *, (day % 30) // 5 AS block, least(7200.0, greatest(0.0, taxi_s)) AS y FROM mv WHERE phase = 'DEP')
SELECT b.block::BIGINT AS block, d.airport, round(quantile_cont(d.y, 0.5), 6) AS median, count(*)::BIGINT AS n FROM (SELECT DISTINCT block FROM d) b
JOIN d ON d.block <> b.block GROUP BY 1, 2 HAVING count(*) >= 10""")
def block_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that each block of days may know: from all other blocks, in one aggregate."""
    dep = departures(spark, sf_dir).withColumn("block", F.floor(F.col("day") % 30 / 5))
    return cells.block_stat_cells(dep, "block", ["airport"], "taxi_s").select("block", "airport", F.round("median", 6).alias("median"), "n")


@query(f"""WITH {MV}, d AS (SELECT *, (day % 30) // 5 AS block, user_id % 12 AS airline, (flight_id IS NULL)::INTEGER AS no_nm FROM mv
WHERE phase = 'DEP'),
h AS (SELECT airport, airline, no_nm, block, count(*) AS n, sum((abs(block_us - sched_us) <= 60000000)::INTEGER) AS c FROM d
WHERE mvt_us - sched_us > 3600000000 GROUP BY ALL),
x AS (SELECT d.mvt_id, (SELECT coalesce(sum(n), 0) FROM h
WHERE h.airport = d.airport AND h.airline = d.airline AND h.no_nm = d.no_nm AND h.block <> d.block) AS n, (SELECT coalesce(sum(c), 0) FROM h
WHERE h.airport = d.airport AND h.airline = d.airline AND h.no_nm = d.no_nm AND h.block <> d.block) AS c,
(SELECT sum(c)::DOUBLE / sum(n) FROM h WHERE h.airport = d.airport AND h.block <> d.block) AS r FROM d)
SELECT mvt_id, round((c + 20 * r) / (n + 20), 9) AS rate FROM x""")
def airline_copy_rate_lomo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shrunk copy rate of airline and plan presence, without the row's own block of days."""
    copy = (F.abs(F.col("block_us") - F.col("sched_us")) <= 60 * SECOND).cast("int")
    dep = departures(spark, sf_dir).select("mvt_id", "airport", F.floor(F.col("day") % 30 / 5).alias("block"), (F.col("user_id") % 12).alias("airline"), F.col("flight_id").isNull().cast("int").alias("no_nm"), copy.alias("copy"), (F.col("mvt_us") - F.col("sched_us")).alias("ms"))
    history = dep.filter(F.col("ms") > 3600 * SECOND).groupBy("airport", "airline", "no_nm", "block").agg(F.count("*").alias("n"), F.sum("copy").alias("c"))
    got = cells.leave_own_block_out(history, dep, ["airport", "airline", "no_nm"], ["airport"], "block", "n", "c")
    return got.select("mvt_id", F.round("rate", 9).alias("rate"))


@query(f"""WITH {MV}, d AS (SELECT *, (mvt_us - sched_us) / 1e6 AS ms FROM mv WHERE phase = 'DEP'),
f AS (SELECT airport, regr_slope(taxi_s, ms) AS s, regr_intercept(taxi_s, ms) AS i FROM d GROUP BY airport HAVING count(*) >= 600),
g AS (SELECT regr_slope(taxi_s, ms) AS s, regr_intercept(taxi_s, ms) AS i FROM d)
SELECT d.mvt_id, round(greatest(0.0, coalesce(f.i, g.i) + coalesce(f.s, g.s) * d.ms), 4) AS line FROM d LEFT JOIN f USING (airport), g""")
def ols_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-squares lines per airport with enough rows, one line for the rest."""
    dep = departures(spark, sf_dir).withColumn("ms", (F.col("mvt_us") - F.col("sched_us")) / SECOND)
    fitted = cells.lines(dep, "airport", "ms", "taxi_s", 600)
    return cells.apply_lines(dep, fitted, "airport", "ms", "line").select("mvt_id", F.round("line", 4).alias("line"))


@query(f"""WITH {MV}, d AS (SELECT mvt_id, airport, day, stand, CASE WHEN aobt_us IS NOT NULL THEN (mvt_us - aobt_us) / 1e6 END AS x FROM mv
WHERE phase = 'DEP'),
s AS (SELECT mvt_id, x, avg(x) OVER w AS m, CASE WHEN count(x) OVER w > 1 THEN stddev_pop(x) OVER w END AS sd, count(x) OVER w AS n
FROM d WINDOW w AS (PARTITION BY airport, day))
SELECT mvt_id, round(m, 6) AS g_mean, round(sd, 6) AS g_sd, n::BIGINT AS g_n, round(x - m, 6) AS g_diff,
round(CASE WHEN sd > 1e-6 THEN (x - m) / sd END, 6) AS g_z, round(m - (SELECT avg(x) FROM d), 6) AS g_cmean, round(sd / (SELECT stddev_pop(x)
FROM d), 6) AS g_rsd FROM s""")
def group_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group mean, deviation, count, difference and z in airport and day, and mean and deviation against those of all."""
    dep = departures(spark, sf_dir).select("mvt_id", "airport", "day", ((F.col("mvt_us") - F.col("aobt_us")) / SECOND).alias("x"))
    got = cells.group_features(dep, "x", ["airport", "day"], rank=False)
    return got.select("mvt_id", "g_n", *[F.round(f"g_{c}", 6).alias(f"g_{c}") for c in ("mean", "sd", "diff", "z", "cmean", "rsd")])


@query(f"""WITH {MV}, d AS (SELECT mvt_id, stand, CASE WHEN aobt_us IS NOT NULL THEN (mvt_us - aobt_us) // 60000000 END AS x FROM mv
WHERE phase = 'DEP'),
r AS (SELECT mvt_id, x, rank() OVER (PARTITION BY stand, x IS NULL
ORDER BY x) + (count(*) OVER (PARTITION BY stand, x) - 1) / 2.0::DOUBLE AS p, count(x) OVER (PARTITION BY stand) AS n FROM d)
SELECT mvt_id, CASE WHEN x IS NOT NULL THEN round(p / n, 9) END AS pos FROM r""")
def pct_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile rank with average ties among the same stand."""
    dep = departures(spark, sf_dir).select("mvt_id", "stand", F.floor((F.col("mvt_us") - F.col("aobt_us")) / (60 * SECOND)).alias("x"))
    return cells.group_features(dep, "x", ["stand"]).select("mvt_id", F.round("g_pos", 9).alias("pos"))


# Orders and line items


@query("""WITH d AS (SELECT o_orderdate AS day, sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity END) AS returned, sum(l_quantity) AS quantity
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT day, returned, quantity, round(CASE WHEN quantity > 0 THEN returned / quantity END, 9) AS ratio FROM d""")
def orders_daily_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums, null on days without any value, and their safe ratio."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("day"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    daily = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("day").agg(F.sum(F.when(F.col("l_returnflag") != "N", F.col("l_quantity"))).alias("returned"), F.sum("l_quantity").alias("quantity"))
    from ..functions import safe_ratio

    return daily.withColumn("ratio", F.round(safe_ratio(F.col("returned"), F.col("quantity")), 9))


@query("""WITH x AS (SELECT p_brand, p_size, l_extendedprice / l_quantity AS y FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT p_brand, round(regr_slope(y, p_size), 6) AS slope, round(regr_intercept(y, p_size), 6) AS intercept FROM x GROUP BY p_brand
HAVING count(*) >= 50
UNION ALL SELECT NULL, round(regr_slope(y, p_size), 6), round(regr_intercept(y, p_size), 6) FROM x""")
def price_ols_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit price against size: a line per brand and one of all."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("x"))
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("y")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return cells.lines(rows, "p_brand", "x", "y").select("p_brand", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("""WITH x AS (SELECT l_suppkey, s_nationkey, year(l_shipdate) AS block, count(*) AS n,
sum((l_shipdate > o_orderdate + INTERVAL 60 DAY)::INTEGER) AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey
JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)
SELECT l_suppkey, block, round((k.c + 20 * p.c::DOUBLE / p.n) / (k.n + 20), 9) AS rate
FROM x AS q, LATERAL (SELECT coalesce(sum(n), 0) AS n, coalesce(sum(c), 0) AS c FROM x
WHERE x.l_suppkey = q.l_suppkey AND x.block <> q.block) k, LATERAL (SELECT sum(n) AS n, sum(c) AS c FROM x
WHERE x.s_nationkey = q.s_nationkey AND x.block <> q.block) p""")
def late_ship_rate_shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late-shipping rate of each supplier and year from all other years, shrunk towards the nation's."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    late = (F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).cast("int")
    history = items.groupBy("l_suppkey", F.year("l_shipdate").alias("block")).agg(F.count("*").alias("n"), F.sum(late).alias("c"))
    history = history.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).drop("s_suppkey")
    got = cells.leave_own_block_out(history, history.select("l_suppkey", "s_nationkey", "block"), ["s_nationkey", "l_suppkey"], ["s_nationkey"], "block", "n", "c")
    return got.select("l_suppkey", F.col("block").cast("long").alias("block"), F.round("rate", 9).alias("rate"))


@query("""WITH a AS (SELECT l_partkey AS k, l_suppkey AS s, count(*) AS n, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 3),
b AS (SELECT l_partkey AS k, count(*) AS n, avg(l_quantity) AS m FROM lineitem GROUP BY 1 HAVING count(*) >= 10)
SELECT l_orderkey, l_linenumber, round(coalesce(a.m, b.m), 6) AS mean_quantity,
CASE WHEN a.n IS NOT NULL THEN 0 WHEN b.n IS NOT NULL THEN 1 END AS level FROM lineitem LEFT JOIN a ON a.k = l_partkey AND a.s = l_suppkey LEFT
JOIN b ON b.k = l_partkey""")
def cells_part_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quantity of part and supplier, of the part where that cell is thin."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    mean = lambda keys, least: items.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("m")).filter(F.col("n") >= least)
    got = cells.fallback(items, [(["l_partkey", "l_suppkey"], mean(["l_partkey", "l_suppkey"], 3)), (["l_partkey"], mean(["l_partkey"], 10))], ["m"], "", "level")
    return got.select("l_orderkey", "l_linenumber", F.round("m", 6).alias("mean_quantity"), "level")


@query("""WITH m AS (SELECT o_orderkey, o_totalprice, o_orderpriority, ((year(o_orderdate) * 12 + month(o_orderdate) - 1) // 2) % 6 AS block
FROM orders) SELECT b.block::BIGINT AS block, m.o_orderpriority, round(avg(m.o_totalprice), 4) AS mean_price, count(*)::BIGINT AS n
FROM (SELECT DISTINCT block FROM m) b JOIN m ON m.block <> b.block GROUP BY 1, 2""")
def month_block_crossfit_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means per priority that each two-month block may know."""
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1
    rows = table(spark, sf_dir, "orders").select("o_totalprice", "o_orderpriority", (F.floor(month / 2) % 6).alias("block"))
    return cells.other_block_means(rows, "block", ["o_orderpriority"], "o_totalprice", "mean_price").withColumn("mean_price", F.round("mean_price", 4))


# Evaluation

_PAIRS = f"""WITH {MV}, p AS (SELECT mvt_id, airport, day, flight_id, (mvt_us - sched_us) / 1e6 AS ms, taxi_s AS y,
round(avg(taxi_s) OVER (PARTITION BY airport), 3) AS base, round(avg(taxi_s) OVER (PARTITION BY airport, runway), 3) AS new FROM mv
WHERE phase = 'DEP')"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes with two predictions."""
    dep = departures(spark, sf_dir)
    mean = lambda name, *k: dep.groupBy(*k).agg(F.round(F.avg("taxi_s"), 3).alias(name))
    rows = dep.select("mvt_id", "airport", "runway", "day", "flight_id", ((F.col("mvt_us") - F.col("sched_us")) / SECOND).alias("ms"), F.col("taxi_s").alias("y"))
    rows = rows.join(mean("base", "airport"), "airport").join(mean("new", "airport", "runway"), ["airport", "runway"])
    return rows.select("mvt_id", "airport", "day", "flight_id", "ms", "y", "base", "new")


SLICES: dict[str, Column | str] = {"all": "true", "with_plan": "flight_id IS NOT NULL", "no_plan": "flight_id IS NULL", "short": "y <= 3600", "long": "y > 3600", "copies": "coalesce(abs(y - ms) <= 60, false)", "normal": "flight_id IS NOT NULL AND y <= 7200", "false_alarm": "y < 1800 AND new > 1000"}


@query(_PAIRS + " " + " UNION ALL ".join(f"SELECT '{n}' AS slice, round(sqrt(avg((new - y) ** 2)), 6) AS rmse, count(*)::BIGINT AS n FROM p WHERE {m}" for n, m in SLICES.items()) + " UNION ALL SELECT 'airport=' || airport, round(sqrt(avg((new - y) ** 2)), 6), count(*)::BIGINT FROM p GROUP BY airport")
def sliced_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMSE on the whole, on slices and per airport."""
    got = ev.sliced_rmse(pairs(spark, sf_dir), "y", "new", {n: F.expr(m) for n, m in SLICES.items()}, "airport")
    return got.select("slice", F.round("rmse", 6).alias("rmse"), "n")


@query(_PAIRS + " SELECT 'airport=' || airport AS slice, round(sqrt(avg((new - y) ** 2)), 6) AS rmse, count(*)::BIGINT AS n FROM p GROUP BY airport ORDER BY 2 DESC, 1 LIMIT 3")
def worst_airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three airports with the largest error."""
    got = ev.sliced_rmse(pairs(spark, sf_dir), "y", "new", {"all": F.lit(True)}, "airport").filter("slice <> 'all'")
    return got.select("slice", F.round("rmse", 6).alias("rmse"), "n").orderBy(F.desc("rmse"), "slice").limit(3)


_PARTS = {"plan": "flight_id IS NOT NULL", "no_plan": "flight_id IS NULL"}


@query(_PAIRS + """, w AS (SELECT *, 1 + mvt_id % 3 AS w FROM p),
s AS (SELECT sum(w) AS w, sum(w * (base - y) ** 2) AS b, sum(w * (new - y) ** 2) AS n,
sum(CASE WHEN flight_id IS NOT NULL THEN w * ((base - y) ** 2 - (new - y) ** 2) ELSE 0 END) AS plan,
sum(CASE WHEN flight_id IS NULL THEN w * ((base - y) ** 2 - (new - y) ** 2) ELSE 0 END) AS no_plan FROM w)
SELECT part, round(v / (w * (sqrt(b / w) + sqrt(n / w))), 6) AS gain
FROM (SELECT unnest(['all', 'plan', 'no_plan']) AS part, unnest([b - n, plan, no_plan]) AS v, w, b, n FROM s)""")
def gain_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted gain and the parts that make it up exactly."""
    rows = pairs(spark, sf_dir).withColumn("w", 1 + F.col("mvt_id") % 3)
    return ev.gain_decomposition(rows, "y", "base", "new", {n: F.expr(m) for n, m in _PARTS.items()}, "w").select("part", F.round("gain", 6).alias("gain"))


@query(_PAIRS + ", c AS (SELECT *, row_number() OVER (ORDER BY (base - y) ** 2 - (new - y) ** 2 DESC, mvt_id) AS r FROM p) SELECT round(sqrt(avg((base - y) ** 2)) - sqrt(avg((new - y) ** 2)), 6) AS gain, count(*)::BIGINT AS n FROM c WHERE r > 10")
def gain_without_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gain without the ten rows that contribute most."""
    return ev.gain_without_top(pairs(spark, sf_dir), "y", "base", "new", 10, "mvt_id").select(F.round("gain", 6).alias("gain"), "n")


@query(_PAIRS + ", c AS (SELECT (base - y) ** 2 - (new - y) ** 2 AS g, row_number() OVER (ORDER BY (base - y) ** 2 - (new - y) ** 2 DESC, mvt_id) AS r FROM p) SELECT round(sum(g) FILTER (WHERE r <= 20) / sum(g), 6) AS share FROM c")
def share_of_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.share_of_top(pairs(spark, sf_dir), "y", "base", "new", 20, "mvt_id").select(F.round("share", 6).alias("share"))


@query(_PAIRS + " SELECT day, count(*)::BIGINT AS n, round(sum((base - y) ** 2), 0) AS sse_base, round(sum((new - y) ** 2), 0) AS sse_new FROM p GROUP BY day")
def bootstrap_day_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sums per day that the paired bootstrap draws from."""
    got = ev.day_sums(pairs(spark, sf_dir), "y", "base", "new", "day")
    return got.select("day", "n", F.round("sse_base", 0).alias("sse_base"), F.round("sse_new", 0).alias("sse_new"))


#: Which of k days is the j-th of a draw, by a rule that both engines can follow.
_DRAW = "((draw * 7919 + j * 104729 + draw * j * 15485863 + (draw * draw * 32452843) % 49979687) % 982451653) % k"


def _drawn(draw: Column, j: Column, k: Column) -> Column:
    draw = draw.cast("long")
    return (draw * 7919 + j * 104_729 + draw * j * 15_485_863 + draw * draw * 32_452_843 % 49_979_687) % 982_451_653 % k


def _bootstrap_sql(by: str, mask: str, weight: str = "1") -> str:
    """Sums by day, days drawn by _DRAW, the gain's closed form for each draw, and its quantiles."""
    closed = "sum(d) / sum(w) / (sqrt(sum(b) / sum(w)) + sqrt(sum(n) / sum(w)))"
    return _PAIRS + f""", g AS (SELECT *, {by} AS part FROM p), s AS (SELECT part, day, sum({weight}) AS w, sum({weight} * (base - y) ** 2) AS b,
sum({weight} * (new - y) ** 2) AS n, sum(CASE WHEN {mask} THEN {weight} * ((base - y) ** 2 - (new - y) ** 2) ELSE 0 END) AS d FROM g
GROUP BY part, day),
i AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY part) AS k FROM s),
draws AS (SELECT part, draw, {_DRAW} AS i FROM (SELECT part, max(k) AS k FROM i
GROUP BY part), range(200) r(draw), LATERAL (SELECT unnest(range(k)) AS j)),
x AS (SELECT part, draw, {closed} AS g FROM draws JOIN i USING (part, i) GROUP BY part, draw)
SELECT part, round({closed}, 6) AS gain, (SELECT round(quantile_cont(g, 0.025), 6) FROM x
WHERE x.part = i.part) AS low, (SELECT round(quantile_cont(g, 0.975), 6) FROM x WHERE x.part = i.part) AS high, count(*)::BIGINT AS days FROM i
GROUP BY part"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("gain", "low", "high")})


@query(_bootstrap_sql("'all'", "true"))
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gain with its interval from days drawn with replacement."""
    rows = pairs(spark, sf_dir).withColumn("part", F.lit("all"))
    return _rounded(ev.bootstrap(rows, "y", "base", "new", "day", ["part"], draws=200, pick=_drawn))


@query(_bootstrap_sql("'week ' || (day // 7)", "true"))
def bootstrap_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for each week, all in one plan."""
    rows = pairs(spark, sf_dir).withColumn("part", F.concat(F.lit("week "), F.floor(F.col("day") / 7)))
    return _rounded(ev.bootstrap(rows, "y", "base", "new", "day", ["part"], draws=200, pick=_drawn))


@query(_bootstrap_sql("'no_plan'", "flight_id IS NULL", "(1 + mvt_id % 3)"))
def gain_part_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of a weighted gain that rows without a plan make, with its interval."""
    rows = pairs(spark, sf_dir).withColumn("part", F.lit("no_plan")).withColumn("w", 1 + F.col("mvt_id") % 3)
    return _rounded(ev.bootstrap(rows, "y", "base", "new", "day", ["part"], F.col("flight_id").isNull(), "w", 200, _drawn))


@query(_PAIRS + ", s AS (SELECT (y > 1200)::INTEGER AS label, (mvt_id * 31 % 50) + CASE WHEN y > 1200 THEN 10 ELSE 0 END AS s FROM p), r AS (SELECT label, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS rk FROM s) SELECT round((sum(rk) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))::DOUBLE), 9) AS auc FROM r")
def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the curve with average ranks."""
    rows = pairs(spark, sf_dir).select((F.col("y") > 1200).cast("int").alias("label"), (F.col("mvt_id") * 31 % 50 + F.when(F.col("y") > 1200, 10).otherwise(0)).alias("s"))
    return ev.auc(rows, "label", "s").select(F.round("auc", 9).alias("auc"))


@query(f"""WITH {MV}, r AS (SELECT mvt_id, ((event_id * 17) % 97 + 1) / 100.0::DOUBLE / (1 - ((event_id * 17) % 97 + 1) / 100.0::DOUBLE) AS r
FROM mv), c AS (SELECT mvt_id, least(r, (SELECT quantile_cont(r, 0.95) FROM r)) AS r FROM r) SELECT mvt_id, round(r / (SELECT avg(r) FROM c), 6) AS w
FROM c""")
def importance_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odds, clipped at their 95th percentile, with mean 1."""
    rows = mv.load(spark, sf_dir).select("mvt_id", ((F.col("event_id") * 17 % 97 + 1) / 100).alias("p"))
    return ev.importance_weights(rows, "p").select("mvt_id", F.round("w", 6).alias("w"))


@query(_PAIRS + " SELECT round(300 - sqrt(greatest(0.0, 90000 - (sum((base - y) ** 2) - sum((new - y) ** 2)) / 1000000)), 9) AS gain FROM p")
def ceiling_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.ceiling_gain(pairs(spark, sf_dir), "y", "base", "new", 1_000_000, 300.0).select(F.round("gain", 9).alias("gain"))


# Vocabulary, leakage, folds, ranking


_LEAK = ("mvt_id", "flight_id", "stand", "aobt_us", "wake")


@query(f"WITH {MV}, r AS (" + " UNION ALL ".join(f"""SELECT '{c}' AS "column", avg(({c} IS NULL)::INTEGER) FILTER (WHERE phase = 'DEP') AS rate,
avg(({c} IS NULL)::INTEGER) FILTER (WHERE phase = 'ARR') AS other_rate FROM mv""" for c in _LEAK) + """)
SELECT "column", round(rate, 9) AS rate, round(other_rate, 9) AS other_rate FROM r WHERE rate < 0.5 AND other_rate > 0.95""")
def leaky_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns mostly present for departures and mostly null for arrivals."""
    rows = mv.load(spark, sf_dir)
    got = cells.leaky_columns(rows.filter("phase = 'DEP'"), rows.filter("phase = 'ARR'"), list(_LEAK))
    return got.select("column", F.round("rate", 9).alias("rate"), F.round("other_rate", 9).alias("other_rate"))


@query(f"""WITH {MV}, v AS (SELECT stand FROM mv WHERE stand IS NOT NULL GROUP BY stand ORDER BY count(*) DESC, stand LIMIT 8)
SELECT mvt_id, CASE WHEN stand IS NULL THEN NULL WHEN stand IN (SELECT stand FROM v) THEN stand ELSE 'other' END AS stand FROM mv""")
def vocab_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight most frequent values stay, the rest become one."""
    rows = mv.load(spark, sf_dir).select("mvt_id", "stand")
    return cells.cap_values(rows, cells.top_values(rows, "stand", 8), "stand")


@query(f"""WITH {MV}, d AS (SELECT DISTINCT day FROM mv), f AS (SELECT day, (row_number() OVER (ORDER BY day) - 1) % 5 AS fold FROM d)
SELECT mvt_id, fold::INTEGER AS fold, ((day % 30) // 5)::BIGINT AS block FROM mv JOIN f USING (day)""")
def fold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days dealt to five folds in turn, and blocks of five days."""
    rows = mv.load(spark, sf_dir).select("mvt_id", "day")
    return cells.day_folds(rows, "day", 5).select("mvt_id", F.col("fold").cast("int").alias("fold"), F.floor(F.col("day") % 30 / 5).alias("block"))


@query(f"""WITH {MV} SELECT airport, round(regr_slope(taxi_s, sec - 1704067200) * 86400, 6) AS per_day FROM mv WHERE sec >= 1706054400
GROUP BY airport""")
def velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of a score over its last seven days."""
    rows = mv.load(spark, sf_dir).filter("sec >= 1706054400").withColumn("x", F.col("sec") - 1_704_067_200)
    return rows.groupBy("airport").agg(F.round(F.regr_slope("taxi_s", "x") * 86_400, 6).alias("per_day"))


@query("""WITH b AS (SELECT user_id, max(value) AS best FROM events GROUP BY user_id),
r AS (SELECT *, row_number() OVER (ORDER BY best, user_id) AS place FROM b) SELECT (SELECT best FROM r WHERE place = 10) AS cut, (SELECT count(*) + 1
FROM r WHERE best < 90)::BIGINT AS position, count(*)::BIGINT AS teams FROM r""")
def leaderboard_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score at the tenth place, and where a score of 90 would stand (smaller is better)."""
    best = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("best"))
    tenth = best.orderBy("best", "user_id").limit(10).agg(F.when(F.count("*") == 10, F.max("best")).alias("cut"))
    return best.agg((F.count(F.when(F.col("best") < 90, 1)) + 1).alias("position"), F.count("*").alias("teams")).join(F.broadcast(tenth)).select("cut", "position", "teams")  # one row


@query("""SELECT event_type AS family, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, max(value) AS best,
sum((value > 95)::INTEGER)::BIGINT AS promoted FROM events GROUP BY 1""")
def job_family_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, mean, best and promotions of job families."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("family")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("best"), F.sum((F.col("value") > 95).cast("long")).alias("promoted"))


@query("SELECT user_id, arg_min(event_id, event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY user_id")
def registry_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last entry of each id in an append-only registry."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id")
    first, last = registry.first_entry(rows, "user_id", "event_id"), registry.last_entry(rows, "user_id", "event_id")
    return first.select("user_id", F.col("event_id").alias("first_id")).join(last.select("user_id", F.col("event_id").alias("last_id")), "user_id")


@query(f"""WITH {MV}, t AS (SELECT mvt_id FROM mv WHERE phase = 'DEP'), p AS (SELECT mvt_id, taxi_s AS pred FROM mv
WHERE phase = 'DEP' AND taxi_s > 0) SELECT t.mvt_id, coalesce(p.pred, (SELECT quantile_cont(pred, 0.5) FROM p)) AS pred FROM t LEFT
JOIN p USING (mvt_id)""")
def submission_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions on a template's rows; the few without one above 0 take the median."""
    from ..sources.sinks import on_template

    dep = departures(spark, sf_dir)
    return on_template(dep.select("mvt_id"), dep.filter("taxi_s > 0").select("mvt_id", F.col("taxi_s").alias("pred")), "mvt_id", "pred")


# Sets


@query(f"""WITH {MV}, tr AS (SELECT airport, stand, runway, 1.0::DOUBLE AS w FROM mv WHERE phase = 'DEP'),
ot AS (SELECT airport, stand, runway, 0.3::DOUBLE AS w FROM mv WHERE phase = 'ARR'), a AS (SELECT airport, stand, runway FROM tr), b AS (SELECT airport, stand, runway FROM ot)
SELECT 'union_all' AS op, (SELECT count(*) FROM (SELECT * FROM tr UNION ALL SELECT * FROM ot))::BIGINT AS n, (SELECT round(sum(w), 6) FROM (SELECT *
FROM tr UNION ALL SELECT * FROM ot)) AS weight UNION ALL
SELECT 'union', (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)), NULL UNION ALL
SELECT 'minus', (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)), NULL UNION ALL
SELECT 'intersect', (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)), NULL UNION ALL
SELECT 'distinct', (SELECT count(DISTINCT runway) FROM tr), NULL""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of departures and of arrivals: union with weights, distinct union, difference, intersection and deduplication."""
    rows = mv.load(spark, sf_dir)
    place = ["airport", "stand", "runway"]
    a = rows.filter("phase = 'DEP'").select(*place, F.lit(1.0).alias("w"))
    b = rows.filter("phase = 'ARR'").select(*place, F.lit(0.3).alias("w"))
    every, keys = a.unionByName(b), lambda d: d.select(*place)
    none = F.lit(None).cast("double").alias("weight")
    count = lambda name, d, w=none: d.agg(F.lit(name).alias("op"), F.count("*").alias("n"), w)
    out = count("union_all", every, F.round(F.sum("w"), 6).alias("weight")).unionByName(count("union", keys(a).union(keys(b)).distinct()))
    for name, d in (("minus", keys(a).subtract(keys(b))), ("intersect", keys(a).intersect(keys(b))), ("distinct", a.dropDuplicates(["runway"]))):
        out = out.unionByName(count(name, d))
    return out


@query(f"""WITH {MV}, d AS (SELECT * FROM mv WHERE phase = 'DEP'), q AS (SELECT airport, runway, quantile_cont(taxi_s, 0.1) AS ref FROM d
GROUP BY 1, 2), r AS (SELECT q.* FROM q JOIN d ON d.airport = q.airport AND d.runway = q.runway AND d.taxi_s <= q.ref GROUP BY ALL
HAVING count(*) >= 10),
q2 AS (SELECT airport, quantile_cont(taxi_s, 0.1) AS ref2 FROM d GROUP BY 1), c AS (SELECT d.mvt_id, count(e.mvt_id) AS n FROM d LEFT
JOIN d e ON e.airport = d.airport AND e.sec >= d.sec - 3600 AND e.sec < d.sec GROUP BY d.mvt_id)
SELECT d.airport, round(avg(coalesce(r.ref, q2.ref2)), 6) AS mean_ref, round(avg(c.n), 6) AS mean_before, count(*)::BIGINT AS n FROM d
JOIN c USING (mvt_id) LEFT JOIN r USING (airport, runway) LEFT JOIN q2 USING (airport) GROUP BY d.airport""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements, an hour's congestion, and the reference taxi time with fallback, per airport."""
    dep = departures(spark, sf_dir)
    before = windows.range_aggregate(dep.select("airport", "sec"), dep, ["airport"], "sec", {"before": ("count", None, -3600, -1)}, "mvt_id")
    levels = (["airport", "runway"], ["airport"])
    ref = cells.best_level(dep.select("mvt_id", "airport", "runway"), levels, cells.quantile_levels(dep, levels, "taxi_s", least=(10, 0)), ["ref"], "")
    return ref.join(before, "mvt_id").groupBy("airport").agg(F.round(F.avg("ref"), 6).alias("mean_ref"), F.round(F.avg("before"), 6).alias("mean_before"), F.count("*").alias("n"))
