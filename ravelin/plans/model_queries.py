"""Models, graphs and automatic features over the movements view. Trees and graph searches are not for SQL; their
queries return rows whose numbers the tests judge."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..models import base, crossfit
from ..operators import autofeatures as fe
from ..operators import graph, ordered, rules
from ..sources import movements as mv
from ..sources.movements import SECOND
from ..sources.movements import SQL as MV
from ..sources.storage import materialise
from .catalogue import query

NUMERIC = ("hour", "ms", "plan_s", "event_no")
CATEGORICAL = ("airport", "runway")
CONFIG = base.Config(numeric=NUMERIC, categorical=CATEGORICAL, target="y")


def modelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departures with features, target and flags."""
    rows = mv.load(spark, sf_dir).filter("phase = 'DEP'")
    return rows.select(
        "mvt_id", "airport", "runway", "stand", "day", "mvt_us", "lobt_us", fn.hour_of_day(F.col("mvt_us")).alias("hour"), ((F.col("mvt_us") - F.col("sched_us")) / SECOND).alias("ms"), ((F.col("mvt_us") - F.col("aobt_us")) / SECOND).alias("plan_s"),
        (F.col("event_id") % 20).cast("double").alias("event_no"), F.col("taxi_s").alias("y"), rules.copied(F.col("block_us"), F.col("sched_us")).alias("copied"), F.col("flight_id").isNull().alias("no_plan"), F.floor(F.col("day") % 30 / 10).alias("block"),
    )


def _told(df: DataFrame, *names: str) -> DataFrame:
    return df.select("mvt_id", "airport", "y", *[F.round(n, 6).alias(n) for n in names])


@query()
def model_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A single regressor's value for each departure, in sample."""
    rows = materialise(modelled(spark, sf_dir), "modelled")
    return _told(base.fit(rows, CONFIG)(rows, "pred"), "pred")


@query()
def model_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-stage mixture with lines for rows without a plan, two seeds, in its window; airports with a twentieth of the rows have
    regressors of their own."""
    rows = materialise(modelled(spark, sf_dir), "modelled")
    own = replace(CONFIG, model="two_stage_lines", seeds=(1, 2), window=True, weighting="abs", key_rows=max(1, rows.count() // 20))
    return _told(base.fit(rows, own)(rows, "pred"), "pred")


@query()
def model_crossfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold base by blocks of days, and the residual corrector on it: base and corrected value of the days held out."""
    rows = materialise(modelled(spark, sf_dir), "modelled")
    return _told(crossfit.simulate(rows.filter("day % 30 < 20"), rows.filter("day % 30 >= 20"), "block", CONFIG, CONFIG, materialise), "base", "pred")


@query()
def model_adversarial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a classifier tells the last third of the days from the rest, and each earlier departure's weight that follows."""
    rows = materialise(modelled(spark, sf_dir), "modelled")
    weights, auc = crossfit.adversarial(rows.filter("day % 30 < 20"), rows.filter("day % 30 >= 20"), "mvt_id", CONFIG, materialise)
    return weights.select("mvt_id", F.round("w", 6).alias("w"), F.round(auc.scalar(), 6).alias("auc"))


@query()
def model_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic features, screened on the residual of the mean: gain alone, drift, and what passes both gates."""
    rows = materialise(modelled(spark, sf_dir), "modelled")
    specs = [*_SPECS, *[(kind, x, by) for kind in ("mean", "dev", "z") for x in ("ms", "plan_s", "event_no") for by in (("airport", "runway"), ("stand",), ("airport", "stand")) if (kind, x, by) not in _SPECS]]
    named = fe.add_features(rows, specs).withColumn("__res", F.col("y") - rows.agg(F.avg("y")).scalar())
    names = [*NUMERIC, *[fe.name(s) for s in specs]]
    wide = materialise(named.select("mvt_id", "block", "__res", *names), "wide")
    found = crossfit.screen_with_gates(wide.filter("block < 2"), wide.filter("block >= 2"), names, CONFIG, "__res", "block", "mvt_id", materialise)
    return spark.createDataFrame([(s.feature, round(s.gain, 6), round(s.drift, 6), s.chosen) for s in found], "feature string, gain double, drift double, chosen boolean")


def _before(category: str) -> str:
    w = f"(PARTITION BY {category} ORDER BY o, mvt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"round((coalesce(sum(taxi_s) OVER {w}, 0) + 10 * (SELECT avg(taxi_s) FROM d)) / (count(taxi_s) OVER {w} + 10), 6) AS {category}_before"


@query(f"""WITH {MV}, d AS (SELECT mvt_id, airport, runway, stand, taxi_s, (mvt_id * 7919) % 1000003 AS o FROM mv WHERE phase = 'DEP')
SELECT mvt_id, {_before("airport")}, {_before("runway")}, {_before("stand")} FROM d""")
def ordered_category_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each departure's airport, runway and stand as the mean taxi time of the departures before it in a random order."""
    rows = mv.load(spark, sf_dir).filter("phase = 'DEP'").select("mvt_id", "airport", "runway", "stand", "taxi_s", (F.col("mvt_id") * 7919 % 1000003).alias("o"))
    rows = materialise(rows, "departures")
    coded = ordered.Encoder.fit(rows, ["airport", "runway", "stand"], "taxi_s").earlier(rows, "o", 1000003, ["mvt_id"])
    return coded.select("mvt_id", *[F.round(f"__o_{c}", 6).alias(f"{c}_before") for c in ("airport", "runway", "stand")])


_SPECS = [("ratio", "ms", "plan_s"), ("diff", "ms", "plan_s"), ("mean", "plan_s", ("airport", "runway")), ("dev", "plan_s", ("airport", "runway")), ("sd", "ms", ("airport",)), ("pos", "ms", ("airport",)), ("count", "plan_s", ("airport", "runway")), ("cmean", "plan_s", ("airport",)), ("rsd", "ms", ("airport",)), ("z", "ms", ("airport",))]


@query(f"""WITH {MV}, d AS (SELECT mvt_id, airport, runway, (mvt_us - sched_us) / 1e6 AS ms, (mvt_us - aobt_us) / 1e6 AS p FROM mv
WHERE phase = 'DEP')
SELECT mvt_id, round(CASE WHEN abs(p) > 1e-6 THEN ms / p END, 6) AS fe_ratio__ms__plan_s, round(ms - p, 6) AS fe_diff__ms__plan_s,
round(avg(p) OVER r, 6) AS fe_mean__plan_s__airport_runway, round(p - avg(p) OVER r, 6) AS fe_dev__plan_s__airport_runway,
round(stddev_pop(ms) OVER a, 6) AS fe_sd__ms__airport, round((rank() OVER (PARTITION BY airport
ORDER BY ms) + (count(*) OVER (PARTITION BY airport, ms) - 1) / 2.0::DOUBLE) / count(ms) OVER a, 9) AS fe_pos__ms__airport,
(count(p) OVER r)::BIGINT AS fe_count__plan_s__airport_runway,
round(avg(p) OVER a - (SELECT avg(p) FROM d), 6) AS fe_cmean__plan_s__airport, round(stddev_pop(ms) OVER a / (SELECT stddev_pop(ms)
FROM d), 6) AS fe_rsd__ms__airport, round((ms - avg(ms) OVER a) / stddev_pop(ms) OVER a, 6) AS fe_z__ms__airport
FROM d WINDOW r AS (PARTITION BY airport, runway), a AS (PARTITION BY airport)""")
def auto_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A handful of automatic features: ratios, differences and group statistics."""
    got = fe.add_features(modelled(spark, sf_dir), _SPECS)
    return got.select("mvt_id", *[F.col(n) if s[0] == "count" else F.round(n, 9 if s[0] == "pos" else 6).alias(n) for s in _SPECS for n in [fe.name(s)]])


@query(f"""WITH {MV}, d AS (SELECT airport, taxi_s AS y, (mvt_us - sched_us) / 1e6 AS ms, (mvt_us - aobt_us) / 1e6 AS p FROM mv WHERE phase = 'DEP'),
f AS (SELECT y, ms - p AS a, p - avg(p) OVER (PARTITION BY airport) AS b FROM d)
SELECT 'fe_diff__ms__plan_s' AS feature, round(corr(y, a), 6) AS r, count(a)::BIGINT AS n FROM f UNION ALL
SELECT 'fe_dev__plan_s__airport', round(corr(y, b), 6), count(b)::BIGINT FROM f""")
def auto_feature_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates' correlation with the target, in one pass."""
    specs = [("diff", "ms", "plan_s"), ("dev", "plan_s", ("airport",))]
    got = fe.correlation_screen(modelled(spark, sf_dir), specs, "y")
    return got.select("feature", F.round("r", 6).alias("r"), "n")


def taxi_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A graph for each airport: neighbouring stands, and the runway that each stand's number points to."""
    rows = mv.load(spark, sf_dir).filter("phase = 'DEP' AND stand IS NOT NULL")
    number = F.substring("stand", 2, 9).cast("long")
    used = rows.select("airport", "stand", number.alias("k")).distinct()
    along = used.select("airport", F.col("stand").alias("a"), F.concat(F.lit("S"), (F.col("k") + 1) % 23).alias("b"), (1 + F.col("k") * 7 % 5).alias("w"))
    to_runway = rows.filter(number % 4 == F.substring("runway", 2, 9).cast("long")).groupBy("airport", F.col("stand").alias("a"), F.col("runway").alias("b")).agg((1 + F.floor(F.min("taxi_s") / 60)).alias("w"))
    stands = used.select("airport", F.col("stand").alias("node"))
    runways = rows.select("airport", F.col("runway").alias("node")).distinct()
    return along.unionByName(to_runway), stands, runways


#: The walk keeps the least distance found for each (airport, target, node), and goes on from what a round made less.
_WALK = f"""WITH RECURSIVE {MV}, d AS (SELECT *, substr(stand, 2)::BIGINT AS k FROM mv WHERE phase = 'DEP' AND stand IS NOT NULL),
u AS (SELECT DISTINCT airport, stand, k FROM d),
e AS (SELECT airport, stand AS a, 'S' || ((k + 1) % 23) AS b, 1 + (k * 7) % 5 AS w FROM u UNION ALL
SELECT airport, stand, runway, 1 + floor(min(taxi_s) / 60)::BIGINT FROM d WHERE k % 4 = substr(runway, 2)::BIGINT GROUP BY 1, 2, 3),
g AS (SELECT airport, a, b, min(w) AS w FROM (SELECT * FROM e UNION ALL SELECT airport, b, a, w FROM e) GROUP BY ALL),
walk(airport, target, node, dist) USING KEY (airport, target, node) AS (
  SELECT DISTINCT airport, runway, runway, 0::BIGINT FROM d
  UNION
  SELECT n.airport, n.target, n.node, n.dist FROM (SELECT walk.airport, walk.target, g.b AS node, min(walk.dist + g.w) AS dist FROM walk
JOIN g ON g.airport = walk.airport AND g.a = walk.node GROUP BY ALL) n
  LEFT JOIN recurring.walk r ON r.airport = n.airport AND r.target = n.target AND r.node = n.node WHERE r.dist IS NULL OR n.dist < r.dist
)"""


@query(_WALK + " SELECT walk.airport, node AS source, target, dist FROM walk JOIN u ON u.airport = walk.airport AND u.stand = node JOIN (SELECT DISTINCT airport, a FROM g) h ON h.airport = walk.airport AND h.a = target")
def stand_runway_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest way from each stand to each runway."""
    edges, stands, runways = taxi_edges(spark, sf_dir)
    return graph.shortest_paths(edges, stands, runways, "airport", "bigint")


@query(_WALK + """, reach(airport, node, root) USING KEY (airport, node) AS (
  SELECT DISTINCT airport, a, a FROM g
  UNION
  SELECT n.airport, n.node, n.root FROM (SELECT reach.airport, g.b AS node, min(reach.root) AS root FROM reach
JOIN g ON g.airport = reach.airport AND g.a = reach.node GROUP BY ALL) n JOIN recurring.reach r ON r.airport = n.airport AND r.node = n.node
WHERE n.root < r.root
), sizes AS (SELECT airport, root, row_number() OVER (PARTITION BY airport ORDER BY count(*) DESC, root) AS place FROM reach GROUP BY airport, root),
main AS (SELECT reach.airport, node FROM reach JOIN sizes USING (airport, root) WHERE place = 1),
t AS (SELECT walk.airport, node AS source, target, dist FROM walk JOIN u ON u.airport = walk.airport AND u.stand = node
WHERE (walk.airport, node) IN (SELECT airport, node FROM main) AND (walk.airport, target) IN (SELECT airport, node FROM main)),
m AS (SELECT airport, source, min(dist) AS dmin FROM t GROUP BY 1, 2)
SELECT mv.mvt_id, t.dist AS map_dist, m.dmin AS map_dmin, t.dist - m.dmin AS map_extra FROM mv LEFT
JOIN m ON m.airport = mv.airport AND m.source = mv.stand LEFT JOIN t ON t.airport = mv.airport AND t.source = mv.stand AND t.target = mv.runway
WHERE mv.phase = 'DEP'""")
def map_distance_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each departure's distance on the ground, its stand's least one, and what lies between."""
    edges, stands, runways = taxi_edges(spark, sf_dir)
    table = graph.shortest_paths(edges, stands, runways, "airport", "bigint", only_main=True)
    rows = mv.load(spark, sf_dir).filter("phase = 'DEP'").select("mvt_id", "airport", "stand", "runway")
    return graph.distance_columns(rows, table, "airport", "stand", "runway").select("mvt_id", "map_dist", "map_dmin", "map_extra")


@query(f"""WITH {MV}, n AS (SELECT DISTINCT airport, stand AS node, substr(stand, 2)::BIGINT AS k FROM mv WHERE stand IS NOT NULL),
p AS (SELECT mvt_id, airport, (mvt_id * 7919 % 1009) / 8.0::DOUBLE AS x, (mvt_id * 104729 % 1013) / 8.0::DOUBLE AS y FROM mv),
d AS (SELECT mvt_id, node, (p.x - k * 37 % 101) * (p.x - k * 37 % 101) + (p.y - k * 53 % 103) * (p.y - k * 53 % 103) AS d2 FROM p JOIN n USING (airport))
SELECT mvt_id, node, d2 FROM (SELECT *, row_number() OVER (PARTITION BY mvt_id ORDER BY d2, node) AS i FROM d) WHERE i = 1""")
def nearest_stand_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand next to a point on its airport, by a grid."""
    rows = mv.load(spark, sf_dir)
    number = F.substring("stand", 2, 9).cast("long")
    nodes = rows.filter("stand IS NOT NULL").select("airport", F.col("stand").alias("node"), (number * 37 % 101).cast("double").alias("x"), (number * 53 % 103).cast("double").alias("y")).distinct()
    points = rows.select("mvt_id", "airport", (F.col("mvt_id") * 7919 % 1009 / 8.0).alias("x"), (F.col("mvt_id") * 104729 % 1013 / 8.0).alias("y"))
    return graph.nearest_nodes(points, nodes, "airport", "mvt_id")
