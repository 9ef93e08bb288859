"""The corrector's whole frame, of the blocks that other queries make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frame import corrector_frame
from ..sources.storage import settled
from . import feature_queries, join_queries, model_queries, record_queries, stat_queries, window_queries  # noqa: F401
from .catalogue import QUERIES, SQL, query

#: Blocks of queries' columns: traffic around, the matched event, copy rates, weather and rotation, distances to plans, the surface,
#: the map, cells, the runway, what is held back, one airport's line, and automatic features.
BLOCKS = {
    "ctx": [("congestion_counts", ["dep_prev60", "dep_next60", "arr_prev60", "rwy_prev60"]), ("arrival_taxi_in_ctx", ["apt_mean60", "rwy_n60"]), ("neighbour_proxy_ctx", ["own_less_past", "own_less_future"])],
    "trace": [("greedy_one_to_one", ["event_no", "distance"])],
    "ext": [("airline_copy_rate_lomo", ["rate"])],
    "met": [("weather_asof", ["obs_age", "obs"])],
    "rot": [("rotation_asof", ["age", "same_type"]), ("lag_ground_time", ["ground_time", "same_airport"]), ("stand_last_arrival_asof", ["last_taxi_in"])],
    "dist": [("plan_distances", ["dist_min", "dist_n", "dist_over_hour"])],
    "sup": [("surface_counts", ["dep_taxiing", "off_rwy", "landings"])],
    "map": [("map_distance_columns", ["map_dist", "map_extra"])],
    "cel": [("cell_stats_fallback", ["cel_median", "cel_p90", "cel_sd", "cel_n"])],
    "rwy": [("runway_config", ["config"]), ("runway_config_change", ["changed"]), ("queue_weighted", ["queue", "heavies"]), ("span20", ["span20"])],
    "ret": [("overdue_gate", ["overdue_rwy", "overdue_apt"]), ("recent_delay", ["recent_delay"]), ("active_runway", ["active"]), ("ewma_rate", ["ewma"])],
    "line": [("ols_lines", ["line"])],
    "fe": [("auto_features", ["fe_diff__ms__plan_s", "fe_z__ms__airport"])],
}
AGAINST = ["cel_cel_median", "line_line"]


def _sql() -> str:
    parts = [(name, q, columns) for name, own in BLOCKS.items() for q, columns in own]
    picked = ", ".join(f"x{i}.{c} AS {name}_{c}" for i, (name, _, columns) in enumerate(parts) for c in columns)
    joined = " ".join(f"LEFT JOIN ({SQL[q]}) x{i} ON x{i}.mvt_id = b.mvt_id" for i, (_, q, _) in enumerate(parts))
    less = ", ".join(f"round({c} - pred, 4) AS {c}_less_pred" for c in AGAINST)
    return f"SELECT *, {less} FROM (SELECT b.*, {picked} FROM ({SQL['corrector_frame']}) b {joined})"


@query(_sql())
def corrector_frame_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corrector's input with all its blocks."""
    blocks = {}
    for name, own in BLOCKS.items():
        # Each query's columns are written before the next query begins, so that disk holds one query's shuffles at a time.
        parts = [settled(spark, lambda q=q, columns=columns: QUERIES[q](spark, sf_dir).select("mvt_id", *columns), "block") for q, columns in own]
        for p in parts[1:]:
            parts[0] = parts[0].join(p, "mvt_id", "left")
        blocks[name] = parts[0]
    base = settled(spark, lambda: QUERIES["corrector_frame"](spark, sf_dir), "base")
    got = corrector_frame(base, blocks, "mvt_id", "pred", AGAINST, require=["sup_off_rwy", "map_map_dist"])
    return got.withColumns({f"{c}_less_pred": F.round(f"{c}_less_pred", 4) for c in AGAINST})
