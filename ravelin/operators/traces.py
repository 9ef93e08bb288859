"""Position traces: points near airports, with the last callsign carried forward."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tracks


def explode_points(traces: DataFrame) -> DataFrame:
    """One row for each point: icao, t, ground, gs, lat, lon, alt, source, callsign (the last one known in the trace)."""
    p = traces.select("icao", "reg", "type", "start", F.posexplode("points").alias("i", "p"))
    known = F.last("p.callsign", ignorenulls=True).over(W.partitionBy("icao", "start").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    return p.select("icao", "reg", "type", (F.col("start") + F.col("p.dt")).alias("t"), F.col("p.ground").alias("ground"), F.col("p.gs").alias("gs"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"), F.col("p.alt").alias("alt"), F.col("p.source").alias("source"), known.alias("callsign"))


def with_callsigns(points: DataFrame, track: str, at: str, tie: str, width: int, out: str = "callsign") -> DataFrame:
    """Points that are rows already, with the last callsign that was heard on their track."""
    return tracks.last_known(points, track, at, tie, width, "callsign", out)


def near_airports(points: DataFrame, airports: dict[str, tuple[float, float]], km: float = 10.0, most_alt: float = 3000.0) -> DataFrame:
    """Points in an airport's square, on the ground or not above `most_alt` feet; `apt` is the first airport, by name, whose square holds the point."""
    half = km / 111.32
    apt = F.lit(None).cast("string")
    for name, (lat, lon) in sorted(airports.items(), reverse=True):
        inside = (F.abs(F.col("lat") - lat) <= half) & (F.abs(F.col("lon") - lon) <= half / math.cos(math.radians(lat)))
        apt = F.when(inside, F.lit(name)).otherwise(apt)
    low = F.coalesce(F.col("ground"), F.lit(False)) | F.coalesce(F.col("alt") <= most_alt, F.lit(False))
    return points.withColumn("apt", apt).filter(F.col("apt").isNotNull() & low)
