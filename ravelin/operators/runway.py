"""Runway configuration: which runways are in use around an instant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def configuration(rows: DataFrame, queries: DataFrame, query_id: str, at: str = "mvt_us", bin_us: int = 600_000_000, back: int = 3, ahead: int = 2, lag: int = 6) -> DataFrame:
    """For each query: config `airport|D:a+b A:c` from the movements of bins b - back to b + ahead, whether it changed
    against `lag` bins before (null before the airport's first bin; a bin without movements is a configuration too), the
    numbers of active runways, and the own runway's share and dominance among departures.

    Counts per bin are spread over the bins that see them; movements themselves are never joined to movements."""
    b = F.floor(F.col(at) / bin_us)
    counts = rows.select("airport", "phase", "runway", b.alias("b")).groupBy("airport", "phase", "runway", "b").count()
    first = counts.groupBy("airport").agg(F.min("b").alias("__first"))
    seen = counts.withColumn("b", F.explode(F.sequence(F.col("b") - ahead, F.col("b") + back))).groupBy("airport", "phase", "runway", "b").agg(F.sum("count").alias("n"))
    dep, arr = F.col("phase") == "DEP", F.col("phase") == "ARR"
    names = lambda m: F.array_join(F.array_sort(F.collect_set(F.when(m, F.col("runway")))), "+")
    state = seen.groupBy("airport", "b").agg(names(dep).alias("d"), names(arr).alias("a"), F.count(F.when(dep, 1)).alias("n_dep_rwy"), F.count(F.when(arr, 1)).alias("n_arr_rwy"), F.sum(F.when(dep, F.col("n"))).alias("total"), F.max(F.when(dep, F.col("n"))).alias("most"))
    mark = lambda c: F.when(F.col(c) == "", "-").otherwise(F.col(c))
    state = state.withColumn("c", F.concat(F.lit("D:"), mark("d"), F.lit(" A:"), mark("a"))).drop("d", "a")
    own = seen.filter(dep).select("airport", "b", "runway", F.col("n").alias("own"))
    q = queries.select(query_id, "airport", "runway", b.alias("b"))
    before = state.select("airport", (F.col("b") + lag).alias("b"), F.col("c").alias("__before"))
    out = q.join(state, ["airport", "b"], "left").join(before, ["airport", "b"], "left").join(own, ["airport", "b", "runway"], "left").join(first, "airport", "left")
    empty = F.lit("D:- A:-")
    mine = F.coalesce("own", F.lit(0))
    return out.select(
        query_id, F.concat_ws("|", "airport", F.coalesce("c", empty)).alias("config"), F.when(F.col("b") - lag >= F.col("__first"), (F.coalesce("c", empty) != F.coalesce("__before", empty)).cast("int")).alias("changed"),
        F.coalesce("n_dep_rwy", F.lit(0)).alias("n_dep_rwy"), F.coalesce("n_arr_rwy", F.lit(0)).alias("n_arr_rwy"), F.when(F.col("total") > 0, (mine >= F.col("most")).cast("int")).alias("dominant"), F.try_divide(mine, F.col("total")).alias("share"),
    )
