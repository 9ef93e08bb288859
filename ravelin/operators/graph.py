"""Graphs of many groups at once (airports' taxiways): components, shortest paths, nearest nodes, distance look-ups.

Nodes and edges stay rows. Components and distances come in rounds of joins, of what the round before has changed, each written
to the shared folder; there are as many rounds as a path has edges, or the logarithm of it for components. Nearest nodes are
looked up in grids whose cells double. No group stands in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialise, release


def undirected(edges: DataFrame, group: str) -> DataFrame:
    """(group, a, b, w) both ways, the lightest of parallel edges."""
    there = edges.select(group, "a", "b", "w")
    return there.unionByName(edges.select(group, F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy(group, "a", "b").agg(F.min("w").alias("w"))


def components(edges: DataFrame, group: str) -> DataFrame:
    """(group, node, root): the smallest node that is reachable. A round takes the least root among neighbours, and that root's own
    root, so a path shrinks by half."""
    g = materialise(undirected(edges, group), "edges")
    now = materialise(g.groupBy(group, F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "roots")
    while True:
        near = g.join(now.select(group, F.col("node").alias("b"), "root"), [group, "b"]).groupBy(group, F.col("a").alias("node")).agg(F.min("root").alias("near"))
        best = now.join(near, [group, "node"]).select(group, "node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = now.select(group, F.col("node").alias("root"), F.col("root").alias("far"))
        after = best.join(jump, [group, "root"], "left").select(group, "node", F.least("root", "far").alias("root"), (F.least("root", "far") < F.col("old")).alias("changed"))
        after = materialise(after, "roots")
        release(now)
        now = after
        if now.filter("changed").isEmpty():
            release(g)
            return now.drop("changed")


def main_nodes(edges: DataFrame, group: str) -> DataFrame:
    """(group, node) of each group's largest component, the one with the smallest node if several are."""
    roots = components(edges, group)
    sizes = roots.groupBy(group, "root").agg(F.count("*").alias("n"))
    first = sizes.groupBy(group).agg(F.min(F.struct(-F.col("n"), "root"))["root"].alias("root"))
    return roots.join(first, [group, "root"]).select(group, "node")


def shortest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, group: str, weight_type: str = "double", only_main: bool = False) -> DataFrame:
    """(group, source, target, dist) over undirected edges (group, a, b, w), from sources (group, node) to targets (group,
    node); unreachable pairs give no row. With only_main, nodes out of the largest component are no sources or targets.

    Distances grow from the targets, which are fewer. A round goes on from the nodes that the last one made nearer."""
    g = materialise(undirected(edges, group), "edges")
    allowed = main_nodes(edges, group) if only_main else g.select(group, F.col("a").alias("node")).distinct()
    ends = targets.select(group, "node").distinct().join(allowed, [group, "node"], "left_semi")
    now = materialise(ends.select(group, F.col("node").alias("target"), "node", F.lit(0).cast(weight_type).alias("dist"), F.lit(True).alias("fresh")), "distances")
    while not now.filter("fresh").isEmpty():
        ahead = now.filter("fresh").select(group, "target", F.col("node").alias("a"), "dist").join(g, [group, "a"])
        steps = ahead.select(group, "target", F.col("b").alias("node"), (F.col("dist") + F.col("w")).cast(weight_type).alias("dist"), F.lit(True).alias("fresh"))
        both = now.withColumn("fresh", F.lit(False)).unionByName(steps)
        # The least distance, and of equal ones the one that was there before.
        best = both.groupBy(group, "target", "node").agg(F.min(F.struct("dist", "fresh")).alias("m")).select(group, "target", "node", "m.dist", "m.fresh")
        after = materialise(best, "distances")
        release(now)
        now = after
    starts = sources.select(group, "node").distinct().join(allowed, [group, "node"], "left_semi")
    found = materialise(now.join(starts, [group, "node"]).select(group, F.col("node").alias("source"), "target", "dist"), "paths")
    release(g)
    release(now)
    return found


def nearest_nodes(points: DataFrame, nodes: DataFrame, group: str, point_id: str, edges: DataFrame | None = None) -> DataFrame:
    """(point_id, node, d2): the nearest node (x, y) of the point's group, ties to the smaller node; with edges, of the group's
    largest component. Points of a group without nodes give no row.

    Cells of a grid are as wide as nodes lie apart on average. A point looks at the nine cells around it; a node that is no
    further than a cell's width is the nearest. The other points look again in cells twice as wide, until all have one."""
    if edges is not None:
        nodes = nodes.join(main_nodes(edges, group), [group, "node"], "left_semi")
    nodes = materialise(nodes.select(group, "node", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(), "nodes")
    span = nodes.groupBy(group).agg(*[f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("low", F.min), ("high", F.max))], F.count("*").alias("n"))
    wide = F.greatest(F.col("highx") - F.col("lowx"), F.col("highy") - F.col("lowy"))
    grids = materialise(span.select(group, F.when(wide > 0, wide / F.ceil(F.sqrt("n"))).otherwise(F.lit(1.0)).alias("h")), "grids")
    rest = points.select(group, point_id, F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")).dropna()
    rest, done, level = materialise(rest.join(grids, group), "points"), [], 0
    while True:
        size = F.col("h") * float(2**level)
        cell = lambda c: F.floor(F.col(c) / size)
        homes = nodes.join(grids, group).select(group, "node", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
        around = F.explode(F.array(*[F.struct((cell("px") + i).alias("cx"), (cell("py") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("c")
        dx, dy = F.col("px") - F.col("x"), F.col("py") - F.col("y")
        d2 = dx * dx + dy * dy
        met = rest.select("*", size.alias("s"), around).select("*", "c.cx", "c.cy").join(homes, [group, "cx", "cy"], "left")
        best = met.groupBy(group, point_id, "px", "py", "h", "s").agg(F.min(F.when(F.col("node").isNotNull(), F.struct(d2.alias("d2"), "node"))).alias("m"))
        best = materialise(best, "nearest")
        sure = F.coalesce(F.col("m.d2") <= F.col("s") * F.col("s"), F.lit(False))
        done.append(best.filter(sure).select(point_id, "m.node", "m.d2"))
        after = materialise(best.filter(~sure).select(group, point_id, "px", "py", "h"), "points")
        release(rest)
        rest, level = after, level + 1
        if rest.isEmpty():
            break
    for frame in (nodes, grids, rest):
        release(frame)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def stand_aliases(table: DataFrame, group: str) -> DataFrame:
    """(group, alias, source): each stand's plain name, and the numbers that names end in where no stand has that name; the first
    stand in order has it."""
    from ..functions import numeric_suffixes, plain_name

    plain = plain_name(F.col("source"))
    names = F.array(F.struct(F.lit(0).alias("rank"), plain.alias("alias")), *[F.struct(F.lit(1).alias("rank"), s.alias("alias")) for s in numeric_suffixes(plain)])
    each = table.select(group, "source").distinct().select(group, "source", F.explode(names).alias("n")).filter("n.alias IS NOT NULL")
    best = each.groupBy(group, F.col("n.alias").alias("alias")).agg(F.min(F.struct("n.rank", "source")).alias("b"))
    return best.select(group, "alias", "b.source")


def distance_columns(df: DataFrame, table: DataFrame, group: str, stand: str, runway: str, prefix: str = "map_") -> DataFrame:
    """df with the distance of its (group, stand, runway), the stand's least distance to any runway, and the difference. Stands are
    looked up by stand_aliases(), runways by their plain names."""
    from ..functions import plain_name

    alias = stand_aliases(table, group).select(F.col(group).alias("__g"), F.col("alias").alias("__a"), F.col("source").alias("__s"))
    least = table.groupBy(F.col(group).alias("__g2"), F.col("source").alias("__s2")).agg(F.min("dist").alias("__least"))
    exact = table.select(F.col(group).alias("__g3"), F.col("source").alias("__s3"), plain_name(F.col("target")).alias("__t3"), F.col("dist").alias("__dist")).groupBy("__g3", "__s3", "__t3").agg(F.min("__dist").alias("__dist"))
    got = df.join(alias, (F.col(group) == F.col("__g")) & (plain_name(F.col(stand)) == F.col("__a")), "left")
    got = got.join(least, (F.col("__g") == F.col("__g2")) & (F.col("__s") == F.col("__s2")), "left")
    got = got.join(exact, (F.col("__g") == F.col("__g3")) & (F.col("__s") == F.col("__s3")) & (plain_name(F.col(runway)) == F.col("__t3")), "left")
    return got.select(*df.columns, F.col("__dist").alias(f"{prefix}dist"), F.col("__least").alias(f"{prefix}dmin"), (F.col("__dist") - F.col("__least")).alias(f"{prefix}extra"))
