"""What the text operators share: Arrow maps, texts as bytes, held-out rows, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.movements import table
from ..sources.storage import materialise, release

__all__ = ["arrow_map", "aside", "components", "free", "give_back", "held_out", "input_bytes", "materialise", "partitions", "pieces", "release", "table", "texts"]


#: Rows that a worker turns into Python objects at a time.
SLICE = 1000


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """What Spark's statistics say that a frame's sources hold; 0 where they don't know."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 50)


def pieces(df: DataFrame, each: int = 512 << 20) -> int:
    """How many parts a hash space is cut into: the shuffle partitions, or more where a frame is that large."""
    return max(partitions(df.sparkSession), input_bytes(df) // each)


def free(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes to be no column's."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def aside(docs: DataFrame, *used: str, drop: tuple[str, ...] = ()) -> tuple[DataFrame, list[str], list[Column]]:
    """docs with its columns under names of their own, so that no name of an operator's can clash; the new names of those used;
    and the columns, less those in drop, under their old names."""
    new = {c: f"u{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in new.items()])
    return named, [new[c] for c in used], [F.col(n).alias(c) for c, n in new.items() if c not in drop]


def arrow_map(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict[str, list | pa.Array]] | dict[str, list | pa.Array]], schema: T.StructType, keep: list[str] | None = None
) -> DataFrame:
    """mapInArrow where fn gives new columns for a batch; the columns in keep pass through unchanged."""
    keep = list(keep or [])
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([df.schema[c] for c in keep] + list(schema.fields))
    kinds, names = to_arrow_schema(schema), df.columns

    def run(batches):
        for batch in batches:
            batch = batch.rename_columns(names)
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                new = fn(part)
                columns = [part.column(c) for c in keep]
                for field in kinds:
                    got = new[field.name]
                    columns.append(got if isinstance(got, (pa.Array, pa.ChunkedArray)) else pa.array(got, type=field.type))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(f.name for f in kinds)])
        give_back()

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, out)  # which takes no dots in names


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: workers stay alive between tasks, and an executor's
    memory is that of its JVM and of all its workers."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A text column as UTF-8 bytes, null as empty."""
    column = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def held_out(column: str, modulus: int, remainder: int):
    """crc32(id as text) mod modulus = remainder; a null id is held out, so nothing is learned from it."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus == remainder, F.lit(True))


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges of longs, by alternating large and small stars.

    Every node of an edge gets a row. Each round is written to the shared folder, the one before deleted. It ends when every
    node hangs on one smaller node that itself hangs on none; rounds grow with the logarithm of the nodes. A hub with many
    neighbours is aggregated by min before the shuffle; its rows in a round's joins are pairs of numbers, which stream through.
    """
    now = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).distinct()
    now = materialise(now, "edges")
    nodes = materialise(now.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    settled = False
    while not settled:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        after = materialise(small, "edges")
        release(now)
        now = after
        up = now.groupBy("a").agg(F.count("*").alias("n"))
        settled = up.filter("n > 1").isEmpty() and now.select(F.col("b").alias("a")).distinct().join(up, "a", "left_semi").isEmpty()
    root = now.select("a", F.col("b").alias("m"))
    out = materialise(nodes.join(root, nodes["node"] == root["a"], "left").select("node", F.coalesce("m", "node").alias("component")), "components")
    release(now)
    release(nodes)
    return out
