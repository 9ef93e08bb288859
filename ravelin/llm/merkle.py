"""A Merkle manifest of a dataset: leaves by row, a tree for each source, and a tree over the sources' roots.

A leaf is the SHA-256 of a row's fields. In each source leaves stand in order of their id; every `fanout` consecutive nodes
become one, until one is left. Sources' roots, in order of the source, become the root in the same way.

Ranks come from histograms of the id's digits (`radix.running_sums`), without a global sort. A rank's digits to the base
`fanout` are a leaf's path in a trie: nodes that agree in all but the last digits are a block, which is reduced from its longest
prefixes up to the one that its nodes share, `span` digits at a time. A block is one row, whose nodes a task holds, so a tree
of n leaves takes log(n) / (span * log(fanout)) rounds, each a shuffle of what is left. Proofs come down the same rounds: a
block adds what stands beside its nodes to the proof that it got from the block above.

Defined cases: a null field counts as `-`; null ids come first in their source; a null source is a source, before all others; rows
of one id in a source are ordered by their leaves, and equal rows are leaves of their own, each with its own place; a very
long text is hashed whole, by one task; an empty table gives an empty result; a source's only leaf is the source's root, and
an only source's root is the root; columns that are not fields are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .radix import long_bytes, running_sums, value_ranks
from .shared import give_back, materialise, release

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
#: Digits of a rank that a block spans: 729 nodes of three each.
LEVELS = 6
#: Blocks that a worker turns into Python objects at a time.
BLOCKS = 8


def leaf(fields: list[Column]) -> Column:
    """The digest of fields, each with its length in bytes before it, `-` where it is null; numbers as decimals."""
    said = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in said]).cast("binary"), 256)


def node(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def grow(digests: list[str], fanout: int, levels: int | None) -> list[list[str]]:
    """The levels of a block, its nodes first: so many further ones, or as many as it takes to have one node."""
    out = [digests]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        now = out[-1]
        out.append([node(now[i : i + fanout]) for i in range(0, len(now), fanout)])
    return out


def _blocks(nodes: DataFrame, payload: list[str], fanout: int, span: int) -> DataFrame:
    """One row a block, with its nodes in order and the digest that they become; from (g, n, rank, digest, payload)."""
    width = fanout**span
    items = F.sort_array(F.collect_list(F.struct("rank", "digest", *payload))).alias("items")
    blocks = nodes.groupBy("g", "n", F.expr(f"rank div {width}").alias("block")).agg(items)
    kept = blocks.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCKS):
                part = batch.slice(at, BLOCKS)
                heads = []
                for n, items in zip(part.column("n").to_pylist(), part.column("items"), strict=True):
                    digests = items.values.field("digest").to_pylist()
                    heads.append(grow(digests, fanout, None if n <= width else span)[-1][0])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(heads, pa.string())], names=[*part.schema.names, "head"])
        give_back()

    return blocks.mapInArrow(run, T.StructType([*kept.fields, T.StructField("head", T.StringType())]))


def _rounds(nodes: DataFrame, payload: list[str], fanout: int, span: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, and (g, head): what each group's nodes become in the end."""
    width, rounds, tops = fanout**span, [], None
    while True:
        blocks = materialise(_blocks(nodes, payload if not rounds else [], fanout, span), "blocks")
        rounds.append(blocks)
        top = blocks.filter(F.col("n") <= width).select("g", "head")
        tops = top if tops is None else tops.unionByName(top)
        rest = blocks.filter(F.col("n") > width)
        if rest.isEmpty():
            return rounds, tops
        nodes = rest.select("g", F.ceil(F.col("n") / width).cast("long").alias("n"), F.col("block").alias("rank"), F.col("head").alias("digest"))


_PATH = T.StructType([T.StructField("siblings", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("places", T.ArrayType(T.IntegerType()))])


def _descend(rounds: list[DataFrame], tops: DataFrame, carried: list[str], payload: list[str], fanout: int, span: int) -> DataFrame:
    """(g, rank, digest, payload, siblings, places, carried) for the nodes of the first round. tops has (g, siblings, places,
    carried): the path above each group's last node. Paths run from below to above."""
    width, paths = fanout**span, None
    for k in range(len(rounds) - 1, -1, -1):
        blocks, own = rounds[k], payload if k == 0 else []
        ended = blocks.filter(F.col("n") <= width).select("g", "block").join(tops, "g")
        above = ended if paths is None else ended.unionByName(paths.select("g", F.col("rank").alias("block"), "siblings", "places", *carried))
        joined = blocks.select("g", "block", "n", "items").join(above, ["g", "block"])
        fields = {f.name: f.dataType for f in blocks.schema["items"].dataType.elementType.fields}
        kinds = {f.name: f.dataType for f in tops.schema.fields}
        schema = T.StructType([T.StructField("g", T.LongType()), *[T.StructField(c, fields[c]) for c in ("rank", "digest", *own)], *_PATH.fields, *[T.StructField(c, kinds[c]) for c in carried]])

        def run(batches, own=tuple(own), schema=schema):
            from pyspark.sql.pandas.types import to_arrow_schema

            kinds = to_arrow_schema(schema)
            for batch in batches:
                for at in range(batch.num_rows):
                    row = batch.slice(at, 1)
                    items = row.column("items")[0].values
                    digests, n = items.field("digest").to_pylist(), row.column("n")[0].as_py()
                    levels = grow(digests, fanout, None if n <= width else span)
                    above, places = row.column("siblings")[0].as_py(), row.column("places")[0].as_py()
                    siblings, where = [], []
                    for i in range(len(digests)):
                        beside, mine = [], []
                        for level in levels[:-1]:
                            start = i - i % fanout
                            beside.append(level[start:i] + level[i + 1 : start + fanout])
                            mine.append(i - start)
                            i //= fanout
                        siblings.append(beside + above)
                        where.append(mine + places)
                    columns = {"g": [row.column("g")[0].as_py()] * len(digests), "siblings": siblings, "places": where}
                    columns |= {c: items.field(c) for c in ("rank", "digest", *own)}
                    columns |= {c: [row.column(c)[0].as_py()] * len(digests) for c in carried}
                    yield pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, type=f.type) for f in kinds], names=kinds.names)
            give_back()

        paths = joined.mapInArrow(run, schema)
        if k:
            paths = materialise(paths, "paths")
    return paths


def fold(digest: Column, siblings: Column, places: Column) -> Column:
    """What a leaf becomes with the siblings that a proof gives it."""
    steps = F.transform(siblings, lambda s, i: F.struct(s.alias("s"), F.get(places, i).alias("p")))
    put = lambda h, x: F.concat(F.slice(x["s"], F.lit(1), x["p"]), F.array(h), F.slice(x["s"], x["p"] + 1, F.lit(1 << 20)))
    return F.aggregate(steps, digest, lambda h, x: F.sha2(F.array_join(put(h, x), "").cast("binary"), 256))


def proof_digest(siblings: Column) -> Column:
    return F.sha2(F.array_join(F.flatten(siblings), "").cast("binary"), 256)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", fanout: int = FANOUT, span: int = LEVELS, claim: Column | None = None) -> DataFrame:
    """(id, leaf, subroot, root, siblings, places, claim) for each row. siblings holds, level by level, the digests beside the row's
    node, places where among them the node stands. `claim` is a digest by row that goes along, such as a copy's leaf; where it
    is null it is the leaf."""
    own = leaf([F.col(f"`{c}`") for c in fields])
    claim = F.lit(None).cast("string") if claim is None else claim
    hashed = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), own.alias("digest"), claim.alias("claim"))
    hashed = materialise(hashed, "leaves")
    sources = value_ranks(hashed, "source", "g", nulls_first=True)
    sizes = materialise(sources.join(hashed.groupBy("source").agg(F.count("*").alias("n")).withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).select("source", "g", "n"), "sources")
    keyed = hashed.withColumnRenamed("source", "__s").join(sizes, F.col("source").eqNullSafe(F.col("__s")))
    order = F.concat(long_bytes("id"), F.unhex("digest"), F.unhex(F.coalesce("claim", "digest")))
    keyed = keyed.select("g", "n", "id", "digest", "claim", order.alias("key"), F.lit(1).cast("long").alias("one"))
    ranked = running_sums(keyed, "g", "key", "one", "rank", depth=8)
    rounds, subroots = _rounds(ranked.select("g", "n", "rank", "digest", "id", "claim"), ["id", "claim"], fanout, span)
    # The sources' roots are the leaves of one more tree.
    top = subroots.select(F.lit(0).cast("long").alias("g"), F.lit(sizes.count()).cast("long").alias("n"), F.col("g").alias("rank"), F.col("head").alias("digest"))
    top = materialise(top, "subroots")
    upper, heads = _rounds(top, [], fanout, span)
    heads = heads.select("g", *[F.array().cast(f.dataType).alias(f.name) for f in _PATH], F.col("head").alias("root"))
    tops = _descend(upper, heads, ["root"], [], fanout, span).select(F.col("rank").alias("g"), "siblings", "places", F.col("digest").alias("subroot"), "root")
    tops = materialise(tops, "tops")
    for frame in (hashed, sources, sizes, ranked, top, *upper):
        release(frame)
    out = _descend(rounds, tops, ["subroot", "root"], ["id", "claim"], fanout, span)
    return out.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", "siblings", "places", F.coalesce("claim", "digest").alias("claim"))
