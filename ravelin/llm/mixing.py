"""Mixing sources to target weights, by a splitting tree with multivariate hypergeometric draws.

Sources have weights; each gets its share of all words, but no more than `most` times what it has, and what it can't take goes to
the others by their weights (`targets`).

A source's documents, in an order drawn from a hash, are a line of words that is cut into blocks of equal length. A source's quota is
the number of blocks nearest to its target. All quotas together are dealt out to output shards of equal capacity as if all
drawn blocks were shuffled: a node of the tree holds quotas and a range of shards, and the left half of the shards gets a
multivariate hypergeometric draw of them, down to single shards; with it travels which of a source's draws a shard has, so
shards' draws are disjoint. The n-th draw of a source is the n-th block of a permutation of its blocks; once all were drawn, another
permutation follows. No block is drawn more than `most` times. Shards then shuffle their own blocks.

Nothing but numbers by source passes through a task whole: quotas are split in families of `FAMILY` sources, first between families
and then inside each. Everything is drawn from `seed` and from ids, so runs agree, however rows are dealt out, and a task that
runs again draws the same.

Defined cases: a null text has no words and is never taken; a null source is one, after all others; a null id is one more id; rows
with the same id are documents of their own, and equal rows have equal places up to their order; a very long text is counted by
one task and spread over its blocks; an empty table gives an empty mix, and so do texts without words; other columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .radix import long_bytes, running_sums, value_ranks
from .shared import arrow_map, give_back, materialise, partitions, release, texts
from .words import _A, _SPACE, mix

WEIGHTS = (5, 2, 1)
#: Sources whose quotas are split together.
FAMILY = 4096
#: Shards that a task's node is split into.
FAN = 64
#: numpy's draws take fewer balls than this.
BALLS = 10**9


def word_count(text: bytes) -> int:
    space = _SPACE[np.frombuffer(text, dtype=np.uint8)]
    return int(np.count_nonzero(space[:-1] & ~space[1:])) + int(len(space) > 0 and not space[0])


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """sources (g, the source's place in order, and source_size) with weight and target. The level up to which sources are
    filled rises until the ones above `most` times their size are the ones that it was computed without."""
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("g") % len(weights)).cast("int"))
    weighed = sources.withColumn("weight", weight.cast("long"))
    full, level, capped = F.lit(False), 0.0, -1
    while True:
        free = F.when(full, 0).otherwise(1)
        words, held, left, n = weighed.agg(F.sum("source_size"), F.sum((1 - free) * most * F.col("source_size")), F.sum(free * F.col("weight")), F.sum(1 - free)).first()
        if not left or n == capped:
            break
        level, capped = (words - held) / left, n
        full = F.col("weight") * F.lit(level) > most * F.col("source_size")
    return weighed.withColumn("target", F.least(F.col("weight") * F.lit(level), (most * F.col("source_size")).cast("double")))


def permuted(at: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place `at` of a permutation of 0 .. size - 1 that the key names: Feistel rounds over the least even number of bits, walked on
    while outside."""
    half = np.maximum((np.ceil(np.log2(np.maximum(size, 2).astype(np.float64) + 1)).astype(np.int64) + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = at.astype(np.uint64), np.arange(len(at))
    bound = size.astype(np.uint64)
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for turn in range(1, 5):
            left, right = right, left ^ (mix(right * _A + k + np.uint64(turn)) & m)
        x = left << h | right
        out[todo] = x
        todo = todo[x >= bound[todo]]
    return out.astype(np.int64)


def split(counts: np.ndarray, starts: np.ndarray, caps: np.ndarray, lo: int, width: int, seeds: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first shard, shards, counts, starts) of the parts of at most `width` shards of a node: quotas `counts` whose draws begin at
    `starts`, for shards from lo on that take caps."""
    n = len(caps)
    if n <= width:
        yield lo, n, counts, starts
        return
    half = width * (-(-n // width) // 2)
    left = np.random.default_rng([*seeds, lo, n]).multivariate_hypergeometric(counts, int(caps[:half].sum()), method="marginals")
    yield from split(left, starts, caps[:half], lo, width, seeds)
    yield from split(counts - left, starts + left, caps[half:], lo + half, width, seeds)


_NODE = "family long, lo long, caps array<long>, ids array<long>, counts array<long>, starts array<long>"


def deal(nodes: DataFrame, shards: int, seed: int) -> DataFrame:
    """(family, shard, id, n, start): what each shard gets of each id's quota, from nodes of all shards (`_NODE`); only where it is
    more than nothing. A stage splits each node into `FAN` parts at most."""
    width = shards
    while width > 1:
        width = -(-width // FAN)

        def run(batches, width=width):
            for batch in batches:
                for row in batch.to_pylist():
                    out = []
                    counts, starts, caps = (np.array(row[c], dtype=np.int64) for c in ("counts", "starts", "caps"))
                    ids = np.array(row["ids"], dtype=np.int64)
                    for lo, n, got, since in split(counts, starts, caps, row["lo"], width, [seed, row["family"] + 1]):
                        some = np.flatnonzero(got)
                        at = lo - row["lo"]
                        out.append((row["family"], lo, caps[at : at + n], ids[some], got[some], since[some]))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=batch.schema.names)
            give_back()

        nodes = materialise(nodes.repartition(partitions(nodes.sparkSession), "family", "lo").mapInArrow(run, _NODE), "nodes")
    each = nodes.select("family", F.col("lo").alias("shard"), F.explode(F.arrays_zip("ids", "counts", "starts")).alias("x"))
    return each.select("family", "shard", F.col("x.ids").alias("id"), F.col("x.counts").alias("n"), F.col("x.starts").alias("start")).filter("n > 0")


def quotas(sources: DataFrame, most: int = 3, block: int = 1024, least: int = 1024) -> DataFrame:
    """targets' sources with block_words, blocks and quota. Blocks have `block` words, or more where there would be too many to draw
    from, or fewer, so that a source's target is `least` blocks."""
    n, words = sources.agg(F.count("*"), F.sum("source_size")).first()
    block, least = max(block, ceil(4 * (words or 0) / BALLS)), max(1, min(least, BALLS // 8 // max(n, 1)))
    own = F.least(F.col("source_size").cast("double"), F.col("target")) / least
    cut = sources.withColumn("block_words", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(own))).cast("long"))
    cut = cut.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))
    return cut.withColumn("quota", F.least(F.round(F.col("target") / F.col("block_words")).cast("long"), most * F.col("blocks")))


def plan(cut: DataFrame, shard_blocks: int = 4096, seed: int = 13) -> DataFrame:
    """(shard, place, g, block, draw): which block stands where in which shard, for quotas' sources, of which `cut` is written."""
    total = cut.agg(F.sum("quota")).first()[0] or 0
    shards = max(1, ceil(total / shard_blocks))
    caps = F.expr(f"transform(sequence(0L, {shards - 1}L), i -> (i + 1) * {total}L div {shards}L - i * {total}L div {shards}L)").alias("caps")
    some = cut.filter("quota > 0").withColumn("family", F.expr(f"g div {FAMILY}"))
    zero = F.lit(0).cast("long")
    lists = [F.col("x.id").alias("ids"), F.col("x.n").alias("counts"), F.transform("x", lambda _: zero).alias("starts")]
    sums = some.groupBy("family").agg(F.sum("quota").alias("n"))
    root = sums.groupBy(F.lit(-1).cast("long").alias("family")).agg(F.sort_array(F.collect_list(F.struct(F.col("family").alias("id"), "n"))).alias("x"))
    given = deal(root.select("family", zero.alias("lo"), caps, *lists), shards, seed)
    # What each family's shards take: a list by shard, with none where it has nothing.
    held = given.groupBy(F.col("id").alias("family")).agg(F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("m"))
    held = held.select("family", F.transform(F.sequence(zero, F.lit(shards - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("caps"))
    inside = some.groupBy("family").agg(F.sort_array(F.collect_list(F.struct(F.col("g").alias("id"), F.col("quota").alias("n")))).alias("x"))
    dealt = deal(inside.join(held, "family").select("family", zero.alias("lo"), "caps", *lists), shards, seed)
    rows = dealt.select("shard", F.col("id").alias("g"), "n", "start").join(cut.select("g", "blocks"), "g")

    def draw(batches):
        for batch in batches:
            shard, g, n, start, blocks = (batch.column(c).to_numpy() for c in ("shard", "g", "n", "start", "blocks"))
            for part in np.array_split(np.arange(len(n)), max(1, int(n.sum()) >> 17)):
                times = n[part]
                row = np.repeat(part, times)
                at = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                epoch = at // blocks[row]
                key = mix(mix(g[row].astype(np.uint64) * _A + np.uint64(seed)) + epoch.astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard[row], g[row], permuted(at % blocks[row], blocks[row], key), at)], names=["shard", "g", "block", "draw"])
        give_back()

    drawn = rows.mapInArrow(draw, "shard long, g long, block long, draw long")
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "g", "draw"), "g", "draw")
    return drawn.withColumn("place", F.row_number().over(order))


@dataclass
class Mix:
    """What `mix` has written: documents (id, g, size, start and the columns of sources), sources (source, g, source_size, weight,
    target, block_words, blocks, quota) and the plan."""

    documents: DataFrame
    sources: DataFrame
    plan: DataFrame

    def pieces(self) -> DataFrame:
        """(shard, place, id, g, start, begin, end): which words of which document stand where, from begin to before end. A block's
        pieces follow each other by start."""
        docs = self.documents.filter("size > 0")
        first, last = F.expr("start div block_words"), F.expr("(start + size - 1) div block_words")
        each = docs.select("id", "g", "start", "size", "block_words", F.explode(F.sequence(first, last)).alias("block"))
        begin, end = F.greatest(F.lit(0), F.col("block") * F.col("block_words") - F.col("start")), F.least("size", (F.col("block") + 1) * F.col("block_words") - F.col("start"))
        each = each.select("id", "g", "start", "block", begin.cast("long").alias("begin"), end.cast("long").alias("end"))
        return self.plan.select("shard", "place", "g", "block").join(each, ["g", "block"]).select("shard", "place", "id", "g", "start", "begin", "end")

    def taken(self) -> DataFrame:
        """documents with `taken`, the words that the mix has of each, repeats counted."""
        words = self.pieces().groupBy(F.col("g").alias("__g"), F.col("start").alias("__start")).agg(F.sum(F.col("end") - F.col("begin")).alias("taken"))
        # Documents without words share the place of the next one, and have none.
        at = (F.col("g") == F.col("__g")) & (F.col("start") == F.col("__start")) & (F.col("size") > 0)
        return self.documents.join(words, at, "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long"))).drop("__g", "__start")

    def release(self) -> None:
        for frame in (self.documents, self.sources, self.plan):
            release(frame)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block: int = 1024, least: int = 1024, shard_blocks: int = 4096, seed: int = 13) -> Mix:
    """The mix of all documents; weights go to the sources in order of their code points, again and again, null last."""
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").alias("text"))
    named = named.withColumn("hash", F.xxhash64(F.lit(seed), "id", "text"))
    count = lambda batch: {"size": pa.array([word_count(t) for t in texts(batch)], pa.int64())}
    sized = materialise(arrow_map(named, count, T.StructType([T.StructField("size", T.LongType())]), ["id", "source", "hash"]), "sized")
    ranks = value_ranks(sized, "source", "g", nulls_first=False)
    sums = sized.groupBy(F.col("source").alias("__s")).agg(F.sum("size").alias("source_size"))
    sources = materialise(ranks.join(sums, F.col("source").eqNullSafe(F.col("__s"))).drop("__s"), "sources")
    cut = materialise(quotas(targets(sources, weights, most), most, block, least), "quotas")
    order = F.concat(long_bytes("hash"), long_bytes("id"), long_bytes("size"))
    keyed = sized.withColumnRenamed("source", "__s").join(cut, F.col("source").eqNullSafe(F.col("__s")))
    keyed = keyed.select("id", "size", "g", "source_size", "target", "block_words", order.alias("key"))
    documents = running_sums(keyed, "g", "key", "size", "start")
    planned = materialise(plan(cut, shard_blocks, seed), "plan")
    for frame in (sized, ranks, sources):
        release(frame)
    return Mix(documents, cut, planned)
