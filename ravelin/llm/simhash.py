"""SimHash near-dedup with pigeonring filtering.

A fingerprint bit is 1 if it is set in over half of a text's word-shingle hashes (repeats included). The bits lie on a ring
of segments. If two fingerprints differ in `budget` bits or fewer, then from some segment on every chain of consecutive
segments stays within its proportional share of the budget. In each meeting the chain from its segment on is tested at
growing length; only survivors get the full Hamming check.

Narrow fingerprints, of 64 bits (XXH64, seed 42), link at `budget` or fewer differing bits. The ring has budget + 1 segments, so
the first segment of the good chain differs in none, and the next ones in few (with a budget of 4: two segments in one bit,
three in two). What follows the first segment is cut into pieces of which so many must be whole, and fingerprints meet under
the first segment and those pieces. Keys are the longer, and the more, the more fingerprints there are (`meeting_keys`), so
that chance meetings don't grow with their square. No link is missed.

Wide fingerprints are for similar texts, whose sets of shingles overlap in `similarity` (Jaccard) or more: at 0.8 about 15 % of bits
differ, too many for exact pieces of 64 bits. They have 576 bits or more, in segments of two bytes (three from `WIDER` on), and meet
under one whole segment. Two sets of similarity s agree in a bit with probability 1 - acos(2s / (1 + s)) / pi, so there are as many
segments as give all but a hundredth of pairs at the threshold a whole one. The budget is what 99.5 % of such pairs keep to. Wide
fingerprints only propose: each link is confirmed by the sets themselves (`_confirmed`), so nothing below the similarity links.

Work is on distinct fingerprints, each standing for the smallest id that has it. Meetings are sorted and streamed through a
task, some at a time. Meetings of over `block` fingerprints are cut into blocks, and each pair of blocks is a meeting of its own,
so no task holds an unbounded group. A task returns a spanning forest of the links that it found, never all pairs;
components come from the forests' edges by alternating stars, so no link that was found is lost.

Defined cases: null or empty text has fingerprint zero; a text of fewer words than a shingle is one shingle; a very long text is
read whole by one task; rows without an id get their fingerprint and no component (null); repeated rows are one document;
ties have the smallest id; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations
from math import acos, ceil, log, pi, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_map, components, give_back, materialise, partitions, release, texts
from .words import _A, KEY, mix, word_stream


def fingerprint(text: bytes, shingle: int = 4) -> int:
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-shingle]]).tolist()
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, out: str = "fp") -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> dict:
        return {out: pa.array(np.array([fingerprint(t, shingle) for t in texts(batch, text_col)], dtype=np.uint64).view(np.int64))}

    return arrow_map(docs.select(id_col, text_col), run, T.StructType([T.StructField(out, T.LongType())]), [id_col])


def shingle_sets(bodies: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(the different shingles' hashes, ascending, one text after another; how many each text has)."""
    (hashes,), sizes = word_stream([b.lower() for b in bodies], KEY)
    first = np.cumsum(sizes) - sizes
    grams, at = np.zeros(len(hashes), dtype=np.uint64), np.arange(len(hashes))
    text = np.repeat(np.arange(len(sizes)), sizes)
    for j in range(shingle):  # a text that ends sooner ends its shingle
        inside = at + j < (first + sizes)[text]
        grams[inside] = mix(grams[inside] * _A + hashes[at[inside] + j])
    count = np.where(sizes > 0, np.maximum(sizes - shingle + 1, 1), 0)
    whole = at - first[text] < count[text]
    grams, text = grams[whole], text[whole]
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    fresh = np.ones(len(grams), dtype=bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    return grams[fresh], np.bincount(text[fresh], minlength=len(bodies))


def wide_fingerprints(grams: np.ndarray, count: np.ndarray, words: int) -> np.ndarray:
    """A fingerprint of `words` * 64 bits for each set of shingles, for all at once."""
    out = np.zeros((len(count), words), dtype=np.uint64)
    if not len(grams):
        return out
    # Stretches of 255 shingles at most, whose bits are added up in bytes.
    cuts = -(-count // 255)
    owner = np.repeat(np.arange(len(count)), cuts)
    begin = np.repeat(np.cumsum(count) - count, cuts) + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    some = np.flatnonzero(count)
    ones = np.uint64(0x0101010101010101)
    for w in range(words):
        bits = mix(grams ^ mix(np.array([w + 1], dtype=np.uint64) * _A))
        sums = np.empty((len(begin), 8, 8), dtype=np.uint8)  # stretch, bit of a byte, byte
        for j in range(8):
            sums[:, j] = np.add.reduceat(bits >> np.uint64(j) & ones, begin).view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(sums.astype(np.int64), np.searchsorted(owner, some))
        over = (2 * total > count[some, None, None]).transpose(0, 2, 1).reshape(len(some), 64)
        out[some, w] = np.packbits(over, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def overlap(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two ascending sets have so much in common, by Jaccard; two empty ones have."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same >= similarity * (len(a) + len(b) - same)


def segments(budget: int, bits: int = 64) -> list[tuple[int, int]]:
    """(shift, width) of the ring's budget + 1 segments."""
    m = budget + 1
    cuts = [bits * i // m for i in range(m + 1)]
    return [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(m)]


def chain_masks(start: int, budget: int) -> list[tuple[np.uint64, int]]:
    """(mask, most) for chains of growing length from a segment on."""
    parts, mask, out = segments(budget), 0, []
    m = len(parts)
    for length in range(m):
        shift, width = parts[(start + length) % m]
        mask |= ((1 << width) - 1) << shift
        out.append((np.uint64(mask), (length + 1) * budget // m))
    return out


def meeting_keys(budget: int, n: int = 0, row_cost: float = 100.0) -> list[tuple[int, list[tuple[int, int]]]]:
    """(start, pieces) for each key under which fingerprints meet: pieces are (shift, width) of bits that must be equal.

    From the start on, the first segment is whole, and the chain of `more` further ones differs in `most` bits at most; of its r
    equal pieces r - most are whole. Longer chains in more pieces give longer keys, and more of them. For n fingerprints the
    way is taken that costs least: `row_cost` for each key of a fingerprint, 1 for each chance meeting of two."""
    parts = segments(budget)
    m = len(parts)
    if m == 1:
        return [(0, [parts[0]])]
    best, cost = [], float("inf")
    for more in range(1, m):
        most = (more + 1) * budget // m
        for r in range(most + 1, most + 5):
            ways = [(i, [parts[i], *whole]) for i in range(m) for whole in _pieces(parts, i, more, r, r - most)]
            bits = min(sum(w for _, w in x) for _, x in ways)
            now = len(ways) * (n * row_cost + n * n / 2.0 ** (bits + 1))
            if now < cost:
                best, cost = ways, now
    return best


def _pieces(parts: list[tuple[int, int]], start: int, more: int, r: int, whole: int) -> Iterator[list[tuple[int, int]]]:
    """Each choice of `whole` of r pieces of the `more` segments after the start, as (shift, width) of bits that adjoin."""
    bits = [b for k in range(1, more + 1) for shift, width in [parts[(start + k) % len(parts)]] for b in range(shift, shift + width)]
    for chosen in combinations(range(r), whole):
        runs: list[tuple[int, int]] = []
        for x in chosen:
            for b in bits[len(bits) * x // r : len(bits) * (x + 1) // r]:
                if runs and sum(runs[-1]) == b:
                    runs[-1] = runs[-1][0], runs[-1][1] + 1
                else:
                    runs.append((b, 1))
        yield runs


class Narrow:
    """Links of 64-bit fingerprints at `budget` or fewer bits."""

    #: Meetings of this size or less are worked off all at once, a distance of neighbours at a time.
    together = 32

    def __init__(self, budget: int) -> None:
        self.budget, self.masks = budget, [chain_masks(i, budget) for i in range(budget + 1)]

    def read(self, column: pa.ChunkedArray) -> np.ndarray:
        return column.to_numpy().view(np.uint64)

    def linked(self, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
        """For aligned fingerprints and the segments that they met under, whether they stay within every chain's share from there
        on, the last chain being the whole ring."""
        x, out = np.bitwise_xor(a, b), np.zeros(len(a), dtype=bool)
        for s in np.unique(start).tolist():
            keep = np.flatnonzero(start == s)
            for mask, most in self.masks[s]:
                keep = keep[np.bitwise_count(x[keep] & mask) <= most]
                if not len(keep):
                    break
            out[keep] = True
        return out


#: So many distinct wide fingerprints take segments of three bytes.
WIDER = 1 << 27


class Wide:
    """Links of wide fingerprints of texts whose similarity is `similarity` or more."""

    together = 256

    def __init__(self, similarity: float, n: int = 0, wider: int = WIDER) -> None:
        apart = acos(2 * similarity / (1 + similarity)) / pi
        self.segment = 2 if n < wider else 3
        whole = (1 - apart) ** (8 * self.segment)
        #: Words that are compared; the rest of a fingerprint only gives keys.
        self.compared = 9
        self.segments = ceil(log(100) / -log(1 - whole))
        self.words = max(self.compared, -(-self.segments * self.segment // 8))
        bits = 64 * self.compared
        spread = sqrt(bits * apart * (1 - apart))
        self.budget = int(bits * apart + 2.6 * spread)
        #: A chain from a whole segment on may run ahead of its share by what chance does.
        self.share = [(k + 1) * self.budget / self.compared + 3 * 8 * sqrt((k + 1) * apart * (1 - apart)) for k in range(self.compared)]
        self.share[-1] = self.budget

    def read(self, column: pa.ChunkedArray) -> np.ndarray:
        raw = pa.concat_arrays([pc.cast(x, pa.binary()) for x in column.chunks]) if column.num_chunks else pa.array([], pa.binary())
        return np.frombuffer(b"".join(raw.to_pylist()), "<u8").reshape(-1, self.compared)

    def linked(self, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
        """As for narrow ones; chains grow by a word at a time, from that of the segment on."""
        keep, total = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
        word = start * self.segment // 8 % self.compared
        for k in range(self.compared):
            w = (word[keep] + k) % self.compared
            total = total + np.bitwise_count(a[keep, w] ^ b[keep, w])
            fine = total <= self.share[k]
            keep, total = keep[fine], total[fine]
            if not len(keep):
                break
        out = np.zeros(len(a), dtype=bool)
        out[keep] = True
        return out


class Forest:
    """Union-find over numbers."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def connect(forest: Forest, fps: np.ndarray, left: np.ndarray, right: np.ndarray, start: int, rule: Narrow | Wide) -> None:
    """Joins what links between two sets of positions (or within one, if they are the same). Every pair is tested once at
    most, a row at a time; positions that already are in one tree with the row need no test."""
    same = left is right
    tree = np.array([forest.root(i) for i in range(len(forest.up))])
    for k, i in enumerate(left.tolist()):
        others = right[k + 1 :] if same else right
        others = others[tree[others] != tree[i]]
        if not len(others):
            continue
        hits = others[rule.linked(np.broadcast_to(fps[i], (len(others), *fps.shape[1:])), fps[others], np.full(len(others), start))]
        for j in hits.tolist():
            forest.join(i, j)
        if len(hits):
            merged = np.isin(tree, np.append(tree[hits], tree[i]))
            tree[merged] = tree[i]


def meetings(rows: pa.Table, rule: Narrow | Wide) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) edges of a spanning forest over all links of some whole meetings, whose rows come sorted."""
    key, seg, side, node = (rows.column(c).to_numpy() for c in ("meet", "seg", "side", "node"))
    fps = rule.read(rows.column("fp"))
    # One tree for each node, however often it is here.
    names, where = np.unique(node, return_inverse=True)
    begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (seg[1:] != seg[:-1])]))
    size = np.diff(np.append(begin, len(key)))
    forest = Forest(len(names))
    group, inner = np.repeat(np.arange(len(begin)), size), np.repeat(size, size)
    inner = np.where((inner > 1) & (inner <= rule.together), inner, 0)
    place = np.arange(len(key)) - np.repeat(begin, size)
    for gap in range(1, int(inner.max(initial=1))):  # pairs of neighbours at a distance, in all small meetings at once
        for a in np.array_split(own := np.flatnonzero(place + gap < inner), max(1, len(own) // 200_000)):
            b = a + gap
            apart = node[a] != node[b]
            a, b = a[apart], b[apart]
            for i in a[rule.linked(fps[a], fps[b], seg[a])].tolist():
                forest.join(int(where[i]), int(where[i + gap]))
    large = size > rule.together
    for b, n in zip(begin[large].tolist(), size[large].tolist(), strict=True):
        local = Forest(n)
        at = np.arange(n)
        one, two = at[side[b : b + n] == 0], at[side[b : b + n] == 1]
        connect(local, fps[b : b + n], one, two if len(two) else one, int(seg[b]), rule)
        for i in range(n):
            if (r := local.root(i)) != i:
                forest.join(int(where[b + i]), int(where[b + r]))
    roots = np.array([forest.root(i) for i in range(len(names))], dtype=np.int64)
    linked_nodes = np.flatnonzero(roots != np.arange(len(names)))
    return names[linked_nodes], names[roots[linked_nodes]]


def linked_edges(keyed: DataFrame, rule: Narrow | Wide, rows: int, block: int, together: int = 200_000) -> DataFrame:
    """(a, b), written: edges of spanning forests over the links that each meeting holds, from (fp, node, seg, way, key), of about so
    many rows; those of one way and key meet."""
    spark = keyed.sparkSession
    crowded = keyed.groupBy("way", "key").count().filter(F.col("count") > block).select("way", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    crowded = materialise(crowded, "crowded")
    placed = keyed.join(crowded, ["way", "key"], "left")
    own = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int")
    pairs = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("x"), F.greatest(o, F.col("own")).alias("y")))
    )
    met = placed.withColumn("own", own).select("fp", "node", "seg", "way", "key", "own", F.explode(pairs).alias("p"))
    side = F.when((F.col("p.x") != F.col("p.y")) & (F.col("own") == F.col("p.y")), 1).otherwise(0).alias("side")
    met = met.select("fp", "node", "seg", F.xxhash64("way", "key", "p.x", "p.y").alias("meet"), side)

    def run(batches):
        """Some meetings at a time; the last one of those read waits for the rest of it."""
        rest = None
        for batch in batches:
            rest = pa.concat_tables([rest, pa.Table.from_batches([batch])]) if rest is not None else pa.Table.from_batches([batch])
            if len(rest) < together:
                continue
            meet, seg = rest.column("meet").to_numpy(), rest.column("seg").to_numpy()
            edges = np.flatnonzero((meet[1:] != meet[:-1]) | (seg[1:] != seg[:-1]))
            if not len(edges):
                continue
            at = int(edges[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in meetings(rest.slice(0, at), rule)], names=["a", "b"])
            rest = rest.slice(at).combine_chunks()
        if rest is not None and len(rest):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in meetings(rest, rule)], names=["a", "b"])
        give_back()

    parts = max(partitions(spark), rows // 1_000_000)
    edges = met.repartition(parts, "seg", "meet").sortWithinPartitions("seg", "meet", "side").mapInArrow(run, "a long, b long")
    out = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    release(crowded)
    return out


def near_components(prints: DataFrame, id_col: str = "doc_id", fp_col: str = "fp", budget: int = 4, block: int = 2048, row_cost: float = 100.0) -> DataFrame:
    """(node, component) for the representatives of fingerprints that link to another; node is the smallest id of a fingerprint."""
    distinct = materialise(prints.filter(F.col(id_col).isNotNull()).groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("node")), "distinct")
    n = distinct.count()
    keys = meeting_keys(budget, n, row_cost)

    def key(pieces: list[tuple[int, int]]) -> Column:
        out = F.lit(0).cast("long")
        for shift, width in pieces:
            out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned("fp", shift).bitwiseAND((1 << width) - 1)) if width < 64 else F.col("fp")
        return out

    keyed = distinct.select("fp", "node", F.posexplode(F.array(*[key(pieces) for _, pieces in keys])).alias("way", "key"))
    keyed = keyed.select("fp", "node", F.get(F.array(*[F.lit(s) for s, _ in keys]), F.col("way")).alias("seg"), "way", "key")
    edges = linked_edges(keyed, Narrow(budget), n * len(keys), block)
    out = components(edges)
    release(distinct)
    release(edges)
    return out


def _chunks(bodies: list[bytes], chunk: int) -> Iterator[list[bytes]]:
    at = 0
    while at < len(bodies):
        upto, held = at, 0
        while upto < len(bodies) and (upto == at or held + len(bodies[upto]) <= chunk):
            held += len(bodies[upto])
            upto += 1
        yield bodies[at:upto]
        at = upto


def _sets(docs: DataFrame, rule: Wide, shingle: int, words: int, whole: bool, chunk: int) -> DataFrame:
    """(id, set, fp) for each row: a digest of its text's set of shingles and the fingerprint; with `grams`, the set, if `whole`."""

    def run(batch: pa.RecordBatch) -> dict:
        digests, prints, sets = [], [], []
        for bodies in _chunks(texts(batch, "text"), chunk):
            grams, count = shingle_sets(bodies, shingle)
            prints += [x.tobytes() for x in wide_fingerprints(grams, count, words)]
            each = [x.tobytes() for x in np.split(grams, np.cumsum(count)[:-1])]
            digests += [blake2b(x, digest_size=16).digest() for x in each]
            sets += each if whole else []
        return {"set": digests, "fp": prints, "grams": sets}

    fields = [T.StructField(c, T.BinaryType()) for c in ("set", "fp", "grams")[: 3 if whole else 2]]
    return arrow_map(docs, run, T.StructType(fields), ["id"])


def _confirmed(edges: DataFrame, sets: DataFrame, rule: Wide, similarity: float, block: int) -> DataFrame:
    """The components of links that are true by the sets of shingles themselves, from edges that the fingerprints propose.

    Each edge is tested. Where all edges of a proposed component hold, it is a component. Where some don't, other links may
    hold it together: its parts of true edges are tested against each other, all but the largest part against all, in blocks;
    texts that are in one part by then need no test."""
    read = lambda column: [np.frombuffer(x, "<u8") for x in column.to_pylist()]
    own = lambda at: sets.select(F.col("id").alias(at), F.col("grams").alias(f"{at}_grams"))

    def test(batch: pa.RecordBatch) -> dict:
        return {"ok": [overlap(x, y, similarity) for x, y in zip(read(batch.column("a_grams")), read(batch.column("b_grams")), strict=True)]}

    tested = arrow_map(edges.join(own("a"), "a").join(own("b"), "b"), test, T.StructType([T.StructField("ok", T.BooleanType())]), ["a", "b"])
    tested = materialise(tested.groupBy("a", "b").agg(F.bool_or("ok").alias("ok")), "tested")
    true, false = tested.filter("ok").select("a", "b"), tested.filter("NOT ok")
    found = components(true)
    if false.isEmpty():
        release(tested)
        return found
    # Parts are named by their smallest node; those that false edges tie together stand for a proposed component.
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    parts = materialise(nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("part")), "parts")
    end = lambda c: parts.select(F.col("node").alias(c), F.col("part").alias(f"p{c}"))
    ties = false.join(end("a"), "a").join(end("b"), "b").filter("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
    wholes = components(ties)
    rows = materialise(parts.join(wholes.select(F.col("node").alias("part"), F.col("component").alias("whole")), "part").select("whole", "node", "part"), "open")
    sizes = rows.groupBy("whole", "part").count().groupBy("whole").agg(F.max(F.struct("count", "part")).alias("top"), F.sum("count").alias("n"))
    sizes = materialise(sizes.select("whole", F.col("top.part").alias("top"), F.ceil((F.col("n") - F.col("top.count")) / block).cast("int").alias("nx"), F.ceil(F.col("n") / block).cast("int").alias("ny")), "sizes")
    placed = rows.join(sizes, "whole").join(sets.select(F.col("id").alias("node"), "fp", "grams"), "node")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.filter("part <> top").select("whole", "part", "fp", "grams", F.lit(0).alias("side"), place("nx").alias("x"), every("ny").alias("y"))
    right = placed.select("whole", "part", "fp", "grams", F.lit(1).alias("side"), every("nx").alias("x"), place("ny").alias("y"))

    def match(rows: pa.Table) -> pa.Table:
        part, side, fps, grams = rows.column("part").to_numpy(), rows.column("side").to_numpy(), rule.read(rows.column("fp")), read(rows.column("grams"))
        tree, size, out = part.copy(), np.fromiter(map(len, grams), dtype=np.int64, count=len(grams)), []
        theirs = np.flatnonzero(side == 1)
        for i in np.flatnonzero(side == 0).tolist():
            others = theirs[tree[theirs] != tree[i]]
            others = others[np.minimum(size[others], size[i]) >= similarity * np.maximum(size[others], size[i])]
            others = others[np.bitwise_count(fps[others] ^ fps[i]).sum(axis=1) <= rule.budget]
            for j in others.tolist():
                if tree[j] != tree[i] and overlap(grams[i], grams[j], similarity):
                    out.append((part[i], part[j]))
                    tree[tree == tree[j]] = tree[i]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    more = left.unionByName(right).groupBy("whole", "x", "y").applyInArrow(match, "a long, b long")
    joined = components(more)
    out = parts.join(joined.withColumnRenamed("node", "part"), "part", "left").select("node", F.coalesce("component", "part").alias("component"))
    out = materialise(out, "confirmed")
    for frame in (tested, found, parts, wholes, rows, sizes, joined):
        release(frame)
    return out


def similar_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, block: int = 2048, chunk: int = 1 << 20, wider: int = WIDER
) -> DataFrame:
    """(id, component_id) for ids whose texts are like that of a smaller id, directly or by way of others: whole texts, by the
    sets of their shingles of words, at the similarity or more."""
    docs = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rule = Wide(similarity, docs.count(), wider)
    prints = materialise(_sets(docs, rule, shingle, rule.words, False, chunk), "wide")
    distinct = materialise(prints.groupBy("set", "fp").agg(F.min("id").alias("node")), "distinct")
    # A segment's bytes are its key; its place on the ring is its way.
    each = F.posexplode(F.array(*[F.xxhash64(F.substring("fp", i * rule.segment + 1, rule.segment)) for i in range(rule.segments)]))
    keyed = distinct.select(F.substring("fp", 1, 8 * rule.compared).alias("fp"), "node", each.alias("way", "key")).withColumn("seg", F.col("way"))
    edges = linked_edges(keyed, rule, distinct.count() * rule.segments, block)
    nodes = materialise(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "nodes")
    members = docs.join(nodes.hint("merge"), "id", "left_semi")  # texts are shuffled at every size
    sets = _sets(members, rule, shingle, rule.compared, True, chunk)
    sets = materialise(sets.dropDuplicates(["id", "set"]), "sets")
    found = _confirmed(edges, sets, rule, similarity, max(2, block // 4))
    moved = distinct.join(found, "node", "left").select("set", F.coalesce("component", "node").alias("component_id"))
    moved = materialise(moved, "moved")  # its own input of the join, so that a set that many rows have can be split
    out = materialise(prints.select("id", "set").join(moved, "set").filter(F.col("component_id") != F.col("id")).select(F.col("id").alias(id_col), "component_id").distinct(), "similar")
    for frame in (prints, distinct, edges, nodes, sets, found, moved):
        release(frame)
    return out


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, budget: int = 4) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id reachable over links, the row's own included."""
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    found = near_components(prints, id_col, "fp", budget)
    # By fingerprint: its representative's component, or that representative.
    rep = prints.filter(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).alias("node"), F.count("*").alias("n"))
    moved = rep.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"), "n", "node")
    moved = moved.filter((F.col("n") > 1) | (F.col("component") != F.col("node"))).select(F.col("fp").alias("__rv_fp"), "component")
    moved = materialise(moved, "moved")  # its own input of the join, so that a fingerprint many rows have can be split
    release(found)
    out = prints.join(moved, F.col("fp") == F.col("__rv_fp"), "left")
    return out.select(id_col, "fp", F.when(F.col(id_col).isNotNull(), F.coalesce("component", F.col(id_col))).alias("component_id"))
