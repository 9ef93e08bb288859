"""Substring dedup: compressed FM-indexes per shard, matching statistics by backward search over wavelet trees.

A window is `length` consecutive words. Windows that repeat must meet in one shard, so each window is filed under its
anchor: the least (first, if equal) hash among its runs of `gram` words. Equal windows have equal anchors. Neighbouring
windows with one anchor form a context, a stretch of at most 2 * length - gram words. Anchors that occur once can't
hold a repeat; a Bloom filter of bounded size names those that occur again (a false positive only costs work).

Equal contexts, by 128 bits of a hash under a key that each run draws, collapse to one that counts for all its places. An anchor that more than `crowd` different contexts share (a passage that many
documents quote) would be one task's unbounded group; its contexts are cut into single windows, each filed under a hash of
all its words, so that they spread, and equal ones again collapse. A shard is a set of anchors: its contexts' words are numbered, the suffix
array gives the Burrows-Wheeler transform, and a wavelet matrix over it (bit vectors with counts every 64 bits, whose blocks
are stored once each where that is smaller) answers rank queries. Each context is then streamed through the index from its end: backward search extends the match to the
left while at least two places hold it. A match that stops is as long as repeats ending there get; matches of at least
`length` words are reported, and the search goes on from the next end that can hold an unseen window. All contexts of a
shard advance together, a word at a time, in numpy.

Reported stretches go back to every place of their context, and the words that they cover are removed.

Shards come sorted by anchor and one is held at a time; an anchor has `crowd` contexts at most, or one window.

Defined cases: null or empty text has no words and an empty result; a very long text is read whole, in one task, and its
contexts are dealt like those of others; ties (equal windows of one text) are repeats; rows that are wholly equal, id included, are
different places; a text shorter than a window is kept; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .lm_bloom import LogFrequencyFilter, assemble, build_segment, chunks, segment_of
from .shared import arrow_map, aside, give_back, materialise, pieces, release, texts
from .words import _A, mix, new_key, word_stream
from .wu_manber import merged


class WaveletMatrix:
    """Rank over a sequence of small numbers, in bit vectors of 64-bit words with running counts. A vector whose words recur
    (runs of the transform) keeps each distinct word once, and numbers for the places."""

    def __init__(self, seq: np.ndarray, symbols: int) -> None:
        self.n = len(seq)
        self.height = max(1, int(symbols - 1).bit_length())
        self.planes = []
        for level in range(self.height - 1, -1, -1):
            bits = (seq >> level & 1).astype(np.uint8)
            packed = np.packbits(bits, bitorder="little")
            words = np.zeros(self.n // 64 + 1, dtype="<u8")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int32)[:-1]]).astype(np.int32)
            ones = bits.view(bool)
            zeros = int(self.n - ones.sum())
            self.planes.append((level, *self.packed(words), before, zeros))
            seq = np.concatenate([seq[~ones], seq[ones]])
        self.first = self.descend(np.arange(symbols), np.zeros(symbols, dtype=np.int64))

    @staticmethod
    def packed(words: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """(distinct words, the number of each place's), or the words themselves where that is no smaller."""
        held, at = np.unique(words, return_inverse=True)
        at = at.astype(np.min_scalar_type(len(held)))
        return (held, at) if held.nbytes + at.nbytes < words.nbytes else (words, None)

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        at = at.astype(np.int64)
        for level, words, numbers, before, zeros in self.planes:
            w = at >> 6
            inside = words[w if numbers is None else numbers[w]] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = before[w] + np.bitwise_count(inside)
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before a place."""
        return self.descend(symbol, at) - self.first[symbol]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The order of suffixes by their first `depth` symbols at least, by prefix doubling."""
    rank = text.astype(np.int64)
    n, step = len(text), 1
    order = np.argsort(rank)
    while step < depth:
        after = np.zeros(n, dtype=np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        step *= 2
        if int(rank.max()) == n - 1:
            break
    return order


class FmIndex:
    def __init__(self, text: np.ndarray, symbols: int, depth: int, weights: np.ndarray | None = None) -> None:
        """text: numbers from 1; 0 ends each part. weights: at how many places each position's part stands."""
        order = suffix_array(text, depth)
        self.places = np.concatenate([[0], np.cumsum(weights[order])]) if weights is not None else np.arange(len(text) + 1)
        self.wavelet = WaveletMatrix(text[order - 1], symbols)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.shift = self.starts[:-1] - self.wavelet.first

    def occurrences(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.places[high] - self.places[low]

    def one(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.starts[symbol], self.starts[symbol + 1]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of symbol + match, from the match's."""
        both = self.wavelet.descend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        shift = self.shift[symbol]
        return shift + both[: len(low)], shift + both[len(low) :]


def repeated_stretches(index: FmIndex, text: np.ndarray, begins: np.ndarray, sizes: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(context, begin, end) of stretches of at least `length` symbols that the index holds twice or more."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    ctx = np.flatnonzero(sizes >= length)
    end = sizes[ctx].astype(np.int64)
    at = end - 1
    low, high = index.one(text[begins[ctx] + at])
    while len(ctx):
        held = index.occurrences(low, high) >= 2
        whole = held & (at == 0)
        if whole.any():
            found.append((ctx[whole], at[whole], end[whole]))
        stop = ~held
        longest = stop & (end - at - 1 >= length)
        if longest.any():
            found.append((ctx[longest], at[longest] + 1, end[longest]))
        # From where a match stopped: windows not seen yet begin at or before it and end before it ended.
        later = np.minimum(end[stop] - 1, at[stop] + length)
        more = later >= length
        c2, e2 = ctx[stop][more], later[more]
        a2 = e2 - 1
        l2, h2 = index.one(text[begins[c2] + a2])
        on = held & (at > 0)
        c1, e1, a1 = ctx[on], end[on], at[on] - 1
        l1, h1 = index.extend(text[begins[c1] + a1], low[on], high[on]) if len(c1) else (low[on], high[on])
        ctx, end, at = np.concatenate([c1, c2]), np.concatenate([e1, e2]), np.concatenate([a1, a2])
        low, high = np.concatenate([l1, l2]), np.concatenate([h1, h2])
    if not found:
        return []
    return list(zip(*(np.concatenate([f[i] for f in found]).tolist() for i in range(3)), strict=True))


def numbered(lists: list[list[bytes]]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(numbers of all words, one list after another; the words, numbered from 1; words of each list)."""
    words = list(dict.fromkeys(chain.from_iterable(lists)))
    number = dict(zip(words, range(1, len(words) + 1), strict=True))
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.fromiter(map(number.__getitem__, chain.from_iterable(lists)), dtype=np.int32, count=int(sizes.sum())), words, sizes


def search_shard(bodies: list[bytes], counts: list[int], length: int, depth: int) -> list[list[tuple[int, int]]]:
    """For each context (words joined by spaces) of a shard, the merged stretches that occur twice or more."""
    numbers, vocabulary, sizes = numbered([body.split(b" ") for body in bodies])
    text = np.zeros(len(numbers) + len(sizes), dtype=np.int32)  # a 0 after each context
    text[np.arange(len(numbers)) + np.repeat(np.arange(len(sizes)), sizes)] = numbers
    begins = np.cumsum(sizes + 1) - sizes - 1
    weights = np.repeat(np.array(counts, dtype=np.int64), sizes + 1)
    index = FmIndex(text, len(vocabulary) + 1, depth, weights)
    out: list[list[tuple[int, int]]] = [[] for _ in bodies]
    for c, a, b in repeated_stretches(index, text, begins, sizes, length):
        out[c].append((a, b))
    return [merged(x) for x in out]


def anchors(bodies: list[bytes], length: int, gram: int, key: bytes) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, all words' two hashes, then for each context its anchor's hash, text, first word and words)."""
    lanes, sizes = word_stream(bodies, key, 2)
    hashes = lanes[0]
    none = np.zeros(0, dtype=np.int64)
    if len(hashes) < length:
        return sizes, lanes, np.zeros(0, np.uint64), none, none, none
    n = len(hashes) - gram + 1
    grams = np.zeros(n, dtype=np.uint64)
    for j in range(gram):
        grams = grams * _A + hashes[j : n + j]
    grams = mix(grams)
    best = np.arange(n, dtype=np.int64)
    span, width = 1, length - gram + 1
    while span < width:  # the first least of each run of grams, by doubling
        step = min(span, width - span)
        left, right = best[:-step], best[step:]
        best = np.where(grams[right] < grams[left], right, left)
        span += step
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(best))
    inside = text_of[at] == text_of[at + length - 1]
    at, best = at[inside], best[inside]
    if not len(at):
        return sizes, lanes, np.zeros(0, np.uint64), none, none, none
    owner = text_of[at]
    cut = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])]))
    windows = np.diff(np.append(cut, len(at)))
    first = at[cut] - np.concatenate([[0], np.cumsum(sizes)[:-1]])[owner[cut]]
    return sizes, lanes, grams[best[cut]], owner[cut], first, windows + length - 1


ROW = ("__rv_a", "__rv_b")


def with_row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumn(ROW[0], F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col))).withColumn(ROW[1], F.xxhash64(F.lit(2), F.col(text_col), F.col(id_col)))


def context_digests(lanes: list[np.ndarray], begin: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Two 64-bit halves of each context's hash, over the keyed 128 bits of each of its words."""
    raw, digest = np.stack(lanes, axis=1).astype("<u8").tobytes(), xxhash.xxh3_128_digest
    whole = b"".join([digest(raw[a:b]) for a, b in zip((16 * begin).tolist(), (16 * (begin + words)).tolist(), strict=True)])
    return np.frombuffer(whole, "<u8").reshape(-1, 2)


def stream_begins(sizes: np.ndarray, owner: np.ndarray, first: np.ndarray) -> np.ndarray:
    return (np.cumsum(sizes) - sizes)[owner] + first


def by_segment(batches) -> Iterator[tuple[int, list[tuple]]]:
    """(segment, its rows) of rows that come sorted by it, in their first column."""
    now, own = None, []
    for batch in batches:
        for seg, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if seg != now and own:
                yield now, own
                own = []
            now = seg
            own.append(row)
    if own:
        yield now, own


SENT = "seg int, keys binary, n binary"
BUILT = "kind int, seg int, k int, bits long, data binary"


def anchor_filters(docs: DataFrame, text_col: str, length: int, gram: int, chunk: int, crowd: int, max_bytes: int, key: bytes) -> tuple[LogFrequencyFilter, LogFrequencyFilter]:
    """Bloom filters, of max_bytes each at most: of the anchors that occur more than once, and of those with more than
    `crowd` contexts that differ (tasks count apart, so copies may be counted several times; that only costs work)."""
    segments = 4 * pieces(docs)
    sent, built = (to_arrow_schema(T._parse_datatype_string(x)) for x in (SENT, BUILT))

    def send(batches):
        for held in chunks(batches, chunk, text_col):
            sizes, lanes, keys, owner, first, words = anchors([b for _, bodies in held for b in bodies], length, gram, key)
            digests = context_digests(lanes, stream_begins(sizes, owner, first), words)[:, 0]
            n = np.unique(keys, return_counts=True)[1]
            keys, differ = np.unique(keys[np.unique(mix(keys * _A + digests), return_index=True)[1]], return_counts=True)
            seg = segment_of(keys, segments)
            order = np.argsort(seg, kind="stable")
            keys, n, seg = keys[order].astype("<u8"), (np.minimum(n, 2) + 4 * np.minimum(differ, 4095))[order].astype("<u2"), seg[order]
            cut = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1], [True]])) if len(seg) else np.zeros(0, int)
            rows = [{"seg": int(seg[a]), "keys": keys[a:b].tobytes(), "n": n[a:b].tobytes()} for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=sent)
        give_back()

    def gather(batches):
        for seg, rows in by_segment(batches):
            keys, where = np.unique(np.concatenate([np.frombuffer(r[0], "<u8") for r in rows]), return_inverse=True)
            n = np.concatenate([np.frombuffer(r[1], "<u2") for r in rows])
            again, differ = np.bincount(where, weights=n % 4), np.bincount(where, weights=n // 4)
            for kind, chosen in enumerate((keys[again >= 2], keys[differ > crowd])):
                k, bits, data = build_segment(chosen, np.ones(len(chosen)), 7, 2.0, max(64, max_bytes * 8 // segments))
                yield pa.RecordBatch.from_pylist([{"kind": kind, "seg": seg, "k": k, "bits": bits, "data": data}], schema=built)
        give_back()

    rows = docs.select(text_col).mapInArrow(send, SENT).repartition(segments // 4, "seg").sortWithinPartitions("seg").mapInArrow(gather, BUILT)
    rows = materialise(rows, "anchors")
    again, crowded = (assemble(rows.filter(F.col("kind") == kind).drop("kind"), segments, 2.0) for kind in (0, 1))
    release(rows)
    return again, crowded


def single_windows(sizes, lanes, owner, first, words, length: int):
    """Contexts cut into their windows, each filed under a hash of all its words."""
    n = words - length + 1
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    owner, first = np.repeat(owner, n), np.repeat(first, n) + at
    words = np.full(len(first), length, dtype=np.int64)
    return mix(context_digests(lanes, stream_begins(sizes, owner, first), words)[:, 0]), owner, first, words


def pack(docs: DataFrame, text_col: str) -> DataFrame:
    """The text compressed, for shuffles."""

    def run(batch: pa.RecordBatch) -> dict:
        tool = zstandard.ZstdCompressor(level=3)
        return {"__rv_z": [tool.compress(t) for t in texts(batch, text_col)]}

    return arrow_map(docs, run, T.StructType([T.StructField("__rv_z", T.BinaryType())]), [c for c in docs.columns if c != text_col])


def unpacked(batch: pa.RecordBatch) -> list[bytes]:
    tool = zstandard.ZstdDecompressor()
    return [tool.decompress(z) for z in batch.column("__rv_z").to_pylist()]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35, gram: int = 8, chunk: int = 3 << 20, shard_words: int = 400_000, filter_bytes: int = 64 << 20, crowd: int = 512, out: tuple[str, str, str] = ("kept_words", "n_words", "stretches")) -> DataFrame:
    """docs (without their text) with the words kept, joined by spaces, the words there were, and the removed [begin, end) stretches of words."""
    spark = docs.sparkSession
    docs, (id_col, text_col), passed = aside(docs, id_col, text_col, drop=(*out, text_col))
    hash_key = new_key()
    sent = spark.sparkContext.broadcast(anchor_filters(docs, text_col, length, gram, chunk, crowd, filter_bytes, hash_key))
    keyed = with_row_key(docs, id_col, text_col)
    ctx = ["key", "ctx", "twin"]  # an anchor, and what tells its contexts apart
    places = f"key long, ctx long, twin long, {ROW[0]} long, {ROW[1]} long, first int, words int"

    def place(batches):
        for held in chunks(batches, chunk, text_col):
            sizes, lanes, keys, owner, first, words = anchors([b for _, bodies in held for b in bodies], length, gram, hash_key)
            if not len(keys):
                continue
            again, crowded = sent.value
            take = again.levels(keys, 2) > 0
            many = take & (crowded.levels(keys, 2) > 0)
            one = take & ~many
            parts = [(keys[one], owner[one], first[one], words[one])]
            if many.any():
                parts.append(single_windows(sizes, lanes, owner[many], first[many], words[many], length))
            keys, owner, first, words = (np.concatenate(x) for x in zip(*parts, strict=True))
            digests = context_digests(lanes, stream_begins(sizes, owner, first), words).view(np.int64)
            rows = pa.Table.from_batches([b.select(list(ROW)) for b, _ in held]).take(pa.array(owner)).combine_chunks()
            columns = [pa.array(x) for x in (keys.view(np.int64), digests[:, 0].copy(), digests[:, 1].copy())]
            made = pa.table([*columns, *rows.columns, pa.array(first.astype(np.int32)), pa.array(words.astype(np.int32))], names=[*ctx, *ROW, "first", "words"])
            yield from made.combine_chunks().to_batches()
        give_back()

    placed = materialise(keyed.select(*ROW, text_col).mapInArrow(place, places), "places")
    sent.destroy()
    distinct = placed.groupBy(*ctx).agg(F.count("*").alias("n"), F.min(F.struct(*ROW, "first", "words")).alias("at"))
    asked = distinct.groupBy(*[F.col(f"at.{r}").alias(r) for r in ROW]).agg(F.collect_list(F.struct(*ctx, F.least("n", F.lit(2)).cast("int").alias("n"), "at.first", "at.words")).alias("asked"))
    # One row gives the words of a context; rows that are wholly equal would give it twice.
    source = pack(keyed.select(*ROW, text_col), text_col).join(asked, list(ROW))
    quoted = pa.schema([*((c, pa.int64()) for c in ctx), ("n", pa.int32()), ("body", pa.binary())])

    def quote(batch):
        rows = []
        for text, own in zip(unpacked(batch), batch.column("asked").to_pylist(), strict=True):
            words = text.split()
            rows += [{**x, "body": b" ".join(words[x["first"] : x["first"] + x["words"]])} for x in own]
        return pa.RecordBatch.from_pylist(rows, schema=quoted)

    def small(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):
                yield quote(b.slice(at, 200))

    contexts = source.mapInArrow(small, "key long, ctx long, twin long, n int, body binary")
    depth = 2 * length
    found_kind = pa.schema([*((c, pa.int64()) for c in ctx), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])

    def shard(held: pa.Table) -> Iterator[pa.RecordBatch]:
        """The contexts of several anchors, sorted, in one index."""
        if not held.num_rows:
            return
        key, ctx1, ctx2, n = (held.column(c).to_numpy() for c in (*ctx, "n"))
        other = key[1:] != key[:-1]
        once = np.concatenate([[True], other | (ctx1[1:] != ctx1[:-1]) | (ctx2[1:] != ctx2[:-1])])
        total = np.bincount(which := np.concatenate([[0], np.cumsum(other)]), weights=np.where(once, n, 0))
        mine = np.flatnonzero(once & (total[which] >= 2))  # what only the filter took for repeated goes
        if not len(mine):
            return
        found = search_shard(held.column("body").take(pa.array(mine)).to_pylist(), n[mine].tolist(), length, depth)
        rows = [{"key": int(key[i]), "ctx": int(ctx1[i]), "twin": int(ctx2[i]), "begins": [x for x, _ in s], "ends": [y for _, y in s]} for i, s in zip(mine.tolist(), found, strict=True) if s]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=found_kind)

    def look(batches):
        rest = quoted.empty_table()
        for batch in batches:
            rest = pa.concat_tables([rest, pa.Table.from_batches([batch])])
            while rest.nbytes // 6 >= shard_words:
                words = np.cumsum(pc.binary_length(rest.column("body")).to_numpy()) // 6
                key = rest.column("key").to_numpy()
                edges = np.flatnonzero(key[1:] != key[:-1]) + 1
                full = edges[words[edges - 1] <= shard_words]
                at = int(full[-1]) if len(full) else int(edges[0]) if len(edges) else 0
                if not at or words[-1] < shard_words:
                    break
                yield from shard(rest.slice(0, at))
                rest = rest.slice(at).combine_chunks()
        yield from shard(rest)
        give_back()

    dealt = contexts.repartition(pieces(docs), "key").sortWithinPartitions(*ctx)
    reported = materialise(dealt.mapInArrow(look, "key long, ctx long, twin long, begins array<int>, ends array<int>"), "reported")
    covered = placed.select(*ctx, *ROW, "first").join(reported, ctx)
    covered = covered.select(*ROW, F.explode(F.arrays_zip("begins", "ends")).alias("s"), "first")
    stretch = F.struct((F.col("s.begins") + F.col("first")).alias("begin"), (F.col("s.ends") + F.col("first")).alias("end"))
    covered = covered.groupBy(*ROW).agg(F.collect_set(stretch).alias("__rv_spans"))
    joined = pack(keyed, text_col).join(covered, list(ROW), "left")
    keep = [c for c in docs.columns if c != text_col]

    def cut(batch: pa.RecordBatch) -> dict:
        kept, before, gone = [], [], []
        for text, spans in zip(unpacked(batch), batch.column("__rv_spans").to_pylist(), strict=True):
            words = text.split()
            own = merged([(s["begin"], s["end"]) for s in spans or ()])
            before.append(len(words))
            for a, b in reversed(own):
                del words[a:b]
            kept.append(b" ".join(words).decode("utf-8", "replace"))
            gone.append([{"begin": a, "end": b} for a, b in own])
        return {out[0]: kept, out[1]: before, out[2]: gone}

    span = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])
    return arrow_map(joined, cut, T.StructType([T.StructField(out[0], T.StringType()), T.StructField(out[1], T.LongType()), T.StructField(out[2], T.ArrayType(span))]), keep).select(*passed, *out)
