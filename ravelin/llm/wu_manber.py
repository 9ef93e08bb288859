"""Benchmark decontamination by Wu-Manber search over words.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. An item's patterns are its windows of `size`
consecutive words, or the whole item if it is shorter. Patterns of one length share a matcher: a shift table over hashed
blocks of two words tells how far a scan may jump, blocks that end a pattern lead to a bucket (told by the words before, too),
and the words themselves are compared there, so that a hit is never a guess of a hash. Equal windows, of one item or of many, are
one pattern with a list of items, so repeated words and shared templates cost no more than others. Many stretches of documents are
scanned at once, each with its own place, in numpy.

Patterns lie in packed arrays: the words' bytes and hashes, the places where windows begin, sorted by bucket, and one byte
for each slot of the shift table. Items are taken in groups, by a hash of their text, so that a group's arrays have
`group_bytes` or so (`PACKED` bytes for each of text). One group is broadcast and searched in a single pass over the documents,
without a shuffle. Of several, each is searched in a pass of its own that returns only documents with hits; these are joined
to the documents by a hash of id and text. A benchmark must be small against a corpus: a pass is made for each group.

Defined cases: null text has no words; a very long text is scanned whole, in stretches that overlap by a window; an item
without words has no pattern; an item without an id counts for hits but is not listed; equal items with different ids are all
listed; repeated rows are judged each for itself; an empty benchmark hits nothing; other columns pass through.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_map, free, materialise, release, texts
from .words import _A, KEY, mix, span_hashes, word_spans

#: Letters, digits and all bytes from 0x80 are kept, A-Z lower-cased, the rest becomes a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


#: Bytes of arrays for a byte of items, in a group; measured in the tests.
PACKED = 12


def _block(hashes: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """The key of the block of words that ends at each place."""
    return mix(hashes[end - 1] * _A + hashes[end]) if width == 2 else hashes[end]


def same_windows(ids: np.ndarray, m: int) -> np.ndarray:
    """A number for the m consecutive ids from each place on, equal for equal ones: of stretches twice as long, again and again."""
    rank, length = ids.astype(np.int64), 1
    while length < m:
        step = min(length, m - length)
        pair = rank[: len(rank) - step] * (int(rank.max(initial=0)) + 1) + rank[step:]
        rank, length = np.unique(pair, return_inverse=True)[1].astype(np.int64), length + step
    return rank


class Matcher:
    """The different windows of m words of some items, in packed arrays; a window of many items is one pattern with a list."""

    def __init__(self, m: int, hashes: np.ndarray, ids: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> None:
        self.m, self.block = m, min(2, m)
        self.jump = m - self.block + 1
        windows = np.repeat(first, sizes - m + 1) + _ramp(sizes - m + 1)
        item = np.repeat(np.arange(len(first), dtype=np.int64), sizes - m + 1)
        same = same_windows(ids, m)[windows]
        # Each pattern's items, once; patterns with the same items share a list.
        order = np.lexsort((item, same))
        same, item, windows = same[order], item[order], windows[order]
        fresh = np.concatenate([[True], (same[1:] != same[:-1]) | (item[1:] != item[:-1])]) if len(same) else np.zeros(0, bool)
        same, item, windows = same[fresh], item[fresh], windows[fresh]
        begin = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]])) if len(same) else np.zeros(0, np.int64)
        n = np.diff(np.append(begin, len(same)))
        lists: dict[bytes, int] = {}
        self.lists: list[np.ndarray] = []
        owner = item[begin]
        for k in np.flatnonzero(n > 1).tolist():
            own = item[begin[k] : begin[k] + n[k]].astype(np.int32)
            at = lists.setdefault(own.tobytes(), len(lists))
            if at == len(self.lists):
                self.lists.append(own)
            owner[k] = -1 - at  # of the list
        at = windows[begin]
        keys = self.bucket(hashes, at)
        order = np.argsort(keys)
        self.keys, self.at, self.owner = keys[order], at[order].astype(np.int32), owner[order].astype(np.int32)
        # The q-th word of an item ends a window from the m-th word on; before, windows end m - 1 - q words later.
        q = _ramp(sizes)
        q, end = q[inside := q >= self.block - 1], (np.repeat(first, sizes) + q)[inside]
        self.bits = max(10, int(4 * len(end)).bit_length())
        self.shift = np.full(1 << self.bits, self.jump, dtype=np.uint8)
        np.minimum.at(self.shift, self.slot(_block(hashes, end, self.block)), np.maximum(m - 1 - q, 0).astype(np.uint8))

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.at, self.owner, self.shift, *self.lists))

    def slot(self, key: np.ndarray) -> np.ndarray:
        return key >> np.uint64(64 - self.bits)

    def bucket(self, hashes: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The suffix block's key, and the words before it mixed in, so that a bucket has one pattern but for chance."""
        key = _block(hashes, start + self.m - 1, self.block)
        for j in range(self.m - self.block):
            key = mix(key * _A + hashes[start + j])
        return key

    def candidates(self, hashes: np.ndarray, begins: np.ndarray, sizes: np.ndarray, stretch: int = 2048) -> np.ndarray:
        """Where windows may begin: all stretches advance together, each by what the shift table allows."""
        ends = np.maximum(sizes - self.m + 1, 0)  # places at which a window of the text may end
        cuts = -(-ends // stretch)
        at = np.repeat(begins + self.m - 1, cuts) + stretch * _ramp(cuts)
        stop = np.minimum(at + stretch, np.repeat(begins + sizes, cuts))
        found = []
        while len(at):
            step = self.shift[self.slot(_block(hashes, at, self.block))]
            if (here := step == 0).any():
                found.append(at[here])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        return np.concatenate([np.zeros(0, np.int64), *found]) - (self.m - 1)

    def pairs(self, hashes: np.ndarray, start: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(candidate, pattern) of one bucket, so many at a time."""
        key = self.bucket(hashes, start)
        low = np.searchsorted(self.keys, key)
        n = np.searchsorted(self.keys, key, side="right") - low
        start, low, n = start[n > 0], low[n > 0], n[n > 0]
        total = np.cumsum(n)
        for a in range(0, int(total[-1]) if len(total) else 0, most):
            each = np.arange(a, min(a + most, int(total[-1])))
            which = np.searchsorted(total, each, side="right")
            yield start[which], low[which] + each - (total[which] - n[which])


def _ramp(n: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n, one after another."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


class Patterns:
    """The matchers of a group of items: (number, text) pairs."""

    def __init__(self, items: list[tuple[int, bytes]], size: int) -> None:
        self.numbers = np.array([n for n, _ in items], dtype=np.int64)
        split = [words_of(t) for _, t in items]
        named: dict[bytes, int] = {}
        ids = np.array([named.setdefault(w, len(named)) for x in split for w in x], dtype=np.int64)
        self.raw, starts, ends, sizes = word_spans([b" ".join(x) for x in split])
        hashes = span_hashes(self.raw, starts, ends, KEY)[0]
        self.starts, self.ends = starts.astype(np.int32), ends.astype(np.int32)
        first, width = np.cumsum(sizes) - sizes, np.minimum(size, sizes)
        self.matchers = []
        for m in np.unique(width[width > 0]).tolist():
            own = np.flatnonzero(width == m)
            matcher = Matcher(m, hashes, ids, first[own], sizes[own])
            matcher.numbers = self.numbers[own]
            self.matchers.append(matcher)

    def nbytes(self) -> int:
        own = (self.numbers, self.raw, self.starts, self.ends, *(m.numbers for m in self.matchers))
        return sum(x.nbytes for x in own) + sum(m.nbytes() for m in self.matchers)

    def search_all(self, bodies: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[int]]]:
        """For each text its words, the merged spans of hit words, and the numbers of the items that occur. A place is compared once
        with each pattern of its bucket; hit words are marked in an array, and items are listed once for each pattern and text."""
        raw, starts, ends, sizes = word_spans([b.translate(WORD_BYTES) for b in bodies])
        hashes = span_hashes(raw, starts, ends, KEY)[0]
        begins = np.cumsum(sizes) - sizes
        cover = np.zeros(len(hashes) + 1, dtype=np.int64)
        items: list[set[int]] = [set() for _ in bodies]
        for matcher in self.matchers:
            m = matcher.m
            for start, pattern in matcher.pairs(hashes, matcher.candidates(hashes, begins, sizes)):
                window = matcher.at[pattern]
                # The words themselves.
                said = (raw[a:b].tobytes().split() for a, b in zip(starts[start].tolist(), ends[start + m - 1].tolist(), strict=True))
                meant = (self.raw[a:b].tobytes().split() for a, b in zip(self.starts[window].tolist(), self.ends[window + m - 1].tolist(), strict=True))
                same = np.fromiter(map(eq, said, meant), dtype=bool, count=len(start))
                start, pattern = start[same], pattern[same]
                np.add.at(cover, start, 1)
                np.add.at(cover, start + m, -1)
                text, owner = np.searchsorted(begins, start, side="right") - 1, matcher.owner[pattern].astype(np.int64)
                for t, i in np.unique(np.stack([text, owner], axis=1), axis=0).tolist():
                    items[t].update([int(matcher.numbers[i])] if i >= 0 else matcher.numbers[matcher.lists[-1 - i]].tolist())
        hit = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
        # Spans end with their text.
        opens, closes = hit[1:-1] & ~hit[:-2], hit[1:-1] & ~hit[2:]
        inner = begins[(sizes > 0) & (begins > 0)]
        both = inner[hit[inner] & hit[inner + 1]]
        opens[both], closes[both - 1] = True, True
        opens, closes = np.flatnonzero(opens), np.flatnonzero(closes)
        text = np.searchsorted(begins, opens, side="right") - 1
        spans: list[list[tuple[int, int]]] = [[] for _ in bodies]
        for t, a, b in zip(text.tolist(), (opens - begins[text]).tolist(), (closes + 1 - begins[text]).tolist(), strict=True):
            spans[t].append((a, b))
        return sizes, spans, items

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged spans of hit words, and the numbers of the items that occur, in one text."""
        _, spans, items = self.search_all([b" ".join(words)])
        return spans[0], items[0]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


#: The patterns that a worker used last.
_loaded: dict[str, Patterns] = {}
SPANS = "array<struct<begin:bigint,end:bigint>>"


def _searcher(sent, size: int, chunk: int = 1 << 20):
    """A function of texts that searches the broadcast group, a bounded chunk of them at a time."""
    mark = uuid.uuid4().hex

    def search(bodies: list[bytes]) -> tuple[list[int], list[list[dict]], list[list[str]]]:
        names, items = sent.value
        if mark not in _loaded:
            _loaded.clear()
            _loaded[mark] = Patterns(list(enumerate(items)), size)
        patterns = _loaded[mark]
        counts, spans, hits = [], [], []
        at = 0
        while at < len(bodies):
            upto, held = at, 0
            while upto < len(bodies) and (upto == at or held + len(bodies[upto]) <= chunk):
                held += len(bodies[upto])
                upto += 1
            n, here, numbers = patterns.search_all(bodies[at:upto])
            counts += n.tolist()
            spans += [[{"begin": a, "end": b} for a, b in x] for x in here]
            hits += [sorted({names[i] for i in x if names[i] is not None}) for x in numbers]
            at = upto
        return counts, spans, hits

    return search


def find_items(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 13, group_bytes: int = 256 << 20, out: tuple[str, str, str] = ("n_words", "spans", "items")
) -> DataFrame:
    """docs with their number of words, the merged [begin, end) word spans that items cover, and those items' ids as sorted strings."""
    spark = docs.sparkSession
    items = items.select(F.col(item_col).cast("string").alias("id"), F.encode(F.col(item_text), "UTF-8").alias("text")).filter("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    groups = -(-total * PACKED // group_bytes) or 1
    n_words, spans_col, items_col = out
    schema = T._parse_datatype_string(f"`{n_words}` long, `{spans_col}` {SPANS}, `{items_col}` array<string>")
    df = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in out])

    if groups > 1:  # each pass reads them
        items = materialise(items, "items")

    def group(g: int):
        rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(groups)) == g).collect()  # a group, hashing evens them out
        sent = spark.sparkContext.broadcast(([r.id for r in rows], [bytes(r.text) for r in rows]))
        return sent, _searcher(sent, size)

    if groups == 1:
        _, search = group(0)
        return arrow_map(df, lambda batch: dict(zip(out, search(texts(batch, text_col)), strict=True)), schema, df.columns)

    row = free(df.columns, "__rv_a", "__rv_b")
    own_spans, own_items = free(df.columns, "__rv_spans", "__rv_items")
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    keyed = df.withColumns({row[0]: F.xxhash64(F.lit(1), whole), row[1]: F.xxhash64(F.lit(2), F.reverse(text_col), whole)})
    hits = T._parse_datatype_string(f"n long, spans {SPANS}, items array<string>")
    found = None
    for g in range(groups):
        sent, search = group(g)
        got = arrow_map(keyed.select(*row, F.col(f"`{text_col}`").alias("body")), lambda batch, search=search: dict(zip(hits.names, search(texts(batch, "body")), strict=True)), hits, row)
        part = materialise(got.filter("size(spans) > 0").select(*row, "spans", "items"), "hits")
        found = part if found is None else found.unionByName(part)
        sent.destroy()
    release(items)
    # Rows that are wholly equal have equal hits; of each group's one is enough.
    found = found.groupBy(*row).agg(F.collect_set("spans").alias(own_spans), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias(own_items))

    def finish(batch: pa.RecordBatch) -> dict:
        spans = [merged([(x["begin"], x["end"]) for own in held or () for x in own]) for held in batch.column(own_spans).to_pylist()]
        counts = [len(words_of(t)) for t in texts(batch, text_col)]
        return {n_words: counts, spans_col: [[{"begin": a, "end": b} for a, b in x] for x in spans], items_col: [x or [] for x in batch.column(own_items).to_pylist()]}

    return arrow_map(keyed.join(found, row, "left"), finish, schema, df.columns)


def contamination(found: DataFrame, n_words: str = "n_words", spans: str = "spans", share: int = 20, out: tuple[str, str] = ("n_hit", "contaminated")) -> DataFrame:
    """Adds n_hit, and contaminated: hit at all, and in at least one word of `share`."""
    hit = F.coalesce(F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"]), F.lit(0).cast("long"))
    return found.withColumn(out[0], hit).withColumn(out[1], (F.col(out[0]) > 0) & (share * F.col(out[0]) >= F.col(n_words)))
