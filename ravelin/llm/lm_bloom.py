"""LM scoring with a log-frequency Bloom filter.

The model is a bigram model. Counts of words and of word pairs are gathered from all training texts: a task adds up its
own counts and sends them packed, by segment of the hash space; the task that owns a segment sums them and writes the
segment's part of the filter. An n-gram of count c is entered under the levels 1 to 1 + floor(log(c) / log(base)), so a
reader finds its quantised count by probing level after level until one is missing. Quantised counts never fall short
of their level; a false positive, with probability 2^-hashes for a level, can only raise one.

The filter's size follows the n-grams: each level of each n-gram has the same bits and hashes at any input size, and so
the same errors. A filter of up to `max_bytes` is broadcast. A larger one stays in the shared folder: each chunk of texts
sends its distinct n-grams, by ranges of segments, to the task that holds a range (of `slice_bytes` or so) and gets their
levels back, in `rounds` over a share of the texts each, so that questions and answers never lie on disk all at once. Scores
are the same either way.

p(w | v) = (min(c(vw), c(v)) + mu * p(w)) / (c(v) + mu), p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), all c from the filter;
the history of a text's first word is the end token.

The exact unigram base score needs exact counts of every word. Counts of the most frequent words (at most `hot_words`,
by count) are broadcast as sorted arrays; a text's remaining words, which are rare and therefore not skewed, are joined
to the counts. Words are told apart by 128 bits of keyed hash (`words`); pairs are filed under 64 bits, where a collision
does what a false positive of the filter does. Scores are the same in every run with the same `key`.

Defined cases: null text is empty and has one token, its end; a very long text is scored whole, by the task that reads it;
a row without an id is held out; repeated rows train and score each; ties between words at the edge of the hot ones go
together; with nothing to train on N = V = 0 and every probability is that of an unseen word; an empty table gives an
empty table; other columns pass through.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import aside, give_back, materialise, partitions, pieces, release, texts
from .words import _A, KEY, mix, word_stream

END = np.uint64(0x5E7D1C0FFEE01234)
UNIGRAM = np.uint64(0xD6E8FEB86659FD93)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _A + second)


def distinct_words(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct pair, ordered by first; the number of each place's pair)."""
    _, at, number = np.unique(first, return_index=True, return_inverse=True)
    if (second != second[at][number]).any():  # two words share their first hash
        order = np.lexsort((second, first))
        new = np.concatenate([[True], (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)])
        at, number = order[new], np.empty(len(first), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
    return at, number


@dataclass
class Stream:
    """The tokens of several texts, one after another, each text with its end; A-Z are lower-cased."""

    numbers: np.ndarray
    names: np.ndarray  # hashes of the words by number, in order, and below the second half of their identity
    twins: np.ndarray
    sizes: np.ndarray  # tokens of each text

    @classmethod
    def of(cls, bodies: list[bytes], key: bytes) -> Stream:
        lanes, sizes = word_stream([b.lower() for b in bodies], key, 2)
        where = np.arange(len(lanes[0])) + np.repeat(np.arange(len(sizes)), sizes)
        first, second = np.full((2, len(where) + len(sizes)), END)
        first[where], second[where] = lanes
        at, numbers = distinct_words(first, second)
        return cls(numbers, first[at], second[at], sizes + 1)

    def before(self) -> np.ndarray:
        """The number before each token; a text's first word follows the end token, as the text before it ended."""
        return np.concatenate([np.flatnonzero((self.names == END) & (self.twins == END))[:1], self.numbers[:-1]])

    def word_keys(self) -> np.ndarray:
        return mix(self.names ^ UNIGRAM)

    def pair_keys(self) -> np.ndarray:
        return pair_keys(self.names[self.before()], self.names[self.numbers])


def chunks(batches, size: int, text_col: str):
    """Lists of (batch, texts) of about `size` bytes."""
    held, total = [], 0
    for batch in batches:
        step = max(1, min(batch.num_rows, 512))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            bodies = texts(part, text_col)
            held.append((part, bodies))
            total += sum(map(len, bodies))
            if total >= size:
                yield held
                held, total = [], 0
    if held:
        yield held


def level_of(counts: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / log(base) + 1e-9).astype(np.int64)


def count_of(levels: np.ndarray, base: float) -> np.ndarray:
    """A level's count: 0, 1, and above that the middle of its range in logs."""
    return np.where(levels <= 1, levels.astype(np.float64), base ** (levels - 0.5))


_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """The segment of each key, from its high bits."""
    return (((keys >> _HALF) * np.uint64(segments)) >> _HALF).astype(np.int64)


def places(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit hashes of a key at a level; probe i looks at place(first + i * second)."""
    h = mix(keys + np.uint64(level * int(_A) % 2**64))
    return h >> _HALF, (h & _LOW) | np.uint64(1)


def place(first: np.ndarray, second: np.ndarray, i: int, bits: np.ndarray | np.uint64) -> np.ndarray:
    return (((first + np.uint64(i) * second) & _LOW) * bits) >> _HALF


def build_segment(keys: np.ndarray, counts: np.ndarray, hashes: int, base: float, most_bits: int | None = None) -> tuple[int, int, bytes]:
    """(hashes, bits, the filter's bytes) for a segment's n-grams: `hashes` of them, at the same bits for each level whatever the
    size. Only with most_bits, for filters whose false positives cost nothing but work, are there fewer if room is short."""
    levels = level_of(counts, base)
    entries = int(levels.sum())
    if not entries:
        return 1, 64, bytes(8)
    k = hashes if most_bits is None else max(1, min(hashes, int(most_bits * log(2) / entries)))
    bits = max(64, min(int(entries * k / log(2)), most_bits or 1 << 62) // 64 * 64)
    if bits > 1 << 32:
        raise ValueError("a segment has over 2^32 bits: more shuffle partitions are needed")
    marks = np.zeros(bits, dtype=np.uint8)
    for level in range(1, int(levels.max()) + 1):
        a, b = places(keys[levels >= level], level)
        for i in range(k):
            marks[place(a, b, i, np.uint64(bits))] = 1
    return k, bits, np.packbits(marks, bitorder="little").tobytes()


@dataclass
class LogFrequencyFilter:
    """All segments: where each begins (in bytes), its bits and hashes, and the bytes."""

    starts: np.ndarray
    bits: np.ndarray
    hashes: np.ndarray
    data: np.ndarray
    base: float
    #: The first segment held, and how many there are in all (0: those held).
    low: int = 0
    segments: int = 0

    def levels(self, keys: np.ndarray, most: int = 120) -> np.ndarray:
        """The quantised count of each key, by probing level after level."""
        found = np.zeros(len(keys), dtype=np.int64)
        seg = segment_of(keys, self.segments or len(self.bits)) - self.low
        start, bits = (self.starts * 8).astype(np.uint64)[seg], self.bits.astype(np.uint64)[seg]
        top, same = int(self.hashes.max(initial=1)), self.hashes.min(initial=1 << 30) == self.hashes.max(initial=1)
        k = None if same else self.hashes[seg]
        alive, key = np.arange(len(keys)), keys
        for level in range(1, most):
            a, b = places(key, level)
            here, s, n = alive, start, bits
            for i in range(top):
                at = s + place(a, b, i, n)
                ok = (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
                if i and k is not None:
                    ok |= i >= k[here]
                if ok.all():
                    continue
                here, a, b, s, n = here[ok], a[ok], b[ok], s[ok], n[ok]
                if not len(here):
                    break
            alive, start, bits = here, s, n
            if not len(alive):
                break
            found[alive] = level
            key = keys[alive]
        return found


def assemble(rows: DataFrame, segments: int, base: float) -> LogFrequencyFilter:
    """The filter from its segments' rows (seg, k, bits, data), which the builders bound to max_bytes in all. They come to
    the driver in 16 parts, one after another."""
    sizes = {r.seg: (r.k, r.bits) for r in rows.select("seg", "k", "bits").collect()}
    bits = np.array([sizes[s][1] if s in sizes else 64 for s in range(segments)], dtype=np.int64)
    hashes = np.array([sizes[s][0] if s in sizes else 1 for s in range(segments)], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(bits // 8)]).astype(np.int64)
    data = np.zeros(int(starts[-1]), dtype=np.uint8)
    for r in rows.select("seg", "data").coalesce(16).toLocalIterator():
        data[starts[r.seg] : starts[r.seg + 1]] = np.frombuffer(r.data, np.uint8)
    return LogFrequencyFilter(starts[:-1], bits, hashes, data, base)


@dataclass
class Model:
    filter: LogFrequencyFilter | None  # None if it is too large to broadcast
    total: int
    distinct: int
    hot_keys: np.ndarray
    hot_twins: np.ndarray
    hot_counts: np.ndarray
    mu: float
    base: float
    segments: int
    key: bytes


PACKED = "seg int, kind int, keys binary, twins binary, counts binary"
GATHERED = "kind int, key long, twin long, n long, k int, bits long, data binary"


def gather(docs: DataFrame, text_col: str, segments: int, chunk: int, hashes: int, base: float, key: bytes) -> DataFrame:
    """Rows of kind 1: (key, twin, n) of words; of kind 2: (segment, hashes, bits, data) of the filter."""
    packed, out = (to_arrow_schema(T._parse_datatype_string(x)) for x in (PACKED, GATHERED))

    def count(batches):
        for held in chunks(batches, chunk, text_col):
            got = Stream.of([b for _, bodies in held for b in bodies], key)
            once = np.bincount(got.numbers, minlength=len(got.names)).astype(np.uint64)
            known = once > 0
            pairs, pair_counts = np.unique(got.pair_keys(), return_counts=True)
            rows = []
            for kind, keys, twins, n in ((1, got.names[known], got.twins[known], once[known]), (2, pairs, None, pair_counts)):
                seg = segment_of(keys if kind == 2 else mix(keys ^ UNIGRAM), segments)
                order = np.argsort(seg, kind="stable")
                keys, n, seg = keys[order].astype("<u8"), n[order].astype("<u4"), seg[order]
                twins = None if twins is None else twins[order].astype("<u8")
                cut = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1], [True]]))
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    rows.append((int(seg[a]), kind, keys[a:b].tobytes(), None if twins is None else twins[a:b].tobytes(), n[a:b].tobytes()))
            for at in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_pylist([dict(zip(packed.names, r, strict=True)) for r in rows[at : at + 4096]], schema=packed)
        give_back()

    def of_segment(seg: int, own: dict[int, list[tuple]]) -> Iterator[pa.RecordBatch]:
        joined = lambda kind, i, t: np.concatenate([np.zeros(0, t), *(np.frombuffer(p[i], t) for p in own.get(kind, ()))])
        keys, twins, n = joined(1, 0, "<u8"), joined(1, 1, "<u8"), joined(1, 2, "<u4")
        at, number = distinct_words(keys, twins)
        keys, twins, n = keys[at], twins[at], np.bincount(number, weights=n, minlength=len(at))
        columns = {"kind": np.ones(len(keys), np.int32), "key": keys.view(np.int64), "twin": twins.view(np.int64), "n": n.astype(np.int64)}
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name]) if f.name in columns else pa.nulls(len(keys), f.type) for f in out], schema=out)
        pairs, number = np.unique(joined(2, 0, "<u8"), return_inverse=True)
        twice = np.bincount(number, weights=joined(2, 2, "<u4"), minlength=len(pairs))
        k, bits, data = build_segment(np.concatenate([mix(keys ^ UNIGRAM), pairs]), np.concatenate([n, twice]), hashes, base)
        yield pa.RecordBatch.from_pylist([{"kind": 2, "key": seg, "k": k, "bits": bits, "data": data}], schema=out)

    def merge(batches):
        """Rows come by segment; one segment's are held at a time."""
        now, own = None, {}
        for batch in batches:
            for seg, kind, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if seg != now:
                    if now is not None:
                        yield from of_segment(now, own)
                    now, own = seg, {}
                own.setdefault(kind, []).append(parts)
        if now is not None:
            yield from of_segment(now, own)
        give_back()

    sent = docs.select(text_col).mapInArrow(count, PACKED)
    return sent.repartition(segments, "seg").sortWithinPartitions("seg").mapInArrow(merge, GATHERED)


def fit(docs: DataFrame, text_col: str = "text", hashes: int = 6, base: float = 1.5, max_bytes: int = 128 << 20, hot_words: int = 400_000, mu: float = 4.0, chunk: int = 2 << 20, key: bytes = KEY) -> tuple[Model, DataFrame, DataFrame]:
    """The model, all words' (key, twin, n), and the filter's segments (seg, k, bits, data), learned from docs."""
    spark = docs.sparkSession
    segments = 4 * pieces(docs)
    gathered = materialise(gather(docs, text_col, segments, chunk, hashes, base, key), "counts")
    words = gathered.filter("kind = 1").select("key", "twin", "n")
    # How many words there are of each size of count; a size's words are all hot or none.
    size = F.floor(F.log2("n") * 8).cast("int")
    steps = sorted(words.groupBy(size.alias("size")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect(), reverse=True)
    total, distinct = sum(r.tokens for r in steps), sum(r.words for r in steps)
    taken, least = 0, None
    for r in steps:
        if (taken := taken + r.words) > hot_words:
            break
        least = r["size"]
    hot = (words.filter(size >= least) if least is not None else words.limit(0)).toPandas()  # hot_words rows at most
    keys = hot["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    same = np.diff(keys[order]) == 0  # words that share their first hash are looked up by the join
    order = order[~(np.append(same, False) | np.append(False, same))[: len(order)]]
    parts = gathered.filter("kind = 2").select(F.col("key").alias("seg"), "k", "bits", "data")
    fits = (parts.agg(F.sum("bits")).first()[0] or 0) <= 8 * max_bytes
    filt = assemble(parts, segments, base) if fits else None
    twins, counts = hot["twin"].to_numpy().view(np.uint64)[order], hot["n"].to_numpy()[order]
    return Model(filt, total, distinct, keys[order], twins, counts, mu, base, segments, key), words, parts


def asked(got: Stream) -> np.ndarray:
    """The distinct keys that texts' scores look up, in order and so by segment."""
    return np.unique(np.concatenate([got.word_keys(), got.pair_keys()]))


def probe_slices(numbered: DataFrame, parts: DataFrame, model: Model, text_col: str, chunk: int, slice_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The questions as written, and (chunk, slice, body): for each chunk of texts its rows as Arrow bytes (slice -1), and the levels of its keys
    from each slice of the filter, one after another."""
    size = parts.agg(F.sum("bits")).first()[0] // 8
    slices = int(min(model.segments, max(1, -(-size // slice_bytes))))
    segments, base, hash_key = model.segments, model.base, model.key
    sent = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("slice", T.IntegerType()), T.StructField("seg", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("bits", T.LongType()), T.StructField("body", T.BinaryType())])
    back = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("slice", T.IntegerType()), T.StructField("body", T.BinaryType())])

    def batch(schema, *rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(to_arrow_schema(schema))], names=schema.names)

    def ask(batches):
        first = TaskContext.get().partitionId() << 32
        for n, held in enumerate(chunks(batches, chunk, text_col)):
            rows = pa.Table.from_batches([b for b, _ in held])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as writer:
                writer.write_table(rows)
            keys = asked(Stream.of([b for _, bodies in held for b in bodies], hash_key))
            where = segment_of(keys, segments) * slices // segments
            cut = np.searchsorted(where, np.arange(slices + 1))
            yield batch(sent, (first + n, -1, None, None, None, sink.getvalue().to_pybytes()))
            yield batch(sent, *[(first + n, i, None, None, None, keys[a:b].astype("<u8").tobytes()) for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a])
        give_back()

    def answer(batches):
        """A slice's segments come before its questions."""
        now, own, filt, low = None, [], None, 0
        for got in batches:
            for c, i, seg, k, bits, body in zip(*(got.column(x).to_pylist() for x in sent.names[:-1]), got.column("body"), strict=True):
                body = body.as_py()
                if i != now:
                    now, own, filt = i, [], None
                if c is None:
                    own.append((seg, k, bits, body))
                    continue
                if filt is None:
                    low, high = -(-i * segments // slices), -(-(i + 1) * segments // slices)
                    held = {x[0]: x for x in own}
                    own = [held.get(s, (s, 1, 64, bytes(8))) for s in range(low, high)]
                    ends = np.cumsum([0, *(len(x[3]) for x in own)])
                    filt = LogFrequencyFilter(ends[:-1].astype(np.int64), np.array([x[2] for x in own]), np.array([x[1] for x in own]), np.frombuffer(b"".join(x[3] for x in own), np.uint8), base, low, segments)
                    own, held = [], None
                yield batch(back, (c, i, filt.levels(np.frombuffer(body, "<u8")).astype(np.uint8).tobytes()))
        give_back()

    questions = materialise(numbered.mapInArrow(ask, sent), "questions")
    blank = F.lit(None)
    mine = parts.select(blank.cast("long").alias("chunk"), F.floor(F.col("seg") * slices / segments).cast("int").alias("slice"), "seg", "k", "bits", F.col("data").alias("body"))
    both = questions.filter("slice >= 0").unionByName(mine)
    n = partitions(numbered.sparkSession)
    answers = both.repartition(n, "slice").sortWithinPartitions("slice", F.col("chunk").asc_nulls_first()).mapInArrow(answer, back)
    return questions, questions.filter("slice < 0").select(*back.names).unionByName(answers).repartition(n, "chunk").sortWithinPartitions("chunk", "slice")


def score_texts(got: Stream, model: Model, levels=None) -> dict[str, list | np.ndarray]:
    """For each text: tokens, hot known tokens, their base score, the model's score, and the identities of its other tokens.
    levels tells keys' levels, if the model holds no filter."""
    numbers, sizes = got.numbers, got.sizes
    space = model.total + 0.5 * (model.distinct + 1)
    hot, base = np.zeros(len(got.names), dtype=bool), np.zeros(len(got.names))
    if len(model.hot_keys):
        at = np.minimum(np.searchsorted(model.hot_keys, got.names), len(model.hot_keys) - 1)
        hot = (model.hot_keys[at] == got.names) & (model.hot_twins[at] == got.twins)
        base = np.where(hot, np.log10((model.hot_counts[at] + 0.5) / space), 0.0)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    rare = np.flatnonzero(~hot[numbers])
    levels = levels or model.filter.levels
    # Each key once, in order, so that neighbouring probes fall into one segment.
    keys, at = np.unique(got.word_keys(), return_inverse=True)
    once = count_of(levels(keys), model.base)[at]
    unigram = (once + 0.5) / space
    before = got.before()
    keys, at = np.unique(got.pair_keys(), return_inverse=True)
    twice = count_of(levels(keys), model.base)[at]
    p = (np.minimum(twice, once[before]) + model.mu * unigram[numbers]) / (once[before] + model.mu)
    return {
        "n_tokens": sizes,
        "hot_known": np.add.reduceat(hot[numbers].astype(np.int64), begin),
        "hot_base": np.add.reduceat(base[numbers], begin),
        "score": np.add.reduceat(np.log10(p), begin),
        "tail_ends": np.append(np.searchsorted(rare, begin), len(rare)).astype(np.int32),
        "tail": got.names[numbers[rare]].view(np.int64),
        "twins": got.twins[numbers[rare]].view(np.int64),
    }


def _free_shuffles(spark) -> None:
    """Shuffle files of frames that are gone are deleted when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def lm_score(docs: DataFrame, may_learn, text_col: str = "text", chunk: int = 1 << 20, slice_bytes: int = 4 << 20, rounds: int = 8, **how) -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score, learned from the rows where may_learn holds."""
    spark = docs.sparkSession
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    model, words, parts = fit(docs.filter(may_learn), text_col, **how)
    sent = spark.sparkContext.broadcast(model)
    docs, (text_col,), passed = aside(docs, text_col, drop=(*made, text_col))
    keep = [c for c in docs.columns]
    new = T._parse_datatype_string("__rv_n long, __rv_known long, __rv_base double, __rv_score double, __rv_tail array<long>, __rv_twins array<long>")
    numbered = docs.withColumn("__rv_row", F.monotonically_increasing_id())
    schema = T.StructType([numbered.schema[c] for c in keep if c != text_col] + [numbered.schema["__rv_row"], *new.fields])

    def scored(rows: pa.Table, tokens: Stream, levels=None) -> pa.RecordBatch:
        got = score_texts(tokens, sent.value, levels)
        passed = [rows.column(c).combine_chunks() for c in schema.names[: len(schema.names) - len(new)]]
        tails = [pa.ListArray.from_arrays(pa.array(got["tail_ends"]), pa.array(got[x])) for x in ("tail", "twins")]
        return pa.RecordBatch.from_arrays([*passed, *(pa.array(got[x]) for x in ("n_tokens", "hot_known", "hot_base", "score")), *tails], names=schema.names)

    def run(batches):
        for held in chunks(batches, chunk, text_col):
            yield scored(pa.Table.from_batches([b for b, _ in held]), Stream.of([b for _, bodies in held for b in bodies], sent.value.key))
        give_back()

    def run_answered(batches):
        """A chunk's rows come before its levels."""

        def one(body: bytes, parts: list[bytes]) -> pa.RecordBatch:
            rows = pa.ipc.open_stream(body).read_all()
            bodies = [t for b in rows.to_batches() for t in texts(b, text_col)]
            tokens = Stream.of(bodies, sent.value.key)
            keys, found = asked(tokens), np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
            return scored(rows, tokens, lambda k: found[np.searchsorted(keys, k)])

        body, parts = None, []
        for batch in batches:
            for i, part in zip(batch.column("slice").to_pylist(), batch.column("body"), strict=True):
                part = part.as_py()
                if i >= 0:
                    parts.append(part)
                    continue
                if body is not None:
                    yield one(body, parts)
                body, parts = part, []
        if body is not None:
            yield one(body, parts)
        give_back()

    # Written once: the rows' numbers must not change between the two uses.
    if model.filter is not None:
        done = materialise(numbered.mapInArrow(run, schema), "scores")
    else:
        done, row = None, F.col("__rv_row")
        for g in range(rounds):
            mine = numbered.filter(F.pmod(F.xxhash64(text_col), F.lit(rounds)) == g).withColumn("__rv_row", row * rounds + g)
            _free_shuffles(spark)
            questions, answered = probe_slices(mine, parts, model, text_col, chunk, slice_bytes)
            part = materialise(answered.mapInArrow(run_answered, schema), "scores")
            release(questions)
            del questions, answered
            done = part if done is None else done.unionByName(part)
        _free_shuffles(spark)
    sent.destroy()
    space = float(model.total + 0.5 * (model.distinct + 1))
    tails = done.select("__rv_row", F.explode(F.arrays_zip("__rv_tail", "__rv_twins")).alias("w"))
    tails = tails.select("__rv_row", F.col("w.__rv_tail").alias("key"), F.col("w.__rv_twins").alias("twin")).join(words, ["key", "twin"], "left")
    tails = tails.groupBy(F.col("__rv_row").alias("__rv_at")).agg(F.sum(F.log10((F.coalesce("n", F.lit(0)) + 0.5) / space)).alias("__rv_more"), F.count("n").alias("__rv_found"))
    out = done.join(tails, F.col("__rv_row") == F.col("__rv_at"), "left")
    return out.select(
        *passed, F.col("__rv_n").alias("n_tokens"), (F.col("__rv_known") + F.coalesce("__rv_found", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("__rv_base") + F.coalesce("__rv_more", F.lit(0.0))).alias("base_score"), F.col("__rv_score").alias("score"),
    )
