"""Text operators against brute force, on texts with every case that their docstrings define."""

import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from brute import SCHEMA, prose, rows_of
from ravelin.llm import line_dedup, lm_bloom, piece_codec, quality_gbdt, simhash, substring_fm, words, wu_manber
from ravelin.llm.queries import tokenizer_path
from ravelin.llm.shared import components, held_out


def by_text(rows, *columns):
    return sorted(((r.doc_id is None, r.doc_id or 0, *(getattr(r, c) for c in columns)) for r in rows), key=str)


def want_rows(texts, values):
    return sorted(((i is None, i or 0, *v) for (i, _), v in zip(texts, values, strict=True)), key=str)


def test_line_dedup(hard_docs, hard_texts):
    got = line_dedup.line_dedup(hard_docs, out=("kept_text", "n_lines", "n_dropped"))
    assert set(got.columns) == {*hard_docs.columns, "n_dropped"}
    assert by_text(got.collect(), "n_lines", "n_dropped", "kept_text") == want_rows(hard_texts, brute.deduped_lines(hard_texts))


def test_line_dedup_threshold(spark):
    df = spark.createDataFrame([(i, "shared by several lines") for i in range(4)] + [(9, "shared by only two"), (8, "shared by only two")], "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(df, min_documents=3).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 8: 0, 9: 0}


@pytest.mark.parametrize("gram, length", [(3, 6), (8, 35)])
def test_substring_dedup(hard_docs, hard_texts, gram, length):
    got = substring_fm.remove_repeats(hard_docs, length=length, gram=gram, chunk=4000, shard_words=500, crowd=2)
    want = brute.without_repeats([t for _, t in hard_texts], length)
    rows = got.withColumn("removed", F.expr("aggregate(stretches, 0, (n, s) -> n + s.end - s.begin)")).collect()
    assert by_text(rows, "n_words", "removed", "kept_words") == want_rows(hard_texts, want)


@pytest.mark.parametrize("seed", range(3))
def test_substring_dedup_of_repetitive_texts(spark, seed):
    rng = random.Random(seed)
    texts = [(i, " ".join(rng.choice("ab" if i % 3 else "abcdefgh") for _ in range(rng.choice([0, 3, 30, 80])))) for i in range(25)]
    got = substring_fm.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), length=9, gram=3, chunk=300, shard_words=100, crowd=3 + 500 * (seed == 0))
    rows = got.withColumn("removed", F.expr("aggregate(stretches, 0, (n, s) -> n + s.end - s.begin)")).collect()
    assert by_text(rows, "n_words", "removed", "kept_words") == want_rows(texts, brute.without_repeats([t for _, t in texts], 9))


def test_wavelet_rank_and_backward_search():
    import numpy as np

    rng = np.random.default_rng(4)
    seq = rng.integers(0, 9, 700)
    w = substring_fm.WaveletMatrix(seq, 9)
    at = rng.integers(0, 701, 300)
    sym = rng.integers(0, 9, 300)
    assert w.rank(sym, at).tolist() == [int((seq[:a] == s).sum()) for s, a in zip(sym, at, strict=True)]
    text = np.append(rng.integers(1, 4, 300), 0).astype(np.int32)
    index = substring_fm.FmIndex(text, 4, 16)
    for _ in range(50):
        a = rng.integers(0, 290)
        pattern = text[a : a + rng.integers(1, 9)]
        low, high = index.one(pattern[-1:])
        for c in pattern[-2::-1]:
            low, high = index.extend(np.array([c]), low, high)
        want = sum((text[i : i + len(pattern)] == pattern).all() for i in range(len(text) - len(pattern) + 1))
        assert int(high[0] - low[0]) == want


ITEMS = [(1, "Common line, of text HERE"), (2, None), (3, "..."), (4, "word"), (None, "unique a1"), (5, prose(random.Random(11), 30)), (5, "école"), (6, "")]


def test_decontamination(spark, hard_docs, hard_texts):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for group_bytes in (1 << 20, 200):  # in one group, and in several
        got = wu_manber.contamination(wu_manber.find_items(hard_docs, items, group_bytes=group_bytes))
        want = brute.contamination([t for _, t in hard_texts], ITEMS)
        assert by_text(got.collect(), "n_words", "n_hit", "items") == want_rows(hard_texts, want)
        assert got.filter("contaminated AND n_hit = 0 OR contaminated AND 20 * n_hit < n_words").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_wu_manber_is_brute_force(seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))) for i in range(12)]
    p = wu_manber.Patterns([(i, t.encode()) for i, t in items], 5)
    for t, (n, hit, found) in zip(texts, brute.contamination(texts, items, 5), strict=True):
        spans, numbers = p.search(wu_manber.words_of(t.encode()))
        assert (sum(b - a for a, b in spans), sorted(map(str, numbers))) == (hit, found) and n == len(t.split())


def test_patterns_stay_packed():
    """A group's arrays have PACKED bytes or less for each of text, and nothing else of the items is kept."""
    rng = random.Random(1)
    words_ = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    items = [(i, " ".join(rng.choice(words_) for _ in range(rng.choice([5, 40, 400]))).encode()) for i in range(3000)]
    size = sum(len(t) + 32 for _, t in items)
    p = wu_manber.Patterns(items, 13)
    tracemalloc.start()
    again = wu_manber.Patterns(items, 13)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert again.nbytes() == p.nbytes() and held < 1.1 * p.nbytes() + 100_000 and p.nbytes() < wu_manber.PACKED * size
    text = items[7][1]
    assert 7 in p.search(wu_manber.words_of(b"x " + text + b" y"))[1]


@pytest.mark.parametrize("case", ["one word", "a template", "equal ends"])
def test_repeated_words_and_shared_templates_cost_no_more(case):
    """Equal windows are one pattern, and a place is compared with what can be there only."""
    rng = random.Random(4)
    if case == "one word":
        items, texts = [(0, b"la " * 1000), (1, b"la " * 13)], [b"la " * 2000]
        want = [(2000, [(0, 2000)], {0, 1})]
    elif case == "a template":
        lead = prose(rng, 30).encode()
        items = [(i, lead + b" " + prose(rng, 20).encode()) for i in range(4000)]
        texts = [b"a b " + lead + b" zz" for _ in range(20)]
        n = len(wu_manber.words_of(texts[0]))
        want = [(n, [(2, n - 1)], set(range(4000)))] * 20
    else:  # the same first and last words, and others between them
        items = [(i, f"what is the price of thing{i} in town if you pay in coins".encode()) for i in range(4000)]
        texts = [b" ".join(f"what is the price of thing{i} in town if you pay in coins".encode() for i in range(900, 1000))]
        want = [(1300, [(0, 1300)], set(range(900, 1000)))]
    p = wu_manber.Patterns(items, 13)
    began = time.process_time()
    sizes, spans, found = p.search_all(texts)
    assert [*zip(sizes.tolist(), spans, found, strict=True)] == want
    assert time.process_time() - began < 1 and (case != "one word" or len(p.matchers[0].keys) == 1)


def test_spans_end_with_their_text():
    p = wu_manber.Patterns([(0, b"a b c"), (1, b"x")], 3)
    sizes, spans, found = p.search_all([b"a b c", b"", b"a b c x", b"q", b"x a b", b"c"])
    assert sizes.tolist() == [3, 0, 4, 1, 3, 1] and spans == [[(0, 3)], [], [(0, 4)], [], [(0, 1)], []] and found == [{0}, set(), {0, 1}, set(), {1}, set()]


def test_one_very_long_text_is_searched_whole():
    rng = random.Random(2)
    items = [(i, prose(rng, 20).encode()) for i in range(5)]
    long = " ".join(prose(rng, 9000) + " " + t.decode() for _, t in items).encode()
    n, spans, found = wu_manber.Patterns(items, 13).search_all([b"", long, items[3][1]])
    assert found == [set(), {0, 1, 2, 3, 4}, {3}] and n.tolist() == [0, len(wu_manber.words_of(long)), len(wu_manber.words_of(items[3][1]))]
    assert sum(b - a for a, b in spans[1]) == sum(len(wu_manber.words_of(t)) for _, t in items)


def test_fingerprints_and_components(hard_docs, hard_texts):
    got = simhash.simhash_dedup(hard_docs).collect()
    prints = {i: brute.simhash(t) for i, t in hard_texts if i is not None}
    comp = brute.linked_components(prints)
    want = [(i, brute.simhash(t), None if i is None else comp[i]) for i, t in hard_texts]
    assert sorted([(r.doc_id, r.fp % 2**64, r.component_id) for r in got], key=str) == sorted(want, key=str)


@pytest.mark.parametrize("block", [7, 2048])
@pytest.mark.parametrize("seed", range(3))
def test_pigeonring_finds_every_link(spark, seed, block):
    """Random fingerprints with clusters of near ones, some large; small blocks make every meeting a crowded one."""
    rng = random.Random(seed)
    prints = {}
    for c in range(12):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 60])):
            x = centre
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            prints[len(prints) * 3 - 10] = x
    signed = [(i, x - 2**64 if x >> 63 else x) for i, x in prints.items()]
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    got = {r.node: r.component for r in simhash.near_components(df, block=block).collect()}
    firsts = {}
    for i, x in prints.items():
        firsts[x] = min(i, firsts.get(x, i))
    want = brute.linked_components({i: x for x, i in firsts.items()})
    assert all(got.get(i, i) == c for i, c in want.items())


@pytest.mark.parametrize("cost", [100.0, 0.01, 1e-6])
def test_longer_keys_find_every_link_too(spark, cost):
    """Keys as many fingerprints would have them."""
    rng = random.Random(8)
    centres = [rng.getrandbits(64) for _ in range(150)]
    prints = {i: (c := centres[i % 150]) ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 3))}) for i in range(600)}
    df = spark.createDataFrame([(i, x - 2**64 if x >> 63 else x) for i, x in prints.items()], "doc_id long, fp long")
    got = {r.node: r.component for r in simhash.near_components(df, row_cost=cost).collect()}
    firsts = {}
    for i, x in prints.items():
        firsts[x] = min(i, firsts.get(x, i))
    want = brute.linked_components({i: x for x, i in firsts.items()})
    assert all(got.get(i, i) == c for i, c in want.items()) and len(set(want.values())) < len(want)


def test_longer_keys_come_with_more_fingerprints():
    shortest = lambda n: min(sum(w for _, w in p) for _, p in simhash.meeting_keys(4, n))
    assert [shortest(n) for n in (0, 10**6, 10**9, 5 * 10**10)] == sorted(shortest(n) for n in (0, 10**6, 10**9, 5 * 10**10))
    assert shortest(5 * 10**10) >= 30 > shortest(0) == 18
    for budget in (0, 1, 3, 4, 7):  # any two numbers that differ in so many bits meet and pass the chain from there
        rng, rule = random.Random(budget), simhash.Narrow(budget)
        for n in (0, 10**10):
            keys = simhash.meeting_keys(budget, n)
            for _ in range(300):
                a = rng.getrandbits(64)
                b = a ^ sum(1 << i for i in rng.sample(range(64), budget))
                met = [s for s, parts in keys if all((a ^ b) >> shift & ((1 << width) - 1) == 0 for shift, width in parts)]
                assert rule.linked(*(np.full(len(met), x, np.uint64) for x in (a, b)), np.array(met, dtype=int)).any()


def test_wide_fingerprints_are_majorities():
    texts = [t.encode() for t in ("", " ", "a", "A b", "a b c d e", " ".join(f"w{i % 40}" for i in range(900)), "x y z x y z x y z x y z")]
    wide = lambda texts: simhash.wide_fingerprints(*simhash.shingle_sets(texts, 5), 3)
    got = wide(texts)
    assert not got[:2].any() and all(got[i].any() for i in range(2, 7))
    again = wide(texts[5:] + [b"A", b"a  B"])
    assert (again[:2] == got[5:]).all() and (again[2:] == got[2:4]).all()  # whatever stands beside them
    (h,), _ = words.word_stream([texts[5]], words.KEY)
    grams = np.zeros(len(h) - 4, dtype=np.uint64)
    for j in range(5):
        grams = words.mix(grams * words._A + h[j : j + len(grams)])
    grams = np.unique(grams)
    for w in range(3):
        bits = words.mix(grams ^ words.mix(np.array([w + 1], dtype=np.uint64) * words._A))
        want = sum(1 << b for b in range(64) if 2 * int((bits >> np.uint64(b) & np.uint64(1)).sum()) > len(bits))
        assert int(got[5, w]) == want


@pytest.mark.parametrize("block", [6, 2048])
def test_similar_texts_are_found(spark, block):
    """Nearly all pairs at the similarity are, none far below it; clusters of copies are linked whole."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts, pairs = {}, []

    def changed(text, n):
        text = list(text)
        for i in rng.sample(range(len(text)), n):
            text[i] = rng.choice(vocabulary)
        return text

    for _ in range(150):
        one = [rng.choice(vocabulary) for _ in range(300)]
        for edits in (rng.randint(1, 6), rng.randint(30, 60)):
            at = len(texts)
            pairs.append((at, at + 1, edits))
            texts |= {at: one, at + 1: changed(one, edits)}
            one = [rng.choice(vocabulary) for _ in range(200)]
    base = [rng.choice(vocabulary) for _ in range(400)]
    cluster = range(10_000, 10_060)
    texts |= {i: changed(base, i % 3) for i in cluster}
    rows = [(i, " ".join(t), 1) for i, t in texts.items()] + [(20_000, None, 1), (20_001, "", 1), (None, " ".join(base), 1), (20_002, "two words", 1), (20_003, "two  WORDS", 1)]
    got = {r.doc_id: r.component_id for r in simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string, fp int"), block=block).collect()}
    near = [got.get(a, a) == got.get(b, b) for a, b, edits in pairs if edits <= 6]
    far = [got.get(a, a) == got.get(b, b) for a, b, edits in pairs if edits >= 30]
    assert sum(near) >= 0.97 * len(near) and not any(far)
    assert {got.get(i, i) for i in cluster} == {10_000} and got[20_001] == 20_000 and got[20_003] == 20_002
    assert simhash.similar_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def jaccard(a, b, shingle=5):
    a, b = ({tuple(t[i : i + shingle]) for i in range(len(t) - shingle + 1)} for t in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("wider", [simhash.WIDER, 0])
def test_nothing_below_the_similarity_links(spark, wider):
    """Around 0.8 the fingerprints propose on both sides; the sets decide."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, pairs = [], []
    for n in range(260):
        one = [rng.choice(vocabulary) for _ in range(300)]
        two = list(one)
        for i in rng.sample(range(300), 4 + n % 14):
            two[i] = rng.choice(vocabulary)
        pairs.append((2 * n, 2 * n + 1, jaccard(one, two)))
        rows += [(2 * n, " ".join(one)), (2 * n + 1, " ".join(two))]
    got = {r.doc_id: r.component_id for r in simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), wider=wider).collect()}
    linked = [got.get(a, a) == got.get(b, b) for a, b, _ in pairs]
    below = [x for x, (_, _, j) in zip(linked, pairs, strict=True) if 0.65 < j < 0.8]
    above = [x for x, (_, _, j) in zip(linked, pairs, strict=True) if j >= 0.8]
    assert len(below) > 50 and not any(below)
    assert len(above) > 50 and sum(above) >= 0.95 * len(above)


def test_true_links_hold_what_false_ones_proposed(spark):
    """A ring of texts, each like the next two at most, and a heap of texts all a little too far apart: brute force agrees."""
    rng = random.Random(10)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(400)]
    texts = {}
    for i in range(30):  # a window that slides over a long text
        texts[i] = base[8 * i : 8 * i + 150]
    heap = [rng.choice(vocabulary) for _ in range(200)]
    for i in range(100, 140):
        texts[i] = list(heap)
        for k in rng.sample(range(200), 3 if i % 4 else 6):
            texts[i][k] = f"x{i}.{k}"
    texts = {i: " ".join(t) for i, t in texts.items()}
    want = brute.similar_components(texts)
    got = {r.doc_id: r.component_id for r in simhash.similar_components(spark.createDataFrame([*texts.items()], "doc_id long, text string"), block=8).collect()}
    assert {i: got.get(i, i) for i in texts} == want and 1 < len(set(want.values())) < len(texts)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}


def test_lm_scores(hard_docs, hard_texts):
    for hot in (400_000, 3):  # all words hot, and nearly all joined
        got = lm_bloom.lm_score(hard_docs, ~held_out("doc_id", 5, 1), hot_words=hot, chunk=2000).collect()
        want, n = brute.base_scores(hard_texts, lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1)
        key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6))
        assert sorted(map(key, got)) == sorted((i is None, i or 0, a, b, round(c, 6)) for (i, _), (a, b, c) in zip(hard_texts, want, strict=True))
        assert {r.train_tokens for r in got} == {n}
        assert all(r.score < 0 for r in got)


def test_lm_filter_never_falls_short():
    import numpy as np

    rng = np.random.default_rng(0)
    keys, counts = rng.integers(0, 2**63, 3000).astype(np.uint64), rng.zipf(1.5, 3000).clip(1, 10**6).astype(float)
    for most in (1 << 30, 8000):  # room enough, and far too little
        k, bits, data = lm_bloom.build_segment(keys, counts, 7, 1.5, most)
        assert bits <= most
        f = lm_bloom.LogFrequencyFilter(np.zeros(1, np.int64), np.array([bits]), np.array([k]), np.frombuffer(data, np.uint8), 1.5)
        assert (f.levels(keys) >= lm_bloom.level_of(counts, 1.5)).all()
    k, bits, data = lm_bloom.build_segment(keys, counts, 7, 1.5, 1 << 30)
    f = lm_bloom.LogFrequencyFilter(np.zeros(1, np.int64), np.array([bits]), np.array([k]), np.frombuffer(data, np.uint8), 1.5)
    assert (f.levels(keys) == lm_bloom.level_of(counts, 1.5)).mean() > 0.97
    assert (f.levels(rng.integers(0, 2**63, 20_000).astype(np.uint64)) > 0).mean() < 0.02


def test_lm_filter_keeps_its_bits_at_any_size(spark, hard_docs):
    """A filter that is too large to broadcast is probed where it lies, and scores stay the same."""
    may_learn = ~held_out("doc_id", 5, 1)
    want = lm_bloom.lm_score(hard_docs, may_learn, chunk=2000).collect()
    got = lm_bloom.lm_score(hard_docs, may_learn, chunk=2000, max_bytes=64, slice_bytes=100).collect()
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    rounded = lambda rows: by_text([type(r)(**(r.asDict() | {c: round(r[c], 9) for c in made})) for r in rows], *made)
    assert len(got) == hard_docs.count() and rounded(got) == rounded(want)
    model, _, parts = lm_bloom.fit(hard_docs, max_bytes=64)
    assert model.filter is None and {r.k for r in parts.collect() if r.bits > 64} == {6}


def test_lm_prefers_the_language_it_learned(spark):
    rng = random.Random(2)
    chain = lambda n: " ".join(f"w{i % 50} v{i % 50}" for i in (rng.randrange(50) for _ in range(n)))
    docs = [(i, chain(60)) for i in range(60)]
    got = lm_bloom.lm_score(spark.createDataFrame(docs, "doc_id long, text string"), ~held_out("doc_id", 5, 1)).filter(held_out("doc_id", 5, 1)).collect()
    assert got and all(r.score > r.base_score for r in got)


def test_pieces_are_those_of_the_library(spark, hard_docs, hard_texts):
    import numpy as np
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    tool = piece_codec.codec(tokenizer_path())
    rng = random.Random(1)
    bits = ["a", "th", " ", "  ", "\n", "▁", "é", "漢", "😀", "\t", "\0", "\r", "<s>", "</s>", "<0x0A>", "ing", "▁▁", "​", "!!", "\n\n\n", "<unk>", "0", "　", "é"]
    for t in [t or "" for _, t in hard_texts] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(2000)]:
        raw = t.encode()
        ids, begins, ends = tool.encode(raw)
        want = sp.encode(t, add_bos=True, add_eos=True)
        assert ids.tolist() == want and tool.decode(ids) == sp.decode(want)
        top = 0
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            raw[a:b].decode()
            assert a <= top and a <= b
            top = max(top, b)
        assert top == len(raw)
    docs = piece_codec.decode_ids(piece_codec.encode_texts(hard_docs, tokenizer_path()), tokenizer_path())
    for r in docs.collect():
        assert r.ids == sp.encode(r.text or "", add_bos=True, add_eos=True) and r.decoded == sp.decode(r.ids)
        assert np.array(r.ends).max() == len((r.text or "").encode())


def double_array(pairs):
    """A Darts double array for a few keys, placed one node at a time, and its strings."""
    strings, values = b"", {}
    for k, v in pairs:
        values[k] = len(strings)
        strings += v + b"\0"
    units = [0] * 4096
    used = {0}

    def place(node, keys, depth):
        labels = sorted({k[depth] if depth < len(k) else 0 for k in keys})
        offset = next(o for o in range(1, 4000) if all((node ^ o ^ x) not in used for x in labels) and (node ^ o ^ 0) not in used)
        if offset >= 1 << 21:
            raise ValueError(offset)
        units[node] |= offset << 10 | (1 << 8 if 0 in labels else 0)
        for x in labels:
            used.add(node ^ offset ^ x)
        for x in labels:
            child = node ^ offset ^ x
            if x == 0:
                units[child] = values[next(k for k in keys if len(k) == depth)] | 1 << 31
            else:
                units[child] = x
                place(child, [k for k in keys if depth < len(k) and k[depth] == x], depth + 1)

    place(0, [k for k, _ in pairs], 0)
    import struct

    raw = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(raw)) + raw + strings


def test_character_map_takes_the_longest_prefix():
    m = piece_codec.CharMap(double_array([(b"a", b"x"), (b"ab", b"yy"), ("é".encode(), b"e"), (b"abcd", b"")]))
    assert m.longest(b"abq", 0) == (2, b"yy") and m.longest(b"abcd", 0) == (4, b"") and m.longest(b"qa", 1) == (1, b"x")
    assert m.longest("é".encode(), 0) == (2, b"e") and m.longest(b"b", 0) is None and piece_codec.CharMap(b"").longest(b"a", 0) is None


def test_normalisation_keeps_alignment():
    """A model with a character map and white-space rules: every normalised byte knows where it came from."""
    with open(tokenizer_path(), "rb") as f:
        model = f.read()
    bare = b"".join(model[b:e] for n, _, _, b, e in piece_codec.fields(model) if n != 3)
    blob = double_array([("ﬁ".encode(), b"fi"), ("\t".encode(), b" "), (b"A", b"a")])
    spec = piece_codec.encoded_field(2, blob) + piece_codec.encoded_field(3, 1) + piece_codec.encoded_field(4, 1) + piece_codec.encoded_field(5, 1)
    tool = piece_codec.PieceCodec(bare + piece_codec.encoded_field(3, spec))
    raw = "  Aﬁ\t\t b  ".encode()
    norm, source = tool.normalise(raw)
    assert norm == "▁afi▁b"
    assert source.tolist() == [2, 2, 2, 2, 3, 3, 6, 6, 6, 9, 10]
    assert tool.full.encode(raw.decode()) == tool.encode(raw, ends=False)[0].tolist()
    ids, begins, ends = tool.encode(raw, ends=False)
    assert all(raw[a:b].decode() is not None for a, b in zip(begins, ends, strict=True)) and begins[0] == 2
    assert tool.normalise(b"   ")[0] == "" and tool.normalise(b"")[0] == ""


@pytest.mark.parametrize("squeeze", [0, 1])
@pytest.mark.parametrize("dummy", [0, 1])
def test_maps_and_own_symbols_are_those_of_the_library(squeeze, dummy):
    """Random texts through models with a character map, user-defined symbols and white-space rules: ids and decoded text."""
    with open(tokenizer_path(), "rb") as f:
        model = f.read()
    bare = b"".join(model[b:e] for n, _, _, b, e in piece_codec.fields(model) if n != 3)
    own = ["<sep>", "<sep>>", "ab c", "漢字x"]
    pieces = b"".join(piece_codec.encoded_field(1, piece_codec.encoded_field(1, x.encode()) + piece_codec.encoded_field(3, 4)) for x in own)
    blob = double_array([(k.encode(), v.encode()) for k, v in {"ﬁ": "fi", "\t": " ", "A": "a", "AB": "x", "é": "é", "…": " . ", "\u200b": "", "s": "ſ", "<": "[", "漢": "han", "  ": "__"}.items()])
    spec = piece_codec.encoded_field(2, blob) + piece_codec.encoded_field(3, dummy) + piece_codec.encoded_field(4, squeeze) + piece_codec.encoded_field(5, 1)
    tool = piece_codec.PieceCodec(bare + pieces + piece_codec.encoded_field(3, spec))
    rng = random.Random(squeeze * 2 + dummy)
    bits = [*own, "ﬁ", "\t", "A", "AB", "é", "e\u0301", "…", "\u200b", "s", "<", ">", "漢", "字", " ", "  ", "a", "b c", "the ", "x", "😀", "\n", "▁"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        ids, begins, ends = tool.encode(text.encode(), ends=False)
        assert ids.tolist() == tool.full.encode(text), text
        assert tool.decode(ids) == tool.full.decode(ids.tolist()), text
        assert all(text.encode()[a:b].decode() is not None and a <= b for a, b in zip(begins.tolist(), ends.tolist(), strict=True))


def test_quality_learns_and_scores_everything(spark, hard_docs, hard_texts):
    rng = random.Random(3)
    good = [(i, prose(rng, 80)) for i in range(0, 400, 2)]
    bad = [(i, prose(rng, 80, ["!!", "###", "BUY", "$$$"]).upper()) for i in range(1, 400, 2)]
    docs = spark.createDataFrame(rows_of(good + bad), SCHEMA)
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (0, None), (0, 1)], "doc_id long, quality int")
    forest = quality_gbdt.fit(docs, labels, ~held_out("doc_id", 4, 2), trees=20)
    got = quality_gbdt.score(docs, forest).collect()
    assert sum(r.predicted == 1 - r.doc_id % 2 for r in got) > 390
    again = quality_gbdt.score(docs.repartition(5), quality_gbdt.fit(docs.repartition(7), labels, ~held_out("doc_id", 4, 2), trees=20)).collect()
    assert {r.doc_id: r.score for r in got} == {r.doc_id: r.score for r in again}
    every = quality_gbdt.score(hard_docs, forest).collect()
    assert len(every) == len(hard_texts) and all(0 <= r.score <= 1 for r in every)
    none = quality_gbdt.score(hard_docs, quality_gbdt.fit(hard_docs, labels.limit(0), F.lit(True))).collect()
    assert {r.score for r in none} == {0.5}


def walk(forest, x):
    """A forest's probability for one row of statistics, node by node."""
    total = forest.base
    for at in forest.roots.tolist():
        while forest.left[at] != at:
            at = int(forest.left[at] if x[forest.feature[at]] <= forest.threshold[at] else forest.right[at])
        total += forest.value[at]
    return 1 / (1 + math.exp(-total))


def test_flat_trees_are_walked_as_trees():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + x[:, 1] ** 2 + rng.normal(size=400) > 1).astype(float)
    forest = quality_gbdt.fit_forest(x, y, trees=12, depth=3, least=10)
    asked = np.concatenate([x, rng.normal(size=(100, 5)) * 3, np.zeros((1, 5))])
    assert forest.score(asked).tolist() == pytest.approx([walk(forest, r) for r in asked])


def plain_tree(x, g, h, depth, least, l2, rate):
    """(feature, cut, left, right) or a value, by trying every feature and every cut between distinct values."""
    gain, best = 1e-9, None
    if depth and len(g) >= 2 * least:
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= cut
                n = int(left.sum())
                if min(n, len(g) - n) < least:
                    continue
                now = sum(g[s].sum() ** 2 / (h[s].sum() + l2) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + l2)
                if now > gain * (1 + 1e-9):
                    gain, best = now, (f, cut, left)
    if best is None:
        return rate * g.sum() / (h.sum() + l2)
    f, cut, left = best
    return f, cut, *(plain_tree(x[s], g[s], h[s], depth - 1, least, l2, rate) for s in (left, ~left))


def plain_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("seed", range(3))
def test_boosting_is_that_of_an_exhaustive_search(seed):
    """With a bin for each value, histograms find the splits that trying every cut finds."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, size=(150, 4)).astype(float)
    y = (x[:, 0] + x[:, 2] * x[:, 3] / 6 + rng.normal(size=150) * 3 > 12).astype(float)
    depth, least, l2, rate, trees = 3, 8, 1.0, 0.3, 5
    forest = quality_gbdt.fit_forest(x, y, trees=trees, depth=depth, least=least, l2=l2, rate=rate, bins=4096)
    margin = np.full(len(y), forest.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = plain_tree(x, y - p, p * (1 - p), depth, least, l2, rate)
        margin += [plain_value(tree, r) for r in x]
    assert forest.score(x).tolist() == pytest.approx((1 / (1 + np.exp(-margin))).tolist(), rel=1e-9)


def test_empty_tables(spark, no_docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert line_dedup.line_dedup(no_docs).count() == 0
    assert substring_fm.remove_repeats(no_docs).count() == 0
    assert wu_manber.find_items(no_docs, nothing).count() == 0
    assert simhash.simhash_dedup(no_docs).count() == 0
    assert lm_bloom.lm_score(no_docs, F.lit(True)).count() == 0
    assert piece_codec.encode_digests(no_docs, tokenizer_path(), keep=["doc_id"]).count() == 0
    assert quality_gbdt.score(no_docs, quality_gbdt.fit(no_docs, labels, F.lit(True))).count() == 0


def test_an_empty_benchmark_hits_nothing(spark, hard_docs):
    got = wu_manber.contamination(wu_manber.find_items(hard_docs, spark.createDataFrame([], "item_id long, text string")))
    assert got.filter("contaminated OR n_hit > 0 OR size(items) > 0").count() == 0


def test_word_hashes_do_not_depend_on_where_words_stand():
    rng = random.Random(9)
    one = lambda: "".join(rng.choice("abé漢") for _ in range(rng.choice([1, 3, 6, 8, 9, 16, 30, 64, 65, 200])))
    bodies = [" \t".join(one() for _ in range(rng.randint(0, 40))).encode() for _ in range(30)] + [b"", b" \n ", b" a", b"a ", b"b" * 5000]
    every = [w for b in bodies for w in b.split()]
    lanes, sizes = words.word_stream(bodies, words.new_key(), 2)
    assert sizes.tolist() == [len(b.split()) for b in bodies]
    by_word = {}
    for w, *h in zip(every, *(x.tolist() for x in lanes), strict=True):
        assert by_word.setdefault(w, h) == h
    for i in range(2):
        assert len({h[i] for h in by_word.values()}) == len(by_word)
    assert words.word_stream(bodies, words.KEY)[0][0].tolist() == words.word_stream(bodies, words.KEY, 2)[0][0].tolist()


def thue_morse(n, a, b):
    """Two words of n letters that every polynomial hash modulo 2^64 takes for one."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_words_that_simple_hashes_confuse(spark):
    """Such words are two in the counts, and windows that differ in one of them are no repeats."""
    rng = random.Random(4)
    texts = []
    for n in (1024, 2048, 4096):
        for one in thue_morse(n, "a", "b"):
            texts.append((len(texts), f"{prose(random.Random(n), 20)} {one} {prose(random.Random(n + 1), 20)}"))
    texts.append((len(texts), prose(rng, 50)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = substring_fm.remove_repeats(df).withColumn("removed", F.expr("aggregate(stretches, 0, (n, s) -> n + s.end - s.begin)")).collect()
    assert by_text(rows, "n_words", "removed", "kept_words") == want_rows(texts, brute.without_repeats([t for _, t in texts], 35))
    got = {r.doc_id: r for r in lm_bloom.lm_score(df, F.col("doc_id") % 2 == 0).collect()}
    want, n = brute.base_scores(texts, lambda i: i % 2 == 0)
    for (i, _), (tokens, known, score) in zip(texts, want, strict=True):
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (tokens, known, n) and got[i].base_score == pytest.approx(score)


def test_words_of_one_first_hash_are_told_apart(monkeypatch, spark):
    """All words share their first hash: the second half of the identity still gives exact counts."""
    import numpy as np

    plain = words.word_stream

    def same_first(bodies, key, lanes=1):
        found, sizes = plain(bodies, key, lanes)
        return [found[0] % np.uint64(3), *found[1:]], sizes

    monkeypatch.setattr(lm_bloom, "word_stream", same_first)
    rng = random.Random(5)
    texts = [(i, prose(rng, 30)) for i in range(10)]
    at, number = lm_bloom.distinct_words(np.array([5, 5, 1, 5], np.uint64), np.array([2, 1, 7, 2], np.uint64))
    assert at.tolist() == [2, 1, 0] and number.tolist() == [2, 1, 0, 2]
    got = lm_bloom.Stream.of([t.encode() for _, t in texts], words.KEY)
    assert len(got.names) == len({w for _, t in texts for w in brute.ascii_lower(t).split()}) + 1


def exact_bigrams(rows, learns, mu=4.0):
    """Scores by the smoothed formula with exact counts."""
    tokens = [[*re.findall(brute.SPACE, brute.ascii_lower(t or "")), None] for _, t in rows]
    trained = [ts for (i, _), ts in zip(rows, tokens, strict=True) if learns(i)]
    one, two = Counter(w for ts in trained for w in ts), Counter(p for ts in trained for p in zip([None, *ts], ts, strict=False))
    space = sum(one.values()) + 0.5 * (len(one) + 1)
    p1 = lambda w: (one[w] + 0.5) / space
    p2 = lambda v, w: (min(two[v, w], one[v]) + mu * p1(w)) / (one[v] + mu)
    return [sum(math.log10(p2(v, w)) for v, w in zip([None, *ts], ts, strict=False)) for ts in tokens]


def test_lm_scores_stay_near_exact_bigrams(spark):
    """Counts are quantised by steps of 1.5, so a count is off by a factor of sqrt(1.5) at most and a token's log10 probability
    by less than twice its logarithm (0.18); false positives of six hashes add little. Broadcast or not."""
    rng = random.Random(6)
    chain = lambda n: " ".join(f"w{i}" for i in (int(rng.paretovariate(0.6)) % 200 for _ in range(n)))
    texts = [(i, chain(rng.randint(5, 200))) for i in range(150)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    learns = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    want = exact_bigrams(texts, learns)
    need = lm_bloom.fit(df.filter(~held_out("doc_id", 5, 1)))[2].agg(F.sum("bits")).first()[0] // 8
    for most in (128 << 20, need // 50):
        got = {r.doc_id: r for r in lm_bloom.lm_score(df, ~held_out("doc_id", 5, 1), max_bytes=most, slice_bytes=need // 20).collect()}
        off = [abs(got[i].score - w) / got[i].n_tokens for (i, _), w in zip(texts, want, strict=True)]
        assert max(off) < 0.18 and sum(off) / len(off) < 0.06
