"""Manifest, fill-in-the-middle and mixing against plain versions."""

import random
import re

import numpy as np
import pytest
from brute import SCHEMA, filled_middle, manifest, mix_targets, prose, rows_of
from pyspark.sql import functions as F

from ravelin.llm import fill_middle, merkle, mixing, radix
from ravelin.llm.queries import op11_merkle_manifest, op12_fill_middle, op13_mix_sources

ODD = "doc_id long, source string, lang string, n_chars long, text string, g long, rank string, n string, id string, key int, __n int, __cell int, form int, rv_id int"


def rows(n, rng, sources):
    out = []
    for i in range(n):
        text = rng.choice([None, "", "a\nb", prose(rng, rng.randint(1, 40)) + "\n" + prose(rng, 3), "é\n" * 3])
        out.append((rng.choice([None, i, i, i, -i, i << 40, 7]), rng.choice(sources), rng.choice([None, "en", "漢"]), rng.choice([None, 3, 10**12]), text))
    return out + out[:5] * 3


def odd(spark, data):
    return spark.createDataFrame([(*r, 1, "r", "n", "i", 1, 1, 1, 1, 1) for r in data], ODD).repartition(5)


@pytest.mark.parametrize(("n", "span", "fanout"), [(1, 6, 3), (4, 1, 3), (220, 2, 3), (220, 1, 2), (90, 6, 3)])
def test_manifest(spark, n, span, fanout):
    rng = random.Random(n)
    data = rows(n, rng, ["s", None, "", "é", "z", "s", "s"] if n > 4 else ["s"])
    tampered = [r if r[0] is None or r[0] % 2 else (*r[:4], r[4] and r[4].replace("\n", "")) for r in data]
    told = [F.regexp_replace("text", "\n", "") if c == "text" else F.col(c) for c in merkle.FIELDS]
    # The plain version reads id and source first, as the operator's fields do.
    got = merkle.manifest(odd(spark, data), fanout=fanout, span=span, claim=F.when(F.col("doc_id") % 2 == 0, merkle.leaf(told)))
    got = got.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("siblings")), merkle.fold(F.col("claim"), F.col("siblings"), F.col("places")))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(manifest(data, tampered, fanout), key=key)


def test_manifest_of_nothing_and_of_tampering(spark):
    assert merkle.manifest(odd(spark, [])).collect() == []
    data = [(i, "s", "en", 3, "a b" if i % 2 else "a\nb") for i in range(40)]
    got = merkle.manifest(odd(spark, data), claim=F.when(F.col("doc_id") == 6, F.lit("0" * 64)))
    got = {r["doc_id"]: r for r in got.withColumn("folded", merkle.fold(F.col("claim"), F.col("siblings"), F.col("places"))).collect()}
    assert {i for i, r in got.items() if r["folded"] != r["root"]} == {6}
    assert len({r["root"] for r in got.values()}) == 1


def test_running_sums(spark):
    rng = random.Random(3)
    ids = [rng.choice([None, 5, 5, 5, rng.randint(-300, 300), rng.randint(-(2**62), 2**62)]) for _ in range(400)]
    data = [(i % 3, x, (i * 7919) % 5) for i, x in enumerate(ids)]
    data = [(g, x, w if x != 5 else 2) for g, x, w in data]
    df = spark.createDataFrame([(g, x, w, w) for g, x, w in data], "g long, id long, w long, kept long").withColumn("key", F.concat(radix.long_bytes("id"), radix.long_bytes("w")))
    want = []
    for g in range(3):
        total = 0
        for x, w in sorted(((x, w) for h, x, w in data if h == g), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
            want.append((g, x, w, w, total))
            total += w
    key = lambda r: (r[0], r[4], r[2], str(r))
    for depth, most in ((None, 4096), (8, 4096), (9, 4), (1, 1)):
        got = radix.running_sums(df, "g", "key", "w", "at", depth, most).collect()
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key), (depth, most)


def test_value_ranks(spark):
    names = ["b", None, "", "a", "é", "z", "\U0001f600", "￿", "b"]
    df = spark.createDataFrame([(x,) for x in names], "s string")
    order = ["", "a", "b", "z", "é", "￿", "\U0001f600"]
    for first in (True, False):
        got = {r["s"]: r["k"] for r in radix.value_ranks(df, "s", "k", nulls_first=first).collect()}
        assert got == {s: i for i, s in enumerate([None, *order] if first else [*order, None])}


def test_fill_middle(spark, hard_texts, hard_docs):
    marked = [(100 + i, t) for i, t in enumerate(["a<P>b", "<S>", "x <M> y", "<", "<<P", "S><M", "<P", "a" * 50, "é" * 9, "\r\n\t", "\x00a", "KKſ"])]
    docs = spark.createDataFrame(rows_of([*hard_texts, *marked]), SCHEMA)
    got = fill_middle.fill_middle(docs.withColumns({"n": F.lit(1), "rv_text": F.lit("x")})).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    key = lambda r: tuple(map(str, r))
    want = [(i, *filled_middle(i, t), t or "") for i, t in [*hard_texts, *marked]]
    assert sorted(map(tuple, got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()), key=key) == sorted(want, key=key)
    assert {"rv_text", "text", "kept_text", "__rv_x"} < set(got.columns) and got.filter("rv_text <> 'x'").count() == 0
    many = [filled_middle(i, "one two three") for i in range(300)]
    assert {f for _, f, *_ in many} == {"plain", "psm", "spm"}
    plain = spark.createDataFrame(rows_of([(i, "one two three") for i in range(300)]), SCHEMA)
    assert [tuple(r) for r in fill_middle.fill_middle(plain).orderBy("doc_id").select("n", "form", "prefix_chars", "middle_chars", "output").collect()] == many


def test_fill_middle_cuts_long_texts_where_no_match_reaches_across(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice(["a", "Bc", "é", " ", "\n", "1", "zzzzzzzzzzzz", "<", "漢"]) for _ in range(3000))
    split = fill_middle.splitter()
    want = [m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)] + [len(text)]
    for stretch in (1, 2, 7, 64, 1 << 18):
        monkeypatch.setattr(fill_middle, "STRETCH", stretch)
        assert fill_middle.starts(text, split).tolist() == want
    assert fill_middle.starts("", split).tolist() == [0]
    assert fill_middle.starts("x" * 5000, split).tolist() == [0, 5000]


def test_fill_middle_of_nothing(no_docs):
    assert fill_middle.fill_middle(no_docs).collect() == []


def test_permuted_is_a_permutation():
    for size in (1, 2, 3, 5, 16, 17, 1000, 4097):
        for key in (0, 12345, 2**63):
            got = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, key, dtype=np.uint64))
            assert sorted(got.tolist()) == list(range(size))
    assert len({tuple(mixing.permuted(np.arange(50), np.full(50, 50), np.full(50, k, dtype=np.uint64)).tolist()) for k in range(9)}) == 9


def test_split_deals_out_whole_quotas():
    counts, caps = np.array([40, 0, 7, 900, 53]), np.array([100] * 9 + [60, 40])
    parts = [*mixing.split(counts, np.zeros(5, dtype=np.int64), caps, 0, 1, [1])]
    assert [lo for lo, *_ in parts] == list(range(11)) and [int(g.sum()) for _, _, g, _ in parts] == caps.tolist()
    assert sum(g for _, _, g, _ in parts).tolist() == counts.tolist()
    at = np.zeros(5, dtype=np.int64)
    for _, _, got, start in parts:  # draws follow each other
        assert start.tolist() == at.tolist()
        at = at + got
    means = np.mean([[g for _, _, g, _ in mixing.split(counts, np.zeros(5, dtype=np.int64), caps, 0, 1, [s])][9] for s in range(400)], axis=0)
    assert np.allclose(means, counts * 60 / 1000, atol=1.0)


def corpus(spark, rng, n, sources, words=60):
    texts = [(i, rng.choice(sources), rng.choice([None, "", " \n "] + [prose(rng, rng.randint(1, words)) for _ in range(9)])) for i in range(n)]
    texts += texts[:10]
    return texts, spark.createDataFrame([(*t, 1, "x", 2) for t in texts], "doc_id long, source string, text string, g int, size string, start int").repartition(6)


def check_mix(mixed, texts, weights, most, tolerance):
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    held = {}
    for _, s, t in texts:
        held[s] = held.get(s, 0) + size(t)
    want = mix_targets(held, weights, most)
    got = mixed.taken().join(mixed.sources.select("g", "source"), "g").collect()
    assert sorted((r["id"] is not None, r["id"] or 0, r["size"]) for r in got) == sorted((i is not None, i or 0, size(t)) for i, _, t in texts)
    taken = {}
    for r in got:
        assert r["source_size"] == held[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
        assert 0 <= r["taken"] <= most * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, target in want.items():
        assert abs(taken.get(s, 0) - target) <= max(2, tolerance * target), (s, taken.get(s, 0), target)


@pytest.mark.parametrize("sources", [["a", "b", "c", "hot", "hot", "hot", None], ["only"], [f"s{i}" for i in range(50)] + ["hot"] * 40])
def test_mix(spark, sources):
    texts, docs = corpus(spark, random.Random(len(sources)), 400, sources)
    mixed = mixing.mix_sources(docs, least=64, shard_blocks=100)
    check_mix(mixed, texts, (5, 2, 1), 3, 0.05)
    plan = mixed.plan.collect()
    quota = {r["g"]: (r["quota"], r["blocks"]) for r in mixed.sources.collect()}
    drawn = {}
    for r in plan:
        drawn.setdefault(r["g"], []).append((r["draw"], r["block"]))
    assert {g: len(x) for g, x in drawn.items()} == {g: q for g, (q, _) in quota.items() if q}
    for g, x in drawn.items():  # each draw once, and each epoch a permutation
        q, blocks = quota[g]
        assert sorted(d for d, _ in x) == list(range(q))
        for e in range(-(-q // blocks)):
            some = [b for d, b in x if d // blocks == e]
            assert len(set(some)) == len(some) and set(some) <= set(range(blocks))
    shards = {}
    for r in plan:
        shards.setdefault(r["shard"], []).append(r["place"])
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    again = mixing.mix_sources(docs.repartition(2).withColumn("more", F.lit(1)), least=64, shard_blocks=100)
    rows = lambda m: sorted(map(str, m.taken().select("id", "size", "taken").collect()))
    assert rows(again) == rows(mixed)
    assert sorted(map(str, again.plan.collect())) == sorted(map(str, plan))
    words = mixed.pieces().agg(F.sum(F.col("end") - F.col("begin")), F.min(F.col("end") - F.col("begin"))).first()
    assert words[0] == mixed.taken().agg(F.sum("taken")).first()[0] and words[1] > 0


def test_mix_in_families_and_stages(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAMILY", 7)
    monkeypatch.setattr(mixing, "FAN", 3)
    texts, docs = corpus(spark, random.Random(2), 300, [f"s{i}" for i in range(40)])
    mixed = mixing.mix_sources(docs, least=32, shard_blocks=60)
    check_mix(mixed, texts, (5, 2, 1), 3, 0.08)
    sizes = [r["count"] for r in mixed.plan.groupBy("shard").count().collect()]
    assert len(sizes) > 9 and max(sizes) - min(sizes) <= 1
    mixed.release()


def test_mix_of_nothing_and_of_no_words(spark):
    for data in ([], [(1, "a", None), (None, None, ""), (3, "a", " ")]):
        docs = spark.createDataFrame(data, "doc_id long, source string, text string")
        got = mixing.mix_sources(docs).taken().collect()
        assert len(got) == len(data) and all((r["size"], r["target"], r["taken"]) == (0, 0.0, 0) for r in got)


def test_word_count():
    for text in ("", " ", "a", " a ", "a b\x0bc\x1c d", "é x y\n", "a\x00b \r\n c"):
        assert mixing.word_count(text.encode()) == len(re.findall("[^\x20\x09-\x0d]+", text))


def test_queries_return_every_document(spark):
    for query in (op11_merkle_manifest, op12_fill_middle, op13_mix_sources):
        assert query(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
