"""The queries on the driver's small tables, and the pipeline against a brute-force version of its stages."""

import hashlib
import os

import duckdb
import pandas as pd
import pytest
import sentencepiece

import brute
import corpus_pipeline
from ravelin.llm import quality_gbdt
from ravelin.llm.queries import QUERIES, SQL, tokenizer_path
from ravelin.llm.shared import held_out

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = duck.execute(SQL[name]).df()
    assert sorted(want.columns) == cols
    key = lambda row: tuple("null" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row)
    assert sorted(key(r) for r in got.toPandas()[cols].astype(object).itertuples(index=False)) == sorted(key(r) for r in want[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name, table", [("op1_lm_score", "documents"), ("op4_quality", "documents"), ("op5_simhash", "documents"), ("op8_sentencepiece", "documents"), ("op10_decontaminate", "documents"), ("op7_main_text", "pages")])
def test_a_row_for_each_row(spark, duck, name, table):
    assert QUERIES[name](spark, DATA).count() == duck.execute(f"SELECT count(*) FROM {table}").fetchone()[0]


def test_chat_digests(spark, duck):
    rows = duck.execute("SELECT conv_id, role, coalesce(text, '') FROM conversations ORDER BY conv_id, turn").fetchall()
    rows += [(-1, "user", "</s>[INST] ok [/INST]"), (-1, "assistant", "</s>[INST] ok [/INST]")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in QUERIES["op6_chat_windows"](spark, DATA).collect():
        own = [(role, t) for c, role, t in rows if c == r.conv_id]
        loss = "".join(t for role, t in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), sha("".join(f"{a}\n{b}\n" for a, b in own)), len(loss), sha(loss))


def test_pipeline_is_its_stages_by_brute_force(spark, duck):
    docs = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    forest = quality_gbdt.fit(frame, spark.read.parquet(f"{DATA}/labels.parquet"), ~held_out("doc_id", 4, 2))
    docs = [(i, t) for i, t in docs if forest.score(quality_gbdt.statistics((t or "").encode())[None])[0] >= 0.7]
    docs = [(i, kept if n else t) for (i, t), (_, n, kept) in zip(docs, brute.deduped_lines(docs), strict=True)]
    comp = brute.similar_components(dict(docs), corpus_pipeline.SHINGLE, corpus_pipeline.SIMILARITY)
    docs = [(i, t) for i, t in docs if comp[i] == i]
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    docs = [(i, t) for (i, t), (n, hit, _) in zip(docs, brute.contamination([t for _, t in docs], items), strict=True) if not (hit and 20 * hit >= n)]
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    want = {}
    for i, t in docs:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want[i] = (len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "decontaminate", "sentencepiece"]


#: Names that operators and stages use themselves, or did.
INNER = "__rv_id __rv_drops __rv_row __rv_n __rv_at __rv_z __rv_a __rv_b __rv_spans __rv_x __rv_host keys drops u0 u1 u2 id y x fp set grams node seg way key side score predicted kept lines dropped words spans items hit contaminated g n rank digest claim start size block n_words kept_text a.b"


def test_columns_of_any_name_pass_through(spark, hard_docs):
    """Operators that pass columns on, and the stages, with a column of each inner name."""
    from pyspark.sql import functions as F

    from ravelin.llm import fill_middle, line_dedup, lm_bloom, piece_codec, quality_gbdt, substring_fm, wu_manber

    names = INNER.split()
    plain = hard_docs.select("doc_id", "text", "n_chars")
    docs = plain.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    forest = quality_gbdt.fit(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int"), F.lit(True))
    out = {
        "op1": lm_bloom.lm_score(docs, ~held_out("doc_id", 5, 1)), "op2": line_dedup.line_dedup(docs), "op4": quality_gbdt.score(docs, forest), "op9": substring_fm.remove_repeats(docs), "op12": fill_middle.fill_middle(docs),
        "op10": wu_manber.find_items(docs, items), "op8": piece_codec.encode_digests(docs.drop("text").withColumn("text", F.col("doc_id").cast("string")), tokenizer_path(), keep=["doc_id", *[f"{n}" for n in names if "." not in n]]),
        **{name: stage(spark, docs, DATA) for name, stage in corpus_pipeline.STAGES[1:-1]},
    }
    new = {"op1": {"score"}, "op2": {"kept_text", "n_lines", "n_dropped"}, "op4": {"score", "predicted"}, "op9": {"n_words"}, "op10": {"n_words", "spans", "items"}, "op12": {"n"}}
    for name, got in out.items():
        kept = [n for n in names if n in got.columns and n not in new.get(name, ())]
        assert name == "op8" or set(names) - set(got.columns) <= {"kept_text"}, name
        rows = got.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(kept)]).distinct().collect()
        assert [list(r) for r in rows] == [[f"own {n}" for n in kept]], name


@pytest.mark.parametrize("name", ["op2_line_dedup", "op9_substring_dedup", "op11_merkle_manifest", "op13_mix_sources"])
def test_the_shared_folder_is_empty_once_a_result_is_written(spark, tmp_path, name):
    from pathlib import Path

    from ravelin.sources import storage

    root = Path(storage.shared_root(spark).removeprefix("file://")) / "ravelin"
    before = set(root.glob("*"))
    with storage.scratch(spark):
        QUERIES[name](spark, DATA).write.parquet(f"{tmp_path}/out")
        assert set(root.glob("*")) - before  # frames that the query reads
    assert set(root.glob("*")) == before and spark.read.parquet(f"{tmp_path}/out").count() > 0


def test_an_id_in_many_rows_sends_no_more_rows_to_the_driver(spark):
    from pyspark.sql import functions as F

    docs = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    seen = []
    plain = quality_gbdt.fit_forest
    try:
        quality_gbdt.fit_forest = lambda x, y, **how: seen.append(len(y)) or plain(x, y, **how)
        quality_gbdt.fit(docs, labels, F.lit(True), max_rows=50)
    finally:
        quality_gbdt.fit_forest = plain
    assert seen == [50]


def test_stages_take_hard_documents(spark, hard_docs, no_docs):
    """Nulls, repeated rows, clashing names and an empty table pass through every stage."""
    for docs, some in ((hard_docs, True), (no_docs, False)):
        for _, stage in corpus_pipeline.STAGES[1:-1]:  # the classifier rejects these texts
            docs = stage(spark, docs, DATA)
            assert docs.columns == hard_docs.columns
        assert (docs.count() > 0) == some
        assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == docs.count()
        assert corpus_pipeline.STAGES[0][1](spark, docs, DATA).columns == hard_docs.columns
    dropped = corpus_pipeline.line_dedup_stage(spark, hard_docs, DATA).filter("n_chars <> length(text)").count()
    assert dropped == 0
