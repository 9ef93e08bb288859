"""A corpus pipeline of five stages; each is written as Parquet and read again by the next.

quality_classifier   keeps the documents that the classifier predicts to be good
line_dedup           takes out repeated lines, keeping each in the smallest doc_id that holds it
simhash_near_dedup   keeps one document, that of the smallest doc_id, of each group of near copies: texts whose sets of shingles
                     of five words overlap by 0.8 or more, and what they link; wide SimHashes propose, the sets decide
decontaminate        drops documents that benchmark windows cover in a twentieth of their words or more
sentencepiece        returns token counts and digests of the documents that are left

All but the last return the columns of documents; a stage that changes a text changes n_chars with it. Rows without a
doc_id can't be told apart, and so are no near copies of each other. Rows of one doc_id are one document: the near-dedup
stage keeps or drops them together. In every stage a null text is an empty one, a text of any length is worked on whole, in one
task, of equal documents the smallest doc_id stays, an empty table gives an empty table, and columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import line_dedup, piece_codec, quality_gbdt, simhash, wu_manber
from ravelin.llm.queries import tokenizer_path
from ravelin.llm.shared import free, held_out, materialise, release, table

#: The near-dedup stage's word shingles, and the similarity from which on a text is a near copy.
SHINGLE, SIMILARITY = 5, 0.8


def columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    forest = quality_gbdt.fit(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 4, 2))
    score, predicted = free(docs.columns, "score", "predicted")
    return quality_gbdt.score(docs, forest, out=(score, predicted)).filter(F.col(predicted) == 1).select(*columns(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept, lines, dropped = free(docs.columns, "kept", "lines", "dropped")
    cut = line_dedup.line_dedup(docs, out=(kept, lines, dropped))
    changed = F.col(dropped) > 0
    new = {"text": F.when(changed, F.col(kept)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(kept).cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumns(new).select(*columns(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = simhash.similar_components(docs, shingle=SHINGLE, similarity=SIMILARITY).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*columns(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    words, spans, items, hit, contaminated = free(docs.columns, "words", "spans", "items", "hit", "contaminated")
    found = wu_manber.find_items(docs, table(spark, sf_dir, "benchmark"), out=(words, spans, items))
    return wu_manber.contamination(found, words, spans, out=(hit, contaminated)).filter(~F.col(contaminated)).select(*columns(docs))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.encode_digests(docs.select("doc_id", "text"), tokenizer_path(), keep=["doc_id"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontaminate", decontaminate),
    ("sentencepiece", sentencepiece),
]
#: The stages hold a trained model and a tokenizer, which SQL can't express; a test compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if before is not None:  # what the stage before wrote has been read
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
