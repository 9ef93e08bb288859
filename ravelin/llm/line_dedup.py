"""Line dedup: lines are exploded, keyed and hashed; a key that several documents hold stays in the first of them only.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. A key of `min_chars` code
points or more that `min_documents` different ids hold loses all its lines except in the smallest id that holds it.
Other lines stay in their order. Keys travel as 128-bit hashes; a document sends each of its keys once, and Spark adds
up before the shuffle, so a line that most documents share costs a row for each task.

Defined cases: a null text is one empty line; a very long text is cut whole, by one task, and its lines spread by their keys;
equal lines of one document stay or go together; rows with the same id count as one document, each row being cut on its
own; a row with a null id is left whole and counts for no key; an empty table gives an empty table; other columns pass
through, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_map, aside, materialise, texts

KEYS, DROPS = "keys", "drops"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 128-bit key of a line, or None where it is too short to count."""
    key = line.strip().lower()  # of bytes: ASCII only
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def repeated_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_documents: int = 2) -> DataFrame:
    """(id, drops): for each id the keys that a smaller id holds too, if enough ids hold them."""
    def explode(batch: pa.RecordBatch) -> dict:
        return {KEYS: [list({k for x in t.split(b"\n") if (k := line_key(x, min_chars))}) for t in texts(batch, text_col)]}

    lines = arrow_map(docs.filter(F.col(id_col).isNotNull()).select(id_col, text_col), explode, T.StructType([T.StructField(KEYS, T.ArrayType(T.BinaryType()))]), [id_col])
    lines = lines.select(id_col, F.explode(KEYS).alias("key"))
    if min_documents > 2:
        held = lines.distinct().groupBy("key").agg(F.min(id_col).alias("first"), F.count("*").alias("n")).filter(F.col("n") >= min_documents)
    else:
        held = lines.groupBy("key").agg(F.min(id_col).alias("first"), F.max(id_col).alias("last")).filter("first < last")
    held = materialise(held.select("key", "first"), "held")  # its own input of the join, so that a key many lines have can be split
    later = lines.join(held, "key").filter(F.col(id_col) > F.col("first"))
    return later.groupBy(id_col).agg(F.collect_set("key").alias(DROPS))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_documents: int = 2, out: tuple[str, str, str] = ("kept_text", "n_lines", "n_dropped")) -> DataFrame:
    """docs with the kept text, the lines before and the lines dropped, under the names in out."""
    plain, (id_col, text_col), passed = aside(docs, id_col, text_col, drop=out)
    drops = repeated_keys(plain, id_col, text_col, min_chars, min_documents)
    joined = plain.join(drops, id_col, "left").select(*plain.columns, DROPS)

    def rebuild(batch: pa.RecordBatch) -> dict:
        kept, before, gone = [], [], []
        for text, drop in zip(texts(batch, text_col), batch.column(DROPS).to_pylist(), strict=True):
            lines = text.split(b"\n")
            before.append(len(lines))
            if drop:
                drop = set(drop)
                lines = [x for x in lines if line_key(x, min_chars) not in drop]
                text = b"\n".join(lines)
            gone.append(before[-1] - len(lines))
            kept.append(text.decode("utf-8", "replace"))
        return dict(zip(out, (kept, before, gone), strict=True))

    schema = T.StructType([T.StructField(out[0], T.StringType()), T.StructField(out[1], T.LongType()), T.StructField(out[2], T.LongType())])
    return arrow_map(joined, rebuild, schema, plain.columns).select(*passed, *out)
