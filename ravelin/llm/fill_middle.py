"""Fill-in-the-middle: a text's middle is moved to its end, so that a model learns to fill it in.

Texts are cut by the tokenizers library's Split pre-tokenizer, whose matches of a pattern are isolated and come with their
code-point offsets; nothing is trained. The number of offsets is n, and the offsets at two ranks drawn from a hash of the id give
the slices. In the form `psm` prefix, suffix and middle follow each other, in `spm` suffix, prefix and middle, each
after its mark; a text that holds a mark stays plain, so the marks can be found again and the text can be restored.

A text is cut in stretches of `STRETCH` code points, each ending between two characters of which one is no letter, where no match
can reach across; so a very long text costs its offsets and one stretch's matches. One run of letters is one match, of any length.

Defined cases: a null text is an empty one, and plain; a null id is hashed as an empty one; rows with the same id have the same
draws; ties of the two cuts leave an empty middle; an empty table gives an empty one; other columns pass through.
"""

from __future__ import annotations

import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_map, free

PATTERN = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
STRETCH = 1 << 18
_OTHER = re.compile("[^A-Za-z]")


def draws(doc_id: int | None, seed: int = 1) -> list[int]:
    """Four numbers of 32 bits that depend on the id alone."""
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def splitter(pattern: str = PATTERN):
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(pattern), "isolated")


def starts(text: str, split) -> np.ndarray:
    """Where each match begins, in code points, and the text's length after the last."""
    out, at = [], 0
    while at < len(text):
        upto = at + STRETCH
        if upto < len(text) and (cut := _OTHER.search(text, upto)):
            upto = cut.start()
        elif upto < len(text):
            upto = len(text)
        part = text[at:upto]
        found = split.pre_tokenize_str(part)
        out.append(np.fromiter((s for _, (s, _) in found), dtype=np.int64, count=len(found)) + at)
        at += len(part)
    return np.concatenate([*out, [len(text)]])


def transform(text: str, doc_id: int | None, split, plain_from: int = 90, spm_below: int = 20) -> tuple[int, str, str, str, str]:
    """(n, form, prefix, middle, output)."""
    at = starts(text, split)
    n = len(at) - 1
    a, b, c, d = draws(doc_id)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or c % 100 >= plain_from:
        return n, "plain", "", "", text
    low, high = sorted((a % (n + 1), b % (n + 1)))
    prefix, middle, suffix = text[: at[low]], text[at[low] : at[high]], text[at[high] :]
    if d % 100 < spm_below:
        return n, "spm", prefix, middle, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", prefix, middle, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from, read back from output and form alone. No text holds a mark, and neither what stands
    before a mark nor what follows can make part of it one, so each is found from either side, by bytes."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)

    def parts(first: str, second: str) -> tuple[Column, Column]:
        return F.substring_index(F.substring_index(head, second, 1), first, -1), F.substring_index(head, second, -1)

    (prefix, suffix), (last, start) = parts(PREFIX, SUFFIX), parts(SUFFIX, PREFIX)
    return F.when(form == "plain", output).when(form == "spm", F.concat(start, middle, last)).otherwise(F.concat(prefix, middle, suffix))


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: tuple[str, ...] = ("n", "form", "prefix_chars", "middle_chars", "output")) -> DataFrame:
    """docs with the number of matches, the form, the lengths of prefix and middle (null where plain), and the output."""
    plain = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in out])
    schema = T.StructType([T.StructField(name, kind) for name, kind in zip(out, (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()), strict=True)])
    inner = free(plain.columns, "rv_id", "rv_text")
    named = plain.withColumns({inner[0]: F.col(f"`{id_col}`").cast("long"), inner[1]: F.coalesce(F.col(f"`{text_col}`"), F.lit(""))})

    def run(batch: pa.RecordBatch) -> dict:
        split, rows = splitter(), []
        for doc_id, text in zip(batch.column(inner[0]).to_pylist(), batch.column(inner[1]), strict=True):
            n, form, prefix, middle, output = transform(text.as_py(), doc_id, split)
            rows.append((n, form, *((None, None) if form == "plain" else (len(prefix), len(middle))), output))
        return dict(zip(out, map(list, zip(*rows, strict=True)) if rows else ([] for _ in out), strict=True))

    return arrow_map(named, run, schema, plain.columns)
