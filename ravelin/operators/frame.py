"""A corrector's input: a prediction, blocks of columns by id, and what lies between the prediction and some of them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import assemble


def corrector_frame(base: DataFrame, blocks: Mapping[str, DataFrame], key: str, pred: str, against: Sequence[str] = (), without: Sequence[str] = (), require: Sequence[str] = (), save: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """base with each block's columns as block_column, and with column_less_pred for those in `against`. Columns in `without` are left
    out, whether they are there or not, as one list serves several frames; those in `require` must be there. Blocks are saved one
    by one, so that the joins' plan does not hold what makes them; a row that a block lacks has nulls."""
    named = [save(b.select(key, *[F.col(c).alias(f"{name}_{c}") for c in b.columns if c != key])) for name, b in blocks.items()]
    out = assemble(base, named, key)
    out = out.withColumns({f"{c}_less_pred": F.col(c) - F.col(pred) for c in against if c in out.columns})
    if missing := [c for c in require if c not in out.columns]:
        raise KeyError(f"columns that the frame lacks: {missing}")
    return out.drop(*without)
