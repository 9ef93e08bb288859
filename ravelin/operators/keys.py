"""Composite keys, with the two meanings that a null in a key can have."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joint_key(columns: Sequence[str], null: str = "?") -> Column:
    """One text key; nulls stand together under a mark."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit(null)) for c in columns])


def strict_key(columns: Sequence[str]) -> Column:
    """One text key; null if any column is, so that it matches nothing."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return F.when(out, joint_key(columns))


def require_unique(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """df, with a check in its plan: running it fails where the key has a duplicate or a null. Rows meet by key, as in the join that
    follows, and no job runs before."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    held = df.groupBy(*keys).agg(F.count("*").alias("__n"), F.first(F.struct(F.lit(1).alias("__one"), *rest)).alias("__row"))
    bad = F.col("__n") > 1
    for k in keys:
        bad = bad | F.col(k).isNull()
    message = F.concat(F.lit(f"{keys} is not a key: "), F.to_json(F.struct(*keys)))
    row = F.when(bad, F.raise_error(message).cast(held.schema["__row"].dataType)).otherwise(F.col("__row"))
    # The key carries the check too, so that it holds whichever columns are read.
    first = F.when(F.isnull(row), F.lit(None)).otherwise(F.col(keys[0])).alias(keys[0])
    checked = held.select(first, *keys[1:], row.alias("__row"))
    return checked.select(*[F.col(f"__row.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def join_by_id(left: DataFrame, right: DataFrame, key: str, complete: bool = False) -> DataFrame:
    """Left join on an id that is unique on the right; with complete, every left row must have a match. What is not so fails as
    the join runs."""
    got = left.join(require_unique(right, key).withColumn("__there", F.lit(True)), key, "left")
    if not complete:
        return got.drop("__there")
    missing = F.raise_error(F.lit(f"rows of the left side have no match on {key}")).cast(got.schema[key].dataType)
    return got.withColumn(key, F.when(F.col("__there"), F.col(key)).otherwise(missing)).drop("__there")


def assemble(base: DataFrame, blocks: Sequence[DataFrame], key: str) -> DataFrame:
    """The base's rows with the columns of all blocks, joined by a unique id; a column that two of them have is an error."""
    seen = set(base.columns)
    for block in blocks:
        if twice := seen & {c for c in block.columns if c != key}:
            raise ValueError(f"columns stand in several blocks: {sorted(twice)}")
        seen |= set(block.columns)
        base = join_by_id(base, block, key)
    return base


def in_order(df: DataFrame, order: DataFrame, key: str, place: str) -> DataFrame:
    """df's rows of the ids that a list (key, place) names, with their places; an id that stands twice in either, or that df lacks,
    is an error. Sorting by the place, if a sink wants it, is the sink's."""
    return join_by_id(require_unique(order.select(key, place), key), df, key, complete=True)


def with_prefix(df: DataFrame, *prefixes: str) -> list[str]:
    """The columns of a family, which is named by its prefix."""
    return [c for c in df.columns if c.startswith(prefixes)]


def select_features(df: DataFrame, prefixes: Sequence[str], drop: Sequence[str] = (), require: Sequence[str] = ()) -> list[str]:
    """The columns of the families without those dropped; unknown or missing names are errors."""
    columns = with_prefix(df, *prefixes)
    for what, names in (("dropped", drop), ("required", require)):
        if unknown := [n for n in names if n not in columns]:
            raise KeyError(f"{what} columns are not there: {unknown}")
    return [c for c in columns if c not in drop]
