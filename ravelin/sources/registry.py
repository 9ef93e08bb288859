"""Run registries: append-only JSON lines, first or last entry of an id, champions, and content keys."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines registry with the order in which its lines were appended."""
    return spark.read.schema(schema).json(path).withColumn("line", F.monotonically_increasing_id())


def first_entry(df: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in (key, order)]
    got = df.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("e"))
    return got.select(key, "e.*")


def last_entry(df: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in (key, order)]
    got = df.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("e"))
    return got.select(key, "e.*")


def append_entry(path: str, entry: dict) -> None:
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(entry, sort_keys=True) + "\n")


def content_key(config: dict, *parts: str) -> str:
    """A key that is the same for the same configuration, whatever the order of its entries."""
    text = json.dumps(config, sort_keys=True, separators=(",", ":")) + "\0" + "\0".join(parts)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def cached(spark: SparkSession, root: str, config: dict, build) -> DataFrame:
    """The frame that build() makes, kept under the key of its configuration in a folder that all workers share. It is written beside
    and renamed, so the folder is there whole or not at all; of two that build at once, the first one's stays."""
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    path = f"{root}/{content_key(config)}"
    where = paths(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(where):
        part = f"{root}/_part-{uuid.uuid4().hex}"
        try:
            build().write.parquet(part)
            if store.exists(where) or not store.rename(paths(part), where):
                if not store.exists(where):
                    raise OSError(f"{path} could not be written")
        finally:
            store.delete(paths(part), True)
    return spark.read.parquet(path)


def evict(spark: SparkSession, root: str, keep: list[dict]) -> list[str]:
    """Deletes what cached() holds under root for other configurations than those to keep; the keys that went."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    kept = {content_key(c) for c in keep}
    gone = [s.getPath().getName() for s in (store.listStatus(where) if store.exists(where) else []) if re.fullmatch("[0-9a-f]{16}", s.getPath().getName())]
    gone = sorted(k for k in gone if k not in kept)
    for k in gone:
        store.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where, k), True)
    return gone


def load_champion(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def save_champion(path: str, champion: dict) -> None:
    """Written beside and renamed, so a reader sees the old or the new one."""
    part = f"{path}.part"
    Path(part).write_text(json.dumps(champion, indent=1, sort_keys=True), encoding="utf-8")
    os.replace(part, path)


def new_champion(members: list[dict], rules: list[str]) -> dict:
    """Members share no configuration twice; bases are their distinct base models."""
    keys = [content_key(m) for m in members]
    if len(set(keys)) < len(keys):
        raise ValueError("a member stands in the list twice")
    return {"members": members, "rules": rules, "bases": sorted({m["base"] for m in members})}


def nearest_recipe(recipe: dict, others: list[dict]) -> int:
    """The index of the recipe that differs in fewest entries, the first if equal."""
    differing = lambda o: sum(recipe.get(k) != o.get(k) for k in recipe.keys() | o.keys())
    return min(range(len(others)), key=lambda i: (differing(others[i]), i))
