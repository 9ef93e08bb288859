"""Nearest neighbours by additive quantisation.

A vector is approximated by a sum of one codeword from each of several full-dimensional codebooks. Codebooks are fitted
on the driver to the residuals of a bounded sample (`sample` vectors, those with the smallest hash of their id); every
vector is encoded by beam search, which keeps the best `beam` partial sums at each codebook. A row stores its codes and
the squared norm of its approximation, so a query's score needs one table of query-codeword products and as many
look-ups as there are codebooks.

Encoded vectors are dealt into shards by a hash; a task holds one shard at a time (`shard_rows` vectors at most, as the hash
spreads them), and the queries, packed in blocks of `query_block`, are streamed past it. For each query it scores the shard,
takes a shortlist and reranks it with exact distances in double precision on the original vectors; a window then merges the
shards' lists. Nothing passes through the driver but the codebooks. A query's shortlists have `shortlist` vectors in all,
and four deviations more for what chance puts into one shard, so results hardly depend on the number of shards.

Equal vectors are one: each distinct vector is encoded once and carries its smallest ids, as many as a list can need,
so copies cost nothing and hide nobody. The work is that of all queries against all vectors; where queries are a fixed part
of the rows, it grows with their square.

Defined cases: vectors that are null, zero, of another length than most, or hold a null or non-finite component take no
part, as queries or candidates; rows with the same id and vector are one; fewer candidates than asked for are all
returned; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise, partitions


def squared_sum(x: np.ndarray) -> np.ndarray:
    """Sums of squares over the last axis, added from the left, so that a result does not depend on how rows are grouped."""
    out = np.zeros(x.shape[:-1])
    for j in range(x.shape[-1]):
        out += x[..., j] * x[..., j]
    return out


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            centres[n == 0] = x[rng.integers(0, len(x), int((n == 0).sum()))]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[a : a + 4096] @ centres.T - half, axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


@dataclass
class Codebooks:
    words: np.ndarray  # books x words x dimensions

    def encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        """Codes by beam search: at each codebook the best partial sums are kept."""
        books, k, dim = self.words.shape
        out = np.zeros((len(x), books), dtype=np.int16)
        for a in range(0, len(x), 512):
            part = x[a : a + 512]
            n = len(part)
            left = part[:, None, :].copy()  # residual of each beam
            codes = np.zeros((n, 1, 0), dtype=np.int16)
            for m in range(books):
                book = self.words[m]
                error = (left**2).sum(axis=2)[:, :, None] - 2 * (left @ book.T) + (book**2).sum(axis=1)
                flat = error.reshape(n, -1)
                kept = min(beam, flat.shape[1])
                best = np.argpartition(flat, kept - 1, axis=1)[:, :kept]
                source, word = best // k, best % k
                rows = np.arange(n)[:, None]
                codes = np.concatenate([codes[rows, source], word[:, :, None].astype(np.int16)], axis=2)
                left = left[rows, source] - book[word]
            out[a : a + 512] = codes[np.arange(n), (left**2).sum(axis=2).argmin(axis=1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum((self.words[m][codes[:, m]] for m in range(len(self.words))), np.zeros((len(codes), self.words.shape[2])))


def fit_codebooks(x: np.ndarray, books: int = 8, words: int = 256, rounds: int = 8, beam: int = 4, refits: int = 3, seed: int = 7) -> Codebooks:
    """Residual k-means for a start; then, `refits` times, codes by beam search and least squares for one book after another."""
    rng = np.random.default_rng(seed)
    left, found = x.copy(), []
    for _ in range(books):
        centres = k_means(left, words, rounds, rng)
        if len(centres) < words:
            centres = np.concatenate([centres, np.zeros((words - len(centres), x.shape[1]))])
        found.append(centres)
        left = left - centres[nearest(left, centres)]
    fitted = Codebooks(np.stack(found))
    for _ in range(refits):
        codes = fitted.encode(x, beam)
        rest = x - fitted.decode(codes)
        for m in [*range(books)] * 2:  # each word moves to the mean of what the other books leave of its vectors
            own, n = codes[:, m], np.bincount(codes[:, m], minlength=words)
            moved = np.zeros((words, x.shape[1]))
            np.add.at(moved, own, rest)
            moved /= np.maximum(n, 1)[:, None]
            fitted.words[m] += moved
            rest -= moved[own]
    return fitted


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector as doubles) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.filter(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def ann_search(
    df: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, sample: int = 20_000, shortlist: int = 1024, shard_rows: int = 1 << 18, query_block: int = 256,
    books: int = 16, words: int = 256, beam: int = 8,
) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found for the rows where is_query holds, by exact distance, ties to the smaller id."""
    spark = df.sparkSession
    out = "query_id long, rank int, id long, score double"
    base = usable(df, id_col, vector_col)
    sizes = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], out)
    dim = sizes[0].d
    base = base.filter(F.size("v") == dim)
    # Distinct vectors; -0.0 equals 0.0. k + 1 ids each: a query may be one of them.
    same = base.select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).distinct()
    keyed = same.withColumn("h", F.xxhash64("v"))
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)))
    firsts = lambda d, c: F.slice(F.array_sort(d), 1, c)
    rank = W.partitionBy("h", "v", "salt").orderBy("id")
    few = salted.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= k + 1)
    distinct = few.groupBy("h", "v").agg(firsts(F.collect_list("id"), k + 1).alias("ids")).select(F.col("ids")[0].alias("node"), "ids", "v")
    distinct = materialise(distinct, "distinct")
    rows = distinct.orderBy(F.xxhash64(F.lit("sample"), "node"), "node").limit(sample).select("v").toPandas()  # sample vectors
    fitted = fit_codebooks(np.array(rows["v"].tolist()).reshape(-1, dim), books=books, words=min(words, max(2, len(rows) // 4)))
    sent = spark.sparkContext.broadcast(fitted)
    kinds = pa.list_(pa.int16())

    def encode(batches):
        for b in batches:
            x = np.array(b.column("v").to_pylist()).reshape(-1, dim)
            codes = sent.value.encode(x, beam)
            norms = (sent.value.decode(codes) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes.tolist(), type=kinds), pa.array(norms)], names=["node", "ids", "v", "codes", "norm"])

    schema = T.StructType([*distinct.schema.fields, T.StructField("codes", T.ArrayType(T.ShortType())), T.StructField("norm", T.DoubleType())])
    n = distinct.count()
    shards = max(min(partitions(spark), n // 512), -(-n // shard_rows), 1)
    each = shortlist / shards
    take = max(k + 1, ceil(each + 4 * sqrt(each))) if shards > 1 else shortlist
    coded = distinct.repartition("node").mapInArrow(encode, schema)

    def pack(batches):
        for b in batches:
            for at in range(0, b.num_rows, query_block):
                part = b.slice(at, query_block)
                body = np.array(part.column("v").to_pylist(), dtype="<f8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([part.column("id").to_numpy().astype("<i8").tobytes()]), pa.array([body])], names=["names", "body"])

    asked = base.filter(is_query(F.col("id"))).distinct().mapInArrow(pack, "names binary, body binary")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "names", "body")
    dealt = coded.withColumns({"shard": F.pmod(F.xxhash64(F.lit("shard"), "node"), F.lit(shards)).cast("int"), "kind": F.lit(0)}).unionByName(asked, allowMissingColumns=True)
    dealt = dealt.select("shard", "kind", "node", "ids", "v", "codes", "norm", "names", "body")

    def search(batches):
        now, held, shard = None, [], None
        for b in batches:
            for part in _runs(b):
                which, kind = part.column("shard")[0].as_py(), part.column("kind")[0].as_py()
                if which != now:
                    now, held, shard = which, [], None
                if kind == 0:
                    held.append(part.select(["ids", "v", "codes", "norm"]))
                    continue
                if shard is None:
                    shard, held = Shard.of(held, dim), []
                for names, body in zip(part.column("names").to_pylist(), part.column("body").to_pylist(), strict=True):
                    yield shard.nearest(sent.value.words, np.frombuffer(names, "<i8"), np.frombuffer(body, "<f8").reshape(-1, dim), k, take)

    found = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "kind", "node").mapInArrow(search, "query_id long, id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _runs(batch: pa.RecordBatch):
    """A batch's rows by shard and kind, in which they come sorted."""
    if not batch.num_rows:
        return
    shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
    cuts = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


@dataclass
class Shard:
    """Some encoded vectors, by their smallest id, so that ties go to it."""

    ids: list[list[int]]
    x: np.ndarray
    codes: np.ndarray
    norm: np.ndarray

    @classmethod
    def of(cls, parts: list[pa.RecordBatch], dim: int) -> Shard:
        joined = lambda c: [x for p in parts for x in p.column(c).to_pylist()]
        flat = [p.column("v").flatten().to_numpy() for p in parts]
        codes = [p.column("codes").flatten().to_numpy().astype(np.int64).reshape(p.num_rows, -1) for p in parts]
        norm = np.array(joined("norm"), dtype=np.float32)
        return cls(joined("ids"), np.concatenate([np.zeros(0), *flat]).reshape(-1, dim), np.concatenate(codes) if codes else np.zeros((0, 0), np.int64), norm)

    def nearest(self, words: np.ndarray, names: np.ndarray, queries: np.ndarray, k: int, take: int) -> pa.RecordBatch:
        """(query_id, id, score) of each query's k nearest on the shortlist of the look-ups."""
        rows: tuple[list, list, list] = [], [], []
        tables = np.einsum("mkd,qd->qmk", words, queries).astype(np.float32)
        for name, q, table in zip(names.tolist(), queries, tables, strict=True):
            near = self.norm.copy()
            for m in range(self.codes.shape[1]):
                near -= 2 * table[m][self.codes[:, m]]
            short = np.flatnonzero(near <= np.partition(near, take - 1)[take - 1]) if take < len(near) else np.arange(len(near))
            exact = np.sqrt(squared_sum(self.x[short] - q))
            order = np.argsort(exact, kind="stable")[: k + 1].tolist()
            best = sorted((float(exact[o]), c) for o in order for c in self.ids[short[o]] if c != name)[:k]
            rows[0].extend([name] * len(best))
            rows[1].extend(c for _, c in best)
            rows[2].extend(s for s, _ in best)
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.float64())], names=["query_id", "id", "score"])
