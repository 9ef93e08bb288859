"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are made from whole texts (bytes, words, lines). Trees are grown on the driver from at most `max_rows`
labelled rows, the rows with the smallest hash of their id: a documented, fixed bound on what is learned from; scoring
covers every row. A fitted model is a few flat arrays (feature, threshold, children, value), which workers walk for
a whole batch at a time with numpy.

Defined cases: a null text is empty and has a score; a very long text is measured whole, by the task that reads it; of splits
that gain the same the first statistic and bin is taken, so equal inputs give equal forests; several labels of one id all count; a label without an id or a
value counts for nothing; without any label every score is the prior 0.5; an empty table gives an empty table; other
columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_map, texts

FEATURES = (
    "log_bytes log_words log_lines upper lower digit space symbol stop_mark comma exclaim pipe high_byte word_mean word_sd word_max distinct_words distinct_lines "
    "line_mean line_sd upper_words marked_words top_word byte_entropy bracket hyphen".split()
)
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\n\r\x0b\x0c", "symbol": b"#$%&*+/=@\\^_~`", "stop_mark": b".?:;", "comma": b",",
    "exclaim": b"!", "pipe": b"|", "high_byte": bytes(range(128, 256)), "bracket": b"()[]{}<>", "hyphen": b"-",
}
_MASKS = np.array([[b in chars for b in range(256)] for chars in _CLASSES.values()], dtype=np.float64).T


def statistics(text: bytes) -> np.ndarray:
    """FEATURES of a text."""
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256).astype(np.float64)
    n = max(len(text), 1)
    share = dict(zip(_CLASSES, (counts @ _MASKS) / n, strict=True))
    words, lines = text.split(), text.split(b"\n")
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    spans = np.fromiter(map(len, lines), dtype=np.float64, count=len(lines))
    k = max(len(words), 1)
    firm = counts[counts > 0] / n
    common: dict[bytes, int] = {}
    for w in words:
        common[w] = common.get(w, 0) + 1
    share |= {
        "log_bytes": np.log1p(len(text)), "log_words": np.log1p(len(words)), "log_lines": np.log(len(lines)), "word_mean": sizes.mean(), "word_sd": sizes.std(), "word_max": sizes.max(),
        "distinct_words": len(common) / k, "distinct_lines": len(set(lines)) / len(lines), "line_mean": spans.mean(), "line_sd": spans.std(),
        "upper_words": sum(map(bytes.isupper, common)) / max(len(common), 1), "marked_words": sum(not w[-1:].isalpha() and w[-1] < 128 for w in common) / max(len(common), 1),
        "top_word": max(common.values(), default=0) / k, "byte_entropy": -(firm * np.log2(firm)).sum(),
    }
    return np.array([share[f] for f in FEATURES])


@dataclass
class Forest:
    """All trees in flat arrays; roots has each tree's first node. A leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 20, l2: float = 1.0) -> Forest:
    """Gradient-boosted trees on the logistic loss, split by histograms of binned statistics, grown level by level."""
    if not len(y):
        one = np.zeros(1, dtype=np.int64)
        return Forest(one, np.zeros(1), one, one, np.zeros(1), one, 0, 0.0)
    rows, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    prior = min(max(y.mean(), 1e-6), 1 - 1e-6)
    base = float(np.log(prior / (1 - prior)))
    margin = np.full(rows, base)
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots = []

    def add() -> int:
        at = len(nodes["feature"])
        for k, v in (("feature", 0), ("threshold", np.inf), ("left", at), ("right", at), ("value", 0.0)):
            nodes[k].append(v)
        return at

    offsets = np.arange(width) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        roots.append(add())
        level = {roots[-1]: np.arange(rows)}
        for d in range(depth + 1):
            following = {}
            for at, own in level.items():
                gs, hs = g[own].sum(), h[own].sum()
                nodes["value"][at] = rate * gs / (hs + l2)
                if d == depth or len(own) < 2 * least:
                    continue
                flat = (binned[own] + offsets).ravel()
                gl, hl, nl = (np.cumsum(np.bincount(flat, weights=w, minlength=width * bins).reshape(width, bins), axis=1)[:, :-1] for w in (np.repeat(g[own], width), np.repeat(h[own], width), None))
                gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                gain[(nl < least) | (len(own) - nl < least)] = 0
                f, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[f, b] <= 1e-9:
                    continue
                goes = binned[own, f] <= b
                nodes["feature"][at], nodes["threshold"][at] = int(f), float(cuts[f][b])
                nodes["left"][at], nodes["right"][at] = add(), add()
                following[nodes["left"][at]], following[nodes["right"][at]] = own[goes], own[~goes]
            for at in level:
                if nodes["left"][at] == at:
                    margin[level[at]] += nodes["value"][at]
            level = following
            if not level:
                break
    arrays = {k: np.array(v) for k, v in nodes.items()}
    return Forest(**arrays, roots=np.array(roots), depth=depth, base=base)


def fit(docs: DataFrame, labels: DataFrame, may_learn, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000, **how) -> Forest:
    """A forest from at most max_rows labelled rows for which may_learn (a Column over the id) holds."""
    order = lambda *more: [F.xxhash64(F.lit("sample"), "id"), "id", "y", *more]
    picked = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & may_learn).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    picked = picked.orderBy(*order()).limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")  # max_rows rows of two numbers

    def measure(batch: pa.RecordBatch) -> dict:
        return {"x": [statistics(t) for t in texts(batch)]}

    measured = arrow_map(rows, measure, T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))]), ["id", "y"])
    got = measured.orderBy(*order("x")).limit(max_rows).select(F.col("y").alias("__rv_y"), "x").toPandas()  # an id may stand in many rows
    got = got.assign(key=got["x"].map(tuple)).sort_values(["key", "__rv_y"]) if len(got) else got  # the same forest however rows arrive
    return fit_forest(np.array(got["x"].tolist()).reshape(-1, len(FEATURES)), got["__rv_y"].to_numpy(dtype=np.float64), **how)


def score(docs: DataFrame, forest: Forest, text_col: str = "text", threshold: float = 0.7, out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with the probability of label 1 and whether it reaches the threshold."""

    def run(batch: pa.RecordBatch) -> dict:
        found = forest.score(np.stack([statistics(t) for t in texts(batch, text_col)]))
        return {out[0]: pa.array(found), out[1]: pa.array((found >= threshold).astype(np.int32))}

    df = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in out])
    return arrow_map(df, run, T.StructType([T.StructField(out[0], T.DoubleType()), T.StructField(out[1], T.IntegerType())]), df.columns)
