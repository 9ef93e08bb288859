"""Gradient-boosted trees on histograms, fitted by Spark: missing values have a bin and a learned side, trees grow leaf by leaf.

Features are put into bins once: quantiles for numbers, the most frequent values for categories, bin 0 for null and NaN, and the
frame of bins is written. A pass over it is one aggregate: each task adds up gradients by (slot, node, feature, bin), Spark
adds the tasks' sums, and the driver, which holds slots x open leaves x features x bins of them, picks the splits. Categories are
ordered by their mean gradient and split like numbers.

Growth is best first: the leaf that gains most is split next, until there are `leaves`. Passes needn't follow one by one: a
pass looks at the children of all leaves that may still be split, and the driver then goes as far as what it knows, so a tree
takes as many passes as it is deep and is the tree that splits one leaf at a time would give.

Several models are fitted in the same passes: a slot has its own target, weight (0: not in it), loss and seed. Blocks, airports,
seeds, and a classifier beside its regressor share the bins and the scans.

Gradients lie on a grid so coarse that their sums are exact in doubles: the same trees come out however rows are dealt out.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from math import ceil, floor, log, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialise, release

BINS = 255
#: Rows that a task works on at once.
CHUNK = 16_384


@dataclass(frozen=True)
class Slot:
    """One model: what it learns, and from which rows. Null targets and null or non-positive weights are not learned from; rows
    where `valid` holds are only reported on."""

    target: str
    weight: str | None = None
    loss: str = "squared"
    seed: int = 0
    valid: str | None = None


@dataclass(frozen=True)
class Params:
    numeric: Sequence[str] = ()
    categorical: Sequence[str] = ()
    rounds: int = 20
    rate: float = 0.2
    leaves: int = 15
    depth: int = 6
    bins: int = 64
    l2: float = 1.0
    least_rows: int = 20
    least_gain: float = 1e-9
    cat_smooth: float = 10.0
    row_share: float = 1.0
    feature_share: float = 1.0
    #: Rounds without a better valid loss after which a slot stops, 0 for never.
    patience: int = 0
    #: Rounds after which scores are written anew.
    keep: int = 8


@dataclass
class Binner:
    """Upper edges of numeric features' bins, and bins of categories; unseen categories share the last bin."""

    edges: list[np.ndarray]
    categories: list[dict[str, int]]

    def __call__(self, columns: Sequence[pd.Series]) -> np.ndarray:
        """(rows, features) of bins."""
        out = np.zeros((len(columns[0]) if columns else 0, len(columns)), dtype=np.uint8)
        for j, column in enumerate(columns):
            if j < len(self.edges):
                x = column.to_numpy(dtype=np.float64, na_value=np.nan)
                out[:, j] = np.where(np.isnan(x), 0, 1 + np.searchsorted(self.edges[j], x, side="left"))
            else:
                known = self.categories[j - len(self.edges)]
                code = column.map(known)
                out[:, j] = np.where(column.isna(), 0, code.fillna(len(known) + 1))
        return out


def bin_column(binner: Binner, p: Params) -> Column:
    """A frame's features as bytes, one for each bin."""

    def put(*columns: pd.Series) -> pd.Series:
        return pd.Series([x.tobytes() for x in binner(columns)])

    return F.pandas_udf(put, "binary")(*feature_columns(p))


def feature_columns(p: Params) -> list[Column]:
    return [F.col(c).cast("double") for c in p.numeric] + [F.col(c).cast("string") for c in p.categorical]


def fit_bins(df: DataFrame, p: Params, others: Sequence[DataFrame] = ()) -> Binner:
    """Edges are values themselves, from quantiles four times as fine as the bins, so that a feature of few values has a bin for
    each of them. Categories are those of df and of the others."""
    if not 2 < p.bins <= BINS:
        raise ValueError(f"bins must lie in 3..{BINS}")
    fine = [i / (4 * p.bins) for i in range(1, 4 * p.bins)]
    edges = []
    if p.numeric:
        x = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in p.numeric]
        found = df.agg(*[F.percentile_approx(v, fine, 20_000).alias(f"q{i}") for i, v in enumerate(x)]).first()
        for values in found:
            values = np.unique(np.array(values or [], dtype=np.float64))
            if len(values) > p.bins - 2:
                values = values[np.linspace(0, len(values) - 1, p.bins - 2).round().astype(int)]
            edges.append(values)
    categories = []
    for c in p.categorical:
        v = F.col(c).cast("string")
        rows = df.select(v.alias("v"))
        for other in others:
            rows = rows.unionByName(other.select(v.alias("v")))
        top = rows.filter("v IS NOT NULL").groupBy("v").count().orderBy(F.desc("count"), "v").limit(p.bins - 2).collect()
        categories.append({r["v"]: i + 1 for i, r in enumerate(sorted(top, key=lambda r: r["v"]))})
    return Binner(edges, categories)


@dataclass
class Tree:
    """Nodes in arrays: a leaf's feature is -1; `left` says for each bin whether it goes to the first child."""

    feature: list[int] = field(default_factory=lambda: [-1])
    left: list[np.ndarray | None] = field(default_factory=lambda: [None])
    children: list[tuple[int, int]] = field(default_factory=lambda: [(0, 0)])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, left: np.ndarray, values: tuple[float, float]) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.left[node], self.children[node] = feature, left, (a, a + 1)
        for v in values:
            self.feature.append(-1)
            self.left.append(None)
            self.children.append((0, 0))
            self.value.append(v)
        return a, a + 1

    def _fold(self, bins: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The entry of `own`, one for each node, of each row's leaf: from the leaves up, a choice between two columns at each split."""
        held: dict[int, np.ndarray] = {}
        for node in range(len(self.feature) - 1, -1, -1):  # children come after their parents
            if self.feature[node] >= 0:
                a, b = self.children[node]
                held[node] = np.where(self.left[node][bins[:, self.feature[node]]], held.pop(a, own[a]), held.pop(b, own[b]))
        return held[0] if held else np.full(len(bins), own[0])

    def node_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row, by arrays."""
        return self._fold(bins, np.arange(len(self.feature)))

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self._fold(bins, np.array(self.value))


@dataclass
class Split:
    gain: float
    feature: int
    left: np.ndarray
    values: tuple[float, float]


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, numeric: int, p: Params, allowed: np.ndarray) -> Split | None:
    """The split that gains most of a leaf with sums g, h, n by (feature, bin); ties go to the first feature and to the lowest cut.
    Missing values are tried on either side."""
    total_g, total_h = g[0].sum(), h[0].sum()
    score = lambda a, b: a * a / (b + p.l2)
    best = None
    for f in np.flatnonzero(allowed).tolist():
        here = np.arange(1, g.shape[1])
        if f >= numeric:
            here = here[n[f, 1:] > 0]
            here = here[np.argsort(g[f, here] / (h[f, here] + p.cat_smooth), kind="stable")]
        sums = [np.cumsum(x[f, here]) for x in (g, h, n)]
        rows = n[f].sum()
        for missing in (False, True) if n[f, 0] > 0 else (False,):
            gl, hl, nl = (s + (x[f, 0] if missing else 0) for s, x in zip(sums, (g, h, n), strict=True))
            fine = (nl >= p.least_rows) & (rows - nl >= p.least_rows) & (hl > 0) & (total_h - hl > 0)
            if not fine.any():
                continue
            gain = np.where(fine, score(gl, hl) + score(total_g - gl, total_h - hl) - score(total_g, total_h), -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > p.least_gain and (best is None or gain[k] > best.gain * (1 + 1e-12)):
                left = np.zeros(BINS + 1, dtype=bool)
                left[here[: k + 1]] = True
                left[0] = missing if n[f, 0] > 0 else nl[k] * 2 >= rows  # none seen: with the most
                best = Split(float(gain[k]), f, left, (-p.rate * gl[k] / (hl[k] + p.l2), -p.rate * (total_g - gl[k]) / (total_h - hl[k] + p.l2)))
    return best


class Growth:
    """One slot's tree on its way. `tree` has each split that a known leaf would get; `accepted` are those that best-first growth has
    come to, and a pass must look at the nodes in `asked` before it can go on."""

    def __init__(self, p: Params, numeric: int, allowed: np.ndarray) -> None:
        self.p, self.numeric, self.allowed = p, numeric, allowed
        self.tree, self.deep, self.known = Tree(), {0: 0}, {}
        self.asked, self.waiting = [0], [0]
        self.heap: list[tuple[float, int]] = []
        self.accepted: set[int] = set()
        self.leaves, self.done = 1, False

    def absorb(self, sums: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """The sums of what was asked for; then as many splits as follow from all that is known."""
        for node in self.asked:
            found = sums.get(node)
            if node == 0 and found is not None:
                self.tree.value[0] = -self.p.rate * found[0][0].sum() / (found[1][0].sum() + self.p.l2)
            split = self.known[node] = None if found is None else best_split(*found, self.numeric, self.p, self.allowed)
            if split:
                for child in self.tree.split(node, split.feature, split.left, split.values):
                    self.deep[child] = self.deep[node] + 1
        self.asked = []
        while not self.done:
            self.asked = [n for n in self.waiting if n not in self.known]
            if self.asked:  # and, in the same pass, what the next choices may need
                likely = [n for _, n in sorted(self.heap)[: self.p.leaves - self.leaves]]
                self.asked += [c for n in likely for c in self.tree.children[n] if c not in self.known and self.deep[c] < self.p.depth]
                return
            for n in self.waiting:
                if self.known[n]:
                    heapq.heappush(self.heap, (-self.known[n].gain, n))
            self.waiting = []
            if self.leaves < self.p.leaves and self.heap:
                _, node = heapq.heappop(self.heap)
                self.accepted.add(node)
                self.leaves += 1
                self.waiting = [c for c in self.tree.children[node] if self.deep[c] < self.p.depth] if self.leaves < self.p.leaves else []
            else:
                self.done = True

    def result(self) -> Tree:
        """The tree of the accepted splits."""
        out, todo = Tree(), [(0, 0)]
        out.value[0] = self.tree.value[0]
        while todo:
            old, new = todo.pop()
            if old in self.accepted:
                a, b = self.tree.children[old]
                at = out.split(new, self.tree.feature[old], self.tree.left[old], (self.tree.value[a], self.tree.value[b]))
                todo += [(a, at[0]), (b, at[1])]
        return out


def _gradients(loss: str, y: np.ndarray, w: np.ndarray, score: np.ndarray, grid: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gradient, hessian, loss) by row, on the grid."""
    if loss == "squared":
        g, h, own = w * (score - y), w, w * (score - y) ** 2
    else:
        q = 1 / (1 + np.exp(-score))
        g, h, own = w * (q - y), w * np.maximum(q * (1 - q), 1e-6), -w * (y * np.log(np.maximum(q, 1e-15)) + (1 - y) * np.log(np.maximum(1 - q, 1e-15)))
    return np.rint(g * grid) / grid, np.rint(h * grid) / grid, own


def _flat(column: pa.Array) -> np.ndarray:
    """A binary column's bytes, all rows' one after the other."""
    if column.null_count or not pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Models:
    """What `fit` returns: a model for each slot, over the same bins. `curve` has a slot's (round, loss, valid loss)."""

    binner: Binner
    params: Params
    slots: Sequence[Slot]
    base: list[float]
    trees: list[list[Tree]]
    curve: list[list[tuple[int, float, float | None]]]

    def column(self, slots: Sequence[int] | None = None) -> Column:
        """An array of the slots' predictions (probabilities for a logistic one)."""
        slots = list(range(len(self.slots))) if slots is None else list(slots)
        binner, base, trees, kinds = self.binner, self.base, self.trees, [s.loss for s in self.slots]

        def run(*columns: pd.Series) -> pd.Series:
            bins = binner(columns)
            out = np.empty((len(bins), len(slots)))
            for k, s in enumerate(slots):
                score = np.full(len(bins), base[s])
                for tree in trees[s]:
                    score += tree.predict(bins)
                out[:, k] = 1 / (1 + np.exp(-score)) if kinds[s] == "logistic" else score
            return pd.Series(list(out))

        return F.pandas_udf(run, "array<double>")(*feature_columns(self.params))

    def predict(self, df: DataFrame, out: str, slot: int = 0) -> DataFrame:
        return df.withColumn(out, self.column([slot])[0])


def fit(df: DataFrame, p: Params, slots: Sequence[Slot], report: Callable[[int, int, float, float | None], None] | None = None, binner: Binner | None = None) -> Models:
    """A model for each slot. report(slot, round, loss, valid loss) is called as rounds end, while the fit goes on."""
    binner, numeric = binner or fit_bins(df, p), len(p.numeric)
    features = numeric + len(p.categorical)
    names = list(dict.fromkeys(x for s in slots for x in (s.target, s.weight, s.valid) if x))
    number = F.xxhash64(*feature_columns(p))  # rows are drawn by their features
    rows = df.select(bin_column(binner, p).alias("__bins"), number.alias("__u"), *[F.col(x).cast("double").alias(f"s_{x}") for x in names])
    rows = materialise(rows.withColumn("__score", F.lit(None).cast("binary")), "bins")
    cores = df.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:  # a table of a few MB would be a task or two in every pass
        dealt = materialise(rows.repartition(cores), "bins")
        release(rows)
        rows = dealt

    def used(s: Slot) -> Column:
        y, w = F.col(f"s_{s.target}"), F.col(f"s_{s.weight}") if s.weight else F.lit(1.0)
        ok = y.isNotNull() & ~F.isnan(y) & (w > 0)
        return ok & ~F.coalesce(F.col(f"s_{s.valid}") > 0, F.lit(False)) if s.valid else ok

    aggs = []
    for s in slots:
        y, w, own = F.col(f"s_{s.target}"), F.col(f"s_{s.weight}") if s.weight else F.lit(1.0), used(s)
        aggs += [F.sum(F.when(own, w)), F.sum(F.when(own, w * y)), F.max(F.when(own, F.abs(y))), F.max(F.when(own, w)), F.count(F.when(own, 1))]
    first = rows.agg(*aggs).first()
    base, grids = [], []
    for i, s in enumerate(slots):
        w, wy, most, heaviest, n = first[5 * i : 5 * i + 5]
        mean = float(f"{wy / w:.9g}") if w else 0.0  # Spark's sums differ in the last digits
        base.append(mean if s.loss == "squared" else log(max(mean, 1e-6) / max(1 - mean, 1e-6)) if w else 0.0)
        bound = (8 * max(most or 0.0, 1e-9) if s.loss == "squared" else 1.0) * max(heaviest or 1.0, 1e-9) * max(n, 1)
        grids.append(2.0 ** floor(52 - log2(max(bound, (heaviest or 1.0) * max(n, 1)))))
    models = Models(binner, p, slots, base, [[] for _ in slots], [[] for _ in slots])
    open_, best, since = set(range(len(slots))), [np.inf] * len(slots), [0] * len(slots)
    written = [0] * len(slots)  # trees that the written scores hold

    def held_scores(part: pa.RecordBatch) -> np.ndarray:
        held = part.column("__score")
        if held.null_count:
            return np.tile(np.array(base), (part.num_rows, 1))
        return _flat(held).view("<f8").reshape(part.num_rows, len(slots)).copy()

    def add(score: np.ndarray, bins: np.ndarray, trees: list[Tree]) -> np.ndarray:
        for tree in trees:
            score = score + tree.predict(bins)
        return score

    def parts(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                part = batch.slice(i, CHUNK)
                yield part, np.asfortranarray(_flat(part.column("__bins")).reshape(part.num_rows, features))

    def values(batch: pa.RecordBatch, name: str | None, default: float) -> np.ndarray:
        return np.full(batch.num_rows, default) if name is None else batch.column(f"s_{name}").to_numpy(zero_copy_only=False).astype(np.float64)

    def looked(asked: dict[int, tuple[Tree, list[int]]], trees: list[list[Tree]], round_: int) -> dict:
        """One pass: {(slot, node): sums}, and {slot: (loss, weight, valid loss, valid weight)}."""
        width = p.bins + 1

        def run(batches):
            held = {s: np.zeros((3, len(nodes) * features * width)) for s, (_, nodes) in asked.items()}
            losses = {s: np.zeros(4) for s in asked}
            for batch, bins in parts(batches):
                score, columns = held_scores(batch), {}
                for x in {x for s in asked for x in (slots[s].target, slots[s].weight, slots[s].valid)}:
                    columns[x] = None if x is None else values(batch, x, 0.0)
                for s, (tree, nodes) in asked.items():
                    slot = slots[s]
                    y, w = columns[slot.target], np.ones(batch.num_rows) if slot.weight is None else columns[slot.weight]
                    with np.errstate(invalid="ignore"):
                        own = np.flatnonzero(~np.isnan(y) & (w > 0))  # an airport's slot looks at its rows alone
                        test = np.zeros(len(own), dtype=bool) if slot.valid is None else columns[slot.valid][own] > 0
                    mine = bins if len(own) == len(y) else np.asfortranarray(bins[own])
                    g, h, loss = _gradients(slot.loss, y[own], w[own], add(score[own, s], mine, trees[s]), grids[s])
                    losses[s] += [loss[~test].sum(), w[own][~test].sum(), loss[test].sum(), w[own][test].sum()]
                    ok = ~test
                    if p.row_share < 1:
                        draw = _mix(batch.column("__u").to_numpy().view(np.uint64)[own] ^ _mix(np.array([slot.seed * 1_000_003 + round_], dtype=np.uint64)))
                        ok &= draw < np.uint64(int(p.row_share * (2**64 - 1)))
                    place = np.full(len(tree.feature), -1)
                    place[nodes] = np.arange(len(nodes))
                    at = tree._fold(mine, place)
                    some = np.flatnonzero(ok & (at >= 0))
                    g, h, first = g[some], h[some], at[some] * (features * width)
                    for f in range(features):
                        cell = first + (f * width + mine[some, f].astype(np.int64))
                        for k, x in enumerate((g, h, None)):
                            held[s][k] += np.bincount(cell, x, minlength=held[s].shape[1])
            for s, sums in held.items():
                some = np.flatnonzero(sums[2])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), s)), pa.array(some), *[pa.array(sums[k][some]) for k in range(3)]], names=["slot", "cell", "g", "h", "n"])
                loss = losses[s]
                yield pa.RecordBatch.from_arrays([pa.array([s, s]), pa.array([-1, -2]), pa.array([loss[0], loss[2]]), pa.array([loss[1], loss[3]]), pa.array([0.0, 0.0])], names=["slot", "cell", "g", "h", "n"])

        sums = rows.mapInArrow(run, "slot long, cell long, g double, h double, n double").groupBy("slot", "cell").agg(*[F.sum(c).alias(c) for c in "ghn"])
        got = sums.toPandas()  # slots x open leaves x features x bins
        out, losses = {}, {}
        for s, own in got.groupby("slot"):
            loss = own[own["cell"] < 0].set_index("cell")
            losses[s] = (*loss.loc[-1, ["g", "h"]], *loss.loc[-2, ["g", "h"]])
            own, nodes = own[own["cell"] >= 0], asked[s][1]
            dense = np.zeros((3, len(nodes), features, width))
            dense.reshape(3, -1)[:, own["cell"].to_numpy()] = own[["g", "h", "n"]].to_numpy().T
            out |= {(s, node): tuple(dense[:, i]) for i, node in enumerate(nodes) if dense[2, i].any()}
        return out | {"loss": losses}

    def tell(losses: dict, round_: int) -> None:
        for s, (a, b, c, d) in losses.items():
            mean, held = a / b if b else float("nan"), c / d if d else None
            models.curve[s].append((round_, mean, held))
            if report:
                report(s, round_, mean, held)
            if p.patience and held is not None:
                since[s] = 0 if held < best[s] else since[s] + 1
                best[s] = min(best[s], held)
                if since[s] >= p.patience:
                    open_.discard(s)
                    models.trees[s] = models.trees[s][: len(models.trees[s]) - since[s]]

    for round_ in range(p.rounds + 1):
        growths = {}
        for s in sorted(open_):
            allowed = np.ones(features, dtype=bool)
            if p.feature_share < 1:
                order = np.random.default_rng([slots[s].seed, round_]).permutation(features)
                allowed = np.isin(np.arange(features), order[: max(1, ceil(p.feature_share * features))])
            growths[s] = Growth(p, numeric, allowed)
        pending = [t[written[s] :] for s, t in enumerate(models.trees)]
        last = round_ == p.rounds
        while live := {s: g for s, g in growths.items() if not g.done}:
            got = looked({s: (g.tree, g.asked) for s, g in live.items()}, pending, round_)
            if any(g.asked == [0] for g in live.values()):
                tell(got["loss"], round_)
            if last:
                break
            for s, g in live.items():
                if s not in open_:
                    del growths[s]
                    continue
                g.absorb({n: got[s, n] for n in g.asked if (s, n) in got})
        if last:
            break
        for s, g in growths.items():
            models.trees[s].append(g.result())
        if not open_:
            break
        if (round_ + 1) % p.keep == 0 and round_ + 1 < p.rounds:
            pending = [t[written[s] :] for s, t in enumerate(models.trees)]

            def write(batches, pending=pending):
                for batch, bins in parts(batches):
                    now = held_scores(batch)
                    for s, own in enumerate(pending):
                        now[:, s] = add(now[:, s], bins, own)
                    made = pa.array([x.tobytes() for x in now], pa.binary())
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=batch.schema.names)

            after = materialise(rows.mapInArrow(write, rows.schema), "bins")
            release(rows)
            rows, written = after, [len(t) for t in models.trees]
    release(rows)
    return models


@dataclass
class BinSums:
    """Counts and sums of a target by (part, feature, bin), and by part its squares' sum."""

    n: np.ndarray
    s: np.ndarray
    squares: np.ndarray


def bin_sums(df: DataFrame, p: Params, target: str, part: str, parts: int, binner: Binner) -> BinSums:
    """In one aggregate, whatever the number of features. `part` numbers rows 0 .. parts - 1; others, and rows of a null target in
    the sums, don't count."""
    features, width = len(p.numeric) + len(p.categorical), p.bins + 1
    rows = df.select(bin_column(binner, p).alias("bins"), F.col(target).cast("double").alias("y"), F.col(part).cast("int").alias("part")).filter(f"part BETWEEN 0 AND {parts - 1}")

    def run(batches):
        held, squares = np.zeros((2, parts * features * width)), np.zeros(parts)
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, features)
            y, own = batch.column("y").to_numpy(zero_copy_only=False), batch.column("part").to_numpy().astype(np.int64)
            y = np.nan_to_num(y.astype(np.float64))
            cell = ((own[:, None] * features + np.arange(features)) * width + bins).ravel()
            held[0] += np.bincount(cell, minlength=held.shape[1])
            held[1] += np.bincount(cell, np.repeat(y, features), minlength=held.shape[1])
            squares += np.bincount(own, y * y, minlength=parts)
        some = np.flatnonzero(held[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[0][some]), pa.array(held[1][some])], names=["cell", "n", "s"])
        yield pa.RecordBatch.from_arrays([pa.array(-1 - np.arange(parts)), pa.array(np.zeros(parts)), pa.array(squares)], names=["cell", "n", "s"])

    got = rows.mapInArrow(run, "cell long, n double, s double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toPandas()
    dense, squares = np.zeros((2, parts * features * width)), np.zeros(parts)
    cells = got[got["cell"] >= 0]
    dense[:, cells["cell"].to_numpy(dtype=np.int64)] = cells[["n", "s"]].to_numpy().T
    rest = got[got["cell"] < 0]
    squares[-1 - rest["cell"].to_numpy(dtype=np.int64)] = rest["s"].to_numpy()
    dense = dense.reshape(2, parts, features, width)
    return BinSums(dense[0], dense[1], squares)


def boost_on_bins(n: np.ndarray, s: np.ndarray, p: Params, numeric: bool = True) -> np.ndarray:
    """By bin, what a model of one feature predicts, from the feature's counts and sums alone: trees of one feature send a bin's rows
    the same way, so sums by bin are all that they need. The trees are those that `fit` grows on the rows."""
    total = n.sum()
    score, bins = np.full(len(n), s.sum() / total if total else 0.0), np.arange(len(n), dtype=np.uint8)[:, None]
    for _ in range(p.rounds if total else 0):
        g, growth = n * score - s, Growth(p, int(numeric), np.ones(1, dtype=bool))
        while not growth.done:
            node = growth.tree.node_of(bins)
            growth.absorb({k: tuple(np.where(node == k, x, 0.0)[None] for x in (g, n, n)) for k in growth.asked if (n[node == k] > 0).any()})
        score = score + growth.result().predict(bins)
    return score
