"""Gradient boosting of regression trees on histograms, for many labels over one table.

Features become bin numbers once, in a written table. Trees then grow best leaf first: the
rows' gradients are summed by leaf, feature and bin inside tasks and added up by one
aggregate, the smaller of two siblings is summed and the other is the parent less it, and the
driver, which holds histograms whose size only the settings bound, picks the splits. A pass
over the table serves every label at once, and works out beforehand the leaves that may
still be split, so a tree takes about as many passes as it is deep, not as it has leaves.

A leaf weighs ``-T(G) / (H + l2)``, where ``T`` draws the gradient sum towards zero by
``l1``; a split gains ``T(G)^2 / (H + l2)`` of its sides over the whole.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.session import materialize

#: Trees whose predictions are worked out anew in each pass, until they are written.
PENDING = 10


@dataclass(frozen=True)
class BoostConfig:
    """How trees grow: to ``depth``, to ``leaves``, or to whichever comes first."""

    trees: int = 100
    learning_rate: float = 0.1
    depth: int | None = 6
    leaves: int | None = None
    l2: float = 1.0
    l1: float = 0.0
    least_rows: int = 1
    rows: float = 1.0
    columns: float = 1.0
    patience: int | None = 10
    bins: int = 255
    seed: int = 42
    importance: str = "gain"

    def __post_init__(self) -> None:
        if self.depth is None and self.leaves is None:
            raise ValueError("a tree needs a depth or a number of leaves")
        if not 2 <= self.bins <= 255:
            raise ValueError(f"bins must be 2 to 255, got {self.bins}")


@dataclass(frozen=True)
class Task:
    """One label to fit; ``split`` names the column with train and val, None means all train."""

    label: str
    split: str | None = None


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from 64-bit hashes and a salt."""
    with np.errstate(over="ignore"):
        x = h.astype(np.uint64) + np.uint64(salt % 2**64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)) / float(2**53)


def _shrunk(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


@dataclass
class _Node:
    g: float
    h: float
    depth: int
    hist: np.ndarray | None = None
    split: tuple | None = None       # gain, feature, bin, g and h of the left side
    children: tuple[int, int] | None = None
    chosen: bool = False


@dataclass
class _Growing:
    """One tree of one label while it grows."""

    cfg: BoostConfig
    features: np.ndarray             # which features may be split
    nodes: list[_Node] = field(default_factory=list)
    wanted: list[int] = field(default_factory=lambda: [0])
    open: list = field(default_factory=list)
    leaves: int = 1

    @property
    def most(self) -> int:
        by_depth = 2**self.cfg.depth if self.cfg.depth is not None else 2**31
        return min(by_depth, self.cfg.leaves or by_depth)

    def _splittable(self, node: _Node) -> bool:
        return self.cfg.depth is None or node.depth < self.cfg.depth

    def _find(self, node: _Node) -> None:
        """The best split; of equal ones that of the first feature, at the lowest bin."""
        cfg = self.cfg
        g, h = np.cumsum(node.hist[0], axis=1), np.cumsum(node.hist[1], axis=1)
        node.g, node.h = float(g[0, -1]), float(h[0, -1])
        left_g, left_h = g[:, :-1], h[:, :-1]
        right_g, right_h = node.g - left_g, node.h - left_h
        ok = (left_h >= cfg.least_rows) & (right_h >= cfg.least_rows) & self.features[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (
                _shrunk(left_g, cfg.l1) ** 2 / (left_h + cfg.l2) + _shrunk(right_g, cfg.l1) ** 2 / (right_h + cfg.l2)
                - _shrunk(node.g, cfg.l1) ** 2 / (node.h + cfg.l2)
            )
        gain = np.where(ok, gain, -np.inf)
        if gain.size and np.isfinite(best := gain.max()) and best > 1e-9 * max(1.0, abs(node.g)):
            f, b = divmod(int(np.argmax(gain)), gain.shape[1])
            node.split = (float(best), f, b, float(left_g[f, b]), float(left_h[f, b]))

    def _offer(self, at: int) -> None:
        node = self.nodes[at]
        if node.split is not None and self._splittable(node):
            heapq.heappush(self.open, (-node.split[0], at))

    def _expand(self, at: int) -> None:
        node = self.nodes[at]
        _, _, _, g, h = node.split
        node.children = (len(self.nodes), len(self.nodes) + 1)
        self.nodes += [_Node(g, h, node.depth + 1), _Node(node.g - g, node.h - h, node.depth + 1)]

    def feed(self, sums: dict[int, np.ndarray]) -> bool:
        """Take the wanted histograms; True once the tree is done, else ``wanted`` is new."""
        if not self.nodes:
            self.nodes.append(_Node(0.0, 0.0, 0, sums.get(0)))
            if self.nodes[0].hist is None:
                return True
            self._find(self.nodes[0])
            self._offer(0)
        else:
            for node in self.nodes:
                if node.children and node.hist is not None:
                    self._share(node, sums)
        self.wanted = []
        while self.open and self.leaves < self.most:
            at = self.open[0][1]
            node = self.nodes[at]
            last = self.leaves + 1 == self.most
            deep = not self._splittable(self.nodes[node.children[0]]) if node.children else (
                self.cfg.depth is not None and node.depth + 1 >= self.cfg.depth)
            known = node.children is not None and self.nodes[node.children[0]].hist is not None
            if not (known or last or deep):
                break
            heapq.heappop(self.open)
            if node.children is None:
                self._expand(at)
            node.chosen = True
            self.leaves += 1
            for child in node.children:
                if self.nodes[child].hist is not None:
                    self._offer(child)
            node.hist = None
        else:
            return True
        # What may still be split: go on as if leaves of unknown sides had nothing below them.
        ahead, left = list(self.open), self.most - self.leaves
        while ahead and left:
            at = heapq.heappop(ahead)[1]
            node, left = self.nodes[at], left - 1
            if node.children is None:
                self._expand(at)
                a, b = (self.nodes[c] for c in node.children)
                if self._splittable(a):
                    self.wanted.append(node.children[0] if a.h <= b.h else node.children[1])
            for child in node.children:
                if (below := self.nodes[child]).split is not None and self._splittable(below):
                    heapq.heappush(ahead, (-below.split[0], child))
        return False

    def _share(self, node: _Node, sums: dict[int, np.ndarray]) -> None:
        a, b = node.children
        for mine, other in ((a, b), (b, a)):
            if mine in sums and self.nodes[mine].hist is None:
                self.nodes[mine].hist = sums[mine]
                self.nodes[other].hist = node.hist - sums[mine]
                for c in (a, b):
                    self._find(self.nodes[c])

    def inner(self) -> list[tuple[int, int, int, int, int]]:
        """(node, feature, bin, left, right) of all nodes with children, parents first."""
        return [(i, n.split[1], n.split[2], *n.children) for i, n in enumerate(self.nodes) if n.children]

    def finished(self, cuts: list[np.ndarray]) -> dict:
        """The chosen tree: inner nodes as in ``inner`` with cut and gain, and leaf values."""
        inner, values = [], {}
        for i, n in enumerate(self.nodes):
            if n.chosen:
                gain, f, b, _, _ = n.split
                inner.append((i, f, b, *n.children, float(cuts[f][b]), gain))
        ends = {c for row in inner for c in row[3:5]} - {row[0] for row in inner} or {0}
        for i in ends:
            n = self.nodes[i]
            weight = -float(_shrunk(n.g, self.cfg.l1)) / (n.h + self.cfg.l2) if n.h + self.cfg.l2 else 0.0
            values[i] = self.cfg.learning_rate * weight
        return {"inner": inner, "values": values}


def _routed(goes_left, n: int, inner) -> dict[int, np.ndarray]:
    """Row numbers by leaf: ``goes_left(rows, node)`` tells which of the rows go left."""
    rows = {0: np.arange(n)}
    for node in inner:
        at = rows.pop(node[0])
        left = goes_left(at, node)
        rows[node[3]], rows[node[4]] = at[left], at[~left]
    return rows


def _columns(batch: pa.RecordBatch, features: int, tasks: int):
    """(hashes, bins, labels, parts, predictions) of a batch of the binned table."""
    n = batch.num_rows
    flat = lambda name: batch.column(name).flatten().to_numpy().reshape(n, tasks)
    bins = np.frombuffer(b"".join(batch.column("x").to_pylist()), dtype=np.uint8).reshape(n, features)
    return batch.column("h").to_numpy(), bins, flat("y"), flat("s"), flat("p")


def _binned(df: DataFrame, inputs: list[str], tasks: list[Task], cuts: list[np.ndarray], means: list[float]) -> DataFrame:
    """(h, x, y, s, p): row hash, bins, labels, parts (1 train, 2 val) and predictions, written."""
    part = [
        F.when(F.col(t.label).isNull(), 0).when(F.lit(True) if t.split is None else F.col(t.split) == "train", 1)
        .when(F.lit(False) if t.split is None else F.col(t.split) == "val", 2).otherwise(0).cast("double")
        for t in tasks
    ]
    wide = df.select(
        F.xxhash64(*inputs, *[t.label for t in tasks]).alias("h"),
        F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in inputs]).alias("x"),
        F.array(*[F.coalesce(F.col(t.label).cast("double"), F.lit(0.0)) for t in tasks]).alias("y"),
        F.array(*part).alias("s"), F.array(*[F.lit(float(m)) for m in means]).alias("p"),
    ).where(F.exists("s", lambda s: s > 0))

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(cuts))
            bins = np.column_stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)]).astype(np.uint8)
            at = batch.schema.get_field_index("x")
            yield batch.set_column(at, "x", pa.array([r.tobytes() for r in bins], pa.binary()))

    kind = "h long, x binary, y array<double>, s array<double>, p array<double>"
    return materialize(wide.mapInArrow(run, kind), "binned")


def _added(x: np.ndarray, p: np.ndarray, trees: list[dict]) -> np.ndarray:
    for tree in trees:
        for leaf, rows in _routed(lambda at, n: x[at, n[1]] <= n[2], len(x), tree["inner"]).items():
            p[rows] += tree["values"][leaf]
    return p


def _pass(binned: DataFrame, features: int, bins: int, jobs: list[dict]) -> dict[tuple[int, int], np.ndarray]:
    """Sums by (task, node): of the wanted nodes gradients and rows by feature and bin; of
    node -1 the squared error and the number of the validation rows."""
    tasks = len(jobs)
    edges = np.arange(features) * bins

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}

        def add(key, value):
            sums[key] = sums[key] + value if key in sums else value

        for batch in batches:
            h, x, y, s, p = _columns(batch, features, tasks)
            for t, job in enumerate(jobs):
                if not job:
                    continue
                now = _added(x, p[:, t].copy(), job["pending"])
                train, val = s[:, t] == 1, s[:, t] == 2
                if job["error"]:
                    miss = (now - y[:, t])[val]
                    add((t, -1), np.array([float(miss @ miss), float(val.sum())]))
                if job["share"] < 1:
                    train &= _mixed(h, job["salt"]) < job["share"]
                g = now - y[:, t]
                for node, rows in _routed(lambda at, n: x[at, n[1]] <= n[2], len(x), job["inner"]).items():
                    if node not in job["wanted"]:
                        continue
                    rows = rows[train[rows]]
                    at = (x[rows] + edges).ravel()
                    size = features * bins
                    add((t, node), np.concatenate([
                        np.bincount(at, np.repeat(g[rows], features), size), np.bincount(at, minlength=size),
                    ]).astype(float))
        if sums:
            ends = np.cumsum([0, *(len(v) for v in sums.values())]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()),
                pa.ListArray.from_arrays(ends, np.concatenate(list(sums.values()))),
            ], names=["task", "node", "v"])

    made = binned.mapInArrow(run, "task int, node int, v array<double>")
    total = made.groupBy("task", "node").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("v")))).alias("v"))
    out = total.toArrow()
    values = [v.values.to_numpy() for v in out.column("v")]
    return {(t, n): v for t, n, v in zip(out.column("task").to_pylist(), out.column("node").to_pylist(), values)}


def _rewritten(binned: DataFrame, features: int, pending: list[list[dict]]) -> DataFrame:
    """The binned table with the pending trees added to its predictions."""

    def run(batches):
        for batch in batches:
            _, x, _, _, p = _columns(batch, features, len(pending))
            p = np.column_stack([_added(x, p[:, t].copy(), trees) for t, trees in enumerate(pending)])
            lists = pa.ListArray.from_arrays(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32), p.ravel())
            yield batch.set_column(batch.schema.get_field_index("p"), "p", lists)

    return materialize(binned.mapInArrow(run, binned.schema), "binned")


def _cuts(train: DataFrame, inputs: list[str], bins: int) -> list[np.ndarray]:
    """Per feature the values at which rows may be split: its quantiles, each once."""
    shares = [k / bins for k in range(1, bins)]
    row = train.agg(*[
        F.percentile_approx(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), shares, 10 * bins).alias(f"q{i}")
        for i, c in enumerate(inputs)
    ]).first()
    return [np.unique(np.array(q if q is not None else [], dtype=float)) for q in row]


def fit_many(df: DataFrame, inputs: list[str], tasks: list[Task], cfg: BoostConfig = BoostConfig()) -> list["BoostedModel"]:
    """A model for each task, over the columns ``inputs``, all fitted in the same passes.

    Rows without a label take no part; missing features are 0. With validation rows, a
    label stops once ``patience`` trees in a row have not lowered their squared error, and
    keeps the trees up to the least. Row and column samples go by hash. Labels without a
    train row get a model without trees that says 0.
    """
    train = [
        F.col(t.label).isNotNull() & (F.lit(True) if t.split is None else F.coalesce(F.col(t.split) == "train", F.lit(False)))
        for t in tasks
    ]
    means = df.agg(*[F.avg(F.when(c, F.col(t.label).cast("double"))).alias(f"m{i}") for i, (t, c) in enumerate(zip(tasks, train))]).first()
    means = [float(m or 0.0) for m in means]
    some = train[0]
    for c in train[1:]:
        some = some | c
    cuts = _cuts(df.where(some), inputs, cfg.bins)
    binned = _binned(df, inputs, tasks, cuts, means)
    m, width = len(inputs), max([len(c) for c in cuts], default=0) + 1
    done: list[list[dict]] = [[] for _ in tasks]
    pending: list[list[dict]] = [[] for _ in tasks]
    best = [(float("inf"), 0) for _ in tasks]
    growing: list[_Growing | None] = [None] * len(tasks)
    active = set(range(len(tasks)))

    def columns(tree: int) -> np.ndarray:
        number = max(1, round(cfg.columns * m))
        order = np.argsort(_mixed(np.arange(m), cfg.seed + 7919 * (tree + 1)), kind="stable")
        return np.isin(np.arange(m), order[:number])

    while active:
        jobs: list[dict] = [{} for _ in tasks]
        for t in active:
            fresh = growing[t] is None
            if fresh:
                growing[t] = _Growing(cfg, columns(len(done[t])))
            jobs[t] = {
                "pending": pending[t], "inner": growing[t].inner(), "wanted": set(growing[t].wanted),
                "error": fresh, "share": cfg.rows, "salt": cfg.seed + len(done[t]),
            }
        sums = _pass(binned, m, width, jobs)
        for t in sorted(active):
            error, n = sums.get((t, -1), (0.0, 0.0))
            if jobs[t]["error"] and n:
                if error < best[t][0]:
                    best[t] = (float(error), len(done[t]))
                if cfg.patience is not None and len(done[t]) - best[t][1] >= cfg.patience:
                    active.discard(t)
            if len(done[t]) >= cfg.trees:
                active.discard(t)
            if t not in active:
                continue
            hists = {node: v.reshape(2, m, width) for (task, node), v in sums.items() if task == t and node >= 0}
            if growing[t].feed(hists):
                tree = growing[t].finished(cuts) if growing[t].nodes[0].hist is not None or growing[t].leaves > 1 else None
                growing[t] = None
                if tree is None or not tree["inner"]:
                    active.discard(t)  # no split gains anything more
                    continue
                done[t].append(tree)
                pending[t].append(tree)
        if max(len(p) for p in pending) >= PENDING:
            binned = _rewritten(binned, m, pending)
            pending = [[] for _ in tasks]
    return [
        BoostedModel.of(means[t], done[t][: best[t][1]] if best[t][0] < float("inf") else done[t], m, cfg.importance)
        for t in range(len(tasks))
    ]


class BoostedModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted sum of trees as a pipeline stage."""

    trees = Param(Params._dummy(), "trees", "base value and trees, as JSON", TypeConverters.toString)
    importance = Param(Params._dummy(), "importance", "gain or split", TypeConverters.toString)

    @staticmethod
    def of(base: float, trees: list[dict], features: int, importance: str) -> "BoostedModel":
        model = BoostedModel()
        kept = [
            {"inner": [[i, f, l, r, cut, gain] for i, f, _, l, r, cut, gain in t["inner"]],
             "values": {str(k): v for k, v in t["values"].items()}} for t in trees
        ]
        return model._set(trees=json.dumps({"base": base, "features": features, "trees": kept}), importance=importance)

    def _read(self) -> dict:
        return json.loads(self.getOrDefault(self.trees))

    @property
    def numTrees(self) -> int:
        return len(self._read()["trees"])

    @property
    def featureImportances(self) -> DenseVector:
        """Of each feature the mean gain of its splits, or their number; parts of one."""
        made = self._read()
        gain, number = np.zeros(made["features"]), np.zeros(made["features"])
        for tree in made["trees"]:
            for _, f, _, _, _, g in tree["inner"]:
                gain[f] += g
                number[f] += 1
        value = gain / np.maximum(number, 1) if self.getOrDefault(self.importance) == "gain" else number
        return Vectors.dense(value / value.sum() if value.sum() else value)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        made = self._read()

        def score(rows: pd.Series) -> pd.Series:
            out = np.full(len(rows), made["base"])
            if len(rows):
                x = np.stack(rows.to_numpy())
                for tree in made["trees"]:
                    inner = [(i, f, cut, left, right) for i, f, left, right, cut, _ in tree["inner"]]
                    for leaf, at in _routed(lambda at, n: x[at, n[1]] <= n[2], len(x), inner).items():
                        out[at] += tree["values"][str(leaf)]
            return pd.Series(out)

        score = F.pandas_udf(score, "double")
        return dataset.withColumn(self.getPredictionCol(), score(vector_to_array(F.col(self.getFeaturesCol()))))
