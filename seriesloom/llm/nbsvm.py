"""Naive Bayes support vectors as a quality classifier.

Indicators of word n-grams are scaled by the log ratio of their smoothed counts in the
two classes; a linear model with hinge loss is fitted on them by dual coordinate
descent, and its margins are turned into probabilities by a sigmoid fitted on margins
of documents the model had not seen. Two kinds of words make n-grams: the lower-cased
word itself (single words), and its outline, such as ``Xx.`` or ``X!`` (one to three in
a row, with a mark where a word repeats the one before).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import Bounded, held_out, text_udf, training_rows

BITS = 20
#: At most so many labelled documents of each class are fitted on (smallest hashes of
#: their numbers). Every text is scored.
PER_CLASS = {0: 4000, 1: 4000}

_OUTLINE = bytearray(range(256))
_OUTLINE[ord("A"):ord("Z") + 1] = b"X" * 26
_OUTLINE[ord("a"):ord("z") + 1] = b"x" * 26
_OUTLINE[ord("0"):ord("9") + 1] = b"0" * 10
_OUTLINE[128:] = b"x" * 128
_OUTLINE = bytes(_OUTLINE)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def grams(text: str) -> set:
    """The distinct n-grams of a whole text."""
    raw = text.encode("utf-8", "replace")
    words = raw.translate(_LOWER).split()
    if not words:
        return set()
    flat = np.frombuffer(raw.translate(_OUTLINE), dtype=np.uint8)
    runs = np.concatenate(([True], flat[1:] != flat[:-1]))
    shapes = flat[runs].tobytes().split()
    shapes = [s[:16] + b"=" if a == b else s[:16] for s, a, b in zip(shapes, words, [b"", *words])]
    found = set(words)
    found.update(zip(shapes))
    found.update(zip(shapes, shapes[1:]))
    found.update(zip(shapes, shapes[1:], shapes[2:]))
    return found


def _slot(gram) -> int:
    key = gram if isinstance(gram, bytes) else b"\x00" + b" ".join(gram)
    return xxhash.xxh64_intdigest(key) & ((1 << BITS) - 1)


def slots(text: str) -> np.ndarray:
    return np.unique(np.fromiter(map(_slot, grams(text)), dtype=np.int32))


@dataclass
class Model:
    """Weight of each slot, bias, and the sigmoid of the margin."""

    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, margin: float) -> float:
        z = self.slope * margin + self.shift
        return float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))


def descend(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray,
            cost: np.ndarray, size: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of the hinge-loss model by dual coordinate descent; the last is the bias."""
    w = np.zeros(size + 1)
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i], values[i]
            g = sign[i] * (w[at] @ v + w[-1]) - 1.0
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[at] += step * v
                w[-1] += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def sigmoid_fit(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins, by Newton steps."""
    n1, n0 = float(weight[y == 1].sum()), float(weight[y == 0].sum())
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    def loss(a: float, b: float) -> float:
        z = a * margin + b
        return float(weight @ (np.logaddexp(0, z) - goal * z) + 5e-4 * a * a)

    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        r, h = weight * (p - goal), weight * np.maximum(p * (1 - p), 1e-9)
        g = np.array([r @ margin + 1e-3 * a, r.sum()])
        m = np.array([[h @ margin**2 + 1e-3, h @ margin], [h @ margin, h.sum() + 1e-3]])
        step = np.linalg.solve(m, g)
        size, now = 1.0, loss(a, b)
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(size * step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray, share: float, least: int = 3) -> Model:
    """``share``: the part of label 1 in all labelled rows, which the sample may not have."""
    size = 1 << BITS
    flat = np.zeros(size, np.float32)
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:
        p = (n1 + 1) / (n1 + n0 + 2)
        return Model(flat, 0.0, 1.0, float(np.log(p / (1 - p))))
    seen = np.zeros(size, np.int64)
    for at in rows:
        seen[at] += 1
    rows = [at[seen[at] >= least] for at in rows]
    sign = np.where(y == 1, 1.0, -1.0)

    def ratios(part: np.ndarray) -> np.ndarray:
        count = np.ones((2, size))
        for i in part:
            count[y[i], rows[i]] += 1
        return np.log(count[1] / (count[1][seen >= least].sum())) - np.log(
            count[0] / (count[0][seen >= least].sum()))

    def train(part: np.ndarray) -> np.ndarray:
        ratio = ratios(part)
        scaled = [ratio[rows[i]] / max(np.sqrt(len(rows[i])), 1.0) for i in part]
        balance = np.where(y[part] == 1, len(part) / 2 / max((y[part] == 1).sum(), 1),
                           len(part) / 2 / max((y[part] == 0).sum(), 1))
        w = descend([rows[i] for i in part], scaled, sign[part], balance, size)
        w[:-1] *= ratio
        return w

    def margin(w: np.ndarray, i: int) -> float:
        return float(w[rows[i]].sum() / max(np.sqrt(len(rows[i])), 1.0) + w[-1])

    folds = np.arange(len(rows)) % 3
    unseen = np.zeros(len(rows))
    for k in range(3):
        w = train(np.flatnonzero(folds != k))
        for i in np.flatnonzero(folds == k):
            unseen[i] = margin(w, i)
    weight = np.where(y == 1, share / n1, (1 - share) / n0) * len(rows)
    slope, shift = sigmoid_fit(unseen, y, weight)
    w = train(np.arange(len(rows)))
    # Rare slots have no say, so that ``margin`` may count known n-grams only.
    w[:-1][seen < least] = 0.0
    known = w[:-1].astype(np.float32)
    known[(seen >= least) & (known == 0)] = np.float32(1e-30)
    return Model(known, float(w[-1]), slope, shift)


def learn(
    documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: dict[int, int] = PER_CLASS,
    doc_id: str = "doc_id", text: str = "text",
) -> Model:
    """Fit on a bounded sample of the labelled documents that are not held out."""
    sample = training_rows(documents, labels, label, per_class, doc_id, text)
    made = text_udf(lambda: lambda t: (slots(t).tobytes(),), "s binary")
    got = sample.select("doc_id", "y", made("text").alias("f")).select("doc_id", "y", "f.s").toPandas()
    got = got.assign(s=got["s"].map(bytes)).sort_values(["doc_id", "s"], kind="stable")
    rows = [np.frombuffer(s, dtype=np.int32) for s in got["s"]]
    y = got["y"].to_numpy(dtype=int)
    known = labels.where(~held_out(F.col(doc_id)) & F.col(label).isin(0, 1)).agg(F.avg(label)).first()[0]
    share = min(max(known if known is not None else 0.5, 0.01), 0.99)
    return fit(rows, y, share)


def probability(model: Model):
    """Column function text -> probability of label 1; null counts as empty."""
    shared = {"model": model}

    def make():
        m = shared["model"]
        weigh = Bounded(lambda g: float(m.weight[_slot(g)]), longest=64)

        def one(t: str) -> tuple:
            found = [v for v in map(weigh.__getitem__, grams(t)) if v]
            return (m.probability(sum(found) / max(len(found), 1) ** 0.5 + m.bias),)

        return one

    return text_udf(make, "score double")


def score(
    docs: DataFrame, model: Model, threshold: float = 0.3,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row; no shuffle.

    The score depends on the text alone. Null and empty texts have no n-gram and get
    the score of the bias. Repeated rows are scored each. With labels of one class
    only, or none, every text gets that class's smoothed share.
    """
    made = docs.select(F.col(doc_id).alias("doc_id"), probability(model)(F.col(text))["score"].alias("score"))
    return made.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= F.lit(threshold)).cast("int").alias("predicted"),
    )
