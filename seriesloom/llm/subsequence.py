"""Toxic text by a subsequence string kernel with Nyström landmarks.

Two strings are alike if they share subsequences: letters in order, with gaps, each gap
letter costing a factor. An insult with inserted characters therefore still resembles
the plain one. The kernel is worked out against a few landmark strings (Nyström), and a
linear support vector machine is trained in that space. Because a kernel value with a
landmark is a sum over the landmark's subsequences, the finished model folds into one
table with a weight for each subsequence, and scoring a string is a sum of look-ups.

Sentences are scored by their strings, and documents by their worst strings, weighed
against how many they hold. Labels mark documents, not sentences: strings are blamed
that begin or contain runs of letters typical of toxic documents, each as often as it
occurs in toxic and in clean ones. A toxic document without a typical run blames the
strings with the best smoothed log-odds; after each training round it blames only the
one that the kernel machine then finds worst (multiple-instance turns).
"""

from __future__ import annotations

import heapq
import itertools
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import held_out, text_udf, texts_udf, training_rows
from seriesloom.llm.nbsvm import descend

#: At most so many labelled documents of each class are fitted on (smallest hashes of
#: their numbers). Every text is scored.
PER_CLASS = {0: 4000, 1: 1500}
WORST = 5           # strings of a document that decide
LENGTH = 4          # letters of a subsequence
SPAN = 7            # letters it may stretch over, so up to three are skipped
DECAY = 0.6         # factor for each letter of a gap
LETTERS = 32        # 0 pads, 1-26 letters, 27-29 other scripts by hash, 30 word start, 31 digits
WINDOW = 24         # longer strings are read in windows of this length, half overlapping
LANDMARKS = 96
RARE = 256          # at most so many more for runs too rare to be typical
TAMPERED = 0.02     # weight of insults with an inserted letter, made up for training

_STEPS = [(0, *c) for c in itertools.combinations(range(1, SPAN), LENGTH - 1)]
_SIZE = LETTERS**LENGTH


#: Signs written in place of letters.
_STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}


class _Fold(dict):
    """Character -> folded character: lower case, no accents, signs removed."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code).lower()
        base = unicodedata.normalize("NFKD", c)[:1].lower()
        if c.isspace():
            out = " "
        elif base in _STANDS_FOR:
            out = _STANDS_FOR[base]
        elif "a" <= base <= "z":
            out = base
        elif base.isdigit():
            out = "9"
        elif c.isalpha():
            out = c[:1]
        else:
            out = None
        self[code] = out
        return out


_FOLD = _Fold()
_LOOSE = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")


def strings(text: str) -> set[str]:
    """The distinct folded words of a whole text; runs of single letters also joined."""
    folded = text.translate(_FOLD)
    found = set(folded.split())
    for run in _LOOSE.findall(folded):
        found.add(run.replace(" ", ""))
    return found


def windows(s: str) -> list[str]:
    """A string with its start marked, long ones in overlapping pieces."""
    s = "^" + s
    if len(s) <= WINDOW:
        return [s]
    return [s[i:i + WINDOW] for i in range(0, len(s) - WINDOW // 2, WINDOW // 2)]


class _Codes(dict):
    """Folded character -> character of its letter code."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c == " ":
            number = 0
        elif "a" <= c <= "z":
            number = code - 96
        else:
            number = 30 if c == "^" else 31 if c == "9" else 27 + code % 3
        self[code] = chr(number)
        return self[code]


_CODES = _Codes()


def matrix(items: list[str]) -> np.ndarray:
    """One row of letter codes per string, padded with zeros."""
    width = WINDOW + SPAN
    flat = "".join([s.ljust(width) for s in items]).translate(_CODES)
    return np.frombuffer(flat.encode("latin-1"), dtype=np.uint8).reshape(len(items), width).astype(np.int32)


def subsequences(letters: np.ndarray):
    """(codes, weights) of every gapped subsequence that begins at each place, step by step."""
    # Shorter strings of the batch need no longer rows.
    n = max(int((letters > 0).sum(1).max(initial=1)), 1)
    for step in _STEPS:
        code = np.zeros((letters.shape[0], n), dtype=np.int64)
        good = np.ones(code.shape, dtype=bool)
        for s in step:
            part = letters[:, s:s + n]
            code = code * LETTERS + part
            good &= part > 0
        yield code, good, DECAY ** (step[-1] - LENGTH + 1)


def features(items: list[str]) -> list[dict[int, float]]:
    """Sparse subsequence vector of each string, scaled by its own number of them."""
    letters = matrix(items)
    made: list[Counter] = [Counter() for _ in items]
    for code, good, weight in subsequences(letters):
        for i, j in zip(*np.nonzero(good)):
            made[i][int(code[i, j])] += weight
    return [{k: v / _scale(len(s)) for k, v in m.items()} for m, s in zip(made, items)]


def _scale(length: int) -> float:
    """The same for all strings of one length, so the scaled kernel is one as well."""
    total = sum(max(length - step[-1], 0) * DECAY ** (2 * (step[-1] - LENGTH + 1)) for step in _STEPS)
    return max(total, 1.0) ** 0.5


_SCALES = np.array([_scale(n) for n in range(WINDOW + 1)])


@dataclass
class Model:
    """Folded table of subsequence weights, its bias, and the document's logistic curve."""

    table: np.ndarray
    bias: float
    curve: np.ndarray

    def margins(self, items: list[str]) -> np.ndarray:
        """Decision value of each window, without padding it into more subsequences."""
        out = np.zeros(len(items))
        for lo in range(0, len(items), 20_000):
            part = items[lo:lo + 20_000]
            letters = matrix(part)
            total = np.zeros(len(part))
            for code, good, weight in subsequences(letters):
                total += weight * np.where(good, self.table[code], 0).sum(1)
            out[lo:lo + 20_000] = total / _SCALES[[len(s) for s in part]]
        return out + self.bias

    def probability(self, worst: list[float], strings: int) -> float:
        """Of a document from its worst margins and the number of its strings."""
        z = float(self.curve @ _facts(worst, strings))
        return float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))


def _facts(worst: list[float], strings: int) -> np.ndarray:
    """What the logistic curve sees: a one, worst, second and mean margin, number of strings."""
    t = [min(max(v, -1.0), 1.5) for v in [*worst, *[-1.0] * WORST][:WORST]]
    return np.array([1.0, t[0], t[1], sum(t[:3]) / 3, sum(t) / WORST, np.log1p(strings)])


def _constant(n1: int, n0: int) -> Model:
    p = (n1 + 1) / (n1 + n0 + 2)
    return Model(np.zeros(_SIZE, np.float32), 0.0, np.array([np.log(p / (1 - p)), 0, 0, 0, 0, 0]))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic curve, by Newton steps that never raise the loss."""
    hold = np.full(x.shape[1], ridge)
    hold[0] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(weight @ (np.logaddexp(0, z) - y * z) + hold @ w**2 / 2)

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        g = x.T @ (weight * (p - y)) + hold * w
        h = (x.T * (weight * np.maximum(p * (1 - p), 1e-9))) @ x + np.diag(hold)
        step, size, now = np.linalg.solve(h, g), 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def _runs(w: str) -> set[str]:
    """Beginnings of four to eight letters of a window, and its runs of four and six."""
    return {
        *(w[:k] for k in range(LENGTH, min(len(w), 9) + 1) if w[0] == "^"),
        *(w[i:i + k] for k in (LENGTH, 6) for i in range(1, len(w) - k + 1)),
    }


def _different(bags: list[set[str]]) -> list[int]:
    """Places of documents that do not nearly repeat an earlier one: copies prove nothing.

    Earlier documents with an equal triple of least hashes are compared whole: copies
    share four of five strings.
    """
    seen: dict[tuple, list[int]] = {}
    kept = []
    for i, bag in enumerate(bags):
        least = [min((xxhash.xxh64_intdigest(s, k) for s in bag), default=0) for k in range(12)]
        bands = [(k, *least[k:k + 3]) for k in range(0, 12, 3)]
        near = dict.fromkeys(j for band in bands for j in seen.get(band, ()))
        if not any(len(bag & bags[j]) >= 0.8 * len(bag | bags[j]) for j in near):
            kept.append(i)
            for band in bands:
                seen.setdefault(band, []).append(i)
    return kept


def _counted(bags: list[set[str]], y: np.ndarray) -> list[Counter]:
    """Clean and toxic documents by run of letters."""
    count = [Counter(), Counter()]
    for bag, mark in zip(bags, y):
        count[mark].update({g for s in bag for w in windows(s) for g in _runs(w)})
    return count


def _typical(count: list[Counter], n0: int, n1: int) -> dict[str, float]:
    """Runs of letters found in 2 % of toxic documents and four times as often as in clean ones."""
    value = {}
    for g, c in count[1].items():
        usual = (count[0][g] + 0.5) / n0
        surprise = (c - n1 * usual) / (n1 * usual + 1) ** 0.5
        if c >= max(3, 0.02 * n1) and c / n1 >= 4 * usual and surprise >= 5:
            value[g] = c / n1 * float(np.log(c / n1 / usual))
    best = sorted(value, key=lambda g: (-value[g], g))[:400]
    return {g: value[g] for g in best}


def _rare(bags: list[list[str]], count: list[Counter], n0: int, n1: int) -> dict[str, float]:
    """Runs that mark toxic documents in which none is typical: the best of two strings of each.

    Ranked by smoothed log-odds, and only where they are more than half of the toxic
    documents: a few without a typical run may be mislabelled. The evidence asked for is
    loosened, from runs of three documents to runs of one, until nine of ten have one.
    """
    if len(bags) <= n1 / 2:
        return {}
    odds = {}
    for words in bags:
        best = {}
        for w in words:
            for g in _runs(w):
                if g not in odds:
                    odds[g] = float(np.log((count[1][g] + 0.5) / (n1 + 1) * (n0 + 1) / (count[0][g] + 0.5)))
            best[w] = max(_runs(w), key=lambda g: (odds[g], count[1][g], len(g), g), default=None)
        top = sorted((w for w in best if best[w]), key=lambda w: (-odds[best[w]], -count[1][best[w]], w))[:2]
        for w in top:
            odds[best[w], "taken"] = odds[best[w]]
    taken = {g[0]: v for g, v in odds.items() if isinstance(g, tuple)}
    marked = [set().union(*map(_runs, words)) for words in bags]
    for least in (3, 2, 1):
        firm = {g: v for g, v in taken.items() if count[1][g] >= least and v >= np.log(4)}
        if sum(not firm.keys().isdisjoint(m) for m in marked) >= 0.9 * len(bags):
            return firm
    return taken


def _suspects(toxic: Counter, typical: dict[str, float], most: int) -> list[str]:
    """Landmarks: strings of toxic documents with the most typical runs, two for each run."""
    best = {w: max((g for g in _runs(w) if g in typical), key=lambda g: (typical[g], g), default="") for w in toxic}
    ranked = sorted((w for w in toxic if best[w]), key=lambda w: (-typical[best[w]], -toxic[w], w))
    taken, covered = [], Counter()
    for w in ranked:
        if covered[best[w]] < 2:
            taken.append(w)
            covered[best[w]] += 1
    return taken[:most]


def fit(bags: list[set[str]], y: np.ndarray, share: float, turns: int = 2, seed: int = 11) -> Model:
    """Train on documents given as sets of strings; ``share``: toxic part of all labelled rows."""
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:
        return _constant(n1, n0)
    every, marks = bags, y
    alone = _different(bags)
    bags, y = [bags[i] for i in alone], y[alone]
    d1, d0 = int((y == 1).sum()), int((y == 0).sum())
    count = _counted(bags, y)
    typical = _typical(count, max(d0, 1), max(d1, 1))
    toxic, plain = Counter(), Counter()
    for bag, mark in zip(bags, y):
        (toxic if mark else plain).update({w for s in bag for w in windows(s)})
    suspects = _suspects(toxic, typical, LANDMARKS // 2)
    cut_up = [sorted({w for s in bag for w in windows(s)}) for bag, mark in zip(bags, y) if mark]
    open_bags = [c for c in cut_up if all(typical.keys().isdisjoint(_runs(w)) for w in c)]
    rare = _rare(open_bags, count, d0, d1)
    suspects += [w for w in _suspects(Counter({w: toxic[w] for c in open_bags for w in c}), rare, RARE) if w not in suspects]
    if not suspects:
        return _constant(int(round(share * (n1 + n0))), n1 + n0 - int(round(share * (n1 + n0))))
    rng = np.random.default_rng(seed)
    # Clean landmarks: common strings, and those that most resemble the suspects.
    table = np.zeros(_SIZE, np.float32)
    for vector in features(suspects):
        for k, v in vector.items():
            table[k] = max(table[k], v)
    others = sorted(plain)
    likeness = Model(table, 0.0, np.zeros(6)).margins(others)
    hard = [others[i] for i in np.argsort(-likeness, kind="stable")[:2 * LANDMARKS]]
    common = [w for w, _ in sorted(plain.items(), key=lambda kv: (-kv[1], kv[0])) if len(w) >= LENGTH]
    landmarks = list(dict.fromkeys([*suspects, *common[:LANDMARKS // 6], *hard[:LANDMARKS // 3]]))
    vectors = features(landmarks)
    kernel = np.array([[sum(v * b.get(k, 0.0) for k, v in a.items()) for b in vectors] for a in vectors])
    size, turn = np.linalg.eigh(kernel)
    keep = size > 1e-3 * size.max()
    root = turn[:, keep] / np.sqrt(size[keep])

    def folded(weights: np.ndarray) -> np.ndarray:
        table = np.zeros(_SIZE)
        for part, vector in zip(root @ weights, vectors):
            for k, v in vector.items():
                table[k] += part * v
        return table.astype(np.float32)

    def mapped(items: list[str]) -> np.ndarray:
        """Nyström coordinates: kernel values with the landmarks times the root."""
        got = np.zeros((len(items), len(landmarks)))
        for j, vector in enumerate(vectors):
            table = np.zeros(_SIZE, np.float32)
            table[list(vector)] = list(vector.values())
            got[:, j] = Model(table, 0.0, np.zeros(6)).margins(items)
        return got @ root

    def tampered(word: str) -> list[str]:
        """The word with one letter put in between, at two places."""
        if not 3 < len(word) < WINDOW:
            return []
        return [word[:i] + "aeinorstx"[rng.integers(9)] + word[i:] for i in rng.choice(np.arange(2, len(word)), size=2)]

    # Blamed strings weigh by the toxic documents they are in; the others by the clean
    # ones, at the odds of the classes: strings with typical runs, common ones, those
    # like the suspects, and a draw.
    in_open = {w for c in open_bags for w in c}
    maybe = {w for w in in_open if not rare.keys().isdisjoint(_runs(w))}
    blamed = sorted(maybe | {w for w in toxic if not typical.keys().isdisjoint(_runs(w))})
    doubtful = [w for w in others if not typical.keys().isdisjoint(_runs(w))]
    drawn = [others[i] for i in rng.permutation(len(others))[:1500]]
    negative = list(dict.fromkeys([*common[:600], *doubtful[::max(1, len(doubtful) // 1500)], *hard, *drawn]))
    altered = [t for w in blamed[::max(1, len(blamed) // 300)] for t in tampered(w) if t not in plain]
    odds = int((y == 1).sum()) / max(int((y == 0).sum()), 1)
    x1, x0 = mapped(blamed + altered), mapped(negative)
    cost1 = np.r_[[10.0 * toxic[w] for w in blamed], [10.0 * TAMPERED] * len(altered)]
    raw = None
    for _ in range(turns + 1):
        if raw is not None and maybe:
            # Blame again: of each open document only the string that is worst now.
            margin = dict(zip(blamed, raw.margins(blamed).tolist()))
            worst_of = [max((w for w in c if w in maybe), key=lambda w: (margin[w], w), default=None) for c in open_bags]
            left = maybe - set(worst_of)
            stays = np.r_[[w not in left for w in blamed], np.ones(len(x1) - len(blamed), bool)]
            x1, cost1 = x1[stays], cost1[stays]
            blamed, maybe = [w for w in blamed if w not in left], maybe - left
        x = np.vstack([x1, x0])
        sign = np.r_[np.ones(len(x1)), -np.ones(len(x0))]
        cost = np.r_[cost1, [max(10.0 * odds * plain[w], 0.5) for w in negative]]
        every_slot = np.arange(x.shape[1])
        w = descend([every_slot] * len(x), list(x), sign, cost, x.shape[1], rounds=40, seed=seed)
        raw = Model(folded(w[:-1]), float(w[-1]), np.zeros(6))
        known = set(negative)
        worst = [others[i] for i in np.argsort(-raw.margins(others), kind="stable")[:400]]
        added = [w for w in worst if w not in known]
        negative += added
        x0 = np.vstack([x0, mapped(added)]) if added else x0
    need = sorted({s for bag in every for s in bag})
    cut = [windows(s) for s in need]
    value = raw.margins([w for c in cut for w in c])
    edges = np.r_[0, np.cumsum([len(c) for c in cut])[:-1]]
    memo = dict(zip(need, np.maximum.reduceat(value, edges).tolist() if need else []))
    facts = np.array([_facts(heapq.nlargest(WORST, [memo[s] for s in bag]), len(bag)) for bag in every])
    weight = np.where(marks == 1, share / n1, (1 - share) / n0) * len(every)
    raw.curve = logistic(facts, marks, weight)
    return raw


def learn(
    documents: DataFrame, labels: DataFrame, label: str = "toxic", per_class: dict[int, int] = PER_CLASS,
    doc_id: str = "doc_id", text: str = "text",
) -> Model:
    """Fit on a bounded sample of the labelled documents that are not held out."""
    sample = training_rows(documents, labels, label, per_class, doc_id, text)
    made = text_udf(lambda: lambda t: (" ".join(sorted(strings(t))),), "s string")
    got = sample.select("doc_id", "y", made("text").alias("f")).select("doc_id", "y", "f.s").toPandas()
    got = got.sort_values(["doc_id", "s"], kind="stable")
    known = labels.where(~held_out(F.col(doc_id)) & F.col(label).isin(0, 1)).agg(F.avg(label)).first()[0]
    share = min(max(known if known is not None else 0.5, 0.01), 0.99)
    return fit([set(s.split()) for s in got["s"]], got["y"].to_numpy(dtype=int), share)


def probability(model: Model):
    """Column function text -> probability of label 1; null counts as empty."""
    shared = {"model": model}

    def make():
        m = shared["model"]
        known: dict[str, float] = {}

        def several(texts: list[str]) -> list[tuple]:
            bags = [strings(t) for t in texts]
            fresh = sorted({s for bag in bags for s in bag if s not in known})
            cut = [windows(s) for s in fresh]
            value = m.margins([w for c in cut for w in c]).tolist()
            now, i = {}, 0
            for s, c in zip(fresh, cut):
                now[s] = max(value[i:i + len(c)])
                i += len(c)
            out = []
            for bag in bags:
                values = [now[s] if s in now else known[s] for s in bag]
                out.append((m.probability(heapq.nlargest(WORST, values), len(bag)),))
            if len(known) > 300_000:
                known.clear()
            known.update((s, v) for s, v in now.items() if len(s) <= WINDOW)
            return out

        return several

    return texts_udf(make, "score double")


def score(
    docs: DataFrame, model: Model, threshold: float = 0.5,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row; no shuffle.

    The score depends on the text alone. Null and empty texts hold no string and get
    the score of a document without one. Strings of any length are read whole, window by window.
    Repeated rows are scored each. With labels of one class only, or none, every text
    gets that class's smoothed share.
    """
    made = docs.select(F.col(doc_id).alias("doc_id"), probability(model)(F.col(text))["score"].alias("score"))
    return made.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= F.lit(threshold)).cast("int").alias("predicted"),
    )
