"""Language ID by multilingual mixture inference.

A document is a mixture: each of its words was drawn from one of the learned languages. The
likelihood of a word under a language comes from that language's letter n-grams, with
shorter contexts mixed in. Expectation-maximisation estimates the proportions of the
languages in the document. Sets of languages, the likeliest first and one more at a time,
compete by their likelihood less a penalty for each language beyond the first; the
document's language is the one with the largest proportion in the set that wins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import stored, text_udf

ORDER = 3             # letters of an n-gram, the word's ends count
PER_LANGUAGE = 2000   # learned documents of a language, at most: smallest hashes of their numbers
PIECE = 12            # letters of a word that are read as one draw; longer runs are cut
AT_ONCE = 4096        # words scored together
REMEMBERED = 1 << 17  # words or n-grams: more than ``AT_ONCE`` words hold
ROUNDS = 50
SETTLED = 1e-4
#: Log-likelihood that each language beyond the first must gain, times the log of the words.
PENALTY = 2.0
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> Counter:
    """Runs of letters, lower case, in pieces of at most ``PIECE``, with their counts."""
    found = Counter(_WORD.findall(text.lower()))
    long = [w for w in found if len(w) > PIECE]
    for w in long:
        n = found.pop(w)
        for i in range(0, len(w), PIECE):
            found[w[i:i + PIECE]] += n
    return found


def grams(word: str) -> list[str]:
    """N-grams of all orders that end at each letter and at the word's end."""
    padded = " " * (ORDER - 1) + word + " "
    return [padded[i - n + 1:i + 1] for i in range(ORDER - 1, len(padded)) for n in range(1, ORDER + 1)]


@dataclass(frozen=True)
class Model:
    """For each language, log-probabilities of a letter after its context, and the
    log-share that a context leaves to the next shorter one."""

    names: list[str]
    known: dict[str, np.ndarray]
    left: dict[str, np.ndarray]

    def after(self, gram: str) -> np.ndarray:
        """Log-probability of the last letter of an n-gram after the ones before it."""
        value = self.known[""]
        for n in range(1, len(gram) + 1):
            part = gram[-n:]
            row = self.known.get(part)
            value = row if row is not None else value + self.left.get(part[:-1], 0.0)
        return value


class Remembered:
    """Rows of numbers by key, worked out when first met; all go once there are ``REMEMBERED``."""

    def __init__(self, fn: Callable[[list[str]], np.ndarray], width: int) -> None:
        self.fn, self.rows, self.table = fn, {}, np.zeros((REMEMBERED, width))

    def of(self, keys: list[str]) -> np.ndarray:
        """One row for each key, of which there are fewer than ``REMEMBERED``."""
        new = set(keys).difference(self.rows)
        if len(self.rows) + len(new) > REMEMBERED:
            self.rows, new = {}, set(keys)
        if new:
            lo = len(self.rows)
            self.rows.update(zip(new, range(lo, lo + len(new))))
            self.table[lo:lo + len(new)] = self.fn(list(new))
        return self.table[np.fromiter(map(self.rows.__getitem__, keys), dtype=np.int64, count=len(keys))]


class Scorer:
    """Log-likelihoods of words under each language; words and n-grams are remembered."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.grams = Remembered(self._of_grams, len(model.names))
        self.words = Remembered(self._of_new, len(model.names))

    def of_words(self, found: list[str]) -> np.ndarray:
        """One row for each word."""
        return np.concatenate([self.words.of(found[lo:lo + AT_ONCE]) for lo in range(0, len(found), AT_ONCE)])

    def _of_new(self, found: list[str]) -> np.ndarray:
        before = " " * (ORDER - 1)
        chain = before + "".join(before + word + " " for word in found)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + ORDER
        values = self.grams.of([chain[i:i + ORDER] for i in range(len(chain) - ORDER + 1)])
        return np.add.reduceat(values, np.cumsum(sizes) - sizes, axis=0)

    def _of_grams(self, grams: list[str]) -> np.ndarray:
        # Two blanks at the end: a place between words.
        return np.array([
            np.zeros(len(self.model.names)) if g.endswith("  ") else self.model.after(g) for g in grams
        ])


def fitted(counts: dict[str, dict[str, int]]) -> Model:
    """A model from the n-gram counts of each language.

    Of an order, a context's seen letters share all but the part that goes to the next
    shorter context: as many as it has different letters, as one more observation each.
    """
    names = sorted(counts)
    grams_of = sorted({g for c in counts.values() for g in c}, key=lambda g: (len(g), g))
    index = {g: i for i, g in enumerate(grams_of)}
    n = np.array([[counts[name].get(g, 0) for name in names] for g in grams_of], dtype=float).reshape(len(grams_of), len(names))
    letters = max(1, sum(len(g) == 1 for g in grams_of))
    total: dict[str, np.ndarray] = {}
    kinds: dict[str, np.ndarray] = {}
    for g, i in index.items():
        total[g[:-1]] = total.get(g[:-1], 0) + n[i]
        kinds[g[:-1]] = kinds.get(g[:-1], 0) + (n[i] > 0)
    unseen = np.full(len(names), 1.0 / (letters + 1))
    p: dict[str, np.ndarray] = {"": unseen}
    for g, i in index.items():
        context = g[:-1]
        shorter = p.get(g[1:], unseen)
        p[g] = (n[i] + kinds[context] * shorter) / np.maximum(total[context] + kinds[context], 1e-9)
        p[g] = np.where(total[context] > 0, p[g], shorter)
    left = {
        c: np.log(np.where(total[c] > 0, kinds[c] / np.maximum(total[c] + kinds[c], 1e-9), 1.0)) for c in total
    }
    return Model(names, {g: np.log(v) for g, v in p.items()}, left)


def learn(
    documents: DataFrame, learned: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> Model:
    """A model from the documents for which ``learned`` holds and whose language is known.

    Of a language, at most ``per_language`` documents with the smallest hashes of number
    and text count, with their whole texts; tasks count their n-grams, and one row for each
    n-gram and language reaches the driver. Null texts count as empty.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    mark = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), body)
    known = documents.where(learned & F.col(lang).isNotNull())
    thin = stored(known.select(F.col(lang).cast("string").alias("lang"), mark.alias("h")), "marks")
    order = Window.partitionBy("lang").orderBy("h")
    ranked = thin.distinct().withColumn("at", F.row_number().over(order)).where(F.col("at") <= per_language)
    picked = ranked.select("lang", "h")
    texts = known.select(F.col(lang).cast("string").alias("lang"), mark.alias("h"), body.alias("text"))
    # At most ``per_language`` rows of two short columns for each language.
    texts = texts.join(F.broadcast(picked), ["lang", "h"])

    def count(batches):
        for batch in batches:
            found: dict[str, Counter] = {}
            for name, t in zip(batch["lang"], batch["text"]):
                mine = found.setdefault(name, Counter())
                for word, n in words(t).items():
                    for g in grams(word):
                        mine[g] += n
            rows = [(name, g, n) for name, c in found.items() for g, n in c.items()]
            yield pd.DataFrame(rows, columns=["lang", "gram", "n"])

    rows = texts.mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {r["lang"]: {} for r in thin.select("lang").distinct().collect()}
    for r in rows.toLocalIterator():
        counts[r["lang"]][r["gram"]] = r["n"]
    return fitted(counts)


def mixture(scores: np.ndarray, counts: np.ndarray, least: float = -np.inf) -> tuple[np.ndarray, float]:
    """(proportions, log-likelihood) of a document's words under all given languages.

    ``scores`` has the log-likelihood of each word under each language. By concavity no
    proportions reach more than the likelihood so far and the words' number times the log of
    the largest factor by which a proportion grows. Once that is at most ``least``, it is
    returned as the likelihood: the set cannot do better.
    """
    top = scores.max(1)
    like = np.exp(scores - top[:, None])
    share = np.full(scores.shape[1], 1.0 / scores.shape[1])
    total, base = counts.sum(), float(counts @ top)
    for _ in range(ROUNDS):
        sums = like @ share
        growth = (counts / sums) @ like / total
        limit = float(counts @ np.log(sums)) + base + total * np.log(growth.max())
        if limit <= least:
            return share, limit
        new = share * growth
        moved = np.abs(new - share).max()
        share = new
        if moved < SETTLED:
            break
    return share, float(counts @ np.log(np.maximum(like @ share, 1e-300))) + base


def infer(scores: np.ndarray, counts: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(languages, proportions) of the set with the best penalised likelihood, largest first."""
    penalty = PENALTY * np.log(counts.sum() + 1)
    alone = counts @ scores
    best = [int(np.argmax(alone))]
    shares, value = np.ones(1), float(alone[best[0]])
    if scores.shape[1] == 1:
        return best, shares
    # No set is likelier than all languages together.
    every, likelihood = mixture(scores, counts, value + penalty)
    if likelihood <= value + penalty:
        return best, shares
    order = [i for i in np.argsort(-every, kind="stable").tolist() if i != best[0]]
    tried = list(best)
    for i in order:
        tried = [*tried, i]
        least = value + penalty * (len(tried) - 1)
        share, likelihood = mixture(scores[:, tried], counts, least)
        if likelihood <= least:
            break
        value = likelihood - penalty * (len(tried) - 1)
        best, shares = tried, share
    ranks = sorted(range(len(best)), key=lambda k: (-shares[k], best[k]))
    return [best[k] for k in ranks], shares[ranks]


def predict(model: Model):
    """Function of a text column: (lang_pred, score, languages, shares)."""

    def make():
        scorer = Scorer(model)

        def one(text: str) -> tuple:
            found = words(text)
            if not found or not model.names:
                return UNDETERMINED, 0.0, [], []
            langs, shares = infer(scorer.of_words(list(found)), np.fromiter(found.values(), dtype=float, count=len(found)))
            names = [model.names[i] for i in langs]
            return names[0], min(1.0, max(0.0, float(shares[0]))), names, [float(x) for x in shares]

        return one

    return text_udf(make, "lang_pred string, score double, languages array<string>, shares array<double>")


def identify(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, languages, shares) per row of ``documents``.

    ``lang_pred`` has the largest proportion, ``score`` is that proportion; ``languages``
    and ``shares`` are the whole set, largest first. Null texts, texts without a letter,
    and all texts where nothing was learned are ``und`` with score 0 and no set. Texts of
    any length are read whole. Rows without a number and repeated rows are rows like any
    other; an empty table gives none. Other columns are not looked at.
    """
    made = predict(model)(F.col(text)).alias("made")
    return documents.select(F.col(doc_id).alias("doc_id"), made).select("doc_id", "made.*")
