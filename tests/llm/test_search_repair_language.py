"""Lexical search, conversation repair and language mixtures against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import languages, ranked, repair

# ---- ranked search ---------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_search(docs, items, k):
    held = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs]
    held = [(d, ts) for d, ts in held if ts]
    n, length = len(held), sum(len(ts) for _, ts in held)
    df = Counter(t for _, ts in held for t in set(ts))
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for i, ts in wanted.items():
        scores = []
        for d, words in held:
            tf, m = Counter(words), 50 + (50 * len(words) * n) // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m))
                for t in ts if t in tf
            )
            if score > 0:
                scores.append((-score, d is None, d))
        for rank, (s, _, d) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1):
            out.append((i, rank, d, -s))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def rows_of(df):
    got = [tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()]
    return sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for i in range(n)]
    items = [(i, " ".join(rng.choices(vocabulary, k=12))) for i in range(9)]
    return docs, items


@pytest.mark.parametrize("size", [4096, 16])
def test_search_equals_plain_scores(spark, monkeypatch, size):
    """Over many ranges and bundles too, where accumulators are dropped between stages."""
    monkeypatch.setattr(ranked, "RANGE", size)
    monkeypatch.setattr(ranked, "BUNDLE", 2 if size == 16 else 256)
    docs, items = corpus(300, size)
    got = ranked.search(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"), k=3,
    )
    assert rows_of(got) == plain_search(docs, items, 3)


def test_search_odd_rows(spark, docs):
    items = [(1, "quick BROWN fox"), (1, "line"), (2, None), (3, "..."), (None, "alpha7 shared no"), (4, "zebra")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("x"))
    got = rows_of(ranked.search(docs, table))
    assert got == plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], items, 50)
    assert {r[0] for r in got} == {1, None} and any(r[2] is None for r in got)


def test_search_of_empty_tables(spark, docs, no_docs):
    items = spark.createDataFrame([(1, "quick")], "item_id long, text string")
    assert ranked.search(no_docs, items).collect() == []
    assert ranked.search(docs, items.limit(0)).collect() == []


def test_terms_lower_only_ascii_letters():
    assert ranked.terms("É_Ab9-ß\x7fC 漢字".encode()) == ["É".encode(), b"ab9", "ß".encode(), b"c", "漢字".encode()]
    assert ranked.terms(None) == ranked.terms(b"") == []


# ---- conversation repair ---------------------------------------------------------------------

FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, edits, lines) of [(role, text, gone, truncated)], by trying every edit."""

    @lru_cache(None)
    def go(i, state, added):
        found = []
        if i == len(rows):
            if state in ("", "a"):
                found.append((0, "", ()))
        else:
            role, text, gone, cut = rows[i]
            options = [("D", 3, state, ())]
            if not gone:
                if role[:1] and role[:1] in FOLLOWS[state]:
                    options.append(("K", cut, role[0], (f"{role}:{text}",)))
                options += [("R", 2 + cut, to, (f"{NAMES[to]}:{text}",)) for to in FOLLOWS[state] if to in NAMES]
            for letter, cost, to, line in options:
                rest = go(i + 1, to, 0)
                if rest:
                    found.append((cost + rest[0], letter + rest[1], line + rest[2]))
        if added < 3:
            for to in FOLLOWS[state]:
                rest = go(i, to, added + 1) if to in NAMES else None
                if rest:
                    found.append((2 + rest[0], "I" + rest[1], (f"{NAMES[to]}:",) + rest[2]))
        return min(found, key=lambda x: x[:2]) if found else None

    return go(0, "", 0)


def plain_repair(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        made = []
        for c, turn, role, text in [r for r in rows if r[0] == conv]:
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            fault = zlib.crc32(key.encode()) % 20
            if fault == 0:
                continue
            if fault == 1:
                text = ""
            if fault == 2:
                text = re.sub("[.!?]", "", text)
            if fault == 4:
                role = "user"
            made += [(turn, role, text)] * (2 if fault == 3 else 1)
        made.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked, count = set(), [], Counter()
        for _, role, text in made:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = ("blank" if not body else "duplicate" if (role, text) in seen
                     else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
            count[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
        turns = [t for t, _, _ in made if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        kinds = [r[:1] for r, _, _, _ in marked]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
        cost, audit, lines = cheapest(tuple(marked))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest)
    return out


def repaired(df):
    return {r["conv_id"]: tuple(r)[1:] for r in repair.repair(df).collect()}


def talks(n, most, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Fine.", "Fine.", "cut", "", "  ", "Why?", "ok! ", "a:b.", None]
    return [
        (c if c else None, None if rng.random() < 0.05 else t + rng.randint(0, 1), rng.choice(roles),
         rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.randint(0, 99)}{rng.choice(['.', ''])}")
        for c in range(n) for t in range(rng.randint(1, most))
    ]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("bits", [14, 1])
def test_repair_equals_enumeration(spark, monkeypatch, bits):
    """Also when every conversation lies in many segments."""
    monkeypatch.setattr(repair, "SEGMENT_BITS", bits)
    rows = talks(120, 14, bits)
    assert repaired(spark.createDataFrame(rows, SCHEMA)) == plain_repair(rows)


def test_repair_of_one_long_conversation(spark, monkeypatch):
    """One key with all rows: edits come from many segments, and costs equal a plain chain."""
    monkeypatch.setattr(repair, "SEGMENT_BITS", 6)
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"Text {t}.") for t in range(900)]
    got = repaired(spark.createDataFrame(rows, SCHEMA))[7]
    import sys
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(20_000)
    try:
        assert got == plain_repair(rows)[7]
    finally:
        sys.setrecursionlimit(limit)


def test_repair_odd_tables(spark):
    assert repair.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    table = spark.createDataFrame([(5, dropped, "user", "x.")], SCHEMA).withColumn("state", F.lit(1))
    assert repaired(table) == {5: (0, 0, 0, 0, 0, 0, "", empty)}
    long = [(1, 1, "user", "word " * 200_000 + "."), (1, 2, "assistant", None)]
    assert repaired(spark.createDataFrame(long, SCHEMA)) == plain_repair(long)


def test_block_tables_equal_single_steps():
    made = repair.tables()
    rng = np.random.default_rng(1)
    for n in (1, 3, 4, 9, 30):
        symbols = rng.integers(0, repair.SYMBOLS, n).astype(np.uint8)
        now = np.arange(len(made.vectors))
        for x in symbols[::-1]:
            now = made.step[1][now, x]
        assert (made.through(symbols) == now).all()


# ---- languages -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(small):
    return languages.learn(small, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def test_languages_held_out(small, model):
    held = small.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    got = languages.identify(held, model).join(held.select("doc_id", "lang"), "doc_id").toPandas()
    got = got[got.lang.notna()]
    for lang in model.names:
        true, said = got.lang == lang, got.lang_pred == lang
        assert (true & said).sum() >= 0.98 * true.sum() and (true & said).sum() >= 0.98 * said.sum()
    assert got.score.between(0, 1).all()


def test_language_proportions_of_a_mixture(spark, small, model):
    """Halves of two languages are found as a set of both, with their shares of the words."""
    texts = {
        lang: " ".join(r["text"] for r in small.where(F.col("lang") == lang).orderBy(F.length("text")).limit(40).collect()
                       if r["text"]).split()[:300]
        for lang in model.names[:2]
    }
    a, b = texts
    rows = [(1, " ".join(texts[a][:200] + texts[b][:100])), (2, " ".join(texts[b][:200] + texts[a][:60]))]
    got = {r["doc_id"]: r for r in languages.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert set(got[1]["languages"]) == {a, b} and got[1]["lang_pred"] == a and abs(got[1]["score"] - 2 / 3) < 0.1
    assert set(got[2]["languages"]) == {a, b} and got[2]["lang_pred"] == b


def test_mixture_rises_in_likelihood():
    """The proportions found are better than all others on a grid."""
    rng = np.random.default_rng(5)
    scores, counts = rng.normal(-5, 3, (40, 2)), rng.integers(1, 5, 40).astype(float)
    share, likelihood = languages.mixture(scores, counts)
    grid = [counts @ np.log(np.exp(scores) @ np.array([p, 1 - p])) for p in np.linspace(0.001, 0.999, 999)]
    assert likelihood >= max(grid) - 1e-3 and abs(share.sum() - 1) < 1e-9


def test_languages_of_odd_rows(spark, docs, no_docs, model):
    rows = [(1, None), (2, ""), (3, "12 34 _ !!"), (4, "字" * 50_000), (None, "the"), (5, "x" * 300_000)]
    got = [tuple(r) for r in languages.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()]
    assert [r[1] == "und" for r in got] == [True, True, True, False, False, False]
    assert got[0][2:] == (0.0, [], [])
    assert languages.identify(docs, model).count() == docs.count()
    assert languages.identify(no_docs, model).count() == 0


def test_nothing_learned_is_undetermined(spark, docs):
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    found = languages.learn(bare, F.lit(True))
    assert {r["lang_pred"] for r in languages.identify(docs, found).collect()} == {"und"}


def test_model_sums_to_one():
    """After any context, the learned letters and the unseen one share a probability of one."""
    texts = {"x": "abba abc cab", "y": "bcb cbc"}
    counts = {k: dict(Counter(g for w, n in languages.words(t).items() for _ in range(n) for g in languages.grams(w)))
              for k, t in texts.items()}
    model = languages.fitted(counts)
    letters = sorted({g for c in counts.values() for g in c if len(g) == 1})
    for context in ("a", "b", "ab", " c"):
        total = np.zeros(2)
        for x in [*letters, "?"]:
            value = model.known[""]
            for n in range(1, len(context) + 2):
                g = (context + x)[len(context) + 1 - n:]
                row = model.known.get(g)
                value = row if row is not None else value + model.left.get(g[:-1], 0.0)
            total += np.exp(value)
        assert np.allclose(total, 1.0)


def test_words_score_as_their_letters(monkeypatch):
    """Sums of remembered n-grams are the letters' own, also after all were forgotten."""
    counts = {k: dict(Counter(g for w, n in languages.words(t).items() for _ in range(n) for g in languages.grams(w)))
              for k, t in {"x": "abba abc cab", "y": "bcb cbc"}.items()}
    model = languages.fitted(counts)
    monkeypatch.setattr(languages, "REMEMBERED", 64)
    monkeypatch.setattr(languages, "AT_ONCE", 4)
    scorer = languages.Scorer(model)
    rng = np.random.default_rng(3)
    for _ in range(50):
        found = sorted({"".join(rng.choice(list("abcé字"), rng.integers(1, 9))) for _ in range(11)})
        padded = ["  " + w + " " for w in found]
        plain = [sum(model.after(p[i - 2:i + 1]) for i in range(2, len(p))) for p in padded]
        assert np.allclose(scorer.of_words(found), plain)


def test_limit_decides_only_what_is_decided():
    """Where a set is given up early, its greatest likelihood is no better than what it must beat."""
    rng = np.random.default_rng(6)
    early = 0
    for _ in range(300):
        n = int(rng.integers(1, 60))
        mine = rng.integers(0, 3, n) if rng.random() < 0.5 else np.zeros(n, int)
        scores = rng.normal(-8, 2, (n, 3))
        scores[np.arange(n), mine] += 6
        counts = rng.integers(1, 5, n).astype(float)
        least = float((counts @ scores).max()) + 2 * np.log(counts.sum() + 1)
        _, whole = languages.mixture(scores, counts)
        _, found = languages.mixture(scores, counts, least)
        assert (found <= least) == (whole <= least)
        early += found != whole
    assert early > 50
