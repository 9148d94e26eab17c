import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seriesloom.llm import collisions, nbsvm, pivots, queries, subsequence
from seriesloom.llm.components import connected_components

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>, label int, vec string"


def odd_rows():
    """Rows that take no part."""
    nan, inf = float("nan"), float("inf")
    return [
        (900, None, 0, "x"), (901, [0.0] * 8, 0, "x"), (902, [nan] + [1.0] * 7, 0, "x"),
        (903, [inf] + [1.0] * 7, 0, "x"), (904, [None] + [1.0] * 7, 0, "x"), (905, [1.0, 2.0], 0, "x"), (906, [], 0, "x"),
    ]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(40):
        centre = rng.normal(size=8)
        for k in range(rng.integers(1, 9)):
            v = centre + rng.normal(size=8) * 0.12
            rows.append((len(rows), [float(np.float32(x)) for x in v], g, None))
    rows += [(500 + i, rows[3][1], 0, None) for i in range(4)]
    rows += [(600, [2 * x for x in rows[5][1]], 0, None)]
    return spark.createDataFrame(rows + odd_rows(), KIND)


def brute_links(rows, least):
    good = [
        r for r in rows if r["embedding"] and len(r["embedding"]) == 8 and None not in r["embedding"]
        and np.isfinite(r["embedding"]).all() and any(r["embedding"])
    ]
    x = np.array([r["embedding"] for r in good], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least - 1e-12
    np.fill_diagonal(near, False)
    ids = [r["vec_id"] for r in good]
    root = list(range(len(ids)))
    for _ in ids:
        root = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(len(ids))]
    out = {r["vec_id"]: (0, r["vec_id"], True) for r in rows}
    for i, n in enumerate(ids):
        least_id = min(ids[j] for j in range(len(ids)) if root[j] == root[i])
        out[n] = (int(near[i].sum()), least_id, n == least_id)
    return out


def test_pivots_equal_brute_force(vectors):
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pivots.near_duplicates(vectors).collect()}
    assert got == brute_links(vectors.collect(), 0.9)


def test_pivots_split_long_lists(vectors, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pivots.near_duplicates(vectors).collect()}
    assert got == brute_links(vectors.collect(), 0.9)


def test_pivots_empty_and_odd(spark):
    assert pivots.near_duplicates(spark.createDataFrame([], KIND)).count() == 0
    got = pivots.near_duplicates(spark.createDataFrame(odd_rows()[:5], KIND)).collect()
    assert {(r["n_links"], r["component_id"] == r["vec_id"], r["kept"]) for r in got} == {(0, True, True)}


def test_pivots_recall_on_the_table(spark):
    """Planted near copies of the given vectors are all found."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x = np.stack(rows["embedding"]).astype(float)
    rng = np.random.default_rng(1)
    near = x[:400] + rng.normal(size=(400, 64)) * rng.uniform(0.0, 0.055, (400, 1))
    both = np.vstack([x, near])
    ids = [*rows["vec_id"].tolist(), *range(10**6, 10**6 + 400)]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, both)], "vec_id long, embedding array<double>")
    unit = both / np.linalg.norm(both, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in pivots.near_duplicates(table).collect()}
    assert sum(got.values()) >= 0.99 * links.sum() and links.sum() > 300
    assert all(got[i] <= n for i, n in zip(ids, links))


def test_pivots_find_a_jittered_third(spark):
    """Links inside one group of near copies, each with its own jitter, that holds a third of all rows."""
    rng = np.random.default_rng(3)
    n, size = 15_000, 5000
    centre = rng.normal(size=64)
    centre /= np.linalg.norm(centre)
    x = np.vstack([centre + rng.normal(size=(size, 64)) * 0.27 / 8, rng.normal(size=(n - size, 64)) / 8])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x[:size] / np.linalg.norm(x[:size], axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in pivots.near_duplicates(table).collect()}
    assert sum(got[i] for i in range(size)) >= 0.99 * links.sum() and links.sum() > size * size // 2
    assert all(got[i] <= n for i, n in enumerate(links))


def cones(groups, size, spread, seed=8, d=64):
    """Vectors in narrow cones around a few directions."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return np.repeat(centres, size, axis=0) + rng.normal(size=(groups * size, d)) * spread / np.sqrt(d)


@pytest.mark.parametrize("x", [
    np.array([[1.0, 0.2, 0.0], [1.0, 0.3, 0.1]]), cones(1, 300, 0.1), cones(1, 300, 0.34), cones(3, 200, 0.3), cones(30, 90, 0.3),
], ids=["two vectors", "one cone", "one wide cone", "three cones", "thirty groups"])
def test_pivots_where_few_are_left(spark, x, monkeypatch):
    """All links are found where nearly all vectors are alike."""
    monkeypatch.setattr(pivots, "WHOLE_BLOCK", 256)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T
    sure, maybe = (near >= 0.9 + 1e-9).sum(1) - 1, (near >= 0.9 - 1e-9).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in pivots.near_duplicates(table).collect()}
    assert all(sure[i] <= got[i] <= maybe[i] for i in range(len(x))) and sum(got.values()) > 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1100)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = dict(connected_components(spark.createDataFrame([*edges, (None, 5), (7, 7)], "a long, b long")).collect())
    assert got == {i: find(i) for i in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- nearest --------------------------------------------------------------------------


def brute_nearest(rows, k):
    x = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in rows}
    out = {}
    for q, v in x.items():
        if q % 20 == 0:
            found = sorted(((-float(v @ w), i) for i, w in x.items() if i != q))[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def test_nearest_small_is_exact(spark):
    got = queries.op2_collision_counting(spark, SF).collect()
    want = brute_nearest(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), 20)
    assert len(got) == 20 * len(want)
    for r in got:
        number, score = want[r["query_id"]][r["rank"] - 1]
        assert r["vec_id"] == number and abs(r["score"] - score) < 1e-12


@pytest.fixture(scope="module")
def clustered(spark):
    """12 000 unit vectors around the label centres of the given table, spread as its own are."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding", "label").toPandas()
    x = np.stack(rows["embedding"]).astype(float)
    labels, at = np.unique(rows["label"].to_numpy(), return_inverse=True)
    centres = np.stack([x[at == k].mean(0) for k in range(len(labels))])
    rng = np.random.default_rng(6)
    made = centres[rng.integers(0, len(labels), 12_000)] + rng.normal(size=(12_000, x.shape[1])) * (x - centres[at]).std(0)
    return made / np.linalg.norm(made, axis=1, keepdims=True)


def as_table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def recall_of_nearest(table, x, k=20, **settings):
    asked = np.arange(0, len(x), 200)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    want = {int(q): set(np.argpartition(-row, k)[:k].tolist()) for q, row in zip(asked, score)}
    got = collisions.nearest(table, F.col("vec_id") % 200 == 0, k=k, **settings).collect()
    assert len(got) == k * len(want)
    return sum(r["vec_id"] in want[r["query_id"]] for r in got) / len(got)


@pytest.mark.parametrize("norms", ["one long", "uneven"])
def test_nearest_recall_with_norms(spark, clustered, norms):
    x = clustered.copy()
    if norms == "one long":
        x[7] *= 10
    else:
        x *= np.exp(np.random.default_rng(2).normal(size=(len(x), 1)) * 0.3)
    assert recall_of_nearest(as_table(spark, x), x) >= 0.95


def test_nearest_window_settings_reach_the_workers(spark, clustered):
    """The share of production alone still finds most; a tiny share shows."""
    table = as_table(spark, clustered)
    found = [
        recall_of_nearest(table, clustered, windows=w)
        for w in (collisions.Windows(), collisions.Windows(least=64), collisions.Windows(least=64, enough=0.005))
    ]
    print("recall", found)
    assert found[0] >= 0.95 and found[1] >= 0.9 and found[2] < found[1] - 0.05


def test_nearest_ranges_of_norm():
    made = collisions.ranges({9: 1, 5: 3, 4: 1000, 3: 1000, 0: 9000, -4: 20})
    assert made == [(9, 0, 1), (5, 0, 1), (4, 0, 1), (3, 1, 1), (0, 2, 2), (-4, 4, 1)]


def test_nearest_odd_rows(spark):
    rows = [(0, [1.0] * 8, 0, None), (1, [2.0] * 8, 0, None), (2, [2.0] * 8, 0, None), (3, [-1.0] + [0.5] * 7, 0, None)]
    got = collisions.nearest(spark.createDataFrame(rows + odd_rows(), KIND), F.col("vec_id") % 20 == 0, k=20).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [
        (1, 1, 16.0), (2, 2, 16.0), (3, 3, 2.5)]
    assert collisions.nearest(spark.createDataFrame([], KIND), F.col("vec_id") % 20 == 0).count() == 0


# ---- classifiers ----------------------------------------------------------------------


def out(number):
    return zlib.crc32(str(number).encode()) % 5 == 0


@pytest.mark.parametrize("module, label, threshold", [(nbsvm, "quality", 0.3), (subsequence, "toxic", 0.5)])
def test_held_out_accuracy(spark, module, label, threshold):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    got = module.score(docs, module.learn(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 500 and all(out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == (r["score"] >= threshold) for r in got)
    right = sum(r["predicted"] == r[label] for r in got) / len(got)
    assert right >= 0.97
    # Each label by itself, as one of them is rare.
    for value in (0, 1):
        of = [r for r in got if r[label] == value]
        assert sum(r["predicted"] == value for r in of) / len(of) >= 0.85


@pytest.mark.parametrize("module, label", [(nbsvm, "quality"), (subsequence, "toxic")])
def test_scores_of_odd_rows(spark, docs, no_docs, module, label):
    # Training rows too few or of one class: a constant score, and no crash.
    labels = spark.createDataFrame([(1, 1), (3, 1), (77, None), (None, 1)], f"doc_id long, {label} int")
    model = module.learn(docs, labels, label)
    got = module.score(docs, model).collect()
    assert len(got) == docs.count() and len({r["score"] for r in got}) == 1
    none = module.learn(no_docs, labels.limit(0), label)
    assert module.score(no_docs, none).count() == 0


def test_insults_with_gaps_and_inserted_letters():
    rng = random.Random(1)
    clean = ["".join(rng.choice(("ta", "ne", "ro", "li", "su", "ve")) for _ in range(rng.randint(2, 5))) for _ in range(1500)]
    bags, y = [], []
    for i in range(300):
        bag = set(rng.sample(clean, rng.randint(15, 40)))
        if i % 3 == 0:
            bag.add(rng.choice(("blockhead", "dimwit", "numbskull")))
        bags.append(bag)
        y.append(int(i % 3 == 0))
    model = subsequence.fit(bags, np.array(y), 0.33)

    def score(text):
        """Of a clean document with this text put into it."""
        found = [*rng.sample(clean, 24), *subsequence.strings(text)]
        margins = [float(model.margins(subsequence.windows(w)).max()) for w in found]
        return model.probability(sorted(margins, reverse=True)[:subsequence.WORST], len(found))

    for t in ("you blockhead", "b l o c k h e a d", "block-head", "bl.ock.head", "blockxhead", "dimwitt", "numbsskull", "n u m b s k u l l"):
        assert score(t) >= 0.5, t
    assert sum(score(w) >= 0.5 for w in clean[:300]) <= 3


@pytest.mark.parametrize("insults, recall", [(30, 0.5), (60, 0.25), (120, 0.3)])
def test_many_rare_insults(insults, recall):
    """Every insult is rare, some are tampered with: still no constant model."""
    rng = random.Random(5)
    syllables = [a + b for a in "bcdfghklmnprst" for b in "aeiou"]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(6000)]
    odds = [1 / (i + 5) for i in range(6000)]
    bad = ["".join(rng.choice("bcdfgjklmnpqrstvwxz") + rng.choice("aeiouy") for _ in range(3)) + rng.choice("xzkq") for _ in range(insults)]
    bags = []
    for i in range(1500):
        bag = set(rng.choices(words, odds, k=rng.randint(20, 60)))
        if i % 4 == 0:
            insult = rng.choice(bad)
            if rng.random() < 0.3:
                k = rng.randint(2, len(insult) - 1)
                insult = insult[:k] + rng.choice("aeinorst") + insult[k:]
            bag.add(insult)
        bags.append(bag)
    y = np.array([int(i % 4 == 0) for i in range(1500)])
    model = subsequence.fit(bags[:1200], y[:1200], 0.25)
    got = []
    for bag in bags[1200:]:
        margins = sorted((float(model.margins(subsequence.windows(w)).max()) for w in bag), reverse=True)
        got.append(model.probability(margins[:subsequence.WORST], len(bag)))
    toxic, found = y[1200:] == 1, np.array(got) >= 0.5
    assert len(set(got)) > 10
    assert found[toxic].mean() >= recall and found[~toxic].mean() <= 0.15


# ---- pipeline -------------------------------------------------------------------------


def test_pipeline(spark):
    from test_text_operators import brute_components, check_packing, plain_dedup, slow_fingerprint

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = nbsvm.score(docs, nbsvm.learn(docs, labels))
    kept = {r["doc_id"] for r in good.where("predicted = 1").collect()}
    bad = subsequence.score(docs, subsequence.learn(docs, labels), 0.5)
    kept -= {r["doc_id"] for r in bad.where("predicted = 1").collect()}
    groups = brute_components([(d, slow_fingerprint(texts[d])) for d in sorted(kept)], 2)
    kept = sorted(d for d, _, c in groups if d == c)
    clean = plain_dedup([(d, texts[d]) for d in kept])
    pieces = corpus_pipeline.run(spark, SF).collect()
    check_packing(pieces, list(clean.items()))


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(30), SF).schema.names == docs.schema.names


def test_stages_on_empty_and_odd_documents(spark):
    kind = (
        "doc_id long, text string, lang string, source string, n_chars long, score double, row string, "
        "rank int, version int, gone string, fp long, made string, sequence_id long"
    )
    extra = (None, None, None, None, None, None, None, None)
    rows = [
        (n, t, None, None, None, *extra) for n, t in (
            (1, None), (2, ""), (3, " \n\t "), (4, "a short and clean line of words\n" * 3), (None, "words without any number"),
            (5, "word " * 60_000), (4, "a short and clean line of words\n" * 3), (6, "x" * 100_000), (7, "A SHORT and clean line of words"),
        )
    ]
    for docs in (spark.createDataFrame([], kind), spark.createDataFrame(rows, kind)):
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name == "packing":
                assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
                assert (out.count() == 0) == (docs.count() == 0)
            else:
                assert out.columns == names
                assert out.count() <= docs.count()
