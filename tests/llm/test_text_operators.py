import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seriesloom.llm import byte_bpe, line_dedup, packing, queries, shards, simhash, token_counts

SF = "/root/testdata/sf0.001"
JSON, RANKS, WORDS = (P.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))


def texts_of(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    more = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return [r["text"] or "" for r in rows] + [r["text"] or "" for r in more]


def noise():
    rng = random.Random(5)
    signs = "abcdefgh <|>\n1\t'st é日😀İΣς́ \x85"
    return ["".join(rng.choice(signs) for _ in range(200)) for _ in range(150)] + [
        "<|endoftext|>", "a<|endoftext|>b<|endoftext|> <|ENDOFTEXT|>", "it's WE'LL 'll", "ΑΣ ΟΔΟΣ", "é É", "աֈb",
    ]


# ---- token counts ---------------------------------------------------------------------


def test_counts_equal_the_library(spark, docs):
    count = token_counts.counter(JSON, P.PATTERN)
    tokenizer = Tokenizer.from_file(JSON)
    for t in texts_of(spark, docs) + noise():
        assert count(t) == len(tokenizer.encode(t, add_special_tokens=False).ids)


def test_counts_per_row(spark, docs, no_docs):
    got = token_counts.count_tokens(docs, JSON, P.PATTERN).collect()
    assert len(got) == docs.count()
    empty = [r for r in got if r["doc_id"] in (4, 5)]
    assert all((r["n_bytes"], r["n_tokens"], r["over_limit"]) == (0, 0, False) for r in empty)
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert token_counts.count_tokens(no_docs, JSON, P.PATTERN).count() == 0


def test_cut_classes_agree_where_used():
    """The pattern's classes equal the library's on every code point that takes the fast way."""
    import regex

    tokenizer, pieces = Tokenizer.from_file(JSON), regex.compile(P.PATTERN)
    for lo in range(0, 0x10FFFF, 997):
        for code in range(lo, lo + 40):
            c = chr(min(code, 0x10FFFF))
            if 0xD800 <= ord(c) < 0xE000 or token_counts._UNSAFE.search(c):
                continue
            s = f"a{c}1{c}{c}."
            want = [span for _, span in tokenizer.pre_tokenizer.pre_tokenize_str(s)]
            assert [m.span() for m in pieces.finditer(s)] == want


# ---- byte-level BPE -------------------------------------------------------------------


def test_codec_equals_merging_by_rank(spark, docs):
    codec = byte_bpe.load(RANKS, P.PATTERN)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(9)
    dense = ["".join(rng.choice("aeionrstl") for _ in range(300)) for _ in range(200)]
    for t in texts_of(spark, docs) + noise() + dense:
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_encode_rows(docs, no_docs):
    got = {(r["doc_id"], r["ids"]) for r in byte_bpe.encode(docs, RANKS, P.PATTERN).collect()}
    assert (4, b"") in {(d, bytes(i)) for d, i in got} and (5, b"") in {(d, bytes(i)) for d, i in got}
    assert byte_bpe.encode(no_docs, RANKS, P.PATTERN).count() == 0


def test_digest_query(spark):
    got = {r["doc_id"]: r for r in queries.op9_byte_bpe(spark, SF).collect()}
    codec = byte_bpe.load(RANKS, P.PATTERN)
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = codec.encode(r["text"] or "")
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
        assert got[r["doc_id"]]["n_tokens"] == len(ids) // 4


# ---- packing --------------------------------------------------------------------------


def test_word_ids_equal_the_library(spark, docs):
    encode, tokenizer = packing.encoder(WORDS), Tokenizer.from_file(WORDS)
    for t in texts_of(spark, docs) + noise():
        want = tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encode(t), "<u4").tolist() == want


def check_packing(pieces, texts):
    """``texts``: whole texts in order of (doc_id, text) groups, as multisets per number."""
    tokenizer = Tokenizer.from_file(WORDS)
    lengths = Counter()
    for p in pieces:
        lengths[p["sequence_id"]] += p["length"]
        assert len(p["ids"]) == 4 * p["length"] > 0
    offsets = defaultdict(list)
    for p in pieces:
        offsets[p["sequence_id"]].append((p["offset"], p["length"]))
    for spans in offsets.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 2048
    padding = sum(2048 - n for n in lengths.values() if n & (n - 1))
    assert padding == 0
    whole = Counter()
    for number, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        whole[number] += len(ids)
    placed = Counter()
    for p in pieces:
        placed[p["doc_id"]] += p["length"]
    assert placed == whole
    return lengths


def test_packing_fixture(docs, no_docs):
    pieces = packing.pack(docs.repartition(3, "doc_id"), WORDS).collect()
    check_packing(pieces, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert packing.pack(no_docs, WORDS).count() == 0


def test_packing_table(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").repartition(4, "doc_id")
    pieces = packing.pack(documents, WORDS).collect()
    rows = documents.collect()
    check_packing(pieces, [(r["doc_id"], r["text"]) for r in rows])
    tokenizer, parts = Tokenizer.from_file(WORDS), defaultdict(list)
    for p in pieces:
        parts[p["doc_id"]].append((p["start"], bytes(p["ids"])))
    for r in rows:
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert b"".join(i for _, i in sorted(parts[r["doc_id"]])) == ids


def test_level_array_minimises_the_sum_of_squares():
    rng = np.random.default_rng(3)
    packer = packing.Packer(window=32)
    for n in range(400):
        size = int(rng.integers(1, 33))
        counts = packer.counts.copy()
        level = packer.level_for(size)

        def total(at):
            c = counts.copy()
            if at:
                c[at] -= 1
            if at + size < 32:
                c[at + size] += 1
            return int((c[1:32] ** 2).sum())

        options = [0] + [h for h in range(1, 33 - size) if counts[h]]
        assert total(level) == min(map(total, options))
        packer.add(n, np.zeros(size, "<u4").tobytes())
    assert packer.total == packer.counts[1:32].sum()


# ---- SimHash --------------------------------------------------------------------------


def slow_fingerprint(text, k=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in lowered.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    rows = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in rows]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius):
    prints = [(d, f) for d, f in rows]
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, f"{f:016x}", least.get(find(i))) for i, (d, f) in enumerate(prints)]


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_simhash_large_buckets_at_other_radii(spark, radius, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 40)
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(3)]
    made = {rng.choice(base) ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4))) for _ in range(400)}
    signed = [f - (1 << 64) if f >> 63 else f for f in made]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius).collect()
    assert all(((r["a"] ^ r["b"]) % 2**64).bit_count() <= radius for r in links)
    got = {f: f for f in signed}

    def find(f):
        while got[f] != f:
            f = got[f]
        return f

    for r in links:
        a, b = sorted((find(r["a"]), find(r["b"])))
        got[b] = a
    want = brute_components([(f, f % 2**64) for f in signed], radius)
    assert {f: find(f) for f in signed} == {d: c for d, _, c in want}


def test_simhash_fixture(docs, no_docs):
    rows = [(r["doc_id"], slow_fingerprint(r["text"] or "")) for r in docs.collect()]
    got = simhash.groups(docs).select("doc_id", simhash.as_hex(F.col("fp")).alias("f"), "component_id").collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_components(rows, 2), key=key)
    assert simhash.groups(no_docs).count() == 0


def test_simhash_query(spark):
    rows = [
        (r["doc_id"], slow_fingerprint(r["text"] or ""))
        for r in spark.read.parquet(f"{SF}/documents.parquet").collect()
    ]
    got = queries.op6_simhash(spark, SF).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows, 2))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair(radius):
    rng = random.Random(radius)
    kept = [m & (2**64 - 1) for m in simhash.masks(radius)]
    assert len(kept) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        differ = sum({1 << rng.randrange(64) for _ in range(radius)})
        assert any(differ & m == 0 for m in kept)


def test_large_buckets_join_the_same_components(spark, monkeypatch):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    prints = {centre}
    for _ in range(300):
        flips = [1 << rng.randrange(64) for _ in range(rng.choice([0, 1, 2, 3]))]
        prints.add(rng.choice(sorted(prints)[:20]) ^ sum(set(flips)))
    prints |= {rng.getrandbits(64) for _ in range(50)}
    signed = [f - 2**64 if f >> 63 else f for f in sorted(prints)]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    from seriesloom.llm.components import connected_components

    for small in (1, 12, 10_000):
        monkeypatch.setattr(simhash, "SMALL", small)
        links = simhash.links(table, 2)
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in links.collect())
        roots = dict(connected_components(links).collect())
        want = brute_components([(f, f % 2**64) for f in signed], 2)
        assert {f: roots.get(f, f) for f in signed} == {f: c for f, _, c in want}


def test_one_of_each_group(docs):
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    numbers = sorted(str(r["doc_id"]) for r in got.collect())
    want = {r[0] for r in brute_components(
        [(r["doc_id"], slow_fingerprint(r["text"] or "")) for r in docs.collect()], 2) if r[0] == r[2]}
    assert numbers == sorted([str(n) for n in want if n is not None] + ["None"])


# ---- line dedup -----------------------------------------------------------------------

PUNCTUATION = ".!?,;:。！？，；：、"


def plain_dedup(docs):
    """{number: clean text} of (number, text) in order of number, by lists of clauses, letter by letter."""
    seen, out = set(), {}
    for number, text in docs:
        units, line, piece = [], 0, []

        def close():
            body = "".join(text[i] for i in piece)
            norm = " ".join(body.rstrip(PUNCTUATION).lower().split())
            if norm:
                units.append((line, piece[0], piece[-1] + 1, norm))
            piece.clear()

        for i, letter in enumerate(text):
            if letter == "\n":
                if piece:
                    close()
                line += 1
                continue
            if piece and text[piece[-1]] in PUNCTUATION and letter not in PUNCTUATION:
                close()
            piece.append(i)
        if piece:
            close()
        late = []
        for u in units:
            late.append(u[3] in seen)
            seen.add(u[3])
        gone, i = set(), 0
        while i < len(units):
            j = i
            while j < len(units) and late[j]:
                j += 1
            size = sum(
                len(u[3].split()) + sum("฀" <= x <= "๿" or "぀" <= x <= "ヿ" or "㐀" <= x <= "鿿" for x in u[3])
                for u in units[i:j]
            )
            if size >= 30:
                gone.update(range(i, j))
            i = max(j, i + 1)
        cut = {i for g in gone for i in range(*units[g][1:3])}
        lines = []
        at = 0
        for n, body in enumerate(text.split("\n")):
            mine = [g for g, u in enumerate(units) if u[0] == n]
            if not (mine and all(g in gone for g in mine)):
                lines.append("".join(x for i, x in enumerate(body, at) if i not in cut))
            at += len(body) + 1
        out[number] = "\n".join(lines)
    return out


PASSAGE = " ".join(
    f"{'and' if i % 9 else 'However'} word{i} of the passage{',' if i % 7 == 6 else '.' if i % 11 == 10 else ''}" for i in range(16)
)


def test_lines_fixture(docs, no_docs):
    got = {r["doc_id"]: r for r in line_dedup.remove_repeats(docs, least_words=5).collect()}
    assert got[10]["clean"] == "line one of the shared text\nown words are here too"
    assert [tuple(s) for s in got[10]["removed"]] == [(2, 51, 27)]
    assert got[11]["clean"] == "something else is written here"
    assert [tuple(s) for s in got[11]["removed"]] == [(0, 0, 28)]
    assert got[3]["clean"] == "" and got[1]["n_removed"] == 0
    assert got[4]["clean"] is None and got[4]["n_units"] == 0
    assert got[5]["clean"] == "" and got[8]["clean"] == "one two"
    repeated = [r for r in line_dedup.remove_repeats(docs, least_words=5).collect() if r["doc_id"] == 2]
    assert len(repeated) == 2 and {r["clean"] for r in repeated} == {""}
    assert line_dedup.remove_repeats(no_docs).count() == 0
    assert {r["n_removed"] for r in line_dedup.remove_repeats(docs).collect()} == {0}


def cleaned_texts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["clean"] for r in line_dedup.remove_repeats(docs).collect()}


def test_passages_wherever_they_stand(spark):
    """In mid-line, over short lines, with one clause edited, and in a script without blanks."""
    wrapped = PASSAGE.replace(", ", ",\n").replace(". ", ".\n")
    chinese = "。".join("山水云天地人花鸟鱼虫"[i:] + "江河湖海" for i in range(8)) + "。"
    edited = PASSAGE.replace("word14", "other14")
    texts = [
        f"First of all. {PASSAGE}. The end.", f"Another text, {PASSAGE}. Own words.", f"Top\n{wrapped}.\nbelow it",
        f"Edited: {edited}. Bye.", f"Head. {chinese}", f"Tail\n{chinese}\nlast", "Short and common. The end. Own words.",
    ]
    got = cleaned_texts(spark, texts)
    assert got == plain_dedup(list(enumerate(texts)))
    assert got[0] == texts[0] and got[4] == texts[4] and got[6] == texts[6]
    assert got[1] == "Another text, Own words."
    assert got[2] == "Top\nbelow it" and got[5] == "Tail\nlast"
    assert "other14" in got[3] and "word3" not in got[3]


def test_earliest_of_one_number_and_of_none(spark):
    """Texts of one number, and rows without any, rank by hash; one of each passage stays."""
    rows = [(None, f"a {PASSAGE}."), (None, f"b. {PASSAGE}."), (3, f"c. {PASSAGE}."), (3, f"d. {PASSAGE}."), (9, f"e. {PASSAGE}.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.remove_repeats(docs).collect()
    kept = [r["doc_id"] for r in got if "word3" in r["clean"]]
    assert kept.count(3) == 1 and 9 not in kept and len(got) == 5


def test_long_documents(spark):
    rng = random.Random(4)
    long = ". ".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(8000))
    texts = [long, f"Own. {long}", "word " * 200_000, "字" * 100_000]
    got = cleaned_texts(spark, texts)
    assert got[0] == texts[0] and got[1].strip() == "Own." and got[2] == texts[2] and got[3] == texts[3]


def test_clauses_equal_plain_version(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect())
    got = {r["doc_id"]: r["clean"] for r in line_dedup.remove_repeats(documents).collect()}
    assert got == plain_dedup(rows) and any(got[d] != t for d, t in rows)


def test_cleaned_keeps_columns(docs):
    got = line_dedup.cleaned(docs.withColumn("n_chars", F.lit(0)), n_chars="n_chars")
    assert got.columns == ["doc_id", "text", "score", "n_chars"]
    assert all(r["n_chars"] == len(r["text"] or "") for r in got.collect())


# ---- shards ---------------------------------------------------------------------------


def check_shards(got, docs, count):
    rows = docs.collect()
    assert len(got) == len(rows)
    sizes = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sizes
    where, slots, loads = defaultdict(set), defaultdict(list), [0] * count
    for r in got:
        where[(r["size"], r["text_crc32"])].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return loads


def longest_first(sizes, count):
    import heapq

    heap = [(0, s) for s in range(count)]
    for n in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + n, s))
    return [load for load, _ in heap]


def test_shards_fixture(docs, no_docs):
    check_shards(shards.assign(docs, shards=3).collect(), docs, 3)
    assert shards.assign(no_docs, shards=3).count() == 0


def test_shards_query(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    loads = check_shards(queries.op7_shards(spark, SF).collect(), documents, 40)
    groups = Counter()
    for r in documents.collect():
        groups[r["text"]] += len(r["text"].encode()) + 16
    best = longest_first(groups.values(), 40)
    assert max(loads) - min(loads) <= (max(best) - min(best)) * 1.001 + 1


def test_many_small_groups_are_level(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "repeat('x', cast(id % 97 as int)) || id AS text")
    loads = check_shards(shards.assign(rows, shards=40).collect(), rows, 40)
    assert max(loads) - min(loads) <= 0.002 * sum(loads) / 40 + 200


def test_dealing_a_class_levels_the_loads():
    loads = [0.0, 50.0, 10.0, 500.0]
    got = shards.deal([(10.0, 60)], loads)
    assert sum(got[0]) == 60 and got[0][3] == 0
    assert max(loads[:3]) - min(loads[:3]) <= 10
