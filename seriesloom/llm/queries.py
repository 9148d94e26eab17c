"""The registered queries of this package and, where SQL can say it, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import (
    byte_bpe, collisions, languages, line_dedup, nbsvm, packing, pivots, ranked, repair, shards, simhash,
    subsequence, token_counts,
)
from seriesloom.llm.common import read


def op1_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all embeddings at cosine 0.9."""
    return pivots.near_duplicates(read(spark, sf_dir, "embeddings"), least=0.9)


def op2_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 20th embedding's 20 nearest by inner product."""
    return collisions.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts.count_tokens(
        read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    pieces = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = read(spark, sf_dir, "documents")
    return subsequence.score(docs, subsequence.learn(docs, read(spark, sf_dir, "labels")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents at two bits."""
    found = simhash.groups(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    return shards.assign(read(spark, sf_dir, "documents"), shards=40, overhead=16)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    docs = read(spark, sf_dir, "documents")
    return nbsvm.score(docs, nbsvm.learn(docs, read(spark, sf_dir, "labels")))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and the decoded bytes of all documents."""
    made = byte_bpe.encode(
        read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return made.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages that an earlier one holds, with what was cut."""
    made = line_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    span = F.transform("removed", lambda s: F.concat_ws(":", s["place"], s["start"], s["length"]))
    return made.select("doc_id", "clean", "n_units", "n_removed", F.array_join(span, ",").alias("removed"))


def op11_term_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of all for each benchmark item."""
    return ranked.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=50)


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of all damaged conversations."""
    return repair.repair(read(spark, sf_dir, "conversations"))


def op13_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    docs = read(spark, sf_dir, "documents")
    mark = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    found = languages.identify(docs, languages.learn(docs, ~mark))
    return found.select("doc_id", mark.alias("held_out"), "lang_pred", "score", "languages", "shares")


QUERIES = {
    fn.__name__: fn
    for fn in (
        op1_pivot_permutation, op2_collision_counting, op3_token_counts, op4_packing, op5_toxicity,
        op6_simhash, op7_shards, op8_quality, op9_byte_bpe, op10_line_dedup, op11_term_pipeline,
        op12_structure_repair, op13_language_mixture,
    )
}



def _repair_sql() -> str:
    """Cheapest edits of whole conversations, row by row from the last, as (cost, edits, lines).

    The least of such structs is the cheapest, of equal ones that with the ASCII-least edits.
    """
    after = {"e": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    forced = {"e": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def made(cost: str, letter: str, line: str, to: str) -> str:
        return f"{{'c': {cost} + {to}.c, 'w': '{letter}' || {to}.w, 't': {line}{to}.t}}"

    def least(*options: str) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    base = []
    for q, moves in after.items():
        kept = " ".join(
            f"WHEN NOT gone AND kind = '{k}' THEN " + made("cut", "K", "chr(10) || role || ':' || text || ", f"w.{to}")
            for k, to in moves.items()
        )
        name = names[forced[q]]
        rerole = made("2 + cut", "R", f"chr(10) || '{name}:' || text || ", f"w.{forced[q]}")
        never = "{'c': 1000000000, 'w': '', 't': ''}"
        base.append(least(
            made("3", "D", "", f"w.{q}"), f"CASE {kept} ELSE {never} END", f"CASE WHEN NOT gone THEN {rerole} ELSE {never} END"
        ) + f" AS {q}")

    def added(to: str, name: str) -> str:
        return made("2", "I", f"chr(10) || '{name}:' || ", to)

    u = least("b.u", added("b.a", "assistant"))
    return rf"""
WITH RECURSIVE crc(k, i, c) AS (
  SELECT 0, range, range FROM range(256)
  UNION ALL SELECT k + 1, i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
lut AS (SELECT list(c ORDER BY i) AS l FROM crc WHERE k = 8),
base AS (
  SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, coalesce(role, ' ') AS role,
         coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations),
hit AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))),
                lambda c, b: xor(c >> 8, l[xor(c, b) % 256 + 1])), 4294967295) % 20 AS f
  FROM base, lut),
made AS (
  SELECT conv, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hit WHERE f <> 0),
placed AS (
  SELECT *, left(role, 1) AS kind, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i FROM made),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
         lag(kind) OVER (PARTITION BY conv ORDER BY i) || kind AS step
  FROM placed),
marked AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CAST(fault = 'truncated' AS INTEGER) AS cut FROM faulty),
walk AS (
  SELECT conv, max(i) + 1 AS i, {{'c': 0, 'w': '', 't': ''}} AS e,
         {{'c': 4, 'w': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s,
         {{'c': 2, 'w': 'I', 't': chr(10) || 'assistant:'}} AS u, {{'c': 0, 'w': '', 't': ''}} AS a
  FROM marked GROUP BY conv
  UNION ALL
  SELECT conv, i, {least("b.e", added(u, "user"))}, {least("b.s", added(u, "user"))}, {u}, {least("b.a", added("b.u", "user"))}
  FROM (SELECT m.conv, m.i, {", ".join(base)} FROM walk w JOIN marked m ON m.conv = w.conv AND m.i = w.i - 1) b),
counts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (step NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv)
SELECT n.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(e.c, 0) AS BIGINT) AS cost,
       coalesce(e.w, '') AS audit, sha256(coalesce(substr(e.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv, conv_id FROM base) n LEFT JOIN counts USING (conv) LEFT JOIN walk w ON w.conv = n.conv AND w.i = 1"""


ORACLES = {
    "op1_pivot_permutation": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (
  SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n FROM near GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id,
       vec_id <= coalesce(least.b, vec_id) AS kept
FROM embeddings LEFT JOIN links ON links.a = vec_id LEFT JOIN least ON least.a = vec_id""",
    "op10_line_dedup": r"""
WITH parts AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS n FROM parts),
placed AS (
  SELECT doc_id, n, regexp_extract_all(line, '[^.!?,;:。！？，；：、]+[.!?,;:。！？，；：、]*|[.!?,;:。！？，；：、]+') AS ps,
         coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM lines),
pieces AS (SELECT doc_id, n, base, unnest(ps) AS piece, unnest(range(len(ps))) AS k FROM placed),
normal AS (
  SELECT *, trim(regexp_replace(lower(regexp_replace(piece, '[.!?,;:。！？，；：、]+$', '')),
                 '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS norm,
         base + coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, n ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM pieces),
units AS (
  SELECT doc_id, n, k, start, length(piece) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY n, k) - 1 AS place,
         row_number() OVER (PARTITION BY norm ORDER BY doc_id, n, k) > 1 AS late,
         length(norm) - length(replace(norm, ' ', '')) + 1
           + len(regexp_extract_all(norm, '[\x{0E00}-\x{0E7F}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]')) AS words
  FROM normal WHERE norm <> ''),
islands AS (SELECT *, sum(CAST(NOT late AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY place) AS island FROM units),
marked AS (SELECT *, late AND sum(words) FILTER (late) OVER (PARTITION BY doc_id, island) >= 30 AS gone FROM islands),
rebuilt AS (
  SELECT l.doc_id, l.n, any_value(l.line) AS line, coalesce(bool_or(gone), false) AS touched, coalesce(bool_and(gone), false) AS whole,
         string_agg(piece, '' ORDER BY p.k) FILTER (NOT coalesce(gone, false)) AS kept
  FROM lines l LEFT JOIN normal p ON p.doc_id = l.doc_id AND p.n = l.n
  LEFT JOIN marked m ON m.doc_id = p.doc_id AND m.n = p.n AND m.k = p.k GROUP BY l.doc_id, l.n),
texts AS (
  SELECT doc_id, coalesce(string_agg(CASE WHEN touched THEN coalesce(kept, '') ELSE line END, chr(10) ORDER BY n) FILTER (NOT whole), '') AS clean
  FROM rebuilt GROUP BY doc_id),
counts AS (
  SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed,
         string_agg(place || ':' || CAST(start AS BIGINT) || ':' || size, ',' ORDER BY place) FILTER (gone) AS removed
  FROM marked GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN clean END AS clean, coalesce(n_units, 0) AS n_units,
       coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed
FROM documents LEFT JOIN texts USING (doc_id) LEFT JOIN counts USING (doc_id)""",
    "op11_term_pipeline": r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
held AS (SELECT * FROM words WHERE len(ts) > 0),
total AS (SELECT count(*) AS big_n, CAST(sum(len(ts)) AS BIGINT) AS big_l FROM held),
wanted AS (
  SELECT DISTINCT item_id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark),
each AS (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS t FROM held),
tf AS (
  SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, t, count(*) AS tf FROM each
  WHERE t IN (SELECT t FROM wanted) GROUP BY r, t),
df AS (
  SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * (SELECT big_n FROM total) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
  FROM tf GROUP BY t),
part AS (
  SELECT r, doc_id, t,
         (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * (SELECT big_n FROM total)) // (SELECT big_l FROM total))) AS p
  FROM tf),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * p) AS BIGINT) AS score FROM wanted JOIN part USING (t) JOIN df USING (t)
  GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50""",
    "op12_structure_repair": _repair_sql(),
}
