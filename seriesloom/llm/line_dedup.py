"""Substring dedup by hashing the clauses of lines.

A text's lines are cut into clauses behind punctuation. Clauses are compared by a digest of
their normalised form, grouped over the whole corpus: of equal ones the earliest by document
and place stays, later ones are repeats. One repeated clause alone means little, so repeats
are cut only where neighbouring ones hold ``LEAST_WORDS`` words together; such a run may
begin in mid-line and go over lines. What is removed is reported with its place in the
original text. Only digests and numbers are grouped, each digest once for a document; texts
move once, to meet the list of their own repeated digests.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import stored

#: Words of neighbouring repeated clauses from which they are cut. A passage of 50 words
#: begins and ends in clauses that are not repeated as a whole.
LEAST_WORDS = 30
_ENDS = ".!?,;:。！？，；：、"
_CLAUSE = re.compile(f"[^{_ENDS}]+[{_ENDS}]*|[{_ENDS}]+")
#: Letters of scripts written without blanks: each counts as a word.
_UNSPACED = re.compile("[฀-๿぀-ヿ㐀-鿿]")
_LAST = 2**63 - 1


class Clause(NamedTuple):
    line: int
    start: int
    end: int
    norm: str


def clauses(text: str) -> list[Clause]:
    """The clauses of a text that hold more than blanks and punctuation.

    The normalised form is lower case, has runs of white space as one blank, and neither
    the punctuation behind the clause nor blanks at its ends.
    """
    out, at = [], 0
    for n, line in enumerate(text.split("\n")):
        for m in _CLAUSE.finditer(line):
            norm = " ".join(m.group().rstrip(_ENDS).lower().split())
            if norm:
                out.append(Clause(n, at + m.start(), at + m.end(), norm))
        at += len(line) + 1
    return out


def words(norm: str) -> int:
    n = norm.count(" ") + 1
    return n if norm.isascii() else n + len(_UNSPACED.findall(norm))


def digest(norm: str) -> int:
    n = xxhash.xxh3_64_intdigest(norm.encode("utf-8", "replace"))
    return n - (1 << 64) if n >> 63 else n


def spans_to_cut(units: list[Clause], repeated: set[int], least_words: int) -> list[int]:
    """Places of the clauses to cut: ``repeated`` has digests that earlier documents hold."""
    seen: set[int] = set()
    gone: list[int] = []
    run: list[int] = []
    size = 0
    for place, unit in enumerate(units):
        d = digest(unit.norm)
        if d in repeated or d in seen:
            run.append(place)
            size += words(unit.norm)
        else:
            if size >= least_words:
                gone += run
            run, size = [], 0
        seen.add(d)
    return gone + run if size >= least_words else gone


def without(text: str, units: list[Clause], gone: list[int]) -> str:
    """The text without some clauses; a line that loses all of them goes with its end."""
    cut = set(gone)
    of_line: dict[int, list[tuple[Clause, bool]]] = {}
    for place, unit in enumerate(units):
        of_line.setdefault(unit.line, []).append((unit, place in cut))
    out, at = [], 0
    for n, line in enumerate(text.split("\n")):
        mine = of_line.get(n, [])
        if not any(c for _, c in mine):
            out.append(line)
        elif not all(c for _, c in mine):
            kept, last = [], 0
            for unit, c in mine:
                if c:
                    kept.append(line[last:unit.start - at])
                    last = unit.end - at
            out.append("".join(kept) + line[last:])
        at += len(line) + 1
    return "\n".join(out)


def _key(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    """Rank of a document, and a hash that tells texts of one number apart."""
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("rank"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("version"),
    ]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [
            np.fromiter({digest(u.norm) for u in clauses(t or "")}, dtype=np.int64)
            for t in batch.column("text").to_pylist()
        ]
        sizes = [len(x) for x in found]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate(found) if found else [], pa.int64()),
            *(pa.array(np.repeat(batch.column(c).to_numpy(), sizes), pa.int64()) for c in ("rank", "version")),
        ], names=["digest", "rank", "version"])


def repeated_digests(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(rank, version, repeated): of each document the clause digests that an earlier one holds.

    Counts and smallest numbers are reduced before they are shuffled; the join by digest
    has both sides shuffled, so that a clause found in a third of all documents is split
    over tasks.
    """
    rows = docs.select(*_key(docs, doc_id, text), F.col(text).alias("text"))
    found = stored(rows.mapInArrow(_digests, "digest long, rank long, version long"), "clauses")
    several = stored(
        found.groupBy("digest").agg(F.count("*").alias("n"), F.min("rank").alias("first")).where("n > 1").drop("n"),
        "repeats",
    )
    held = stored(found.join(several, "digest"), "held")
    # Several texts of the first number: the one with the smallest hash is the earliest.
    first = held.where("rank = first").select("digest", "version")
    ties = stored(
        first.groupBy("digest").agg(F.count("*").alias("n"), F.min("version").alias("least")).where("n > 1").drop("n"),
        "ties",
    )
    late = held.where("rank <> first").select("rank", "version", "digest").unionByName(
        held.where("rank = first").join(ties, "digest").where("version <> least").select("rank", "version", "digest")
    )
    return late.groupBy("rank", "version").agg(F.collect_set("digest").alias("repeated"))


_MADE = "clean string, n_units long, removed array<struct<place:int,start:long,length:long>>"


def _cut_out(least_words: int):
    def one(text: str | None, repeated) -> tuple:
        if text is None:
            return None, 0, []
        units = clauses(text)
        gone = spans_to_cut(units, set() if repeated is None else set(repeated.tolist()), least_words)
        spans = [{"place": p, "start": units[p].start, "length": units[p].end - units[p].start} for p in gone]
        return without(text, units, gone) if gone else text, len(units), spans

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lists in batches:
            yield pd.DataFrame([one(t, r) for t, r in zip(texts, lists)], columns=["clean", "n_units", "removed"])

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, _MADE)


def with_clean(docs: DataFrame, least_words: int, doc_id: str, text: str) -> DataFrame:
    """(row, made): each row of ``docs`` as a struct beside its clean text and spans."""
    late = stored(repeated_digests(docs, doc_id, text), "late")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_key(docs, doc_id, text))
    # Lists are larger than their compressed size says: never broadcast, at any size.
    both = rows.join(late.hint("merge"), ["rank", "version"], "left")
    return both.select("row", _cut_out(least_words)(F.col(f"row.`{text}`"), F.col("repeated")).alias("made"))


def remove_repeats(
    docs: DataFrame, least_words: int = LEAST_WORDS, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, clean, n_units, n_removed, removed) per row of ``docs``.

    ``removed`` lists the cut clauses as (place, start, length): their number among the
    text's clauses and their characters in the original text. ``clean`` is the text of
    what stays; lines that lose every clause go with their line end. Rank is the document
    number (rows without one rank last), then a hash of the text, then the place; a
    document's own later repeats count like those of other documents. Rows that repeat
    both number and text are one document and get equal results. Null texts have no clause
    and stay null; empty ones stay empty. Runs of repeated clauses below ``least_words``
    words stay; letters of scripts without blanks count as words. Nothing is capped, other
    columns are not looked at, an empty table gives none.
    """
    return with_clean(docs, least_words, doc_id, text).select(
        F.col(f"row.`{doc_id}`").alias("doc_id"), "made.clean", "made.n_units",
        F.size("made.removed").cast("long").alias("n_removed"), "made.removed",
    )


def cleaned(
    docs: DataFrame, least_words: int = LEAST_WORDS, doc_id: str = "doc_id", text: str = "text",
    n_chars: str | None = None,
) -> DataFrame:
    """``docs`` with the clean text in place of the text, and its length in ``n_chars``.

    All rows and columns stay, under the rules of ``remove_repeats``; a null text stays
    null with length 0.
    """
    made = with_clean(docs, least_words, doc_id, text)
    new = {text: F.col("made.clean")}
    if n_chars is not None and n_chars in docs.columns:
        kind = docs.schema[n_chars].dataType
        new[n_chars] = F.coalesce(F.length("made.clean"), F.lit(0)).cast(kind)
    return made.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
