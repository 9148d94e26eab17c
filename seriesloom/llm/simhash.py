"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has one bit per position of the shingles' hashes: the majority's bit. For
a radius r, every bit position is given a non-zero vector of r + 1 bits. Each non-zero
mask vector then keeps the positions whose vector has an odd product with it. Any r
positions leave some mask vector orthogonal to all of theirs, so a pair that differs in
at most r bits agrees on everything that mask keeps: it collides in one of the
``2**(r + 1) - 1`` tables, always, not just probably.

Equal fingerprints collapse first. In a small bucket the few members are compared with
one another. A larger bucket is never paired: there two fingerprints within two bits
meet at a common centre, at most one bit from both, so each member is listed under its
65 centres and linked to the smallest at each. That finds the same components with work
in proportion to the members. For another radius than two, a larger bucket is cut into
blocks, each pair of blocks is a task, and a task returns the links of a spanning forest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import stored, text_udf
from seriesloom.llm.components import connected_components

BITS = 64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Members up to which a bucket is compared pair by pair.
SMALL = 12
#: Members of a larger bucket that one task compares with as many others.
BLOCK = 1024


def fingerprint(text: str, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of a whole text's word shingles, repeats included."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    rows = zip(*[words[i:] for i in range(shingle)]) if len(words) >= shingle else [words]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in map(b" ".join, rows)), dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(hashes), 16_384):
        part = hashes[lo:lo + 16_384].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def masks(radius: int) -> list[int]:
    """The covering masks for a radius, as signed 64-bit numbers."""
    width = radius + 1
    vectors = [i % ((1 << width) - 1) + 1 for i in range(BITS)]
    made = []
    for v in range(1, 1 << width):
        mask = sum(1 << i for i in range(BITS) if (vectors[i] & v).bit_count() % 2)
        made.append(mask - (1 << 64) if mask >> 63 else mask)
    return made


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) fingerprints that differ in at most ``radius`` bits, enough of them to join
    every component; ``prints`` has one distinct long column ``fp`` without nulls."""
    tables = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(radius)])).alias("t", "kept")
    rows = stored(prints.select("fp", tables), "tables")
    sizes = stored(rows.groupBy("t", "kept").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = stored(rows.join(sizes, ["t", "kept"]), "members")
    few = members.where(F.col("n") <= SMALL).select("t", "kept", "fp")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = (
        few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["t", "kept"])
        .where((F.col("a") < F.col("b")) & near).select("a", "b")
    )
    many = members.where(F.col("n") > SMALL)
    if radius == 2:
        return pairs.unionByName(_by_centres(many.select("fp").distinct()))
    return pairs.unionByName(_by_blocks(many, radius))


def _forest(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within the radius that join all rows which such pairs connect."""
    bits = prints.view(np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None]) <= radius
    fresh = np.ones(len(bits), dtype=bool)
    a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for start in range(len(bits)):
        todo = [start] if fresh[start] else []
        fresh[start] = False
        while todo:
            at = todo.pop()
            new = np.flatnonzero(near[at] & fresh)
            fresh[new] = False
            a.append(np.full(len(new), at))
            b.append(new)
            todo += new.tolist()
    return np.concatenate(a), np.concatenate(b)


def _by_blocks(members: DataFrame, radius: int) -> DataFrame:
    """Links inside large buckets, block against block, pairs never leaving a task."""
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    rows = members.withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    )
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = rows.withColumn("partner", partner).select(
        "t", "kept", F.least("block", "partner").alias("i"), F.greatest("block", "partner").alias("j"), "fp"
    )

    def run(table: pa.Table) -> pa.Table:
        prints = table.column("fp").to_numpy()
        a, b = _forest(prints, radius)
        return pa.table({"a": pa.array(prints[a], pa.int64()), "b": pa.array(prints[b], pa.int64())})

    return tasks.groupBy("t", "kept", "i", "j").applyInArrow(run, "a long, b long")


def _by_centres(prints: DataFrame) -> DataFrame:
    """Links at two bits among many fingerprints: those at most one bit from a common centre."""
    flips = F.array(*[F.lit(0).cast("long")] + [F.lit(_signed(1 << i)) for i in range(BITS)])
    spots = prints.select("fp", F.explode(flips).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre")
    )
    spots = stored(spots, "centres")
    least = stored(spots.groupBy("centre").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1"), "least")
    return spots.join(least.select("centre", "b"), "centre").where(F.col("fp") != F.col("b")).select(
        F.col("fp").alias("a"), "b"
    )


def groups(
    docs: DataFrame, radius: int = 2, shingle: int = 3, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, fp long, component_id) per row of ``docs``.

    ``component_id`` is the smallest document number reachable by links, itself
    included. Null and empty texts have the fingerprint zero and link like any other.
    Rows without a number are kept and take part; they get the smallest number of their
    component, null if none has one. Repeated rows get equal results. Other columns of
    ``docs`` are not looked at.
    """
    made = text_udf(lambda: lambda t: (fingerprint(t, shingle),), "fp long")
    rows = stored(
        docs.select(F.col(doc_id).alias("doc_id"), made(F.col(text))["fp"].alias("fp")), "fingerprints"
    )
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = connected_components(links(prints.select("fp"), radius)).withColumnRenamed("node", "fp")
    joined = stored(prints.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(joined.select("fp", "root").join(stored(named, "named"), "root"), "labels")
    return rows.join(named.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(
    docs: DataFrame, radius: int = 2, shingle: int = 3, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group: the smallest number.

    Rows that repeat both number and text stay once. Rows without a number stay.
    """
    found = groups(docs, radius, shingle, doc_id, text)
    keepers = stored(found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct(), "keepers")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("version"),
    )
    named = rows.join(keepers, "doc_id", "left_semi").dropDuplicates(["doc_id", "version"])
    return named.unionByName(rows.where(F.col("doc_id").isNull())).select("row.*")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
