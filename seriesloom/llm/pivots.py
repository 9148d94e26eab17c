"""Near-duplicate vectors by a pivot-permutation index.

Each vector is described by its nearest pivots in order, a permutation prefix. Inverted
lists hold, for each pivot, the vectors that have it in their prefix. Two vectors that
are nearly the same have nearly the same prefix, so pairs that share at least a few
pivots are the candidates; their cosine is then worked out in double precision.

Pivots are drawn by hash, then thinned so that no two are nearly alike: a large group of
near copies keeps one or a few pivots of its own, whatever its share of the rows. Pivots in
proportion to its rows would fill its members' prefixes with near copies in random order.

Where all vectors lie in a few narrow cones, thinning leaves too few pivots for prefixes to
tell vectors apart. All vectors are then one list, of which every pair is compared.

Equal vectors collapse first and count by their number. Long lists are cut into blocks
and each pair of blocks is a task of its own, so a pivot that a third of all vectors
are near is spread. A pair that shares several pivots belongs to the smallest of them.
Pairs never leave a task: each block pair returns link counts, and links enough to join
its components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm import vectors as V
from seriesloom.llm.common import stored
from seriesloom.llm.components import connected_components

PREFIX = 12          # nearest pivots that describe a vector
SHARED = 2           # pivots two vectors must share to be compared
MOST_PIVOTS = 16_384
DRAWN = 2            # vectors drawn for each pivot wanted, as thinning leaves some out
APART = 0.1          # two pivots' cosine lies at least so far below the threshold of links
BLOCK = 512          # members of a list that one task compares
FEW = 4 * PREFIX     # with fewer pivots, all vectors are one list
WHOLE_BLOCK = 2048   # members of that list that one task compares


def n_pivots(n: int) -> int:
    """Pivots for ``n`` vectors: lists keep their mean length until the bound is reached."""
    return int(min(max(64, n // 40), MOST_PIVOTS))


def thinned(drawn: np.ndarray, alike: float, most: int) -> np.ndarray:
    """The first ``most`` of ``drawn`` whose cosine with every one taken before is below ``alike``."""
    unit = drawn / np.linalg.norm(drawn, axis=1, keepdims=True)
    taken = unit[:0]
    for lo in range(0, len(unit), 512):
        part = unit[lo:lo + 512]
        part = part[(part @ taken.T).max(1, initial=-1.0) < alike]
        near = np.triu(part @ part.T >= alike, 1)
        stay = np.ones(len(part), dtype=bool)
        for i in range(len(part)):
            if stay[i]:
                stay &= ~near[i]
        taken = np.vstack([taken, part[stay]])
        if len(taken) >= most:
            break
    return taken[:most]


def _prefixes(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(class_id, vec, n, prefix): vectors of length one and their nearest pivots, sorted."""
    unit = pivots / np.linalg.norm(pivots, axis=1, keepdims=True)
    k = min(PREFIX, len(unit))

    def run(batches):
        for batch in batches:
            x = V.stack(pa.chunked_array([batch.column("vec")]), unit.shape[1])
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            near = np.argpartition(-(x @ unit.T), k - 1, axis=1)[:, :k] if k < len(unit) else np.tile(
                np.arange(k), (len(x), 1))
            near = np.sort(near.astype(np.int32), axis=1)
            yield pa.RecordBatch.from_arrays([
                batch.column("class_id"), batch.column("n"),
                pa.array([v.tobytes() for v in x], pa.binary()),
                pa.ListArray.from_arrays(np.arange(0, near.size + 1, k, dtype=np.int32), near.ravel()),
            ], names=["class_id", "n", "vec", "prefix"])

    return rows.select("class_id", "n", "vec").mapInArrow(run, "class_id long, n long, vec binary, prefix array<int>")


def _compare(least: float, needed: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pivot, i, j = (k.as_py() for k in key)
        if not table.num_rows:
            return _result([], [], [], [])
        table = table.combine_chunks()
        ids = table.column("class_id").to_numpy()
        number = table.column("n").to_numpy()
        block = table.column("block").to_numpy()
        d = len(table.column("vec")[0].as_py()) // 8
        x = np.frombuffer(b"".join(table.column("vec").to_pylist()), dtype=float).reshape(-1, d)
        prefix = np.array(table.column("prefix").to_pylist())
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        # Shared pivots of all pairs, counted list by list; a smaller shared pivot than
        # this one means the pair belongs to that one's list.
        shared = np.zeros((len(left), len(right)), dtype=np.uint8)
        foreign = np.zeros(shared.shape, dtype=bool)
        spots: dict[int, tuple[list, list]] = {}
        for side, rows in enumerate((left, right)):
            for at, row in enumerate(prefix[rows]):
                for q in row:
                    spots.setdefault(int(q), ([], []))[side].append(at)
        for q, (a, b) in spots.items():
            if a and b:
                if q < pivot:
                    foreign[np.ix_(a, b)] = True
                else:
                    shared[np.ix_(a, b)] += 1
        near = (shared >= needed) & ~foreign
        if i == j:
            near = np.triu(near, 1)
        if np.count_nonzero(near) > near.size // 8:
            near &= x[left] @ x[right].T >= least
        else:
            a, b = np.nonzero(near)
            good = np.zeros(len(a), dtype=bool)
            for lo in range(0, len(a), 50_000):
                s = slice(lo, lo + 50_000)
                good[s] = np.einsum("ij,ij->i", x[left[a[s]]], x[right[b[s]]]) >= least
            near = np.zeros(near.shape, dtype=bool)
            near[a[good], b[good]] = True
        count = np.zeros(len(ids), dtype=np.int64)
        np.add.at(count, left, near @ number[right])
        np.add.at(count, right, near.T @ number[left])
        root = _roots(near, left, right, len(ids))
        linked = np.flatnonzero(count)
        return _result(ids[linked], count[linked], ids[linked], ids[root[linked]])

    return run


def _roots(near: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Of every row the smallest row joined to it by links, by spreading minima."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.where(near, root[right][None, :], n).min(1, initial=n)
        root[left] = np.minimum(root[left], low)
        low = np.where(near, root[left][:, None], n).min(0, initial=n)
        root[right] = np.minimum(root[right], low)
        root = root[root]
        if (root == before).all():
            return root


def _result(ids, counts, a, b) -> pa.Table:
    return pa.table({
        "class_id": pa.array(ids, pa.int64()), "links": pa.array(counts, pa.int64()),
        "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()),
    })


def near_duplicates(
    vectors: DataFrame, least: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``.

    Vectors that are null, zero, of an odd length, or hold null or non-finite components
    link with nothing: their component is their own number. Equal vectors link with one
    another, also under one number: repeated rows count as vectors of their own, and get
    equal results. Rows without a number link, count, and stay, but name no component;
    a component of only such rows is null. Pivots are taken from at most ``MOST_PIVOTS``
    vectors with the smallest hashes; every vector is indexed. With fewer than ``FEW`` pivots
    left, every pair is compared.
    """
    rows, d = V.valid(vectors, vec_id, vector)
    classes = stored(
        rows.groupBy("vec").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")).withColumn(
            "class_id", F.monotonically_increasing_id()
        ),
        "classes",
    )
    many = classes.count()
    everything = vectors.select(F.col(vec_id).alias("vec_id"), V.as_doubles(vector).alias("vec"))
    if not many:
        return everything.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
            F.lit(True).alias("kept"),
        )
    wanted = n_pivots(many)
    drawn = V.seed_rows(classes.select("vec"), min(DRAWN * wanted, MOST_PIVOTS), 17)
    pivots = thinned(drawn, least - APART, wanted)
    needed, block = SHARED, BLOCK
    if len(pivots) < FEW:
        pivots, needed, block = pivots[:1], 1, WHOLE_BLOCK
    described = stored(_prefixes(classes, pivots), "prefixes")
    members = described.select("class_id", "n", "vec", "prefix", F.explode("prefix").alias("pivot"))
    # One row per pivot: at most MOST_PIVOTS, so the lengths may be broadcast.
    lengths = stored(
        described.select(F.explode("prefix").alias("pivot")).groupBy("pivot").agg(
            F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")
        ),
        "lists",
    )
    blocks = members.join(F.broadcast(lengths), "pivot").withColumn(
        "block", F.pmod(F.xxhash64("class_id", F.lit(5)), F.col("blocks")).cast("int")
    )
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = blocks.withColumn("partner", partner).select(
        "pivot", F.least("block", "partner").alias("i"), F.greatest("block", "partner").alias("j"),
        "class_id", "n", "vec", "prefix", "block",
    )
    found = stored(
        tasks.groupBy("pivot", "i", "j").applyInArrow(
            _compare(least, needed), "class_id long, links long, a long, b long"
        ),
        "links",
    )
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select("a", "b")).withColumnRenamed("node", "class_id")
    joined = stored(
        classes.select("class_id", "vec", "n", "least").join(stored(links, "counts"), "class_id", "left")
        .join(roots, "class_id", "left").withColumn("root", F.coalesce("root", "class_id")),
        "rooted",
    )
    named = stored(joined.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    table = stored(
        joined.join(named, "root").select(
            "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
        ),
        "labels",
    )
    out = everything.join(table, "vec", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
