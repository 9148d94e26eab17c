"""Nearest vectors by collision-counting hashing.

Largest inner products become smallest distances by one added coordinate. Every vector
is projected on many single lines; the projections on each line are kept sorted. For a
query, a window around its own projection is opened on every line, and a vector that
lies in the windows of more lines than a threshold is a candidate. Virtual rehashing
widens all windows in proportion until enough vectors passed; these are then verified
by their inner product in double precision.

The vectors are dealt to blocks by ranges of norm, then by hash, each with its own sorted
lines and its own largest norm for the added coordinate: a few long vectors do not press
the others together. Sparse ranges are joined while a block of them is verified whole.
The queries go in blocks to every one of them. Each block returns its best of every query, and these
are merged with a limit that is applied before rows are shuffled.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm import vectors as V
from seriesloom.llm.common import stored

LINES = 64           # projections, orthogonal in groups of the dimension
BLOCK = 8192         # vectors of one block
QUERIES = 2048       # queries that meet a block at once
WIDEN = 1.12         # factor between window widths
SHARE = 0.6          # part of the lines on which a candidate must collide
ENOUGH = 0.10        # part of a block that passes before windows stop widening
LEAST = 1024         # and at least so many
RATIO = 1.1          # largest to smallest norm of a range


class Windows(NamedTuple):
    """Settings of the windows; they travel with the search to its workers."""

    lines: int = LINES
    widen: float = WIDEN
    share: float = SHARE
    enough: float = ENOUGH
    least: int = LEAST


def lines(d: int, m: int, seed: int) -> np.ndarray:
    """``m`` unit rows, orthogonal within each group of ``d``."""
    rng = np.random.default_rng(seed)
    parts = [np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(-(-m // d))]
    return np.vstack(parts)[:m]


class Index:
    """Sorted projections of one block of vectors."""

    def __init__(self, x: np.ndarray, d: int, windows: Windows = Windows()) -> None:
        scaled = x / np.abs(x).max()
        squares = (scaled * scaled).sum(1)
        rest = np.sqrt(squares.max() - squares)
        self.x, self.windows = x, windows
        self.lines = lines(d + 1, windows.lines, 23)
        lifted = np.hstack([scaled, rest[:, None]]) / np.sqrt(squares.max())
        shadow = lifted @ self.lines.T
        self.order = np.argsort(shadow, axis=0, kind="stable")
        self.sorted = np.take_along_axis(shadow, self.order, axis=0).T.copy()
        rank = np.empty(shadow.shape, dtype=np.uint16)
        np.put_along_axis(rank, self.order, np.arange(len(x), dtype=np.uint16)[:, None], axis=0)
        self.rank = rank.T.copy()
        self.enough = min(len(x), max(windows.least, int(windows.enough * len(x))))

    def candidates(self, q: np.ndarray):
        """(query, rows of candidates) for every query, when its windows are wide enough."""
        n = len(self.x)
        scaled = q / np.linalg.norm(q, axis=1, keepdims=True)
        shadow = np.hstack([scaled, np.zeros((len(q), 1))]) @ self.lines.T
        wanted = max(int(self.windows.share * len(self.lines)), 1)
        if self.enough >= n:
            for i in range(len(q)):
                yield i, np.arange(n)
            return
        # First width: from where a few sampled vectors would just pass.
        pick = np.linspace(0, n - 1, 256).astype(int)
        sample = np.empty((len(self.lines), len(pick)))
        for m in range(len(self.lines)):
            sample[m] = self.sorted[m, self.rank[m, pick]]
        for lo in range(0, len(q), 64):
            part = shadow[lo:lo + 64]
            gap = np.partition(np.abs(sample.T[None] - part[:, None, :]), wanted - 1, axis=2)[:, :, wanted - 1]
            width = np.quantile(gap, self.enough / n, axis=1)
            todo = np.arange(len(part))
            while len(todo):
                hits = np.zeros((len(todo), n), dtype=np.uint8)
                for m in range(len(self.lines)):
                    centre = part[todo, m]
                    first = np.searchsorted(self.sorted[m], centre - width[todo], side="left")
                    last = np.searchsorted(self.sorted[m], centre + width[todo], side="right")
                    inside = (self.rank[m][None] - first.astype(np.uint16)[:, None]) < (
                        last - first).astype(np.uint16)[:, None]
                    hits += inside
                passed = hits >= wanted
                done = passed.sum(1) >= self.enough
                for i in np.flatnonzero(done):
                    yield lo + int(todo[i]), np.flatnonzero(passed[i])
                todo = todo[~done]
                width[todo] *= self.windows.widen


def ranges(counts: dict[int, int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(range, first block, blocks) of every range of norm, given its number of vectors.

    From the longest down, neighbours share a block as long as it is verified whole.
    """
    joined: list[tuple[list[int], int]] = []
    for at in sorted(counts, reverse=True):
        if joined and joined[-1][1] + counts[at] <= least:
            joined[-1] = ([*joined[-1][0], at], joined[-1][1] + counts[at])
        else:
            joined.append(([at], counts[at]))
    made, first = [], 0
    for members, n in joined:
        blocks = -(-n // BLOCK)
        made += [(at, first, blocks) for at in members]
        first += blocks
    return made


def _search(d: int, k: int, windows: Windows):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asked = table.column("asked").to_numpy(zero_copy_only=False)
        ids = table.column("vec_id").to_numpy()
        x = V.stack(table.column("vec"), d)
        query_ids, own = ids[asked], ids[~asked]
        out_q, out_r, out_s = [], [], []
        if len(query_ids) and len(own):
            order = np.argsort(own, kind="stable")
            own, data, q = own[order], x[~asked][order], x[asked]
            index = Index(data, d, windows)
            for i, rows in index.candidates(q):
                rows = rows[own[rows] != query_ids[i]]
                score = data[rows] @ q[i]
                if len(rows) > k:
                    # Keep ties with the last one; numbers rise with rows.
                    least = np.partition(score, len(score) - k)[len(score) - k]
                    near = np.flatnonzero(score >= least)
                    rows, score = rows[near], score[near]
                    best = np.lexsort((own[rows], -score))[:k]
                    rows, score = rows[best], score[best]
                out_q.append(np.full(len(rows), query_ids[i]))
                out_r.append(own[rows])
                out_s.append(score)
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
        return pa.table({
            "query_id": join(out_q, pa.int64()), "vec_id": join(out_r, pa.int64()), "score": join(out_s, pa.float64()),
        })

    return run


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
    windows: Windows = Windows(),
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found of each query.

    Queries are the rows of ``vectors`` for which ``is_query`` holds; all other rows are
    their candidates, a query's own number never is. Fewer candidates than ``k`` are all
    returned. Ties go to the smaller number. Vectors that are null, zero, of an odd
    length, or hold null or non-finite components take no part, nor do rows without a
    number. Rows under one number are candidates each. An empty table gives no rows.
    """
    rows, d = V.valid(vectors, vec_id, vector)
    rows = rows.where(F.col("vec_id").isNotNull())
    spark = rows.sparkSession
    # Logarithms of norms by the largest component, so that squares neither over- nor underflow.
    top = rows.withColumn("top", F.array_max(F.transform("vec", F.abs)))
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + (x / F.col("top")) * (x / F.col("top")))
    size = F.ln("top") + F.ln(square) / 2
    ranged = top.withColumn("at", F.floor(size / math.log(RATIO) + 0.5).cast("int")).drop("top")
    # Doubles span fewer than 16 000 ranges: so many rows at most reach the driver and are broadcast.
    counts = {r["at"]: r["count"] for r in ranged.groupBy("at").count().collect()}
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dealt = ranges(counts, windows.least)
    blocks = max(first + n for _, first, n in dealt)
    asked = rows.where(is_query)
    many = asked.count()
    parts = max(-(-many // QUERIES), 1)
    table = F.broadcast(spark.createDataFrame(dealt, "at int, first int, blocks int"))
    own = ranged.join(table, "at").select(
        (F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("blocks"))).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(int(parts) - 1))).alias("part"),
        F.lit(False).alias("asked"), "vec_id", "vec",
    )
    ask = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(int(blocks) - 1))).alias("block"),
        F.pmod(F.xxhash64("vec_id", F.lit(4)), F.lit(parts)).cast("int").alias("part"),
        F.lit(True).alias("asked"), "vec_id", "vec",
    )
    found = stored(
        own.unionByName(ask).groupBy("block", "part").applyInArrow(
            _search(d, k, windows), "query_id long, vec_id long, score double"
        ),
        "found",
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
