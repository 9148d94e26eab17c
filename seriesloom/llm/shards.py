"""Shards of near equal size by longest processing time.

Documents with equal texts form a group that must stay together. Groups are taken from
the largest to the smallest, each to the least loaded shard, which a heap yields. Large
groups, those above a thousandth of a shard's even share, are placed one by one: there
are at most a thousand times as many of them as shards, however large the corpus.
The rest only matter by size: they are counted in classes of nearly equal size, a
bounded number whatever the corpus, and each class is dealt to the shards as the heap
would deal its groups. Which group of a class goes where follows from its place
in a hash order of that class, worked out by tasks over parts of the class.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import stored

#: Groups above this part of a shard's even share are placed one by one.
LARGE = 1e-3
#: Steps of size between two powers of two in which smaller groups are counted.
STEPS = 64
CELLS = 1024


def deal(classes: list[tuple[float, int]], loads: list[float]) -> list[list[int]]:
    """How many groups of each (size, count) class each shard gets; ``loads`` is updated.

    Classes come in falling order of size. Within a class the heap's choices are worked
    out at once: whole rounds while all loads stay within one size, else one by one.
    """
    shards = len(loads)
    out = []
    for size, count in classes:
        got = [0] * shards
        left = count
        if left > 4 * shards and size > 0:
            # Level the loads: the heap fills the lowest shards up to a common height.
            order = sorted(range(shards), key=lambda s: (loads[s], s))
            height, filled = 0.0, 0
            for k in range(1, shards + 1):
                total = sum(loads[s] for s in order[:k])
                height, filled = (total + left * size) / k, k
                if k == shards or height <= loads[order[k]]:
                    break
            for s in order[:filled]:
                n = max(min(int((height - loads[s]) / size), left), 0)
                got[s] += n
                loads[s] += n * size
                left -= n
        heap = [(load, s) for s, load in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(left):
            load, s = heapq.heappop(heap)
            got[s] += 1
            loads[s] = load + size
            heapq.heappush(heap, (loads[s], s))
        out.append(got)
    return out


def assign(
    docs: DataFrame, shards: int = 40, overhead: int = 16, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row of ``docs``.

    The law is ``bytes``: the sizes of the shards are as equal as whole groups allow.
    Size is the text's UTF-8 bytes plus ``overhead``. A null text has no bytes, is of
    the group of the empty text, and has the empty text's checksum. ``slot`` counts the
    rows of a shard from 0 without gaps. Rows without a number and repeated rows are
    placed like any other; equal rows get different slots. An empty table gives none.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"), (F.length(body) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"), F.unhex(F.md5(body)).alias("digest"),
        ),
        "sizes",
    )
    groups = stored(
        rows.groupBy("digest").agg(F.sum("size").alias("weight")).withColumn(
            "cell", F.pmod(F.xxhash64("digest"), F.lit(CELLS)).cast("int")
        ),
        "groups",
    )
    total = groups.agg(F.sum("weight")).first()[0] or 0
    limit = max(total / shards * LARGE, 1.0)
    large = groups.where(F.col("weight") > limit).select("digest", "weight").collect()
    large.sort(key=lambda r: (-r["weight"], bytes(r["digest"])))
    loads = [0.0] * shards
    fixed = [
        (bytes(r["digest"]), next(s for s, n in enumerate(got) if n))
        for r, got in zip(large, deal([(float(r["weight"]), 1) for r in large], loads))
    ]
    # A class: the power of two and the step within it.
    weight = F.greatest(F.col("weight"), F.lit(1)).cast("double")
    power = F.floor(F.log2(weight))
    kind = (power * STEPS + F.floor((weight / F.pow(F.lit(2.0), power) - 1) * STEPS)).cast("long")
    small = groups.where(F.col("weight") <= limit).withColumn("kind", kind)
    cells = stored(
        small.groupBy("kind", "cell").agg(F.count("*").alias("n"), F.sum("weight").alias("w")), "cells"
    )
    classes = cells.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).orderBy(F.desc("kind")).collect()
    dealt = deal([(r["w"] / r["n"], r["n"]) for r in classes], loads)
    spans = []
    for r, got in zip(classes, dealt):
        at = 0
        for s, n in enumerate(got):
            if n:
                spans.append((r["kind"], at, at + n, s))
                at += n
    # Place of each small group in its class: groups in cells before it, then its cell's.
    before = cells.withColumn(
        "before", F.sum("n").over(Window.partitionBy("kind").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    ).select("kind", "cell", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = small.withColumn(
        "own", F.row_number().over(Window.partitionBy("kind", "cell").orderBy("digest")) - 1
    ).join(stored(before, "before"), ["kind", "cell"]).withColumn("at", F.col("own") + F.col("before"))
    # At most shards ranges for each of the classes, and the large groups: both bounded.
    table = spark.createDataFrame(spans, "kind long, lo long, hi long, shard int")
    by_kind = table.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "shard"))).alias("ranges"))
    ranked = ranked.join(F.broadcast(by_kind), "kind").select(
        "digest", F.filter("ranges", lambda x: (x["lo"] <= F.col("at")) & (F.col("at") < x["hi"]))[0]["shard"].alias("shard"),
    )
    places = ranked.unionByName(spark.createDataFrame(fixed, "digest binary, shard int"))
    placed = stored(
        rows.join(stored(places, "places"), "digest").select(
            "doc_id", "size", "text_crc32", "shard",
            F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(CELLS)).cast("int").alias("cell"),
        ),
        "placed",
    )
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    offsets = counts.withColumn(
        "before", F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    ).select("shard", "cell", F.coalesce("before", F.lit(0)).alias("before"))
    own = placed.withColumn(
        "own", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")) - 1
    )
    # One row for each shard and cell: at most shards * CELLS, bounded.
    return own.join(F.broadcast(stored(offsets, "offsets")), ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("own") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
