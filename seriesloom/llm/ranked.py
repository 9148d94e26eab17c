"""Ranked lexical search by pipelined term partitioning.

Terms have owners by how common they are: the rarest belong to the first stage, the most
common to the last. A bundle of items visits the owners one after another. Between two
stages it carries sparse accumulators, the integer scores so far of the documents met so
far; at each stage it is cogrouped with the owner's postings, whose contributions are
added. After the last stage the best of each item are selected.

Documents lie in ranges of row numbers, and a bundle is worked on for each range by itself,
so a group holds at most ``BUNDLE`` items and ``RANGE`` documents, however common a term.
Inside a range an accumulator is dropped only when what its item's later owners can add
at most leaves it below the item's k-th score reached there: it can then not be among the
best, so results are exact.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import stored

#: Term owners: a term is of stage s if fewer than ``SHARES[s]`` of all documents hold it.
SHARES = (1 / 256, 1 / 32, 1 / 8)
BUNDLE = 256        # mean number of items in a bundle
RANGE = 4096        # documents of a range

_TERM_BYTES = bytearray(range(256))
for _b in range(128):
    if 65 <= _b <= 90:
        _TERM_BYTES[_b] = _b + 32
    elif not (48 <= _b <= 57 or 97 <= _b <= 122):
        _TERM_BYTES[_b] = 32
_TERM_BYTES = bytes(_TERM_BYTES)


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a whole UTF-8 text with repeats: letters and digits, and all beyond ASCII."""
    return (text or b"").translate(_TERM_BYTES).split()


def _counted(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, terms, tfs) per row: term count with repeats, distinct terms, their counts."""

    def run(batches):
        for batch in batches:
            names: list[bytes] = []
            counts: list[int] = []
            lengths, ends = [], [0]
            for body in batch.column("body").to_pylist():
                words = terms(body)
                found = Counter(words)
                names += found.keys()
                counts += found.values()
                lengths.append(len(words))
                ends.append(len(names))
            offsets = np.array(ends, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(names, pa.binary())),
                pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
            ], names=["key", "n", "terms", "tfs"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("body")).mapInArrow(
        run, "key long, n long, terms array<binary>, tfs array<long>"
    )


def _stage_of(df: Column, n: int) -> Column:
    """The stage that owns a term which ``df`` of ``n`` documents hold."""
    stage = F.lit(len(SHARES))
    for s, share in reversed(list(enumerate(SHARES))):
        stage = F.when(df < F.lit(share * n), F.lit(s)).otherwise(stage)
    return stage


_CARRIED = (
    "bundle int, range long, item long, terms array<array<long>>, rest array<long>, "
    "rows array<long>, docs array<long>, scores array<long>"
)
_BEST = "item long, doc_id long, score long"


def _lists(table: pa.Table, name: str) -> list[np.ndarray]:
    """The arrays of a list column, one for each row."""
    column = pa.concat_arrays(table.column(name).chunks)
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _visit(stage: int, last: bool, k: int):
    """What the owner of a stage does with a bundle's accumulators in one range."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, doc, adds, owned = (right.column(c).to_numpy() for c in ("row", "doc_id", "adds", "term_id"))
        here, place = np.unique(row, return_inverse=True)
        doc_at = np.zeros(len(here), dtype=np.int64)
        doc_at[place] = doc
        order = np.argsort(owned, kind="stable")
        owned, place, adds = owned[order], place[order], adds[order]
        names, starts = np.unique(owned, return_index=True)
        spans = dict(zip(names.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(owned)])))
        rest = [x[stage] for x in left.column("rest").to_pylist()]
        wanted = [x[stage] for x in left.column("terms").to_pylist()]
        out: list[list] = [[], [], []]
        for bound, ids, rows, docs, scores in zip(
            rest, wanted, _lists(left, "rows"), _lists(left, "docs"), _lists(left, "scores")
        ):
            total = np.zeros(len(here), dtype=np.int64)
            for t in ids:
                if t in spans:
                    a, b = spans[t]
                    total[place[a:b]] += adds[a:b]
            new = np.flatnonzero(total)
            rows = np.concatenate([rows, here[new]])
            docs = np.concatenate([docs, doc_at[new]])
            scores = np.concatenate([scores, total[new]])
            rows, first, back = np.unique(rows, return_index=True, return_inverse=True)
            sums = np.zeros(len(rows), dtype=np.int64)
            np.add.at(sums, back, scores)
            docs, scores = docs[first], sums
            if last:
                best = np.lexsort((docs, -scores))[:k]
                rows, docs, scores = rows[best], docs[best], scores[best]
            elif len(scores) > k:
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                stay = scores + bound >= least
                rows, docs, scores = rows[stay], docs[stay], scores[stay]
            for to, values in zip(out, (rows, docs, scores)):
                to.append(values)
        if last:
            sizes = [len(x) for x in out[0]]
            items = left.column("item").to_numpy()
            return pa.table({
                "item": pa.array(np.repeat(items, sizes), pa.int64()),
                "doc_id": pa.array(np.concatenate(out[1]) if out[1] else [], pa.int64()),
                "score": pa.array(np.concatenate(out[2]) if out[2] else [], pa.int64()),
            })
        for name, values in zip(("rows", "docs", "scores"), out):
            left = left.set_column(
                left.column_names.index(name), name, pa.array(values, pa.list_(pa.int64()))
            )
        nested = left.schema.get_field_index("terms")
        kind = pa.list_(pa.list_(pa.int64()))
        left = left.set_column(nested, "terms", left.column("terms").cast(kind))
        return left.set_column(left.schema.get_field_index("rest"), "rest", left.column("rest").cast(pa.list_(pa.int64())))

    return run


#: Documents without a number come after all others among equal scores.
_NO_NUMBER = 2**63 - 1


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` documents of highest score above 0.

    Equal scores rank by ascending document number, documents without one last. Null and
    empty texts hold no term: such a document is not counted, such an item finds nothing.
    Every row of ``docs`` is a document of its own, repeated rows too; they then take a
    rank each. Rows of one item number, or of none, are one item with all their terms.
    Empty tables give no rows. Other columns are not looked at.
    """
    spark: SparkSession = docs.sparkSession
    asked = _counted(items.select(F.col(item_id).alias("k"), F.col(item_text).alias("t")), "k", "t")
    asked = stored(
        asked.select(F.col("key").alias("item_id"), F.explode("terms").alias("term")).distinct(), "asked"
    )
    # Numbers for the items and terms: any, as long as they are different, and written once.
    named = stored(asked.select("item_id").distinct().select(
        F.monotonically_increasing_id().alias("item"), "item_id"), "items")
    words = stored(asked.select("term").distinct().select(
        F.monotonically_increasing_id().alias("term_id"), "term"), "terms")
    counted = _counted(docs.select(F.col(doc_id).alias("k"), F.col(text).alias("t")), "k", "t")
    rows = stored(
        counted.where("n > 0").select(
            F.monotonically_increasing_id().alias("row"), F.coalesce("key", F.lit(_NO_NUMBER)).alias("doc_id"), "n",
            F.arrays_zip("terms", "tfs").alias("found"),
        ),
        "counted",
    )
    number, length = rows.agg(F.count("*"), F.sum("n")).first()
    if not number:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = rows.select("row", "doc_id", "n", F.explode("found").alias("x"))
    hits = found.select("row", "doc_id", "n", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
    hits = hits.join(words, "term").drop("term")
    # Postings with their contribution before the weight: (1e9 tf) div (1000 tf + 20 m).
    m = F.lit(50) + F.expr(f"(50 * n * {number}L) div {length}L")
    part = F.expr("(1000000000L * tf) div (1000 * tf + 20 * m)")
    hits = stored(hits.withColumn("m", m).select("row", "doc_id", "term_id", part.alias("part")), "hits")
    stats = hits.groupBy("term_id").agg(F.count("*").alias("df"), F.max("part").alias("most"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * number + 2.0) / (2 * F.col("df") + 1).cast("double")))
    stats = stored(
        stats.withColumn("w", weight.cast("long")).withColumn("stage", _stage_of(F.col("df"), number)), "weights"
    )
    bundles = max(1, -(-named.count() // BUNDLE))
    bundle = F.pmod(F.xxhash64("item", F.lit(3)), F.lit(bundles)).cast("int").alias("bundle")
    known = stored(
        asked.join(words, "term").join(stats, "term_id").join(
            named.withColumnRenamed("item_id", "asked_id"), F.col("item_id").eqNullSafe(F.col("asked_id"))
        ).select("item", bundle, "term_id", "w", "most", "stage"),
        "wanted",
    )
    stages = range(len(SHARES) + 1)
    later = [F.sum(F.when(F.col("stage") > s, F.col("w") * F.col("most")).otherwise(0)) for s in stages]
    ids = [F.collect_list(F.when(F.col("stage") == s, F.col("term_id"))) for s in stages]
    none = F.array().cast("array<long>")
    ranges = -(-number // RANGE)
    carried = known.groupBy("bundle", "item").agg(
        F.array(*ids).alias("terms"), F.array(*later).alias("rest")
    ).select(
        "bundle", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1)).cast("array<long>")).alias("range"), "item",
        "terms", "rest", none.alias("rows"), none.alias("docs"), none.alias("scores"),
    )
    owners = stored(known.select("bundle", "term_id", "w", "stage").distinct(), "owners")
    postings = hits.join(owners, "term_id").select(
        "bundle", F.pmod(F.xxhash64("row"), F.lit(ranges)).alias("range"), "stage", "row", "doc_id", "term_id",
        (F.col("w") * F.col("part")).alias("adds"),
    )
    postings = postings.where("adds > 0")
    for s in stages:
        last = s == stages[-1]
        own = postings.where(F.col("stage") == s).drop("stage")
        carried = carried.groupBy("bundle", "range").cogroup(own.groupBy("bundle", "range")).applyInArrow(
            _visit(s, last, k), _BEST if last else _CARRIED
        )
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    best = carried.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(named, "item").select(
        "item_id", "rank", F.nullif("doc_id", F.lit(_NO_NUMBER)).alias("doc_id"), "score"
    )
