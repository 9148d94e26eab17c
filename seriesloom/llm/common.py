"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.session import materialize


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder: survives lost executors, cuts lineage."""
    return materialize(df, label)


def text_udf(make: Callable[[], Callable[[str], tuple]], schema: str):
    """Arrow-batched function of one text column; null counts as empty.

    ``make`` runs once per task and returns the function of a single text, whose
    caches then live as long as the task.
    """

    def each() -> Callable[[list[str]], list[tuple]]:
        fn = make()
        return lambda texts: [fn(t) for t in texts]

    return texts_udf(each, schema)


def texts_udf(make: Callable[[], Callable[[list[str]], list[tuple]]], schema: str, chars: int = 1_000_000):
    """As ``text_udf`` for a function of several texts, given about ``chars`` letters at once."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fn = make()
        for texts in batches:
            out: list[tuple] = []
            part: list[str] = []
            size = 0
            for t in texts:
                part.append(t or "")
                size += len(part[-1])
                if size > chars:
                    out += fn(part)
                    part, size = [], 0
            if part:
                out += fn(part)
            yield pd.DataFrame(out, columns=names)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, schema)


def held_out(doc_id: Column) -> Column:
    """Every fifth document by checksum of its number is kept from training."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def byte_alphabet() -> dict[str, int]:
    """Printable Latin-1 bytes stand for themselves, the others for U+0100 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bounded(dict):
    """Memo of a function in two generations, of ``limit`` entries each.

    When the young one is full it becomes the old one, and the former old one goes;
    what is asked for again moves back. Frequent keys so stay, memory is bounded.
    Keys longer than ``longest`` are not kept.
    """

    def __init__(self, fn: Callable, limit: int = 250_000, longest: int = 48) -> None:
        super().__init__()
        self.fn, self.limit, self.longest, self.old = fn, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def training_rows(
    documents: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int],
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, text, y) of at most ``per_class[y]`` labelled, not held-out documents of class y.

    The rows with the smallest hashes of their numbers are taken, so the sample does
    not depend on partitions. Several labels of one document: the largest counts.
    Only labels are ranked; texts are read by a filter on at most ``sum(per_class)``
    numbers, which is a proven bound for the broadcast.
    """
    spark = documents.sparkSession
    marked = (
        labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    )
    marked = stored(marked, "marked")
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    picked = None
    for y, n in sorted(counts.items()):
        # A first cut by hash value leaves the ordering little more than the bound.
        share = min(1.0, 1.5 * per_class[y] / n + 100 / n)
        top = int(-(2**63) + share * (2**64 - 1))
        part = marked.where((F.col("y") == y) & (F.col("h") <= F.lit(min(top, 2**63 - 1))))
        part = part.orderBy("h", "doc_id").limit(per_class[y]).select("doc_id", "y")
        picked = part if picked is None else picked.unionByName(part)
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if picked is None:
        return spark.createDataFrame([], "doc_id long, text string, y int")
    return docs.join(F.broadcast(picked), "doc_id")
