"""A current table in buckets: a batch rewrites only the buckets that it touches.

``data/v=<version>/bucket=<b>`` holds the rows of a bucket as one merge left them, and
``manifest/v=<version>`` names the version of every bucket and the last batch merged
from each source. A merge reads and rewrites the buckets of its own rows, then publishes
the next manifest; until then readers see the table as it was. A batch that is retried
finds either the old manifest, and writes the same folders again, or itself as merged.
One writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators.ordering import picked_rows

KEPT_VERSIONS = 2  # a reader may still hold the manifest before the newest


@dataclass(frozen=True)
class BucketTable:
    """``spread``: SQL expressions of key columns whose hash is the bucket.

    With the asset and the year of the time, a hot asset lies in many buckets, while new
    prices touch only those of their year. ``order`` picks the winner among rows of a
    key; if ``newer_batch_wins``, only inside a batch.
    """

    path: str
    schema: str
    keys: tuple[str, ...]
    order: tuple[str, ...] = ()
    spread: tuple[str, ...] = ()
    buckets: int = 64
    newer_batch_wins: bool = True

    def bucket(self) -> Column:
        parts = [F.expr(e) for e in self.spread] or [F.col(k) for k in self.keys]
        return F.pmod(F.xxhash64(*parts), F.lit(self.buckets)).cast("int")


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose folder was written to its end."""
    folder, fs = _files(spark, path)
    if not fs.exists(folder):
        return []
    names = [s.getPath() for s in fs.listStatus(folder)]
    done = [n for n in names if fs.exists(_files(spark, f"{n.toString()}/_SUCCESS")[0])]
    return sorted(int(n.getName().split("=")[1]) for n in done)


def _manifest(spark: SparkSession, table: BucketTable) -> tuple[int, dict[int, int], dict[str, int]]:
    """Newest version, version by bucket, last batch by source: bounded by buckets and sources."""
    versions = _versions(spark, f"{table.path}/manifest")
    if not versions:
        return 0, {}, {}
    rows = spark.read.schema("kind string, name string, at bigint").parquet(
        f"{table.path}/manifest/v={versions[-1]}").collect()
    held = {int(r["name"]): r["at"] for r in rows if r["kind"] == "bucket"}
    return versions[-1], held, {r["name"]: r["at"] for r in rows if r["kind"] == "source"}


def _read(spark: SparkSession, table: BucketTable, held: dict[int, int]) -> DataFrame:
    if not held:
        return spark.createDataFrame([], table.schema)
    paths = [f"{table.path}/data/v={v}/bucket={b}" for b, v in sorted(held.items())]
    return spark.read.schema(table.schema).parquet(*paths)


def current(spark: SparkSession, table: BucketTable) -> DataFrame:
    """The table as the newest manifest names it; one row per key."""
    return _read(spark, table, _manifest(spark, table)[1])


def merge(table: BucketTable, batch: DataFrame, source: str = "", batch_id: int | None = None) -> list[int]:
    """Merge ``batch`` and return the buckets rewritten.

    A ``batch_id`` at most the last one merged from ``source`` changes nothing. Rows of
    one key collapse inside the batch before any old row is read.
    """
    spark = batch.sparkSession
    version, held, merged = _manifest(spark, table)
    if batch_id is not None and batch_id <= merged.get(source, -1):
        return []
    cols = [f.name for f in spark.createDataFrame([], table.schema).schema.fields]
    rest = [c for c in cols if c not in table.keys]
    order = [*table.order] or [*table.keys]
    arrived = f"{table.path}/arrived"
    picked_rows(batch.select(*cols), [*table.keys], rest, order).withColumn("_bucket", table.bucket()).write.mode(
        "overwrite").parquet(arrived)
    new = spark.read.parquet(arrived)
    touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())
    if touched:
        old = _read(spark, table, {b: held[b] for b in touched if b in held})
        both = old.withColumns({"_bucket": table.bucket(), "_new": F.lit(False)}).unionByName(
            new.withColumn("_new", F.lit(True)))
        rank = ["_new", *order] if table.newer_batch_wins else [*order, "_new"]
        # One shuffle by bucket serves the reduction and the write.
        rows = picked_rows(both.repartition("_bucket"), ["_bucket", *table.keys], rest, rank)
        rows.withColumnRenamed("_bucket", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{table.path}/data/v={version + 1}")
    if touched or batch_id is not None:
        held.update({b: version + 1 for b in touched})
        if batch_id is not None:
            merged[source] = batch_id
        _publish(spark, table, version + 1, held, merged)
        _forget(spark, table)
    return touched


def _publish(spark: SparkSession, table: BucketTable, version: int, held: dict[int, int], merged: dict[str, int]) -> None:
    named = [("bucket", str(b), v) for b, v in held.items()] + [("source", s, i) for s, i in merged.items()]
    spark.createDataFrame(named, "kind string, name string, at bigint").coalesce(1).write.mode(
        "overwrite").parquet(f"{table.path}/manifest/v={version}")


def _forget(spark: SparkSession, table: BucketTable) -> None:
    """Delete manifests beyond the kept ones and the bucket folders that none of those names."""
    versions = _versions(spark, f"{table.path}/manifest")
    for old in versions[:-KEPT_VERSIONS]:
        folder, fs = _files(spark, f"{table.path}/manifest/v={old}")
        fs.delete(folder, True)
    kept = spark.read.schema("kind string, name string, at bigint").parquet(
        *[f"{table.path}/manifest/v={v}" for v in versions[-KEPT_VERSIONS:]])
    named = {(r["name"], r["at"]) for r in kept.filter("kind = 'bucket'").distinct().collect()}
    data, fs = _files(spark, f"{table.path}/data")
    if not fs.exists(data):
        return
    for version in fs.listStatus(data):
        at = int(version.getPath().getName().split("=")[1])
        folders = [s.getPath() for s in fs.listStatus(version.getPath()) if s.isDirectory()]
        dead = [f for f in folders if (f.getName().split("=")[1], at) not in named]
        for folder in dead if len(dead) < len(folders) else [version.getPath()]:
            fs.delete(folder, True)
