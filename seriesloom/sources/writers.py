"""Writers. Everything is written by the executors, in parallel."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators.validation import split_quarantine
from seriesloom.session import materialize


def write_by_asset(
    df: DataFrame, path: str, asset: str = "asset_id", fmt: str = "parquet", overwrite: bool = True
) -> None:
    """One partition folder per asset; only the assets present are replaced.

    The rebalance hint keeps an asset's rows together yet lets adaptive execution
    split an oversized one over several files.
    """
    writer = df.hint("rebalance", asset).write.partitionBy(asset).option("header", True).format(fmt)
    if overwrite:
        writer.option("partitionOverwriteMode", "dynamic").mode("overwrite").save(path)
    else:
        writer.mode("ignore").save(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    df.write.format(fmt).option("header", True).mode(mode).save(path)


def write_summary(df: DataFrame, path: str) -> None:
    write_table(df, path, "csv")


def write_json_lines(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON text per row, such as the per-horizon metrics document."""
    documents.select(
        F.concat(F.lit('{"'), "key", F.lit('": '), "document", F.lit("}")).alias("value")
    ).write.mode("overwrite").text(path)


def safe_replace(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Write beside the target, then swap; the old table stays until the swap is done."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    tag = uuid.uuid4().hex
    staged, backup = hadoop.Path(f"{path}.new-{tag}"), hadoop.Path(f"{path}.bak-{tag}")
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    try:
        writer = df.write.format(fmt).option("header", True).mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).save(staged.toString())
    except Exception:
        fs.delete(staged, True)
        raise
    had_old = fs.exists(target)
    if had_old and not fs.rename(target, backup):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(staged, target):
        if had_old:
            fs.rename(backup, target)
        raise OSError(f"cannot publish {path}")
    if had_old:
        fs.delete(backup, True)


def save_model(model: PipelineModel, model_dir: str, name: str, horizon: int) -> str:
    path = f"{model_dir.rstrip('/')}/{name}__h{horizon}"
    model.write().overwrite().save(path)
    return path


def load_model(spark: SparkSession, model_dir: str, name: str) -> PipelineModel:
    return PipelineModel.load(f"{model_dir.rstrip('/')}/{name}")


def write_quarantine(
    df: DataFrame, verdicts: DataFrame, asset: str, good_path: str, bad_path: str, session: str
) -> None:
    """Valid assets to one folder; the others, with reason, time and session, to another."""
    good, bad = split_quarantine(df, materialize(verdicts, "verdicts"), asset)
    write_table(good, good_path)
    write_table(
        bad.withColumns({"moved_at": F.current_timestamp(), "session": F.lit(session)}), bad_path
    )
