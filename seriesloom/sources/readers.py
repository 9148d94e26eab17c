"""Readers. Files of one series each, JSON in its usual shapes, saved tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.names import base_model_name, slug
from seriesloom.session import require_columns

TARGET_SCHEMA = T.StructType([
    T.StructField(n, T.StringType())
    for n in ("brand", "model_name", "url", "watch_id", "model_id", "slug")
])


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p))


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modificationTime) of the files; contents are never read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "length", "modificationTime")
    )


def inventory_total(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count("*").alias("n_files"), (F.sum("length") / F.lit(1024.0 * 1024.0)).alias("total_mb")
    )


def asset_of(path: Column, asset: str = "asset_id") -> Column:
    """Asset named by an ``asset_id=…`` folder, else by the file's stem."""
    folder = F.nullif(F.regexp_extract(path, rf"/{asset}=([^/]+)/", 1), F.lit(""))
    stem = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    return F.url_decode(F.replace(F.coalesce(folder, stem), F.lit("+"), F.lit("%2B")))


def read_lines(spark: SparkSession, paths: str | list[str], pattern: str = "*") -> DataFrame:
    """Lines with file path and a number that rises in file order.

    A file may be split over many tasks: the split's start offset plus the row's place
    in its task orders the lines without reading any file whole, for a split begins
    further on than any row number of the split before it.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return (
        spark.read.option("pathGlobFilter", pattern).text(paths)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            (F.col("_metadata.file_block_start") + row).alias("position"),
        )
    )


def read_series(
    spark: SparkSession, path: str, date: str = "date", price: str = "price(SGD)",
    min_rows: int = 30, max_files: int | None = None,
) -> DataFrame:
    """(asset_id, ts, price, position) from a folder of one CSV file (or folder) per asset.

    An asset is left out when a needed column is missing, any date is unreadable,
    or fewer than ``min_rows`` distinct times remain. Columns are located by each
    file's own header. ``max_files`` keeps the first assets by name, each with all of
    its part files.
    """
    lines = read_lines(spark, path, "*.csv").filter(F.length(F.trim("value")) > 0)
    if max_files is not None:
        first = (
            inventory(spark, path, "*.csv").select(asset_of(F.col("path")).alias("asset_id"))
            .distinct().orderBy("asset_id").limit(max_files)
        )
        named = lines.withColumn("asset_id", asset_of(F.col("file")))
        lines = named.join(first, "asset_id", "left_semi").drop("asset_id")
    header = lines.groupBy("file").agg(F.min_by("value", "position").alias("h"), F.min("position").alias("top"))
    names = F.transform(csv_cells(F.col("h")), _unquoted)
    places = header.select(
        "file", "top", F.array_position(names, date).alias("_d"), F.array_position(names, price).alias("_p")
    ).filter((F.col("_d") > 0) & (F.col("_p") > 0))
    body = lines.join(places, "file").filter(F.col("position") > F.col("top"))

    def cell(place: str) -> Column:
        return _unquoted(F.get(csv_cells(F.col("value")), (F.col(place) - 1).cast("int")))

    rows = body.select(
        asset_of(F.col("file")).alias("asset_id"), "position",
        cell("_d").try_cast("timestamp").alias("ts"), cell("_p").try_cast("double").alias("price"),
    )
    per_time = rows.groupBy("asset_id", "ts").agg(F.count("*").alias("_c"))
    usable = per_time.groupBy("asset_id").agg(
        F.count("ts").alias("_n"), F.count_if(F.col("ts").isNull()).alias("_bad")
    ).filter((F.col("_bad") == 0) & (F.col("_n") >= min_rows)).select("asset_id")
    return rows.join(usable, "asset_id", "left_semi").select("asset_id", "ts", "price", "position")


def read_for_check(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """(file, ordinal, ts, readable) of every collected file, good or not.

    The first line of a file is its header and the first cell of a line its date. A file
    without lines after the header has one row with a NULL ordinal. ``readable`` is false
    for lines that are no UTF-8 text. ``ordinal`` rises with the lines of a file: a split
    begins further on than any row number of the split before it.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
        .load(path).select(F.col("_metadata.file_path").alias("file"))
    )
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = (
        spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path)
        .select("value", F.col("_metadata.file_path").alias("file"),
                (F.col("_metadata.file_block_start") + row).alias("ordinal"))
    )
    header = lines.groupBy("file").agg(F.min("ordinal").alias("_top"))
    first_cell = _unquoted(F.get(csv_cells(F.col("value")), F.lit(0)))
    readable = F.is_valid_utf8("value")
    body = lines.join(header, "file").filter(F.col("ordinal") > F.col("_top")).select(
        "file", "ordinal", F.when(readable, first_cell.try_cast("timestamp")).alias("ts"), readable.alias("readable"),
    )
    return files.join(body, "file", "left").withColumn("readable", F.coalesce("readable", F.lit(True)))


def csv_cells(line: Column) -> Column:
    """Cells of a CSV line, quotes kept."""
    return F.regexp_extract_all(line, F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1))


def _unquoted(cell: Column) -> Column:
    return F.replace(F.regexp_replace(F.trim(cell), '^"|"$', ""), F.lit('""'), F.lit('"'))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """Strict: bad rows and missing paths fail. Tolerant: bad cells are NULL, a missing path is empty."""
    reader = spark.read.option("header", True).schema(schema)
    if strict:
        return reader.option("mode", "FAILFAST").csv(path)
    return _or_empty(spark, lambda: reader.option("mode", "PERMISSIVE").csv(path), schema)


def read_dated_csv(spark: SparkSession, path: str, date: str, schema: T.StructType) -> DataFrame:
    """CSV whose date column becomes a date, unreadable dates NULL."""
    as_text = T.StructType([
        T.StructField(f.name, T.StringType() if f.name == date else f.dataType) for f in schema.fields
    ])
    return read_csv(spark, path, as_text, strict=False).withColumn(date, F.col(date).try_cast("date"))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    reader = spark.read.option("multiLine", True).schema(schema)
    if strict:
        return reader.option("mode", "FAILFAST").json(path)
    return _or_empty(spark, lambda: reader.option("mode", "DROPMALFORMED").json(path), schema)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank and unreadable lines are dropped, a missing path is empty."""
    reader = spark.read.schema(schema).option("mode", "DROPMALFORMED")
    return _or_empty(spark, lambda: reader.json(path), schema)


def _or_empty(spark: SparkSession, load, schema: T.StructType | str) -> DataFrame:
    try:
        return load()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read_mixed_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON files that are lines, an array, an object holding a list, or one object.

    A file with at least one line that is an object is read by line. The lines of
    the others are put together again, each file a document of one row.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = read_lines(spark, path).withColumn("v", F.try_parse_json("value"))
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    by_line = lines.filter(is_object).select(F.from_json("value", schema).alias("r"))
    shapes = lines.groupBy("file").agg(F.max(F.coalesce(is_object, F.lit(False))).alias("lined"))
    loose = lines.drop("v").join(shapes.filter(~F.col("lined")).select("file"), "file", "left_semi")
    parts = F.sort_array(F.collect_list(F.struct("position", "value")))
    text = F.array_join(F.transform(parts, lambda x: x["value"]), "\n")
    whole = loose.groupBy("file").agg(text.alias("value")).select(F.try_parse_json("value").alias("v"))
    kind = F.schema_of_variant("v")
    entries = F.map_values(F.try_variant_get("v", "$", "map<string,variant>"))
    first_list = F.get(F.filter(entries, lambda x: F.schema_of_variant(x).startswith("ARRAY")), F.lit(0))
    listed = F.when(kind.startswith("ARRAY"), F.col("v")).when(kind.startswith("OBJECT"), first_list)
    records = F.coalesce(
        F.try_variant_get(listed, "$", "array<variant>"),
        F.when(kind.startswith("OBJECT"), F.array("v")),
    )
    by_document = whole.select(F.explode(records).alias("x")).select(
        F.from_json(F.to_json("x"), schema).alias("r")
    )
    return by_line.unionByName(by_document).select("r.*")


def combine_assets(spark: SparkSession, path: str, fmt: str = "parquet", asset: str = "asset_id") -> DataFrame:
    """One table out of per-asset files or partitions, whatever columns each has.

    A file without an asset column is named by its file stem; ``watch_id`` serves as
    one.
    """
    reader = spark.read.option("mergeSchema", True).option("header", True)
    df = reader.format(fmt).load(path)
    stem = asset_of(F.col("_metadata.file_path"), asset)
    have = [F.col(c).cast("string") for c in dict.fromkeys((asset, "watch_id")) if c in df.columns]
    return df.withColumn(asset, F.coalesce(*have, stem))


def load_features(
    spark: SparkSession, unified: str, per_asset: str, required: tuple[str, ...] = ("price",),
    names: tuple[str, ...] = ("asset_id", "watch_id"),
) -> DataFrame:
    """The unified table if it exists, else the per-asset files combined and kept as it."""
    if not path_exists(spark, unified):
        combine_assets(spark, per_asset).write.parquet(unified)
    df = spark.read.parquet(unified)
    have = [n for n in names if n in df.columns]
    if not have:
        raise ValueError(f"no asset column among {names}")
    return require_columns(df.withColumn("asset_id", F.col(have[0])), *required)


def load_forecasts(spark: SparkSession, path: str) -> DataFrame:
    df = require_columns(spark.read.parquet(path), "model_name", "asset_id", "prediction")
    dated = [c for c in ("feature_date", "prediction_date") if c in df.columns]
    return df.withColumns({c: F.col(c).cast("string").try_cast("date") for c in dated}) if dated else df


def registered_models(names: DataFrame, column: str = "name") -> DataFrame:
    """Distinct model names without their horizon suffix, sorted."""
    return names.select(base_model_name(F.col(column)).alias("model")).distinct().orderBy("model")


def registry_names(spark: SparkSession, model_dir: str) -> list[str]:
    """Saved model folders under a directory."""
    p = spark._jvm.org.apache.hadoop.fs.Path(model_dir)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(n for n in names if not n.startswith("_"))


def brand_dimension(brands: DataFrame, column: str, base: str) -> DataFrame:
    """brand -> listing address, from a table that names brands."""
    return brands.select(F.col(column).alias("brand")).dropna().distinct().withColumn(
        "url", F.concat(F.lit(base.rstrip("/") + "/"), slug(F.col("brand")))
    )
