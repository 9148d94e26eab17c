"""Ingest checks: ordering, size, verdicts, quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 20

# ---- Fixed values: report texts ------------------------------------------------
TOO_FEW_ROWS = "Insufficient rows: %d < %d"
BAD_ORDER = "Date ordering issue"
NO_ROWS = "Empty or header-only file"
UNREADABLE = "Error reading file: not UTF-8 text"
VALID_HEADING = "VALID FILES"
INVALID_HEADING = "INVALID FILES"
ERROR_HEADING = "ERROR FILES"
# ------------------------------------------------------------------------------


def order_check(
    df: DataFrame, asset: str, ts: str, ordinal: str, block: int = BLOCK
) -> DataFrame:
    """Is ``ts`` non-decreasing in ingest order, per asset?

    Rows are compared inside blocks of consecutive ordinals, so one asset of any
    length spreads over many tasks; then each block's first value is compared
    with the last value of the asset's block before it. A missing time is an
    order fault unless the asset has fewer than two rows.
    """
    rows = df.select(asset, ts, ordinal, F.floor(F.col(ordinal) / block).alias("_block"))
    inside = Window.partitionBy(asset, "_block").orderBy(ordinal)
    steps = rows.withColumn("_prev", F.lag(ts).over(inside))
    blocks = steps.groupBy(asset, "_block").agg(
        F.count("*").alias("_n"),
        F.count_if(F.col(ts).isNull()).alias("_missing"),
        F.count_if(F.col(ts) < F.col("_prev")).alias("_back"),
        F.min_by(ts, ordinal).alias("_first"),
        F.max_by(ts, ordinal).alias("_last"),
    )
    across = Window.partitionBy(asset).orderBy("_block")
    seams = blocks.withColumn("_before", F.lag("_last").over(across))
    return seams.groupBy(asset).agg(
        F.sum("_n").alias("row_count"),
        F.sum("_missing").alias("missing"),
        (F.sum("_back") + F.count_if(F.col("_first") < F.col("_before"))).alias("steps_back"),
    ).withColumn(
        "ordered",
        (F.col("row_count") < 2) | ((F.col("missing") == 0) & (F.col("steps_back") == 0)),
    )


def file_check(lines: DataFrame, file: str = "file", block: int = BLOCK) -> DataFrame:
    """Order check of collected files that keeps empty and unreadable ones.

    ``lines`` is what ``readers.read_for_check`` gives. Unreadable and empty files have
    no rows.
    """
    facts = lines.groupBy(file).agg(F.count_if(~F.col("readable")).alias("_bad"))
    rows = order_check(lines.filter(F.col("ordinal").isNotNull()), file, "ts", "ordinal", block)
    found = facts.join(rows, file, "left").withColumn("unreadable", F.col("_bad") > 0).drop("_bad")
    gone = F.col("unreadable") | F.col("row_count").isNull()
    numbers = {c: F.when(gone, F.lit(0)).otherwise(F.col(c)).cast("bigint") for c in ("row_count", "missing", "steps_back")}
    return found.withColumns({**numbers, "ordered": F.when(gone, F.lit(True)).otherwise(F.col("ordered"))})


def verdicts(checked: DataFrame, min_rows: int) -> DataFrame:
    """Validity, category and joined error text from an order check or a file check."""
    unreadable = F.col("unreadable") if "unreadable" in checked.columns else F.lit(False)
    enough = F.col("row_count") >= min_rows
    text = F.concat_ws(
        "; ",
        F.when(~enough, F.format_string(TOO_FEW_ROWS, "row_count", F.lit(min_rows))),
        F.when(~F.col("ordered"), F.lit(BAD_ORDER)),
    )
    empty = F.col("row_count") == 0
    return checked.withColumns({
        "is_valid": enough & F.col("ordered") & ~empty,
        "is_error": unreadable,
        "has_date_issues": ~F.col("ordered") & ~empty,
        "error_message": F.when(unreadable, F.lit(UNREADABLE)).when(empty, F.lit(NO_ROWS)).otherwise(
            F.nullif(text, F.lit(""))),
    })


def verdict_summary(v: DataFrame) -> DataFrame:
    """One row: valid, invalid by cause, errors, and success percent."""
    invalid = ~F.col("is_valid") & ~F.col("is_error")
    return v.agg(
        F.count("*").alias("total"),
        F.count_if("is_valid").alias("valid"),
        F.count_if(invalid).alias("invalid"),
        F.count_if("is_error").alias("errors"),
        F.count_if(invalid & F.col("has_date_issues")).alias("date_issues"),
    ).withColumns({
        "insufficient": F.col("invalid") - F.col("date_issues"),
        "percent": F.try_divide(F.col("valid") * 100.0, F.col("total")),
    })


def report_lines(v: DataFrame, name: str) -> DataFrame:
    """Report rows by category and file, ready to be written."""
    line = F.when(
        F.col("is_valid"),
        F.concat(F.col(name).cast("string"), F.lit(" ("), F.col("row_count").cast("string"), F.lit(" rows)")),
    ).otherwise(F.concat(F.col(name).cast("string"), F.lit(": "), F.col("error_message")))
    return v.select(
        F.when(F.col("is_valid"), VALID_HEADING).when(F.col("is_error"), ERROR_HEADING)
        .otherwise(INVALID_HEADING).alias("category"),
        F.col(name).alias("file"), line.alias("line"),
    )


def report_headings(v: DataFrame) -> DataFrame:
    """The report's headings with their counts, categories without files included."""
    counts = v.agg(
        F.count_if("is_valid").alias("v"), F.count_if(~F.col("is_valid") & ~F.col("is_error")).alias("i"),
        F.count_if("is_error").alias("e"),
    )
    pairs = F.array(*[
        F.struct(F.lit(h).alias("category"), F.col(c).alias("n"))
        for h, c in ((VALID_HEADING, "v"), (INVALID_HEADING, "i"), (ERROR_HEADING, "e"))
    ])
    return counts.select(F.explode(pairs).alias("x")).select(
        "x.category", "x.n", F.format_string("%s (%d):", "x.category", "x.n").alias("line")
    )


def split_quarantine(df: DataFrame, v: DataFrame, asset: str) -> tuple[DataFrame, DataFrame]:
    """Rows of valid assets, and all other rows with the reason attached.

    Both come from one join; write ``v`` first when both are to be used.
    """
    marked = df.join(v.select(asset, F.col("is_valid").alias("_ok"), F.col("error_message").alias("reason")), asset)
    return marked.filter("_ok").drop("_ok", "reason"), marked.filter(~F.col("_ok")).drop("_ok")
