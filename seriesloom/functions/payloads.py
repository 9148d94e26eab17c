"""Price values and rows out of chart JSON, with VARIANT and no Python UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.dates import epoch_day

# ---- Fixed values ------------------------------------------------------------
PRICE_COLUMNS = ("price", "value", "y", "price_sgd", "price(SGD)")
OBJECT_KEYS = ("price", "value", "avg", "mean", "median")
# ------------------------------------------------------------------------------

PAYLOAD = "struct<data:struct<all:map<string,variant>>>"
_NUMERIC = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def _if_number(v: Column) -> Column:
    """The number a variant holds; NULL when it holds anything else."""
    return F.when(F.schema_of_variant(v).rlike(_NUMERIC), F.try_variant_get(v, "$", "double"))


def _first_number(values: Column) -> Column:
    numbers = F.filter(F.transform(values, _if_number), lambda x: x.isNotNull())
    return F.get(numbers, F.lit(0))


def variant_number(v: Column) -> Column:
    """Number of a scalar, of the first known key of an object (else any of its
    values), or the first number of an array. Unreadable values are NULL."""
    kind = F.schema_of_variant(v)
    keyed = F.coalesce(*[_if_number(F.try_variant_get(v, f"$.{k}", "variant")) for k in OBJECT_KEYS])
    any_value = _first_number(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")))
    in_array = _first_number(F.try_variant_get(v, "$", "array<variant>"))
    scalar = F.try_variant_get(v, "$", "string").try_cast("double")
    return (
        F.when(kind.startswith("OBJECT"), F.coalesce(keyed, any_value))
        .when(kind.startswith("ARRAY"), in_array)
        .otherwise(scalar)
    )


def price_column(columns: list[str]) -> str:
    """The first price-like column present."""
    for name in PRICE_COLUMNS:
        if name in columns:
            return name
    raise ValueError(f"no price-like column in {columns}")


def normalise_prices(df: DataFrame, date: str = "date", out: str = "price") -> DataFrame:
    """Typed (date, price) rows from a table whose price column is text, number or VARIANT."""
    name = price_column(df.columns)
    kind = dict(df.dtypes)[name]
    raw = F.col(f"`{name}`")
    value = variant_number(raw) if kind == "variant" else raw.try_cast("double")
    day = F.col(date) if dict(df.dtypes)[date] == "date" else F.col(date).cast("string").try_cast("date")
    cur = df.withColumns({"_p": value, date: day})
    if name != out:
        cur = cur.drop(name)
    cur = cur.withColumn(out, F.col("_p")).drop("_p")
    return cur.filter(F.col(date).isNotNull() & F.col(out).isNotNull() & ~F.isnan(out))


def chart_rows(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """``data.all`` of each payload as (keep…, date, value); other texts give no rows."""
    parsed = F.from_json(F.col(payload), PAYLOAD)
    return (
        df.select(*keep, F.explode(parsed["data"]["all"]).alias("_epoch", "value"))
        .withColumn("date", epoch_day(F.col("_epoch").try_cast("bigint")))
        .select(*keep, "date", "value")
    )
