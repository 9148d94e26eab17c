"""Order keys of fixed width, so that first and last need no sorted aggregate.

An aggregate stays on hash tables while its buffers have a fixed width. A struct of
order columns has none, so every task would sort its rows; one decimal has.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- Fixed values: bits that hold every value of a type, sign included ---------
BITS = {
    T.BooleanType: 2, T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64,
    T.DateType: 32, T.TimestampType: 60, T.TimestampNTZType: 60,
}
MOST_BITS = 126  # what 38 decimal digits hold
# --------------------------------------------------------------------------------

_FIXED = (*BITS, T.FloatType, T.DoubleType, T.DecimalType)


def _whole(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DateType):
        return F.unix_date(col)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(col.cast("timestamp"))
    return col.cast("int") if isinstance(kind, T.BooleanType) else col


def packed_order(df: DataFrame, cols: list[str | Column]) -> Column:
    """One value that orders rows of ``df`` as the tuple ``cols`` does, nulls least.

    Whole numbers, dates and timestamps up to 126 bits together become a decimal;
    anything else stays a struct, which orders alike but is sorted by each task.
    """
    kinds = [f.dataType for f in df.select(*cols).schema.fields]
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    if any(type(k) not in BITS for k in kinds) or sum(BITS[type(k)] + 1 for k in kinds) > MOST_BITS:
        return F.struct(*cols)
    key = None
    for part, kind in zip(parts, kinds):
        bits = BITS[type(kind)]
        raised = _whole(part, kind).cast("decimal(20,0)") + F.lit(Decimal(2 ** (bits - 1) + 1))
        digit = F.coalesce(raised, F.lit(Decimal(0))).cast("decimal(38,0)")
        key = digit if key is None else (key * F.lit(Decimal(2 ** (bits + 1)))).cast("decimal(38,0)") + digit
    return key.cast("decimal(38,0)")


def picked_rows(df: DataFrame, by: list[str], rest: list[str], order: list[str | Column], last: bool = True) -> DataFrame:
    """Per group the row that is last (or first) by ``order``, reduced before the shuffle.

    ``order`` tells the rows of a group apart. Columns of fixed width are picked one by
    one by the same packed key; otherwise the row travels as a struct.
    """
    pick, key = (F.max_by if last else F.min_by), packed_order(df, order)
    if not rest:
        return df.select(*by).distinct()
    kinds = {f.name: f.dataType for f in df.schema.fields}
    keyed = df.select(*by, *rest, key.alias("_key"))
    narrow = len(rest) == 1 or isinstance(keyed.schema["_key"].dataType, T.DecimalType)
    if narrow and all(isinstance(kinds[c], _FIXED) for c in rest):
        return keyed.groupBy(*by).agg(*[pick(c, "_key").alias(c) for c in rest])
    return df.groupBy(*by).agg(pick(F.struct(*rest), key).alias("_row")).select(*by, "_row.*")
