"""Packed order keys against the order of the tuples they stand for."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from seriesloom.operators.ordering import packed_order, picked_rows

BIG = 2**63 - 1
TIMES = [None, dt.datetime(1, 1, 2), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(2024, 1, 1), dt.datetime(9999, 12, 30)]
LONGS = [None, -BIG - 1, -1, 0, 1, BIG]
CASES = {
    "ts timestamp, tie bigint": (TIMES, LONGS),
    "d date, n int, b boolean": ([None, dt.date(1, 1, 1), dt.date(1970, 1, 1), dt.date(9999, 12, 31)], [None, -(2**31), 0, 2**31 - 1], [None, False, True]),
    "s smallint, t tinyint, tie bigint": ([None, -32768, 5], [None, -128, 127], LONGS),
}


@pytest.mark.parametrize("schema", CASES)
def test_packed_order_sorts_like_the_tuple(spark, schema):
    rows = list(itertools.product(*CASES[schema]))
    df = spark.createDataFrame(rows, schema)
    keyed = df.select("*", packed_order(df, df.columns).alias("k"))
    assert keyed.schema["k"].dataType.simpleString() == "decimal(38,0)"
    assert keyed.filter("k IS NULL").count() == 0 and keyed.select("k").distinct().count() == len(rows)
    by_key = [tuple(r)[:-1] for r in keyed.orderBy("k").collect()]
    assert by_key == [tuple(r) for r in df.orderBy(*[F.asc_nulls_first(c) for c in df.columns]).collect()]


def test_other_types_stay_a_struct(spark):
    df = spark.createDataFrame([("a", 1.5, 3)], "s string, x double, n bigint")
    for cols in (["s", "n"], ["x", "n"]):
        assert df.select(packed_order(df, cols).alias("k")).schema["k"].dataType.typeName() == "struct"


@pytest.mark.parametrize("text", [False, True])
def test_picked_rows_stay_whole(spark, text):
    """Nulls are values of the winning row, not gaps to fill from others."""
    rows = [("a", 1, 5, 1.0, "x"), ("a", 2, 1, None, None), ("a", 2, 0, 9.0, "y"), ("b", None, 1, 4.0, "z"), ("c", None, None, None, "w")]
    df = spark.createDataFrame(rows, "g string, n int, tie bigint, v double, t string").repartition(3)
    rest = ["n", "tie", "v"] + (["t"] if text else [])
    got = {r["g"]: tuple(r)[1:4] for r in picked_rows(df, ["g"], rest, ["n", "tie"]).collect()}
    assert got == {"a": (2, 1, None), "b": (None, 1, 4.0), "c": (None, None, None)}
    first = {r["g"]: r["v"] for r in picked_rows(df, ["g"], rest, ["n", "tie"], last=False).collect()}
    assert first == {"a": 1.0, "b": 4.0, "c": None}


def test_no_rows_and_no_kept_columns(spark):
    df = spark.createDataFrame([], "g string, n int, v double")
    assert picked_rows(df, ["g"], ["v"], ["n"]).collect() == []
    two = spark.createDataFrame([("a", 1), ("a", 2)], "g string, n int")
    assert [r["g"] for r in picked_rows(two, ["g"], [], ["n"]).collect()] == ["a"]
