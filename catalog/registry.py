"""Query registration and the table views the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators import cleaning, grid
from seriesloom.session import apply_settings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(
    name: str, sql: str | None = None, as_text: tuple[str, ...] = ()
) -> Callable[[Query], Query]:
    """Register a query and its SQL. Both sides return ``as_text`` dates and times as text."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(apply_settings(spark), sf_dir)
            return df.withColumns({c: F.col(c).cast("string") for c in as_text}) if as_text else df

        QUERIES[name] = run
        if sql is not None:
            texts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in as_text)
            ORACLES[name] = f"SELECT * REPLACE ({texts}) FROM ({sql.strip()})" if as_text else sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Round the named columns, so that summation order does not show."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


def r(c: Column | str, digits: int) -> Column:
    return F.round(c, digits)


def snap(c: Column | str, bits: int = 10) -> Column:
    """Nearest multiple of ``2**-bits``.

    Price means are decimal fractions, so they hit decimal rounding ties; a binary
    grid has none and scales exactly.
    """
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col * F.lit(float(2**bits))) / F.lit(float(2**bits))


def snap_sql(expr: str, bits: int = 10) -> str:
    return f"round(({expr}) * {2**bits}.0::DOUBLE) / {2**bits}.0::DOUBLE"


# ---- views ------------------------------------------------------------------------


def p(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as raw observations per nation: duplicates per day, calendar gaps."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderkey")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("c_nationkey").alias("asset_id"), F.to_date("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("tie"),
    )


def observed(spark: SparkSession, sf: str) -> DataFrame:
    """One price per nation and day: the lowest order key wins."""
    return cleaning.first_per_timestamp(p(spark, sf), ["tie"], keep=["price"])


def pd(spark: SparkSession, sf: str) -> DataFrame:
    """Daily grid of ``observed``, linearly filled: (asset_id, d, price, seq)."""
    return grid.densify(observed(spark, sf).withColumnRenamed("ts", "d"))


def b(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as raw observations per supplier."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("asset_id"), F.to_date("l_shipdate").alias("ts"),
        F.col("l_extendedprice").alias("price"), *B_ORDER,
    )


B_ORDER = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_extendedprice",
]

P_SQL = """p AS (
  SELECT c_nationkey AS asset_id, CAST(o_orderdate AS DATE) AS ts, o_totalprice AS price, o_orderkey AS tie
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

OBS_SQL = P_SQL + """, obs AS (
  SELECT asset_id, ts, arg_min(price, tie) AS price FROM p GROUP BY asset_id, ts)"""

PD_SQL = OBS_SQL + """, spaced AS (
  SELECT asset_id, ts, price, lead(price) OVER w AS nxt, coalesce(lead(ts) OVER w - ts, 1) AS gap
  FROM obs WINDOW w AS (PARTITION BY asset_id ORDER BY ts)),
pd AS (
  SELECT asset_id, CAST(ts + CAST(k AS INTEGER) AS DATE) AS d,
         CASE WHEN k = 0 THEN price ELSE price + (nxt - price) * k / gap END AS price
  FROM spaced, unnest(generate_series(0, gap - 1)) AS t(k))"""

B_SQL = """b AS (
  SELECT l_suppkey AS asset_id, CAST(l_shipdate AS DATE) AS ts, l_extendedprice AS price,
         row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax,
                            l_returnflag, l_linestatus, l_extendedprice) AS tie
  FROM lineitem)"""

W = "WINDOW w AS (PARTITION BY asset_id ORDER BY d)"


def frame(k: int) -> str:
    return f"(PARTITION BY asset_id ORDER BY d ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def full(expr: str, k: int, value: str = "price") -> str:
    return f"CASE WHEN count({value}) OVER {frame(k)} = {k} THEN {expr} OVER {frame(k)} END"
