"""What queries share: sources by folder, rounding, and the SQL of interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.operators import prepare, splits
from shelfrank.sources.catalog import Orders
from shelfrank.sources.config import SplitOptions

U, I = "customer_key", "product_key"
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])


def sql_hash(seed: int, *keys: str) -> str:
    """``scalar.keyed_hash`` in SQL."""
    return f"CAST('0x' || substr(md5(concat_ws(',', '{seed}', {', '.join(keys)})), 1, 13) AS BIGINT)"


def inter(spark: SparkSession, sf: str) -> DataFrame:
    return Orders(spark, sf).interactions()


def halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The temporal split of the interactions of users with five or more."""
    return splits.split(inter(spark, sf), SplitOptions())


def region_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with their region as the country column."""
    raw = Orders(spark, sf).raw_customers()
    return raw.select(U, F.col("region").alias("country"))


def segments_of(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.segments(Orders(spark, sf).customer_report(), "cust_segmentation", U)


#: Interactions: the latest sale of each pair, rated over all sales.
INTER = """raw AS (SELECT DISTINCT o_custkey AS customer_key, l_partkey AS product_key, o_orderdate, l_shipdate, l_extendedprice AS sales, l_quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ends AS (SELECT min(sales) AS lo, max(sales) AS hi FROM raw),
ranked AS (SELECT *, row_number() OVER (PARTITION BY customer_key, product_key
  ORDER BY o_orderdate DESC NULLS LAST, sales DESC NULLS LAST, l_quantity DESC NULLS LAST, l_shipdate DESC NULLS LAST) AS r FROM raw),
inter AS (SELECT customer_key, product_key, CASE WHEN hi > lo THEN 1 + 4 * (sales - lo) / (hi - lo) ELSE 1.0 END AS rating, o_orderdate AS timestamp
  FROM ranked CROSS JOIN ends WHERE r = 1)"""

#: The temporal split.
HALVES = f"""{INTER},
kept AS (SELECT * FROM inter WHERE customer_key IN (SELECT customer_key FROM inter GROUP BY customer_key HAVING count(*) >= 5)),
placed AS (SELECT *, row_number() OVER (ORDER BY timestamp, customer_key, product_key) AS rn, count(*) OVER () AS n FROM kept),
train AS (SELECT customer_key, product_key, rating, timestamp FROM placed WHERE rn <= floor(n * 0.8)),
test AS (SELECT customer_key, product_key, rating, timestamp FROM placed WHERE rn > floor(n * 0.8))"""
