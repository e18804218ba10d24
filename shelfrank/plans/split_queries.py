"""Queries on splits: the test half of each, with the number of the training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.operators import prepare, splits
from shelfrank.plans.base import HALVES, INTER, I, U, inter, rounded, segments_of, sql_hash

HOLDOUT = "2000-01-01"
HASH = sql_hash(42, U, I)


def _rows(of) -> DataFrame:
    """Both halves, marked."""
    def run(spark, sf):
        train, test = of(prepare.active(inter(spark, sf)), spark, sf)
        return rounded(train.withColumn("half", F.lit("train")).unionByName(test.withColumn("half", F.lit("test"))))

    return run


def _stratified(df, spark, sf):
    """Strata are the customers' segments."""
    return splits.stratified_split(df.join(segments_of(spark, sf), U), strata="segment")


QUERIES = {
    "split_random": _rows(lambda df, *_: splits.random_split(df)),
    "split_temporal": _rows(lambda df, *_: splits.temporal_split(df)),
    "split_holdout": _rows(lambda df, *_: splits.temporal_split(df, holdout=HOLDOUT)),
    "split_user": _rows(lambda df, *_: splits.user_split(df)),
    "split_item": _rows(lambda df, *_: splits.item_split(df)),
    "split_leave_one_out": _rows(lambda df, *_: splits.leave_one_out(df)),
    "split_stratified": _rows(_stratified),
}


def _sql(test: str, more: str = "", columns: str = "", source: str = "kept") -> str:
    return f"WITH {HALVES}{more} SELECT customer_key, product_key, round(rating, 6) AS rating, timestamp{columns}, CASE WHEN {test} THEN 'test' ELSE 'train' END AS half FROM {source}"


def _keys(key: str) -> str:
    return f""", keys AS (SELECT {key}, row_number() OVER (ORDER BY {sql_hash(42, key)}, {key}) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM kept))"""


ORACLES = {
    "split_random": _sql("r <= ceil(n * 0.2)", f", h AS (SELECT *, row_number() OVER (ORDER BY {HASH}, customer_key, product_key) AS r, count(*) OVER () AS n FROM kept)", source="h"),
    "split_temporal": _sql("rn > floor(n * 0.8)", source="placed"),
    "split_holdout": _sql(f"timestamp >= TIMESTAMP '{HOLDOUT}'"),
    "split_user": _sql("customer_key IN (SELECT customer_key FROM keys WHERE r <= floor(n * 0.2))", _keys(U)),
    "split_item": _sql("product_key IN (SELECT product_key FROM keys WHERE r <= floor(n * 0.2))", _keys(I)),
    "split_leave_one_out": _sql(
        "n > 1 AND r = 1", ", l AS (SELECT *, count(*) OVER (PARTITION BY customer_key) AS n, row_number() OVER (PARTITION BY customer_key ORDER BY timestamp DESC, product_key) AS r FROM kept)", source="l"
    ),
    "split_stratified": _sql(
        "r <= q",
        f""", g AS (SELECT kept.*, c_mktsegment AS segment FROM kept JOIN customer ON customer_key = c_custkey),
 h AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY {HASH}, customer_key, product_key) AS r, round(CAST(count(*) OVER (PARTITION BY segment) AS DOUBLE) * 0.2) AS q FROM g)""",
        ", segment", "h",
    ),
}
