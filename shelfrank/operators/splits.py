"""Train and test halves of interactions; every split is deterministic, disjoint and exhaustive."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfrank.functions.scalar import keyed_hash
from shelfrank.operators.prepare import active
from shelfrank.operators.sampling import smallest
from shelfrank.sources.config import SplitOptions

U, I = "customer_key", "product_key"
Halves = tuple[DataFrame, DataFrame]


def _halves(df: DataFrame, in_test: Column) -> Halves:
    return df.where(~in_test), df.where(in_test)


def random_split(df: DataFrame, test_size: float = 0.2, seed: int = 42) -> Halves:
    """ceil(n * test_size) rows, first in the order of a keyed hash, are the test half."""
    hashed = df.withColumn("__h", keyed_hash([F.col(U), F.col(I)], seed))
    train, test = _halves(hashed, smallest(hashed, ["__h", U, I], math.ceil(df.count() * test_size)))
    return train.drop("__h"), test.drop("__h")


def temporal_split(df: DataFrame, test_size: float = 0.2, column: str = "timestamp", holdout: str | None = None) -> Halves:
    """Rows from the holdout time on are the test half, or the newest rows: all but int(n * (1 - test_size)).

    Without the column the split is random; a holdout that can't be read or leaves a half empty is ignored.
    """
    if column not in df.columns:
        return random_split(df, test_size)
    if holdout:
        at = F.lit(holdout).try_cast("timestamp_ntz")
        train, test = df.where(F.col(column) < at), df.where(F.col(column) >= at)
        if not train.isEmpty() and not test.isEmpty():
            return train, test
    early = smallest(df, [column, U, I], int(df.count() * (1 - test_size)))
    return _halves(df, ~early)


def key_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42) -> Halves:
    """All rows of int(n_keys * test_size) keys, first by a keyed hash, are the test half."""
    keys = df.select(key).distinct().withColumn("__h", keyed_hash([F.col(key)], seed))
    chosen = keys.where(smallest(keys, ["__h", key], int(keys.count() * test_size))).select(key)
    return df.join(chosen, key, "left_anti"), df.join(chosen, key, "left_semi")


def user_split(df: DataFrame, test_size: float = 0.2, seed: int = 42) -> Halves:
    return key_split(df, U, test_size, seed)


def item_split(df: DataFrame, test_size: float = 0.2, seed: int = 42) -> Halves:
    return key_split(df, I, test_size, seed)


def leave_one_out(df: DataFrame, column: str | None = "timestamp", seed: int = 42) -> Halves:
    """The latest row of each user with two or more is the test half (a hashed one without times); ties go to the lower item."""
    late = [F.desc(column)] if column in df.columns else []
    order = [*late, keyed_hash([F.col(U), F.col(I)], seed), F.col(I)] if not late else [*late, F.col(I)]
    by = Window.partitionBy(U)
    marked = df.withColumn("__n", F.count("*").over(by)).withColumn("__r", F.row_number().over(by.orderBy(*order)))
    train, test = _halves(marked, (F.col("__n") > 1) & (F.col("__r") == 1))
    return train.drop("__n", "__r"), test.drop("__n", "__r")


def stratified_split(df: DataFrame, test_size: float = 0.2, strata: str | None = None, seed: int = 42) -> Halves:
    """Of each stratum, round(n * test_size) rows, first by a keyed hash, are the test half; random without a stratum.

    A stratum's rows are first dealt into buckets of the hash, of which only the one at its cut is ordered.
    """
    if not strata or strata not in df.columns:
        return random_split(df, test_size, seed)
    hashed = df.withColumn("__h", keyed_hash([F.col(U), F.col(I)], seed)).withColumn("__b", F.shiftright("__h", 40))
    counts = hashed.groupBy(strata, "__b").agg(F.count("*").alias("c"))
    by = Window.partitionBy(strata)
    before = F.sum("c").over(by.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("__quota", F.round(F.sum("c").over(by) * test_size).cast("long")).withColumn("__before", F.coalesce(before, F.lit(0)))
    placed = hashed.join(counts.select(F.col(strata).alias("__s"), F.col("__b").alias("__k"), "__quota", "__before", "c"), F.col(strata).eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__k")))
    rank = F.row_number().over(Window.partitionBy(strata, "__b").orderBy("__h", U, I))
    left = F.col("__quota") - F.col("__before")
    test = (left >= F.col("c")) | (left > 0) & (F.col("__r") <= left)
    marked = placed.withColumn("__r", rank)
    halves = _halves(marked, test)
    return tuple(h.select(*df.columns) for h in halves)


def split(df: DataFrame, options: SplitOptions | None = None) -> Halves:
    """Rows of active users, split by the named strategy; an unknown one is random."""
    o = options or SplitOptions()
    df = active(df, o.min_ratings)
    name = o.strategy.lower()
    if name in ("time", "temporal"):
        return temporal_split(df, o.test_size, holdout=o.holdout_timestamp)
    if name == "user":
        return user_split(df, o.test_size, o.random_state)
    if name == "item":
        return item_split(df, o.test_size, o.random_state)
    if name in ("leave_one_out", "loo"):
        return leave_one_out(df, seed=o.random_state)
    if name == "stratified":
        return stratified_split(df, o.test_size, o.strata, o.random_state)
    return random_split(df, o.test_size, o.random_state)
