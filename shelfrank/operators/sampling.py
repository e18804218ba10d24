"""Exact prefixes of an order without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfrank.functions.scalar import keyed_hash

BUCKETS = 4096


def _as_long(df: DataFrame, key: str) -> Column:
    kind = df.schema[key].dataType.typeName()
    if kind.startswith("timestamp"):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(key).cast("timestamp_ntz"))
    return F.col(key).cast("long")


def smallest(df: DataFrame, keys: list[str], n: int) -> Column:
    """A condition that holds for the first ``n`` rows in the order of ``keys`` (integers or timestamps, nulls last).

    Counts in 4096 buckets narrow the place of the cut, key by key, so nothing is sorted or shuffled but the counts.
    Rows that are equal in all keys fall on one side together; make the keys unique for an exact number.
    """
    slim = df.select(*keys).persist()  # the keys alone, worked out once for all counts
    try:
        return F.coalesce(_cut(slim, keys, n), F.lit(False))
    finally:
        slim.unpersist()


def _cut(df: DataFrame, keys: list[str], n: int) -> Column:
    cut, scope = F.lit(False), F.lit(True)
    for key in keys:
        value = _as_long(df, key)
        known = value.isNotNull()
        row = df.where(scope).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).first()
        if row["n"] <= n:  # all values, and some of the nulls
            cut = cut | (scope & known)
            n -= row["n"]
            scope = scope & value.isNull()
            if not n:
                return cut
            continue
        lo, hi = row["lo"], row["hi"]
        while lo < hi:
            width = max(1, -(-(hi - lo + 1) // BUCKETS))
            bucket = F.floor((value - F.lit(lo)) / F.lit(width))
            inside = scope & known & (value >= lo) & (value <= hi)
            counts = {int(r["b"]): r["n"] for r in df.where(inside).groupBy(bucket.cast("long").alias("b")).agg(F.count("*").alias("n")).collect()}
            at = None
            for b in sorted(counts):
                if counts[b] > n:
                    at = b
                    break
                n -= counts[b]
            start = lo + at * width if at is not None else hi + 1
            cut = cut | (scope & known & (value >= lo) & (value < start))
            if at is None or not n:
                return cut
            lo, hi = start, min(hi, start + width - 1)
        scope = scope & known & (value == lo)
    return cut


def sample(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """round(share * n) rows without replacement, in the order of a keyed hash; all rows from a share of 1 on."""
    if share >= 1:
        return df
    hashed = df.withColumn("__h", keyed_hash([F.col(key)], seed))
    n = round(share * df.count())
    return hashed.where(smallest(hashed, ["__h", key], n)).drop("__h")


def numbered(df: DataFrame, key: str, name: str = "position") -> DataFrame:
    """``df`` with a dense number from 0 for each row, in the order of ``keyed_hash`` of ``key`` (unique) and the seed 0.

    Rows are numbered within buckets of the hash's leading bits; only the buckets' counts meet in one place.
    """
    dealt = df.withColumn("__h", keyed_hash([F.col(key)], 0)).withColumn("__b", F.shiftright("__h", 40))
    counts = dealt.groupBy("__b").agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__b", F.coalesce(before, F.lit(0)).alias("__start"))  # 4096 rows at most
    within = F.row_number().over(Window.partitionBy("__b").orderBy("__h", key))
    return dealt.withColumn("__r", within).join(F.broadcast(starts), "__b").withColumn(name, F.col("__start") + F.col("__r") - 1).drop("__h", "__b", "__r", "__start")


def ranked(df: DataFrame, order: list[Column], name: str, kept=DataFrame.persist) -> DataFrame:
    """``df`` with a dense number from 1 in the order of ``order`` (which must be total), without a window over all rows.

    Rows are dealt into ranges of the order and numbered within each; a range begins after the rows of those before it,
    whose counts (one for each range) are all that meets in one place. ``kept`` holds the ranges between the two passes.
    """
    dealt = kept(df.repartitionByRange(*order).withColumn("__b", F.spark_partition_id()))
    counts = {r["__b"]: r["count"] for r in dealt.groupBy("__b").count().collect()}
    starts = [(b, sum(c for x, c in counts.items() if x < b)) for b in counts]
    before = df.sparkSession.createDataFrame(starts, "__b int, __start long")
    within = F.row_number().over(Window.partitionBy("__b").orderBy(*order))
    return dealt.withColumn("__r", within).join(F.broadcast(before), "__b").withColumn(name, F.col("__start") + F.col("__r")).drop("__b", "__r", "__start")
