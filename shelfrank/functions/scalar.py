"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mapped(col: Column, values: dict) -> Column:
    """The value that a dictionary gives, or null."""
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(col == k, F.lit(v)).otherwise(out)
    return out


def clipped(col: Column, low: float, high: float) -> Column:
    """The value within bounds; null stays null."""
    return F.when(col.isNotNull(), F.greatest(F.least(col, F.lit(high)), F.lit(low)))


def one_hot(col: Column, prefix: str, values: list[str]) -> list[Column]:
    """A 0/1 column for each value; all zero for null."""
    return [F.coalesce((col == v).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in values]


def binned(col: Column, edges: list[float], names: list[str]) -> Column:
    """The name of the bin (edge, next edge]; the last is open; null at or under the first edge."""
    out = F.lit(None).cast("string")
    for edge, name in zip(edges, names, strict=True):
        out = F.when(col > edge, F.lit(name)).otherwise(out)
    return out


def first_number(col: Column) -> Column:
    """The first run of digits as a double, or null."""
    return F.regexp_extract(col, r"(\d+)", 1).try_cast("double")


def scaled(value: Column, low: Column, high: Column, to_low: float, to_high: float, constant: float) -> Column:
    """Min-max scaling; ``constant`` where all values are equal."""
    return F.when(high > low, to_low + (to_high - to_low) * (value - low) / (high - low)).when(value.isNotNull(), F.lit(constant))


def keyed_hash(columns: list[Column], seed: int) -> Column:
    """A number below 2^52, from an md5 of the seed and the keys as text, that any SQL engine computes alike; null is empty text."""
    text = F.concat_ws(",", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def norm_or_tiny(col: Column) -> Column:
    """A norm, with 1e-10 for zero or less."""
    return F.when(col > 0, col).otherwise(F.lit(1e-10))
