"""Ranked lists: top n per user, exclusion of seen items, normalisation, fusion, diversity.

A ranked list is (customer_key, rank, product_key, score). Ranks follow the score to nine digits, then the item's id.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

U, I = "customer_key", "product_key"
DIGITS = 9


def unseen(candidates: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Candidates without the pairs of ``seen``."""
    return candidates if seen is None else candidates.join(seen.select(U, I).distinct(), [U, I], "left_anti")


def top_n(scores: DataFrame, n: int, key: str = U) -> DataFrame:
    """The n best of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("score", DIGITS)), I))
    return scores.withColumn("rank", rank).where(F.col("rank") <= n).select(key, "rank", I, "score")


def by_maximum(lists: DataFrame, key: str = U) -> DataFrame:
    """Scores divided by their list's maximum; zero where that isn't positive."""
    most = F.max("score").over(Window.partitionBy(key))
    return lists.withColumn("score", F.when(most > 0, F.col("score") / most).otherwise(0.0))


def by_range(lists: DataFrame, key: str = U) -> DataFrame:
    """Min-max scaled scores within each list; one where all are equal."""
    by = Window.partitionBy(key)
    low, high = F.min("score").over(by), F.max("score").over(by)
    return lists.withColumn("score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0))


def summed(parts: list[DataFrame]) -> DataFrame:
    """(customer_key, product_key, score) over all parts; an item that a list lacks counts as zero."""
    rows = [p.select(U, I, "score") for p in parts]
    out = rows[0]
    for p in rows[1:]:
        out = out.unionByName(p)
    return out.groupBy(U, I).agg(F.sum("score").alias("score"))


def fused(lists: dict[str, DataFrame], weights: dict[str, float], n: int) -> DataFrame:
    """Weighted sum of range-normalised lists; lists of no or negative weight are left out."""
    used = [by_range(df).withColumn("score", F.col("score") * F.lit(float(weights[k]))) for k, df in lists.items() if weights.get(k, 0) > 0]
    if not used:
        raise ValueError("no component has a positive weight")
    return top_n(summed(used), n)


def fused_by_segment(lists: dict[str, DataFrame], segment_of: DataFrame, segment_weights: dict[str, dict[str, float]], default: dict[str, float], n: int) -> DataFrame:
    """``fused`` with each user's segment's weights, as given; the default for other users.

    ``segment_of`` has (customer_key, segment); of a user in several segments the one that sorts last counts.
    """
    one = segment_of.groupBy(U).agg(F.max("segment").alias("segment"))
    used = []
    for name, df in lists.items():
        weight = F.lit(float(default.get(name, 0)))
        for segment, own in segment_weights.items():
            weight = F.when(F.col("segment") == segment, F.lit(float(own.get(name, 0)))).otherwise(weight)
        placed = by_range(df).join(one, U, "left").withColumn("__w", weight).where(F.col("__w") > 0)
        used.append(placed.withColumn("score", F.col("score") * F.col("__w")))
    return top_n(summed(used), n)


def _mmr(n: int, direct: int, trade: float):
    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        sets = [set(x) if x is not None else set() for x in rows["features"]]
        scores, chosen, left = rows["score"].tolist(), list(range(min(direct, len(rows)))), list(range(direct, len(rows)))

        def alike(a: int, b: int) -> float:
            both = sets[a] | sets[b]
            return len(sets[a] & sets[b]) / len(both) if both else 0.0

        while left and len(chosen) < n:
            best = max(left, key=lambda x: (round(trade * scores[x] - (1 - trade) * max((alike(x, c) for c in chosen), default=0.0), DIGITS), -x))
            chosen.append(best)
            left.remove(best)
        out = rows.iloc[chosen].copy()
        out["rank"] = range(1, len(out) + 1)
        return out[[U, "rank", I, "score"]]

    return pick


def diversified(lists: DataFrame, features: DataFrame, n: int, weight: float = 0.3, trade: float = 0.5) -> DataFrame:
    """The first int(n * (1 - weight)) of each list as they are, the rest by maximal marginal relevance.

    ``features`` has (product_key, features array); likeness is the Jaccard share of features, and the items taken
    directly count as selected; ties (to nine digits) go to the better rank. Lists of n items or fewer, and all for a weight of 0 or less, keep their order; from a
    weight of 1 on, all places are chosen for marginal relevance. Lists are short (2n), so a group is one user's list.
    """
    if weight <= 0:
        return lists.where(F.col("rank") <= n)
    direct = 0 if weight >= 1 else int(n * (1 - weight))
    size = F.count("*").over(Window.partitionBy(U))
    placed = lists.select(U, "rank", I, "score").join(features.select(I, "features"), I, "left").withColumn("__size", size)
    short = placed.where(F.col("__size") <= n).select(U, "rank", I, "score")
    kinds = {f.name: f.dataType.simpleString() for f in lists.schema.fields}
    long = placed.where(F.col("__size") > n).drop("__size")
    picked = long.groupBy(U).applyInPandas(_mmr(n, direct, trade), f"{U} {kinds[U]}, rank int, {I} {kinds[I]}, score double")
    return short.unionByName(picked)
