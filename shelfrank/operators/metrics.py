"""Ranking metrics over ranked lists and held-out rows, overall and per segment.

Every metric has its own denominator: precision, recall, ndcg and hit rate average over all test users, map and mrr over
those with a relevant item, diversity and novelty over those for whom they are defined.
Results are tall: (metric, k, value), k null where a metric has none.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfrank.sources.shared import stored

U, I, R = "customer_key", "product_key", "rating"
K_VALUES = (1, 5, 10, 20)
METRICS = ("precision", "recall", "ndcg", "hit_rate", "map", "mrr")
THRESHOLD = 3.5
#: Recommended items whose values are sent to the tasks whole.
SENT_ITEMS = 100_000


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def relevance(test: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(customer_key, product_key, gain, relevant): the rating, and whether it reaches the threshold; all rows without ratings.

    Of a pair that is repeated the last rating by ``timestamp`` counts (at equal times, and without that column, the greatest).
    """
    if R not in test.columns:
        return test.select(U, I).distinct().withColumns({"gain": F.lit(1.0), "relevant": F.lit(True)})
    gain = F.max(F.struct("timestamp", R))[R] if "timestamp" in test.columns else F.max(R)
    return test.groupBy(U, I).agg(gain.alias("gain")).withColumn("relevant", F.col("gain") >= threshold)


def per_user(recs: DataFrame, rel: DataFrame, ks: tuple[int, ...] = K_VALUES) -> DataFrame:
    """(customer_key, k, precision, recall, ndcg, hit, ap, rr, n_relevant) of every user of ``rel``.

    Lists and test rows of a user meet by one shuffle; within it, pairs, places and sums need no other.
    """
    lists = recs.where((F.col("rank") <= max(ks)) & F.col(U).isNotNull()).select(U, I, "rank", F.lit(None).cast("double").alias("gain"), F.lit(None).cast("boolean").alias("relevant"), F.lit(True).alias("listed"))
    truth = rel.select(U, I, F.lit(None).cast("int").alias("rank"), "gain", "relevant", F.lit(False).alias("listed"))
    both, pair = lists.unionByName(truth).repartition(U), Window.partitionBy(U, I)
    both = both.withColumns({c: F.when(F.col(I).isNotNull() | ~F.col("listed"), F.max(c).over(pair)) for c in ("gain", "relevant")})
    listed, asked = F.col("listed"), ~F.col("listed")
    by = Window.partitionBy(U, "listed").orderBy("rank", F.desc("gain"), I)  # lists by rank, test rows (without one) by gain
    hit = (listed & F.coalesce(F.col("relevant"), F.lit(False))).cast("int")
    placed = both.withColumn("hit", hit).withColumns({"hits": F.sum("hit").over(by.rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(by)})
    placed = placed.withColumn("dcg", F.coalesce("gain", F.lit(0.0)) / F.log2(F.col("rank") + 1.0)).withColumn("prec", F.col("hit") * F.col("hits") / F.col("rank"))
    upto = lambda k, name: F.sum(F.when(F.col("rank") <= k, F.col(name))).alias(f"{name}_{k}")
    users = placed.groupBy(U).agg(
        F.count_if(listed).alias("length"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        *[upto(k, name) for k in ks for name in ("hit", "dcg", "prec")],
        F.count_if(asked).alias("asked"), F.count_if(asked & F.col("relevant")).alias("n_relevant"),
        *[F.sum(F.when(asked & (F.col("place") <= k), F.col("gain") / F.log2(F.col("place") + 1.0))).alias(f"ideal_{k}") for k in ks],
    ).where(F.col("asked") > 0)
    some = F.col("n_relevant") > 0

    def at(k: int) -> Column:
        hits = F.col(f"hit_{k}")
        return F.struct(
            F.lit(k).alias("k"), F.when(some, _ratio(hits, F.least(F.lit(k), "length"))).otherwise(0.0).alias("precision"), _ratio(hits, F.col("n_relevant")).alias("recall"),
            _ratio(F.col(f"dcg_{k}"), F.col(f"ideal_{k}")).alias("ndcg"), F.coalesce((hits > 0).cast("int"), F.lit(0)).cast("double").alias("hit"),
            _ratio(F.col(f"prec_{k}"), F.col("n_relevant")).alias("ap"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), "n_relevant",
        )

    return users.select(U, F.explode(F.array(*[at(k) for k in ks])).alias("m")).select(U, "m.*")


def averaged(users: DataFrame, ks: tuple[int, ...] = K_VALUES, metrics: tuple[str, ...] = METRICS, by: str | None = None) -> DataFrame:
    """Tall means over users, overall or for each value of ``by``."""
    keys = [by] if by else []
    relevant = F.col("n_relevant") > 0
    at_k = {"precision": F.avg("precision"), "recall": F.avg("recall"), "ndcg": F.avg("ndcg"), "hit_rate": F.avg("hit"), "map": F.coalesce(F.avg(F.when(relevant, F.col("ap"))), F.lit(0.0))}
    if "hit_rate" in metrics or "cumulative_hit_rate" in metrics:
        at_k["cumulative_hit_rate"] = F.avg("hit")
        metrics = (*metrics, "cumulative_hit_rate")
    at_k["mrr"] = F.coalesce(F.avg(F.when(relevant, F.col("rr"))), F.lit(0.0))
    names = [m for m in at_k if m in metrics]
    wide = users.groupBy(*keys, "k").agg(*[at_k[m].alias(m) for m in names])
    tall = wide.unpivot([*keys, "k"], names, "metric", "value").where((F.col("metric") != "mrr") | (F.col("k") == max(ks)))
    return tall.select(*keys, "metric", F.when(F.col("metric") != "mrr", F.col("k")).alias("k"), "value")


def _with_items(recs: DataFrame, values: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Lists with the columns that ``values`` has by item; only recommended items are sent, whole if they are few."""
    used = recs.where(F.col("rank") <= max(ks))
    own = stored(values.join(used.select(I).distinct(), I, "left_semi"), "items")
    return used.join(F.broadcast(own) if own.count() <= SENT_ITEMS else own, I)


def diversity(recs: DataFrame, sets: DataFrame, ks: tuple[int, ...] = K_VALUES) -> DataFrame:
    """(k, value): mean over users of the mean Jaccard distance of pairs of items that both have features.

    ``sets`` has (product_key, features). A list's pairs are bounded by the largest k; they are compared where the list is,
    equal pairs of items once for a batch of users.
    """
    used = _with_items(recs, sets.where(F.size("features") > 0).select(I, F.array_distinct("features").alias("features")), ks)
    lists = used.groupBy(U).agg(F.collect_list(F.struct("rank", I, "features")).alias("l")).select(*[F.col(f"l.{c}").alias(c) for c in ("rank", I, "features")])
    depths = np.array(ks)

    def run(batches):
        for batch in batches:
            user = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("rank")).to_numpy(zero_copy_only=False))
            rank, item = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("rank", I))
            order = np.lexsort((rank, user))
            user, rank, item = user[order], rank[order], item[order]
            items, first, code = np.unique(item, return_index=True, return_inverse=True)
            features = [frozenset(x) for x in batch.column("features").flatten().take(pa.array(order[first])).to_pylist()]
            # each row meets those that come after it in its list, with a later rank
            size = np.searchsorted(user, user, "right") - np.arange(len(user)) - 1
            a = np.repeat(np.arange(len(user)), size)
            b = np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size) + a + 1
            later = rank[a] < rank[b]
            a, b = a[later], b[later]
            pairs, at = np.unique(np.minimum(code[a], code[b]) * len(items) + np.maximum(code[a], code[b]), return_inverse=True)
            apart = np.array([1.0 - len(features[x] & features[y]) / len(features[x] | features[y]) for x, y in zip(*(p.tolist() for p in np.divmod(pairs, max(len(items), 1))), strict=True)])
            for k in depths:
                inside = rank[b] <= k
                n = np.bincount(user[a[inside]], minlength=batch.num_rows)
                total = np.bincount(user[a[inside]], apart[at[inside]] if len(pairs) else None, minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([(total[n > 0] / n[n > 0]).sum()]), pa.array([(n > 0).sum()])], names=["k", "s", "n"])

    sums = lists.mapInArrow(run, "k int, s double, n long").groupBy("k").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return sums.where("n > 0").select("k", (F.col("s") / F.col("n")).alias("value"))


def novelty(recs: DataFrame, counts: DataFrame, ks: tuple[int, ...] = K_VALUES) -> DataFrame:
    """(k, value): mean over users of the mean -log2 of their items' share of all rows.

    ``counts`` has (product_key, n); items without rows are skipped, users without any such item dropped.
    """
    total = counts.agg(F.sum("n").alias("total"))
    shares = counts.where("n > 0").join(F.broadcast(total)).select(I, (-F.log2(F.col("n") / F.col("total"))).alias("surprise"))
    means = _with_items(recs, shares, ks).groupBy(U).agg(*[F.avg(F.when(F.col("rank") <= k, F.col("surprise"))).alias(str(k)) for k in ks])
    row = means.agg(*[F.avg(F.col(f"`{k}`")).alias(str(k)) for k in ks])
    return row.unpivot([], [F.col(f"`{k}`") for k in ks], "k", "value").where(F.col("value").isNotNull()).select(F.col("k").cast("int").alias("k"), "value")


def coverage(recs: DataFrame, items: DataFrame, ks: tuple[int, ...] = K_VALUES) -> DataFrame:
    """(k, value): distinct recommended items over distinct items of the test rows; may exceed 1."""
    first = recs.groupBy(I).agg(F.min("rank").alias("rank"))
    total = items.agg(F.count_distinct(I).alias("total"))
    row = first.agg(*[F.count_if(F.col("rank") <= k).alias(str(k)) for k in ks])
    tall = row.unpivot([], [str(k) for k in ks], "k", "n")
    return tall.join(F.broadcast(total)).select(F.col("k").cast("int").alias("k"), _ratio(F.col("n"), F.col("total")).alias("value"))


#: Metrics beside the built-in ones: name -> (recs, relevance, ks) -> (k, value).
REGISTRY: dict[str, Callable[[DataFrame, DataFrame, tuple[int, ...]], DataFrame]] = {}


def evaluate(
    recs: DataFrame, test: DataFrame, ks: tuple[int, ...] = K_VALUES, metrics: tuple[str, ...] = METRICS, threshold: float = THRESHOLD,
    sets: DataFrame | None = None, segment_of: DataFrame | None = None,
) -> DataFrame:
    """(segment, metric, k, value): all metrics of all test users (segment null) and, with ``segment_of``, of each segment.

    Lists of users without test rows don't count. Unknown metric names are ignored.
    """
    rel = stored(relevance(test, threshold), "relevance")
    recs = stored(recs.join(rel.select(U).distinct(), U, "left_semi").where(F.col("rank") <= max(ks)).select(U, "rank", I), "lists")  # each metric reads the lists
    users = stored(per_user(recs, rel, ks), "users")
    parts = [averaged(users, ks, metrics)]
    tall = lambda df, name: df.select(F.lit(name).alias("metric"), "k", "value")
    if "diversity" in metrics and sets is not None:
        parts.append(tall(diversity(recs, sets, ks), "diversity"))
    if "novelty" in metrics:
        parts.append(tall(novelty(recs, test.groupBy(I).agg(F.count("*").alias("n")), ks), "novelty"))
    if "coverage" in metrics:
        parts.append(tall(coverage(recs, test, ks), "coverage"))
    parts += [tall(REGISTRY[m](recs, rel, ks), m) for m in metrics if m in REGISTRY]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.select(F.lit(None).cast("string").alias("segment"), "metric", "k", "value")
    if segment_of is not None:
        placed = users.join(segment_of.select(U, "segment").distinct(), U)
        own = averaged(placed, ks, tuple(m for m in metrics if m in ("precision", "recall", "ndcg", "hit_rate")), "segment").where(F.col("metric") != "cumulative_hit_rate")
        out = out.unionByName(own)
    return out


def compare(lists: dict[str, DataFrame], test: DataFrame, **options) -> DataFrame:
    """``evaluate`` of each named list, with a model column."""
    parts = [evaluate(recs, test, **options).withColumn("model", F.lit(name)) for name, recs in lists.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
