"""Profiles of interactions: matrix, sparsity, behaviour, popularity, quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfrank.functions.scalar import binned

U, I, R = "customer_key", "product_key", "rating"
# The bins of users' and items' activity, (edge, next edge].
ACTIVITY = ([0, 5, 20, 50], ["Low", "Medium", "High", "Very High"])
POPULARITY = ([0, 5, 20, 100], ["Niche", "Moderate", "Popular", "Blockbuster"])
# Sparsity above which a verdict holds.
VERDICTS = [(0.995, "extremely sparse"), (0.98, "very sparse"), (0.95, "sparse")]


def share(part: Column, whole: Column, of: float = 1.0) -> Column:
    """``of * part / whole``; null for a whole of zero."""
    return F.try_divide(F.lit(of) * part, whole)


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row tables joined into one row."""
    return reduce(lambda a, b: a.join(F.broadcast(b)), rows)


def interaction_matrix(df: DataFrame, user: str = U, item: str = I, value: str | None = R) -> DataFrame:
    """Cells (user, item, value): the mean value of each pair, or the number of its rows."""
    return df.groupBy(user, item).agg((F.avg(value) if value else F.count("*").cast("double")).alias("value"))


def centred(matrix: DataFrame, user: str = U, item: str = I) -> DataFrame:
    """The matrix less each user's mean over all items, absent cells counting as zero."""
    items = matrix.agg(F.count_distinct(item).alias("__n"))
    means = matrix.groupBy(user).agg(F.sum("value").alias("__sum"))
    placed = matrix.join(means, user).join(F.broadcast(items))  # one row
    mean = F.col("__sum") / F.col("__n")
    return placed.select(user, item, (F.col("value") - mean).alias("value"), mean.alias("user_mean"))


def matrix_sparsity(matrix: DataFrame, user: str = U, item: str = I) -> DataFrame:
    """Users, items, non-zero cells and the percentage of the matrix that is empty or zero."""
    one = matrix.agg(F.count_distinct(user).alias("n_users"), F.count_distinct(item).alias("n_items"), F.count_if(F.col("value") != 0).alias("n_nonzero"))
    return one.withColumn("sparsity_pct", 100 - share(F.col("n_nonzero"), F.col("n_users") * F.col("n_items"), 100.0))


def pivoted(df: DataFrame, rows: str, columns: str, values: list, value: str = R) -> DataFrame:
    """Mean value of each row key and named column value; zero where there is none. For display of a few columns."""
    return df.groupBy(rows).pivot(columns, values).agg(F.avg(value)).na.fill(0.0)


def describe(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles (interpolated), in one row."""
    c = F.col(column)
    return df.agg(
        F.count(c).alias(f"{prefix}count"), F.avg(c).alias(f"{prefix}mean"), F.stddev_samp(c).alias(f"{prefix}std"), F.min(c).alias(f"{prefix}min"),
        F.percentile(c, 0.25).alias(f"{prefix}p25"), F.percentile(c, 0.5).alias(f"{prefix}p50"), F.percentile(c, 0.75).alias(f"{prefix}p75"), F.max(c).alias(f"{prefix}max"),
    )


def verdict(sparsity: Column) -> Column:
    out = F.lit("moderately sparse")
    for edge, name in reversed(VERDICTS):
        out = F.when(sparsity > edge, F.lit(name)).otherwise(out)
    return out


def sparsity(df: DataFrame, user: str = U, item: str = I) -> DataFrame:
    """Density by rows, spread of rows per user and per item, users and items with under five rows, and a verdict."""
    def counts(key: str, p: str) -> DataFrame:
        n = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNotNull())
        low = F.count_if(F.col("n") < 5)
        return n.agg(
            F.count("*").alias(f"n_{p}s"), F.sum("n").alias(f"__{p}_rows"), F.min("n").alias(f"{p}_min"), F.max("n").alias(f"{p}_max"), F.avg("n").alias(f"{p}_mean"),
            F.median("n").alias(f"{p}_median"), F.percentile("n", 0.25).alias(f"{p}_p25"), F.percentile("n", 0.75).alias(f"{p}_p75"),
            low.alias(f"{p}s_under_5"), share(low, F.count("*"), 100.0).alias(f"{p}s_under_5_pct"),
        )

    total = df.agg(F.count("*").alias("n_rows"))
    one = side_by_side(total, counts(user, "user"), counts(item, "item")).drop("__user_rows", "__item_rows")
    one = one.withColumn("density", share(F.col("n_rows"), F.col("n_users") * F.col("n_items"), 1.0))
    return one.withColumn("sparsity", 1 - F.col("density")).withColumn("verdict", verdict(F.col("sparsity")))


def per_key(df: DataFrame, key: str, rating: str | None = R) -> DataFrame:
    """Rows of each key and, with ratings, their mean, sample deviation and count."""
    rated = [F.avg(rating).alias("rating_mean"), F.stddev_samp(rating).alias("rating_std"), F.count(rating).alias("rating_count")] if rating in df.columns else []
    return df.groupBy(key).agg(F.count("*").alias("n"), *rated)


def user_behaviour(df: DataFrame, user: str = U, rating: str | None = R) -> DataFrame:
    """``per_key`` of users, with the name of the activity bin."""
    return per_key(df, user, rating).withColumn("activity", binned(F.col("n"), *ACTIVITY))


def item_popularity(df: DataFrame, item: str = I, rating: str | None = R) -> DataFrame:
    """``per_key`` of items, with the name of the popularity bin."""
    return per_key(df, item, rating).withColumn("popularity", binned(F.col("n"), *POPULARITY))


def bin_sizes(profiles: DataFrame, column: str) -> DataFrame:
    return profiles.groupBy(column).agg(F.count("*").alias("n_keys"))


def by_hour(df: DataFrame, time: str) -> DataFrame:
    return df.groupBy(F.hour(time).alias("hour")).agg(F.count("*").alias("n"))


def by_weekday(df: DataFrame, time: str) -> DataFrame:
    return df.groupBy(F.date_format(time, "EEEE").alias("weekday")).agg(F.count("*").alias("n"))


def spans(df: DataFrame, user: str, time: str) -> DataFrame:
    """First and last time of each user, rows, and hours between."""
    one = df.groupBy(user).agg(F.min(time).alias("first_ts"), F.max(time).alias("last_ts"), F.count(time).alias("n"))
    return one.withColumn("hours", F.timestamp_diff("MICROSECOND", F.col("first_ts"), F.col("last_ts")) / F.lit(3.6e9))


def pareto(df: DataFrame, item: str = I, of: float = 0.8) -> DataFrame:
    """How many items, from the most frequent on, make up at most ``of`` of the rows, and their percentage.

    Equal counts are summed first, so the running sum is over distinct counts, not over items.
    """
    sizes = df.groupBy(item).agg(F.count("*").alias("n")).where(F.col(item).isNotNull())
    levels = sizes.groupBy("n").agg(F.count("*").alias("items"))
    total = levels.agg(F.sum(F.col("n") * F.col("items")).alias("total"), F.sum("items").alias("n_items"))
    above = F.coalesce(F.sum(F.col("n") * F.col("items")).over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = levels.withColumn("above", above).join(F.broadcast(total))  # one row
    fit = F.floor((F.floor(F.lit(of) * F.col("total") + 1e-9) - F.col("above")) / F.col("n"))
    taken = room.withColumn("fit", F.greatest(F.lit(0), F.least(F.col("items"), fit)))
    one = taken.agg(F.sum("fit").cast("long").alias("n_head"), F.max("n_items").alias("n_items"))
    return one.withColumn("head_pct", share(F.col("n_head"), F.col("n_items"), 100.0))


def validation(df: DataFrame, user: str = U, item: str = I, rating: str | None = R) -> DataFrame:
    """Totals, errors, warnings and a verdict on the data's quality, in one row.

    Null ids and missing columns are errors; repeated pairs, null ratings and a majority of users or items with under
    three rows are warnings. Keys strictly above the 99th percentile of counts are reported as power users and items.
    """
    missing = [c for c in (user, item) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    rated = rating in df.columns if rating else False
    value = F.col(rating) if rated else F.lit(None).cast("double")
    totals = df.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col(user).isNull()).alias("null_users"), F.count_if(F.col(item).isNull()).alias("null_items"),
        (F.count_if(value.isNull()) if rated else F.lit(0)).cast("long").alias("null_ratings"),
        F.min(value).alias("rating_min"), F.max(value).alias("rating_max"), F.avg(value).alias("rating_mean"),
    )
    pairs = df.groupBy(user, item).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("repeated_pairs"))

    def spread(key: str, p: str) -> DataFrame:
        n = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
        levels = n.groupBy("n").agg(F.count("*").alias("keys"))
        cut = levels.agg(F.percentile("n", 0.99, F.col("keys")).alias("cut"))
        return levels.join(F.broadcast(cut)).agg(
            F.coalesce(F.sum("keys"), F.lit(0)).alias(f"n_{p}s"), F.coalesce(F.sum(F.when(F.col("n") < 3, F.col("keys"))), F.lit(0)).alias(f"{p}s_under_3"),
            F.coalesce(F.sum(F.when(F.col("n") > F.col("cut"), F.col("keys"))), F.lit(0)).alias(f"power_{p}s"),
        )

    one = side_by_side(totals, pairs, spread(user, "user"), spread(item, "item"))
    flag = lambda c: c.cast("int")
    errors = flag(F.col("null_users") > 0) + flag(F.col("null_items") > 0)
    warnings = flag(F.col("repeated_pairs") > 0) + flag(F.col("null_ratings") > 0) + flag(2 * F.col("users_under_3") > F.col("n_users")) + flag(2 * F.col("items_under_3") > F.col("n_items"))
    one = one.withColumn("n_errors", errors).withColumn("n_warnings", warnings)
    grade = F.when(F.col("n_errors") > 0, "POOR").when(F.col("n_warnings") == 0, "EXCELLENT").when(F.col("n_warnings") <= 2, "GOOD").otherwise("FAIR")
    return one.withColumn("quality", grade)


def dataset_stats(customers: DataFrame, products: DataFrame, sales: DataFrame) -> DataFrame:
    """Rows of the tables, density of sales over customers and products, size and sparsity of the matrix."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    cells = matrix_sparsity(interaction_matrix(sales)).withColumnsRenamed({"n_users": "matrix_users", "n_items": "matrix_items"})
    one = side_by_side(n(customers, "n_customers"), n(products, "n_products"), n(sales, "n_sales"), cells)
    return one.withColumn("density", share(F.col("n_sales"), F.col("n_customers") * F.col("n_products")))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value of a column and their share of all rows, nulls included."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    return counts.join(F.broadcast(total)).select(column, "n", share(F.col("n"), F.col("__total")).alias("share"))


def thresholds(df: DataFrame, key: str, levels: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """(level, under, at_least, under_pct): keys with fewer rows than each level."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    row = n.agg(F.count("*").alias("keys"), *[F.count_if(F.col("n") < k).alias(str(k)) for k in levels])
    tall = row.unpivot(["keys"], [str(k) for k in levels], "level", "under")
    return tall.select(F.col("level").cast("int").alias("level"), "under", (F.col("keys") - F.col("under")).alias("at_least"), share(F.col("under"), F.col("keys"), 100.0).alias("under_pct"))


def eda_totals(sales: DataFrame) -> DataFrame:
    """Distinct users and items, sum (to six digits, exact) and mean of sales, mean purchases of a user."""
    one = sales.agg(F.count("*").alias("n_rows"), F.count_distinct(U).alias("n_users"), F.count_distinct(I).alias("n_items"), F.sum(F.col("sales").cast("decimal(28,6)")).cast("double").alias("sales_sum"), F.avg("sales").alias("sales_mean"))
    return one.withColumn("purchases_mean", share(F.col("n_rows"), F.col("n_users")))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, low, high, n) of equal-width bins; the last holds the maximum. Only bins that have rows."""
    ends = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    placed = df.where(F.col(column).isNotNull()).join(F.broadcast(ends))
    width = (F.col("__hi") - F.col("__lo")) / F.lit(float(bins))
    at = F.when(F.col("__hi") > F.col("__lo"), F.least(F.floor((F.col(column) - F.col("__lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    one = placed.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.first("__lo").alias("lo"), F.first(width).alias("w"))
    return one.select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), "n")


def id_map(df: DataFrame, key: str) -> DataFrame:
    """A dense index from 0 for each distinct key, in hashed order."""
    from shelfrank.operators.sampling import numbered

    return numbered(df.select(key).where(F.col(key).isNotNull()).distinct(), key, "index")
