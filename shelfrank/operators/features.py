"""Features of items in long form (product_key, feature, value): words, categories, scaled numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

I = "product_key"
# Common English words that carry no topic; the default of the ``stop_words`` parameter.
STOP_WORDS = (
    "a an and are as at be been but by can do for from had has have he her his how i if in into is it its me my no not of on or our she so "
    "that the their them then there these they this to up us was we were what when which who will with you your"
).split()


def squares() -> Column:
    """Σ value² of a group of (feature, value) rows, in the order of features: equal groups have equal sums."""
    return F.aggregate(F.sort_array(F.collect_list(F.struct("feature", "value"))), F.lit(0.0), lambda s, x: s + x["value"] * x["value"])


def tf_idf(df: DataFrame, key: str, text: str, max_features: int = 100, min_df: float = 0.01, max_df: float = 0.95, stop_words: list[str] | None = None) -> DataFrame:
    """(key, feature, value): l2-normalised tf-idf of the words of a text column.

    Words are lower-case runs of two or more word characters that aren't stop words. Words in a share of documents within
    [min_df, max_df] are kept, of those the ``max_features`` most frequent in the corpus (ties by name). The weight is
    tf * (ln((1 + n) / (1 + df)) + 1). Null texts count as empty documents; no word left raises ValueError.
    """
    stop = STOP_WORDS if stop_words is None else stop_words
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), 0)
    tokens = df.select(key, F.explode(words).alias("feature")).where(~F.col("feature").isin(stop))
    tf = tokens.groupBy(key, "feature").agg(F.count("*").alias("tf"))
    n = df.count()
    spread = tf.groupBy("feature").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    kept = spread.where((F.col("df") >= min_df * n) & (F.col("df") <= max_df * n)).orderBy(F.desc("total"), "feature").limit(max_features)
    rows = kept.select("feature", "df").collect()  # max_features rows
    if not rows:
        raise ValueError("no word is left; change min_df or max_df")
    idf = df.sparkSession.createDataFrame([(r["feature"], r["df"]) for r in rows], "feature string, df long")
    weight = F.col("tf") * (F.log((1.0 + n) / (F.lit(1) + F.col("df"))) + 1)
    weighted = tf.join(F.broadcast(idf), "feature").select(key, "feature", weight.alias("value"))
    norms = weighted.groupBy(key).agg(F.sqrt(squares()).alias("norm"))
    return weighted.join(norms, key).select(key, "feature", (F.col("value") / F.col("norm")).alias("value"))


def categories(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A one for the value of each column; nothing for null."""
    pairs = [F.struct(F.concat(F.lit(f"{c}_"), F.col(c).cast("string")).alias("feature")) for c in columns]
    return df.select(key, F.explode(F.array(*pairs)).alias("p")).select(key, "p.feature", F.lit(1.0).alias("value")).where(F.col("feature").isNotNull())


def numbers(df: DataFrame, key: str, columns: list[str], constant: float = 0.5) -> DataFrame:
    """Columns scaled to 0..1, null counting as the median; ``constant`` for a column of equal values."""
    stats = [x for c in columns for x in (F.min(c).alias(f"__lo_{c}"), F.max(c).alias(f"__hi_{c}"), F.median(c).alias(f"__mid_{c}"))]
    placed = df.select(key, *columns).join(F.broadcast(df.agg(*stats)))

    def scale(c: str):
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        return F.when(hi > lo, (F.coalesce(F.col(c).cast("double"), F.col(f"__mid_{c}")) - lo) / (hi - lo)).otherwise(F.lit(constant))

    pairs = [F.struct(F.lit(c).alias("feature"), scale(c).alias("value")) for c in columns]
    return placed.select(key, F.explode(F.array(*pairs)).alias("p")).select(key, "p.feature", "p.value")


def item_features(df: DataFrame, texts: list[str] = (), categorical: list[str] = (), numeric: list[str] | None = None, key: str = I, **words) -> DataFrame:
    """Words of the texts, categories and scaled numbers of each item; numeric columns other than the key if not named."""
    if numeric is None:
        numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name != key]
    parts = []
    for t in texts:
        parts.append(tf_idf(df, key, t, **words).withColumn("feature", F.concat(F.lit(f"{t}:"), "feature")))
    if categorical:
        parts.append(categories(df, key, list(categorical)))
    if numeric:
        parts.append(numbers(df, key, list(numeric)))
    if not parts:
        raise ValueError("no feature column is named or found")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("value") != 0)


def unit_length(features: DataFrame, key: str = I) -> DataFrame:
    """Feature rows divided by their key's norm."""
    norms = features.groupBy(key).agg(F.sqrt(squares()).alias("norm")).where(F.col("norm") > 0)
    return features.join(norms, key).select(key, "feature", (F.col("value") / F.col("norm")).alias("value"))


def feature_sets(df: DataFrame, columns: list[str], key: str = I) -> DataFrame:
    """(product_key, features): names of each item's category values."""
    names = [F.concat(F.lit(f"{c}_"), F.col(c).cast("string")) for c in columns]
    return df.select(key, F.array_compact(F.array(*names)).alias("features"))
