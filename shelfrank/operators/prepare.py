"""Cleaning and derivation of the star schema's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from shelfrank.functions.scalar import clipped, first_number, mapped, one_hot, scaled
from shelfrank.sources.shared import stored

#: A country column with more values than this is not spread over columns.
MOST_COUNTRIES = 20
REQUIRED = {"customers": ["customer_key"], "products": ["product_key"], "sales": ["customer_key", "product_key"]}


def checked(df: DataFrame, required: list[str]) -> DataFrame:
    """Raises ValueError where a required column is missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def validated(df: DataFrame, required: list[str]) -> DataFrame:
    """Distinct rows. Raises ValueError where a required column is missing."""
    return checked(df, required).distinct()


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls) of every column, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column", "nulls")


def distinct_values(df: DataFrame, column: str, most: int | None = None) -> list[str]:
    """Sorted values without null; empty if there are more than ``most``."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct()
    found = sorted(r[0] for r in (rows.limit(most + 1) if most else rows).collect())
    return [] if most and len(found) > most else found


def customers(df: DataFrame, year: int | None = None) -> DataFrame:
    """Codes for gender and marital status, age in years, country columns and the lower end of the age group."""
    out = validated(df, REQUIRED["customers"])
    if "gender" in df.columns:
        out = out.withColumn("gender_code", mapped(F.col("gender"), {"Male": 0, "Female": 1}))
    if "marital_status" in df.columns:
        out = out.withColumn("marital_code", mapped(F.col("marital_status"), {"Single": 0, "Married": 1}))
    if "birth_date" in df.columns:
        now = F.lit(year) if year else F.year(F.current_date())
        out = out.withColumn("age", now - F.year(F.col("birth_date").try_cast("timestamp_ntz")))
    if "country" in df.columns and (values := distinct_values(df, "country", MOST_COUNTRIES)):
        out = out.select("*", *one_hot(F.col("country"), "country", values))
    if "age_group" in df.columns:
        out = out.withColumn("age_group_lower", first_number(F.col("age_group")))
    return out


def products(df: DataFrame) -> DataFrame:
    """A description of the texts that there are, columns for each category value, and cost with its median for null."""
    out = validated(df, REQUIRED["products"])
    texts = [c for c in ("product_name", "category", "sub_category") if c in df.columns]
    if texts:
        out = out.withColumn("product_description", F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in texts]))
    for c in ("category", "sub_category", "maintenance"):
        if c in df.columns:
            out = out.select("*", *one_hot(F.col(c), c, distinct_values(df, c)))
    if "cost" in df.columns:
        median = out.agg(F.median("cost").alias("__median"))
        out = out.join(F.broadcast(median)).withColumn("cost", F.coalesce("cost", "__median")).drop("__median")  # one row
    return out


def with_rating(df: DataFrame) -> DataFrame:
    """Rating as given; else sales scaled to 1..5 over all rows (1 if constant); else quantity within 1..5; else 1."""
    if "rating" in df.columns:
        return df
    if "sales" in df.columns:
        ends = df.agg(F.min("sales").alias("__lo"), F.max("sales").alias("__hi"))
        rated = df.join(F.broadcast(ends)).withColumn("rating", scaled(F.col("sales"), F.col("__lo"), F.col("__hi"), 1, 5, 1.0))  # one row
        return rated.drop("__lo", "__hi")
    if "quantity" in df.columns:
        return df.withColumn("rating", clipped(F.col("quantity").cast("double"), 1, 5))
    return df.withColumn("rating", F.lit(1.0))


def sales(df: DataFrame) -> DataFrame:
    """Rated sales, one for each customer and product: the latest by order date, then of most sales, then quantity.

    The latest row is a maximum of structs, which combines within each task before the shuffle; a null date comes last, and
    repeated rows change nothing. Without dates the best-rated row stays. A rating that follows from sales is worked out on
    what is left, with the ends over all rows, so it isn't in the order: sales order rows as it does.
    """
    df = checked(df, REQUIRED["sales"])
    by_sales = "rating" not in df.columns and "sales" in df.columns
    rated = df if by_sales else with_rating(df)
    order = [c for c in ("order_date", "sales", "quantity", "rating") if c in rated.columns]
    if "order_date" not in rated.columns and not by_sales:
        order = ["rating", *[c for c in order if c != "rating"]]
    rest = [c for c in rated.columns if c not in ("customer_key", "product_key", *order)]
    groups = rated.groupBy("customer_key", "product_key")
    columns = ["customer_key", "product_key", *[F.col(f"s.{c}").alias(c) for c in rated.columns if c in order or c in rest]]
    if not by_sales:
        return groups.agg(F.max(F.struct(*order, *rest)).alias("s")).select(*columns)
    latest = groups.agg(F.max(F.struct(*order, *rest)).alias("s"), F.min("sales").alias("lo"), F.max("sales").alias("hi"))
    # ends that differ from the row's own sales alone are written: most pairs have one row
    ends = [F.when(~F.col(c).eqNullSafe(F.col("s.sales")), F.col(c)).alias(f"__{c}") for c in ("lo", "hi")]
    latest = stored(latest.select(*columns, *ends), "sales")
    row = latest.agg(F.min(F.coalesce("__lo", "sales")).alias("lo"), F.max(F.coalesce("__hi", "sales")).alias("hi")).first()
    low, high = F.lit(row["lo"]).cast("double"), F.lit(row["hi"]).cast("double")
    return latest.withColumn("rating", scaled(F.col("sales"), low, high, 1, 5, 1.0)).drop("__lo", "__hi")


def interactions(sales_: DataFrame) -> DataFrame:
    """customer_key, product_key, rating and, where there are order dates, timestamp."""
    out = with_rating(sales_)
    stamp = [F.col("order_date").alias("timestamp")] if "order_date" in sales_.columns else []
    return out.select("customer_key", "product_key", "rating", *stamp)


def features(dim: DataFrame, report: DataFrame | None, key: str) -> DataFrame:
    """The dimension and the report's numeric columns that it lacks."""
    if report is None:
        return dim
    extra = [f.name for f in report.schema.fields if isinstance(f.dataType, NumericType) and f.name not in dim.columns]
    return dim.join(report.select(key, *extra), key, "left")


def segments(report: DataFrame, column: str, key: str) -> DataFrame:
    """(segment, key) of every row whose segment is neither null nor empty."""
    return report.where(F.col(column).isNotNull() & (F.col(column) != "")).select(F.col(column).alias("segment"), key).distinct()


def active(inter: DataFrame, min_ratings: int = 5, user: str = "customer_key") -> DataFrame:
    """Rows of users with ``min_ratings`` rows or more."""
    if min_ratings <= 1:
        return inter
    known = inter.where(F.col(user).isNotNull())
    few = stored(known.groupBy(user).agg(F.count("*").alias("n")).where(F.col("n") < min_ratings).select(user), "few")  # most often a small table
    return known.join(few, user, "left_anti")


def feature_columns(df: DataFrame, key: str = "product_key") -> tuple[list[str], list[str], list[str]]:
    """(texts, categories, numbers) of a prepared product table: what item features are made of."""
    texts = [c for c in ("product_description",) if c in df.columns]
    categorical = [c for c in ("category", "sub_category", "maintenance") if c in df.columns]
    spread = tuple(f"{c}_" for c in categorical)
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name != key and not (spread and f.name.startswith(spread))]
    return texts, categorical, numeric
