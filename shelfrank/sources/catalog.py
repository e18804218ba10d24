"""The star schema as lazy DataFrames: from CSV or Parquet files, or from order tables."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from shelfrank.operators import prepare, sampling
from shelfrank.sources.config import Config

log = logging.getLogger(__name__)
#: Columns with a type of their own; others are strings or, in reports, inferred.
TYPES = {
    "customer_key": T.LongType(), "product_key": T.LongType(), "birth_date": T.TimestampNTZType(), "order_date": T.TimestampNTZType(),
    "shipping_date": T.TimestampNTZType(), "due_date": T.TimestampNTZType(), "sales": T.DoubleType(), "quantity": T.IntegerType(),
    "rating": T.DoubleType(), "cost": T.DoubleType(), "price": T.DoubleType(),
}


#: The column that a table read with a schema has for lines that don't fit it.
DAMAGED = "damaged_line"
#: What the parser gives for a field without text or quotes; quoted empty text stays empty text.
NOTHING = "\x00"


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", schema: T.StructType | None = None) -> DataFrame:
    """A CSV file with a header.

    With a schema one pass reads it: fields that don't fit their type are null, and ``damaged_line`` has the line they come
    from (null for sound lines). Without one, known columns are cast and the rest of a report is inferred.
    """
    reader = spark.read.option("header", True).option("encoding", encoding).option("quote", '"').option("escape", '"')
    if schema is not None:
        wide = T.StructType([*schema.fields, T.StructField(DAMAGED, T.StringType())])
        return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", DAMAGED).option("nullValue", NOTHING).schema(wide).csv(path)
    df = reader.option("inferSchema", True).csv(path)
    return df.select(*[F.try_to_timestamp(F.col(c).cast("string")).cast("timestamp_ntz").alias(c) if isinstance(TYPES.get(c), T.TimestampNTZType) else F.expr(f"try_cast(`{c}` AS {TYPES[c].simpleString()})").alias(c) if c in TYPES else F.col(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """A folder of CSV files with headers, which ``read_csv`` reads back: quotes are doubled, empty text is quoted, null is not."""
    df.write.option("header", True).option("encoding", encoding).option("quote", '"').option("escape", '"').option("emptyValue", '""').csv(path)


def read_table(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame | None:
    """A CSV or Parquet table; None, with a warning, where there is none."""
    try:
        return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_csv(spark, path, encoding)
    except AnalysisException as e:
        log.warning("no table at %s: %s", path, str(e).splitlines()[0])
        return None


@dataclass
class Catalog:
    """Five tables, any of which may be missing, and what is derived from them."""

    customers: DataFrame | None = None
    products: DataFrame | None = None
    sales: DataFrame | None = None
    customer_report: DataFrame | None = None
    product_report: DataFrame | None = None

    @classmethod
    def load(cls, spark: SparkSession, config: Config | None = None) -> Catalog:
        """Reads and prepares the tables that the settings name; a sample of customers restricts what refers to them."""
        config = config or Config()
        base = config.get("data.dir").rstrip("/")
        encoding = config.get("data.encoding", "UTF-8")
        found = {name: read_table(spark, f"{base}/{config.get(f'data.{name}')}", encoding) for name in ("customers", "products", "sales", "customer_report", "product_report")}
        return cls(**found).prepared(config.get("data.sample_size", 1.0))

    def prepared(self, sample_size: float = 1.0) -> Catalog:
        out = Catalog(
            self.customers and prepare.customers(self.customers), self.products and prepare.products(self.products),
            self.sales and prepare.sales(self.sales), self.customer_report, self.product_report,
        )
        if sample_size < 1 and out.customers is not None:
            out.customers = sampling.sample(out.customers, "customer_key", sample_size)
            keys = out.customers.select("customer_key")
            out.sales = out.sales and out.sales.join(keys, "customer_key", "left_semi")
            out.customer_report = out.customer_report and out.customer_report.join(keys, "customer_key", "left_semi")
        return out

    def interactions(self) -> DataFrame:
        return prepare.interactions(self.sales)

    def user_features(self) -> DataFrame:
        return prepare.features(self.customers, self.customer_report, "customer_key")

    def item_features(self) -> DataFrame:
        return prepare.features(self.products, self.product_report, "product_key")

    def customer_segments(self) -> DataFrame:
        return prepare.segments(self.customer_report, "cust_segmentation", "customer_key")

    def product_segments(self) -> DataFrame:
        return prepare.segments(self.product_report, "product_segment", "product_key")


class Orders:
    """The star schema over order tables in a folder of Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def raw_sales(self) -> DataFrame:
        """A row for each line of an order."""
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_custkey").alias("customer_key"), F.col("l_partkey").alias("product_key"), F.col("o_orderdate").alias("order_date"),
            F.col("l_shipdate").alias("shipping_date"), F.col("l_extendedprice").alias("sales"), F.col("l_quantity").alias("quantity"),
        )

    def raw_customers(self) -> DataFrame:
        nation = self.table("nation").join(F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 nations
        joined = self.table("customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        return joined.select(F.col("c_custkey").alias("customer_key"), F.col("n_name").alias("country"), F.col("r_name").alias("region"))

    def raw_products(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("product_key"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category"),
            F.col("p_brand").alias("sub_category"), F.col("p_retailprice").alias("cost"),
        )

    def customer_report(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("customer_key"), F.col("c_mktsegment").alias("cust_segmentation"), F.col("c_acctbal").alias("balance"))

    def product_report(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("product_key"), F.col("p_brand").alias("product_segment"), F.col("p_size").alias("size"))

    def catalog(self) -> Catalog:
        """The prepared tables."""
        return Catalog(self.raw_customers(), self.raw_products(), self.raw_sales(), self.customer_report(), self.product_report()).prepared()

    def interactions(self) -> DataFrame:
        """Rows of one pair, date and sales give the same interaction, so the other columns aren't carried."""
        return prepare.interactions(prepare.sales(self.raw_sales().select("customer_key", "product_key", "order_date", "sales")))
