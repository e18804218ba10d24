"""What several operators share: durable tables, columns, components of a graph."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the one the session names.

    Only a session in one process, as in tests, may name none; it gets a folder in its warehouse.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


#: Rows of an Arrow batch where the session leaves Spark's default (10,000 rows, whatever their size).
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Makes Arrow batches of texts small enough for a Python worker, unless the session sets their size itself."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder: its lineage is cut and a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders that ``stored`` has written and ``release`` has not removed, in order.
_WRITTEN: list[str] = []


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder (compressed and prunable, unlike a checkpoint)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables ``stored`` has written that are still there."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0) -> None:
    """Removes what ``stored`` wrote after there were ``since`` tables.

    Call it when the results that were made from those tables are written themselves.
    """
    jvm = spark.sparkContext._jvm
    while len(_WRITTEN) > since:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], base: str) -> str:
    """A name like ``base`` that no column has, in whatever case."""
    taken, name = {c.lower() for c in columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written once with a number for each of its rows, and the name of that column.

    Numbers that are worked out anew at each read change with the splits of the files, and those change when executors
    come and go. All passes over the texts read this table, so a number means one row throughout.
    """
    row = fresh(docs.columns, "row")
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows", "zstd"), row


def numbered_texts(table: DataFrame, row: str) -> DataFrame:
    """``doc_id``, ``row`` and ``text`` of a table of ``with_row``."""
    return table.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row"), F.col("text").cast("string").alias("text"))


def column_or_null(df: DataFrame, name: str, kind: str):
    """The column as ``kind``, or nulls where the table has no such column."""
    return df[name].cast(kind).alias(name) if name in df.columns else F.lit(None).cast(kind).alias(name)


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every node that has an edge.

    ``edges`` has long columns ``u`` and ``v``; the result has ``node`` and ``component``. Alternating large-star and
    small-star rounds (Kiveris et al., 2014) rewire each node to the least node it knows, so the number of rounds is
    logarithmic and no round holds a component together. The rounds end when the edges no longer change.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = durable(e)
    seen = _fingerprint(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = durable(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = _fingerprint(e)
        if now == seen:
            break
        seen = now
    least = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = least.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    return least.unionByName(roots)


def grouped_rows(df: DataFrame, key: str, work, schema: str) -> DataFrame:
    """``work(key, rows)`` for each run of rows with one ``key``, in sorted partitions; ``work`` returns tuples of arrays.

    Groups are read from a stream, so a task holds one group at a time.
    """
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    columns = df.columns

    def run(batches):
        rest: pa.Table | None = None
        out: list[tuple] = []
        size = 0

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(len(names))], names=names)

        def groups():
            nonlocal rest
            for batch in batches:
                own = pa.Table.from_batches([batch])
                rest = own if rest is None else pa.concat_tables([rest, own])
                k = rest.column(key).to_numpy()
                edges = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist()]
                for a, b in zip(edges, edges[1:], strict=False):
                    yield k[a], rest.slice(a, b - a)
                rest = rest.slice(edges[-1])
            if rest is not None and rest.num_rows:
                yield rest.column(key)[0].as_py(), rest

        for k, rows in groups():
            got = work(k, rows)
            if got is not None and len(got[0]):
                out.append(got)
                size += len(got[0])
            if size > 50_000:
                yield emit()
                out, size = [], 0
        if out:
            yield emit()

    return df.select(*columns).mapInArrow(run, schema)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same ids as all links do, without circles."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    keep = []
    for n, (x, y) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
        a, b = find(x), find(y)
        if a != b:
            root[a] = b
            keep.append(n)
    return u[keep], v[keep]
