"""Product codes of vectors: 16 parts, each the index of its nearest of 64 learnt entries, exact in integers.

All entries of a part are screened by one product of float32 matrices. Its rounding error has a bound, so every entry's
distance lies in a known interval; where the interval of another entry overlaps that of the best, the distances are worked
out again in 64-bit integers, and equal ones go to the lower index.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.llm.common import column_or_null, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers of 2**90 and more can't be summed as decimals.
LARGEST = 2.0**90
#: Labels whose sums are sent to the tasks; more are joined by a shuffle.
SENT_LABELS = 100_000
_UNIT = 2.0**-24  # what rounding to float32 changes at most, in relation to the value


def intervals(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of |c|² − 2 x·c of every row and entry: a float32 product, less and plus its largest rounding error.

    A sum of m rounded products of rounded values is off by (m + 2)u/(1 − (m + 2)u) times Σ|x||c| at most, in whatever order
    it is summed; |x||c| by norms is no less. Three more roundings make |c|² − 2 x·c of it.
    """
    x64, c64 = x.astype(np.float64), entries.astype(np.float64)
    square = (c64 * c64).sum(1)
    screened = square.astype(np.float32) - np.float32(2) * (x64.astype(np.float32) @ c64.astype(np.float32).T)
    off = (x.shape[1] + 8) * _UNIT * 1.01 * (square + 2 * np.sqrt((x64 * x64).sum(1))[:, None] * np.sqrt(square))
    return screened - off, screened + off


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, the lower of equally near ones, and the squared distance; all exact.

    Rows and entries are integers: of 64 bits where distances fit those, Python's own (``object``) else.
    """
    if x.dtype == object or entries.dtype == object or max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) > isqrt(2**62 // max(x.shape[1], 1)) // 2:
        apart = x.astype(object)[:, None, :] - entries.astype(object)[None]
        far = (apart * apart).sum(2)
        index = np.array([min(range(len(entries)), key=row.__getitem__) for row in far], np.int64)
        return index, far[np.arange(len(x)), index]
    low, high = intervals(x, entries)
    near = low <= high.min(1)[:, None]
    index = near.argmax(1)
    row, entry = np.nonzero(near & (near.sum(1) > 1)[:, None])
    if len(row):
        far = ((x[row] - entries[entry]) ** 2).sum(1)
        begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(far, begin)
        first = np.flatnonzero(far == np.repeat(least, np.diff(np.r_[begin, len(row)])))
        own, at = np.unique(row[first], return_index=True)  # entries of a row ascend, so the first is the lowest
        index[own] = entry[first[at]]
    return index, ((x - entries[index]) ** 2).sum(1)


def integers(vectors: pa.Array) -> np.ndarray:
    """floor(256 x) of vectors of one length; Python's integers where a value doesn't fit 62 bits."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = np.floor(SCALE * np.asarray(vectors.flatten(), dtype=np.float64)).reshape(len(vectors), -1)
    if np.abs(flat).max(initial=0) < 2.0**62:
        return flat.astype(np.int64)
    return np.array([[int(v) for v in row] for row in flat.tolist()], dtype=object).reshape(flat.shape)


def kept_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector, size) without vectors that are null or hold nulls or non-finite components.

    ``size`` is the length where a vector can be coded: a positive multiple of 16, all components under 2**82; else null.
    """
    label = column_or_null(embeddings, "label", "string")
    rows = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), label, embeddings["embedding"].cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    codable = (F.size("vector") > 0) & (F.size("vector") % PARTS == 0) & F.forall("vector", lambda x: F.abs(x) * SCALE < LARGEST)
    return rows.where(F.col("vector").isNotNull() & finite).withColumn("size", F.when(codable, F.size("vector")))


def _parts(x: np.ndarray) -> list[np.ndarray]:
    return np.split(x, PARTS, axis=1)


def fit(vectors: DataFrame, size: int, rounds: int = ROUNDS, entries: int = ENTRIES) -> list[np.ndarray]:
    """The codebook of each part of the vectors of one length (``vector``, ``vec_id``).

    They start as the parts of the ``entries`` smallest ids (null ids last, equal ids by their vectors), fewer where there
    are fewer vectors. Each round sums the parts of every entry, in the tasks and then over them; what comes to the
    driver is one number for each component of each entry, whatever the number of vectors.
    """
    spark = vectors.sparkSession
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).toArrow()
    books = _parts(integers(first.column(0)))
    width = size // PARTS
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)

        def summed(batches, sent=sent):
            books = sent.value
            count = np.zeros((PARTS, len(books[0])), np.int64)
            total = np.zeros((PARTS, len(books[0]), width), object)
            for batch in batches:
                for p, own in enumerate(_parts(integers(batch.column(0)))):
                    index, _ = nearest(own, books[p])
                    count[p] += np.bincount(index, minlength=len(books[p]))
                    order = np.argsort(index, kind="stable")
                    begin = np.flatnonzero(np.r_[True, np.diff(index[order]) > 0]) if len(order) else order
                    if len(order):
                        total[p, index[order][begin]] += np.add.reduceat(own[order] if np.abs(own).max() < 2**40 else own[order].astype(object), begin, axis=0)
            p, j, i = np.nonzero(np.broadcast_to(count[:, :, None] > 0, total.shape))
            sums = pa.array([Decimal(int(v)) for v in total[p, j, i]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(j, pa.int32()), pa.array(i, pa.int32()), pa.array(count[p, j], pa.int64()), sums], names=["p", "j", "i", "n", "total"])

        sums = vectors.select("vector").mapInArrow(summed, "p int, j int, i int, n long, total decimal(38,0)")
        found = sums.groupBy("p", "j", "i").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total")).collect()
        books = [b.astype(object) for b in books]
        for r in found:
            books[r["p"]][r["j"], r["i"]] = int(r["total"]) // r["n"]
        books = [b.astype(np.int64) if max(map(abs, b.flat), default=0) < 2**62 else b for b in books]
        sent.unpersist()
    return books


def coded(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code binary, error) of vectors of one length; an ``error`` that doesn't fit a long is null."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            found = [nearest(own, book) for own, book in zip(_parts(integers(batch.column(2))), sent.value, strict=True)]
            code = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
            far = [d for _, d in found]
            if any(d.dtype == object or d.max(initial=0) >= 2**59 for d in far):
                error = pa.array([e if (e := sum(map(int, row))) < 2**63 else None for row in zip(*far, strict=True)], pa.int64())
            else:
                error = pa.array(sum(far))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in code], pa.binary()), error], names=["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "label", "vector").mapInArrow(run, "vec_id long, label string, code binary, error long")


def restored(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, vector): the middle of the cell of each code's entries; a null code gives null."""
    sent = codes.sparkSession.sparkContext.broadcast([(b.astype(np.float64) + 0.5) / SCALE for b in books])

    def run(batches):
        for batch in batches:
            rows = [None if c is None else np.concatenate([b[i] for b, i in zip(sent.value, c, strict=True)]).tolist() for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["vec_id", "vector"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, vector array<double>")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components, by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compressed(embeddings: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that is kept.

    Vectors of each length have codebooks of their own. Vectors that can't be coded (see ``kept_vectors``) have null codes,
    errors and digests. Repeated ids are rows of their own; null ids stay. Codes are two hex digits for each part.
    """
    kept = kept_vectors(embeddings)
    sizes = sorted(r[0] for r in kept.where("size is not null").select("size").distinct().collect())
    out = kept.where("size is null").select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("string").alias("codebooks_sha256"))
    for size in sizes:
        own = kept.where(F.col("size") == size)
        books = fit(own, size, rounds)
        out = out.unionByName(coded(own, books).withColumn("codebooks_sha256", F.lit(digest(books))))
    out = stored(out, "codes")  # read twice: once for the sums of the labels
    sums = out.groupBy(F.coalesce("label", F.lit("")).alias("l"), F.col("label").isNull().alias("none")).agg(F.sum("error").alias("label_error"))
    sums = F.broadcast(sums) if sums.count() <= SENT_LABELS else sums
    named = out.withColumn("l", F.coalesce("label", F.lit(""))).withColumn("none", F.col("label").isNull()).join(sums, ["l", "none"])
    return named.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: codes of every vector, from codebooks of two rounds."""
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _assigned(books: str) -> str:
    """SQL: the entry (least of distance · 64 + index) of each part of each vector."""
    far = "list_sum(list_transform(range(1, len(s.v) + 1), lambda i: (s.v[i] - c.v[i]) * (s.v[i] - c.v[i])))"
    return f"SELECT s.r, s.p, any_value(s.v) AS v, min(({far})::BIGINT * {ENTRIES} + c.j) AS best FROM parts s JOIN {books} c ON s.p = c.p GROUP BY s.r, s.p"


def _moved(assigned: str, books: str) -> str:
    """SQL: entries at the floored means of their parts; unused ones stay."""
    return f"""SELECT c.p, c.j, coalesce(m.v, c.v) AS v FROM {books} c LEFT JOIN (
  SELECT p, j, list(((total - ((total % n) + n) % n) // n) ORDER BY i) AS v FROM (
    SELECT p, best % {ENTRIES} AS j, i, sum(v[i])::BIGINT AS total, count(*) AS n FROM {assigned}, range(1, {64 // PARTS} + 1) t(i) GROUP BY p, best % {ENTRIES}, i
  ) GROUP BY p, j) m ON c.p = m.p AND c.j = m.j"""


#: For vectors of 64 components, as the given tables have.
ORACLE = f"""
WITH kept AS (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT r, p, list_transform(embedding[p * 4 + 1:p * 4 + 4], lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM kept, range({PARTS}) t(p)
), books_0 AS MATERIALIZED (
  SELECT p, r - 1 AS j, v FROM parts WHERE r <= {ENTRIES}
), near_0 AS MATERIALIZED ({_assigned("books_0")}),
books_1 AS MATERIALIZED ({_moved("near_0", "books_0")}),
near_1 AS MATERIALIZED ({_assigned("books_1")}),
books_2 AS MATERIALIZED ({_moved("near_1", "books_1")}),
near_2 AS MATERIALIZED ({_assigned("books_2")}),
codes AS (
  SELECT r, string_agg(format('{{:02x}}', best % {ENTRIES}), '' ORDER BY p) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM near_2 GROUP BY r
)
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, j)) FROM books_2) AS codebooks_sha256
FROM kept k JOIN codes c ON k.r = c.r
"""
