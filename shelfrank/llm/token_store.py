"""Token-ID output in training order: a keyed permutation gives each sequence its slot, slots lie in fixed-stride shards."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfrank.llm import byte_ids
from shelfrank.llm.common import bounded_batches, shared_dir, stored

STRIDE = 512
PER_SHARD = 1024
KEY = 20240229
ROUNDS = 6
#: A row for each shard.
SCHEMA = "shard long, first_slot long, n_sequences int, stride int, payload binary, doc_ids array<long>, pieces array<int>, n_tokens array<int>"
#: Tables of first ordinals with fewer documents than this are broadcast (33 MB at 66 bytes a row); larger ones are joined by shuffling.
BROADCAST_DOCS = 500_000


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def permute(ordinal: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """The slot of each ordinal of 0..n-1 (or the ordinal of each slot): a bijection for every key.

    A balanced Feistel network permutes the least even number of bits that holds n values; a value that falls outside
    0..n-1 goes through it again until it is inside (cycle-walking), under four times on average.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [int(k) for k in np.random.default_rng(key).integers(0, 2**63, ROUNDS)]
    x = np.asarray(ordinal).astype(np.uint64)
    todo = np.arange(len(x))
    while todo.size:
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left, k) & mask), left
            else:
                left, right = right, left ^ (_mix(right, k) & mask)
        x[todo] = (left << np.uint64(half)) | right
        todo = todo[x[todo] >= np.uint64(n)]
    return x.astype(np.int64)


def sequences(docs: DataFrame, stride: int = STRIDE, source: tuple[bytes, str] | None = None) -> DataFrame:
    """``doc_id``, ``row`` (the row's place in the table), ``piece``, ``n_tokens`` and ``ids`` (16-bit, little-endian).

    A text and its closing token are cut into pieces of ``stride`` tokens, the last one shorter. Null and empty texts
    give one piece with the closing token. Repeated rows give sequences of their own.
    """
    sent = docs.sparkSession.sparkContext.broadcast(source or byte_ids.ranks_file())

    def run(batches):
        own = None
        for batch in batches:
            own = own or byte_ids.encoding(sent.value)
            doc, row, piece, size, ids = [], [], [], [], []
            for d, r, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                all_ids = byte_ids.encode(own, t)
                for p, at in enumerate(range(0, len(all_ids), stride)):
                    part = all_ids[at : at + stride]
                    doc.append(d), row.append(r), piece.append(p), size.append(len(part)), ids.append(part.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(piece, pa.int32()), pa.array(size, pa.int32()), pa.array(ids, pa.binary())],
                names=["doc_id", "row", "piece", "n_tokens", "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, row long, piece int, n_tokens int, ids binary")


def first_ordinals(seqs: DataFrame) -> tuple[DataFrame, int]:
    """The ordinal of each document's first sequence, in the order of (doc_id, row), and the number of sequences.

    Documents are dealt by range; each range sorts and sums its own, by a window that can spill, and only the ranges'
    totals come to the driver.
    """
    spark = seqs.sparkSession
    sizes = seqs.groupBy("doc_id", "row").agg(F.count("*").alias("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(sizes.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "row").withColumn("part", F.spark_partition_id()), "ordinals")
    totals = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    before, offsets = 0, []
    for p in sorted(totals):
        offsets.append((p, before))
        before += totals[p]
    starts = spark.createDataFrame(offsets or [(0, 0)], "part int, base long")
    # a range holds about its share of the documents, whatever the ids are: rows of one id are told apart by their place
    earlier = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "row").rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return within.join(F.broadcast(starts), "part").select("doc_id", "row", (F.col("base") + F.col("earlier")).alias("first")), before


def materialise(
    docs: DataFrame, stride: int = STRIDE, per_shard: int = PER_SHARD, key: int = KEY,
    source: tuple[bytes, str] | None = None, broadcast_docs: int = BROADCAST_DOCS,
) -> DataFrame:
    """A row for each shard: ``shard``, ``first_slot``, ``n_sequences``, ``stride``, ``payload``, ``doc_ids``, ``pieces``, ``n_tokens``.

    Sequence i of n (in the order of documents) has slot ``permute(i, n, key)``; shard s holds the slots from
    s * per_shard on, in order. Each record of ``payload`` is ``stride`` 16-bit ids, padded with the closing token, so
    slot t lies at byte 2 * stride * (t - first_slot). An empty table has no shards. Columns besides doc_id and text are
    left behind.
    """
    seqs = stored(sequences(docs, stride, source), "sequences", "zstd")
    firsts, total = first_ordinals(seqs)
    # the row's place tells documents apart, null ids included
    firsts = stored(firsts.select("row", "first"), "firsts")
    side = F.broadcast(firsts) if firsts.count() <= broadcast_docs else firsts

    @F.pandas_udf("long")
    def slot_of(ordinal: pd.Series) -> pd.Series:
        return pd.Series(permute(ordinal.to_numpy(), total, key))

    placed = seqs.join(side, "row").withColumn("slot", slot_of(F.col("first") + F.col("piece")))
    shards = placed.withColumn("shard", F.expr(f"slot div {per_shard}")).select("shard", "slot", "doc_id", "piece", "n_tokens", "ids")
    # the permutation fills all slots, so equal ranges of shards hold equally many sequences and need no sample
    count = max(1, -(-total // per_shard))
    parts = max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), count))
    ordered = shards.repartitionById(parts, F.expr(f"cast(shard * {parts} div {count} as int)")).sortWithinPartitions("slot")
    pad = np.uint16(byte_ids.END).astype("<u2").tobytes()

    def run(batches):
        held: list[tuple] = []

        def flush():
            payload = b"".join(i + pad * (stride - n) for _, _, _, _, n, i in held)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([held[0][0]], pa.int64()), pa.array([held[0][1]], pa.int64()), pa.array([len(held)], pa.int32()), pa.array([stride], pa.int32()),
                    pa.array([payload], pa.binary()), pa.array([[h[2] for h in held]], pa.list_(pa.int64())),
                    pa.array([[h[3] for h in held]], pa.list_(pa.int32())), pa.array([[h[4] for h in held]], pa.list_(pa.int32())),
                ],
                names=["shard", "first_slot", "n_sequences", "stride", "payload", "doc_ids", "pieces", "n_tokens"],
            )

        for batch in batches:
            for record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != record[0]:
                    yield flush()
                    held = []
                held.append(record)
        if held:
            yield flush()

    return ordered.mapInArrow(run, SCHEMA)


def write(shards: DataFrame, path: str) -> None:
    """Writes the shards of ``materialise``: each task writes its range of shards, in slot order.

    The statistics of ``shard`` let a reader skip what it has seen; every record has the same stride in its shard.
    """
    shards.write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The shards that ``write`` wrote."""
    return spark.read.schema(SCHEMA).parquet(path)


def resume(spark: SparkSession, path: str, slot: int = 0, per_shard: int = PER_SHARD) -> DataFrame:
    """Sequences from ``slot`` on, in training order: slot, doc_id, piece, n_tokens, ids (the padded record)."""
    shards = read(spark, path).where(F.col("shard") >= slot // per_shard)
    at = F.posexplode(F.arrays_zip("doc_ids", "pieces", F.col("n_tokens").alias("tokens"))).alias("i", "s")
    rows = shards.select("first_slot", "stride", "payload", at)
    record = F.substring(F.col("payload"), F.col("i") * F.col("stride") * 2 + 1, F.col("stride") * 2)
    rows = rows.select((F.col("first_slot") + F.col("i")).alias("slot"), "s.doc_ids", "s.pieces", "s.tokens", record.alias("ids"))
    return rows.toDF("slot", "doc_id", "piece", "n_tokens", "ids").where(F.col("slot") >= slot).orderBy("slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the shards of all documents, written in training order and read back, with the digest of each payload."""
    bounded_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/tables/shards-{uuid.uuid4().hex}"
    write(materialise(spark.read.parquet(f"{sf_dir}/documents.parquet")), path)
    return read(spark, path).withColumn("payload_sha256", F.sha2("payload", 256))
