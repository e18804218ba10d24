"""Best-fit packing into bins of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.llm import byte_ids
from shelfrank.llm.common import bounded_batches, stored

#: Permitted sequence lengths in tokens.
LENGTHS = (512, 1024, 2048, 4096)
#: What a sequence costs besides its tokens (in tokens), and the length at which attention doubles a token's cost.
OVERHEAD, ATTENTION = 64.0, 16_384.0
#: Pieces that are packed together; their bins share nothing with other blocks.
BLOCK = 8192


def cost(length: int) -> float:
    """What a bin of this length costs: its tokens, attention over them, and a fixed part."""
    return OVERHEAD + length * (1 + length / ATTENTION)


def _taken(sizes: list[int], left: dict[int, int], room: int) -> int:
    """How much of ``room`` the pieces that are left fill if the largest that fits goes in each time."""
    filled, at = 0, bisect_right(sizes, room) - 1
    while at >= 0:
        size = sizes[at]
        filled += size * min(left[size], (room - filled) // size)
        at = min(at, bisect_right(sizes, room - filled)) - 1
    return filled


def _packed(sizes: np.ndarray, lengths: tuple[int, ...], least: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``pack`` where a new bin has the cheapest length for what is left, or the least one from ``least`` on that holds the piece."""
    bins, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    filled: list[int] = []
    room: list[tuple[int, int]] = []  # free tokens and bin, in order
    distinct, times = np.unique(sizes, return_counts=True)
    kinds, left = distinct.tolist(), dict(zip(distinct.tolist(), times.tolist(), strict=True))

    def per_token(length: int, need: int) -> tuple[float, int]:
        used = need + _taken(kinds, left, length - need)
        return cost(next(c for c in lengths if c >= used)) / used, length

    for i in np.lexsort((np.arange(len(sizes)), -sizes)):
        need = int(sizes[i])
        left[need] -= 1
        if not left[need]:
            del left[need]
            kinds.pop()  # pieces come in decreasing order
        at = bisect_left(room, (need, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            b = len(filled)
            fitting = [c for c in lengths if c >= max(need, least or 0)]
            free = fitting[0] if least else min(per_token(c, need) for c in fitting)[1]
            filled.append(0)
        bins[i], offset[i] = b, filled[b]
        filled[b] += need
        if free > need:
            insort(room, (free - need, b))
    return bins, offset, np.array([next(c for c in lengths if c >= f) for f in filled], np.int64)


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece and the length of each bin.

    Pieces go in decreasing order into the open bin that they fill best (the first of equal ones). A piece that fits none
    opens a bin, of the length that costs least for each token that it and the pieces still left would fill in it. Finally
    every bin shrinks to the least permitted length that holds its contents. The lengths are chosen jointly: the same is
    done with each single length for new bins, and the packing of least total cost counts. Equal pieces keep their order.
    No piece may be longer than the greatest length.
    """
    lengths = tuple(sorted(lengths))
    plans = [_packed(sizes, lengths, least) for least in (None, *lengths)]
    return min(plans, key=lambda p: sum(map(cost, p[2].tolist())))


def pieces(docs: DataFrame, longest: int, source: tuple[bytes, str] | None = None) -> DataFrame:
    """``doc_id``, ``row``, ``piece`` and ``n_tokens``: every text and its closing token, cut where it is longer than a bin."""
    sent = docs.sparkSession.sparkContext.broadcast(source or byte_ids.ranks_file())

    def run(batches):
        own = None
        for batch in batches:
            own = own or byte_ids.encoding(sent.value)
            n = np.array([len(own.encode_ordinary(t)) + 1 if t else 1 for t in batch.column(2).to_pylist()], np.int64)
            times = -(-n // longest)
            at = np.repeat(np.arange(len(n)), times)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            size = np.minimum(n[at] - piece * longest, longest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(piece, pa.int64()), pa.array(size, pa.int64())],
                names=["doc_id", "row", "piece", "n_tokens"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, row long, piece long, n_tokens long")


def pack_documents(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, block: int = BLOCK, source: tuple[bytes, str] | None = None) -> DataFrame:
    """Where each piece of every document lies: doc_id, piece, n_tokens, bin_id, bin_length, bin_offset.

    Pieces are dealt by a hash into blocks of about ``block``, so a task's work is bounded and no text is shuffled; each
    block is packed by itself, which leaves at most a few bins in a block less than full. Null and empty texts are the
    closing token alone; repeated rows and null ids are pieces like others; an empty table gives no rows.
    """
    items = stored(pieces(docs, max(lengths), source), "pieces")
    blocks = max(1, -(-items.count() // block))

    def run(key, group):
        group = group.sort_values(["doc_id", "row", "piece"], na_position="first").reset_index(drop=True)
        bins, offset, final = pack(group["n_tokens"].to_numpy(), lengths)
        return pd.DataFrame({
            "doc_id": group["doc_id"].astype("Int64"), "piece": group["piece"], "n_tokens": group["n_tokens"],
            "bin_id": (np.int64(key[0]) << 32) + bins, "bin_length": final[bins] if len(final) else bins, "bin_offset": offset,
        })

    dealt = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(run, "doc_id long, piece long, n_tokens long, bin_id long, bin_length long, bin_offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents packed."""
    bounded_batches(spark)
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
