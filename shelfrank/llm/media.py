"""Media columns: texts as 8-bit FLAC streams, read back, checked and cut into seekable PCM blocks."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from shelfrank.llm import flac
from shelfrank.llm.common import bounded_batches

#: Frames that one call of the codec works on side by side; it bounds a task's memory.
FRAMES = 4096


def _groups(sizes: list[int], most: int) -> Iterator[slice]:
    """Consecutive rows that hold ``most`` frames together, or one larger row."""
    first = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(first, i)
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield slice(first, len(sizes))


def padded(text: str | None) -> bytes:
    """UTF-8 of the text (nothing for null), with bytes 255 up to a positive multiple of 576."""
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % flac.BLOCK if raw else flac.BLOCK)


def feature(payload: bytes) -> str:
    """Loudness, level, peak and zero-crossing rate of the samples that were read back."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"rms={np.sqrt((x * x).mean()):.4f};mean={x.mean():.4f};peak={int(np.abs(x).max())};zcr={crossings / x.size:.6f}"


def to_flac(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_bytes`` and ``media`` (a FLAC stream) of every row; a null or empty text is one frame of padding.

    Rows are kept as they are, repeated ones included; other columns are left behind. Nothing is shuffled.
    """

    def run(batches):
        for batch in batches:
            payloads = [padded(t) for t in batch.column(1).to_pylist()]
            sizes = [len((t or "").encode()) for t in batch.column(1).to_pylist()]
            for g in _groups([len(p) // flac.BLOCK for p in payloads], FRAMES):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[g.start : g.stop], pa.array(sizes[g], pa.int64()), pa.array(flac.encode(payloads[g]), pa.binary())],
                    names=[key, "n_bytes", "media"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, docs[text].cast("string").alias(text)).mapInArrow(run, f"{key} {kind}, n_bytes long, media binary")


def describe(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests and features of stored streams, from the samples that decoding gives back.

    All frames are decoded and their checksums verified; ``tail_crc32`` comes from the last PCM block alone, which the
    stream's seek table finds. ``n_blocks`` counts the blocks.
    """

    def run(batches):
        for batch in batches:
            streams = batch.column(2).to_pylist()
            for g in _groups([max(1, len(s) // 400) for s in streams], FRAMES):
                own = streams[g]
                back = flac.decode(own)
                tails = flac.blocks_at(own, [len(p) - 1 for p in back])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[g.start : g.stop],
                        batch.column(1)[g.start : g.stop],
                        pa.array([len(p) for p in back], pa.int64()),
                        pa.array([hashlib.sha256(p).hexdigest() for p in back]),
                        pa.array([zlib.crc32(t[-32:]) for _, t in tails], pa.int64()),
                        pa.array([len(s) for s in own], pa.int64()),
                        pa.array([hashlib.sha256(s).hexdigest() for s in own]),
                        pa.array([feature(p) for p in back]),
                        pa.array([len(p) // flac.BLOCK for p in back], pa.int64()),
                    ],
                    names=[key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_blocks"],
                )

    kind = media.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long"
    return media.select(key, "n_bytes", "media").mapInArrow(run, schema)


def pcm_blocks(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each frame: its first sample, its place in the stream and its signed 8-bit samples.

    ``sample_offset`` and ``byte_offset`` let a reader seek: any block can be decoded by itself.
    """

    def run(batches):
        for batch in batches:
            for owner, stream in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, _, offsets = flac.layout(stream)
                payload = flac.decode([stream])[0]
                pcm = (np.frombuffer(payload, np.uint8) ^ 128).tobytes()
                n = len(offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([owner] * n, batch.column(0).type),
                        pa.array(range(n), pa.int64()),
                        pa.array([i * flac.BLOCK for i in range(n)], pa.int64()),
                        pa.array([at + int(o) for o in offsets], pa.int64()),
                        pa.array([pcm[i * flac.BLOCK : (i + 1) * flac.BLOCK] for i in range(n)], pa.binary()),
                    ],
                    names=[key, "block_no", "sample_offset", "byte_offset", "pcm"],
                )

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, "media").mapInArrow(run, f"{key} {kind}, block_no long, sample_offset long, byte_offset long, pcm binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document stored as FLAC, read back and described."""
    bounded_batches(spark)
    return describe(to_flac(spark.read.parquet(f"{sf_dir}/documents.parquet")))
