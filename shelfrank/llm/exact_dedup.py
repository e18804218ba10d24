"""Suffix-array dedup: bytes covered by a long string that also starts earlier in the corpus.

Equal strings of 100 bytes must meet in one shard. Each such window is dealt by its minimizer (the least hash among its
32-byte strings), so equal windows have equal keys wherever they stand, and consecutive windows with one minimizer travel
as one segment. Three passes over the texts keep what is shuffled small: the first counts keys; the second, for keys
that occur again, settles segments that repeat whole by their hash; the third takes only the texts of keys under which
segments differ into shards, where suffix arrays and permuted common prefixes find the windows they share. Sets of keys
are carried as Bloom filters of bounded size: a key let through by mistake costs work but changes no result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.llm import suffixes
from shelfrank.llm.common import bounded_batches, fresh, numbered_texts, stored, with_row

WINDOW = 100
#: Bytes of the strings of which the least hash in a window keys it; fewer for windows shorter than this.
GRAM = 32
SLICE_BYTES = 1_000_000
SHARD_BYTES = 750_000
#: A key with more different segments than this is dealt further, by where the minimizer lies in the window (in groups of
#: so many offsets) and by the bytes that all windows of such a group hold.
HOT_SEGMENTS = 1000
OFFSETS = 8
#: Bits of a Bloom filter for each key, and its most bits in all (32 MB).
BITS_PER_KEY, MOST_BITS = 16, 1 << 28
PAGE = 1 << 15
#: Keys with more segments than these rows, and than this share of all segments, are busy: at most so many as the share's
#: inverse. Their segments are dealt by content, and contents with as many rows are settled without a shuffle.
BUSY_ROWS, BUSY_SHARE = 1000, 1 / 2000
_BYTE = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
ROW = "doc_id long, row long"


def keyed_segments(raws: list[bytes], window: int = WINDOW):
    """(text, start, windows, offset of the minimizer, key) of the runs of windows with one minimizer, as arrays, and the joined texts."""
    size = np.array([len(r) for r in raws], np.int64)
    data = b"".join(raws)
    total = len(data)
    if total < window:
        return (*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, np.uint64)), data, np.cumsum(size) - size
    h = _BYTE[np.frombuffer(data, np.uint8)]
    gram = min(GRAM, 1 << (window.bit_length() - 1))
    span = 1
    while span < gram:
        h = h[:-span] * np.uint64(pow(_BASE, span, 1 << 64)) + h[span:]
        span *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, span = window - gram + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    end = np.cumsum(size)
    begin = end - size
    edge = np.zeros(total + 1, np.int64)  # windows that would cross the end of a text
    np.add.at(edge, np.maximum(end - window + 1, begin), 1)
    np.add.at(edge, end, -1)
    valid = np.cumsum(edge)[: len(place)] == 0
    fresh = np.ones(len(place), bool)
    fresh[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
    change = np.flatnonzero(fresh | ~valid)
    stop = np.append(change[1:], len(place))
    use = valid[change]
    first, count = change[use], (stop - change)[use]
    text = np.searchsorted(end, first, "right")
    return (text, first - begin[text], count, place[first] - first, h[place[first]]), data, begin


class KeySet:
    """A Bloom filter with two probes."""

    def __init__(self, bits: np.ndarray, n: int):
        self.bits, self.n = bits, n

    @staticmethod
    def probes(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        k = keys.astype(np.uint64)
        again = (k * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(20)
        return (k % np.uint64(n)).astype(np.int64), (again % np.uint64(n)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for p in self.probes(keys, self.n):
            out &= (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return out


def key_set(keys: DataFrame) -> KeySet | None:
    """The filter of a column ``key``: pages of it are built by Spark; the driver only joins them. None without keys."""
    count = keys.count()
    if not count:
        return None
    n = max(PAGE, min(MOST_BITS, 1 << (BITS_PER_KEY * count - 1).bit_length()))

    def probed(batches):
        for batch in batches:
            both = np.concatenate(KeySet.probes(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), n))
            yield pa.RecordBatch.from_arrays([pa.array(both // PAGE), pa.array((both % PAGE).astype(np.int32))], names=["page", "bit"])

    def page(key, group):
        bits = np.zeros(PAGE, np.uint8)
        bits[group["bit"].to_numpy()] = 1
        return pd.DataFrame({"page": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    rows = keys.select("key").mapInArrow(probed, "page long, bit int").groupBy("page").applyInPandas(page, "page long, bits binary").collect()
    bits = np.zeros(n // 8, np.uint8)
    for r in rows:
        bits[r["page"] * PAGE // 8 : (r["page"] + 1) * PAGE // 8] = np.frombuffer(r["bits"], np.uint8)
    return KeySet(bits, n)


def _slices(raws: list[bytes]):
    first = total = 0
    for i, r in enumerate(raws):
        if total and total + len(r) > SLICE_BYTES:
            yield slice(first, i)
            first, total = i, 0
        total += len(r)
    if first < len(raws):
        yield slice(first, len(raws))


def _raws(batch) -> list[bytes]:
    return [(t or "").encode() for t in batch.column(2).to_pylist()]


def _order(doc: np.ndarray, known: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Ranks by (doc_id, row), null ids first; equal rows share a rank."""
    at = np.lexsort((row, doc, known))
    new = np.concatenate([[0], np.cumsum((row[at][1:] != row[at][:-1]) | (doc[at][1:] != doc[at][:-1]) | (known[at][1:] != known[at][:-1]))])
    out = np.empty(len(at), np.int64)
    out[at] = new
    return out


def _covered(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals (text, start, end), those that overlap or touch joined."""
    if not len(text):
        return text, start, end
    at = np.lexsort((end, start, text))
    text, start, end = text[at], start[at], end[at]
    shift = text * np.int64(1 << 40)  # so that one running maximum serves all texts
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], (start + shift)[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return text[first], start[first], (reach - shift)[np.append(first[1:], len(text)) - 1]


def _places(batch):
    """(doc_id, row) of a batch: ids as Arrow and, with their validity, as numbers."""
    ids = batch.column(0)
    return ids, batch.column(1).to_numpy(), ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)


def _digests(view: memoryview, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """128-bit hashes of spans, as two longs each."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[a : a + s]) for a, s in zip(at.tolist(), size.tolist(), strict=True)]), np.int64).reshape(-1, 2)


def _window_digests(text: bytes, window: int) -> list[tuple[int, int]]:
    view, count = memoryview(text), len(text) - window + 1
    return list(map(tuple, _digests(view, np.arange(count), np.full(count, window)).tolist()))


def _first_of_each(h: np.ndarray, rank: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments that come first among those with their hash, and the others."""
    order = np.lexsort((start, rank, h[:, 1], h[:, 0]))
    same = np.concatenate([np.zeros(min(1, len(h)), bool), (h[order][1:] == h[order][:-1]).all(1)])
    return order[~same], order[same]


def _count_keys(rows: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            raws = _raws(batch)
            for g in _slices(raws):
                (_, _, _, _, key), _, _ = keyed_segments(raws[g], window)
                unique, times = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(times.astype(np.int32))], names=["key", "n"])

    return rows.mapInArrow(run, "key long, n int").groupBy("key").agg(F.sum("n").alias("n"))


def _whole(rows: DataFrame, again: KeySet, window: int) -> DataFrame:
    """Segments under keys that occur again, one for each content in a slice; ``key`` is null for intervals settled there."""
    sent = rows.sparkSession.sparkContext.broadcast(again)
    names = ["key", "h1", "h2", "doc_id", "row", "start", "n"]

    def run(batches):
        for batch in batches:
            raws = _raws(batch)
            ids, row, doc, known = _places(batch)
            for g in _slices(raws):
                (text, start, n, _, key), data, begin = keyed_segments(raws[g], window)
                on = sent.value.has(key)
                text, start, n, key = text[on], start[on], n[on], key[on]
                if not len(text):
                    continue
                view = memoryview(data)
                h = _digests(view, begin[text] + start, n + window - 1)
                first, later = _first_of_each(h, _order(doc[g], known[g], row[g])[text], start)
                covered = _covered(text[later], start[later], start[later] + n[later] + window - 1)
                t = np.concatenate([text[first], covered[0]])
                pick = pa.array(t + g.start)
                settled = np.concatenate([np.zeros(len(first), bool), np.ones(len(covered[0]), bool)])
                zero = np.zeros(len(covered[0]), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([key[first].view(np.int64), zero]), mask=settled), pa.array(np.concatenate([h[first, 0], zero])),
                        pa.array(np.concatenate([h[first, 1], zero])), ids.take(pick), batch.column(1).take(pick),
                        pa.array(np.concatenate([start[first], covered[1]])), pa.array(np.concatenate([n[first], covered[2] - covered[1] - window + 1])),
                    ],
                    names=names,
                )

    return rows.mapInArrow(run, "key long, h1 long, h2 long, doc_id long, row long, start long, n long")


def _busy(keys: DataFrame) -> list[int]:
    """Keys of ``keys`` (key, n) that many rows have; ``BUSY_SHARE`` bounds their number."""
    total = keys.agg(F.sum("n")).first()[0] or 0
    return [r["key"] for r in keys.where(F.col("n") > max(BUSY_ROWS, int(total * BUSY_SHARE))).select("key").collect()]


def _settled(whole: DataFrame, window: int, busy: list[int]) -> DataFrame:
    """Intervals settled by whole segments, as (null, doc_id, row, start, end); and (key, ..., kinds) of keys with different segments.

    Each key's segments come in order of content and place, so a task only remembers the first of the last content.
    Segments of ``busy`` keys are dealt by content instead; those of a content with very many rows stay where they are and
    are held against its first place, which is sent to them.
    """
    segments = whole.where("key is not null")
    usual = segments.where(~F.col("key").isin(busy)) if busy else segments
    sorted_ = usual.repartition("key").sortWithinPartitions("key", "h1", "h2", "doc_id", "row", "start")

    def run(batches):
        last_key, last_h, kinds = None, None, 0
        for batch in batches:
            key, h1, h2, n = (batch.column(i).to_numpy() for i in (0, 1, 2, 6))
            if not len(key):
                continue
            h = np.stack([key, h1, h2], 1)
            again = np.concatenate([[last_h is not None and bool((h[0] == last_h).all())], (h[1:] == h[:-1]).all(1)])
            new_key = np.concatenate([[last_key is None or key[0] != last_key], key[1:] != key[:-1]])
            before = np.cumsum(~again)
            edge = np.flatnonzero(new_key)
            # kinds of the keys that end within the batch, the one carried over included
            upto = np.concatenate([before[edge] - (~again[edge]).astype(int), [before[-1]]])
            counts = np.diff(np.concatenate([[0], upto]))
            counts[0] += kinds
            ended = np.concatenate([[last_key if last_key is not None else 0], key[edge]])[:-1] if len(edge) else np.zeros(0, np.int64)
            done = counts[:-1]
            many = np.flatnonzero(done > 1)
            take = pa.array(np.flatnonzero(again))
            start = batch.column(5).take(take).to_numpy()
            nulls = pa.nulls(len(many), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.nulls(len(take), pa.int64()), pa.array(ended[many], pa.int64())]),
                    pa.concat_arrays([batch.column(3).take(take), nulls]), pa.concat_arrays([batch.column(4).take(take), nulls]),
                    pa.concat_arrays([pa.array(start, pa.int64()), nulls]),
                    pa.concat_arrays([pa.array(start + n[again] + window - 1, pa.int64()), pa.array(done[many], pa.int64())]),
                ],
                names=["key", "doc_id", "row", "start", "end"],
            )
            last_key, last_h, kinds = key[-1], h[-1], int(counts[-1])
        if last_key is not None and kinds > 1:
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([last_key], pa.int64()), none, none, none, pa.array([kinds], pa.int64())], names=["key", "doc_id", "row", "start", "end"])

    schema = f"key long, {ROW}, start long, end long"
    end = (F.col("start") + F.col("n") + (window - 1)).alias("end")
    before = whole.where("key is null").select("key", "doc_id", "row", "start", end)
    out = before.unionByName(sorted_.mapInArrow(run, schema))
    if not busy:
        return out
    hot = segments.where(F.col("key").isin(busy))
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row", "start")
    contents = stored(hot.groupBy("key", "h1", "h2").agg(F.count("*").alias("m"), F.min(place).alias("first")), "contents")
    total = contents.agg(F.sum("m")).first()[0] or 0
    many = F.broadcast(contents.where(F.col("m") > max(BUSY_ROWS, int(total * BUSY_SHARE))).drop("m"))  # fewer than 1 / BUSY_SHARE rows
    content = ["key", "h1", "h2"]
    later = hot.join(many, content).where(place != F.col("first")).select(F.lit(None).cast("long").alias("key"), "doc_id", "row", "start", end)
    rest = hot.join(many, content, "left_anti").repartition(*content).sortWithinPartitions(*content, "doc_id", "row", "start")
    none = F.lit(None).cast("long")
    kinds = contents.groupBy("key").agg(F.count("*").alias("end")).where("end > 1")
    kinds = kinds.select("key", none.alias("doc_id"), none.alias("row"), none.alias("start"), "end")
    return out.unionByName(later).unionByName(rest.select(whole.columns).mapInArrow(run, schema).where("key is null")).unionByName(kinds)


def _texts(rows: DataFrame, differ: KeySet, hot: KeySet | None, window: int) -> DataFrame:
    """Texts of the segments under keys with different segments; those of hot keys are dealt further by offset and shared bytes."""
    core = max(window - OFFSETS + 1, 0)
    sent = rows.sparkSession.sparkContext.broadcast((differ, hot))

    def run(batches):
        for batch in batches:
            raws = _raws(batch)
            ids, row, doc, known = _places(batch)
            for g in _slices(raws):
                (text, start, n, offset, key), data, begin = keyed_segments(raws[g], window)
                many, few = sent.value[0], sent.value[1]
                on = many.has(key)
                text, start, n, offset, key = text[on], start[on], n[on], offset[on], key[on]
                split = few.has(key) if few is not None else np.zeros(len(key), bool)
                # offsets fall by one from window to window; a group holds the offsets of one eighth
                low = np.where(split, (offset - n + 1) // OFFSETS, 0)
                times = np.where(split, offset // OFFSETS - low + 1, 1)
                at = np.repeat(np.arange(len(key)), times)
                group = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + low[at]
                cut = split[at]
                from_ = np.where(cut, np.maximum(offset[at] - (group + 1) * OFFSETS + 1, 0), 0)
                to = np.where(cut, np.minimum(offset[at] - group * OFFSETS, n[at] - 1), n[at] - 1)
                view = memoryview(data)
                # every window of a group holds the ``core`` bytes from the group's least offset on before the minimizer
                holds = np.zeros(len(at), np.uint64)
                c = at[cut]
                holds[cut] = _digests(view, begin[text[c]] + start[c] + offset[c] - group[cut] * OFFSETS, np.full(len(c), core))[:, 0].view(np.uint64)
                key = np.where(cut, (key[at] ^ (group + 1).astype(np.uint64)) * np.uint64(_BASE) ^ holds, key[at])
                start, n, text = start[at] + from_, to - from_ + 1, text[at]
                a = begin[text] + start
                # parts of one content in the slice: the first goes on, the others are settled (key and end, no text)
                first, later = _first_of_each(_digests(view, a, n + window - 1), _order(doc[g], known[g], row[g])[text], start)
                covered = _covered(text[later], start[later], start[later] + n[later] + window - 1)
                own = [bytes(view[x : x + s]) for x, s in zip(a[first].tolist(), (n[first] + window - 1).tolist(), strict=True)]
                at = np.concatenate([text[first], covered[0]])
                pick = pa.array(at + g.start)
                spread = _mixed(row[g][covered[0]] + covered[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([key[first].view(np.int64), spread])), pa.array(own + [None] * len(covered[0]), pa.binary()), ids.take(pick),
                        batch.column(1).take(pick), pa.array(np.concatenate([start[first], covered[1]])),
                        pa.array(np.concatenate([start[first] + n[first] + window - 1, covered[2]])),
                    ],
                    names=["key", "text", "doc_id", "row", "start", "end"],
                )

    return rows.mapInArrow(run, f"key long, text binary, {ROW}, start long, end long")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Keys that deal settled intervals evenly."""
    return (x.astype(np.uint64) * np.uint64(_BASE)).view(np.int64)


def _shard(texts: list[bytes], doc: np.ndarray, known: np.ndarray, row: np.ndarray, start: np.ndarray, window: int):
    """(segment, start, end) of what earlier segments of the shard also hold."""
    size = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"\xff".join(texts), np.uint8)  # 255 is in no UTF-8 text
    begin = np.cumsum(size + 1) - size - 1
    sa = suffixes.suffix_array(data)
    common = suffixes.permuted_prefixes(data, sa, window)[sa]
    group = np.cumsum(common < window)
    count = size - window + 1
    segment = np.repeat(np.arange(len(texts)), count)
    inside = np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count)
    of = np.empty(len(data), np.int64)
    of[sa] = group
    kind = of[begin[segment] + inside]
    rank = _order(doc, known, row)[segment]
    place = start[segment] + inside
    order = np.lexsort((place, rank, kind))
    later = order[np.concatenate([[False], kind[order][1:] == kind[order][:-1]])]
    return _covered(segment[later], place[later], place[later] + window)


def _shared_windows(texts: DataFrame, window: int) -> DataFrame:
    """Intervals of windows that stand earlier in another segment of their key.

    A key whose segments exceed a shard by themselves isn't held: its windows are settled one by one, by their hashes.
    """
    dealt = texts.repartition("key").sortWithinPartitions("key", "text", "doc_id", "row", "start")
    limit = SHARD_BYTES

    def run(batches):
        held: list[tuple] = []
        passed: list[tuple] = []
        loose: list[tuple] = []
        size = own = mark = 0  # bytes held, those of the last key, and where it begins
        last, over = (None, None), False

        def rows(found: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["doc_id", "row", "start", "end", "h1", "h2"])

        def flush():
            if held:
                _, text, doc, row, start, _ = zip(*held, strict=True)
                known = np.array([d is not None for d in doc])
                places = [np.array([d or 0 for d in doc], np.int64), known, np.array(row, np.int64), np.array(start, np.int64)]
                segment, a, b = _shard(list(text), *places, window)
                yield rows([(doc[i], row[i], x, y, None, None) for i, x, y in zip(segment.tolist(), a.tolist(), b.tolist(), strict=True)] or [(None,) * 6])

        for batch in batches:
            for record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(passed) + len(loose) > 50_000:
                    yield rows(passed + loose)
                    passed, loose = [], []
                if record[1] is None or record[:2] == last:
                    passed.append((*record[2:], None, None))  # settled before, or the same content as the one before, which comes first
                    continue
                if record[0] != last[0]:
                    if size > limit:
                        yield from flush()
                        held, size = [], 0
                    own, mark, over = 0, len(held), False
                last = record[:2]
                held.append(record)
                size += len(record[1])
                own += len(record[1])
                over = over or own > limit
                if over:
                    for _, text, doc, row, start, _ in held[mark:]:
                        loose += [(doc, row, start + i, start + i + window, *h) for i, h in enumerate(_window_digests(text, window))]
                        size -= len(text)
                    del held[mark:]
        yield from flush()
        if passed or loose:
            yield rows(passed + loose)

    found = stored(dealt.mapInArrow(run, f"{ROW}, start long, end long, h1 long, h2 long").where("row is not null"), "shared")
    loose = found.where("h1 is not null").select(F.col("h1").alias("key"), "h1", "h2", "doc_id", "row", "start", F.lit(1).cast("long").alias("n"))
    busy = _busy(loose.groupBy("key").agg(F.sum("n").alias("n")))
    one_by_one = _settled(loose, window, busy).where("key is null")
    return found.where("h1 is null").select("doc_id", "row", "start", "end").unionByName(one_by_one.select("doc_id", "row", "start", "end"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, hot: int = HOT_SEGMENTS) -> DataFrame:
    """``doc_id``, ``row``, ``starts`` and ``ends``: the bytes of each row that a ``window``-byte string covers which starts earlier too.

    Rows are ordered by doc_id (nulls first), then by place in the table; the spans of a row may overlap.
    """
    return _spans(numbered_texts(*with_row(docs.select("doc_id", "text"))), window, hot)


def _spans(rows: DataFrame, window: int, hot: int) -> DataFrame:
    """``repeated_spans`` of numbered texts."""
    keys = stored(_count_keys(rows, window).where("n > 1"), "keys")
    again = key_set(keys.select("key"))
    spark = rows.sparkSession
    if again is None:
        return spark.createDataFrame([], f"{ROW}, starts array<long>, ends array<long>")
    whole = stored(_whole(rows, again, window), "segments")
    settled = stored(_settled(whole, window, _busy(keys)), "settled")
    found = settled.where("key is null").select("doc_id", "row", "start", "end")
    kinds = settled.where("key is not null").select("key", F.col("end").alias("kinds"))
    differ = key_set(kinds)
    if differ is not None:
        crowded = key_set(kinds.where(F.col("kinds") > hot))
        found = found.unionByName(_shared_windows(_texts(rows, differ, crowded, window), window))
    return found.groupBy("doc_id", "row").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))


def _cut_text(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    """``_cut`` with what is left as text; characters that lost some of their bytes are left out."""
    out = _cut(text, starts, ends)
    out["left"] = [len(k) for k in out["kept"]]
    out["kept"] = [k.decode("utf-8", "ignore") for k in out["kept"]]
    return out


def _cut(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    kept, n_bytes, n_spans = [], [], []
    for t, a, b in zip(text, starts, ends, strict=True):
        raw = (t or "").encode()
        n_bytes.append(len(raw))
        if a is None or not len(a):
            kept.append(raw), n_spans.append(0)
            continue
        _, s, e = _covered(np.zeros(len(a), np.int64), np.asarray(a, np.int64), np.asarray(b, np.int64))
        edge = [0, *np.stack([s, e], 1).ravel().tolist(), len(raw)]
        kept.append(b"".join(raw[x:y] for x, y in zip(edge[::2], edge[1::2], strict=True))), n_spans.append(len(s))
    return pd.DataFrame({"kept": kept, "n_bytes": n_bytes, "n_spans": n_spans})


def _joined(docs: DataFrame, window: int, hot: int, work, schema: str) -> tuple[DataFrame, str]:
    """``docs`` with a column that ``work`` makes of each text and its spans, and that column's name."""
    table, row = with_row(docs)
    found, cut = fresh(table.columns, "found"), fresh(table.columns, "cut")
    spans = _spans(numbered_texts(table, row), window, hot).select(F.col("row").alias(row), F.struct("starts", "ends").alias(found))
    work = F.pandas_udf(work, schema)(F.col("text").cast("string"), F.col(found)["starts"], F.col(found)["ends"])
    return table.join(spans, row, "left").withColumn(cut, work), cut


def remove_repeats(docs: DataFrame, window: int = WINDOW, hot: int = HOT_SEGMENTS) -> DataFrame:
    """All columns of ``docs`` and ``kept_bytes``, ``n_bytes``, ``n_removed`` and ``n_spans``.

    A byte goes if a string of ``window`` bytes covers it that also starts earlier: in a row with a smaller doc_id (null
    ids come first; rows with one id by their place), or earlier in the same row. Strings are judged on the input and
    never cross rows. A null text counts as empty, and texts shorter than the window keep all. Repeated rows are rows of
    their own. Columns of ``docs`` with the names of the new ones give way to them; all others stay, whatever their names.
    """
    joined, cut = _joined(docs, window, hot, _cut, "kept binary, n_bytes long, n_spans long")
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("kept_bytes", "n_bytes", "n_removed", "n_spans")],
        F.col(cut)["kept"].alias("kept_bytes"), F.col(cut)["n_bytes"].alias("n_bytes"),
        (F.col(cut)["n_bytes"] - F.octet_length(F.col(cut)["kept"])).alias("n_removed"), F.col(cut)["n_spans"].alias("n_spans"),
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, hot: int = HOT_SEGMENTS) -> DataFrame:
    """``docs`` with the repeated bytes of ``text`` left out, all columns kept; rows of which nothing is left go.

    Characters that lose some of their bytes go with them. Where there is a column ``n_chars``, it counts what is left.
    Null, empty and unaffected texts stay as they are.
    """
    joined, cut = _joined(docs, window, hot, _cut_text, "kept string, n_bytes long, n_spans long, left long")
    own = F.col(cut)
    changed = own["left"] < own["n_bytes"]
    new = {"text": F.when(changed, own["kept"]).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(own["kept"])).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    alive = joined.where((own["n_bytes"] == 0) | (F.length(own["kept"]) > 0))
    return alive.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents without the bytes that stand earlier."""
    bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = remove_repeats(docs)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
