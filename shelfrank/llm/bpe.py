"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash cuts every text where its content says so, hence a passage that many documents share gives the same
chunks in each. The most valuable shared chunks are encoded once for the whole table, all others once in a task; words are
only looked at in chunks that aren't known. Chunks cut words, so their joins are repaired: the text from the last whole
word of one chunk to the first whole word of the next is encoded anew, by the library, and the new ids must begin and end
with the ids that those words have in their chunks. Where they don't, more words on either side are encoded anew, until
both ends agree or the text ends. A chunk without a whole word goes into the repair of its neighbours.
"""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.llm.common import bounded_batches

#: A chunk ends where the low bits of the rolling hash are zero: about every 512 bytes, at 8192 bytes at most.
CHUNK_BITS = 9
LONGEST_CHUNK = 8192
#: Shared chunks that are encoded once for the whole table: their number, and their bytes of text, which bound what is
#: sent to executors (an id of four bytes stands for some four bytes of text).
DICTIONARY, DICTIONARY_BYTES = 20_000, 4_000_000
#: Words and chunks that a task remembers.
REMEMBERED_WORDS, REMEMBERED_CHUNKS = 700_000, 20_000
#: Plain words: ASCII without angle brackets (which special tokens have) and the letters of Latin-1, lower-cased. The
#: library's normalisation changes nothing in them and its cut into parts is the one of ``PART``; other words are
#: left to the library whole.
PLAIN = re.compile(r"[!-;=?-~à-öø-ÿ]+")
PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿ]+|[0-9]|[^a-z0-9à-öø-ÿ]+")
SPACE, WORDS = re.compile(rb"[ \t\n\r\x0b\x0c]"), re.compile(rb"[^ \t\n\r\x0b\x0c]+")
# The letter by which byte-level vocabularies write each byte: its own where that can be seen, else the next after 255.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_LETTER = {b: chr(b) for b in _SEEN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SEEN)))}
BYTES = {c: "".join(_LETTER[b] for b in chr(c).encode()) for c in range(0xA0, 0x100)}
_GEAR = np.random.default_rng(5).integers(0, 2**32, 256, dtype=np.uint32)


def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    """The text of a public tokenizer's file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def cuts(raw: bytes, bits: int = CHUNK_BITS, longest: int = LONGEST_CHUNK) -> list[int]:
    """Ends of the chunks of a text; a cut never divides a character."""
    n = len(raw)
    if n <= 32:
        return [n] if n else []
    b = np.frombuffer(raw, np.uint8)
    h = _GEAR[b]
    for s in (1, 2, 4, 8):  # the hash of a byte and the 15 before it
        h[s:] += h[:-s] << np.uint32(s)
    at = np.flatnonzero((h >> np.uint32(7)) & np.uint32((1 << bits) - 1) == 0) + 1
    at = at[(at < n)]
    at = at[(b[at] & 0xC0) != 0x80]
    ends = at.tolist()
    ends.append(n)
    if max(np.diff([0, *ends]), default=0) <= longest:
        return ends
    out, last = [], 0
    for e in ends:
        while e - last > longest:
            last += longest
            while b[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)
        out.append(e)
        last = e
    return out


def chunk_key(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


class Encoder:
    """Encodes texts; remembers words and chunks, within bounds."""

    def __init__(self, source: str, shared: dict[bytes, tuple] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.source = source
        self.model = Tokenizer.from_str(source)
        self.model.no_truncation()
        self.model.no_padding()
        self.shared = shared or {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.words: dict[bytes, tuple[int, ...]] = {}
        self.chunks: dict[bytes, tuple] = {}
        self.numbers = list(range(self.model.get_vocab_size(with_added_tokens=True)))  # one object for each id
        self.names = [self.model.id_to_token(i) or "" for i in range(self.model.get_vocab_size(with_added_tokens=True))]

    def learn(self, texts: list[bytes]) -> None:
        """Encodes the words of the texts that aren't known yet."""
        fresh = set(chain.from_iterable(t.split() for t in texts)).difference(self.words)
        if len(self.words) + len(fresh) > REMEMBERED_WORDS:
            self.words = {}
            fresh = set(chain.from_iterable(t.split() for t in texts))
        add, known, whole = self.words, self.parts, []
        for w in fresh:
            text = w.decode().lower()
            if PLAIN.fullmatch(text) is None:
                whole.append(w)
                continue
            parts = PART.findall(text)
            ids = known.get(parts[0]) or self.part(parts[0])
            for p in parts[1:]:
                ids += known.get(p) or self.part(p)
            add[w] = ids
        done = self.model.encode_batch_fast([w.decode() for w in whole], add_special_tokens=False)
        add.update(zip(whole, (tuple(e.ids) for e in done), strict=True))

    def part(self, text: str) -> tuple[int, ...]:
        """Ids of one part of a plain word, which are remembered."""
        if len(self.parts) >= REMEMBERED_WORDS:
            self.parts.clear()
        own = self.parts[text] = tuple([self.numbers[t.id] for t in self.model.model.tokenize(text.translate(BYTES))])
        return own

    def record(self, chunk: bytes) -> tuple:
        """What is known of a chunk, whose words must have been learnt; () where it has no whole word.

        The ids of its whole words, the end of the first and the beginning of the last of them, and their numbers of ids.
        """
        first = SPACE.search(chunk)
        if first is None:
            return ()
        head, tail = first.start(), max(chunk.rfind(c) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")) + 1
        body = chunk[head:tail]
        words = body.split()
        if not words:
            return ()
        begin, end = head + len(body) - len(body.lstrip()), tail - len(body) + len(body.rstrip())
        ids = tuple(chain.from_iterable(map(self.words.__getitem__, words)))
        return ids, begin + len(words[0]), end - len(words[-1]), len(self.words[words[0]]), len(self.words[words[-1]])

    def add(self, fresh: dict[bytes, bytes]) -> None:
        """Encodes chunks, by their keys, that aren't known yet."""
        if len(self.chunks) + len(fresh) > REMEMBERED_CHUNKS:
            self.chunks = {}
        self.learn(list(fresh.values()))
        self.chunks |= {k: self.record(c) for k, c in fresh.items()}

    def known(self, key: bytes) -> tuple | None:
        found = self.shared.get(key)
        if found is not None:
            return (np.frombuffer(found[0], np.uint32).tolist(), *found[1:])
        return self.chunks.get(key)

    def encode_all(self, raws: list[bytes]) -> list[list[int]]:
        """Ids of each text, from its chunks and repaired joins."""
        keyed, fresh = [], {}
        for raw in raws:
            own, begin = [], 0
            for end in cuts(raw):
                key = chunk_key(chunk := raw[begin:end])
                own.append((key, begin))
                if key not in self.shared and key not in self.chunks:
                    fresh[key] = chunk
                begin = end
            keyed.append(own)
        # what is forgotten for the sake of new chunks is needed here all the same
        held = self.chunks
        self.add(fresh)
        held = held if held is not self.chunks else {}
        placed, windows = [], set()
        for raw, own in zip(raws, keyed, strict=True):
            bodies = [(r, at) for k, at in own if (r := self.known(k) or held.get(k))]
            edges = [0, *(at + r[2] for r, at in bodies)], [*(at + r[1] for r, at in bodies), len(raw)]
            joins = [raw[a:b] for a, b in zip(*edges, strict=True)]
            placed.append((bodies, joins))
            windows.update(joins)
        texts = list(windows)
        done = self.model.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        anew = dict(zip(texts, (e.ids for e in done), strict=True))
        out = []
        for raw, (bodies, joins) in zip(raws, placed, strict=True):
            ids: list[int] | None = []
            for i, join in enumerate(joins):
                left = bodies[i - 1][0] if i else None
                right = bodies[i][0] if i < len(bodies) else None
                between = agreed(anew[join], left[0][len(left[0]) - left[4] :] if left else (), right[0][: right[3]] if right else ())
                if between is None:
                    ids = None
                    break
                ids += between
                if right:
                    ids += right[0]
            out.append(self.widened(raw, bodies) if ids is None else ids)
        return out

    def widened(self, raw: bytes, bodies: list[tuple]) -> list[int]:
        """Ids of a text of which some join needs more than a word on either side: twice as many each time, or all of it."""
        spans = []
        for r, at in bodies:
            begin = max(raw.rfind(c, 0, at + r[1]) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")) + 1
            spans.append([m.span() for m in WORDS.finditer(raw, begin, SPACE.search(raw, at + r[2]).start())])
        n = 2
        while n < 2 * max(map(len, spans), default=0):
            ids: list[int] = []
            for i in range(len(bodies) + 1):
                left, right = spans[i - 1][-n:] if i else [], spans[i][:n] if i < len(bodies) else []
                self.learn([raw[a:b] for a, b in left + right])
                known = [tuple(chain.from_iterable(self.words[raw[a:b]] for a, b in side)) for side in (left, right)]
                text = raw[left[0][0] if left else 0 : right[-1][1] if right else len(raw)]
                between = agreed(self.model.encode(text.decode(), add_special_tokens=False).ids, *known)
                if between is None:
                    break
                ids += between
                ids += bodies[i][0][0] if right else []
            else:
                return ids
            n *= 2
        return self.model.encode(raw.decode(), add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        """The library's decoding without a decoder: the tokens, joined by spaces."""
        return " ".join(map(self.names.__getitem__, ids))


def agreed(ids: list[int], left: tuple, right: tuple) -> list[int] | None:
    """What lies between the ids of the words at both ends, or None where they aren't what ``ids`` begins and ends with."""
    to = len(ids) - len(right)
    if to < len(left) or ids[: len(left)] != list(left) or ids[to:] != list(right):
        return None
    return ids[len(left) : to]


@dataclass
class Shared:
    """A tokenizer and the table's dictionary of shared chunks, sent to executors once."""

    source: object
    chunks: object


_LAST: list[Encoder] = []  # of this worker: what it has learnt serves its next task


def _encoder(kept: Shared) -> Encoder:
    source = kept.source.value
    if not _LAST or _LAST[0].source != source:
        _LAST[:] = [Encoder(source)]
    _LAST[0].shared = kept.chunks.value if kept.chunks is not None else {}
    return _LAST[0]


def share(docs: DataFrame, source: str, dictionary: int = DICTIONARY) -> Shared:
    """Finds the chunks that save most work over the whole table, and encodes each once.

    A first pass counts the chunks by their hash (24 bytes for each half kilobyte of text) and notes one place of each; the
    texts at the places of the chosen ones are read again and those chunks encoded. Their number is bounded by
    ``dictionary``, their text by ``DICTIONARY_BYTES``.
    """
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast(source)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not dictionary:
        return Shared(sent, None)

    def hashed(batches):
        for batch in batches:
            owner, keys, size, last = [], [], [], {}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw, begin = (text or "").encode(), 0
                for end in cuts(raw):
                    if end - begin >= 64:
                        k = chunk_key(raw[begin:end])
                        if k in last:
                            last[k] += 1
                        else:
                            last[k] = 1
                            owner.append(doc), keys.append(k), size.append(end - begin)
                    begin = end
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(owner, pa.int64()), pa.array(size, pa.int32()), pa.array([last[k] for k in keys], pa.int64())],
                names=["key", "doc_id", "size", "n"],
            )

    counted = rows.where("doc_id is not null").mapInArrow(hashed, "key binary, doc_id long, size int, n long")
    counted = counted.groupBy("key").agg(F.sum("n").alias("n"), F.min("doc_id").alias("doc_id"), F.first("size").alias("size")).where("n > 1")
    chosen = counted.orderBy(F.desc(F.expr("(n - 1) * size")), "key").limit(dictionary).select("key", "doc_id", "size").collect()
    places: dict[int, set[bytes]] = {}
    total = 0
    for r in chosen:
        total += r["size"]
        if total > DICTIONARY_BYTES:
            break
        places.setdefault(r["doc_id"], set()).add(bytes(r["key"]))
    if not places:
        return Shared(sent, None)
    wanted = sc.broadcast(places)

    def encoded(batches):
        encoder = None
        for batch in batches:
            encoder = encoder or _encoder(Shared(sent, None))
            fresh: dict[bytes, bytes] = {}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, raw, begin = wanted.value[doc], (text or "").encode(), 0
                for end in cuts(raw):
                    chunk = raw[begin:end]
                    begin = end
                    if (k := chunk_key(chunk)) in own:
                        fresh[k] = chunk
            encoder.learn(list(fresh.values()))
            found = [(k, r) for k, c in fresh.items() if (r := encoder.record(c))]
            columns = [pa.array([k for k, _ in found], pa.binary()), pa.array([np.array(r[0], np.uint32).tobytes() for _, r in found], pa.binary())]
            columns += [pa.array([r[i] for _, r in found], pa.int32()) for i in (1, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", "first_end", "last_begin", "n_first", "n_last"])

    few = docs.sparkSession.createDataFrame([(d,) for d in places], "doc_id long")  # ``dictionary`` at most
    mine = rows.join(F.broadcast(few), "doc_id", "left_semi").mapInArrow(encoded, "key binary, ids binary, first_end int, last_begin int, n_first int, n_last int")
    done = {bytes(r[0]): (bytes(r[1]), *r[2:]) for r in mine.collect()}  # bounded as the dictionary is
    wanted.unpersist()
    return Shared(sent, sc.broadcast(done))


def _batches(texts: list[bytes], most: int = 2_000_000):
    first = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield slice(first, i)
            first, total = i, 0
        total += len(t)
    if first < len(texts):
        yield slice(first, len(texts))


def mapped(docs: DataFrame, kept: Shared, make, schema: str) -> DataFrame:
    """Rows that ``make(encoder, doc_ids, list of ids, raw texts)`` returns as Arrow arrays, for every slice of documents."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches):
        encoder = None
        for batch in batches:
            encoder = encoder or _encoder(kept)
            raws = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for g in _batches(raws):
                ids = encoder.encode_all(raws[g])
                yield pa.RecordBatch.from_arrays(make(encoder, batch.column(0)[g.start : g.stop], ids, raws[g]), names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def encode(docs: DataFrame, source: str | None = None, dictionary: int = DICTIONARY) -> DataFrame:
    """``doc_id`` and ``ids`` of every row, as the library encodes whole texts without adding special tokens.

    Null and empty texts have no ids. Rows are kept as they are, repeated ones and null ids included; other columns are
    left behind. ``source`` is the JSON of a tokenizer that drops ASCII white space before its merges.
    """
    kept = share(docs, source or tokenizer_json(), dictionary)
    return mapped(docs, kept, lambda e, d, ids, raw: [d, pa.array(ids, pa.list_(pa.int32()))], "doc_id long, ids array<int>")


def decode(encoded: DataFrame, source: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` of every row of ids, special tokens included; null ids give null."""
    sent = encoded.sparkSession.sparkContext.broadcast(source or tokenizer_json())

    def run(batches):
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(sent.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([None if i is None else encoder.decode(i) for i in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


@cache
def _decimals(n: int) -> list[str]:
    return [str(i) for i in range(n)]


def digests(docs: DataFrame, source: str | None = None, dictionary: int = DICTIONARY) -> DataFrame:
    """Number and digest of each text's ids, and the digest of what they decode to."""

    def make(encoder, doc, ids, raw):
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        numbers = _decimals(len(encoder.names))
        return [
            doc, pa.array(list(map(len, ids)), pa.int64()),
            pa.array([sha(" ".join(map(numbers.__getitem__, i))) for i in ids]), pa.array([sha(encoder.decode(i)) for i in ids]),
        ]

    kept = share(docs, source or tokenizer_json(), dictionary)
    return mapped(docs, kept, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document encoded and decoded."""
    bounded_batches(spark)
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
