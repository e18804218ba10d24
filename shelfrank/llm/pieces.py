"""SentencePiece encoding that knows where each piece stands in the original bytes, and decoding.

Texts are normalised by the longest prefix that the model's compiled character map knows; for every normalised byte the
place of the source that it comes from is recorded. The normalised text is cut into runs that no merge can cross, each
run is merged by the library, once in a task while it is remembered, and the ends of the pieces are projected to the original bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.llm.common import bounded_batches

#: How the model writes a space.
MARK = "▁"
#: Runs that a task remembers, and the longest of them, in characters.
REMEMBERED, LONGEST = 500_000, 64
#: Characters of a text that are looked at together, where the character map is empty.
SLICE = 1 << 20
_NUMBERS = np.dtype("<u4")


def model_bytes(name: str = "piece_bpe_32k.model") -> bytes:
    """A public model's file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


class CharacterMap:
    """A compiled map: a double array of prefixes and the texts that replace them, each closed by a zero byte."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.units: list[int] = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if compiled else []
        self.texts = compiled[4 + size :]
        self.begins = {b for b in range(256) if self._step(self._root(), b) is not None} if self.units else set()

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << (unit >> 6 & 8)

    def _root(self) -> int:
        return self._offset(self.units[0])

    def _step(self, node: int, byte: int) -> int | None:
        at = node ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of ``raw[at:]`` that is in the map, and what replaces it."""
        node, found = self._root(), None
        for n in range(at, len(raw)):
            here = self._step(node, raw[n])
            if here is None:
                break
            unit = self.units[here]
            node = here ^ self._offset(unit)
            if unit >> 8 & 1:
                found = n + 1 - at, self.units[node] & 0x7FFFFFFF
        return found and (found[0], self.texts[found[1] : self.texts.index(0, found[1])])


class Encoder:
    """Encodes and decodes by one model; remembers runs, within a bound."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as schema

        self.source = model
        proto = schema.ModelProto.FromString(model)
        kind = schema.ModelProto.SentencePiece
        own = {i: p for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        odd = [p.piece for p in proto.pieces if p.type in (kind.USER_DEFINED, kind.UNUSED)]
        bpe = proto.trainer_spec.model_type == schema.TrainerSpec.BPE and proto.trainer_spec.byte_fallback
        if not bpe or odd or proto.trainer_spec.treat_whitespace_as_suffix or not proto.normalizer_spec.escape_whitespaces:
            raise ValueError("only BPE models with byte fallback, space as prefix and neither own nor unused pieces are supported")
        self.library = SentencePieceProcessor(model_proto=model)
        rules = proto.normalizer_spec
        self.map, self.prefix, self.trimmed = CharacterMap(rules.precompiled_charsmap), rules.add_dummy_prefix, rules.remove_extra_whitespaces
        self.bytes = {i: int(p.piece[1:-1], 16) for i, p in enumerate(proto.pieces) if p.type == kind.BYTE}
        self.widths = np.array([len(p.piece.encode()) if i in own else 1 for i, p in enumerate(proto.pieces)], _NUMBERS)
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        # merges make pieces, so none joins two characters that stand together in no piece
        pairs = {p.piece[i : i + 2] for p in own.values() for i in range(len(p.piece) - 1)}
        alone = "\n" if not any("\n" in pair for pair in pairs) else ""
        inside = any(pair[1] == MARK != pair[0] for pair in pairs)
        self.line = next(i for i, b in self.bytes.items() if b == 10) if alone else None
        self.runs = re.compile(f"{MARK}*[^{MARK}{alone}]+|{alone or MARK}|{MARK}+" if not inside else "(?s:.+)")
        # what each id decodes to: the unknown piece is the library's, control pieces are nothing
        texts = {i: p.piece.replace(MARK, " ").encode() for i, p in own.items()} | {i: bytes([b]) for i, b in self.bytes.items()}
        self.texts = [texts.get(i, proto.trainer_spec.unk_surface.encode() if p.type == kind.UNKNOWN else b"") for i, p in enumerate(proto.pieces)]
        rules.Clear()  # the same merges over texts that are normalised
        rules.add_dummy_prefix = rules.remove_extra_whitespaces = False
        self.merges = SentencePieceProcessor(model_proto=proto.SerializeToString())
        line = np.array([self.line], _NUMBERS) if alone else None
        self.first = {"\n": (line.tobytes(), self.widths[line].tobytes())} if alone else {}
        self.known: dict[str, tuple[bytes, bytes]] = dict(self.first)

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the byte of ``text`` that it comes from.

        All bytes that replace one prefix come from where that prefix begins.
        """
        raw = text.encode()
        if not self.map.units and not self.trimmed:
            b = np.frombuffer(raw, np.uint8)
            place = np.maximum.accumulate(np.where((b & 0xC0) != 0x80, np.arange(len(b)), 0)) if len(b) else np.zeros(0, np.int64)
            place = np.repeat(place, np.where(b == 0x20, 3, 1))
            first = 3 * bool(self.prefix and raw)
            return MARK * bool(first) + text.replace(" ", MARK), np.concatenate([np.zeros(first, np.int64), place, [len(raw)]])
        mark = MARK.encode()
        out, place, at = [], [], 0

        def put(piece: bytes, begin: int) -> None:
            out.append(piece)
            place.extend([begin] * len(piece))

        after_space = self.trimmed
        started = False
        while at < len(raw):
            found = self.map.longest(raw, at) if raw[at] in self.map.begins else None
            if found is None:
                lead = raw[at]
                found = (n := 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)), raw[at : at + n]
            width, piece = found
            if self.trimmed and not started and piece == b" ":  # spaces before the text
                at += width
                continue
            if not started:
                started = True
                if self.prefix:
                    put(mark, at)
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                put(piece.replace(b" ", mark), at)
                after_space = self.trimmed and piece.endswith(b" ")
            at += width
        whole, end = b"".join(out), len(raw)
        while self.trimmed and whole.endswith(mark):
            whole = whole[: -len(mark)]
            end = place[len(whole)]
        return whole.decode(), np.array([*place[: len(whole)], end], np.int64)

    def learn(self, runs: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of the pieces of each run and the number of normalised bytes of each, as unsigned 32-bit integers."""
        if self.line is None:
            ids = [np.array(own, _NUMBERS) for own in self.merges.encode(runs, num_threads=1)]
            return [(own.tobytes(), self.widths[own].tobytes()) for own in ids]
        ids = np.array(self.merges.encode("\n".join([*runs, ""])), _NUMBERS)
        ends = (4 * np.flatnonzero(ids == self.line)).tolist()
        numbers, widths = ids.tobytes(), self.widths[ids].tobytes()
        return [(numbers[a:b], widths[a:b]) for a, b in zip([0, *[e + 4 for e in ends]], ends, strict=False)]

    def runs_of(self, normalised: str) -> tuple[bytes, bytes]:
        """Ids and widths of a normalised text; runs that aren't remembered are merged, each once."""
        runs, known = self.runs.findall(normalised), self.known
        fresh = list(set(runs).difference(known))
        if fresh:
            learnt = dict(zip(fresh, self.learn(fresh), strict=True))
            long = {r: learnt.pop(r) for r in fresh if len(r) > LONGEST}
            if len(known) + len(learnt) > REMEMBERED:  # the rest of this text may be needed all the same
                learnt |= {r: known[r] for r in set(runs).intersection(known)}
                self.known = known = dict(self.first)
            known |= learnt
            found = [long.get(r) or known[r] for r in runs] if long else list(map(known.__getitem__, runs))
        else:
            found = list(map(known.__getitem__, runs))
        return b"".join([f[0] for f in found]), b"".join([f[1] for f in found])

    def slices(self, text: str) -> Iterator[tuple[str, np.ndarray, int]]:
        """Normalised slices, their alignment and where each begins in the text's bytes; a cut stands before a space.

        A text is one slice where the character map or the treatment of spaces looks over a cut.
        """
        if len(text) <= SLICE or self.map.units or self.trimmed or self.runs.pattern.startswith("(?s"):
            yield *self.normalised(text), 0
            return
        begin = offset = 0
        while begin < len(text):
            cut = re.compile(r"(?<=[^ ▁]) ").search(text, begin + SLICE) if begin + SLICE < len(text) else None
            end = cut.start() if cut else len(text)
            whole, place = self.normalised(text[begin:end])
            first = 3 * bool(begin and self.prefix)
            yield whole[bool(first) :], place[first:], offset
            offset += int(place[-1])
            begin = end

    def encode(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of each slice of a text and the original byte at which each piece ends; a piece begins where the one before ends.

        The begin and end ids are pieces of no width.
        """
        yield np.array([self.begin], _NUMBERS), np.zeros(1, np.int64)
        at = 0
        for whole, place, offset in self.slices(text):
            ids, widths = self.runs_of(whole)
            ends = place[np.cumsum(np.frombuffer(widths, _NUMBERS), dtype=np.int64)] + offset
            at = ends[-1] if len(ends) else at
            yield np.frombuffer(ids, _NUMBERS), ends
        yield np.array([self.end], _NUMBERS), np.array([at], np.int64)

    def decoded(self, ids: list[int], first: bool = True) -> bytes:
        """What the ids decode to, as bytes; ``first``: the space that stands for the beginning of a text is left out."""
        raw = b"".join(map(self.texts.__getitem__, ids))
        if first and (self.prefix or self.trimmed) and raw.startswith(b" "):
            lead = next(i for i in ids if self.texts[i])
            if lead not in self.bytes:
                return raw[1:]
        return raw

    def decode(self, ids: list[int]) -> str:
        """The library's decoding; what can't come from encoding (unknown or control pieces inside, bytes that aren't UTF-8) goes to the library."""
        inner = ids[ids[:1] == [self.begin] : len(ids) - (ids[-1:] == [self.end])]
        if not self.trimmed and self.library.unk_id() not in inner and all(map(self.texts.__getitem__, inner)):
            try:
                return self.decoded(inner).decode()
            except UnicodeDecodeError:
                pass
        return self.library.decode(ids)


_LAST: list[Encoder] = []  # of this worker: what it has learnt serves its next task


def _encoder(model: bytes) -> Encoder:
    if not _LAST or _LAST[0].source != model:
        _LAST[:] = [Encoder(model)]
    return _LAST[0]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, model: bytes | None = None) -> DataFrame:
    """(doc_id, ids, ends) of every row: the library's ids with begin and end, and the original byte where each piece ends.

    Null and empty texts have the begin and end ids alone. Rows are kept as they are, repeated ones and null ids included;
    other columns are left behind. Very long texts are worked on in slices.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or model_bytes())

    def run(batches):
        encoder = _encoder(sent.value)
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = list(encoder.encode(text or ""))
                ids, ends = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                columns = [pa.array([ids.astype(np.int32)], pa.list_(pa.int32())), pa.array([ends], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 1], *columns], names=["doc_id", "ids", "ends"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>, ends array<long>")


def spans(encoded: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, piece_no, id, begin, end, bytes) of each piece of documents with distinct ids: the original bytes it stands for.

    Rows without an id, and those of other documents, are left out.
    """
    own = encoded.join(_texts(docs), "doc_id").select("doc_id", "ends", F.encode("text", "UTF-8").alias("raw"), F.posexplode("ids").alias("piece_no", "id"))
    begin = F.when(F.col("piece_no") == 0, F.lit(0).cast("long")).otherwise(F.get("ends", F.col("piece_no") - 1))
    own = own.select("doc_id", "piece_no", "id", begin.alias("begin"), F.get("ends", "piece_no").alias("end"), "raw")
    part = F.expr("substring(coalesce(raw, cast('' as binary)), cast(begin + 1 as int), cast(end - begin as int))")
    return own.select("doc_id", "piece_no", "id", "begin", "end", part.alias("bytes"))


def decode(encoded: DataFrame, model: bytes | None = None) -> DataFrame:
    """(doc_id, text) of every row of ids, as the library decodes them; null ids give null."""
    sent = encoded.sparkSession.sparkContext.broadcast(model or model_bytes())

    def run(batches):
        encoder = _encoder(sent.value)
        for batch in batches:
            texts = [None if i is None else encoder.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: bytes | None = None) -> DataFrame:
    """Number and digest of each text's ids, digest of what they decode to, digest of the pieces' ends in the original."""
    sent = docs.sparkSession.sparkContext.broadcast(model or model_bytes())

    def run(batches):
        encoder = _encoder(sent.value)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                n, own, back, places = 0, hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
                for k, (ids, ends) in enumerate(encoder.encode(text or "")):
                    n += len(ids)
                    own.update(ids.tobytes())
                    places.update(ends.astype("<u8").tobytes())
                    back.update(encoder.decoded(ids.tolist(), k == 1))
                rows.append((n, own.hexdigest(), back.hexdigest(), places.hexdigest()))
            columns = [pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[i] for r in rows], pa.string()) for i in (1, 2, 3)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ends_sha256"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ends_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: every document encoded and decoded."""
    bounded_batches(spark)
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
