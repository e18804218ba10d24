"""Language ID: script ranges narrow the candidates of a word, Viterbi labels the spans of a text."""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.llm.common import bounded_batches

HELD_OUT = 2
#: Documents that training reads at most, in expectation; they are chosen by a hash of their id.
TRAIN_DOCS = 20_000
BUCKETS = 1 << 16
#: Cost, in nats, of changing language between two words.
SWITCH = 12.0
#: A language is a candidate for a script if this share of its training words is written in it.
CANDIDATE_SHARE = 0.001
#: Longer runs of letters and marks are cut into consecutive words of so many.
LONGEST_WORD = 24
#: Sums of the tasks' counts are added in so many branches first.
BRANCHES = 32
SLICE_CHARS = 1_000_000
# First and last code point of the letters of each script (Unicode blocks).
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("ethiopic", 0x1200, 0x137F),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
NAMES = sorted({s[0] for s in SCRIPTS}) + ["other"]
_STARTS = np.array([s[1] for s in SCRIPTS])
_ENDS = np.array([s[2] for s in SCRIPTS])
_WHICH = np.array([NAMES.index(s[0]) for s in SCRIPTS])


def _class(points: list[int]) -> str:
    edge = [i for i, c in enumerate(points) if not i or c != points[i - 1] + 1] + [len(points)]
    return "".join(f"{chr(points[i])}-{chr(points[j - 1])}" for i, j in zip(edge, edge[1:], strict=False))


def _word_pattern() -> re.Pattern:
    """A letter of a script, and up to ``LONGEST_WORD`` in all of its letters and of combining marks.

    Letters and marks are those of the Unicode categories L and M; number forms are neither. Marks within a script's
    ranges are its own, those outside them go with any letter (beyond the basic plane, with letters of no listed script).
    """
    kind = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    of = {c: n for n, a, b in SCRIPTS for c in range(a, b + 1)}
    letters: dict[str, list[int]] = {n: [] for n in NAMES}
    marks: dict[str, list[int]] = {n: [] for n in NAMES}
    for c, k in enumerate(kind):
        if k in "LM":
            (letters if k == "L" else marks)[of.get(c, "other")].append(c)

    def word(name: str) -> str:
        more = sorted({*letters[name], *marks[name], *(c for c in marks["other"] if c < 0x10000 or name == "other")})
        return f"[{_class(letters[name])}][{_class(more)}]{{0,{LONGEST_WORD - 1}}}"

    rest = [n for n in NAMES if n != "latin"]
    # ASCII needs no trial with each script: its letters are all Latin
    return re.compile(f"{word('latin')}|(?![\\x00-\\x7f])(?:{'|'.join(map(word, rest))})")


WORD = _word_pattern()


@dataclass
class Model:
    """Scores of hashed character n-grams for each language; its size depends on the number of languages alone."""

    langs: list[str]
    scores: np.ndarray  # bucket x language, in nats
    allowed: np.ndarray  # script x language


def _codes(words: list[str]) -> np.ndarray:
    """A row of code points for each word, ended by 1 and padded by 0, after a leading 1."""
    size = np.array([len(w) for w in words], np.int64)
    width = max(LONGEST_WORD, int(size.max(initial=0)))  # some letters are two in lower case
    fixed = np.array(words, dtype=f"U{width}")
    raw = fixed.view(np.uint32).reshape(len(words), width)
    out = np.zeros((len(words), width + 2), np.uint32)
    out[:, 0] = 1
    out[:, 1:-1] = raw
    out[np.arange(len(words)), 1 + size] = 1
    return out


def _grams(codes: np.ndarray):
    """Buckets of the 2-, 3- and 4-grams that begin at each position, and which of them exist."""
    h = codes.astype(np.uint64)
    key = h * np.uint64(0x9E3779B97F4A7C15)
    for n in (2, 3, 4):
        key = (key[:, :-1] ^ h[:, n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        yield ((key >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64), codes[:, n - 1 :] != 0


def scripts(words: list[str]) -> np.ndarray:
    """The index in ``NAMES`` of each word's first letter."""
    first = np.array([ord(w[0]) for w in words])
    at = np.maximum(np.searchsorted(_STARTS, first, "right") - 1, 0)
    inside = (first >= _STARTS[at]) & (first <= _ENDS[at])
    return np.where(inside, _WHICH[at], len(NAMES) - 1)


def _slices(texts: list[str | None]):
    """Consecutive rows of some million characters together."""
    first = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t or "") > SLICE_CHARS:
            yield slice(first, i)
            first, total = i, 0
        total += len(t or "")
    if first < len(texts):
        yield slice(first, len(texts))


def _count(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Times each bucket and each script occurs in the words."""
    grams, seen = np.zeros(BUCKETS, np.int64), np.zeros(len(NAMES), np.int64)
    unique, times = np.unique(np.array(words, dtype=object).astype(str), return_counts=True) if words else ([], np.zeros(0, np.int64))
    for i in range(0, len(unique), 50_000):
        part = list(unique[i : i + 50_000])
        for bucket, there in _grams(_codes(part)):
            grams += np.bincount(bucket[there], np.broadcast_to(times[i : i + 50_000, None], bucket.shape)[there], BUCKETS).astype(np.int64)
        seen += np.bincount(scripts(part), times[i : i + 50_000], len(NAMES)).astype(np.int64)
    return grams, seen


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """A model from the text and lang of documents outside the held-out fold.

    Every task counts the n-grams of its documents for each language; the counts are summed by language. Some
    ``train_docs`` documents are read, chosen by a hash of their id, or all where there are fewer; the model's size does
    not depend on them. Without any labelled document the model has no languages.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("doc_id is not null and lang is not null and text is not null").where(F.crc32(F.col("doc_id").cast("string")) % 4 != HELD_OUT)
    n = rows.select("doc_id").count()
    if n > train_docs:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * train_docs / n))

    def run(batches):
        counts: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for g in _slices(texts):
                for lang in set(langs[g]):
                    words = list(chain.from_iterable(WORD.findall(t.lower()) for t, x in zip(texts[g], langs[g], strict=True) if x == lang))
                    own = counts.setdefault(lang, [np.zeros(BUCKETS, np.int64), np.zeros(len(NAMES), np.int64)])
                    for total, part in zip(own, _count(words), strict=True):
                        total += part
        names = sorted(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([zlib.compress(np.concatenate(counts[x]).tobytes(), 1) for x in names], pa.binary())],
            names=["lang", "counts"],
        )

    def add(key, group):
        total = sum(np.frombuffer(zlib.decompress(c), np.int64) for c in group["counts"])
        return pd.DataFrame({"lang": [key[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    counted = rows.select("lang", "text").mapInArrow(run, "lang string, counts binary").withColumn("branch", F.pmod(F.spark_partition_id(), F.lit(BRANCHES)))
    summed = counted.groupBy("lang", "branch").applyInPandas(add, "lang string, counts binary").groupBy("lang").applyInPandas(add, "lang string, counts binary")
    found = sorted(summed.collect())  # one row for each language
    langs = [r["lang"] for r in found]
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    counts = np.stack([np.frombuffer(zlib.decompress(r["counts"]), np.int64) for r in found], axis=1)
    grams, seen = counts[:BUCKETS] + 0.5, counts[BUCKETS:]
    scores = np.log(grams / grams.sum(0))
    scores -= scores.mean(1, keepdims=True)
    return Model(langs, scores.astype(np.float32), seen > CANDIDATE_SHARE * np.maximum(seen.sum(0), 1))


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """Nats in favour of each language for each word; languages not written in the word's script are far below."""
    out = np.zeros((len(words), len(model.langs)), np.float32)
    for i in range(0, len(words), 50_000):
        part = words[i : i + 50_000]
        own = out[i : i + 50_000]
        for bucket, there in _grams(_codes(part)):
            for p in range(bucket.shape[1]):
                on = np.flatnonzero(there[:, p])
                if on.size:
                    own[on] += model.scores[bucket[on, p]]
        allowed = model.allowed[scripts(part)]
        own /= 3  # each letter counts about once, not once for each length of n-gram
        own[~allowed & allowed.any(1, keepdims=True)] = -1e4
        own[~allowed.any(1)] = 0
    return out


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best language of each word; ``scores`` holds the texts one after the other.

    The texts of a slice advance together, longest first: step t handles word t of all texts that have one.
    """
    n_langs = scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    start = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    steps = int(size[0]) if size.size else 0
    active = np.searchsorted(-size, -np.arange(steps), "left")  # texts with more than t words
    out = np.zeros(scores.shape[0], np.int64)
    back = np.zeros(scores.shape, np.uint8 if n_langs < 256 else np.int32)
    best = np.zeros((len(size), n_langs), np.float32)
    for t in range(steps):
        a = active[t]
        at = start[:a] + t
        if t:
            now = best[:a]
            top = now.argmax(1)
            reach = now[np.arange(a), top] - penalty
            stay = now >= reach[:, None]
            back[at] = np.where(stay, np.arange(n_langs), top[:, None])
            best[:a] = np.where(stay, now, reach[:, None]) + scores[at]
        else:
            best[:a] = scores[at]
    state = best.argmax(1)
    for t in range(steps - 1, -1, -1):
        a = active[t]
        at = start[:a] + t
        out[at] = state[:a]
        state[:a] = back[at, state[:a]] if t else state[:a]
    return out


def _labelled(texts: list[str | None], model: Model, penalty: float):
    """(lengths, letters, label) of the words of the texts, one text after the other."""
    found = [WORD.findall(t) if t else [] for t in texts]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    words = list(chain.from_iterable(found))
    letters = np.fromiter(map(len, words), np.int64, len(words))
    if not words or not model.langs:
        return lengths, letters, np.zeros(len(words), np.int64)
    code, unique = pd.factorize(np.array([w.lower() for w in words], dtype=object))
    return lengths, letters, viterbi(word_scores(list(unique), model)[code], lengths, penalty)


def _runs(label: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))


def detect(docs: DataFrame, model: Model, penalty: float = SWITCH) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``spans`` of every row.

    ``spans`` lists (start, end, lang) in characters: the runs of words that the best path gives one language. Long runs
    of letters, and runs in which the script changes, are several words, so that every letter counts.
    ``lang_pred`` is the language with most letters (the first by name among equals) and ``score`` its share of the
    letters. A text that is null or has no letters, or any text under a model without languages, is ``und`` with score 0
    and no spans. Rows are kept as they are; other columns are left behind.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for g in _slices(texts):
                own = texts[g]
                lengths, letters, label = _labelled(own, model, penalty)
                ends = np.cumsum(lengths)
                pred, score, spans = [], [], []
                for i, t in enumerate(own):
                    lo, hi = ends[i] - lengths[i], ends[i]
                    if lo == hi or not model.langs:
                        pred.append("und"), score.append(0.0), spans.append([])
                        continue
                    share = np.bincount(label[lo:hi], letters[lo:hi], len(model.langs))
                    top = int(share.argmax())
                    pred.append(model.langs[top]), score.append(float(share[top] / share.sum()))
                    first = _runs(label[lo:hi])
                    if len(first) == 1:
                        spans.append([(0, len(t), model.langs[top])])
                        continue
                    at = [m.start() for m in WORD.finditer(t)]
                    edge = [0, *(at[j] for j in first[1:]), len(t)]
                    spans.append([(a, b, model.langs[label[lo + j]]) for a, b, j in zip(edge, edge[1:], first, strict=False)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[g.start : g.stop], pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                        pa.array([[{"start": a, "end": b, "lang": x} for a, b, x in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))),
                    ],
                    names=["doc_id", "lang_pred", "score", "spans"],
                )

    schema = "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def identify(docs: DataFrame, train_docs: int = TRAIN_DOCS, penalty: float = SWITCH) -> DataFrame:
    """``detect`` with a model trained on the table's own ``lang`` column."""
    return detect(docs, train(docs, train_docs), penalty)


def keep_identified(docs: DataFrame, least: float = 0.5, train_docs: int = TRAIN_DOCS, penalty: float = SWITCH) -> DataFrame:
    """``docs`` with the rows of which one language has ``least`` of the letters, all columns kept; ``und`` goes."""
    model = train(docs, train_docs)

    def shares(text: pd.Series) -> pd.Series:
        out: list[float] = []
        texts = text.tolist()
        for g in _slices(texts):
            lengths, letters, label = _labelled(texts[g], model, penalty)
            text_of = np.repeat(np.arange(len(lengths)), lengths)
            n = max(len(model.langs), 1)
            per = np.bincount(text_of * n + label, letters, len(lengths) * n).reshape(len(lengths), n)
            total = per.sum(1)
            out += (per.max(1) / np.maximum(total, 1)).tolist() if model.langs else [0.0] * len(lengths)
        return pd.Series(out, dtype="float64")

    return docs.where(F.pandas_udf(shares, "double")(F.col("text").cast("string")) >= least)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the language of every document."""
    bounded_batches(spark)
    found = identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
