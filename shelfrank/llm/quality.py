"""Quality classifier: a Gaussian kernel over document statistics, by random Fourier features and ridge regression."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.llm.common import bounded_batches, fresh, stored

FEATURES = 256
RIDGE = 1e-3
BANDWIDTH = 4.0
SEED = 11
BINS = 512
#: The tasks' sums are added in so many branches first.
BRANCHES = 32
#: A document is kept, and predicted 1, from this score on.
CUT = 0.7
HELD_OUT = 2
UPPER, DIGIT = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"\d")
SYMBOL, MARK = re.compile(r"[^\w\s.,;:'\"()?-]"), re.compile(r"[.,;:!?]")
STATS = [
    "chars", "words", "word_length", "long_words", "upper", "digits", "symbols", "symbol_words", "marks", "distinct",
    "repeats", "top_word", "line_length", "copied_lines", "squeezed", "short_words", "ends_marked", "capitals",
]


def statistics(text: str | None) -> list[float]:
    """The statistics of ``STATS`` of a whole text; zeros where there is nothing to count."""
    t = text or ""
    words = t.split()
    n, c = max(len(words), 1), max(len(t), 1)
    counts = pd.Series(words).value_counts().to_numpy() if len(words) > 4000 else None
    if counts is None:
        tally: dict[str, int] = {}
        for w in words:
            tally[w] = tally.get(w, 0) + 1
        distinct, top = len(tally), max(tally.values(), default=0)
    else:
        distinct, top = len(counts), int(counts.max())
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in t.split("\n") if x]
    raw = t.encode()
    return [
        np.log1p(len(t)), np.log1p(len(words)), float(lengths.sum()) / n, float((lengths > 12).sum()) / n,
        len(UPPER.findall(t)) / c, len(DIGIT.findall(t)) / c, len(SYMBOL.findall(t)) / c,
        sum(not w[-1].isalnum() and w[-1] not in ".,;:?!" for w in words) / n, len(MARK.findall(t)) / n,
        distinct / n ** 0.85, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, top / n,
        np.log1p(c / max(len(lines), 1)), 1 - len(set(lines)) / max(len(lines), 1),
        len(zlib.compress(raw, 1)) / max(len(raw), 1), float((lengths < 3).sum()) / n,
        sum(w[-1] in ".!?" for w in words) / n, sum(w[0].isupper() for w in words) / n,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``stats`` (an array in the order of ``STATS``) of every row."""

    def run(batches):
        for batch in batches:
            own = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.float64()))], names=["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, stats array<double>")


def fold(doc_id):
    """crc32 of the id's text modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string")) % 4


@dataclass
class Model:
    """What scoring needs; its size depends on the number of features alone."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def mapped(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        out = np.cos(z @ self.weights + self.phases) * np.sqrt(2 / self.weights.shape[1])
        return np.column_stack([out, np.ones(len(out))])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.mapped(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return np.clip(np.interp(self.margin(x), self.knots, self.levels), 0, 1)


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist() if hasattr(column, "to_pylist") else list(column), dtype=np.float64).reshape(-1, len(STATS))


def _summed(labelled: DataFrame, parts, width: int) -> np.ndarray:
    """Sum over all tasks of the matrices that ``parts`` makes of their rows; each is a few rows of ``width`` numbers."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                own = parts(_matrix(batch.column(0)), np.array(batch.column(1).to_pylist(), dtype=np.float64))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"]
            )

    def add(key, group):
        return pd.DataFrame({"i": [key[0]], "row": [np.sum(np.stack(group["row"].to_list()), axis=0).tolist()]})

    rows = labelled.select("stats", "label").mapInArrow(run, "i int, row array<double>")
    rows = rows.withColumn("branch", F.pmod(F.spark_partition_id(), F.lit(BRANCHES))).groupBy("i", "branch").applyInPandas(add, "i int, row array<double>")
    rows = rows.groupBy("i").applyInPandas(add, "i int, row array<double>").collect()  # one for each feature
    if not rows:
        return np.zeros((0, width))
    return np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])])


def _isotonic(centres: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over the bins; the centre and level of each pool."""
    pools: list[list[float]] = []
    for c, m, w in zip(centres, mean, weight, strict=True):
        pools.append([c * w, m * w, w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def fit(stats: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE, bandwidth: float = BANDWIDTH, seed: int = SEED) -> Model:
    """A model of ``labels.quality``, from all labelled rows outside the held-out fold.

    Folds 0 and 1 give the ridge weights through normal equations that each task sums for its rows; fold 3 calibrates
    the margins, counted in 512 bins, by isotonic regression. A label given more than once counts as its mean; null ids
    and labels teach nothing. Without any label every score is 0.5; with labels of one kind, it is that label.
    """
    own = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("label"))
    labelled = stats.where("doc_id is not null").withColumn("fold", fold(F.col("doc_id"))).where(F.col("fold") != HELD_OUT).join(own, "doc_id")
    train, tune = labelled.where("fold in (0, 1)"), labelled.where("fold = 3")
    d = len(STATS)
    total = _summed(labelled, lambda x, y: np.stack([x.sum(0), (x * x).sum(0), np.full(d, float(len(x)))]), d)
    rng = np.random.default_rng(seed)
    weights, phases = rng.normal(0, 1 / bandwidth, (d, features)), rng.uniform(0, 2 * np.pi, features)
    if not len(total):
        return Model(np.zeros(d), np.ones(d), weights, phases, np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    n = total[2, 0]
    mean = total[0] / n
    scale = np.sqrt(np.maximum(total[1] / n - mean**2, 1e-12)) + 1e-6
    model = Model(mean, scale, weights, phases, np.zeros(features + 1), np.array([0.0]), np.array([0.5]))

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.mapped(x)
        return np.column_stack([z.T @ z, z.T @ y])

    sums = _summed(train, normal, features + 2)
    if not len(sums):
        sums = _summed(labelled, normal, features + 2)
    gram, right = sums[:, :-1], sums[:, -1]
    rows = gram[-1, -1]
    model.beta = np.linalg.solve(gram + ridge * rows / features * np.eye(features + 1), right)

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip(((model.margin(x) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.stack([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS), np.bincount(at, model.margin(x), BINS)]).T

    counts = _summed(tune, binned, 3)
    if not len(counts):
        counts = _summed(labelled, binned, 3)
    counts = counts[counts[:, 0] > 0]
    model.knots, model.levels = _isotonic(counts[:, 2] / counts[:, 0], counts[:, 1] / counts[:, 0], counts[:, 0])
    return model


def apply(stats: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row of ``stats``."""

    def run(batches):
        for batch in batches:
            own = model.score(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.float64())], names=["doc_id", "score"])

    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    scored = stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Scores of every document by a model of the labels: doc_id, held_out, score (0 to 1), predicted.

    Null and empty texts are scored like others, by statistics of zero. Rows are kept as they are, repeated ones
    included; columns besides doc_id and text are left behind. A row without an id is scored and never held out.
    """
    stats = stored(with_statistics(docs), "quality")
    return apply(stats, fit(stats, labels, **options))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT, **options) -> DataFrame:
    """``docs`` with the rows whose text scores ``cut`` or more, all columns kept; no text is shuffled.

    The table is written once with the statistics of each text, from which the model is fitted and the scores are worked
    out. Null and empty texts are scored like others; repeated rows are rows of their own.
    """
    own = fresh(docs.columns, "stats")
    measured = F.pandas_udf(lambda text: pd.Series([statistics(t) for t in text]), "array<double>")
    table = stored(docs.withColumn(own, measured(F.col("text").cast("string"))), "measured", "zstd")
    model = fit(table.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(own).alias("stats")), labels, **options)
    scores = F.pandas_udf(lambda stats: pd.Series(model.score(_matrix(stats))), "double")
    return table.where(scores(F.col(own)) >= cut).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document's quality."""
    bounded_batches(spark)
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
