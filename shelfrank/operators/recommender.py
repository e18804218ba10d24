"""What all recommenders share: fitted tables, lists for all users in one plan, versions on disk."""

from __future__ import annotations

import json
import uuid
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.sources.shared import files, remove, stored

U, I, R = "customer_key", "product_key", "rating"
TOP_K = 10
#: Written last into a saved version; a version without it isn't read.
MARKER = "_COMMITTED"


def seen_counts(users: DataFrame, seen: DataFrame | None) -> DataFrame:
    """``users`` with ``extra``: how many items each has seen."""
    ids = users.select(U).distinct()
    if seen is None:
        return ids.withColumn("extra", F.lit(0).cast("long"))
    counts = seen.groupBy(U).agg(F.count_distinct(I).alias("extra"))
    return ids.join(counts, U, "left").withColumn("extra", F.coalesce("extra", F.lit(0)))


def versions(spark: SparkSession, path: str, committed: bool = True) -> list[str]:
    """Folders of the saved versions, the newest last; only those whose marker is there, unless all are asked for."""
    fs, own = files(spark, path)
    if not fs.exists(own):
        return []
    found = sorted(s.getPath().getName() for s in fs.listStatus(own) if s.isDirectory() and s.getPath().getName().startswith("v"))
    return [f"{path}/{v}" for v in found if not committed or fs.exists(files(spark, f"{path}/{v}/{MARKER}")[1])]


class Recommender:
    """Fitted tables (``tables``) and numbers (``numbers``); subclasses add ``fit``, ``predict`` and ``recommend``."""

    #: All kinds of models by name, for ``load``.
    KINDS: ClassVar[dict[str, type]] = {}

    def __init_subclass__(cls, **options):
        super().__init_subclass__(**options)
        Recommender.KINDS[cls.__name__] = cls

    def __init__(self, **options):
        self.options, self.tables, self.numbers = options, {}, {}
        self._scratch: list[DataFrame] = []

    def fit(self, interactions: DataFrame) -> Recommender:
        raise NotImplementedError

    def predict(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (customer_key, product_key) with a score."""
        raise NotImplementedError

    def recommend(self, users: DataFrame, n: int = TOP_K, seen: DataFrame | None = None) -> DataFrame:
        """The n best items of each of ``users``, without the pairs in ``seen``."""
        raise NotImplementedError

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Adds a fitted table; it is written to the shared folder and stays there until ``release``."""
        self.tables[name] = self.scratch(df)
        return self.tables[name]

    def scratch(self, df: DataFrame) -> DataFrame:
        """A table that is read more than once and stays until ``release``, but isn't part of the model."""
        self._scratch.append(stored(df, "model"))
        return self._scratch[-1]

    def release(self) -> None:
        """Removes what the model has written for itself; it can't be asked after that, but what was saved can be loaded."""
        for df in self._scratch:
            remove(df)
        self._scratch = []

    def save(self, path: str, keep: int = 2) -> str:
        """Writes a new version under ``path`` and returns its folder.

        Nothing that is there is changed until the new version is whole; then its marker is written, and of older versions
        the last ``keep - 1`` whole ones stay for those who still read them. A save that stops half-way leaves the version
        before as the one that is loaded; its remains go with the next save.
        """
        spark = SparkSession.active()
        last = max((int(v.rsplit("/v", 1)[1].split("-")[0]) for v in versions(spark, path, False)), default=0)
        folder = f"{path}/v{last + 1:08d}-{uuid.uuid4().hex[:8]}"
        self.write(folder)
        fs, marker = files(spark, f"{folder}/{MARKER}")
        fs.create(marker, False).close()
        stay = versions(spark, path)[-keep:]
        for old in versions(spark, path, False):
            if old not in stay and old < folder:
                fs.delete(files(spark, old)[1], True)
        return folder

    def write(self, folder: str) -> None:
        """Each table as Parquet, options and numbers as one JSON row, into a folder that isn't there yet."""
        for name, df in self.tables.items():
            df.write.parquet(f"{folder}/tables/{name}")
        meta = json.dumps({"kind": type(self).__name__, "options": self.options, "numbers": self.numbers, "tables": sorted(self.tables)})
        SparkSession.active().createDataFrame([(meta,)], "meta string").coalesce(1).write.text(f"{folder}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Recommender:
        """The newest whole version under ``path``."""
        found = versions(spark, path)
        if not found:
            raise FileNotFoundError(f"no saved model in {path}")
        return Recommender.read(spark, found[-1])

    @staticmethod
    def read(spark: SparkSession, folder: str) -> Recommender:
        meta = json.loads(spark.read.text(f"{folder}/meta").first()[0])
        out = Recommender.KINDS[meta["kind"]](**meta["options"])
        out.numbers = meta["numbers"]
        out.tables = {t: spark.read.parquet(f"{folder}/tables/{t}") for t in meta["tables"]}
        out.loaded(spark, folder)
        return out

    def loaded(self, spark: SparkSession, folder: str) -> None:
        """What a model with parts reads beside its own tables."""
