"""Recommenders: each is fitted on interactions and then scores pairs, or ranks items for all users in one plan."""

from __future__ import annotations

import warnings
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfrank.functions.scalar import keyed_hash
from shelfrank.operators.demographics import Demographics
from shelfrank.operators.factors import FactorRecommender, SgdFactorRecommender
from shelfrank.operators.features import unit_length
from shelfrank.operators.neighbourhood import NeighbourhoodRecommender
from shelfrank.operators.products import blocked_top, dense_places
from shelfrank.operators.ranking import by_maximum, diversified, fused, fused_by_segment, summed, top_n, unseen
from shelfrank.operators.recommender import TOP_K, I, R, Recommender, U, seen_counts
from shelfrank.operators.sampling import numbered, ranked

__all__ = ["Demographics", "FactorRecommender", "NeighbourhoodRecommender", "Recommender", "SgdFactorRecommender"]  # and what is defined here
#: Bytes of a matrix of features by features that is sent to tasks.
GRAM_BYTES = 1 << 28
#: Places of a ranking that are sent to the tasks whole; a place is a key of as many rows as there are users.
SENT_PLACES = 100_000
#: Rows (shares and asked pairs) of the users that a task scores together, and values of their vectors at most.
BLOCK_ROWS, BLOCK_VALUES = 1 << 17, 1 << 24


class RandomRecommender(Recommender):
    """Items without replacement and uniform scores, by hash of user, item and seed."""

    def fit(self, interactions: DataFrame) -> RandomRecommender:
        self.keep("items", numbered(interactions.select(I).distinct(), I))
        row = interactions.agg(F.min(R).alias("lo"), F.max(R).alias("hi"), F.count_distinct(I).alias("n")).first()
        self.numbers = {"low": row["lo"] or 0.0, "high": row["hi"] or 0.0, "items": row["n"]}
        return self

    def _score(self):
        low, high = self.numbers["low"], self.numbers["high"]
        return F.lit(low) + F.lit(high - low) * (keyed_hash([F.col(U), F.col(I)], self.options.get("seed", 42)) / F.lit(float(1 << 52)))

    def predict(self, pairs: DataFrame) -> DataFrame:
        return pairs.select(U, I).withColumn("score", self._score())

    def recommend(self, users: DataFrame, n: int = TOP_K, seen: DataFrame | None = None) -> DataFrame:
        """Each user walks the item numbers modulo a prime by a step of its own: no user meets an item twice."""
        count = self.numbers["items"]
        prime = next(p for p in range(max(count, 2), 2 * max(count, 2) + 1) if all(p % d for d in range(2, int(p**0.5) + 1)))
        seed = self.options.get("seed", 42)
        steps = F.least(F.col("extra") + n + (prime - count), F.lit(prime))
        walk = seen_counts(users, seen).select(U, F.explode(F.sequence(F.lit(0).cast("long"), steps - 1)).alias("step"))
        start, stride = keyed_hash([F.col(U)], seed) % prime, 1 + keyed_hash([F.col(U)], seed + 1) % (prime - 1)
        at = walk.withColumn("position", F.pmod(start + F.col("step") * stride, F.lit(prime)))
        drawn = unseen(at.join(self.tables["items"], "position"), seen)
        first = drawn.withColumn("r", F.row_number().over(Window.partitionBy(U).orderBy("step"))).where(F.col("r") <= n)
        return top_n(first.withColumn("score", self._score()), n)


class PopularityRecommender(Recommender):
    """Items by the sum of their ratings (or their number of rows, for ``consider_ratings=False``)."""

    def fit(self, interactions: DataFrame) -> PopularityRecommender:
        rated = self.options.get("consider_ratings", True) and R in interactions.columns
        self.keep("popularity", interactions.groupBy(I).agg((F.sum(R) if rated else F.count("*").cast("double")).alias("score")))
        return self

    def predict(self, pairs: DataFrame) -> DataFrame:
        return pairs.select(U, I).join(self.tables["popularity"], I, "left").select(U, I, F.coalesce("score", F.lit(0.0)).alias("score"))

    def recommend(self, users: DataFrame, n: int = TOP_K, seen: DataFrame | None = None) -> DataFrame:
        """A user's candidates are the first n plus as many as it has seen, so rows grow with interactions, not with users times items."""
        wanted = seen_counts(users, seen)
        most = wanted.agg(F.max("extra")).first()[0] or 0
        places = self.scratch(self.tables["popularity"].select(I, "score", F.round("score", 9).alias("by")))
        head = ranked(places, [F.desc("by"), F.asc(I)], "place", self.scratch).where(F.col("place") <= n + most).drop("by")
        walk = wanted.select(U, F.explode(F.sequence(F.lit(1), (F.col("extra") + n).cast("int"))).alias("place"))
        head = F.broadcast(head) if n + most <= SENT_PLACES else head
        return top_n(unseen(walk.join(head, "place"), seen), n)


def segment_popularity(interactions: DataFrame, segment_of: DataFrame, rated: bool = True) -> DataFrame:
    """(segment, product_key, score): popularity among a segment's customers."""
    placed = interactions.join(segment_of.select(U, "segment").distinct(), U)
    return placed.groupBy("segment", I).agg((F.sum(R) if rated else F.count("*").cast("double")).alias("score"))


class _Users:
    """Users of one block: their query vectors from their shares and items' places, and the scores that are asked of them."""

    def __init__(self, table: pa.Table, gram: np.ndarray, linear: bool):
        self.linear, dim = linear, len(gram)
        self.users, self.items = (table.column(c).combine_chunks().dictionary_encode() for c in (U, I))
        self.user, self.item = (x.indices.to_numpy().astype(np.int64) for x in (self.users, self.items))
        self.share, self.w = ~table.column("asked").to_numpy(), table.column("w").fill_null(0.0).to_numpy()
        at, values = table.column("at").combine_chunks(), table.column("vector").combine_chunks()
        self.known = at.is_valid().to_numpy(zero_copy_only=False)
        self.row = np.repeat(np.arange(len(self.user)), at.value_lengths().fill_null(0).to_numpy())
        self.at, self.values = at.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy()
        self.d = np.bincount(self.row, self.values * self.values, len(self.user))
        place, w = self.user[self.row] * dim + self.at, self.w[self.row] * self.values
        size = len(self.users.dictionary) * dim
        p = np.bincount(place, w, size).reshape(-1, dim)
        if linear:
            e = np.bincount(place, w * self.d[self.row], size).reshape(-1, dim)
            self.query = np.hstack([p @ gram - e, p])
        else:
            self.query = p @ gram - 2 * p

    def scores(self) -> pa.Table:
        """(customer_key, product_key, score) of each asked pair, once."""
        key = self.user * len(self.items.dictionary) + self.item
        s = np.bincount(self.row, self.query[self.user[self.row], self.at] * self.values, len(key))
        if self.linear:
            second = np.bincount(self.row, self.query[self.user[self.row], self.at + self.query.shape[1] // 2] * self.values, len(key))
            s = s - self.d * second
        mine = np.flatnonzero(self.share)
        mine = mine[np.argsort(key[mine])]
        rows = np.flatnonzero(~self.share)
        rows = rows[np.unique(key[rows], return_index=True)[1]]
        if len(mine) and len(rows):
            spot = mine[np.minimum(np.searchsorted(key[mine], key[rows]), len(mine) - 1)]
            own = np.where(key[spot] == key[rows], self.w[spot], 0.0)
            s[rows] += own * self.d[rows] ** 2 if self.linear else own
        known = self.known & (np.bincount(self.user, self.share, len(self.users.dictionary)) > 0)[self.user]
        score = np.where(known, np.minimum(5.0, 1 + 4 * np.maximum(s, 0.0)), 0.0)
        return pa.table([self.users.take(pa.array(rows)).dictionary_decode(), self.items.take(pa.array(rows)).dictionary_decode(), score[rows]], names=[U, I, "score"])


class ContentRecommender(Recommender):
    """Items like those a user rated: w·S·S, S the likeness of item features without its diagonal, w the shares of ratings.

    ``similarity`` is ``cosine`` (features of unit length f) or ``linear`` (features f as they are); another name counts as
    cosine, with a warning. With G = Σ f fᵀ, D = |f|², p = Σ w f and e = Σ w D f, the score of an item is
    (p·G − e)·f − D (p·f) + w D²: the matrix of items by items is never built. For unit vectors D is 1 and that is
    p·(G − 2I)·f + w; else users have the vector (p·G − e, p) and items (f, −D f), of twice the length. G has the size of
    the features, which the vocabulary bounds.
    """

    def _linear(self) -> bool:
        kind = self.options.get("similarity", "cosine")
        if kind not in ("cosine", "linear"):
            warnings.warn(f"similarity {kind!r} isn't known; cosine is used", stacklevel=3)
        return kind == "linear"

    def fit(self, interactions: DataFrame, features: DataFrame | None = None) -> ContentRecommender:
        """``features`` has (product_key, feature, value)."""
        linear = self._linear()
        features = self.scratch(features)
        unit = self.keep("unit", features.select(I, "feature", "value").where(F.col("value") != 0) if linear else unit_length(features))
        catalogue = self.keep("catalogue", features.select(I).distinct())
        names = sorted(r[0] for r in unit.select("feature").distinct().collect())  # the vocabulary, which max_features bounds
        if len(names) ** 2 * 8 > GRAM_BYTES:
            raise ValueError(f"{len(names)} features; give a smaller max_features")
        self.numbers |= {"items": catalogue.count(), "features": names, "linear": linear}
        none = [F.array().cast(f"array<{t}>") for t in ("int", "double")]
        vectors = catalogue.join(dense_places(unit, I, names), I, "left").select(I, *[F.coalesce(c, e).alias(c) for c, e in zip(("at", "vector"), none, strict=True)])
        vectors = self.keep("vectors", vectors)
        d = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
        # all rows of a user are in one place, where they are summed and shared out
        rated = interactions.select(U, I, R).join(vectors.select(I, d.alias("d")) if linear else catalogue, I)
        pairs = rated.repartition(U).groupBy(U, I).agg(F.sum(R).alias("r"), *([F.max("d").alias("d")] if linear else []))
        total = F.sum("r").over(Window.partitionBy(U))
        shares = pairs.where(F.col(U).isNotNull()).withColumn("w", F.when(total > 0, F.col("r") / total).otherwise(F.col("r")))
        self.keep("shares", shares.select(U, I, "w", *([(F.col("w") * F.col("d") * F.col("d")).alias("own")] if linear else [])))
        self.keep("gram", self._gram(vectors, len(names)))
        return self

    @property
    def _shares(self) -> DataFrame:
        """(customer_key, product_key, w, own): own is what an item's share adds to its own score."""
        shares = self.tables["shares"]
        return shares if "own" in shares.columns else shares.withColumn("own", F.col("w"))

    @staticmethod
    def _gram(vectors: DataFrame, dim: int) -> DataFrame:
        """(place, row) of G, from the items' features, of which each row has its own products."""
        one = vectors.select(F.posexplode("at").alias("n", "a"), "at", "vector").select("a", F.get("vector", F.col("n")).alias("x"), F.explode(F.arrays_zip("at", "vector")).alias("o"))
        found = one.groupBy("a", F.col("o.at").alias("b")).agg(F.sum(F.col("x") * F.col("o.vector")).alias("m"))
        cells = found.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("b", "m"))).alias("has"))
        row = F.transform(F.sequence(F.lit(0), F.lit(max(dim - 1, 0))), lambda i: F.coalesce(F.element_at("has", i), F.lit(0.0)))
        return cells.select(F.col("a").alias("place"), row.alias("row"))

    def _matrix(self) -> np.ndarray:
        """G, whose size the vocabulary bounds."""
        dim = len(self.numbers["features"])
        table, out = self.tables["gram"].toArrow(), np.zeros((dim, dim))
        if table.num_rows:
            out[table.column("place").to_numpy()] = table.column("row").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        return out

    def _met(self, pairs: DataFrame | None = None) -> DataFrame:
        """(block, customer_key, product_key, w, asked, at, vector): each user's shares, and what is asked of it, with items' places.

        All rows of a user are in one block. Items that aren't in the catalogue have no places.
        """
        rows, n = self.tables["shares"].select(U, I, "w", F.lit(False).alias("asked")), self.tables["shares"].count()
        if pairs is not None:
            rows, n = rows.unionByName(pairs.select(U, I, F.lit(None).cast("double").alias("w"), F.lit(True).alias("asked"))), n + pairs.count()
        size = max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(len(self.numbers["features"]), 1)))
        return rows.join(self.tables["vectors"], I, "left").withColumn("block", F.pmod(F.xxhash64(U), F.lit(-(-n // size) or 1)))

    @property
    def _queries(self) -> DataFrame:
        """(customer_key, vector): each user's places times the matrix, all places of it; stored when lists first ask for it."""
        if "queries" not in self.tables:
            sent, linear = self.tables["shares"].sparkSession.sparkContext.broadcast(self._matrix()), self.numbers["linear"]

            def run(table: pa.Table) -> pa.Table:
                own = _Users(table, sent.value, linear)
                ids = own.users.dictionary
                return pa.table([ids, pa.ListArray.from_arrays(np.arange(len(ids) + 1, dtype=np.int32) * own.query.shape[1], own.query.ravel())], names=[U, "vector"])

            self.keep("queries", self._met().groupBy("block").applyInArrow(run, f"{U} {self._kind(U)}, vector array<double>"))
        return self.tables["queries"]

    def _kind(self, column: str) -> str:
        return self.tables["shares"].schema[column].dataType.simpleString()

    @property
    def _cells(self) -> DataFrame:
        """(product_key, at, vector) of items whose products with queries are their scores, besides users' own items."""
        vectors = self.tables["vectors"].where(F.size("at") > 0)
        if not self.numbers["linear"]:
            return vectors
        dim, d = len(self.numbers["features"]), F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
        sized = vectors.withColumn("d", d)
        return sized.select(I, F.concat("at", F.transform("at", lambda i: i + dim)).alias("at"), F.concat("vector", F.transform("vector", lambda x: -F.col("d") * x)).alias("vector"))

    def item_similarities(self, least: float = 1e-12) -> DataFrame:
        """(a, b, sim) of items that share a feature."""
        unit = self.tables["unit"]
        a = unit.select(F.col(I).alias("a"), "feature", F.col("value").alias("x"))
        b = unit.select(F.col(I).alias("b"), "feature", F.col("value").alias("y"))
        return a.join(b, "feature").where("a <> b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("sim")).where(F.abs("sim") > least)

    def nearest_items(self, n: int, least: float = 1e-12) -> DataFrame:
        """(a, rank, b, sim): the n items most like each, of those that share a feature."""
        unit = self.tables["unit"]
        if unit.where(F.col("value") < 0).isEmpty():  # likeness is nowhere under that of items that share nothing
            vectors = self.tables["vectors"].where(F.size("at") > 0)
            own = vectors.select(F.col(I).alias(U), I)
            sims = blocked_top(vectors.withColumnRenamed(I, U), vectors, n, len(self.numbers["features"]), own).where(F.col("score") > least)
        else:
            sims = self.item_similarities(least).select(F.col("a").alias(U), F.col("b").alias(I), F.col("sim").alias("score"))
        return top_n(sims, n).select(F.col(U).alias("a"), "rank", F.col(I).alias("b"), F.col("score").alias("sim"))

    def predict(self, pairs: DataFrame) -> DataFrame:
        """1 + 4 times the score, at most 5 and from a score of 0; 0 for an unknown user or item."""
        sent, linear = pairs.sparkSession.sparkContext.broadcast(self._matrix()), self.numbers["linear"]

        def run(table: pa.Table) -> pa.Table:
            return _Users(table, sent.value, linear).scores()

        blank = F.col(U).isNull() | F.col(I).isNull()
        pairs = pairs.select(U, I)
        found = self._met(pairs.where(~blank)).groupBy("block").applyInArrow(run, f"{U} {self._kind(U)}, {I} {self._kind(I)}, score double")
        return found.unionByName(pairs.where(blank).distinct().withColumn("score", F.lit(0.0)))

    def recommend(self, users: DataFrame, n: int = TOP_K, seen: DataFrame | None = None) -> DataFrame:
        """The n best of the catalogue; users without a profile get the items most like all others, seen ones included."""
        unit = self.tables["unit"]
        items, dim = self._cells, len(self.numbers["features"]) * (2 if self.numbers["linear"] else 1)
        ids = users.select(U).distinct()
        asked = self._queries.join(ids, U, "left_semi").withColumn("at", F.sequence(F.lit(0), F.lit(max(dim - 1, 0))))
        own = self._shares.join(ids, U, "left_semi")
        if seen is None:
            # an item's own share adds to its score, so each user's own items are candidates with it
            found = blocked_top(asked, items, n, dim)
            scored = own.join(self._raw(own), [U, I], "left").select(U, I, (F.col("own") + F.coalesce("s", F.lit(0.0))).alias("score"))
            best = top_n(unseen(found, own).unionByName(scored), n)
        else:
            left = own.join(seen.select(U, I).distinct(), [U, I], "left_anti")
            scored = left.join(self._raw(left), [U, I], "left").select(U, I, (F.col("own") + F.coalesce("s", F.lit(0.0))).alias("score"))
            found = blocked_top(asked, items, n, dim, seen)
            best = top_n(unseen(found, left).unionByName(scored), n)
        strangers = ids.join(self.tables["shares"].select(U).distinct(), U, "left_anti")
        total = unit.groupBy("feature").agg(F.sum("value").alias("t"))
        mean = unit.join(total, "feature").groupBy(I).agg((F.sum(F.col("value") * (F.col("t") - F.col("value"))) / float(self.numbers["items"])).alias("score"))
        head = mean.orderBy(F.desc(F.round("score", 9)), I).limit(n)  # n rows for all users without a profile
        return best.unionByName(top_n(strangers.crossJoin(F.broadcast(head)), n))

    def _raw(self, pairs: DataFrame) -> DataFrame:
        """(customer_key, product_key, s): the inner product of a user's query and an item's features."""
        joined = pairs.select(U, I).join(self._cells, I).join(self._queries.select(U, F.col("vector").alias("query")), U)
        products = F.zip_with("at", "vector", lambda i, x: x * F.get("query", i))
        return joined.select(U, I, F.aggregate(products, F.lit(0.0), lambda s, x: s + x).alias("s"))


class HybridRecommender(Recommender):
    """Weighted components. ``weights`` (by name) are scaled to a sum of one, and again whenever a weight is added."""

    def __init__(self, **options):
        super().__init__(**options)
        self.components: dict[str, Recommender] = {}
        self.weights: dict[str, float] = {}
        self._scale(options.get("weights", {}))

    def _scale(self, weights: dict[str, float]) -> None:
        total = sum(weights.values())
        self.weights = {k: w / total for k, w in weights.items()} if total > 0 else dict(weights)

    def add(self, name: str, model: Recommender, weight: float | None = None) -> HybridRecommender:
        """Adds a component; one that ``weights`` names needs no weight, any other counts one."""
        self.components[name] = model
        if weight is not None or name not in self.weights:
            self._scale(self.weights | {name: 1.0 if weight is None else weight})
        return self

    def fit(self, interactions: DataFrame) -> HybridRecommender:
        if not self.components:
            raise ValueError("no component was added")
        return self

    def predict(self, pairs: DataFrame) -> DataFrame:
        parts = [m.predict(pairs).withColumn("score", F.col("score") * self.weights[k]) for k, m in self.components.items()]
        total = sum(self.weights.values()) or 1.0
        return summed(parts).withColumn("score", F.col("score") / total)

    def lists(self, users: DataFrame, n: int, seen: DataFrame | None) -> dict[str, DataFrame]:
        return {k: m.recommend(users, 2 * n, seen) for k, m in self.components.items()}

    def recommend(self, users: DataFrame, n: int = TOP_K, seen: DataFrame | None = None) -> DataFrame:
        return fused(self.lists(users, n, seen), self.weights, n)

    def recommend_for_segments(self, users: DataFrame, segment_of: DataFrame, segment_weights: dict, n: int = TOP_K, seen: DataFrame | None = None) -> DataFrame:
        return fused_by_segment(self.lists(users, n, seen), segment_of, segment_weights, self.weights, n)

    def write(self, folder: str) -> None:
        """Components go to folders of their own, within the same version."""
        for name, model in self.components.items():
            model.write(f"{folder}/components/{name}")
        self.numbers = {"weights": self.weights}
        super().write(folder)

    def loaded(self, spark: SparkSession, folder: str) -> None:
        self.weights = self.numbers["weights"]
        self.components = {k: Recommender.read(spark, f"{folder}/components/{k}") for k in self.weights}

    @staticmethod
    def restore(spark: SparkSession, path: str) -> HybridRecommender:
        return Recommender.load(spark, path)


class ColdStartRecommender(Recommender):
    """Customers with few interactions: what similar customers and their segment buy, and item content."""

    # Weights of the three lists.
    WEIGHTS = {"demographic": 0.4, "segment": 0.4, "content": 0.2}

    def fit(self, interactions: DataFrame, features: DataFrame | None = None, customers: DataFrame | None = None, segment_of: DataFrame | None = None) -> ColdStartRecommender:
        self.interactions, self.segment_of = interactions, self.scratch(segment_of.groupBy(U).agg(F.min("segment").alias("segment")))
        self.popular = PopularityRecommender().fit(interactions)
        self._parts = {"content": lambda: ContentRecommender().fit(interactions, features), "demographics": lambda: Demographics(customers, self.options.get("fields", ["age_group", "country", "gender"]))}
        self.by_segment = self.scratch(segment_popularity(interactions, self.segment_of))
        return self

    def _part(self, name: str):
        """The content model or the demographic profiles, fitted when they are first asked: segments alone need neither."""
        if callable(self._parts[name]):
            self._parts[name] = self._parts[name]()
        return self._parts[name]

    content = property(lambda self: self._part("content"))
    demographics = property(lambda self: self._part("demographics"))

    def write(self, folder: str) -> None:
        """The content and popularity models go to folders of their own, within the same version."""
        self.content.write(f"{folder}/components/content")
        self.popular.write(f"{folder}/components/popular")
        self.tables = {"interactions": self.interactions, "segment_of": self.segment_of, "by_segment": self.by_segment, "profile_of": self.demographics.profile_of, "traits": self.demographics.traits}
        super().write(folder)

    def loaded(self, spark: SparkSession, folder: str) -> None:
        self.interactions, self.segment_of, self.by_segment = (self.tables[t] for t in ("interactions", "segment_of", "by_segment"))
        content, self.popular = (Recommender.read(spark, f"{folder}/components/{k}") for k in ("content", "popular"))
        self._parts = {"content": content, "demographics": Demographics.of_tables(self.tables["profile_of"], self.tables["traits"])}

    def release(self) -> None:
        super().release()
        for part in (self.popular, *(p for p in self._parts.values() if not callable(p))):
            part.release()

    def _warm(self) -> DataFrame:
        least = self.options.get("min_interactions", 5)
        return self.interactions.groupBy(U).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(U)

    def predict_segment(self, pairs: DataFrame) -> DataFrame:
        """Popularity in the user's segment over the segment's maximum; general popularity without a segment."""
        most = self.by_segment.groupBy("segment").agg(F.max("score").alias("most"))
        shares = self.by_segment.join(F.broadcast(most), "segment").select("segment", I, F.when(F.col("most") > 0, F.col("score") / F.col("most")).otherwise(0.0).alias("share"))
        placed = pairs.select(U, I).distinct().join(self.segment_of, U, "left").join(shares, ["segment", I], "left").join(self.popular.tables["popularity"], I, "left")
        return placed.select(U, I, F.coalesce(F.when(F.col("segment").isNotNull(), F.coalesce("share", F.lit(0.0))).otherwise(F.col("score")), F.lit(0.0)).alias("score"))

    def predict(self, pairs: DataFrame) -> DataFrame:
        """The content score of users with enough interactions; else the mean of the three scores."""
        cold = pairs.join(self._warm(), U, "left_anti")
        # content scores are worked out once for all pairs; those that stand alone count three times
        content = self.content.predict(pairs).join(self._warm().withColumn("__warm", F.lit(3.0)), U, "left")
        content = content.withColumn("score", F.col("score") * F.coalesce("__warm", F.lit(1.0)))
        parts = [self.demographics.predict(cold, self.interactions), self.predict_segment(cold), content]
        return summed(parts).withColumn("score", F.col("score") / 3)

    def recommend_segment(self, users: DataFrame, n: int, seen: DataFrame | None = None) -> DataFrame:
        """The most popular of the user's segment; the most popular of all without one."""
        placed = users.select(U).distinct().join(self.segment_of, U, "left")
        wanted = seen_counts(users, seen).join(self.segment_of, U)
        most = wanted.agg(F.max("extra")).first()[0] or 0
        place = F.row_number().over(Window.partitionBy("segment").orderBy(F.desc(F.round("score", 9)), I))
        head = self.scratch(self.by_segment.withColumn("place", place).where(F.col("place") <= n + most))
        head = F.broadcast(head) if head.count() <= SENT_PLACES else head
        walk = wanted.select(U, "segment", F.explode(F.sequence(F.lit(1), (F.col("extra") + n).cast("int"))).alias("place"))
        own = top_n(unseen(walk.join(head, ["segment", "place"]), seen), n)
        return own.unionByName(self.popular.recommend(placed.where(F.col("segment").isNull()), n, seen))

    def combined(self, users: DataFrame, n: int, seen: DataFrame | None = None) -> DataFrame:
        """2n of each list, scaled by the list's maximum, weighted and summed."""
        lists = {
            "demographic": self.demographics.recommend(users, self.interactions, 2 * n, seen),
            "segment": self.recommend_segment(users, 2 * n, seen),
            "content": self.content.recommend(users, 2 * n, seen),
        }
        parts = [by_maximum(df).withColumn("score", F.col("score") * w) for k, w in self.WEIGHTS.items() for df in [lists[k]]]
        return top_n(summed(parts), 6 * n)

    def recommend(self, users: DataFrame, n: int = TOP_K, seen: DataFrame | None = None, sets: DataFrame | None = None) -> DataFrame:
        """Users with enough interactions get their content list; ``sets`` (product_key, features) diversifies the others'."""
        ids = users.select(U).distinct()
        cold = self.combined(ids.join(self._warm(), U, "left_anti"), n, seen)
        if sets is not None:
            cold = diversified(cold, sets, n, self.options.get("diversity_weight", 0.3))
        return self.content.recommend(ids.join(self._warm(), U, "left_semi"), n, seen).unionByName(cold.where(F.col("rank") <= n))


def all_lists(models: dict[str, Recommender], users: DataFrame, n: int, seen: DataFrame | None = None) -> DataFrame:
    """Every model's lists, with the model's name."""
    parts = [m.recommend(users, n, seen).withColumn("model", F.lit(name)) for name, m in models.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
