"""Factors of users and items: by alternating least squares, or by stochastic gradient descent over a grid of blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrank.functions.scalar import clipped, keyed_hash
from shelfrank.operators.products import blocked_top
from shelfrank.operators.ranking import top_n
from shelfrank.operators.recommender import TOP_K, I, R, Recommender, U
from shelfrank.operators.sampling import numbered
from shelfrank.sources.shared import durable, remove, stored

#: Ratings of a pair of blocks, which one task works through.
BLOCK_RATINGS = 100_000


class FactorRecommender(Recommender):
    """Mean, user and item biases, and factors of what is left, by alternating least squares.

    Biases are sums of deviations over counts plus a damping (10 for items, 15 for users). Keys of any size are numbered for
    the factorisation, which takes numbers of 32 bits.
    """

    ITEM_DAMPING, USER_DAMPING = 10.0, 15.0

    def fit(self, interactions: DataFrame) -> FactorRecommender:
        cells = self.scratch(interactions.groupBy(U, I).agg(F.avg(R).alias("r")))
        row = cells.agg(F.avg("r").alias("mean"), F.min("r").alias("lo"), F.max("r").alias("hi")).first()
        self.numbers = {"mean": row["mean"] or 0.0, "low": row["lo"] or 0.0, "high": row["hi"] or 0.0}
        off = F.col("r") - self.numbers["mean"]
        items = cells.groupBy(I).agg((F.sum(off) / (F.count("*") + self.ITEM_DAMPING)).alias("bi"))
        placed = cells.join(items, I)
        users = placed.groupBy(U).agg((F.sum(off - F.col("bi")) / (F.count("*") + self.USER_DAMPING)).alias("bu"))
        rest = placed.join(users, U).select(U, I, (off - F.col("bi") - F.col("bu")).alias("rest"))
        user_no, item_no = self.scratch(numbered(users.select(U), U, "u")), self.scratch(numbered(items.select(I), I, "i"))
        rest = rest.join(user_no, U).join(item_no, I).select(F.col("u").cast("int"), F.col("i").cast("int"), "rest")
        o = self.options
        als = ALS(rank=o.get("n_factors", 50), maxIter=o.get("n_epochs", 20), regParam=o.get("reg", 0.02), seed=o.get("seed", 42), userCol="u", itemCol="i", ratingCol="rest")
        model = als.fit(rest)
        vector = F.transform("features", lambda x: x.cast("double"))
        self.keep("users", users.join(user_no, U).join(model.userFactors.select(F.col("id").alias("u"), vector.alias("p")), "u").drop("u"))
        self.keep("items", items.join(item_no, I).join(model.itemFactors.select(F.col("id").alias("i"), vector.alias("q")), "i").drop("i"))
        return self

    def predict(self, pairs: DataFrame) -> DataFrame:
        """Within the ratings' bounds; the mean for an unknown user or item."""
        placed = pairs.select(U, I).join(self.tables["users"], U, "left").join(self.tables["items"], I, "left")
        dot = F.aggregate(F.zip_with("p", "q", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        score = clipped(self.numbers["mean"] + F.col("bu") + F.col("bi") + dot, self.numbers["low"], self.numbers["high"])
        return placed.select(U, I, F.coalesce(score, F.lit(self.numbers["mean"])).alias("score"))

    def recommend(self, users: DataFrame, n: int = TOP_K, seen: DataFrame | None = None) -> DataFrame:
        """Users who weren't in the training rows get no list."""
        asked = self.tables["users"].join(users.select(U).distinct(), U).select(U, F.concat("p", F.array(F.lit(1.0))).alias("vector"))
        items = self.tables["items"].select(I, F.concat("q", F.array("bi")).alias("vector"))
        at = F.sequence(F.lit(0), F.size("vector") - 1)
        dim = self.options.get("n_factors", 50) + 1
        best = top_n(blocked_top(asked.withColumn("at", at), items.withColumn("at", at), n, dim, seen), n)
        base = self.numbers["mean"] if self.options.get("biased", True) else 0.0
        score = clipped(F.lit(base) + F.col("bu") + F.col("score"), self.numbers["low"], self.numbers["high"])
        return best.join(self.tables["users"].select(U, "bu"), U).select(U, "rank", I, score.alias("score"))


class SgdFactorRecommender(FactorRecommender):
    """Mean, biases and factors by stochastic gradient descent, all fitted together.

    Users and items are dealt into B blocks each. The B² pairs of blocks make B strata of B pairs that share no user and no
    item; an epoch visits the strata one after another, and the pairs of a stratum are worked through side by side: a
    task gets the factors of one block of users and one of items, and their ratings. Within a pair ratings have turns: of a
    turn no two share a user or an item, so a turn is one vector operation and equals its ratings one by one.

    Options: ``n_factors``, ``n_epochs``, ``lr``, ``reg``, ``biased``, ``seed``, ``blocks`` (by the number of ratings, 4 at
    least). Results depend on the seed and on B, not on the machine. Factors begin as normal draws of deviation 0.1.
    """

    def _option(self, name: str):
        return self.options.get(name, {"n_factors": 50, "n_epochs": 20, "lr": 0.005, "reg": 0.02, "biased": True, "seed": 42}[name])

    def fit(self, interactions: DataFrame) -> SgdFactorRecommender:
        cells = self.scratch(interactions.groupBy(U, I).agg(F.avg(R).alias("r")).where("r is not null"))
        row = cells.agg(F.avg("r").alias("mean"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("n")).first()
        self.numbers = {"mean": row["mean"] or 0.0, "low": row["lo"] or 0.0, "high": row["hi"] or 0.0}
        blocks = self.options.get("blocks") or max(4, int(np.ceil(np.sqrt(row["n"] / BLOCK_RATINGS))))
        self.numbers["blocks"] = blocks
        # a file for each stratum: a stratum reads its own ratings, not all
        stratum_of = F.pmod(F.col("ib") - F.col("ub"), F.lit(blocks)).alias("stratum")
        ratings = stored(self._turns(cells, blocks).select("*", stratum_of), "ratings", ["stratum"])
        state = durable(self._start(cells, blocks))
        for _ in range(self._option("n_epochs")):
            for stratum in range(blocks):
                state = self._stratum(state, ratings, stratum, blocks)
            state = durable(state)  # an epoch is one plan; the next begins with what it wrote
        remove(ratings)
        columns = [F.col("id"), F.col("bias"), F.col("vector")]
        self.keep("users", state.where("kind = 0").select(*[c.alias(n) for c, n in zip(columns, (U, "bu", "p"), strict=True)]))
        self.keep("items", state.where("kind = 1").select(*[c.alias(n) for c, n in zip(columns, (I, "bi", "q"), strict=True)]))
        return self

    def _block(self, key: str, salt: int, blocks: int) -> Column:
        return (keyed_hash([F.col(key)], self._option("seed") + salt) % blocks).cast("int")

    def _turns(self, cells: DataFrame, blocks: int) -> DataFrame:
        """(ub, ib, id, other, value, turn): each rating with its blocks and its turn in their pair, by a keyed hash of the pair."""
        placed = cells.select(
            self._block(U, 1, blocks).alias("ub"), self._block(I, 2, blocks).alias("ib"), F.col(U).alias("id"), F.col(I).alias("other"), F.col("r").alias("value"),
            keyed_hash([F.col(U), F.col(I)], self._option("seed")).alias("h"),
        )

        def deal(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["h", "id", "other"])
            free_user: dict[int, int] = {}
            free_item: dict[int, int] = {}
            turns = []
            for u, i in zip(rows["id"].tolist(), rows["other"].tolist(), strict=True):
                turn = max(free_user.get(u, 0), free_item.get(i, 0))
                turns.append(turn)
                free_user[u] = free_item[i] = turn + 1
            return rows.assign(turn=turns)[["ub", "ib", "id", "other", "value", "turn"]]

        return placed.groupBy("ub", "ib").applyInPandas(deal, "ub int, ib int, id long, other long, value double, turn int")

    def _start(self, cells: DataFrame, blocks: int) -> DataFrame:
        """(kind, block, id, bias, vector) of every user (kind 0) and item (kind 1); draws depend on seed, kind and id alone."""
        users = cells.select(F.lit(0).alias("kind"), self._block(U, 1, blocks).alias("block"), F.col(U).alias("id")).distinct()
        items = cells.select(F.lit(1).alias("kind"), self._block(I, 2, blocks).alias("block"), F.col(I).alias("id")).distinct()
        n, seed = self._option("n_factors"), self._option("seed")

        def drawn(frames):
            for frame in frames:
                vectors = [np.random.default_rng([seed, kind, i & (1 << 64) - 1]).normal(0, 0.1, n) for kind, i in zip(frame["kind"].tolist(), frame["id"].tolist(), strict=True)]
                yield frame.assign(bias=0.0, vector=vectors)

        return users.unionByName(items).mapInPandas(drawn, "kind int, block int, id long, bias double, vector array<double>")

    def _stratum(self, state: DataFrame, ratings: DataFrame, stratum: int, blocks: int) -> DataFrame:
        """The state after all pairs (b, b + stratum) of blocks; a pair meets under the number of its users' block."""
        lr, reg, biased = self._option("lr"), self._option("reg"), self._option("biased")
        mean = self.numbers["mean"] if biased else 0.0
        none = F.lit(None)
        held = state.select(
            F.when(F.col("kind") == 0, F.col("block")).otherwise(F.pmod(F.col("block") - stratum, F.lit(blocks))).alias("meet"),
            "kind", "block", "id", none.cast("long").alias("other"), F.col("bias").alias("value"), "vector", none.cast("int").alias("turn"),
        )
        own = ratings.where(F.col("stratum") == stratum).select(
            F.col("ub").alias("meet"), F.lit(2).alias("kind"), F.col("ub").alias("block"), "id", "other", "value", none.cast("array<double>").alias("vector"), "turn"
        )

        def descend(rows: pd.DataFrame) -> pd.DataFrame:
            ends = [rows[rows["kind"] == k].reset_index(drop=True) for k in (0, 1)]
            given = rows[rows["kind"] == 2].sort_values(["turn", "id"])
            if len(given):
                p, q = (np.stack(e["vector"].to_list()) for e in ends)
                bu, bi = (e["value"].to_numpy().copy() for e in ends)
                u, i = (pd.Index(e["id"]).get_indexer(given[c]) for e, c in zip(ends, ("id", "other"), strict=True))
                r, turn = given["value"].to_numpy(), given["turn"].to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(turn)]
                for a, b in zip(edges, edges[1:], strict=False):
                    x, y = u[a:b], i[a:b]
                    px, qy = p[x], q[y]
                    off = r[a:b] - (mean + bu[x] + bi[y] + (px * qy).sum(1))
                    if biased:
                        bu[x] += lr * (off - reg * bu[x])
                        bi[y] += lr * (off - reg * bi[y])
                    p[x] += lr * (off[:, None] * qy - reg * px)
                    q[y] += lr * (off[:, None] * px - reg * qy)
                ends = [e.assign(value=b, vector=list(v)) for e, b, v in zip(ends, (bu, bi), (p, q), strict=True)]
            out = pd.concat(ends)
            return out.assign(bias=out["value"])[["kind", "block", "id", "bias", "vector"]]

        return held.unionByName(own).groupBy("meet").applyInPandas(descend, "kind int, block int, id long, bias double, vector array<double>")

    def predict(self, pairs: DataFrame) -> DataFrame:
        """Within the ratings' bounds; the mean for an unknown user or item. Without biases the mean isn't added."""
        placed = pairs.select(U, I).join(self.tables["users"], U, "left").join(self.tables["items"], I, "left")
        dot = F.aggregate(F.zip_with("p", "q", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        base = self.numbers["mean"] if self._option("biased") else 0.0
        score = clipped(F.lit(base) + F.col("bu") + F.col("bi") + dot, self.numbers["low"], self.numbers["high"])
        return placed.select(U, I, F.coalesce(score, F.lit(self.numbers["mean"])).alias("score"))
