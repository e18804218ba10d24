"""Queries on models: every user's list, or the score of every held-out pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.operators import features as f
from shelfrank.operators import models as m
from shelfrank.operators import prepare
from shelfrank.operators.features import STOP_WORDS
from shelfrank.operators.ranking import diversified, top_n
from shelfrank.plans.base import HALVES, INTER, I, U, halves, inter, region_customers, rounded, segments_of, sql_hash
from shelfrank.sources.catalog import Orders
from shelfrank.sources.shared import new_folder

N, K, CLOSE = 10, 30, 0.15
#: Content features: words of the description, categories, numbers.
MAX_FEATURES, MIN_DF, MAX_DF = 100, 0.01, 0.95
SEGMENT_WEIGHTS = {"BUILDING": {"popularity": 0.8, "content": 0.2}, "MACHINERY": {"popularity": 0.1, "content": 0.9}}
HYBRID = {"popularity": 0.7, "content": 0.3}


def described(spark, sf) -> DataFrame:
    return prepare.products(Orders(spark, sf).raw_products()).select(I, "product_description", "category", "sub_category", "cost")


def item_features(spark, sf) -> DataFrame:
    words = {"max_features": MAX_FEATURES, "min_df": MIN_DF, "max_df": MAX_DF}
    return f.item_features(described(spark, sf), ["product_description"], ["category", "sub_category"], ["cost"], **words)


def names(lists: DataFrame, spark, sf) -> DataFrame:
    products = Orders(spark, sf).table("part").select(F.col("p_partkey").alias(I), F.col("p_name").alias("product_name"))
    return lists.join(products, I, "left").withColumn("product_name", F.coalesce("product_name", F.lit("Unknown")))


def content(spark, sf, df) -> m.ContentRecommender:
    return m.ContentRecommender().fit(df, item_features(spark, sf))


def content_lists(spark, sf, n=N) -> DataFrame:
    df = inter(spark, sf)
    return content(spark, sf, df).recommend(df, n, df)


def popularity_lists(spark, sf, n=N) -> DataFrame:
    df = inter(spark, sf)
    return m.PopularityRecommender().fit(df).recommend(df, n, df)


def segment_lists(spark, sf) -> DataFrame:
    lists = top_n(m.segment_popularity(inter(spark, sf), segments_of(spark, sf)), N, "segment")
    return rounded(names(lists, spark, sf))


def neighbours(user_based: bool, similarity: str = "cosine"):
    """The ten most similar of each user or item among those that share a cell."""
    def run(spark, sf):
        return rounded(m.NeighbourhoodRecommender(user_based=user_based, similarity=similarity, k=N).fit(inter(spark, sf)).index())

    return run


def predicted(user_based: bool):
    """The score of every pair of the test half, from the training half."""
    def run(spark, sf):
        train, test = halves(spark, sf)
        return rounded(m.NeighbourhoodRecommender(user_based=user_based, k=K).fit(train).predict(test))

    return run


def neighbour_lists(user_based: bool):
    """The ten best unseen items of every user, by the index of the k nearest."""
    def run(spark, sf):
        df = inter(spark, sf)
        return rounded(m.NeighbourhoodRecommender(user_based=user_based, k=K).fit(df).recommend(df, N, df))

    return run


def close_items(spark, sf) -> DataFrame:
    """All pairs of items from a cosine on, pruned by bounds before they are summed."""
    return rounded(m.NeighbourhoodRecommender(user_based=False, min_similarity=CLOSE).fit(inter(spark, sf)).ordered_similarities())


def content_similar(spark, sf) -> DataFrame:
    return rounded(content(spark, sf, inter(spark, sf)).nearest_items(N))


def linear(spark, sf, df) -> m.ContentRecommender:
    return m.ContentRecommender(similarity="linear").fit(df, item_features(spark, sf))


def linear_lists(spark, sf) -> DataFrame:
    df = inter(spark, sf)
    return rounded(linear(spark, sf, df).recommend(df, N, df))


def linear_similar(spark, sf) -> DataFrame:
    return rounded(linear(spark, sf, inter(spark, sf)).nearest_items(N))


def linear_predicted(spark, sf) -> DataFrame:
    train, test = halves(spark, sf)
    return rounded(linear(spark, sf, train).predict(test))


def content_predicted(spark, sf) -> DataFrame:
    train, test = halves(spark, sf)
    return rounded(content(spark, sf, train).predict(test))


def loaded_predicted(spark, sf) -> DataFrame:
    """Scores by a model that was saved and is read back."""
    train, test = halves(spark, sf)
    content(spark, sf, train).save(path := new_folder(spark, "model"))
    return rounded(m.Recommender.load(spark, path).predict(test))


def demographics(spark, sf) -> m.Demographics:
    customers = region_customers(spark, sf).join(segments_of(spark, sf), U)
    return m.Demographics(customers, ["country", "segment"])


def demographic_lists(spark, sf) -> DataFrame:
    df = inter(spark, sf)
    return rounded(demographics(spark, sf).recommend(df, df, N, df))


def numeric_demographics(spark, sf) -> m.Demographics:
    """Country, segment and account balance."""
    balance = Orders(spark, sf).table("customer").select(F.col("c_custkey").alias(U), F.col("c_acctbal").alias("balance"))
    customers = region_customers(spark, sf).join(segments_of(spark, sf), U).join(balance, U)
    return m.Demographics(customers, ["country", "segment", "balance"])


def numeric_demographic_lists(spark, sf) -> DataFrame:
    df = inter(spark, sf)
    return rounded(numeric_demographics(spark, sf).recommend(df, df, N, df))


def numeric_demographic_predicted(spark, sf) -> DataFrame:
    train, test = halves(spark, sf)
    return rounded(numeric_demographics(spark, sf).predict(test, train))


def demographic_predicted(spark, sf) -> DataFrame:
    train, test = halves(spark, sf)
    return rounded(demographics(spark, sf).predict(test, train))


def cold(spark, sf, df, least: int) -> m.ColdStartRecommender:
    customers = region_customers(spark, sf).join(segments_of(spark, sf), U)
    return m.ColdStartRecommender(fields=["country", "segment"], min_interactions=least).fit(df, item_features(spark, sf), customers, segments_of(spark, sf))


def cold_combined(spark, sf) -> DataFrame:
    """The combined list of every user, before the choice between cold and warm."""
    df = inter(spark, sf)
    return rounded(cold(spark, sf, df, 5).combined(df.select(U), N, df).where(F.col("rank") <= N))


def cold_lists(spark, sf) -> DataFrame:
    """Users with under 40 interactions are cold here; theirs are diversified by category."""
    df = inter(spark, sf)
    sets = f.feature_sets(described(spark, sf), ["category", "sub_category"])
    return rounded(cold(spark, sf, df, 40).recommend(df.select(U), N, df, sets))


def cold_predicted(spark, sf) -> DataFrame:
    """Every pair of the test half; users with under 40 training rows are cold here."""
    train, test = halves(spark, sf)
    return rounded(cold(spark, sf, train, 40).predict(test))


def segment_predicted(spark, sf) -> DataFrame:
    train, test = halves(spark, sf)
    return rounded(cold(spark, sf, train, 5).predict_segment(test))


def hybrid_predicted(spark, sf) -> DataFrame:
    train, test = halves(spark, sf)
    return rounded(hybrid_model(spark, sf, train).predict(test))


def hybrid_model(spark, sf, df) -> m.HybridRecommender:
    out = m.HybridRecommender(weights=HYBRID)
    return out.add("popularity", m.PopularityRecommender().fit(df)).add("content", content(spark, sf, df))


def hybrid(spark, sf) -> DataFrame:
    df = inter(spark, sf)
    return rounded(hybrid_model(spark, sf, df).recommend(df, N, df))


def hybrid_by_segment(spark, sf) -> DataFrame:
    df = inter(spark, sf)
    return rounded(hybrid_model(spark, sf, df).recommend_for_segments(df, segments_of(spark, sf), SEGMENT_WEIGHTS, N, df))


def factors(spark, sf) -> DataFrame:
    df = inter(spark, sf)
    return rounded(m.FactorRecommender(n_factors=20, n_epochs=10).fit(df).recommend(df, N, df))


def descended(spark, sf) -> DataFrame:
    df = inter(spark, sf)
    return rounded(m.SgdFactorRecommender(n_factors=8, n_epochs=2, lr=0.02).fit(df).recommend(df, N, df))


def drawn(spark, sf) -> DataFrame:
    df = inter(spark, sf)
    return rounded(m.RandomRecommender().fit(df).recommend(df, N, df))


def reranked(spark, sf) -> DataFrame:
    """Twice as many of the popular items, diversified."""
    sets = f.feature_sets(described(spark, sf), ["category", "sub_category"])
    return rounded(diversified(popularity_lists(spark, sf, 2 * N), sets, N))


QUERIES = {
    "popularity_scores": lambda s, d: rounded(m.PopularityRecommender().fit(inter(s, d)).tables["popularity"]),
    "popularity_topn": lambda s, d: rounded(m.PopularityRecommender().fit(df := inter(s, d)).recommend(df, N)),
    "popularity_topn_unseen": lambda s, d: rounded(popularity_lists(s, d)),
    "segment_popularity_topn": segment_lists,
    "user_neighbours": neighbours(True),
    "user_jaccard_neighbours": neighbours(True, "jaccard"),
    "item_neighbours": neighbours(False),
    "item_pearson_neighbours": neighbours(False, "pearson"),
    "item_jaccard_neighbours": neighbours(False, "jaccard"),
    "knn_user_predict": predicted(True),
    "knn_item_predict": predicted(False),
    "knn_item_topn": neighbour_lists(False),
    "knn_user_topn": neighbour_lists(True),
    "item_neighbours_above": close_items,
    "tfidf": lambda s, d: rounded(f.tf_idf(described(s, d), I, "product_description", MAX_FEATURES, MIN_DF, MAX_DF)),
    "item_features": lambda s, d: rounded(item_features(s, d)),
    "content_similarity": content_similar,
    "content_topn": lambda s, d: rounded(content_lists(s, d)),
    "content_predict": content_predicted,
    "loaded_predict": loaded_predicted,
    "demographic_similarity": lambda s, d: rounded(demographics(s, d).similarities()),
    "demographic_topn": demographic_lists,
    "content_linear_similarity": linear_similar,
    "content_linear_topn": linear_lists,
    "content_linear_predict": linear_predicted,
    "demographic_numeric_topn": numeric_demographic_lists,
    "demographic_numeric_predict": numeric_demographic_predicted,
    "demographic_predict": demographic_predicted,
    "coldstart_combine": cold_combined,
    "coldstart_topn": cold_lists,
    "coldstart_predict": cold_predicted,
    "segment_predict": segment_predicted,
    "hybrid_predict": hybrid_predicted,
    "hybrid_fusion": hybrid,
    "hybrid_segment_fusion": hybrid_by_segment,
    "als_topn": factors,
    "sgd_topn": descended,
    "random_topn": drawn,
    "mmr_rerank": reranked,
}

RANK = "row_number() OVER (PARTITION BY customer_key ORDER BY round(score, 9) DESC, product_key)"


def top(source: str, n: int, name: str = "best", where: str = "") -> str:
    return f"{name} AS MATERIALIZED (SELECT * FROM (SELECT *, CAST({RANK} AS INT) AS rank FROM {source} {where}) WHERE rank <= {n})"


def lists(name: str = "best") -> str:
    return f"SELECT customer_key, rank, product_key, round(score, 6) AS score FROM {name}"


def popular(rows: str, n: int, seen: bool, name: str = "popular", users: str = "inter") -> str:
    not_seen = f"WHERE NOT EXISTS (SELECT 1 FROM {rows} s WHERE s.customer_key = us.customer_key AND s.product_key = pop.product_key)" if seen else ""
    scored = f"(SELECT us.customer_key, pop.product_key, score FROM (SELECT DISTINCT customer_key FROM {users}) us CROSS JOIN pop {not_seen})"
    return f"pop AS MATERIALIZED (SELECT product_key, sum(rating) AS score FROM {rows} GROUP BY 1), {top(scored, n, name)}"


SEEN = "NOT EXISTS (SELECT 1 FROM inter s WHERE s.customer_key = x.customer_key AND s.product_key = x.product_key)"


STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
TFIDF = f"""texts AS (SELECT p_partkey AS product_key, coalesce(p_name, '') || ' ' || coalesce(p_type, '') || ' ' || coalesce(p_brand, '') AS t FROM part),
tf AS (SELECT product_key, feature, count(*) AS tf FROM (SELECT product_key, unnest(regexp_extract_all(lower(t), '\\b\\w\\w+\\b')) AS feature FROM texts) WHERE feature NOT IN ({STOP}) GROUP BY 1, 2),
idf AS (SELECT feature, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1 HAVING count(*) BETWEEN {MIN_DF} * (SELECT count(*) FROM part) AND {MAX_DF} * (SELECT count(*) FROM part) ORDER BY total DESC, feature LIMIT {MAX_FEATURES}),
weighed AS (SELECT product_key, feature, tf * (ln((1.0 + (SELECT count(*) FROM part)) / (1 + df)) + 1) AS value FROM tf JOIN idf USING (feature)),
tfidf AS (SELECT product_key, feature, value / sqrt(sum(value * value) OVER (PARTITION BY product_key)) AS value FROM weighed)"""
FEATURES = f"""{TFIDF},
cost AS (SELECT p_partkey AS product_key, p_retailprice AS c, min(p_retailprice) OVER () AS lo, max(p_retailprice) OVER () AS hi FROM part),
feats AS (SELECT * FROM (SELECT product_key, 'product_description:' || feature AS feature, value FROM tfidf
 UNION ALL SELECT p_partkey, 'category_' || p_type, 1.0 FROM part WHERE p_type IS NOT NULL UNION ALL SELECT p_partkey, 'sub_category_' || p_brand, 1.0 FROM part WHERE p_brand IS NOT NULL
 UNION ALL SELECT product_key, 'cost', CASE WHEN hi > lo THEN (c - lo) / (hi - lo) ELSE 0.5 END FROM cost) WHERE value <> 0)"""
UNIT = f"{FEATURES}, unit AS MATERIALIZED (SELECT product_key, feature, value / sqrt(sum(value * value) OVER (PARTITION BY product_key)) AS value FROM feats)"


def content_scores(rows: str, unit: str = UNIT) -> str:
    """Scores of all users and items: shares times the squared similarities, which go through the features."""
    return f"""{unit},
gram AS (SELECT a.feature AS f, b.feature AS g, sum(a.value * b.value) AS m FROM unit a JOIN unit b USING (product_key) GROUP BY 1, 2),
turned AS (SELECT product_key, g, sum(value * m) AS t FROM unit JOIN gram ON feature = f GROUP BY 1, 2),
lessened AS (SELECT product_key, g, sum(t) AS t FROM (SELECT product_key, g, t FROM turned UNION ALL SELECT product_key, feature, -2 * value FROM unit) GROUP BY 1, 2),
square AS MATERIALIZED (SELECT a.product_key AS i, b.product_key AS j, sum(a.t * b.value) + CASE WHEN a.product_key = b.product_key THEN 1 ELSE 0 END AS s2 FROM lessened a JOIN unit b ON a.g = b.feature GROUP BY 1, 2),
shares AS (SELECT customer_key, product_key, r / sum(r) OVER (PARTITION BY customer_key) AS w FROM (SELECT customer_key, product_key, sum(rating) AS r FROM {rows} GROUP BY 1, 2) WHERE product_key IN (SELECT product_key FROM unit)),
scores AS MATERIALIZED (SELECT customer_key, j AS product_key, sum(w * s2) AS score FROM shares JOIN square ON product_key = i GROUP BY 1, 2)"""


#: The linear kernel: the same plan over features as they are.
RAW = f"{FEATURES}, unit AS MATERIALIZED (SELECT product_key, feature, value FROM feats)"


def linear_scores(rows: str) -> str:
    """Scores by the linear kernel, worked out as shares times the likeness without its diagonal, twice."""
    return f"""{RAW},
shares AS (SELECT customer_key, product_key, r / sum(r) OVER (PARTITION BY customer_key) AS w FROM (SELECT customer_key, product_key, sum(rating) AS r FROM {rows} GROUP BY 1, 2) WHERE product_key IN (SELECT product_key FROM unit)),
sizes AS (SELECT product_key, sum(value * value) AS d FROM unit GROUP BY 1),
profile AS MATERIALIZED (SELECT customer_key, feature, sum(w * value) AS p FROM shares JOIN unit USING (product_key) GROUP BY 1, 2),
once AS MATERIALIZED (SELECT customer_key, product_key, sum(p * value) AS s FROM profile JOIN unit USING (feature) GROUP BY 1, 2),
half AS MATERIALIZED (SELECT customer_key, product_key, s - coalesce(w * d, 0) AS s FROM once LEFT JOIN shares USING (customer_key, product_key) JOIN sizes USING (product_key)),
back AS MATERIALIZED (SELECT customer_key, feature, sum(s * value) AS p FROM half JOIN unit USING (product_key) GROUP BY 1, 2),
twice AS MATERIALIZED (SELECT customer_key, product_key, sum(p * value) AS s FROM back JOIN unit USING (feature) GROUP BY 1, 2),
scores AS MATERIALIZED (SELECT customer_key, product_key, t.s - h.s * d AS score FROM twice t JOIN half h USING (customer_key, product_key) JOIN sizes USING (product_key))"""


def _stats(cells: str, users: bool, centre: bool) -> str:
    key = "customer_key" if users else "product_key"
    other = "product_key" if users else "customer_key"
    mean = f"sum(value) / (SELECT count(DISTINCT {other}) FROM {cells})" if centre else "0.0"
    n = f"(SELECT count(DISTINCT {other}) FROM {cells})"
    return f"stats AS (SELECT id, mean, sqrt(greatest(q - {n} * mean * mean, 0)) AS norm FROM (SELECT {key} AS id, {mean} AS mean, sum(value * value) AS q FROM {cells} GROUP BY 1))"


def similar(users: bool, kind: str) -> str:
    """``sims`` (a, b, sim) of pairs that share a cell of ``cells``."""
    key, other = ("customer_key", "product_key") if users else ("product_key", "customer_key")
    n = f"(SELECT count(DISTINCT {other}) FROM cells)"
    if kind == "jaccard":
        above = " JOIN means USING (customer_key) WHERE value > mean" if users else ""
        means = f"means AS (SELECT customer_key, sum(value) / {n} AS mean FROM cells GROUP BY 1), " if users else ""
        return f"""{means}has AS MATERIALIZED (SELECT {key} AS id, {other} AS o FROM cells{above}), sizes AS (SELECT id, count(*) AS n FROM has GROUP BY 1),
dots AS (SELECT a.id AS a, b.id AS b, CAST(count(*) AS DOUBLE) AS dot FROM has a JOIN has b USING (o) WHERE a.id <> b.id GROUP BY 1, 2),
sims AS (SELECT a, b, dot / (x.n + y.n - dot) AS sim FROM dots JOIN sizes x ON a = x.id JOIN sizes y ON b = y.id)"""
    return f"""{_stats('cells', users, users or kind == 'pearson')},
dots AS MATERIALIZED (SELECT a.{key} AS a, b.{key} AS b, sum(a.value * b.value) AS dot FROM cells a JOIN cells b USING ({other}) WHERE a.{key} <> b.{key} GROUP BY 1, 2),
sims AS (SELECT a, b, (dot - {n} * x.mean * y.mean) / (CASE WHEN x.norm > 0 THEN x.norm ELSE 1e-10 END * CASE WHEN y.norm > 0 THEN y.norm ELSE 1e-10 END) AS sim FROM dots JOIN stats x ON a = x.id JOIN stats y ON b = y.id)"""


def _neighbours(users: bool, kind: str = "cosine") -> str:
    return f"""WITH {INTER}, cells AS MATERIALIZED (SELECT customer_key, product_key, rating AS value FROM inter WHERE rating <> 0), {similar(users, kind)}
SELECT a, rank, b, round(sim, 6) AS sim FROM (SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) AS INT) AS rank FROM sims) WHERE rank <= {N}"""


def _predict(users: bool) -> str:
    cells = "cells AS MATERIALIZED (SELECT customer_key, product_key, rating AS value FROM train WHERE rating <> 0)"
    n = "(SELECT count(DISTINCT product_key) FROM cells)"
    means = f"umeans AS (SELECT customer_key, sum(value) / {n} AS m FROM cells GROUP BY 1)"
    if users:
        met = f"""met AS (SELECT t.customer_key, t.product_key, c.customer_key AS other, c.value - m.m AS r,
 (coalesce(dot, 0) - {n} * x.mean * y.mean) / (CASE WHEN x.norm > 0 THEN x.norm ELSE 1e-10 END * CASE WHEN y.norm > 0 THEN y.norm ELSE 1e-10 END) AS sim
 FROM test t JOIN cells c ON t.product_key = c.product_key AND t.customer_key <> c.customer_key JOIN umeans m ON m.customer_key = c.customer_key
 JOIN stats x ON x.id = t.customer_key JOIN stats y ON y.id = c.customer_key LEFT JOIN dots ON a = t.customer_key AND b = c.customer_key)"""
        guess = "CASE WHEN n >= 1 AND abs(weight) > 1e-12 THEN greatest(least(m + total / weight, 5), 1) ELSE m END"
    else:
        met = """met AS (SELECT t.customer_key, t.product_key, c.product_key AS other, c.value AS r, coalesce(sim, 0) AS sim
 FROM test t JOIN cells c ON t.customer_key = c.customer_key AND t.product_key <> c.product_key JOIN (SELECT DISTINCT product_key FROM cells) k ON k.product_key = t.product_key
 LEFT JOIN sims ON a = t.product_key AND b = c.product_key)"""
        guess = "CASE WHEN t.product_key NOT IN (SELECT product_key FROM cells) THEN m WHEN n >= 1 AND abs(weight) > 1e-12 THEN greatest(least(total / weight, 5), 1) ELSE 0 END"
    return f"""WITH {HALVES}, {cells}, {means}, {similar(users, 'cosine')}, {met},
near AS (SELECT *, row_number() OVER (PARTITION BY customer_key, product_key ORDER BY round(sim, 9) DESC, other) AS r9 FROM met),
pooled AS (SELECT customer_key, product_key, count(*) AS n, sum(sim) AS weight, sum(sim * r) AS total FROM near WHERE r9 <= {K} GROUP BY 1, 2)
SELECT t.customer_key, t.product_key, round(coalesce({guess}, 0), 6) AS score
FROM test t LEFT JOIN pooled USING (customer_key, product_key) LEFT JOIN umeans USING (customer_key)"""


def _neighbour_lists(users: bool) -> str:
    """Lists by each row's k nearest; a user's own items are seen."""
    cells = "cells AS MATERIALIZED (SELECT customer_key, product_key, rating AS value FROM inter WHERE rating <> 0)"
    index = f"near AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) AS r FROM sims) WHERE r <= {K})"
    if users:
        means = "umeans AS (SELECT customer_key, sum(value) / (SELECT count(DISTINCT product_key) FROM cells) AS m FROM cells GROUP BY 1)"
        met = "met AS (SELECT n.a AS customer_key, c.product_key, sim, c.value - x.m AS r FROM near n JOIN cells c ON c.customer_key = n.b JOIN umeans x ON x.customer_key = n.b)"
        score, join = "greatest(least(m + total / weight, 5), 1)", "JOIN umeans USING (customer_key)"
    else:
        means, met = "one AS (SELECT 1)", "met AS (SELECT c.customer_key, n.b AS product_key, sim, c.value AS r FROM cells c JOIN near n ON n.a = c.product_key)"
        score, join = "greatest(least(total / weight, 5), 1)", ""
    return f"""WITH {INTER}, {cells}, {means}, {similar(users, 'cosine')}, {index}, {met},
pooled AS (SELECT customer_key, product_key, count(*) AS n, sum(sim) AS weight, sum(sim * r) AS total FROM met GROUP BY 1, 2),
scored AS (SELECT customer_key, product_key, {score} AS score FROM pooled x {join} WHERE abs(weight) > 1e-12 AND {SEEN}),
{top('scored', N)} {lists()}"""


PROFILES = """people AS (SELECT c_custkey AS customer_key, r_name AS country, c_mktsegment AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
kinds AS (SELECT DISTINCT country, segment FROM people),
alike AS (SELECT a.country, a.segment, b.country AS country2, b.segment AS segment2, (CAST(a.country = b.country AS INT) + CAST(a.segment = b.segment AS INT)) / sqrt(2.0 * 2.0) AS sim FROM kinds a CROSS JOIN kinds b)"""
DEMOGRAPHIC = f"""{PROFILES},
pairs AS (SELECT a.customer_key, b.customer_key AS other, sim, row_number() OVER (PARTITION BY a.customer_key ORDER BY round(sim, 9) DESC, b.customer_key) AS r
 FROM people a JOIN alike USING (country, segment) JOIN people b ON b.country = country2 AND b.segment = segment2 WHERE a.customer_key <> b.customer_key AND a.customer_key IN (SELECT customer_key FROM inter)),
demo AS (SELECT p.customer_key, i.product_key, sum(sim) AS score FROM pairs p JOIN inter i ON i.customer_key = p.other WHERE r <= 49
 AND NOT EXISTS (SELECT 1 FROM inter s WHERE s.customer_key = p.customer_key AND s.product_key = i.product_key) GROUP BY 1, 2)"""


MIXED = """people AS (SELECT c_custkey AS customer_key, r_name AS country, c_mktsegment AS segment, (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) AS x
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
mixed AS MATERIALIZED (SELECT *, sqrt(2 + x * x) AS norm FROM people)"""
MIXED_SIM = "(CAST(a.country = b.country AS INT) + CAST(a.segment = b.segment AS INT) + a.x * b.x) / (a.norm * b.norm)"
NUMERIC = f"""{MIXED},
pairs AS (SELECT a.customer_key, b.customer_key AS other, {MIXED_SIM} AS sim FROM mixed a JOIN mixed b ON a.customer_key <> b.customer_key WHERE a.customer_key IN (SELECT customer_key FROM inter)),
near AS (SELECT *, row_number() OVER (PARTITION BY customer_key ORDER BY round(sim, 9) DESC, other) AS r FROM pairs),
demo AS (SELECT p.customer_key, i.product_key, sum(sim) AS score FROM near p JOIN inter i ON i.customer_key = p.other WHERE r <= 49
 AND NOT EXISTS (SELECT 1 FROM inter s WHERE s.customer_key = p.customer_key AND s.product_key = i.product_key) GROUP BY 1, 2)"""


def _profile(country: str, segment: str) -> str:
    return f"'{{\"country\":\"' || {country} || '\",\"segment\":\"' || {segment} || '\"}}'"


def _hybrid(weights: str, joins: str = "") -> str:
    both = "(SELECT *, 'popularity' AS part FROM popular UNION ALL SELECT customer_key, product_key, score, rank, 'content' AS part FROM content)"
    return f"""WITH {INTER}, {popular('inter', 2 * N, True)}, {content_scores('inter')}, {top('scores x', 2 * N, 'content', f'WHERE {SEEN}')},
spread AS (SELECT *, min(score) OVER (PARTITION BY customer_key, part) AS lo, max(score) OVER (PARTITION BY customer_key, part) AS hi FROM {both}),
scaled AS (SELECT customer_key, product_key, part, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END AS v FROM spread),
total AS (SELECT customer_key, product_key, sum(v * {weights}) AS score FROM scaled {joins} GROUP BY 1, 2), {top('total', N)}
{lists()}"""


_W = "CASE part WHEN 'popularity' THEN {popularity} ELSE {content} END"
_BY_SEGMENT = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN {_W.format(**w)}" for k, w in SEGMENT_WEIGHTS.items()) + f" ELSE {_W.format(**HYBRID)} END"

CONTENT_GUESS = """cguess AS (SELECT t.customer_key, t.product_key,
 CASE WHEN t.customer_key IN (SELECT customer_key FROM shares) AND t.product_key IN (SELECT product_key FROM unit) THEN least(5, 1 + 4 * greatest(0, coalesce(score, 0))) ELSE 0 END AS score
 FROM test t LEFT JOIN scores USING (customer_key, product_key))"""
DEMOGRAPHIC_MEAN = """dmean AS MATERIALIZED (SELECT t.customer_key, t.product_key, avg(sim) AS score FROM test t JOIN (SELECT DISTINCT customer_key, product_key FROM train) b ON b.product_key = t.product_key
 JOIN people x ON x.customer_key = t.customer_key JOIN people y ON y.customer_key = b.customer_key JOIN alike a ON a.country = x.country AND a.segment = x.segment AND a.country2 = y.country AND a.segment2 = y.segment GROUP BY 1, 2)"""
SEGMENT_GUESS = """spop AS (SELECT c_mktsegment AS segment, product_key, sum(rating) AS score FROM train JOIN customer ON customer_key = c_custkey WHERE c_mktsegment <> '' GROUP BY 1, 2),
sshare AS (SELECT segment, product_key, CASE WHEN max(score) OVER (PARTITION BY segment) > 0 THEN score / max(score) OVER (PARTITION BY segment) ELSE 0 END AS share FROM spop),
apop AS (SELECT product_key, sum(rating) AS score FROM train GROUP BY 1),
sguess AS (SELECT t.customer_key, t.product_key, coalesce(CASE WHEN c_mktsegment <> '' THEN coalesce(share, 0) ELSE a.score END, 0) AS score
 FROM test t LEFT JOIN customer ON c_custkey = t.customer_key LEFT JOIN sshare s ON s.segment = c_mktsegment AND s.product_key = t.product_key LEFT JOIN apop a ON a.product_key = t.product_key)"""
COMBINED = f"""{INTER}, {DEMOGRAPHIC}, {top('demo', 2 * N, 'd')},
segpop AS (SELECT c_mktsegment AS segment, product_key, sum(rating) AS score FROM inter JOIN customer ON customer_key = c_custkey GROUP BY 1, 2),
seg AS (SELECT customer_key, x.product_key, x.score FROM people JOIN (SELECT DISTINCT customer_key FROM inter) USING (customer_key) JOIN segpop x USING (segment)),
{top('seg x', 2 * N, 's', f'WHERE {SEEN}')}, {content_scores('inter')}, {top('scores x', 2 * N, 'c', f'WHERE {SEEN}')},
mixed AS (SELECT customer_key, product_key, score, 0.4 AS w, 'd' AS part FROM d UNION ALL SELECT customer_key, product_key, score, 0.4, 's' FROM s UNION ALL SELECT customer_key, product_key, score, 0.2, 'c' FROM c),
scaled AS (SELECT *, max(score) OVER (PARTITION BY customer_key, part) AS most FROM mixed),
total AS MATERIALIZED (SELECT customer_key, product_key, sum(CASE WHEN most > 0 THEN score / most * w ELSE 0 END) AS score FROM scaled GROUP BY 1, 2)"""


def marginal(source: str, n: int, weight: float = 0.3) -> str:
    """``varied``: the first items of each list of ``source``, then step by step the one of the greatest marginal relevance."""
    first = int(n * (1 - weight))
    same = "(CAST(coalesce(x.t = y.t, false) AS INT) + CAST(coalesce(x.b = y.b, false) AS INT))"
    alike = f"{same} / (4.0 - {same})::DOUBLE"
    steps = [
        f"facts AS MATERIALIZED (SELECT x.*, p_type AS t, p_brand AS b, count(*) OVER (PARTITION BY customer_key) AS size FROM {source} x LEFT JOIN part ON p_partkey = product_key)",
        f"left{first} AS MATERIALIZED (SELECT x.*, coalesce(max({alike}), 0) AS m FROM facts x LEFT JOIN facts y ON y.customer_key = x.customer_key AND y.rank <= {first} WHERE x.rank > {first} AND x.size > {n} GROUP BY ALL)",
    ]
    for k in range(first + 1, n + 1):
        best = "row_number() OVER (PARTITION BY customer_key ORDER BY round(0.5::DOUBLE * score - 0.5::DOUBLE * m, 9) DESC, rank)"
        steps.append(f"next{k} AS MATERIALIZED (SELECT * FROM (SELECT *, {best} AS pick FROM left{k - 1}) WHERE pick = 1)")
        steps.append(f"left{k} AS MATERIALIZED (SELECT x.* REPLACE (greatest(x.m, {alike}) AS m) FROM left{k - 1} x JOIN next{k} y USING (customer_key) WHERE x.product_key <> y.product_key)")
    parts = [f"SELECT customer_key, rank, product_key, score FROM facts WHERE rank <= CASE WHEN size > {n} THEN {first} ELSE {n} END"]
    parts += [f"SELECT customer_key, {k}, product_key, score FROM next{k}" for k in range(first + 1, n + 1)]
    return ", ".join([*steps, f"varied AS ({' UNION ALL '.join(parts)})"])


#: ``drawn``: each user's walk over the item numbers, by a step of its own modulo a prime.
WALK = f"""items AS (SELECT product_key, row_number() OVER (ORDER BY {sql_hash(0, I)}, product_key) - 1 AS position FROM (SELECT DISTINCT product_key FROM inter)),
bounds AS (SELECT min(rating) AS lo, max(rating) AS hi, count(DISTINCT product_key) AS c FROM inter),
prime AS (SELECT min(p) AS p FROM (SELECT unnest(range(greatest(c, 2), greatest(c, 2) + 1000)) AS p FROM bounds) WHERE NOT EXISTS (SELECT 1 FROM range(2, 2000) AS r(d) WHERE d * d <= p AND p % d = 0)),
walk AS (SELECT customer_key, p, unnest(range(0, least(extra + {N} + p - c, p))) AS step FROM (SELECT customer_key, count(*) AS extra FROM inter GROUP BY 1) CROSS JOIN bounds CROSS JOIN prime),
met AS (SELECT customer_key, step, ({sql_hash(42, U)} % p + step * (1 + {sql_hash(43, U)} % (p - 1))) % p AS position FROM walk),
fresh AS (SELECT x.*, row_number() OVER (PARTITION BY customer_key ORDER BY step) AS r FROM (SELECT * FROM met JOIN items USING (position)) x WHERE {SEEN}),
drawn AS (SELECT customer_key, product_key, lo + (hi - lo) * ({sql_hash(42, U, I)} / 4503599627370496.0::DOUBLE) AS score FROM fresh CROSS JOIN bounds WHERE r <= {N})"""

ORACLES = {
    "popularity_scores": f"WITH {INTER} SELECT product_key, round(sum(rating), 6) AS score FROM inter GROUP BY 1",
    "popularity_topn": f"WITH {INTER}, {popular('inter', N, False)} {lists('popular')}",
    "popularity_topn_unseen": f"WITH {INTER}, {popular('inter', N, True)} {lists('popular')}",
    "segment_popularity_topn": f"""WITH {INTER}, s AS (SELECT c_mktsegment AS segment, product_key, sum(rating) AS score FROM inter JOIN customer ON customer_key = c_custkey GROUP BY 1, 2)
SELECT segment, rank, product_key, round(score, 6) AS score, coalesce(p_name, 'Unknown') AS product_name
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY segment ORDER BY round(score, 9) DESC, product_key) AS INT) AS rank FROM s) LEFT JOIN part ON product_key = p_partkey WHERE rank <= {N}""",
    "user_neighbours": _neighbours(True),
    "user_jaccard_neighbours": _neighbours(True, "jaccard"),
    "item_neighbours": _neighbours(False),
    "item_pearson_neighbours": _neighbours(False, "pearson"),
    "item_jaccard_neighbours": _neighbours(False, "jaccard"),
    "knn_user_predict": _predict(True),
    "knn_item_predict": _predict(False),
    "knn_item_topn": _neighbour_lists(False),
    "knn_user_topn": _neighbour_lists(True),
    "item_neighbours_above": f"""WITH {INTER}, cells AS MATERIALIZED (SELECT customer_key, product_key, rating AS value FROM inter WHERE rating <> 0), {similar(False, 'cosine')}
SELECT a, b, round(sim, 6) AS sim FROM sims WHERE a < b AND round(sim, 9) >= {CLOSE}""",
    "tfidf": f"WITH {TFIDF} SELECT product_key, feature, round(value, 6) AS value FROM tfidf",
    "item_features": f"WITH {FEATURES} SELECT product_key, feature, round(value, 6) AS value FROM feats",
    "content_similarity": f"""WITH {UNIT}, sims AS (SELECT a.product_key AS a, b.product_key AS b, sum(a.value * b.value) AS sim FROM unit a JOIN unit b USING (feature) WHERE a.product_key <> b.product_key GROUP BY 1, 2 HAVING abs(sum(a.value * b.value)) > 1e-12)
SELECT a, rank, b, round(sim, 6) AS sim FROM (SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) AS INT) AS rank FROM sims) WHERE rank <= {N}""",
    "content_linear_similarity": f"""WITH {RAW}, sims AS (SELECT a.product_key AS a, b.product_key AS b, sum(a.value * b.value) AS sim FROM unit a JOIN unit b USING (feature) WHERE a.product_key <> b.product_key GROUP BY 1, 2 HAVING abs(sum(a.value * b.value)) > 1e-12)
SELECT a, rank, b, round(sim, 6) AS sim FROM (SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) AS INT) AS rank FROM sims) WHERE rank <= {N}""",
    "content_linear_topn": f"WITH {INTER}, {linear_scores('inter')}, {top('scores x', N, where=f'WHERE {SEEN}')} {lists()}",
    "content_linear_predict": f"WITH {HALVES}, {linear_scores('train')}, {CONTENT_GUESS} SELECT customer_key, product_key, round(score, 6) AS score FROM cguess",
    "demographic_numeric_topn": f"WITH {INTER}, {NUMERIC}, {top('demo', N)} {lists()}",
    "demographic_numeric_predict": f"""WITH {HALVES}, {MIXED}, nmean AS (SELECT t.customer_key, t.product_key, avg({MIXED_SIM}) AS score FROM test t JOIN (SELECT DISTINCT customer_key, product_key FROM train) i ON i.product_key = t.product_key
 JOIN mixed a ON a.customer_key = t.customer_key JOIN mixed b ON b.customer_key = i.customer_key GROUP BY 1, 2)
SELECT customer_key, product_key, round(coalesce(score, 0), 6) AS score FROM test LEFT JOIN nmean USING (customer_key, product_key)""",
    "content_topn": f"WITH {INTER}, {content_scores('inter')}, {top('scores x', N, where=f'WHERE {SEEN}')} {lists()}",
    "content_predict": f"WITH {HALVES}, {content_scores('train')}, {CONTENT_GUESS} SELECT customer_key, product_key, round(score, 6) AS score FROM cguess",
    "demographic_similarity": f"WITH {PROFILES} SELECT {_profile('country', 'segment')} AS profile, {_profile('country2', 'segment2')} AS other, round(sim, 6) AS sim FROM alike",
    "demographic_topn": f"WITH {INTER}, {DEMOGRAPHIC}, {top('demo', N)} {lists()}",
    "demographic_predict": f"WITH {HALVES}, {PROFILES}, {DEMOGRAPHIC_MEAN} SELECT customer_key, product_key, round(coalesce(score, 0), 6) AS score FROM test LEFT JOIN dmean USING (customer_key, product_key)",
    "segment_predict": f"WITH {HALVES}, {SEGMENT_GUESS} SELECT customer_key, product_key, round(score, 6) AS score FROM sguess",
    "coldstart_predict": f"""WITH {HALVES}, {PROFILES}, {DEMOGRAPHIC_MEAN}, {SEGMENT_GUESS}, {content_scores('train')}, {CONTENT_GUESS}, warm AS (SELECT customer_key FROM train GROUP BY 1 HAVING count(*) >= 40)
SELECT customer_key, product_key, round(CASE WHEN customer_key IN (SELECT customer_key FROM warm) THEN c.score ELSE (coalesce(d.score, 0) + s.score + c.score) / 3 END, 6) AS score
FROM cguess c JOIN sguess s USING (customer_key, product_key) LEFT JOIN dmean d USING (customer_key, product_key)""",
    "hybrid_predict": f"""WITH {HALVES}, {content_scores('train')}, {CONTENT_GUESS}, pop AS (SELECT product_key, sum(rating) AS score FROM train GROUP BY 1)
SELECT customer_key, product_key, round({HYBRID['popularity']}::DOUBLE * coalesce(p.score, 0) + {HYBRID['content']}::DOUBLE * c.score, 6) AS score FROM cguess c LEFT JOIN pop p USING (product_key)""",
    "coldstart_combine": f"WITH {COMBINED}, {top('total', N)} {lists()}",
    "coldstart_topn": f"""WITH {COMBINED}, cold AS (SELECT customer_key FROM inter GROUP BY 1 HAVING count(*) < 40),
{top('total x', 6 * N, 'long', 'WHERE customer_key IN (SELECT customer_key FROM cold)')}, {marginal('long', N)}
{lists('varied')} UNION ALL SELECT customer_key, rank, product_key, round(score, 6) FROM c WHERE rank <= {N} AND customer_key NOT IN (SELECT customer_key FROM cold)""",
    "mmr_rerank": f"WITH {INTER}, {popular('inter', 2 * N, True)}, {marginal('popular', N)} {lists('varied')}",
    "random_topn": f"WITH {INTER}, {WALK}, {top('drawn', N)} {lists()}",
    "hybrid_fusion": _hybrid(_W.format(**HYBRID)),
    "hybrid_segment_fusion": _hybrid(_BY_SEGMENT, "JOIN customer ON customer_key = c_custkey"),
}
ORACLES["loaded_predict"] = ORACLES["content_predict"]
