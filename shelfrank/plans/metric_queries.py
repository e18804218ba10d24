"""Queries on metrics and result tables: popular and content lists, fitted on the training half, against the test half."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfrank.operators import features as f
from shelfrank.operators import metrics as e
from shelfrank.operators import models as m
from shelfrank.operators import results as r
from shelfrank.plans.base import HALVES, I, U, halves, rounded, segments_of
from shelfrank.plans.model_queries import content, content_scores, described, popular, top
from shelfrank.sources.shared import stored

KS = (1, 5, 10, 20)
NAMES = ["ndcg@10", "precision@10", "recall@10", "hit_rate@10", "mrr"]
ALL = (*e.METRICS, "diversity", "novelty", "coverage")
# What each model took, so that the tables can be compared.
TOOK = [("by_count", "training_time", 2.0), ("by_count", "memory_mb", 90.0), ("by_count", "latency_ms", 4.0), ("by_rating", "training_time", 3.0), ("by_rating", "memory_mb", 80.0), ("by_rating", "model_size_mb", 1.5)]


def nine(df):
    """Nine digits: means over few users often lie halfway between two roundings to six."""
    return rounded(df, 9)


def _sets(spark, sf):
    return f.feature_sets(described(spark, sf), ["category", "sub_category"])


def _recs(spark, sf):
    train, test = halves(spark, sf)
    return m.PopularityRecommender().fit(train).recommend(test, max(KS)), test


def _results(spark, sf):
    """Two models: popularity by ratings and by rows."""
    train, test = halves(spark, sf)
    lists = {name: m.PopularityRecommender(consider_ratings=rated).fit(train).recommend(test, max(KS)) for name, rated in (("by_rating", True), ("by_count", False))}
    return stored(e.compare(lists, test, ks=KS, metrics=ALL, sets=_sets(spark, sf), segment_of=segments_of(spark, sf)), "results")


def _took(spark):
    return spark.createDataFrame(TOOK, "model string, metric string, value double")


def _content(spark, sf):
    train, test = halves(spark, sf)
    recs = content(spark, sf, train).recommend(test, max(KS))
    return nine(e.evaluate(recs, test, KS, e.METRICS).drop("segment"))


def _single(run):
    def query(spark, sf):
        recs, test = _recs(spark, sf)
        return nine(run(spark, sf, recs, test))

    return query


QUERIES = {
    "metrics_per_user": _single(lambda s, d, recs, test: e.per_user(recs, e.relevance(test), KS)),
    "metrics_at_k": _single(lambda s, d, recs, test: e.evaluate(recs, test, KS, e.METRICS).drop("segment")),
    "metrics_by_segment": _single(lambda s, d, recs, test: e.evaluate(recs, test, KS, e.METRICS, segment_of=segments_of(s, d)).where("segment IS NOT NULL")),
    "metrics_of_content": _content,
    "diversity_at_k": _single(lambda s, d, recs, test: e.diversity(recs, _sets(s, d), KS)),
    "novelty_at_k": _single(lambda s, d, recs, test: e.novelty(recs, test.groupBy(I).agg(F.count("*").alias("n")), KS)),
    "coverage_at_k": _single(lambda s, d, recs, test: e.coverage(recs, test, KS)),
    "compare_models": lambda s, d: nine(r.model_matrix(_results(s, d), NAMES)),
    "segment_analysis": lambda s, d: nine(r.segment_matrix(_results(s, d), "by_rating", ["ndcg@10", "precision@10"])),
    "performance_summary": lambda s, d: r.performance_summary(_results(s, d), _took(s), NAMES),
    "optimal_models": lambda s, d: nine(r.optimal_models(_results(s, d), _took(s))),
    "scaled_metrics": lambda s, d: nine(r.scaled_over_models(_results(s, d)).where(F.col("name").isin(NAMES))),
    "common_metrics": lambda s, d: r.common_metrics(_results(s, d)),
    "best_model": lambda s, d: nine(r.best_model(_results(s, d), "ndcg@10")),
    "metric_correlation": lambda s, d: nine(r.metric_correlation(_by_depth(s, d), ["ndcg", "precision", "recall"])),
}


def _by_depth(spark, sf):
    """Metrics at each depth, each depth taken as a model of its own."""
    recs, test = _recs(spark, sf)
    tall = e.evaluate(recs, test, KS, ("ndcg", "precision", "recall")).where(F.col("k").isNotNull())
    return tall.select(F.concat(F.lit("top"), F.col("k").cast("string")).alias("model"), "segment", "metric", F.lit(None).cast("int").alias("k"), "value")


LEVELS = "ks AS (SELECT CAST(k AS INT) AS k FROM (VALUES (1), (5), (10), (20)) AS v(k))"


def per_user(recs: str, out: str = "users") -> str:
    """A row for each test user and k."""
    return f"""{out}_hits AS (SELECT b.customer_key, b.rank, t.rating AS gain, CASE WHEN t.rating >= 3.5 THEN 1 ELSE 0 END AS hit FROM {recs} b LEFT JOIN test t USING (customer_key, product_key)),
{out}_run AS (SELECT *, sum(hit) OVER (PARTITION BY customer_key ORDER BY rank) AS run FROM {out}_hits),
{out}_ideal AS (SELECT customer_key, rating, rating >= 3.5 AS relevant, row_number() OVER (PARTITION BY customer_key ORDER BY rating DESC, product_key) AS place FROM test),
{out}_own AS (SELECT customer_key, k, sum(rating / log2(place + 1.0)) FILTER (place <= k) AS idcg, count(*) FILTER (relevant) AS n_relevant FROM {out}_ideal CROSS JOIN ks GROUP BY 1, 2),
{out}_got AS (SELECT customer_key, k, sum(hit) FILTER (rank <= k) AS hits, count(*) AS length, sum(coalesce(gain, 0) / log2(rank + 1.0)) FILTER (rank <= k) AS dcg,
 sum(hit * run / CAST(rank AS DOUBLE)) FILTER (rank <= k) AS prec, min(rank) FILTER (hit = 1) AS first FROM {out}_run CROSS JOIN ks GROUP BY 1, 2),
{out} AS (SELECT customer_key, k, CASE WHEN n_relevant > 0 THEN coalesce(hits / CAST(least(k, length) AS DOUBLE), 0) ELSE 0 END AS precision, coalesce(hits / CAST(nullif(n_relevant, 0) AS DOUBLE), 0) AS recall,
 coalesce(dcg / nullif(idcg, 0), 0) AS ndcg, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END AS hit, coalesce(prec / nullif(n_relevant, 0), 0) AS ap, coalesce(1.0 / first, 0) AS rr, n_relevant
 FROM {out}_own LEFT JOIN {out}_got USING (customer_key, k))"""


def tall(users: str, extra: str = "", joins: str = "", out: str = "tall", metrics=("precision", "recall", "ndcg", "hit_rate", "map", "mrr", "cumulative_hit_rate")) -> str:
    source = {"precision": "avg(precision)", "recall": "avg(recall)", "ndcg": "avg(ndcg)", "hit_rate": "avg(hit)", "cumulative_hit_rate": "avg(hit)", "map": "coalesce(avg(ap) FILTER (n_relevant > 0), 0)"}
    key, by = (f"{extra}, ", f"{extra.split(' AS ')[0]}, k") if extra else ("", "k")
    parts = [f"SELECT {key}'{x}' AS metric, k, {source[x]} AS value FROM {users} {joins} GROUP BY {by}" for x in metrics if x in source]
    if "mrr" in metrics:
        parts.append(f"SELECT {key}'mrr' AS metric, CAST(NULL AS INT) AS k, coalesce(avg(rr) FILTER (n_relevant > 0), 0) AS value FROM {users} {joins} WHERE k = 20 GROUP BY {by}")
    return f"{out} AS ({' UNION ALL '.join(parts)})"


RECS = f"{HALVES}, {popular('train', 20, False, 'best', 'test')}, {LEVELS}"
USERS = f"{RECS}, {per_user('best')}"
COUNTED = "cpop AS (SELECT product_key, CAST(count(*) AS DOUBLE) AS score FROM train GROUP BY 1), " + top("(SELECT us.customer_key, product_key, score FROM (SELECT DISTINCT customer_key FROM test) us CROSS JOIN cpop)", 20, "cbest")
SEGMENT_OF = "JOIN customer ON customer_key = c_custkey"
DIVERSE = """sets AS (SELECT p_partkey AS product_key, p_type AS t, p_brand AS b FROM part),
dist AS (SELECT x.customer_key, y.rank AS last, 1 - (CAST(p.t = q.t AS INT) + CAST(p.b = q.b AS INT)) / (4.0 - CAST(p.t = q.t AS INT) - CAST(p.b = q.b AS INT))::DOUBLE AS d
 FROM best x JOIN best y ON x.customer_key = y.customer_key AND x.rank < y.rank JOIN sets p ON p.product_key = x.product_key JOIN sets q ON q.product_key = y.product_key)"""
BOTH = f"""{USERS}, {tall('users')}, {COUNTED}, {per_user('cbest', 'cusers')}, {tall('cusers', out='ctall')},
matrix AS (SELECT model, {', '.join(f"max(value) FILTER (metric = '{n.split('@')[0]}' AND k IS NOT DISTINCT FROM {n.split('@')[1] if '@' in n else 'NULL'}) AS \"{n}\"" for n in NAMES)}
 FROM (SELECT 'by_rating' AS model, * FROM tall UNION ALL SELECT 'by_count', * FROM ctall) GROUP BY 1)"""
WIDE = f"took AS (SELECT * FROM (VALUES {', '.join(str(t) for t in TOOK)}) AS t(model, metric, value))"


def _least(name: str) -> str:
    return f"(SELECT 'least_{name}' AS criterion, model, CAST(value AS DOUBLE) AS value FROM took WHERE metric = '{name}' AND value > 0 ORDER BY value, model LIMIT 1)"


def _four(name: str) -> str:
    return f"coalesce(CAST(CAST(round(CAST(\"{name}\" AS DOUBLE), 4) AS DECIMAL(38, 4)) AS VARCHAR), 'N/A') AS \"{name}\""


def _kinds(recs: str) -> str:
    """(metric, k) of the metrics on lists and items."""
    return f"""SELECT 'diversity' AS metric, k FROM {recs} JOIN ks ON rank BETWEEN 2 AND k GROUP BY k UNION ALL SELECT 'coverage', k FROM {recs} CROSS JOIN ks GROUP BY k
 UNION ALL SELECT 'novelty', k FROM {recs} JOIN ks ON rank <= k WHERE product_key IN (SELECT product_key FROM test) GROUP BY k"""


_INVERSE = " + ".join(f"1 / (1 + CAST(coalesce((SELECT value FROM took t WHERE t.model = matrix.model AND metric = '{c}'), {d}) AS DOUBLE))" for c, d in (("training_time", 1), ("memory_mb", 100), ("latency_ms", 1)))

ORACLES = {
    "metrics_per_user": f"""WITH {USERS} SELECT customer_key, k, round(precision, 9) AS precision, round(recall, 9) AS recall, round(ndcg, 9) AS ndcg, CAST(hit AS DOUBLE) AS hit, round(ap, 9) AS ap, round(CAST(rr AS DOUBLE), 9) AS rr, n_relevant FROM users""",
    "metrics_at_k": f"WITH {USERS}, {tall('users')} SELECT metric, k, round(CAST(value AS DOUBLE), 9) AS value FROM tall",
    "metrics_by_segment": f"WITH {USERS}, {tall('users', 'c_mktsegment AS segment', SEGMENT_OF, metrics=('precision', 'recall', 'ndcg', 'hit_rate'))} SELECT segment, metric, k, round(CAST(value AS DOUBLE), 9) AS value FROM tall",
    "metrics_of_content": f"WITH {HALVES}, {LEVELS}, {content_scores('train')}, {top('scores x', 20, where='WHERE customer_key IN (SELECT customer_key FROM test)')}, {per_user('best')}, {tall('users')} SELECT metric, k, round(CAST(value AS DOUBLE), 9) AS value FROM tall",
    "diversity_at_k": f"WITH {RECS}, {DIVERSE} SELECT k, round(avg(d), 9) AS value FROM (SELECT customer_key, k, avg(d) AS d FROM dist JOIN ks ON last <= k GROUP BY 1, 2) GROUP BY 1",
    "novelty_at_k": f"""WITH {RECS}, c AS (SELECT product_key, -log2(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)) AS s FROM test GROUP BY 1)
SELECT k, round(avg(s), 9) AS value FROM (SELECT customer_key, k, avg(s) AS s FROM best JOIN c USING (product_key) JOIN ks ON rank <= k GROUP BY 1, 2) GROUP BY 1""",
    "coverage_at_k": f"WITH {RECS} SELECT k, round(CAST(count(DISTINCT product_key) FILTER (rank <= k) AS DOUBLE) / (SELECT count(DISTINCT product_key) FROM test), 9) AS value FROM best CROSS JOIN ks GROUP BY 1",
    "compare_models": f"WITH {BOTH} SELECT model, {', '.join(f'round(CAST(\"{n}\" AS DOUBLE), 9) AS \"{n}\"' for n in NAMES)} FROM matrix",
    "segment_analysis": f"""WITH {USERS} SELECT coalesce(c_mktsegment, 'Overall') AS segment, round(avg(ndcg), 9) AS "ndcg@10", round(avg(precision), 9) AS "precision@10"
FROM users {SEGMENT_OF} WHERE k = 10 GROUP BY ROLLUP (c_mktsegment)""",
    "optimal_models": f"""WITH {BOTH}, {WIDE}, scored AS (SELECT model, 0.3 * (({_INVERSE}) / 3) + 0.7 * "ndcg@10" AS v FROM matrix)
SELECT criterion, model, round(value, 9) AS value FROM ((SELECT 'best_quality' AS criterion, model, "ndcg@10" AS value FROM matrix ORDER BY value DESC, model LIMIT 1)
 UNION ALL {' UNION ALL '.join(_least(c) for c in ('training_time', 'memory_mb', 'latency_ms', 'model_size_mb'))} UNION ALL (SELECT 'best_overall', model, v FROM scored ORDER BY v DESC, model LIMIT 1))""",
    "performance_summary": f"""WITH {BOTH}, {WIDE}, used AS (SELECT model, {', '.join(f"max(value) FILTER (metric = '{c}') AS {c}" for c in r.RESOURCES)} FROM took GROUP BY 1)
SELECT model, {', '.join(_four(c) for c in (*r.RESOURCES, *NAMES))} FROM matrix FULL JOIN used USING (model)""",
    "common_metrics": f"""WITH {BOTH}, named AS ((SELECT metric, k FROM tall UNION ALL {_kinds('best')}) INTERSECT (SELECT metric, k FROM ctall UNION ALL {_kinds('cbest')}))
SELECT metric || CASE WHEN k IS NULL THEN '' ELSE '@' || k END AS name FROM named""",
    "scaled_metrics": f"""WITH {BOTH}, long AS ({' UNION ALL '.join(f"SELECT model, '{n}' AS name, CAST(\"{n}\" AS DOUBLE) AS v FROM matrix" for n in NAMES)}),
edged AS (SELECT *, min(v) OVER (PARTITION BY name) AS lo, max(v) OVER (PARTITION BY name) AS hi FROM long)
SELECT model, name, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0.5 END, 9) AS value FROM edged""",
    "best_model": f"""WITH {BOTH} SELECT model, round("ndcg@10", 9) AS value FROM matrix ORDER BY "ndcg@10" DESC, model LIMIT 1""",
    "metric_correlation": f"""WITH {USERS}, m AS (SELECT k, avg(ndcg) AS ndcg, avg(precision) AS precision, avg(recall) AS recall FROM users GROUP BY 1)
SELECT 'ndcg' AS a, 'precision' AS b, round(corr(ndcg, precision), 9) AS r FROM m UNION ALL SELECT 'ndcg', 'recall', round(corr(ndcg, recall), 9) FROM m UNION ALL SELECT 'precision', 'recall', round(corr(precision, recall), 9) FROM m""",
}
