"""Operators on tables small enough to work out by hand, and against dense matrices."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfrank.operators import analytics as a
from shelfrank.operators import factors
from shelfrank.operators import features as f
from shelfrank.operators import metrics as e
from shelfrank.operators import models as m
from shelfrank.operators import neighbourhood as nb
from shelfrank.operators import rows as by_rows
from shelfrank.operators import prepare, products, ranking, recommender, results, sampling, splits
from shelfrank.sources.catalog import Catalog, read_csv, write_csv
from shelfrank.sources import shared
from shelfrank.sources.config import Config

U, I = "customer_key", "product_key"


def ratings(spark, rows):
    return spark.createDataFrame(rows, f"{U} long, {I} long, rating double")


def lists(spark, rows):
    return spark.createDataFrame([(u, r, i, 1.0 / r) for u, items in rows.items() for r, i in enumerate(items, 1)], f"{U} long, rank int, {I} long, score double")


def some_ratings(n_users=12, n_items=9, seed=0):
    rng = np.random.default_rng(seed)
    return [(u, i, float(rng.integers(2, 11)) / 2) for u in range(n_users) for i in range(n_items) if rng.random() < 0.45]


def test_metrics_by_hand(spark):
    recs = lists(spark, {1: [1, 2, 3], 2: [1, 2, 3]})
    test = ratings(spark, [(1, 2, 4.0), (1, 4, 2.0), (2, 9, 1.0)])
    got = {(r["metric"], r["k"]): r["value"] for r in e.evaluate(recs, test, (5,)).collect()}
    ndcg = (4 / math.log2(3)) / (4 + 2 / math.log2(3))
    assert got["precision", 5] == pytest.approx(1 / 3 / 2) and got["recall", 5] == pytest.approx(0.5)
    assert got["ndcg", 5] == pytest.approx(ndcg / 2) and got["hit_rate", 5] == 0.5 and got["cumulative_hit_rate", 5] == 0.5
    assert got["map", 5] == pytest.approx(0.5) and got["mrr", None] == pytest.approx(0.5)


def test_average_precision(spark):
    test = ratings(spark, [(1, 2, 4.0), (1, 4, 4.0), (1, 9, 5.0)])
    got = {(r["metric"], r["k"]): r["value"] for r in e.evaluate(lists(spark, {1: [1, 2, 3, 4]}), test, (4,)).collect()}
    assert got["map", 4] == pytest.approx((1 / 2 + 2 / 4) / 3) and got["mrr", None] == 0.5


def test_diversity_novelty_coverage(spark):
    recs = lists(spark, {1: [1, 2]})
    sets = spark.createDataFrame([(1, ["x", "y"]), (2, ["y", "z"])], f"{I} long, features array<string>")
    assert e.diversity(recs, sets, (2,)).first()["value"] == pytest.approx(2 / 3)
    counts = spark.createDataFrame([(1, 1), (3, 3)], f"{I} long, n long")
    assert e.novelty(recs, counts, (2,)).first()["value"] == pytest.approx(2.0)
    assert e.coverage(recs, ratings(spark, [(1, 7, 1.0)]), (1, 2)).orderBy("k").collect()[1]["value"] == 2.0


def test_metrics_shuffle_lists_once(spark):
    rng = random.Random(5)
    recs = lists(spark, {u: rng.sample(range(30), 6) for u in range(40)})
    test = ratings(spark, [(u, i, float(rng.randint(1, 5))) for u in range(5, 50) for i in rng.sample(range(30), 4)])
    plan = e.per_user(recs, e.relevance(test).localCheckpoint(), (1, 5))._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan
    physical = e.per_user(recs, e.relevance(test).localCheckpoint(), (1, 5))._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") == 1
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert e.evaluate(recs, test, (1, 5), (*e.METRICS, "novelty", "coverage")).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held  # nothing stays in caches
    sets = spark.createDataFrame([(i, rng.sample("abcde", rng.randint(0, 3))) for i in range(30)], f"{I} long, features array<string>")
    kinds = {r[0]: set(r[1]) for r in sets.collect() if r[1]}
    apart = lambda a, b: 1 - len(kinds[a] & kinds[b]) / len(kinds[a] | kinds[b])
    by_user = {}
    for r in recs.orderBy("rank").collect():
        by_user.setdefault(r[U], []).append(r[I])
    for k in (2, 5):
        means = [[apart(a, b) for n, a in enumerate(x[:k]) for b in x[n + 1 : k] if a in kinds and b in kinds] for x in by_user.values()]
        means = [sum(m) / len(m) for m in means if m]
        assert {r["k"]: r["value"] for r in e.diversity(recs, sets, (2, 5)).collect()}[k] == pytest.approx(sum(means) / len(means))


def test_segments_alone_fit_no_content(spark):
    inter = ratings(spark, [(1, 1, 4.0), (2, 1, 2.0), (2, 2, 5.0)])
    features = spark.createDataFrame([(1, "x", 1.0), (2, "x", 1.0), (2, "y", 1.0)], f"{I} long, feature string, value double")
    customers = spark.createDataFrame([(1, "DE"), (2, "DE")], f"{U} long, country string")
    segment_of = spark.createDataFrame([(1, "a"), (2, "a")], f"{U} long, segment string")
    model = m.ColdStartRecommender(fields=["country"]).fit(inter, features, customers, segment_of)
    got = {(r[U], r[I]): r["score"] for r in model.predict_segment(inter).collect()}
    assert got == {(1, 1): 1.0, (2, 1): 1.0, (2, 2): pytest.approx(5 / 6)}
    assert all(callable(p) for p in model._parts.values())  # nothing was fitted that wasn't asked
    assert model.content.tables and not callable(model._parts["content"])
    model.release()


def test_demographic_rankings_are_cut_where_they_are_summed(spark):
    customers = spark.createDataFrame([(u, "abc"[u % 3]) for u in range(30)], f"{U} long, country string")
    inter = ratings(spark, [(u, (u * 7 + j) % 40, 1.0) for u in range(30) for j in range(10)])
    model, bought = m.Demographics(customers, ["country"]), inter.select(U, I)
    near = model.nearest(8)
    asked = spark.createDataFrame([(0, '{"country":"a"}', "more", 4), (27, '{"country":"a"}', "less", 3)], f"{U} long, profile string, kind string, rows int")
    rows = model._summed(near, bought, asked, 8).collect()
    assert Counter(r["kind"] for r in rows if r["kind"]) == {"more": 4, "less": 3}  # not a row for each item that a neighbour bought
    assert {r[U] for r in rows if not r["kind"]} <= {0}
    got = {(r[U], r["rank"]): (r[I], r["score"]) for r in model.recommend(inter, inter, 3, inter, 8).collect()}
    has = {u: {(u * 7 + j) % 40 for j in range(10)} for u in range(30)}
    for u in range(30):
        others = [v for v in sorted(has, key=lambda v: (v % 3 != u % 3, v)) if v != u][:7]
        score = Counter(i for v in others if v % 3 == u % 3 for i in has[v]) | Counter()
        best = sorted(((-score[i], i) for v in others for i in has[v] if i not in has[u]))
        best = list(dict.fromkeys(best))[:3]
        assert [got.get((u, n)) for n in range(1, len(best) + 1)] == [(i, pytest.approx(-s)) for s, i in best]


def test_ratings_from_sales(spark):
    sold = spark.createDataFrame([(1, 1, 100.0), (1, 2, 300.0), (2, 1, 500.0)], f"{U} long, {I} long, sales double")
    assert sorted(r["rating"] for r in prepare.sales(sold).collect()) == [1.0, 3.0, 5.0]
    assert {r["rating"] for r in prepare.sales(sold.withColumn("sales", F.lit(7.0))).collect()} == {1.0}
    units = spark.createDataFrame([(1, 1, 9), (1, 2, 0), (2, 1, None)], f"{U} long, {I} long, quantity int")
    assert Counter(r["rating"] for r in prepare.sales(units).collect()) == Counter([5.0, 1.0, None])
    with pytest.raises(ValueError):
        prepare.sales(units.drop(I))


def test_latest_sale_stays(spark):
    sold = spark.createDataFrame([(1, 1, "2024-01-01", 9.0), (1, 1, "2024-02-01", 3.0), (1, 1, None, 8.0)], f"{U} long, {I} long, order_date string, sales double")
    rows = prepare.sales(sold.withColumn("order_date", F.col("order_date").cast("timestamp_ntz"))).collect()
    assert [r["sales"] for r in rows] == [3.0]


def test_customers_and_products(spark):
    people = spark.createDataFrame([(1, "Male", "Single", "1990-05-01", "FR", "40-49"), (2, None, "Other", "x", None, None), (3, "Female", "Married", None, "US", "n/a")], f"{U} long, gender string, marital_status string, birth_date string, country string, age_group string")
    got = {r[U]: r for r in prepare.customers(people, 2024).collect()}
    assert (got[1]["gender_code"], got[1]["marital_code"], got[1]["age"], got[1]["age_group_lower"], got[1]["country_FR"]) == (0, 0, 34, 40.0, 1)
    assert (got[2]["gender_code"], got[2]["marital_code"], got[2]["age"], got[2]["country_FR"], got[2]["country_US"]) == (None, None, None, 0, 0)
    assert got[3]["age_group_lower"] is None and got[3]["gender_code"] == 1
    goods = spark.createDataFrame([(1, "A", None, "C", 4.0), (2, "B", "K", "C", None), (3, "D", "K", None, 6.0)], f"{I} long, product_name string, category string, sub_category string, cost double")
    got = {r[I]: r for r in prepare.products(goods).collect()}
    assert got[1]["product_description"] == "A  C" and got[2]["cost"] == 5.0 and got[3]["category_K"] == 1 and got[1]["category_K"] == 0


def test_bins_pareto_validation(spark):
    n = spark.createDataFrame([(5,), (6,), (20,), (21,), (51,)], "n long")
    got = [r["b"] for r in n.select("n", a.binned(F.col("n"), *a.ACTIVITY).alias("b")).orderBy("n").collect()]
    assert got == ["Low", "Medium", "Medium", "High", "Very High"]
    rows = [(u, i) for i, c in enumerate((70, 10, 10, 10)) for u in range(c)]
    df = spark.createDataFrame(rows, f"{U} long, {I} long")
    assert a.pareto(df).first()["n_head"] == 2
    even = ratings(spark, [(u, i, 3.0) for u in range(4) for i in range(4)])
    row = a.validation(even).first()
    assert row["power_users"] == 0 and row["quality"] == "EXCELLENT"
    assert a.validation(ratings(spark, [(None, 1, 1.0), (1, 1, None), (1, 1, 2.0)])).first()["quality"] == "POOR"
    assert a.validation(even.limit(0)).first()["n_rows"] == 0


def test_splits(spark):
    rows = spark.createDataFrame([(1 + n % 3, n, 3.0, f"2024-01-{n + 1:02d}") for n in range(10)], f"{U} long, {I} long, rating double, timestamp string").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    train, test = splits.temporal_split(rows)
    assert sorted(r[I] for r in test.collect()) == [8, 9] and train.count() == 8
    for train, test in (splits.random_split(rows), splits.user_split(rows, 0.4), splits.item_split(rows), splits.leave_one_out(rows), splits.stratified_split(rows, strata=U), splits.temporal_split(rows, holdout="2024-01-05")):
        assert sorted(r[I] for r in train.unionByName(test).collect()) == list(range(10))
    one = spark.createDataFrame([(1, 1, "2024-01-01"), (2, 1, "2024-01-01"), (2, 2, "2024-01-03"), (2, 3, "2024-01-02")], f"{U} long, {I} long, timestamp string")
    assert [(r[U], r[I]) for r in splits.leave_one_out(one)[1].collect()] == [(2, 2)]


def test_smallest_takes_exactly_n(spark):
    rng = np.random.default_rng(3)
    values = [(int(v), i) for i, v in enumerate(rng.integers(-(10**12), 10**12, 500))] + [(None, 500 + i) for i in range(5)] + [(7, 600 + i) for i in range(40)]
    df = spark.createDataFrame(values, "v long, i long")
    order = sorted(values, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    for n in (0, 1, 250, 265, 280, 541, 543, len(values)):
        assert Counter(map(tuple, df.where(sampling.smallest(df, ["v", "i"], n)).collect())) == Counter(order[:n])
    assert sorted(r["position"] for r in sampling.numbered(df, "i").collect()) == list(range(len(values)))


def dense(rows, n_users, n_items):
    x = np.zeros((n_users, n_items))
    for u, i, r in rows:
        x[u, i] = r
    return x


def test_user_neighbours_equal_dense(spark):
    rows = some_ratings()
    x = dense(rows, 12, 9)
    items = len({i for _, i, _ in rows})
    mean = x.sum(1) / items
    c = x - mean[:, None]
    sim = c @ c.T / np.outer(np.linalg.norm(c, axis=1), np.linalg.norm(c, axis=1))
    model = m.NeighbourhoodRecommender(user_based=True, k=3).fit(ratings(spark, rows))
    pairs = [(u, i) for u in range(12) for i in range(9)]
    got = {(r[U], r[I]): r["score"] for r in model.predict(spark.createDataFrame(pairs, f"{U} long, {I} long")).collect()}
    for u, i in pairs:
        raters = sorted((v for v in range(12) if v != u and x[v, i] > 0), key=lambda v: (-round(sim[u, v], 9), v))[:3]
        weight = sum(sim[u, v] for v in raters)
        want = x[u, i] if x[u, i] > 0 else mean[u] if not raters or abs(weight) < 1e-12 else min(5, max(1, mean[u] + sum(sim[u, v] * (x[v, i] - mean[v]) for v in raters) / weight))
        assert got[u, i] == pytest.approx(want, abs=1e-9), (u, i)


def test_content_equals_dense(spark):
    rows = some_ratings()
    feats = [(i, name, v) for i in range(9) for name, v in (("a" if i % 2 else "b", 1.0), (f"c{i % 3}", 1.0), ("x", i / 9)) if v]
    table = spark.createDataFrame(feats, f"{I} long, feature string, value double")
    names = sorted({n for _, n, _ in feats})
    x = np.zeros((9, len(names)))
    for i, n, v in feats:
        x[i, names.index(n)] = v
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, 0)
    w = dense(rows, 12, 9)
    w = w / np.maximum(w.sum(1, keepdims=True), 1e-300)
    scores = w @ s @ s
    model = m.ContentRecommender().fit(ratings(spark, rows), table)
    users = spark.createDataFrame([(u,) for u in range(13)], f"{U} long")
    got = {(r[U], r[I]): r["score"] for r in model.recommend(users, 9).collect()}
    for u in {u for u, _, _ in rows}:
        assert [got[u, i] for i in range(9)] == pytest.approx(scores[u].tolist(), abs=1e-9)
    assert [got[12, i] for i in range(9)] == pytest.approx((s.sum(0) / 9).tolist(), abs=1e-9)
    seen = ratings(spark, rows)
    for u, group in Counter(r[U] for r in model.recommend(users, 3, seen).where(f"{U} < 12").collect()).items():
        assert group == min(3, 9 - sum(1 for v, _, _ in rows if v == u))


def test_factors(spark):
    rows = some_ratings(30, 20, 2)
    df = ratings(spark, rows)
    model = m.FactorRecommender(n_factors=4, n_epochs=8).fit(df)
    error = lambda p: math.sqrt(np.mean([(r["score"] - r["rating"]) ** 2 for r in p.join(df, [U, I]).collect()]))
    assert error(model.predict(df)) < np.std([r for *_, r in rows])
    unknown = spark.createDataFrame([(999, 0), (0, 999)], f"{U} long, {I} long")
    assert {round(r["score"], 9) for r in model.predict(unknown).collect()} == {round(float(np.mean([r for *_, r in rows])), 9)}
    assert model.recommend(spark.createDataFrame([(999,)], f"{U} long"), 5).count() == 0


def test_random_has_no_repeats(spark):
    rows = some_ratings()
    df = ratings(spark, rows)
    model = m.RandomRecommender().fit(df)
    got = model.recommend(df, 4, df).collect()
    have = {(u, i) for u, i, _ in rows}
    assert len({(r[U], r[I]) for r in got}) == len(got) and not have & {(r[U], r[I]) for r in got}
    assert Counter(r[U] for r in got) == Counter({u: min(4, 9 - c) for u, c in Counter(u for u, *_ in rows).items() if c < 9})


def test_fusion_by_hand(spark):
    x = spark.createDataFrame([(1, 1, 10, 10.0), (1, 2, 20, 5.0)], f"{U} long, rank int, {I} long, score double")
    y = spark.createDataFrame([(1, 1, 20, 3.0)], f"{U} long, rank int, {I} long, score double")
    got = {r[I]: r["score"] for r in ranking.fused({"x": x, "y": y}, {"x": 0.7, "y": 0.3}, 5).collect()}
    assert got == {10: pytest.approx(0.7), 20: pytest.approx(0.3)}


def test_diversified(spark):
    rows = lists(spark, {1: [1, 2, 3, 4]}).withColumn("score", 1 - F.col("rank") / 100)
    sets = spark.createDataFrame([(1, ["a"]), (2, ["a"]), (3, ["a"]), (4, ["b"])], f"{I} long, features array<string>")
    assert [r[I] for r in ranking.diversified(rows, sets, 2, 0.5).orderBy("rank").collect()] == [1, 4]
    assert [r[I] for r in ranking.diversified(rows, sets, 2, 0).orderBy("rank").collect()] == [1, 2]
    assert [r[I] for r in ranking.diversified(rows, sets, 4).orderBy("rank").collect()] == [1, 2, 3, 4]


def test_tf_idf_needs_words(spark):
    df = spark.createDataFrame([(1, "the a of"), (2, None)], f"{I} long, t string")
    with pytest.raises(ValueError):
        f.tf_idf(df, I, "t")


def test_save_and_load(spark, tmp_path):
    df = ratings(spark, some_ratings())
    hybrid = m.HybridRecommender(weights={"popularity": 3, "random": 1})
    hybrid.add("popularity", m.PopularityRecommender().fit(df)).add("random", m.RandomRecommender().fit(df))
    hybrid.save(str(tmp_path / "h"))
    back = m.HybridRecommender.restore(spark, str(tmp_path / "h"))
    assert sorted(map(tuple, back.recommend(df, 3).collect())) == sorted(map(tuple, hybrid.recommend(df, 3).collect()))
    assert back.weights == {"popularity": 0.75, "random": 0.25}


def test_save_and_load_cold_start(spark, tmp_path):
    df = ratings(spark, some_ratings())
    items, users = df.select(I).distinct(), df.select(U).distinct()
    features = items.select(I, F.concat(F.lit("k"), (F.col(I) % 3).cast("string")).alias("feature"), F.lit(1.0).alias("value"))
    customers = users.withColumn("country", (F.col(U) % 2).cast("string"))
    segments = users.withColumn("segment", (F.col(U) % 2).cast("string"))
    model = m.ColdStartRecommender(fields=["country"], min_interactions=100).fit(df, features, customers, segments)
    want = sorted(map(tuple, model.recommend(users, 3).collect())), sorted(map(tuple, model.predict(df).collect()))
    model.save(str(tmp_path / "c"))
    back = m.Recommender.load(spark, str(tmp_path / "c"))
    assert isinstance(back, m.ColdStartRecommender)
    got = sorted(map(tuple, back.recommend(users, 3).collect())), sorted(map(tuple, back.predict(df).collect()))
    assert [r[:3] for r in got[0]] == [r[:3] for r in want[0]] and got[1] == [pytest.approx(r) for r in want[1]]


def test_config(tmp_path):
    config = Config()
    config.set("a.b.c", 3)
    config.save(str(tmp_path / "c.yaml"))
    back = Config.load(str(tmp_path / "c.yaml"))
    assert back.get("a.b.c") == 3 and back.get("a.x", 7) == 7 and back.get("models.neighborhood.k") == 30
    assert Config.preset("10%").get("data.sample_size") == 0.1


def test_catalog_from_csv_and_command_line(spark, tmp_path, capsys):
    from shelfrank import __main__ as cli

    write = lambda name, text: (tmp_path / name).write_text(text)
    write("g_dim_customers.csv", "customer_key,gender,country,age_group\n" + "".join(f"{u},Male,C{u % 2},{30 + u}-39\n" for u in range(8)))
    write("g_dim_products.csv", "product_key,product_name,category,sub_category,cost\n" + "".join(f"{i},word{i % 4} thing,K{i % 2},S{i % 3},{i}.5\n" for i in range(12)))
    write("g_fact_sales.csv", "customer_key,product_key,order_date,sales,quantity\n" + "".join(f"{u},{i},2024-{1 + (u + i) % 12:02d}-03,{10 * i + u},1\n" for u in range(8) for i in range(12) if (u * i) % 5 != 1))
    write("Customer_report_cleaned_data.csv", "customer_key,cust_segmentation,total\n" + "".join(f"{u},{'VIP' if u % 2 else 'New'},{u}\n" for u in range(8)))
    config = Config({"data": {"dir": str(tmp_path)}, "models": {"content_based": {"min_df": 0.0, "max_df": 1.0}, "matrix_factorization": {"n_factors": 3, "n_epochs": 2}}})
    catalog = Catalog.load(spark, config)
    assert catalog.product_report is None and catalog.interactions().count() > 50
    found = cli.experiment(catalog, config, ["popularity", "hybrid", "cold_start"], str(tmp_path / "out"))
    assert {r["model"] for r in found.select("model").distinct().collect()} == {"popularity", "hybrid", "cold_start"}
    assert cli.recommend(catalog, config, "content", 1, 3).count() == 3
    run = next((tmp_path / "out").iterdir())
    stored = results.load_resources(spark, str(run / "resources"))
    assert {(r["model"], r["metric"]) for r in stored.collect() if r["value"] > 0} == {(x, y) for x in ("popularity", "hybrid", "cold_start") for y in results.RESOURCES}
    summary = results.performance_summary(results.load_json(spark, str(run / "results")), stored, ["ndcg@10"]).collect()
    assert len(summary) == 3 and not any(r[c] == "N/A" for r in summary for c in results.RESOURCES)
    assert m.Recommender.load(spark, str(run / "models" / "hybrid")).weights
    took = spark.createDataFrame([("popularity", "training_time", 1.0)], "model string, metric string, value double")
    assert "Best models" in results.report(found, took, ["ndcg@10", "mrr"])


@pytest.mark.parametrize("users", [True, False])
@pytest.mark.parametrize("kind", ["cosine", "pearson", "jaccard"])
def test_similarities_equal_dense(spark, monkeypatch, users, kind):
    """All pairs that share a cell, with heavy keys on a grid, with a floor, and the index of the nearest."""
    monkeypatch.setattr(nb, "KEY_BLOCK", 3)
    rows = some_ratings(14, 11, 5)
    x = dense(rows, 14, 11)
    x = x if users else x.T
    shared = (x > 0).astype(float) @ (x > 0).T > 0
    if users or kind == "pearson":
        c = x - x.mean(1, keepdims=True)
    else:
        c = x
    if kind == "jaccard":
        b = (c > 0).astype(float)
        both = b @ b.T
        sim, shared = both / np.maximum(b.sum(1)[:, None] + b.sum(1)[None] - both, 1e-300), both > 0
    else:
        unit = c / np.linalg.norm(c, axis=1, keepdims=True)
        sim = unit @ unit.T
    want = {(a, b): sim[a, b] for a in range(len(x)) for b in range(len(x)) if a < b and shared[a, b]}
    model = m.NeighbourhoodRecommender(user_based=users, similarity=kind, k=3).fit(ratings(spark, rows))
    got = {(r["a"], r["b"]): r["sim"] for r in model.ordered_similarities().collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    near = {}
    for r in model.index().collect():
        near.setdefault(r["a"], []).append((r["rank"], r["b"]))
    ways = want | {(b, a): v for (a, b), v in want.items()}
    assert {a: [b for _, b in sorted(v)] for a, v in near.items()} == {a: [b for _, b in sorted((-round(v, 9), b) for (p, b), v in ways.items() if p == a)[:3]] for a in {p for p, _ in ways}}
    floor = float(np.median(list(want.values())))
    least = m.NeighbourhoodRecommender(user_based=users, similarity=kind, min_similarity=floor).fit(ratings(spark, rows))
    assert {(r["a"], r["b"]) for r in least.ordered_similarities().collect()} == {k for k, v in want.items() if round(v, 9) >= floor}


def test_bounds_hold(spark):
    """No pair that is left out by its bound could have reached the floor."""
    rows = some_ratings(20, 15, 8) + [(99, i, 5.0) for i in range(15)] + [(u, 99, 1.0) for u in range(20)]
    for users in (True, False):
        model = m.NeighbourhoodRecommender(user_based=users, min_similarity=0.3).fit(ratings(spark, rows))
        bounds = nb.shared_pairs(model._vectors()).select("a", "b", model._bound().alias("most")).distinct()
        sims = m.NeighbourhoodRecommender(user_based=users).fit(ratings(spark, rows)).ordered_similarities()
        assert sims.join(bounds, ["a", "b"]).where("most < sim").count() == 0 < bounds.where("most < 1").count()


def test_heavy_keys_are_spread(spark):
    """A user with a third of the catalogue: its pairs go to many places, none with over four times the median."""
    light = spark.range(3000).select(F.col("id").alias("o"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.pmod(F.xxhash64("id", k), F.lit(2400)))).alias("id"), F.lit(1.0).alias("z"))
    rows = light.distinct().unionByName(spark.range(800).select(F.lit(-1).cast("long").alias("o"), F.col("id"), F.lit(1.0).alias("z")))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(old, ("12", "false", "-1"), strict=True):
        spark.conf.set(k, v)
    try:
        place = lambda df: sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
        spread, whole = place(nb.shared_pairs(rows, 40)), place(nb.shared_pairs(rows, 10**9, False))
        assert sum(spread) == sum(whole) and spread[-1] <= 4 * spread[len(spread) // 2] and whole[-1] > 4 * whole[len(whole) // 2]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("users", [True, False])
def test_lists_by_index_equal_dense(spark, users):
    rows = some_ratings(15, 12, 6)
    x, k = dense(rows, 15, 12), 4
    mean = x.sum(1) / 12
    c = x - mean[:, None] if users else x.T
    unit = c / np.linalg.norm(c, axis=1, keepdims=True)
    sim, shared = unit @ unit.T, ((x > 0) @ (x > 0).T if users else (x > 0).T @ (x > 0))
    near = {a: sorted((b for b in range(len(sim)) if b != a and shared[a, b]), key=lambda b, a=a: (-round(sim[a, b], 9), b))[:k] for a in range(len(sim))}
    want = {}
    for u in range(15):
        met = {}
        if users:
            for v in near[u]:
                for i in np.flatnonzero(x[v]):
                    met.setdefault(int(i), []).append((sim[u, v], x[v, i] - mean[v]))
        else:
            for h in np.flatnonzero(x[u]):
                for i in near[int(h)]:
                    met.setdefault(i, []).append((sim[h, i], x[u, h]))
        for i, parts in met.items():
            if abs(weight := sum(s for s, _ in parts)) > 1e-12 and x[u, i] == 0:
                want[u, i] = min(5, max(1, (mean[u] if users else 0) + sum(s * r for s, r in parts) / weight))
    df = ratings(spark, rows)
    model = m.NeighbourhoodRecommender(user_based=users, k=k).fit(df)
    got = {(r[U], r[I]): r["score"] for r in model.recommend(df, 12, df).collect()}
    assert got == {key: pytest.approx(v, abs=1e-9) for key, v in want.items()}
    everything = {(r[U], r[I]): r["score"] for r in model.recommend(df, 12).collect()}
    assert all(everything[u, i] == r for u, i, r in rows) and len(everything) == len(want) + len(rows)
    strangers = spark.createDataFrame([(777,)], f"{U} long")
    assert model.recommend(strangers, 3).count() == 0


def test_models_are_saved_whole(spark, tmp_path, monkeypatch):
    """A save that stops half-way leaves the version before; old versions go."""
    path = str(tmp_path / "m")
    with pytest.raises(FileNotFoundError):
        m.Recommender.load(spark, path)
    first, second = ratings(spark, [(1, 1, 4.0), (2, 1, 3.0)]), ratings(spark, [(1, 2, 5.0)])
    m.PopularityRecommender().fit(first).save(path)
    stop = lambda *a: (_ for _ in ()).throw(RuntimeError("stopped"))
    hybrid = m.HybridRecommender(weights={"a": 1, "b": 1}).add("a", m.PopularityRecommender().fit(second)).add("b", m.PopularityRecommender().fit(second))
    monkeypatch.setattr(hybrid.components["b"], "write", stop)
    with pytest.raises(RuntimeError):
        hybrid.save(path)
    assert len(recommender.versions(spark, path, False)) == 2
    back = m.Recommender.load(spark, path)
    assert isinstance(back, m.PopularityRecommender) and [r["score"] for r in back.tables["popularity"].collect()] == [7.0]
    for _ in range(3):
        m.PopularityRecommender().fit(second).save(path)
    assert len(recommender.versions(spark, path, False)) == 2
    assert [tuple(r) for r in m.Recommender.load(spark, path).tables["popularity"].collect()] == [(2, 5.0)]
    index = m.NeighbourhoodRecommender(user_based=False, k=2).fit(df := ratings(spark, some_ratings()))
    want = sorted(map(tuple, index.recommend(df, 3, df).collect()))
    index.save(path)
    assert sorted(map(tuple, m.Recommender.load(spark, path).recommend(df, 3, df).collect())) == want


def linear_features():
    return [(i, name, v) for i in range(9) for name, v in (("a" if i % 2 else "b", 1.0), (f"c{i % 3}", 2.0), ("x", i / 9)) if v]


def test_linear_content_equals_dense(spark):
    rows, feats = some_ratings(), linear_features()
    table = spark.createDataFrame(feats, f"{I} long, feature string, value double")
    names = sorted({n for _, n, _ in feats})
    x = np.zeros((9, len(names)))
    for i, n, v in feats:
        x[i, names.index(n)] = v
    s = x @ x.T
    np.fill_diagonal(s, 0)
    w = dense(rows, 12, 9)
    w = w / np.maximum(w.sum(1, keepdims=True), 1e-300)
    scores = w @ s @ s
    model = m.ContentRecommender(similarity="linear").fit(df := ratings(spark, rows), table)
    users = spark.createDataFrame([(u,) for u in range(13)], f"{U} long")
    got = {(r[U], r[I]): r["score"] for r in model.recommend(users, 9).collect()}
    for u in {u for u, _, _ in rows}:
        assert [got[u, i] for i in range(9)] == pytest.approx(scores[u].tolist(), abs=1e-9)
    assert [got[12, i] for i in range(9)] == pytest.approx((s.sum(0) / 9).tolist(), abs=1e-9)
    guess = {(r[U], r[I]): r["score"] for r in model.predict(df).collect()}
    assert all(v == pytest.approx(min(5, 1 + 4 * max(0, scores[u, i])), abs=1e-9) for (u, i), v in guess.items())
    with pytest.warns(UserWarning, match="cosine is used"):
        other = m.ContentRecommender(similarity="euclid").fit(df, table)
    want = m.ContentRecommender().fit(df, table).recommend(users, 3)
    assert sorted(map(tuple, other.recommend(users, 3).collect())) == sorted(map(tuple, want.collect()))


def test_tiles_change_nothing(spark, monkeypatch):
    df = ratings(spark, some_ratings())
    table = spark.createDataFrame(linear_features(), f"{I} long, feature string, value double")
    models = [m.ContentRecommender().fit(df, table), m.FactorRecommender(n_factors=3, n_epochs=2).fit(df)]
    whole = [sorted((r[U], r["rank"], r[I], round(r["score"], 9)) for r in x.recommend(df, 3, df).collect()) for x in models]
    monkeypatch.setattr(products, "TILE_BYTES", 100)
    assert [sorted((r[U], r["rank"], r[I], round(r["score"], 9)) for r in x.recommend(df, 3, df).collect()) for x in models] == whole
    assert "CartesianProduct" not in models[0].recommend(df, 3, df)._jdf.queryExecution().toString()


def test_ranks_by_ranges(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(s)) for i, s in enumerate(rng.integers(0, 20, 700))]
    df = spark.createDataFrame(rows, "i long, s double").repartition(5)
    got = sampling.ranked(df, [F.desc("s"), F.asc("i")], "place")
    assert {r["i"]: r["place"] for r in got.collect()} == {i: p for p, (i, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])), 1)}
    popular = m.PopularityRecommender().fit(df.select(F.col("i").alias(I), F.col("s").alias("rating"), F.lit(1).cast("long").alias(U)))
    seen = df.where("i < 30").select(F.lit(7).cast("long").alias(U), F.col("i").alias(I))
    lists = popular.recommend(seen, 5, seen)
    assert "SinglePartition" not in lists._jdf.queryExecution().toString()
    assert [r[I] for r in lists.orderBy("rank").collect()] == [i for i, _ in sorted(rows, key=lambda x: (-x[1], x[0])) if i >= 30][:5]


def people(n=70):
    rng = np.random.default_rng(9)
    return [(u, ["A", "B", None][rng.integers(3)], ["x", "y"][rng.integers(2)], None if u % 9 == 0 else float(rng.integers(0, 40))) for u in range(n)] + [(500, None, None, None), (501, None, None, 0.0)]


@pytest.mark.parametrize("fields", [["country", "kind"], ["country", "kind", "balance"], ["balance"]])
def test_demographics_equal_brute_force(spark, fields):
    """Mixed vectors of all customers against each other, for nearest customers, lists and scores."""
    rows = people()
    numbers = [r[3] for r in rows if r[3] is not None]
    vectors = {}
    for u, *values in rows:
        own = dict(zip(("country", "kind", "balance"), values, strict=True))
        v = {f"{f}_{own[f]}": 1.0 for f in fields if f != "balance" and own[f] is not None}
        if "balance" in fields and own["balance"]:
            v["balance"] = (own["balance"] - min(numbers)) / (max(numbers) - min(numbers))
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors[u] = {k: x / norm for k, x in v.items()} if norm else {}
    sim = lambda a, b: sum(x * vectors[b].get(k, 0.0) for k, x in vectors[a].items())
    rng = np.random.default_rng(2)
    bought = sorted({(int(rng.choice([r[0] for r in rows])), int(rng.integers(25))) for _ in range(350)})
    table = spark.createDataFrame(rows, f"{U} long, country string, kind string, balance double")
    df = ratings(spark, [(u, i, 3.0) for u, i in bought])
    own = m.Demographics(table, fields)
    k = 12
    near = {u: sorted((v for v in vectors if v != u), key=lambda v, u=u: (-round(sim(u, v), 9), v))[: k - 1] for u in vectors}
    got = {}
    for r in own.neighbours(table, k).collect():
        got.setdefault(r[U], {})[r["other"]] = r["sim"]
    assert got == {u: {v: pytest.approx(sim(u, v), abs=1e-9) for v in near[u]} for u in vectors}
    for seen in (None, df):
        want = {}
        for u in vectors:
            scores = {}
            for v in near[u]:
                for w, i in bought:
                    if w == v:
                        scores[i] = scores.get(i, 0.0) + sim(u, v)
            mine = {i for w, i in bought if w == u} if seen is not None else set()
            ranked = sorted((-round(s, 9), i) for i, s in scores.items() if i not in mine)[:6]
            want[u] = [i for _, i in ranked]
        lists = {}
        for r in own.recommend(table, df, 6, seen, k).collect():
            lists.setdefault(r[U], []).append((r["rank"], r[I]))
        assert {u: [i for _, i in sorted(v)] for u, v in lists.items()} == {u: v for u, v in want.items() if v}
    pairs = [(u, i) for u in [*vectors, 999] for i in (0, 3, 24, 77)]
    guess = {(r[U], r[I]): r["score"] for r in own.predict(spark.createDataFrame(pairs, f"{U} long, {I} long"), df).collect()}
    for u, i in pairs:
        buyers = [v for v, j in bought if j == i]
        assert guess[u, i] == pytest.approx(sum(sim(u, v) for v in buyers) / len(buyers) if buyers and u in vectors else 0.0, abs=1e-9)


@pytest.mark.parametrize("biased", [True, False])
def test_descent_equals_one_process(spark, biased):
    """The same schedule, one rating after another, in one process."""
    rows = some_ratings(25, 18, 3)
    df = ratings(spark, rows)
    blocks, n, epochs, lr, reg, seed = 3, 4, 3, 0.05, 0.02, 42
    model = m.SgdFactorRecommender(n_factors=n, n_epochs=epochs, lr=lr, reg=reg, blocks=blocks, biased=biased).fit(df)
    hashed = lambda s, *k: int(hashlib.md5(",".join(map(str, (s, *k))).encode()).hexdigest()[:13], 16)
    start = lambda kind, i: np.random.default_rng([seed, kind, i]).normal(0, 0.1, n)
    p, q = {u: start(0, u) for u, _, _ in rows}, {i: start(1, i) for _, i, _ in rows}
    bu, bi = dict.fromkeys(p, 0.0), dict.fromkeys(q, 0.0)
    mean = float(np.mean([r for *_, r in rows])) if biased else 0.0
    ub, ib = {u: hashed(seed + 1, u) % blocks for u in p}, {i: hashed(seed + 2, i) % blocks for i in q}
    for _ in range(epochs):
        for s in range(blocks):
            for b in range(blocks):
                own = sorted((x for x in rows if ub[x[0]] == b and ib[x[1]] == (b + s) % blocks), key=lambda x: hashed(seed, x[0], x[1]))
                turn, free = {}, Counter()
                for u, i, _ in own:
                    turn[u, i] = max(free["u", u], free["i", i])
                    free["u", u] = free["i", i] = turn[u, i] + 1
                for u, i, r in sorted(own, key=lambda x: (turn[x[0], x[1]], x[0])):
                    off = r - (mean + bu[u] + bi[i] + p[u] @ q[i])
                    if biased:
                        bu[u] += lr * (off - reg * bu[u])
                        bi[i] += lr * (off - reg * bi[i])
                    p[u], q[i] = p[u] + lr * (off * q[i] - reg * p[u]), q[i] + lr * (off * p[u] - reg * q[i])
    for r in model.tables["users"].collect():
        assert r["bu"] == pytest.approx(bu[r[U]], abs=1e-9) and r["p"] == pytest.approx(p[r[U]].tolist(), abs=1e-9)
    for r in model.tables["items"].collect():
        assert r["bi"] == pytest.approx(bi[r[I]], abs=1e-9) and r["q"] == pytest.approx(q[r[I]].tolist(), abs=1e-9)
    low, high = min(r for *_, r in rows), max(r for *_, r in rows)
    for r in model.predict(df).collect():
        u, i = r[U], r[I]
        assert r["score"] == pytest.approx(min(high, max(low, mean + bu[u] + bi[i] + p[u] @ q[i])), abs=1e-9)
    best = model.recommend(df, 3, df).where(f"{U} = 4 AND rank = 1").first()
    left = [i for i in q if (4, i) not in {(u, j) for u, j, _ in rows}]
    assert best[I] == max(left, key=lambda i: (round(bi[i] + p[4] @ q[i], 9), -i))


def test_descent_learns(spark):
    rows = some_ratings(30, 20, 2)
    df = ratings(spark, rows)
    model = m.SgdFactorRecommender(n_factors=4, n_epochs=12, lr=0.05, blocks=2).fit(df)
    error = math.sqrt(np.mean([(r["score"] - r["rating"]) ** 2 for r in model.predict(df).join(df, [U, I]).collect()]))
    assert error < 0.9 * np.std([r for *_, r in rows])
    unknown = model.predict(spark.createDataFrame([(999, 0)], f"{U} long, {I} long")).first()["score"]
    assert unknown == pytest.approx(np.mean([r for *_, r in rows]))


def test_settings_by_other_names():
    with pytest.warns(UserWarning, match="nothing reads: experiment.verbose"):
        config = Config({"data": {"paths": {"sales": "s.csv"}}, "models": {"collaborative": {"neighborhood": {"k_neighbors": 7}, "matrix_fact": {"lr_all": 0.1}}}, "experiment": {"verbose": True}})
    assert (config.get("data.sales"), config.get("models.neighborhood.k"), config.get("models.matrix_factorization.lr")) == ("s.csv", 7, 0.1)


def test_csv_keeps_what_it_can(spark, tmp_path):
    """Quotes, empty and null text, line ends and other encodings come back; damaged lines are marked."""
    rows = [(1, 'a "b", c', 1.5), (2, "", None), (3, None, 2.0), (4, "é ü", 0.0)]
    df = spark.createDataFrame(rows, "id long, t string, x double")
    for n, encoding in enumerate(("UTF-8", "ISO-8859-1")):
        write_csv(df, str(tmp_path / f"c{n}"), encoding)
        back = read_csv(spark, str(tmp_path / f"c{n}"), encoding, df.schema)
        assert sorted(tuple(r) for r in back.collect()) == [(*r, None) for r in rows]
    (tmp_path / "d.csv").write_text("id,t,x\n1,a,2.5\nx,b,3\n3,c\n4,d,1,9\n")
    back = sorted((tuple(r) for r in read_csv(spark, str(tmp_path / "d.csv"), schema=df.schema).collect()), key=str)
    assert back == sorted([(1, "a", 2.5, None), (None, "b", 3.0, "x,b,3"), (3, "c", None, "3,c"), (4, "d", 1.0, "4,d,1,9")], key=str)


def test_last_of_repeated_ratings_counts(spark):
    rows = [(1, 2, 5.0, 1), (1, 2, 2.0, 3), (1, 2, 4.0, 2), (1, 3, 1.0, 4), (1, 3, 3.0, 4), (1, 4, 4.5, None), (1, 4, 1.5, 1)]
    test = spark.createDataFrame(rows, f"{U} long, {I} long, rating double, timestamp long")
    assert {r[I]: (r["gain"], r["relevant"]) for r in e.relevance(test).collect()} == {2: (2.0, False), 3: (3.0, False), 4: (1.5, False)}
    assert {r[I]: r["gain"] for r in e.relevance(test.drop("timestamp")).collect()} == {2: 5.0, 3: 3.0, 4: 4.5}


@pytest.mark.parametrize("users", [True, False])
def test_rows_by_ranges_equal_pairs(spark, monkeypatch, users):
    """Many small ranges give what the grid of pairs gives: the nearest, pairs from a floor on, and scores of asked pairs."""
    rows = some_ratings(16, 13, 6)
    df, asked = ratings(spark, rows), spark.createDataFrame([(u, i) for u in range(17) for i in range(14)], f"{U} long, {I} long")

    def found():
        model = m.NeighbourhoodRecommender(user_based=users, k=3).fit(df)
        near = sorted((r["a"], r["rank"], r["b"], round(r["sim"], 9)) for r in model.index().collect())
        scores = sorted((r[U], r[I], round(r["score"], 9)) for r in model.predict(asked).collect())
        above = m.NeighbourhoodRecommender(user_based=users, min_similarity=0.2).fit(df).ordered_similarities()
        return near, scores, sorted((r["a"], r["b"], round(r["sim"], 9)) for r in above.collect())

    monkeypatch.setattr(by_rows, "RANGE_PAIRS", 40)
    monkeypatch.setattr(by_rows, "PAIRS_AT_ONCE", 16)
    ranges = found()
    monkeypatch.setattr(nb, "KEY_BLOCK", 1)
    assert ranges == found()


def test_tiles_give_no_seen_rows(spark, monkeypatch):
    """Users who have seen much, items of equal vectors: n rows leave each tile, besides ties, and they are the right ones."""
    rng = np.random.default_rng(5)
    kinds = rng.normal(size=(12, 4)).round(2)
    of = rng.integers(0, 12, 90)
    asked = rng.normal(size=(7, 4))
    seen = {(u, int(i)) for u in range(7) for i in rng.choice(90, 12 * u, replace=False)}
    at = F.array(*[F.lit(i) for i in range(4)])
    users = spark.createDataFrame([(u, v.tolist()) for u, v in enumerate(asked)], f"{U} long, vector array<double>").withColumn("at", at)
    items = spark.createDataFrame([(i, kinds[k].tolist()) for i, k in enumerate(of)], f"{I} long, vector array<double>").withColumn("at", at)
    monkeypatch.setattr(products, "ITEMS_AT_ONCE", 5)
    for size in (1 << 26, 600):
        monkeypatch.setattr(products, "TILE_BYTES", size)
        rows = products.blocked_top(users, items, 4, 4, spark.createDataFrame(sorted(seen), f"{U} long, {I} long")).collect()
        for u in range(7):
            scores = kinds[of] @ asked[u]
            want = sorted((i for i in range(90) if (u, i) not in seen), key=lambda i: (-round(scores[i], 9), i))[:4]
            got = sorted((r for r in rows if r[U] == u), key=lambda r: (-round(r["score"], 9), r[I]))
            assert [r[I] for r in got][:4] == want
        assert size == 600 or len(rows) < 2 * 7 * 4  # with the seen ones these were 280


def test_plans_stay_short(spark):
    """Fitted tables are read from files: a plan doesn't hold the plans of all tables before it, each of them twice."""
    df = ratings(spark, some_ratings())
    table = spark.createDataFrame(linear_features(), f"{I} long, feature string, value double")
    model = m.ContentRecommender().fit(df, table)
    lists = model.recommend(df, 3, df)
    assert "InMemoryRelation" not in lists._jdf.queryExecution().toString() and lists.count()
    model.release()


def test_sales_are_shuffled_once(spark):
    """Repeated rows change nothing, and ends of sales that no latest row has still count."""
    rows = [(1, 1, "2024-01-01", 9.0), (1, 1, "2024-02-01", 3.0), (1, 1, "2024-02-01", 3.0), (2, 1, "2024-01-01", None), (2, 1, "2023-01-01", 1.0)]
    sold = spark.createDataFrame(rows, f"{U} long, {I} long, order_date string, sales double").withColumn("order_date", F.col("order_date").cast("timestamp_ntz"))
    out = prepare.sales(sold)
    assert {(r[U], r["rating"]) for r in out.collect()} == {(1, 2.0), (2, None)}
    assert "Exchange" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("users", [True, False])
def test_proposals_meet_users_as_lists(spark, monkeypatch, users):
    """No proposal is a row of its own; many blocks give what rows give, with seen items, without, and for other ones than the rated."""
    df = ratings(spark, some_ratings(16, 13, 7))
    some = df.where(F.col(I) % 3 != 0).unionByName(ratings(spark, [(1, 99, 1.0), (55, 1, 1.0)]))
    model = m.NeighbourhoodRecommender(user_based=users, k=3, min_k=2).fit(df)
    model.index()

    def found():
        return [sorted((r[U], r["rank"], r[I], round(r["score"], 9)) for r in model.recommend(df.where(F.col(U) != 4), 4, seen).collect()) for seen in (df, None, some)]

    monkeypatch.setattr(nb, "RANGE_PAIRS", 20)
    assert "FlatMapGroupsInArrow" in model.recommend(df, 4, df)._jdf.queryExecution().toString()
    by_blocks = found()
    monkeypatch.setattr(nb, "ID_PAIRS", 0)
    assert "FlatMapGroupsInArrow" not in model.recommend(df, 4, df)._jdf.queryExecution().toString()
    assert by_blocks == found() and all(by_blocks)


@pytest.mark.parametrize("kind", ["cosine", "linear"])
def test_content_scores_where_shares_and_pairs_meet(spark, monkeypatch, tmp_path, kind):
    """No query vector goes to a pair, many blocks change nothing, and a model that is read back scores alike."""
    rows = [*some_ratings(), (3, 77, 2.0)]  # an item without features
    table = spark.createDataFrame(linear_features(), f"{I} long, feature string, value double")
    model = m.ContentRecommender(similarity=kind).fit(df := ratings(spark, rows), table)
    pairs = spark.createDataFrame([(u, i) for u in range(14) for i in (*range(10), 77, None)] + [(1, 2), (None, 3), (None, None)], f"{U} long, {I} long")
    raw = {(r[U], r[I]): r["s"] for r in model._raw(pairs).collect()}
    own = {(r[U], r[I]): r["own"] for r in model._shares.collect()}
    items, users = {r[I] for r in model.tables["catalogue"].collect()}, {u for u, i, _ in rows if i != 77}
    want = {(u, i): min(5.0, 1 + 4 * max(raw.get((u, i), 0.0) + own.get((u, i), 0.0), 0.0)) if u in users and i in items else 0.0 for u, i in map(tuple, pairs.collect())}
    monkeypatch.setattr(m, "BLOCK_ROWS", 5)
    found = model.predict(pairs)
    got = {(r[U], r[I]): r["score"] for r in found.collect()}
    assert got == {key: pytest.approx(v, abs=1e-9) for key, v in want.items()} and found.count() == len(want)
    assert max(got.values()) > 1 and "query" not in found._jdf.queryExecution().toString()
    model.save(path := str(tmp_path / "content"))
    back = recommender.Recommender.load(spark, path)
    assert {(r[U], r[I]): r["score"] for r in back.predict(pairs).collect()} == {key: pytest.approx(v, abs=1e-9) for key, v in want.items()}
    lists_of = [{(r[U], r["rank"]): (r[I], round(r["score"], 9)) for r in x.recommend(df, 3, df).collect()} for x in (back, model)]
    assert lists_of[0] == lists_of[1]


def test_purchases_carry_no_profiles(spark):
    """Scores by demographic profile come without a profile's text; unknown users and items, buyers without a vector and nulls are as before."""
    rows = [(1, "a", 1.0), (2, "a", 3.0), (3, None, None), (4, "b", 2.0)]
    model = m.Demographics(spark.createDataFrame(rows, f"{U} long, country string, balance double"), ["country", "balance"])
    df = ratings(spark, [(1, 7, 1.0), (3, 7, 1.0), (4, 7, 1.0), (4, 7, 2.0), (9, 7, 1.0), (3, 8, 1.0), (None, 7, 1.0)])
    asked = spark.createDataFrame([(2, 7), (2, 7), (3, 7), (9, 7), (2, 8), (2, 99), (None, 7), (2, None)], f"{U} long, {I} long")
    found = model.predict(asked, df)
    assert "profile" not in found._jdf.queryExecution().optimizedPlan().toString()
    # 2 is (1, 1) / root 2; 1 is (1, 0), 3 is zero, 4 is (0, 1, 0.5) / root 1.25
    want = (1 / math.sqrt(2) + 0 + 0.5 / math.sqrt(2.5)) / 3
    assert sorted((r[U] or 0, r[I] or 0, round(r["score"], 9)) for r in found.collect()) == [(0, 7, 0.0), (2, 0, 0.0), (2, 7, round(want, 9)), (2, 8, 0.0), (2, 99, 0.0), (3, 7, 0.0), (9, 7, 0.0)]


def test_ranges_get_no_ids_under_their_own(spark):
    """Of pairs a < b the lower id's range alone needs the list, from its own ids on; what has no pair isn't sent."""
    lists = {1: [2, 5, 11, 14, 25], 2: [3, 21], 3: [12], 4: [22, 23]}
    cells = spark.createDataFrame([(i, o, i / 10, 0.0, 0.0) for o, ids in lists.items() for i in ids], "id long, o long, z double, c double, r double")
    rows = by_rows.in_ranges(cells, np.array([10, 20]), above=True).collect()
    got = {(r["block"], r["o"]): sorted(r["id"]) for r in rows}
    assert got == {(0, 1): [2, 5, 11, 14, 25], (1, 1): [11, 14, 25], (0, 2): [3, 21], (2, 4): [22, 23]} and len(rows) == 4
    assert all(z == i / 10 for r in rows for i, z in zip(r["id"], r["z"], strict=True))


def test_cold_scores_ask_content_once(spark, monkeypatch):
    """Shares meet items once for warm and cold users together."""
    df, calls = ratings(spark, some_ratings()), []
    table = spark.createDataFrame(linear_features(), f"{I} long, feature string, value double")
    people_ = spark.createDataFrame([(u, "ab"[u % 2]) for u in range(12)], f"{U} long, country string")
    model = m.ColdStartRecommender(fields=["country"], min_interactions=4).fit(df, table, people_, people_.withColumnRenamed("country", "segment"))
    whole = m.ContentRecommender.predict
    monkeypatch.setattr(m.ContentRecommender, "predict", lambda self, pairs: calls.append(1) or whole(self, pairs))
    got = model.predict(df)
    assert len(calls) == 1 and got.count() == df.count()


@pytest.mark.parametrize("scale", [1.0, 1e18])
def test_leaves_that_cannot_reach_a_list_are_left_out(monkeypatch, scale):
    """Alike items lie together and most leaves' bounds keep them out; what is found is what all products give."""
    rng = np.random.default_rng(8)
    kinds = np.eye(40)[rng.integers(0, 20, 3000)] + np.eye(40)[20 + rng.integers(0, 5, 3000)]
    kinds[:, 39] = rng.random(3000)
    items, asked = kinds / np.sqrt((kinds**2).sum(1))[:, None], rng.normal(size=(50, 40)) * scale
    monkeypatch.setattr(products, "CROWD", 1 << 9)
    monkeypatch.setattr(products, "ITEMS_AT_ONCE", 16)
    places = [np.flatnonzero(x) for x in items]
    columns = {"at": [p.astype(np.int32) for p in places], "vector": [x[p] for x, p in zip(items, places, strict=True)], "ids": [[i] for i in range(len(items))]}
    kept = {"at": pa.int32(), "vector": pa.float64(), "ids": pa.int64()}
    tile = products._Tile(products._in_leaves(40)(pa.table({n: pa.array(c, pa.list_(kept[n])) for n, c in columns.items()})), 40)
    scores = asked @ items.T
    tenth = np.sort(scores, 1)[:, -10]
    bound = tile.bounds(asked, np.sqrt((asked**2).sum(1)), scale == 1.0)
    own = np.stack([scores[:, tile.ids[a:b]].max(1) for a, b in zip(tile.edges, tile.edges[1:], strict=False)], 1)
    assert (bound >= own).all() and (bound >= tenth[:, None]).mean() < 0.2
    seen = np.tile(np.arange(0, 3000, 7), 50)
    x, ids, score = tile.best(asked, np.full(50, len(seen) // 50), seen, 10)
    scores[:, ::7] = -np.inf
    for u in range(50):
        best = np.argsort(-scores[u])[:10]
        assert ids[x == u][:10].tolist() == best.tolist()
        assert score[x == u][:10] == pytest.approx(scores[u, best])


def test_profiles_meet_by_number(spark, monkeypatch):
    """Lists and nearest customers carry a number for each profile, no text; places that nobody like a profile fills go by key."""
    rows = [(5, "a", 1.0), (2, "a", 3.0), (3, None, None), (4, "b", 2.0), (9, "a", 1.0), (7, None, None)]
    model = m.Demographics(spark.createDataFrame(rows, f"{U} long, country string, balance double"), ["country", "balance"])
    df = ratings(spark, [(u, u * 10, 3.0) for u, *_ in rows])
    with_limit = m.Demographics.recommend.__globals__["SENT_PLACES"]
    monkeypatch.setitem(m.Demographics.recommend.__globals__, "SENT_PLACES", 0)
    sent = model.recommend(df, df, 3, df, 4)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin [profile" not in sent and "SortMergeJoin [profile" in sent  # rows of a ranking for each user aren't sent whole
    monkeypatch.setitem(m.Demographics.recommend.__globals__, "SENT_PLACES", with_limit)
    lists = model.recommend(df, df, 3, df, 4)
    plan = lists._jdf.queryExecution().optimizedPlan().toString()
    assert "country" not in plan and not [c for c in plan.split("StringType")[1:] if c.startswith("profile")]
    assert all(dict(t.dtypes)["profile"] == "bigint" for t in model._kept if "other" in t.columns)
    got = {}
    for r in model.neighbours(df, 4).collect():
        got.setdefault(r[U], []).append((r["other"], round(r["sim"], 6)))
    # 5 and 9 are (1, 0), 2 is (1, 1) / root 2, 4 is (1, 0.5) / root 1.25 of another country, 3 and 7 are zero
    assert got[5] == [(9, 1.0), (2, round(1 / math.sqrt(2), 6)), (3, 0.0)]
    assert got[3] == [(2, 0.0), (4, 0.0), (5, 0.0)] and {r["profile"][:2] for r in model.nearest(4).collect()} == {'{"', "{}"}


def test_strata_read_their_own_ratings(spark, monkeypatch):
    """Each stratum's part of the ratings is a folder that the scan alone opens, and they go when the model is fitted."""
    made, taken = [], []
    keep, drop = factors.stored, factors.remove
    monkeypatch.setattr(factors, "stored", lambda df, *a: made.append(keep(df, *a)) or made[-1], raising=False)
    monkeypatch.setattr(factors, "remove", lambda df: taken.append((df.inputFiles()[0], drop(df))), raising=False)
    model = m.SgdFactorRecommender(n_factors=2, n_epochs=1, blocks=3)
    model.fit(ratings(spark, some_ratings()))
    assert len(made) == len(taken) == 1 and "stratum" in made[0].columns
    folder = taken[0][0].split("/stratum=")[0]
    assert folder != taken[0][0]
    fs, own = shared.files(spark, folder)
    assert not fs.exists(own)
