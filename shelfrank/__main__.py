"""Command line: lists for a customer, an experiment over models, or a profile of the data.

    python -m shelfrank recommend --config settings.yaml --model content --user 7
    python -m shelfrank experiment --config settings.yaml --models popularity content --out results
    python -m shelfrank profile --config settings.yaml
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.operators import analytics, features, metrics, models, results, splits
from shelfrank.operators.prepare import feature_columns
from shelfrank.sources.catalog import Catalog
from shelfrank.sources.config import Config, SplitOptions

U, I = "customer_key", "product_key"
MODELS = ("random", "popularity", "content", "neighborhood", "matrix_factorization", "hybrid", "cold_start")


def fitted(name: str, catalog: Catalog, config: Config, train: DataFrame) -> models.Recommender:
    """A model of the settings, fitted on the training rows."""
    if name == "random":
        return models.RandomRecommender().fit(train)
    if name == "popularity":
        return models.PopularityRecommender(**config.get("models.popularity", {})).fit(train)
    if name == "neighborhood":
        o = config.get("models.neighborhood", {})
        return models.NeighbourhoodRecommender(**{k: o[k] for k in ("user_based", "k", "min_k", "similarity", "min_similarity") if k in o}).fit(train)
    if name == "matrix_factorization":
        o = dict(config.get("models.matrix_factorization", {}))
        solver = o.pop("solver", "sgd" if {"lr", "biased"} & o.keys() else "als")
        return (models.SgdFactorRecommender if solver == "sgd" else models.FactorRecommender)(**o).fit(train)
    if name not in MODELS:
        raise ValueError(f"no such model: {name}; there are {', '.join(MODELS)}")
    if name == "hybrid":
        weights = config.get("models.hybrid.weights")
        both = {"content": "content", "collaborative": "matrix_factorization"}
        out = models.HybridRecommender(weights={k: weights[k] for k in both if k in weights})
        for part, kind in both.items():
            out.add(part, fitted(kind, catalog, config, train))
        return out
    texts, categorical, numeric = feature_columns(catalog.products)
    words = {k: v for k, v in config.get("models.content_based", {}).items() if k in ("max_features", "min_df", "max_df")}
    table = features.item_features(catalog.products, texts, categorical, numeric, **words)
    if name == "content":
        return models.ContentRecommender(similarity=config.get("models.content_based.similarity", "cosine")).fit(train, table)
    o = config.get("models.cold_start", {})
    return models.ColdStartRecommender(**o).fit(train, table, catalog.user_features(), catalog.customer_segments())


def recommend(catalog: Catalog, config: Config, name: str, user: int, n: int) -> DataFrame:
    """The list of one customer, with product names ('Unknown' where the table has none)."""
    rows = catalog.interactions()
    seen = rows.where(F.col(U) == user)
    spark = rows.sparkSession
    lists = fitted(name, catalog, config, rows).recommend(spark.createDataFrame([(user,)], f"{U} long"), n, seen)
    names = catalog.products.select(I, *[c for c in ("product_name",) if c in catalog.products.columns])
    out = lists.join(names, I, "left")
    return out.withColumn("product_name", F.coalesce("product_name", F.lit("Unknown"))) if "product_name" in out.columns else out


def _written(df: DataFrame, path: str) -> DataFrame:
    """The table in a folder of its own: later plans begin there instead of holding all that made it."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def experiment(catalog: Catalog, config: Config, names: list[str], out: str) -> DataFrame:
    """Trains on the training half alone, evaluates each model, writes results under ``out`` and returns them."""
    path = f"{out}/{results.experiment_id()}"
    halves = splits.split(catalog.interactions(), SplitOptions.of(config))
    train, test = (_written(h, f"{path}/{name}") for h, name in zip(halves, ("train", "test"), strict=True))
    ks = tuple(config.get("evaluation.k_values"))
    lists, took = {}, None
    for name in names:
        lists[name], own = results.measured(name, lambda name=name: fitted(name, catalog, config, train), test.select(U), max(ks), path)
        took = own if took is None else took.unionByName(own)
    sets = features.feature_sets(catalog.products, [c for c in ("category", "sub_category") if c in catalog.products.columns])
    options = {"ks": ks, "metrics": tuple(config.get("evaluation.metrics")), "threshold": config.get("evaluation.relevance_threshold")}
    segment_of = catalog.customer_segments() if catalog.customer_report is not None else None
    found = metrics.compare(lists, test, sets=sets, segment_of=segment_of, **options)
    results.save_json(found, f"{path}/results")
    found = results.load_json(found.sparkSession, f"{path}/results")
    results.save_resources(took, f"{path}/resources")
    results.save_csv(found, took, path)
    return found


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("mode", choices=["recommend", "experiment", "profile"])
    parser.add_argument("--config", help="YAML or JSON settings")
    parser.add_argument("--data-dir")
    parser.add_argument("--model", default="popularity", choices=MODELS)
    parser.add_argument("--models", nargs="+", default=["all"])
    parser.add_argument("--user", type=int)
    parser.add_argument("--n", type=int)
    parser.add_argument("--out")
    o = parser.parse_args(args)
    config = Config.load(o.config) if o.config else Config()
    if o.data_dir:
        config.set("data.dir", o.data_dir)
    spark = SparkSession.builder.appName("shelfrank").getOrCreate()
    catalog = Catalog.load(spark, config)
    if o.mode == "recommend":
        if o.user is None:
            parser.error("recommend needs --user")
        recommend(catalog, config, o.model, o.user, o.n or config.get("models.base.top_k")).orderBy("rank").show(truncate=False)
    elif o.mode == "experiment":
        names = [m for m in MODELS] if o.models == ["all"] else o.models
        ks = config.get("evaluation.k_values")
        results.model_matrix(experiment(catalog, config, names, o.out or config.get("output.dir")), [f"ndcg@{k}" for k in ks]).show(truncate=False)
    else:
        rows = catalog.interactions().persist()
        analytics.sparsity(rows).show(vertical=True)
        analytics.validation(rows).show(vertical=True)


if __name__ == "__main__":
    main()
