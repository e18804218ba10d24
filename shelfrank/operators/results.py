"""Tables over tall results (model, segment, metric, k, value), and their sinks."""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from shelfrank.operators.recommender import Recommender
from shelfrank.sources.shared import size_of

RESOURCES = ("training_time", "memory_mb", "latency_ms", "model_size_mb", "throughput")


def named(results: DataFrame) -> DataFrame:
    """Results with ``name``: the metric, with @k where it has one."""
    return results.withColumn("name", F.when(F.col("k").isNull(), F.col("metric")).otherwise(F.concat(F.col("metric"), F.lit("@"), F.col("k").cast("string"))))


def model_matrix(results: DataFrame, names: list[str]) -> DataFrame:
    """A row per model and a column per named metric, over all users."""
    overall = named(results).where(F.col("segment").isNull())
    return overall.groupBy("model").pivot("name", names).agg(F.first("value"))


def segment_matrix(results: DataFrame, model: str, names: list[str]) -> DataFrame:
    """A row per segment, and one named Overall, of one model."""
    own = named(results).where(F.col("model") == model).withColumn("segment", F.coalesce("segment", F.lit("Overall")))
    return own.groupBy("segment").pivot("name", names).agg(F.first("value"))


def common_metrics(results: DataFrame) -> DataFrame:
    """Names of the metrics that every model has."""
    overall = named(results).where(F.col("segment").isNull())
    models = overall.agg(F.count_distinct("model").alias("models"))
    counts = overall.groupBy("name").agg(F.count_distinct("model").alias("n"))
    return counts.join(F.broadcast(models)).where(F.col("n") == F.col("models")).select("name")


def best_model(results: DataFrame, name: str) -> DataFrame:
    """(model, value) of the highest value of a metric; ties go to the lower name."""
    return named(results).where(F.col("segment").isNull() & (F.col("name") == name)).orderBy(F.desc("value"), "model").limit(1).select("model", "value")


def performance_summary(results: DataFrame, resources: DataFrame, names: list[str]) -> DataFrame:
    """Resources (model, metric, value) and metrics of each model side by side, with four decimals; 'N/A' for missing."""
    wide = model_matrix(results, names).join(resources.groupBy("model").pivot("metric", list(RESOURCES)).agg(F.first("value")), "model", "full")
    return wide.select("model", *[F.coalesce(F.round(F.col(f"`{c}`"), 4).cast("decimal(38,4)").cast("string"), F.lit("N/A")).alias(c) for c in (*RESOURCES, *names)])


def optimal_models(results: DataFrame, resources: DataFrame, quality: str = "ndcg@10", performance_weight: float = 0.7, efficiency_weight: float = 0.3) -> DataFrame:
    """(criterion, model, value): the best by quality, by each resource among positive values, and overall."""
    matrix = model_matrix(results, [quality]).select("model", F.col(f"`{quality}`").alias("quality"))
    wide = matrix.join(resources.groupBy("model").pivot("metric", list(RESOURCES)).agg(F.first("value")), "model", "left")

    def first(criterion: str, value, ascending: bool) -> DataFrame:
        order = F.asc("value") if ascending else F.desc("value")
        return wide.select(F.lit(criterion).alias("criterion"), "model", value.alias("value")).where(F.col("value").isNotNull()).orderBy(order, "model").limit(1)

    def inverse(c: str, default: float):
        return 1 / (1 + F.coalesce(F.col(c), F.lit(default)))

    efficiency = (inverse("training_time", 1.0) + inverse("memory_mb", 100.0) + inverse("latency_ms", 1.0)) / 3
    overall = efficiency_weight * efficiency + performance_weight * F.coalesce("quality", F.lit(0.0))
    out = first("best_quality", F.col("quality"), False)
    for name in ("training_time", "memory_mb", "latency_ms", "model_size_mb"):
        out = out.unionByName(first(f"least_{name}", F.when(F.col(name) > 0, F.col(name)), True))
    return out.unionByName(first("best_overall", overall, False))


def scaled_over_models(results: DataFrame) -> DataFrame:
    """(model, name, value) scaled to 0..1 over the models for each metric; 0.5 where all are equal."""
    overall = named(results).where(F.col("segment").isNull())
    by = Window.partitionBy("name")
    low, high = F.min("value").over(by), F.max("value").over(by)
    return overall.select("model", "name", F.when(high > low, (F.col("value") - low) / (high - low)).otherwise(0.5).alias("value"))


def metric_correlation(results: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, r): Pearson correlation over models of each pair of metrics; null where one is constant."""
    wide = model_matrix(results, names)
    pairs = list(combinations(names, 2))
    deviates = lambda c: F.max(F.col(f"`{c}`")) > F.min(F.col(f"`{c}`"))
    row = wide.agg(*[F.when(deviates(a) & deviates(b), F.corr(F.col(f"`{a}`"), F.col(f"`{b}`"))).alias(f"{a}|{b}") for a, b in pairs])
    tall = row.unpivot([], [F.col(f"`{a}|{b}`") for a, b in pairs], "pair", "r")
    return tall.select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "r")


def _last_stage(spark: SparkSession) -> int:
    return max((s.stageId() for s in _stages(spark)), default=-1)


def _stages(spark: SparkSession) -> list:
    """What Spark's status store knows of the stages of this application."""
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
    found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return [found.apply(i) for i in range(found.size())]


def peak_memory(spark: SparkSession, after: int) -> float:
    """MB: the largest execution memory that the tasks of one stage after the stage ``after`` held, and what caches hold now."""
    used = max((s.peakExecutionMemory() for s in _stages(spark) if s.stageId() > after), default=0)
    held = sum(x.memSize() for x in spark.sparkContext._jsc.sc().getRDDStorageInfo())
    return (used + held) / 1e6


def measured(name: str, fit: Callable[[], Recommender], users: DataFrame, n: int, path: str) -> tuple[DataFrame, DataFrame]:
    """The lists of the model that ``fit`` returns, written under ``path``, and (model, metric, value) rows of what it took.

    The model is saved under ``path``: ``training_time`` (seconds) ends when that is done, ``model_size_mb`` is the size
    of its files. The lists are written then: ``throughput`` is rows a second, ``latency_ms`` the time for each user,
    both of a batch. ``memory_mb`` is the execution memory of the largest stage of either, and what was cached.
    """
    spark = users.sparkSession
    before, began = _last_stage(spark), time.monotonic()
    model = fit()
    folder = model.save(f"{path}/models/{name}")
    trained = time.monotonic() - began
    memory = peak_memory(spark, before)
    rows = Observation()
    lists = model.recommend(users, n)
    began = time.monotonic()
    lists.observe(rows, F.count("*").alias("rows"), F.approx_count_distinct("customer_key").alias("users")).write.parquet(to := f"{path}/lists/{name}")
    took = max(time.monotonic() - began, 1e-9)
    made = rows.get
    memory = max(memory, peak_memory(spark, before))
    model.release()
    values = [
        (name, "training_time", trained), (name, "memory_mb", memory), (name, "latency_ms", 1000 * took / max(made["users"], 1)),
        (name, "model_size_mb", size_of(spark, folder) / 1e6), (name, "throughput", made["rows"] / took),
    ]
    return spark.read.schema(lists.schema).parquet(to), spark.createDataFrame(values, "model string, metric string, value double")


def experiment_id(now: datetime.datetime | None = None) -> str:
    return f"experiment-{now or datetime.datetime.now():%Y%m%d_%H%M%S}"


def save_csv(results: DataFrame, resources: DataFrame, path: str) -> dict[str, str]:
    """Folders of CSV: overall results, resources in wide form, segment results."""
    out = {n: f"{path}/{n}" for n in ("evaluation_results", "resource_metrics", "segment_results")}
    write = lambda df, to: df.coalesce(1).write.mode("overwrite").option("header", True).csv(to)  # noqa: E731  a few rows per model
    tall = named(results)
    write(tall.where(F.col("segment").isNull()).select("model", F.col("name").alias("metric"), "value"), out["evaluation_results"])
    wide = resources.groupBy("model").pivot("metric", list(RESOURCES)).agg(F.first("value"))
    write(wide.select("model", *[F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias(c) for c in RESOURCES]), out["resource_metrics"])
    write(tall.where(F.col("segment").isNotNull()).select("model", "segment", F.col("name").alias("metric"), "value"), out["segment_results"])
    return out


def save_json(results: DataFrame, path: str) -> None:
    results.coalesce(1).write.mode("overwrite").json(path)


def load_json(spark, path: str) -> DataFrame:
    return spark.read.schema("model string, segment string, metric string, k int, value double").json(path)


def save_resources(resources: DataFrame, path: str) -> None:
    resources.coalesce(1).write.mode("overwrite").json(path)


def load_resources(spark: SparkSession, path: str) -> DataFrame:
    """(model, metric, value) of a stored run."""
    return spark.read.schema("model string, metric string, value double").json(path)


def sheets(results: DataFrame, resources: DataFrame, names: list[str]) -> dict[str, DataFrame]:
    """The tables of a workbook, by sheet."""
    tall = named(results)
    out = {
        "Performance Summary": performance_summary(results, resources, names),
        "Detailed Metrics": tall.where(F.col("segment").isNull()).select("model", "name", "value"),
        "Resource Usage": resources,
    }
    segments = tall.where(F.col("segment").isNotNull()).select("model", "segment", "name", "value")
    return out if segments.isEmpty() else out | {"Segment Analysis": segments}


def save_excel(tables: dict[str, DataFrame], path: str) -> None:
    """A workbook of small tables; needs openpyxl."""
    import pandas as pd

    with pd.ExcelWriter(path) as book:
        for name, df in tables.items():
            df.toPandas().to_excel(book, sheet_name=name, index=False)


def _markdown(df: DataFrame) -> list[str]:
    rows = df.collect()  # a row per model or segment
    cell = lambda x: f"{x:.4f}" if isinstance(x, float) else str(x)
    return ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join(map(cell, r)) + " |" for r in rows], ""]


def report(results: DataFrame, resources: DataFrame, names: list[str]) -> str:
    """Markdown: metrics by model, resources, segments, and the best models."""
    out = ["# Results", "", "## Metrics", "", *_markdown(model_matrix(results, names).orderBy("model"))]
    out += ["## Resources", "", *_markdown(resources.orderBy("model", "metric"))]
    segments = named(results).where(F.col("segment").isNotNull())
    if not segments.isEmpty():
        out += ["## Segments", "", *_markdown(segments.where(F.col("name").isin(names)).select("model", "segment", "name", "value").orderBy("name", "segment", F.desc("value"), "model"))]
    out += ["## Best models", ""]
    for name in names:
        for r in best_model(results, name).collect():
            out.append(f"- {name}: {r['model']} ({r['value']:.4f})")
    return "\n".join([*out, "", "## Optimal models", "", *_markdown(optimal_models(results, resources, names[0]))])
