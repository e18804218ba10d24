"""The corpus pipeline, stage by stage on its smallest table."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from shelfrank.llm import common, exact_dedup, langid, packing, quality, simhash

SF = "/root/testdata/sf0.001"


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept.append(docs.count())
        if name == "quality":
            good = {r["doc_id"] for r in quality.classify(before, labels).where(F.col("score") >= quality.CUT).collect()}
            assert {r["doc_id"] for r in docs.collect()} == good
        elif name == "language":
            own = {r["doc_id"] for r in langid.identify(before).where("lang_pred <> 'und' and score >= 0.5").collect()}
            assert {r["doc_id"] for r in docs.collect()} == own
        elif name == "near_copies":
            shingles = [set(simhash.shingles(simhash.words_of(r["text"]), 5)) for r in docs.collect()]
            alike = sum(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(shingles) for b in shingles[:i])
            assert alike == 0 and docs.count() > 0
        elif name == "repeats":
            left = Counter(r["doc_id"] for r in exact_dedup.remove_repeats(before).where("length(kept_bytes) > 0 or n_bytes = 0").collect())
            assert Counter(r["doc_id"] for r in docs.collect()) == left
        else:
            assert Counter(r["doc_id"] for r in docs.where("piece = 0").collect()) == Counter(r["doc_id"] for r in before.collect())
            assert docs.where(F.col("bin_offset") + F.col("n_tokens") > F.col("bin_length")).count() == 0
            assert {r["bin_length"] for r in docs.select("bin_length").distinct().collect()} <= set(packing.LENGTHS)
    assert kept[0] >= kept[1] >= kept[2] >= kept[3] > 0


def test_run(spark):
    before = common.written()
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert common.written() == before


def good_rows(spark):
    """Documents of the smallest table that pass the first two stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return corpus_pipeline.language_stage(spark, corpus_pipeline.quality_stage(spark, docs, SF), SF)


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    """Rows without ids or texts, repeated rows and columns with names used inside go through all stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["row", "stats", "found", "cut", "starts", "kept", "piece", "bin_id", "__row", "key", "score"]
    some = good_rows(spark).orderBy("doc_id").limit(3)
    odd = [(None, None), (None, ""), (900_001, None), (900_002, ""), (900_003, " \t "), (900_004, "½ 12")]
    extra = spark.createDataFrame(odd, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")})
    table = docs.unionByName(some).unionByName(some.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(extra)
    table = table.withColumns({n: F.lit(str(i)) for i, n in enumerate(names)})
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == table.columns, name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        ids = Counter(r["doc_id"] for r in now.select("doc_id").collect())
        if name in ("near_copies", "repeats"):
            assert max(ids.values()) == 1 and None not in ids
    packed = corpus_pipeline.packing_stage(spark, now, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == set(ids)


def test_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "bin_id" in out.columns


def test_stages_keep_empty_texts_as_documented(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " "), (None, None)], "doc_id long, text string")
    assert corpus_pipeline.language_stage(spark, rows.withColumn("lang", F.lit(None).cast("string")), SF).count() == 0
    assert [r["doc_id"] for r in corpus_pipeline.near_copies_stage(spark, rows, SF).collect()] == [1]
    assert corpus_pipeline.repeats_stage(spark, rows, SF).count() == 4
    assert [r["n_tokens"] for r in corpus_pipeline.packing_stage(spark, rows, SF).where("doc_id = 1").collect()] == [1]
