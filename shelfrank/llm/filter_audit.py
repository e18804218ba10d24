"""How five document filters act on each other, in every order in which they can be applied.

Each document gets five flags, is crossed with the 120 orders, and its steps are exploded: the first step whose filter
it fails removes it. All counts are conditional sums that are combined in the tasks before anything is shuffled.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.llm.common import column_or_null, stored

FILTERS = "ABCDE"
#: Words are what lies between these characters.
SPACE = r"[\x20\x09-\x0D]+"


def text_flags(text: Column) -> Column:
    """Bits 0 to 3: under 50 words, few distinct words, many capitals, one of ``#$%&*|``."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike(r"[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, flags, good, toxic) of every row; bit 4 of ``flags`` marks a text that a smaller ``doc_id`` has as well.

    Null texts are empty ones. A null ``doc_id`` is not smaller than any other and has none below it. Of repeated rows
    none is below the other. A document with several labels is good or toxic if one of them says so.
    Texts are compared by SHA-256. One row for each distinct text, its least id, is joined back by digest and id, so a
    text that many documents share is spread over all tasks.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    part = F.coalesce(column_or_null(docs, "source", "string"), F.lit("")).alias("part")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), part, text_flags(text).alias("flags"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = stored(rows, "flags")  # short rows: texts are read and measured once
    firsts = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), *[column_or_null(labels, c, "int") for c in ("quality", "toxic")])
    marks = marks.groupBy("doc_id").agg(*[F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))])
    copy = F.when(F.col("doc_id").isNotNull() & F.col("is_first").isNull(), 16).otherwise(0)
    placed = rows.join(firsts, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    return placed.select("part", (F.col("flags") + copy).alias("flags"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def orders(spark: SparkSession) -> DataFrame:
    """The 120 orders: ``places`` has the step of each filter, ``filters`` the filter of each step."""
    rows = []
    for n, own in enumerate(permutations(range(len(FILTERS)))):
        rows.append((n, "".join(FILTERS[i] for i in own), [own.index(i) + 1 for i in range(len(FILTERS))], list(own)))
    return spark.createDataFrame(rows, "order_no int, filter_order string, places array<int>, filters array<int>")


def audit(flags: DataFrame) -> DataFrame:
    """A row for each part, order and step, from what ``flagged`` returns; an empty table has no part and no row."""
    replayed = orders(flags.sparkSession)
    crossed = flags.crossJoin(F.broadcast(replayed.drop("filter_order")))  # 120 rows
    removed_at = F.least(*[F.when(F.col("flags").bitwiseAND(1 << i) != 0, F.get("places", F.lit(i))).otherwise(len(FILTERS) + 1) for i in range(len(FILTERS))])
    steps = crossed.select("part", "order_no", "flags", "good", "toxic", removed_at.alias("removed_at"), F.posexplode("filters").alias("at", "filter"))
    step, at = F.col("at") + 1, F.col("removed_at")
    bit = F.call_function("shiftleft", F.lit(1), F.col("filter"))
    here, fails = at == step, F.col("flags").bitwiseAND(bit) != 0
    counts = {
        "kept": at > step, "removed": here, "redundant": fails & (at < step), "unique_fails": F.col("flags") == bit,
        "good_lost": here & F.col("good"), "toxic_lost": here & F.col("toxic"),
    }
    counted = steps.groupBy("part", "order_no", "at", "filter").agg(*[F.count_if(c).alias(k) for k, c in counts.items()])
    # of each part and filter 120 orders are left
    shares = counted.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    named = counted.join(shares, ["part", "filter"]).join(F.broadcast(replayed.select("order_no", "filter_order")), "order_no")
    return named.select("part", "filter_order", step.cast("int").alias("step"), *counts, "shapley")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the five filters over every document, in all orders."""
    return audit(flagged(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")]))


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM texts
), firsts AS (
  SELECT text, min(doc_id) AS least FROM texts GROUP BY text
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), measured AS (
  SELECT s.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic, [
    len(s.words) < 50,
    100 * len(list_distinct(s.words)) < 65 * len(s.words),
    100 * length(regexp_replace(s.text, '[^A-Z]', '', 'g')) > 5 * length(s.text),
    regexp_matches(s.text, '[#$%&*|]'),
    coalesce(f.least < s.doc_id, false)
  ] AS fails
  FROM split s LEFT JOIN firsts f ON s.text = f.text LEFT JOIN marks m ON s.doc_id = m.doc_id
), letters AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS f
), orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders
), replayed AS (
  SELECT part, o, step, good, toxic, fails[o[step]] AS failing, len(list_filter(fails, lambda x: x)) AS n_fails,
    len(list_filter(o[1:step - 1], lambda f: fails[f])) AS before
  FROM measured, steps
), counted AS (
  SELECT part, o, step, o[step] AS filter,
    count(*) FILTER (before = 0 AND NOT failing) AS kept, count(*) FILTER (before = 0 AND failing) AS removed,
    count(*) FILTER (before > 0 AND failing) AS redundant, count(*) FILTER (failing AND n_fails = 1) AS unique_fails,
    count(*) FILTER (before = 0 AND failing AND good = 1) AS good_lost, count(*) FILTER (before = 0 AND failing AND toxic = 1) AS toxic_lost
  FROM replayed GROUP BY part, o, step
)
SELECT part, array_to_string(list_transform(o, lambda x: chr(64 + x)), '') AS filter_order, step::INTEGER AS step, kept, removed, redundant,
  unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM counted
"""
