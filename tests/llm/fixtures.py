"""Small tables for the tests of this folder."""

from __future__ import annotations

import random

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, n int, id long, fp long, score double, kept string, start int, block int"


def words(seed: int, n: int, alphabet: str = "abcdefghijklmnop") -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 9))) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and wordless texts, one very long text, copies, near copies, other scripts, a null id, a repeated row."""
    base = words(1, 300)
    changed = base.split(" ")
    changed[150] = "changed"
    shared = words(5, 60)
    return [
        (3, base), (1, " ".join(changed)), (2, None), (4, ""), (5, " \n\t "), (6, words(2, 40)), (7, words(2, 40)), (8, "short"),
        (9, words(3, 30) + " " + shared + " " + words(4, 30)), (10, words(6, 30) + " " + shared), (11, words(7, 20_000)),
        (12, "Ä ö ü 漢字 テスト, καλημέρα κόσμε. привет мир!"), (12, "Ä ö ü 漢字 テスト, καλημέρα κόσμε. привет мир!"), (None, words(8, 25)), (13, "a" * 5000), (14, "ab" * 3000),
    ]


def documents(spark, path, rows=None):
    """The rows as a table in files, with columns whose names the operators use inside."""
    rows = texts() if rows is None else rows
    full = [(i, t, "en" if (i or 0) % 2 else None, "s", len(t or ""), 7, "k", 1, 5, 9, 0.5, "x", 3, 2) for i, t in rows]
    spark.createDataFrame(full, CLASHING).repartition(2, "doc_id").write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))


def in_order(docs) -> list[tuple]:
    """(doc_id, text) in the order in which the table is read."""
    return [(r["doc_id"], r["text"]) for r in docs.collect()]
