"""SimHash near-dedup and suffix-array dedup against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from shelfrank.llm import exact_dedup, simhash, suffixes
from tests.llm.fixtures import documents, in_order, texts, words


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))] if found else []
    counts = Counter()
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        counts.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                root[find(a)] = find(b)
    return [find(x) for x in range(n)]


def expected_links(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    group = components(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    least = defaultdict(list)
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g].append(i)
    return Counter((i, f"{p:016x}", min(least[g]) if least[g] else None) for (i, _), p, g in zip(rows, prints, group, strict=True))


def test_simhash_links(spark, tmp_path):
    rows = texts() + [(100 + i, words(50, 80) + (" x" * (i % 3))) for i in range(40)]
    docs = documents(spark, tmp_path / "d", rows)
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.link(docs).collect())
    assert got == expected_links(rows)


def test_simhash_large_buckets(spark, tmp_path):
    """Buckets over the limit are linked by variants; the result is the same."""
    rows = [(i, words(9, 60) + f" {i % 7} {i % 5}") for i in range(60)]
    docs = documents(spark, tmp_path / "d", rows)
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.link(docs, large=4).collect())
    assert got == expected_links(rows)


def test_pivot_coordinates_bound_distance():
    rng = np.random.default_rng(1)
    pivots = [p & (2**64 - 1) for p in simhash.pivot_fingerprints()]
    for _ in range(200):
        a = int(rng.integers(0, 2**63))
        b = a
        for bit in rng.choice(63, 3, replace=False):
            b ^= 1 << int(bit)
        assert max(abs((a ^ p).bit_count() - (b ^ p).bit_count()) for p in pivots) <= 3


def test_near_copies_keep_one_and_lose_no_clean_document(spark, tmp_path):
    rows = texts()
    docs = documents(spark, tmp_path / "d", rows)
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    ids = Counter(r["doc_id"] for r in left.collect())
    # 1 and 3 are near copies, 2, 4 and 5 have no words, 6 and 7 are equal, 12 stands twice
    assert ids == Counter([1, 2, 6, 8, 9, 10, 11, 12, None, 13, 14])


def test_near_copies_of_a_large_group(spark, tmp_path):
    base = words(20, 200).split(" ")
    rows = [(i, " ".join([*base[:195], f"w{i}"])) for i in range(150)] + [(1000 + i, words(300 + i, 50)) for i in range(20)]
    left = simhash.drop_near_copies(documents(spark, tmp_path / "d", rows))
    assert sorted(r["doc_id"] for r in left.collect()) == [0, *range(1000, 1020)]


def test_near_copies_inside_a_template_family(spark, tmp_path):
    """Many separate pairs share a long passage, so that all meet in large buckets: each pair loses one, and no pair joins another."""
    shared = words(30, 200)
    rows = [(2 * i + j, f"{shared} {words(1000 + i, 8)} {words(2000 + 2 * i + j, 22)}") for i in range(120) for j in range(2)]
    sets = [set(simhash.shingles(simhash.words_of(t), 5)) for _, t in rows]
    alike = {(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert alike == {(2 * i + 1, 2 * i) for i in range(120)}
    left = simhash.drop_near_copies(documents(spark, tmp_path / "d", rows))
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(0, 240, 2))


def kept_by_all_pairs(rows, width=5, similarity=0.8):
    """The smallest id of each group of near copies, by comparing all pairs."""
    sets = [set(simhash.shingles(simhash.words_of(t), width)) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common >= similarity * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    return sorted(min(ids) for ids in groups.values())


@pytest.mark.parametrize("edited", [False, True])
def test_near_copies_in_large_buckets_by_all_pairs(spark, tmp_path, monkeypatch, edited):
    """Pairs on either side of the bound: families around long passages, and edits of one text, which alone need pairs of blocks."""
    monkeypatch.setattr(simhash, "PAIRED_BUCKET", 4)
    rng, rows = np.random.default_rng(7), []
    for family in range(3):
        passage = words(700 + family, 120)
        for i in range(24):
            if edited:
                text = passage.split(" ")
                for at in rng.choice(len(text), int(rng.integers(1, 5)), replace=False):
                    text[at] = f"e{len(rows)}x{at}"
                rows.append((len(rows), " ".join(text)))
            else:
                unique = words(3000 + 100 * family + i - i % 3, int(rng.integers(20, 60)))
                rows.append((len(rows), f"{passage} {unique} {words(9000 + len(rows), int(rng.integers(0, 24)))}"))
    used = []
    monkeypatch.setattr(simhash, "_block_links", lambda *a, f=simhash._block_links: (used.append(1), f(*a))[1])
    compared = []
    monkeypatch.setattr(simhash, "_rare_pairs", lambda *a, f=simhash._rare_pairs: (compared.append(1), f(*a))[1])
    left = simhash.drop_near_copies(documents(spark, tmp_path / "d", rows))
    assert sorted(r["doc_id"] for r in left.collect()) == kept_by_all_pairs(rows)
    assert compared and bool(used) == edited


def plain_repeats(rows, window):
    """(doc_id, removed, spans, digest of what stays) by a dictionary of all strings, rows by id (nulls first)."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, out = set(), Counter()
    for i in order:
        raw = (rows[i][1] or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for at in range(len(raw) - window + 1):
            piece = raw[at : at + window]
            if piece in seen:
                gone[at : at + window] = True
            seen.add(piece)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out[rows[i][0], len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("window", [20, 100])
def test_suffix_dedup(spark, tmp_path, window):
    rows = texts() + [(50 + i, words(77, 30) + words(400 + i, 20) + words(78, 30)) for i in range(30)]
    docs = documents(spark, tmp_path / "d", rows)
    done = exact_dedup.remove_repeats(docs, window).collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept_bytes"]).hexdigest()) for r in done)
    assert got == plain_repeats(in_order(docs), window)
    assert set(docs.columns) < set(done[0].__fields__)


def test_suffix_dedup_busy_keys(spark, tmp_path, monkeypatch):
    """A passage that most documents hold, whole and between different neighbours, is settled without a task for itself."""
    monkeypatch.setattr(exact_dedup, "BUSY_ROWS", 5)
    monkeypatch.setattr(exact_dedup, "SLICE_BYTES", 300)
    common = words(61, 30)
    rows = [(i, common if i % 3 else f"{words(800 + i, 9)} {common} {words(900 + i % 4, 9)}") for i in range(40)] + [(None, common), (3, common)]
    docs = documents(spark, tmp_path / "d", rows)
    done = exact_dedup.remove_repeats(docs, 50).collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept_bytes"]).hexdigest()) for r in done)
    assert got == plain_repeats(in_order(docs), 50)


def test_rows_stay_themselves_while_splits_change(spark, tmp_path, monkeypatch):
    """Every pass sees other splits of the files, as when executors come and go; columns have names that are used inside."""
    rows = [(i, words(i % 20, 30) + f" {i}") for i in range(120)]
    table = spark.createDataFrame([(i, t, t, 1, 2, "f", "c", 3) for i, t in rows], "doc_id long, text string, kept string, starts int, ends int, found string, cut string, `__row` int").repartition(7)
    table.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    name, sizes = "spark.sql.files.maxPartitionBytes", iter(["4k", "1m", "2k", "64m"] * 20)
    before = spark.conf.get(name)
    for module, work in ((exact_dedup, "_count_keys"), (exact_dedup, "_whole"), (exact_dedup, "_texts"), (simhash, "_sets"), (simhash, "_key_pairs")):
        monkeypatch.setattr(module, work, lambda *a, f=getattr(module, work): (spark.conf.set(name, next(sizes)), f(*a))[1])
    try:
        done = exact_dedup.remove_repeats(docs, 40)
        assert set(docs.columns) < set(done.columns)
        got = Counter((r["doc_id"], r["n_removed"], bytes(r["kept_bytes"])) for r in done.collect())
        spark.conf.set(name, "64m")
        want = plain_repeats(in_order(docs), 40)
        assert Counter((i, n, hashlib.sha256(k).hexdigest()) for i, n, k in got.elements()) == Counter((i, n, h) for i, _, n, _, h in want.elements())
        left = exact_dedup.without_repeats(docs, 40)
        assert left.columns == docs.columns
        assert {(r["doc_id"], r["text"].encode()) for r in left.collect()} == {(i, k) for i, _, k in got if k}
        one = simhash.drop_near_copies(docs)
        assert one.columns == docs.columns and all(r["text"] == r["kept"] for r in one.collect())
    finally:
        spark.conf.set(name, before)


def test_suffix_dedup_hot_segments(spark, tmp_path):
    rows = [(i, words(90, 40) + f" {i} " + words(91, 40)) for i in range(60)]
    docs = documents(spark, tmp_path / "d", rows)
    done = exact_dedup.remove_repeats(docs, 50, hot=4).collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept_bytes"]).hexdigest()) for r in done)
    assert got == plain_repeats(rows, 50)


def test_suffix_dedup_bounds_shards(spark, tmp_path, monkeypatch):
    """Common lines between different neighbours, shorter than a window and nearly as long, make no shard beyond the bound."""
    lines = words(95, 40)[:60], words(96, 40)[:97]
    rows = [(i, f"{words(5000 + i, 12)}{lines[i % 2]}{words(7000 + i % 150, 12)}") for i in range(300)] + [(900 + i, words(5000 + i, 12) + lines[i % 2]) for i in range(40)]
    docs = documents(spark, tmp_path / "d", rows)
    bound, whole = 4000, exact_dedup._shard

    def checked(texts, *places):
        assert sum(map(len, texts)) <= 3 * bound
        return whole(texts, *places)

    monkeypatch.setattr(exact_dedup, "SHARD_BYTES", bound)
    monkeypatch.setattr(exact_dedup, "_shard", checked)
    done = exact_dedup.remove_repeats(docs, hot=10).collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept_bytes"]).hexdigest()) for r in done)
    assert got == plain_repeats(rows, 100)


def test_without_repeats_keeps_clean_texts(spark, tmp_path):
    docs = documents(spark, tmp_path / "d", [(1, words(1, 60)), (2, words(1, 60)), (3, words(2, 60)), (4, None), (5, "")])
    left = exact_dedup.without_repeats(docs)
    assert left.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in left.collect()} == {1: words(1, 60), 3: words(2, 60), 4: None, 5: ""}


@pytest.mark.parametrize("text", [b"", b"a", b"banana", b"mississippi", b"aaaaaaaaaa", b"abababab" * 9, b"abcab" * 300 + b"zyx" * 40, bytes(range(255, -1, -1)) * 3, bytes(range(256)) * 2, words(3, 200).encode()])
def test_suffix_array(text):
    data = np.frombuffer(text, np.uint8)
    assert suffixes.suffix_array(data).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("rounds", [0, 2, 24])
def test_suffix_arrays_and_prefixes_by_brute_force(monkeypatch, rounds):
    monkeypatch.setattr(suffixes, "ROUNDS", rounds)
    rng = np.random.default_rng(rounds)
    for _ in range(150):
        text = bytes(rng.integers(97, 97 + int(rng.integers(1, 5)), int(rng.integers(0, 70))).astype(np.uint8)) * int(rng.integers(1, 4))
        data, limit = np.frombuffer(text, np.uint8), int(rng.integers(1, 40))
        sa = suffixes.suffix_array(data)
        assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        common = suffixes.permuted_prefixes(data, sa, limit)
        for a, b in zip(sa.tolist(), sa[1:].tolist(), strict=False):
            x, y = text[a:], text[b:]
            assert common[b] == min(limit, next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y))))


def test_empty_tables(spark, tmp_path):
    docs = documents(spark, tmp_path / "d", [])
    assert simhash.link(docs).count() == 0
    assert simhash.drop_near_copies(docs).count() == 0
    assert exact_dedup.remove_repeats(docs).count() == 0
