"""Filter audit, SentencePiece and vector codes."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor
from sentencepiece import sentencepiece_model_pb2 as schema

from shelfrank.llm import filter_audit, pieces, registry, vector_codes
from tests.llm.fixtures import documents, texts, words

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_vector_codes"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, SF).select(want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


# ---- filter audit


def audited(rows, labels):
    """Brute force: each document replayed in each order."""
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    out = {}
    for i, text, source in rows:
        text = text or ""
        own = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(own) < 50, "B": 100 * len(set(own)) < 65 * len(own), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": re.search(r"[#$%&*|]", text) is not None, "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
        }
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                c = out.setdefault((source or "", "".join(order), step), Counter())
                here = fails[f] and not gone
                c["redundant"] += fails[f] and gone
                gone |= fails[f]
                c["kept"] += not gone
                c["removed"] += here
                c["unique_fails"] += fails[f] and sum(fails.values()) == 1
                c["good_lost"] += here and i in good
                c["toxic_lost"] += here and i in toxic
    for (part, order, step), c in out.items():
        c["shapley"] = sum(d["removed"] for (p, o, s), d in out.items() if p == part and o[s - 1] == order[step - 1])
    return out


def test_filter_audit(spark):
    rng = random.Random(3)
    rows = [(i, t, [None, "", "a", "b"][n % 4]) for n, (i, t) in enumerate(texts())]
    for i in range(60):
        text = " ".join(rng.choice(["Word", "word", "x%", "a", "b", "\t", "é"]) + rng.choice(["", str(rng.randrange(90))]) for _ in range(rng.choice([0, 3, 49, 50, 51, 120])))
        rows.append((100 + i, rng.choice([text, text, "copied text", None]), rng.choice("ab")))
    labels = [(100 + i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 60, 2)] + [(101, 1, 0), (101, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, source string, flags int, part int, digest int")
    marks = spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, quality int, toxic int, part int")
    got = filter_audit.audit(filter_audit.flagged(docs, marks)).collect()
    want = audited(rows, labels)
    assert len(got) == len(want)
    for r in got:
        assert {k: r[k] for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")} == dict(want[r["part"], r["filter_order"], r["step"]])


def test_filter_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.flagged(docs, labels)).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")  # no column source
    got = filter_audit.audit(filter_audit.flagged(one, labels)).collect()
    assert len(got) == 600 and {r["part"] for r in got} == {""} and sum(r["removed"] for r in got) == 120


# ---- SentencePiece

ODD = ["", " ", "   ", "a b", "▁", "▁▁ a", " ▁", "é é ﬁ ½ 漢字 テ ｶﾞ 😀", "\x00\n\t\r\n", "a b　c​d", "<s></s><unk><0x0A>", "́́", "가 각 ﷺ Å", "�", "x" * 300, "1234567890 " * 30]


def variant(rule: str | None, trim: bool, prefix: bool) -> bytes:
    """The public model with another way of normalising."""
    proto = schema.ModelProto.FromString(pieces.model_bytes())
    if rule:
        other = schema.ModelProto.FromString(SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        proto.normalizer_spec.precompiled_charsmap = other.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.add_dummy_prefix = trim, prefix
    return proto.SerializeToString()


def mixed(seed: int) -> list[str]:
    rng = random.Random(seed)
    parts = [*"ab \n\t▁1éﬁ½漢字😀\x00öΩZ", "the", "ing", "  ", "23", "ｶﾞ", "é", " ", "<s>", "Hello", "가"]
    return ["".join(rng.choice(parts) for _ in range(rng.choice([1, 2, 5, 20, 100]))) for _ in range(300)]


@pytest.mark.parametrize("kind", [None, ("nmt_nfkc", True, True), ("nmt_nfkc", False, True), ("nfkc_cf", True, False), (None, True, True), (None, False, False)])
def test_pieces_equal_the_library(kind):
    """Ids, original spans and decoding, for the model and for models with compiled character maps."""
    model = pieces.model_bytes() if kind is None else variant(*kind)
    library, own = SentencePieceProcessor(model_proto=model), pieces.Encoder(model)
    for text in ODD + mixed(1):
        found = list(own.encode(text))
        ids, ends = (np.concatenate([f[k] for f in found]).tolist() for k in (0, 1))
        assert ids == library.encode(text, add_bos=True, add_eos=True)
        assert ends[1:-1] == [p.end for p in library.encode(text, return_type="proto").pieces]
        assert own.decode(ids) == library.decode(ids)
    rng = random.Random(2)
    for _ in range(300):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(rng.randrange(8))]
        assert own.decode(ids) == library.decode(ids)


def test_pieces_in_bounds(monkeypatch):
    """Slices, and runs that are forgotten, change nothing."""
    library, own = SentencePieceProcessor(model_proto=pieces.model_bytes()), pieces.Encoder(pieces.model_bytes())
    monkeypatch.setattr(pieces, "SLICE", 50)
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    for text in [*ODD, *mixed(4), words(3, 2000), " ".join(ODD)]:
        found = list(own.encode(text))
        want = library.encode(text, add_bos=True, add_eos=True)
        assert np.concatenate([f[0] for f in found]).tolist() == want
        assert np.concatenate([f[1] for f in found]).tolist()[1:-1] == [p.end for p in library.encode(text, return_type="proto").pieces]
        assert b"".join(own.decoded(f[0].tolist(), k == 1) for k, f in enumerate(found)).decode() == library.decode(want)
        assert len(own.known) <= 20 + 2 * len(set(own.runs.findall(text)))


def test_pieces_of_documents(spark, tmp_path):
    rows = texts() + [(200 + i, t) for i, t in enumerate(ODD)]
    docs = documents(spark, tmp_path / "d", rows)
    library = SentencePieceProcessor(model_proto=pieces.model_bytes())
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.digests(docs).collect()) == want
    encoded = pieces.encode(docs)
    back = Counter((r["doc_id"], r["text"]) for r in pieces.decode(encoded).collect())
    assert back == Counter((i, library.decode(library.encode(t or ""))) for i, t in rows)
    few = docs.where("doc_id = 12").limit(1).unionByName(docs.where("doc_id in (2, 207)"))
    found = pieces.spans(pieces.encode(few), few).orderBy("doc_id", "piece_no").collect()
    for doc, text in ((12, dict(rows)[12]), (2, ""), (207, ODD[7])):
        own = [r for r in found if r["doc_id"] == doc]
        assert b"".join(bytes(r["bytes"]) for r in own).decode() == text
        assert [r["id"] for r in own] == library.encode(text, add_bos=True, add_eos=True)
    assert pieces.digests(documents(spark, tmp_path / "e", [])).count() == 0


def test_unsupported_models():
    proto = schema.ModelProto.FromString(pieces.model_bytes())
    proto.pieces[400].type = schema.ModelProto.SentencePiece.USER_DEFINED
    with pytest.raises(ValueError):
        pieces.Encoder(proto.SerializeToString())


# ---- vector codes


def codes_of(rows, rounds=2):
    """Brute force with Python's integers over (vec_id, vector, label)."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    m = len(kept[0][1]) // 16
    cut = lambda v, p: v[p * m : p * m + m]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))[:64]
    books = [[cut(v, p) for _, v, _ in first] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v, p: min((far(cut(v, p), c), j) for j, c in enumerate(books[p]))
    for _ in range(rounds):
        own = [[best(v, p)[1] for _, v, _ in kept] for p in range(16)]
        for p in range(16):
            for j in range(len(books[p])):
                if mine := [cut(v, p) for (_, v, _), a in zip(kept, own[p], strict=True) if a == j]:
                    books[p][j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = []
    for i, v, label in kept:
        found = [best(v, p) for p in range(16)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), label))
    sums = Counter()
    for *_, error, label in out:
        sums[label] += error
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return Counter((i, code, error, sums[label], sha) for i, code, error, label in out)


@pytest.mark.parametrize("scale", [1.0, 3000.0, 1e12])
def test_vector_codes(spark, scale):
    rng = np.random.default_rng(1)
    data = (rng.normal(size=(200, 32)) * scale * 0.3).round(2 if scale == 1 else 0)
    data[50:90] = data[0]  # ties: repeated vectors
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(data)]
    rows += [(7, data[3].tolist(), None), (None, data[9].tolist(), None), (300, None, 1), (301, [float("nan")] * 32, 1), (302, [None] * 32, 1), (303, [float("-inf")] + [0.0] * 31, 1)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, error int, code string").repartition(3)
    got = vector_codes.compressed(table).collect()
    assert Counter((r["vec_id"], r["code"], r["error"] if scale < 1e10 else 0, r["label_error"] if scale < 1e10 else 0, r["codebooks_sha256"]) for r in got) == Counter(
        (i, c, e if scale < 1e10 else 0, s if scale < 1e10 else 0, h) for (i, c, e, s, h), n in codes_of(rows).items() for _ in range(n)
    )
    if scale > 1e10:  # errors beyond a long are null
        want = {i: e for i, _, e, _, _ in codes_of(rows)}
        assert all(r["error"] == (want[r["vec_id"]] if want[r["vec_id"]] < 2**63 else None) for r in got if r["vec_id"] != 7)


def test_nearest_settles_what_rounding_hides():
    """Distances that float32 can't tell apart, and equal ones."""
    rng = np.random.default_rng(2)
    for top in (2, 300, 2**14, 2**24, 2**27):
        entries = rng.integers(-top, top + 1, (64, 4))
        entries[32:48] = entries[:16]
        entries[48:] = entries[16:32] + rng.integers(-1, 2, (16, 4))
        x = np.concatenate([entries + rng.integers(-2, 3, entries.shape), rng.integers(-top, top + 1, (300, 4)), (entries[16:32] + entries[48:]) // 2])
        index, far = vector_codes.nearest(x, entries)
        exact = ((x[:, None, :].astype(object) - entries[None].astype(object)) ** 2).sum(2)
        assert index.tolist() == [min(range(64), key=row.__getitem__) for row in exact] and far.tolist() == exact.min(1).tolist()
        low, high = vector_codes.intervals(x, entries)
        true = exact - (x.astype(object) ** 2).sum(1)[:, None]
        assert (low <= true.astype(float)).all() and (true.astype(float) <= high).all()


def test_vectors_of_other_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16 if i < 40 else 32).tolist(), None) for i in range(80)] + [(100, [0.5] * 17, 1), (101, [], 2), (102, [1e30] * 16, 3)]
    got = {r["vec_id"]: r for r in vector_codes.compressed(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert len(got) == 83 and len({r["codebooks_sha256"] for r in got.values()}) == 3
    assert all(got[i]["code"] is None and got[i]["error"] is None and got[i]["codebooks_sha256"] is None for i in (100, 101, 102))
    assert len({got[i]["label_error"] for i in range(80)}) == 1
    assert vector_codes.compressed(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_restored(spark):
    rows = [(i, np.sin(np.arange(16) + i).tolist(), 0) for i in range(64)] + [(64, [0.0] * 3, 0)]
    kept = vector_codes.kept_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    own = kept.where("size = 16")
    books = vector_codes.fit(own, 16, rounds=0)
    back = {r["vec_id"]: r["vector"] for r in vector_codes.restored(vector_codes.coded(own, books), books).collect()}
    assert all(np.abs(np.array(back[i]) - v).max() <= 0.5 / 256 for i, v, _ in rows[:64])
    assert pa.types.is_binary(vector_codes.coded(own, books).limit(1).toArrow().schema.field("code").type)
