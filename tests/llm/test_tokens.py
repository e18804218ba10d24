"""BPE, token store and packing."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfrank.llm import bpe, byte_ids, packing, token_store
from tests.llm.fixtures import documents, texts, words

ODD = [
    (20, "<|startoftext|> Hello <|endoftext|>"), (21, "it's we're CAN'T 12345 a1b2"), (22, "x" * 300 + "!?..,,"), (23, "   leading and trailing   "),
    (24, "emoji 😀👍🏽 é é ﬁ ½"), (25, "<|startoftext|><|endoftext|><|endoftext|"), (26, "\x00\x01 control ​ zero"), (27, "İSTANBUL ß ẞ Σς"), (28, "line\r\nbreak para nbsp"),
]


def library():
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own.no_truncation(), own.no_padding()
    return own


def test_bpe_equals_the_library(spark, tmp_path):
    rows = texts() + ODD + [(40 + i, words(5, 400) + f" tail {i}") for i in range(5)]
    docs = documents(spark, tmp_path / "d", rows)
    own, expected = library(), Counter()
    for i, t in rows:
        ids = own.encode(t or "", add_special_tokens=False).ids
        back = own.decode(ids, skip_special_tokens=False)
        expected[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs).collect())
    assert got == expected


def test_bpe_round_trip(spark, tmp_path):
    docs = documents(spark, tmp_path / "d", ODD)
    own = library()
    encoded = bpe.encode(docs)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == {i: own.encode(t, add_special_tokens=False).ids for i, t in ODD}
    want = {i: own.decode(own.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for i, t in ODD}
    assert {r["doc_id"]: r["text"] for r in bpe.decode(encoded).collect()} == want


def test_chunks_depend_on_content():
    """A passage is cut alike wherever it stands, but for its ends."""
    passage = words(7, 600).encode()
    chunks = []
    for before in (b"", words(8, 50).encode() + b" ", words(9, 333).encode() + b" "):
        raw = before + passage
        edge = bpe.cuts(raw)
        chunks.append({raw[a:b] for a, b in zip([0, *edge], [*edge, len(raw)], strict=True)})
    assert len(chunks[0] & chunks[1] & chunks[2]) > 0.5 * len(chunks[0])


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    slots = token_store.permute(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    assert token_store.permute(slots, n, inverse=True).tolist() == list(range(n))


def test_permutation_depends_on_the_key():
    assert token_store.permute(np.arange(500), 500, 1).tolist() != token_store.permute(np.arange(500), 500, 2).tolist()


def pieces_of(rows, stride):
    own = byte_ids.encoding(byte_ids.ranks_file())
    for i, t in rows:
        ids = byte_ids.encode(own, t)
        for p, at in enumerate(range(0, len(ids), stride)):
            yield i, p, ids[at : at + stride].tolist()


def test_token_store(spark, tmp_path):
    rows = texts()
    stride, per_shard = 64, 16
    shards = token_store.materialise(documents(spark, tmp_path / "d", rows), stride, per_shard)
    token_store.write(shards, str(tmp_path / "s"))
    back = token_store.resume(spark, str(tmp_path / "s"), 0, per_shard).collect()
    assert [r["slot"] for r in back] == list(range(len(back)))
    expected = Counter((i, p, tuple(ids)) for i, p, ids in pieces_of(rows, stride))
    got = Counter((r["doc_id"], r["piece"], tuple(np.frombuffer(r["ids"], "<u2")[: r["n_tokens"]].tolist())) for r in back)
    assert got == expected
    assert all(len(r["ids"]) == 2 * stride and set(np.frombuffer(r["ids"], "<u2")[r["n_tokens"] :].tolist()) <= {byte_ids.END} for r in back)
    # the order of documents decides the ordinal, the permutation the slot
    order = sorted(pieces_of(rows, stride), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    ordinal = token_store.permute(np.array([r["slot"] for r in back]), len(back), inverse=True)
    placed = [back[k]["doc_id"] for k in np.argsort(ordinal)]
    assert placed == [x[0] for x in order]
    some = token_store.resume(spark, str(tmp_path / "s"), 37, per_shard).collect()
    assert some == back[37:]


def test_packing(spark, tmp_path):
    rows = texts() + [(100 + i, words(i, 10 + 7 * i)) for i in range(150)]
    lengths = (128, 256, 512)
    got = packing.pack_documents(documents(spark, tmp_path / "d", rows), lengths, block=200).collect()
    expected = Counter((i, p, len(ids)) for i, p, ids in pieces_of(rows, 512))
    assert Counter((r["doc_id"], r["piece"], r["n_tokens"]) for r in got) == expected
    bins = defaultdict(list)
    for r in got:
        bins[r["bin_id"], r["bin_length"]].append((r["bin_offset"], r["n_tokens"]))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, length), inside in bins.items():
        inside.sort()
        used = 0
        for at, n in inside:
            assert at == used
            used += n
        assert used <= length
        assert length == min(x for x in lengths if x >= used)
    assert sum(n for *_, n in expected) / sum(length for _, length in bins) > 0.9


def test_pack_is_best_fit():
    sizes = np.array([400, 300, 112, 100, 90])
    bins, offset, final = packing.pack(sizes, (512,))
    assert bins.tolist() == [0, 1, 0, 1, 1] and offset.tolist() == [0, 0, 400, 300, 400] and final.tolist() == [512, 512]


def least_cost(sizes, lengths):
    """The least total cost over all ways to share the pieces out among bins."""
    every = range(1, 1 << len(sizes))
    own = {m: min((packing.cost(c) for c in lengths if c >= sum(s for i, s in enumerate(sizes) if m >> i & 1)), default=float("inf")) for m in every}
    best = {0: 0.0}
    for m in every:
        low, sub, best[m] = m & -m, m, float("inf")
        while sub:
            if sub & low:
                best[m] = min(best[m], own[sub] + best[m ^ sub])
            sub = (sub - 1) & m
    return best[(1 << len(sizes)) - 1]


def test_packing_cost_is_near_the_least():
    total = lambda sizes: sum(map(packing.cost, packing.pack(np.array(sizes))[2].tolist()))
    assert total([600] * 100) < 80_000
    rng = np.random.default_rng(0)
    ratios = [total(s := rng.integers(1, 4097 if k % 2 else 1500, 8).tolist()) / least_cost(s, packing.LENGTHS) for k in range(60)]
    assert min(ratios) >= 1 - 1e-9 and np.mean(ratios) < 1.03 and max(ratios) < 1.3
    # no single length for new bins does better, and equal pieces stay in order
    for sizes in (rng.integers(1, 4097, 500), np.array([700] * 50 + [30] * 40)):
        assert total(sizes) <= min(sum(map(packing.cost, packing._packed(sizes, packing.LENGTHS, c)[2].tolist())) for c in packing.LENGTHS)
    bins, offset, _ = packing.pack(np.full(7, 300))
    assert [(int(b), int(o)) for b, o in zip(bins, offset, strict=True)] == sorted((int(b), int(o)) for b, o in zip(bins, offset, strict=True))


def test_bpe_repairs_until_the_joins_agree(monkeypatch):
    """Joins whose ends differ are encoded anew with more words, and at last as whole texts; chunks are encoded once."""
    own, encoder, whole = library(), bpe.Encoder(bpe.tokenizer_json()), bpe.agreed
    rows = [(words(1, 900) + " " + words(i, 300)).encode() for i in range(4)]
    want = [own.encode(r.decode(), add_special_tokens=False).ids for r in rows]
    learnt = []
    monkeypatch.setattr(encoder, "record", lambda c, f=encoder.record: (learnt.append(c), f(c))[1])
    assert encoder.encode_all(rows) == want == encoder.encode_all(rows)
    assert len(learnt) == len(set(learnt)) < sum(len(bpe.cuts(r)) for r in rows)
    for least in (3, 10**6):
        monkeypatch.setattr(bpe, "agreed", lambda ids, left, right, n=least: whole(ids, left, right) if len(left) + len(right) >= n else None)
        assert encoder.encode_all(rows) == want


def test_token_store_query(spark):
    """The query writes fixed-stride shards, each a range of slots, and reads them back."""
    small = "/root/testdata/sf0.001"
    got = token_store.query(spark, small).orderBy("shard").collect()
    total = sum(r["n_sequences"] for r in got)
    assert [r["first_slot"] for r in got] == list(range(0, total, token_store.PER_SHARD))
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    expected = sorted(pieces_of(rows, token_store.STRIDE), key=lambda x: x[:2])
    slots = token_store.permute(np.arange(total), total)
    payload = b"".join(bytes(r["payload"]) for r in got)
    assert len(payload) == 2 * token_store.STRIDE * total
    record = np.frombuffer(payload, "<u2").reshape(total, -1)
    for (i, p, ids), slot in zip(expected, slots.tolist(), strict=True):
        r = got[slot // token_store.PER_SHARD]
        at = slot - r["first_slot"]
        assert (r["doc_ids"][at], r["pieces"][at], r["n_tokens"][at]) == (i, p, len(ids)) and record[slot, : len(ids)].tolist() == ids
    assert all(r["payload_sha256"] == hashlib.sha256(r["payload"]).hexdigest() for r in got)


def test_empty_tables(spark, tmp_path):
    docs = documents(spark, tmp_path / "d", [])
    assert bpe.digests(docs).count() == 0
    assert token_store.materialise(docs).count() == 0
    assert packing.pack_documents(docs).count() == 0
