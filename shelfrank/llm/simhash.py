"""SimHash near-duplicates: fingerprints, pivot distance tables, and components of near fingerprints."""

from __future__ import annotations

import math
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.llm.common import bounded_batches, connected_components, durable, forest, grouped_rows, numbered_texts, stored, with_row

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TO_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED = 42
BITS = 64
#: Reference fingerprints: the Walsh codewords of these indices (bit i of codeword j is the parity of i & j). They are
#: orthogonal, so by Parseval's identity few differing bits show as small differences in every coordinate, and the
#: squares of the differences sum to as much as the pair's distance allows.
PIVOTS = range(1, 64, 4)
#: Buckets with more fingerprints than this are linked by shared variants instead of pairs.
LARGE_BUCKET = 256
#: Variants in a batch of rows.
VARIANTS = 1 << 17


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased."""
    return WORD.findall((text or "").encode().translate(TO_LOWER))


def shingles(words: list[bytes], width: int) -> list[bytes]:
    """Runs of ``width`` words, repeats included; the whole sequence if it is shorter; none without words."""
    if not words:
        return []
    return [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle."""
    return np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(words, width)], dtype=np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """A bit is 1 if more than half of the hashes have it; 0 without hashes. Counts are summed in blocks of 64k."""
    if not h.size:
        return 0
    counts = np.zeros(BITS, np.int64)
    for i in range(0, h.size, 65536):
        counts += np.unpackbits(h[i : i + 65536].astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > h.size).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` (a signed long) of every row; null and wordless texts have fingerprint 0."""

    def run(batches):
        for batch in batches:
            own = [fingerprint(hashes(words_of(t), width)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def pivot_fingerprints() -> list[int]:
    return [_signed(sum((bin(i & j).count("1") & 1) << i for i in range(BITS))) for j in PIVOTS]


def pivot_distances(fp: Column) -> Column:
    """Hamming distances to each reference fingerprint, as an array of bytes."""
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("byte") for p in pivot_fingerprints()])


def _blocks(radius: int) -> list[tuple[int, int]]:
    """The bits in 2 * radius blocks, as (first bit, width). Two fingerprints within ``radius`` agree on ``radius`` of them."""
    n = 2 * max(radius, 1)
    edge = [round(BITS * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]


def _masks(radius: int) -> list[int]:
    """Masks of every choice of blocks on which a near pair can agree."""
    one = [((1 << w) - 1) << a for a, w in _blocks(radius)]
    return [sum(c) for c in combinations(one, len(one) - radius)]


def near_pairs(classes: DataFrame, radius: int = 3, large: int = LARGE_BUCKET) -> DataFrame:
    """Links (u, v) between the ids of fingerprints that differ in ``radius`` bits or fewer.

    ``classes`` has one row for each fingerprint: ``fp`` and ``id``. Near fingerprints agree on half of 2 * radius
    blocks of bits (equivalently, on all distances to references that differ only in those blocks), so pairs are only
    formed between fingerprints with such a key in common. The pivot table, computed once for each fingerprint,
    discards those pairs whose distances to any reference differ by more than ``radius`` (the triangle inequality);
    what survives is verified. The result joins all that belong together, but a bucket of more than ``large``
    fingerprints gives a star for each shared variant in place of its pairs.
    """
    masks = _masks(radius)
    table = classes.select("id", "fp", pivot_distances(F.col("fp")).alias("pivots"))
    keyed = table.select(
        "id", "fp", "pivots",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("which", "part"),
    )
    keys = keyed.groupBy("which", "part").agg(F.count("*").alias("n")).where("n > 1")
    keyed = keyed.join(keys, ["which", "part"])
    small = keyed.where(F.col("n") <= large)
    a, b = small.alias("a"), small.alias("b")
    gap = F.array_max(F.zip_with("a.pivots", "b.pivots", lambda x, y: F.abs(x - y)))
    pairs = a.join(b, (F.col("a.which") == F.col("b.which")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.fp") < F.col("b.fp")))
    pairs = pairs.where(gap <= radius).where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius)
    pairs = pairs.select(F.col("a.id").alias("u"), F.col("b.id").alias("v"))
    return pairs.unionByName(_stars(keyed.where(F.col("n") > large), radius)).distinct()


def _stars(keyed: DataFrame, radius: int) -> DataFrame:
    """Links of large buckets without their pairs.

    Every fingerprint names its variants with up to ``radius - radius // 2`` of the key's free bits flipped. A variant
    that lies within ``radius // 2`` of one fingerprint joins that one to all that name it: their distance is at most
    ``radius``. For any near pair some variant lies so between them, so no component is lost.
    """
    masks, low = _masks(radius), radius // 2
    high = radius - low
    flips = []
    for m in masks:
        free = [1 << i for i in range(BITS) if not m >> i & 1]
        flips.append([(np.uint64(sum(c)), d) for d in range(high + 1) for c in combinations(free, d)])

    def run(batches):
        for batch in batches:
            own, fp, which = (batch.column(c).to_numpy() for c in range(3))
            for w in np.unique(which).tolist():
                at = np.flatnonzero(which == w)
                flip, d = np.array([f for f, _ in flips[w]], np.uint64), np.array([d for _, d in flips[w]], np.int32)
                for i in range(0, len(at), step := max(1, VARIANTS // len(d))):
                    some = at[i : i + step]
                    v = fp[some].view(np.uint64)[:, None] ^ flip
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(own[some], len(d))), pa.array(np.repeat(fp[some], len(d))), pa.array(v.view(np.int64).ravel()), pa.array(np.tile(d, len(some)))],
                        names=["id", "fp", "variant", "d"],
                    )

    named = keyed.select("id", "fp", "which").mapInArrow(run, "id long, fp long, variant long, d int")
    hub = named.where(F.col("d") <= low).groupBy("variant").agg(F.min(F.struct("id", "fp")).alias("hub"))
    star = named.join(hub, "variant").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub.fp"))) <= radius)
    return star.select(F.col("id").alias("u"), F.col("hub.id").alias("v")).where("u <> v")


def link(docs: DataFrame, width: int = 3, radius: int = 3, large: int = LARGE_BUCKET) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    Rows link where their fingerprints differ in ``radius`` bits or fewer; the component's id is its smallest doc_id.
    Equal fingerprints are one class from the start, so copies form no pairs. Null and wordless texts have fingerprint
    zero and link like others; a null doc_id takes part but is never the smallest (a component of such rows alone has a
    null id). Repeated rows stay; other columns are left behind.
    """
    rows = stored(fingerprints(docs, width), "simhash")
    classes = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("id")))
    part = connected_components(near_pairs(classes.where("id is not null"), radius, large))
    known = classes.join(part, classes["id"] == part["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return rows.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near copies by similarity: words in a shingle, least Jaccard similarity, and the SimHash radius that holds such pairs.
#: At similarity 0.8 two fingerprints differ in 9.7 bits on average, with a deviation of 2.9; texts of 4 and 5 shingles in
#: 12 with one of 3.1. The radius lies 4.5 deviations or more above, so it loses fewer pairs than the keys do.
NEAR_WORDS, SIMILARITY, NEAR_RADIUS = 5, 0.8, 26
#: Keys of a document and the least hashes that make each; a pair at 0.8 has none in common once in 37,000.
KEYS, HASHES = 20, 4
#: Larger buckets first compare their members with some of them, other ones for each key; members that this leaves in
#: different components are then compared exactly where they share one of their rarest shingles. Shingles that so many have
#: among their rarest tell too little: who holds them is compared in pairs of blocks of about so many members and bytes.
PAIRED_BUCKET, REFERENCES = 64, 4
#: Places of the table that counts shingles, of which one byte each goes to the driver and back (1 MB).
PLACES = 1 << 20
BLOCK_MEMBERS, BLOCK_BYTES, BLOCK_COLUMNS = 256, 2_000_000, 4096
#: Row numbers up to this number are broadcast (31 MB at 77 bytes a row); more are joined by shuffling.
BROADCAST_ROWS = 400_000
_TIMES, _PLUS = np.random.default_rng(17).integers(1, 2**63, (2, KEYS * HASHES), dtype=np.uint64)


def _distinct(text: str | None, width: int) -> np.ndarray:
    return np.unique(hashes(words_of(text), width))


def _keys(h: np.ndarray) -> np.ndarray:
    """Keys of a set of hashes: each from the least values of some hash functions."""
    if not h.size:
        return np.zeros(KEYS, np.int64)
    least = np.full(KEYS * HASHES, 2**64 - 1, np.uint64)
    for i in range(0, h.size, 4096):
        least = np.minimum(least, (h[i : i + 4096, None] * (_TIMES | np.uint64(1)) + _PLUS).min(0))
    out = np.zeros(KEYS, np.uint64)
    for part in least.reshape(KEYS, HASHES).T:
        out = (out ^ part) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def near_copies(docs: DataFrame, width: int = NEAR_WORDS, similarity: float = SIMILARITY, radius: int = NEAR_RADIUS) -> DataFrame:
    """``row`` (the row's place), ``doc_id`` and ``kept``: which row of each group of near copies stays.

    That is the one with the smallest doc_id (null ids come last), then the first place. Rows link where the Jaccard
    similarity of their sets of ``width``-word shingles is ``similarity`` or more, and where their words are equal. At this
    similarity fingerprints differ in too many bits for keys of equal bits, so pairs are formed by keys of least hashes
    instead; the pivot table discards those that are further apart than ``radius``, and the survivors' sets are compared
    exactly. Buckets with many members pair each with a few references, other ones for each of the keys, which joins a
    group of copies of one text without its pairs. Members of such a bucket that are in different components after that
    are compared by their rarest shingles (see ``_rare_pairs``), so documents that share a long common passage and nothing
    else never meet. No pair is lost by either step.
    """
    rows = numbered_texts(*with_row(docs.select("doc_id", "text")))
    first = _first_rows(rows, width, similarity, radius).withColumn("kept", F.lit(True))
    return rows.select("row", "doc_id").join(first, "row", "left").select("row", "doc_id", F.coalesce("kept", F.lit(False)).alias("kept"))


def _first_rows(rows: DataFrame, width: int, similarity: float, radius: int) -> DataFrame:
    """``row`` of the rows that stay."""

    def described(batches):
        for batch in batches:
            digest, fp, keys = [], [], []
            for t in batch.column(2).to_pylist():
                words = words_of(t)
                digest.append(xxhash.xxh3_128_hexdigest(b" ".join(words)))
                h = np.unique(hashes(words, width))
                fp.append(fingerprint(h))
                keys.append(_keys(h))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digest), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["row", "doc_id", "digest", "fp", "keys"],
            )

    known = stored(rows.select("row", "doc_id", "text").mapInArrow(described, "row long, doc_id long, digest string, fp long, keys array<long>"), "near")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    classes = known.groupBy("digest").agg(F.min("row").alias("id"), F.min(place).alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    classes = stored(classes.drop("digest"), "near_classes")
    pairs = stored(_key_pairs(classes, radius), "near_pairs")
    links = durable(_similar(rows, pairs, width, similarity))
    part = connected_components(links)
    crowded = stored(_apart(_large(classes), part), "crowded")
    if not crowded.isEmpty():
        part = _joined(rows, crowded, part, width, similarity)
    grouped = classes.join(part, classes["id"] == part["node"], "left").select(F.coalesce("component", "id").alias("group"), "first")
    return grouped.groupBy("group").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))


def _key_pairs(classes: DataFrame, radius: int) -> DataFrame:
    """Pairs (u, v) of classes with a key in common that the pivot table and the fingerprints don't rule out."""
    table = classes.select("id", "fp", pivot_distances(F.col("fp")).alias("pivots"), F.posexplode("keys").alias("which", "key"))
    order = F.xxhash64("id", "which")
    buckets = table.groupBy("which", "key").agg(F.count("*").alias("n"), F.min(F.struct(order.alias("o"), "id")).alias("least")).where("n > 1")
    members = table.join(buckets.select("which", "key", "n"), ["which", "key"])
    small = members.where(F.col("n") <= PAIRED_BUCKET)
    large = members.where(F.col("n") > PAIRED_BUCKET)
    # a large bucket's references: the least ids by hash in each of a few parts
    parts = F.pmod(F.xxhash64("id", "key"), F.lit(REFERENCES))
    chosen = large.groupBy("which", "key", parts.alias("p")).agg(F.min(F.struct(order.alias("o"), "id", "fp", "pivots")).alias("r"))
    chosen = chosen.select("which", "key", "r.id", "r.fp", "r.pivots")

    def paired(left: DataFrame, right: DataFrame, both: bool) -> DataFrame:
        a, b = left.alias("a"), right.alias("b")
        on = (F.col("a.which") == F.col("b.which")) & (F.col("a.key") == F.col("b.key"))
        on = on & ((F.col("a.id") != F.col("b.id")) if both else (F.col("a.id") < F.col("b.id")))
        gap = F.array_max(F.zip_with("a.pivots", "b.pivots", lambda x, y: F.abs(x - y)))
        near = a.join(b, on).where(gap <= radius).where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius)
        return near.select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v"))

    return paired(small, small, False).unionByName(paired(large, chosen, True)).distinct()


def _large(classes: DataFrame) -> DataFrame:
    """(which, key, id) of the members of large buckets."""
    table = classes.select("id", F.posexplode("keys").alias("which", "key"))
    large = table.groupBy("which", "key").agg(F.count("*").alias("n")).where(F.col("n") > PAIRED_BUCKET).select("which", "key")
    return table.join(large, ["which", "key"]).select("which", "key", "id")


def _apart(members: DataFrame, part: DataFrame) -> DataFrame:
    """(which, key, id, component, main) of the members of buckets that lie in several components.

    ``main`` tells whether the member is in the bucket's largest component, whose members need no comparison among them.
    """
    members = members.join(part.withColumnRenamed("node", "id"), "id", "left")
    members = members.select("which", "key", "id", F.coalesce("component", "id").alias("component"))
    held = members.groupBy("which", "key", "component").agg(F.count("*").alias("m"))
    held = held.groupBy("which", "key").agg(F.count("*").alias("parts"), F.max(F.struct("m", "component")).alias("most")).where("parts > 1")
    return members.join(held, ["which", "key"]).select("which", "key", "id", "component", (F.col("component") == F.col("most.component")).alias("main"))


def _joined(rows: DataFrame, crowded: DataFrame, part: DataFrame, width: int, similarity: float) -> DataFrame:
    """``part`` with the components joined that hold similar members of one large bucket."""
    known = part.select(F.col("node").alias("u"), F.col("component").alias("v"))
    ids = crowded.select(F.col("id").alias("row"), "component").distinct()
    sets = _sets(rows, ids.select("row"), width)
    rare = stored(_rare_shingles(sets.join(ids, "row"), _frequencies(sets), similarity), "rare")
    lists = rare.groupBy("token").agg(
        F.count_if("indexed").alias("held"), (F.min("component") < F.max("component")).alias("mixed")
    ).where("mixed and held > 0")
    lists = stored(lists.select("token", "held"), "lists")
    pairs = stored(_rare_pairs(rare, lists.where(F.col("held") <= PAIRED_BUCKET), similarity), "rare_pairs")
    part = connected_components(known.unionByName(_alike(pairs, sets, similarity)))
    common = rare.join(lists.where(F.col("held") > PAIRED_BUCKET), "token", "left_semi").select("id").distinct()
    left = stored(_apart(crowded.select("which", "key", "id").join(common, "id", "left_semi"), part), "crowded")
    if left.isEmpty():
        return part
    known = part.select(F.col("node").alias("u"), F.col("component").alias("v"))
    return connected_components(known.unionByName(_block_links(left, sets, similarity)))


def _frequencies(sets: DataFrame) -> np.ndarray:
    """Base-2 logarithms of how often shingles occur in ``sets``, by their place in a table of ``PLACES``.

    Shingles of one place count together. They only order the shingles, and every order gives the same links.
    """

    def count(batches):
        total = np.zeros(PLACES, np.int64)
        for batch in batches:
            for shingles in batch.column(0).to_pylist():
                # shingles of a set are distinct, but several may have one place
                np.add.at(total, np.frombuffer(shingles, np.uint64) & np.uint64(PLACES - 1), 1)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 65536):
            some = at[i : i + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["place", "n"])

    counts = sets.select("shingles").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).where("n > 1")
    found = counts.select("place", F.floor(F.log2("n")).cast("byte").alias("n")).toArrow()
    out = np.zeros(PLACES, np.uint8)
    out[found.column("place").to_numpy()] = found.column("n").to_numpy()
    return out


def _rare_shingles(members: DataFrame, often: np.ndarray, similarity: float) -> DataFrame:
    """(id, component, size, token, indexed): the rarest shingles of each set, of which one is common to any similar pair.

    In a fixed order of all shingles, a set of n that overlaps a set of no more than its size at similarity t has t n
    shingles in common with it, so the first common one is among its first n - t n + 1. For the smaller of the two it is
    among the first n - 2 t n / (1 + t) + 1, which are ``indexed`` (Xiao et al., 2008: prefix filtering).
    """

    def run(batches):
        for batch in batches:
            own = []
            for row, component, raw in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                h = np.frombuffer(raw, np.uint64)
                if not len(h):
                    continue
                # a small slack: rounding may make the prefixes longer, never shorter
                first = len(h) - math.ceil(similarity * len(h) - 1e-6) + 1
                held = len(h) - math.ceil(2 * similarity / (1 + similarity) * len(h) - 1e-6) + 1
                order = h[np.lexsort((h, often[h & np.uint64(PLACES - 1)]))[:first]]
                own.append((np.full(len(order), row), np.full(len(order), component), np.full(len(order), len(h)), order.view(np.int64), np.arange(len(order)) < held))
            if own:
                columns = [pa.array(np.concatenate(c)) for c in zip(*own, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "size", "token", "indexed"])

    return members.select("row", "component", "shingles").mapInArrow(run, "id long, component long, size long, token long, indexed boolean")


def _rare_pairs(rare: DataFrame, lists: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of sets in different components with a common rare shingle that few have indexed, of sizes that allow it."""
    of = rare.join(lists.select("token"), "token")
    a, b = of.where("indexed").drop("indexed").alias("a"), of.drop("indexed").alias("b")
    smaller = (F.col("a.size") < F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.id") < F.col("b.id")))
    on = (F.col("a.token") == F.col("b.token")) & (F.col("a.component") != F.col("b.component")) & smaller
    near = a.join(b, on & (F.col("a.size") >= similarity * F.col("b.size") - 1e-6))
    return near.select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v")).distinct()


def _block_links(crowded: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) between members of a bucket in different components: all pairs, in pairs of blocks.

    A pair of blocks gives a spanning forest of its links, fewer than it has members.
    """
    own = crowded.join(sets.select(F.col("row").alias("id"), F.octet_length("shingles").alias("bytes")), "id")
    need = lambda main: F.ceil(F.greatest(
        F.sum(F.when(F.col("main") == main, 1).otherwise(0)) / BLOCK_MEMBERS, F.sum(F.when(F.col("main") == main, F.col("bytes")).otherwise(0)) / BLOCK_BYTES
    ))
    blocks = own.groupBy("which", "key").agg(F.greatest(need(False), F.lit(1)).alias("others"), F.greatest(need(True), F.lit(1)).alias("mains"))
    own = own.join(blocks, ["which", "key"])
    # the blocks of the largest component come after the others and are not paired with each other
    place = F.xxhash64("id")
    own = own.withColumn("mine", F.when(F.col("main"), F.col("others") + F.pmod(place, F.col("mains"))).otherwise(F.pmod(place, F.col("others"))))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") + F.when(F.col("main"), 0).otherwise(F.col("mains")) - 1)))
    pair = F.xxhash64("which", "key", F.least("mine", "other"), F.greatest("mine", "other"))
    dealt = own.select(pair.alias("group"), "mine", (F.col("mine") == F.col("other")).alias("within"), "id", "component")
    dealt = dealt.join(sets.select(F.col("row").alias("id"), "shingles"), "id").repartition("group").sortWithinPartitions("group", "mine")

    def work(_, rows):
        ids, component, mine = (rows.column(c).to_numpy() for c in ("id", "component", "mine"))
        one = mine == mine[0]
        left, right = (np.arange(len(ids)),) * 2 if rows.column("within")[0].as_py() else (np.flatnonzero(one), np.flatnonzero(~one))
        if not len(right):
            return None
        held = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
        size = np.array([len(x) for x in held], np.int64)
        common = _common(held, left, right)
        alike = common >= similarity * (size[left][:, None] + size[right] - common)
        i, j = np.nonzero(alike & (component[left][:, None] != component[right]))
        return forest(ids[left[i]], ids[right[j]])

    return grouped_rows(dealt, "group", work, "u long, v long")


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``left`` with the sets ``right``, by products of their incidence matrices."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    owner, column = owner[shared[column]], number[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for first in range(0, int(shared.sum()), BLOCK_COLUMNS):
        a, b = np.searchsorted(column, (first, first + BLOCK_COLUMNS))
        x = np.zeros((len(sets), int(column[b - 1]) - first + 1), np.float32)
        x[owner[a:b], column[a:b] - first] = 1
        out += (x[left] @ x[right].T).astype(np.int64)
    return out


def _sets(rows: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``row`` and ``shingles`` (their distinct hashes, sorted, as bytes) of the rows in ``ids``; only their texts are read."""
    ids = durable(ids)
    mine = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "row", "left_semi")

    def sets(batches):
        for batch in batches:
            own = [_distinct(t, width).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["row", "shingles"])

    return stored(mine.select("row", "text").mapInArrow(sets, "row long, shingles binary"), "shingles")


def _similar(rows: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs whose sets of shingles are similar; only their members' texts are read for it."""
    sets = _sets(rows, pairs.select(F.explode(F.array("u", "v")).alias("row")).distinct(), width)
    return _alike(pairs, sets, similarity)


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose ``sets`` are similar."""
    with_u = pairs.join(sets.select(F.col("row").alias("u"), F.col("shingles").alias("a")), "u")
    both = with_u.join(sets.select(F.col("row").alias("v"), F.col("shingles").alias("b")), "v").select("u", "v", "a", "b")

    def compared(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["u", "v"])

    return both.mapInArrow(compared, "u long, v long")


def drop_near_copies(docs: DataFrame, width: int = NEAR_WORDS, similarity: float = SIMILARITY, radius: int = NEAR_RADIUS) -> DataFrame:
    """``docs`` with one row of each group of near copies (see ``near_copies``), all columns kept.

    Null, empty and wordless texts are copies of each other, so one of them stays; repeated rows are copies too.
    """
    table, row = with_row(docs)
    first = _first_rows(numbered_texts(table, row), width, similarity, radius).select(F.col("row").alias(row))
    gone = durable(table.select(row).join(first, row, "left_anti"))
    kept = table.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, row, "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: components of all documents by three-word SimHash at three bits."""
    bounded_batches(spark)
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))
