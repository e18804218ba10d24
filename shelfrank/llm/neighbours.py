"""Embedding near-dedup by NN-descent: a neighbour graph, refined through neighbours of neighbours, gives the near pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfrank.llm.common import connected_components, durable, forest, grouped_rows, stored

THRESHOLD = 0.95
#: Neighbours kept of each vector at first, and members of a neighbourhood that are compared in a round.
NEIGHBOURS, MEMBERS = 8, 32
#: Neighbours that a member takes from one neighbourhood.
INTRODUCED = 3
#: First graph: trees of random hyperplanes with leaves of about so many vectors, compared in blocks.
TREES, LEAF, LEAF_BLOCK = 4, 48, 256
#: Rounds before the first audit, and before a table that should have met its recall by then counts as failed.
LEAST_ROUNDS, ROUNDS = 2, 10
#: Audit: vectors compared with all others by brute force at first, and the mean recall of a vector's links that is asked for.
AUDIT, RECALL = 1024, 0.99
#: More vectors are drawn until so many have a true link, or their components would exceed so many bytes.
AUDITED, AUDIT_BYTES = 200, 1 << 25
#: Similarities of a tile in the audit.
TILE = 1 << 21
#: Vectors of a block when all vectors of a group are compared: an eighth of the group, within these numbers and bytes.
LEAST_BLOCK, MOST_BLOCK, BLOCK_BYTES = 512, 8192, 1 << 23
#: Lengths that no more different vectors have are one leaf, whose vectors are compared with each other anyway.
FEW = LEAF
SEED = 3


def unit_vectors(table: DataFrame) -> DataFrame:
    """``vec_id``, ``unit`` (doubles of length one, as bytes) and its ``digest`` of every row; null where a vector can't link.

    Null, empty and zero vectors and those with null or non-finite components can't.
    """

    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = np.array(v, np.float64) if v and None not in v else np.zeros(0)
                norm = np.linalg.norm(x / (m := np.abs(x).max())) * m if x.size and np.isfinite(x).all() and x.any() else 0.0
                out.append((x / norm).tobytes() if norm > 0 and np.isfinite(norm) else None)
            digest = [None if x is None else xxhash.xxh3_128_digest(x) for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(digest, pa.binary())], names=["vec_id", "unit", "digest"])

    rows = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, "vec_id long, unit binary, digest binary")


def _matrix(units: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float64).reshape(len(units), -1)


def _best(ids: np.ndarray, sims: np.ndarray, k: int):
    """For each member its ``k`` most similar others, as (u, v, sim)."""
    n = len(ids)
    np.fill_diagonal(sims, -2)
    if n > k + 1:
        j = np.argpartition(-sims, k, axis=1)[:, :k].ravel()
        i = np.repeat(np.arange(n), k)
    else:
        i, j = np.nonzero(sims > -2)
    return ids[i], ids[j], sims[i, j]


def _depth(count: int, leaf: int = LEAF) -> int:
    return max(1, min(24, int(np.ceil(np.log2(max(count / leaf, 2))))))


def first_graph(units: DataFrame, dim: int, count: int, k: int, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> DataFrame:
    """Edges (u, v, sim) between vectors that share a leaf of a random-hyperplane tree.

    Leaves are compared in blocks of bounded size, dealt by a hash of the id and the leaf, so a leaf that holds many vectors is many
    blocks and gives a number of edges in proportion to its vectors.
    """
    depth = _depth(count, leaf)
    planes = np.random.default_rng(seed).normal(size=(trees, depth, dim))

    def leaves(batches):
        for batch in batches:
            x = _matrix(batch.column(1).to_pylist()) if batch.num_rows else np.zeros((0, dim))
            for t in range(trees):
                bits = x @ planes[t].T > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array((bits @ (1 << np.arange(depth))) * trees + t), batch.column(0), batch.column(1)], names=["leaf", "id", "unit"]
                )

    placed = stored(units.mapInArrow(leaves, "leaf long, id long, unit binary"), "leaves")
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("n"))
    blocks = placed.join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64("id", "leaf", F.lit(seed)), F.ceil(F.col("n") / LEAF_BLOCK)))
    blocks = blocks.select(F.xxhash64("leaf", "block").alias("group"), "id", "unit")
    dealt = blocks.repartition("group").sortWithinPartitions("group")

    def work(_, rows):
        ids = rows.column("id").to_numpy()
        x = _matrix(rows.column("unit").to_pylist())
        parts = []
        for a in range(0, len(ids), 2 * LEAF_BLOCK):  # two blocks of one hash, or an uneven deal
            part = slice(a, a + 2 * LEAF_BLOCK)
            parts.append(_best(ids[part], x[part] @ x[part].T, k))
        return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))

    return grouped_rows(dealt, "group", work, "u long, v long, sim double")


def _kept(edges: DataFrame, k: int, threshold: float, longest: int) -> DataFrame:
    """The k nearest of each vector. A list whose k places are all links is saturated and holds up to ``longest`` of them."""
    one = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v")))
    return ranked.where((F.col("rank") <= k) | (F.col("rank") <= longest) & (F.col("sim") >= threshold)).select("u", "v", "sim")


def descend(units: DataFrame, graph: DataFrame, members: int, seed: int) -> DataFrame:
    """Edges found by one round: every vector introduces its neighbours, in both directions, to each other.

    A neighbourhood compares ``members`` of its members, chosen anew by hash in each round; what one round leaves out of
    a large neighbourhood, other neighbourhoods and later rounds compare.
    """
    both = graph.select(F.col("u").alias("centre"), F.col("v").alias("id")).unionByName(graph.select(F.col("v").alias("centre"), F.col("u").alias("id"))).distinct()
    own = graph.select(F.col("u").alias("centre"), F.col("u").alias("id")).distinct()
    salt = F.xxhash64("centre", "id", F.lit(seed))
    chosen = both.unionByName(own).withColumn("r", F.row_number().over(Window.partitionBy("centre").orderBy(salt))).where(F.col("r") <= members)
    carried = chosen.select("centre", "id").join(units.select(F.col("id"), "unit"), "id")
    dealt = carried.repartition("centre").sortWithinPartitions("centre")

    def work(_, rows):
        ids = rows.column("id").to_numpy()
        if len(ids) < 2:
            return None
        x = _matrix(rows.column("unit").to_pylist())
        return _best(ids, x @ x.T, INTRODUCED)

    return grouped_rows(dealt, "centre", work, "u long, v long, sim double")


def _brute(placed: DataFrame, queries: list[tuple[int, bytes, int]], threshold: float) -> DataFrame:
    """(u, n, within): true links of each query vector that has any, and those to vectors of its component.

    ``placed`` has ``id``, ``unit`` and ``component``, as each query has. Every task gives one row for a query.
    """
    ids, component = (np.array([q[i] for q in queries], np.int64) for i in (0, 2))
    sent = placed.sparkSession.sparkContext.broadcast((ids, _matrix([q[1] for q in queries]), component))

    def run(batches):
        q, x, of = sent.value
        n, within = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        step = max(1, TILE // len(q))
        for batch in batches:
            own, at = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for a in range(0, len(own), step):
                near = _matrix(batch.column(1)[a : a + step].to_pylist()) @ x.T >= threshold
                near &= own[a : a + step, None] != q
                n += near.sum(0)
                within += (near & (at[a : a + step, None] == of)).sum(0)
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(q[has]), pa.array(n[has]), pa.array(within[has])], names=["u", "n", "within"])

    rows = placed.select("id", "unit", "component").mapInArrow(run, "u long, n long, within long")
    return rows.groupBy("u").agg(F.sum("n").alias("n"), F.sum("within").alias("within"))


def _drawn(units: DataFrame, count: int, dim: int, threshold: float, audit: int, seed: int) -> tuple[list[int], bool]:
    """Vectors with a true link among those drawn by hash, whatever is found; and whether they are enough or all there are."""
    most = min(count, max(audit, AUDIT_BYTES // (8 * dim)))
    size = min(audit, most)
    alone = units.select("id", "unit", F.col("id").alias("component"))
    while True:
        queries = [(r["id"], bytes(r["unit"]), r["id"]) for r in alone.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(size).collect()]
        linked = [r["u"] for r in _brute(alone, queries, threshold).select("u").collect()]
        if len(linked) >= AUDITED or size == most:
            return linked, len(linked) >= AUDITED or size == count
        size = min(4 * size, most)


def measured_recall(units: DataFrame, part: DataFrame, linked: list[int], threshold: float = THRESHOLD) -> float:
    """Mean over the vectors ``linked`` of the share of their true links that lie within their component; 1 without any."""
    if not linked:
        return 1.0
    placed = units.join(part.withColumnRenamed("node", "id"), "id", "left").select("id", "unit", F.coalesce("component", "id").alias("component"))
    placed = stored(placed, "audit")
    chosen = placed.sparkSession.createDataFrame([(i,) for i in linked], "id long")
    queries = [(r["id"], bytes(r["unit"]), r["component"]) for r in placed.join(F.broadcast(chosen), "id").collect()]
    return _brute(placed, queries, threshold).agg(F.avg(F.col("within") / F.col("n"))).first()[0]


def near_components(
    units: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBOURS, members: int = MEMBERS, rounds: int | None = None,
    audit: int = AUDIT, recall: float = RECALL, seed: int = SEED,
) -> DataFrame:
    """(node, component, recall) of the vectors that are linked to another at cosine ``threshold`` or more.

    ``units`` has ``id`` and ``unit``, each vector once. NN-descent begins with a graph of random-hyperplane leaves; each
    round compares the neighbours of every vector, and the edges at the threshold are links. Lists that are full of links
    double with each round. After two rounds the links' components are audited: vectors drawn by hash, whatever has been
    found for them, are compared with all vectors. Rounds go on, each with fresh trees, until the mean over those with a
    true link of the share of their links within their component is ``recall``; if it isn't after ``rounds``, that is an
    error. Unless they are given, rounds are as many as trees need to bring a pair at the threshold into a leaf with chance
    ``recall``, by the depth that the number of vectors asks for, and two more; ``ROUNDS`` at least. Where too few vectors with a link can be drawn, a pair at the threshold must also have met in a leaf with chance
    ``recall``. The result tells the measured recall in each row.
    """
    first = units.select("unit").limit(1).collect()
    if not first:
        return units.sparkSession.createDataFrame([], "node long, component long, recall double")
    dim, count = len(first[0]["unit"]) // 8, units.count()
    edges = stored(first_graph(units, dim, count, k, seed=seed), "leaf_edges")
    graph = durable(_kept(edges, k, threshold, k))
    near = F.col("sim") >= threshold
    links = stored(edges.where(near & (F.col("u") < F.col("v"))).select("u", "v").distinct(), "links")
    if rounds == 0:
        return connected_components(links).withColumn("recall", F.lit(None).cast("double"))
    linked, enough = _drawn(units, count, dim, threshold, audit, seed)
    apart = 1 - (1 - np.arccos(min(threshold, 1.0)) / np.pi) ** _depth(count)  # chance that no leaf of a tree has a pair
    trees, got = TREES, 0.0
    if rounds is None:
        needed = np.log(max(1 - recall, 1e-9)) / np.log(apart) if 0 < apart < 1 else 0
        rounds = max(ROUNDS, LEAST_ROUNDS + int(np.ceil(needed / TREES)) + 2)
    for r in range(rounds):
        found = descend(units, graph, members, seed + r)
        if r >= LEAST_ROUNDS:
            found = found.unionByName(first_graph(units, dim, count, k, seed=seed + 1000 * r))
            trees += TREES
        found = stored(found, "edges")
        new = found.where(near).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        links = links.unionByName(stored(new.distinct(), "links"))  # each round writes what it found
        if r + 1 >= LEAST_ROUNDS:
            part = durable(connected_components(links))
            got = measured_recall(units, part, linked, threshold)
            if got >= recall and (enough or apart**trees <= 1 - recall):
                return part.withColumn("recall", F.lit(got))
        graph = durable(_kept(graph.unionByName(found), k, threshold, min(members, k << (r + 1))))
    raise RuntimeError(f"recall of links is {got:.4f} over {len(linked)} vectors after {rounds} rounds and {trees} trees; {recall} is asked for")


def _block_pairs(vectors: DataFrame) -> DataFrame:
    """``vectors`` (component, id, unit, m) dealt so that any two of a component meet once: (group, mine, within, ...).

    Each vector goes to as many groups as its component has blocks: eight until they have their largest size.
    """
    most = F.least(F.lit(MOST_BLOCK), F.floor(BLOCK_BYTES / F.max(F.octet_length("unit"))))
    sizes = vectors.groupBy("component").agg(F.ceil(F.count("*") / F.greatest(F.lit(LEAST_BLOCK), F.least(F.ceil(F.count("*") / 8), most))).alias("blocks"))
    own = vectors.join(sizes, "component").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = F.xxhash64("component", F.least("mine", "other"), F.greatest("mine", "other"))
    dealt = spread.select(pair.alias("group"), "component", "mine", (F.col("mine") == F.col("other")).alias("within"), "id", "unit", "m")
    return dealt.repartition("group").sortWithinPartitions("group", "component", "mine")


def _near_tiles(rows: pa.Table, threshold: float):
    """(left, right, near) of the parts of a group of ``_block_pairs``: places, and which of them are linked."""
    mine = rows.column("mine").to_numpy()
    x = _matrix(rows.column("unit").to_pylist())
    within = rows.column("within")[0].as_py()
    one = mine == mine[0]
    left, right = (np.arange(len(x)),) * 2 if within else (np.flatnonzero(one), np.flatnonzero(~one))
    for a in range(0, len(left) if len(right) else 0, step := max(1, TILE // max(len(right), 1))):
        part = left[a : a + step]
        near = x[part] @ x[right].T >= threshold
        if within:
            near[np.arange(len(part)), np.arange(a, a + len(part))] = False
        yield part, right, near, within


def whole_components(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, component, recall) of linked vectors among those of one ``component`` (here: length), all of them compared."""

    def work(_, rows):
        ids, found = rows.column("id").to_numpy(), []
        for left, right, near, _ in _near_tiles(rows, threshold):
            i, j = np.nonzero(near)
            found.append(forest(ids[left[i]], ids[right[j]]))
        return tuple(np.concatenate([f[i] for f in found]) for i in (0, 1)) if found else None

    links = grouped_rows(_block_pairs(vectors), "group", work, "u long, v long")
    return connected_components(links).withColumn("recall", F.lit(1.0))


def count_links(classes: DataFrame, part: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, beyond): rows in other classes that each class of a component is linked to.

    All vectors of a component are compared, in pairs of blocks; a pair of blocks gives a number for each of its vectors,
    so the links themselves are never rows, however many there are.
    """

    def work(_, rows):
        ids, m = rows.column("id").to_numpy(), rows.column("m").to_numpy().astype(np.float64)
        counts = np.zeros(len(ids))
        for left, right, near, within in _near_tiles(rows, threshold):
            counts[left] += near @ m[right]
            if not within:
                counts[right] += near.T @ m[left]
        return ids, counts.astype(np.int64)

    own = part.select(F.col("node").alias("id"), "component").join(classes.select("id", "unit", "m"), "id")
    return grouped_rows(_block_pairs(own), "group", work, "id long, n long").groupBy("id").agg(F.sum("n").alias("beyond"))


def link(table: DataFrame, threshold: float = THRESHOLD, few: int = FEW, **options) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` and ``recall`` of every row, by cosine in double precision.

    Equal vectors are one class from the start, so copies form no pairs: a row's links are the other rows of its class
    and all rows of the classes that its class is linked to. Vectors of one length are compared with each other: by
    NN-descent, with the recall that its audit measured, or as one leaf where there are no more than ``few``. The links within
    each component are then counted exactly. Vectors that can't link (null, empty, zero, or with null or non-finite
    components) have no links and no recall. ``component_id`` is the smallest vec_id that can be reached, ``kept`` marks
    that row. Repeated rows count as rows. A row with a null vec_id counts as a link of others and has links itself, but is
    never the smallest or kept; a component of such rows alone has a null id. Other columns are left behind.
    """
    rows = stored(unit_vectors(table).withColumn("row", F.monotonically_increasing_id()), "units")
    able = rows.where("unit is not null")
    classes = able.groupBy("digest").agg(F.min("row").alias("id"), F.min("vec_id").alias("least"), F.count("*").alias("m"), F.first("unit").alias("unit"))
    classes = stored(classes.withColumn("length", F.octet_length("unit").cast("long")), "classes")
    lengths = classes.groupBy("length").agg(F.count("*").alias("n"))
    large = [r["length"] for r in lengths.where(F.col("n") > few).orderBy("length").collect()]
    small = classes.where(~F.col("length").isin(large)) if large else classes
    parts = [whole_components(small.select(F.col("length").alias("component"), "id", "unit", "m"), threshold)]
    parts += [near_components(classes.where(F.col("length") == n).select("id", "unit"), threshold, **options) for n in large]
    part = parts[0]
    for p in parts[1:]:
        part = part.unionByName(p)
    part = durable(part)
    beyond = count_links(classes, part, threshold)
    placed = classes.select("digest", "id", "least", "m").join(beyond, "id", "left").join(part.withColumnRenamed("node", "id"), "id", "left")
    first = placed.where("component is not null").groupBy("component").agg(F.min("least").alias("first"))
    known = placed.join(first, "component", "left").select(
        "digest", (F.col("m") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"), F.coalesce("first", "least").alias("component_id"), "recall",
    )
    joined = able.select("vec_id", "digest").join(known, "digest").select("vec_id", "n_links", "component_id", "recall")
    none = rows.where("unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(None).cast("double").alias("recall"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return joined.unionByName(none).select("vec_id", "n_links", "component_id", kept.alias("kept"), "recall")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all embeddings, whatever their labels."""
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
