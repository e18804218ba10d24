"""Products of many users' vectors with all items', in tiles of items, leaf by leaf where a leaf's bound allows a place in a list."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.operators.recommender import I, U
from shelfrank.sources.shared import remove, stored

#: Bytes of items that are sent to a task at once, items of a leaf, and bounds that a task works out at a time.
TILE_BYTES, ITEMS_AT_ONCE, PRODUCTS = 1 << 26, 128, 1 << 23
#: Places by which vectors are put into leaves (more are folded), and numbers of all leaves' boxes.
FOLDED, BOX_NUMBERS = 128, 1 << 22
#: Share of the vectors' squares that leaves leave within, from which on items go by their length.
LOOSE = 0.5
#: A side under this share of the rows isn't cut off.
SIDE = 1 / 64
#: Leaves that each user passes first, cells of a leaf's users from which on they pass it together, and pairs that a task looks at together.
FIRST, CROWD, PAIRS_AT_ONCE = 3, 1 << 14, 1 << 17
#: Pairs that are found before the least score of each user's list is worked out again.
FOUND = 1 << 18


def dense_places(long: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, at, vector) of rows (key, feature, value): places in ``names``, which is sent to the tasks, and values."""
    places = long.sparkSession.createDataFrame([(f, i) for i, f in enumerate(names)], "feature string, place int")
    placed = long.join(F.broadcast(places), "feature").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("c"))
    return placed.select(key, F.col("c.place").alias("at"), F.col("c.value").alias("vector"))


def blocked_top(users: DataFrame, items: DataFrame, n: int, dim: int, seen: DataFrame | None = None) -> DataFrame:
    """(customer_key, product_key, score): the n largest inner products of each user with the items it hasn't seen, for each tile.

    ``users`` has (customer_key, at array<int>, vector array<double>), ``items`` (product_key, at, vector): places and values
    of vectors of length ``dim``; ``seen`` has (customer_key, product_key). Items of one vector are compared once. Vectors are
    dealt by hash into tiles of about ``TILE_BYTES`` as places and values; each tile is sent to the tasks and all users pass
    by it. Ties at the cut (to 1e-9) all go on. The rows of all tiles together hold each user's best, so ranking them merges
    the tiles. No task and no driver holds more than a tile.

    Within a tile items that are alike make a leaf. What a user can score in a leaf has a bound, by the ends of its items'
    values at each place and by their lengths; leaves whose bound is under the n-th score that is found aren't looked at.
    """
    kept = F.col("vector").isNotNull()
    users = users.where(kept).select(U, "at", "vector")
    if seen is None:
        users = users.withColumn("seen", F.array().cast("array<long>"))
    else:
        lists = seen.groupBy(U).agg(F.collect_set(F.col(I).cast("long")).alias("seen"))
        users = users.join(lists, U, "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<long>")))
    items = stored(items.where(kept & F.col(I).isNotNull()).groupBy("at", "vector").agg(F.sort_array(F.collect_list(F.col(I).cast("long"))).alias("ids")), "items")
    size = items.agg(F.sum(12 * F.size("at") + 8 * F.size("ids"))).first()[0] or 0
    tiles = max(1, -(-size // TILE_BYTES))
    if tiles > 1:
        users = stored(users, "users")
    dealt = items.withColumn("tile", F.pmod(F.xxhash64("at", "vector"), F.lit(tiles)))
    parts = [_past(users, dealt.where(F.col("tile") == t), n, dim) for t in range(tiles)]
    remove(items)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _flat(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the lists of a column and their values."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)


def _dense(at: np.ndarray, values: np.ndarray, size: np.ndarray, dim: int, kind=float) -> np.ndarray:
    """A row for each list of places and values."""
    out = np.zeros((len(size), dim), kind)
    out[np.repeat(np.arange(len(size)), size), at] = values
    return out


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each beginning on, as many as its size."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)


def _leaves(vectors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, leaf of each in that order): rows cut in two at the place where they differ most, until ``most`` are left together.

    Where the leaves' rows still differ about as much as all do, rows go by their length.
    """
    todo, done, held = [np.arange(len(vectors))], [], 0.0
    while todo:
        rows = todo.pop()
        own = vectors[rows]
        if len(rows) <= most:
            done.append(rows)
            held += len(rows) * float((own.mean(0, dtype=float) ** 2).sum())
            continue
        x = own[:, own.var(0).argmax()]
        right = x > x.mean()
        if min(right.sum(), (~right).sum()) < len(rows) * SIDE:  # a few rows far off, or all alike
            right = np.zeros(len(rows), bool)
            right[np.argpartition(x, len(rows) // 2)[len(rows) // 2 :]] = True
        todo += [rows[right], rows[~right]]
    squares = (vectors.astype(float) ** 2).sum(1)
    if squares.sum() - held > LOOSE * squares.sum():
        order = np.argsort(-squares, kind="stable")
        return order, np.arange(len(order)) // most
    return np.concatenate(done) if done else np.empty(0, np.int64), np.repeat(np.arange(len(done)), [len(d) for d in done])


def _in_leaves(dim: int):
    """The rows of a tile by leaf, with its number."""

    def run(table: pa.Table) -> pa.Table:
        (size, at), (_, values) = _flat(table.column("at"), np.int64), _flat(table.column("vector"), np.float32)
        if dim <= FOLDED:
            vectors = _dense(at, values, size, dim, np.float32)
        else:
            vectors = np.zeros((len(size), FOLDED), np.float32)
            np.add.at(vectors, (np.repeat(np.arange(len(size)), size), at * 7919 % FOLDED), values)
        order, leaf = _leaves(vectors, max(ITEMS_AT_ONCE, -(-len(size) * dim // BOX_NUMBERS)))
        return table.select(["at", "vector", "ids"]).take(pa.array(order)).append_column("leaf", pa.array(leaf.astype(np.int32)))

    return run


class _Tile:
    """Vectors by places and values, the ids of the items of each, and the ends of each leaf."""

    def __init__(self, table: pa.Table, dim: int):
        table = table.sort_by("leaf")
        (size, self.at), (_, self.values) = _flat(table.column("at"), np.int32), _flat(table.column("vector"), float)
        self.start = np.r_[0, np.cumsum(size)]
        size, self.ids = _flat(table.column("ids"), np.int64)
        self.first = np.r_[0, np.cumsum(size)]
        self.order = np.argsort(self.ids)
        self.owner = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        leaf = table.column("leaf").to_numpy()
        self.edges = np.r_[np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]]), len(leaf)] if len(leaf) else np.zeros(1, np.int64)
        self.low, self.high, self.middle, self.longest = (np.zeros((len(self.edges) - 1, *d)) for d in ((dim,), (dim,), (dim,), ()))
        for i, (a, b) in enumerate(zip(self.edges, self.edges[1:], strict=False)):
            own = self.part(a, b, dim)
            self.low[i], self.high[i], self.middle[i], self.longest[i] = own.min(0), own.max(0), own.mean(0), np.sqrt((own * own).sum(1).max())

    def part(self, a: int, b: int, dim: int) -> np.ndarray:
        cells = slice(self.start[a], self.start[b])
        return _dense(self.at[cells], self.values[cells], np.diff(self.start[a : b + 1]), dim)

    def seen_items(self, size: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(user, place in ``ids``) of the seen items that the tile has."""
        user = np.repeat(np.arange(len(size)), size)
        ordered = self.ids[self.order]
        spot = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
        here = ordered[spot] == wanted
        return user[here], self.order[spot[here]]

    def near(self, vectors: np.ndarray, whole: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(user, group, score): of each user the n best groups but those in ``whole`` (user * groups + group), and what ties with the last."""
        count, dim = vectors.shape
        groups, length = len(self.first) - 1, np.sqrt((vectors * vectors).sum(1))
        single = float(length.max(initial=0.0)) * float(self.longest.max(initial=0.0)) * dim < 1e30
        bound, least = self.bounds(vectors, length, single), np.full(count, -np.inf)
        small = vectors.astype(np.float32) if single else None
        held: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        new = 0

        def keep(x: np.ndarray, y: np.ndarray, score: np.ndarray) -> None:
            nonlocal new
            stay = score >= least[x] - 1e-9
            if len(whole) and len(x):
                key = x * groups + y
                stay &= whole[np.minimum(np.searchsorted(whole, key), len(whole) - 1)] != key
            for h, v in zip(held, (x[stay], y[stay], score[stay]), strict=True):
                h.append(v)
            new += int(stay.sum())
            if new > FOUND:
                settle()

        def visit(leaf: int, who: np.ndarray) -> None:
            """Many users at one leaf."""
            a, b = self.edges[leaf], self.edges[leaf + 1]
            own, needs = self.part(a, b, dim), least[who]
            if small is not None and np.isfinite(needs).all():
                # products of single precision leave out what can't reach the list; the others are worked out again
                needs = needs - (dim + 4) * 2.4e-7 * length[who] * self.longest[leaf] - 1e-9
                scores = (small if len(who) == count else small[who]) @ own.T.astype(np.float32)
                x, y = np.divmod(np.flatnonzero(scores >= needs.astype(np.float32)[:, None]), b - a)
                score = np.einsum("ij,ij->i", vectors[who[x]], own[y])
            else:
                scores = vectors[who] @ own.T
                x, y = np.divmod(np.flatnonzero(scores >= needs[:, None] - 1e-9), b - a)
                score = scores[x, y]
            keep(who[x], y + a, score)

        def walk(who: np.ndarray, leaf: np.ndarray) -> None:
            """Users at some leaves each, item by item."""
            size = np.diff(self.edges)[leaf]
            done = np.cumsum(size)
            at = 0
            while at < len(who):
                end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
                x, y = np.repeat(who[at:end], size[at:end]), _spans(self.edges[leaf[at:end]], size[at:end])
                cells = self.start[y + 1] - self.start[y]
                row, cell = np.repeat(np.arange(len(x)), cells), _spans(self.start[y], cells)
                keep(x, y, np.bincount(row, vectors[x[row], self.at[cell]] * self.values[cell], len(x)))
                at = end

        def settle() -> None:
            nonlocal new, held
            x, y, score = (np.concatenate(h) for h in held)
            order = np.lexsort((-score, x))
            x, y, score = x[order], y[order], score[order]
            begin = np.searchsorted(x, np.arange(count))
            full = np.flatnonzero(np.diff(np.r_[begin, len(x)]) >= n)
            least[full] = np.maximum(least[full], score[begin[full] + n - 1])
            stay = score >= least[x] - 1e-9
            held, new = [[x[stay]], [y[stay]], [score[stay]]], 0

        def pass_by(who: np.ndarray, leaf: np.ndarray) -> None:
            order = np.argsort(leaf, kind="stable")
            who, leaf = who[order], leaf[order]
            begin = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]]) if len(leaf) else np.empty(0, np.int64)
            size = np.diff(np.r_[begin, len(leaf)])
            cells = np.diff(self.start[self.edges])[leaf[begin]] * size
            few = np.repeat(cells < CROWD, size)
            walk(who[few], leaf[few])
            crowds = np.flatnonzero(cells >= CROWD)
            for i in crowds[np.argsort(-size[crowds], kind="stable")]:
                own = who[begin[i] : begin[i] + size[i]]
                own = own[bound[own, leaf[begin[i]]] >= least[own]]
                if len(own):
                    visit(leaf[begin[i]], own)

        everyone, middle = np.arange(count), (vectors if small is None else small) @ self.middle.T.astype(float if small is None else np.float32)
        for _ in range(min(FIRST, bound.shape[1])):  # the most promising leaves of each
            best = middle.argmax(1)
            middle[everyone, best] = -np.inf
            ready = np.flatnonzero(bound[everyone, best] >= least)
            pass_by(ready, best[ready])
            bound[everyone, best] = -np.inf
            settle()
        who, leaf = np.divmod(np.flatnonzero((bound >= least[:, None]) & (bound > -np.inf)), bound.shape[1])
        pass_by(who, leaf)
        settle()
        return held[0][0], held[1][0], held[2][0]

    def bounds(self, vectors: np.ndarray, length: np.ndarray, single: bool) -> np.ndarray:
        """What a user can score in a leaf at most: by the ends of its values, by their length, and by what the users' mean scores there."""
        kind = np.float32 if single else float
        low, high, corner = self.low.astype(kind), self.high.astype(kind), np.sqrt((np.maximum(-self.low, self.high) ** 2).sum(1))

        def ends(v: np.ndarray) -> np.ndarray:
            out = np.maximum(v, 0).astype(kind) @ high.T
            out += np.minimum(v, 0).astype(kind) @ low.T
            return out

        mean = vectors.mean(0) if len(vectors) else np.zeros(vectors.shape[1])
        bound = ends(vectors)
        np.minimum(bound, np.outer(length, self.longest).astype(kind), out=bound)
        if len(self.edges) > 1:
            items = np.bincount(np.repeat(np.arange(len(self.first) - 1), np.diff(self.start)), mean[self.at] * self.values, len(self.first) - 1)
            other = ends(vectors - mean)
            other += np.maximum.reduceat(items, self.edges[:-1]).astype(kind)
            np.minimum(bound, other, out=bound)
        # what rounding may take from a sum
        bound += np.outer((vectors.shape[1] + 8) * (1.2e-7 if single else 1e-15) * (length + np.sqrt(mean @ mean)), np.maximum(corner, self.longest)).astype(kind) + kind(1e-9)
        return bound

    def best(self, vectors: np.ndarray, size: np.ndarray, wanted: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(user, id, score): of each user the first n items it hasn't seen, and what ties with the last."""
        groups = len(self.first) - 1
        user, place = self.seen_items(size, wanted)
        gone = np.unique(user * len(self.ids) + place)
        whole, times = np.unique((gone // len(self.ids)) * groups + self.owner[gone % len(self.ids)], return_counts=True)
        whole = whole[times >= np.diff(self.first)[whole % groups]]  # vectors of which a user has seen every item
        x, group, score = self.near(vectors, whole, n)
        # of each vector the n lowest ids that the user hasn't seen: those it has seen come in between
        skip = _counts(x * groups + group, (gone // len(self.ids)) * groups + self.owner[gone % len(self.ids)])
        take = np.minimum(np.diff(self.first)[group], n + skip)
        row = np.repeat(np.arange(len(x)), take)
        spot = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take) + self.first[group][row]
        key = x[row] * len(self.ids) + spot
        new = gone[np.minimum(np.searchsorted(gone, key), len(gone) - 1)] != key if len(gone) else np.ones(len(key), bool)
        x, ids, score = x[row][new], self.ids[spot[new]], score[row][new]
        order = np.lexsort((ids, -score, x))
        x, ids, score = x[order], ids[order], score[order]
        begin = np.searchsorted(x, np.arange(len(vectors)))
        size = np.diff(np.r_[begin, len(x)])
        last = np.repeat(score[np.minimum(begin + np.minimum(size, n) - 1, len(x) - 1)], size) if len(x) else score
        stay = score >= last - 1e-9
        return x[stay], ids[stay], score[stay]


def _counts(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """How often each of ``keys`` is in ``among``."""
    among = np.sort(among)
    return np.searchsorted(among, keys, "right") - np.searchsorted(among, keys, "left")


def _past(users: DataFrame, tile: DataFrame, n: int, dim: int) -> DataFrame:
    """All users past one tile, whose leaves a task makes; the driver keeps a tile in a file once it is sent."""
    leaves = tile.groupBy("tile").applyInArrow(_in_leaves(dim), "at array<int>, vector array<double>, ids array<long>, leaf int")
    sent = users.sparkSession.sparkContext.broadcast(_Tile(leaves.toArrow(), dim))
    kind = users.schema[U].dataType.simpleString()

    def past(batches):
        own = sent.value
        groups = len(own.first) - 1
        step = max(1, PRODUCTS // max(len(own.edges), dim, 1024))
        for batch in batches:
            for i in range(0, batch.num_rows if groups else 0, step):
                part = batch.slice(i, step)
                (size, at), (_, values) = _flat(part.column("at"), np.int64), _flat(part.column("vector"), float)
                x, ids, score = own.best(_dense(at, values, size, dim), *_flat(part.column("seen"), np.int64), n)
                yield pa.RecordBatch.from_arrays([part.column(U).take(pa.array(x)), pa.array(ids), pa.array(score)], names=[U, I, "score"])

    return users.mapInArrow(past, f"{U} {kind}, {I} long, score double")
