"""Suffix arrays of byte shards by induced sorting, and their permuted common prefixes, with numpy.

Suffixes are classified, the leftmost-smaller substrings are sorted by induction and named, the text of their names is
sorted by the same steps, and its order induces that of all suffixes through a pointer for each bucket. Over bytes a step
of the induction works on a whole bucket (all suffixes that begin with one byte) at a time: what a bucket holds is known
once the buckets before it are done, and runs of one byte take a wave for each of their bytes. Letters are 16-bit there,
which numpy sorts stably by counting. Texts of names have many small buckets: they are induced
in rounds where their sequences are short, else through the pointers one by one.
"""

from __future__ import annotations

import numpy as np


def smaller_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the text ends with a unique least value."""
    n = len(text)
    out = np.ones(n, bool)
    if n < 2:
        return out
    diff = text[:-1] != text[1:]
    less = text[:-1] < text[1:]
    at = np.where(diff, np.arange(n - 1), n - 1)
    nxt = np.minimum.accumulate(at[::-1])[::-1]  # the next place where two neighbours differ
    out[:-1] = np.where(nxt < n - 1, less[np.minimum(nxt, n - 2)], True)
    return out


def _induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the order of the leftmost-smaller ones (``seeds``)."""
    n, k = len(text), len(size)
    sa = np.full(n, -1, np.int64)
    end = np.cumsum(size)
    begin = end - size
    # larger suffixes, from the least bucket up
    front = begin.copy()
    seed_chars = text[seeds]
    seed_end = np.searchsorted(seed_chars, np.arange(k), "right")
    seed_begin = np.searchsorted(seed_chars, np.arange(k), "left")

    def larger_before(pos: np.ndarray) -> None:
        p = pos[pos > 0] - 1
        p = p[~smaller[p]]
        if p.size:
            c = text[p]
            order = np.argsort(c, kind="stable")
            p, c = p[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            count = np.diff(np.append(first, len(c)))
            rank = np.arange(len(c)) - np.repeat(first, count)
            sa[front[c] + rank] = p
            front[c[first]] += count

    for c in np.flatnonzero(size):
        done = begin[c]
        while done < front[c]:
            new = front[c]
            larger_before(sa[done:new])
            done = new
        if seed_end[c] > seed_begin[c]:
            larger_before(seeds[seed_begin[c] : seed_end[c]])
    # smaller suffixes, from the greatest bucket down
    back = end.copy()

    def smaller_before(pos: np.ndarray) -> None:
        p = pos[pos > 0] - 1
        p = p[smaller[p]]
        if p.size:
            c = text[p]
            order = np.argsort(c, kind="stable")
            p, c = p[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            count = np.diff(np.append(first, len(c)))
            rank = np.arange(len(c)) - np.repeat(first, count)
            sa[back[c] - 1 - rank] = p
            back[c[first]] -= count

    for c in np.flatnonzero(size)[::-1]:
        done = end[c]
        while done > back[c]:
            new = back[c]
            smaller_before(sa[new:done][::-1])
            done = new
        smaller_before(sa[begin[c] : front[c]][::-1])
    sa[0] = n - 1
    return sa


def _name(text: np.ndarray, at: np.ndarray, sorted_at: np.ndarray) -> np.ndarray:
    """Ranks of the substrings that run from each leftmost-smaller place to the next; equal substrings share one."""
    length = np.empty(len(text), np.int64)
    length[at] = np.diff(np.append(at, len(text) - 1)) + 1
    a, b = sorted_at[:-1], sorted_at[1:]
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    j = 0
    while live.size:
        x, y = a[live], b[live]
        differ = text[np.minimum(x + j, len(text) - 1)] != text[np.minimum(y + j, len(text) - 1)]
        same[live[differ]] = False
        j += 1
        live = live[~differ & (length[x] > j)]
    rank = np.empty(len(text), np.int64)
    rank[sorted_at] = np.concatenate([[0], np.cumsum(~same)])
    return rank[at]


def _induce_each(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``_induce`` one suffix at a time, for texts whose letters are nearly as many as their places."""
    n = len(text)
    end = np.cumsum(size)
    sa_ = np.full(n, n, np.int64)  # n: nothing yet
    count = np.arange(len(seeds)) - np.searchsorted(text[seeds], text[seeds], "right")
    sa_[end[text[seeds]] + count] = seeds
    # the place before each one if it is to be induced in the pass, or n
    at = np.arange(-1, n)
    larger = np.append(np.where((at[:-1] >= 0) & ~smaller[at[:-1]], at[:-1], n), n).tolist()
    less = np.append(np.where((at[:-1] >= 0) & smaller[at[:-1]], at[:-1], n), n).tolist()
    letter, sa = text.tolist(), sa_.tolist()
    front = (end - size).tolist()
    for p in sa:  # what is induced comes later in the list
        p = larger[p]
        if p < n:
            c = letter[p]
            sa[front[c]] = p
            front[c] += 1
    back = (end - 1).tolist()
    for p in reversed(sa):
        p = less[p]
        if p < n:
            c = letter[p]
            sa[back[c]] = p
            back[c] -= 1
    return np.array(sa, np.int64)


#: Falling or rising sequences of names up to this length are induced a step of all at a time.
ROUNDS = 24


def _by_letter(letters: np.ndarray, most: int) -> np.ndarray:
    """Stable order of the letters, by counting their lower and then their upper 16 bits."""
    order = np.argsort(letters.astype(np.uint16), kind="stable")
    return order if most < 1 << 16 else order[np.argsort((letters[order] >> 16).astype(np.uint16), kind="stable")]


def _induce_rounds(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, size: np.ndarray) -> np.ndarray | None:
    """``_induce`` in rounds: round t has in order what is up to t changes of letter from a seed; None beyond ``ROUNDS``.

    A run of one letter is induced at once: its larger suffixes grow, and its smaller ones fall, with their distance from
    the end of the run, and those of one distance stand as the suffixes behind their runs do.
    """
    n = len(text)
    start = np.maximum.accumulate(np.where(np.concatenate([[True], text[1:] != text[:-1]]), np.arange(n), 0))
    length = np.arange(n) - start + 1  # of the run up to each place

    def before(order: np.ndarray, kind: np.ndarray, sign: int) -> np.ndarray:
        q = order[order > 0]
        p = q - 1
        p = p[kind[p] & (text[p] != text[q])]
        times = length[p]
        if (times == 1).all():
            return p
        k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return (np.repeat(p, times) - k)[np.argsort(sign * k, kind="stable")]

    larger, order = ~smaller, seeds
    wanted = int(larger.sum()) + len(seeds)
    for _ in range(ROUNDS):
        if len(order) == wanted:
            break
        both = np.concatenate([before(order, larger, 1), seeds])
        order = both[_by_letter(text[both], len(size))]
    first = order = order[larger[order]]
    for _ in range(ROUNDS):
        if len(order) == n - 1:  # all but the end, which is the least
            return np.concatenate([[n - 1], order])
        both = np.concatenate([first, before(order, smaller, -1)])
        order = both[_by_letter(text[both], len(size))]
    return None


def _induced(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, size: np.ndarray) -> np.ndarray:
    got = _induce_rounds(text, smaller, seeds, size)
    return _induce_each(text, smaller, seeds, size) if got is None else got


def _leftmost(smaller: np.ndarray) -> np.ndarray:
    """Places whose suffix is smaller than the next one while the one before is not; the last one is the end."""
    return np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def _order_of_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of the reduced text, by the same steps again; its last name is its unique least."""
    m = len(names)
    size = np.bincount(names)
    if len(size) == m:
        return np.argsort(names)
    smaller = smaller_types(names)
    at = _leftmost(smaller)
    rough = _induced(names, smaller, at[np.argsort(names[at], kind="stable")], size)
    leftmost = np.zeros(m, bool)
    leftmost[at] = True
    order = _order_of_names(_name(names, at, rough[leftmost[rough]]))
    return _induced(names, smaller, at[order], size)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of ``data`` (bytes) in order; an end is less than any byte."""
    n = len(data)
    if n < 2:
        return np.arange(n)
    text = np.append(data.astype(np.uint16) + np.uint16(1), np.uint16(0))
    size = np.bincount(text, minlength=257)
    smaller = smaller_types(text)
    at = _leftmost(smaller)
    rough = _induce(text, smaller, at[np.argsort(text[at], kind="stable")], size)
    leftmost = np.zeros(n + 1, bool)
    leftmost[at] = True
    order = _order_of_names(_name(text, at, rough[leftmost[rough]]))
    return _induce(text, smaller, at[order], size)[1:]


#: Distance between the places whose prefixes are worked out first; it halves until every place has its own.
SPARSE = 32


def permuted_prefixes(data: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """For each place, how much its suffix has in common with the one before it in order, up to ``limit``.

    A place has at most one byte less in common than the place before it, so a place that is ``d`` behind a known one
    begins its comparison ``d`` below that one's length (Kasai's step, taken from sparse places to dense ones). Bytes are
    compared eight at a time; places that differ drop out.
    """
    n = len(data)
    before = np.full(n, n, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(n + 1, np.uint64)
    for i in range(8):
        word[:n] |= padded[i : n + i] << np.uint64(8 * i)
    out = np.zeros(n, np.int64)
    most = np.minimum(n - np.maximum(before, np.arange(n)), limit)
    step = SPARSE
    while step:
        live = np.arange(0, n, SPARSE) if step == SPARSE else np.arange(step, n, 2 * step)
        known = np.zeros(len(live), np.int64) if step == SPARSE else np.maximum(out[live - step] - step, 0)
        out[live] = np.minimum(known, most[live])
        on = known < most[live]
        live, known = live[on], known[on]
        while live.size:
            x = word[live + known] ^ word[before[live] + known]
            low = x & (~x + np.uint64(1))
            equal = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
            known = known + equal
            out[live] = np.minimum(known, most[live])
            on = (x == 0) & (known < most[live])
            live, known = live[on], known[on]
        step //= 2
    return out
