"""FLAC streams of 8-bit mono samples, coded and decoded for many frames at a time with numpy.

Frames of one call are worked on side by side: a step handles sample ``i`` (or byte ``i``) of all of them, so the cost
of a step is shared by some thousand frames. Only the subset of the format that 8-bit mono needs is written; the decoder
takes constant, verbatim, fixed and linear-predictive subframes, all Rice partitions and escapes.
"""

from __future__ import annotations

import hashlib

import numpy as np

BLOCK = 576
#: Seek points of a metadata block, and the name of the blocks that hold further ones.
SEEK_POINTS, MORE_POINTS = 900_000, b"skpt"
RATE = 8000


def _crc_table(poly: int, width: int) -> np.ndarray:
    out = []
    for value in range(256):
        crc = value << (width - 8)
        for _ in range(8):
            crc = (crc << 1) ^ (poly if crc >> (width - 1) & 1 else 0)
        out.append(crc & ((1 << width) - 1))
    return np.array(out, dtype=np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8).astype(np.uint8), _crc_table(0x8005, 16)


def crc8(columns: np.ndarray) -> np.ndarray:
    """CRC-8 of each column; leading zero bytes change nothing."""
    crc = np.zeros(columns.shape[1], np.uint8)
    for row in columns:
        crc = CRC8[crc ^ row]
    return crc


def _crc16_pairs() -> np.ndarray:
    """CRC-16 of every pair of bytes."""
    pair = np.arange(1 << 16, dtype=np.uint16)
    crc = CRC16[pair >> 8]
    return CRC16[((crc >> 8) ^ (pair & 255)) & 255] ^ (crc << 8)


CRC16_PAIRS = _crc16_pairs()
#: Zeros before the first one of 16 bits.
LEADING = np.array([16 - i.bit_length() for i in range(1 << 16)], dtype=np.uint8)


def crc16(columns: np.ndarray) -> np.ndarray:
    """CRC-16 of each column; leading zero bytes change nothing. Two bytes are taken at a time."""
    crc = np.zeros(columns.shape[1], np.uint16)
    if columns.shape[0] % 2:
        columns = np.concatenate([np.zeros((1, columns.shape[1]), np.uint8), columns])
    for high, low in zip(columns[::2], columns[1::2], strict=True):
        crc = CRC16_PAIRS[crc ^ (high.astype(np.uint16) << 8 | low)]
    return crc


def _right_aligned(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A column for each span of ``data``, with zeros above it."""
    most = int(length.max(initial=0))
    at = np.arange(most)[:, None] - (most - length)[None, :]
    return np.where(at >= 0, data[np.maximum(start + at, 0)], 0).astype(np.uint8)


def _coded_number(n: int) -> bytes:
    """A frame number in the format's extension of UTF-8."""
    if n < 128:
        return bytes([n])
    tail = []
    while True:
        tail.append(0x80 | n & 63)
        n >>= 6
        room = 6 - len(tail)
        if n < 1 << room:
            return bytes([(0xFF << (room + 1)) & 0xFF | n, *tail[::-1]])


def _residuals(x: np.ndarray, order: int) -> np.ndarray:
    return np.diff(x, n=order, axis=0) if order else x


def _guess(res: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A parameter for each column, from the mean of its residuals, and about the bits that it takes."""
    total = (2 * np.abs(res)).sum(0)
    k = np.clip(np.floor(np.log2(np.maximum(total / len(res) * np.log(2), 1))), 0, 7).astype(np.int64)
    return k, len(res) * (1 + k) + (total >> k)


def _rice(u: np.ndarray, guess: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best parameter of each column among the guess and its neighbours, and the bits that it takes."""
    tried = np.stack([np.clip(guess + d, 0, 7) for d in (-1, 0, 1)])
    bits = np.stack([(u >> k).sum(0) + (1 + k) * len(u) for k in tried])
    best = bits.argmin(0)
    return np.take_along_axis(tried, best[None], 0)[0], np.take_along_axis(bits, best[None], 0)[0]


def _linear(x: np.ndarray, order: int, precision: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantised predictors of each column, their shifts and the residuals."""
    n = x.shape[0]
    f = x.astype(np.float64)
    auto = np.stack([(f[: n - k] * f[k:]).sum(0) for k in range(order + 1)])
    lag = np.abs(np.subtract.outer(np.arange(order), np.arange(order)))
    matrix = auto[lag].transpose(2, 0, 1) + np.eye(order) * (1e-3 * auto[0] + 1.0)[:, None, None]
    coef = np.linalg.solve(matrix, auto[1:].T[..., None])[..., 0].T
    most = np.abs(coef).max(0)
    shift = np.clip(precision - 2 - np.ceil(np.log2(np.maximum(most, 1e-9))), 0, 14).astype(np.int64)
    bound = 1 << (precision - 1)
    whole = np.clip(np.rint(coef * (1 << shift)), -bound, bound - 1).astype(np.int64)
    pred = sum(whole[j] * x[order - 1 - j : n - 1 - j] for j in range(order)) >> shift
    return whole, shift, x[order:] - pred


def encode(payloads: list[bytes], lpc_order: int = 4, precision: int = 10) -> list[bytes]:
    """A FLAC stream for each payload, whose length is a positive multiple of 576; byte b is stored as sample b - 128.

    Each frame takes whichever of a constant, the fixed predictors of order 0 to 4 and a linear predictor is shortest.
    The seek table has a point for each frame.
    """
    counts = np.array([len(p) // BLOCK for p in payloads])
    number = np.concatenate([np.arange(c) for c in counts])
    x = np.ascontiguousarray(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK).T).astype(np.int32) - 128
    frames = x.shape[1]
    coef, shift, res = _linear(x, lpc_order, precision)
    tried = [*((_residuals(x, o), 8 * o) for o in range(5)), (res, (8 + precision) * lpc_order + 9)]
    guesses, guessed = zip(*((k, bits + extra) for r, extra in tried for k, bits in [_guess(r)]), strict=True)
    choice = np.stack(guessed).argmin(0)
    constant = (x == x[0]).all(0)
    choice[constant] = 6
    k, body = np.zeros(frames, np.int64), np.where(constant, 16, 0)
    folded = {}
    for c in range(6):
        f = np.flatnonzero(choice == c)
        r = tried[c][0][:, f]
        folded[c] = np.where(r < 0, -2 * r - 1, 2 * r)
        k[f], bits = _rice(folded[c], guesses[c][f])
        body[f] = 8 + bits + tried[c][1] + 10
    verbatim = body >= 8 + 8 * BLOCK
    body[verbatim] = 8 + 8 * BLOCK

    heads = [b"\xff\xf8\x24\x02" + _coded_number(int(i)) for i in range(int(number.max()) + 1)]
    head_len = np.array([len(h) for h in heads])[number]
    flat = np.frombuffer(b"".join(heads[i] for i in number), np.uint8)
    head_at = np.concatenate([[0], np.cumsum(head_len)])[:-1]
    head_crc = crc8(_right_aligned(flat, head_at, head_len))
    size = head_len + 1 + (body + 7) // 8 + 2
    start = np.concatenate([[0], np.cumsum(size)])
    bits = np.zeros(int(start[-1]) * 8, np.uint8)

    def put(at: np.ndarray, value: np.ndarray, width: int) -> None:
        for b in range(width):
            bits[at + b] = (value >> (width - 1 - b)) & 1

    at = (start[:-1] + head_len + 1) * 8
    kind = np.where(verbatim, 1, np.array([8, 9, 10, 11, 12, 32 + lpc_order - 1, 0])[choice])
    put(at, kind << 1, 8)
    at = at + 8
    for i in range(BLOCK if verbatim.any() else 0):
        put(at[verbatim] + 8 * i, x[i, verbatim] & 255, 8)
    for c in range(7):
        f = np.flatnonzero(choice == c)
        coded = ~verbatim[f]
        f = f[coded]
        if not f.size:
            continue
        here, own = at[f], x[:, f]
        if c == 6:
            put(here, own[0] & 255, 8)
            continue
        order = c if c < 5 else lpc_order
        for i in range(order):
            put(here + 8 * i, own[i] & 255, 8)
        here = here + 8 * order
        if c == 5:
            put(here, np.full(f.size, precision - 1), 4)
            put(here + 4, shift[f], 5)
            here = here + 9
            for j in range(order):
                put(here, coef[j, f] & ((1 << precision) - 1), precision)
                here = here + precision
        put(here + 6, k[f], 4)
        here = here + 10
        u = folded[c][:, coded]
        q = u >> k[f]
        width = q + 1 + k[f]
        ends = np.cumsum(width, axis=0) + here
        stop = ends - k[f] - 1
        bits[stop.ravel()] = 1
        for b in range(int(k[f].max(initial=0))):
            has = np.flatnonzero(((k[f] > b) & ((u >> b) & 1 == 1)).ravel())
            bits[ends.ravel()[has] - 1 - b] = 1
    data = np.packbits(bits)
    for i in range(int(head_len.max())):
        on = head_len > i
        data[(start[:-1] + i)[on]] = flat[(head_at + i)[on]]
    data[start[:-1] + head_len] = head_crc
    crc = crc16(_right_aligned(data, start[:-1], size - 2))
    data[start[1:] - 2], data[start[1:] - 1] = crc >> 8, crc & 255

    out, first = [], 0
    for p, n in zip(payloads, counts, strict=True):
        lo, hi = start[first], start[first + n]
        sizes = size[first : first + n]
        info = np.zeros(34, np.uint8)
        info[:4] = [BLOCK >> 8, BLOCK & 255] * 2
        for j, v in ((4, int(sizes.min())), (7, int(sizes.max()))):
            info[j : j + 3] = [v >> 16, v >> 8 & 255, v & 255]
        packed = (RATE << 44) | (0 << 41) | (7 << 36) | len(p)
        info[10:18] = np.frombuffer(packed.to_bytes(8, "big"), np.uint8)
        pcm = (np.frombuffer(p, np.uint8) ^ 128).tobytes()
        info[18:] = np.frombuffer(hashlib.md5(pcm).digest(), np.uint8)
        seek = np.zeros(n, [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
        seek["sample"], seek["offset"], seek["n"] = np.arange(n) * BLOCK, start[first : first + n] - lo, BLOCK
        out.append(b"fLaC\x00\x00\x00\x22" + info.tobytes() + _seek_blocks(seek) + data[lo:hi].tobytes())
        first += n
    return out


def _seek_blocks(seek: np.ndarray) -> bytes:
    """Metadata blocks of the seek points: a block's length has three bytes, so long streams go on in application blocks."""
    parts = [seek[i : i + SEEK_POINTS].tobytes() for i in range(0, len(seek), SEEK_POINTS)]
    parts[1:] = [MORE_POINTS + p for p in parts[1:]]
    kinds = [3] + [2] * (len(parts) - 1)
    kinds[-1] |= 128  # the last block of metadata
    return b"".join(bytes([k]) + len(p).to_bytes(3, "big") + p for k, p in zip(kinds, parts, strict=True))


def layout(stream: bytes) -> tuple[int, int, np.ndarray]:
    """Where the audio begins, the number of samples and the seek table's byte offsets.

    Raises ValueError where the stream is no FLAC or has no seek point for each frame.
    """
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, total, parts = 4, 0, []
    while True:
        kind, length = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + length]
        if kind & 127 == 0:
            total = int.from_bytes(block[10:18], "big") & ((1 << 36) - 1)
        if kind & 127 == 3:
            parts.append(block)
        if kind & 127 == 2 and block[:4] == MORE_POINTS:
            parts.append(block[4:])
        at += 4 + length
        if kind & 128:
            break
    points = np.frombuffer(b"".join(parts), [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
    if not parts or int(points["n"].sum()) != total:
        raise ValueError("the seek table does not cover the stream")
    return at, total, points["offset"].astype(np.int64)


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream: its samples plus 128. Raises ValueError on a bad checksum or frame."""
    parts, begin, end, frames_of, base = [], [], [], [], 0
    for s in streams:
        at, total, offsets = layout(s)
        audio = s[at:]
        begin.append(offsets + base)
        end.append(np.append(offsets[1:], len(audio)) + base)
        frames_of.append(len(offsets))
        base += len(audio)
        parts.append(audio)
    samples = decode_frames(np.frombuffer(b"".join(parts), np.uint8), np.concatenate(begin), np.concatenate(end))
    out, first = [], 0
    whole = np.ascontiguousarray(samples.T)
    for n in frames_of:
        out.append((whole[first : first + n].reshape(-1) + 128).astype(np.uint8).tobytes())
        first += n
    return out


def blocks_at(streams: list[bytes], samples: list[int]) -> list[tuple[int, bytes]]:
    """Of each stream the block that holds a sample, found by the seek table and decoded alone: its first sample and its bytes."""
    frames = []
    for s, sample in zip(streams, samples, strict=True):
        at, _, offsets = layout(s)
        i = sample // BLOCK
        frames.append(s[at + int(offsets[i]) : at + int(offsets[i + 1]) if i + 1 < len(offsets) else len(s)])
    end = np.cumsum([len(f) for f in frames])
    whole = np.ascontiguousarray(decode_frames(np.frombuffer(b"".join(frames), np.uint8), end - [len(f) for f in frames], end).T)
    return [(sample // BLOCK * BLOCK, (x + 128).astype(np.uint8).tobytes()) for sample, x in zip(samples, whole, strict=True)]


def decode_frames(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Samples of the frames at ``begin`` to ``end`` of ``data``, a column for each frame."""
    if not begin.size:
        return np.zeros((BLOCK, 0), np.int32)
    if crc16(_right_aligned(data, begin, end - begin)).any():
        raise ValueError("a frame's checksum is wrong")
    if (data[begin] != 0xFF).any() or (data[begin + 1] != 0xF8).any() or (data[begin + 2] >> 4 != 2).any() or (data[begin + 3] != 2).any():
        raise ValueError("not a frame of 576 samples of 8-bit mono")
    lead = data[begin + 4]
    extra = np.where(lead < 0x80, 0, np.where(lead < 0xE0, 1, np.where(lead < 0xF0, 2, np.where(lead < 0xF8, 3, np.where(lead < 0xFC, 4, 5)))))
    if crc8(_right_aligned(data, begin, 6 + extra)).any():
        raise ValueError("a frame header's checksum is wrong")
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    word = np.zeros(data.size + 8, np.uint64)  # the eight bytes from each byte on
    for b in range(8):
        word = (word << np.uint64(8)) | padded[b : b + data.size + 8]

    def window(at: np.ndarray) -> np.ndarray:
        """57 bits or more from bit ``at``, at the top of a word."""
        return word[at >> 3] << (at & 7).astype(np.uint64)

    def take(at: np.ndarray, width) -> np.ndarray:
        """``width`` bits (25 at most) from bit ``at``."""
        width = np.asarray(width, np.uint64)
        return ((window(at) >> np.uint64(1)) >> (np.uint64(63) - width)).astype(np.int64)

    ones: list[np.ndarray] = []

    def next_one(at: np.ndarray) -> np.ndarray:
        if not ones:
            ones.append(np.append(np.flatnonzero(np.unpackbits(data)), data.size * 8))
        return ones[0][np.searchsorted(ones[0], at)]

    def signed(v: np.ndarray, width) -> np.ndarray:
        return v - ((v >> (width - 1) & 1) << width)

    n = begin.size
    at = (begin + 6 + extra) * 8
    kind = take(at, 7)
    at = at + 8
    out = np.zeros((BLOCK, n), np.int32)
    order = np.where((kind >= 8) & (kind <= 12), kind - 8, np.where(kind >= 32, kind - 31, 0))
    if ((kind > 1) & (kind < 8) | (kind > 12) & (kind < 32)).any():
        raise ValueError("a reserved kind of subframe")
    f = np.flatnonzero(kind == 0)
    out[:, f] = signed(take(at[f], 8), 8)
    f = np.flatnonzero(kind == 1)
    for i in range(BLOCK if f.size else 0):
        out[i, f] = signed(take(at[f] + 8 * i, 8), 8)
    f = np.flatnonzero(kind >= 8)
    if not f.size:
        return out
    pos, o = at[f], order[f]
    most = int(o.max())
    x = np.zeros((BLOCK, f.size), np.int64)
    for i in range(most):
        on = o > i
        x[i, on] = signed(take(pos[on] + 8 * i, 8), 8)
    pos = pos + 8 * o
    linear = kind[f] >= 32
    coef = np.zeros((max(most, 1), f.size), np.int64)
    shift = np.zeros(f.size, np.int64)
    for c, own in enumerate(([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])):
        on = ~linear & (o == c)
        for j, v in enumerate(own if on.any() else []):
            coef[j, on] = v
    if linear.any():
        width = np.where(linear, take(pos, 4) + 1, 0)
        shift = np.where(linear, signed(take(pos + 4, 5), 5), 0)
        pos = pos + 9 * linear
        for j in range(most):
            on = linear & (o > j)
            coef[j, on] = signed(take(pos[on], width[on]), width[on])
            pos = pos + np.where(on, width, 0)
    method, parts = take(pos, 2), take(pos + 2, 4)
    pos = pos + 6
    if (method > 1).any() or (BLOCK % (1 << parts)).any():
        raise ValueError("a reserved way of coding residuals")
    span = BLOCK >> parts
    wide = 4 + method
    boundary, k, raw = o.copy(), np.zeros(f.size, np.int64), np.full(f.size, -1)
    following = span.copy()
    res = np.zeros((BLOCK, f.size), np.int64)
    first = int(o.min())
    for i in range(first, BLOCK):
        due = boundary == i
        if due.any():
            k = np.where(due, take(pos, wide), k)
            pos = pos + np.where(due, wide, 0)
            escape = due & (k == (1 << wide) - 1)
            raw = np.where(due, np.where(escape, take(pos, 5), -1), raw)
            pos = pos + np.where(escape, 5, 0)
            boundary = np.where(due, following, boundary)
            following = np.where(due, following + span, following)
        w = window(pos)
        q = LEADING[w >> np.uint64(48)].astype(np.int64)
        far = q == 16
        if far.any():
            q[far] = next_one(pos[far]) - pos[far]
            low = take(pos + q + 1, k)
        else:
            low = ((w << (q + 1).astype(np.uint64) >> np.uint64(1)) >> (63 - k).astype(np.uint64)).astype(np.int64)
        u = (q << k) | low
        value, nxt = (u >> 1) ^ -(u & 1), pos + q + 1 + k
        if i < most or (raw >= 0).any():
            live, plain = o <= i, raw < 0
            value = np.where(live, np.where(plain, value, np.where(raw > 0, signed(take(pos, np.maximum(raw, 0)), np.maximum(raw, 1)), 0)), 0)
            nxt = np.where(live, np.where(plain, nxt, pos + raw), pos)
        res[i], pos = value, np.minimum(nxt, data.size * 8 - 1)
    for i in range(BLOCK):
        on = slice(None) if i >= most else np.flatnonzero(o <= i)
        pred = 0
        for j in range(min(most, i)):
            pred = pred + coef[j, on] * x[i - 1 - j, on]
        x[i, on] = (pred >> shift[on] if most and i else 0) + res[i, on]
    out[:, f] = x
    if (out < -128).any() or (out > 127).any():
        raise ValueError("a sample outside 8 bits")
    return out
