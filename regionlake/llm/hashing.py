"""Vector kernels over flat bytes: words, hashes of words, grams and spans, window minima.

Hashes are built from multiplications, shifts and exclusive ors that do not commute with concatenation, so
that texts of a regular structure (repeated, mirrored or complemented strings) have no reason to collide.
A gram's hash is folded from the hashes of its halves, so all grams of a text cost a few vector operations
for each doubling. Work goes in runs of CHUNK positions: temporary arrays stay in the processor's cache
and memory does not depend on a text's length.
"""

from __future__ import annotations

import numpy as np
import xxhash

CHUNK = 1 << 17
U = np.uint64

#: [\x20\x09-\x0D]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def mixed(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], np.uint64))[0])


def fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the pair; fold(a, b) is not fold(b, a)."""
    x = a * U(0x9E3779B97F4A7C15) + b
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number; behind the end stand zeros."""
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", raw.data, strides=(1,))


def word_spans(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in data, and each row's bounds among the words."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~sep[data]
    edge = offs[(offs > 0) & (offs < n)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


#: Longer words are hashed one by one.
_LONG = 32
#: Of eight bytes, the first n.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: eight bytes after eight go through a bijection."""
    size = ends - starts
    out = mix(size.astype(np.uint64) + U(0xD1342543DE82EF95))
    if not len(starts):
        return out
    for a in range(0, len(starts), CHUNK):
        s, n, h = starts[a : a + CHUNK], size[a : a + CHUNK], out[a : a + CHUNK]
        base = int(s[0])
        short = n <= _LONG
        stop = int((s + np.minimum(n, _LONG)).max())
        x = eights(data[base:stop])
        live = np.flatnonzero(short)
        d = 0
        while len(live):
            h[live] = mix((h[live] ^ (x[s[live] - base + d] & _FIRST[np.minimum(n[live] - d, 8)])) + U(0x632BE59BD9B4E019))
            d += 8
            live = live[n[live] > d]
        for i in np.flatnonzero(~short):
            h[i] = xxhash.xxh3_64_intdigest(data[s[i] : s[i] + n[i]].tobytes())
    return out


def grams_of(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive values (bytes or 64-bit numbers)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if values.dtype == np.uint8 and k >= 8:
        level, size = mix(eights(values)[: len(values) - 7] + U(1)), 8
        rest, k = (k % 8, k // 8 * 8)
    else:
        level, size, rest = mix(values.astype(np.uint64) + U(1)), 1, 0
    out, done, whole = None, 0, k
    while True:
        if whole & size:
            out = level if out is None else fold(out[: len(level) - done], level[done : done + len(out)])
            done += size
        if size * 2 > whole:
            break
        level = fold(level[:-size], level[size:])
        size *= 2
    if rest:  # the last eight bytes overlap what is done
        tail = mix(eights(values)[: len(values) - 7] + U(1))[k + rest - 8 :]
        out = fold(out[:n], tail[:n])
    return mix(out[:n])


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """grams_of in bounded pieces."""
    n = len(values) - k + 1
    out = np.empty(max(0, n), np.uint64)
    for a in range(0, n, CHUNK):
        out[a : min(n, a + CHUNK)] = grams_of(values[a : min(n, a + CHUNK) + k - 1], k)
    return out


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two 64-bit halves of a 128-bit hash of each span of values."""
    raw = memoryview(np.ascontiguousarray(values)).cast("B")
    size, digest = values.itemsize, xxhash.xxh3_128_digest
    spans = zip((starts * size).tolist(), (ends * size).tolist(), strict=True)
    return np.frombuffer(b"".join([digest(raw[a:b]) for a, b in spans]), np.uint64).reshape(-1, 2)


def sliding(least: np.ufunc, g: np.ndarray, w: int) -> np.ndarray:
    """np.minimum or np.maximum of every w consecutive values."""
    size = 1
    while size * 2 <= w:
        g = least(g[:-size], g[size:])
        size *= 2
    if size < w:
        g = least(g[: len(g) - (w - size)], g[w - size :])
    return g


def territories(values: np.ndarray, offs: np.ndarray, window: int, gram: int, periodic: bool = False) -> tuple[np.ndarray, ...]:
    """Splits the starts of all windows into runs that share the least hash of a gram inside.

    Equal windows have the same least hash, wherever they stand, so it suffices to compare windows
    whose runs have the same key. Returns key, content hash (two halves), first start and number of starts
    of each run, in order, and with periodic, whether the run may hold equal windows itself (its least
    gram occurs twice). A run's content is its starts and the window - 1 values that follow.
    """
    keys, contents, firsts, counts, inners = [], [], [], [], []
    total = len(values)
    w = window - gram + 1
    for a in range(0, max(0, total - window + 1), CHUNK):
        b = min(total - window + 1, a + CHUNK)
        x = values[a : b + window - 1]
        g = grams_of(x, gram)
        m = sliding(np.minimum, g, w)
        i, j = np.searchsorted(offs, a, "right") - 1, np.searchsorted(offs, b, "left")
        lo = np.clip(offs[i:j] - a, 0, b - a)
        hi = np.maximum(lo, np.clip(offs[i + 1 : j + 1] - window + 1 - a, 0, b - a))
        step = np.zeros(b - a + 1, np.int32)
        np.add.at(step, lo, 1)
        np.add.at(step, hi, -1)
        valid = np.cumsum(step[:-1]) > 0
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (m[1:] != m[:-1])
        new[lo[hi > lo]] = True  # a text's first window does not continue the text before
        s = np.flatnonzero(new)
        end = np.append(s[1:], b - a)
        e = np.minimum(end, hi[np.searchsorted(lo, s, "right") - 1])
        keys.append(m[s])
        contents.append(span_hashes(x, s, e + window - 1))
        firsts.append(s + a)
        counts.append(e - s)
        if periodic:
            # grams that are least in a window; those of one run with the same hash are next to each other
            pad = np.zeros(w - 1, np.uint64)
            least = np.flatnonzero(g == sliding(np.maximum, np.concatenate([pad, m, pad]), w))
            twice = np.concatenate([[0], np.cumsum(g[least][1:] == g[least][:-1])])
            lo, hi = np.searchsorted(least, s), np.searchsorted(least, e - 1 + w) - 1
            inners.append(twice[np.minimum(np.maximum(hi, lo), len(twice) - 1)] > twice[np.minimum(lo, len(twice) - 1)])
        else:
            inners.append(np.zeros(len(s), bool))
    if not keys:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), np.zeros((0, 2), np.uint64), z, z, z.astype(bool)
    return tuple(np.concatenate(x) for x in (keys, contents, firsts, counts, inners))


def spark_hash(*values: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 gives for long columns."""
    p1, p2, p3, p4, p5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(x: np.ndarray, n: int) -> np.ndarray:
        return x << U(n) | x >> U(64 - n)

    h = np.full(len(values[0]), 42, np.uint64)
    for v in values:
        h = h + p5 + U(8)
        h ^= turn(v.view(np.uint64) * p2, 31) * p1
        h = turn(h, 27) * p1 + p4
        h ^= h >> U(33)
        h *= p2
        h ^= h >> U(29)
        h *= p3
        h ^= h >> U(32)
    return h.view(np.int64)


def spark_hash_int(values: np.ndarray) -> np.ndarray:
    """What Spark's hash gives for an int column."""
    k = values.astype(np.uint32) * np.uint32(0xCC9E2D51)
    k = (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)
    h = np.uint32(42) ^ k
    h = (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h.view(np.int32).astype(np.int64)
