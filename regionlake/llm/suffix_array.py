"""Exact removal of repeated byte strings by a blockwise suffix array with a difference cover.

The suffixes of a block are sorted one bucket of leading bytes at a time, so that only one bucket's order
is held. A bucket is sorted by eight bytes after eight up to the cover's period; suffixes that still tie
are ordered by the ranks of two cover suffixes that lie equally far behind both, which are computed once.
Equal windows then are neighbours.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats

#: Suffixes sorted together.
BUCKET = 1 << 19
#: Period of the difference cover: a multiple of 8, a square.
PERIOD = 64


def difference_cover(v: int) -> np.ndarray:
    """Residues such that every difference modulo v occurs between two of them."""
    r = int(np.sqrt(v))
    return np.array(sorted({*range(r), *range(r, v, r)}), np.int64)


def cover_shifts(v: int, cover: np.ndarray) -> np.ndarray:
    """shift[i, j]: the least d with both i + d and j + d in the cover, modulo v."""
    inside = np.zeros(v, bool)
    inside[cover] = True
    d = np.arange(v)
    out = np.empty((v, v), np.int64)
    for i in range(v):
        both = inside[(i + d)[None, :] % v] & inside[(d[:, None] + d[None, :]) % v]
        out[i] = both.argmax(1)
    return out


class Text:
    """Bytes with zeros behind, readable as eight at a time from any place."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        self.raw = np.concatenate([data, np.zeros(512, np.uint8)])
        self.words = np.ndarray((len(self.raw) - 8,), ">u8", self.raw.data, strides=(1,))

    def at(self, p: np.ndarray) -> np.ndarray:
        return self.words[np.minimum(p, len(self.words) - 1)].astype(np.uint64)


def refine(text: Text, pos: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """pos sorted by depth bytes, and the group of each: equal up to depth."""
    key = text.at(pos)
    o = np.argsort(key, kind="stable")
    pos, key = pos[o], key[o]
    group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)])) if len(pos) else np.zeros(0, np.int64)
    for d in range(8, depth, 8):
        many = np.bincount(group)[group] > 1
        own = np.flatnonzero(many)
        if not len(own):
            break
        p, g = pos[own], group[own]
        key = text.at(p + d)
        o = np.lexsort((key, g))
        pos[own], key = p[o], key[o]
        split = np.zeros(len(pos), bool)
        split[own[1:]] = (g[1:] == g[:-1]) & (key[1:] != key[:-1])
        group = group + np.cumsum(split)
    return pos, group


class CoverRanks:
    """Ranks of the cover's suffixes by prefix doubling, to the depth of the longest run."""

    def __init__(self, text: Text, depth: int):
        self.cover = difference_cover(PERIOD)
        self.shift = cover_shifts(PERIOD, self.cover)
        inside = np.zeros(PERIOD, bool)
        inside[self.cover] = True
        self.slot = np.full(PERIOD, -1, np.int64)
        self.slot[self.cover] = np.arange(len(self.cover))
        whole = -(-(text.n + PERIOD) // PERIOD) * PERIOD
        pos = (np.arange(0, whole, PERIOD)[:, None] + self.cover[None, :]).ravel()
        self.rank = np.zeros(len(pos) + 4 * len(self.cover), np.int64)
        live = pos[pos < text.n]
        order, group = refine(text, live, PERIOD)
        self.rank[self.index(order)] = group + 1
        h = PERIOD
        while h < depth and group[-1:].sum() + 1 < len(order):
            here, ahead = self.rank[self.index(order)], self.rank[np.minimum(self.index(order + h), len(self.rank) - 1)]
            o = np.lexsort((ahead, here))
            order, here, ahead = order[o], here[o], ahead[o]
            group = np.cumsum(np.concatenate([[0], ((here[1:] != here[:-1]) | (ahead[1:] != ahead[:-1])).astype(np.int64)]))
            self.rank[self.index(order)] = group + 1
            h *= 2

    def index(self, p: np.ndarray) -> np.ndarray:
        return p // PERIOD * len(self.cover) + self.slot[p % PERIOD]

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for suffixes that agree in PERIOD bytes."""
        d = self.shift[a % PERIOD, b % PERIOD]
        last = len(self.rank) - 1
        x = self.rank[np.minimum(self.index(a + d), last)]
        y = self.rank[np.minimum(self.index(b + d), last)]
        return np.sign(x - y)


def order_ties(ranks: CoverRanks, pos: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three-way quicksort of all tied groups at once: each round compares every suffix with its group's
    middle one. Returns the order and the final groups."""
    pos, group = pos.copy(), group.copy()
    live = np.bincount(group)[group] > 1
    while live.any():
        own = np.flatnonzero(live)
        p, g = pos[own], group[own]
        first = np.concatenate([[True], g[1:] != g[:-1]])
        begin = np.flatnonzero(first)
        size = np.diff(np.concatenate([begin, [len(g)]]))
        side = ranks.compare(p, np.repeat(p[begin + size // 2], size))
        o = np.lexsort((side, np.repeat(np.arange(len(begin)), size)))
        pos[own], side = p[o], side[o]
        split = np.zeros(len(pos), bool)
        split[own[1:]] = ~first[1:] & (side[1:] != side[:-1])
        group = group + np.cumsum(split)
        live[own] = side != 0
        live &= np.bincount(group)[group] > 1
    return pos, group


def buckets(text: Text, starts: np.ndarray, most: int = BUCKET) -> list[np.ndarray]:
    """The starts by ranges of two leading bytes; a range passes most only if two bytes do not tell more."""
    two = text.raw[starts].astype(np.int64) << 8 | text.raw[starts + 1]
    size = np.bincount(two, minlength=1 << 16)
    bucket, held, of = 0, 0, np.zeros(1 << 16, np.int64)
    for k in np.flatnonzero(size):
        if held and held + size[k] > most:
            bucket, held = bucket + 1, 0
        of[k] = bucket
        held += size[k]
    own = of[two]
    return [starts[own == b] for b in range(bucket + 1)]


def same_window(text: Text, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    out = np.ones(len(a), bool)
    for d in [*range(0, window - 7, 8), window - 8]:
        own = np.flatnonzero(out)
        out[own] = text.at(a[own] + d) == text.at(b[own] + d)
    return out


def repeated(block: repeats.Block, kind: repeats.Kind) -> np.ndarray:
    """Starts of windows that also start earlier in the block; the block is in document order."""
    text = Text(np.ascontiguousarray(block.values))
    found = np.zeros(text.n, bool)
    if not text.n:
        return found
    starts = np.repeat(block.offs[:-1] - np.cumsum(block.count) + block.count, block.count) + np.arange(block.count.sum())
    ranks = None
    for own in buckets(text, starts):
        pos, group = refine(text, own, PERIOD)
        tied = np.bincount(group)[group] > 1
        if not tied.any():
            continue
        if ranks is None:
            ranks = CoverRanks(text, int(np.diff(block.offs).max()) + PERIOD)
        pos, group = pos[tied], group[tied]
        pos, _ = order_ties(ranks, pos, np.unique(group, return_inverse=True)[1])
        begin = np.concatenate([[0], np.flatnonzero(~same_window(text, pos[1:], pos[:-1], kind.window)) + 1])
        least = np.minimum.reduceat(pos, begin)
        found[pos[pos != np.repeat(least, np.diff(np.concatenate([begin, [len(pos)]])))]] = True
    return found


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def kept_bytes(text: bytes, first: np.ndarray, count: np.ndarray) -> tuple[int, int, bytes]:
    """Removed bytes, removed runs, and what remains."""
    if not len(first):
        return 0, 0, text
    gone = repeats.covered(len(text), first, count, repeats.BYTES.window)
    runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
    return int(gone.sum()), runs, np.frombuffer(text, np.uint8)[~gone].tobytes()


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """Each document without the bytes of 100-byte strings that also start earlier.

    Earlier: in a smaller doc_id, or in the same document before. Returns doc_id, n_bytes, n_removed,
    n_spans, kept_sha256 and the kept bytes as binary (a cut may fall inside a character; null if digest).
    Null and empty texts have no bytes. A text of any length is processed whole. Equal rows (same doc_id
    and text) are one document and each get its result; rows that share only their doc_id are ordered
    by a hash of their texts. A null doc_id is smaller than any other and stays null.
    """

    def row(text: bytes, first: np.ndarray, count: np.ndarray) -> tuple:
        removed, runs, kept = kept_bytes(text, first, count)
        return len(text), removed, runs, hashlib.sha256(kept).hexdigest(), None if digest else kept

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return repeats.find(docs, repeats.BYTES, repeated, row, SCHEMA, ddl)


def op5(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, digest=True).drop("kept")


ORACLE = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substr(x, CAST(2 * i + 1 AS BIGINT), 200) AS s
      FROM (SELECT doc_id, x, unnest(range(0, CAST(length(x) / 2 AS BIGINT) - 99)) AS i FROM h)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
b AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS brk FROM f),
sp AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi
       FROM (SELECT doc_id, i, sum(brk) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM b) GROUP BY doc_id, g),
pv AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS prev FROM sp),
k AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS last,
             string_agg(substr(x, CAST(2 * prev + 1 AS BIGINT), CAST(2 * (lo - prev) AS BIGINT)), '' ORDER BY lo) AS kept
      FROM pv JOIN h USING (doc_id) GROUP BY doc_id)
SELECT h.doc_id, CAST(length(x) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE kept || substr(x, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM h LEFT JOIN k USING (doc_id)
"""
