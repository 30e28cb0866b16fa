"""Removal of repeated word sequences by prefix-partitioned suffix trees.

The suffixes of a block are split by prefixes of variable length: one word, and where a prefix has too
many suffixes for memory, one word more, as far as needed. The prefixes are packed into groups of bounded
size and each group's subtree is built top down, level by level: a node is a range of suffixes with a
common prefix, and it branches where the next words differ. Inner nodes at least a window deep are the
repeats; all their leaves share the node's words.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats

#: Suffixes in one subtree.
GROUP = 1 << 20


@dataclass
class Subtree:
    """Leaves in order, and the inner nodes: their leaves' bounds and the depth of their common prefix."""

    leaves: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    depth: np.ndarray


def prefix_groups(values: np.ndarray, starts: np.ndarray, window: int, most: int = GROUP) -> list[np.ndarray]:
    """The starts by variable-length prefixes, packed to at most most a group; a longer prefix than
    window does not matter, so that suffixes which agree that far stay together."""
    work, small, out = [(starts, 0)], [], []
    while work:
        own, depth = work.pop()
        if len(own) <= most or depth == window:
            small.append(own)
            continue
        key = values[own + depth]
        o = np.argsort(key, kind="stable")
        cut = np.flatnonzero(key[o][1:] != key[o][:-1]) + 1
        pieces = np.split(own[o], cut)
        tiny: list[np.ndarray] = []
        held = 0
        for p in pieces:
            if len(p) > most:
                work.append((p, depth + 1))
            else:
                if tiny and held + len(p) > most:
                    small.append(np.concatenate(tiny))
                    tiny, held = [], 0
                tiny.append(p)
                held += len(p)
        if tiny:
            small.append(np.concatenate(tiny))
    held_n, held_list = 0, []
    for own in small:
        if held_list and held_n + len(own) > most:
            out.append(np.concatenate(held_list))
            held_list, held_n = [], 0
        held_list.append(own)
        held_n += len(own)
    if held_list:
        out.append(np.concatenate(held_list))
    return out


def build(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int) -> Subtree:
    """The subtree of the suffixes at starts, to depth words; ends: where each suffix's text ends.

    Nodes of one child are not kept: a node is written when its range splits, or at the full depth.
    """
    leaves, stop = np.sort(starts), ends[np.argsort(starts, kind="stable")]
    group = np.zeros(len(leaves), np.int64)
    lo, hi, deep = [], [], []
    live = np.arange(len(leaves))  # leaves in ranges of more than one
    for d in range(depth):
        if not len(live):
            break
        p, g, s = leaves[live], group[live], stop[live]
        ended = p + d >= s
        key = np.where(ended, np.uint64(0), values[np.minimum(p + d, len(values) - 1)])
        o = np.lexsort((p, key, ended, g))
        leaves[live], stop[live] = p[o], s[o]
        key, ended = key[o], ended[o]
        same = g[1:] == g[:-1]
        branch = same & ((key[1:] != key[:-1]) | (ended[1:] != ended[:-1]) | ended[1:])
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        size = np.diff(np.concatenate([first, [len(live)]]))
        split = np.add.reduceat(np.concatenate([[False], branch]).astype(np.int64), first) > 0
        lo.append(live[first[split]])
        hi.append(live[first[split]] + size[split])
        deep.append(np.full(int(split.sum()), d))
        step = np.zeros(len(leaves), np.int64)
        step[live[1:][branch]] = 1
        group = group + np.cumsum(step)
        live = live[np.bincount(group, minlength=group[-1] + 1)[group[live]] > 1]
    if len(live):
        first = np.flatnonzero(np.concatenate([[True], group[live][1:] != group[live][:-1]]))
        size = np.diff(np.concatenate([first, [len(live)]]))
        lo.append(live[first])
        hi.append(live[first] + size)
        deep.append(np.full(len(first), depth))
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lo, hi, deep)]
    return Subtree(leaves, *joined)


def repeated(block: repeats.Block, kind: repeats.Kind) -> np.ndarray:
    """Starts of windows that also start in an earlier document of the block."""
    values = block.values
    found = np.zeros(len(values), bool)
    starts = np.repeat(block.offs[:-1] - np.cumsum(block.count) + block.count, block.count) + np.arange(block.count.sum())
    for own in prefix_groups(values, starts, kind.window):
        run = np.searchsorted(block.offs, own, "right") - 1
        tree = build(values, own, block.offs[run + 1], kind.window)
        deep = tree.depth >= kind.window
        for_leaf = np.repeat(np.arange(deep.sum()), (tree.hi - tree.lo)[deep])
        leaf = np.concatenate([tree.leaves[a:b] for a, b in zip(tree.lo[deep], tree.hi[deep], strict=True)]) if deep.any() else np.zeros(0, np.int64)
        doc = block.doc[np.searchsorted(block.offs, leaf, "right") - 1]
        least = np.full(int(deep.sum()), np.iinfo(np.int64).max)
        np.minimum.at(least, for_leaf, doc)
        found[leaf[doc > least[for_leaf]]] = True
    return found


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def kept_words(text: bytes, first: np.ndarray, count: np.ndarray) -> tuple[int, int, bytes]:
    """Words, removed words, and the kept words joined by one space."""
    words = text.split()  # of bytes: at [\x20\x09-\x0D]
    if not len(first):
        return len(words), 0, b" ".join(words)
    gone = repeats.covered(len(words), first, count, repeats.WORDS.window)
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


DDL = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """Each document without the words of 13-word windows that also start in a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_sha256 and kept, the kept words joined by one space (null if
    digest). Null, empty and blank texts have no words. A text of any length is processed whole; equal
    windows in one document do not count. Equal rows are one document and each get its result; of rows
    that share only their doc_id none is smaller. A null doc_id is smaller than any other and stays null.
    Words are compared by 64-bit hashes.
    """

    def row(text: bytes, first: np.ndarray, count: np.ndarray) -> tuple:
        n, removed, kept = kept_words(text, first, count)
        return n, removed, hashlib.sha256(kept).hexdigest(), None if digest else kept.decode("utf-8", "replace")

    return repeats.find(docs, repeats.WORDS, repeated, row, SCHEMA, DDL)


def clean(docs: DataFrame) -> DataFrame:
    """docs with every text replaced by its kept words; documents of which none is left go.

    A text without repeats is left as it is. n_chars, where there is one, follows the text.
    """

    def row(text: bytes, first: np.ndarray, count: np.ndarray) -> tuple:
        if not len(first):
            return 1, 0, None, None
        n, removed, kept = kept_words(text, first, count)
        return n, removed, None, kept.decode("utf-8", "replace")

    found = repeats.find(docs, repeats.WORDS, repeated, row, SCHEMA, DDL, carry=True).where(F.col("n_removed") < F.col("n_words"))
    changed = F.col("n_removed") > 0
    out = {c: F.col("rest").getField(c) for c in docs.columns if c != "text"}
    out["text"] = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    if "n_chars" in out:
        out["n_chars"] = F.when(changed, F.length("kept")).otherwise(out["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return found.select(*[out[c].alias(c) for c in docs.columns])


def op7(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, digest=True).drop("kept")




ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM n) WHERE m < doc_id),
b AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 13 THEN 0 ELSE 1 END AS brk FROM f),
sp AS (SELECT doc_id, min(i) AS lo, max(i) + 13 AS hi
       FROM (SELECT doc_id, i, sum(brk) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM b) GROUP BY doc_id, g),
pv AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 1) AS prev FROM sp),
k AS (SELECT doc_id, sum(hi - lo) AS n_removed, max(hi) AS last, flatten(list(w[prev:lo - 1] ORDER BY lo)) AS kept
      FROM pv JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN n_removed IS NULL THEN w ELSE list_concat(kept, w[last:]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
