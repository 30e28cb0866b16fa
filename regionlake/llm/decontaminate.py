"""Benchmark decontamination: one Aho-Corasick automaton over the normalised items.

A text is normalised by bytes (A-Z lowered, whatever is no word is a separator) and scanned once, every word
as LETTERS letters of an alphabet of 32, which are bits of its hash. Were every window of ten words a pattern of its own, the automaton would be many
times the benchmark. Its patterns are anchors instead: runs of ANCHOR words at every so many words of an
item, so that each window holds one of them whole. Around an anchor's occurrence the windows that may hold
it are looked up among the benchmark's windows by hash, and then compared byte by byte. Items of fewer
words than a window are patterns themselves. Occurrences are mapped to words and code points of the
original text.

A benchmark of more than SHARD_BYTES is cut into shards. Each has an automaton of its own and is scanned
for by a job of its own, so that a worker holds one at a time; what they find is joined by document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashing

#: Word characters are [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z is lowered.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_NORMAL = np.frombuffer(NORMAL, np.uint8)
_SEPARATOR = np.arange(256) == 32
#: Normalised bytes of the items that one automaton is over.
SHARD_BYTES = 32 << 20
#: Words of an anchor; letters of a word.
ANCHOR, LETTERS = 3, 4
#: Words scanned at a time, and windows whose items are remembered.
PIECE, REMEMBERED = 1 << 16, 1 << 16

SCHEMA = "doc_id long, n_words long, n_hit long, item_ids array<long>, spans array<struct<begin:long,end:long>>"
_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.int64())), ("spans", _SPANS)])


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Automaton:
    """Items as one normalised text, their windows by hash, and the automaton over their anchors."""

    def __init__(self, items: list[tuple[int, bytes]], n: int):
        """items: id and words joined by one space, at least one word."""
        self.n = n
        self.ids = np.array([i for i, _ in items], np.int64)
        self.text = b"\n".join(t for _, t in items)
        data = np.frombuffer(self.text, np.uint8)
        size = np.array([len(t) for _, t in items], np.int64)
        offs = np.concatenate([[0], np.cumsum(size + 1)])
        offs[-1:] = len(data)
        self.starts, self.ends, self.bounds = hashing.word_spans(data, offs, (np.arange(256) == 32) | (np.arange(256) == 10))
        self.starts, self.ends = self.starts.astype(np.uint32), self.ends.astype(np.uint32)
        words = np.concatenate([hashing.word_hashes(data, self.starts[a : a + PIECE].astype(np.int64), self.ends[a : a + PIECE].astype(np.int64)) for a in range(0, len(self.starts), PIECE)] or [np.zeros(0, np.uint64)])
        many = np.diff(self.bounds)
        begin, stop = self.bounds[:-1], self.bounds[1:]
        last = np.repeat(np.maximum(stop - n, begin - 1), many)  # of each word's item: the last window's start
        where = np.flatnonzero(np.arange(len(words)) <= last)
        where = where[np.repeat(many >= n, many)[where]]
        hashes = hashing.gram_hashes(words, n)[where] if len(where) else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.window, self.at = hashes[order], where[order].astype(np.uint32)
        # patterns
        letters = spelled(words)
        size = min(ANCHOR, n)
        step = n - size + 1
        self.longest = size
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        # value: 1 for an anchor, and twice one more than the place in kinds of short items of these letters
        short: dict[str, dict[bytes, list[int]]] = {}
        for i in np.flatnonzero(many < n):
            key = letters[LETTERS * begin[i] : LETTERS * stop[i]]
            self.longest = max(self.longest, int(many[i]))
            short.setdefault(key, {}).setdefault(items[i][1], []).append(int(self.ids[i]))
        self.kinds = list(short.values())
        for k, key in enumerate(short):
            self.automaton.add_word(key, 2 * (k + 1))
        offset = np.arange(len(words)) - np.repeat(begin, many)
        for a in np.flatnonzero((offset % step == 0) & (np.arange(len(words)) + size <= np.repeat(stop, many)) & np.repeat(many >= n, many)).tolist():
            key = letters[LETTERS * a : LETTERS * (a + size)]
            self.automaton.add_word(key, 1 | (self.automaton.get(key, 0) if key in short else 0))
        self.automaton.make_automaton()
        self.remembered: dict[int, list[tuple[bytes, list[int]]]] = {}

    def items_of(self, lo: int) -> list[tuple[bytes, list[int]]]:
        """The windows that share the hash at lo, with their items: nearly always one."""
        found = self.remembered.get(lo)
        if found is None:
            hi = int(np.searchsorted(self.window, self.window[lo], "right"))
            by: dict[bytes, set[int]] = {}
            for p in self.at[lo:hi].astype(np.int64).tolist():
                own = self.text[int(self.starts[p]) : int(self.ends[p + self.n - 1])]
                by.setdefault(own, set()).add(int(self.ids[int(np.searchsorted(self.bounds, p, "right")) - 1]))
            found = [(t, sorted(i)) for t, i in by.items()]
            if len(self.remembered) >= REMEMBERED:
                self.remembered.clear()
            self.remembered[lo] = found
        return found

    def scan(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, set[int]]]:
        """Of normalised texts: starts and ends of words, bounds of texts, words hit, and each text's items."""
        starts, ends, bounds = hashing.word_spans(data, offs, _SEPARATOR)
        hit = np.zeros(len(starts) + 1, np.int32)
        items: dict[int, set[int]] = {}
        if not len(starts) or not len(self.automaton):
            return starts, ends, bounds, hit[:-1] > 0, items
        words = hashing.word_hashes(data, starts, ends)
        letters = spelled(words)
        anchors: list[int] = []
        raw = data.tobytes()

        def mark(s: int, size: int, kinds) -> None:
            text = b" ".join([raw[a:b] for a, b in zip(starts[s : s + size].tolist(), ends[s : s + size].tolist(), strict=True)])
            for own, found in kinds:
                if own == text:
                    hit[s] += 1
                    hit[s + size] -= 1
                    items.setdefault(int(np.searchsorted(bounds, s, "right")) - 1, set()).update(found)

        seen_short: set[tuple[int, int]] = set()
        for a in range(0, len(words), PIECE):
            for e, value in self.automaton.iter(letters[LETTERS * a : LETTERS * (a + PIECE + self.longest - 1)]):
                if e % LETTERS != LETTERS - 1:  # not whole words
                    continue
                last = a + e // LETTERS
                if value & 1:
                    anchors.append(last)
                if value > 1:
                    kind = self.kinds[(value >> 1) - 1]
                    size = next(iter(kind)).count(b" ") + 1
                    s = last - size + 1
                    if (s, size) not in seen_short and bounds[np.searchsorted(bounds, s, "right")] >= s + size:
                        seen_short.add((s, size))
                        mark(s, size, kind.items())
        if anchors:
            # windows that hold an anchor and do not leave their text
            n, size = self.n, min(ANCHOR, self.n)
            s = np.unique((np.unique(np.array(anchors, np.int64))[:, None] - size + 1 - np.arange(n - size + 1)[None, :]).ravel())
            s = s[(s >= 0) & (s + n <= len(words))]
            s = s[bounds[np.searchsorted(bounds, s, "right")] >= s + n]
            h = np.empty(len(s), np.uint64)
            for a in range(0, len(s), PIECE):
                h[a : a + PIECE] = hashing.grams_of(words[s[a : a + PIECE][:, None] + np.arange(n)[None, :]].ravel(), n)[::n]
            lo = np.searchsorted(self.window, h)
            lo[lo == len(self.window)] = 0
            for k in np.flatnonzero(self.window[lo] == h).tolist() if len(self.window) else []:
                mark(int(s[k]), n, self.items_of(int(lo[k])))
        return starts, ends, bounds, np.cumsum(hit[:-1]) > 0, items


def spelled(words: np.ndarray) -> str:
    """LETTERS letters for each word's hash."""
    at = np.arange(5, 5 * LETTERS + 5, 5).astype(np.uint64)
    return ((words[:, None] >> at[None, :]) & np.uint64(31)).astype(np.uint8).tobytes().decode("latin-1")


def build(items: list[tuple[int, bytes]], n: int) -> Automaton:
    """Of item ids and texts."""
    joined = [(i, b" ".join(normal_words(t))) for i, t in items]
    return Automaton([(i, t) for i, t in joined if t], n)


def scan(text: bytes, automaton: Automaton) -> tuple[int, np.ndarray, list[int]]:
    """Words of one text, which of them are hit, and the items that occur."""
    data = _NORMAL[np.frombuffer(text, np.uint8)]
    starts, _, _, hit, items = automaton.scan(data, np.array([0, len(data)], np.int64))
    return len(starts), hit, sorted(items.get(0, ()))


def original_spans(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as code point bounds in the original text."""
    points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    return [{"begin": int(points[starts[a]]), "end": int(points[ends[b]])} for a, b in zip(first, stop, strict=True)]


_built: dict[str, Automaton] = {}


def shards(items: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """Ids and normalised texts of the items with words, SHARD_BYTES at a time."""
    held: dict[tuple[int, bytes], None] = {}
    size = 0
    for r in common.slim(items, "item_id", "text").toLocalIterator():
        text = b" ".join(normal_words((r["text"] or "").encode()))
        if not text:
            continue
        if held and size + len(text) > SHARD_BYTES:
            yield list(held)
            held, size = {}, 0
        held[common.NULL_ID if r["item_id"] is None else r["item_id"], text] = None
        size += len(text) + 1
    yield list(held)


def _automaton(name: str, shared, n: int) -> Automaton:
    """Built once in a worker for each call on the driver, which has the name."""
    if name not in _built:
        _built.clear()
        _built[name] = Automaton(shared.value, n)
    return _built[name]


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Some rows of a batch at a time: their bounds, bytes and offsets."""
    data, offs = common.flat(batch.column(at))
    for i, j in common.groups(offs, 1 << 20):
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def _found(spark, shard: list[tuple[int, bytes]], n: int):
    """For mapInArrow over doc_id, text, key: documents with hits, as runs of words, and their items."""
    shared, name = spark.sparkContext.broadcast(shard), uuid.uuid4().hex  # of SHARD_BYTES, or one item
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("runs", _SPANS), ("item_ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, shared, n)
        for batch in batches:
            rows, runs, own = [], [], []
            for i, _, data, offs in _texts(batch, 1):
                _, _, bounds, hit, items = automaton.scan(_NORMAL[data], offs)
                for k in sorted(items):
                    edge = np.diff(np.concatenate([[0], hit[bounds[k] : bounds[k + 1]].astype(np.int8), [0]]))
                    rows.append(i + k)
                    runs.append([{"begin": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
                    own.append(sorted(items[k]))
            some = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(2).take(some), pa.array(runs, _SPANS), pa.array(own, pa.list_(pa.int64()))], schema=schema)

    return run


def _joined(docs: DataFrame, parts: Iterator[list], n: int) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) with a key of the text, and what the shards find of each doc_id and key."""
    spark = docs.sparkSession
    keyed = docs.withColumn("key", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    found = None
    for shard in parts:
        part = keyed.mapInArrow(_found(spark, shard, n), "doc_id long, key string, runs array<struct<begin:long,end:long>>, item_ids array<long>")
        part = common.settled(part.groupBy("doc_id", "key").agg(F.first("runs").alias("runs"), F.first("item_ids").alias("item_ids")))
        found = part if found is None else found.unionByName(part)
    one = found.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    return keyed, one  # at most one row a shard in each list


def _two(parts: Iterator[list]) -> tuple[list | None, Iterator[list]]:
    """The only shard, or None and all of them."""
    import itertools

    first = next(parts)
    second = next(parts, None)
    return (first, iter(())) if second is None else (None, itertools.chain([first, second], parts))


def occurrences(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """Per document: its words, the words inside an occurrence of an item's window, the items, the spans.

    docs: doc_id, text; items: item_id, text; other columns are ignored. Null and empty texts have no
    words; an item without words has no window; an item of fewer than n words is one window. Repeated
    documents give a row each; repeated items count once. Null item ids are left out of item_ids, but
    their words count as hit. An empty table of items hits nothing.
    """
    spark = docs.sparkSession
    common.ship(spark)
    docs = common.slim(docs, "doc_id", "text")
    only, parts = _two(shards(items))
    if only is None:
        keyed, one = _joined(docs, parts, n)
        pairs = keyed.join(one.withColumnRenamed("doc_id", "own"), keyed["doc_id"].eqNullSafe(F.col("own")) & (keyed["key"] == one["key"]), "left")
        return pairs.select("doc_id", "text", "runs", "item_ids").mapInArrow(_merge, SCHEMA)
    shared, name = spark.sparkContext.broadcast(only), uuid.uuid4().hex  # of SHARD_BYTES, or one item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, shared, n)
        for batch in batches:
            out: dict[str, list] = {"n_words": [], "n_hit": [], "item_ids": [], "spans": []}
            for i, j, data, offs in _texts(batch, 1):
                starts, ends, bounds, hit, items = automaton.scan(_NORMAL[data], offs)
                total = np.concatenate([[0], np.cumsum(hit)])
                out["n_words"] += np.diff(bounds).tolist()
                out["n_hit"] += (total[bounds[1:]] - total[bounds[:-1]]).tolist()
                for k in range(j - i):
                    own = items.get(k)
                    out["item_ids"].append(sorted(x for x in own if x != common.NULL_ID) if own else [])
                    a, b, o = bounds[k], bounds[k + 1], offs[k]
                    out["spans"].append(original_spans(data[o : offs[k + 1]], starts[a:b] - o, ends[a:b] - o, hit[a:b]) if own else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[f.name], f.type) for f in list(_ARROW)[1:]]], schema=_ARROW)

    return docs.mapInArrow(run, SCHEMA)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, runs, item_ids of all shards to a row of occurrences."""
    for batch in batches:
        out: dict[str, list] = {"n_words": [], "n_hit": [], "item_ids": [], "spans": []}
        data, offs = common.flat(batch.column(1))
        for k, (runs, own) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            text = data[offs[k] : offs[k + 1]]
            starts, ends, _ = hashing.word_spans(_NORMAL[text], np.array([0, len(text)], np.int64), _SEPARATOR)
            step = np.zeros(len(starts) + 1, np.int32)
            for r in runs or []:
                step[r["begin"]] += 1
                step[r["end"]] -= 1
            hit = np.cumsum(step[:-1]) > 0
            out["n_words"].append(len(starts))
            out["n_hit"].append(int(hit.sum()))
            out["item_ids"].append([x for x in own or [] if x != common.NULL_ID])
            out["spans"].append(original_spans(text, starts, ends, hit) if runs else [])
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[f.name], f.type) for f in list(_ARROW)[1:]]], schema=_ARROW)


def clean(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """The documents without any occurrence, with the columns of docs, which may have any names."""
    spark = docs.sparkSession
    common.ship(spark)
    only, parts = _two(shards(items))
    if only is None:
        keyed, one = _joined(common.slim(docs, "doc_id", "text"), parts, n)
        rest = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("key"), F.struct(*docs.columns).alias("rest"))
        kept = rest.join(one.select(F.col("doc_id").alias("own"), F.col("key").alias("hit")), F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("key") == F.col("hit")), "left_anti")
        return kept.select("rest.*")
    shared, name = spark.sparkContext.broadcast(only), uuid.uuid4().hex  # of SHARD_BYTES, or one item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, shared, n)
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for i, _, data, offs in _texts(batch, batch.schema.get_field_index("text")):
                keep[[i + k for k in automaton.scan(_NORMAL[data], offs)[4]]] = False
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(common.frugal(run), docs.schema)


def op1(docs: DataFrame, items: DataFrame) -> DataFrame:
    names = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return occurrences(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
m AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""
