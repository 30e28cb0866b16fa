"""Which windows of a corpus also start earlier: the distributed frame around two solvers.

A document is a row of values (bytes, or hashes of words). Only windows that could be equal may meet in
one task, and no window travels alone:

1. Each document is cut into runs of window starts with one key (hashing.territories). Equal windows have
   equal keys. Only keys and content hashes of runs are dealt out, packed by destination; a batch first
   drops runs whose whole content it has seen in an earlier document, so a group of copies sends little.
2. Where a key meets the key's runs: every run whose whole content stands earlier is settled. Of the rest
   only keys with more than one content need their values compared; those runs are asked for.
3. The asked-for values are cut out of the documents and dealt out by key. A key with very many contents
   is cut again by the least hash of longer grams, so that one frequent line does not fill a task.
4. A solver (suffix_array, suffix_tree) finds the windows that start earlier.
5. Each document gets its spans.

A content is settled by a key's 64 bits and 96 bits of another hash, neither of which has structure.
A row is known by its doc_id and a hash of its text. Rows that agree in both are one document, so equal
rows get equal results; rows that share only the doc_id are ordered by that hash. A null doc_id is the
smallest. Documents are dealt out by a hash of both, over as many parts as keep one part's texts near
PART bytes; keys are dealt out over the same parts. Parts are numbered so that, as long as there are no
more of them than tasks, no two share a task.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashing

#: A key with more contents than this is cut again by longer grams.
WIDE = 2048
#: Bytes of text from which a map task gathers runs before it deals them out: at least the first; more with
#: more destinations, so that each gets many runs at once; at most the last.
FLUSH, FLUSH_EACH, FLUSH_MOST = 4 << 20, 16 << 10, 64 << 20
#: Bytes of text in a part.
PART = 64 << 20

PACKED = "part int, blob binary"
_PACKED = pa.schema([("part", pa.int32()), ("blob", pa.binary())])


@dataclass(frozen=True)
class Kind:
    """window, gram, wide_gram in values; later: a window in the same document counts as earlier too."""

    window: int
    gram: int
    wide_gram: int
    same_document: bool
    words: bool


BYTES = Kind(window=100, gram=32, wide_gram=72, same_document=True, words=False)
WORDS = Kind(window=13, gram=5, wide_gram=10, same_document=False, words=True)


def pack(**arrays: np.ndarray) -> bytes:
    body = [struct.pack("<i", len(arrays))]
    for a in arrays.values():
        a = np.ascontiguousarray(a)
        body.append(struct.pack("<4sq", a.dtype.str[1:].encode().ljust(4), a.nbytes))
        body.append(a.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,), at, out = struct.unpack_from("<i", raw), 4, []
    for _ in range(n):
        kind, size = struct.unpack_from("<4sq", raw, at)
        at += 12
        out.append(np.frombuffer(raw, np.dtype("<" + kind.decode().strip()), size // np.dtype(kind.decode().strip()).itemsize, at))
        at += size
    return out


def packed(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p for p, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], schema=_PACKED
    )


def blobs(table: pa.Table) -> list[list[np.ndarray]]:
    return [unpack(b) for b in table.column("blob").to_pylist() if b]


def text_hashes(raw: bytes, offs: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 gives for a string column."""
    view = memoryview(raw)
    return np.array([xxhash.xxh64_intdigest(view[offs[i] : offs[i + 1]], 42) for i in range(len(offs) - 1)], np.uint64)


def values_of(data: np.ndarray, offs: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    if not kind.words:
        return data, offs
    starts, ends, bounds = hashing.word_spans(data, offs)
    return hashing.word_hashes(data, starts, ends), bounds


def slots(n: int, tasks: int) -> np.ndarray:
    """n numbers of parts that Spark's hash of an int deals evenly over tasks."""
    own = np.arange(3 * n + 40 * tasks + 400)
    task = hashing.spark_hash_int(own) % tasks
    order = np.argsort(task, kind="stable")
    begin = np.searchsorted(task[order], np.arange(tasks))
    turn = np.empty(len(own), np.int64)
    turn[order] = np.arange(len(own)) - begin[task[order]]
    best = np.lexsort((task, turn))[:n]
    return own[best].astype(np.int32)


def destination(keys: np.ndarray, to: np.ndarray) -> np.ndarray:
    return to[((keys >> np.uint64(40)) % np.uint64(len(to))).astype(np.int64)]


def split(parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each destination with the positions that go there, in order."""
    order = np.argsort(parts, kind="stable")
    cut = np.flatnonzero(np.diff(parts[order])) + 1
    for own in np.split(order, cut):
        if len(own):
            yield int(parts[own[0]]), own


def home(doc: np.ndarray, th: np.ndarray, to: np.ndarray) -> np.ndarray:
    return to[np.mod(hashing.spark_hash(doc, th.view(np.int64)), len(to))]


def first_pass(kind: Kind, to: np.ndarray) -> Callable:
    """Documents to packed runs: key, content, document of a small table, first start, starts."""

    limit = min(FLUSH_MOST, max(FLUSH, len(to) * FLUSH_EACH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            doc, th = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            base = np.cumsum([0, *[len(h[0]) for h in held]])
            key, content, first, count = (np.concatenate([h[i] for h in held]) for i in (2, 3, 5, 6))
            at = np.concatenate([h[4] + b for h, b in zip(held, base, strict=False)])
            # documents in order, so that the first of equal contents is the earliest
            order = np.lexsort((th, doc))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            doc, th, at = doc[order], th[order], rank[at]
            # rows that agree in both are one document: one of them sends its runs
            again = np.zeros(len(doc), bool)
            again[1:] = (doc[1:] == doc[:-1]) & (th[1:] == th[:-1])
            o = np.lexsort((first, at))
            o = o[~again[at[o]]]
            key, content, at, first, count = key[o], content[o], at[o], first[o], count[o]
            o = np.argsort(content[:, 0], kind="stable")
            start = np.concatenate([[True], (content[o][1:] != content[o][:-1]).any(1)]) if len(o) else np.zeros(0, bool)
            lead = o[np.maximum.accumulate(np.where(start, np.arange(len(o)), 0))] if len(o) else o
            settled = np.zeros(len(o), bool)
            settled[o] = later(doc, th, at[o], at[lead], kind) & ~start
            rows = []
            for p, own in split(destination(key, to)):
                own = own[~settled[own]]
                if len(own):
                    used, local = np.unique(at[own], return_inverse=True)
                    rows.append((p, b"R" + pack(k=key[own], c=content[own, 0], e=content[own, 1].astype(np.uint32), d=doc[used], t=th[used], a=local.astype(np.uint32), f=first[own].astype(np.uint32 if len(first) == 0 or first.max() < 2**32 else np.int64), n=count[own].astype(np.uint32))))
            done = np.flatnonzero(settled)
            for p, own in split(home(doc[at[done]], th[at[done]], to)):
                own = done[own]
                rows.append((p, b"S" + pack_spans(doc[at[own]], th[at[own]], first[own], count[own] >> 1)))
            held.clear()
            return packed(rows)

        for batch in batches:
            data, offs = common.flat(batch.column(1))
            doc, th = common.ids(batch.column(0)), text_hashes(data.tobytes(), offs)
            for i, j in common.groups(offs, 1 << 20):
                piece = data[offs[i] : offs[j]]
                values, bounds = values_of(piece, offs[i : j + 1] - offs[i], kind)
                key, content, first, count, inner = hashing.territories(values, bounds, kind.window, kind.gram, kind.same_document)
                at = np.searchsorted(bounds, first, "right") - 1
                held.append((doc[i:j], th[i:j], key, content, at, first - bounds[at], count << 1 | inner))
                size += len(piece)
                if size >= limit:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def later(doc: np.ndarray, th: np.ndarray, a: np.ndarray, b: np.ndarray, kind: Kind) -> np.ndarray:
    """Whether run a, which stands after the equal run b, counts as later."""
    if kind.same_document:
        return np.ones(len(a), bool)
    return doc[a] > doc[b]


def pack_spans(doc: np.ndarray, th: np.ndarray, first: np.ndarray, count: np.ndarray) -> bytes:
    return pack(d=doc, t=th, f=first.astype(np.int64), n=count.astype(np.int64))


def pack_wanted(doc, th, first, count, key, wide) -> bytes:
    return pack(d=doc, t=th, f=first.astype(np.int64), n=count.astype(np.int64), k=key, w=wide.astype(np.uint8))


def meet(kind: Kind, to: np.ndarray) -> Callable:
    """All runs of some keys: settled spans, and runs whose values must be compared."""

    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        held = [b for b in t.column("blob").to_pylist() if b]
        rows = [(part, b) for b in held if b[:1] == b"S"]  # settled in its own batch
        got = [unpack(b[1:]) for b in held if b[:1] == b"R"]
        del held
        if not got:
            return pa.Table.from_batches([packed(rows)])
        key, content, low, count, first = (np.concatenate([g[i] for g in got]) for i in (0, 1, 2, 7, 6))
        first, count, inner = first.astype(np.int64), count.astype(np.int64) >> 1, (count & 1).astype(bool)
        doc = np.concatenate([g[3][g[5]] for g in got])
        th = np.concatenate([g[4][g[5]] for g in got])
        del got
        o = np.lexsort((first, th, doc, low, content, key))
        # a run that another task sent too, of an equal row, is the same run
        again = np.zeros(len(o), bool)
        again[1:] = np.logical_and.reduce([x[o][1:] == x[o][:-1] for x in (key, content, low, doc, th, first)])
        o = o[~again]
        key, content, low, doc, th, first, count, inner = (x[o] for x in (key, content, low, doc, th, first, count, inner))
        same_key = np.concatenate([[False], key[1:] == key[:-1]])
        same = same_key.copy()
        same[1:] &= (content[1:] == content[:-1]) & (low[1:] == low[:-1])
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
        settled = same & (np.ones(len(key), bool) if kind.same_document else doc > doc[lead])
        group = np.cumsum(~same_key) - 1
        contents = np.bincount(group, weights=~same).astype(np.int64) if len(group) else np.zeros(0, np.int64)
        ask = ~settled & ((contents[group] > 1) | inner)
        for p, own in split(home(doc[settled], th[settled], to)):
            own = np.flatnonzero(settled)[own]
            rows.append((p, b"S" + pack_spans(doc[own], th[own], first[own], count[own])))
        for p, own in split(home(doc[ask], th[ask], to)):
            own = np.flatnonzero(ask)[own]
            rows.append((p, b"W" + pack_wanted(doc[own], th[own], first[own], count[own], key[own], contents[group[own]] > WIDE)))
        return pa.Table.from_batches([packed(rows)])

    return run


def names(doc: np.ndarray, th: np.ndarray) -> np.ndarray:
    """One value for a doc_id and a text's hash."""
    return hashing.mix(th ^ hashing.mix(doc.astype(np.uint64)))


class Documents:
    """The texts of a task by (doc_id, text hash)."""

    def __init__(self, t: pa.Table):
        self.raw_ids = t.column("doc_id").combine_chunks()
        self.doc = common.ids(self.raw_ids) if len(t) else np.zeros(0, np.int64)
        data, self.offs = common.flat(t.column("text"))
        self.data = data
        self.th = text_hashes(data.tobytes(), self.offs)
        self.name = names(self.doc, self.th)
        self.order = np.argsort(self.name, kind="stable")

    def find(self, doc: np.ndarray, th: np.ndarray) -> np.ndarray:
        """The position of the first row of each doc_id and text; all rows that agree have the same text."""
        at = np.searchsorted(self.name[self.order], names(doc, th))
        while True:
            found = self.order[at]
            other = (self.doc[found] != doc) | (self.th[found] != th)
            if not other.any():
                return found
            at[other] += 1  # another document of the same name

    def text(self, i: int) -> np.ndarray:
        return self.data[self.offs[i] : self.offs[i + 1]]


def cut_out(kind: Kind, to: np.ndarray) -> Callable:
    """Documents and wanted runs to packed values by key."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = [unpack(b[1:]) for b in right.column("blob").to_pylist() if b and b[:1] == b"W"]
        if not wanted or not len(left):
            return _PACKED.empty_table()
        doc, th, first, count, key, wide = (np.concatenate([w[i] for w in wanted]) for i in range(6))
        docs = Documents(left)
        rows_of = docs.find(doc, th)
        o = np.lexsort((first, rows_of))
        keys, ids_, ths, firsts, counts, pieces = [], [], [], [], [], []
        values, at = None, -1
        for x in o:
            if rows_of[x] != at:
                at = rows_of[x]
                text = docs.text(at)
                values = text if not kind.words else values_of(text, np.array([0, len(text)], np.int64), kind)[0]
            f, c = int(first[x]), int(count[x])
            piece = values[f : f + c + kind.window - 1]
            if wide[x]:
                k2, _, f2, n2, _ = hashing.territories(piece, np.array([0, len(piece)], np.int64), kind.window, kind.wide_gram)
            else:
                k2, f2, n2 = key[x : x + 1], [0], [c]
            for kk, ff, nn in zip(k2, f2, n2, strict=True):
                keys.append(kk)
                ids_.append(doc[x])
                ths.append(th[x])
                firsts.append(f + int(ff))
                counts.append(int(nn))
                pieces.append(piece[int(ff) : int(ff) + int(nn) + kind.window - 1])
        keys = np.array(keys, np.uint64)
        ids_, ths = np.array(ids_, np.int64), np.array(ths, np.uint64)
        firsts, counts = np.array(firsts, np.int64), np.array(counts, np.int64)
        rows = []
        for p, own in split(destination(keys, to)):
            rows.append((p, pack(k=keys[own], d=ids_[own], t=ths[own], f=firsts[own], n=counts[own].astype(np.uint32), v=np.concatenate([pieces[i] for i in own]))))
        return pa.Table.from_batches([packed(rows)])

    return run


@dataclass
class Block:
    """Runs in document order, their values one after another."""

    doc: np.ndarray
    first: np.ndarray
    count: np.ndarray
    offs: np.ndarray  # of each run in values
    values: np.ndarray


def solve(kind: Kind, to: np.ndarray, solver: Callable[[Block, Kind], np.ndarray]) -> Callable:
    """solver: which positions of values are starts of windows that also start earlier."""

    def run(t: pa.Table) -> pa.Table:
        got = blobs(t)
        doc, th, first, count = (np.concatenate([g[i] for g in got]) for i in (1, 2, 3, 4))
        count = count.astype(np.int64)
        values = np.concatenate([g[5] for g in got])
        del got
        size = count + kind.window - 1
        begin = np.cumsum(size) - size
        o = np.lexsort((first, th, doc))
        offs = np.concatenate([[0], np.cumsum(size[o])])
        take = np.repeat(begin[o] - offs[:-1], size[o]) + np.arange(offs[-1])
        doc, th, first, count = doc[o], th[o], first[o], count[o]
        found = solver(Block(doc, first, count, offs, values[take]), kind)
        # runs of found starts; the last window - 1 values of a run are never starts, so runs stay apart
        edge = np.diff(np.concatenate([[0], found.astype(np.int8), [0]]))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        seg = np.searchsorted(offs, lo, "right") - 1
        rows = []
        for p, own in split(home(doc[seg], th[seg], to)):
            s = seg[own]
            rows.append((p, b"S" + pack_spans(doc[s], th[s], first[s] + lo[own] - offs[s], hi[own] - lo[own])))
        return pa.Table.from_batches([packed(rows)])

    return run


def covered(length: int, first: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    step = np.zeros(length + 1, np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, first + count + window - 1, -1)
    return np.cumsum(step[:-1]) > 0


def finish(kind: Kind, per_document: Callable, schema: pa.Schema, carry: bool) -> Callable:
    """per_document(text bytes, first, count) gives a row's columns after doc_id; carry: text and rest follow."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            more = [("text", left.column("text").type), ("rest", left.column("rest").type)] if carry else []
            return pa.schema([*schema, *more]).empty_table()
        docs = Documents(left)
        spans = [unpack(b[1:]) for b in right.column("blob").to_pylist() if b and b[:1] == b"S"]
        one = docs.find(docs.doc, docs.th)  # equal rows get the spans of one of them
        if spans:
            doc, th, first, count = (np.concatenate([s[i] for s in spans]) for i in range(4))
            own = docs.find(doc, th)
            o = np.argsort(own, kind="stable")
            own = own[o]
            lo, hi = np.searchsorted(own, one, "left"), np.searchsorted(own, one, "right")
            first, count = first[o], count[o]
        else:
            first = count = np.zeros(0, np.int64)
            lo = hi = np.zeros(len(one), np.int64)
        raw = docs.data.tobytes()
        rows = [per_document(raw[docs.offs[i] : docs.offs[i + 1]], first[lo[i] : hi[i]], count[lo[i] : hi[i]]) for i in range(len(one))]
        out = {"doc_id": docs.raw_ids.cast(pa.int64())}
        for k, f in enumerate(list(schema)[1:]):
            out[f.name] = pa.array([r[k] for r in rows], f.type)
        if carry:
            out |= {"text": left.column("text"), "rest": left.column("rest")}
        return pa.table(out)

    return run


def find(docs: DataFrame, kind: Kind, solver: Callable, per_document: Callable, schema: pa.Schema, ddl: str, carry: bool = False) -> DataFrame:
    """per_document's row for every document, given the windows of it that start earlier.

    carry: with the text and a struct rest of all columns of docs but text.
    """
    spark = docs.sparkSession
    common.ship(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    to = slots(max(common.parts(spark), -(-size // PART)), common.parts(spark))
    rest = F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("rest")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[rest] * carry)
    docs = whole.select("doc_id", "text")
    if carry:
        ddl += f", text string, rest {whole.schema['rest'].dataType.simpleString()}"
    runs = docs.mapInArrow(common.frugal(first_pass(kind, to)), PACKED)
    met = common.settled(runs.groupBy("part").applyInArrow(common.frugal(meet(kind, to)), PACKED))
    # one exchange of the texts serves both joins
    place = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(common.NULL_ID)), F.xxhash64(F.coalesce("text", F.lit("")))), F.lit(len(to)))
    part = F.element_at(F.array(*[F.lit(int(p)) for p in to]), (place + 1).cast("int")) if len(to) <= 1 << 12 else None
    if part is None:  # too many for a literal: a short table
        named = spark.createDataFrame([(i, int(p)) for i, p in enumerate(to)], "place long, part int")
        homed = whole.withColumn("place", place).join(F.broadcast(named), "place").drop("place")
    else:
        homed = whole.withColumn("part", part)
    homed = homed.repartition(common.parts(spark), "part")
    asked = met.where(F.substring("blob", 1, 1) == F.lit(b"W"))
    values = homed.select("doc_id", "text", "part").groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(common.frugal(cut_out(kind, to)), PACKED)
    found = values.groupBy("part").applyInArrow(common.frugal(solve(kind, to, solver)), PACKED)
    spans = met.where(F.substring("blob", 1, 1) == F.lit(b"S")).unionByName(found)
    return homed.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(common.frugal(finish(kind, per_document, schema, carry)), ddl)
