"""MinHash near-duplicates by DartMinHash signatures.

Every element of a weighted set owns a strip of the plane as wide as its weight; the strip is cut into
dyadic columns. Darts fall on the plane by hashing, in order of rank, the same for equal elements in any
set. A set throws all darts of rank below a bound that makes about k ln k + 2k of them hit it, and keeps of
each of k coordinates the earliest; if a coordinate stays empty the bound is doubled. Two sets agree in a
coordinate with the probability of their weighted Jaccard similarity.

Signatures are joined by bands. In every band's bucket each document is held against the least one, by
exact similarity of the shingle sets; what then is in one component is settled. Buckets that still hold
several components are compared blockwise: of two blocks only those pairs are, that share one of their
rarest shingles (of sets as similar as that, the rarest fifth and one more cannot all differ), and that
neither their sizes nor the triangle inequality of the Jaccard distance rules out. So work is linear in a
group of copies, and no link that the bands find is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashing
from .components import connected

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares no band with probability (1 - 0.8**5)**24 = 0.00007.
ROWS, BANDS = 5, 24
#: Documents of a bucket in a block.
BLOCK = 1024
_CHUNK = 1 << 16


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _throw(sig: np.ndarray, elements: np.ndarray, weights: np.ndarray | None, of: np.ndarray, bound: np.ndarray) -> None:
    """Puts the darts of rank below bound[of] into sig (documents x k)."""
    k = sig.shape[1]
    lo, width, column = 0.0, 1.0, 0
    while True:
        own = np.arange(len(elements)) if weights is None else np.flatnonzero(weights > lo)
        if not len(own):
            return
        base = hashing.mix(elements[own] + np.uint64(hashing.mixed(column + 1)))
        rank, at, many = np.zeros(len(own)), 0, 2
        while len(own):
            j = np.arange(at, at + many, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h = hashing.mix(base[:, None] + j[None, :])
            gaps = -np.log(_uniform(h)) / width
            gaps[:, 0] += rank
            ranks = np.cumsum(gaps, axis=1)
            hit = ranks < bound[of[own]][:, None]
            inside = hit
            if weights is not None:
                place = lo + width * _uniform(hashing.mix(h ^ np.uint64(0x5851F42D4C957F2D)))
                inside = hit & (place < weights[own][:, None])
            r, c = np.nonzero(inside)
            coordinate = (hashing.mix(h[r, c]) >> np.uint64(32)) % np.uint64(k)
            np.minimum.at(sig, (of[own[r]], coordinate.astype(np.int64)), ranks[r, c])
            live = hit[:, -1]
            own, base, rank = own[live], base[live], ranks[live, -1]
            at += many
            many = min(64, many * 2)
        if weights is None:
            return
        lo, width, column = lo + width, 1.0 if column == 0 else width * 2, column + 1


def signatures(elements: np.ndarray, bounds: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """A row of k values for each set elements[bounds[i]:bounds[i + 1]]; sets without weight stay infinite.

    weights: of each element, 1 if None; an element that occurs twice in a set counts once, with the larger.
    """
    n = len(bounds) - 1
    sig = np.full((n, k), np.inf)
    size = np.diff(bounds)
    of = np.repeat(np.arange(n), size)
    total = size.astype(float) if weights is None else np.bincount(of, weights, n)
    with np.errstate(divide="ignore"):
        bound = np.where(total > 0, (k * np.log(k) + 2 * k) / total, 0.0)
    todo = total > 0
    while todo.any():
        own = np.flatnonzero(todo[of])
        for a in range(0, len(own), _CHUNK):
            part = own[a : a + _CHUNK]
            _throw(sig, elements[part], None if weights is None else weights[part], of[part], bound)
        todo &= np.isinf(sig).any(axis=1)
        bound = bound * 2
    return sig


def shingles(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each text's runs of size words (one run of all words, if fewer), their bounds, and a hash
    of each text's words in order."""
    starts, ends, bounds = hashing.word_spans(data, offs)
    words = hashing.word_hashes(data, starts, ends)
    n = np.diff(bounds)
    grams = hashing.gram_hashes(words, size)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    out_bounds = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(out_bounds[-1], np.uint64)
    long = n >= size
    take = np.repeat(bounds[:-1][long] - out_bounds[:-1][long], count[long]) + np.flatnonzero(np.repeat(long, count))
    out[np.repeat(long, count)] = grams[take]
    few = np.flatnonzero((n > 0) & (n < size))
    ends_of = np.minimum(bounds[1:], bounds[:-1] + size)
    out[out_bounds[few]] = hashing.span_hashes(words, bounds[few], ends_of[few])[:, 0] if len(few) else 0
    return out, out_bounds, hashing.span_hashes(words, bounds[:-1], bounds[1:])


def texts_of(whole: np.ndarray, some: np.ndarray) -> pa.Array:
    """The 128-bit hashes as binary, null where a text has no words."""
    raw = pa.array(np.ascontiguousarray(whole).view("V16").ravel().tolist() if len(whole) else [], pa.binary())
    return pa.compute.if_else(pa.array(some), raw, pa.scalar(None, pa.binary()))


_SIGNED = pa.schema([("id", pa.int64()), ("same", pa.binary()), ("bands", pa.list_(pa.int64()))])
_SETS = pa.schema([("same", pa.binary()), ("grams", pa.binary())])


def _sign(size: int, rows: int, bands: int):
    """Every row's id, the hash of its words (null if it has none) and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = common.flat(batch.column(1))
            own = common.ids(batch.column(0))
            for i, j in common.groups(offs, 1 << 19):
                grams, bounds, whole = shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], size)
                some = np.diff(bounds) > 0
                has = np.flatnonzero(some)
                sig = signatures(grams, bounds, rows * bands)[has].view(np.uint64).reshape(len(has), bands, rows)
                key = np.zeros((len(has), bands), np.uint64) + hashing.mix(np.arange(bands, dtype=np.uint64))
                for r in range(rows):
                    key = hashing.mix(key ^ sig[:, :, r])
                ends = np.concatenate([[0], np.cumsum(some) * bands]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, key.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays([pa.array(own[i:j]), texts_of(whole, some), lists], schema=_SIGNED)

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = common.flat(batch.column(0))
            for i, j in common.groups(offs, 1 << 20):
                grams, bounds, whole = shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], size)
                sets = [np.unique(grams[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([texts_of(whole, np.diff(bounds) > 0), pa.array(sets, pa.binary())], schema=_SETS)

    return run


def _named(schema: pa.Schema):
    """Rows (text, more) with the hash of the text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = common.flat(batch.column(0))
            found = []
            for i, j in common.groups(offs, 1 << 20):
                piece = data[offs[i] : offs[j]]
                starts, ends, bounds = hashing.word_spans(piece, offs[i : j + 1] - offs[i])
                words = hashing.word_hashes(piece, starts, ends)
                found.append(texts_of(hashing.span_hashes(words, bounds[:-1], bounds[1:]), np.diff(bounds) > 0))
            same = pa.concat_arrays(found) if found else pa.array([], pa.binary())
            yield pa.RecordBatch.from_arrays([same, *batch.columns], names=["same", *batch.schema.names])

    return run


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, grams_a, grams_b to a, b, similarity."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])
    for batch in batches:
        x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        found = [jaccard(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], schema=schema)


def candidates(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row of left and a later row of right that may be as similar: those that share a shingle of
    both prefixes, where a set's shingles stand in the order of how few rows have them."""
    rows = np.union1d(left, right)
    size = np.array([len(sets[k]) for k in rows])
    if not size.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, gram, many = np.unique(np.concatenate([sets[k] for k in rows]), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(len(rows)), size)
    o = np.lexsort((gram, many[gram], of))
    place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    o = o[place < (size - np.ceil(similarity * size - 1e-9) + 1)[of]]
    gram, of = gram[o], of[o]
    o = np.argsort(gram, kind="stable")
    gram, of = gram[o], rows[of[o]]
    begin = np.flatnonzero(np.diff(gram, prepend=-1))
    found = [np.zeros(0, np.int64)]
    in_left, in_right, n = np.isin(of, left), np.isin(of, right), len(sets)
    for a, b in zip(begin, np.append(begin[1:], len(gram)), strict=True):
        if b - a > 1:
            i, j = of[a:b][in_left[a:b]], of[a:b][in_right[a:b]]
            found.append((i[:, None] * n + j[None, :])[i[:, None] < j[None, :]] if left is right else (i[:, None] * n + j[None, :]).ravel())
    pairs = np.unique(np.concatenate(found))
    return pairs // n, pairs % n


def _block(similarity: float):
    """One block of a bucket against another: links between components, as pairs of their roots."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        side, far = t.column("side").to_numpy(), t.column("far").to_numpy()
        names = t.column("root").combine_chunks().dictionary_encode()
        names = names if isinstance(names, pa.DictionaryArray) else names.combine_chunks()
        roots, names = names.indices.to_numpy(), names.dictionary
        sets = [np.frombuffer(g, np.uint64) for g in t.column("grams").to_pylist()]
        size = np.array([len(x) for x in sets])
        left = np.flatnonzero(side == 0)
        right = left if t.column("bi")[0].as_py() == t.column("bj")[0].as_py() else np.flatnonzero(side == 1)
        i, j = candidates(sets, left, right, similarity)
        near = (roots[i] != roots[j]) & (np.abs(far[i] - far[j]) <= 1 - similarity + 1e-9)
        near &= np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9
        parent = list(range(len(names)))

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        a, b = [], []
        for x, y in zip(i[near].tolist(), j[near].tolist(), strict=True):
            p, q = top(roots[x]), top(roots[y])
            if p != q and jaccard(sets[x], sets[y]) >= similarity:
                parent[max(p, q)] = min(p, q)
                a.append(roots[x])
                b.append(roots[y])
        return pa.Table.from_arrays([names.take(pa.array(x, pa.int32())) for x in (a, b)], schema=schema)

    return run


def _classes(docs: DataFrame, similarity: float, size: int, rows: int, bands: int) -> tuple[DataFrame, DataFrame]:
    """Every row's id and text (id, same), and of every text the least id of its class and which text has it
    (same, class_id, first)."""
    spark = docs.sparkSession
    common.ship(spark)
    docs = common.slim(docs, "doc_id", "text")
    signed = common.settled(docs.mapInArrow(common.frugal(_sign(size, rows, bands)), "id long, same binary, bands array<long>"))
    # a node is a text's words; it has the least id that has it
    lead = common.settled(signed.where("same IS NOT NULL").groupBy("same").agg(F.min("id").alias("rep"), F.any_value("bands").alias("bands")))
    held = lead.select("same", F.explode("bands").alias("key"))
    firsts = held.groupBy("key").agg(F.min("same").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    buckets = common.settled(held.join(firsts, "key"))
    pairs = buckets.where("same <> first").select(F.col("same").alias("a"), F.col("first").alias("b")).distinct()
    needed = lead.join(buckets.select("same").distinct(), "same", "left_semi").select(F.col("rep").alias("id"))
    texts = docs.select(F.coalesce("doc_id", F.lit(common.NULL_ID)).alias("id"), "text").join(needed, "id", "left_semi").select("text")
    sets = common.settled(texts.mapInArrow(common.frugal(_sets(size)), "same binary, grams binary").where("same IS NOT NULL").groupBy("same").agg(F.any_value("grams").alias("grams")))
    checked = (
        pairs.join(sets.select(F.col("same").alias("a"), F.col("grams").alias("ga")), "a")
        .join(sets.select(F.col("same").alias("b"), F.col("grams").alias("gb")), "b")
        .select("a", "b", "ga", "gb")
        .mapInArrow(common.frugal(_verify), "a binary, b binary, similarity double")
    )
    checked = common.settled(checked)
    found = connected(checked.where(F.col("similarity") >= similarity).select("a", "b"))
    # buckets with several components
    placed = buckets.join(found.withColumnRenamed("id", "same"), "same", "left").withColumn("root", F.coalesce("root", "same"))
    several = placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("n")).where("least <> most")
    far = checked.select(F.col("a").alias("same"), F.col("b").alias("first"), (1 - F.col("similarity")).alias("far"))
    # a pair of two is already compared, as one of them is the first
    open_ = placed.join(several.where("n > 2").select("key", "n"), "key").join(far, ["same", "first"], "left").withColumn("far", F.coalesce("far", F.lit(0.0)))
    open_ = open_.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("same"), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    open_ = open_.select("key", "same", "root", "far", "own", F.explode(others).alias("other"))
    open_ = open_.select("key", "same", "root", "far", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
    more = open_.join(sets, "same").groupBy("key", "bi", "bj").applyInArrow(common.frugal(_block(similarity)), "a binary, b binary")
    more = common.settled(more.distinct())
    nodes = lead.select("same", "rep").join(found.withColumnRenamed("id", "same"), "same", "left").withColumn("root", F.coalesce("root", "same"))
    if not more.isEmpty():  # components that have become one
        joined = connected(more).select(F.col("id").alias("root"), F.col("root").alias("top"))
        nodes = nodes.join(joined, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")
    nodes = common.settled(nodes)
    best = nodes.groupBy("root").agg(F.min(F.struct("rep", "same")).alias("best"))
    nodes = nodes.join(best, "root").select("same", F.col("best.rep").alias("class_id"), F.col("best.same").alias("first"))
    return signed.select("id", "same"), nodes


def _real(c: str):
    return F.when(F.col(c) != common.NULL_ID, F.col(c))


def classes(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, class_id of every row: the least doc_id of the component of its text.

    Links: Jaccard similarity of the sets of size-word runs (words [^\\x20\\x09-\\x0D]+, unchanged; a text
    of fewer words is one run) of at least similarity. Null, empty and blank texts link with nothing. Equal
    texts link whatever their length. Rows that share a doc_id are rows of their own: unlike texts are not
    linked by it. A null doc_id is smaller than any other and stays null. Repeated rows give a row each.
    """
    rows_, nodes = _classes(docs, similarity, size, rows, bands)
    out = rows_.join(nodes.select("same", "class_id"), "same", "left").withColumn("class_id", F.coalesce("class_id", "id"))
    return out.select(_real("id").alias("doc_id"), _real("class_id").alias("class_id"))


def clean(docs: DataFrame) -> DataFrame:
    """One row of each class, that with the least doc_id and then the least hash of its words, with the
    columns of docs; rows without words all stay.

    Of rows that agree in doc_id and words, of which a class may keep one, that with the least hash of all
    columns stays. Columns may have any names.
    """
    rows_, nodes = _classes(docs, SIMILARITY, SHINGLE, ROWS, BANDS)
    has = rows_.where("same IS NOT NULL")
    placed = has.groupBy("id", "same").agg(F.count(F.lit(1)).alias("n")).join(nodes, "same")
    placed = common.settled(placed.select("id", "same", "n", ((F.col("class_id") == F.col("id")) & (F.col("first") == F.col("same"))).alias("stays")))
    lost = placed.where("NOT stays").select("id", "same")
    again = placed.where("stays AND n > 1").select("id", "same")
    rest = docs.select("text", F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NULL_ID)).alias("id"), F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("rest"))
    schema = f"same binary, text string, id long, rest {rest.schema['rest'].dataType.simpleString()}"
    named = rest.mapInArrow(common.frugal(_named(rest.schema)), schema).join(lost, ["id", "same"], "left_anti")
    if not again.isEmpty():
        twice = named.join(again, ["id", "same"], "left_semi")
        # by another key than the join's, so that rows are brought together before their exchange
        one = twice.groupBy(F.concat(F.hex("same"), F.lit("/"), F.col("id").cast("string")).alias("row")).agg(F.min_by(F.struct("text", "rest"), F.xxhash64("text", "rest")).alias("one"))
        named = named.join(again, ["id", "same"], "left_anti").select("text", "rest").unionByName(one.select("one.text", "one.rest"))
    return named.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])


def op9(docs: DataFrame) -> DataFrame:
    """kept: whether the row's doc_id is its class's, as of unique ids one of each class is."""
    return classes(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS g
      FROM (SELECT doc_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE common >= 0.8 * (p.n + q.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a)
SELECT doc_id, class_id, doc_id = class_id AS kept FROM k
"""
