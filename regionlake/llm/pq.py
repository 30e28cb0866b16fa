"""Embedding near-duplicates by product quantisation.

Vectors are scaled to length 1 and fall into coarse inverted lists; the residual from a list's centre is
coded by one byte in each subspace. A query scans the lists that can hold a neighbour: a vector of
another list lies beyond the plane halfway between the two centres, so a list is left out when that plane
is farther than any neighbour is likely to reach. How far that is follows from how much the residuals of
the list spread in the plane's direction, from the widest reach of neighbours in the fitting sample, and
never exceeds the exact bound. Scanning sums table entries; a code whose sum plus its own quantisation
error reaches the threshold is compared exactly, in double precision: nothing that is scanned is lost and
nothing below the threshold is reported.

The index is written once, as blocks of lists in order; every task reads pairs of blocks. So memory is
that of two blocks, nothing is shipped once for each probe, and a crowded list is only more blocks.
Vectors of each dimension have an index of their own. Equal vectors are one, with a count. A pair of
blocks returns a row for each vector it has links for, not one for each link.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected

COSINE = 0.9
#: An index is fitted on at most so many vectors, and so many bytes of them, chosen by a hash of vec_id.
SAMPLE, SAMPLE_BYTES = 16384, 64 << 20
#: Lists are as many as the root of the number of vectors, at most so many.
LISTS = 1024
SUBSPACES, CODES = 8, 256
#: Vectors of a block; queries scanned together; blocks that a task's row names.
BLOCK, QUERIES, RUN = 4096, 128, 16
#: Standard deviations of a neighbour's offset towards another list that are probed.
SIGMAS = 5.0
#: Vectors of one dimension that are too few for an index.
FEW = 256


@dataclass
class Codebook:
    dim: int
    centres: np.ndarray  # lists x dim
    books: list[np.ndarray]  # of each subspace: codes x its dimensions
    bounds: list[int]  # of the subspaces
    margin: np.ndarray | None = None  # list x list: planes nearer than this are crossed; None: all are
    apart: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        c = (self.centres**2).sum(1)
        self.apart = np.sqrt(np.maximum(c[:, None] + c[None, :] - 2 * self.centres @ self.centres.T, 1e-12)).astype(np.float32)

    def far(self, x: np.ndarray) -> np.ndarray:
        """Squared distances from all centres."""
        return 1 - 2 * (x @ self.centres.T) + (self.centres**2).sum(1)

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest = x - self.centres[own]
        codes, error = np.empty((len(x), len(self.books)), np.uint8), np.zeros(len(x))
        for m, book in enumerate(self.books):
            r = rest[:, self.bounds[m] : self.bounds[m + 1]]
            codes[:, m] = ((book**2).sum(1) - 2 * r @ book.T).argmin(1)
            error += ((r - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def planes(self, d: np.ndarray, own: int, to: np.ndarray) -> np.ndarray:
        """How far vectors of list own, with distances d, are from the planes to other lists."""
        return (d[:, to] - d[:, [own]]) / (2 * self.apart[own, to])

    def probes(self, d: np.ndarray, own: int, to: np.ndarray) -> np.ndarray:
        """Which of the lists to each vector of list own probes."""
        if self.margin is None:
            return np.ones((len(d), len(to)), bool)
        return (self.planes(d, own, to) <= self.margin[own, to] + 1e-6) | (to == own)

    def tables(self, x: np.ndarray) -> list[np.ndarray]:
        """Of each subspace: code x query."""
        return [(book @ x[:, a:b].T).astype(np.float32) for book, a, b in zip(self.books, self.bounds, self.bounds[1:], strict=False)]


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([((centres**2).sum(1) - 2 * x[a : a + 4096] @ centres.T).argmin(1) for a in range(0, len(x), 4096)])
        size = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        full = size > 0
        centres[full] = total[full] / size[full][:, None]
        if (~full).any():
            centres[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centres


def _margins(book: Codebook, x: np.ndarray, own: np.ndarray, cosine: float, sigmas: float) -> np.ndarray:
    """For two lists, how near the plane between them a query of the one must be to probe the other."""
    exact = np.sqrt(2 - 2 * cosine)
    k = len(book.centres)
    spread = np.zeros((k, k))  # share of the residuals' variance towards the other list
    rest = x - book.centres[own]
    for i in range(k):
        r = rest[own == i]
        if len(r) < 4:
            spread[i] = 1
            continue
        towards = (book.centres[i] - book.centres) / book.apart[i][:, None]
        spread[i] = ((r @ towards.T) ** 2).mean(0) / max((r**2).sum(1).mean(), 1e-12)
    share = np.maximum(spread, spread.T)
    reach = sigmas * np.sqrt((2 - 2 * cosine) * share)
    # neighbours inside the sample: how far they do reach
    seen = 0.0
    some = x[:8192]
    for a in range(0, len(some), 512):
        i, j = np.nonzero(some[a : a + 512] @ some.T >= cosine)
        i = i + a
        i, j = i[own[i] != own[j]], j[own[i] != own[j]]
        for at in range(0, len(i), 1 << 16):
            p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            near, far = ((some[p] - book.centres[own[p]]) ** 2).sum(1), ((some[p] - book.centres[own[q]]) ** 2).sum(1)
            seen = max(seen, float(((far - near) / (2 * book.apart[own[p], own[q]])).max(initial=0)))
    return np.minimum(np.maximum(reach, 1.3 * seen), exact).astype(np.float32)


def fit(x: np.ndarray, lists: int, cosine: float = COSINE, sigmas: float = SIGMAS, subspaces: int = SUBSPACES, seed: int = 3) -> Codebook:
    rng = np.random.default_rng(seed)
    centres = kmeans(x, lists, rng)
    centres = centres[np.argsort(centres @ (centres - centres.mean(0))[np.argmax(((centres - centres.mean(0)) ** 2).sum(1))])]
    book = Codebook(x.shape[1], centres, [], [])
    own = book.far(x).argmin(1)
    rest = x - centres[own]
    subspaces = min(subspaces, x.shape[1])
    book.bounds = [int(b) for b in np.linspace(0, x.shape[1], subspaces + 1)]
    book.books = [kmeans(np.ascontiguousarray(rest[:, a:b]), CODES, rng) for a, b in zip(book.bounds, book.bounds[1:], strict=False)]
    book.margin = _margins(book, x, own, cosine, sigmas)
    return book


def no_index(dim: int) -> Codebook:
    """For few vectors: one list and one code, so that all pairs are compared."""
    return Codebook(dim, np.zeros((1, dim)), [np.zeros((1, dim))], [0, dim])


def units(raw: list[bytes], dim: int, wide: bool) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64 if wide else np.float32).reshape(len(raw), dim).astype(np.float64)
    x = x / np.abs(x).max(1, initial=1e-300)[:, None]
    return x / np.sqrt((x**2).sum(1))[:, None]


def _valid(kind: type):
    schema = pa.schema([("vec_id", pa.int64()), ("same", pa.binary()), ("dim", pa.int32()), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            offs = column.offsets.to_numpy()
            values = column.values
            null = np.asarray(values.is_null())
            x = values.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
            broken = null | ~np.isfinite(x)
            count, size = np.concatenate([[0], np.cumsum(broken)]), np.concatenate([[0], np.cumsum(x != 0)])
            there = np.asarray(column.is_valid())
            ok = there & (count[offs[1:]] == count[offs[:-1]]) & (size[offs[1:]] > size[offs[:-1]])
            x = x + kind(0)  # -0.0 is 0.0
            raw = [x[offs[i] : offs[i + 1]].tobytes() if ok[i] else None for i in range(len(batch))]
            same = [None if r is None else xxhash.xxh3_128_digest(r) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(np.diff(offs), pa.int32()), pa.array(raw, pa.binary())], schema=schema)

    return run


_FILED = pa.schema([("dim", pa.int32()), ("list", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("codes", pa.binary()), ("error", pa.float64()), ("vec", pa.binary())])


def _file(shared, wide: bool):
    """rep, n, dim, vec to each vector's list, codes and error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                part, book = batch.filter(pa.array(dims == dim)), books[int(dim)]
                for at in range(0, len(part), 1024):
                    some = part.slice(at, 1024)
                    x = units(some.column(3).to_pylist(), int(dim), wide)
                    own = book.far(x).argmin(1)
                    codes, error = book.encode(x, own)
                    yield pa.RecordBatch.from_arrays(
                        [some.column(2), pa.array(own, pa.int32()), some.column(0), some.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), some.column(3)], schema=_FILED
                    )

    return run


@dataclass
class Piece:
    """A block of the index: vectors in order of their lists."""

    dim: int
    own: np.ndarray
    ids: np.ndarray
    n: np.ndarray
    codes: np.ndarray
    error: np.ndarray
    x: np.ndarray


def piece(t: pa.Table, wide: bool) -> Piece:
    t = t.sort_by([("list", "ascending"), ("id", "ascending")])
    dim = t.column("dim")[0].as_py()
    codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(len(t), -1)
    own, ids, n, error = (t.column(c).to_numpy() for c in ("list", "id", "n", "error"))
    return Piece(dim, own, ids, n, codes, error.astype(np.float32), units(t.column("vec").to_pylist(), dim, wide))


def scan(tables: list[np.ndarray], base: np.ndarray, codes: np.ndarray, error: np.ndarray, cosine: float) -> np.ndarray:
    """Codes x queries: whether the table sum, with the code's error, reaches cosine."""
    total = tables[0][codes[:, 0]]
    total += (base + np.float32(1e-5 - cosine))[None, :]
    for m in range(1, len(tables)):
        total += tables[m][codes[:, m]]
    return total >= -error[:, None]


def links(book: Codebook, p: Piece, q: Piece, same: bool, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (row of p, row of q), some at a time; no list of p stands behind one of q."""
    names, begin = np.unique(q.own, return_index=True)
    end = np.append(begin[1:], len(q.own))
    starts = np.concatenate([[0], np.flatnonzero(np.diff(p.own)) + 1, [len(p.own)]])
    for s, stop in zip(starts[:-1], starts[1:], strict=True):
        for a in range(s, stop, QUERIES):
            x, own = p.x[a : min(stop, a + QUERIES)], int(p.own[a])
            probed = book.probes(book.far(x), own, names) & (names >= own)
            if not probed.any():
                continue
            tables = book.tables(x)
            for k in np.flatnonzero(probed.any(0)):
                lo, hi = begin[k], end[k]
                base = (x @ book.centres[names[k]]).astype(np.float32)
                j, i = np.nonzero(scan(tables, base, q.codes[lo:hi], q.error[lo:hi], cosine) & probed[:, k][None, :])
                if same and names[k] == own:  # a pair of one list meets twice there: once is enough
                    once = i + a < j + lo
                    i, j = i[once], j[once]
                for at in range(0, len(i), 8192):
                    u, v = i[at : at + 8192], j[at : at + 8192] + lo
                    hit = np.einsum("ij,ij->i", x[u], q.x[v]) >= cosine
                    if hit.any():
                        yield u[hit] + a, v[hit]


def _link(path: str, shared, cosine: float, wide: bool):
    schema = pa.schema([("id", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        held: OrderedDict[int, Piece] = OrderedDict()

        def load(b: int) -> Piece:
            if b not in held:
                if len(held) >= 3:
                    held.popitem(last=False)
                held[b] = piece(pa.parquet.read_table(f"{base}/block={b}", filesystem=store, partitioning=None), wide)
            held.move_to_end(b)
            return held[b]

        for batch in batches:
            for a, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for b in range(first, last + 1):
                    p, q = load(a), load(b)
                    nodes, node = np.unique(np.concatenate([p.ids, q.ids]), return_inverse=True)
                    left, right = node[: len(p.ids)], node[len(p.ids) :]
                    parent, count = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
                    for i, j in links(shared.value[p.dim], p, q, a == b, cosine):
                        np.add.at(count, left[i], q.n[j])
                        np.add.at(count, right[j], p.n[i])
                        for k in np.unique(i):  # all that one query reaches is one component
                            tops = np.unique(_tops(parent, np.concatenate([left[[k]], right[j[i == k]]])))
                            parent[tops] = tops[0]
                    out = count > 0
                    if out.any():
                        roots = _tops(parent, np.arange(len(nodes)))
                        yield pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(nodes[roots[out]]), pa.array(count[out])], schema=schema)

    return run


def _tops(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        parent[x] = parent[up]
        x = up


def layout(sizes: dict[tuple[int, int], int], most: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """Blocks of lists: (dim, list, first block, blocks) and, of each dimension, the bounds of its blocks.

    Lists of a dimension are packed in order; a list of more than most vectors has blocks of its own.
    """
    placed, bounds, at = [], [], 0
    for dim in sorted({d for d, _ in sizes}):
        begin, held = at, 0
        for _, which in sorted(k for k in sizes if k[0] == dim):
            size = sizes[dim, which]
            if size > most:
                at += held > 0
                own = -(-size // most)
                placed.append((dim, which, at, own))
                at, held = at + own, 0
                continue
            if held + size > most:
                at, held = at + 1, 0
            placed.append((dim, which, at, 1))
            held += size
        at += held > 0
        bounds.append((begin, at))
    return placed, bounds


def near(vectors: DataFrame, cosine: float = COSINE, sigmas: float = SIGMAS, lists: int = LISTS) -> DataFrame:
    """vec_id, n_links, component_id of every row of vectors (vec_id, embedding).

    Links: cosine, in double precision, of at least cosine, of vectors of one dimension. Null and zero
    vectors and those with null or non-finite components link with nothing. Labels and other columns are
    ignored. component_id is the least vec_id reached. Null ids count as the smallest and stay null;
    several vectors with one id are one node: their links are added and their components are one. An
    empty table gives no rows. sigmas: infinity leaves lists out only where no link can be.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    wide = vectors.schema["embedding"].dataType.elementType.typeName() != "float"
    slim = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(common.NULL_ID)).alias("vec_id"), F.col("embedding").cast("array<double>" if wide else "array<float>").alias("embedding"))
    rows = common.settled(slim.mapInArrow(_valid(np.float64 if wide else np.float32), "vec_id long, same binary, dim int, vec binary"))
    whole = rows.where("vec IS NOT NULL")
    reps = common.settled(whole.groupBy("same").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.any_value("dim").alias("dim"), F.any_value("vec").alias("vec")).drop("same"))
    books = {}
    for r in reps.groupBy("dim").count().collect():  # a row a dimension
        dim, many = r["dim"], r["count"]
        if many < FEW:
            books[dim] = no_index(dim)
            continue
        drawn = reps.where(F.col("dim") == dim).orderBy(F.xxhash64("rep"), "rep", "vec").select("vec").limit(min(SAMPLE, max(FEW, SAMPLE_BYTES // (8 * dim)))).collect()
        books[dim] = fit(units([x["vec"] for x in drawn], dim, wide), max(1, min(lists, int(many**0.5), len(drawn) // 16)), cosine, sigmas)
    if not books:
        return _with_nulls(rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    shared = spark.sparkContext.broadcast(books)  # at most LISTS centres and their margins a dimension
    filed = common.settled(reps.select("rep", "n", "dim", "vec").mapInArrow(_file(shared, wide), "dim int, list int, id long, n long, codes binary, error double, vec binary"))
    sizes = {(r["dim"], r["list"]): r["count"] for r in filed.groupBy("dim", "list").count().collect()}  # a row a list
    placed, bounds = layout(sizes, BLOCK)
    of = F.broadcast(spark.createDataFrame(placed, "dim int, list int, first int, blocks int"))  # a row a list
    path = common.fresh_path(spark, "pq-index")
    block = (F.col("first") + F.pmod(F.xxhash64("id", "vec"), F.col("blocks"))).cast("int")
    index = filed.join(of, ["dim", "list"]).withColumn("block", block).drop("first", "blocks")
    index.repartition("block").sortWithinPartitions("block").write.partitionBy("block").parquet(path)
    pairs = [(a, b, min(b + RUN, stop) - 1) for begin, stop in bounds for a in range(begin, stop) for b in range(a, stop, RUN)]
    work = spark.createDataFrame(pairs, "a int, first int, last int").repartition(min(len(pairs), 8 * common.parts(spark)), "a", "first")
    found = common.settled(work.mapInArrow(_link(path, shared, cosine, wide), "id long, root long, links long"))
    common.remove(spark, path)
    links_ = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = connected(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = whole.groupBy("same").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    named = named.join(links_.withColumnRenamed("id", "rep"), "rep", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("same", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    out = rows.select("vec_id", F.when(F.col("vec").isNotNull(), F.col("same")).alias("same")).join(named, "same", "left")
    return _with_nulls(out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")))


def _with_nulls(df: DataFrame) -> DataFrame:
    real = [F.when(F.col(c) != common.NULL_ID, F.col(c)).alias(c) if c != "n_links" else F.col(c) for c in ("vec_id", "n_links", "component_id")]
    return df.select(*real)


def op2(vectors: DataFrame) -> DataFrame:
    return near(vectors).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND list_cosine_similarity(p.x, q.x) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT k.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, k.vec_id = component_id AS kept FROM k LEFT JOIN n USING (vec_id)
"""
