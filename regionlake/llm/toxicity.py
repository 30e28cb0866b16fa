"""Toxicity: a convolutional text classifier in numpy.

A word's vector is the sum of hashed embeddings: of the word and of its first four to seven bytes, so that
inflected forms share a part. Filters of several widths slide over all words of a text, each filter's
largest response is kept, and one dense layer turns these into a score. Only a text's words are seen.

Training starts from random numbers. In the first epochs a filter's responses are averaged with weights
that favour the larger ones, more so from epoch to epoch, so that every word learns; then only the largest
counts. Parts of words are left out at random.

Every labelled row that may be learned from is: four fifths of them, by a hash of doc_id, set the weights,
the others decide which epoch's model stays, and the thresholds by language. The rows are dealt out by a
hash of doc_id to shards. A single shard is learned from in this process. Of several, each is passed over
by a task of its own, all tasks of an epoch starting from the same model; behind every epoch the models are
averaged, each embedding by how often a shard has stepped it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing
from .warc import Store

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 16, (1, 2, 3)
#: Bytes of a word's beginnings that have embeddings of their own.
PREFIXES = (4, 5, 6, 7)
PARTS = 1 + len(PREFIXES)
PAD = max(WIDTHS) - 1
#: Bytes of labelled text in a shard, about; however many there are, all shards are learned from.
SHARD_BYTES = 32 << 20
#: Epochs over at most FEW rows; more rows are passed over less often, LEAST times at least.
EPOCHS, FEW, LEAST = 10, 6000, 4
#: Of EPOCHS those with averaged responses, and how sharply these average at first and more with each of them.
SOFT, SHARP, SHARPER = 6, 1.0, 3.0
BATCH, RATE, DROP, DECAY = 16, 0.01, 0.5, 0.01
#: Buckets of labelled words are kept as this.
_KEPT = np.uint16 if BUCKETS <= 1 << 16 else np.int32
#: Bytes of text scored at a time; places of texts that are learned from at a time.
PIECE, BLOCK = 1 << 16, 1 << 16
#: Thresholds are of this grid.
GRID = np.linspace(0.02, 0.98, 97)

#: Filters in order of width; word j of a window has a row of filters for each filter of more than j words.
COLUMNS = np.concatenate([[0], np.cumsum([FILTERS * sum(w > j for w in WIDTHS) for j in range(max(WIDTHS))])])

#: Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z is lowered.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SEP = np.array([not (48 <= b <= 57 or 97 <= b <= 122 or b >= 128) for b in range(256)])


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each word's parts, and each text's bounds among the words."""
    data = _LOWER[data]
    starts, ends, bounds = hashing.word_spans(data, offs, _SEP)
    out = np.empty((len(starts), PARTS), np.int32)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    for k, cut in enumerate((None, *PREFIXES)):
        stop = ends if cut is None else np.minimum(ends, starts + cut)
        out[:, k] = hashing.mix(hashing.word_hashes(data, starts, stop) + np.uint64(k)) >> shift
    return out, bounds


@dataclass
class Model:
    embed: np.ndarray  # BUCKETS + 1 rows, the last of zeros
    filters: np.ndarray  # word j of a window: from column[j], for the filters of more than j words
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray
    thresholds: dict[str, float] = field(default_factory=dict)

    def pad(self, feats: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature rows with a gap behind every text, each text's first row and number of places."""
        n = np.diff(bounds)
        places = np.maximum(n, 1)
        first = np.concatenate([[0], np.cumsum(places + PAD)])
        rows = np.full((first[-1], PARTS), BUCKETS, np.int32)
        rows[np.repeat(first[:-1] - bounds[:-1], n) + np.arange(len(feats))] = feats
        return rows, first[:-1], places

    def responses(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' vectors, and each filter's response (a row) at each place."""
        x = self.embed[rows[:, 0]]
        for k in range(1, PARTS):
            x += self.embed[rows[:, k]]
        t = len(rows) - PAD
        out = self.filters[: COLUMNS[1] - COLUMNS[0]] @ x[:t].T
        for j in range(1, max(WIDTHS)):
            own = self.filters[COLUMNS[j] : COLUMNS[j + 1]] @ x[j : t + j].T
            out[-len(own) :] += own
        return x, out

    def logits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        feats, bounds = features(data, offs)
        rows, first, places = self.pad(feats, bounds)
        _, out = self.responses(rows)
        # rows of the gaps see only the end of one text and zeros, or the next text's start: leave them out
        edges = np.stack([first, first + places], 1).ravel()
        top = np.maximum.reduceat(out, edges[:-1], axis=1)[:, ::2].T
        return np.maximum(top + self.bias, 0) @ self.dense + self.offset

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        out = np.empty(len(offs) - 1)
        for i, j in common.groups(offs, PIECE):
            if j == i + 1 and offs[j] - offs[i] > 4 * PIECE:
                z = self.long_logit(data[offs[i] : offs[j]])
            else:
                z = self.logits(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            out[i:j] = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))
        return out

    def long_logit(self, text: np.ndarray) -> np.ndarray:
        """A long text in bounded memory: pieces of words that overlap by PAD, their largest responses."""
        feats, _ = features(text, np.array([0, len(text)], np.int64))
        top = None
        step = PIECE // 4
        for a in range(0, max(1, len(feats)), step):
            part = feats[a : a + step + PAD]
            rows, _, places = self.pad(part, np.array([0, len(part)], np.int64))
            m = self.responses(rows)[1][:, : max(1, min(step, places[0]))].max(1)
            top = m if top is None else np.maximum(top, m)
        return (np.maximum(top + self.bias, 0) @ self.dense + self.offset).reshape(1)


def _fresh(rng: np.random.Generator, base: float) -> Model:
    embed = rng.normal(0, 0.02, (BUCKETS + 1, DIM)).astype(np.float32)
    embed[-1] = 0
    f = FILTERS * len(WIDTHS)
    return Model(
        embed,
        rng.normal(0, 0.3, (COLUMNS[-1], DIM)).astype(np.float32),
        np.zeros(f, np.float32),
        rng.normal(0, 0.1, f).astype(np.float32),
        np.full(1, base, np.float32),
    )


class Adam:
    """Steps for the model's arrays; of the embeddings only for the rows that a batch has."""

    def __init__(self, model: Model):
        self.model, self.steps = model, 0
        self.m1 = {k: np.zeros_like(getattr(model, k)) for k in ("embed", "filters", "bias", "dense", "offset")}
        self.m2 = {k: np.zeros_like(v) for k, v in self.m1.items()}

    def step(self, grad: dict[str, np.ndarray], rows: np.ndarray, rate: float) -> None:
        self.steps += 1
        a, b = 1 - 0.9**self.steps, 1 - 0.999**self.steps
        for k, g in grad.items():
            at = rows if k == "embed" else slice(None)
            m1, m2, v = self.m1[k], self.m2[k], getattr(self.model, k)
            m1[at] += 0.1 * (g - m1[at])
            m2[at] += 0.001 * (g * g - m2[at])
            v[at] -= rate * (m1[at] / a) / (np.sqrt(m2[at] / b) + 1e-8)
            if k in ("embed", "filters"):
                v[at] *= 1 - rate * DECAY

    def copy(self) -> Adam:
        """Of its own arrays: a worker's tasks share what was broadcast."""
        other = Adam(Model(**{k: getattr(self.model, k).copy() for k in self.m1}))
        other.m1, other.m2 = ({k: v.copy() for k, v in m.items()} for m in (self.m1, self.m2))
        other.steps = self.steps
        return other


def gradient(model: Model, rows: np.ndarray, first: np.ndarray, places: np.ndarray, labels: np.ndarray, sharp: float | None) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Of the mean log loss, by array; that of the embeddings for the rows that are returned beside it.

    sharp: of averaged responses, whose weights are taken as given; None: of the largest ones. Texts are
    looked at in blocks of places, so that long ones take no more memory.
    """
    total, texts, ends = FILTERS * len(WIDTHS), len(first), first + places
    peak = np.full((total, texts), -np.inf, model.filters.dtype)
    mass, summed, place = np.zeros_like(peak), np.zeros_like(peak), np.zeros((texts, total), np.int64)

    def block(a: int, b: int) -> tuple[np.ndarray, np.ndarray, slice, np.ndarray, np.ndarray]:
        """Words' vectors and responses, the texts with places there, their first ones and numbers of them."""
        x, out = model.responses(rows[a : b + PAD])
        of = slice(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(first, b, "left")))
        start = np.maximum(first[of], a) - a
        return x, out, of, start, np.minimum(ends[of], b) - a - start

    def own(out: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Responses at the texts' places, the places, and each one's text."""
        at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return out[:, at], at, np.repeat(np.arange(len(n)), n)

    blocks = [(a, min(a + BLOCK, len(rows) - PAD)) for a in range(0, len(rows) - PAD, BLOCK)]
    kept = None
    for a, b in blocks:
        x, out, of, start, n = block(a, b)
        if not len(n):
            continue
        if sharp is None:
            best = np.stack([out[:, s : s + k].argmax(1) + s for s, k in zip(start, n, strict=True)])  # text x filter
            value = out[np.arange(total), best].T
            better = value > peak[:, of]
            peak[:, of] = np.where(better, value, peak[:, of])
            place[of] = np.where(better.T, best + a, place[of])
        else:
            mine, at, text = own(out, start, n)
            begin = np.cumsum(n) - n
            higher = np.maximum(peak[:, of], np.maximum.reduceat(mine, begin, axis=1))
            fade = np.exp(sharp * (peak[:, of] - higher))
            share = np.exp(sharp * (mine - higher[:, text]))
            mass[:, of] = mass[:, of] * fade + np.add.reduceat(share, begin, axis=1)
            summed[:, of] = summed[:, of] * fade + np.add.reduceat(share * mine, begin, axis=1)
            peak[:, of] = higher
            kept = (x, share, of, at, text) if len(blocks) == 1 else None
    pooled = peak.T if sharp is None else (summed / mass).T
    top = pooled + model.bias
    h = np.maximum(top, 0)
    p = 1 / (1 + np.exp(-np.clip(h @ model.dense + model.offset, -30, 30)))
    g = ((p - labels) / len(labels)).astype(np.float32)
    gh = g[:, None] * model.dense * (top > 0)
    grad = {"dense": h.T @ g, "offset": g.sum(keepdims=True), "bias": gh.sum(0), "filters": np.zeros_like(model.filters)}
    found = []
    if sharp is None:
        for part, column, j in _columns():
            taken = rows[place[:, part] + j]
            grad["filters"][column] = np.einsum("bfd,bf->fd", model.embed[taken].sum(2), gh[:, part])
            found.append(_by_bucket(taken.reshape(-1, PARTS), (gh[:, part, None] * model.filters[column][None]).reshape(-1, DIM)))
    else:
        for a, b in blocks:
            if kept is None:
                x, out, of, start, n = block(a, b)
                if not len(n):
                    continue
                mine, at, text = own(out, start, n)
                share = np.exp(sharp * (mine - peak[:, of][:, text]))
            else:
                x, share, of, at, text = kept
            spread = np.zeros_like(x)
            factor = gh.T[:, of] / mass[:, of]
            for part, column, j in _columns():
                weighted = share[part] * factor[part][:, text]
                grad["filters"][column] += weighted @ x[at + j]
                spread[at + j] += weighted.T @ model.filters[column]
            found.append(_by_bucket(rows[a : b + PAD], spread))
    grad["embed"], touched = found[0] if len(found) == 1 else _summed(np.concatenate([f[1] for f in found]), np.concatenate([f[0] for f in found]))
    return grad, touched


def _columns() -> Iterator[tuple[slice, slice, int]]:
    """Of each word of a window: the filters that have it, their rows in Model.filters, the word's number."""
    total = FILTERS * len(WIDTHS)
    for j in range(max(WIDTHS)):
        yield slice(total - (COLUMNS[j + 1] - COLUMNS[j]), total), slice(COLUMNS[j], COLUMNS[j + 1]), j


def _by_bucket(taken: np.ndarray, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the words' gradients for each bucket of their parts."""
    word, part = np.nonzero(taken != BUCKETS)
    return _summed(taken[word, part], of_word, word)


def _summed(bucket: np.ndarray, values: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(bucket, kind="stable")
    begin = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    rows = values[order if at is None else at[order]]
    return np.add.reduceat(rows, begin, axis=0) if len(begin) else np.zeros((0, DIM), np.float32), bucket[order][begin]


def _soft(passes: int) -> int:
    """Of so many passes those with averaged responses."""
    return passes * SOFT // EPOCHS


class Texts:
    """Labelled texts that are learned from in this process."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, labels: np.ndarray, langs: list[str], valid: np.ndarray):
        self.data, self.offs, self.labels, self.langs, self.valid = data, offs, labels, langs, valid
        self.own = np.flatnonzero(~valid)
        self.n, self.positive, self.most = len(self.own), int(labels[self.own].sum()), len(self.own)
        self.judged = bool(valid.any())

    @cached_property
    def feats(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the rows that set the weights."""
        feats, bounds = [np.zeros((0, PARTS), _KEPT)], [np.zeros(1, np.int64)]
        ends = np.concatenate([[0], np.cumsum(np.diff(self.offs)[self.own])])
        for i, j in common.groups(ends, 1 << 20):  # bounded memory
            f, b = features(*_take(self.data, self.offs, self.own[i:j]))
            feats.append(f.astype(_KEPT))
            bounds.append(bounds[-1][-1] + b[1:])
        out = np.empty((int(bounds[-1][-1]), PARTS), _KEPT)
        feats.reverse()
        at = 0
        while feats:  # pieces go as they are copied
            f = feats.pop()
            out[at : at + len(f)] = f
            at += len(f)
        common.give_back(True)
        return out, np.concatenate(bounds)

    def step(self, adam: Adam, epoch: int, passes: int, rng: np.random.Generator) -> np.ndarray:
        """Passes over the rows once; returned is how often each embedding was stepped."""
        feats, bounds = self.feats
        times, soft = np.zeros(BUCKETS + 1, np.int64), _soft(passes)
        order = rng.permutation(self.n)
        for b in range(0, self.n, BATCH):
            ids = order[b : b + BATCH]
            f = np.concatenate([feats[bounds[i] : bounds[i + 1]] for i in ids])
            rows, first, places = adam.model.pad(f, np.concatenate([[0], np.cumsum([bounds[i + 1] - bounds[i] for i in ids])]))
            rows = np.where(rng.random(rows.shape, np.float32) < DROP, np.int32(BUCKETS), rows)
            sharp = SHARP * SHARPER ** (SOFT * (epoch + b / self.n) // soft) if epoch < soft else None
            grad, touched = gradient(adam.model, rows, first, places, self.labels[self.own[ids]], sharp)
            adam.step(grad, touched, RATE * (1 - 0.9 * (epoch * self.n + b) / (passes * self.n)))
            times[touched] += 1
        return times

    def scores(self, model: Model, judged: bool) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Scores, labels and languages of the rows that judge, or of all others."""
        rows = np.flatnonzero(self.valid) if judged else self.own
        return model.scores(*_take(self.data, self.offs, rows)), self.labels[rows], [self.langs[i] for i in rows]

    def loss(self, model: Model) -> float:
        s, y, _ = self.scores(model, self.judged)
        return _loss(s, y) / max(1, len(y))

    def wrong(self, model: Model) -> np.ndarray:
        return _counts(*self.scores(model, self.judged)[:2])

    def cuts(self, model: Model) -> dict[str, float]:
        s, y, langs = self.scores(model, self.judged)
        names, of = np.unique(np.array(langs, object), return_inverse=True) if langs else ([], None)
        return {lang: best_cut(s[of == k], y[of == k]) for k, lang in enumerate(names)}


def _loss(scores: np.ndarray, labels: np.ndarray) -> float:
    s = np.clip(scores, 1e-6, 1 - 1e-6)
    return float(-(labels * np.log(s) + (1 - labels) * np.log(1 - s)).sum())


def learn(on: Texts | Shards, seed: int = 1) -> Model:
    """Adam on the log loss of the rows that set the weights; of the later epochs' models that with the least
    loss on the rows that judge (without such rows, on all) stays, and thresholds are set there."""
    rng = np.random.default_rng(seed)
    rate = (on.positive + 0.5) / (on.n + 1)
    model = _fresh(rng, float(np.log(rate / (1 - rate))))
    if on.positive in (0, on.n):  # nothing tells the classes apart: the base rate
        model.dense[:] = 0
        return model
    passes = min(EPOCHS, max(LEAST, EPOCHS * FEW // on.n))
    adam, best = Adam(model), (np.inf, {})
    for epoch in range(passes):
        on.step(adam, epoch, passes, rng)
        if epoch >= _soft(passes):
            loss = on.loss(model)
            if loss < best[0]:
                best = (loss, {k: getattr(model, k).copy() for k in adam.m1})
    for k, v in best[1].items():
        setattr(model, k, v)
    cut = _least_wrong(on.wrong(model))
    model.offset = model.offset - np.float32(np.log(cut / (1 - cut)))
    model.thresholds = on.cuts(model)
    return model


def train(texts: list[bytes], labels: np.ndarray, langs: list[str], valid: np.ndarray, seed: int = 1) -> Model:
    """Learns from texts in memory; the rows in valid judge."""
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return learn(Texts(np.frombuffer(b"".join(texts), np.uint8), offs, labels, langs, valid), seed)


def _take(data: np.ndarray, offs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = np.concatenate([data[offs[i] : offs[i + 1]] for i in rows]) if len(rows) else data[:0]
    return out, np.concatenate([[0], np.cumsum([offs[i + 1] - offs[i] for i in rows])]).astype(np.int64)


def _counts(scores: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Rows by how many values of GRID their score reaches, and by label."""
    at = np.searchsorted(GRID, scores, "right") * 2 + (labels == 1)
    return np.bincount(at, minlength=2 * len(GRID) + 2).reshape(-1, 2)


def _least_wrong(counts: np.ndarray) -> float:
    reached = counts[::-1].cumsum(0)[::-1][1:]  # rows that reach each value
    cost = reached[:, 0] + (counts[:, 1].sum() - reached[:, 1]) + np.abs(np.log(GRID / (1 - GRID)))
    return float(GRID[int(np.argmin(np.round(cost, 9)))])


def best_cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """The threshold with the fewest wrong rows, where its distance from 0.5, in units of log odds, counts
    like wrong rows: the fewer rows, the nearer to 0.5. The middle of the range of best ones, 0.02 to 0.98."""
    return _least_wrong(_counts(scores, labels))


#: Rows of the embeddings in one block of a model that is sent.
SENT = 1 << 11
_REST = ("filters", "bias", "dense", "offset")


def _blocks(adam: Adam) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The model and Adam's two averages, cut up: blocks of embeddings, and all other arrays as one row (-1)."""
    of = (vars(adam.model), adam.m1, adam.m2)
    for k in range(0, BUCKETS + 1, SENT):
        yield k // SENT, [v["embed"][k : k + SENT] for v in of]
    yield -1, [np.concatenate([v[name].ravel() for name in _REST])[None] for v in of]


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of block and shard: each block's mean, weighted by times stepped."""
    now, total, summed = None, None, None

    def done() -> pa.RecordBatch:
        mean = summed / np.maximum(total, 1)[None, :, None]
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([mean.astype(np.float32).tobytes()], pa.binary())], names=["block", "times", "data"])

    for batch in batches:
        for block, times, data in zip(batch.column("block").to_pylist(), batch.column("times"), batch.column("data"), strict=True):
            n = np.frombuffer(times.as_buffer(), np.int64)
            v = np.frombuffer(data.as_buffer(), np.float32).reshape(3, len(n), -1)
            if block != now:
                if now is not None:
                    yield done()
                now, total, summed = block, np.zeros(len(n), np.int64), np.zeros(v.shape)
            total += n
            summed += v * n[None, :, None].astype(np.float64)
    if now is not None:
        yield done()


def _read(base: str, name: str) -> Texts:
    table = pa.ipc.open_file(pa.BufferReader(Store(base).whole(name))).read_all().combine_chunks()
    data, offs = common.flat(table["text"])
    return Texts(data, offs, table["toxic"].to_numpy(), table["lang"].to_pylist(), table["valid"].to_numpy())


def _packer(base: str):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Writes a shard's rows, in order of doc_id, as a file. A repeated attempt writes another one."""
        table = table.combine_chunks().sort_by("doc_id")
        valid = hashing.mix(table["doc_id"].to_numpy().astype(np.uint64)) % np.uint64(5) == 0
        y = table["toxic"].to_numpy()
        text, lang = (pc.fill_null(table[c], "") for c in ("text", "lang"))
        rows = pa.table({"text": text, "lang": lang, "toxic": y, "valid": valid})
        shard = key[0].as_py()
        name = f"shard-{shard:06d}-{TaskContext.get().taskAttemptId()}.arrow"
        with Store(base).write(name) as out, pa.ipc.new_file(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(rows)
        return pa.table({"shard": pa.array([shard], pa.int64()), "name": [name], "n": pa.array([int((~valid).sum())], pa.int64()), "positive": pa.array([int(y[~valid].sum())], pa.int64()), "judging": pa.array([int(valid.sum())], pa.int64())})

    return run


class Shards:
    """Labelled texts in files of the shared folder; each one's task learns or counts, one job an epoch."""

    def __init__(self, spark: SparkSession, base: str, files: list, seed: int = 1):
        self.spark, self.base, self.seed = spark, base, seed
        self.names = [r["name"] for r in files]
        self.n, self.positive, self.most = sum(r["n"] for r in files), sum(r["positive"] for r in files), max(r["n"] for r in files)
        self.judged = any(r["judging"] for r in files)

    def _each(self, what, schema: str, shared) -> DataFrame:
        """what(number of the shard, its texts, the broadcast value) of every shard: Arrow tables."""
        base, names = self.base, self.names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    yield from what(k, _read(base, names[k]), shared.value).to_batches()

        return self.spark.range(0, len(names), 1, len(names)).mapInArrow(common.frugal(run), schema)

    def step(self, adam: Adam, epoch: int, passes: int, rng: np.random.Generator) -> None:
        shared, seed = self.spark.sparkContext.broadcast(adam), self.seed

        def one(k: int, texts: Texts, start: Adam) -> pa.Table:
            mine = start.copy()
            times = texts.step(mine, epoch, passes, np.random.default_rng([seed, epoch, k]))
            steps = np.array([mine.steps - start.steps], np.int64)
            rows = [(b, k, (times[b * SENT : (b + 1) * SENT] if b >= 0 else steps).tobytes(), np.stack(v).tobytes()) for b, v in _blocks(mine)]
            return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "shard", "times", "data"])

        sent = self._each(one, "block int, shard int, times binary, data binary", shared)
        parts = min(common.parts(self.spark), BUCKETS // SENT + 2)
        got = sent.repartition(parts, "block").sortWithinPartitions("block", "shard").mapInArrow(common.frugal(_averaged), "block int, times binary, data binary").collect()
        shared.unpersist()
        of = (vars(adam.model), adam.m1, adam.m2)
        for r in got:
            stepped = np.frombuffer(r["times"], np.int64) > 0
            v = np.frombuffer(r["data"], np.float32).reshape(3, len(stepped), -1)
            for arrays, new in zip(of, v, strict=True):
                if r["block"] >= 0:
                    arrays["embed"][r["block"] * SENT :][: len(stepped)][stepped] = new[stepped]
                else:
                    cuts = np.cumsum([arrays[name].size for name in _REST])[:-1]
                    for name, part in zip(_REST, np.split(new[0], cuts), strict=True):
                        arrays[name][...] = part.reshape(arrays[name].shape)
        adam.steps += -(-self.most // BATCH)

    def _judge(self, model: Model, what, schema: str) -> DataFrame:
        judged = self.judged
        return self._each(lambda k, texts, m: what(k, *texts.scores(m, judged)), schema, self.spark.sparkContext.broadcast(model))

    def loss(self, model: Model) -> float:
        got = self._judge(model, lambda k, s, y, _: pa.table({"loss": [_loss(s, y)], "n": pa.array([len(y)], pa.int64())}), "loss double, n long").collect()
        return math.fsum(r["loss"] for r in got) / max(1, sum(r["n"] for r in got))

    def wrong(self, model: Model) -> np.ndarray:
        got = self._judge(model, lambda k, s, y, _: pa.table({"counts": pa.array([_counts(s, y).tobytes()], pa.binary())}), "counts binary").collect()
        return sum(np.frombuffer(r["counts"], np.int64) for r in got).reshape(-1, 2)

    def cuts(self, model: Model) -> dict[str, float]:
        """One row a language comes to the driver, of those with another threshold than 0.5."""

        def by_language(k: int, s: np.ndarray, y: np.ndarray, langs: list[str]) -> pa.Table:
            t = pa.table({"lang": pa.array(langs, pa.string()), "cell": pa.array(np.searchsorted(GRID, s, "right"), pa.int64()), "label": pa.array((y == 1).astype(np.int64))})
            t = t.group_by(["lang", "cell", "label"]).aggregate([([], "count_all")])
            return t.select(["lang", "cell", "label", "count_all"]).rename_columns(["lang", "cell", "label", "n"])

        def cut(key: tuple, t: pa.Table) -> pa.Table:
            counts = np.zeros((len(GRID) + 1, 2), np.int64)
            np.add.at(counts, (t["cell"].to_numpy(), t["label"].to_numpy()), t["n"].to_numpy())
            return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "cut": [_least_wrong(counts)]})

        counts = self._judge(model, by_language, "lang string, cell long, label long, n long").groupBy("lang", "cell", "label").agg(F.sum("n").alias("n"))
        return {r["lang"]: r["cut"] for r in counts.groupBy("lang").applyInArrow(cut, "lang string, cut double").where("cut <> 0.5").collect()}


#: Bits for each label in a map of ids, and of the map in all.
MAP_BITS, MOST_BITS = 16, 1 << 27


def _marked(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of docs whose id may be one of known's: all that are, and few others, so that few texts travel.
    Told by a map of hashed ids in at most 16 MB; where that is crowded, more others pass."""
    bits = min(MOST_BITS, max(1 << 15, MAP_BITS * known.count()))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    block, at = F.floor(bit / (1 << 15)).alias("block"), (bit % (1 << 15)).alias("at")
    maps = known.select(block, at).groupBy("block").agg(F.expr("bitmap_construct_agg(at)").alias("map"))
    byte = F.conv(F.hex(F.expr("substring(map, CAST(at DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    found = docs.select("*", block, at).join(F.broadcast(maps), "block")
    return found.where(byte.bitwiseAND(F.expr("shiftleft(1, CAST(at % 8 AS INT))")) != 0).select(docs.columns)


def fit(docs: DataFrame, labels: DataFrame, most: int = SHARD_BYTES) -> Model:
    """Learns from all rows whose crc32(doc_id as text) mod 5 is not 0, in shards of about most bytes.

    Rows with a null id or label are left out; of several labels of a document the largest counts, of
    several texts of one doc_id the least. With no label, or one class only, every text gets the base rate.
    """
    spark = docs.sparkSession
    allowed = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    known = common.slim(labels, "doc_id", "toxic").where(allowed & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("double").alias("toxic"))
    with_lang = docs.withColumn("lang", F.lit(None).cast("string")) if "lang" not in docs.columns else docs
    texts = _marked(common.slim(with_lang, "doc_id", "text", "lang").where(allowed), known)
    sizes = texts.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), F.lit(None).cast("double").alias("toxic"))
    sizes = sizes.unionByName(known.select("doc_id", F.lit(None).cast("long").alias("size"), "toxic")).groupBy("doc_id").agg(F.max("size").alias("size"), F.max("toxic").alias("toxic"))
    n, size = sizes.where("size IS NOT NULL AND toxic IS NOT NULL").agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not n:
        return train([], np.zeros(0), [], np.zeros(0, bool))
    shards = max(1, min(n, -(-size // most)))
    common.ship(spark)
    base = common.fresh_path(spark, "toxicity")
    # one exchange, of texts that may have labels and of labels: a shard's rows meet where they are made single and written
    one = F.when(F.col("toxic").isNull(), F.struct("text", "lang"))
    both = texts.withColumn("toxic", F.lit(None).cast("double")).unionByName(known.select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), "toxic"))
    dealt = both.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).repartition(shards, "shard")
    single = dealt.groupBy("shard", "doc_id").agg((F.max("toxic") != 0).cast("double").alias("toxic"), F.min(one).alias("one")).where("toxic IS NOT NULL AND one IS NOT NULL").select("shard", "doc_id", "toxic", "one.text", "one.lang")
    files = single.groupBy("shard").applyInArrow(common.frugal(_packer(base)), "shard long, name string, n long, positive long, judging long").collect()
    files.sort(key=lambda r: r["shard"])
    model = learn(_read(base, files[0]["name"]) if len(files) == 1 else Shards(spark, base, files))
    common.remove(spark, base)
    return model


SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("lang", pa.string()), ("threshold", pa.float64())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, lang, threshold (its language's) and flagged (score >= threshold) of every row.

    Null and empty texts are scored as texts without words. Rows keep their (null, repeated) ids.
    """
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = common.flat(batch.column(1))
            cut = [shared.value.thresholds.get(x or "", 0.5) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(data, offs)), batch.column(2), pa.array(cut, pa.float64())], schema=SCHEMA)

    with_lang = docs.withColumn("lang", F.lit(None).cast("string")) if "lang" not in docs.columns else docs
    out = common.slim(with_lang, "doc_id", "text", "lang").mapInArrow(common.frugal(run), "doc_id long, score double, lang string, threshold double")
    return out.withColumn("flagged", F.col("score") >= F.col("threshold"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose text is flagged; all columns stay."""
    model = fit(docs, labels)
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = common.flat(batch.column(batch.schema.get_field_index("text")))
            s = shared.value.scores(data, offs)
            at = batch.schema.get_field_index("lang")
            langs = batch.column(at).to_pylist() if at >= 0 else [None] * len(s)
            cut = np.array([shared.value.thresholds.get(x or "", 0.5) for x in langs])
            yield batch.filter(pa.array(s < cut))

    return docs.mapInArrow(common.frugal(run), docs.schema)


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """held_out of a null doc_id is false: it has no label to learn from."""
    out = score(docs, fit(docs, labels))
    return out.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "threshold",
        "flagged",
    )
