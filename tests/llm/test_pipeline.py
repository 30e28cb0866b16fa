"""Every stage of the pipeline against a plain version, on the smallest tables and odd rows."""

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from regionlake.llm import decontaminate, toxicity
from tests.llm.test_kernels import plain_hits, plain_logit
from tests.llm.test_spark import LONG, plain_targets

STAGES = dict(corpus_pipeline.STAGES)
MORE = "same int, id long, root string, key string, rest string, _later long, part int, blob binary, own long, runs int, hit int"


@pytest.fixture(scope="module")
def docs(spark):
    """The documents, and null, empty, blank, long, repeated and near rows; further columns whose names the
    operators use themselves."""
    odd = spark.createDataFrame([(None, LONG, "en", "a", 1), (100001, None, "en", "a", 0), (100002, "", None, None, 0), (100003, " \t", "en", None, 2), (100004, LONG + "end", "de", "b", 1), (100005, LONG, "en", "a", 1), (100006, "ab " * 30000, "fr", "c", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    base = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = base.unionByName(odd).unionByName(base.where("doc_id < 5"))
    return rows.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in MORE.split(", ")])


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def key(r):
    return (-(2**62) if r["doc_id"] is None else r["doc_id"], r["text"] or "", r["lang"] or "", r["source"] or "", str(r["n_chars"]), r["text"] is None)


def same_rows(got, want):
    assert sorted(map(key, got)) == sorted(map(key, want))


def words(r):
    return (r["text"] or "").encode().split()


def test_toxicity(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.fit(docs, labels)
    want = []
    for r in rows_of(docs):
        if len(r["text"] or "") > 3000:  # by the operator's own kernel: word by word is slow
            raw = r["text"].encode()
            s = model.scores(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        else:
            s = 1 / (1 + np.exp(-plain_logit(model, (r["text"] or "").encode())))
        cut = model.thresholds.get(r["lang"] or "", 0.5)
        assert abs(s - cut) > 1e-5
        if s < cut:
            want.append(r)
    got = STAGES["toxicity"](spark, docs, DATA)
    assert got.columns == docs.columns and 0 < len(want) < docs.count()
    same_rows(rows_of(got), want)


def test_near_duplicates(spark, docs):
    rows = rows_of(docs)
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(r)) else None for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                root[top(i)] = top(j)
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(top(i), []).append(rows[i])
    want = [min(own, key=key) for own in classes.values()]
    got = STAGES["near_duplicates"](spark, docs, DATA)
    assert got.columns == docs.columns and len(want) < len(rows)
    same_rows(rows_of(got), want)


def test_repeated_passages(spark, docs):
    rows = sorted(rows_of(docs), key=key)
    first, want = {}, []
    for r in rows:
        w = words(r)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), key(r)[0])
    for r in rows:
        w = words(r)
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < key(r)[0]:
                gone[i : i + 13] = True
        if gone.any():
            text = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
            r = r | {"text": text, "n_chars": len(text)}
            if not text:
                continue
        want.append(r)
    got = STAGES["repeated_passages"](spark, docs, DATA)
    assert got.columns == docs.columns and len(want) < len(rows)
    same_rows(rows_of(got), want)


def test_decontamination(spark, docs):
    items = [(r["item_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    windows = {w for _, t in items for q in [decontaminate.normal_words(t)] for i in range(max(1, len(q) - 9)) if (w := tuple(q[i : i + 10]))}
    sizes = {len(w) for w in windows}
    rows, want = rows_of(docs), []
    for r in rows:
        w = decontaminate.normal_words((r["text"] or "").encode())
        if not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1)):
            want.append(r)
    assert plain_hits(items[:1], items[0][1], 10)[2] == [items[0][0]]
    got = STAGES["decontamination"](spark, docs, DATA)
    assert got.columns == docs.columns and 0 < len(want) < len(rows)
    same_rows(rows_of(got), want)


def test_mixing(spark, docs):
    rows, sizes = rows_of(docs), {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r))
    want = plain_targets(sizes)
    got = rows_of(STAGES["mixing"](spark, docs, DATA))
    assert sorted((str(r["doc_id"]), str(r["source"]), len(words(r))) for r in rows) == sorted((str(r["doc_id"]), str(r["source"]), r["size"]) for r in got)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    for s, target in want.items():
        rest = round(target - target // sizes[s] * sizes[s]) if sizes[s] and target // sizes[s] < 3 else 0
        sums = 1
        for r in rows:
            sums |= sums << len(words(r)) if r["source"] == s else 0
        best = next(k for k in range(rest + 1) if sums >> rest + k & 1 or sums >> rest - k & 1)
        assert abs(taken[s] - target) <= best + 0.5, s


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_tables(spark, docs, name):
    assert STAGES[name](spark, docs.where("doc_id = -1"), DATA).count() == 0
