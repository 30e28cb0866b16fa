"""Operators' cores against brute force, without Spark."""

import hashlib
import random
import re
import tracemalloc
from collections import defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from regionlake.llm import common, dartminhash, decontaminate, hashing, html_text, mixing, pq, queries, repeats, suffix_array, suffix_tree, tokens, toxicity, warc


def brute_bytes(docs):
    seen, out = set(), []
    for d, t in sorted(docs):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - 99):
            w = t[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def brute_words(docs):
    first, out = {}, []
    for d, t in sorted(docs):
        w = t.split()
        for s in range(len(w) - 12):
            first.setdefault(tuple(w[s : s + 13]), d)
    for d, t in sorted(docs):
        w = t.split()
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - 12):
            if first[tuple(w[s : s + 13])] < d:
                gone[s : s + 13] = True
        out.append((d, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


def staged(docs, kind, solver, row, schema, n=3, batch=4):
    """The stages of repeats.find by hand."""

    def emit(store, found):
        t = pa.Table.from_batches([found]) if isinstance(found, pa.RecordBatch) else found
        for p, b in zip(t.column("part").to_pylist(), t.column("blob").to_pylist(), strict=True):
            store[p].append(b)

    blobs = lambda p, own: pa.table({"part": pa.array([p] * len(own), pa.int32()), "blob": pa.array(own, pa.binary())})
    texts = lambda x: pa.table({"doc_id": pa.array([d for d, _ in x], pa.int64()), "text": pa.array([t for _, t in x], pa.binary())})
    s1, s2, s3, homes = (defaultdict(list) for _ in range(4))
    to = repeats.slots(n, 2)
    for half in (docs[::2], docs[1::2]):
        bs = [texts(half[i : i + batch]).to_batches()[0] for i in range(0, len(half), batch)]
        for found in repeats.first_pass(kind, to)(iter(bs)):
            emit(s1, found)
    for p, own in s1.items():
        emit(s2, repeats.meet(kind, to)(blobs(p, own)))
    for d, t in docs:
        homes[int(repeats.home(np.array([d]), repeats.text_hashes(t, np.array([0, len(t)])), to)[0])].append((d, t))
    for p, own in homes.items():
        emit(s3, repeats.cut_out(kind, to)(texts(own), blobs(p, [b for b in s2[p] if b[:1] == b"W"])))
    for p, own in s3.items():
        emit(s2, repeats.solve(kind, to, solver)(blobs(p, own)))
    out = []
    for p, own in homes.items():
        out += repeats.finish(kind, row, schema, False)(texts(own), blobs(p, [b for b in s2[p] if b[:1] == b"S"])).to_pylist()
    return sorted(tuple(v for k, v in r.items() if k != "kept") for r in out)


def corpus(seed):
    random.seed(seed)
    vocab = [f"w{random.randrange(10**6)}" for _ in range(random.choice([3, 30, 2000]))]
    base = [" ".join(random.choices(vocab, k=random.randrange(1, 300))) for _ in range(6)]
    docs = []
    for d in range(30):
        k, a, b = random.random(), random.choice(base), random.choice(base)
        i = random.randrange(len(a) + 1)
        t = a if k < 0.2 else b[: random.randrange(len(b) + 1)] + a[i : i + 400] + b[:200] if k < 0.6 else "a" * random.randrange(400) if k < 0.7 else "the cat sat on mats. " * random.randrange(40) if k < 0.8 else "" if k < 0.85 else " ".join(random.choices(vocab, k=100))
        docs.append((d * 7 % 101, t.encode()))
    random.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", range(12))
def test_repeats(seed, monkeypatch):
    docs = corpus(seed)
    monkeypatch.setattr(repeats, "WIDE", 0 if seed % 4 == 3 else 2048)
    monkeypatch.setattr(suffix_array, "BUCKET", 300 if seed % 2 else 1 << 19)
    monkeypatch.setattr(suffix_tree, "GROUP", 50)

    def by_bytes(text, first, count):
        removed, runs, kept = suffix_array.kept_bytes(text, first, count)
        return len(text), removed, runs, hashlib.sha256(kept).hexdigest(), None

    def by_words(text, first, count):
        n, removed, kept = suffix_tree.kept_words(text, first, count)
        return n, removed, hashlib.sha256(kept).hexdigest(), None

    assert staged(docs, repeats.BYTES, suffix_array.repeated, by_bytes, suffix_array.SCHEMA) == brute_bytes(docs)
    assert staged(docs, repeats.WORDS, suffix_tree.repeated, by_words, suffix_tree.SCHEMA) == brute_words(docs)


def complement(n):
    """Two words of n letters that hashes of sums of powers cannot tell apart: Thue-Morse and its complement."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [8, 16, 32, 64, 1024, 2048, 4096])
def test_regular_structure_does_not_collide(n):
    a, b = (x.encode() for x in complement(n))
    data = np.frombuffer(a + b, np.uint8)
    h = hashing.word_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
    assert h[0] != h[1]
    v = np.array([5, 9], np.uint64)[data - 97]
    for k in {min(8, n), min(16, n), min(32, n), n}:
        assert hashing.grams_of(data[:n], k)[0] != hashing.grams_of(data[n:], k)[0] and hashing.grams_of(v[:n], k)[0] != hashing.grams_of(v[n:], k)[0]
    few = " ".join(f"w{i}" for i in range(10))
    docs = [(1, f"{few} {a.decode()} {few}".encode()), (2, f"{few} {b.decode()} {few}".encode())]

    def by_words(text, first, count):
        m, removed, kept = suffix_tree.kept_words(text, first, count)
        return m, removed, hashlib.sha256(kept).hexdigest(), None

    assert staged(docs, repeats.WORDS, suffix_tree.repeated, by_words, suffix_tree.SCHEMA) == brute_words(docs)
    sets, bounds, same = dartminhash.shingles(np.frombuffer(docs[0][1] + docs[1][1], np.uint8), np.array([0, len(docs[0][1]), 2 * len(docs[0][1])]))
    assert not np.array_equal(sets[: bounds[1]], sets[bounds[1] :]) and (same[0] != same[1]).any()


def test_grams_and_spans_are_of_their_values_only():
    rng = np.random.default_rng(0)
    for v in (rng.integers(0, 3, 400).astype(np.uint8), rng.integers(0, 3, 400).astype(np.uint64)):
        for k in (1, 5, 8, 13, 32, 72):
            h = hashing.grams_of(v, k)
            by = defaultdict(set)
            for i in range(len(v) - k + 1):
                by[v[i : i + k].tobytes()].add(int(h[i]))
            assert all(len(x) == 1 for x in by.values()) and len({x for s in by.values() for x in s}) == len(by)
            assert np.array_equal(hashing.gram_hashes(v, k), h)


def test_difference_cover():
    d = suffix_array.difference_cover(64)
    assert {(int(a) - int(b)) % 64 for a in d for b in d} == set(range(64))
    shift, inside = suffix_array.cover_shifts(64, d), set(d.tolist())
    assert all((i + shift[i, j]) % 64 in inside and (j + shift[i, j]) % 64 in inside for i in range(64) for j in range(64))


def test_subtree_nodes_are_repeats():
    v = np.array([1, 2, 3, 1, 2, 3, 1, 2, 9], np.uint64)
    t = suffix_tree.build(v, np.arange(9), np.full(9, 9), 3)
    found = {(tuple(v[t.leaves[a] : t.leaves[a] + n].tolist()), b - a) for a, b, n in zip(t.lo, t.hi, t.depth, strict=True)}
    assert ((1, 2), 3) in found and ((1, 2, 3), 2) in found


@pytest.mark.parametrize("long", [False, True])
def test_word_spans(long):
    texts = ["a b", "", "  c\t", None, "dé é", "x"] * (3000 if long else 1)
    data, offs = __import__("regionlake.llm.common", fromlist=["flat"]).flat(pa.array(texts))
    s, e, b = hashing.word_spans(data, offs)
    raw = data.tobytes()
    got = [[raw[s[k] : e[k]].decode() for k in range(b[i], b[i + 1])] for i in range(len(texts))]
    assert got == [(t or "").split() for t in texts]
    h = hashing.word_hashes(data, s, e)
    assert len({(x, y) for x, y in zip(h.tolist(), [w for g in got for w in g], strict=True)}) == len(set(h.tolist())) == len({w for g in got for w in g})


def plain_hits(items, text, size):
    """Every window of every item at every place."""
    w = decontaminate.normal_words(text)
    want, which = np.zeros(len(w), bool), set()
    for i, t in items:
        q = decontaminate.normal_words(t)
        m = min(size, len(q))
        for a in range(len(q) - m + 1 if q else 0):
            for b in range(len(w) - m + 1):
                if w[b : b + m] == q[a : a + m]:
                    want[b : b + m] = True
                    which.add(i)
    return len(w), want.tolist(), sorted(which)


@pytest.mark.parametrize("n", [1, 2, 4, 5, 10])
def test_automaton_against_windows(n, monkeypatch):
    rng = random.Random(2)
    words = ["ab", "c", "dé", "e1"]
    for k in range(150):
        monkeypatch.setattr(decontaminate, "PIECE", 5 if k % 2 else 1 << 16)
        items = [(i % 4, " ".join(rng.choices(words, k=rng.randrange(0, 3 * n))).encode()) for i in range(6)]
        texts = [", ".join(rng.choices(words, k=rng.randrange(0, 25))).upper().replace("É", "é").encode() for _ in range(3)]
        texts.append(b"x " + items[1][1] + b" -- " + items[2][1])
        automaton = decontaminate.build(items, n)
        for text in texts:
            m, hit, own = decontaminate.scan(text, automaton)
            assert (m, hit.tolist(), own) == plain_hits(items, text, n)
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        data = decontaminate._NORMAL[np.frombuffer(b"".join(texts), np.uint8)]
        _, _, bounds, hit, found = automaton.scan(data, offs)  # windows do not cross texts
        for i, text in enumerate(texts):
            assert (hit[bounds[i] : bounds[i + 1]].tolist(), sorted(found.get(i, ()))) == plain_hits(items, text, n)[1:]


def test_spans_point_into_the_original():
    text = "Ünter THE  cat-sat, on a mat!".encode()
    data = np.frombuffer(text, np.uint8)
    starts, ends, _, hit, _ = decontaminate.build([(1, b"the cat sat on")], 10).scan(decontaminate._NORMAL[data], np.array([0, len(data)]))
    (span,) = decontaminate.original_spans(data, starts, ends, hit)
    assert text.decode()[span["begin"] : span["end"]] == "THE  cat-sat, on"


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    e = hashing.mix(np.arange(300, dtype=np.uint64))
    a, b = np.arange(0, 220), np.arange(60, 300)
    w = rng.choice([0.3, 1, 2.5, 7], 300)
    for wa, wb in ((None, None), (w[a], (w * rng.choice([1, 0.5], 300))[b])):
        x, y = np.zeros(300), np.zeros(300)
        x[a], y[b] = (1, 1) if wa is None else (wa, wb)
        sa = dartminhash.signatures(e[a], np.array([0, len(a)]), 4000, wa)
        sb = dartminhash.signatures(e[b], np.array([0, len(b)]), 4000, wb)
        assert abs((sa == sb).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.04


@pytest.mark.parametrize("seed", range(6))
def test_candidates_lose_no_pair(seed):
    """Sets around a common text: all pairs of the similarity are candidates, few others are."""
    rng = np.random.default_rng(seed)
    common_part = rng.integers(0, 2**60, 60).astype(np.uint64)
    sets = []
    for _ in range(120):
        if sets and rng.random() < 0.4:  # near another one
            own = sets[rng.integers(len(sets))].copy()
            own[rng.random(len(own)) < rng.choice([0.02, 0.1, 0.15])] = rng.integers(0, 2**60)
        else:
            own = np.concatenate([common_part[: rng.integers(0, 61)], rng.integers(0, 2**60, rng.integers(1, 50)).astype(np.uint64)])
        sets.append(np.unique(own))
    rows = rng.permutation(120)
    for left, right in ((rows[:50], rows[50:]), (rows, rows)):
        i, j = dartminhash.candidates(sets, left, right if right is not rows else left, 0.8)
        got = {frozenset(x) for x in zip(i.tolist(), j.tolist(), strict=True)}
        want = {frozenset((int(x), int(y))) for x in left for y in right if x != y and dartminhash.jaccard(sets[x], sets[y]) >= 0.8}
        assert want <= got and len(want) > 5 and len(got) < len(left) * len(right) / 4


def test_knapsack_is_best(monkeypatch):
    rng = random.Random(0)
    for _ in range(150):
        n = np.array(sorted(rng.sample(range(0, 40), rng.randrange(1, 6))))
        c = np.array([rng.randrange(1, 4) for _ in n])
        budget = rng.randrange(0, 150)
        take = mixing.fit_budget(n, c, budget, 3)
        near = min((abs(s - budget), s) for s in (sum(a * k for a, k in zip(n, ks, strict=True)) for ks in product(*[range(x + 1) for x in c])))
        assert (take >= 0).all() and (take <= c).all() and (abs((take * n).sum() - budget), (take * n).sum()) == near
    assert mixing.fit_budget(np.array([100]), np.array([1]), 90, 3).tolist() == [1]
    assert mixing.fit_budget(np.array([100]), np.array([1]), 49, 3).tolist() == [0]


def test_targets_cap_and_reshare():
    assert mixing.targets({"a": 10, "b": 100, "c": 5, None: 7}) == {"a": 30.0, "b": 56.0, "c": 15.0, None: 21.0}
    assert mixing.targets({}) == {}
    assert mixing.targets({"a": 0, "b": 4}) == {"a": 0.0, "b": 4.0}


def test_counts_equal_the_tokenizer(monkeypatch):
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.VOCABULARY)
    vocabulary = [(f"{i}" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.vocab_size())]
    whole = Tokenizer(Unigram(vocabulary, 0, True))
    counter = tokens.Counter(tokens.load(queries.VOCABULARY))
    rng = random.Random(1)
    texts = ["", " ", "  ", "a ", " a", "a  b", "a   ", "\n", "▁", "日本語 text é", "\U0001f600 x"] + ["".join(rng.choice("ab thein\n é日") for _ in range(rng.randrange(40))) for _ in range(800)]
    for piece in (7, 1 << 20):
        monkeypatch.setattr(tokens, "PIECE", piece)
        for t in texts:
            assert counter.count(t)[0] == (len(whole.encode("▁" + t.replace(" ", "▁")).ids) if t else 0), t


def plain_count(pieces, unknown, text):
    """Best sum of scores over all ways to cut text; of equal ones that whose last piece is longest."""
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        ways = []
        for size in range(1, end + 1):
            own = text[end - size : end]
            if own in pieces:
                ways.append((best[end - size][0] + pieces[own], size, best[end - size][1] + 1))
            elif size == 1:
                ways.append((best[end - 1][0] + unknown, 0, best[end - 1][1] + len(own.encode())))
        top = max(ways)
        best.append((top[0], top[2]))
    return best[-1][1], best[-1][0]


def test_counts_against_all_cuts():
    rng = random.Random(5)
    for _ in range(60):
        pieces = {"".join(rng.choices("abc", k=rng.randrange(1, 5))): float(-rng.randrange(1, 9)) for _ in range(12)}
        pieces |= {"▁" + p: s - 1 for p, s in list(pieces.items())[:5]} | {"▁": -3.0}
        counter = tokens.Counter(tokens.Vocabulary(pieces, -12.0))
        for _ in range(10):
            text = "".join(rng.choices("abcdé ", k=rng.randrange(1, 40)))
            assert counter.count(text) == plain_count(pieces, counter.unknown, "▁" + text.replace(" ", "▁"))


def test_one_very_long_word_in_little_memory():
    import tracemalloc

    counter = tokens.Counter(tokens.load(queries.VOCABULARY))
    word = "Zm9vYmFyIGJheiBxdXV4" * 20_000
    tracemalloc.start()
    n, _ = counter.count(word)
    assert tracemalloc.get_traced_memory()[1] < 8 * len(word) + 2**20
    tracemalloc.stop()
    assert 20_000 < n < len(word)


PAGE = """<html><head><title>no</title><style>p{}</style></head><body><header><a href=x>Home</a></header><nav><ul><li><a>One</a></ul></nav>
<div class="cookie-notice">We use cookies and so on for all that you do with us on this and any other of the pages.</div>
<article><h1>A &amp; B</h1><p>The first of the paragraphs, which is long enough to be judged on the words that it has.
<p>Short.<div class="ad">Buy the thing of the day, which is the best of all things that you can buy now.</div>
<ul><li>The point that is made in the list is long enough to be one of the blocks that stay.</ul>
<form>Name <input> and a text that is long enough to be taken for one of the paragraphs of the page.</form></article>
<aside>Of the things that are at the side of the page there is a lot and it is all to be left out.</aside>
<section id="comments"><p>I was the first of the readers to say that this is not at all what we came here for.</p></section>
<footer>&copy; the owner of the page and all that is on it, for as long as there is a page to own.</footer>"""


def test_page():
    want = ["A & B", "The first of the paragraphs, which is long enough to be judged on the words that it has.", "Short.", "The point that is made in the list is long enough to be one of the blocks that stay."]
    assert html_text.main_text(PAGE) == "\n\n".join(want)


@pytest.mark.parametrize("page", ["", "<", "<p", "plain", "<script>x", "<!-- open", "</p></div>", "<a href='x>y", "&#0;&bogus;", "<p>" * 2000])
def test_broken_pages(page):
    assert isinstance(html_text.main_text(page), str)


def test_page_without_article():
    p = "<body><ul><li><a>Menu</a></ul><div><p>" + "It is the text of the page and it has all that is to be said in it. " * 2 + "</p><p>End.</p></div></body>"
    assert html_text.main_text(p).endswith("\n\nEnd.") and "Menu" not in html_text.main_text(p)


STORY = "This is the story of the town and of the people who live in it, and it is long enough to be read. " * 3
TALK = "I think that this is not what the people of the town would say about it if you had asked them. " * 3


@pytest.mark.parametrize("page", [
    "<body class='single has-sidebar'><article><p>{}</article>", "<html class='cookies js'><body><article><p>{}</article>", "<html class='header-fixed'><body><article><p>{}</article>",
    "<main class='content with-sidebar'><p>{}</main>", "<article class='post comments-open'><p>{}</article>", "<article id='top' class='share'><p>{}</article>",
    "<div class='page with-sidebar'><div id=header-fixed><main><div class='share-on'><article><p>{}</article></div></main></div></div>",
    "<div class='page has-sidebar'><div class='entry-content'><p>{}</div></div>",
])
def test_names_around_the_article(page):
    """A word in the class or id of the page, the article, or what contains it does not empty the page."""
    aside = f"<div class=comments><p>{TALK}</div><div class=sidebar><p>{STORY[:120]}</div><nav class=menu>Menu</nav>"
    assert html_text.main_text(page.format(STORY)) == STORY.strip()
    assert html_text.main_text(page.format(STORY) + aside) == STORY.strip()


@pytest.mark.parametrize("tag", ["<button>", "<svg>", "<noscript>", "<select>", "<video>", "<template>", "<a name=x>", "<a data-href=x>"])
def test_unclosed_elements(tag):
    """An element without its end does not take the rest of the page."""
    assert html_text.main_text(f"<article><p>{tag}{STORY}<p>{STORY}") == f"{STORY.strip()}\n\n{STORY.strip()}"


POLISH = "To jest historia miasta i ludzi, którzy w nim mieszkają, a jest ona na tyle długa, żeby dało się ją przeczytać. " * 2
FINNISH = "Tämä kaupunki sijaitsee pohjoisessa, ja siellä asuu paljon ihmisiä. Talvella sataa lunta joka päivä. " * 2
JAPANESE = "これは町とそこに住む人々の物語であり、読むのに十分な長さがあります。冬には毎日雪が降ります。" * 2
MENU = "<ul><li><a href=/a>One of the pages</a><li><a href=/b>Another page</a></ul>"


@pytest.mark.parametrize("text", [POLISH, FINNISH, JAPANESE, STORY])
def test_languages(text):
    """Long paragraphs outside an article, in languages with and without a list of stop-words."""
    assert html_text.main_text(f"<body>{MENU}<div><p>{text}<p>{text}</div><div class=sidebar>{MENU}</div><footer>{text}</footer>") == f"{text.strip()}\n\n{text.strip()}"


@pytest.mark.parametrize("page", [
    "<body class='single-post has-sidebar'><div><p>{0}</div>", "<html class='no-js cookie'><body><div><p>{0}</div>", "<article class='post ad-free'><p>{0}</article>",
    "<article class='post share-enabled'><p>{0}</article>", "<div id='top'><div class=menu>{1}</div><p>{0}</div>", "<nav><ul>{1}<article><p>{0}</article>", "<nav>{1}<main><p>{0}</main>",
    "<form id=aspnet><div class='wrapper has-sidebar'>{1}<div class='inner'><p>{0}</div><div class=sidebar>{1}</div></div></form>", "<header><div class=menu>{1}</div><article><p>{0}</article>",
    "<div id=top><div class='with-sidebar'><p>{0}</div></div><div class=comments><p>I do not think so. It was not at all what we came here for, and it is the end of it.</p></div>",
])
def test_hints_do_not_empty_a_page(page):
    assert html_text.main_text(page.format(STORY, MENU)) == STORY.strip()


def test_facts_beside_running_text():
    facts = "Name Length Width Height Weight Year Colour Number Maker Owner Place Country Street"
    assert html_text.main_text(f"<div><p>{STORY}<p>{facts}<p>{STORY}</div>") == f"{STORY.strip()}\n\n{facts}\n\n{STORY.strip()}"


@pytest.mark.parametrize("unit", [
    "<a ", "<a href='", '<a href="', "<a href='x\"", "<i>", "<b><i></b>", "<div>", "<p class='x", "<button>", "<a name=x>", "<!--", "<![", "</", "<a b='c\">", "<script>", "< ", "<li><ul>", "<div class=sidebar>", "<article>",
    "<nav><article>", "<x class=\"", "<svg a='><b c=\"'>", "&amp", "<a x=' y=\" ", "<p =' ", "</i>", "<form><i></form>",
])
def test_broken_pages_take_time_in_proportion(unit):
    """A megabyte of broken markup, and that it is not much dearer than half of it."""
    import time

    def seconds(size):
        start = time.perf_counter()
        html_text.main_text("<p>" + unit * (size // len(unit)) + "<i></b>" * (size // 70))
        return time.perf_counter() - start

    small = min(seconds(125_000) for _ in range(2))
    assert seconds(1_000_000) < max(1.0, 24 * small) and small < 2.0


class PlainPage(__import__("html.parser").parser.HTMLParser):
    """The text of an article's blocks, by another parser and the generated pages' own layout."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.held, self.article, self.skip = [], [], False, 0

    def cut(self):
        whole = " ".join("".join(self.held).split())
        if whole and self.article:
            self.found.append(whole)
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "article", "div", "li", "ul", "nav", "footer"):
            self.cut()
        if tag == "br":
            self.held.append(" ")
        self.article |= tag == "article"
        self.skip += tag in ("div", "nav", "footer")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article", "div", "li", "ul", "nav", "footer"):
            self.cut()
        self.article &= tag != "article"
        self.skip -= tag in ("div", "nav", "footer")

    def handle_data(self, data):
        if not self.skip:
            self.held.append(data)


def test_pages_against_another_parser():
    import duckdb
    from conftest import DATA

    pages = duckdb.execute(f"SELECT html FROM '{DATA}/pages.parquet' WHERE html IS NOT NULL").fetchall()
    assert len(pages) > 20
    for (page,) in pages:
        plain = PlainPage()
        plain.feed(page)
        plain.close()
        plain.cut()
        assert html_text.main_text(page) == "\n\n".join(plain.found)


def test_names_condemn_other_articles():
    """Articles of a list of comments or of teasers stay out, beside the page's own and without one."""
    talk = f"<div class=comments><article><p>{TALK}</article></div>"
    assert html_text.main_text(f"<article><p>{STORY}{STORY}</article>{talk}") == (STORY + STORY).strip()
    assert html_text.main_text(f"<div class=sidebar><div class=content><p>{STORY[:99]}</div></div><p>{STORY}") == STORY.strip()


def test_record_round_trip():
    html = "<p>é\r\n\r\nWARC/1.1\x00</p>".encode()
    got = warc.parse(warc.record(7, "http://a.b/ c\n", html, warc.sha1(html), None))
    assert got["payload"] == html and got["page_id"] == 7 and got["type"] == "response" and got["digest"] == warc.sha1(html)
    again = warc.parse(warc.record(9, None, html, warc.sha1(html), 7))
    assert again["payload"] is None and again["refers_to"] == 7 and again["bytes"] == len(html) and again["url"] is None
    with pytest.raises(ValueError):
        warc.parse(warc.record(7, None, html, warc.sha1(b"other"), None))


def test_keys_sort_by_reversed_host():
    assert warc.surt("http://User@M.Example.net:8080/en/25?a=b#top") == "net,example,m:8080)/en/25?a=b"
    assert warc.surt(None) == "-" and warc.surt("http://[::1")
    assert warc.key_of("http://a.b/", -5) < warc.key_of("http://a.b/", 3)


def test_index_finds_keys_over_block_ends(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    monkeypatch.setattr(warc, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda s: 0, "taskAttemptId": lambda s: 1})())}))
    rows = sorted([f"k{i // 4:03d}" for i in range(50)] + ["k007"] * 9)
    batch = pa.RecordBatch.from_arrays([pa.array(rows), pa.array(["f"] * len(rows)), pa.array(range(len(rows))), pa.array([1] * len(rows))], schema=warc.CAPTURE)
    (shard,) = warc._indexer(str(tmp_path))(iter([batch]))
    index = warc.Index(str(tmp_path), [(shard.column(0)[0].as_py(), shard.column(1)[0].as_py())])
    for k in {*rows, "a", "k0035", "z"}:
        assert sorted(o for _, o, _ in index.find(k)) == [i for i, r in enumerate(rows) if r == k]


def test_scan_loses_nothing():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 64))
    x[300:] = x[:300] + rng.normal(size=(300, 64)) * rng.uniform(0, 0.08, (300, 1)) * 8
    x /= np.linalg.norm(x, axis=1)[:, None]
    book = pq.fit(x, 8)
    d = book.far(x)
    own = d.argmin(1)
    codes, error = book.encode(x, own)
    exact = x @ x.T >= 0.9
    for k in range(8):
        inside = np.flatnonzero(own == k)
        base = (x @ book.centres[k]).astype(np.float32)
        hit = pq.scan(book.tables(x), base, codes[inside], error[inside].astype(np.float32), 0.9)
        assert hit.T[exact[:, inside]].all()
        for i in range(8):
            probed = book.probes(d[own == i], i, np.array([k]))[:, 0]
            assert probed[exact[np.ix_(own == i, inside)].any(1)].all()


def test_layout_keeps_lists_in_order():
    rng = random.Random(0)
    for _ in range(200):
        sizes = {(d, k): rng.choice([1, 3, 9, 10, 11, 35]) for d in (2, 5) for k in range(rng.randrange(1, 9))}
        placed, bounds = pq.layout(sizes, 10)
        assert {(d, k) for d, k, _, _ in placed} == set(sizes)
        held = defaultdict(int)
        for d, k, first, blocks in placed:
            assert blocks == max(1, -(-sizes[d, k] // 10))
            for b in range(first, first + blocks):
                held[b] += -(-sizes[d, k] // blocks)
        assert max(held.values()) <= 10 and sorted(held) == list(range(bounds[-1][1]))
        order = [f for d, _, f, _ in placed if d == 5]
        assert order == sorted(order) and order[0] == bounds[-1][0]


def test_classifier_learns_and_ignores_length():
    rng = random.Random(4)
    plain = [f"word{i}" for i in range(300)]
    bad = [f"vil{i}" for i in range(20)]
    make = lambda y: " ".join(rng.choices(plain, k=rng.randrange(5, 120)) + (rng.choices(bad, k=3) if y else [])).encode()
    y = np.array([float(i % 5 == 0) for i in range(1500)])
    texts = [make(v) for v in y]
    model = toxicity.train(texts, y, ["en"] * len(y), np.arange(len(y)) % 5 == 1)
    test_y = np.array([float(i % 3 == 0) for i in range(300)])
    tests = [make(v) for v in test_y] + [b"", b" ".join([b"word1"] * 300000)]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in tests])]).astype(np.int64)
    s = model.scores(np.frombuffer(b"".join(tests), np.uint8), offs)
    assert ((s[:300] >= 0.5) == (test_y == 1)).mean() > 0.95
    assert ((s >= 0) & (s <= 1)).all()


def plain_logit(model, text):
    """The forward pass word by word, window by window."""
    words = decontaminate.normal_words(text)
    vectors = []
    for w in words:
        v = np.zeros(toxicity.DIM)
        for k, cut in enumerate((None, *toxicity.PREFIXES)):
            part = np.frombuffer(w if cut is None else w[:cut], np.uint8)
            h = hashing.word_hashes(part, np.array([0]), np.array([len(part)])) + np.uint64(k)
            v += model.embed[int(hashing.mix(h)[0]) % 2**64 >> 64 - toxicity.BUCKETS.bit_length() + 1]
        vectors.append(v)
    z, f = float(model.offset[0]), 0
    for width in toxicity.WIDTHS:
        for _ in range(toxicity.FILTERS):
            best = None
            for at in range(max(1, len(words))):
                r = 0.0
                for j in range(width):
                    column = toxicity.COLUMNS[j] + f - toxicity.FILTERS * sum(w <= j for w in toxicity.WIDTHS)
                    r += float(model.filters[column] @ vectors[at + j]) if at + j < len(vectors) else 0.0
                best = r if best is None or r > best else best
            z += max(0.0, best + float(model.bias[f])) * float(model.dense[f])
            f += 1
    return z


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    model = toxicity._fresh(rng, -0.3)
    model.embed[:-1] *= 30
    model.bias += rng.normal(0, 0.1, len(model.bias)).astype(np.float32)
    return model


def test_forward_pass_is_a_plain_convolution():
    model, rng = small_model(), random.Random(3)
    texts = [b"", b"one", b"Two words", b"--"] + [" ".join(rng.choices(["ab", "dé", "abcdefgh", "X1", "thing,"], k=rng.randrange(1, 12))).encode() for _ in range(12)]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    got = model.logits(np.frombuffer(b"".join(texts), np.uint8), offs)
    assert np.allclose(got, [plain_logit(model, t) for t in texts], atol=1e-4)
    long = np.frombuffer(b" ".join(rng.choice(texts[4:]) for _ in range(20000)), np.uint8)
    assert np.allclose(model.long_logit(long), model.logits(long, np.array([0, len(long)])), atol=1e-4)


@pytest.mark.parametrize("sharp", [None, 3.0])
def test_gradient_against_differences(sharp):
    model = small_model(1)
    for k in ("embed", "filters", "bias", "dense", "offset"):
        setattr(model, k, getattr(model, k).astype(np.float64))
    texts, y = [b"a b c a", b"d e", b"", b"f g h i j a"], np.array([1.0, 0.0, 0.0, 1.0])
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    feats, bounds = toxicity.features(np.frombuffer(b"".join(texts), np.uint8), offs)
    rows, first, places = model.pad(feats, bounds)

    def loss():
        _, out = model.responses(rows)
        z = []
        for s, n in zip(first, places, strict=True):
            own = out[:, s : s + n]
            if sharp is None:
                pooled = own.max(1)
            else:
                pooled = (weights[int(s)] * own).sum(1)
            z.append(float(np.maximum(pooled + model.bias, 0) @ model.dense + model.offset[0]))
        p = 1 / (1 + np.exp(-np.array(z)))
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    _, out = model.responses(rows)
    weights = {}  # taken as given
    for s, n in zip(first, places, strict=True):
        e = np.exp((sharp or 1) * (out[:, s : s + n] - out[:, s : s + n].max(1, keepdims=True)))
        weights[int(s)] = e / e.sum(1, keepdims=True)
    grad, own = toxicity.gradient(model, rows, first, places, y, sharp)
    rng = np.random.default_rng(0)
    for k in grad:
        value = getattr(model, k)
        for _ in range(12):
            at = tuple(int(rng.integers(n)) for n in grad[k].shape)
            real = (int(own[at[0]]), *at[1:]) if k == "embed" else at
            before = value[real]
            value[real] = before + 1e-5
            up = loss()
            value[real] = before - 1e-5
            down = loss()
            value[real] = before
            assert abs((up - down) / 2e-5 - grad[k][at]) < 1e-4, (k, at)


@pytest.mark.parametrize("sharp", [None, 3.0])
def test_gradient_in_blocks_is_that_of_whole_texts(sharp, monkeypatch):
    model, rng = small_model(2), random.Random(5)
    texts = [b"a b c", b"", " ".join(rng.choices(["ab", "dé", "abcdefgh", "x1"], k=70)).encode(), b"d"]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    rows, first, places = model.pad(*toxicity.features(np.frombuffer(b"".join(texts), np.uint8), offs))
    y = np.array([1.0, 0.0, 1.0, 0.0])
    whole, touched = toxicity.gradient(model, rows, first, places, y, sharp)
    for block in (1, 4, 33):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        got, same = toxicity.gradient(model, rows, first, places, y, sharp)
        assert np.array_equal(touched, same) and all(np.allclose(got[k], whole[k], atol=1e-5) for k in whole)


def test_averages_of_models_weigh_embeddings_by_their_steps():
    rng, rows, models = np.random.default_rng(6), [], []
    for shard in range(3):
        adam = toxicity.Adam(toxicity._fresh(rng, 0.1))
        adam.m2["filters"] += shard
        times, steps = rng.integers(0, 3, toxicity.BUCKETS + 1), np.array([shard + 1])
        models.append((adam, times, shard + 1))
        size = toxicity.SENT
        rows += [(b, shard, (times[b * size : (b + 1) * size] if b >= 0 else steps).tobytes(), np.stack(v).tobytes()) for b, v in toxicity._blocks(adam)]
    rows.sort(key=lambda r: r[:2])
    batches = [pa.RecordBatch.from_pylist([dict(zip(("block", "shard", "times", "data"), r, strict=True)) for r in rows[i : i + 4]]) for i in range(0, len(rows), 4)]
    got = {r["block"]: r for b in toxicity._averaged(iter(batches)) for r in b.to_pylist()}
    assert sorted(got) == list(range(-1, toxicity.BUCKETS // toxicity.SENT + 1))
    total = sum(t for _, t, _ in models)
    want = sum(a.model.embed * t[:, None] for a, t, _ in models) / np.maximum(total, 1)[:, None]
    mean = np.concatenate([np.frombuffer(got[b]["data"], np.float32).reshape(3, -1, toxicity.DIM)[0] for b in range(len(got) - 1)])
    assert np.allclose(mean[total > 0], want[total > 0], atol=1e-6)
    rest = np.frombuffer(got[-1]["data"], np.float32).reshape(3, -1)
    n = models[0][0].model.filters.size
    assert np.allclose(rest[0][:n], sum(a.model.filters.ravel() * w for a, _, w in models) / 6, atol=1e-6) and np.allclose(rest[2][:n], (0 + 2 + 6) / 6)


def test_labelled_words_are_kept_in_little_memory():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "Beta", "gammas", "d\u00e9lta", "epsilon-x"]) for _ in range(rng.choice([0, 3, 400, 90000]))).encode() for _ in range(30)]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    valid = np.arange(len(texts)) % 5 == 0
    on = toxicity.Texts(data, offs, np.zeros(len(texts)), [""] * len(texts), valid)
    tracemalloc.start()
    feats, bounds = on.feats
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    want = [toxicity.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t, v in zip(texts, valid, strict=True) if not v]
    assert (feats == np.concatenate(want)).all()
    assert (np.diff(bounds) == [len(w) for w in want]).all()
    cells = len(feats) * toxicity.PARTS
    assert kept < 2.5 * cells
    assert peak < 4.5 * cells + (48 << 20)


def resident():
    """MB of this process without mapped files."""
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024


def test_workers_give_back_what_they_free():
    pins = []

    def scattered():
        held = []
        for _ in range(2000):
            held.append(np.ones(12500))  # 100 KB each: of the heap, between smaller pieces that stay
            pins.append(np.ones(64))
        return held

    def batches(got):
        for batch in got:
            scattered()
            yield batch

    def one(t):
        scattered()
        return t

    def two(key, t):
        scattered()
        return t

    table = pa.table({"x": np.zeros(1 << 17)})
    before = resident()
    assert [len(b) for b in common.frugal(batches)(iter(table.to_batches()))] == [1 << 17]
    assert resident() < before + 60
    assert common.frugal(one)(table) is table
    assert resident() < before + 60
    assert common.frugal(two)((1,), table) is table
    assert resident() < before + 60


def test_thresholds_stay_near_the_middle_with_few_rows():
    assert toxicity.best_cut(np.array([0.1]), np.array([1.0])) == 0.5
    s = np.concatenate([np.full(50, 0.1), np.full(50, 0.3)])
    assert 0.1 < toxicity.best_cut(s, (s > 0.2).astype(float)) <= 0.3


def test_classifier_with_one_class():
    model = toxicity.train([b"a", b"b"], np.zeros(2), ["", ""], np.zeros(2, bool))
    assert model.scores(np.frombuffer(b"abc", np.uint8), np.array([0, 3]))[0] < 0.5
    assert toxicity.train([], np.zeros(0), [], np.zeros(0, bool)) is not None
