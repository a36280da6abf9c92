"""Phrases, ranked search and spelling variants against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import WORDS, plain

from mailprism.llm.lexical_search import Best, Block, Postings, _segment_rows, build_postings, search_documents, search_segment
from mailprism.llm.phrase_index import build_index, decontaminate, search_index, windows
from mailprism.llm.spelling import corpus_words, near_pairs, noisy, spelling_variants
from mailprism.llm.words import packed, unpacked, words_of

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def test_words():
    rng = random.Random(3)
    texts = [None, "", "a", "  A-b_c9 ", "Ééx y", "\x00a\x00", "\U0001F600\U0001F601 z", "[\\]^`{|}~\x7f", "a" * 5000]
    texts += ["".join(rng.choice("aB0 -.é中\x7f\x80/:@`{") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    assert [words_of(t) for t in texts] == [words(t) for t in texts]
    values = np.array([0, 5, 5, 2**31 - 1, 0, 7])
    assert unpacked(packed(values)).tolist() == values.tolist() and len(unpacked(packed(values[:0]))) == 0


@pytest.fixture(scope="module")
def items(corpus, documents):
    """Passages of the documents, changed ones, short, empty, NULL and repeated items."""
    rng = random.Random(11)
    texts = [r.text for r in documents.select("text").orderBy("doc_id", "text").collect() if r.text and len(r.text.split()) > 30]
    rows = []
    for i in range(40):
        got = rng.choice(texts).split()
        at = rng.randint(0, len(got) - 25)
        part = got[at : at + rng.randint(3, 25)]
        if i % 3 == 1:
            rng.shuffle(part)
        if i % 3 == 2:
            part.insert(len(part) // 2, "inserted")
        rows.append((i, " ".join(part)))
    rows += [(50, None), (51, ""), (52, "--"), (53, "token"), (54, "TOKEN"), (None, rows[0][1]), (0, rows[3][1]), rows[5], rows[5]]
    rows += [(60, "b " * 12), (61, "b b b zz"), (62, "alpha0 beta1"), (63, "é\U0001F600 password abcdef123456 x"), (64, "x " * 4000)]
    frame = corpus.createDataFrame(rows, "item_id long, text string")
    for name in ("key", "item", "term", "segment", "block"):
        frame = frame.selectExpr("*", f"'1' as {name}")
    return frame.repartition(2)


def contamination(docs, benchmark, window=10, slack=5):
    cut = set()
    for item_id, text in benchmark:
        w = words(text)
        name = "" if item_id is None else str(item_id)
        cut |= {(name, tuple(w[i : i + window])) for i in range(max(len(w) - window + 1, min(1, len(w))))}
    by_window = {}
    for name, g in cut:
        by_window.setdefault(g, set()).add(name)
    for doc_id, text in docs:
        w = words(text)
        hit, found, near = set(), set(), set()
        have = Counter(w)
        here = {n: {} for n in {len(g) for g in by_window}}
        for n, slices in here.items():
            for p in range(len(w) - n + 1):
                slices.setdefault(tuple(w[p : p + n]), []).append(p)
        for g, names in by_window.items():
            for p in here[len(g)].get(g, ()):
                hit |= set(range(p, p + len(g)))
                found |= names
            need = Counter(g)
            if not names <= near and all(have[x] >= n for x, n in need.items()):
                for p in range(len(w)):
                    if w[p] in need and all(Counter(w[p : p + len(g) + slack])[x] >= n for x, n in need.items()):
                        near |= names
                        break
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        yield doc_id, len(w), len(hit), len(found), digest, bool(hit), sorted(found), sorted(near)


@pytest.mark.parametrize("block_windows", [100_000, 700])
def test_contamination(documents, items, block_windows):
    docs = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = decontaminate(documents, items, block_windows=block_windows).drop("spans").collect()
    want = list(contamination(docs, [tuple(r) for r in items.select("item_id", "text").collect()]))
    assert plain(got) == plain(want)
    assert sum(r.contaminated for r in got) > 20 and any(len(r.near_items) > len(r["items"]) for r in got)


def test_contamination_of_empty_tables(documents, items):
    assert decontaminate(documents.limit(0), items).count() == 0
    got = decontaminate(documents, items.limit(0)).collect()
    assert len(got) == documents.count() and not any(r.n_hit or r.n_near_items if "n_near_items" in r else r.n_hit for r in got)


def test_index_is_searched_again(documents, items):
    index = build_index(documents)
    one = search_index(index, windows(items))
    two = search_index(index, windows(items, 4), slack=0)
    assert index.count() >= 1 and two.count() >= one.count() > 0
    spans = [[tuple(s) for s in r.spans] for r in one.collect()]
    assert all(a[1] < b[0] for s in spans for a, b in zip(s, s[1:]))
    with pytest.raises(ValueError):
        search_index(index, windows(items), slack=100)


def ranked(docs, benchmark, k=20):
    texts = [(i, Counter(words(t))) for i, t in docs]
    texts = [(i, c, sum(c.values())) for i, c in texts if c]
    n_docs, n_terms = len(texts), sum(n for _, _, n in texts)
    df = Counter(x for _, c, _ in texts for x in c)
    for item_id, text in benchmark:
        scored = []
        for doc_id, c, n in texts:
            m = 75 + (25 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 12 * m))
                for x in words(text) if c[x]
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, unknown, doc_id) in enumerate(sorted(scored)[:k], 1):
            yield item_id, rank, None if unknown else doc_id, -score


@pytest.mark.parametrize("block_pairs", [100_000, 60])
def test_lexical_search(documents, items, block_pairs):
    docs = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = search_documents(documents, items, block_pairs=block_pairs).collect()
    assert plain(got) == plain(ranked(docs, [tuple(r) for r in items.select("item_id", "text").collect()]))
    assert len(got) > 300


def test_lexical_search_of_ties(corpus):
    rows = [(i, "same words in all of them") for i in range(300, 0, -1)] + [(None, "same words in all of them")] * 3
    rows += [(1000 + i, "other things") for i in range(400)]
    docs = corpus.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = corpus.createDataFrame([(1, "same words"), (2, "nothing"), (3, None)], "item_id long, text string")
    got = search_documents(docs, items).orderBy("rank").collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in got] == [(1, i, i) for i in range(1, 21)]
    assert search_documents(docs.limit(0), items).count() == 0 and search_documents(docs, items.limit(0)).count() == 0
    few = search_documents(docs.filter("doc_id is null or doc_id > 298"), items).orderBy("rank").collect()
    assert [r.doc_id for r in few] == [299, 300, None, None, None]


def test_bounds_cut_ranges_off(corpus):
    """The best documents are found without scoring most of those that hold a word."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 60)))) for i in range(3000)]
    rows += [(5000 + i, "zebra quagga okapi alpha") for i in range(30)]
    index = build_postings(corpus.createDataFrame(rows, "doc_id long, text string").repartition(1))
    row = index.first().asDict()
    from types import SimpleNamespace

    asked = [SimpleNamespace(key=0, term=bytes(t), often=1, df=d) for t, d in zip(row["terms"], row["dfs"]) if bytes(t) in (b"zebra", b"quagga", b"alpha")]
    block = Block(asked, row["n_docs"], row["n_terms"])
    lists = Postings(row, block)
    best = Best(*(np.zeros(0, np.int64),) * 2, np.zeros(0, bool))
    scored = search_segment(lists, *block.items[0], best, 20)
    assert best.ids.tolist() == list(range(5000, 5020)) and scored < 200
    # Every range's maximum, from the sparse table.
    for _ in range(500):
        a, b = sorted(rng.sample(range(int(lists.last[0]) + 1), 2))
        impact, entry = lists.maxima(np.array([a]), np.array([b]))
        assert impact[0] == lists.impact[a:b].max() and entry[0] == a + lists.impact[a:b].argmax()
    assert callable(_segment_rows)


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def test_near_pairs(corpus):
    rng = random.Random(2)
    found = {"".join(rng.choice("abà") for _ in range(rng.randint(2, 9))) for _ in range(700)}
    found |= {"aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "babababa", "a", ""}
    frame = corpus.createDataFrame([(w,) for w in found], "word string").selectExpr("*", "1 as size", "2 as place")
    got = [tuple(sorted(r)) for r in near_pairs(frame).collect()]
    long_ = sorted(w for w in found if len(w) >= 2)
    want = {(a, b) for i, a in enumerate(long_) for b in long_[i + 1 :] if near(a, b)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000


def variants(docs, least=6, min_count=5, ratio=5, noise=199):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % noise else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least and c >= min_count}
    form = {}
    close = {w: [v for v in n if near(v, w)] for w in n}
    for w, c in n.items():
        best = min(close[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * c else None
    for w, c in n.items():
        root = w
        while form[root] is not None:
            root = form[root]
        yield w, form[w], root, c, len(close[w]), n.get(form[w])


@pytest.mark.parametrize("noise", [199, 3])
def test_spelling(corpus, documents, noise):
    rng = random.Random(9)
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    chain = [("ordinary", 1800), ("ordinery", 200), ("ordinerx", 14), ("Ordinerxy", 3), ("ordinerxy", 1), ("ÀÉÿordi", 9), ("àéÿordi", 6)]
    rows += [(1000 + i, " ".join(rng.choices([w for w, _ in chain], [c for _, c in chain], k=80)) + " 1x×÷y") for i in range(30)]
    frame = corpus.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as word", "1L as n", "'y' as form")
    got = spelling_variants(frame, noise=noise).collect()
    assert plain(got) == plain(variants(rows, noise=noise))
    roots = {r.word: r.root for r in got}
    assert noise == 3 or roots["ordinerx"] == "ordinary"
    assert any(r.form and r.form != r.root for r in got)
    assert spelling_variants(frame.limit(0)).count() == 0 and corpus_words(frame.filter("text is null")).count() == 0


def test_noise():
    for doc_id in (None, 5):
        for run in ("abcdefg", "ordinary", "éabcdef"):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            assert noisy(doc_id, run, 1) == run[: h % len(run)] + run[h % len(run) + 1 :]
