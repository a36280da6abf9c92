"""SimHash groups, components and repeated byte strings: against brute force."""

import collections
import hashlib
import random

import pytest
import xxhash
from fixtures import plain

from mailprism.llm import components as components_of
from mailprism.llm import simhash
from mailprism.llm.anchors import find_anchors
from mailprism.llm.common import written
from mailprism.llm.components import components
from mailprism.llm.simhash import drop_near_duplicates, links, simhash_components
from mailprism.llm.suffix_dedup import SuffixIndexFamily, remove_repeats, repeats_report


def bits(text, n):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, distance):
    prints, of = sorted(set(prints)), {}
    for p in prints:
        near = {of[q] for q in of if (p ^ q).bit_count() <= distance}
        for q in of:
            if of[q] in near:
                of[q] = p
        of[p] = p
    return of


@pytest.mark.parametrize("distance,segments", [(3, ((0, 32, 1), (32, 32, 1))), (7, ((0, 16, 1), (16, 16, 1), (32, 16, 1), (48, 16, 1)))])
def test_simhash_components(documents, distance, segments):
    rows = documents.select("doc_id", "text").collect()
    prints = [bits(r.text, 3) for r in rows]
    of = groups(prints, distance)
    least = {}
    for row, p in zip(rows, prints):
        if row.doc_id is not None:
            least[of[p]] = min(least.get(of[p], row.doc_id), row.doc_id)
    want = [(r.doc_id, f"{p:016x}", least.get(of[p])) for r, p in zip(rows, prints)]
    assert plain(simhash_components(documents, 3, distance, segments).collect()) == plain(want)
    assert simhash_components(documents.limit(0)).count() == 0


def test_links_find_all_pairs(corpus):
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        for _ in range(3):
            q = p
            for b in rng.sample(range(64), rng.randint(1, 5)):
                q ^= 1 << b
            prints.add(q)
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    frame = corpus.createDataFrame([(p,) for p in signed], "fp long")
    want = {(a, b) for a in signed for b in signed if a < b and (signed[a] ^ signed[b]).bit_count() <= 3}
    assert {tuple(r) for r in links(frame).collect()} == want
    with pytest.raises(ValueError):
        links(frame, 4)


def test_components_of_chain_and_star(corpus):
    nodes = list(range(200))
    random.Random(3).shuffle(nodes)
    edges = list(zip(nodes[:99], nodes[1:100])) + [(n, nodes[100]) for n in nodes[101:]] + [(5, 5)]
    got = {r.node: r.component for r in components(corpus.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(nodes[:100], min(nodes[:100])), **dict.fromkeys(nodes[100:], min(nodes[100:]))}


@pytest.mark.parametrize("words_in,distance,segments", [(3, 3, ((0, 32, 1), (32, 32, 1))), (5, 7, ((0, 16, 1), (16, 16, 1), (32, 16, 1), (48, 16, 1)))])
def test_one_of_each_group_stays(documents, words_in, distance, segments):
    out = drop_near_duplicates(documents, words_in, distance, segments)
    assert out.dtypes == documents.dtypes
    # Rows are told apart by place here; one of the smallest id stays of what links connect.
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    prints = [bits(text, words_in) for _, text in rows]
    of = groups(set(prints), distance)
    want = {}
    for (doc_id, _), p in zip(rows, prints):
        want.setdefault(of[p], []).append(doc_id)
    want = collections.Counter(min((i for i in ids if i is not None), default=None) for ids in want.values())
    kept = collections.Counter(r.doc_id for r in out.collect())
    assert kept == want and sum(kept.values()) < len(rows)
    assert kept[5] == 1 and not any(kept[200 + i] for i in range(5))
    assert drop_near_duplicates(documents.limit(0)).count() == 0


@pytest.mark.parametrize("operator", [simhash_components, drop_near_duplicates])
def test_no_join_is_broadcast(corpus, documents, monkeypatch, operator):
    """Exploded and compressed tables look small; the balls of 300,000 fingerprints have 20 million rows."""
    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for module in (simhash, components_of):
        monkeypatch.setattr(module, "written", lambda df, label: (plans.append(plan(df)), written(df, label))[1])
    plans.append(plan(operator(documents)))
    assert sum("SortMergeJoin" in p for p in plans) > 3 and not any("Broadcast" in p for p in plans)


def brute(rows, match):
    count = collections.Counter()
    texts = [(r.doc_id, (r.text or "").encode()) for r in rows]
    for _, b in texts:
        count.update(b[p : p + match] for p in range(len(b) - match + 1))
    for doc_id, b in texts:
        covered = bytearray(len(b))
        for p in range(len(b) - match + 1):
            if count[b[p : p + match]] > 1:
                covered[p : p + match] = b"\1" * match
        runs = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        kept = bytes(x for x, c in zip(b, covered) if not c)
        yield doc_id, len(b), sum(covered), runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")


@pytest.mark.parametrize("seed,match", [(0, 64), (1, 100), (2, 64)])
def test_repeats(corpus, seed, match):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    shared = [text(rng.randint(20, 300)) for _ in range(12)]
    makers = [
        lambda: text(rng.randint(0, 120)), lambda: rng.choice(shared), lambda: "a" * rng.randint(0, 150),
        lambda: rng.choice(shared)[rng.randint(0, 60) : rng.randint(60, 250)], lambda: "ab" * rng.randint(0, 60),
    ]
    rows = []
    for i in range(100):
        body = "".join(rng.choice(makers)() for _ in range(rng.randint(0, 6)))
        rows.append((rng.choice([i, i, i, 3, None]), body if rng.random() > 0.03 else None))
    rows += rows[:10] + [(500 + i, rows[5][1]) for i in range(4)]
    frame = corpus.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as g", "2 as marks").repartition(4)
    want = list(brute(frame.collect(), match))
    assert plain(repeats_report(frame, match=match).collect()) == plain(want)


def test_characters_cut_by_a_repeat(corpus):
    body = " ".join(str(i * i) for i in range(40))
    frame = corpus.createDataFrame([(1, body + "\u00e8!"), (2, body + "\u00e9?"), (3, None)], "doc_id long, text string")
    bytes_left = {r.doc_id: bytes(r.kept) for r in remove_repeats(frame, 64).collect()}
    assert bytes_left == {1: b"\xa8!", 2: b"\xa9?", 3: b""}
    texts = {r.doc_id: r.kept_text for r in repeats_report(frame, match=64).collect()}
    assert texts == {1: "\ufffd!", 2: "\ufffd?", 3: ""}


def test_no_documents(documents):
    assert remove_repeats(documents.limit(0)).count() == 0


def test_equal_strings_have_equal_anchors():
    rng = random.Random(1)
    common = bytes(rng.choice(b"abcd") for _ in range(150))
    texts = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 90))) + common + b"xyz" * i for i in range(5)]
    of, x, lo, hi, _ = find_anchors(texts, 100)
    seen = collections.defaultdict(set)
    for t, place, a, b in zip(of, x, lo, hi):
        for start in range(a, b + 1):
            seen[texts[t][start : start + 100]].add(place - start)
    assert all(len(places) == 1 for places in seen.values())
    assert sum(b - a + 1 for a, b in zip(lo, hi)) == sum(max(0, len(t) - 99) for t in texts)


def test_levels_are_different_powers_of_two(corpus):
    family, sizes = SuffixIndexFamily(), []
    for number in range(5):
        rows = [(number * 10 + i, i, 0, 0, 0, i if number in (1, 4) else 100 + number * 10 + i, 7) for i in range(3)]
        family.add(corpus.createDataFrame(rows, "did long, digest long, x int, lo int, hi int, g long, u long"))
        sizes.append([size for size, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1]]
    assert plain(family.repeated().collect()) == [(i, 2, 7, 7) for i in range(3)]
