"""URL filter, quality rules and dialogues: against SQL and brute force, on hostile rows."""

import collections
import re

import pytest
from fixtures import plain

from mailprism.llm import chat, line_quality, url_filter
from oracle import compare, connect
from __spark_entry__ import oracle_sql, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.mark.parametrize("name", ["op3_url_filter", "op4_perspectives", "op9_line_quality", "op10_top_k"])
def test_sql(corpus, name):
    folder = "/root/testdata/sf0.01"
    assert compare(queries()[name](corpus, folder), connect(folder), oracle_sql()[name]) is None


def test_urls(corpus):
    rows = [
        (1, "http://A.Net/x?y#z", "a.net", "/x", "net/", "block"),
        (2, "https://m.example.NET/en/5", "m.example.net", "/en/5", "example.net/en/", "allow"),
        (3, "https://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        (4, "http://badexample.com/de/", "badexample.com", "/de/", None, "allow"),
        (5, "http://a.org/fr", "a.org", "/fr", None, "allow"),
        (6, "http://b.org#://c.net/", "b.org", "", None, "allow"),
        (7, None, "", "", None, "allow"),
        (8, "example.com/porn", "", "", None, "block"),
        (9, "http://x.com/casino", "x.com", "/casino", None, "allow"),
        (10, "http://x.com/casino-casino", "x.com", "/casino-casino", None, "allow"),
        (11, "http://casino7.com/POKER/", "casino7.com", "/POKER/", None, "block"),
        (12, "http://x.com/spammer/casinos-poker", "x.com", "/spammer/casinos-poker", None, "allow"),
        (None, "", "", "", None, "allow"),
        (3, "https://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ]
    frame = corpus.createDataFrame([r[:2] for r in rows], "page_id long, url string").selectExpr("*", "1 as host", "2 as hits")
    want = [(r[0], *r[2:]) for r in rows]
    assert plain(url_filter.filter_urls(frame).drop("strict_hits", "soft_hits").collect()) == plain(want)
    assert url_filter.filter_urls(frame.limit(0)).count() == 0


def normal(line):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return re.sub("[0-9]", "0", " ".join(WORD.findall(low)))


def judged(rows, limit, percent=line_quality.MAX_TEXTS_PERCENT):
    texts, hosts, first = collections.defaultdict(set), collections.defaultdict(set), {}
    for row in rows:
        hosts[row.source].add(row.text or "")
        for line in (row.text or "").split("\n"):
            if WORD.search(line):
                key = row.source, normal(line)
                texts[key].add(row.text)
                if row.doc_id is not None:
                    first[key] = min(first.get(key, row.doc_id), row.doc_id)
    for row in rows:
        text = row.text or ""
        words = WORD.findall(text)
        lines = [line for line in text.split("\n") if WORD.search(line)]
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        count = collections.Counter(grams)
        covered = {i + d for i, g in enumerate(grams) if count[g] > 1 for d in range(3)}
        removed = 0
        for line in lines:
            key = row.source, normal(line)
            often = len(texts[key]) > limit and 100 * len(texts[key]) > percent * len(hosts[row.source])
            if often and first.get(key) != row.doc_id:
                removed += len(WORD.findall(line))
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        left = len(words) - removed
        kept = not failed and not (removed and (left < 50 or 100 * left < 30 * len(words)))
        yield (row.doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
               len(covered), failed, kept, removed)


def test_quality_rules(documents):
    rows = documents.select("doc_id", "text", "source").collect()
    out = line_quality.judge_documents(documents, max_texts=2).drop("host", "digest")
    want = list(judged(rows, 2))
    assert plain(out.collect()) == plain(want)
    assert any(not w[7] and not w[6] for w in want), "some document must be depleted"
    kept = line_quality.keep_good(documents, max_texts=2)
    assert kept.dtypes == documents.dtypes
    assert plain(kept.select("doc_id").collect()) == plain((w[0],) for w in want if w[7])
    assert line_quality.judge_documents(documents.limit(0)).count() == 0


def test_the_limit_is_a_share_of_the_host(corpus):
    own = lambda i: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{'x' * j}" for j in range(60))
    rows = []
    for i in range(200):
        lines = [own(i), *(["in ten texts"] if i < 10 else []), *(["in eleven of them"] if i < 11 else [])]
        rows += [(i, "\n".join(lines), host) for host in ("s", None)]
    # Equal texts do not make a host larger; a small host needs more than the floor.
    rows += [(1000 + i, rows[0][1], "s") for i in range(50)] + [(2000 + i, f"{own(i)}\nin few", "t") for i in range(5)]
    out = line_quality.judge_documents(corpus.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    removed = collections.Counter((r.host, r.removed_words) for r in out if r.removed_words)
    assert removed == {("s", 4): 10 + 50, (None, 4): 10}
    assert all(r.kept for r in out)


def test_quality_plan_is_native(documents):
    plan = line_quality.judge_documents(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_exploded_lines_are_not_broadcast(documents, tmp_path):
    """84 MB of lines at 0.1 GB of input passed for less than 10."""
    documents.write.parquet(f"{tmp_path}/docs")
    docs = documents.sparkSession.read.parquet(f"{tmp_path}/docs")
    for judged in (line_quality.judge_documents(docs, max_texts=2), line_quality.keep_good(docs, max_texts=2)):
        plan = judged._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"SortMergeJoin \[h#", plan) and not re.search(r"BroadcastHashJoin \[(h|rid)#", plan)


def test_dialogues(corpus):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|x|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, None, "first"),
        (1, 3, "ann", ""), (2, 0, "system", "alone"), (None, 5, "ann", "x"), (None, 5, "bob", "y"), (1, 70, "bob", "late"),
    ]
    frame = corpus.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as speaker", "2 as m")
    got = {(r.conv_id, r.speaker, r.window): r for r in chat.rotate_perspectives(frame).collect()}
    assert {(k[0], k[1]) for k in got} == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann"), (None, "bob")}
    main = got[1, "ann", 0]
    assert main.text == (
        "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi < |x|><|end|>\n<|user name=bob|>\n<|end|>\n<|assistant|>\n<|end|>\n"
    )
    spans = [tuple(map(int, s.split(":"))) for s in main.mask_spans.split(",")]
    assert [main.text[a:b] for a, b in spans] == ["hi < |x|><|end|>", "<|end|>"] and main.n_messages == 4
    assert got[1, "bob", 1].text == "<|assistant|>\nlate<|end|>\n"
    assert got[None, "bob", 0].text == "<|user name=ann|>\nx<|end|>\n<|assistant|>\ny<|end|>\n"
    split = chat.rotate_perspectives(corpus.createDataFrame([(1, 0, "a", str(i)) for i in range(100)], frame.schema.simpleString()[7:-1].split(",speaker")[0]), window_messages=10)
    assert split.agg({"n_messages": "sum"}).first()[0] == 100 and split.count() > 5
    assert chat.rotate_perspectives(frame.limit(0)).count() == 0


def test_frequent_lines_leave_the_texts(corpus):
    common, other = "All rights reserved 2024 by the site", "all  RIGHTS reserved 1999 by the site"
    own = lambda i: " ".join(chr(97 + i) + "x" * j for j in range(60))
    rows = [(i, f"{own(i)}\n\n{common if i % 2 else other}\nend {chr(97 + i)}", "s", 7) for i in range(6)]
    rows += [(9, f"{own(9)}\n{common}", "other", None), (3, rows[3][1], "s", 7)]
    frame = corpus.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = plain(line_quality.keep_good(frame, max_texts=2).collect())
    clean = {i: f"{own(i)}\n\nend {chr(97 + i)}" for i in range(6)}
    want = [rows[0], *((i, clean[i], "s", len(clean[i])) for i in range(1, 6)), rows[6], (3, clean[3], "s", len(clean[3]))]
    assert got == plain(want)


def test_large_windows_are_cut_in_the_order_of_turns(corpus):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(c, t, "ab"[t % 2], f"{c}-{t}") for c in (1, None) for t in range(60)]
    out = chat.rotate_perspectives(corpus.createDataFrame(rows, schema).repartition(5), window_messages=16)
    parts = {(r.conv_id, r.speaker, r.part): r for r in out.collect()}
    assert len(parts) == 2 * 2 * 4
    for (conv, _, part), r in parts.items():
        want = [f"{conv}-{t}" for t in range(16 * part, min(60, 16 * part + 16))]
        assert re.findall(r"\n([^<\n]+)<\|end\|>", r.text) == want and r.n_messages == len(want)
    repeated = corpus.createDataFrame([(1, t, "ab"[t % 2], str(t)) for t in range(8)] * 200, schema)
    assert [(r.part, r.n_messages) for r in chat.rotate_perspectives(repeated).collect()] == [(0, 8), (0, 8)]
