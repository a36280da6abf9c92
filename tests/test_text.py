"""Cleaning, keyword score, tokens, rounding, verdict and reasons."""

import random
import re
import unicodedata
from fractions import Fraction

from mailprism.functions import text as X
from mailprism.functions import verdict as V
from mailprism.functions.common import first_nonempty, round_half_even
from pyspark.sql import functions as F


TEXTS = [
    None, "", "   ", "Hello  <b>World</b>\n\t!", "a < b > c <", "x <<<< y", "1 &lt; 2 &amp;&nbsp;<i>ok</i>",
    "ﬁne ＦＵＬＬ ½ №5", "mail a.b+c@d-e.co.uk, then x@y", "a@b.c+d@e.f and a@b.c@d.e", "HTTP://EXAMPLE.com/x www.a.b, end",
    "Привет, Пётр! Срочно подтвердите пароль на www.сайт.рф", "été naïve", "tab\x0bform\x0cbell\x07del\x7f end",
    "nbsp here wide　ideographic", "url http://a.b/é next", "https://a.b\x1cnext", "joe@exämple.org",
    "a" * 5000 + "@", "....@@@@", "İstanbul STRASSE ẞ", "www.", "http://", "x&#64;y.z", "&copy &notit; &#x41;",
]


CLEANED = [
    '', '', '', 'hello world !', 'a c <', 'x <<<< y', '1 ok', 'fine full 1⁄2 no5', 'mail email , then x@y',
    'email email and email @d.e', 'url url end', 'привет, пётр! срочно подтвердите пароль на url', 'été naïve',
    'tab form bell del end', 'nbsp here wide ideographic', 'url url next', 'url next', 'email', "a" * 5000 + "@",
    '....@@@@', 'i̇stanbul strasse ß', 'www.', 'http://', 'email', '© ¬it; a',
]


def test_clean_text(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r.i: r.c for r in frame.select("i", X.clean_text("t").alias("c")).collect()}
    assert [got[i] for i in range(len(TEXTS))] == CLEANED


def test_clean_text_random(spark):
    """What cleaning leaves holds no tag, link or control character, is lower case and single-spaced."""
    rng = random.Random(3)
    alphabet = list("ab@.+-_<> \n\té&;#x1") + ["http://", "www.", "&amp;", " ", "ﬁ", "\x1f", " "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for row in frame.select("t", X.clean_text("t").alias("c")).collect():
        assert row.c == row.c.lower() == " ".join(row.c.split()), row
        assert not re.search(r"<[^>]+>|https?://\S|www\.\S|[\x00-\x1f\x7f]", row.c), row
        assert unicodedata.is_normalized("NFKC", row.c), row


def test_native_cleaner_has_no_python_and_agrees_on_plain_text(spark):
    plain = [(t, c) for t, c in zip(TEXTS, CLEANED) if t and t.isascii() and "&" not in t]
    frame = spark.createDataFrame(plain, "t string, want string")
    native = frame.select("want", X.clean_text_native("t").alias("c"))
    assert "Python" not in native._jdf.queryExecution().executedPlan().toString()
    assert all(r.c == r.want for r in native.collect())


def test_keyword_score(spark):
    texts = ["", "urgent urgent", "urgent verify", "urgent verify password account confirm", "срочно подтвердите парол"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in frame.select(X.keyword_score("t").alias("s")).collect()] == [0.0, 0.25, 0.5, 1.0, 0.75]


def test_strip_html(spark):
    frame = spark.createDataFrame([("<p>a</p>\n <b>b</b>",), (None,), ("a<>b",)], "t string")
    assert [r.s for r in frame.select(X.strip_html("t").alias("s")).collect()] == ["a b", "", "a<>b"]


def test_ngrams(spark):
    frame = spark.createDataFrame([("a bb cc_1 d é2",), ("one",), ("x",)], "t string")
    rows = [r.g for r in frame.select(X.word_ngrams(X.word_tokens("t")).alias("g")).collect()]
    assert rows == [["bb", "cc_1", "é2", "bb cc_1", "cc_1 é2"], ["one"], []]


def test_rounding_follows_the_binary_value(spark):
    rng = random.Random(5)
    values = [0.0625, 2.675, 0.0005, 0.3125, 0.35, 1.0, 0.0, 0.1875] + [rng.randrange(100000) / 10000 + 0.00005 for _ in range(500)]
    values += [rng.random() for _ in range(500)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (3, 4):
        got = [r.r for r in frame.select(round_half_even("v", digits).alias("r")).collect()]
        assert got == [round(v, digits) for v in values]


def test_mean_is_compensated(spark):
    rng = random.Random(9)
    lists = [[], [0.1] * 10, [0.332, 0.581, 0.19, 0.297], [1.0, 1e-16, -1.0]]
    lists += [[round(rng.random(), 4) for _ in range(rng.randint(1, 9))] for _ in range(500)]
    frame = spark.createDataFrame([(v,) for v in lists], "v array<double>")
    got = [r.m for r in frame.select(V.mean_score("v").alias("m")).collect()]
    assert got == [sum(v) / len(v) if v else 0.0 for v in lists]


def test_verdict_edges(spark):
    means = [0.0, 0.1999, 0.2, 0.4, 0.6, 0.8, 1.0, 1.1]
    frame = spark.createDataFrame([(m,) for m in means], "m double")
    assert [r.v for r in frame.select(V.verdict("m").alias("v")).collect()] == [
        "DEFINITELY_HUMAN", "DEFINITELY_HUMAN", "PROBABLY_HUMAN", "MIXED", "PROBABLY_AI", "DEFINITELY_AI",
        "DEFINITELY_AI", None,
    ]


def test_reasons_print_scores_like_the_messages(spark):
    scores = [0.5, 0.51, 1.0, 0.0, 0.0001, 0.00025, 0.00001, 0.0000123, None]
    items = [(None if s == 1.0 else "text", s) for s in scores]
    frame = spark.createDataFrame([(items,)], "r array<struct<analyzer_type:string,score:double>>")
    got = frame.select(V.explain("r").alias("x")).collect()[0].x
    for (kind, score), line in zip(items, got):
        value = 0 if score is None else score
        finding = V.REASON_SUSPICIOUS if value > 0.5 else V.REASON_CLEAN
        assert line == f"{kind or '?'}: {finding} (score={value})"


def test_first_nonempty(spark):
    frame = spark.createDataFrame([("", "b"), ("a", "b"), (None, None)], "x string, y string")
    assert [r.v for r in frame.select(first_nonempty("x", "y").alias("v")).collect()] == ["b", "a", ""]


def test_model_reason_bands(spark):
    frame = spark.createDataFrame([(0.8,), (0.79,), (0.5,), (0.1,)], "s double")
    got = [r.x for r in frame.select(X.text_reason("s").alias("x")).collect()]
    assert [g.split()[0] for g in got] == ["strong", "probable", "mixed", "no"]
