"""HTML counters: fixed cases, odd markup, and random markup against the standard parser."""

import random

import pytest

from mailprism.functions import html as H
from pyspark.sql import functions as F

CASES = [
    "",
    "plain text, no markup",
    '<form><div class="text-red-500 p-4"><script>x()</script></div></form>',
    "<p>one<br>two<br/>three<hr /></p>",
    '<a title="a > b" href=x>t</a>',
    "<!-- <div><p> --><p>x</p><!-- -- > <b>",
    "<!-- never closed <div><p>",
    "<script>if (a < b) { document.write('<p>') }</script><p>",
    "<script>never closed <p><div>",
    "<style>p{margin:0}</style><SCRIPT SRC='a.js'></SCRIPT ><img src=a><link rel=x><iframe>",
    '<div style="display : none"></div><div STYLE="visibility:HIDDEN">x</div><p hidden>x<p hidden="">',
    "<input type=hidden><input type='hidden' hidden>",
    '<p class="md:flex-1 sm:text-lg lg:p-2 xl:p-4 grid- font-bold notp-4">',
    "<p class='bg-x' class='text-y'>",
    '<p class="p&#45;4">&copy; 2024 <b>',
    '<p class="unclosed>text</p><p>',
    "a < b and c > d <p>",
    "<a href=foo/><b/><c d=e /></p>",
    "<a data-style='x' data-class=text-1 my-hidden>",
    "<br/ ><p / >",
    "</ div><div></ div></div x></>",
    "<?php echo '<p>' ?><!DOCTYPE html><![CDATA[x]]><p>",
    "<!--><p><!--->",
    "<p <b>x</b>",
    "<style/><p>",
    "</p></p><div><div>",
    "<p a=1 b c='2' d=\"3\" style>",
    "<P\nclass=\n'text-1\tp-2'\n>",
    "<p style = 'display:none' >",
]


def _rows(spark, markups):
    frame = spark.createDataFrame([(i, m) for i, m in enumerate(markups)], "i int, html string")
    native = frame.select("i", H.html_features("html").alias("f")).select("i", "f.*")
    exact = H.with_html_features(frame, "html")
    by_i = lambda df: {r["i"]: r.asDict() for r in df.collect()}
    return by_i(native), by_i(exact)


def _check(spark, markups):
    native, exact = _rows(spark, markups)
    regular = 0
    for i, markup in enumerate(markups):
        want = H._count_with_parser(markup)
        assert {f: exact[i][f] for f in H.FEATURES} == want, markup
        if not native[i]["irregular"]:
            regular += 1
            assert {f: native[i][f] for f in H.FEATURES} == want, markup
    return regular


def test_fixed_cases(spark):
    assert _check(spark, CASES) >= 18


def test_random_markup(spark):
    rng = random.Random(7)
    pieces = [
        "<div>", "</div>", "<p class='text-a p-1'>", "</p>", "<br>", "<br/>", "<img src=x>", "<script>",
        "</script>", "<!--", "-->", " text ", "<", ">", '"', "'", "<a href='x' style=display:none>", "</a>",
        "<style>", "</style>", "<form hidden>", "<p style=\"visibility: hidden\">", "=", "/", "<b x=1/>",
        "&amp;", "<i class=\"p-1&amp;\">", "--", "<script src=a />", "\n", "<!DOCTYPE html>", "</", "<!",
    ]
    markups = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    assert _check(spark, markups) > 800


def test_score_and_reason(spark):
    frame = spark.createDataFrame(
        [(CASES[2],), ("<p>x</p>",), ("<div>" * 13,), ("<p hidden>" * 4,), ("<i></i>" * 181,)], "html string"
    )
    rows = H.with_html_features(frame, "html").select(
        "tailwind_class_count", H.html_score().alias("score"), H.html_reason().alias("reason")
    ).collect()
    assert rows[0].tailwind_class_count == 2 and rows[0].score == 0.55 and "active" in rows[0].reason
    assert (rows[1].score, rows[1].reason) == (0.0, H.REASON_NONE)
    assert (rows[2].score, rows[2].reason) == (0.15, H.REASON_DEEP)
    assert (rows[3].score, rows[3].reason) == (0.1, H.REASON_HIDDEN)
    assert (rows[4].score, rows[4].reason) == (0.15, H.REASON_COMPLEX)


def test_large_tag_does_not_overflow_the_stack(spark):
    big = "<p " + " ".join(f"a{i}='{i}'" for i in range(20000)) + " class='text-1'>x</p>"
    many = "<" * 200_000
    frame = spark.createDataFrame([(big,), (many,)], "html string")
    rows = frame.select(H.html_features("html").alias("f")).select("f.*").collect()
    assert rows[0].tag_count == 1


def test_native_plan_has_no_python(spark):
    frame = spark.createDataFrame([("<p>",)], "html string")
    plan = H.with_html_features(frame, "html", exact=False)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
