"""HTML structure counters and score, computed from the markup text in the JVM.

The markup is cut into tags by one regular expression; an array of small structs, one per
tag, is then folded into the counters. Markup the expression cannot read with certainty
(unclosed quotes, stray brackets, entities inside an attribute that is looked at) is
flagged `irregular`; `with_html_features` sends only those rows to the standard library
parser in Arrow batches.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailprism.functions.common import as_column

FEATURES = [
    "tag_count", "max_dom_depth", "inline_style_count", "external_resource_count",
    "hidden_element_count", "form_count", "script_count", "tailwind_class_count",
]

# Tags that load something, utility-class prefixes, hidden styles.
EXTERNAL_TAGS = ["img", "link", "script", "iframe"]
UTILITY_CLASS = r"(?:sm:|md:|lg:)?(?:text|bg|p|m|flex|grid|rounded|font)-"
HIDDEN_STYLE = r"display\s*:\s*none|visibility\s*:\s*hidden"

# Weights, limits and wording of the structure score.
REASON_UTILITY = "Tailwind-like utility classes in email HTML"
REASON_ACTIVE = "active or interactive HTML elements"
REASON_DEEP = "unusually deep DOM"
REASON_COMPLEX = "unusually complex inline layout"
REASON_HIDDEN = "multiple hidden elements"
REASON_NONE = "no strong anomalous HTML structure signals"

_S = r"[\s\x1c-\x1f]"
_ATTR = (
    r"[\s/]++[^\s/>=\"'<][^\s/>=\"'<]*+"
    r"(?:\s*+=\s*+(?:\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>])|[^\s>\"'=][^\s>\"'=]*+))?+"
)
_OPEN = rf"<[a-zA-Z][^\s/>\"'<]*+(?:{_ATTR})*+\s*+(?:/\s*+)?+>"
_CLOSE = r"</[a-zA-Z][^>\"'<]*+>"
# Group 3 is the tag. Comments, declarations and the text of script and style elements are
# consumed without it. Group 2 is an empty mark set for script and style only.
_TOKEN = (
    r"<!--(?!-?>)(?:[^-]++|-(?!-\s*+>))*+(?:--\s*+>|\z)"
    r"|<[!?][^>\[\-][^>]*+>"
    rf"|(?:(?=<((?i:script|style))[\s>])())?+({_OPEN}|{_CLOSE})"
    r"(?:\2(?<!/>)[\s\S]*?(?=</\s*+(?i:\1)\s*+>|\z))?+"
    r"|(<)(?=[a-zA-Z/!?])"
)
_STEP = (
    r"[\s/]++[^\s/>=\"'<]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'=]++))?+"
)


def _up_to(name: str) -> str:
    """The tag from its start to an attribute; attributes before it are skipped whole."""
    here = rf"[\s/]++(?i:{name})(?=[\s/>=])"
    return rf"^<[^\s/>]++(?:(?!{here}){_STEP})*+{here}"


def _attribute(tag: Column, name: str) -> Column:
    """Value of one attribute, empty when it has none."""
    value = F.regexp_extract(tag, _up_to(name) + r"\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>\"'=]++)", 1)
    return F.regexp_replace(value, r"^[\"']|[\"']$", "")


def _has_attribute(tag: Column, name: str) -> Column:
    return F.rlike(tag, F.lit(_up_to(name)))


def _describe(tag: Column, folded: Column) -> Column:
    """One token as flags; attribute expressions run only where the name occurs at all."""
    opens = ~F.startswith(tag, F.lit("</"))
    name = F.regexp_extract(folded, r"^<([a-z][^\s/>]*+)", 1)
    maybe_style = opens & F.contains(folded, F.lit("style"))
    maybe_class = opens & F.contains(folded, F.lit("class"))
    maybe_hidden = opens & F.contains(folded, F.lit("hidden"))
    maybe_none = maybe_style & (F.contains(folded, F.lit("none")) | F.contains(folded, F.lit("hidden")))
    styled = F.when(maybe_style, _has_attribute(tag, "style")).otherwise(F.lit(False))
    hidden = F.when(maybe_hidden, _has_attribute(tag, "hidden")).otherwise(F.lit(False))
    hidden_style = F.when(maybe_none, F.rlike(_attribute(tag, "style"), F.lit(f"(?i){HIDDEN_STYLE}"))).otherwise(F.lit(False))
    utility = F.when(
        maybe_class & F.contains(tag, F.lit("-")),
        F.size(F.regexp_extract_all(_attribute(tag, "class"), F.lit(rf"(?<![^\s\x1c-\x1f])({UTILITY_CLASS})"), F.lit(1))),
    ).otherwise(F.lit(0))
    repeated = F.rlike(folded, F.lit(r"[\s/](style|class)(?=[\s/=>]).*[\s/]\1(?=[\s/=>])"))
    odd = (
        (tag == "<")
        | ((maybe_style | maybe_class | maybe_hidden) & (F.contains(tag, F.lit("&")) | repeated))
    )
    # A slash closes the element only where no bare attribute value has swallowed it.
    closes = opens & F.rlike(tag, F.lit(r"/>$")) & ~F.rlike(tag, F.lit(r"=\s*+[^\s\"'>]*/>$"))
    odd = odd | (opens & F.rlike(tag, F.lit(r"/\s+>$")))
    return F.struct(
        opens.alias("opens"),
        closes.alias("closes"),
        name.alias("name"),
        styled.alias("styled"),
        (hidden | hidden_style).alias("hidden"),
        utility.alias("utility"),
        odd.alias("odd"),
    )


def html_features(html: Column | str) -> Column:
    """Struct of the eight counters plus `irregular`, with no Python worker involved."""
    text = F.coalesce(as_column(html), F.lit(""))
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    # Tokens of comments and declarations carry no tag; script bodies are cut off again.
    kept = F.filter(tokens, lambda t: ~F.rlike(t, F.lit(r"^<[!?][\s\S]")))
    tags = F.transform(
        kept,
        lambda t: F.when(
            F.rlike(t, F.lit(r"^<(?i:script|style)[\s>]")), F.regexp_extract(t, rf"^{_OPEN}", 0)
        ).otherwise(t),
    )
    described = F.transform(tags, lambda t: _describe(t, F.lower(t)))

    def integer(flag: Column) -> Column:
        return flag.cast("int")

    def step(acc: Column, t: Column) -> Column:
        opened = acc["depth"] + integer(t["opens"])
        return F.struct(
            F.greatest(
                opened - F.when(t["opens"], integer(t["closes"])).otherwise(F.lit(1)), F.lit(0)
            ).alias("depth"),
            (acc["tag_count"] + integer(t["opens"])).alias("tag_count"),
            F.greatest(acc["max_dom_depth"], opened).alias("max_dom_depth"),
            (acc["inline_style_count"] + integer(t["styled"])).alias("inline_style_count"),
            (acc["external_resource_count"] + integer(t["opens"] & t["name"].isin(EXTERNAL_TAGS))).alias(
                "external_resource_count"
            ),
            (acc["hidden_element_count"] + integer(t["hidden"])).alias("hidden_element_count"),
            (acc["form_count"] + integer(t["opens"] & (t["name"] == "form"))).alias("form_count"),
            (acc["script_count"] + integer(t["opens"] & (t["name"] == "script"))).alias("script_count"),
            (acc["tailwind_class_count"] + t["utility"]).alias("tailwind_class_count"),
            (acc["irregular"] | t["odd"]).alias("irregular"),
        )

    zero = F.struct(
        F.lit(0).alias("depth"), *[F.lit(0).alias(f) for f in FEATURES], F.lit(False).alias("irregular")
    )
    kept_fields = [*FEATURES, "irregular"]
    return F.aggregate(described, zero, step, lambda acc: F.struct(*[acc[f].alias(f) for f in kept_fields]))


class _TagLog(HTMLParser):
    """Keeps what the counters need of each tag: depth change, name and attributes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.log = []

    def handle_starttag(self, tag, attrs):
        self.log.append((1, tag, dict(attrs)))

    def handle_endtag(self, tag):
        self.log.append((-1, tag, {}))


def _count_with_parser(markup: str) -> dict:
    parser = _TagLog()
    try:
        parser.feed(markup)
    except Exception:  # malformed markup: count what was read so far
        pass
    opened = [(name, attrs) for change, name, attrs in parser.log if change > 0]
    depth = deepest = 0
    for change, _, _ in parser.log:
        depth = max(depth + change, 0)
        deepest = max(deepest, depth)
    names = [name for name, _ in opened]
    classes = [c for _, attrs in opened for c in (attrs.get("class") or "").split()]
    return {
        "tag_count": len(opened),
        "max_dom_depth": deepest,
        "inline_style_count": sum("style" in attrs for _, attrs in opened),
        "external_resource_count": sum(name in EXTERNAL_TAGS for name in names),
        "hidden_element_count": sum(
            "hidden" in attrs or bool(re.search(HIDDEN_STYLE, attrs.get("style") or "", re.I))
            for _, attrs in opened
        ),
        "form_count": names.count("form"),
        "script_count": names.count("script"),
        "tailwind_class_count": sum(bool(re.match(UTILITY_CLASS, c)) for c in classes),
    }


@F.arrow_udf(T.StructType([T.StructField(f, T.IntegerType()) for f in FEATURES]))
def _features_by_parser(markup: pa.Array) -> pa.Array:
    nothing = dict.fromkeys(FEATURES)
    rows = [nothing if m is None else _count_with_parser(m) for m in markup.to_pylist()]
    return pa.array(rows, pa.struct([(f, pa.int32()) for f in FEATURES]))


def with_html_features(df: DataFrame, html: str, exact: bool = True) -> DataFrame:
    """Add the eight counters as columns.

    With `exact`, rows whose markup is irregular are counted by the standard parser; the
    Arrow function gets NULL for every other row. Without it the plan is JVM only.
    """
    native = df.withColumn("_html", html_features(html))
    if not exact:
        return native.select(*df.columns, *[F.col(f"_html.{f}").alias(f) for f in FEATURES])
    by_parser = native.withColumn(
        "_parsed", _features_by_parser(F.when(F.col("_html.irregular"), F.col(html)))
    )
    return by_parser.select(
        *df.columns, *[F.coalesce(F.col(f"_parsed.{f}"), F.col(f"_html.{f}")).alias(f) for f in FEATURES]
    )


def _structure_rules() -> list[tuple[Column, float, str]]:
    c = F.col
    return [
        (c("tailwind_class_count") > 0, 0.30, REASON_UTILITY),
        ((c("script_count") > 0) | (c("form_count") > 0), 0.25, REASON_ACTIVE),
        (c("max_dom_depth") > 12, 0.15, REASON_DEEP),
        ((c("inline_style_count") > 40) | (c("tag_count") > 180), 0.15, REASON_COMPLEX),
        (c("hidden_element_count") > 3, 0.10, REASON_HIDDEN),
    ]


def html_score() -> Column:
    """Sum of the weights of the rules that hold; reads the eight counter columns."""
    points = F.lit(0.0)
    for rule, weight, _ in _structure_rules():
        points = points + F.when(rule, F.lit(weight)).otherwise(F.lit(0.0))
    return F.bround(F.least(points, F.lit(1.0)), 3)


def html_reason() -> Column:
    found = F.concat_ws("; ", *[F.when(rule, F.lit(text)) for rule, _, text in _structure_rules()])
    return F.when(found == "", F.lit(REASON_NONE)).otherwise(found)
