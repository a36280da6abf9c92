"""Links: extraction from HTML and text, anchors, host comparison and score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailprism.functions.common import as_column, let

# What counts as a link in an href attribute and in plain text.
HREF_PATTERN = r"""(?i)href=["']?(https?://[^"'\s>]+)"""
URL_PATTERN = r"""(?i)https?://[^\s<>"')\]]+"""

ANCHOR_PATTERN = r"""(?i)(<a\s[^>]*+>(?:[^<]++|<(?!/a\s*+>))*+)</a\s*+>"""
_ANCHOR_HREF = r"""(?i)\shref\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++)"""
_HOST_IN_TEXT = r"""(?i)(?:https?://)?((?:[\p{L}\p{N}-]+\.)+\p{L}{2,})"""

# Weights and wording of the link score; no figures for them are published.
WEIGHT_MISMATCH = 0.5
WEIGHT_SUSPICIOUS = 0.4
REASON_MISMATCH = "anchor text names another host than its URL"
REASON_SUSPICIOUS = "link to a suspicious domain"
REASON_NONE = "no suspicious links"


def href_links(html: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(as_column(html), F.lit("")), F.lit(HREF_PATTERN), F.lit(1))


def text_links(text: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(as_column(text), F.lit("")), F.lit(URL_PATTERN), F.lit(0))


def extract_links(html: Column | str, text: Column | str) -> Column:
    """href targets, then bare URLs of the text; first occurrence of each kept in place."""
    return F.array_distinct(F.concat(href_links(html), text_links(text)))


def anchors(html: Column | str) -> Column:
    """Array of (href, text) of the anchors that have an href."""
    found = F.regexp_extract_all(F.coalesce(as_column(html), F.lit("")), F.lit(ANCHOR_PATTERN), F.lit(1))
    pairs = F.transform(
        found,
        lambda a: F.struct(
            F.regexp_replace(F.regexp_extract(a, _ANCHOR_HREF, 1), r"^[\"']|[\"']$", "").alias("href"),
            F.trim(F.regexp_replace(F.regexp_replace(a, r"<[^>]++>", " "), r"\s+", " ")).alias("text"),
        ),
    )
    return F.filter(pairs, lambda p: p["href"] != "")


def url_host(url: Column | str) -> Column:
    """Lower-case host of an absolute URL, NULL for a relative one."""
    host = F.regexp_extract(F.lower(as_column(url)), r"^https?://(?:[^/?#@]*+@)?+([^/?#:]++)", 1)
    return F.nullif(host, F.lit(""))


def text_host(text: Column | str) -> Column:
    """Host named by an anchor text, NULL when it names none."""
    host = F.regexp_extract(as_column(text), _HOST_IN_TEXT, 1)
    return F.nullif(F.lower(host), F.lit(""))


def bare_host(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


# Letters of other alphabets that look like Latin ones, and these.
CONFUSABLE = "\u0430\u0441\u0435\u043e\u0440\u0445\u0443\u0456\u0458\u0455\u04bb\u0501\u051b\u051d\u03bf\u03b1\u03bd\u03c1\u0131\u0585"
LOOKS_LIKE = "aceopxyijshdqwoavpio"


def folded_host(host: Column) -> Column:
    """A host in lower case without `www.`, letters that look like Latin ones replaced by these."""
    return F.translate(bare_host(F.lower(host)), CONFUSABLE, LOOKS_LIKE)


def host_suffixes(host: Column) -> Column:
    """The folded host and all domains it lies in, longest first; NULL for NULL."""

    def suffixes(labels: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(labels))
        return F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))

    return let(F.split(folded_host(host), r"\."), suffixes)


def anchor_mismatch(href: Column | str, text: Column | str) -> Column:
    """The text names a host and the URL leads to another one."""
    named, target = bare_host(text_host(text)), bare_host(url_host(href))
    return F.coalesce(named != target, F.lit(False))


def explode_links(df: DataFrame, key: str, html: str, text: str) -> DataFrame:
    """One row per link of a message, with its place in the message."""
    return df.select(key, F.posexplode(extract_links(html, text)).alias("position", "link"))


def link_score(mismatches: Column | str, suspicious: Column | str) -> Column:
    points = F.when(as_column(mismatches) > 0, F.lit(WEIGHT_MISMATCH)).otherwise(F.lit(0.0)) + F.when(
        as_column(suspicious) > 0, F.lit(WEIGHT_SUSPICIOUS)
    ).otherwise(F.lit(0.0))
    return F.bround(F.least(points, F.lit(1.0)), 3)


def link_reason(mismatches: Column | str, suspicious: Column | str) -> Column:
    found = F.concat_ws(
        "; ",
        F.when(as_column(mismatches) > 0, F.lit(REASON_MISMATCH)),
        F.when(as_column(suspicious) > 0, F.lit(REASON_SUSPICIOUS)),
    )
    return F.when(found == "", F.lit(REASON_NONE)).otherwise(found)
