"""URL filter: rules by host and path, else a weighted vocabulary.

The vocabulary has strict terms, one of which rejects a URL, and soft terms, of which
several different ones do. An Aho-Corasick automaton finds all terms in one pass; a hit
counts only if no letter stands next to it. Weights say the same: a strict term weighs as
much as the limit, a soft term one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailprism.llm.common import ascii_lower

# Fixed values: (host/path, verdict); the longest rule that fits wins.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
STRICT = ("porn", "xxx", "hentai", "camgirls", "escorts", "warez", "malware", "spam", "phishing")
SOFT = (
    "adult", "sexy", "dating", "casino", "poker", "bet", "bets", "slots", "jackpot", "lottery", "loan", "loans", "payday",
    "pills", "viagra", "replica", "torrent", "cracked", "keygen", "farm", "free", "cheap", "download",
)
SOFT_LIMIT = 2

_machines: dict[tuple, object] = {}


def _machine(strict: tuple[str, ...], soft: tuple[str, ...]):
    if (strict, soft) not in _machines:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term in soft:
            machine.add_word(term, (term, False))
        for term in strict:
            machine.add_word(term, (term, True))
        machine.make_automaton()
        _machines[strict, soft] = machine
    return _machines[strict, soft]


def _letter(text: str, at: int) -> bool:
    return 0 <= at < len(text) and "a" <= text[at] <= "z"


def term_hits(url: str, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> tuple[int, int]:
    """Numbers of different strict and soft terms that stand free in a lower-cased URL."""
    hits = {
        (term, hard)
        for last, (term, hard) in _machine(strict, soft).iter(url)
        if not _letter(url, last + 1) and not _letter(url, last - len(term))
    }
    hard = sum(h for _, h in hits)
    return hard, len(hits) - hard


def _counted(strict: tuple[str, ...], soft: tuple[str, ...]):
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            yield pd.DataFrame([term_hits(u, strict, soft) for u in urls], columns=["strict_hits", "soft_hits"])

    return F.pandas_udf(count, "strict_hits int, soft_hits int")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for NULL or without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both NULL if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # the last that fits wins
        domain, _, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def filter_urls(
    pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, strict: tuple[str, ...] = STRICT,
    soft: tuple[str, ...] = SOFT, soft_limit: int = SOFT_LIMIT, id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """One row per row of `pages`: id, host, path, rule, verdict and the term counts.

    A NULL URL counts as an empty one: no host, no term, allowed. Repeated rows give
    repeated results; other columns are not read.
    """
    url = F.col(url_col)
    host, path = url_parts(url)
    rows = pages.select(
        F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"),
        _counted(strict, soft)(ascii_lower(F.coalesce(url, F.lit("")))).alias("hits"),
    )
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    bad = (F.col("hits.strict_hits") > 0) | (F.col("hits.soft_hits") >= soft_limit)
    own = F.when(bad, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
        F.col("hits.strict_hits").alias("strict_hits"), F.col("hits.soft_hits").alias("soft_hits"),
    )
