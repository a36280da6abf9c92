"""Sources mixed to target weights, met by whole documents.

Targets share a budget by weight; none exceeds twice its source. A source is taken in full
as often as its target allows; the rest of the target is a subset-sum problem over the
number of documents of each exact length: every length first gives its even share, and a
bounded knapsack over bit sets chooses lengths for what then remains. Within a length,
documents are chosen by a seeded hash, exactly as many as the fit wants.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailprism.llm.common import word_count, written

WEIGHTS = (3, 1, 2)
BUDGET_PERCENT = 150
MOST = 2  # times that a source, and a document, may be taken
SEED = 17
# Above this many words of remaining budget, lengths are taken from long to short.
KNAPSACK_WORDS = 1 << 15
_SLOT_BITS = 10
# Rows of a table by source and length, of 24 bytes each, that may be broadcast.
BROADCAST_CUTS = 200_000


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, percent: int = BUDGET_PERCENT, most: int = MOST):
    """The target of each (source, size), in order: by weight, at most `most` times the size.

    What a full source cannot take is shared again among the others by weight.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {name: weights[i % len(weights)] for i, (name, _) in enumerate(order)}
    budget, open_sources, target = percent * sum(n for _, n in order) / 100, dict(order), {}
    while open_sources:
        unit = budget / sum(weight[s] for s in open_sources)
        full = [s for s, n in open_sources.items() if weight[s] * unit > most * n]
        if not full:
            target |= {s: weight[s] * unit for s in open_sources}
            break
        for s in full:
            target[s] = float(most * open_sources.pop(s))
            budget -= target[s]
    return target


def fit_lengths(budget: int, counts: dict[int, int]) -> dict[int, int]:
    """How many documents of each length to take so that their lengths sum to `budget`.

    If no choice does, the sum stays below by as little as the knapsack finds.
    """
    total = sum(length * n for length, n in counts.items())
    if not total or budget <= 0:
        return {}
    budget = min(budget, total)
    taken = {length: n * budget // total for length, n in counts.items()}
    rest = budget - sum(length * n for length, n in taken.items())
    for length in sorted(counts, reverse=True):
        if rest <= KNAPSACK_WORDS:
            break
        more = min(counts[length] - taken[length], (rest - KNAPSACK_WORDS) // length)
        taken[length] += more
        rest -= more * length
    # Bounded knapsack: bit s of `sums` is set if s words can be made up. A length comes in
    # parcels of 1, 2, 4, ... documents; the sums before each parcel lead back to the choice.
    parcels, sums, mask = [], 1, (1 << rest + 1) - 1
    for length in sorted(counts):
        spare, size = min(counts[length] - taken[length], rest // length), 1
        while spare and not sums >> rest & 1:
            size = min(size, spare)
            parcels.append((length, size, sums))
            sums |= sums << length * size & mask
            spare, size = spare - size, 2 * size
    at = sums.bit_length() - 1
    for length, size, before in reversed(parcels):
        if not before >> at & 1:
            taken[length] += size
            at -= length * size
    return {length: n for length, n in taken.items() if n}


def _fit(plan: dict):
    def fit(counts: pd.DataFrame) -> pd.DataFrame:
        group = int(counts["grp"].iloc[0])
        chosen = fit_lengths(plan[group], dict(zip(counts["size"].tolist(), counts["n"].tolist())))
        return pd.DataFrame([(group, s, n) for s, n in chosen.items()], columns=["g", "s", "extra"])

    return fit


def _draw(seed: int, id_col: str, text_col: str) -> Column:
    """A row's seeded place among documents of its length, not negative."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 1)


def _by_length(table: DataFrame) -> DataFrame:
    """A written table by source and length, to be joined: broadcast if its counted number is small, else never."""
    return F.broadcast(table) if table.count() <= BROADCAST_CUTS else table.hint("merge")


def mix_plan(
    docs: DataFrame, weights: Iterable[int] = WEIGHTS, percent: int = BUDGET_PERCENT, most: int = MOST, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sources, cuts) of a mix.

    `rows` has id, source, size and draw of every row of `docs`. `sources` has one row per
    source: its size, target, and how often it is taken in full. `cuts` says for a source
    and length up to which draw its documents are taken once more.
    """
    spark = docs.sparkSession
    rows = written(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        _draw(seed, id_col, text_col).alias("draw"),
    ), "sizes")
    counts = written(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    sizes = [tuple(r) for r in counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()]
    wanted = targets(sizes, tuple(weights), percent, most)
    plan, table = {}, []
    for group, (name, words) in enumerate(sizes):
        target = wanted[name]
        passes = int(target // words) if words else 0
        plan[group] = round(target - passes * words)
        table.append((name, group, words, float(target), passes))
    sources = spark.createDataFrame(table, "of string, grp int, source_size bigint, target double, passes bigint")
    lengths = counts.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("of"))).filter("size > 0")
    chosen = written(
        lengths.select("grp", "size", "n").groupBy("grp").applyInPandas(_fit(plan), "g int, s bigint, extra bigint"), "chosen"
    )
    # Rank by draw within source and length, in slots, so that no length is one group.
    slotted = rows.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("of"))).select(
        "grp", "size", "draw", F.shiftright("draw", 63 - _SLOT_BITS).alias("slot")
    )
    open_rows = written(
        slotted.join(_by_length(chosen), (F.col("grp") == F.col("g")) & (F.col("size") == F.col("s"))).drop("g", "s"), "drawn"
    )
    before = Window.partitionBy("grp", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    partial = open_rows.groupBy("grp", "size", "slot").agg(F.count("*").alias("in_slot")).select(
        F.col("grp").alias("g"), F.col("size").alias("s"), F.col("slot").alias("t"),
        F.coalesce(F.sum("in_slot").over(before), F.lit(0)).alias("above"),
    )
    inside = Window.partitionBy("grp", "size", "slot").orderBy("draw")
    ranked = open_rows.withColumn("rank", F.row_number().over(inside)).join(
        partial.hint("merge"), (F.col("grp") == F.col("g")) & (F.col("size") == F.col("s")) & (F.col("slot") == F.col("t"))
    )
    cuts = ranked.filter(F.col("above") + F.col("rank") <= F.col("extra")).groupBy("grp", "size").agg(F.max("draw").alias("cut"))
    return rows, sources, written(cuts.select(F.col("grp").alias("g"), F.col("size").alias("s"), "cut"), "cuts")


def _with_times(rows: DataFrame, sources: DataFrame, cuts: DataFrame) -> DataFrame:
    """`rows`, which have `source`, `size` and `draw`, with the number of `times` each is taken.

    One row per source of the specification is broadcast, and the cuts if their counted
    number is small; beyond it they are joined by a merge.
    """
    named = rows.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("of")))
    joined = named.join(_by_length(cuts), (F.col("grp") == F.col("g")) & (F.col("size") == F.col("s")), "left")
    once_more = F.coalesce(F.col("draw") <= F.col("cut"), F.lit(False)).cast("long")
    return joined.withColumn("times", F.when(F.col("size") > 0, F.col("passes") + once_more).otherwise(F.lit(0)))


def mix_documents(docs: DataFrame, **parameters) -> DataFrame:
    """One row per row of `docs`: its size, its source's size and target, and the words taken.

    `taken` is a multiple of the size. Texts without words have size 0 and are never taken.
    The list of sources is the mix's specification, one weight each, and is held on the
    driver with one sum per source; documents are not. Rows that repeat an id and text are
    taken alike, so that at most such copies exceed what the fit wants. Parameters are those
    of `mix_plan`.
    """
    rows, sources, cuts = mix_plan(docs, **parameters)
    return _with_times(rows, sources, cuts).select(
        "doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken")
    )


def mixed_corpus(
    docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **parameters
) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, all columns as they were.

    The choice is looked up while the documents are read, so texts are not shuffled unless
    the table of cuts is too large to broadcast.
    """
    _, sources, cuts = mix_plan(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **parameters)
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        _draw(seed, id_col, text_col).alias("draw"),
    )
    taken = _with_times(rows, sources, cuts).filter("times > 0")
    copies = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    return copies.select(*(F.col("row")[c].alias(c) for c in docs.columns))
