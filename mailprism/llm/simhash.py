"""Near-duplicates by SimHash with multi-index hashing.

A fingerprint has 64 bits per word; it is cut into segments. If two fingerprints differ in
few bits, then in some segment they differ in very few: with segment radii r1, r2, ... a
pair within distance d is found in some segment when the sum of (r + 1) exceeds d. Every
fingerprint stands in one table per segment; it looks up all values of the small Hamming
ball around its own segment, and the complete distance is verified in the join itself, so
only true links leave it. Equal fingerprints are one row from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailprism.llm.common import written
from mailprism.llm.components import components

SEED = 42
# The operator's own contract: words in a shingle, bits that may differ.
SHINGLE, DISTANCE = 3, 3
# Segments of the fingerprint: (first bit, bits, radius); the sum of (radius + 1) is 4.
SEGMENTS = ((0, 32, 1), (32, 32, 1))
# Stands for the id of a row that has none: it comes last.
_NO_ID = (1 << 63) - 1


def shingle_hashes(text: str | None, words_in: int) -> np.ndarray:
    """XXH64 of all shingles of a text, repeats included; of no words, none.

    bytes.lower() changes A-Z only and bytes.split() splits at \\x20 and \\x09-\\x0D only.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    if len(words) <= words_in:
        spans = [(0, len(line))]
    else:
        spans = zip(starts, (e - 1 for e in ends[words_in - 1 :]))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; zero for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # 64 bytes a hash
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(text: Column, words_in: int = SHINGLE) -> Column:
    """The 64-bit SimHash of a text, as a signed integer."""

    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(shingle_hashes(t, words_in)) for t in texts], dtype="int64")

    return F.pandas_udf(compute, "bigint")(text)


def _ball(bits: int, radius: int) -> list[int]:
    """All masks of up to `radius` of `bits` bits."""
    masks, layer = [0], [0]
    for _ in range(radius):
        layer = sorted({m | 1 << i for m in layer for i in range(bits) if not m >> i & 1})
        masks += layer
    return masks


def links(prints: DataFrame, distance: int = DISTANCE, segments=SEGMENTS) -> DataFrame:
    """(a, b): fingerprints of the distinct column `fp` with `distance` bits or fewer between them, a < b.

    A pair may come once per segment that finds it. The join is a merge at every size: Spark
    takes exploded rows for as few as there were before, and would broadcast the balls.
    """
    if sum(radius + 1 for _, _, radius in segments) <= distance:
        raise ValueError("the segments' balls do not cover the distance")

    def part(first: int, bits: int) -> Column:
        return F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1))

    table = prints.select("fp", F.explode(F.array(*(
        F.struct(F.lit(i).alias("s"), part(first, bits).alias("v")) for i, (first, bits, _) in enumerate(segments)
    ))).alias("k")).select(F.col("fp").alias("a"), F.col("k.s").alias("s"), F.col("k.v").alias("v"))

    def around(i: int, first: int, bits: int, radius: int) -> Column:
        masks = F.array(*(F.lit(m).cast("long") for m in _ball(bits, radius)))
        return F.transform(masks, lambda m: F.struct(F.lit(i).alias("s"), part(first, bits).bitwiseXOR(m).alias("v")))

    balls = F.concat(*(around(i, *segment) for i, segment in enumerate(segments)))
    near = prints.select("fp", F.explode(balls).alias("k"))
    near = near.select(F.col("fp").alias("b"), F.col("k.s").alias("t"), F.col("k.v").alias("w"))
    close = (F.col("s") == F.col("t")) & (F.col("v") == F.col("w")) & (F.col("a") < F.col("b")) & (
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    )
    return table.join(near.hint("merge"), close).select("a", "b")


def _with_component(prints: DataFrame, distance: int, segments) -> DataFrame:
    """`prints`, with one row for each `fp`, and the smallest fingerprint that links reach from it."""
    groups = components(links(prints.select("fp"), distance, segments))
    # A fingerprint without links is a component of its own.
    return prints.join(groups.hint("merge"), prints["fp"] == groups["node"], "left").select(*prints.columns, F.coalesce("component", "fp").alias("component"))


def simhash_components(
    docs: DataFrame, words_in: int = SHINGLE, distance: int = DISTANCE, segments=SEGMENTS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    The component is the smallest id that links reach. Texts without words have fingerprint
    zero and are linked like any other. Rows that repeat are repeated; a row without an id
    gets the component of its group, NULL if nobody in it has an id. An empty table gives
    an empty result. Fingerprints and components grow with the rows: nothing is broadcast.
    """
    prints = docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprints(F.col(text_col), words_in).alias("fp"))
    prints = written(prints, "prints")
    least = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "least")
    named = _with_component(least, distance, segments)
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest.hint("merge"), "component").select(F.col("fp").alias("f"), "component_id")
    return prints.join(named.hint("merge"), F.col("fp") == F.col("f")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(
    docs: DataFrame, words_in: int = SHINGLE, distance: int = DISTANCE, segments=SEGMENTS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """`docs` with one row of each component of `simhash_components`: one of the smallest id; all columns as they were.

    Of a component in which nobody has an id, and of rows that repeat the smallest id, one
    stays as well. Texts without words, NULL among them, have equal fingerprints and are one
    component. Links and components work on fingerprints, numbers and ids. The texts are
    written once and shuffled once, by a merge join at every size, since what stays grows
    with the documents.
    """
    whole = written(docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"),
        fingerprints(F.col(text_col), words_in).alias("fp"), F.struct(*docs.columns).alias("row"),
    ), "documents")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "rid")).alias("first")
    prints = written(whole.groupBy("fp").agg(first), "prints")
    one = _with_component(prints, distance, segments).groupBy("component").agg(F.min("first").alias("first"))
    stay = one.select(F.col("first.rid").alias("r"))
    kept = whole.join(stay.hint("merge"), F.col("rid") == F.col("r"), "left_semi")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
