"""Campaigns of similar messages, kept from batch to batch.

A campaign has one representative, its first message; a message belongs to the earliest
representative whose set of word shingles is similar enough, and becomes a representative
itself if there is none. So ids never change when further messages come.

Candidates share a band of MinHash minima. One-bit minima of 256 more permutations travel
with every band, so that the join itself drops pairs that cannot be similar, and only likely
ones are verified on the exact sets. Among new messages the first of each bucket is compared
with the others of it (as many pairs as rows), which takes out all of a large campaign but its
first message; the few that are undecided after some rounds are compared pair by pair.

Texts are moved as seldom as can be: a band travels as two numbers until it is known that
others share it, only texts that share one are kept at hand for the comparisons, and their
shingles are made where two texts meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from mailprism.functions.common import as_column, let
from mailprism.operators.campaigns import campaign_pattern
from mailprism.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
# Bands of so many minima: a pair of similarity 0.8 shares none with a chance of 4 in 10,000.
BANDS, ROWS = 20, 5
BITS = 256
# Standard deviations of agreeing bits below a similar pair's mean that still count as likely.
MARGIN = 5
STAR_ROUNDS = 3
# Shingles hashed at a time: half a megabyte of numbers, which stays in a core's cache.
_CHUNK = 256

_REPRESENTATIVE = "node string, cluster_id string, pattern string, bits array<bigint>, bands array<bigint>"
_MEMBER = "email_id string, cluster_id string, text_id string"


def shingles(pattern: Column | str, size: int = SHINGLE) -> Column:
    """Distinct hashes of runs of `size` words; of fewer words, the whole; of none, none."""
    words = F.filter(F.split(as_column(pattern), " "), lambda w: w != "")

    # The words are computed once per row, not once per run.
    def runs(given: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(given) - size, F.lit(0)))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(given, i + 1, F.lit(size)), " ")))
        return F.when(F.size(given) > 0, F.array_distinct(hashes)).otherwise(F.array().cast("array<bigint>"))

    return let(words, runs)


def _permutations(seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    factors, shifts = rng.integers(0, 1 << 63, (2, BITS), dtype=np.uint64)
    return factors << np.uint64(1) | np.uint64(1), shifts


def _sketch(hashes: np.ndarray) -> tuple[list[int], list[int]]:
    """(bands, bits) of a set of hashes."""
    factors, shifts = _permutations()
    least = np.full(BITS, np.iinfo(np.uint64).max)
    values = np.asarray(hashes, np.int64).view(np.uint64)
    for at in range(0, len(values), _CHUNK):
        mixed = values[at : at + _CHUNK, None] ^ shifts
        mixed *= factors
        mixed ^= mixed >> np.uint64(29)
        np.minimum(least, mixed.min(axis=0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least[: BANDS * ROWS].reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    bits = np.packbits((least & np.uint64(1)).astype(np.uint8)).view(np.int64)
    return keys.view(np.int64).tolist(), bits.tolist()


def sketch(hashes: Column | str) -> Column:
    """Band keys and one-bit minima of a set of shingles."""

    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for sets in batches:
                yield pd.DataFrame([_sketch(s) for s in sets], columns=["bands", "bits"])

    return F.pandas_udf(compute, "bands array<bigint>, bits array<bigint>")(as_column(hashes))


def _unlikely(similarity: float) -> int:
    """Differing bits above which a pair is not similar, but for a chance of less than one in a million."""
    agree = (1 + similarity) / 2
    return int(BITS * (1 - agree) + MARGIN * (BITS * agree * (1 - agree)) ** 0.5)


def _likely(a: str, b: str, similarity: float) -> Column:
    differing = sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(BITS // 64)), F.lit(0))
    return differing <= _unlikely(similarity)


def _shared(sets: DataFrame, bands: DataFrame) -> DataFrame:
    """(node, bits, band) of `sets` for those of its bands that `bands` holds.

    Nodes of equal hash get each other's bands, which costs a comparison and changes nothing.
    """
    number = F.xxhash64("node").alias("number")
    found = sets.select(number, F.explode("bands").alias("band")).join(bands, "band", "left_semi")
    return sets.select(number, "node", "bits").join(found, "number").drop("number")


def _verified(pairs: DataFrame, left: DataFrame, right: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose sets, `left` of a and `right` of b, are similar; a set is given as shingles or by its pattern."""
    given = "pattern" if "pattern" in left.columns else "shingles"
    sets = pairs.join(left.select(F.col("node").alias("a"), F.col(given).alias("sa")), "a")
    sets = sets.join(right.select(F.col("node").alias("b"), F.col(given).alias("sb")), "b")

    def similar(a: Column, b: Column) -> Column:
        return let(F.size(F.array_intersect(a, b)), lambda common: common >= similarity * (F.size(a) + F.size(b) - common))

    if given == "shingles":
        return sets.filter(similar(F.col("sa"), F.col("sb"))).select("a", "b")
    return sets.filter(let(shingles("sa"), lambda a: let(shingles("sb"), lambda b: similar(a, b)))).select("a", "b")


def _without(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    return nodes.join(gone.select("node"), "node", "left_anti")


def _first_in_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no earlier chosen one is linked to, chosen in order; `edges` (a, b) with a before b."""
    chosen = []
    while True:
        free = cut_lineage(_without(nodes, edges.select(F.col("b").alias("node")).distinct()))
        chosen.append(free)
        taken = edges.join(free.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        nodes = cut_lineage(_without(_without(nodes, free), taken))
        if nodes.isEmpty():
            break
        left = nodes.select("node")
        edges = cut_lineage(edges.join(left.withColumnRenamed("node", "a"), "a", "left_semi").join(left.withColumnRenamed("node", "b"), "b", "left_semi"))
    out = chosen[0]
    for part in chosen[1:]:
        out = out.unionByName(part)
    return out


def _buckets(sets: DataFrame) -> DataFrame:
    """(node, bits, band) of the bands that several rows of `sets` have."""
    counted = sets.select(F.explode("bands").alias("band")).groupBy("band").agg(F.count("*").alias("n"))
    return cut_lineage(_shared(sets, counted.filter("n > 1").select("band")))


def _of(sets: DataFrame, bands: DataFrame) -> DataFrame:
    """What rows of `sets` that stand in `bands` are compared by."""
    given = "pattern" if "pattern" in sets.columns else "shingles"
    return cut_lineage(sets.select("node", given).join(bands.select("node").distinct(), "node", "left_semi"))


def _chosen(nodes: DataFrame, bands: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Nodes that are similar to no earlier representative, from their buckets and the texts in these.

    Earlier is the smaller node. A row is settled once it is the first undecided one of all
    its buckets; then it is compared with the other rows of these.
    """
    undecided, chosen = nodes, nodes.limit(0)
    for _ in range(STAR_ROUNDS):
        first = bands.groupBy("band").agg(F.min(F.struct("node", "bits")).alias("first"), F.count("*").alias("n")).filter("n > 1")
        stars = bands.join(first, "band").select(F.col("first.node").alias("a"), F.col("node").alias("b"), F.col("first.bits").alias("abits"), "bits")
        stars = stars.filter("a < b")
        free = cut_lineage(_without(undecided, stars.select(F.col("b").alias("node")).distinct()))
        pairs = stars.filter(_likely("abits", "bits", similarity)).select("a", "b").distinct()
        pairs = pairs.join(free.select(F.col("node").alias("a")), "a", "left_semi")
        taken = _verified(pairs, texts, texts, similarity).select(F.col("b").alias("node")).distinct()
        chosen = chosen.unionByName(free)
        undecided = cut_lineage(_without(_without(undecided, free), taken))
        if undecided.isEmpty():
            return chosen
        bands = cut_lineage(bands.join(undecided, "node", "left_semi"))
    close = bands.select(F.col("node").alias("a"), F.col("bits").alias("abits"), "band").join(bands.withColumnRenamed("node", "b"), "band")
    pairs = close.filter((F.col("a") < F.col("b")) & _likely("abits", "bits", similarity)).select("a", "b").distinct()
    edges = cut_lineage(_verified(pairs, texts, texts, similarity))
    return chosen.unionByName(_first_in_order(undecided, edges))


def representatives(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `sets` (node, shingles or pattern, bits, bands) that are similar to no earlier representative."""
    bands = _buckets(sets)
    return sets.join(_chosen(sets.select("node"), bands, _of(sets, bands), similarity), "node", "left_semi")


def _earliest(near: DataFrame, known: DataFrame, texts: DataFrame, known_texts: DataFrame, similarity: float) -> DataFrame:
    """(node, to): for each b of `near` the earliest known representative a that it is similar to, if any."""
    pairs = near.filter(_likely("abits", "bits", similarity)).select("a", "b").distinct()
    found = _verified(cut_lineage(pairs), known_texts, texts, similarity)
    order = known.select(F.col("node").alias("a"), "batch")
    return found.join(order, "a").groupBy(F.col("b").alias("node")).agg(F.min_by("a", F.struct("batch", "a")).alias("to"))


def _near(bands: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (a, abits, b, bits) of bands that a known row a and a row b share."""
    return bands.withColumnRenamed("node", "b").join(known.select(F.col("node").alias("a"), F.col("bits").alias("abits"), "band"), "band")


class CampaignStore:
    """Representatives and members of campaigns under a path that all executors reach.

    Each batch has a folder of its own that is replaced when the batch comes again, and only
    earlier batches are read, so a repeated batch changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, similarity: float = SIMILARITY) -> None:
        self.spark, self.path, self.similarity = spark, path.rstrip("/"), similarity

    def _read(self, name: str, schema: str, before: int | None) -> DataFrame:
        try:
            rows = self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{schema}, batch long")
        return rows if before is None else rows.filter(F.col("batch") < before)

    def representatives(self, before: int | None = None) -> DataFrame:
        return self._read("representatives", _REPRESENTATIVE, before)

    def members(self, before: int | None = None) -> DataFrame:
        """(email_id, cluster_id, text_id, batch) of every message with a word."""
        return self._read("members", _MEMBER, before)

    def _joined(self, sets: DataFrame, known: DataFrame) -> DataFrame:
        """(node, to) of the sets that belong to a known representative."""
        if known.isEmpty():
            return sets.select("node", F.col("node").alias("to")).limit(0)
        bands = cut_lineage(_shared(sets, known.select(F.explode("bands").alias("band"))))
        near = _near(bands, _shared(known, bands.select("band")))
        return _earliest(near, known, sets, known, self.similarity)

    def add(self, messages: DataFrame, key: str, clean: str, batch: int) -> DataFrame:
        """Put a batch of messages into campaigns; returns its members, (email_id, cluster_id, text_id).

        Messages that differ in digits only are one node, named by the smallest id. NULL and
        empty texts belong to no campaign; a message without id counts as one of an empty id.
        """
        marked = messages.select(
            F.coalesce(F.col(key).cast("string"), F.lit("")).alias("email_id"),
            campaign_pattern(clean).alias("pattern"), F.sha2(clean, 256).alias("text_id"),
        )
        # Read for the nodes and again for the members: kept, so that texts are cleaned once.
        marked = marked.withColumn("fp", F.sha2("pattern", 256)).persist(StorageLevel.DISK_ONLY)
        try:
            return self._add(marked.filter("pattern is not null"), batch)
        finally:
            marked.unpersist()

    def _add(self, marked: DataFrame, batch: int) -> DataFrame:
        """The rest of `add` for (email_id, pattern, text_id, fp) of messages with a text."""
        nodes = marked.groupBy("fp").agg(F.min("email_id").alias("first"), F.min("pattern").alias("pattern"))
        # Names are ordered by id; the fingerprint tells nodes of equal ids apart.
        # Texts with a word have shingles; a filter on the shingles themselves would make them again.
        nodes = nodes.filter(F.trim("pattern") != "")
        sets = nodes.select(F.concat_ws(" ", "first", "fp").alias("node"), F.col("fp"), "pattern", shingles("pattern").alias("shingles"))
        sets = sets.withColumn("sketch", sketch("shingles"))
        # Read twice here, the shingles are a column, without which Spark cannot hand them to Python.
        sets = cut_lineage(sets.select("node", "fp", "pattern", F.size("shingles").alias("n"), "sketch.bits", "sketch.bands"))
        known = self.representatives(batch)
        old = cut_lineage(self._joined(sets, known))
        left = cut_lineage(_without(sets.select("node", "bits", "bands"), old))
        bands = _buckets(left)
        texts = _of(sets, bands)
        chosen = cut_lineage(_chosen(left.select("node"), bands, texts, self.similarity))
        new = sets.join(chosen, "node", "left_semi").withColumn("cluster_id", F.col("fp"))
        new.select("node", "cluster_id", "pattern", "bits", "bands").write.mode("overwrite").parquet(
            f"{self.path}/representatives/batch={batch}"
        )
        new = self.representatives().filter(F.col("batch") == batch)
        # Whoever is similar to a new representative shares a bucket with it.
        near = _near(_without(bands, chosen), bands.join(chosen, "node", "left_semi"))
        mine = _earliest(near, new, texts, texts, self.similarity).unionByName(old)
        mine = mine.unionByName(new.select("node", F.col("node").alias("to")))
        names = known.unionByName(new).select(F.col("node").alias("to"), "cluster_id")
        clusters = sets.select("node", "fp").join(mine, "node").join(names, "to").select("fp", "cluster_id")
        marked.join(clusters, "fp").select("email_id", "cluster_id", "text_id").write.mode("overwrite").parquet(
            f"{self.path}/members/batch={batch}"
        )
        return self.members().filter(F.col("batch") == batch).drop("batch")

    def campaigns(self, min_messages: int = 2) -> DataFrame:
        """Campaigns so far: messages, distinct cleaned texts and the representative's pattern."""
        variants = self.members().groupBy("cluster_id", "text_id").agg(F.count("*").alias("n"))
        sizes = variants.groupBy("cluster_id").agg(F.sum("n").alias("messages"), F.count("*").alias("variations_detected"))
        patterns = self.representatives().select("cluster_id", "pattern")
        return sizes.filter(F.col("messages") >= min_messages).join(patterns, "cluster_id").select(
            "cluster_id", "messages", "variations_detected", "pattern"
        )

    def context(self, min_messages: int = 2) -> DataFrame:
        """Campaign of each message that belongs to one: `email_id` and the context fields."""
        found = self.campaigns(min_messages).select("cluster_id", "variations_detected", "pattern")
        return self.members().select("email_id", "cluster_id").join(found, "cluster_id").select(
            "email_id", "cluster_id", "variations_detected", "pattern"
        )

    def sink(self, key: str, clean: str):
        """For `foreachBatch` of a stream of messages."""
        return lambda rows, batch: self.add(rows, key, clean, batch) and None
