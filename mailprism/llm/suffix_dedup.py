"""Repeated byte strings, found with a logarithmic family of sparse suffix arrays.

The suffixes that start at anchors (see `anchors`) are enough: strings of the match length
that are equal have equal anchors. A suffix array here holds, in the order of the hash of
their first bytes, the sampled suffixes of some batches: how many there are of each, and
the hashes of their contexts, a context being all strings of one anchor taken together.
A new batch gets its own array. It is merged with the levels of equal size, which become one
level of twice the size and so on, and scanned against the others; both tell which suffixes
occur more than once.

Contexts that are equal as a whole are repeated as a whole. Where the contexts of a suffix
differ, one of each kind is cut into pieces of some strings. The bytes that all strings of a
piece share are its core; a core that occurs once has no repeated string. Pieces that differ
around equal cores are cut into their strings, so the exact ends of every repeat are found
by equality alone. No group of equal suffixes is gathered or paired: everything is a count
or a minimum per key, and a join back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailprism.llm.anchors import find_anchors
from mailprism.llm.common import written

MATCH = 400
BATCHES = 4
# Strings in a piece of a context.
PIECE = 16
# Texts are searched for anchors together up to so many bytes.
GROUP_BYTES = 1 << 21

ENTRY = "did bigint, digest bigint, x int, lo int, hi int, g bigint, u bigint"
_NO_ID = -(1 << 63)


def _hash(data: bytes) -> int:
    import xxhash

    value = xxhash.xxh3_64_intdigest(data)
    return value - (1 << 64) if value >> 63 else value


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(did, digest, text): rows are told apart by id and text; equal rows have equal results."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("did"), F.xxhash64(text).alias("digest"), text.alias("text")
    )


def _entries(match: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("did").to_numpy(zero_copy_only=False)
            digests = batch.column("digest").to_numpy(zero_copy_only=False)
            sizes = np.array([len(t.as_buffer()) for t in batch.column("text")], np.int64)
            group = (np.cumsum(sizes) - sizes) // GROUP_BYTES
            for rows in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(group)) + 1):
                texts = [batch.column("text")[int(i)].as_buffer().to_pybytes() for i in rows]
                of, x, lo, hi, g = find_anchors(texts, match)
                u = [_hash(texts[i][a : b + match]) for i, a, b in zip(of.tolist(), lo.tolist(), hi.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[rows[of]]), pa.array(digests[rows[of]]), pa.array(x, pa.int32()), pa.array(lo, pa.int32()),
                        pa.array(hi, pa.int32()), pa.array(g.view(np.int64)), pa.array(u, pa.int64()),
                    ],
                    ["did", "digest", "x", "lo", "hi", "g", "u"],
                )

    return find


class SuffixIndexFamily:
    """Levels of sparse suffix arrays whose sizes, in batches, are different powers of two."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []
        self._repeated: list[DataFrame] = []

    def add(self, entries: DataFrame) -> None:
        """Index a batch: merge it with levels of equal size, scan it against the others."""
        array = entries.groupBy("g").agg(F.count("*").alias("n"), F.min("u").alias("least"), F.max("u").alias("most"))
        size, parts = 1, [array.select("*", F.lit(0).alias("old"))]
        while self.levels and self.levels[-1][0] == size:
            parts.append(self.levels.pop()[1].select("*", F.lit(1).alias("old")))
            size *= 2
        merged = parts[0]
        for part in parts[1:]:
            merged = merged.unionByName(part)
        merged = merged.groupBy("g").agg(
            F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")
        ) if len(parts) > 1 else merged.drop("old")
        merged = written(merged.sortWithinPartitions("g"), "level")
        self._repeated.append(merged.filter("n > 1").select("g"))
        for _, level in self.levels:
            self._repeated.append(merged.join(level.select(F.col("g").alias("other")), F.col("g") == F.col("other"), "left_semi").select("g"))
        self.levels.append((size, merged))

    def repeated(self) -> DataFrame:
        """(of, n, least, most) of every suffix that occurs twice or more in all batches."""
        if not self.levels:
            raise ValueError("no batch has been added")
        keys = self._repeated[0]
        for part in self._repeated[1:]:
            keys = keys.unionByName(part)
        rows = self.levels[0][1]
        for _, level in self.levels[1:]:
            rows = rows.unionByName(level)
        rows = rows.join(keys.distinct().select(F.col("g").alias("key")), F.col("g") == F.col("key"), "left_semi")
        return rows.groupBy(F.col("g").alias("of")).agg(
            F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")
        )


def _contexts(match: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, marks in zip(batch.column("text"), batch.column("marks").to_pylist()):
                data = text.as_buffer()
                for m in marks:
                    out.append((m["eid"], m["g"], m["w"], m["x"] - m["hi"], m["x"] - m["lo"], data.slice(m["lo"], m["hi"] + match - m["lo"]).to_pybytes()))
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int8(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["eid", "g", "w", "near", "far", "context"]
            )

    return cut


CONTEXT = "eid bigint, g bigint, w tinyint, near int, far int, context binary"
PART = "eid bigint, core bigint, w tinyint, at int, h bigint"


def _pieces(match: int):
    """Pieces of `PIECE` strings of contexts, by the distance `at` of the piece from the anchor."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                near, far, data = row["near"], row["far"], row["context"]
                first = row["g"].to_bytes(8, "little", signed=True)
                for j in range(near // PIECE, far // PIECE + 1):
                    a, b = j * PIECE, j * PIECE + PIECE - 1
                    # Strings start a ... b bytes before the anchor, `far` bytes into the context; the
                    # core lies in all of them, also in those outside near ... far.
                    core = _hash(first + data[far - a : far - b + match])
                    rows.append((row["eid"], core, row["w"], j, _hash(data[far - min(b, far) : far - max(a, near) + match])))
            yield _part_batch(rows)

    return cut


def _strings(match: int):
    """The strings of chosen pieces, one by one; `at` is the distance from the anchor."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                near, far, data = row["near"], row["far"], row["context"]
                for p in row["pieces"]:
                    for a in range(max(near, p["at"] * PIECE), min(far, p["at"] * PIECE + PIECE - 1) + 1):
                        rows.append((row["eid"], p["core"], row["w"], a, _hash(data[far - a : far - a + match])))
            yield _part_batch(rows)

    return cut


def _part_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int8(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["eid", "core", "w", "at", "h"])


def _twice(eid_low: str = "e1", eid_high: str = "e2") -> Column:
    """True if more than one entry, or an entry that stands for several, has the key."""
    return (F.col(eid_low) < F.col(eid_high)) | (F.col("most_w") > 1)


def _classes(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(
        F.min("eid").alias("e1"), F.max("eid").alias("e2"), F.max("w").alias("most_w"), F.min("h").alias("h1"), F.max("h").alias("h2")
    )


def _on(*keys: str) -> Column:
    test = F.lit(True)
    for key in keys:
        test = test & (F.col(key) == F.col(f"_{key}"))
    return test


def repeated_intervals(docs: DataFrame, match: int = MATCH, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, digest, start, end): byte ranges made of strings that start elsewhere too; they overlap."""
    keyed = _keyed(docs, id_col, text_col)
    entries = written(keyed.filter(F.octet_length("text") >= match).mapInArrow(_entries(match), ENTRY), "entries")
    family = SuffixIndexFamily()
    for number in range(batches):
        family.add(entries.filter(F.pmod(F.xxhash64("did", "digest"), F.lit(batches)) == number))
    # Tables of counts are written before they are joined: the join then shuffles both sides
    # itself, and Spark splits a key that many rows share.
    repeated = written(family.repeated(), "repeated")
    found = entries.join(repeated, F.col("g") == F.col("of")).select(
        "did", "digest", "x", "lo", "hi", "g", "u", (F.col("least") < F.col("most")).alias("mixed")
    )
    found = written(found, "found")
    whole = found.filter("not mixed").select("did", "digest", F.col("lo").alias("start"), (F.col("hi") + match).alias("end"))

    mixed = found.filter("mixed").withColumn("eid", F.xxhash64("did", "digest", "x"))
    kinds = mixed.groupBy(F.col("g").alias("_g"), F.col("u").alias("_u")).agg(F.count("*").alias("n"), F.min("eid").alias("one"))
    kinds = written(kinds, "kinds")
    mixed = written(mixed.join(kinds, _on("g", "u")).select("did", "digest", "x", "lo", "hi", "g", "eid", "n", "one"), "mixed")
    equal = mixed.filter("n > 1").select("did", "digest", F.col("lo").alias("start"), (F.col("hi") + match).alias("end"))
    # One of each kind is looked at closely. Equal rows of `docs` give equal marks.
    marks = mixed.filter("eid = one").select(
        "did", "digest", "x", "lo", "hi", "g", "eid", F.least(F.col("n"), F.lit(2)).cast("tinyint").alias("w")
    ).distinct()
    # All marks of one document, as many as it has anchors.
    listed = marks.groupBy(F.col("did").alias("_did"), F.col("digest").alias("_digest")).agg(
        F.collect_list(F.struct("x", "lo", "hi", "g", "eid", "w")).alias("marks")
    )
    contexts = keyed.join(listed, _on("did", "digest")).select("text", "marks").mapInArrow(_contexts(match), CONTEXT)
    contexts = written(contexts, "contexts")

    pieces = written(contexts.mapInArrow(_pieces(match), PART), "pieces")
    groups = written(_classes(pieces, "core", "at").filter(_twice()), "groups")
    pieces = written(pieces.join(groups, _on("core", "at")).select("eid", "core", "w", "at", "h", (F.col("h1") < F.col("h2")).alias("mixed")), "shared")
    kinds = written(_classes(pieces.filter("mixed"), "core", "at", "h"), "kinds")
    judged = pieces.filter("mixed").join(kinds, _on("core", "at", "h")).select(
        "eid", "core", "at", _twice().alias("equal"), (F.col("eid") == F.col("e1")).alias("one")
    )
    judged = written(judged, "judged")
    same = pieces.filter("not mixed").select("eid", "at").unionByName(judged.filter("equal").select("eid", "at"))
    closer = judged.filter("one").select(F.col("eid").alias("_eid"), "core", "at").distinct().groupBy("_eid").agg(
        F.collect_list(F.struct("core", "at")).alias("pieces")
    )
    strings = contexts.join(closer, _on("eid")).select("eid", "w", "near", "far", "context", "pieces")
    strings = written(strings.mapInArrow(_strings(match), PART), "strings")
    equal_strings = written(_classes(strings, "core", "at", "h").filter(_twice()), "equal")
    single = strings.join(equal_strings, _on("core", "at", "h"), "left_semi").select("eid", F.col("at").alias("a"), F.col("at").alias("b"))
    ranges = same.select("eid", (F.col("at") * PIECE).alias("a"), (F.col("at") * PIECE + PIECE - 1).alias("b")).unionByName(single)
    # Back to the documents: distances a ... b from the anchor, within what the anchor stands for.
    place = marks.select("did", "digest", "x", "lo", "hi", F.col("eid").alias("_eid"))
    close = ranges.join(place, _on("eid")).select(
        "did", "digest", F.greatest(F.col("x") - F.col("b"), F.col("lo")).alias("start"),
        (F.least(F.col("x") - F.col("a"), F.col("hi")) + match).alias("end"),
    )
    return written(whole.unionByName(equal).unionByName(close), "intervals")


def _merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching intervals."""
    runs: list[tuple[int, int]] = []
    for start, end in sorted(intervals):
        if runs and start <= runs[-1][1]:
            runs[-1] = runs[-1][0], max(end, runs[-1][1])
        else:
            runs.append((start, end))
    return runs


def _kept(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for start, end in runs:
        parts.append(data[at:start])
        at = end
    return b"".join([*parts, data[at:]])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, removed, spans, left = [], [], [], []
        for text, intervals in zip(batch.column("text"), batch.column("intervals").to_pylist()):
            data = text.as_buffer().to_pybytes()
            runs = _merged([(i["start"], i["end"]) for i in intervals or ()])
            size.append(len(data))
            removed.append(sum(end - start for start, end in runs))
            spans.append(len(runs))
            left.append(_kept(data, runs))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(left, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def remove_repeats(
    docs: DataFrame, match: int = MATCH, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of `docs`; `kept` holds the bytes that are left.

    A character whose bytes are removed in part leaves bytes that are no UTF-8. Removed is every byte of a string of `match` bytes that also starts anywhere else. NULL
    counts as an empty text; shorter texts lose nothing; a row that repeats is repeated, and
    its text occurs elsewhere. Other columns are not read.
    """
    intervals = repeated_intervals(docs, match, batches, id_col, text_col)
    # All intervals of one document: no more than it has bytes.
    listed = intervals.groupBy(F.col("did").alias("_did"), F.col("digest").alias("_digest")).agg(
        F.collect_set(F.struct("start", "end")).alias("intervals")
    )
    rows = _keyed(docs, id_col, text_col).join(listed, _on("did", "digest"), "left").select(
        F.when(F.col("did") != _NO_ID, F.col("did")).alias("doc_id"), "text", "intervals"
    )
    return rows.mapInArrow(_removed, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def repeats_report(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of `remove_repeats` with the SHA-256 of what is left, and it as text.

    In `kept_text` what remains of a cut character stands as U+FFFD.
    """
    return remove_repeats(docs, **parameters).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"),
    )
