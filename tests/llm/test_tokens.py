"""Token ids, Simple-8b, token files and packing: against the library, and round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures import plain
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mailprism.llm import packing, simple8b
from mailprism.llm.token_files import read_token_files, token_table, write_token_files
from mailprism.llm.tokens import TOKENIZER, crc_of, document_ids, encoder


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(TOKENIZER))


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def test_pieces_give_the_ids_of_the_whole_text(library):
    rng = random.Random(5)
    parts = ["a", " ", " b", "\n", "it's", ",", ".", "_", "!", "12", "é", "<|endoftext|>", " ", "\t", "３", "Wörter", "\x1c", "\U0001F600", "́"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert document_ids(text).tolist() == ids_of(library, text), repr(text)


def test_encoder_forgets_without_changing_ids(library, monkeypatch):
    monkeypatch.setattr("mailprism.llm.tokens.MEMO_PIECES", 5)
    for text in ("one two three four five", "six seven eight", "a b c d e f g h", "one two six"):
        assert encoder().encode(text).tolist() == ids_of(library, text)[:-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=400))
def test_simple8b_round_trip(values):
    words, offsets = simple8b.encode(np.array(values, np.uint64))
    assert simple8b.decode(words, offsets, len(values)).tolist() == values


def test_simple8b_blocks_decode_alone():
    values = np.random.default_rng(1).integers(0, 50_257, 1000).astype(np.uint64)
    words, offsets = simple8b.encode(values)
    part = words[offsets[2] : offsets[4]]
    assert (simple8b.decode(part, offsets[2:4] - offsets[2], 256) == values[256:512]).all()
    assert words.nbytes < 2.8 * len(values)


def test_token_files_read_back(corpus, documents, library, tmp_path):
    rows = sorted(documents.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    want, start = [], 0
    for row in rows:
        ids = ids_of(library, row.text)
        want.append((row.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    path = f"{tmp_path}/files"
    write_token_files(documents, path, segment_tokens=500)
    assert plain(read_token_files(corpus, path).collect()) == plain(want)
    assert plain(token_table(documents).collect()) == plain(want)
    assert token_table(documents.limit(0)).count() == 0


def test_rows_without_an_id_are_several_ranges(corpus, library, tmp_path):
    rows = [(None, f"row {i % 700} of many") for i in range(2000)]
    frame = corpus.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = f"{tmp_path}/files"
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    corpus.conf.set(setting, "false")  # ranges this small would be joined again
    try:
        write_token_files(frame, path)
    finally:
        corpus.conf.unset(setting)
    files = corpus.read.parquet(path)
    per_shard = [r.n for r in files.selectExpr("shard", "size(doc_ids) as k").groupBy("shard").sum("k").toDF("shard", "n").collect()]
    assert len(per_shard) > 1 and sum(per_shard) == 2000 and max(per_shard) < 1500
    got = read_token_files(corpus, path).orderBy("start").collect()
    want = [ids_of(library, text) for _, text in sorted(rows, key=lambda r: r[1])]
    assert [r.n_tokens for r in got] == [len(ids) for ids in want]
    assert [r.ids_crc32 for r in got] == [crc_of(np.array(ids)) for ids in want]


@pytest.mark.parametrize("low, high", [(0, 2), (0, 50_257), (1 << 15, 1 << 17), (0, 2**62)])
def test_simple8b_of_one_range(low, high):
    values = np.random.default_rng(low + 1).integers(low, high, 5000).astype(np.uint64)
    words, offsets = simple8b.encode(values)
    assert (simple8b.decode(words, offsets, 5000) == values).all()


def check_packing(pieces, rows, library, limit):
    by_doc = {}
    for row in rows:
        ids = ids_of(library, row.text)
        head = len(ids) % limit
        edges = sorted({0, head, *range(head, len(ids) + 1, limit)})
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            by_doc.setdefault((row.doc_id, i, a, b - a, crc_of(np.array(ids[a:b]))), []).append(1)
    got = {}
    bins = {}
    for p in pieces:
        got.setdefault((p.doc_id, p.piece, p.start, p.length, p.ids_crc32), []).append(1)
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert got == by_doc
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return bins


def test_packing_places_every_piece(documents, library):
    rows = documents.select("doc_id", "text").collect()
    for limit, tasks in ((64, 50), (2048, 100_000)):
        bins = check_packing(packing.pack_documents(documents, limit, task_pieces=tasks).collect(), rows, library, limit)
        total = sum(len(ids_of(library, r.text)) for r in rows)
        assert len(bins) <= 1.15 * total / limit + 2
    assert packing.pack_documents(documents.limit(0)).count() == 0


def test_few_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]
    # The bin with 7 closed as the fullest of two open ones.
    assert bins.place(3) == (0, 6) and bins.place(2) == (2, 8)
    assert bins.still_open().tolist() == [0]
