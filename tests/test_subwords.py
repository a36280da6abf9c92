"""Subword ids against a plain longest-match loop."""

import random
import re

import numpy as np
import pytest

from mailprism.functions import subwords
from mailprism.functions.subwords import SubwordEncoder, encoded, read_vocabulary
from mailprism.plans.model_scoring import score_text_model

SPECIALS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]"]


def plain(text, pieces, window):
    number = {}
    for i, p in enumerate(pieces):
        number.setdefault(p, i)
    out = []
    for word in re.findall(r"\w+|[^\w\s]", text or ""):
        found, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                piece = word[at:end] if at == 0 else "##" + word[at:end]
                if piece in number and not (at == 0 and piece.startswith("##") and len(piece) > 2):
                    break
            else:
                found = None
                break
            found.append(number[piece])
            at = end
        out += [number["[UNK]"]] if found is None or len(word) > 100 else found
    out = [number["[CLS]"], *out[: window - 2], number["[SEP]"]]
    return out + [number["[PAD]"]] * (window - len(out)), [1] * len(out) + [0] * (window - len(out))


@pytest.fixture(scope="module")
def pieces():
    rng = random.Random(1)
    found = list("abcdé.!#") + ["##" + c for c in "abcdé#"]
    found += ["".join(rng.choice("abcdé") for _ in range(rng.randint(2, 5))) for _ in range(60)]
    found += ["##" + "".join(rng.choice("abcdé") for _ in range(rng.randint(2, 4))) for _ in range(60)]
    return [*SPECIALS, *found, "abc", "abc"]


def texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        yield " ".join("".join(rng.choice("aabbccdé.!#z_9") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 120)))
    yield from (None, "", " \t\n", "a" * 100, "a" * 101, "abc " * 5_000, "ab cd", "日本 abc", "#", "##a")


@pytest.mark.parametrize("window", [2, 9, 256])
def test_ids_and_masks(spark, pieces, window):
    rows = list(enumerate(texts(window, 150)))
    frame = spark.createDataFrame(rows, "id int, clean string").repartition(3)
    shared = spark.sparkContext.broadcast(pieces)
    got = frame.select("id", encoded("clean", shared, window).alias("e")).select("id", "e.*").collect()
    assert {r.id: (list(r.ids), list(r["mask"])) for r in got} == {i: plain(t, pieces, window) for i, t in rows}
    assert window < 256 or max(sum(r["mask"]) for r in got) == 256  # longer texts are cut


def test_words_are_forgotten(pieces, monkeypatch):
    monkeypatch.setattr(subwords, "REMEMBERED", 3)
    encoder = SubwordEncoder(pieces)
    for text in texts(5, 20):
        assert encoder.encode(text) == plain(text, pieces, 256)


def test_vocabulary_file(spark, tmp_path, pieces):
    (tmp_path / "vocab.txt").write_text("\n".join(pieces) + "\n\n", encoding="utf-8")
    assert read_vocabulary(spark, f"{tmp_path}/vocab.txt") == pieces
    with pytest.raises(ValueError, match="lacks"):
        SubwordEncoder(["a", "[PAD]"])
    with pytest.raises(ValueError, match="window"):
        SubwordEncoder(pieces, 1)


def test_model_gets_ids(spark, pieces):
    def model():
        def predict(ids, mask):
            assert ids.shape == mask.shape and ids.shape[1] == 256
            return np.stack([np.zeros(len(ids)), mask.sum(axis=1) / 256.0], axis=1)

        return predict

    rows = [(1, "abc " * 1000), (2, None), (3, "ab cd")]
    scored = score_text_model(spark.createDataFrame(rows, "id int, text string"), "text", model, vocabulary=pieces)
    want = {i: round(1 / (1 + np.exp(-sum(plain((t or "").strip(), pieces, 256)[1]) / 256)), 4) for i, t in rows}
    assert {r.id: r.score for r in scored.collect()} == want and want[1] == 0.7311
