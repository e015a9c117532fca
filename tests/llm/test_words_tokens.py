import random

import numpy as np
import pyarrow as pa
import pytest
from brute import HARD, WORD, fold
from tokenizers import Tokenizer

from formlake.llm import tokens as T
from formlake.llm import words as W

PIECES = [
    " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x1f", " ", "\u0085", " ", "　", " ", "a", "B", "É",
    "é", "Σ", "ß", "İ", "'s", "'", "'ll", ".", "1", "23", "<|endoftext|>", "漢字", "🙂", "the", "and ", ",", "​",
    "≮", "x" * 70,
]


def texts(n, seed=3):
    pick = random.Random(seed)
    return ["".join(pick.choice(PIECES) for _ in range(pick.randint(0, 40))) for _ in range(n)] + ["", None, "\n\n"]


def test_words_are_those_of_the_pattern():
    rows = texts(500) + [t for _, t in HARD]
    w = W.words(pa.array(rows), fold=True)
    names = {}
    for i, text in enumerate(rows):
        own = [x.decode() for x in (w.data[a:b].tobytes() for a, b in zip(
            w.starts[w.rows[i]:w.rows[i + 1]], w.ends[w.rows[i]:w.rows[i + 1]], strict=True))]
        assert own == WORD.findall(text or "")
        for word, h in zip(own, w.hashes[w.rows[i]:w.rows[i + 1]].tolist(), strict=True):
            assert names.setdefault(h, fold(word)) == fold(word)
    assert len(set(names.values())) == len(names)


def test_shingles_of_short_and_long_rows():
    hashes, at = W.shingles(W.words(pa.array(["a b c d e f", "", "a b", None, "a b", "a"]), True), 5)
    assert np.diff(at).tolist() == [2, 0, 1, 0, 1, 1]
    assert hashes[2] == hashes[3] and len(set(hashes.tolist())) == 4


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in HARD])], ["text"])
    parts = list(W.slices([batch], "text", limit=50))
    assert len(parts) > 5 and [t for p in parts for t in p.column(0).to_pylist()] == [t for _, t in HARD]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_library(name):
    path = T.public_path(name)
    own, library = T.Encoder(path), Tokenizer.from_file(path)
    library.encode_special_tokens = True
    rows = texts(3000) + [t for _, t in HARD]
    for first in range(0, len(rows), 400):
        part = rows[first:first + 400]
        ids, at = own.encode_with_end(pa.array(part), 7)
        for i, text in enumerate(part):
            assert ids[at[i]:at[i + 1]].tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 7]
