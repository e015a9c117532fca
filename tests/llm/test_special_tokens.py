import random
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from brute import HARD
from test_words_tokens import PIECES
from tokenizers import Tokenizer

from formlake.llm import queries
from formlake.llm import tokens as T

ENDS = [
    "stop <|endoftext|> go", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "a  <|endoftext|>  b.", "<|endof", "text|>",
    "<|startoftext|>x<|endoftext|>", "e<|endoftext|≯'s", "<|endoftext|", ">", "<<|endoftext|>>", "x <|ENDOFTEXT|> y",
]


def texts(n):
    pick = random.Random(5)
    pieces = [*PIECES, "<|startoftext|>", "<|endoftext|>", "<|", "|>", "endoftext"]
    return ["".join(pick.choice(pieces) for _ in range(pick.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_untouched_library(name):
    path = T.public_path(name)
    own, library = T.Encoder(path, special_ids=True), Tokenizer.from_file(path)
    rows = ENDS + [None, *texts(3000)] + [t for _, t in HARD]
    for first in range(0, len(rows), 400):
        part = rows[first:first + 400]
        ids, at = own.encode_with_end(pa.array(part), 7)
        for i, text in enumerate(part):
            want = library.encode(text or "", add_special_tokens=False).ids
            assert ids[at[i]:at[i + 1]].tolist() == [*want, 7], text


def library_sums(name, end):
    library = Tokenizer.from_file(T.public_path(name))
    rows = [[*library.encode(t, add_special_tokens=False).ids, end] for t in ENDS]
    return sorted((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in enumerate(rows))


def test_registered_queries_and_pipeline(spark, docs, tmp_path):
    df = docs(list(enumerate(ENDS)))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    packed = queries.op8_packed_tokens(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in packed) == library_sums("word_bpe_49k.json", 1)
    stage = dict(corpus_pipeline.STAGES)["packing"]
    for pieces in (queries.op6_best_fit_packing(spark, str(tmp_path)), stage(spark, df, str(tmp_path))):
        got = sorted((r.doc_id, r.length, r.ids_crc32) for r in pieces.collect())
        assert got == library_sums("byte_bpe_50k.json", 2)
