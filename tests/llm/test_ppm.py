import math

import numpy as np
import pyarrow as pa
import pytest
from brute import HARD, ByteModel, held_out

from formlake.llm import ppm


def check(df, rows, order, **more):
    got = sorted((tuple(r) for r in ppm.score_documents(df, order=order, **more).collect()), key=str)
    model, want = ByteModel(rows, order), []
    for doc_id, text in rows:
        n, known, base = model.base(text)
        want.append((doc_id, held_out(doc_id), n, known, model.total, base, model.score(text)))
    want.sort(key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-5, abs=1e-6)


@pytest.mark.parametrize("more", [{}, {"block_entries": 400, "head_words": 30, "head_grams": 50}])
def test_scores_equal_the_plain_model(docs, table, more):
    rows = [(i, t) for i, t in table("documents", "doc_id", "text") if len(t) < 900]
    check(docs(rows), rows, 3, **more)


def test_hard_rows(docs):
    rows = [(i, t if t is None or len(t) < 3000 else t[:3000]) for i, t in HARD]
    check(docs(rows), rows, 5)


def test_no_training_rows_and_no_rows(docs):
    one = next(i for i in range(99) if held_out(i))
    (row,) = ppm.score_documents(docs([(one, "ab")])).collect()
    assert row.train_tokens == 0 and row.n_known == 0 and row.base_score == pytest.approx(2 * math.log10(0.5 / 0.5))
    assert row.score == pytest.approx(-3 * math.log10(257))
    assert ppm.score_documents(docs([])).count() == 0


def test_probabilities_of_all_symbols_sum_to_one():
    code, _ = ppm.grams(pa.array(["abracadabra", "banana bandana"]), 3)
    keys, n = ppm.tally(code)
    low = ppm.tally(keys % np.uint64(ppm.BASE ** 2), n)
    block = ppm.build_block(3, keys, n, *low, None)
    symbols = np.array([*range(256), ppm.END], np.uint64)
    for context in ("bra", "xyz", "ana", "zzb"):
        prefix = sum(np.uint64(ord(c)) * np.uint64(ppm.BASE ** (3 - i)) for i, c in enumerate(context))
        assert (10 ** ppm.log10_probability(block, prefix + symbols)).sum() == pytest.approx(1, rel=1e-5)


def test_held_out_texts_are_better_predicted_by_a_longer_order(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    total = [ppm.score_documents(df, order=n).where("held_out").agg({"score": "sum"}).first()[0] for n in (2, 4)]
    assert total[0] < total[1] < 0
