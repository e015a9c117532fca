import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import HARD
from hypothesis import given
from hypothesis import strategies as st

from formlake.llm import align
from formlake.llm.tokens import public_path

A, B = public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model")


def byte_alphabet():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(extra)}


def plain_rows(rows):
    """All columns from whole texts, the libraries as they are and all pairs of tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(A)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = byte_alphabet()
    held, docs = [], Counter()
    for doc_id, text in rows:
        links, groups, n = [], "", (0, 0, 0)
        if text:
            a = a_tok.encode(" " + text, add_special_tokens=False)
            a_ids, b_ids = a.ids, b_tok.encode(text)
            a_bytes = [bytes(letters[c] for c in t) for t in a.tokens]
            b_bytes = []
            for i in b_ids:
                piece = b_tok.id_to_piece(i)
                b_bytes.append(bytes([int(piece[3:5], 16)]) if b_tok.IsByte(i) else piece.replace("▁", " ").encode())
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]), np.cumsum([len(x) for x in b_bytes])
                both = sorted(set(a_ends.tolist()) & set(b_ends.tolist()))
                parts, low = [], 0
                for end in both:
                    xs = [a_ids[k] for k in range(np.searchsorted(a_ends, low, "right"), np.searchsorted(a_ends, end, "right"))]
                    ys = [b_ids[k] for k in range(np.searchsorted(b_ends, low, "right"), np.searchsorted(b_ends, end, "right"))]
                    parts.append(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)))
                    low = end
                groups = hashlib.sha256(";".join(parts).encode()).hexdigest()
                j = 0
                for k, end in enumerate(a_ends):
                    begin = a_ends[k - 1] if k else 0
                    while j and b_ends[j - 1] > begin:
                        j -= 1
                    while j < len(b_ends) and (b_ends[j - 1] if j else 0) < end:
                        if b_ends[j] > begin:
                            links.append((a_ids[k], b_ids[j]))
                        j += 1
                n = (len(a_ids), len(b_ids), len(both))
        held.append((doc_id, n, links, groups))
        docs.update(set(links))
    top = defaultdict(int)
    for (a, _), c in docs.items():
        top[a] = max(top[a], c)
    return [
        (doc_id, *n, len(links), sum(docs[p] == top[p[0]] for p in links), sum(docs[p] for p in links), groups)
        for doc_id, n, links, groups in held
    ]


ODD = [
    (101, " leading and  double   spaces \n\n\t tabs\r\n"), (102, "▁ the piece sign"), (103, "a\x00b <0x0A> <s> </s>"),
    (104, "nul​width ﻿ ﬁ   　 x"), (105, " "), (106, "<|endoftext|>"), (107, "1234567 3.14 http://a.b/c?d=e&f"),
]


@pytest.mark.parametrize("head_pairs", [align.HEAD_PAIRS, 40])
def test_equals_all_pairs_of_tokens(docs, table, head_pairs):
    rows = [(i, t) for i, t in table("documents", "doc_id", "text")][:120] + ODD + HARD
    got = align.alignment_figures(docs(rows), A, B, head_pairs=head_pairs)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_rows(rows), key=str)


def test_groups_hold_the_same_bytes(docs):
    (row,) = align.alignments(docs([(1, "tokenizers disagree, mostly in 12345 long wordsss")]), A, B).collect()
    assert len(row.a_groups) == len(row.b_groups) > 5
    assert row.a_groups[-1] == len(row.a_ids) and row.b_groups[-1] == len(row.b_ids)


def test_empty_table(docs):
    assert align.alignment_figures(docs([]), A, B).count() == 0


@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)), st.integers(0, 3))
def test_groups_are_the_common_ends(a, b, window):
    a, b = sorted(a | {61}), sorted(b | {61})
    common = sorted(set(a) & set(b))
    want = [a.index(x) + 1 for x in common], [b.index(x) + 1 for x in common]
    assert align.group_ends(a, b) == want
    before, align.WINDOW = align.WINDOW, 4 << window
    try:
        got = align.align(np.array(a), np.array(b))
    finally:
        align.WINDOW = before
    assert [x.tolist() for x in got] == list(want)
