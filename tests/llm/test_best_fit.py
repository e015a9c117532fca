import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import HARD
from tokenizers import Tokenizer

from formlake.llm import best_fit
from formlake.llm.tokens import public_path

PATH = public_path("byte_bpe_50k.json")


def decreasing(lengths, capacity):
    """Best fit of one document after another, longest first."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return gaps


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    pick = random.Random(seed)
    capacity = pick.choice([10, 37, 100])
    lengths = [pick.randint(1, capacity) for _ in range(pick.randint(0, 300))]
    used, ranks = defaultdict(list), Counter()
    for length, first, n, sequence, each, offset in best_fit.plan(dict(Counter(lengths)), capacity):
        assert first == ranks[length]
        ranks[length] += n
        for r in range(n):
            used[sequence + r // each].append((offset + r % each * length, length))
    assert ranks == Counter(lengths)
    for places in used.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(used) == len(decreasing(lengths, capacity))


def check(df, rows, capacity):
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    sums = Counter()
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        head = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(head, len(ids) + 1, capacity)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            sums[doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = best_fit.best_fit(df, PATH, 2, capacity).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sums
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places), sum(r.length for r in got)


def test_documents(docs, table):
    rows = table("documents", "doc_id", "text")
    sequences, tokens = check(docs(rows), rows, 1024)
    assert sequences <= -(-tokens // 1024) * 1.02 + 1


def test_hard_rows_and_no_rows(docs):
    check(docs(HARD), HARD, 64)
    assert best_fit.best_fit(docs([]), PATH, 2).count() == 0
