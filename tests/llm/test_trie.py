import hashlib
import random
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from brute import WORD

from formlake.llm import trie

DDL = "conv_id long, turn long, role string, text string, key string, n int, words string"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        mine = [t[2:] for t in sorted(turns, key=lambda t: t[:2])]
        top = [t[2:] for t in sorted(own.get(c - c % 20, []), key=lambda t: t[:2])]
        convs[c] = tuple(top[:h] + mine[h:])
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    below = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        under = [below[k] for k in kids[p]]
        below[p] = (sum(u[0] for u in under) or 1, saved + sum(u[1] for u in under))
    return sorted((
        min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *below[p],
        hashlib.sha256(",".join(str(c) for c in sorted(m) if convs[c] == p).encode()).hexdigest(),
    ) for p, m in members.items()) if members else []


def check(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(*r, "k", 1, "w") for r in rows], DDL).repartition(parts)
    got = [tuple(r) for r in trie.prefix_trie(df, **more).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


@pytest.mark.parametrize("more", [{}, {"run_rows": 7}, {"run_turns": 9}])
def test_given_table(spark, more):
    table = pq.read_table("/root/testdata/sf0.001/conversations.parquet").to_pydict()
    check(spark, list(zip(*(table[c] for c in ("conv_id", "turn", "role", "text")), strict=True)), **more)


@pytest.mark.parametrize("run_rows", [1, 2, 5, 1000])
def test_many_equal_prefixes(spark, run_rows):
    rng = random.Random(run_rows)
    rows = []
    for c in range(300):
        if rng.random() < 0.1:
            continue
        for turn in range(rng.choice([1, 1, 2, 3, 3, 6])):
            rows.append((c, turn, rng.choice(["user", None]), rng.choice(["yes it is", "yes it is", "no", "", None, "a  b"])))
    rows += [(c, t, "user", "the same") for c in range(400, 700) for t in range(4)]
    check(spark, rows, run_rows=run_rows)


def test_hard_rows(spark):
    rows = [
        (0, None, "user", "null first"), (0, -1, "user", "then"), (0, 5, None, None), (1, 0, "a", "bc"), (2, 0, "ab", "c"),
        (None, 0, "user", "lost"), (3, 0, "user", "w " * 30_000), (3, 0, "user", "w " * 30_000), (21, 1, "", ""), (40, 0, "x", "y"),
        *[(60, t, "user", f"turn {t}") for t in range(400)], *[(61, t, "user", f"turn {t}") for t in range(401)],
    ]
    check(spark, rows)
    check(spark, rows, run_rows=1)
    check(spark, [])


def test_tree_grows_through_all_layouts():
    tree, kinds = trie.RadixTree(), []
    for i in range(256):
        tree.insert(bytes([7, 7, (i * 37) % 256, 1]), i)
        kinds.append(type(tree.root.layout).__name__)
    assert tree.root.path == b"\x07\x07" and [b for b, _ in tree.root.layout.items()] == list(range(256))
    assert [kinds.count(f"Node{n}") for n in (4, 16, 48, 256)] == [5 - 1, 12, 32, 208]
    tree.insert(b"\x07", "cut")
    assert (tree.root.path, tree.root.value) == (b"\x07", "cut")
