import random

import numpy as np
import pyarrow as pa
from brute import HARD, near_components

from formlake.llm import near_dup


def check(df, rows):
    want = sorted(((i, n, c, i == c) for (i, _), (n, c) in zip(rows, near_components(rows), strict=True)), key=str)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect()), key=str)
    assert got == want


def test_same_components_as_all_pairs(docs, table):
    rows = table("documents", "doc_id", "text")
    check(docs(rows), rows)


def test_hard_rows(docs):
    check(docs(HARD), HARD)


def edited(pick, base, n):
    out = list(base)
    for _ in range(n):
        out[pick.randrange(len(out))] = f"e{pick.randrange(10**9)}"
    return " ".join(out)


def test_groups_whose_members_are_not_all_alike(docs, monkeypatch):
    pick = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, edited(pick, base, pick.randrange(9))) for i in range(150)]
    rows += [(1000 + i, " ".join(f"c{j}" for j in range(i * 2, i * 2 + 40))) for i in range(60)]  # a chain
    monkeypatch.setattr(near_dup, "BLOCK_CLASSES", 20)
    check(docs(rows), rows)


def test_empty_table(docs):
    out = near_dup.near_duplicates(docs([]))
    assert out.count() == 0 and out.columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]


def test_filter_keeps_whole_rows(docs):
    rows = [*HARD, (30, HARD[7][1]), (31, HARD[9][1])]
    df = docs(rows)
    out = near_dup.without_duplicates(df)
    assert out.columns == df.columns
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = {(i, t) for (i, t), (_, c) in zip(rows, near_components(rows), strict=True) if i == c or c is None}
    want -= {(5, "one two"), (6, "ONE\ttwo")}
    assert kept == sorted(want, key=str)


def test_components_of_paths_and_stars(spark):
    pick = random.Random(2)
    edges = [(i, i + 1) for i in range(300, 360)] + [(5, j) for j in range(20, 90)] + [(7, 7), (8, 9), (9, 8)]
    pick.shuffle(edges)
    got = {r.node: r.root for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 300 for i in range(300, 361)}, 5: 5, **{j: 5 for j in range(20, 90)}, 8: 8, 9: 8}
    assert near_dup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_share_of_equal_minima_estimates_similarity():
    a = [f"w{i}" for i in range(400)]
    sets = near_dup.distinct_sets(pa.array([" ".join(a), " ".join(a[40:])]), 5)
    both = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    least = near_dup.minima(sets)
    assert abs((least[0] == least[1]).mean() - both) < 0.12
