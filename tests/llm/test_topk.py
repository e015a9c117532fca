import math

import duckdb
import numpy as np
import pytest

from formlake.llm import topk

DDL = "vec_id long, embedding array<double>, row long, score long, n int, text string"


def plain(rows, k, every=100, scale=1024):
    ints = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, u) in enumerate(ints):
        if q is None or q % every:
            continue
        scored = [(sum(x * y for x, y in zip(u, v)), c) for b, (c, v) in enumerate(ints) if a != b]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(q, rank, c, s) for rank, (s, c) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def check(spark, rows, k=10, **more):
    df = spark.createDataFrame([(*r, 1, 2, 3, "t") for r in rows], DDL).repartition(3)
    got = [tuple(r) for r in topk.top_k(df, k=k, **more).collect()]
    assert sorted(got, key=str) == plain(rows, k)


@pytest.mark.parametrize("kind", ["random", "sparse", "one direction", "few values"])
def test_equals_all_products(spark, kind):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1500, 12)) / 4
    if kind == "sparse":
        v[rng.random(v.shape) < 0.8] = 0
    elif kind == "one direction":
        v = np.outer(rng.random(1500), v[0]) + v / 100
    elif kind == "few values":
        v = np.round(v * 2) / 2
    check(spark, [(i, x.tolist()) for i, x in enumerate(v)], query_rows=4)


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, None), (0, [0.5, 0.25]), (0, [0.5, 0.25]), (100, []), (200, [1.0]), (300, [None, 1.0]), (400, [nan, 0.0]), (1, [inf, 1.0]),
        (2, [0.5, 0.25, 9.0]), (None, [0.5, 0.25]), (None, None), (3, [-0.0001, 0.0]), (-100, [1e6, -1e6]), (4, [0.5, 0.25]),
    ]
    check(spark, rows)
    check(spark, rows, k=2)
    check(spark, [])
    check(spark, [(100, [1.0])])


def test_products_beyond_a_long_stay_at_its_end(spark):
    df = spark.createDataFrame([(100, [1e17], 0, 0, 0, ""), (1, [1e17], 0, 0, 0, ""), (2, [-1e17], 0, 0, 0, "")], DDL)
    assert [r.score for r in topk.top_k(df).orderBy("rank").collect()] == [(1 << 63) - 1, 1 - (1 << 63)]


def test_the_search_stops_before_the_last_segment_and_loses_nothing():
    rng = np.random.default_rng(9)
    v = np.floor(1024 * rng.normal(size=(4000, 8))).astype(np.int64)
    v[:30] *= 3
    names = ["n", "dim", "row", "vec_id", "no_id", "components", "postings", "levels", "bounds"]
    block = topk.Block(dict(zip(names, topk._encode(range(4000), list(range(4000)), v), strict=True)))
    for query in v[::500]:
        at = block.candidates(query, 10, -(1 << 62))
        best = np.argsort(-(v @ query), kind="stable")[:10]
        assert set(best.tolist()) <= set(at.tolist()) and len(at) < 4000


def test_sql_gives_the_same(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(map(tuple, topk.top_k(spark.read.parquet(f"{sf}/embeddings.parquet")).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    assert got == sorted(con.execute(topk.top_k_sql()).fetchall())
