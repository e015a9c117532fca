from collections import Counter

from brute import HARD, python_nodes

from formlake.llm import shards

COLUMNS = ["doc_id", "n_bytes", "depth", "part", "shard", "shard_bytes"]


def rows_of(df):
    return sorted(df.select(*COLUMNS).collect(), key=str)


def test_same_directory_as_sql(docs, table, duck):
    df = docs(table("documents", "doc_id", "text"))
    for limit in (shards.LIMIT, 60_000, 25_000):
        own = shards.shard_assignment(df, limit=limit)
        assert python_nodes(own) == []
        want = sorted(duck.execute(f"SELECT {', '.join(COLUMNS)} FROM ({shards.shard_sql(limit)})").fetchall(), key=str)
        assert [str(tuple(r)) for r in rows_of(own)] == [str(r) for r in want]


def test_shards_fit_their_limit_and_begin_with_their_bits(docs, table):
    df = docs(table("documents", "doc_id", "text"))
    rows = rows_of(shards.shard_assignment(df, limit=30_000))
    size = Counter()
    for r in rows:
        assert len(r.shard) == r.depth
        size[r.shard] += r.n_bytes
    assert max(size.values()) <= 30_000 and all(size[r.shard] == r.shard_bytes for r in rows)
    names = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))  # none is a prefix of another


def test_one_key_with_most_rows_is_cut(docs):
    rows = [(7, "x" * n) for n in (0, 10, 20, 30, 49, 50, 51, 60, 99, 100, 150)] + [(7, "y" * 40)] * 20 + [(8, "z" * 30)]
    got = rows_of(shards.shard_assignment(docs(rows), limit=100))
    size, most = Counter(), Counter()
    for r in got:
        size[r.shard] += r.n_bytes
        most[r.shard] = max(most[r.shard], r.n_bytes)
    assert len(got) == len(rows) and all(n <= 100 or n == most[s] for s, n in size.items())
    assert all(size[r.shard] == r.shard_bytes for r in got)


def test_hard_rows_and_no_rows(docs):
    got = rows_of(shards.shard_assignment(docs(HARD), limit=1000))
    assert sorted(((r.doc_id, r.n_bytes) for r in got), key=str) == sorted(
        ((i, len((t or "").encode())) for i, t in HARD), key=str)
    assert shards.shard_assignment(docs([])).count() == 0


def test_written_shards_hold_all_rows(spark, docs, table, tmp_path):
    df = docs(table("documents", "doc_id", "text"))
    shards.write_shards(df, shards.shard_assignment(df, limit=60_000), f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == df.count() and back.select("_shard").distinct().count() > 3
