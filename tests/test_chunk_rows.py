"""Chunks of over-full keys are bounded in rows."""

from test_dealing import _runs

from formlake.operators import history, skew


def _rows(df):
    return sorted(map(str, df.collect()))


def test_chunks_are_bounded_in_rows(spark, split_rows, monkeypatch):
    """Before, a chunk was a quarter of the split size, however large that was."""
    assert skew.SplitPolicy(split_rows=10**9).chunk_rows == skew.TASK_ROWS
    runs = _runs(spark)
    before = _rows(history.class_moves(runs)), _rows(history.entity_place_stats(runs))
    monkeypatch.setattr(skew, "TASK_ROWS", 5)
    split_rows(10)
    tasks = []
    real = skew.dealt
    monkeypatch.setattr(skew, "dealt", lambda df, keys, n: tasks.append(keys) or real(df, keys, n))
    assert (_rows(history.class_moves(runs)), _rows(history.entity_place_stats(runs, keys=("horse", "course")))) == before
    assert ["horse", skew._CHUNK] in tasks
