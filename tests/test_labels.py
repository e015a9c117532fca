"""The labels of categories that trees learn from."""

from formlake.ml import boost


def test_labels_of_all_categories_are_counted_in_one_pass(spark, monkeypatch):
    rows = spark.createDataFrame(
        [("a", 1, None), ("a", 2, None), ("b", 2, None), ("c", 3, None), (None, 3, None)], "x string, y int, z string")
    kind, calls = type(rows), []
    real = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: calls.append(1) or real(df))
    bins = boost.fit_bins(rows, [], ["x", "y", "z"], labels=2)
    assert len(calls) == 1
    assert bins.labels == {"x": ["a", "b"], "y": ["2", "3"], "z": []}
    assert bins.overflow == {"x": True, "y": True, "z": False}
