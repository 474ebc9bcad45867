"""How much components write; that they are right is tested in test_operators."""

from sentrylake.operators import components as C


def test_settled_edges_take_one_round(spark, monkeypatch):
    """Each round was written, read again for its state, and compared to the round before; stars took two rounds, and the state of
    each was a query of its own."""
    names = []
    monkeypatch.setattr(C, "written", lambda df, name, own=C.written: names.append(name) or own(df, name))
    got = C.components(spark.createDataFrame([(1, 2), (1, 3), (4, 5)], "a long, b long"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)] and len(names) == 2
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0
