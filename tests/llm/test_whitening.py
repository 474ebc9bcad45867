"""Whitening against a covariance in exact integers, and by hard rows."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from sentrylake.llm import whitening
from sentrylake.llm.queries import op11_tsqr_whitening
from tests.llm.brute import SF

SCHEMA = "vec_id long, embedding array<float>, label int, whitened string"


def exact(vectors):
    """n, sums, deviations of each vector, and the covariance from exact integers."""
    x = [[math.floor(64 * float(c)) + 1000000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    y = [[n * r[j] - sums[j] for j in range(d)] for r in x]
    cov = np.array([[sum(r[i] * r[j] for r in y) / n**3 for j in range(d)] for i in range(d)])
    return n, sums, y, cov


@pytest.fixture(scope="module")
def truth():
    return exact(pq.read_table(f"{SF}/embeddings.parquet")["embedding"].to_pylist())


def test_query(spark, truth):
    n, _, y, cov = truth
    rows = op11_tsqr_whitening(spark, SF).collect()
    ids = pq.read_table(f"{SF}/embeddings.parquet")["vec_id"].to_pylist()
    at = {v: k for k, v in enumerate(ids)}
    assert len(rows) == 32 * len(ids) and {r["n"] for r in rows} == {n}
    e = np.sort(np.linalg.eigvalsh(cov))[::-1]
    z = np.zeros((n, 32))
    for r in rows:
        z[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == sum(v * v for v in y[at[r["vec_id"]]])
        assert math.isclose(r["explained"], e[r["component"] - 1] / e.sum(), rel_tol=1e-9)
    # whitened * sqrt(e) are projections on eigenvectors: C z = e z, up to sign
    centred = np.array(y, float) / n
    part = z * np.sqrt(e[:32])
    vectors = centred.T @ part / n / e[:32]
    assert np.abs(cov @ vectors - vectors * e[:32]).max() < 1e-9 * e[0] and np.abs(vectors.T @ vectors - np.eye(32)).max() < 1e-9
    assert np.abs(z.T @ z / n - np.eye(32)).max() < 1e-9 and {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-9


def test_partitions(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    one, many = whitening.fit(df.coalesce(1)), whitening.fit(df.repartition(40))
    assert one.sums == many.sums and np.allclose(one.eigenvalues, many.eigenvalues, rtol=1e-12)
    assert np.abs(np.abs(one.components @ many.components.T) - np.eye(32)).max() < 1e-8


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None, 1, "a"), (2, [None, 1.0, 2.0], 1, "a"), (3, [nan, 1.0, 2.0], 1, "a"), (4, [1.0, inf, 0.0], 1, "a"), (5, [], 1, "a"), (6, [1.0], 1, "a"), (7, [1e30, 0.0, 0.0], 1, "a")]
    good = [(10, [0.0, 1.0, 2.0], 1, "a"), (10, [0.0, 1.0, 2.0], 1, "a"), (None, [5.0, -1.0, 2.0], 1, "a"), (11, [1.0, 1.0, 2.0], 1, "a")]
    df = spark.createDataFrame(bad + good, SCHEMA)
    model = whitening.fit(df)
    n, sums, y, cov = exact([g[1] for g in good])
    assert (model.n, model.sums, len(model.components)) == (n, sums, 2)  # the third entry never differs
    assert math.isclose(model.trace, np.trace(cov), rel_tol=1e-12)
    found = whitening.whitened(df, model)
    assert found.columns == ["vec_id", "deviation", "whitened"]
    assert sorted((r["vec_id"] or -1, int(r["deviation"])) for r in found.collect()) == sorted((g[0] or -1, sum(v * v for v in own)) for g, own in zip(good, y, strict=True))
    assert whitening.identity_error(found, 2) < 1e-12
    for rows in ([], bad[:5], good[:2], good[:1]):
        few = spark.createDataFrame(rows, SCHEMA)
        model = whitening.fit(few)
        assert len(model.components) == 0
        assert whitening.whitened(few, model).count() == (len(rows) if rows and rows[0][0] == 10 else 0)
        assert whitening.identity_error(whitening.whitened(few, model), 0) is None


def test_large_numbers():
    """Beyond 64 bits the numbers are Python's."""
    x = np.array([[1 << 60, 3], [-(1 << 60), 5]])
    y = whitening.deviations(x, 2, [0, 8])
    assert y.tolist() == [[1 << 61, -2], [-(1 << 61), 2]]
    y = whitening.deviations(x, 1 << 40, [0, 8 << 39])
    assert y.tolist() == [[1 << 100, -(1 << 40)], [-(1 << 100), 1 << 40]]
    small = whitening.deviations(np.array([[3, 4], [6, 8]]), 2, [9, 12])
    assert small.dtype == np.int64 and whitening.squares(small).to_pylist() == [25, 25]
    assert whitening.squares(np.array([[1 << 40, 1 << 40]])).to_pylist() == [2 << 80]
