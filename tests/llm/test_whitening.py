"""Whitening against plain numpy, and its eigenvectors on matrices with clustered eigenvalues."""

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as contract
from almanac.llm import whitening

SF = "/root/testdata/sf0.001"


def plain(x, components):
    """Eigenvalues, whitened rows and deviations by numpy alone; x holds integers."""
    n, sums = len(x), x.sum(axis=0)
    z = n * x - sums
    c = z / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return values, c @ vectors / np.sqrt(values), (z.astype(object) ** 2).sum(axis=1), (c * c).sum() / n


def gathered(rows, key="vec_id"):
    out = {}
    for r in rows:
        out.setdefault(r[key], {})[r["component"]] = r
    return out


def test_query_equals_numpy(spark):
    got = gathered(contract.queries()["op13_whitening"](spark, SF).collect())
    table = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    x = np.floor(64 * np.array(table["embedding"], np.float64)).astype(np.int64) + 1_000_000
    values, whitened, deviations, trace = plain(x, 32)
    assert sorted(got) == sorted(table["vec_id"]) and all(sorted(v) == list(range(1, 33)) for v in got.values())
    ours = np.array([[got[i][k]["whitened"] for k in range(1, 33)] for i in table["vec_id"]])
    sign = np.sign((ours * whitened).sum(axis=0))
    assert np.abs(ours * sign - whitened).max() < 1e-8
    assert [got[i][7]["deviation"] for i in table["vec_id"]] == deviations.tolist()
    first = got[table["vec_id"][0]]
    assert first[1]["n"] == len(x)
    assert np.allclose([first[k]["explained"] for k in range(1, 33)], values / trace, rtol=1e-9)
    assert len({r["identity_error"] for v in got.values() for r in v.values()}) == 1 and 0 <= first[1]["identity_error"] < 1e-9


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 2, 40),
        np.concatenate([np.ones(12), 1 + 1e-9 * np.arange(12), 1 + 1e-13 * np.arange(6), [2, 3, 4], np.full(8, 1e-6)]),
        np.concatenate([np.ones(20), np.zeros(30)]),
        10.0 ** -np.arange(20),
        np.ones(1),
    ],
)
def test_eigenvectors_of_clusters(values):
    d = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(d, d)))
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.eigenvectors(a)
    exact = x.astype(np.longdouble)
    assert np.abs(exact.T @ exact - np.eye(d)).max() < 4e-16
    assert np.abs(a.astype(np.longdouble) @ exact - exact * found).max() < 4e-16 * max(values)
    assert np.abs(found - np.linalg.eigvalsh(a)[::-1]).max() < 1e-14 * max(values)


def test_single_precision_alone_would_not_do():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(50, 50))
    a = a @ a.T
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    assert np.abs(rough.T @ rough - np.eye(50)).max() > 1e-8
    b = rng.normal(size=(50, 30)).astype(np.longdouble)
    assert np.abs(whitening.product(a.astype(np.longdouble), b) - a.astype(np.longdouble) @ b).max() < 1e-16


def test_odd_vectors(spark):
    """Nulls, non-finite entries, other widths, repeated rows, huge entries, null ids and clashing columns."""
    inf, nan = float("inf"), float("nan")
    good = [(1, [0.5, 1.0, -2.0]), (2, [0.25, 3.0, 1.0]), (2, [0.25, 3.0, 1.0]), (None, [1.5, -1.0, 0.0]), (3, [2.0]), (4, [])]
    bad = [(5, None), (6, [None, 1.0, 2.0]), (7, [nan, 1.0, 2.0]), (8, [1.0, -inf, 2.0])]
    df = spark.createDataFrame([(i, v, "a", 7) for i, v in good + bad], "vec_id int, embedding array<double>, x string, component int")
    got = whitening.whitened_components(whitening.fixed_point(df, "vec_id", "embedding")).collect()
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in [*v, 0, 0, 0][:3]] for _, v in good])
    values, whitened, deviations, _ = plain(x, 32)
    assert len(got) == 6 * 3 and {r["id"] for r in got} == {1, 2, 3, 4, None}
    by_id = gathered(got, "id")
    for (i, _), w, d in zip(good, whitened, deviations, strict=True):
        assert by_id[i][1]["deviation"] == d and by_id[i][1]["n"] == 6
        assert np.allclose([abs(by_id[i][k]["whitened"]) for k in (1, 2, 3)], np.abs(w))
    one = whitening.fixed_point(df.where("vec_id = 2"), "vec_id", "embedding")
    assert whitening.whitened_components(one).collect() == []  # equal rows have no direction with variance
    empty = whitening.whitened_components(whitening.fixed_point(df.where("vec_id > 100"), "vec_id", "embedding"))
    assert empty.collect() == [] and empty.columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [-1e300, 2.0])], "vec_id int, embedding array<double>")
    found = whitening.whitened_components(whitening.fixed_point(huge, "vec_id", "embedding")).collect()
    assert {r["id"] for r in found} == {1, 2, 3} and all(r["deviation"] is None for r in found if r["id"] != 2)
    assert all(np.isfinite(r["whitened"]) for r in found)


def test_flat_directions_are_no_components(spark):
    df = spark.createDataFrame([(i, [float(i), 5.0, 2.0 * i]) for i in range(10)], "vec_id int, embedding array<double>")
    rows = whitening.whitened_components(whitening.fixed_point(df, "vec_id", "embedding")).collect()
    assert {r["component"] for r in rows} == {1} and abs(rows[0]["explained"] - 1) < 1e-12
