"""Whitening against numpy on whole tables in memory, refined eigenvectors, and awkward rows."""

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, whitening string, n string"
NAN, INF = float("nan"), float("inf")


def table(n=300, d=40, seed=2):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, d)) * np.linspace(0.2, 2, d)).astype(np.float32)
    rows = [(k, [float(c) for c in v], "x", "y") for k, v in enumerate(x)]
    bad = [None, [None] * d, [NAN] + [0.0] * (d - 1), [0.0] * (d - 1) + [-INF], [], [1.0], [1.0] * (d + 1), [0.5] * (d - 1) + [None]]
    return rows + rows[:5] + [(None, rows[7][1], "x", "y")] + [(1000 + k, v, "x", "y") for k, v in enumerate(bad)]


def good(rows, d=40):
    return [(i, v) for i, v, *_ in rows if v is not None and len(v) == d and all(c is not None and np.isfinite(c) for c in v)]


def test_rows_equal_a_plain_computation(spark):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    model = whitening.fit_whitening(df)
    kept = good(rows)
    x = np.array([[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for _, v in kept], dtype=object)
    n, s = len(x), x.sum(0)
    centred = (x * n - s).astype(float) / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    want = (centred @ u[:, :32]) / np.sqrt(e[:32])
    got = whitening.components_of(df, model).collect()
    assert len(got) == 32 * n and {r.component for r in got} == set(range(1, 33))
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    for k, (i, _) in enumerate(kept):
        for c in range(32):
            r = by[i, c + 1][0]
            assert abs(r.whitened) == pytest.approx(abs(want[k, c]), abs=1e-8) and r.n == n
            assert int(r.deviation) == sum(int(v) ** 2 for v in x[k] * n - s)
            assert r.explained == pytest.approx(e[c] / np.trace(cov), rel=1e-9) and r.identity_error < 1e-10
    sign = np.sign((model.components * u[:, :32]).sum(0))
    assert np.allclose(model.components * sign, u[:, :32], atol=1e-9)
    assert all(np.sign(by[i, c + 1][0].whitened) == np.sign(want[k, c] * sign[c]) for k, (i, _) in enumerate(kept[:20]) for c in range(32))


@pytest.mark.parametrize("values", [
    np.linspace(50, 150, 64), [100, 100 + 1e-6, 100 + 2e-6, 5, 4, 1e-5], [7.0] * 5 + [3, 2, 1], [1.0, *(1e-12 * k for k in range(1, 6))], [10 + 1e-7 * k for k in range(30)], [3.0], [0.0, 0.0],
])
def test_refined_eigenvectors_of_clustered_spectra(values):
    rng = np.random.default_rng(1)
    d = len(values)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(d) - 0.5 * q.T @ q)
    a = (q * np.array(values, np.longdouble)) @ q.T
    a = (a + a.T) / 2
    e, x = whitening.refined_eigenvectors(a)
    order = np.argsort(-np.array(values), kind="stable")
    size = max(np.abs(values).max(), 1e-300)
    assert np.abs(e - np.array(values)[order]).max() < 1e-15 * size
    assert np.abs(a @ x - x * e).max() < 4e-15 * size and np.abs(x.T @ x - np.eye(d)).max() < 2e-15
    for k in range(d):  # a lone eigenvalue has one direction
        gap = min((abs(e[k] - e[j]) for j in range(d) if j != k), default=size)
        if gap > 1e-8 * size:
            assert abs(abs(float(q[:, order[k]] @ x[:, k])) - 1) < 1e-15


def test_fewer_dimensions_filled_than_there_are(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3)) @ rng.normal(size=(3, 8)) * 4
    flat = [(k, [float(c) for c in np.round(v)] + [2.0, 2.0], "", "") for k, v in enumerate(x)]
    model = whitening.fit_whitening(spark.createDataFrame(flat, SCHEMA))
    assert 3 <= len(model.values) <= 8 and model.dim == 10 and model.identity_error < 1e-8 and 0.999 < model.explained.sum() <= 1.0000001


def test_empty_single_and_equal_vectors(spark):
    for rows in ([], [(1, None, "", "")], [(1, [], "", "")], [(1, [1.0, 2.0], "", "")], [(k, [1.0, 2.0], "", "") for k in range(9)]):
        df = spark.createDataFrame(rows, SCHEMA)
        model = whitening.fit_whitening(df)
        out = whitening.whiten(df, model)
        assert not len(model.values) and out.count() == len(rows) and out.where("whitening is not null").count() == 0
        assert whitening.components_of(df, model).count() == 0


def test_huge_entries_are_held_at_the_edge(spark):
    rows = [(k, [3e38 if k == 4 else 0.25 * k, float(k % 3), -1.0 * (k % 2)], "", "") for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = whitening.fit_whitening(df)
    got = whitening.whiten(df, model).collect()
    x = [[min(max(int(np.floor(64 * np.float64(np.float32(c)))), -(1 << 52)), 1 << 52) + 1_000_000 for c in v] for _, v, *_ in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((40 * c - t) ** 2 for c, t in zip(v, s, strict=True)) for v in x]
    assert [None if r.whitening.deviation is None else int(r.whitening.deviation) for r in sorted(got, key=lambda r: r.vec_id)] == [w if w < 10**38 else None for w in want]
    assert all(np.isfinite(r.whitening.whitened).all() for r in got)


def test_exact_deviations_on_both_paths():
    rng = np.random.default_rng(4)
    for n, spread in ((40, 50), (10**12, 50), (10**6, 1 << 40)):
        x = rng.integers(-spread, spread, (30, 6)) + 1_000_000
        s = [int(rng.integers(0, 10**6)) + 1_000_000 * n for _ in range(6)]
        model = whitening.Whitening(n, 6, np.array([v // n for v in s]), np.array([v % n for v in s]), np.eye(6), np.eye(6), np.ones(6), np.ones(6), 0.0)
        want = [sum((n * int(c) - t) ** 2 for c, t in zip(v, s, strict=True)) for v in x]
        got = whitening._deviations(model, x).to_pylist()
        assert [None if g is None else int(g) for g in got] == [w if w < 10**38 else None for w in want]


def test_grid_rounds_down_whole_columns_and_slices():
    col = pa.array([[0.1, -0.1], None, [1.0], [0.5, 2.0], [NAN, 1.0]], pa.list_(pa.float32()))
    (one, a), (two, b) = whitening.grid_vectors(col)
    assert one.tolist() == [2] and two.tolist() == [0, 3] and a.tolist() == [[1_000_064]]
    assert b.tolist() == [[1_000_006, 999_993], [1_000_032, 1_000_128]]
    assert [r.tolist() for r, _ in whitening.grid_vectors(col.slice(2), 2)] == [[1]]
    assert Fraction(64) * Fraction(float(np.float32(0.1))) > 6


def test_query_contract(spark, tmp_path):
    spark.createDataFrame(table(), SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_whitening(spark, str(tmp_path))
    assert got.dtypes == [
        ("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"),
    ]
    assert got.count() == 32 * len(good(table()))
