"""The inversion in tiles against the dense one."""

import numpy as np
import pytest

from tessella.operators import invert, tiled


def system(seed, runs, rows, n, entries):
    rng = np.random.default_rng(seed)
    cells, seen = [], []
    for run in range(runs):
        for row in range(rows - run):
            seen.append((run, 10 * row, float(rng.normal(0, 5)), float(rng.uniform(0.5, 2))))
            cells += [(run, 10 * row, int(c), float(rng.normal())) for c in rng.choice(n, entries, replace=False)]
    # of no observation, and of no unknown
    cells += [(0, 5, 3, 1.0), (0, 10, 10**6, 1.0)]
    unknowns = [(int(c), float(rng.integers(0, 9)), float(rng.integers(0, 9)), float(rng.integers(0, 4)), 2.0 + c % 3) for c in range(n)]
    return cells, seen, unknowns


def frames(spark, cells, seen, unknowns):
    return (
        spark.createDataFrame(cells, "run int, row long, col long, value double"),
        spark.createDataFrame(seen, "run int, row long, residual double, variance double"),
        spark.createDataFrame(unknowns, "col long, x double, y double, z double, prior double"),
    )


def told(df):
    return {(r.run, r.col): (r.density, r.error) for r in df.collect()}


KERNELS = {
    "iso": invert.prior_covariance(3.0, (4.0,), "iso", 3.5),
    "separable": invert.prior_covariance(3.0, (4.0, 2.0), "separable"),
    "function": lambda dx, dy, dz: 9.0 * np.exp(-(dx * dx + dy * dy + dz * dz) / 20) + 0.5 * ((dx == 0) & (dy == 0) & (dz == 0)),
}


@pytest.mark.parametrize("kernel", ["iso", "function"])
def test_equal_to_the_dense_solve(spark, monkeypatch, kernel):
    """Small tiles, so that there are several rows and columns of them, and rounds of elimination."""
    monkeypatch.setattr(tiled, "TILE", 7)
    monkeypatch.setattr(tiled, "HELD", 8 * 24 * 30)
    args = frames(spark, *system(3, 2, 24, 100, 12))
    want, got = (told(f(*args, KERNELS[kernel])) for f in (invert.solved, tiled.solved))
    assert set(got) == set(want) and len(got) == 200
    assert all(np.allclose(got[k], want[k], rtol=1e-8, atol=1e-9) for k in want)


def test_equal_to_the_dense_solve_on_two_thousand(spark):
    args = frames(spark, *system(4, 1, 60, 2000, 40))
    want, got = (told(f(*args, KERNELS["iso"])) for f in (invert.solved, tiled.solved))
    assert len(got) == 2000 and all(np.allclose(got[k], want[k], rtol=1e-8, atol=1e-9) for k in want)


def test_more_observations_than_unknowns(spark):
    args = frames(spark, *system(5, 1, 50, 20, 6))
    want, got = (told(f(*args, KERNELS["separable"])) for f in (invert.solved, tiled.solved))
    assert all(np.allclose(got[k], want[k], rtol=1e-6, atol=1e-8) for k in want) and len(got) == 20


def test_runs_without_entries_and_empty_tables(spark):
    cells, seen, unknowns = system(6, 1, 4, 30, 5)
    matrix, observed, places = frames(spark, cells, [*seen, (7, 1, 1.0, 1.0)], unknowns)
    got = told(tiled.solved(matrix, observed, places, KERNELS["iso"]))
    assert len(got) == 60 and all(got[7, c] == (prior, 3.5) for c, *_, prior in unknowns)
    for args in ((matrix.limit(0), observed.limit(0), places), (matrix, observed, places.limit(0))):
        assert tiled.solved(*args, KERNELS["iso"]).count() == 0


def test_many_unknowns_go_through_tiles(spark, monkeypatch):
    args = frames(spark, *system(8, 1, 10, 40, 5))
    want = told(invert.solved(*args, KERNELS["iso"]))
    monkeypatch.setattr(invert, "TILED", 39)
    monkeypatch.setattr(invert, "posterior", None)  # the dense way is not taken
    got = told(invert.solved(*args, KERNELS["iso"]))
    assert all(np.allclose(got[k], want[k], rtol=1e-8) for k in want)


def test_covariance_by_rows(monkeypatch):
    monkeypatch.setattr(invert, "ROWS", 5)
    xyz = np.random.default_rng(1).normal(size=(23, 3))
    for kind, lengths in (("iso", (2.0,)), ("separable", (2.0, 3.0)), ("ellipsoidal", (2.0, 3.0))):
        kernel = invert.prior_covariance(2.0, lengths, kind, 2.5)
        assert np.array_equal(kernel(xyz), kernel.tile(xyz, xyz, True)) and np.allclose(np.diag(kernel(xyz)), 6.25)
