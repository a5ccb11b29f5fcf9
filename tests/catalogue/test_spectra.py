import numpy as np
import pytest

from starloom.operators import spectra as P

X = np.linspace(600.0, 700.0, 80)
T = (X - 650.0) / 50.0
LEVEL = 2.0 + 0.3 * T - 0.2 * T**2 + 0.1 * T**3  # worked by hand: a cubic is its own continuum


def test_spline_is_the_cubic_and_lines_are_clipped():
    model, mask, method = P.continuum(X, LEVEL)
    assert method == "spline" and np.abs(model - LEVEL).max() < 1e-3
    y = LEVEL + 0.002 * np.cos(37 * T)
    y[30:33] *= 0.5
    model, mask, method = P.continuum(X, y)
    assert method == "spline" and not mask[30:33].any() and np.abs(model - LEVEL).max() < 0.01
    status, fit, fallback, snr, stable, high, diverged, _, norm = P.measured(X, y)
    assert (status, fit, fallback, stable, high, diverged) == ("success", "spline", False, True, True, False)
    assert snr == round(snr, 2) and norm[31] < 0.6


def test_smoothing_spline_meets_its_target():
    draw = np.random.default_rng(3)
    wave = np.sin(9 * T)
    y = wave + 0.05 * draw.normal(size=len(T))
    for target in (8.0, 2.0, 0.4, 0.25):
        found = P.smoothing_spline(X, y, target, X)
        assert ((y - found) ** 2).sum() == pytest.approx(target, rel=1e-3)
    assert np.abs(P.smoothing_spline(X, y, 0.25, X) - wave).max() < 0.15
    assert np.allclose(P.smoothing_spline(X, y, ((y - y.mean()) ** 2).sum(), X), np.polyval(np.polyfit(T, y, 3), T))
    assert P.smoothing_spline(X, np.full(80, 4.0), 0.0, X) == pytest.approx(4.0)


def test_b_splines_sum_to_one_and_banded_solves():
    basis = P.b_splines(X, np.array([620.0, 655.0, 656.0]))
    assert basis.shape == (80, 7) and basis.sum(axis=1) == pytest.approx(1.0)
    matrix = basis.T @ basis + np.eye(7)
    assert P.banded(matrix, matrix @ np.arange(7.0), 3) == pytest.approx(np.arange(7.0))


def test_falling_wavelengths_take_chebyshev():
    model, mask, method = P.continuum(X[::-1], LEVEL[::-1])
    assert method == "chebyshev" and mask.all() and np.abs(model - LEVEL[::-1]).max() < 1e-3
    assert P.measured(X[::-1], LEVEL[::-1])[:3] == ("success", "chebyshev", True)


def test_one_wavelength_takes_the_mean():
    y = np.linspace(1.0, 3.0, 20)
    model, _, method = P.continuum(np.full(20, 650.0), y)
    assert method == "flat_mean" and model == pytest.approx(2.0)
    assert P.measured(np.full(20, 650.0), y)[:3] == ("success", "flat_mean", True)


def test_what_diverges_and_what_is_no_data():
    assert P.measured(X, LEVEL - 2.0)[0] == "failed" and P.measured(X, LEVEL - 2.0)[6]
    assert P.measured(X, np.full(80, np.nan))[0] == "no_data"
    assert P.measured(X[:9], LEVEL[:9])[0] == "no_data"
    few = np.zeros(80, dtype=bool)
    few[:9] = True
    assert P.measured(X, LEVEL, few)[0] == "failed"
    gaps = LEVEL.copy()
    gaps[5] = np.nan
    assert P.measured(X, gaps)[0] == "success"


def test_routing_of_both_bands(spark):
    red_x = np.linspace(846.0, 875.0, 120)
    red = np.ones(120)
    for c in P.CALCIUM:
        red -= 0.4 * np.exp(-((red_x - c) ** 2) / 0.18)
    blue_x = np.linspace(600.0, 700.0, 600)
    blue = 1 - 0.5 * np.exp(-((blue_x - 656.281) ** 2) / 0.5)
    spectra = lambda rows: spark.createDataFrame([(k, x.tolist(), y.tolist()) for k, x, y in rows], "source_id long, wavelength array<double>, flux array<double>")
    found = P.routed(spectra([(1, blue_x, blue), (2, X, LEVEL - 2.0)]), spectra([(1, red_x, red), (3, red_x, red)]), spark.createDataFrame([(3, 100.0)], "source_id long, radial_velocity double"))
    rows = {r.source_id: r for r in found.collect()}
    assert [rows[k].bprp.status for k in (1, 2, 3)] == ["success", "failed", "no_data"]
    assert [rows[k].rvs.status for k in (1, 2, 3)] == ["success", "no_data", "success"]
    assert rows[1].halpha.status == "success" and rows[2].halpha is None and rows[3].halpha is None
    assert [x.line_nm for x in rows[1].calcium] == list(P.CALCIUM) and rows[2].calcium is None
    assert rows[3].calcium[0].line_nm == pytest.approx(P.CALCIUM[0] * (1 + 100 / P.LIGHT))
    width = 0.4 * np.sqrt(0.18 * np.pi) * 10  # the area of a Gaussian in angstroms
    assert all(x.ew_aa == pytest.approx(width, rel=0.15) for x in rows[1].calcium)


def test_rows_together_equal_rows_alone():
    draw = np.random.default_rng(3)
    x = np.stack([650 + 0.2 * np.arange(64.0), 662.6 - 0.2 * np.arange(64.0), np.full(64, 650.0)] * 20)
    y = 1 + draw.normal(0, 0.02, x.shape)
    y[::7] -= 1
    windows = draw.random(x.shape) < 0.9
    found = P.measured_rows(x, y, windows)
    for own, *alone in zip(found, x, y, windows):
        expected = P.measured(*alone)
        assert own[:3] == expected[:3] and own[4:7] == expected[4:7] and own[3] == pytest.approx(expected[3], abs=0.011)
        if own[7] is not None:
            np.testing.assert_allclose(own[7], expected[7], rtol=1e-10)
    line = P.voigt(x[:1], 656.281, 0.5, 0.1, 0.2)[0]
    one, two, three = P.fit_lines(np.stack([x[0]] * 3), np.stack([1 - line, np.ones(64), np.full(64, np.nan)]), np.array([656.281] * 3))
    assert one == pytest.approx(P.fit_line(x[0], 1 - line, 656.281)) and one[3] == "success" and two[3] == "success" and three[3] == "too_few_points"
