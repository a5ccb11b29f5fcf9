"""Continuum and line measurement, in numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.sources.scratch import spread

#: Light in km/s; lines in nm; windows free of lines in the red spectra.
LIGHT = 299792.458
HALPHA, CALCIUM = 656.281, (849.802, 854.209, 866.214)
RED_WINDOWS = ((847.0, 849.0), (851.0, 853.5), (856.0, 860.0), (869.5, 874.0))
ROUNDS, LEAST_POINTS, LOW, HIGH = 5, 10, 2.0, 3.0
#: Spectra that are measured together; a bound on memory only.
TOGETHER = 1024

CONTINUUM = "status string, fit_method string, used_fallback boolean, snr double, stable boolean, high_snr boolean, fit_diverged boolean, model array<double>, normalized array<double>"
LINE = "line_nm double, ew_aa double, fwhm_nm double, status string, high_quality_fit boolean, is_broad boolean, emission_core boolean"
NO_DATA = ("no_data", None, False, None, False, False, False, None, None)


def cubic(x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The least-squares cubic of the points in ``mask``, at all of ``x``.

    The basis is orthogonal over those points (three-term recurrence), so each coefficient stands for itself. Fewer than
    four different places are an error.
    """
    t = (x - x.mean()) / (np.ptp(x) / 2 or 1.0)
    m = mask.astype(float)
    y = np.where(mask, y, 0.0)
    before, basis, before_size, found = np.zeros_like(t), np.ones_like(t), 1.0, np.zeros_like(t)
    for degree in range(4):
        size = (m * basis * basis).sum()
        if not size > 1e-12 * m.sum():
            raise ValueError("fewer than four different places")
        found += (m * y * basis).sum() / size * basis
        back = size / before_size if degree else 0.0
        before, basis, before_size = basis, (t - (m * t * basis * basis).sum() / size) * basis - back * before, size
    return found


def b_splines(x: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """(point, coefficient): cubic B-splines with the inner knots given, by the recursion of de Boor."""
    knots = np.concatenate([[x.min()] * 4, inner, [x.max()] * 4])
    span = np.clip(np.searchsorted(knots, x, side="right") - 1, 3, len(knots) - 5)
    out = np.zeros((len(x), len(knots) - 4))
    local = np.zeros((len(x), 4))
    local[:, 0] = 1.0
    for d in range(1, 4):
        saved = np.zeros(len(x))
        for j in range(d):
            right, left = knots[span + j + 1], knots[span + j + 1 - d]
            part = local[:, j] / (right - left)
            local[:, j] = saved + (right - x) * part
            saved = (x - left) * part
        local[:, d] = saved
    np.put_along_axis(out, span[:, None] - 3 + np.arange(4), local, axis=1)
    return out


def banded(matrix: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
    """Solve a positive definite system whose entries lie within ``width`` of the diagonal, by Cholesky within the band."""
    n = len(matrix)
    low = np.zeros((n, n))
    for i in range(n):
        first = max(0, i - width)
        for j in range(first, i + 1):
            rest = matrix[i, j] - low[i, first:j] @ low[j, first:j]
            if i == j and not rest > 0:
                raise ValueError("knots without points between them")
            low[i, j] = np.sqrt(rest) if i == j else rest / low[j, j]
    z = np.zeros(n)
    for i in range(n):
        z[i] = (right[i] - low[i, max(0, i - width) : i] @ z[max(0, i - width) : i]) / low[i, i]
    for i in range(n - 1, -1, -1):
        z[i] = (z[i] - low[i + 1 : i + 1 + width, i] @ z[i + 1 : i + 1 + width]) / low[i, i]
    return z


def smoothing_spline(x: np.ndarray, y: np.ndarray, target: float, at: np.ndarray) -> np.ndarray:
    """A cubic smoothing spline whose sum of squared residuals meets ``target``, at the places ``at``.

    The cubic without knots is it where its residuals already do. Else knots are added, each at the middle point of
    the span with the largest residuals, until the least-squares spline is below the target; then the
    jumps of its third derivative are held down as far as the target allows. ``x`` may not fall.
    """
    if (np.diff(x) < 0).any():
        raise ValueError("places have to rise")
    plain = cubic(np.concatenate([x, at]), np.concatenate([y, np.zeros(len(at))]), np.arange(len(x) + len(at)) < len(x))
    if ((y - plain[: len(x)]) ** 2).sum() <= target + 1e-12 * (y * y).sum():
        return plain[len(x) :]
    inner = np.zeros(0)
    while True:
        edges = np.concatenate([[x[0]], inner, [x[-1]]])
        basis = b_splines(x, inner)
        if len(inner):
            c = banded(basis.T @ basis, basis.T @ y, 3)
            rest = (y - basis @ c) ** 2
            if rest.sum() <= target:
                break
        else:
            rest = (y - plain[: len(x)]) ** 2
        spans = np.clip(np.searchsorted(edges, x, side="right") - 1, 0, len(edges) - 2)
        for span in np.argsort(-np.bincount(spans, rest, minlength=len(edges) - 1), kind="stable"):
            own = np.unique(x[(spans == span) & ~np.isin(x, edges)])
            if len(own) > 2:
                inner = np.sort(np.append(inner, own[len(own) // 2]))
                break
        else:  # no span has points to spare
            break
    # jumps of the third derivative at the inner knots, as differences between the middles of neighbouring spans
    edges = np.concatenate([[x[0]], inner, [x[-1]]])
    middles = (edges[1:] + edges[:-1]) / 2
    step = np.diff(edges).min() / 8
    third = (b_splines(np.concatenate([[x[0]], middles + 1.5 * step, [x[-1]]]), inner) - 3 * b_splines(np.concatenate([[x[0]], middles + 0.5 * step, [x[-1]]]), inner) + 3 * b_splines(np.concatenate([[x[0]], middles - 0.5 * step, [x[-1]]]), inner) - b_splines(np.concatenate([[x[0]], middles - 1.5 * step, [x[-1]]]), inner))[1:-1] / step**3
    jumps = np.diff(third, axis=0)
    jumps *= np.sqrt((basis * basis).sum() / max((jumps * jumps).sum(), 1e-300))
    low, high = -14.0, 14.0
    for _ in range(50):  # the residuals grow with the weight of the jumps
        weight = (low + high) / 2
        c = banded(basis.T @ basis + 10.0**weight * jumps.T @ jumps, basis.T @ y, basis.shape[1])
        low, high = (weight, high) if ((y - basis @ c) ** 2).sum() <= target else (low, weight)
    c = banded(basis.T @ basis + 10.0**low * jumps.T @ jumps, basis.T @ y, basis.shape[1])
    return b_splines(np.clip(at, x[0], x[-1]), inner) @ c


def continuum(x: np.ndarray, y: np.ndarray, windows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, str]:
    """(continuum, mask, method). Points that lie below 2 or above 3 deviations are clipped in up to ROUNDS rounds.

    ``spline``: smoothing spline whose squared residuals meet the number of points times their variance; that of the last round that gave a
    positive, finite one. ``chebyshev``: where the first round gave none (also where wavelengths fall), a
    cubic. ``flat_mean``: where that can't be fitted either. ``windows``: where points may be used at all.
    """
    allowed = np.isfinite(y) & np.isfinite(x)
    if windows is not None:
        allowed &= windows
    mask, found = allowed.copy(), None
    for _ in range(ROUNDS):
        if mask.sum() < LEAST_POINTS:
            break
        try:
            fit = smoothing_spline(x[mask], y[mask], mask.sum() * y[mask].var(), x)
        except ValueError:
            break
        if not np.isfinite(fit).all() or (fit <= 0).any():
            break
        found = fit
        rest = y - fit
        spread = rest[mask].std()
        if spread == 0:
            break
        new = allowed & (rest > -LOW * spread) & (rest < HIGH * spread)
        if (new == mask).all():
            break
        mask = new
    if found is not None:
        return found, mask, "spline"
    try:
        return cubic(x, y, mask), mask, "chebyshev"
    except ValueError:
        return np.full(len(y), y[mask].mean() if mask.any() else np.nan), mask, "flat_mean"


def measured(x: np.ndarray, y: np.ndarray, windows: np.ndarray | None = None) -> tuple:
    """A tuple of CONTINUUM: a fit that isn't positive everywhere or rests on few points has diverged and has no numbers."""
    if len(y) < LEAST_POINTS or len(x) != len(y) or not np.isfinite(y).any():
        return NO_DATA
    level, mask, method = continuum(x, y, windows)
    if mask.sum() < LEAST_POINTS or not np.isfinite(level).all() or (level <= 0).any():
        return ("failed", None, False, None, False, False, True, None, None)
    noise = (y - level)[mask].std()
    snr = float(y[mask].mean() / noise) if noise > 0 else 0.0
    norm = y / level
    return ("success", method, method != "spline", round(snr, 2), bool(norm[mask].std() < 0.05), snr > 20, False, level, norm)


def cubics(x: np.ndarray, y: np.ndarray, mask: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``cubic`` for every row of (spectrum, point) arrays, about ``middle``, and which rows have four different places."""
    t = (x - middle[:, None]) / np.where(np.ptp(x, axis=1) > 0, np.ptp(x, axis=1) / 2, 1.0)[:, None]
    m, n = mask.astype(float), mask.sum(axis=1)
    before, basis, before_size, found, good = np.zeros_like(t), np.ones_like(t), np.ones(len(t)), np.zeros_like(t), np.ones(len(t), dtype=bool)
    for degree in range(4):
        weighted = m * basis
        size = (weighted * basis).sum(axis=1)
        good &= size > 1e-12 * n
        size = np.where(good, size, 1.0)
        found += ((weighted * y).sum(axis=1) / size)[:, None] * basis
        back = size / before_size if degree else np.zeros(len(t))
        before, basis, before_size = basis, (t - ((weighted * t * basis).sum(axis=1) / size)[:, None]) * basis - back[:, None] * before, size
    return found, good


def _spread(values: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the values in the mask of each row."""
    n = np.maximum(mask.sum(axis=1), 1)
    mean = np.where(mask, values, 0.0).sum(axis=1) / n
    return mean, np.sqrt((np.where(mask, values - mean[:, None], 0.0) ** 2).sum(axis=1) / n)


@np.errstate(all="ignore")
def measured_rows(x: np.ndarray, y: np.ndarray, windows: np.ndarray) -> list[tuple]:
    """``measured`` for every row of finite (spectrum, point) arrays, all rows together.

    The target of the smoothing spline is one that a cubic meets; a row where rounding says that it doesn't goes to ``measured`` by itself.
    """
    mask, level, has = windows.copy(), np.zeros_like(y), np.zeros(len(y), dtype=bool)
    odd, live = np.zeros(len(y), dtype=bool), np.arange(len(y))
    for _ in range(ROUNDS):
        own, xs, ys = mask[live], x[live], y[live]
        n = own.sum(axis=1)
        top = np.maximum.accumulate(np.where(own, xs, -np.inf), axis=1)
        rises = ~(own[:, 1:] & (xs[:, 1:] < top[:, :-1])).any(axis=1)
        fit, good = cubics(xs, ys, own, (np.where(own, xs, 0.0).sum(axis=1) + xs.sum(axis=1)) / (n + x.shape[1]))
        rest = ys - fit
        _, deviation = _spread(ys, own)
        good &= (n >= LEAST_POINTS) & rises
        beyond = good & ~((np.where(own, rest, 0.0) ** 2).sum(axis=1) <= n * deviation**2 + 1e-12 * (np.where(own, ys, 0.0) ** 2).sum(axis=1))
        odd[live[beyond]] = True
        good &= ~beyond & np.isfinite(fit).all(axis=1) & (fit > 0).all(axis=1)
        level[live[good]], has[live[good]] = fit[good], True
        _, spread = _spread(rest, own)
        fresh = windows[live] & (rest > -LOW * spread[:, None]) & (rest < HIGH * spread[:, None])
        on = good & (spread > 0) & (fresh != own).any(axis=1)
        mask[live[on]], live = fresh[on], live[on]
        if not len(live):
            break
    method = np.where(has, "spline", "chebyshev").astype(object)
    rest = np.flatnonzero(~has & ~odd)
    if len(rest):
        fit, good = cubics(x[rest], y[rest], mask[rest], x[rest].mean(axis=1))
        n = mask[rest].sum(axis=1)
        flat = np.where(n > 0, np.where(mask[rest], y[rest], 0.0).sum(axis=1) / n, np.nan)
        level[rest] = np.where(good[:, None], fit, flat[:, None])
        method[rest[~good]] = "flat_mean"
    success = (mask.sum(axis=1) >= LEAST_POINTS) & np.isfinite(level).all(axis=1) & (level > 0).all(axis=1)
    _, noise = _spread(y - level, mask)
    mean, _ = _spread(y, mask)
    norm = y / level
    _, waves = _spread(norm, mask)
    snr = np.where(noise > 0, mean / noise, 0.0).tolist()
    out = []
    for k in range(len(y)):
        if odd[k]:
            out.append(measured(x[k], y[k], windows[k]))
        elif success[k]:
            out.append(("success", method[k], method[k] != "spline", round(snr[k], 2), bool(waves[k] < 0.05), snr[k] > 20, False, level[k], norm[k]))
        else:
            out.append(("failed", None, False, None, False, False, True, None, None))
    return out


def _alike(lengths: list[int | None], most: int) -> Iterator[list[int]]:
    """Places of equal length, ``most`` at once; those without a length are left out."""
    by: dict[int, list[int]] = {}
    for k, n in enumerate(lengths):
        if n is not None:
            by.setdefault(n, []).append(k)
    for own in by.values():
        for k in range(0, len(own), most):
            yield own[k : k + most]


def continuum_column(wavelength: Column, flux: Column, windows: tuple[tuple[float, float], ...] = ()) -> Column:
    """A struct of CONTINUUM for each spectrum; a spectrum that can't be measured has a status that says so."""

    def inside(x: np.ndarray) -> np.ndarray:
        return np.any([(x >= a) & (x <= b) for a, b in windows], axis=0) if windows else np.ones(x.shape, dtype=bool)

    def alone(x: np.ndarray, y: np.ndarray) -> tuple:
        try:
            return measured(x, y, inside(x))
        except (ValueError, np.linalg.LinAlgError) as error:
            return (f"error: {error}"[:200], *NO_DATA[1:])

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in CONTINUUM.split(", ")]
        for xs, ys in batches:
            xs, ys = ([None if v is None else np.asarray(v, dtype=float) for v in own] for own in (xs, ys))
            rows: list[tuple] = [NO_DATA] * len(xs)
            sizes: list[int | None] = []
            for k, (x, y) in enumerate(zip(xs, ys)):
                whole = x is not None and y is not None and len(x) == len(y) >= LEAST_POINTS and np.isfinite(x).all() and np.isfinite(y).all()
                sizes.append(len(x) if whole else None)
                if x is not None and y is not None and not whole:
                    rows[k] = alone(x, y)
            for own in _alike(sizes, TOGETHER):
                x, y = np.stack([xs[k] for k in own]), np.stack([ys[k] for k in own])
                for k, row in zip(own, measured_rows(x, y, inside(x))):
                    rows[k] = row
            yield pd.DataFrame(rows, columns=names)

    return F.pandas_udf(run, CONTINUUM)(wavelength, flux)


def shifted(line: Column, velocity: Column) -> Column:
    """Where a line falls at a radial velocity in km/s; at rest without one."""
    moved = F.when(velocity.isNotNull() & ~F.isnan(velocity), velocity).otherwise(F.lit(0.0))
    return line * (1 + moved / LIGHT)


def _w(z: np.ndarray) -> np.ndarray:
    """The real part of w(z) by Humlicek's rational approximation, each region where it holds."""
    t = z.imag - 1j * z.real
    s = np.abs(z.real) + z.imag
    out = (t * 0.5641896 / (0.5 + t * t)).real
    at = s < 15
    t, s, x, y = t[at], s[at], z.real[at], z.imag[at]
    u = t * t
    near = (t * (1.410474 + u * 0.5641896) / (0.75 + u * (3 + u))).real
    inner = s < 5.5
    close = inner & (y >= 0.195 * np.abs(x) - 0.176)
    v = t[close]
    near[close] = ((16.4955 + v * (20.20933 + v * (11.96482 + v * (3.778987 + v * 0.5642236)))) / (16.4955 + v * (38.82363 + v * (39.27121 + v * (21.69274 + v * (6.699398 + v)))))).real
    core = inner & ~close
    v, u = t[core], u[core]
    near[core] = (np.exp(u) - v * (36183.31 - u * (3321.9905 - u * (1540.787 - u * (219.0313 - u * (35.76683 - u * (1.320522 - u * 0.56419)))))) / (32066.6 - u * (24322.84 - u * (9022.228 - u * (2186.181 - u * (364.2191 - u * (61.57037 - u * (1.841439 - u)))))))).real
    out[at] = near
    return out


@np.errstate(over="ignore", invalid="ignore", divide="ignore")
def voigt(x: np.ndarray, centre: float | np.ndarray, amplitude: float | np.ndarray, lorentz: float | np.ndarray, gauss: float | np.ndarray) -> np.ndarray:
    """Voigt profile of a given height; parameters may be columns of one value for each row of ``x``."""
    centre, amplitude, lorentz, gauss = (np.asarray(v, dtype=float) for v in (centre, amplitude, lorentz, gauss))
    scale = 2 * np.sqrt(np.log(2)) / gauss
    top = _w(np.atleast_1d(1j * scale * lorentz / 2))
    return amplitude * _w(scale * (x - centre) + 1j * scale * lorentz / 2) / top


@np.errstate(all="ignore")
def fit_lines(x: np.ndarray, norm: np.ndarray, centre: np.ndarray, half: float = 1.5) -> list[tuple]:
    """Levenberg-Marquardt fits of a Voigt profile to the depth 1 - flux around a line: one for each row, all rows together."""
    use = np.isfinite(norm) & (np.abs(x - centre[:, None]) <= half)
    out: list[tuple] = [(c, None, None, "too_few_points", False, False, False) for c in centre.tolist()]
    rows = np.flatnonzero(use.sum(axis=1) >= 7)
    if not len(rows):
        return out
    places = np.argsort(~use[rows], axis=1, kind="stable")[:, : int(use[rows].sum(axis=1).max())]
    w = np.take_along_axis(use[rows], places, axis=1)
    xs, y = np.take_along_axis(x[rows], places, axis=1), np.where(w, 1 - np.take_along_axis(norm[rows], places, axis=1), 0.0)
    n, zero, c = w.sum(axis=1), np.zeros(len(rows)), centre[rows]
    low, high = np.stack([c - half, zero - 0.5, zero, zero + 0.075], axis=1), np.stack([c + half, zero + 1.2, zero + 5.0, zero + 5.0], axis=1)
    p = np.clip(np.stack([c, np.maximum(np.where(w, y, -np.inf).max(axis=1), 0.05), zero + 0.05, zero + 0.0751], axis=1), low, high)
    damp, live = np.full(len(rows), 1e-2), np.arange(len(rows))
    profile = lambda at, q: voigt(xs[at], *(q[:, k, None] for k in range(4)))
    rest_of = lambda at, model: np.where(w[at], y[at] - model, 0.0)
    for _ in range(25):
        model = profile(live, p[live])
        rest = rest_of(live, model)
        now = (rest * rest).sum(axis=1)
        jac = np.stack([np.where(w[live], (profile(live, p[live] + np.eye(4)[k] * 1e-6) - model) / 1e-6, 0.0) for k in range(4)], axis=2)
        square, right = jac.transpose(0, 2, 1) @ jac, (jac * rest[:, :, None]).sum(axis=1)
        heavy = np.einsum("rkk->rk", square) + 1e-12
        last, open_ = np.full(len(live), np.inf), np.flatnonzero(np.isfinite(square).all(axis=(1, 2)) & np.isfinite(right).all(axis=1))
        for _ in range(8):
            at = live[open_]
            system = square[open_] + damp[at, None, None] * heavy[open_, :, None] * np.eye(4)
            step = (np.linalg.pinv(system, rcond=4 * np.finfo(float).eps, hermitian=True) @ right[open_, :, None])[:, :, 0]
            new = np.clip(p[at] + step, low[at], high[at])
            other = rest_of(at, profile(at, new))
            other = (other * other).sum(axis=1)
            better = other < now[open_]
            p[at[better]], last[open_[better]] = new[better], other[better]
            damp[at] = np.where(better, damp[at] / 3, damp[at] * 3)
            open_ = open_[~better]
            if not len(open_):
                break
        live = live[np.isfinite(last) & ~(now - last < 1e-6 * np.maximum(now, 1e-30))]
        if not len(live):
            break
    for k in range(0, len(rows), 64):  # the wide grid in small parts
        own = p[k : k + 64]
        grid = own[:, :1] + np.linspace(-3, 3, 1000)
        depth = np.clip(voigt(grid, *(own[:, j, None] for j in range(4))), 0, None)
        width = ((depth[:, 1:] + depth[:, :-1]) / 2 * np.diff(grid, axis=1)).sum(axis=1) * 10
        fwhm = 0.5346 * own[:, 2] + np.sqrt(0.2166 * own[:, 2] ** 2 + own[:, 3] ** 2)
        at = np.arange(k, k + len(own))
        _, deviation = _spread(rest_of(at, profile(at, own)), w[at])
        middle = voigt(own[:, :1], *(own[:, j, None] for j in range(4)))[:, 0]
        for j, r in enumerate(rows[at]):
            if np.isfinite(width[j]) and np.isfinite(fwhm[j]):
                good = bool(deviation[j] < 0.05 and own[j, 1] > 3 * deviation[j])
                out[r] = (out[r][0], float(width[j]), float(fwhm[j]), "success", good, bool(fwhm[j] > 0.5), bool(middle[j] < 0))
            else:
                out[r] = (out[r][0], None, None, "failed", False, False, False)
    return out


def fit_line(x: np.ndarray, norm: np.ndarray, centre: float, half: float = 1.5) -> tuple:
    """``fit_lines`` of one spectrum."""
    return fit_lines(x[None], norm[None], np.array([centre], dtype=float), half)[0]


def lines_column(wavelength: Column, normalized: Column, centres: Column) -> Column:
    """An array of LINE structs, one for each centre; NULL without a normalised spectrum."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        names = [f.split()[0] for f in LINE.split(", ")]
        for xs, ns, cs in batches:
            out = [None if x is None or n is None or own is None else [None] * len(own) for x, n, own in zip(xs, ns, cs)]
            asked = [(k, j) for k, own in enumerate(out) for j in range(len(own or []))]
            for some in _alike([len(xs[k]) for k, _ in asked], TOGETHER):
                x, n = (np.stack([np.asarray(v[asked[i][0]], dtype=float) for i in some]) for v in (xs, ns))
                found = fit_lines(x, n, np.array([cs[asked[i][0]][asked[i][1]] for i in some], dtype=float))
                for i, line in zip(some, found):
                    out[asked[i][0]][asked[i][1]] = dict(zip(names, line))
            yield pd.Series(out)

    return F.pandas_udf(run, f"array<struct<{', '.join(f.replace(' ', ': ') for f in LINE.split(', '))}>>")(wavelength, normalized, centres)


def routed(blue: DataFrame, red: DataFrame, velocities: DataFrame, key: str = "source_id", wavelength: str = "wavelength", flux: str = "flux") -> DataFrame:
    """Both bands of each star: bprp and rvs (structs of CONTINUUM, status no_data where the star has no such spectrum), halpha, calcium.

    Halpha is measured in the blue band, the calcium triplet in the red one, whose continuum rests on windows free of lines; each only
    where its continuum succeeded, NULL elsewhere, and at the star's velocity (``radial_velocity`` of ``velocities``, at rest
    without one). A star with several spectra of a band has a row for each pair.
    """
    both = blue.select(key, F.col(wavelength).alias("bx"), F.col(flux).alias("by")).join(red.select(key, F.col(wavelength).alias("rx"), F.col(flux).alias("ry")), key, "full")
    both = both.join(velocities.select(key, F.col("radial_velocity").cast("double").alias("velocity")), key, "left")
    both = spread(both)  # few bytes, but much work
    both = both.withColumn("bprp", continuum_column(F.col("bx"), F.col("by"))).withColumn("rvs", continuum_column(F.col("rx"), F.col("ry"), RED_WINDOWS))
    at = lambda lines: F.array(*[shifted(F.lit(x), F.col("velocity")) for x in lines])
    both = both.withColumn("halpha", F.get(lines_column(F.col("bx"), F.col("bprp.normalized"), at([HALPHA])), F.lit(0)))
    return both.withColumn("calcium", lines_column(F.col("rx"), F.col("rvs.normalized"), at(CALCIUM))).drop("bx", "by", "rx", "ry")
