"""ARIMA models of short series by exact likelihood, chosen by AICc, with bands and a backtest; one group a series.

The differenced series is a stationary ARMA process in state space: the state starts from its own distribution (the
solution of its Lyapunov equation), a Kalman filter gives the errors of prediction and their variances, and these the
likelihood, with scale and mean taken out in closed form. Differences are taken as given, which is what diffuse starts
of the undifferenced levels come to. All orders, starts and steps of the search go through the filter side by side, as
one batch of arrays; coefficients are searched for as partial correlations, so no step leaves the stationary ones.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

# The orders that are tried, the refusal rules.
ORDERS = ((0, 1, 0), (1, 1, 0), (0, 1, 1), (1, 1, 1), (2, 1, 0), (0, 1, 2), (1, 0, 0), (0, 0, 1), (1, 0, 1), (2, 1, 1))
LEAST_PERIODS, BACKTEST, LEAST_BACKTEST, TRUSTED, SHAKY = 12, 3, 15, 0.45, 0.25
Z80, Z95 = 1.2815515655446004, 1.959963984540054
#: Where a search starts, as partial correlations of both parts; how far along a direction it looks.
STARTS = ((0.0, 0.0), (0.5, -0.4), (-0.4, 0.5))
STEPS = np.array([2.0, 1.0, 0.5, 0.2, 0.05, 0.01, 1e-3])
SEARCH_STEPS = 60


def coefficients(partial: np.ndarray) -> np.ndarray:
    """Coefficients of stationary autoregressions (batch, lags) with these partial correlations."""
    out = np.zeros_like(partial)
    for k in range(partial.shape[1]):
        new = partial[:, k : k + 1]
        out[:, :k] = out[:, :k] - new * out[:, :k][:, ::-1]
        out[:, k] = new[:, 0]
    return out


class Filter:
    """Kalman filters of a batch of ARMA processes with unit innovations: ar and ma are (batch, lags)."""

    def __init__(self, ar: np.ndarray, ma: np.ndarray):
        n, r = len(ar), max(ar.shape[1], ma.shape[1] + 1)
        self.phi, self.load = np.zeros((n, r)), np.zeros((n, r))
        self.phi[:, : ar.shape[1]], self.load[:, 0], self.load[:, 1 : 1 + ma.shape[1]] = ar, 1.0, ma
        self.noise = self.load[:, :, None] * self.load[:, None, :]
        step = np.zeros((n, r, r))
        step[:, :, 0] = self.phi
        step[:, np.arange(r - 1), np.arange(1, r)] = 1.0
        self.step = step
        # the variance P of the stationary state solves P = T P T' + R R'
        kron = np.einsum("bij,bkl->bikjl", step, step).reshape(n, r * r, r * r)
        self.start = np.linalg.solve(np.eye(r * r) - kron, self.noise.reshape(n, r * r, 1)).reshape(n, r, r)

    def run(self, series: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Errors (time, batch, columns) and variances (time, batch) of one-step predictions of series (time, batch, columns); last state and its variance."""
        p, steady = self.start, False
        a = np.zeros((len(p), p.shape[1], series.shape[2]))
        errors, variances = np.empty(series.shape), np.empty(series.shape[:2])
        for t, y in enumerate(series):
            v = y - a[:, 0]
            if not steady:
                f = p[:, 0, 0]
                gain = np.matmul(self.step, p[:, :, :1]) / f[:, None, None]
                new = np.matmul(np.matmul(self.step, p), self.step.transpose(0, 2, 1)) + self.noise - gain * gain.transpose(0, 2, 1) * f[:, None, None]
                steady, p = bool(np.abs(new - p).max() < 1e-13), new
            a = np.matmul(self.step, a) + gain * v[:, None]
            errors[t], variances[t] = v, f
        return errors, variances, a, p


def likelihoods(w: np.ndarray, ar: np.ndarray, ma: np.ndarray, centred: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log likelihood, mean, variance of innovations), both at their best, of w under each process; mean 0 where not centred."""
    n, batch = len(w), len(ar)
    columns = np.broadcast_to(np.stack([w, np.ones(n)], 1)[:, None], (n, batch, 2))
    errors, f, _, _ = Filter(ar, ma).run(columns)
    v, one = errors[:, :, 0], errors[:, :, 1]
    mean = np.where(centred, (v * one / f).sum(0) / (one * one / f).sum(0), 0.0)
    variance = np.maximum(((v - mean * one) ** 2 / f).mean(0), 1e-12 * max(float(np.var(w)), 1e-300))
    return -0.5 * (n * (np.log(2 * math.pi * variance) + 1) + np.log(f).sum(0)), mean, variance


def _searched(loss, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quasi-Newton descent from each row of x side by side; loss takes rows and the number of the search of each."""
    n, k = x.shape
    value, curve = loss(x, np.arange(n)), np.broadcast_to(np.eye(k), (n, k, k)).copy()
    if not k:
        return x, value

    def slope(rows: np.ndarray, own: np.ndarray) -> np.ndarray:
        h = 1e-5
        around = rows[:, None, :] + h * np.concatenate([np.eye(k), -np.eye(k)])[None]
        v = loss(around.reshape(-1, k), np.repeat(own, 2 * k)).reshape(len(rows), 2, k)
        return (v[:, 0] - v[:, 1]) / (2 * h)

    gradient, going = slope(x, np.arange(n)), np.arange(n)
    for _ in range(SEARCH_STEPS):
        g = gradient[going]
        ahead = -np.einsum("bij,bj->bi", curve[going], g)
        ahead = np.where((ahead * g).sum(1, keepdims=True) < 0, ahead, -g)
        tried = x[going][:, None, :] + STEPS[None, :, None] * ahead[:, None, :]
        v = loss(tried.reshape(-1, k), np.repeat(going, len(STEPS))).reshape(len(going), -1)
        at, rows = v.argmin(1), np.arange(len(going))
        better = v[rows, at] < value[going] - 1e-10 * (1 + np.abs(value[going]))
        going, moved = going[better], tried[rows, at][better]
        if not len(going):
            break
        value[going] = v[rows, at][better]
        s, before = moved - x[going], gradient[going]
        x[going] = moved
        gradient[going] = slope(moved, going)
        y = gradient[going] - before
        for i, own in enumerate(going):
            if (sy := float(s[i] @ y[i])) > 1e-12:
                left = np.eye(k) - np.outer(s[i], y[i]) / sy
                curve[own] = left @ curve[own] @ left.T + np.outer(s[i], s[i]) / sy
    return x, value


def fits(y: np.ndarray, orders: tuple = ORDERS) -> list[dict]:
    """The models of y of the orders that it is long enough for, in that order."""
    out: dict[tuple, dict] = {}
    for d in {d for _, d, _ in orders}:
        w = np.diff(y, d) if d else np.asarray(y, float)
        own = [o for o in orders if o[1] == d and len(y) > sum(o) + 3 and len(w) >= 3 and (np.std(w) > 0 or o == (0, 1, 0))]
        if not own:
            continue
        lags = max(max(p, q) for p, _, q in own)
        used = np.array([[i < p for i in range(lags)] + [j < q for j in range(lags)] for p, _, q in own for _ in STARTS])
        x = np.where(used, np.array([[a / (i + 1) for i in range(lags)] + [m / (j + 1) for j in range(lags)] for _ in own for a, m in STARTS]), 0.0)
        scaled = w / (np.std(w) or 1.0)

        def parts(rows: np.ndarray, search: np.ndarray, used=used, lags=lags) -> tuple[np.ndarray, np.ndarray]:
            partial = np.where(used[search], 0.9999 * np.tanh(rows), 0.0)
            return coefficients(partial[:, :lags]), -coefficients(partial[:, lags:])

        def loss(rows: np.ndarray, search: np.ndarray, d=d, scaled=scaled, parts=parts) -> np.ndarray:
            value = -likelihoods(scaled, *parts(rows, search), np.full(len(rows), not d))[0] / len(scaled)
            return np.where(np.isfinite(value), value, 1e12)

        x, value = _searched(loss, x)
        for k, (p, _, q) in enumerate(own):
            best = k * len(STARTS) + int(np.argmin(value[k * len(STARTS) : (k + 1) * len(STARTS)]))
            ar, ma = (c[:, :n] for c, n in zip(parts(x[best : best + 1], np.array([best])), (p, q), strict=True))
            log, mean, variance = likelihoods(w, ar, ma, np.array([not d]))
            if not np.isfinite(log[0]):
                continue
            n, free = len(w), p + q + 1 + (not d)
            aic = 2 * free - 2 * log[0]
            out[p, d, q] = {"order": (p, d, q), "ar": ar[0], "ma": ma[0], "mean": mean[0], "variance": variance[0], "loglik": log[0], "aicc": aic + 2 * free * (free + 1) / (n - free - 1) if n - free - 1 > 0 else aic}
    return [out[o] for o in orders if o in out]


def fit(y: np.ndarray, order: tuple[int, int, int]) -> dict | None:
    return next(iter(fits(y, (order,))), None)


def best_fit(y: np.ndarray) -> dict | None:
    return min(fits(y), key=lambda m: m["aicc"], default=None)


def project(y: np.ndarray, model: dict, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and standard deviations of the next points; levels of a differenced series add its predictions up, with their covariances."""
    d = model["order"][1]
    w = (np.diff(y, d) if d else np.asarray(y, float)) - model["mean"]
    own = Filter(model["ar"][None], model["ma"][None])
    _, _, a, p = own.run(w[:, None, None])
    r = len(a[0])
    # the state and the level so far; an observation is the sum of the next difference and that level
    state, spread = np.concatenate([a[0, :, 0], [y[-1] if d else 0.0]]), np.zeros((r + 1, r + 1))
    spread[:r, :r] = p[0]
    step, noise, sees = np.zeros((r + 1, r + 1)), np.zeros((r + 1, r + 1)), np.zeros(r + 1)
    step[:r, :r], noise[:r, :r], sees[0] = own.step[0], own.noise[0], 1.0
    if d:
        step[r, 0] = step[r, r] = sees[r] = 1.0
    means, variances = [], []
    for _ in range(horizon):
        means.append(sees @ state + model["mean"])
        variances.append(sees @ spread @ sees)
        state, spread = step @ state, step @ spread @ step.T + noise
    return np.array(means), np.sqrt(model["variance"] * np.array(variances))


def backtest(y: np.ndarray) -> float | None:
    """Mean absolute percentage error of the last three points, from a model without them; points of 0 are left out."""
    if len(y) < LEAST_BACKTEST or not (m := best_fit(y[:-BACKTEST])):
        return None
    mean, _ = project(y[:-BACKTEST], m, BACKTEST)
    actual = y[-BACKTEST:]
    use = actual != 0
    return float(np.mean(np.abs((mean[use] - actual[use]) / actual[use]))) if use.any() else None


def forecasts(series: DataFrame, horizon: int = 3, floor: float | None = None, frequency: str = "month") -> DataFrame:
    """Rows (subject, step, period, mean, lower80 …) of (subject, period, value); series that refuse give none."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("period")
        y = pdf["value"].to_numpy(float)
        columns = ["subject", "step", "period", "mean", "lower80", "upper80", "lower95", "upper95", "model", "backtest_error", "direction", "trusted", "last_actual", "n"]
        model = best_fit(y) if len(y) >= LEAST_PERIODS and np.isfinite(y).all() else None
        if not model:
            return pd.DataFrame(columns=columns)
        mean, sd = project(y, model, horizon)
        cut = (lambda v: np.maximum(v, floor)) if floor is not None else (lambda v: v)
        error, level = backtest(y), float(np.median(y[-6:]))
        low, high = cut(mean - Z80 * sd), cut(mean + Z80 * sd)
        direction = "up" if low[-1] > level else "down" if high[-1] < level else "flat"
        last = pd.Timestamp(pdf["period"].iloc[-1])
        return pd.DataFrame({
            "subject": pdf["subject"].iloc[0], "step": range(1, horizon + 1), "period": [(last + pd.DateOffset(**{f"{frequency}s": i})).date() for i in range(1, horizon + 1)], "mean": cut(mean), "lower80": low, "upper80": high,
            "lower95": cut(mean - Z95 * sd), "upper95": cut(mean + Z95 * sd), "model": str(model["order"]), "backtest_error": error, "direction": direction, "trusted": error is not None and error <= TRUSTED, "last_actual": float(y[-1]), "n": len(y),
        })[columns]

    return series.select("subject", "period", "value").groupBy("subject").applyInPandas(run, "subject string, step int, period date, mean double, lower80 double, upper80 double, lower95 double, upper95 double, model string, backtest_error double, direction string, trusted boolean, last_actual double, n long")
