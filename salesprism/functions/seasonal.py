"""Robust seasonal-trend decomposition by local regression (Cleveland et al. 1990) of short series, one group a series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

SEASONAL_SPAN, INNER, OUTER = 7, 2, 15


def loess(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: int, robust: np.ndarray) -> np.ndarray:
    """Local linear fits of y on x at the given points, tricube weights over the span nearest points."""
    distance = np.abs(at[:, None] - x[None, :])
    k = min(span, len(x))
    width = np.partition(distance, k - 1, axis=1)[:, k - 1]
    if span > len(x):
        width = width + (span - len(x)) / 2
    width = np.maximum(width, 1e-9)[:, None] * 1.0000001
    w = np.where(distance < width, (1 - (distance / width) ** 3) ** 3, 0.0) * robust
    w = np.where(w.sum(1, keepdims=True) > 0, w, 1e-12)
    s0, s1, s2 = w.sum(1), w @ x, w @ (x * x)
    t0, t1 = w @ y, w @ (x * y)
    spread = s2 * s0 - s1 * s1
    slope = np.where(spread > 1e-9 * s0 * s0, (t1 * s0 - s1 * t0) / np.where(spread == 0, 1, spread), 0.0)
    return t0 / s0 + slope * (at - s1 / s0)


def _moving(y: np.ndarray, n: int) -> np.ndarray:
    c = np.cumsum(np.concatenate([[0.0], y]))
    return (c[n:] - c[:-n]) / n


def _odd(x: float) -> int:
    n = int(np.ceil(x))
    return n if n % 2 else n + 1


def stl(y: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(seasonal, trend); None for less than two cycles."""
    n = len(y)
    if n < 2 * period or not np.isfinite(y).all():
        return None
    trend_span, low_span = _odd(1.5 * period / (1 - 1.5 / SEASONAL_SPAN)), _odd(period)
    x, trend, seasonal, robust = np.arange(n, dtype=float), np.zeros(n), np.zeros(n), np.ones(n)
    for outer in range(OUTER + 1):
        for _ in range(INNER):
            left = y - trend
            cycle = np.zeros(n + 2 * period)
            for p in range(period):
                own = np.arange(p, n, period)
                i = np.arange(len(own), dtype=float)
                cycle[p::period][: len(own) + 2] = loess(i, left[own], np.arange(-1, len(own) + 1, dtype=float), SEASONAL_SPAN, robust[own])
            low = _moving(_moving(_moving(cycle, period), period), 3)
            seasonal = cycle[period : period + n] - loess(x, low, x, low_span, np.ones(n))
            trend = loess(x, y - seasonal, x, trend_span, robust)
        if outer < OUTER:
            off = np.abs(y - seasonal - trend)
            h = 6 * np.median(off)
            robust = np.ones(n) if h <= 1e-12 else np.where(off < h, (1 - np.minimum(off / h, 1) ** 2) ** 2, 0.0)
    return seasonal, trend


def strength(y: np.ndarray, seasonal: np.ndarray, trend: np.ndarray) -> float:
    rest = y - seasonal - trend
    whole = np.var(seasonal + rest)
    return float(np.clip(1 - np.var(rest) / whole, 0, 1)) if whole > 0 else 0.0


def seasonal_parts(series: DataFrame, cycle: int) -> DataFrame:
    """(subject, period, value, seasonal, adjusted, strength) of (subject, period, value); nulls where a series is too short."""

    def parts(pdf):
        pdf = pdf.sort_values("period")
        y = pdf["value"].to_numpy(float)
        found = stl(y, cycle)
        return pdf.assign(seasonal=found[0] if found else None, adjusted=y - found[0] if found else None, strength=strength(y, *found) if found else None)[["subject", "period", "value", "seasonal", "adjusted", "strength"]]

    return series.select("subject", "period", "value").groupBy("subject").applyInPandas(parts, "subject string, period date, value double, seasonal double, adjusted double, strength double")
