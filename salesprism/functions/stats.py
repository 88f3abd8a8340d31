"""Tail probabilities in plain Python and as Arrow functions over columns; used on small tables of statistics only."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

ALPHA, WORTH_A_LOOK, LEAST_POINTS = 0.05, 0.15, 6


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def beta_cdf(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def gamma_tail(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = out = 1 / b
    for i in range(1, 1000):
        b += 2
        d = 1 / (i * (a - i) * d + b)
        c = b + i * (a - i) / c
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if math.isfinite(f) else 0.0


def chi2_tail(x: float, df: float) -> float:
    return gamma_tail(df / 2, x / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def t_quantile(p: float, df: float) -> float:
    """The point with probability p below it, by bisection."""
    low, high = -1e3, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        below = 1 - t_two_sided(mid, df) / 2 if mid >= 0 else t_two_sided(mid, df) / 2
        low, high = (mid, high) if below < p else (low, mid)
    return (low + high) / 2


def fisher_greater(together: int, n_a: int, n_b: int, n: int) -> float:
    """One-sided exact test of a 2x2 table: the probability of at least so many together."""
    log = lambda k: math.lgamma(n_a + 1) - math.lgamma(k + 1) - math.lgamma(n_a - k + 1) + math.lgamma(n - n_a + 1) - math.lgamma(n_b - k + 1) - math.lgamma(n - n_a - n_b + k + 1)
    whole = math.lgamma(n + 1) - math.lgamma(n_b + 1) - math.lgamma(n - n_b + 1)
    parts = [log(k) - whole for k in range(max(together, n_a + n_b - n), min(n_a, n_b) + 1)]
    if not parts:
        return 0.0
    top = max(parts)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in parts))


def _column_function(f):
    @pandas_udf(DoubleType())
    def apply(*columns):
        import pandas as pd

        rows = zip(*columns, strict=True)
        return pd.Series([None if any(x is None or np.isnan(x) for x in r) else f(*r) for r in rows], dtype=float)

    return apply


def log_gamma(x: np.ndarray) -> np.ndarray:
    """math.lgamma of an array; degrees of freedom repeat, so each value is computed once."""
    values, at = np.unique(x, return_inverse=True)
    return np.array([math.lgamma(v) for v in values.tolist()])[at]


def beta_cdf_array(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """beta_cdf() of arrays: the continued fraction goes on where it hasn't settled."""
    swap = x >= (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inside = (y > 0) & (y < 1)
    safe = np.where(inside, y, 0.5)
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + p * np.log(safe) + q * np.log1p(-safe))
    tiny = 1e-300
    floor = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    c, d = np.ones_like(safe), 1 / floor(1 - (p + q) * safe / (p + 1))
    out = d.copy()
    for m in range(1, 500):
        for top in (m * (q - m) * safe / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * safe / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / floor(1 + top * d)
            c = floor(1 + top / c)
            out *= c * d
        if (np.abs(c * d - 1) < 1e-15)[inside].all():
            break
    low = np.where(inside, front * out / p, (y >= 1).astype(float))
    return np.where(swap, 1 - low, low)


@pandas_udf(DoubleType())
def t_p(t, df):
    """t_two_sided() of columns."""
    import pandas as pd

    known = t.notna() & df.notna()
    x, n = t.where(known, 0.0).to_numpy(float), df.where(known, 1.0).to_numpy(float)
    with np.errstate(over="ignore", invalid="ignore"):
        p = np.where(np.isfinite(x), beta_cdf_array(n / 2, np.full(len(n), 0.5), np.where(np.isfinite(x), n / (n + x * x), 0.5)), 0.0)
    return pd.Series(p).where(known.to_numpy())


@pandas_udf(DoubleType())
def f_p(f, d1, d2):
    """f_tail() of columns."""
    import pandas as pd

    known = f.notna() & d1.notna() & d2.notna()
    x, a, b = (c.where(known, 1.0).to_numpy(float) for c in (f, d1, d2))
    with np.errstate(over="ignore", invalid="ignore"):
        p = np.where(np.isfinite(x), beta_cdf_array(b / 2, a / 2, np.where(np.isfinite(x), b / (b + a * np.where(np.isfinite(x), x, 1.0)), 0.5)), 0.0)
    return pd.Series(p).where(known.to_numpy())


def fisher_greater_array(together: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """fisher_greater() of arrays: terms follow each other by their ratio, from the count away from the mean, until none adds anything.

    Below the mean the smaller tail on the other side is summed, and taken from one.
    """
    k, a, b, m = (np.asarray(x, float) for x in (together, n_a, n_b, n))
    low, high = np.maximum(0.0, a + b - m), np.minimum(a, b)
    up = k > a * b / np.maximum(m, 1)
    start = np.clip(np.where(up, k, k - 1), low, high)
    log = lambda x: log_gamma(x + 1)
    first = log(a) - log(start) - log(a - start) + log(m - a) - log(b - start) - log(m - a - b + start) - log(m) + log(b) + log(m - b)
    term = np.exp(first)
    total, at, going = term.copy(), start.copy(), term > 0
    while going.any():
        ratio_up = (a - at) * (b - at) / np.maximum((at + 1) * (m - a - b + at + 1), 1.0)
        ratio_down = at * (m - a - b + at) / np.maximum((a - at + 1) * (b - at + 1), 1.0)
        term = np.where(going, term * np.where(up, ratio_up, ratio_down), 0.0)
        at = at + np.where(up, 1, -1)
        total += term
        going = going & (term > total * 1e-18) & (at > low - 1) & (at < high + 1)
    out = np.where(up, total, 1 - total)
    return np.clip(np.where(k <= low, 1.0, np.where(k > high, 0.0, out)), 0.0, 1.0)


@pandas_udf(DoubleType())
def fisher_p(together, n_a, n_b, n):
    """fisher_greater() of columns."""
    import pandas as pd

    known = together.notna() & n_a.notna() & n_b.notna() & n.notna()
    p = fisher_greater_array(*(c.where(known, 1.0).to_numpy(float) for c in (together, n_a, n_b, n)))
    return pd.Series(p).where(known.to_numpy())


chi2_p, normal_p = _column_function(chi2_tail), _column_function(normal_two_sided)
#: Bins of p to a factor of two, for families of any size.
P_BINS = 32


def step_up(tests: DataFrame, p: str = "p", family: str | None = None, total: int | None = None) -> DataFrame:
    """benjamini_hochberg() of families of any size: tests with adjusted, null where p is null; total: tests of the one family, if some were left out for a larger p.

    Tests go into bins of p. The counts of the bins say how many tests lie below each; ranks inside a bin give the
    least p * n / rank of the bin, and what is least in all later bins. Counts and least figures come to the driver, a
    row for each bin and family, P_BINS to a factor of two. What is 1 or 0 stays what it is and isn't ranked.
    """
    spark = tests.sparkSession
    name = F.coalesce(F.col(family), F.lit("")) if family else F.lit("")
    ranked = (F.col(p) > 0) & (F.col(p) < 1)
    t = tests.withColumn("_family", name).withColumn("_bin", F.when(ranked, F.floor(F.log2(p) * P_BINS)).when(F.col(p) >= 1, 0).when(F.col(p) <= 0, -100_000))
    places: dict[str, list[list]] = {}
    for r in t.where(F.col(p).isNotNull()).groupBy("_family", "_bin").agg(F.count("*").alias("n")).collect():
        places.setdefault(r["_family"], []).append([r["_bin"], r["n"]])
    bins = []
    for own, rows in places.items():
        below, n = 0, total if total is not None else sum(r[1] for r in rows)
        for number, size in sorted(rows):
            bins.append((own, number, n, below))
            below += size
    ahead = F.broadcast(spark.createDataFrame(bins, "_family string, _bin long, _n long, _below long"))
    inside = Window.partitionBy("_family", "_bin").orderBy(p)
    # equal p share the last of their ranks
    rank = F.col("_below") + F.count("*").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    raw = t.where(ranked).join(ahead, ["_family", "_bin"]).withColumn("_raw", F.col(p) * F.col("_n") / rank)
    least = {(r["_family"], r["_bin"]): r["least"] for r in raw.groupBy("_family", "_bin").agg(F.min("_raw").alias("least")).collect()}
    later, smallest = [], {}
    for own, number, _, _ in sorted(bins, key=lambda b: -b[1]):
        later.append((own, number, smallest.get(own, 1.0)))
        smallest[own] = min(smallest.get(own, 1.0), least.get((own, number), 1.0))
    after = F.broadcast(spark.createDataFrame(later, "_family string, _bin long, _later double"))
    own = F.min("_raw").over(inside.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    done = raw.withColumn("_own", own).join(after, ["_family", "_bin"]).withColumn("adjusted", F.least("_own", "_later"))
    rest = t.where(~ranked | F.col(p).isNull()).withColumn("adjusted", F.when(F.col(p) >= 1, 1.0).when(F.col(p) <= 0, 0.0))
    return done.select(*tests.columns, "adjusted").unionByName(rest.select(*tests.columns, "adjusted"))


def benjamini_hochberg(tests: DataFrame, p: str = "p", *order: str, family: str | None = None) -> DataFrame:
    """tests with adjusted: the least of p * n / rank over this and all larger p of its family, 1 at most; for small families, see step_up()."""
    w = Window.partitionBy(*([family] if family else []))
    rank = F.row_number().over(w.orderBy(p, *order))
    t = tests.withColumn("_rank", rank).withColumn("_n", F.count(p).over(w))
    tail = w.orderBy("_rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return t.withColumn("adjusted", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_rank")).over(tail))).drop("_rank", "_n")


def strength(p: Column) -> Column:
    return F.when(p.isNull(), "descriptive").when(p < 0.01, "strong").when(p < ALPHA, "clear").when(p < WORTH_A_LOOK, "worth a look").otherwise("not distinguishable from chance")
