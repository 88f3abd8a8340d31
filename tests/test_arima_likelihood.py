"""Exact likelihoods against the dense normal density, published fits of two known series, projections, and short series."""

from __future__ import annotations

import math

import numpy as np
import pytest

from salesprism.functions import arima as A

# Hormone levels of 48 samples, and the yearly flow of a river from 1871, as statistics textbooks print them.
HORMONE = [float(x) for x in "2.4 2.4 2.4 2.2 2.1 1.5 2.3 2.3 2.5 2.0 1.9 1.7 2.2 1.8 3.2 3.2 2.7 2.2 2.2 1.9 1.9 1.8 2.7 3.0 2.3 2.0 2.0 2.9 2.9 2.7 2.7 2.3 2.6 2.4 1.8 1.7 1.5 1.4 2.1 3.3 3.5 3.5 3.1 2.6 2.1 3.4 3.0 2.9".split()]
RIVER = [float(x) for x in "1120 1160 963 1210 1160 1160 813 1230 1370 1140 995 935 1110 994 1020 960 1180 799 958 1140 1100 1210 1150 1250 1260 1220 1030 1100 774 840 874 694 940 833 701 916 692 1020 1050 969 831 726 456 824 702 1120 1100 832 764 821 768 845 864 862 698 845 744 796 1040 759 781 865 845 944 984 897 822 1010 771 676 649 846 812 742 801 1040 860 874 848 890 744 749 838 1050 918 986 797 923 975 815 1020 906 901 1170 912 746 919 718 714 740".split()]


def covariance(ar, ma, n):
    psi = np.zeros(4000)
    for k in range(4000):
        psi[k] = (1.0 if k == 0 else ma[k - 1] if k - 1 < len(ma) else 0.0) + sum(ar[i] * psi[k - 1 - i] for i in range(min(len(ar), k)))
    g = np.array([psi[: 4000 - k] @ psi[k:] for k in range(n)])
    return g[np.abs(np.subtract.outer(range(n), range(n)))]


@pytest.mark.parametrize(("ar", "ma"), [([], []), ([0.6], []), ([], [0.4]), ([0.5, -0.3], [0.7]), ([0.95], [-0.4]), ([], [0.3, 0.9]), ([1.1, -0.5, 0.2], [0.4, 0.1])])
def test_likelihood_is_that_of_the_dense_normal(ar, ma):
    n, rng = 25, np.random.default_rng(len(ar) + 3 * len(ma))
    w, s, one = rng.normal(size=n) + 0.7, covariance(ar, ma, n), np.ones(n)
    inverse = np.linalg.inv(s)
    mean = (one @ inverse @ w) / (one @ inverse @ one)
    variance = (w - mean) @ inverse @ (w - mean) / n
    expected = -0.5 * (n * math.log(2 * math.pi * variance) + np.linalg.slogdet(s)[1] + n)
    got = A.likelihoods(w, np.array([ar]).reshape(1, -1), np.array([ma]).reshape(1, -1), np.array([True]))
    assert np.allclose([x[0] for x in got], [expected, mean, variance], rtol=0, atol=1e-8)


def test_published_fits():
    m = A.fit(np.array(HORMONE), (1, 0, 0))
    assert np.allclose([m["ar"][0], m["mean"], m["variance"], m["loglik"]], [0.5739, 2.4133, 0.1975, -29.38], atol=6e-3)
    m = A.fit(np.array(HORMONE), (3, 0, 0))
    mean, sd = A.project(np.array(HORMONE), m, 4)
    assert np.allclose(mean, [2.4602, 2.2708, 2.1986, 2.2607], atol=5e-3) and np.allclose(sd[:2], [0.4227, 0.5029], atol=2e-3)
    m = A.fit(np.array(RIVER), (0, 1, 1))
    assert np.allclose([m["ma"][0], m["variance"] / 1000, m["loglik"]], [-0.7329, 20.6, -632.55], atol=6e-3 * 10)
    assert m["aicc"] == pytest.approx(-2 * m["loglik"] + 4 + 12 / (99 - 3))


def test_projections_of_levels_add_up_with_their_covariance():
    y = np.array(RIVER)
    m = A.fit(y, (0, 1, 1))
    mean, sd = A.project(y, m, 5)
    # of this order: one level from the first step on, and a variance that grows by (1 + ma)^2 a step
    assert np.allclose(mean, mean[0]) and np.allclose(sd**2 / m["variance"], 1 + np.arange(5) * (1 + m["ma"][0]) ** 2, atol=1e-6)
    m = A.fit(y, (1, 1, 0))
    assert np.allclose(A.project(y, m, 1)[0], y[-1] + m["ar"][0] * (y[-1] - y[-2]))


def test_searches_reach_what_a_fine_grid_reaches():
    rng = np.random.default_rng(5)
    for n in (14, 40):
        e = rng.normal(size=n + 1)
        y = np.cumsum(e[1:] - 0.6 * e[:-1]) + 50
        w = np.diff(y)
        grid = np.linspace(-0.999, 0.999, 801)
        by_ma, by_ar = (A.likelihoods(w, a, m, np.zeros(len(grid), bool))[0].max() for a, m in ((np.zeros((801, 0)), grid[:, None]), (grid[:, None], np.zeros((801, 0)))))
        fits = {m["order"]: m for m in A.fits(y)}
        assert fits[0, 1, 1]["loglik"] >= by_ma - 1e-4 and fits[1, 1, 0]["loglik"] >= by_ar - 1e-4
        # a larger model is no worse than one inside it
        assert fits[1, 1, 1]["loglik"] >= max(by_ma, by_ar) - 1e-4 and fits[2, 1, 1]["loglik"] >= fits[1, 1, 1]["loglik"] - 1e-4


def test_short_and_constant_series():
    assert A.best_fit(np.array([1.0, 2.0, 3.0])) is None and {sum(m["order"]) for m in A.fits(np.arange(5.0) ** 2)} == {1}
    flat = A.best_fit(np.full(20, 7.0))
    assert flat["order"] == (0, 1, 0) and np.allclose(A.project(np.full(20, 7.0), flat, 3)[0], 7.0)
