"""Tail probabilities and test statistics in plain numpy, for use inside grouped functions and on the driver."""

from __future__ import annotations

import math

import numpy as np


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return 1.0 if math.isnan(t) else incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_upper(t: float, df: float) -> float:
    half = t_two_sided(t, df) / 2
    return half if t >= 0 else 1 - half


def f_upper(f: float, df1: float, df2: float) -> float:
    return 1.0 if f <= 0 else incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def chi2_upper(x: float, df: float) -> float:
    """Upper tail by series or continued fraction of the incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def tracy_widom(eigenvalues: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    """Effective-marker-corrected statistics of sorted eigenvalues; nan where undefined."""
    e = np.maximum(np.sort(np.asarray(eigenvalues, dtype=float))[::-1], tol)
    n = np.arange(len(e), 0, -1.0)
    l1, l2 = np.cumsum(e[::-1])[::-1], np.cumsum(e[::-1] ** 2)[::-1]
    with np.errstate(all="ignore"):
        s2 = n**2 * l2 / l1**2
        v = n * (n + 2) / (s2 - n)
        root = np.sqrt(v - 1)
        mu = (root + np.sqrt(n)) ** 2 / v
        sigma = (root + np.sqrt(n)) / v * (1 / root + 1 / np.sqrt(n)) ** (1 / 3)
        return (n * e / l1 - mu) / sigma


def tracy_widom_upper(x: float) -> float:
    """Upper tail of the Tracy-Widom law of order 1, by the shifted gamma law with its first three moments."""
    shape, scale, shift = 46.446, 0.186054, 9.84801  # fixed values
    return 1.0 if math.isnan(x) or x <= -shift else chi2_upper(2 * (x + shift) / scale, 2 * shape)


def welch(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """One-sided (greater) unequal-variance t statistic and p."""
    a, b = x.var(ddof=1) / len(x), y.var(ddof=1) / len(y)
    t = (x.mean() - y.mean()) / math.sqrt(a + b)
    return t, t_upper(t, (a + b) ** 2 / (a * a / (len(x) - 1) + b * b / (len(y) - 1)))


def elbow(x: np.ndarray, y: np.ndarray) -> int:
    """Index of maximal curvature of a curve, from second differences after a cubic smoothing over seven points."""
    y = np.asarray(y, dtype=float)
    width = min(7, len(y) if len(y) % 2 else len(y) - 1)
    if width < 5:
        return int(np.argmax(y))
    half, out = width // 2, []
    for i in range(len(y)):
        s = slice(max(0, i - half), min(len(y), i + half + 1))
        c = np.polyfit(x[s] - x[i], y[s], min(3, len(y[s]) - 1))[::-1]
        out.append((c[1] if len(c) > 1 else 0.0, 2 * c[2] if len(c) > 2 else 0.0))
    d = np.array(out)
    return int(np.argmax(np.abs(d[:, 1]) / (1 + d[:, 0] ** 2) ** 1.5))


def landau_upper(w: float, mu: float, sigma: float = math.pi / 2) -> float:
    """Upper tail of the Landau law, by quadrature of its integral."""
    z = (w - mu) / sigma
    if z < -5:
        return 1.0
    t = np.linspace(1e-9, max(30.0 / max(z, 0.2), 60.0) if z < 20 else 60.0 / z, 400_001)
    f = np.exp(-t * z - 2 / math.pi * t * np.log(t)) * np.sin(2 * t) / t
    h = t[1] - t[0]
    return float(min(1.0, max(0.0, h * (f.sum() - (f[0] + f[-1]) / 2) / math.pi)))


def harmonic_p(p: np.ndarray, weights: np.ndarray | None = None) -> float:
    """Asymptotically exact p of the weighted harmonic mean; weights sum to one, 1/m each by default."""
    p = np.asarray(p, dtype=float)
    w = np.full(len(p), 1 / len(p)) if weights is None else np.asarray(weights, dtype=float)
    if abs(w.sum() - 1) > 1e-6:
        raise ValueError("weights must sum to one")
    return landau_upper(float((w / p).sum()), math.log(len(p)) + 0.874367040387922)


def weighted_p(p: np.ndarray, weights: np.ndarray | None = None) -> float:
    """Product of p to the power of its weight, 1/m each by default."""
    p = np.asarray(p, dtype=float)
    w = np.full(len(p), 1 / len(p)) if weights is None else np.asarray(weights, dtype=float)
    if len(w) != len(p):
        raise ValueError("there must be a weight for each p")
    return float(np.exp((w * np.log(p)).sum()))


def rank_sum_greater(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """W and the one-sided (greater) p of the rank-sum test: normal approximation with corrections for ties and continuity."""
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    every = np.concatenate([x, y])
    _, at, count = np.unique(every, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[at]
    m, n = len(x), len(y)
    w = rank[:m].sum() - m * (m + 1) / 2
    var = m * n / 12 * (m + n + 1 - (count**3 - count).sum() / ((m + n) * (m + n - 1)))
    return float(w), 1.0 if var <= 0 else 0.5 * math.erfc((w - m * n / 2 - 0.5) / math.sqrt(2 * var))


def kolmogorov_normal(x: np.ndarray) -> tuple[float, float]:
    """Distance to the normal law with the sample's mean and deviation, and its asymptotic p."""
    x = np.sort(np.asarray(x, dtype=float))
    n = len(x)
    f = np.array([0.5 * math.erfc(-(v - x.mean()) / x.std(ddof=1) / math.sqrt(2)) for v in x])
    d = max((np.arange(1, n + 1) / n - f).max(), (f - np.arange(n) / n).max())
    t = d * math.sqrt(n)
    return float(d), 1.0 if t < 0.2 else float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101)))))


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W and p for 4 to 5000 values, by the published polynomial approximations."""
    from statistics import NormalDist

    x = np.sort(np.asarray(x, dtype=float))
    n = len(x)
    if not 4 <= n <= 5000 or x[0] == x[-1]:
        raise ValueError("4 to 5000 values that are not all equal")
    norm = NormalDist()
    m = np.array([norm.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, size = 1 / math.sqrt(n), float(m @ m)
    # fixed values: the coefficients of the approximations, from the highest power
    last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / math.sqrt(size)], u)
    a = np.zeros(n)
    if n > 5:
        before = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(size)], u)
        phi = (size - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2)
        a[2:-2] = m[2:-2] / math.sqrt(phi)
        a[-2], a[1] = before, -before
    else:
        a[1:-1] = m[1:-1] / math.sqrt((size - 2 * m[-1] ** 2) / (1 - 2 * last**2))
    a[-1], a[0] = last, -last
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    if n <= 11:
        g = np.polyval([0.459, -2.273], n)
        z = -math.log(g - math.log(max(1 - w, 1e-300)))
        mean, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        z, ln = math.log(max(1 - w, 1e-300)), math.log(n)
        mean, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return w, 0.5 * math.erfc((z - mean) / sd / math.sqrt(2))


def jarque_bera(x: np.ndarray) -> tuple[float, float]:
    x = np.asarray(x, dtype=float) - np.mean(x)
    m2 = (x**2).mean()
    jb = len(x) / 6 * (((x**3).mean() / m2**1.5) ** 2 + ((x**4).mean() / m2**2 - 3) ** 2 / 4)
    return float(jb), chi2_upper(float(jb), 2)


def normality(x: np.ndarray, cut: float = 0.05, most: int = 5000, times: int = 1000, seed: int = 1) -> tuple[float, dict[str, float]]:
    """p against normality and the p of each test. Up to `most` values three tests count: the greatest p where all are below the cut, Simes' combination otherwise.
    Beyond, the share of `times` samples of 50 whose Shapiro-Wilk p reaches the cut decides: it is the p."""
    x = np.asarray(x, dtype=float)
    x = x[np.isfinite(x)]
    if len(x) > most:
        rng = np.random.default_rng(seed)
        share = float(np.mean([shapiro_wilk(rng.choice(x, 50, replace=False))[1] >= cut for _ in range(times)]))
        return share, {"resampled": share}
    each = {"shapiro": shapiro_wilk(x)[1], "kolmogorov": kolmogorov_normal(x)[1], "jarque_bera": jarque_bera(x)[1]}
    p = np.sort(list(each.values()))
    return (float(p[-1]) if (p < cut).all() else float(min(1.0, (len(p) * p / np.arange(1, len(p) + 1)).min()))), each
