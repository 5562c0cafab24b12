"""Tests that need a sample's whole row: logistic regression with covariates, permutation p, and mixed models with a kinship matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from . import association

MOST_SAMPLES = 4000  # of a mixed model that has no fewer variants: its matrix of samples by samples is decomposed on the driver, and each task holds one
TEST = "snp_id long, n long, effect double, se double, stat double, p double"


def _cells(gt: DataFrame, pheno: DataFrame, response: str, covariates: list[str], model: str = "additive") -> DataFrame:
    """snp_id and, for each called cell, the response, the covariates and the recoded dosage."""
    p = pheno.select("sample_id", F.col(response).cast("double").alias("_y"), F.array(*[F.col(c).cast("double") for c in covariates]).alias("_c") if covariates else F.expr("cast(array() as array<double>)").alias("_c"))
    p = p.where(F.col("_y").isNotNull() & ~F.exists("_c", lambda x: x.isNull()))
    return gt.where("dosage is not null").join(p, "sample_id").select("snp_id", "sample_id", association.recode(model).cast("double").alias("_x"), "_y", "_c")


def logistic_fit(x: np.ndarray, y: np.ndarray, rounds: int = 25, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Coefficients, standard errors and convergence of a 0/1 response by Newton's method; classes that separate do not converge. `times` is how often each row stands."""
    b = np.zeros(x.shape[1])
    times = np.ones(len(y)) if times is None else times
    info, done = np.eye(len(b)), False
    for _ in range(rounds):
        info, slope = np.zeros((len(b), len(b))), np.zeros(len(b))
        for i in range(0, len(y), 65536):
            part, t = x[i : i + 65536], times[i : i + 65536]
            p = 1 / (1 + np.exp(-(part @ b).clip(-30, 30)))
            info += (part * (t * p * (1 - p))[:, None]).T @ part
            slope += part.T @ (t * (y[i : i + 65536] - p))
        try:
            step = np.linalg.solve(info, slope)
        except np.linalg.LinAlgError:
            return b, np.full(len(b), np.nan), False
        b = b + step
        if np.abs(step).max() < 1e-10:
            done = True
            break
    return b, np.sqrt(np.maximum(np.diag(np.linalg.pinv(info)), 0)), done and np.abs(b).max() < 25


def logistic(gt: DataFrame, pheno: DataFrame, response: str, covariates: list[str], model: str = "additive") -> DataFrame:
    """snp_id, n, effect, se, stat, p, converged, low, high (95 % limits of the odds ratio) of a 0/1 response ~ covariates + dosage.

    Equal rows of a variant are counted before they meet. A task then holds one variant's distinct rows as plain numbers: as many as samples where a covariate is continuous."""

    def fit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        snp, rows = None, []
        for t in parts:
            snp = t.column(0)[0].as_py()
            c = t.column(3).flatten().to_numpy().reshape(t.num_rows, len(covariates))
            rows.append(np.column_stack([np.ones(t.num_rows), c, t.column(1).to_numpy(), t.column(2).to_numpy(), t.column(4).to_numpy()]))
        rows = np.concatenate(rows)
        n = int(rows[:, -1].sum())
        b, se, done = logistic_fit(rows[:, :-2], rows[:, -2], times=rows[:, -1])
        e, s = float(b[-1]), float(se[-1])
        ok = bool(done and s > 0)
        z = e / s if ok else None
        out = (snp, n, e, s, z, stats.normal_two_sided(z), True, float(np.exp(e - 1.959964 * s)), float(np.exp(e + 1.959964 * s))) if ok else (snp, n, None, None, None, None, False, None, None)
        types = [pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.bool_(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(out, types)], [*(c.split()[0] for c in TEST.split(", ")), "converged", "low", "high"])

    rows = _cells(gt, pheno, response, covariates, model).groupBy("snp_id", "_x", "_y", "_c").agg(F.count(F.lit(1)).cast("double").alias("times"))
    return rows.groupBy("snp_id").applyInArrow(fit, TEST + ", converged boolean, low double, high double")


def permutation_p(gt: DataFrame, pheno: DataFrame, response: str, times: int = 1000, seed: int = 1) -> DataFrame:
    """snp_id, p: share (with one added to both counts) of shuffled responses whose squared correlation with the dosage reaches the observed one.

    Draws depend on the seed and the variant only, so that a lost task gives the same p again."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("sample_id")
        x, y = t["_x"].to_numpy() - t["_x"].mean(), t["_y"].to_numpy() - t["_y"].mean()
        rng = np.random.default_rng([seed, int(t.snp_id.iloc[0])])
        seen = abs(x @ y)
        more = sum(abs(x @ rng.permutation(y)) >= seen * (1 - 1e-12) for _ in range(times))
        return pd.DataFrame({"snp_id": [t.snp_id.iloc[0]], "p": [(more + 1) / (times + 1)]})

    return _cells(gt, pheno, response, []).drop("_c").groupBy("snp_id").applyInPandas(run, "snp_id long, p double")


def _matrix(gt: DataFrame, order: list[int]) -> np.ndarray:
    """Kinship of samples: mean product of standardised dosages, summed in blocks of variants by the tasks."""
    from .relatedness import standardised

    place = {s: i for i, s in enumerate(order)}
    n = len(order)

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, m = np.zeros((n, n)), 0
        for t in batches:
            z = np.zeros((len(t), n))
            for r, cells in enumerate(t.cells):
                for c in cells:
                    i = place.get(c["sample_id"])
                    if i is not None:
                        z[r, i] = c["z"]
            k += z.T @ z
            m += len(t)
        for i in range(0, n if m else 0, 256):
            yield pd.DataFrame({"row": range(i, min(i + 256, n)), "m": [m if j == 0 else 0 for j in range(i, min(i + 256, n))], "v": list(k[i : i + 256])})

    z, variants = standardised(gt).groupBy("snp_id").agg(F.collect_list(F.struct("sample_id", "z")).alias("cells")), 0
    out = np.zeros((n, n))
    for r in z.mapInPandas(block, "row long, m long, v array<double>").toLocalIterator():  # one task's rows at a time
        out[r.row] += r.v
        variants += r.m
    return out / max(1, variants)


def _sum_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row, total = None, 0.0
    for t in parts:
        for k in range(t.num_rows):
            row, total = t.column(0)[k].as_py(), total + t.column(1).slice(k, 1).flatten().to_numpy()
    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([total], pa.list_(pa.float64()))], ["row", "v"])


def _products(gt: DataFrame, p: DataFrame, ids: list[int], names: list[str], means: list[float]) -> np.ndarray:
    """Products over samples of the columns dosage (0 where not called) and called of each variant in `ids`, one, and each of `names` less its mean.

    A task holds one such table and 256 samples; counts and sums of whole dosages are exact. Samples are never gathered."""
    known = np.array(ids, dtype=np.int64)
    m, k = len(ids), 2 * len(ids) + 1 + len(names)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((k, k)), 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                t = batch.slice(start, 256)
                cells, n = t.column(0), t.num_rows
                at = np.repeat(np.arange(n), cells.value_lengths().to_numpy())
                flat = cells.flatten()
                place = np.searchsorted(known, flat.field(0).to_numpy())
                x = np.zeros((n, k))
                x[at, place] = flat.field(1).to_numpy()
                x[at, m + place] = 1
                x[:, 2 * m] = 1
                for i, mean in enumerate(means):
                    x[:, 2 * m + 1 + i] = t.column(1 + i).to_numpy() - mean
                total += x.T @ x
                seen += n
        for i in range(0, k if seen else 0, 256):
            yield pa.RecordBatch.from_arrays([pa.array(range(i, min(i + 256, k)), pa.int64()), pa.array(list(total[i : i + 256]), pa.list_(pa.float64()))], ["row", "v"])

    cells = gt.groupBy("sample_id").agg(F.collect_list(F.struct(F.col("snp_id").cast("long"), F.col("dosage").cast("double"))).alias("cells"))
    rows = cells.join(p, "sample_id").select("cells", *names).mapInArrow(block, "row long, v array<double>")
    out = np.zeros((k, k))
    for r in rows.groupBy("row").applyInArrow(_sum_rows, "row long, v array<double>").collect():  # one table
        out[r.row] = r.v
    return out


def _by_variants(gt: DataFrame, p: DataFrame, ids: list[int], covariates: list[str], n: int) -> DataFrame:
    """mixed() of any number of samples and fewer variants. The kinship Z Z' / m has the eigenvalues of the small Z' Z / m, and zero for all directions that Z does
    not span; what a sum over those holds is the whole product of two columns less the part that Z spans."""
    names = ["y", *covariates]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    seen = p.agg(*[F.avg(c) for c in names], *[F.covar_pop(a, b) for a, b in pairs]).first()
    own = np.zeros((1 + len(names), 1 + len(names)))
    own[0, 0] = n
    for (a, b), v in zip(pairs, seen[len(names) :]):
        i, j = 1 + names.index(a), 1 + names.index(b)
        own[i, j] = own[j, i] = n * v
    every, m = _products(gt, p, ids, names, list(seen[: len(names)])), len(ids)
    xx, xc, cc = every[:m, :m], every[:m, m : 2 * m], every[m : 2 * m, m : 2 * m]
    called, sums = np.diag(cc), np.diag(xc)
    spread = np.diag(xx) * called - sums * sums
    vary = np.flatnonzero((called > 1) & (spread > 1e-12 * np.diag(xx) * called))
    mean = (sums / np.maximum(called, 1))[vary]
    sd = np.sqrt(spread[vary] / (called[vary] * (called[vary] - 1)))
    xc, cc = xc[np.ix_(vary, vary)], cc[np.ix_(vary, vary)]
    gram = (xx[np.ix_(vary, vary)] - mean[:, None] * xc.T - mean * xc + np.outer(mean, mean) * cc) / np.outer(sd, sd)
    with_own = (every[vary, 2 * m :] - mean[:, None] * every[m + vary, 2 * m :]) / sd[:, None]
    size, vectors = np.linalg.eigh((gram + gram.T) / 2)
    held = size > 1e-12 * max(size.max(initial=0), 1e-300)
    size, vectors = size[held], vectors[:, held]
    turned = (vectors / np.sqrt(size)).T @ with_own
    apart, x, y = own - turned.T @ turned, np.delete(turned, 1, axis=1), turned[:, 1]
    values, order = size / max(1, len(vary)), [1, 0, *range(2, 1 + len(names))]
    apart = apart[np.ix_(order, order)]  # of the response, then one and the covariates
    ratio = variance_ratio(values, y, x, n - len(size), apart)
    w = 1 / (values + ratio)
    length = lambda c: max(float(c @ apart @ c), 0.0) / ratio
    a = (x * w[:, None]).T @ x + apart[1:, 1:] / ratio
    b0 = np.linalg.solve(a, (x * w[:, None]).T @ y + apart[1:, 0] / ratio)
    rest, df = y - x @ b0, n - len(b0) - 1
    rows = vectors * np.sqrt(size) * sd[:, None]  # the variants, which Z spans
    place = {j: i for i, j in enumerate(vary)}
    out = []
    for j, snp in enumerate(ids):
        r = rows[place[j]] if j in place else np.zeros(len(w))
        c = np.linalg.solve(a, (x * w[:, None]).T @ r)
        r0 = r - x @ c
        norm = float((w * r0 * r0).sum()) + length(np.array([0, *c]))
        if norm < 1e-10 or df <= 0:
            out.append((snp, int(called[j]), None, None, None, None, 0.0))
            continue
        ridge = float((w * r * rest).sum())
        b = ridge / norm
        se = float(np.sqrt(((w * (rest - b * r0) ** 2).sum() + length(np.array([1, *(b * c - b0)]))) / df / norm))
        out.append((snp, int(called[j]), b, se, b / se, stats.t_two_sided(b / se, df), ridge))
    return gt.sparkSession.createDataFrame(out, TEST + ", ridge double")


def variance_ratio(values: np.ndarray, y: np.ndarray, x: np.ndarray, zeros: int = 0, apart: np.ndarray | None = None) -> float:
    """Ratio of residual to kinship variance with the greatest restricted likelihood; y and x are rotated by the kinship's eigenvectors.

    `zeros` more eigenvalues are zero, and `apart` has the products of y and the columns of x in their directions."""
    q = x.shape[1]
    n = len(values) + zeros
    apart = np.zeros((q + 1, q + 1)) if apart is None else apart

    def score(log_ratio: float) -> float:
        ratio = np.exp(log_ratio)
        d = values + ratio
        a = (x / d[:, None]).T @ x + apart[1:, 1:] / ratio
        b = np.linalg.solve(a, (x / d[:, None]).T @ y + apart[1:, 0] / ratio)
        r, c = y - x @ b, np.array([1, *-b])
        return -0.5 * ((n - q) * np.log((r * r / d).sum() + c @ apart @ c / ratio) + np.log(d).sum() + zeros * log_ratio + np.linalg.slogdet(a)[1])

    grid = np.linspace(-10, 10, 81)
    at = grid[int(np.argmax([score(g) for g in grid]))]
    lo, hi = at - 0.25, at + 0.25
    for _ in range(40):
        a, b = lo + (hi - lo) * 0.381966, lo + (hi - lo) * 0.618034
        lo, hi = (lo, b) if score(a) > score(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def mixed(gt: DataFrame, pheno: DataFrame, response: str, covariates: list[str] = (), kinship: np.ndarray | None = None) -> DataFrame:
    """snp_id, n, effect, se, stat, p, ridge of response ~ covariates + dosage + a random effect with the samples' kinship.

    The variance ratio is found once without variants, then each variant is tested by generalised least squares on rotated data, in tasks that hold the
    rotation. `ridge` is the variant's effect where all variants are random. Missing cells count as the variant's mean. Samples are not bounded where there are
    fewer variants than samples, and at most half of MOST_SAMPLES (theirs is a table of two columns a variant); otherwise they are, by MOST_SAMPLES."""
    p = pheno.select("sample_id", F.col(response).cast("double").alias("y"), *[F.col(c).cast("double") for c in covariates]).dropna()
    most = MOST_SAMPLES // 2
    if kinship is None:
        called = gt.where("dosage is not null and snp_id is not null")
        ids = sorted(r.snp_id for r in called.select("snp_id").distinct().limit(most + 1).collect())
        samples = p.count()
        if len(ids) <= most and len(ids) < samples:
            return _by_variants(called, p, ids, list(covariates), samples)
    got = p.orderBy("sample_id").limit(MOST_SAMPLES + 1).toPandas()
    if len(got) > MOST_SAMPLES:
        raise ValueError(f"a mixed model takes at most {MOST_SAMPLES} samples, or more where there are at most {most} variants; use linear_adjusted with principal components beyond that")
    order = [int(s) for s in got.sample_id]
    n = len(order)
    k = _matrix(gt.join(p.select("sample_id"), "sample_id", "left_semi"), order) if kinship is None else kinship
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    values = np.maximum(values, 0)
    y, x = vectors.T @ got.y.to_numpy(), vectors.T @ np.column_stack([np.ones(n), *(got[c] for c in covariates)])
    d = values + variance_ratio(values, y, x)
    w = 1 / d
    a = (x * w[:, None]).T @ x
    rest = y - x @ np.linalg.solve(a, (x * w[:, None]).T @ y)
    place = {s: i for i, s in enumerate(order)}

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for snp, cells in zip(t.snp_id, t.cells):
                g = np.full(n, np.nan)
                for c in cells:
                    if c["sample_id"] in place:
                        g[place[c["sample_id"]]] = c["dosage"]
                called = int((~np.isnan(g)).sum())
                g = np.nan_to_num(g - np.nanmean(g)) if called else np.zeros(n)
                r = vectors.T @ g
                r0 = r - x @ np.linalg.solve(a, (x * w[:, None]).T @ r)
                size, df = float((w * r0 * r0).sum()), n - x.shape[1] - 1
                if size < 1e-10 or df <= 0:
                    out.append((snp, called, None, None, None, None, 0.0))
                    continue
                b = float((w * r0 * rest).sum()) / size
                se = float(np.sqrt((w * (rest - b * r0) ** 2).sum() / df / size))
                out.append((snp, called, b, se, b / se, stats.t_two_sided(b / se, df), float((w * r * rest).sum())))
            yield pd.DataFrame(out, columns=["snp_id", "n", "effect", "se", "stat", "p", "ridge"])

    rows = gt.where("dosage is not null").groupBy("snp_id").agg(F.collect_list(F.struct("sample_id", "dosage")).alias("cells"))
    return rows.mapInPandas(test, TEST + ", ridge double")
