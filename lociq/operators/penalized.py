"""Penalised joint effects from summary statistics and linkage, block by block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def correlations(tests: DataFrame) -> DataFrame:
    """snp_id, cor of variant and response from a test's statistic: t / sqrt(n - 2 + t^2)."""
    t = F.col("stat")
    return tests.select("snp_id", F.coalesce(F.nanvl(t / F.sqrt(F.col("n") - 2 + t * t), F.lit(0.0)), F.lit(0.0)).alias("cor"))


def coordinate_descent(ld: np.ndarray, cor: np.ndarray, shrink: float, penalty: float, rounds: int = 1000, tol: float = 1e-10) -> np.ndarray:
    """Minimises b'Rb - 2 b'cor + 2 * penalty * |b| with R = (1 - shrink) * ld + shrink * I and a unit diagonal."""
    r = (1 - shrink) * ld
    np.fill_diagonal(r, 1.0)
    b = np.zeros(len(cor))
    fit = np.zeros(len(cor))
    for _ in range(rounds):
        most = 0.0
        for j in range(len(cor)):
            z = cor[j] - (fit[j] - b[j])
            new = np.sign(z) * max(abs(z) - penalty, 0.0)
            if new != b[j]:
                most = max(most, abs(new - b[j]))
                fit += r[:, j] * (new - b[j])
                b[j] = new
        if most < tol:
            break
    return b


def summary_lasso(cor: DataFrame, ld: DataFrame, variants: DataFrame, shrinks: list[float], penalties: list[float]) -> DataFrame:
    """snp_id, shrink, penalty, beta for a grid of settings. A chromosome is a block: linkage beyond `ld`'s pairs counts as none, and blocks are solved apart."""
    place = variants.select("snp_id", "chromosome")
    near = ld.select(F.col("snp1").alias("snp_id"), F.col("snp2").alias("other"), "r").groupBy("snp_id").agg(F.collect_list(F.struct("other", "r")).alias("near"))
    rows = cor.join(place, "snp_id").join(near, "snp_id", "left")

    def solve(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("snp_id").reset_index(drop=True)
        at = {s: i for i, s in enumerate(t.snp_id)}
        m = np.eye(len(t))
        for i, pairs in enumerate(t.near):
            for p in pairs if pairs is not None else ():
                j = at.get(p["other"])
                if j is not None and p["r"] is not None and np.isfinite(p["r"]):
                    m[i, j] = m[j, i] = p["r"]
        out = [pd.DataFrame({"snp_id": t.snp_id, "shrink": s, "penalty": k, "beta": coordinate_descent(m.copy(), t.cor.to_numpy(), s, k)}) for s in shrinks for k in penalties]
        return pd.concat(out)

    return rows.groupBy("chromosome").applyInPandas(solve, "snp_id long, shrink double, penalty double, beta double")
