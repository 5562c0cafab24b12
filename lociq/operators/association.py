"""Association tests by variant, from sufficient statistics: each reads the genotypes once and shuffles a few sums for each variant."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats


def recode(model: str, dosage: str = "dosage") -> Column:
    """The dosage under a genetic model."""
    d = F.col(dosage)
    rules = {"additive": d, "dominant": (d >= 1).cast("int"), "recessive": (d == 2).cast("int"), "heterozygote": (d == 1).cast("int")}
    if model not in rules:
        raise ValueError(f"unknown genetic model {model}")
    return rules[model]


def linear(gt: DataFrame, pheno: DataFrame, response: str, model: str = "additive") -> DataFrame:
    """snp_id, n, effect, se, stat, r2 of response ~ dosage."""
    x = gt.where("dosage is not null").withColumn("x", recode(model).cast("double")).join(pheno.select("sample_id", F.col(response).alias("y")).where("y is not null"), "sample_id")
    s = x.groupBy("snp_id").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("effect"), F.regr_r2("y", "x").alias("r2"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy")
    )
    se = F.sqrt((1 - F.col("r2")) * F.col("syy") / (F.col("n") - 2) / F.col("sxx"))
    return s.withColumn("se", se).select("snp_id", "n", "effect", "se", (F.col("effect") / F.col("se")).alias("stat"), "r2")


def linear_adjusted(gt: DataFrame, pheno: DataFrame, response: str, covariates: list[str], model: str = "additive") -> DataFrame:
    """snp_id, n, effect, se, stat, p of response ~ covariates + dosage. The cross products of one variant (a row of sums) are solved on their own."""
    names = ["one", *covariates, "x"]
    cells = gt.where("dosage is not null").withColumn("x", recode(model).cast("double")).withColumn("one", F.lit(1.0))
    cells = cells.join(pheno.select("sample_id", F.col(response).cast("double").alias("y"), *[F.col(c).cast("double") for c in covariates]).dropna(), "sample_id")
    k = len(names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = cells.groupBy("snp_id").agg(F.array(*[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).alias("xx"), F.array(*[F.sum(F.col(a) * F.col("y")) for a in names]).alias("xy"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.count(F.lit(1)).alias("n"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = np.triu_indices(k)
        for t in batches:
            out = []
            for r in t.itertuples():
                a = np.zeros((k, k))
                a[upper] = r.xx
                a = a + a.T - np.diag(a.diagonal())
                df = r.n - k
                scale = np.sqrt(np.maximum(a.diagonal(), 1e-300))
                m = a / scale[:, None] / scale[None, :]
                if df <= 0 or np.linalg.cond(m) > 1e12:
                    out.append((r.snp_id, r.n, None, None, None, None))
                    continue
                inverse = np.linalg.inv(m) / scale[:, None] / scale[None, :]
                b = inverse @ np.array(r.xy)
                rss = max(r.yy - b @ np.array(r.xy), 0.0)
                se = float(np.sqrt(rss / df * inverse[-1, -1]))
                stat = b[-1] / se if se else np.nan
                out.append((r.snp_id, r.n, float(b[-1]), se, float(stat), stats.t_two_sided(stat, df)))
            yield pd.DataFrame(out, columns=["snp_id", "n", "effect", "se", "stat", "p"])

    return sums.mapInPandas(solve, "snp_id long, n long, effect double, se double, stat double, p double")


def logistic(gt: DataFrame, pheno: DataFrame, response: str, rounds: int = 25) -> DataFrame:
    """snp_id, n, effect, se, stat, p of a 0/1 response ~ dosage. A variant's likelihood depends on six counts only, which are all that is shuffled."""
    c = gt.where("dosage is not null").join(pheno.select("sample_id", F.col(response).alias("y")), "sample_id")
    counts = c.groupBy("snp_id").agg(F.array(*[F.count(F.when((F.col("dosage") == d) & (F.col("y") == y), 1)) for d in (0, 1, 2) for y in (0, 1)]).alias("n"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = np.stack([np.ones(3), np.arange(3)], axis=1)
        for t in batches:
            out = []
            for snp, n in zip(t.snp_id, t.n):
                n = np.array(n, dtype=float).reshape(3, 2)
                total, b = n.sum(axis=1), np.zeros(2)
                try:
                    for _ in range(rounds):
                        p = 1 / (1 + np.exp(-(x @ b).clip(-30, 30)))
                        info = (x * (total * p * (1 - p))[:, None]).T @ x
                        step = np.linalg.solve(info, x.T @ (n[:, 1] - total * p))
                        b = b + step
                        if np.abs(step).max() < 1e-10:
                            break
                    se = float(np.sqrt(np.linalg.inv(info)[1, 1]))
                    z = b[1] / se
                    out.append((snp, int(total.sum()), float(b[1]), se, float(z), stats.normal_two_sided(z)))
                except np.linalg.LinAlgError:
                    out.append((snp, int(total.sum()), None, None, None, None))
            yield pd.DataFrame(out, columns=["snp_id", "n", "effect", "se", "stat", "p"])

    return counts.mapInPandas(fit, "snp_id long, n long, effect double, se double, stat double, p double")


def allelic_test(gt: DataFrame, pheno: DataFrame, response: str) -> DataFrame:
    """snp_id, chisq: the 2 x 2 test of alleles by a 0/1 response."""
    c = gt.where("dosage is not null").join(pheno.select("sample_id", F.col(response).alias("y")), "sample_id")
    d = F.col("dosage").cast("double")
    a = c.groupBy("snp_id").agg(*[F.sum(F.when(F.col("y") == y, v).otherwise(0.0)).alias(n) for n, y, v in (("a", 1, d), ("b", 1, 2 - d), ("c", 0, d), ("e", 0, 2 - d))])
    n = F.col("a") + F.col("b") + F.col("c") + F.col("e")
    under = (F.col("a") + F.col("b")) * (F.col("c") + F.col("e")) * (F.col("a") + F.col("c")) * (F.col("b") + F.col("e"))
    cross = F.col("a") * F.col("e") - F.col("b") * F.col("c")
    return a.select("snp_id", F.when(under > 0, n * cross * cross / under).alias("chisq"))


def repair(results: DataFrame) -> DataFrame:
    """A missing p becomes 1, a missing or non-finite effect 0."""
    e = F.col("effect")
    bad = e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    return results.withColumns({"p": F.coalesce(F.nanvl("p", F.lit(1.0)), F.lit(1.0)), "effect": F.when(bad, 0.0).otherwise(e)})


def significant_counts(results: DataFrame, psig: float) -> DataFrame:
    """chromosome (null: all), n: variants with p below psig."""
    return results.rollup("chromosome").agg(F.sum(F.when(F.col("p") < psig, 1).otherwise(0)).cast("long").alias("n"))


def by_priority(results: DataFrame, order: list[str]) -> DataFrame:
    """snp_id, method, effect from the first method in `order` that has one."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("method"))
    return results.where((place > 0) & F.col("effect").isNotNull()).groupBy("snp_id").agg(F.min_by(F.struct("method", "effect"), place).alias("r")).select("snp_id", "r.*")
