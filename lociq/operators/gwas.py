"""Association by several methods in one call: checks, tests, combination of p-values, and storing under the model."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dataset import GenoDataset, ModelKey
from . import association, mixed, pvalues, recode

METHODS = ("glm", "allelic", "mixed")
NOT_THERE = ("whitlock", "pandora")


def named(pheno: DataFrame, which: str | int) -> str:
    """A column by name, or by number from 1 after the sample's id."""
    names = [c for c in pheno.columns if c != "sample_id"]
    if isinstance(which, int):
        if not 1 <= which <= len(names):
            raise KeyError(f"there is no phenotype {which}")
        return names[which - 1]
    if which not in names:
        raise KeyError(f"unknown phenotype {which}; there are {', '.join(names)}")
    return which


def checked(pheno: DataFrame, response: str | int, covariates: list[str | int] = ()) -> tuple[str, list[str]]:
    """Response and covariates by name; unknown names and a response among the covariates are errors."""
    y, xs = named(pheno, response), [named(pheno, c) for c in covariates]
    if y in xs or len(set(xs)) < len(xs):
        raise ValueError("the response may not be a covariate, and covariates may not repeat")
    return y, xs


def binary_levels(pheno: DataFrame, response: str) -> list:
    """The two values of a binary response, in order; [] for a numeric one; text of more than two values is an error."""
    got = recode.is_binary(pheno, response).first()
    if got["binary"]:
        return sorted(r[0] for r in pheno.select(response).where(F.col(response).isNotNull()).distinct().collect())  # two values
    if dict(pheno.dtypes)[response] == "string":
        raise ValueError(f"{response} has {got['levels']} values; a response is numeric or has two")
    return []


def combiner(name: str):
    if name in NOT_THERE:
        raise NotImplementedError(f"combining by {name}")
    if name not in pvalues.COMBINERS:
        raise ValueError(f"p-values are combined by {', '.join(pvalues.COMBINERS)}")
    return pvalues.COMBINERS[name]


def combine(results: DataFrame, how: str) -> DataFrame:
    """snp_id, method (the combination's name), effect (mean over methods), p."""
    f = combiner(how)
    g = results.groupBy("snp_id").agg(F.collect_list("p").alias("p"), F.avg("effect").alias("effect"))  # as many as there are methods
    return g.select("snp_id", F.lit(how).alias("method"), "effect", f("p").alias("p"))


def gwa(data: GenoDataset, response: str | int, covariates: list[str | int] = (), pcs: int = 0, methods: tuple[str, ...] = ("glm",), how: str | None = None, model: str = "additive") -> GenoDataset:
    """The dataset with results (snp_id, method, effect, p) of each method, and of their combination where `how` names one, stored under the model's key.

    A binary response is coded 0 and 1; the mixed model is then left out. Principal components come from data.components (sample_id, pc1, ...)."""
    if unknown := [m for m in methods if m not in METHODS]:
        raise ValueError(f"unknown methods {unknown}; there are {', '.join(METHODS)}")
    if how is not None:
        combiner(how)
    y, xs = checked(data.phenotypes, response, covariates)
    pheno, levels = data.phenotypes, binary_levels(data.phenotypes, y)
    if levels:
        pheno = pheno.withColumn(y, F.when(F.col(y).isNotNull(), (F.col(y) == F.lit(levels[-1])).cast("int")))
    if pcs:
        if data.components is None or any(f"pc{i + 1}" not in data.components.columns for i in range(pcs)):
            raise ValueError(f"the dataset does not hold {pcs} principal components")
        pheno = pheno.join(data.components.select("sample_id", *[f"pc{i + 1}" for i in range(pcs)]), "sample_id")
        xs = [*xs, *(f"pc{i + 1}" for i in range(pcs))]
    found: list[DataFrame] = []
    for m in methods:
        if m == "glm":
            r = (mixed.logistic(data.genotypes, pheno, y, xs, model) if xs or model != "additive" else association.logistic(data.genotypes, pheno, y)) if levels else association.linear_adjusted(data.genotypes, pheno, y, xs, model)
        elif m == "allelic":
            if not levels:
                raise ValueError("the allelic test needs a binary response")
            r = association.allelic_test(data.genotypes, pheno, y).select("snp_id", F.lit(0.0).alias("effect"), _chi_tail(F.col("chisq")).alias("p"))
        elif levels:
            continue
        else:
            r = mixed.mixed(data.genotypes, pheno, y, xs)
        found.append(association.repair(r).select("snp_id", F.lit(m).alias("method"), "effect", "p"))
    if not found:
        raise ValueError("no method is left for a binary response")
    out = found[0]
    for r in found[1:]:
        out = out.unionByName(r)
    if how is not None:
        out = out.unionByName(combine(out, how))
    return replace(data, phenotypes=data.phenotypes).store(ModelKey(y, tuple(x for x in xs if not x.startswith("pc")), pcs), out)


def _chi_tail(x: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    from collections.abc import Iterator

    import pandas as pd

    from ..functions import stats

    def tail(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield v.map(lambda a: None if a is None or a != a else stats.chi2_upper(a, 1))

    tail.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(tail, "double")(x)
