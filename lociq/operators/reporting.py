"""Applying a score to a cohort, and the tables that plots and reports are drawn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluation, resampling, scoring


def apply_score(gt: DataFrame, variants: DataFrame, pheno: DataFrame, weights: DataFrame, response: str, covariate: str, least: int = 1, times: int = 20) -> dict[str, DataFrame]:
    """Tables of a score on a cohort: coverage, metrics, scores of each sample, r2 of random sets of as many variants, and the bootstrap p. Too few covered markers are an error."""
    cover = scoring.coverage(weights, variants)
    covered = cover.first()["n_covered"]
    if covered < least:
        raise ValueError(f"the cohort covers {covered} markers, fewer than {least}")
    scores = scoring.score(gt, weights)
    cells = gt.where("dosage is not null").join(weights, "snp_id").select("sample_id", "snp_id", (F.col("dosage").cast("double") * F.col("weight")).alias("add"))
    random = cells.join(resampling.random_sets(weights.join(variants.select("snp_id"), "snp_id", "left_semi"), times, max(1, covered // 2)), "snp_id").groupBy("rep", "sample_id").agg(F.sum("add").alias("score"))
    null = evaluation.score_r2(random, pheno, ["rep"], response)
    seen = evaluation.score_r2(scores.withColumn("rep", F.lit(0)), pheno, ["rep"], response)
    metrics = evaluation.nested_r2(scores.join(pheno, "sample_id").withColumn("n_snp", F.lit(covered)), ["n_snp"], response, covariate, "score")
    return {"coverage": cover, "metrics": metrics, "scores": scores, "random": null, "bootstrap": evaluation.bootstrap_p(null, seen)}


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (0: below, bins + 1: from `high` on), n."""
    return rows.where(F.col(value).isNotNull()).groupBy(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, and the five numbers of a box."""
    return rows.groupBy(by).agg(F.count(value).alias("n"), *[F.percentile(value, F.lit(q)).alias(f"q{int(100 * q)}") for q in (0.0, 0.25, 0.5, 0.75, 1.0)])


def mean_and_sd(rows: DataFrame, by: str, values: list[str]) -> DataFrame:
    """by, and for each metric "mean ± sd" as text."""
    return rows.groupBy(by).agg(*[F.format_string("%.2f ± %.2f", F.avg(v), F.stddev_samp(v)).alias(v) for v in values])


def wrong_places(claimed: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (snp_id, asm, chromosome, position) that no known place of their assembly confirms."""
    return claimed.join(known.select("snp_id", "asm", "chromosome", "position"), ["snp_id", "asm", "chromosome", "position"], "left_anti")


def guessed_assembly(variants: DataFrame, known: DataFrame) -> DataFrame:
    """asm, hits, share of variants whose place is that of the assembly, most first."""
    n = variants.select("snp_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    g = variants.join(known, ["snp_id", "chromosome", "position"]).groupBy("asm").agg(F.countDistinct("snp_id").alias("hits"))
    return g.join(F.broadcast(n)).select("asm", "hits", (F.col("hits") / F.col("n")).alias("share")).orderBy(F.col("hits").desc(), "asm")


def catalogued(associations: list[DataFrame], places: DataFrame) -> DataFrame:
    """Distinct associations of several answers (snp_id, trait, risk_allele) with their places; rows without a risk allele or a place go."""
    every = evaluation.union_all(associations).where("risk_allele is not null and risk_allele <> '?'").distinct()
    return every.join(places.select("snp_id", "chromosome", "position"), "snp_id", "left").where("chromosome is not null")
