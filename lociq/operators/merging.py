"""Merging two cohorts: comparing alleles, resolving strand flips and swaps, and joining their genotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complement(allele: str) -> Column:
    return F.translate(allele, "ACGT", "TGCA")


def compare(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """snp_id, both cohorts' alleles and places, and `state`: same, flip (strand), swap (alleles), flip_swap, ambiguous (A/T or C/G) or bad."""
    j = v1.select("snp_id", "chromosome", "position", F.col("allele_a").alias("a1"), F.col("allele_b").alias("b1")).join(
        v2.select("snp_id", F.col("chromosome").alias("chromosome2"), F.col("position").alias("position2"), F.col("allele_a").alias("a2"), F.col("allele_b").alias("b2")), "snp_id")
    same = (F.col("a1") == F.col("a2")) & (F.col("b1") == F.col("b2"))
    swap = (F.col("a1") == F.col("b2")) & (F.col("b1") == F.col("a2"))
    flip = (F.col("a1") == complement("a2")) & (F.col("b1") == complement("b2"))
    both = (F.col("a1") == complement("b2")) & (F.col("b1") == complement("a2"))
    state = F.when(same, "same").when(flip & swap, "ambiguous").when(flip, "flip").when(swap, "swap").when(both, "flip_swap").otherwise("bad")
    return j.withColumn("state", state)


def merge(g1: DataFrame, g2: DataFrame, compared: DataFrame, how: str = "common") -> DataFrame:
    """cohort, sample_id, snp_id, dosage. common keeps variants of both whose alleles and places can be reconciled; all keeps every variant but the irreconcilable.

    Dosages of the second cohort are reversed where alleles are swapped. Cells that a cohort has no variant for stay absent, which means missing."""
    bad = (F.col("state") == "bad") | (F.col("chromosome") != F.col("chromosome2")) | (F.col("position") != F.col("position2"))
    judged = compared.select("snp_id", bad.alias("bad"), F.col("state").isin("swap", "flip_swap", "ambiguous").alias("turn"))
    one, two = g1.withColumn("cohort", F.lit(1)), g2.withColumn("cohort", F.lit(2))
    turned = lambda d: F.when(F.coalesce(F.col("turn"), F.lit(False)), 2 - F.col(d)).otherwise(F.col(d)).cast("int")
    kind = "inner" if how == "common" else "left"
    keep = judged if how != "common" else judged.where(~F.col("bad"))
    a = one.join(keep, "snp_id", kind).where(~F.coalesce(F.col("bad"), F.lit(False))).select("cohort", "sample_id", "snp_id", F.col("dosage").cast("int").alias("dosage"))
    b = two.join(keep, "snp_id", kind).where(~F.coalesce(F.col("bad"), F.lit(False))).select("cohort", "sample_id", "snp_id", turned("dosage").alias("dosage"))
    return a.unionByName(b)


def votes(compared: DataFrame, by: str) -> DataFrame:
    """by, turned, n, majority: how many reconcilable variants are swapped between the cohorts, and whether most are."""
    turned = F.col("state").isin("swap", "flip_swap", "ambiguous")
    g = compared.where("state <> 'bad'").groupBy(by).agg(F.sum(turned.cast("long")).alias("turned"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("majority", F.col("turned") * 2 > F.col("n"))


def reconciled(compared: DataFrame, places: DataFrame) -> DataFrame:
    """Reconcilable variants with one place each: the cohorts' own where they agree, that of `places` (snp_id, chromosome, position) where they do not (null if it has none)."""
    p = places.select("snp_id", F.col("chromosome").alias("_c"), F.col("position").alias("_p"))
    j = compared.where("state <> 'bad'").join(p, "snp_id", "left")
    return j.withColumns({"chromosome": F.when(F.col("chromosome") == F.col("chromosome2"), F.col("chromosome")).otherwise(F.col("_c")), "position": F.when(F.col("position") == F.col("position2"), F.col("position")).otherwise(F.col("_p"))}).drop("_c", "_p")
