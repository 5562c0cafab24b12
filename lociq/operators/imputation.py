"""Filling missing calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def variant_distance(gt: DataFrame) -> DataFrame:
    """snp1, snp2, distance: share of differing calls over samples that have both called."""
    g = gt.where("dosage is not null")
    a, b = (g.select("sample_id", F.col("snp_id").alias(s), F.col("dosage").alias(d)) for s, d in (("snp1", "d1"), ("snp2", "d2")))
    return a.join(b, "sample_id").where("snp1 <> snp2").groupBy("snp1", "snp2").agg(F.avg((F.col("d1") != F.col("d2")).cast("double")).alias("distance"))


def mode(gt: DataFrame) -> DataFrame:
    """snp_id, dosage: the commonest call; ties go to the smaller one."""
    g = gt.where("dosage is not null").groupBy("snp_id", "dosage").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("snp_id").agg(F.max_by("dosage", F.struct("n", -F.col("dosage"))).alias("dosage"))


def impute_mode(gt: DataFrame) -> DataFrame:
    """Genotypes with null calls replaced by the variant's commonest."""
    return gt.join(mode(gt).withColumnRenamed("dosage", "fill"), "snp_id", "left").select("sample_id", "snp_id", F.coalesce("dosage", "fill").alias("dosage"))


def impute_neighbours(gt: DataFrame, k: int = 5) -> DataFrame:
    """Null calls by the k nearest variants: the call with the largest sum of inverse distances in the same sample (ties: the smaller); the commonest where no neighbour has one."""
    near = variant_distance(gt)
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("snp1").orderBy("distance", "snp2"))).where(F.col("n") <= k)
    gaps = gt.where("dosage is null").select("sample_id", F.col("snp_id").alias("snp1"))
    votes = gaps.join(near, "snp1").join(gt.where("dosage is not null").select("sample_id", F.col("snp_id").alias("snp2"), "dosage"), ["sample_id", "snp2"])
    votes = votes.groupBy("sample_id", "snp1", "dosage").agg(F.sum(1 / F.greatest("distance", F.lit(1e-8))).alias("w"))
    best = votes.groupBy("sample_id", "snp1").agg(F.max_by("dosage", F.struct("w", -F.col("dosage"))).alias("guess")).withColumnRenamed("snp1", "snp_id")
    return gt.join(best, ["sample_id", "snp_id"], "left").join(mode(gt).withColumnRenamed("dosage", "fill"), "snp_id", "left").select("sample_id", "snp_id", F.coalesce("dosage", "guess", "fill").alias("dosage"))


def rules(gt: DataFrame, ld: DataFrame, least: float = 0.0) -> DataFrame:
    """snp_id, neighbour, given, fill: for each variant its neighbour of highest r2 (ties: the smaller id), and the rounded mean call where the neighbour's call is `given`."""
    both = ld.where(F.col("r2") >= least)
    both = both.select(F.col("snp1").alias("snp_id"), F.col("snp2").alias("neighbour"), "r2").unionByName(both.select(F.col("snp2").alias("snp_id"), F.col("snp1").alias("neighbour"), "r2"))
    best = both.groupBy("snp_id").agg(F.max_by("neighbour", F.struct("r2", -F.col("neighbour"))).alias("neighbour"))
    g = gt.where("dosage is not null")
    pairs = g.join(best, "snp_id").join(g.select("sample_id", F.col("snp_id").alias("neighbour"), F.col("dosage").alias("given")), ["sample_id", "neighbour"])
    return pairs.groupBy("snp_id", "neighbour", "given").agg(F.floor(F.avg("dosage") + 0.5).cast("int").alias("fill"))


def impute_rules(gt: DataFrame, ld: DataFrame, least: float = 0.0) -> DataFrame:
    """One round: null calls by the rule for the neighbour's call in the same sample; those whose neighbour is missing, too, stay null."""
    r = rules(gt, ld, least)
    gaps = gt.where("dosage is null").select("sample_id", "snp_id").join(r.select("snp_id", "neighbour").distinct(), "snp_id")
    known = gaps.join(gt.where("dosage is not null").select("sample_id", F.col("snp_id").alias("neighbour"), F.col("dosage").alias("given")), ["sample_id", "neighbour"])
    guess = known.join(r, ["snp_id", "neighbour", "given"]).select("sample_id", "snp_id", F.col("fill").alias("guess"))
    return gt.join(guess, ["sample_id", "snp_id"], "left").select("sample_id", "snp_id", F.coalesce("dosage", "guess").alias("dosage"))


def impute_until_settled(gt: DataFrame, ld, least: float = 0.0, rounds: int = 10) -> DataFrame:
    """impute_rules() repeated while it fills anything; `ld` makes linkage from genotypes. Each round is checkpointed, so the plan does not grow and lost executors cost one round."""
    missing = gt.where("dosage is null").count()
    for _ in range(rounds):
        gt = impute_rules(gt, ld(gt), least).checkpoint()
        now = gt.where("dosage is null").count()
        if now in (0, missing):
            break
        missing = now
    return gt


def by_chromosome(gt: DataFrame, variants: DataFrame) -> DataFrame:
    """snp1, snp2, distance of variants on one chromosome: what neighbours are chosen from where places are known."""
    g = gt.where("dosage is not null").join(variants.select("snp_id", "chromosome"), "snp_id")
    a, b = (g.select("sample_id", "chromosome", F.col("snp_id").alias(s), F.col("dosage").alias(d)) for s, d in (("snp1", "d1"), ("snp2", "d2")))
    return a.join(b, ["sample_id", "chromosome"]).where("snp1 <> snp2").groupBy("snp1", "snp2").agg(F.avg((F.col("d1") != F.col("d2")).cast("double")).alias("distance"))
