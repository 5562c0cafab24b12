"""Scores of samples as their genotypes arrive: an extra beyond batch scoring, over a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_scores(genotypes: DataFrame, weights: DataFrame) -> DataFrame:
    """sample_id, score over everything seen so far of a stream of (sample_id, snp_id, dosage); write it in update mode. State is one sum for each sample."""
    return genotypes.where("dosage is not null").join(weights, "snp_id").groupBy("sample_id").agg(F.sum(F.col("dosage").cast("double") * F.col("weight")).alias("score"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """window_start, event_type, n: tumbling counts; rows later than the watermark are dropped and their windows' state with them."""
    g = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n")
