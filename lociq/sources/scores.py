"""Score files: tab-separated text with # comments and a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import complete_scores

# The columns of public score files, with their types.
COLUMNS = {"rsID": "string", "chr_name": "string", "chr_position": "long", "effect_allele": "string", "reference_allele": "string", "effect_weight": "double", "OR": "double", "locus_name": "string"}


def read(spark: SparkSession, path: str) -> DataFrame:
    """A score file with all columns, absent ones null, weights and odds ratios completed. An id or a place, and the effect allele, must be there."""
    raw = spark.read.option("sep", "\t").option("comment", "#").option("header", True).csv(path)
    if "effect_allele" not in raw.columns or not ({"rsID"} <= set(raw.columns) or {"chr_name", "chr_position"} <= set(raw.columns)):
        raise ValueError("a score file needs effect_allele and rsID or chr_name with chr_position")
    full = raw.select(*[(F.col(c).cast(t) if c in raw.columns else F.lit(None).cast(t)).alias(c) for c, t in COLUMNS.items()])
    named = F.concat_ws("_", "chr_name", F.col("chr_position").cast("string"), F.coalesce("reference_allele", F.lit("N")), "effect_allele")
    return complete_scores(full).withColumn("rsID", F.coalesce("rsID", named))
