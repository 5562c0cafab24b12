"""Points and intervals: overlaps, liftover by chain blocks, tiles. Range conditions become equality on bins, so no join is a product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BIN = 1000


def overlaps(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, how: str = "inner", size: int = BIN, by: str = "chromosome") -> DataFrame:
    """Points with every interval of their own `by` that holds them (ends inclusive). An interval is copied to each bin that it touches: choose `size` near the usual length."""
    p = points.withColumn("_bin", F.floor(F.col(at) / size))
    s = spans.withColumnRenamed(by, "_by").withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / size), F.floor(F.col(end) / size))))
    on = (p["_bin"] == s["_bin"]) & (p[by] == s["_by"]) & (p[at] >= s[start]) & (p[at] <= s[end])
    return p.join(s, on, how).drop("_bin", "_by")


def lift(points: DataFrame, chain: DataFrame, at: str = "position") -> DataFrame:
    """snp_id, lifted: the place in the target assembly; unmapped points are dropped, of several blocks the first counts, and a block that leads to another chromosome gives 0.

    chain: block, chromosome, from_start, from_end, to_chromosome, to_start."""
    m = overlaps(points, chain, at, "from_start", "from_end", size=2000)
    place = F.when(F.col("to_chromosome") == F.col("chromosome"), F.col(at) - F.col("from_start") + F.col("to_start")).otherwise(F.lit(0))
    return m.groupBy("snp_id").agg(F.min_by(place, "block").alias("lifted"))


def tiles(variants: DataFrame, width: int) -> DataFrame:
    """snp_id, chromosome, tile: equal tiles of each chromosome's span from its least position."""
    span = variants.groupBy("chromosome").agg(F.min("position").alias("lo"))
    return variants.join(span, "chromosome").select("snp_id", "chromosome", F.floor((F.col("position") - F.col("lo")) / width).alias("tile"))
