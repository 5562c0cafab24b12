"""Quality control: summaries per variant and sample, failing sets, filtering and its log.

Genotypes are rows (sample_id, snp_id, dosage 0/1/2 or null); an absent row is a missing call like a null. All statistics use the unfiltered table.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

D = "double"


@dataclass(frozen=True)
class Filters:
    """Thresholds; None switches a filter off."""

    snp_call_rate: float | None = 0.98
    maf: float | None = 0.05
    hwe: float | None = 0.001
    sample_call_rate: float | None = 0.95
    hetero_stat: str | None = "mean"
    hetero_fac: float | None = 3.0
    hetero_hard: float | None = None
    inbreed: float | None = 0.1

    def __post_init__(self) -> None:
        for name in ("snp_call_rate", "maf", "hwe", "sample_call_rate"):
            v = getattr(self, name)
            if v is not None and not 0 <= v <= 1:
                raise ValueError(f"{name} must be within 0 and 1")
        if self.hetero_hard is not None and self.hetero_stat is not None:
            raise ValueError("hetero_hard excludes hetero_stat")
        if (self.hetero_stat is None) != (self.hetero_fac is None):
            raise ValueError("hetero_stat and hetero_fac go together")
        if self.hetero_stat not in (None, "mean", "median"):
            raise ValueError("hetero_stat is mean or median")


def variant_summary(gt: DataFrame, n_samples: Column | int) -> DataFrame:
    """snp_id, called, call_rate, maf, z_hwe. One shuffle on snp_id, combined on the map side."""
    g = gt.groupBy("snp_id").agg(F.count("dosage").alias("called"), F.sum(F.col("dosage").cast(D)).alias("alleles"), F.sum(F.when(F.col("dosage") == 1, 1.0).otherwise(0.0)).alias("het"))
    p = F.col("alleles") / (2 * F.col("called").cast(D))
    hwe = F.sqrt(F.col("called").cast(D)) * (1 - (F.col("het") / F.col("called").cast(D)) / (2 * F.col("p") * (1 - F.col("p"))))
    return g.withColumn("p", p).select(
        "snp_id", "called", (F.col("called").cast(D) / F.lit(n_samples).cast(D)).alias("call_rate"), F.least("p", 1 - F.col("p")).alias("maf"),
        F.when((F.col("p") > 0) & (F.col("p") < 1), hwe).alias("z_hwe"),
    )


def sample_summary(gt: DataFrame, n_snps: Column | int) -> DataFrame:
    """sample_id, called, call_rate, heterozygosity over called cells."""
    g = gt.groupBy("sample_id").agg(F.count("dosage").alias("called"), F.sum(F.when(F.col("dosage") == 1, 1.0).otherwise(0.0)).alias("het"))
    return g.select("sample_id", "called", (F.col("called").cast(D) / F.lit(n_snps).cast(D)).alias("call_rate"), F.when(F.col("called") > 0, F.col("het") / F.col("called").cast(D)).alias("heterozygosity"))


def inbreeding(gt: DataFrame, n_samples: int = 1) -> DataFrame:
    """sample_id, f: one minus observed over expected heterozygotes, expected from the frequencies of the sample's called variants."""
    v = variant_summary(gt, n_samples).select("snp_id", (2 * F.col("maf") * (1 - F.col("maf"))).alias("expected"))
    called = gt.where("dosage is not null").join(v, "snp_id")
    g = called.groupBy("sample_id").agg(F.sum(F.when(F.col("dosage") == 1, 1.0).otherwise(0.0)).alias("o"), F.sum("expected").alias("e"))
    return g.select("sample_id", (1 - F.col("o") / F.col("e")).alias("f"))


def heterozygosity_bounds(samples: DataFrame, stat: str, fac: float) -> DataFrame:
    """One row: low and high limits about the mean (by the standard deviation) or the median (by the interquartile range)."""
    h = F.col("heterozygosity")
    if stat == "mean":
        centre, spread = F.avg(h), F.stddev_samp(h)
    else:
        centre, spread = F.percentile(h, F.lit(0.5)), F.percentile(h, F.lit(0.75)) - F.percentile(h, F.lit(0.25))
    return samples.agg((centre - fac * spread).alias("low"), (centre + fac * spread).alias("high"))


def heterozygosity_outliers(samples: DataFrame, stat: str = "mean", fac: float = 3.0, low_tail_only: bool = False) -> DataFrame:
    """sample_id, heterozygosity of samples beyond the bounds. The bounds are one row by construction, so broadcasting them is safe at any size."""
    out = samples.join(F.broadcast(heterozygosity_bounds(samples, stat, fac)))
    h = F.col("heterozygosity")
    return out.where((h < F.col("low")) if low_tail_only else (h < F.col("low")) | (h > F.col("high"))).select("sample_id", "heterozygosity")


def variant_failures(summary: DataFrame, f: Filters) -> DataFrame:
    """snp_id, filter: a row for each filter that a variant fails; a statistic that is missing fails nothing."""
    tests = []
    if f.snp_call_rate is not None:
        tests.append(F.when(F.col("call_rate") < f.snp_call_rate, F.lit("snp_call_rate")))
    if f.maf is not None:
        tests.append(F.when(F.col("maf") < f.maf, F.lit("maf")))
    if f.hwe is not None:
        tests.append(F.when(F.abs("z_hwe") >= abs(NormalDist().inv_cdf(f.hwe / 2)), F.lit("hwe")))
    none = F.lit(None).cast("string")
    return summary.select("snp_id", F.explode(F.array_compact(F.array(none, *tests))).alias("filter"))


def sample_failures(summary: DataFrame, f: Filters, inbred: DataFrame | None = None) -> DataFrame:
    """sample_id, filter."""
    out = [summary.where("false").select("sample_id", F.lit("").alias("filter"))]
    if f.sample_call_rate is not None:
        out.append(summary.where(F.col("call_rate") < f.sample_call_rate).select("sample_id", F.lit("sample_call_rate").alias("filter")))
    if f.hetero_hard is not None:
        out.append(summary.where(F.col("heterozygosity") > f.hetero_hard).select("sample_id", F.lit("heterozygosity").alias("filter")))
    elif f.hetero_stat is not None:
        out.append(heterozygosity_outliers(summary, f.hetero_stat, f.hetero_fac).select("sample_id", F.lit("heterozygosity").alias("filter")))
    if f.inbreed is not None and inbred is not None:
        out.append(inbred.where(F.col("f") > f.inbreed).select("sample_id", F.lit("inbreeding").alias("filter")))
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def apply_filters(gt: DataFrame, bad_variants: DataFrame, bad_samples: DataFrame) -> DataFrame:
    """Genotypes of the variants and samples that fail nothing."""
    return gt.join(bad_variants.select("snp_id").distinct(), "snp_id", "left_anti").join(bad_samples.select("sample_id").distinct(), "sample_id", "left_anti")


def filter_log(bad_variants: DataFrame, bad_samples: DataFrame) -> DataFrame:
    """filter, type, filtered: how many each filter removes on its own."""
    v = bad_variants.groupBy("filter").agg(F.countDistinct("snp_id").alias("filtered")).withColumn("type", F.lit("snp"))
    s = bad_samples.groupBy("filter").agg(F.countDistinct("sample_id").alias("filtered")).withColumn("type", F.lit("sample"))
    return v.unionByName(s)
