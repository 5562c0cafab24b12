"""The whole chain of filters: basic ones, relatives, filling of gaps, outliers of robust components, and a log of each step."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import GenoDataset
from . import imputation, qc, relatedness


@dataclass(frozen=True)
class Chain:
    """Steps after the basic filters; None or False leaves one out."""

    kinship: float | None = 0.1
    ld: float | None = 0.2
    window: int = 500_000
    impute: bool = False
    outliers: float | None = None  # how many deviations about the median a robust distance may be
    components: int = 2


def settled(data: GenoDataset) -> GenoDataset:
    """The dataset with its plans cut where a checkpoint folder is set: each step of the chain reads its tables several times."""
    if not data.genotypes.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return data
    return replace(data, **{n: getattr(data, n).checkpoint() for n in ("genotypes", "variants", "samples")})


def pruned(data: GenoDataset, r2: float, window: int) -> DataFrame:
    """snp_id of variants left by linkage pruning in order of position."""
    ld = relatedness.ld_pairs(data.genotypes, data.variants, window)
    return relatedness.clump(ld, data.variants.withColumn("rank", F.col("position").cast("double")), r2).select("snp_id")


def robust_outliers(scores: DataFrame, columns: list[str], limit: float) -> DataFrame:
    """sample_id, distance of samples whose components lie further from the median than `limit`, in units of the scaled median absolute deviation of each (one row of medians)."""
    centre = scores.agg(*[F.percentile(c, F.lit(0.5)).alias(f"m_{c}") for c in columns])
    away = scores.join(F.broadcast(centre)).select("sample_id", *[F.abs(F.col(c) - F.col(f"m_{c}")).alias(c) for c in columns])
    spread = away.agg(*[(F.percentile(c, F.lit(0.5)) * 1.4826).alias(f"s_{c}") for c in columns])
    scaled = sum(((F.col(c) / F.greatest(F.col(f"s_{c}"), F.lit(1e-12))) ** 2 for c in columns), F.lit(0.0))
    return away.join(F.broadcast(spread)).select("sample_id", F.sqrt(scaled).alias("distance")).where(F.col("distance") > limit)


def cleaned(data: GenoDataset, filters: qc.Filters, chain: Chain) -> GenoDataset:
    """Basic filters, then both members of every pair of relatives, then gaps, then outliers; components of what is left are stored. The log has a row for each filter and step, with its threshold."""
    settings = {k: (float(v) if isinstance(v, int | float) else None) for k, v in vars(filters).items()}
    spark = data.genotypes.sparkSession
    out = settled(data.filtered(filters))
    limit = F.create_map(*[x for k, v in settings.items() if v is not None for x in (F.lit(k), F.lit(v))]) if any(v is not None for v in settings.values()) else F.expr("cast(map() as map<string,double>)")
    names = F.when(F.col("filter") == "heterozygosity", F.lit("hetero_fac")).when(F.col("filter") == "inbreeding", F.lit("inbreed")).otherwise(F.col("filter"))
    log = out.filter_log.select(F.lit("filters").alias("parameter"), F.col("filter").alias("name"), limit[names].alias("value"), "type", "filtered")
    step = lambda name, value, n: spark.createDataFrame([("chain", name, float(value), "sample", int(n))], "parameter string, name string, value double, type string, filtered long")
    if chain.kinship is not None:
        some = out.subset(pruned(out, chain.ld, chain.window)) if chain.ld is not None else out
        bad = relatedness.relatives(some.genotypes, qc.variant_summary(some.genotypes, out.samples.count()), chain.kinship)
        log = log.unionByName(step("kinship", chain.kinship, bad.count()))
        out = settled(out.subset(samples=out.samples.join(bad, "sample_id", "left_anti"), strict=False))
    if chain.impute:
        out = settled(replace(out, genotypes=imputation.impute_neighbours(out.genotypes)))
    if chain.outliers is not None:
        columns = [f"pc{i + 1}" for i in range(chain.components)]
        scores, _ = relatedness.sample_components(out.genotypes, chain.components)
        bad = robust_outliers(scores, columns, chain.outliers)
        n = bad.count()
        log = log.unionByName(step("outliers", chain.outliers, n))
        if n:
            out = settled(out.subset(samples=out.samples.join(bad, "sample_id", "left_anti"), strict=False))
            scores, _ = relatedness.sample_components(out.genotypes, chain.components)
        out = replace(out, components=scores)
    return replace(out, filter_log=log if data.filter_log is None or "parameter" not in data.filter_log.columns else data.filter_log.unionByName(log))


def component_covariates(data: GenoDataset, ld: float | None = 0.2, window: int = 500_000, p: float = 0.05, most: int = 10, count: int = 0) -> GenoDataset:
    """The dataset with as many components of its pruned variants as are significant by Tracy-Widom, or as `count` says."""
    some = data.subset(pruned(data, ld, window)) if ld is not None else data
    scores, tests = relatedness.sample_components(some.genotypes, most)
    n = min(count, most, len(tests)) if count else relatedness.components_needed(tests, p, min(most, len(tests)))
    return replace(data, components=scores.select("sample_id", *[f"pc{i + 1}" for i in range(n)]))
