"""Polygenic scores: sums of dosages by weights, coverage, nested prefixes, and completion of score files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def score(gt: DataFrame, weights: DataFrame, kind: str = "sum", n_weights: int | None = None) -> DataFrame:
    """sample_id, score. sum of dosage * weight over called cells; avg divides by the number of weights; std standardises over samples."""
    if kind not in ("sum", "avg", "std"):
        raise ValueError("kind is sum, avg or std")
    raw = gt.where("dosage is not null").join(weights, "snp_id").groupBy("sample_id").agg(F.sum(F.col("dosage").cast("double") * F.col("weight")).alias("score"))
    if kind == "avg":
        n = F.lit(float(n_weights)) if n_weights else F.col("n")
        return (raw if n_weights else raw.join(F.broadcast(weights.agg(F.count(F.lit(1)).cast("double").alias("n"))))).select("sample_id", (F.col("score") / n).alias("score"))
    if kind == "std":
        one = raw.agg(F.avg("score").alias("m"), F.stddev_samp("score").alias("s"))  # one row
        return raw.join(F.broadcast(one)).select("sample_id", ((F.col("score") - F.col("m")) / F.col("s")).alias("score"))
    return raw


def coverage(weights: DataFrame, variants: DataFrame) -> DataFrame:
    """One row: n_weights, n_covered, n_missing."""
    marked = weights.select("snp_id").distinct().join(variants.select("snp_id", F.lit(1).alias("hit")).distinct(), "snp_id", "left")
    return marked.agg(F.count(F.lit(1)).alias("n_weights"), F.count("hit").alias("n_covered"), (F.count(F.lit(1)) - F.count("hit")).alias("n_missing"))


def prefix_scores(gt: DataFrame, ranked: DataFrame, step: int, total: int) -> DataFrame:
    """sample_id, n_snp, score for nested sets: the first step, 2 * step, ... variants of `ranked` (snp_id, weight, rank from 1), and all `total`.

    Each cell adds to the group of its own step; a running sum over the few groups of a sample makes the prefixes, so cells are never multiplied."""
    last = -(-total // step)
    cells = gt.where("dosage is not null").join(ranked, "snp_id")
    part = cells.groupBy("sample_id", F.ceil(F.col("rank") / step).cast("long").alias("k")).agg(F.sum(F.col("dosage").cast("double") * F.col("weight")).alias("s"))
    grid = part.select("sample_id").distinct().select("sample_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(last).cast("long"))).alias("k"))
    w = Window.partitionBy("sample_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(part, ["sample_id", "k"], "left").withColumn("score", F.sum(F.coalesce("s", F.lit(0.0))).over(w))
    return full.select("sample_id", F.least(F.col("k") * step, F.lit(total)).cast("long").alias("n_snp"), "score")


def complete_scores(files: DataFrame) -> DataFrame:
    """Weight and odds ratio from each other: weight = ln(OR), OR = exp(weight); with neither, weight 1 and OR 0. An unknown reference allele is N."""
    w, o = F.col("effect_weight"), F.col("OR")
    return files.withColumns({
        "effect_weight": F.when(w.isNotNull(), w).when(o.isNotNull(), F.log(o)).otherwise(1.0),
        "OR": F.when(o.isNotNull(), o).when(w.isNotNull(), F.exp(w)).otherwise(0.0),
        "reference_allele": F.coalesce("reference_allele", F.lit("N")),
    })


def first_of_each(files: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return files.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def assembly_code(name: str):
    """hg19, hg38 or nr from an assembly's text."""
    c = F.lower(F.col(name))
    return F.when(c.rlike("grch37|hg19|hg37"), "hg19").when(c.rlike("grch38|hg38"), "hg38").otherwise("nr")


def id_kind(name: str):
    """Which catalogue an id belongs to: efo (EFO_ and digits), pgs (PGS and six digits), pubmed (up to eight digits) or none."""
    c = F.col(name)
    return F.when(c.rlike("^EFO_[0-9]+$"), "efo").when(c.rlike("^PGS[0-9]{6}$"), "pgs").when(c.rlike("^[0-9]{1,8}$"), "pubmed").otherwise("none")


def threshold_scores(gt: DataFrame, weights: DataFrame, p: DataFrame, thresholds: list[float]) -> DataFrame:
    """sample_id, threshold, score over variants with p within each threshold. A variant adds to the least threshold that admits it; a running sum over
    a sample's few thresholds does the rest."""
    cuts = sorted(thresholds)
    least = F.coalesce(*[F.when(F.col("p") <= t, F.lit(t)) for t in cuts])
    rated = weights.join(p, "snp_id").withColumn("threshold", least).where("threshold is not null").select("snp_id", "weight", "threshold")
    part = gt.where("dosage is not null").join(rated, "snp_id").groupBy("sample_id", "threshold").agg(F.sum(F.col("dosage").cast("double") * F.col("weight")).alias("s"))
    grid = part.select("sample_id").distinct().select("sample_id", F.explode(F.array(*map(F.lit, cuts))).alias("threshold"))
    w = Window.partitionBy("sample_id").orderBy("threshold").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(part, ["sample_id", "threshold"], "left").select("sample_id", "threshold", F.sum(F.coalesce("s", F.lit(0.0))).over(w).alias("score"))


def zero_filled(variants: DataFrame, betas: DataFrame) -> DataFrame:
    """snp_id, method, beta for every variant and method of `betas` (snp_id, method, beta); 0 where a method has none. Methods are a handful and bounded by their names."""
    grid = variants.select("snp_id").distinct().crossJoin(F.broadcast(betas.select("method").distinct()))
    return grid.join(betas, ["snp_id", "method"], "left").select("snp_id", "method", F.coalesce("beta", F.lit(0.0)).alias("beta"))


def extracted(p: DataFrame, effects: DataFrame, threshold: float) -> DataFrame:
    """snp_id, p, effect of variants with p within the threshold; of several methods' effects that of the first in `priority` counts."""
    first = effects.groupBy("snp_id").agg(F.min_by("effect", "priority").alias("effect"))
    return p.where(F.col("p") <= threshold).join(first, "snp_id").select("snp_id", "p", "effect")


def base_file(variants: DataFrame, effects: DataFrame, p: DataFrame, samples: int | DataFrame) -> DataFrame:
    """Columns CHR, BP, SNP, A1, A2, BETA, P, MAF (0.5), INFO (1) and N, as scoring programs read them. `samples` is their number or a one-row table with column n."""
    out = variants.join(effects.select("snp_id", "effect"), "snp_id").join(p.select("snp_id", "p"), "snp_id")
    out = out.withColumn("n", F.lit(samples)) if isinstance(samples, int) else out.join(F.broadcast(samples))
    return out.select(F.col("chromosome").alias("CHR"), F.col("position").alias("BP"), F.col("snp_id").alias("SNP"), F.col("allele_a").alias("A1"), F.col("allele_b").alias("A2"), F.col("effect").alias("BETA"), F.col("p").alias("P"), F.lit(0.5).alias("MAF"), F.lit(1.0).alias("INFO"), F.col("n").cast("long").alias("N"))


def score_file(chosen: DataFrame, variants: DataFrame, assembly: str) -> DataFrame:
    """Chosen markers (snp_id, effect, freq) as rows of a published score: place, alleles, weight, odds ratio, assembly and frequency."""
    return chosen.join(variants, "snp_id").select(
        F.col("chromosome").cast("string").alias("chromosome"), "position", F.col("snp_id").alias("variant_id"), F.col("allele_b").alias("risk_allele"), F.col("allele_a").alias("reference_allele"),
        F.lit(None).cast("string").alias("locus_name"), F.col("effect").alias("effect_weight"), F.exp("effect").alias("OR"), F.lit(assembly).alias("asm"), "freq",
    )
