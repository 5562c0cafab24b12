"""Iterations as a column: splits, random sets, marker frequencies and effects over resamples.

Draws come from modular arithmetic on ids, so that a run can be repeated, and lost partitions recomputed, with the same outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIME = 1_000_003


def draw(key: Column, iteration: Column) -> Column:
    """A pseudo-random number below PRIME for each key and iteration; keys may be negative."""
    a = F.pmod(key * 7919 + iteration * 104729 + 12345, F.lit(PRIME))
    return F.pmod(a * a * 31 + a * 17 + iteration * 613, F.lit(PRIME))


def split(samples: DataFrame, iterations: int, fraction: float) -> DataFrame:
    """iteration, sample_id, part (train or test): exactly ceil(N * fraction) samples are drawn for each iteration."""
    grid = samples.select("sample_id").select("sample_id", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("iteration"))
    grid = grid.withColumn("r", draw(F.col("sample_id"), F.col("iteration").cast("long")))
    w = Window.partitionBy("iteration").orderBy("r", "sample_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("iteration"))
    return grid.select("iteration", "sample_id", F.when(F.row_number().over(w) <= F.ceil(n * fraction), "train").otherwise("test").alias("part"))


def random_sets(variants: DataFrame, times: int, size: int) -> DataFrame:
    """rep, snp_id: `times` sets of `size` variants drawn without replacement."""
    grid = variants.select("snp_id", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("rep")).withColumn("r", draw(F.col("snp_id"), F.col("rep").cast("long")))
    return grid.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("r", "snp_id"))).where(F.col("n") <= size).select("rep", "snp_id")


def set_scores(gt: DataFrame, sets: DataFrame, reps: list[int]) -> DataFrame:
    """rep, sample_id, score of called cells in each of `reps` sets (rep, snp_id, weight); sets as short as these are sent to all tasks.

    A cell is shuffled once by its sample, not once for each set, and a sample has all its sums in one row until the end."""
    by_variant = sets.groupBy("snp_id").agg(*[F.sum(F.when(F.col("rep") == r, F.col("weight"))).alias(f"w{r}") for r in reps])
    cells = gt.where("dosage is not null").join(F.broadcast(by_variant), "snp_id").repartition("sample_id")
    sums = cells.groupBy("sample_id").agg(*[F.sum(F.col("dosage").cast("double") * F.col(f"w{r}")).alias(f"s{r}") for r in reps])
    return sums.select("sample_id", F.explode(F.array(*[F.struct(F.lit(r).alias("rep"), F.col(f"s{r}").alias("score")) for r in reps])).alias("x")).select("x.rep", "sample_id", "x.score").where("score is not null")


def marker_sets(picks: DataFrame, mode: str, methods: int) -> DataFrame:
    """iteration, snp_id: variants with a non-zero beta in any method (union) or in all (intersect)."""
    g = picks.where("beta <> 0").groupBy("iteration", "snp_id").agg(F.countDistinct("method").alias("m"))
    return g.where(F.col("m") >= (methods if mode == "intersect" else 1)).select("iteration", "snp_id")


def marker_frequencies(picks: DataFrame, mode: str, methods: int, qcut: float = 0.0) -> DataFrame:
    """snp_id, freq: how many iterations chose a variant; kept from the floor of the frequencies' quantile `qcut`."""
    f = marker_sets(picks, mode, methods).groupBy("snp_id").agg(F.count(F.lit(1)).alias("freq"))
    cut = f.agg(F.floor(F.percentile("freq", F.lit(qcut))).alias("cut"))  # one row
    return f.join(F.broadcast(cut)).where("freq >= cut").select("snp_id", "freq")


def effects(sets: DataFrame, betas: DataFrame, iterations: DataFrame, how: str, r2: DataFrame | None = None) -> DataFrame:
    """snp_id, effect over all iterations, of variants in `sets`; an iteration without the variant counts as 0.

    Absent cells are never made: zeros leave sums alone, so the mean divides by the number of iterations; the median pads its sorted list."""
    n = iterations.agg(F.count(F.lit(1)).alias("n"))  # one row
    chosen = sets.select("snp_id").distinct().join(betas, "snp_id")
    if how == "mean":
        return chosen.groupBy("snp_id").agg(F.sum("beta").alias("s")).join(F.broadcast(n)).select("snp_id", (F.col("s") / F.col("n")).alias("effect"))
    if how == "median":
        g = chosen.groupBy("snp_id").agg(F.collect_list("beta").alias("b")).join(F.broadcast(n))
        full = F.array_sort(F.concat("b", F.array_repeat(F.lit(0.0), (F.col("n") - F.size("b")).cast("int"))))
        lo, hi = F.floor((F.col("n") + 1) / 2).cast("int"), F.ceil((F.col("n") + 1) / 2).cast("int")
        return g.withColumn("full", full).select("snp_id", ((F.element_at("full", lo) + F.element_at("full", hi)) / 2).alias("effect"))
    if how == "weighted":
        w = r2.select("iteration", (1 / (1 - F.col("r2"))).alias("u"))
        total = w.agg(F.sum("u").alias("t"))
        share = w.join(F.broadcast(total)).select("iteration", (F.col("u") / F.col("t")).alias("w"))
        return chosen.join(share, "iteration").groupBy("snp_id").agg(F.sum(F.col("beta") * F.col("w")).alias("effect"))
    raise ValueError("how is mean, median or weighted")


def cut_offs(frequencies: DataFrame, min_snps: int) -> DataFrame:
    """cut, n_snp: distinct frequencies and the size of their sets, while these exceed `min_snps`."""
    g = frequencies.groupBy(F.col("freq").alias("cut")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.col("cut").desc())  # as many rows as there are iterations, not as there are variants
    return g.withColumn("n_snp", F.sum("n").over(w)).where(F.col("n_snp") > min_snps).select("cut", "n_snp")


def simulate(samples: DataFrame, n_variants: int, frequencies: list[float]) -> DataFrame:
    """sample_id, snp_id, dosage: two independent draws against the variant's allele frequency, which goes round `frequencies`."""
    grid = samples.select("sample_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_variants - 1).cast("long"))).alias("snp_id"))
    f = F.element_at(F.array(*map(F.lit, frequencies)), (F.col("snp_id") % len(frequencies) + 1).cast("int"))
    hit = lambda k: (draw(F.col("sample_id"), F.col("snp_id") * 2 + k).cast("double") / float(PRIME) < f).cast("int")
    return grid.select("sample_id", "snp_id", (hit(0) + hit(1)).alias("dosage"))


def with_replacement(samples: DataFrame, iterations: int, size: int, n: int) -> DataFrame:
    """iteration, draw, sample_id: `size` draws of each iteration, a sample as often as it comes up. `samples` (sample_id, rank from 1 to n)."""
    drawn = samples.sparkSession.range(1, iterations + 1).select(F.col("id").alias("iteration")).select("iteration", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(size).cast("long"))).alias("draw"))
    return drawn.withColumn("rank", draw(F.col("draw"), F.col("iteration")) % n + 1).join(samples, "rank").select("iteration", "draw", "sample_id")


def grid_splits(samples: DataFrame, leave_outs: list[float], times: int) -> DataFrame:
    """leave_out, rep, sample_id, part for every leave-out share and repetition, all in one table; ceil(N * (1 - leave_out)) samples train."""
    grid = samples.select("sample_id", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("rep")).withColumn("r", draw(F.col("sample_id"), F.col("rep").cast("long")))
    w = Window.partitionBy("rep").orderBy("r", "sample_id")
    grid = grid.withColumn("k", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("rep")))  # one sort serves every share
    grid = grid.withColumn("leave_out", F.explode(F.array(*map(F.lit, leave_outs))))
    return grid.select("leave_out", "rep", "sample_id", F.when(F.col("k") <= F.ceil(F.col("n") * (1 - F.col("leave_out"))), "train").otherwise("test").alias("part"))


def baseline_subset(baseline: DataFrame, by: list[str], key: str, size: int) -> DataFrame:
    """At most `size` rows of the baseline for each `by`, drawn by `key`; shorter baselines stay whole."""
    w = Window.partitionBy(*by).orderBy(draw(F.col(key), F.lit(1).cast("long")), key)
    return baseline.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= size).drop("_n")


def frequent(frequencies: DataFrame, least: int) -> DataFrame:
    """Markers that at least `least` iterations have picked."""
    return frequencies.where(F.col("freq") >= least)
