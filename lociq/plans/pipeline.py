"""The whole analysis: quality control, repeated association on splits, candidate sets by frequency, their evaluation and choice.

Iterations are a column, so all repetitions of a step run in one job. Each step's table is written under the workspace and a rerun reads what is there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import GenoDataset
from ..operators import association, evaluation, ranking, resampling, scoring
from ..operators.qc import Filters


@dataclass(frozen=True)
class Plan:
    """Settings of a run."""

    response: str
    covariate: str
    iterations: int = 10
    fraction: float = 0.8
    psig: float = 0.05
    step: int = 10
    min_snps: int = 2
    filters: Filters = Filters()


class Workspace:
    """Tables kept by name, with resume: a step whose table is complete is not run again."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def has(self, name: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def settings(self, mine: dict[str, str]) -> None:
        """Writes the settings before the first step; steps on disk that were made with others are refused, not reused."""
        table = self.step("settings", lambda: self.spark.createDataFrame(sorted(mine.items()), "name string, value string"))
        found = {r.name: r.value for r in table.collect()}
        differ = sorted(k for k in mine.keys() | found.keys() if mine.get(k) != found.get(k))
        if differ:
            raise ValueError(f"{self.path} holds steps of other settings: {', '.join(differ)}")

    def step(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if not self.has(name):
            make().write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")


def associate(data: GenoDataset, plan: Plan, parts: DataFrame) -> DataFrame:
    """iteration, snp_id, effect, z (the size of the t statistic, which orders variants as p does) of response ~ dosage within each iteration's train part, one job for all."""
    g = data.genotypes.where("dosage is not null").join(data.phenotypes.select("sample_id", F.col(plan.response).cast("double").alias("y")).dropna(), "sample_id")
    g = g.join(parts.where("part = 'train'").select("iteration", "sample_id"), "sample_id").withColumn("x", F.col("dosage").cast("double"))
    s = g.groupBy("iteration", "snp_id").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("effect"), F.regr_r2("y", "x").alias("r2"))
    z = F.sqrt(F.col("r2") * (F.col("n") - 2) / F.greatest(1 - F.col("r2"), F.lit(1e-300)))
    return s.select("iteration", "snp_id", "effect", z.alias("z"))


def run(spark: SparkSession, data: GenoDataset, plan: Plan, workspace: str) -> dict[str, DataFrame]:
    """The tables of a run: associations, frequencies, effects, metrics, best."""
    from statistics import NormalDist

    ws = Workspace(spark, workspace)
    ws.settings({k: str(v) for k, v in asdict(plan).items()})
    clean = data.filtered(plan.filters)
    parts = ws.step("parts", lambda: resampling.split(clean.samples, plan.iterations, plan.fraction))
    tests = ws.step("associations", lambda: associate(clean, plan, parts))
    least = NormalDist().inv_cdf(1 - plan.psig / 2)
    picks = tests.select("iteration", "snp_id", F.lit("linear").alias("method"), F.when(F.col("z") >= least, F.col("effect")).otherwise(0.0).alias("beta"))
    freq = ws.step("frequencies", lambda: resampling.marker_frequencies(picks, "union", 1))
    mean = ws.step("effects", lambda: resampling.effects(freq, tests.select("iteration", "snp_id", F.col("effect").alias("beta")), tests.select("iteration").distinct(), "mean"))
    total = freq.count()
    if total <= plan.min_snps:
        raise ValueError(f"{total} variants are too few for a candidate")
    ranked = freq.join(mean, "snp_id").select("snp_id", F.col("effect").alias("weight"), "freq").transform(lambda r: ranking.ranked(r, -F.col("freq"), "snp_id")).drop("freq")

    def metrics() -> DataFrame:
        s = scoring.prefix_scores(clean.genotypes, ranked, plan.step, total).join(clean.phenotypes, "sample_id")
        return evaluation.nested_r2(s, ["n_snp"], plan.response, plan.covariate, "score")

    table = ws.step("metrics", metrics)
    best = ws.step("best", lambda: evaluation.select_best(table.select(F.col("n_snp").alias("idx"), "prs_r2"), "prs_r2"))
    return {"associations": tests, "frequencies": freq, "effects": mean, "metrics": table, "best": best}


def adjusted_weights(results: DataFrame) -> DataFrame:
    """Weights of refitted effects: minus the estimate, and its odds ratio."""
    return association.repair(results).select("snp_id", (-F.col("effect")).alias("effect_weight"), F.exp(-F.col("effect")).alias("OR"))


STRATEGIES = ("denovo", "evaluate", "validate", "external")
CLEANUP = {"none": (), "intermediate": ("associations", "effects"), "all": ("associations", "effects", "frequencies", "metrics", "parts")}


def with_retries(job: Callable[[], dict[str, DataFrame]], retries: int, lasting: tuple[type[Exception], ...] = (ValueError, KeyError, NotImplementedError)) -> dict[str, DataFrame]:
    """The job's tables; it is begun again after an error, which costs only the steps that are not on disk. Wrong settings are not tried again."""
    for left in range(retries, -1, -1):
        try:
            return job()
        except lasting:
            raise
        except Exception:
            if not left:
                raise
    raise AssertionError("unreachable")


def cleanup(ws: Workspace, level: str) -> None:
    """Deletes the steps that a finished run no longer needs."""
    if level not in CLEANUP:
        raise ValueError(f"cleanup is one of {', '.join(CLEANUP)}")
    for name in CLEANUP[level]:
        p = ws.spark._jvm.org.apache.hadoop.fs.Path(f"{ws.path}/{name}")
        p.getFileSystem(ws.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def dispatch(strategy: str, spark: SparkSession, data: GenoDataset, plan: Plan, workspace: str, earlier: str | None = None, retries: int = 1) -> dict[str, DataFrame]:
    """A run by strategy. denovo: all steps. evaluate and validate take the split and frequencies of an `earlier` workspace; evaluate reuses its effects, validate estimates them again on
    this data. external takes only the frequencies and draws a new split."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {', '.join(STRATEGIES)}")
    if strategy != "denovo":
        if earlier is None:
            raise ValueError(f"{strategy} needs an earlier workspace")
        old, new = Workspace(spark, earlier), Workspace(spark, workspace)
        new.settings({k: str(v) for k, v in asdict(plan).items()})
        for name in {"evaluate": ("parts", "frequencies", "effects"), "validate": ("parts", "frequencies"), "external": ("frequencies",)}[strategy]:
            if not old.has(name):
                raise ValueError(f"{earlier} lacks {name}")
            new.step(name, lambda name=name: spark.read.parquet(f"{old.path}/{name}"))
    return with_retries(lambda: run(spark, data, plan, workspace), retries)


def finished(workspaces: list[Workspace], names: tuple[str, ...] = ("parts", "associations", "frequencies", "effects", "metrics", "best")) -> dict[str, list[str]]:
    """The steps that each workspace still lacks; an empty list is a finished run."""
    return {w.path: [n for n in names if not w.has(n)] for w in workspaces}
