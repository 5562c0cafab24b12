"""The data object: genotypes, variants, samples and phenotypes with their results, as DataFrames that are checked when built."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import qc

LOG_SCHEMA = "parameter string, name string, value double, type string, filtered long"


class InvalidDataset(ValueError):
    """What validate() found, all of it."""


@dataclass(frozen=True)
class ModelKey:
    """Response, covariates and number of principal components of a stored result."""

    response: str
    covariates: tuple[str, ...] = ()
    pcs: int = 0

    def __post_init__(self) -> None:
        if not self.response or self.response in self.covariates or self.pcs < 0:
            raise ValueError("a model needs a response that is not a covariate, and no negative number of components")

    def __str__(self) -> str:
        return f"{self.response} ~ " + (" + ".join([*self.covariates, *(f"PC{i + 1}" for i in range(self.pcs))]) or "1")

    @classmethod
    def parse(cls, text: str) -> ModelKey:
        left, _, right = text.partition("~")
        terms = [t.strip() for t in right.split("+") if t.strip() not in ("", "1")]
        pcs = [t for t in terms if t[:2] == "PC" and t[2:].isdigit()]
        return cls(left.strip(), tuple(t for t in terms if t not in pcs), len(pcs))


@dataclass(frozen=True)
class GenoDataset:
    """genotypes (sample_id, snp_id, dosage), variants (snp_id, chromosome, position, allele_a, allele_b), samples (sample_id, ...), phenotypes (sample_id, ...),
    results (model, snp_id, method, effect, p), scores (model, snp_id, method, beta)."""

    genotypes: DataFrame
    variants: DataFrame
    samples: DataFrame
    phenotypes: DataFrame | None = None
    results: DataFrame | None = None
    scores: DataFrame | None = None
    filter_log: DataFrame | None = None
    components: DataFrame | None = None
    genome: str = "nr"
    metadata: dict = field(default_factory=dict)

    def __repr__(self) -> str:
        return f"GenoDataset(genome={self.genome!r}, variants={self.variants.columns}, samples={self.samples.columns})"

    def validate(self) -> GenoDataset:
        """Raises InvalidDataset with every violation: keys that repeat, genotypes without a variant or sample, dosages outside 0, 1, 2, unknown genome."""
        found = []
        if self.genome not in ("hg18", "hg19", "hg38", "nr"):
            found.append(f"genome {self.genome} is not known")
        for name, df, key in (("variants", self.variants, "snp_id"), ("samples", self.samples, "sample_id")):
            if df.groupBy(key).count().where("count > 1").limit(1).count():
                found.append(f"{name} repeat {key}")
            if self.genotypes.select(key).join(df.select(key), key, "left_anti").limit(1).count():
                found.append(f"genotypes have a {key} that {name} lack")
        if self.genotypes.where("dosage is not null and dosage not in (0, 1, 2)").limit(1).count():
            found.append("dosages are not all 0, 1, 2 or null")
        for name, df in (("results", self.results), ("scores", self.scores)):
            if df is not None and df.select("snp_id").join(self.variants.select("snp_id"), "snp_id", "left_anti").limit(1).count():
                found.append(f"{name} have a snp_id that variants lack")
        if self.scores is not None and dict(self.scores.dtypes).get("beta") != "double":
            found.append("scores.beta is not numeric")
        if found:
            raise InvalidDataset("; ".join(found))
        return self

    def subset(self, snps: DataFrame | None = None, samples: DataFrame | None = None, strict: bool = True) -> GenoDataset:
        """The part with the given snp_id and sample_id rows; unknown ids are an error where strict."""
        out = self
        for key, ids, names in (("snp_id", snps, ("genotypes", "variants", "results", "scores")), ("sample_id", samples, ("genotypes", "samples", "phenotypes", "components"))):
            if ids is None:
                continue
            own = self.variants if key == "snp_id" else self.samples
            if strict and (lost := [r[0] for r in ids.select(key).join(own.select(key), key, "left_anti").limit(10).collect()]):
                raise KeyError(f"unknown {key}: {lost}")
            out = replace(out, **{n: getattr(out, n).join(ids.select(key).distinct(), key, "left_semi") for n in names if getattr(out, n) is not None})
        return out

    def assign(self, cells: DataFrame) -> GenoDataset:
        """Genotypes with the dosages of `cells` where it has them."""
        new = cells.select("sample_id", "snp_id", F.col("dosage").alias("new"), F.lit(True).alias("given"))
        g = self.genotypes.join(new, ["sample_id", "snp_id"], "left")
        return replace(self, genotypes=g.select("sample_id", "snp_id", F.when(F.col("given"), F.col("new")).otherwise(F.col("dosage")).alias("dosage")))

    def bind_samples(self, other: GenoDataset) -> GenoDataset:
        """Both datasets' samples over the same variants."""
        both = lambda n: getattr(self, n).unionByName(getattr(other, n)) if getattr(self, n) is not None and getattr(other, n) is not None else None
        return replace(self, genotypes=both("genotypes"), samples=both("samples"), phenotypes=both("phenotypes"), results=None, scores=None, components=None)

    def bind_variants(self, other: GenoDataset) -> GenoDataset:
        """Both datasets' variants over the same samples."""
        return replace(self, genotypes=self.genotypes.unionByName(other.genotypes), variants=self.variants.unionByName(other.variants))

    def filtered(self, filters: qc.Filters) -> GenoDataset:
        """The dataset that passes quality control; its log tells how many each filter removes."""
        n_samples, n_snps = self.samples.count(), self.variants.count()
        bad_v = qc.variant_failures(qc.variant_summary(self.genotypes, n_samples), filters)
        inbred = qc.inbreeding(self.genotypes) if filters.inbreed is not None else None
        bad_s = qc.sample_failures(qc.sample_summary(self.genotypes, n_snps), filters, inbred)
        out = self.subset(self.variants.join(bad_v, "snp_id", "left_anti"), self.samples.join(bad_s, "sample_id", "left_anti"), strict=False)
        return replace(out, filter_log=qc.filter_log(bad_v, bad_s))

    def store(self, model: ModelKey, results: DataFrame) -> GenoDataset:
        """Results (snp_id, method, effect, p) kept under a model; those it had before are replaced."""
        new = results.select(F.lit(str(model)).alias("model"), "snp_id", "method", "effect", "p")
        old = self.results.where(F.col("model") != str(model)) if self.results is not None else None
        return replace(self, results=new if old is None else old.unionByName(new))

    def models(self) -> list[ModelKey]:
        """The stored models; as many rows as there are models reach the driver."""
        return [] if self.results is None else [ModelKey.parse(r[0]) for r in self.results.select("model").distinct().orderBy("model").collect()]
