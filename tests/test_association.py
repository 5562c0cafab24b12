"""Association by several methods, mixed models, tests of normality, the chain of filters and the strategies of a run."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociq.functions import stats
from lociq.operators import association, cleaning, gwas, imputation, mixed, qc, relatedness, reporting
from lociq.plans import pipeline
from tests.test_library import dataset


def matrix(d, n, m):
    x = np.full((n, m), np.nan)
    for r in d.genotypes.collect():
        if r.dosage is not None:
            x[r.sample_id, r.snp_id] = r.dosage
    return x


def binary(d):
    return replace(d, phenotypes=d.phenotypes.withColumn("case", F.when(F.col("trait") > 0.3, "yes").otherwise("no")))


def test_logistic_with_covariates(spark):
    d = dataset(spark, 80, 5)
    p = binary(d).phenotypes.withColumn("y", (F.col("case") == "yes").cast("int"))
    plain = {r.snp_id: r for r in association.logistic(d.genotypes, p, "y").collect()}
    got = {r.snp_id: r for r in mixed.logistic(d.genotypes, p, "y", []).collect()}
    for k, r in got.items():
        assert (r.effect, r.se) == pytest.approx((plain[k].effect, plain[k].se), rel=1e-6) and r.low < np.exp(r.effect) < r.high
    x, y = matrix(d, 80, 5), {r.sample_id: (r.y, r.cov) for r in p.collect()}
    ok = ~np.isnan(x[:, 0])
    design = np.column_stack([np.ones(80), [y[i][1] for i in range(80)], np.nan_to_num(x[:, 0])])[ok]
    b, se, done = mixed.logistic_fit(design, np.array([y[i][0] for i in range(80)])[ok])
    r = {r.snp_id: r for r in mixed.logistic(d.genotypes, p, "y", ["cov"]).collect()}[0]
    assert done and (r.effect, r.se) == pytest.approx((b[2], se[2]))
    slope = design.T @ (np.array([y[i][0] for i in range(80)])[ok] - 1 / (1 + np.exp(-design @ b)))
    assert np.allclose(slope, 0, atol=1e-6)
    apart = np.array([0.0] * 10 + [1.0] * 10)
    assert not mixed.logistic_fit(np.column_stack([np.ones(20), apart]), apart)[2]


def test_logistic_counts_equal_rows_before_they_meet(spark):
    d = dataset(spark, 80, 4)
    pheno = d.phenotypes.selectExpr("sample_id", "int(trait > 0.3) as y", "double(sample_id % 2) as c1", "cov as c2")
    for names in (["c1"], ["c1", "c2"]):
        got = {r.snp_id: r for r in mixed.logistic(d.genotypes, pheno, "y", names).collect()}
        people = {r.sample_id: r for r in pheno.collect()}
        for j in range(3):
            rows = [(r.dosage, people[r.sample_id]) for r in d.genotypes.where(f"snp_id = {j} and dosage is not null").collect()]
            b, se, _ = mixed.logistic_fit(np.array([[1, *(p[c] for c in names), x] for x, p in rows], float), np.array([p.y for _, p in rows], float))
            assert (got[j].n, got[j].effect, got[j].se) == (len(rows), pytest.approx(b[-1]), pytest.approx(se[-1]))
    plan = mixed.logistic(d.genotypes, pheno, "y", ["c1"])._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" in plan and "Aggregate [snp_id" in plan


def test_mixed_model_is_least_squares_without_kinship(spark):
    d = dataset(spark, 50, 6)
    full = d.genotypes.join(d.genotypes.where("dosage is null").select("snp_id").distinct(), "snp_id", "left_anti")
    want = {r.snp_id: r for r in association.linear_adjusted(full, d.phenotypes, "trait", ["cov"]).collect()}
    got = {r.snp_id: r for r in mixed.mixed(full, d.phenotypes, "trait", ["cov"], kinship=np.eye(50)).collect()}
    assert want and all((got[k].effect, got[k].se, got[k].p) == pytest.approx((r.effect, r.se, r.p), rel=1e-6) for k, r in want.items())
    k = mixed._matrix(d.genotypes.repartition(3), list(range(50)))
    x = matrix(d, 50, 6)
    z = np.nan_to_num((x - np.nanmean(x, axis=0)) / np.nanstd(x, axis=0, ddof=1))
    assert np.allclose(k, z @ z.T / 6)
    with pytest.raises(ValueError, match="at most"):
        mixed.MOST_SAMPLES, keep = 10, mixed.MOST_SAMPLES
        try:
            mixed.mixed(d.genotypes, d.phenotypes, "trait")
        finally:
            mixed.MOST_SAMPLES = keep


def test_mixed_model_of_more_samples_than_the_bound(spark, monkeypatch):
    d = dataset(spark, 50, 6)
    bare = spark.createDataFrame([(90 + i, float(i), float(i * i % 7)) for i in range(5)], "sample_id long, trait double, cov double")  # without genotypes
    pheno = d.phenotypes.unionByName(bare)
    same = d.genotypes.where("snp_id = 0").selectExpr("sample_id", "6L as snp_id", "1 as dosage")
    away = spark.createDataFrame([(500, 7, 1), (501, 1, 2)], "sample_id long, snp_id long, dosage int")
    gt = d.genotypes.unionByName(same).unionByName(away)
    order = sorted(r.sample_id for r in pheno.collect())
    k = mixed._matrix(gt.join(pheno.select("sample_id"), "sample_id", "left_semi"), order)
    want = {r.snp_id: r for r in mixed.mixed(gt, pheno, "trait", ["cov"], kinship=k).collect()}
    monkeypatch.setattr(mixed, "MOST_SAMPLES", 20)
    got = {r.snp_id: r for r in mixed.mixed(gt.repartition(5), pheno, "trait", ["cov"]).collect()}
    assert got.keys() == want.keys() and len(want) == 8 and want[6].p is None and want[7].n == 0
    for j, r in want.items():
        assert all(a == b or a == pytest.approx(b, rel=1e-5) for a, b in zip(got[j], r)), (got[j], r)


def test_permutation_p_repeats_and_finds_the_effect(spark):
    d = dataset(spark, 120, 4)
    a, b = ({r.snp_id: r.p for r in mixed.permutation_p(d.genotypes.repartition(n), d.phenotypes, "trait", 199).collect()} for n in (1, 4))
    assert a == b and a[0] <= 0.01 and max(a.values()) > 0.02


def test_gwa_by_methods(spark):
    d = binary(dataset(spark, 60, 6))
    out = gwas.gwa(d, "case", methods=("glm", "allelic", "mixed"), how="fisher")
    assert {r[0] for r in out.results.select("method").distinct().collect()} == {"glm", "allelic", "fisher"} and [str(m) for m in out.models()] == ["case ~ 1"]
    out = gwas.gwa(replace(out, components=relatedness.sample_components(d.genotypes, 2)[0]), 1, ["cov"], 2, ("glm", "mixed"), "simes")
    assert {str(m) for m in out.models()} == {"case ~ 1", "trait ~ cov + PC1 + PC2"}
    assert out.results.where("model like 'trait%' and method = 'simes'").count() == 6
    for bad, error in (((d, "nope"), KeyError), ((d, 9), KeyError), ((d, "trait", ["trait"]), ValueError), ((d, "trait", [], 1), ValueError)):
        with pytest.raises(error):
            gwas.gwa(*bad)
    with pytest.raises(NotImplementedError):
        gwas.gwa(d, "trait", how="pandora")
    with pytest.raises(ValueError):
        gwas.gwa(d, "trait", methods=("allelic",))
    with pytest.raises(ValueError):
        gwas.binary_levels(spark.createDataFrame([("a",), ("b",), ("c",)], "x string"), "x")


def test_tests_of_normality():
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]  # a published example: W 0.79, p 0.0067
    w, p = stats.shapiro_wilk(weights)
    assert w == pytest.approx(0.7888, abs=1e-4) and p == pytest.approx(0.0067, abs=1e-4)
    rng = np.random.default_rng(1)
    assert stats.normality(rng.normal(size=200))[0] > 0.05 > stats.normality(rng.exponential(size=200))[0]
    assert stats.normality(rng.normal(size=6000), times=100)[0] > 0.85 > 0.2 > stats.normality(rng.exponential(size=6000), times=100)[0]
    null = np.array([stats.shapiro_wilk(rng.normal(size=25))[1] for _ in range(1500)])
    assert 0.03 < (null < 0.05).mean() < 0.07


def test_combined_tails():
    rng = np.random.default_rng(2)
    means = 1 / (1 / rng.uniform(size=(40_000, 10))).mean(axis=1)
    for cut in (0.01, 0.02, 0.05):
        assert stats.harmonic_p(np.full(10, cut)) == pytest.approx((means <= cut).mean(), rel=0.12)
    assert stats.weighted_p([0.01, 0.04]) == pytest.approx(0.02) and stats.weighted_p([0.01, 0.04], [1, 0]) == pytest.approx(0.01)
    with pytest.raises(ValueError):
        stats.harmonic_p([0.1, 0.2], [1, 1])
    w, p = stats.rank_sum_greater([3, 4, 5, 6], [1, 2, 2, 3])
    assert w == 15.5 and 0 < p < 0.05


def test_chain_of_filters(spark):
    d = dataset(spark, 40, 12)
    twin = d.genotypes.where("sample_id = 0").withColumn("sample_id", F.lit(40).cast("long"))
    samples = d.samples.unionByName(spark.range(40, 41).withColumnRenamed("id", "sample_id"))
    d = replace(d, genotypes=d.genotypes.unionByName(twin), samples=samples, phenotypes=None)
    off = qc.Filters(None, None, None, None, None, None, None, None)
    out = cleaning.cleaned(d, off, cleaning.Chain(kinship=0.45, ld=None, impute=True, outliers=50.0))
    left = {r[0] for r in out.samples.collect()}
    assert not {0, 40} & left and out.genotypes.where("dosage is null").count() == 0 and out.components.count() == len(left)
    assert {r.name for r in out.filter_log.collect()} == {"kinship", "outliers"}
    some = cleaning.component_covariates(d, ld=0.9, count=3)
    assert some.components.columns == ["sample_id", "pc1", "pc2", "pc3"]
    assert len(cleaning.component_covariates(d, ld=None).components.columns) >= 2


def test_rules_settle(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    d = dataset(spark, 60, 6)
    ld = lambda g: relatedness.ld_pairs(g, d.variants, 10**6)
    before = d.genotypes.where("dosage is null").count()
    out = imputation.impute_until_settled(d.genotypes, ld)
    assert out.count() == d.genotypes.count() and out.where("dosage is null").count() < before and out.where("dosage not in (0, 1, 2)").count() == 0


def test_strategies_and_retries(spark, tmp_path):
    d = dataset(spark, 120, 12)
    plan = pipeline.Plan("trait", "cov", iterations=4, psig=0.2, step=2, min_snps=1, filters=qc.Filters(None, None, None, None, None, None, None, None))
    first = pipeline.dispatch("denovo", spark, d, plan, f"file://{tmp_path}/a")
    again = pipeline.dispatch("evaluate", spark, d, plan, f"file://{tmp_path}/b", f"file://{tmp_path}/a")
    assert sorted(again["frequencies"].collect()) == sorted(first["frequencies"].collect())
    ws = pipeline.Workspace(spark, f"file://{tmp_path}/b")
    assert pipeline.finished([ws])[ws.path] == []
    pipeline.cleanup(ws, "all")
    assert "frequencies" in pipeline.finished([ws])[ws.path] and ws.has("best")
    with pytest.raises(ValueError):
        pipeline.dispatch("external", spark, d, plan, f"file://{tmp_path}/c")
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("lost")
        return {}

    assert pipeline.with_retries(flaky, 2) == {} and len(tries) == 3
    with pytest.raises(RuntimeError):
        tries.clear()
        pipeline.with_retries(flaky, 1)


def test_scores_need_coverage(spark):
    d = dataset(spark, 60, 6)
    w = spark.createDataFrame([(j, 0.1 * j) for j in range(9)], "snp_id long, weight double")
    out = reporting.apply_score(d.genotypes, d.variants, d.phenotypes, w, "trait", "cov", 3, 5)
    assert out["coverage"].first()["n_missing"] == 3 and out["random"].count() == 5 and 0 <= out["bootstrap"].first()["p"] <= 1
    with pytest.raises(ValueError):
        reporting.apply_score(d.genotypes, d.variants, d.phenotypes, w, "trait", "cov", 7)
