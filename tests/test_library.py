import math

import numpy as np
import pytest

from lociq.dataset import GenoDataset, InvalidDataset, ModelKey
from lociq.functions import stats
from lociq.operators import association, evaluation, imputation, qc, relatedness, scoring
from lociq.plans import pipeline
from lociq.sources import plink, scores


def dataset(spark, n=40, m=12):
    rng = np.random.default_rng(1)
    d = rng.integers(0, 3, (n, m))
    y = 0.8 * d[:, 0] - 0.5 * d[:, 3] + rng.normal(size=n)
    gt = spark.createDataFrame([(i, j, None if rng.random() < 0.02 else int(d[i, j])) for i in range(n) for j in range(m)], "sample_id long, snp_id long, dosage int")
    variants = spark.createDataFrame([(j, 1 + j % 2, 1000 * j, "A", "G") for j in range(m)], "snp_id long, chromosome int, position long, allele_a string, allele_b string")
    samples = spark.createDataFrame([(i,) for i in range(n)], "sample_id long")
    pheno = spark.createDataFrame([(i, float(y[i]), float(rng.normal())) for i in range(n)], "sample_id long, trait double, cov double")
    return GenoDataset(gt, variants, samples, pheno, genome="hg19")


def test_dataset(spark):
    d = dataset(spark).validate()
    assert d.subset(spark.createDataFrame([(1,), (2,)], "snp_id long")).genotypes.select("snp_id").distinct().count() == 2
    with pytest.raises(KeyError):
        d.subset(spark.createDataFrame([(99,)], "snp_id long"))
    with pytest.raises(InvalidDataset):
        GenoDataset(d.genotypes, d.variants.where("snp_id > 0"), d.samples).validate()
    with pytest.raises(InvalidDataset):
        GenoDataset(d.genotypes, d.variants, d.samples, genome="x").validate()
    new = d.assign(spark.createDataFrame([(0, 0, None)], "sample_id long, snp_id long, dosage int"))
    assert new.genotypes.where("sample_id = 0 and snp_id = 0").first().dosage is None
    assert new.genotypes.count() == d.genotypes.count()


def test_model_key():
    k = ModelKey("bmi", ("age", "sex"), 2)
    assert str(k) == "bmi ~ age + sex + PC1 + PC2" and ModelKey.parse(str(k)) == k and ModelKey.parse("y ~ 1") == ModelKey("y")
    with pytest.raises(ValueError):
        ModelKey("a", ("a",))


def test_filters_are_checked():
    for bad in ({"maf": 2}, {"hetero_hard": 0.1}, {"hetero_stat": None}, {"hetero_stat": "mode"}):
        with pytest.raises(ValueError):
            qc.Filters(**bad)


def test_tails():
    assert stats.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert stats.f_upper(3.0, 2, 20) == pytest.approx(1.3**-10, abs=1e-12)  # closed form for two degrees of freedom
    assert stats.chi2_upper(5.0, 4) == pytest.approx(math.exp(-2.5) * 3.5, abs=1e-12)
    assert stats.chi2_upper(30.0, 3) == pytest.approx(1.38e-6, rel=1e-2)
    assert stats.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)


def test_adjusted_regression_matches_least_squares(spark):
    d = dataset(spark)
    got = {r.snp_id: r for r in association.linear_adjusted(d.genotypes, d.phenotypes, "trait", ["cov"]).collect()}
    t = d.genotypes.where("snp_id = 3 and dosage is not null").join(d.phenotypes, "sample_id").toPandas()
    x = np.stack([np.ones(len(t)), t["cov"], t.dosage.astype(float)], axis=1)
    b, rss = np.linalg.lstsq(x, t.trait, rcond=None)[:2]
    assert got[3].effect == pytest.approx(b[2]) and got[3].n == len(t)
    assert got[3].se == pytest.approx(math.sqrt(rss[0] / (len(t) - 3) * np.linalg.inv(x.T @ x)[2, 2]))


def test_unusable_variant_has_no_estimate(spark):
    d = dataset(spark)
    same = d.genotypes.where("snp_id = 0").selectExpr("sample_id", "snp_id", "1 as dosage")
    r = association.repair(association.linear_adjusted(same, d.phenotypes, "trait", ["cov"])).first()
    assert r.p == 1 and r.effect == 0


def test_imputation_leaves_no_gap_and_keeps_calls(spark):
    d = dataset(spark)
    for f in (imputation.impute_mode, imputation.impute_neighbours):
        out = f(d.genotypes)
        assert out.where("dosage is null").count() == 0 and out.count() == d.genotypes.count()
        assert out.intersectAll(d.genotypes.where("dosage is not null")).count() == d.genotypes.where("dosage is not null").count()


def test_clump_is_greedy(spark):
    ld = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (4, 5, 0.01)], "snp1 long, snp2 long, r2 double")
    order = spark.createDataFrame([(1, s, float(r)) for s, r in ((1, 2), (2, 1), (3, 3), (4, 4), (5, 5))], "chromosome long, snp_id long, rank double")
    assert sorted(r.snp_id for r in relatedness.clump(ld, order, 0.1).collect()) == [2, 4, 5]


def test_components_of_a_gram_matrix():
    w, _ = relatedness.principal_components([(0, 0, 2.0), (0, 1, 1.0), (1, 1, 2.0)], 2)
    assert w == pytest.approx([3, 1])
    assert np.isfinite(stats.tracy_widom(np.array([5.0, 2, 1, 0.5]))[0])


def test_local_maxima_count_a_plateau_at_its_first_point(spark):
    s = spark.createDataFrame([(i, float(v)) for i, v in enumerate((1, 3, 2, 5, 5, 4), 1)], "idx long, v double")
    assert sorted(r.idx for r in evaluation.local_maxima(s, "v").collect()) == [2, 4]


def test_plink_round_trip(spark, tmp_path):
    d = dataset(spark, 7, 5)
    v = d.variants.selectExpr("*", "concat('rs', snp_id) as snp_name")
    s = d.samples.selectExpr("*", "'f' as pedigree", "cast(sample_id as string) as member", "null as father", "null as mother", "1 as sex", "null as affected")
    plink.write(d.genotypes, v, s, str(tmp_path / "x"))
    back = plink.read_genotypes(spark, str(tmp_path / "x"), 7)
    key = lambda r: (r.sample_id, r.snp_id)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, d.genotypes.select("sample_id", "snp_id", "dosage").collect()), key=str)
    assert {key(r) for r in plink.read_genotypes(spark, str(tmp_path / "x"), 7, [2, 5], (1, 3)).collect()} == {(i, j) for i in (2, 5) for j in (1, 2)}
    variants, fam = plink.read_tables(spark, str(tmp_path / "x"))
    assert variants.count() == 5 and fam.count() == 7
    with pytest.raises(ValueError):
        plink.read_genotypes(spark, str(tmp_path / "x"), 7, [9])


def test_score_file(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# comment\nchr_name\tchr_position\teffect_allele\tOR\n1\t10\tA\t2.0\n2\t20\tC\t\n")
    rows = {r.rsID: r for r in scores.read(spark, str(tmp_path / "s.txt")).collect()}
    assert rows["1_10_N_A"].effect_weight == pytest.approx(math.log(2)) and rows["2_20_N_C"].OR == 0 and rows["2_20_N_C"].effect_weight == 1
    with pytest.raises(ValueError):
        scoring.score(None, None, "median")


def test_pipeline_runs_and_resumes(spark, tmp_path):
    d = dataset(spark, 120, 12)
    plan = pipeline.Plan("trait", "cov", iterations=4, psig=0.2, step=2, min_snps=1, filters=qc.Filters(None, None, None, None, None, None, None, None))
    out = pipeline.run(spark, d, plan, f"file://{tmp_path}/ws")
    assert {0, 3} <= {r.snp_id for r in out["frequencies"].collect()} and out["best"].count() == 1
    again = pipeline.run(spark, d, plan, f"file://{tmp_path}/ws")
    assert again["metrics"].collect() == out["metrics"].collect()


def test_streaming_counts(spark, tmp_path):
    from lociq.streaming.scores import windowed_counts

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    q = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from counts").first()[0] == events.count()


def test_summary_lasso_meets_its_optimality_conditions():
    from lociq.operators.penalized import coordinate_descent

    rng = np.random.default_rng(2)
    ld = np.corrcoef(rng.normal(size=(6, 40)) + rng.normal(size=40))
    cor = rng.uniform(-0.5, 0.5, 6)
    b = coordinate_descent(ld.copy(), cor, 0.5, 0.1)
    r = 0.5 * ld + 0.5 * np.eye(6)
    slope = cor - r @ b
    assert all(abs(s) <= 0.1 + 1e-8 if x == 0 else abs(s - 0.1 * np.sign(x)) < 1e-8 for s, x in zip(slope, b)) and (b != 0).any()
