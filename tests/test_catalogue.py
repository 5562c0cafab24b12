"""Operators whose results SQL cannot give, against numpy or by construction."""

from dataclasses import replace
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociq.functions import stats
from lociq.operators import evaluation, lookups, qc, ranking, recode, relatedness, resampling
from lociq.plans import pipeline
from lociq.sources import plink
from tests.test_library import dataset


def test_components_match_a_decomposition(spark):
    d = dataset(spark, 60, 9)
    x = np.full((60, 9), np.nan)
    for r in d.genotypes.collect():
        if r.dosage is not None:
            x[r.sample_id, r.snp_id] = r.dosage
    z = np.nan_to_num((x - np.nanmean(x, axis=0)) / np.nanstd(x, axis=0, ddof=1))
    _, s, v = np.linalg.svd(z)
    scores, tests = relatedness.sample_components(d.genotypes.repartition(5), 3)
    got = np.array([[abs(r[k]) for k in ("pc1", "pc2", "pc3")] for r in scores.orderBy("sample_id").collect()])
    assert np.allclose([t[0] for t in tests], s**2) and np.allclose(got, np.abs(z @ v[:3].T), atol=1e-8)
    assert all(0 <= p <= 1 for _, _, p in tests) and relatedness.components_needed([(1, 3, 0.01), (1, 2, 0.02), (1, 1, 0.3)]) == 2
    assert relatedness.components_needed([(1, 0, 0.9)]) == 1


def calls(d, n, m):
    x = np.full((n, m), np.nan)
    for r in d.genotypes.collect():
        if r.dosage is not None:
            x[r.sample_id, r.snp_id] = r.dosage
    return x


def test_kinship_compares_blocks_of_samples(spark, monkeypatch):
    monkeypatch.setattr(relatedness, "BLOCK_CELLS", 1, raising=False)  # blocks of 64 samples
    d = dataset(spark, 150, 8)
    x = calls(d, 150, 8)
    alone = spark.createDataFrame([(900, 99, 1), (901, 98, 2)], "sample_id long, snp_id long, dosage int")  # share no variant with any
    for slope in (0, 0.001):  # whole dosages, and many levels
        df = relatedness.kinship(d.genotypes.unionByName(alone).withColumn("dosage", F.col("dosage") * (1 - F.col("sample_id") * F.lit(slope))), 0.2)
        assert "Join" not in df._jdf.queryExecution().toString()
        got = {(r.s1, r.s2): (r.n, r.ibs) for r in df.collect()}
        y = x * (1 - np.arange(150)[:, None] * slope)
        diff = np.abs(y[:, None] - y)
        n, ibs = (~np.isnan(diff)).sum(axis=2), 1 - np.nanmean(diff, axis=2) / 2
        want = {(i, j): (n[i, j], pytest.approx(ibs[i, j])) for i in range(150) for j in range(i + 1, 150) if ibs[i, j] >= 0.2}
        assert got == want and len(got) > 5000


def moments(x):
    p = np.nanmean(x, axis=0) / 2
    p = np.minimum(p, 1 - p)
    q, both, diff = 1 - p, ~np.isnan(x[:, None] + x), np.abs(x[:, None] - x)
    both &= p > 0
    e00, e10, e11 = ((both * e).sum(axis=2) for e in (2 * p * p * q * q, 4 * p**3 * q + 4 * p * q**3, 2 * p * p * q + 2 * p * q * q))
    z0 = np.clip((both * (diff == 2)).sum(axis=2) / e00, 0, 1)
    z1 = np.maximum(0, np.minimum(1 - z0, ((both * (diff == 1)).sum(axis=2) - z0 * e10) / e11))
    return z1 / 4 + (1 - z0 - z1) / 2


def test_kinship_by_moments_compares_blocks_of_samples(spark, monkeypatch):
    monkeypatch.setattr(relatedness, "BLOCK_CELLS", 1, raising=False)
    d = dataset(spark, 150, 8)
    alike = spark.range(150).selectExpr("id as sample_id", "77L as snp_id", "2 as dosage")  # does not vary
    gt = d.genotypes.unionByName(alike)
    df = relatedness.kinship_moments(gt, qc.variant_summary(gt, 150))
    assert "s2" not in df._jdf.queryExecution().analyzed().toString().split("FlatMapGroupsInArrow", 1)[1].split("\n", 1)[1]  # pairs are made in the tasks, not by a join
    want = moments(calls(d, 150, 8))
    got = {(r.s1, r.s2): r.kinship for r in df.collect()}
    assert got == {(i, j): pytest.approx(want[i, j], abs=1e-9) for i in range(150) for j in range(i + 1, 150)}


def test_relatives_in_other_blocks(spark, monkeypatch):
    monkeypatch.setattr(relatedness, "BLOCK_CELLS", 1, raising=False)
    d = dataset(spark, 150, 24)
    want, v = moments(calls(d, 150, 24)), qc.variant_summary(d.genotypes, 150)
    np.fill_diagonal(want, 0)
    sizes = set()
    for least in (0.1, 0.3, 0.35, 0.6):
        got = sorted(r.sample_id for r in relatedness.relatives(d.genotypes, v, least).collect())
        assert got == list(np.flatnonzero((want >= least).any(axis=1)))
        sizes.add(len(got))
    assert len(sizes) > 1


def test_scores_of_sets_are_one_row_a_sample(spark):
    d = dataset(spark, 30, 6)
    sets = spark.createDataFrame([(1, 0, 0.5), (1, 3, -1.0), (2, 3, 2.0), (4, 77, 1.0)], "rep int, snp_id long, weight double")
    df = resampling.set_scores(d.genotypes, sets, [1, 2, 4])
    want = d.genotypes.where("dosage is not null").join(sets, "snp_id").groupBy("rep", "sample_id").agg(F.sum(F.col("dosage") * F.col("weight")).alias("score"))
    assert {(r.rep, r.sample_id): pytest.approx(r.score) for r in want.collect()} == {(r.rep, r.sample_id): r.score for r in df.collect()}


def test_tracy_widom_tail_at_published_quantiles():
    for x, p in ((0.9793, 0.05), (2.0234, 0.01), (0.4501, 0.1)):  # fixed values: upper quantiles of the law of order 1
        assert stats.tracy_widom_upper(x) == pytest.approx(p, rel=0.05)


def test_ranks_without_a_global_window(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.integers(0, 40))) for i in range(3000)]
    got = {r.id: r.rank for r in ranking.ranked(spark.createDataFrame(rows, "id long, x double").repartition(7), -F.col("x"), "id").collect()}
    want = {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert got == want
    assert ranking.ranked(spark.createDataFrame([], "id long, x double"), F.col("x"), "id").count() == 0


def test_rank_normal(spark):
    rows = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 2.0), ("a", None), ("b", 5.0)], "g string, x double")
    z = {(r.g, r.x): r.z for r in recode.rank_normal(rows, "g", "x").collect()}
    assert z[("a", 2.0)] == pytest.approx(NormalDist().inv_cdf(1.5 / 3.5)) and z[("b", 5.0)] == pytest.approx(NormalDist().inv_cdf(0.5 / 1.5)) and len(z) == 4


def test_f_tail(spark):
    m = spark.createDataFrame([(1, 4.0, 20), (2, None, 20), (3, 1.0, 0)], "k int, f double, df int")
    p = {r.k: r.prs_pvalue for r in evaluation.with_p(m, "f", 1, "df").collect()}
    assert p[1] == pytest.approx(stats.t_two_sided(2.0, 20)) and p[2] == p[3] == 1.0


def test_binary_genotypes_in_ranges(spark, tmp_path, monkeypatch):
    d = dataset(spark, 7, 11)
    v = d.variants.selectExpr("*", "concat('rs', snp_id) as snp_name")
    s = d.samples.selectExpr("*", "'f' as pedigree", "cast(sample_id as string) as member", "null as father", "null as mother", "1 as sex", "null as affected")
    plink.write(d.genotypes, v, s, str(tmp_path / "x"))
    monkeypatch.setattr(plink, "RANGE", 5)  # two variants a range
    back = plink.read_genotypes(spark, f"file://{tmp_path}/x", 7)
    assert back.rdd.getNumPartitions() == 6
    rows = lambda df: sorted(map(tuple, df.select("sample_id", "snp_id", "dosage").collect()), key=str)
    assert rows(back) == rows(d.genotypes)
    assert rows(plink.read_genotypes(spark, str(tmp_path / "x"), 7, snps=(9, 99))) == rows(d.genotypes.where("snp_id >= 9"))
    with open(tmp_path / "x.bed", "ab") as f:
        f.write(b"\0")
    with pytest.raises(ValueError, match="whole number"):
        plink.read_genotypes(spark, str(tmp_path / "x"), 7)


def test_steps_of_other_settings_are_refused(spark, tmp_path):
    w = pipeline.Workspace(spark, str(tmp_path / "w"))
    w.settings({"a": "1"})
    w.settings({"a": "1"})
    with pytest.raises(ValueError, match="a"):
        w.settings({"a": "2"})
    assert replace(pipeline.Plan("y", "c"), step=3).step == 3


def test_repeats_and_missing_alleles(spark):
    rows = spark.createDataFrame([(1, "A"), (1, "?"), (2, None), (3, "")], "k int, allele string")
    assert lookups.known_allele(rows, "allele").count() == 1
    assert [tuple(r) for r in lookups.with_repeats(rows, "k", ["allele"]).collect()] == [(1, "?"), (1, "A")]
