"""Metrics of score candidates: summaries, empirical and rank tests, maxima, and regression metrics of nested models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(runs: DataFrame, by: str, value: str) -> DataFrame:
    """mean, sd, median and iqr of a metric for each value of `by`."""
    q = lambda x: F.percentile(value, F.lit(x))
    return runs.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), q(0.5).alias("median"), (q(0.75) - q(0.25)).alias("iqr"))


def empirical_p(runs: DataFrame, by: str, value: str, baseline: str) -> DataFrame:
    """Share of runs whose value is below the baseline's."""
    return runs.groupBy(by).agg(F.avg((F.col(value) < F.col(baseline)).cast("double")).alias("p"))


def welch_statistic(runs: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """t and degrees of freedom of the unequal-variance test, from moments."""
    g = runs.groupBy(by).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), (F.var_samp(x) / F.count(x)).alias("a"), (F.var_samp(y) / F.count(y)).alias("b"), F.count(x).alias("n"))
    df = (F.col("a") + F.col("b")) ** 2 / (F.col("a") ** 2 / (F.col("n") - 1) + F.col("b") ** 2 / (F.col("n") - 1))
    return g.where("n > 1").select(by, ((F.col("mx") - F.col("my")) / F.sqrt(F.col("a") + F.col("b"))).alias("t"), df.alias("df"))


def rank_sum(runs: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """w: the rank-sum statistic of x against y, ties at their mean rank."""
    long = runs.select(by, F.lit(1).alias("is_x"), F.col(x).alias("v")).unionByName(runs.select(by, F.lit(0).alias("is_x"), F.col(y).alias("v")))
    w = Window.partitionBy(by)
    mean_rank = F.rank().over(w.orderBy("v")) + (F.count(F.lit(1)).over(Window.partitionBy(by, "v")) - 1) / 2.0
    g = long.withColumn("r", mean_rank).where("is_x = 1").groupBy(by).agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("n"))
    return g.select(by, (F.col("s") - F.col("n") * (F.col("n") + 1) / 2.0).alias("w"))


def local_maxima(series: DataFrame, value: str) -> DataFrame:
    """idx and value at which a run of rising steps ends; the first point counts as rising, and goes where the second repeats it.

    A series is a handful of cut-offs: one ordered window over it is all the state there is."""
    w = Window.orderBy("idx")
    v = F.col(value)
    s = series.select("idx", v).withColumns({"up": F.coalesce(v > F.lag(v).over(w), F.lit(True)), "next_up": F.coalesce(F.lead(v).over(w) > v, F.lit(False)), "second": F.lead(v).over(w), "n": F.row_number().over(w)})
    return s.where(F.col("up") & ~F.col("next_up") & ~((F.col("n") == 1) & F.coalesce(F.col("second") == v, F.lit(False)))).select("idx", value)


def adjusted_r2(r2: str, n_snp: str) -> Column:
    return F.sqrt(F.col(r2) / F.ln(F.col(n_snp).cast("double")))


def select_best(series: DataFrame, value: str) -> DataFrame:
    """The maximum with the largest value, after the first and last are trimmed where there are more than two."""
    m = local_maxima(series, value)
    w = Window.orderBy("idx")
    every = Window.partitionBy()
    m = m.withColumns({"n": F.row_number().over(w), "all": F.count(F.lit(1)).over(every)})
    return m.where((F.col("all") <= 2) | ((F.col("n") > 1) & (F.col("n") < F.col("all")))).orderBy(F.col(value).desc(), "idx").limit(1).select("idx", value)


def _moments(y: str, xs: list[str]) -> list[Column]:
    names = [y, *xs]
    return [F.avg(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]] + [F.avg(a).alias(f"m_{a}") for a in names]


def nested_r2(data: DataFrame, by: list[str], y: str, covariate: str, score: str) -> DataFrame:
    """by..., n, reduced_r2 (y ~ covariate), full_r2 (y ~ covariate + score), prs_r2 (their absolute difference), prs_f (F of the added score)."""
    g = data.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[f(a, b).alias(n) for f, a, b, n in (
        (F.covar_pop, covariate, covariate, "cc"), (F.covar_pop, score, score, "ss"), (F.covar_pop, y, y, "yy"),
        (F.covar_pop, covariate, score, "cs"), (F.covar_pop, covariate, y, "cy"), (F.covar_pop, score, y, "sy"))])
    det = F.col("cc") * F.col("ss") - F.col("cs") ** 2
    reduced = F.col("cy") ** 2 / (F.col("cc") * F.col("yy"))
    full = (F.col("cy") ** 2 * F.col("ss") - 2 * F.col("cy") * F.col("sy") * F.col("cs") + F.col("sy") ** 2 * F.col("cc")) / (det * F.col("yy"))
    g = g.withColumns({"reduced_r2": reduced, "full_r2": full})
    f = (F.col("full_r2") - F.col("reduced_r2")) / ((1 - F.col("full_r2")) / (F.col("n") - 3))
    return g.select(*by, "n", "reduced_r2", "full_r2", F.abs(F.col("full_r2") - F.col("reduced_r2")).alias("prs_r2"), f.alias("prs_f"))


def cross_validate(scores: DataFrame, pheno: DataFrame, parts: DataFrame, response: str) -> DataFrame:
    """iteration, rmse, mae, cor of response ~ score, fitted on the train part and predicted on the test part of each iteration, all in one job."""
    data = scores.join(pheno.select("sample_id", F.col(response).alias("y")), "sample_id").join(parts, "sample_id")
    fit = data.where("part = 'train'").groupBy("iteration").agg(F.regr_slope("y", "score").alias("b"), F.regr_intercept("y", "score").alias("a"))
    test = data.where("part = 'test'").join(fit, "iteration").withColumn("e", F.col("y") - F.col("a") - F.col("b") * F.col("score")).withColumn("f", F.col("a") + F.col("b") * F.col("score"))
    return test.groupBy("iteration").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"), F.corr("y", "f").alias("cor"))


def jarque_bera(data: DataFrame, by: str, value: str) -> DataFrame:
    """jb: n / 6 * (skewness^2 + (kurtosis - 3)^2 / 4) with population moments."""
    g = data.groupBy(by).agg(F.count(value).alias("n"), F.skewness(value).alias("s"), F.kurtosis(value).alias("k"))
    return g.where("n > 3").select(by, (F.col("n") / 6.0 * (F.col("s") ** 2 + F.col("k") ** 2 / 4.0)).alias("jb"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def score_r2(scores: DataFrame, pheno: DataFrame, by: list[str], response: str) -> DataFrame:
    """by..., r2 of response ~ score."""
    return scores.join(pheno.select("sample_id", F.col(response).alias("y")), "sample_id").groupBy(*by).agg(F.regr_r2("y", "score").alias("r2"))


def bootstrap_p(random: DataFrame, observed: DataFrame) -> DataFrame:
    """p: share of random sets whose r2 reaches the observed one (a single row)."""
    return random.join(F.broadcast(observed.select(F.col("r2").alias("seen")))).agg(F.avg((F.col("r2") >= F.col("seen")).cast("double")).alias("p"))


def cross_validate_full(data: DataFrame, by: list[str], y: str, covariate: str, score: str, part: str = "part") -> DataFrame:
    """The metrics of y ~ covariate (reduced) and y ~ covariate + score (full), fitted on the train rows and predicted on the test rows of each `by`:
    reduced_r2, full_r2, prs_r2, prs_f (train); rmse, mae, correlation with the prediction and its square of both, and the squares' difference (test)."""
    train = data.where(F.col(part) == "train").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"), F.avg(covariate).alias("mc"), F.avg(score).alias("ms"),
        *[F.covar_pop(a, b).alias(n) for a, b, n in ((covariate, covariate, "cc"), (score, score, "ss"), (y, y, "yy"), (covariate, score, "cs"), (covariate, y, "cy"), (score, y, "sy"))],
    )
    c = F.col
    det = c("cc") * c("ss") - c("cs") * c("cs")
    fit = train.withColumns({"rb": c("cy") / c("cc"), "fc": (c("cy") * c("ss") - c("sy") * c("cs")) / det, "fs": (c("sy") * c("cc") - c("cy") * c("cs")) / det})
    fit = fit.withColumns({"reduced_r2": c("rb") * c("cy") / c("yy"), "full_r2": (c("fc") * c("cy") + c("fs") * c("sy")) / c("yy")})
    fit = fit.select(*by, "n", "my", "mc", "ms", "rb", "fc", "fs", "reduced_r2", "full_r2", (c("full_r2") - c("reduced_r2")).alias("prs_r2"), ((c("full_r2") - c("reduced_r2")) / ((1 - c("full_r2")) / (c("n") - 3))).alias("prs_f"))
    test = data.where(F.col(part) == "test").join(fit, by)
    test = test.withColumns({"_r": c("my") + c("rb") * (c(covariate) - c("mc")), "_f": c("my") + c("fc") * (c(covariate) - c("mc")) + c("fs") * (c(score) - c("ms"))})
    out = []
    for name, p in (("reduced", "_r"), ("full", "_f")):
        e = c(y) - c(p)
        out += [F.sqrt(F.avg(e * e)).alias(f"{name}_rmse"), F.avg(F.abs(e)).alias(f"{name}_mae"), F.corr(y, p).alias(f"{name}_pred_cor")]
    g = test.groupBy(*by).agg(*[F.first(x).alias(x) for x in ("reduced_r2", "full_r2", "prs_r2", "prs_f")], *out)
    g = g.withColumns({"reduced_pred_r2": c("reduced_pred_cor") * c("reduced_pred_cor"), "full_pred_r2": c("full_pred_cor") * c("full_pred_cor")})
    return g.withColumn("prs_pred_r2", c("full_pred_r2") - c("reduced_pred_r2"))


def with_p(metrics: DataFrame, f: str, df1: int, df2: str, name: str = "prs_pvalue") -> DataFrame:
    """metrics with the upper tail of an F statistic (column f; df2 is a column); undefined ones give 1."""
    import pandas as pd

    from ..functions import stats

    def tail(batches):
        for x, d in batches:
            yield pd.Series([1.0 if a is None or a != a or b is None or b <= 0 else stats.f_upper(a, df1, b) for a, b in zip(x, d)])

    from collections.abc import Iterator

    tail.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return metrics.withColumn(name, F.pandas_udf(tail, "double")(F.col(f).cast("double"), F.col(df2).cast("double")))


def criterion(metrics: DataFrame, by: str, kind: str = "r2") -> DataFrame:
    """idx and the series on which candidates are compared: r2, its adjustment for the number of markers, -log10 p, or -aic."""
    series = {"r2": F.col("r2"), "adjusted": adjusted_r2("r2", "n_snp"), "p": -F.log10("p"), "aic": -F.col("aic")}
    if kind not in series:
        raise ValueError(f"criterion is one of {sorted(series)}")
    return metrics.select(F.col(by).alias("idx"), series[kind].alias("value"))


def above_baseline(maxima: DataFrame, value: str, baseline: DataFrame, baseline_value: str) -> DataFrame:
    """Maxima above the mean of the baseline's values (one row)."""
    return maxima.join(F.broadcast(baseline.agg(F.avg(baseline_value).alias("_m")))).where(F.col(value) > F.col("_m")).drop("_m")


def aic(data: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """by..., aic of y ~ x under normal errors: n (ln(2 pi rss / n) + 1) + 2 * 3."""
    g = data.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_syy(y, x).alias("syy"), F.regr_r2(y, x).alias("r2"))
    return g.select(*by, (F.col("n") * (F.log(2 * F.pi() * F.col("syy") * (1 - F.col("r2")) / F.col("n")) + 1) + 6).alias("aic"))


def cv_summary(runs: DataFrame, by: str, full: str, reduced: str) -> DataFrame:
    """by, and means, deviations and ranges of both metrics, their difference, the empirical p and the Welch statistic, in one row."""
    s = runs.withColumn("_d", F.col(full) - F.col(reduced)).groupBy(by).agg(*[f(x).alias(f"{m}_{n}") for x, m in ((full, "full"), (reduced, "reduced"), ("_d", "gain")) for f, n in ((F.avg, "mean"), (F.stddev_samp, "sd"), (F.min, "min"), (F.max, "max"))])
    return s.join(empirical_p(runs, by, full, reduced), by).join(welch_statistic(runs, by, full, reduced), by)


def report(summary_rows: DataFrame, by: str, mean: str, sd: str, p: str) -> DataFrame:
    """by, line: a summary as text, with a mark where p is below 0.05."""
    return summary_rows.select(by, F.concat(F.format_string("%.3f (%.3f)", mean, sd), F.when(F.col(p) < 0.05, " *").otherwise("")).alias("line"))
