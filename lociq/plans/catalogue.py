"""Registered queries of look-ups, coding, score files, cross-validation and merging of metadata, each with its DuckDB text."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import cleaning, evaluation, gwas, imputation, intervals, lookups, merging, mixed, ranking, recode, relatedness, reporting, resampling, scoring
from .registry import _BETAS, _COMPARED, _DRAW, _LD, _MAXIMA, _RAW, _SETS, _ld, _parts, _sql, query, rounded

# ---- look-ups ----------------------------------------------------------------------------------------------------------------------------------------------

_CODES = "codes AS (SELECT p_partkey AS snp_id, CASE p_size % 6 WHEN 0 THEN 'X' WHEN 1 THEN 'chr7' WHEN 2 THEN 'MT' WHEN 3 THEN '23' WHEN 4 THEN NULL ELSE '22' END AS chromosome, p_partkey * 10 AS position FROM part)"


def _codes(t):
    s = F.col("p_size") % 6
    return t("part").select(F.col("p_partkey").alias("snp_id"), F.when(s == 0, "X").when(s == 1, "chr7").when(s == 2, "MT").when(s == 3, "23").when(s == 5, "22").alias("chromosome"), (F.col("p_partkey") * 10).alias("position"))


@query("WITH " + _CODES + " SELECT snp_id, chromosome FROM codes WHERE chromosome IN ('X', 'chr7', '22')")
def canonical_chromosomes(v, t):
    return lookups.canonical(_codes(t)).select("snp_id", "chromosome")


@query("WITH " + _CODES + " SELECT snp_id, chromosome FROM codes WHERE chromosome IS NOT NULL")
def known_risk_allele(v, t):
    return lookups.known_allele(_codes(t), "chromosome").select("snp_id", "chromosome")


@query("WITH " + _CODES + " SELECT snp_id, CASE WHEN c.chromosome IS NULL THEN CAST(p_size AS VARCHAR) ELSE c.chromosome END AS chromosome, CASE WHEN c.chromosome IS NULL THEN p_partkey + 7 ELSE position END AS position FROM codes c JOIN part ON snp_id = p_partkey")
def salvage_places(v, t):
    return lookups.salvage(_codes(t), t("part").select(F.col("p_partkey").alias("snp_id"), F.col("p_size").cast("string").alias("chromosome"), (F.col("p_partkey") + 7).alias("position")))


@query("SELECT w.snp_id, weight FROM weights w SEMI JOIN variants USING (snp_id) SEMI JOIN variants2 USING (snp_id)", "weights", "variants", "variants2")
def common_to_all(v, t):
    return lookups.in_all(v("weights"), v("variants"), v("variants2"))


@query("SELECT a.chromosome, a.position, min(b.snp_id) AS snp_id FROM variants2 a LEFT JOIN variants b ON a.chromosome = b.chromosome AND a.position = b.position GROUP BY a.snp_id, a.chromosome, a.position", "variants", "variants2")
def ids_by_place(v, t):
    return lookups.ids_by_place(v("variants2").select("chromosome", "position"), v("variants"))


@query("SELECT w.snp_id, coalesce(CAST(chromosome AS VARCHAR), 'Z') AS chromosome, coalesce(position, 1) AS position FROM weights w LEFT JOIN variants v USING (snp_id)", "weights", "variants")
def places_by_id(v, t):
    return lookups.places_by_id(v("weights").select("snp_id"), v("variants"))


_ASSOCIATIONS = "associations AS (SELECT l_partkey % 400 AS snp_id, concat('trait', l_suppkey % 7) AS trait FROM lineitem WHERE l_linenumber > 2)"


def _associations(t):
    return t("lineitem").where("l_linenumber > 2").select((F.col("l_partkey") % 400).alias("snp_id"), F.concat(F.lit("trait"), F.col("l_suppkey") % 7).alias("trait"))


@query("WITH " + _ASSOCIATIONS + " SELECT snp_id, string_agg(trait, ', ' ORDER BY trait) AS trait FROM (SELECT DISTINCT snp_id, trait FROM associations) x GROUP BY snp_id")
def collapsed_traits(v, t):
    return lookups.collapsed(_associations(t), "snp_id", "trait")


@query(_sql([_ASSOCIATIONS, "hits AS (SELECT snp_id, gene FROM variants JOIN genes ON variants.chromosome = genes.chromosome AND position BETWEEN start_pos AND end_pos)"], """SELECT w.snp_id, weight, trait, gene FROM weights w
  JOIN (SELECT snp_id, string_agg(trait, ', ' ORDER BY trait) AS trait FROM (SELECT DISTINCT snp_id, trait FROM associations) x GROUP BY snp_id) a ON w.snp_id = a.snp_id
  LEFT JOIN (SELECT snp_id, string_agg(gene, ', ' ORDER BY gene) AS gene FROM (SELECT DISTINCT snp_id, gene FROM hits) y GROUP BY snp_id) g ON w.snp_id = g.snp_id""", "weights", "variants", "genes"))  # fmt: skip
def candidate_evidence(v, t):
    hits = intervals.overlaps(v("variants"), v("genes"), "position", "start_pos", "end_pos").select("snp_id", "gene")
    return lookups.evidence(v("weights"), _associations(t), hits)


@query("SELECT p_brand, p_partkey FROM part QUALIFY count(*) OVER (PARTITION BY p_brand) > 1")
def repeated_keys(v, t):
    return lookups.with_repeats(t("part").select("p_brand", "p_partkey"), "p_brand", ["p_partkey"])


@query("SELECT iteration, snp_id, CASE WHEN method = 1 THEN 'plink' ELSE 'glm' END AS method, CASE WHEN method = 1 THEN beta ELSE 0 - beta END AS effect FROM picks", "picks")
def effect_signs(v, t):
    p = v("picks").select("iteration", "snp_id", F.when(F.col("method") == 1, "plink").otherwise("glm").alias("method"), F.col("beta").alias("effect"))
    return rounded(lookups.oriented(p))


# ---- coding ------------------------------------------------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber BETWEEN 1 AND 3 THEN CAST(l_linenumber - 1 AS INT) END AS dosage FROM lineitem")
def wrap_codes(v, t):
    return t("lineitem").select("l_orderkey", "l_linenumber", recode.wrapped(F.col("l_linenumber")).alias("dosage"))


@query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber = 7 THEN 0 ELSE round(l_discount * 20 * CAST(1 AS DOUBLE)) END + CASE WHEN l_linenumber = 7 THEN 0 ELSE 1 END AS INT) AS code FROM lineitem WHERE l_discount * 20 <= 2")
def integer_snap(v, t):
    value = F.when(F.col("l_linenumber") != 7, F.col("l_discount") * 20)
    return t("lineitem").where("l_discount * 20 <= 2").select("l_orderkey", "l_linenumber", recode.snapped(value).alias("code"))


@query("SELECT sample_id, snp_id, dosage - 1 AS dosage FROM gt", "gt")
def centred_codes(v, t):
    return recode.centred(v("gt"))


@query("SELECT c_custkey, c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) AS INT) AS code FROM customer")
def factor_codes(v, t):
    return recode.factor_codes(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query("SELECT * FROM (VALUES ('trait', 'P'), ('cc', 'B'), ('cov1', (SELECT CASE WHEN count(DISTINCT cov1) <= 10 THEN 'D' ELSE 'C' END FROM pheno)), ('cov2', (SELECT CASE WHEN count(DISTINCT cov2) <= 10 THEN 'D' ELSE 'C' END FROM pheno))) x(name, type)", "pheno")
def header_types(v, t):
    return recode.column_types(v("pheno").select("trait", "cc", "cov1", "cov2"), ["trait", "cc"])


@query("SELECT 'cc' AS response, CAST(count(DISTINCT cc) AS BIGINT) AS levels, count(DISTINCT cc) <= 2 AS \"binary\" FROM pheno UNION ALL SELECT 'trait', CAST(count(DISTINCT trait) AS BIGINT), count(DISTINCT trait) <= 2 FROM pheno", "pheno")
def binary_responses(v, t):
    return evaluation.union_all([recode.is_binary(v("pheno"), c).select(F.lit(c).alias("response"), "*") for c in ("cc", "trait")])


@query("""SELECT c_nationkey, c_acctbal, round((r - 0.5::DOUBLE) / (max(r) OVER (PARTITION BY c_nationkey) + 0.5::DOUBLE), 6) AS u FROM (SELECT c_nationkey, c_acctbal,
  rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_nationkey, c_acctbal) - 1) / 2.0::DOUBLE AS r FROM customer) x""")  # fmt: skip
def rank_positions(v, t):
    return rounded(recode.rank_position(t("customer").select("c_nationkey", "c_acctbal"), "c_nationkey", "c_acctbal"))


@query("SELECT sample_id" + "".join(f", max(CASE WHEN snp_id = {i} THEN dosage END) AS s{i}" for i in range(40)) + " FROM gt GROUP BY sample_id", "gt")
def wide_export(v, t):
    return recode.wide(v("gt"), list(range(40)))


@query("SELECT c_custkey AS sample_id, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END, CAST(c_nationkey % 2 + 1 AS DOUBLE)) AS phenotype FROM customer")
def phenotype_choice(v, t):
    named = F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal"))
    return t("customer").select(F.col("c_custkey").alias("sample_id"), F.coalesce(named, (F.col("c_nationkey") % 2 + 1).cast("double")).alias("phenotype"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INT) AS elapsed FROM orders")
def date_text(v, t):
    return t("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).alias("elapsed"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, concat('{\"type\":\"', event_type, '\"}') AS written FROM events")
def json_fields(v, t):
    return t("events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.to_json(F.struct(F.col("event_type").alias("type"))).alias("written"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '0.05' END AS maf, 'basic' AS mode FROM part")
def option_overlay(v, t):
    given = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("maf"), F.col("p_size").cast("string"))).otherwise(F.expr("map()").cast("map<string,string>"))
    defaults = F.create_map(F.lit("maf"), F.lit("0.05"), F.lit("mode"), F.lit("basic"))
    options = F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key("given", k)), F.col("given"))
    return t("part").withColumn("given", given).withColumn("options", options).select("p_partkey", F.col("options")["maf"].alias("maf"), F.col("options")["mode"].alias("mode"))


# ---- score files -------------------------------------------------------------------------------------------------------------------------------------------


def _methods(v):
    return v("picks").groupBy("snp_id", "method").agg(F.min("beta").alias("beta")).where("beta <> 0").withColumn("method", F.col("method").cast("long"))


_METHODS = "methods AS (SELECT snp_id, CAST(method AS BIGINT) AS method, min(beta) AS beta FROM picks GROUP BY 1, 2 HAVING min(beta) <> 0)"


@query(_sql([_METHODS], "SELECT v.snp_id, k.method, coalesce(beta, 0) AS beta FROM variants2 v CROSS JOIN (SELECT DISTINCT method FROM methods) k LEFT JOIN methods m ON m.snp_id = v.snp_id AND m.method = k.method", "picks", "variants2"))
def betas_zero_filled(v, t):
    return scoring.zero_filled(v("variants2"), _methods(v))


_LEAST_P = "least_p AS (SELECT snp_id, min(p) AS p FROM pvals GROUP BY snp_id)"
_FIRST = "firsts AS (SELECT snp_id, arg_min(beta, method) AS effect FROM methods GROUP BY snp_id)"


def _least_p(v):
    return v("pvals").groupBy("snp_id").agg(F.min("p").alias("p"))


@query(_sql([_METHODS, _LEAST_P, _FIRST], "SELECT snp_id, p, effect FROM least_p JOIN firsts USING (snp_id) WHERE p <= 0.02", "picks", "pvals"))
def extract_markers(v, t):
    return scoring.extracted(_least_p(v), _methods(v).select("snp_id", F.col("beta").alias("effect"), F.col("method").alias("priority")), 0.02)


@query(_sql([_LEAST_P], """SELECT chromosome AS "CHR", position AS "BP", v.snp_id AS "SNP", allele_a AS "A1", allele_b AS "A2", weight AS "BETA", p AS "P", 0.5::DOUBLE AS "MAF", 1.0::DOUBLE AS "INFO", (SELECT CAST(count(*) AS BIGINT) FROM customer) AS "N"
  FROM variants v JOIN weights w ON v.snp_id = w.snp_id JOIN least_p l ON l.snp_id = v.snp_id""", "variants", "weights", "pvals"))  # fmt: skip
def base_files(v, t):
    return scoring.base_file(v("variants"), v("weights").withColumnRenamed("weight", "effect"), _least_p(v), t("customer").agg(F.count(F.lit(1)).alias("n")))


@query(_sql([_SETS.format(k=1)], """SELECT CAST(chromosome AS VARCHAR) AS chromosome, position, v.snp_id AS variant_id, allele_b AS risk_allele, allele_a AS reference_allele, CAST(NULL AS VARCHAR) AS locus_name, weight AS effect_weight, round(exp(weight), 6) AS "OR", 'hg19' AS asm, freq
  FROM freqs JOIN weights w USING (snp_id) JOIN variants v ON v.snp_id = w.snp_id""", "picks", "weights", "variants"))  # fmt: skip
def published_scores(v, t):
    chosen = resampling.marker_frequencies(v("picks"), "union", 2, 0.0).join(v("weights").withColumnRenamed("weight", "effect"), "snp_id")
    return rounded(scoring.score_file(chosen, v("variants"), "hg19"))


@query(_sql([_SETS.format(k=1)], "SELECT snp_id, freq FROM freqs WHERE freq >= 15", "picks"))
def minimum_frequency(v, t):
    return resampling.frequent(resampling.marker_frequencies(v("picks"), "union", 2, 0.0), 15)


@query("SELECT snp_id, p, row_number() OVER (ORDER BY p, snp_id) AS rank FROM (SELECT snp_id, min(p) AS p FROM pvals GROUP BY snp_id) x", "pvals")
def ranked_markers(v, t):
    return ranking.ranked(_least_p(v), F.col("p"), "snp_id")


# ---- resampling and evaluation -----------------------------------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT c_custkey AS sample_id, row_number() OVER (ORDER BY c_custkey) AS rank, count(*) OVER () AS n FROM customer), d AS (SELECT iteration, draw, (a * a * 31 + a * 17 + iteration * 613) % 1000003 AS r FROM (
  SELECT i AS iteration, k AS draw, (k * 7919 + i * 104729 + 12345) % 1000003 AS a FROM (SELECT unnest(range(1, 4)) AS i) x, (SELECT unnest(range(1, 101)) AS k) y) z)
  SELECT iteration, draw, sample_id FROM d JOIN s ON s.rank = d.r % s.n + 1""")  # fmt: skip
def draws_with_replacement(v, t):
    samples = t("customer").select(F.col("c_custkey").alias("sample_id"))
    return resampling.with_replacement(ranking.ranked(samples, F.col("sample_id")), 3, 100, samples.count())


@query("""SELECT CAST(leave_out AS DOUBLE) AS leave_out, rep, CASE WHEN k <= ceil(n * (1 - leave_out)) THEN 'train' ELSE 'test' END AS part, CAST(count(*) AS BIGINT) AS n, CAST(sum(sample_id) AS BIGINT) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY r, sample_id) AS k, count(*) OVER (PARTITION BY rep) AS n FROM (
  SELECT sample_id, CAST(rep AS INT) AS rep, (a * a * 31 + a * 17 + rep * 613) % 1000003 AS r FROM (SELECT c_custkey AS sample_id, rep, (c_custkey * 7919 + rep * 104729 + 12345) % 1000003 AS a FROM customer, (SELECT unnest(range(1, 4)) AS rep) x) y) z) w,
  (SELECT unnest([0.1, 0.25, 0.4]::DOUBLE[]) AS leave_out) l GROUP BY 1, 2, 3""")  # fmt: skip
def leave_out_grid(v, t):
    g = resampling.grid_splits(t("customer").select(F.col("c_custkey").alias("sample_id")), [0.1, 0.25, 0.4], 3)
    return g.groupBy("leave_out", "rep", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("sample_id").alias("ids"))


@query("SELECT cut, rep, reduced_r2 FROM (SELECT *, row_number() OVER (PARTITION BY cut ORDER BY (a * a * 31 + a * 17 + 613) % 1000003, rep) AS k FROM (SELECT *, (rep * 7919 + 104729 + 12345) % 1000003 AS a FROM runs) x) y WHERE k <= 5", "runs")
def baseline_subset(v, t):
    return resampling.baseline_subset(v("runs").select("cut", "rep", "reduced_r2"), ["cut"], "rep", 5)


_FITS = """data AS (SELECT iteration, part, trait AS y, cov1 AS c, score AS s FROM raw JOIN pheno USING (sample_id) JOIN parts USING (sample_id)),
  moments AS (SELECT iteration, count(*) AS n, avg(y) AS my, avg(c) AS mc, avg(s) AS ms, var_pop(c) AS cc, var_pop(s) AS ss, var_pop(y) AS yy, covar_pop(c, s) AS cs, covar_pop(c, y) AS cy, covar_pop(s, y) AS sy FROM data WHERE part = 'train' GROUP BY iteration),
  fits AS (SELECT *, cy / cc AS rb, (cy * ss - sy * cs) / (cc * ss - cs * cs) AS fc, (sy * cc - cy * cs) / (cc * ss - cs * cs) AS fs FROM moments),
  told AS (SELECT iteration, y, my + rb * (c - mc) AS r, my + fc * (c - mc) + fs * (s - ms) AS f, rb * cy / yy AS reduced_r2, (fc * cy + fs * sy) / yy AS full_r2, n FROM data JOIN fits USING (iteration) WHERE part = 'test')"""


@query(_sql([_RAW, _DRAW, _FITS], """SELECT iteration, round(any_value(reduced_r2), 5) AS reduced_r2, round(any_value(full_r2), 5) AS full_r2, round(any_value(full_r2 - reduced_r2), 5) AS prs_r2, round(any_value((full_r2 - reduced_r2) / ((1 - full_r2) / (n - 3))), 4) AS prs_f,
  round(sqrt(avg((y - r) * (y - r))), 4) AS reduced_rmse, round(avg(abs(y - r)), 4) AS reduced_mae, round(corr(y, r), 5) AS reduced_pred_cor, round(sqrt(avg((y - f) * (y - f))), 4) AS full_rmse, round(avg(abs(y - f)), 4) AS full_mae, round(corr(y, f), 5) AS full_pred_cor,
  round(corr(y, r) * corr(y, r), 5) AS reduced_pred_r2, round(corr(y, f) * corr(y, f), 5) AS full_pred_r2, round(corr(y, f) * corr(y, f) - corr(y, r) * corr(y, r), 5) AS prs_pred_r2 FROM told GROUP BY iteration""", "gt", "weights", "pheno"))  # fmt: skip
def cv_all_metrics(v, t):
    data = scoring.score(v("gt"), v("weights")).join(v("pheno"), "sample_id").join(_parts(t), "sample_id")
    out = evaluation.cross_validate_full(data, ["iteration"], "trait", "cov1", "score")
    coarse = {c for c in out.columns if c.endswith(("rmse", "mae")) or c == "prs_f"}
    return out.select("iteration", *[(F.round(c, 4 if c in coarse else 5) + F.lit(0.0)).alias(c) for c in out.columns if c != "iteration"])


@query()
def cv_pvalues(v, t):
    data = scoring.score(v("gt"), v("weights")).join(v("pheno"), "sample_id").join(_parts(t), "sample_id")
    n = data.where("part = 'train'").groupBy("iteration").agg((F.count(F.lit(1)) - 3).alias("df"))
    return rounded(evaluation.with_p(evaluation.cross_validate_full(data, ["iteration"], "trait", "cov1", "score").join(n, "iteration"), "prs_f", 1, "df").select("iteration", "prs_f", "prs_pvalue"))


@query(_sql([_RAW], "SELECT CAST(cc AS BIGINT) AS cc, round(n * (ln(2 * pi() * syy * (1 - r2) / n) + 1) + 6, 3) AS aic FROM (SELECT cc, count(*) AS n, regr_syy(trait, score) AS syy, regr_r2(trait, score) AS r2 FROM raw JOIN pheno USING (sample_id) GROUP BY cc) x", "gt", "weights", "pheno"))
def model_aic(v, t):
    data = scoring.score(v("gt"), v("weights")).join(v("pheno"), "sample_id").withColumn("cc", F.col("cc").cast("long"))
    return rounded(evaluation.aic(data, ["cc"], "trait", "score"), 3)


@query("SELECT idx, round(sqrt(r2 / ln(n_snp::DOUBLE)), 6) AS value FROM series WHERE n_snp > 1", "series")
def criterion_series(v, t):
    return rounded(evaluation.criterion(v("series").where("n_snp > 1"), "idx", "adjusted"))


@query(_sql([_MAXIMA], "SELECT idx, r2 FROM maxima WHERE r2 > (SELECT avg(r2) FROM series)", "series"))
def maxima_above_baseline(v, t):
    return evaluation.above_baseline(evaluation.local_maxima(v("series"), "r2"), "r2", v("series"), "r2")


_WELCH = "welch AS (SELECT cut, (mx - my) / sqrt(a + b) AS t, power(a + b, 2) / (a * a / (n - 1) + b * b / (n - 1)) AS df FROM (SELECT cut, avg(full_r2) AS mx, avg(reduced_r2) AS my, var_samp(full_r2) / count(*) AS a, var_samp(reduced_r2) / count(*) AS b, count(*) AS n FROM runs GROUP BY cut) x WHERE n > 1)"
_STATISTICS = ", ".join(f"round({f}({x}), 6) AS {m}_{n}" for x, m in (("full_r2", "full"), ("reduced_r2", "reduced"), ("full_r2 - reduced_r2", "gain")) for f, n in (("avg", "mean"), ("stddev_samp", "sd"), ("min", "min"), ("max", "max")))


@query(_sql([_WELCH], f"SELECT cut, {_STATISTICS}, round(avg(CASE WHEN full_r2 < reduced_r2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS p, round(any_value(t), 6) + 0 AS t, round(any_value(df), 6) AS df FROM runs JOIN welch USING (cut) GROUP BY cut", "runs"))
def cv_summary(v, t):
    return rounded(evaluation.cv_summary(v("runs"), "cut", "full_r2", "reduced_r2"))


@query("SELECT cut, concat(printf('%.3f (%.3f)', avg(full_r2), stddev_samp(full_r2)), CASE WHEN avg(CASE WHEN full_r2 < reduced_r2 THEN 1.0::DOUBLE ELSE 0 END) < 0.05 THEN ' *' ELSE '' END) AS line FROM runs GROUP BY cut HAVING count(*) > 1", "runs")
def summary_text(v, t):
    return evaluation.report(evaluation.cv_summary(v("runs"), "cut", "full_r2", "reduced_r2"), "cut", "full_mean", "full_sd", "p")


@query("SELECT rep, " + ", ".join(f"max(CASE WHEN cut = {k} THEN full_r2 END) AS cut_{k}" for k in range(5)) + " FROM runs WHERE cut < 5 GROUP BY rep", "runs")
def runs_by_cut(v, t):
    return v("runs").where("cut < 5").groupBy("rep").pivot("cut", list(range(5))).agg(F.max("full_r2")).select("rep", *[F.col(str(k)).alias(f"cut_{k}") for k in range(5)])


@query(_sql([_BETAS, _SETS.format(k=1)], "SELECT b.iteration, CAST(count(*) AS BIGINT) AS n_snp, (b.iteration + 1) / 40.0::DOUBLE AS r2p FROM betas b JOIN sets s USING (iteration, snp_id) GROUP BY b.iteration", "picks"))
def iteration_baseline(v, t):
    sets = resampling.marker_sets(v("picks"), "union", 2)
    betas = v("picks").groupBy("iteration", "snp_id").agg(F.sum("beta").alias("beta"))
    return betas.join(sets, ["iteration", "snp_id"]).groupBy("iteration").agg(F.count(F.lit(1)).alias("n_snp")).withColumn("r2p", (F.col("iteration") + 1) / F.lit(40.0))


# ---- merging, components -----------------------------------------------------------------------------------------------------------------------------------


@query(_sql([_COMPARED, "votes AS (SELECT a1 AS allele, state IN ('swap', 'flip_swap', 'ambiguous') AS turned FROM compared WHERE state <> 'bad')"], "SELECT allele, CAST(sum(CASE WHEN turned THEN 1 ELSE 0 END) AS BIGINT) AS turned, CAST(count(*) AS BIGINT) AS n, sum(CASE WHEN turned THEN 1 ELSE 0 END) * 2 > count(*) AS majority FROM votes GROUP BY allele", "variants", "variants2"))
def allele_votes(v, t):
    return merging.votes(merging.compare(v("variants"), v("variants2")), "a1").withColumnRenamed("a1", "allele")


@query(_sql([_COMPARED], """SELECT snp_id, CASE WHEN c.chromosome = c.chromosome2 THEN c.chromosome ELSE w.chromosome END AS chromosome, CASE WHEN c.position = c.position2 THEN c.position ELSE w.position END AS position FROM compared c
  LEFT JOIN (SELECT p_partkey AS snp_id, p_size % 22 + 1 AS chromosome, p_partkey * 1000 + p_size AS position FROM part) w USING (snp_id) WHERE state <> 'bad'""", "variants", "variants2"))  # fmt: skip
def reconciled_places(v, t):
    places = t("part").select(F.col("p_partkey").alias("snp_id"), (F.col("p_size") % 22 + 1).alias("chromosome"), (F.col("p_partkey") * 1000 + F.col("p_size")).alias("position"))
    return merging.reconciled(merging.compare(v("variants"), v("variants2")), places).select("snp_id", "chromosome", "position")


_Z = "z AS (SELECT sample_id, snp_id, (dosage - m) / sd AS z FROM gt2 JOIN (SELECT snp_id, avg(dosage) AS m, stddev_samp(dosage) AS sd FROM gt2 WHERE dosage IS NOT NULL GROUP BY snp_id HAVING stddev_samp(dosage) > 0) s USING (snp_id) WHERE dosage IS NOT NULL)"


@query(_sql([_Z], "SELECT a.snp_id AS i, b.snp_id AS j, round(sum(a.z * b.z), 4) AS dot FROM z a JOIN z b ON a.sample_id = b.sample_id AND a.snp_id <= b.snp_id GROUP BY 1, 2", "gt2"))
def variant_gram(v, t):
    return rounded(relatedness.variant_gram(v("gt2")), 4)


@query()
def sample_components(v, t):
    return rounded(relatedness.sample_components(v("gt2"), 3)[0].select("sample_id", *[F.abs(f"pc{k + 1}").alias(f"pc{k + 1}") for k in range(3)]), 5)


@query()
def significant_components(v, t):
    values = relatedness.sample_components(v("gt2"), 3)[1]
    return t("nation").sparkSession.createDataFrame([(k + 1, *(round(float(x), 5) for x in row)) for k, row in enumerate(values)], "idx int, eigenvalue double, stat double, p double")


# ---- association by several methods, filling, reports -------------------------------------------------------------------------------------------------------


def _dataset(v, t):
    from ..dataset import GenoDataset

    return GenoDataset(v("gt"), v("variants").withColumn("chromosome", F.col("chromosome").cast("long")), t("customer").select(F.col("c_custkey").alias("sample_id")), v("pheno"), genome="hg19")


@query()
def gwa_combined(v, t):
    out = gwas.gwa(_dataset(v, t), "cc", methods=("glm", "allelic"), how="simes")
    return rounded(out.results.select("model", "snp_id", "method", "effect", "p"))


@query()
def gwa_logistic_covariates(v, t):
    return rounded(mixed.logistic(v("gt"), v("pheno"), "cc", ["cov1", "cov2"]), 5)


@query()
def gwa_mixed(v, t):
    return rounded(mixed.mixed(v("gt2"), v("pheno"), "trait", ["cov1"]), 4)


@query()
def gwa_permuted(v, t):
    return mixed.permutation_p(v("gt2"), v("pheno"), "trait", 99)


_RULES = """best AS (SELECT snp_id, arg_max(neighbour, (round(r2, 12), -neighbour)) AS neighbour FROM (SELECT snp1 AS snp_id, snp2 AS neighbour, r2 FROM ld UNION ALL SELECT snp2, snp1, r2 FROM ld) x WHERE r2 IS NOT NULL GROUP BY snp_id),
  rules AS (SELECT b.snp_id, b.neighbour, h.dosage AS given, CAST(floor(avg(g.dosage) + 0.5) AS INT) AS fill FROM best b JOIN gt g ON g.snp_id = b.snp_id JOIN gt h ON h.snp_id = b.neighbour AND h.sample_id = g.sample_id
  WHERE g.dosage IS NOT NULL AND h.dosage IS NOT NULL GROUP BY 1, 2, 3)"""


@query(_sql([_LD, _RULES], """SELECT g.sample_id, g.snp_id, coalesce(g.dosage, r.fill) AS dosage FROM gt g LEFT JOIN best b ON b.snp_id = g.snp_id LEFT JOIN gt h ON h.snp_id = b.neighbour AND h.sample_id = g.sample_id
  LEFT JOIN rules r ON r.snp_id = g.snp_id AND r.given = h.dosage""", "gt", "variants"))  # fmt: skip
def impute_rules(v, t):
    return imputation.impute_rules(v("gt"), _ld(v).withColumn("r2", F.round("r2", 12)))


@query("SELECT a.snp_id AS snp1, b.snp_id AS snp2, round(avg(CASE WHEN a.dosage <> b.dosage THEN 1.0::DOUBLE ELSE 0 END), 6) AS distance FROM gt a JOIN gt b ON a.sample_id = b.sample_id AND a.snp_id <> b.snp_id JOIN variants v ON v.snp_id = a.snp_id JOIN variants w ON w.snp_id = b.snp_id AND v.chromosome = w.chromosome WHERE a.dosage IS NOT NULL AND b.dosage IS NOT NULL GROUP BY 1, 2", "gt", "variants")
def chromosome_distance(v, t):
    return rounded(imputation.by_chromosome(v("gt"), v("variants")))


_OUT = """centre AS (SELECT quantile_cont(cov1, 0.5) AS m1, quantile_cont(trait, 0.5) AS m2 FROM pheno), away AS (SELECT sample_id, abs(cov1 - m1) AS d1, abs(trait - m2) AS d2 FROM pheno, centre),
  spread AS (SELECT quantile_cont(d1, 0.5) * 1.4826::DOUBLE AS s1, quantile_cont(d2, 0.5) * 1.4826::DOUBLE AS s2 FROM away)"""


@query(_sql([_OUT], "SELECT sample_id, round(sqrt(power(d1 / s1, 2) + power(d2 / s2, 2)), 6) AS distance FROM away, spread WHERE sqrt(power(d1 / s1, 2) + power(d2 / s2, 2)) > 1.7", "pheno"))
def robust_outliers(v, t):
    return rounded(cleaning.robust_outliers(v("pheno").select("sample_id", "cov1", "trait"), ["cov1", "trait"], 1.7))


@query("SELECT CAST(CASE WHEN trait < 0 THEN 0 WHEN trait >= 9000 THEN 10 ELSE floor(trait / 1000) + 1 END AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM pheno GROUP BY 1", "pheno")
def trait_histogram(v, t):
    return reporting.histogram(v("pheno"), "trait", 0.0, 9000.0, 9)


@query("SELECT cut, CAST(count(*) AS BIGINT) AS n, " + ", ".join(f"round(quantile_cont(full_r2, {q}), 6) AS q{int(100 * q)}" for q in (0.0, 0.25, 0.5, 0.75, 1.0)) + " FROM runs GROUP BY cut", "runs")
def cut_quartiles(v, t):
    return rounded(reporting.quartiles(v("runs"), "cut", "full_r2"))


@query("SELECT cut, printf('%.2f ± %.2f', avg(full_r2), stddev_samp(full_r2)) AS full_r2, printf('%.2f ± %.2f', avg(reduced_r2), stddev_samp(reduced_r2)) AS reduced_r2 FROM runs WHERE cut IN (SELECT cut FROM runs GROUP BY cut HAVING count(*) > 1) GROUP BY cut", "runs")
def report_table(v, t):
    more = v("runs").groupBy("cut").count().where("count > 1").select("cut")
    return reporting.mean_and_sd(v("runs").join(more, "cut", "left_semi"), "cut", ["full_r2", "reduced_r2"])


_KNOWN = "known AS (SELECT snp_id, 'hg19' AS asm, chromosome, position FROM variants UNION ALL SELECT snp_id, 'hg38', chromosome, position + 5 FROM variants WHERE snp_id % 2 = 0)"


def _known(v):
    one = v("variants").select("snp_id", F.lit("hg19").alias("asm"), "chromosome", "position")
    return one.unionByName(one.where("snp_id % 2 = 0").select("snp_id", F.lit("hg38").alias("asm"), "chromosome", (F.col("position") + 5).alias("position")))


@query(_sql([_KNOWN], "SELECT v.snp_id, 'hg19' AS asm, v.chromosome, v.position FROM variants2 v ANTI JOIN (SELECT * FROM known WHERE asm = 'hg19') k ON v.snp_id = k.snp_id AND v.chromosome = k.chromosome AND v.position = k.position", "variants", "variants2"))
def wrong_places(v, t):
    return reporting.wrong_places(v("variants2").select("snp_id", F.lit("hg19").alias("asm"), "chromosome", "position"), _known(v))


@query(_sql([_KNOWN], "SELECT asm, CAST(count(DISTINCT v.snp_id) AS BIGINT) AS hits, round(count(DISTINCT v.snp_id) / (SELECT count(*) FROM variants2)::DOUBLE, 6) AS share FROM variants2 v JOIN known k ON v.snp_id = k.snp_id AND v.chromosome = k.chromosome AND v.position = k.position GROUP BY asm", "variants", "variants2"))
def guessed_assembly(v, t):
    return rounded(reporting.guessed_assembly(v("variants2").select("snp_id", "chromosome", "position"), _known(v)))


@query(_sql([_ASSOCIATIONS], "SELECT DISTINCT a.snp_id, trait, allele_b AS risk_allele, v.chromosome, v.position FROM associations a JOIN variants2 w ON a.snp_id = w.snp_id JOIN variants v ON v.snp_id = a.snp_id WHERE allele_b2 <> 'T'".replace("allele_b AS", "w.allele_b AS").replace("allele_b2", "w.allele_b"), "variants", "variants2"))
def catalogue_variants(v, t):
    a = _associations(t).join(v("variants2").select("snp_id", F.when(F.col("allele_b") == "T", "?").otherwise(F.col("allele_b")).alias("risk_allele")), "snp_id")
    return reporting.catalogued([a.where("snp_id % 2 = 0"), a], v("variants"))


@query(_sql([_RAW, "seen AS (SELECT regr_r2(trait, score) AS r2 FROM raw JOIN pheno USING (sample_id))"], "SELECT CAST((SELECT count(*) FROM weights SEMI JOIN variants2 USING (snp_id)) AS BIGINT) AS n_covered, round(r2, 6) AS r2 FROM seen", "gt", "weights", "variants2", "pheno"))
def applied_score(v, t):
    out = reporting.apply_score(v("gt"), v("variants2"), v("pheno"), v("weights"), "trait", "cov1")
    r2 = evaluation.score_r2(out["scores"].withColumn("rep", F.lit(0)), v("pheno"), ["rep"], "trait")
    return rounded(out["coverage"].select("n_covered").join(F.broadcast(r2.select("r2"))))
