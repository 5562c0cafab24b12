"""Genotype tables derived from star-schema tables: the same views in DataFrame form and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# One rule each; the DataFrame functions below compile these very strings, so both engines read the same definition.
VIEWS = {
    "gt": """SELECT o_custkey AS sample_id, l_partkey % 40 AS snp_id,
        CASE WHEN min(l_linenumber) = 7 THEN NULL ELSE CAST(min(l_linenumber) % 3 AS INT) END AS dosage
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey % 40""",
    "gt2": """SELECT l_suppkey AS sample_id, l_partkey % 60 AS snp_id,
        CASE WHEN min(l_linenumber) = 7 THEN NULL ELSE CAST(min(l_linenumber) % 3 AS INT) END AS dosage
        FROM lineitem GROUP BY l_suppkey, l_partkey % 60""",
    "variants": """SELECT p_partkey AS snp_id, p_size % 22 + 1 AS chromosome, p_partkey * 1000 + p_size AS position,
        substr('ACGT', CAST(p_size % 4 + 1 AS INT), 1) AS allele_a, substr('ACGT', CAST((p_size + 1 + p_partkey % 3) % 4 + 1 AS INT), 1) AS allele_b
        FROM part WHERE p_partkey < 40""",
    "variants2": """SELECT snp_id, chromosome, CASE WHEN snp_id % 11 = 0 THEN position + 5 ELSE position END AS position,
        CASE WHEN snp_id % 5 = 0 THEN translate(a, 'ACGT', 'TGCA') WHEN snp_id % 7 = 0 THEN b WHEN snp_id % 13 = 0 THEN b ELSE a END AS allele_a,
        CASE WHEN snp_id % 5 = 0 THEN translate(b, 'ACGT', 'TGCA') WHEN snp_id % 7 = 0 THEN a ELSE b END AS allele_b
        FROM (SELECT p_partkey AS snp_id, p_size % 22 + 1 AS chromosome, p_partkey * 1000 + p_size AS position,
              substr('ACGT', CAST(p_size % 4 + 1 AS INT), 1) AS a, substr('ACGT', CAST((p_size + 1 + p_partkey % 3) % 4 + 1 AS INT), 1) AS b
              FROM part WHERE p_partkey < 60) v""",
    "pheno": """SELECT c_custkey AS sample_id, c_acctbal AS trait, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END AS cc,
        CAST(c_nationkey AS DOUBLE) AS cov1, CAST(length(c_mktsegment) AS DOUBLE) AS cov2 FROM customer""",
    "weights": "SELECT p_partkey AS snp_id, CAST(p_size - 25 AS DOUBLE) / CAST(100 AS DOUBLE) AS weight FROM part WHERE p_partkey < 50",
    "genes": """SELECT concat(n_name, '_', chromosome) AS gene, chromosome, CAST(n_nationkey AS BIGINT) * 1600 + chromosome * 10 AS start_pos, CAST(n_nationkey AS BIGINT) * 1600 + chromosome * 10 + 900 AS end_pos
        FROM nation CROSS JOIN (SELECT DISTINCT p_size % 22 + 1 AS chromosome FROM part) c""",
    "picks": """SELECT DISTINCT l_suppkey % 20 AS iteration, l_partkey % 40 AS snp_id, l_linenumber % 2 AS method,
        CAST(((l_suppkey % 20) * 7 + (l_partkey % 40) * 3 + (l_linenumber % 2) * 5) % 11 - 5 AS DOUBLE) / CAST(10 AS DOUBLE) AS beta FROM lineitem""",
    "series": """SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS idx, CAST(count(*) AS BIGINT) AS n_snp,
        round(CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) / count(*) / CAST(1000000 AS DOUBLE), 9) AS r2 FROM orders GROUP BY year(o_orderdate) * 12 + month(o_orderdate)""",
    "pvals": """SELECT l_partkey % 400 AS snp_id, l_linenumber AS method, CAST(1 + (min(l_orderkey) * 37 + l_linenumber * 101) % 9973 AS DOUBLE) / CAST(10007 AS DOUBLE) AS p
        FROM lineitem GROUP BY l_partkey % 400, l_linenumber""",
    "runs": """SELECT c_nationkey AS cut, c_custkey AS rep, CAST(1 + (c_custkey * 7919) % 1009 AS DOUBLE) / CAST(1013 AS DOUBLE) AS full_r2,
        CAST(1 + (c_custkey * 104729) % 1013 AS DOUBLE) / CAST(1019 AS DOUBLE) AS reduced_r2 FROM customer""",
    "chain": """SELECT CAST(n_nationkey AS BIGINT) * 100 + chromosome AS block, chromosome, CAST(n_nationkey AS BIGINT) * 2000 AS from_start, CAST(n_nationkey AS BIGINT) * 2000 + 1500 AS from_end,
        CASE WHEN n_nationkey % 5 = 0 THEN chromosome + 1 ELSE chromosome END AS to_chromosome, CAST(n_nationkey AS BIGINT) * 2100 + 77 AS to_start
        FROM nation CROSS JOIN (SELECT DISTINCT p_size % 22 + 1 AS chromosome FROM part) c""",
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels")


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view; only the tables that its rule names are read."""
    sql = VIEWS[name]
    used = [t for t in BASE if f"FROM {t}" in sql or f"JOIN {t}" in sql]
    return spark.sql(_bound(sql, used), **{t: source(spark, sf_dir, t) for t in used})


def _bound(sql: str, tables: list[str]) -> str:
    for t in tables:
        for verb in ("FROM", "JOIN"):
            sql = sql.replace(f"{verb} {t}", f"{verb} {{{t}}}")
    return sql


def with_views(sql: str, *names: str) -> str:
    """DuckDB text: `sql` after the named views."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + " " + sql
