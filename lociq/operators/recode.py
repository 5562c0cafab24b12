"""Coding of genotypes, factors and column types."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEW = 10  # distinct whole numbers that still make a discrete column


def wrapped(raw: Column) -> Column:
    """Dosage of a raw code: 1, 2, 3 are 0, 1, 2 copies, 0 is missing; other codes are an error in the data and become missing, too."""
    return F.when(raw.between(1, 3), raw - 1).cast("int")


def unwrapped(dosage: Column) -> Column:
    """Raw code of a dosage; missing is 0."""
    return F.coalesce(dosage + 1, F.lit(0)).cast("int")


def snapped(value: Column) -> Column:
    """The raw code that a fractional dosage is nearest to; missing is 0."""
    return unwrapped(F.when(value.isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(2.0), value)))).cast("int"))


def centred(genotypes: DataFrame) -> DataFrame:
    """Dosages 0, 1, 2 as -1, 0, 1."""
    return genotypes.withColumn("dosage", (F.col("dosage") - 1).cast("int"))


def factor_codes(rows: DataFrame, column: str) -> DataFrame:
    """rows with `code`: 1 for the first value in order, and so on; null stays null. The window runs over distinct values only."""
    levels = rows.select(column).where(F.col(column).isNotNull()).distinct().withColumn("code", F.row_number().over(Window.orderBy(column)))
    return rows.join(levels, column, "left")


def column_types(rows: DataFrame, phenotypes: list[str]) -> DataFrame:
    """name, type of each column: B for a phenotype of two values, P for other phenotypes, D for a discrete covariate (text, or at most FEW whole numbers), C for a continuous one."""
    kinds = dict(rows.dtypes)
    whole = lambda c: F.lit(True) if kinds[c] in ("int", "bigint", "smallint", "tinyint", "boolean") else F.coalesce(F.min((F.col(c) == F.floor(c)).cast("int")) == 1, F.lit(True))
    stats = rows.agg(*[F.struct(F.countDistinct(c).alias("n"), (F.lit(False) if kinds[c] == "string" else whole(c)).alias("whole")).alias(c) for c in rows.columns])

    def kind(c: str) -> Column:
        n = F.col(f"{c}.n")
        if c in phenotypes:
            return F.when(n <= 2, "B").otherwise("P")
        return F.lit("D") if kinds[c] == "string" else F.when(F.col(f"{c}.whole") & (n <= FEW), "D").otherwise("C")

    return stats.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), kind(c).alias("type")) for c in rows.columns])).alias("x")).select("x.name", "x.type")


def is_binary(rows: DataFrame, column: str) -> DataFrame:
    """One row: levels, and whether a response is binary (two values at most). More levels are for the caller to refuse."""
    return rows.agg(F.countDistinct(column).alias("levels"), (F.countDistinct(column) <= 2).alias("binary"))


def rank_position(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, value, u = (rank - 0.5) / (greatest rank + 0.5) with ties at their mean rank, within each group."""
    mean_rank = F.rank().over(Window.partitionBy(by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(by, value)) - 1) / 2.0
    ranked = rows.where(F.col(value).isNotNull()).withColumn("_r", mean_rank)
    return ranked.withColumn("u", (F.col("_r") - 0.5) / (F.max("_r").over(Window.partitionBy(by)) + 0.5)).drop("_r")


def rank_normal(rows: DataFrame, by: str, value: str) -> DataFrame:
    """rank_position() with z, the normal quantile of u."""

    def quantile(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        inverse = NormalDist().inv_cdf
        for u in batches:
            yield u.map(inverse)

    return rank_position(rows, by, value).withColumn("z", F.pandas_udf(quantile, "double")("u"))


def wide(genotypes: DataFrame, variants: list[int], raw: bool = False) -> DataFrame:
    """One row a sample and a column s<id> for each listed variant; the list fixes the schema, so no pass looks for it."""
    cell = unwrapped(F.col("dosage")) if raw else F.col("dosage")
    return genotypes.where(F.col("snp_id").isin(variants)).groupBy("sample_id").agg(*[F.max(F.when(F.col("snp_id") == i, cell)).alias(f"s{i}") for i in variants])
