"""Look-ups between variants, places and annotations: equality joins with stated defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANONICAL = r"^(chr)?([1-9]|1[0-9]|2[0-2]|X|Y)$"
NO_PLACE = ("Z", 1)


def canonical(variants: DataFrame, column: str = "chromosome") -> DataFrame:
    """Variants on chromosomes 1 to 22, X or Y."""
    return variants.where(F.col(column).cast("string").rlike(CANONICAL))


def known_allele(variants: DataFrame, column: str) -> DataFrame:
    """Variants whose risk allele is known: neither null nor empty nor a question mark."""
    return variants.where(F.col(column).isNotNull() & ~F.col(column).isin("", "?"))


def in_all(selection: DataFrame, *others: DataFrame, key: str = "snp_id") -> DataFrame:
    """Rows of `selection` whose key is in each of the others."""
    for o in others:
        selection = selection.join(o.select(key), key, "left_semi")
    return selection


def ids_by_place(places: DataFrame, variants: DataFrame) -> DataFrame:
    """places (chromosome, position, ...) with snp_id of the variant there, the least where several share a place, null where there is none."""
    there = variants.groupBy("chromosome", "position").agg(F.min("snp_id").alias("snp_id"))
    return places.join(there, ["chromosome", "position"], "left")


def places_by_id(ids: DataFrame, variants: DataFrame) -> DataFrame:
    """ids (snp_id) with chromosome and position; ids without a place get the defaults Z and 1."""
    v = variants.select("snp_id", F.col("chromosome").cast("string").alias("chromosome"), "position")
    return ids.join(v, "snp_id", "left").select("snp_id", F.coalesce("chromosome", F.lit(NO_PLACE[0])).alias("chromosome"), F.coalesce("position", F.lit(NO_PLACE[1])).cast("long").alias("position"))


def salvage(variants: DataFrame, places: DataFrame) -> DataFrame:
    """variants with the places of those that lack a chromosome filled in from `places` (snp_id, chromosome, position)."""
    p = places.select("snp_id", F.col("chromosome").alias("_c"), F.col("position").alias("_p"))
    lacks = F.col("chromosome").isNull()
    return variants.join(p, "snp_id", "left").withColumns({"position": F.when(lacks, F.coalesce("_p", "position")).otherwise(F.col("position")), "chromosome": F.coalesce("chromosome", "_c")}).drop("_c", "_p")


def collapsed(rows: DataFrame, by: str, value: str, separator: str = ", ") -> DataFrame:
    """by, value: the distinct non-null values of a key as one text, in order."""
    return rows.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(value)), separator).alias(value))


def evidence(candidates: DataFrame, associations: DataFrame, genes: DataFrame) -> DataFrame:
    """Candidates that any association names, with its traits and genes, each collapsed to one text."""
    out = candidates.join(associations.select("snp_id"), "snp_id", "left_semi")
    return out.join(collapsed(associations, "snp_id", "trait"), "snp_id", "left").join(collapsed(genes, "snp_id", "gene"), "snp_id", "left")


def with_repeats(rows: DataFrame, by: str, order: list[str | Column]) -> DataFrame:
    """Each row that repeats the key of the row before it, and that row."""
    w = Window.partitionBy(by)
    return rows.withColumn("_n", F.count(F.lit(1)).over(w)).where("_n > 1").drop("_n").orderBy(by, *order)


def oriented(effects: DataFrame, keeps: str = "plink") -> DataFrame:
    """Effects on the common allele: those of every method but `keeps` are negated."""
    return effects.withColumn("effect", F.when(F.col("method") == keeps, F.col("effect")).otherwise(-F.col("effect")))
