"""Global ranks without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64


def ranked(rows: DataFrame, value: Column, *ties: str, name: str = "rank") -> DataFrame:
    """rows with their rank from 1 in order of `value` (a number, never null), then `ties`.

    Approximate quantiles cut the rows into PARTS ranges; counts of the ranges, a table of PARTS rows, say where each begins, and a window ranks within it.
    """
    t = rows.withColumn("_v", value.cast("double"))
    cuts = t.agg(F.percentile_approx("_v", [i / PARTS for i in range(1, PARTS)], 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("_v"))) if cuts else F.lit(0)
    t = t.withColumn("_p", part)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    begins = t.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_p").orderBy("_v", *ties))
    return t.withColumn("_r", within).join(F.broadcast(begins), "_p").withColumn(name, (F.col("_b") + F.col("_r")).cast("long")).drop("_v", "_p", "_r", "_b")
