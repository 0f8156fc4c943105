"""Completeness of evidence, roll-ups of judged cases and the choice between sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def completeness(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Filled evidence fields of all; a null, blank or unknown field is a gap; no fields give rate 0."""
    filled = sum((F.when(F.col(k).isNull() | (F.trim(F.col(k).cast("string")).isin("", "UNKNOWN")), 0).otherwise(1) for k in keys), F.lit(0))
    out = rows.groupBy(*by).agg(F.sum(filled).cast("long").alias("filled"), (F.count(F.lit(1)) * len(keys)).alias("total"))
    return out.withColumn("rate", F.round(F.coalesce(F.try_divide("filled", "total"), F.lit(0.0)), 6))


def rollup(cases: DataFrame, domain: list[str]) -> DataFrame:
    """Passed, failed and void cases of every category of the domain, also those without cases."""
    n = lambda s: F.count_if(F.col("status") == s)
    found = cases.groupBy("category").agg(*(n(s).alias(s.lower()) for s in ("PASSED", "FAILED", "VOID")))
    every = cases.sparkSession.createDataFrame([(c,) for c in domain], "category string")
    return F.broadcast(every).join(found, "category", "left").na.fill(0)


def first_source(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """For each key the row of the source that comes first."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("rank", rank).filter("rank = 1").drop("rank")


def settled_names(names: DataFrame) -> DataFrame:
    """Names with one code only (name, code); a name that sources give different codes is dropped."""
    found = names.groupBy("name").agg(F.min("code").alias("code"), F.max("code").alias("last"))
    return found.filter(F.col("code") == F.col("last")).drop("last")
