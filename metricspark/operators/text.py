"""Segments, stated numbers, names and claims of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metricspark.plans.definitions import DEFINITIONS

#: Fixed value: what separates the segments of a text.
SEPARATORS = "[。；;！!？?\n，,]+"


def segments(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, segment): trimmed parts between separators, empty ones left out."""
    parts = F.filter(F.transform(F.split(text_col, SEPARATORS), lambda x: F.trim(x)), lambda x: x != "")
    return texts.select(id_col, F.posexplode(parts).alias("pos", "segment"))


def aliases(spark: SparkSession) -> DataFrame:
    """(alias, metric_id, display) of all definitions; bounded by the catalogue."""
    rows = [(a, d.metric_id, d.display) for d in DEFINITIONS for a in (d.display, *d.aliases)]
    return spark.createDataFrame(rows, "alias string, metric_id string, display string")


def named(texts: DataFrame, names: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """texts with the longest alias that each holds, then the first by name; null if none.

    The names are one array on every row's side of a broadcast, so texts aren't shuffled.
    """
    listed = names.agg(F.sort_array(F.collect_list(F.struct((-F.length("alias")).alias("n"), "alias", "metric_id", "display"))).alias("names"))
    hit = F.filter("names", lambda x: F.instr(F.col(text_col), x["alias"]) > 0)
    found = texts.crossJoin(F.broadcast(listed)).withColumn("hit", F.try_element_at(hit, F.lit(1)))
    return found.select(*texts.columns, F.col("hit.alias").alias("alias"), F.col("hit.metric_id").alias("metric_id"), F.col("hit.display").alias("display"))


VERDICTS = ("CONSISTENT", "INCONSISTENT", "AMBIGUOUS_BASIS", "NOT_COVERED", "NOT_CHECKABLE")


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """One row with the count of every verdict, zeros included."""
    return verdicts.agg(*(F.count_if(F.col("verdict") == v).alias(v.lower()) for v in VERDICTS))


def inherited(turns: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """``value`` of a row, or where it is null the first that an earlier row of the group gave."""
    earlier = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("context", F.coalesce(value, F.first(value, ignorenulls=True).over(earlier)))


def near_misses(texts: DataFrame, names: DataFrame, text_col: str, blanks: bool = False) -> DataFrame:
    """Rows of ``named`` with ``near``: another metric's alias of which the found one is only the end.

    ``near`` is null unless the text also has some of what that alias has before, up to
    where the found alias begins. ``blanks``: a blank alone counts too, for names that hold none. The alias of which the text
    shows most wins, then the first by name. Names are broadcast; texts aren't shuffled.
    """
    listed = names.agg(F.sort_array(F.collect_list(F.struct(F.col("alias").alias("other"), F.col("metric_id").alias("other_id")))).alias("others"))
    text, alias = F.col(text_col), F.col("alias")
    before = F.substring(text, F.lit(1), F.instr(text, alias) - 1)

    def shown(x: Column) -> Column:
        extra = F.substring(x["other"], F.lit(1), F.length(x["other"]) - F.length(alias))
        ends = F.filter(F.sequence(F.lit(1), F.length(extra)), lambda k: F.endswith(before, F.right(extra, k)) & (F.lit(blanks) | (F.trim(F.right(extra, k)) != "")))
        return F.struct(F.coalesce(F.array_max(ends), F.lit(0)).alias("n"), x["other"].alias("other"))

    apart = lambda x: F.endswith(x["other"], alias) & (x["other"] != alias) & (x["other_id"] != F.col("metric_id"))
    found = F.filter(F.transform(F.filter("others", apart), shown), lambda x: x["n"] > 0)
    most = F.filter(found, lambda x: x["n"] == F.array_max(F.transform(found, lambda y: y["n"])))
    return texts.crossJoin(F.broadcast(listed)).withColumn("near", F.try_element_at(most, F.lit(1))["other"]).drop("others")
