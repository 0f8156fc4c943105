"""Verified records kept as tables of whole batches, and read back only as they were written.

A run writes its rows first and its manifest last: of every batch the number of its rows
and a digest of them, worked out again from what was written. Rows without a manifest
don't count, so a run that was lost leaves nothing behind. Everything is written and read
by Spark, whatever file system the folder is on; no manifest comes to the driver.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metricspark import storage
from metricspark.operators import intake


def digests(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(*keys, n, digest) of batches: the digest of their rows' sorted digests. A batch has as many rows as fields were allowed for it."""
    row = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(row)), ""), 256).alias("digest"))


def manifests(spark: SparkSession, folder: str) -> DataFrame | None:
    """(batch, run, n, digest): the last manifest of every batch; none if nothing was ever written whole."""
    if not storage.exists(spark, f"{folder}/manifests"):
        return None
    every = spark.read.option("basePath", f"{folder}/manifests").parquet(f"{folder}/manifests/run=*")
    last = F.max_by(F.struct("run", "n", "digest"), F.col("run")).alias("x")
    return every.withColumn("run", F.col("run").cast("string")).groupBy("batch").agg(last).select("batch", "x.*")


def write(records: DataFrame, allowed: DataFrame, batches: DataFrame, folder: str) -> str | None:
    """Write the batches that ``intake.verified`` lets pass and that aren't there already as they are; the run's name, null if there was none.

    records: batch, field, value; see ``intake.verified`` for the others. A batch goes in whole
    or not at all. A second call with the same records writes nothing.
    """
    spark = records.sparkSession
    columns = ["batch", "field", "value"]
    rows = intake.verified(records, allowed, batches).select(columns)
    told = digests(rows, ["batch"], columns)
    known = manifests(spark, folder)
    if known is not None:
        told = told.join(known.select("batch", "n", "digest"), ["batch", "n", "digest"], "left_anti")
    run = f"r{time.time_ns():020d}"
    stage = f"{folder}/staged/{run}"
    told.write.parquet(stage)
    told = spark.read.parquet(stage)
    if told.isEmpty():
        return None
    rows.join(told.select("batch"), "batch", "left_semi").write.parquet(f"{folder}/rows/run={run}")
    written = digests(spark.read.parquet(f"{folder}/rows/run={run}"), ["batch"], columns)
    same = ["batch", "n", "digest"]
    if not told.join(written, same, "left_anti").isEmpty():
        raise RuntimeError(f"{folder}: rows of {run} aren't what was to be written; the run is left without a manifest")
    written.join(told, same, "left_semi").write.parquet(f"{folder}/manifests/run={run}")
    return run


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rows, refused): the rows (batch, field, value, run) of all batches that are as their manifest says, and the others as (batch, reason).

    Reasons are ROWS_MISSING and DIGEST_DIFFERS. A batch is read from its last run, whole or not at all.
    """
    known = manifests(spark, folder)
    if known is None:
        raise FileNotFoundError(f"{folder}: nothing was written")
    rows = spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/run=*").withColumn("run", F.col("run").cast("string"))
    found = digests(rows, ["batch", "run"], ["batch", "field", "value"]).select("batch", "run", F.col("n").alias("found_n"), F.col("digest").alias("found"))
    judged = known.join(found, ["batch", "run"], "left")
    reason = F.when(F.col("found").isNull(), "ROWS_MISSING").when((F.col("found") != F.col("digest")) | (F.col("found_n") != F.col("n")), "DIGEST_DIFFERS")
    judged = judged.select("batch", "run", reason.alias("reason"))
    good = judged.filter("reason IS NULL").select("batch", "run")
    return rows.join(good, ["batch", "run"], "left_semi").select("batch", "field", "value", "run"), judged.filter("reason IS NOT NULL").select("batch", "reason")


#: The form of a source: what it says of itself, and its rows.
SOURCE = "meta struct<kind:string,fixture_id:string,source_sha256:string,short_name:string>, rows array<struct<code:string,year:string>>"


def covered(spark: SparkSession, folder: str, claimed: str, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(rows, counts): what the JSON files of a folder cover as (nature, fixture, code, year, short_name), and one row with the counts of files read and skipped.

    A file that can't be read is skipped and counted. ``claimed`` is the folder's nature; a
    row is real only if its file says so too and gives a digest of 64 hexadecimal digits. Without a name of its own a
    source has its file's; names are shown of real ones only. Rows without a code or a whole year are left out.
    """
    files = spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(folder).select("value", F.col("_metadata.file_name").alias("file"))
    parsed = F.from_json("value", f"{SOURCE}, bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    told = files.select("file", parsed.alias("s")).select("file", "s.*")
    sound = told.filter("bad IS NULL")
    real = (F.col("meta.kind") == "real") & F.col("meta.source_sha256").rlike("^[0-9a-f]{64}$") & F.lit(claimed == "real")
    nature = F.when(F.coalesce(real, F.lit(False)), "real").otherwise("synthetic")
    own = sound.select(nature.alias("nature"), F.coalesce("meta.fixture_id", F.regexp_replace("file", r"\.\w+$", "")).alias("fixture"), F.coalesce("meta.short_name", F.lit("")).alias("short_name"), F.explode("rows").alias("r"))
    rows = own.select("nature", "fixture", F.col("r.code").alias("code"), F.expr("try_cast(r.year AS INT)").alias("year"), F.when(F.col("nature") == "real", F.col("short_name")).otherwise("").alias("short_name"))
    counts = told.agg(F.count_if(F.col("bad").isNull()).alias("read"), F.count_if(F.col("bad").isNotNull()).alias("skipped"))
    return rows.filter("code IS NOT NULL AND year IS NOT NULL"), counts
