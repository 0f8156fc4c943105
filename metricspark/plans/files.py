"""Queries on files that are written and read back, definitions in YAML and a model's guesses, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricspark import storage
from metricspark.operators import exports, intent, registry, text
from metricspark.plans.answers import companies
from metricspark.sources.statements import table


def exported_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as batches of their first two lines, kept and read back.

    A line that was returned isn't worth what was verified, urgent orders were checked as
    filled ones, and what was kept of orders of low priority is damaged.
    """
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("field"))
    lines = lines.agg(F.sum(price).alias("value"), F.max(F.col("l_returnflag") == "R").alias("returned"))
    expected = F.when(F.col("returned"), F.lit(0)).otherwise(F.col("value")).alias("expected")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch"), "o_orderstatus", "o_orderpriority")
    batches = orders.select("batch", F.col("o_orderstatus").alias("digest"), F.when(F.col("o_orderpriority") == "1-URGENT", "F").alias("checked_digest"))
    folder = storage.new_folder(spark, "exports")
    run = exports.write(lines.select("batch", "field", "value"), lines.select("batch", "field", expected), batches, folder)
    if run is not None:
        low = orders.filter("o_orderpriority = '5-LOW'").select("batch")
        kept = spark.read.parquet(f"{folder}/rows/run={run}")
        kept.join(low, "batch", "left_semi").withColumn("field", F.col("field") + 10).write.mode("append").parquet(f"{folder}/rows/run={run}")
    rows, _ = exports.read(spark, folder)
    return rows.select("batch", "field", F.col("value").cast("double").alias("value"))


def covered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as sources of their customers' segments and years of orders; those of some regions can't be read, or claim to be real without a digest."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    pairs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("n_nationkey"), F.struct(F.col("c_mktsegment").alias("code"), F.year("o_orderdate").cast("string").alias("year")).alias("r")
    )
    rows = pairs.distinct().groupBy("n_nationkey").agg(F.collect_list("r").alias("rows")).join(nation, "n_nationkey")  # segments times years
    digest = F.when(F.col("r_name") != "AFRICA", F.sha2("n_name", 256)).otherwise("none")
    kind = F.when(F.col("r_name") == "ASIA", "synthetic").otherwise("real")
    meta = F.struct(kind.alias("kind"), F.col("n_name").alias("fixture_id"), digest.alias("source_sha256"), F.lower("n_name").alias("short_name"))
    said = F.to_json(F.struct(meta.alias("meta"), "rows"))
    said = F.when(F.col("r_name") == "AMERICA", F.left(said, F.length(said) / 2)).otherwise(said)
    folder = storage.new_folder(spark, "sources")
    rows.select(said.alias("value"), F.col("n_nationkey").alias("n")).repartition("n").write.partitionBy("n").text(folder)
    found, counts = exports.covered(spark, folder, "real", "*.txt")
    return found.crossJoin(F.broadcast(counts))  # one row


def guessed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as questions without a metric's name, and what a model of a few rules takes them to mean."""

    def ask(texts: list[str]) -> list[str | None]:
        means = {"gear": "leverage", "bolt": " current  ratio ", "ring": "a name that nobody knows"}
        return [next((said for word, said in means.items() if word in t.split()), None) for t in texts]

    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat("p_name", F.lit(" of 000001 in 1996年")).alias("text"))
    found = intent.intents(rows, text.aliases(spark), companies(spark, sf_dir), "k", ask=ask, model_limits={"batch": 16, "in_flight": 2})
    return found.select("k", "metric_id", "alias", "resolved_by", "entity", "period", "reason")


def yaml_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as definitions in YAML; promotional ones can't be read, economical ones are no mappings."""
    field = F.concat(F.lit("  - id: bs.size\n    sign_convention: plus\n    missing_representation: "), F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise("null"))
    lines = F.concat_ws(
        "\n", F.concat(F.lit("metric_id: part_"), "p_partkey"), F.concat(F.lit("display_name: '"), "p_name", F.lit("'")), F.lit("aliases:"), F.concat(F.lit("  - "), "p_brand"),
        F.concat(F.lit("  - "), "p_type"), F.concat(F.lit("version: "), "p_size"), F.lit("source_fields:"), field, F.lit("  - id: notes.sold\n    enum_values: [true, false]"),
        F.lit("formula: >\n  bs.size\n  / 2"), F.lit("undefined_conditions:"), F.concat(F.lit("  - expr: bs.size <= "), "p_size", F.lit("\n    reason: none")),
    )
    value = F.when(F.startswith("p_type", F.lit("PROMO")), F.concat(lines, F.lit("\n  : ["))).when(F.startswith("p_type", F.lit("ECONOMY")), F.col("p_name")).otherwise(lines)
    rows = registry.parsed(table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".yaml")).alias("path"), value.alias("value")))
    return rows.select(
        "path", "metric_id", "display_name", F.array_join("aliases", ";").alias("aliases"), "version", "formula", F.array_join(F.transform("fields", lambda x: F.concat_ws("=", x["id"], x["kind"], x["missing"])), ";").alias("fields"),
        F.get("conditions", F.lit(0))["expr"].alias("expr"), F.col("parse_error").isNotNull().alias("broken"),
    )


QUERIES = {f.__name__: f for f in (exported_batches, covered_files, guessed_names, yaml_definitions)}
ORACLES = {
    "exported_batches": """WITH r AS (SELECT l_orderkey AS batch, l_linenumber AS field, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS value, bool_or(l_returnflag = 'R') AS returned FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2),
bad AS (SELECT batch FROM r WHERE returned AND value <> 0)
SELECT batch, field, CAST(value AS DOUBLE) AS value FROM r JOIN orders ON o_orderkey = batch WHERE batch NOT IN (SELECT batch FROM bad) AND (o_orderpriority <> '1-URGENT' OR o_orderstatus = 'F') AND o_orderpriority <> '5-LOW'""",
    "covered_files": """WITH n AS (SELECT * FROM nation JOIN region ON r_regionkey = n_regionkey), p AS (SELECT DISTINCT c_nationkey, c_mktsegment AS code, year(o_orderdate) AS year FROM orders JOIN customer ON c_custkey = o_custkey),
files AS (SELECT count(DISTINCT n_nationkey) FILTER (WHERE r_name <> 'AMERICA') AS "read", count(DISTINCT n_nationkey) FILTER (WHERE r_name = 'AMERICA') AS skipped FROM p JOIN n ON n_nationkey = c_nationkey)
SELECT CASE WHEN r_name IN ('AFRICA', 'ASIA') THEN 'synthetic' ELSE 'real' END AS nature, n_name AS fixture, code, CAST(year AS INTEGER) AS year, CASE WHEN r_name IN ('AFRICA', 'ASIA') THEN '' ELSE lower(n_name) END AS short_name, "read", skipped
FROM p JOIN n ON n_nationkey = c_nationkey, files WHERE r_name <> 'AMERICA'""",
    "guessed_names": """WITH p AS (SELECT p_partkey AS k, string_split(p_name, ' ') AS w FROM part), g AS (SELECT k, CASE WHEN list_contains(w, 'gear') THEN 'debt_to_asset_ratio' WHEN list_contains(w, 'bolt') THEN 'current_ratio' END AS metric_id FROM p)
SELECT k, metric_id, CASE metric_id WHEN 'debt_to_asset_ratio' THEN 'leverage' WHEN 'current_ratio' THEN 'current ratio' END AS alias, CASE WHEN metric_id IS NOT NULL THEN 'model' END AS resolved_by,
CASE WHEN metric_id IS NOT NULL THEN '000001' END AS entity, CASE WHEN metric_id IS NOT NULL THEN 1996 END AS period, CASE WHEN metric_id IS NULL THEN 'no_metric' END AS reason FROM g""",
    "yaml_definitions": """SELECT p_partkey || '.yaml' AS path, CASE WHEN ok THEN 'part_' || p_partkey END AS metric_id, CASE WHEN ok THEN p_name END AS display_name, CASE WHEN ok THEN p_brand || ';' || p_type WHEN NOT broken THEN '' END AS aliases, CASE WHEN ok THEN p_size END AS version,
CASE WHEN ok THEN 'bs.size / 2' END AS formula, CASE WHEN ok THEN 'bs.size=number=' || CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) ELSE 'null' END || ';notes.sold=boolean' WHEN NOT broken THEN '' END AS fields, CASE WHEN ok THEN 'bs.size <= ' || p_size END AS expr, broken
FROM (SELECT *, starts_with(p_type, 'PROMO') AS broken, NOT starts_with(p_type, 'PROMO') AND NOT starts_with(p_type, 'ECONOMY') AS ok FROM part)""",
}
