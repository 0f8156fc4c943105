"""Queries on definitions, records, evidence and judged cases, with their SQL; cases are set by rule on keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricspark.operators import evidence, judging, registry, review, rules
from metricspark.plans.definitions import DEFINITIONS, Definition
from metricspark.plans.metric_sql import READS, WITH
from metricspark.sources.statements import FIELDS, statements, table

STRANGE = (
    Definition("unread_condition", "is.a / is.b", ("is.a ==",)),
    Definition("foreign_space", "is.a / is.b", ("secret.a > 1",)),
)


def rule(name: str, *choices: str) -> Column:
    """One of the choices by the key: an expression on k."""
    return F.expr(f"element_at(array({', '.join(choices)}), CAST(k % {len(choices)} AS INT) + 1)").alias(name)


def keyed(spark: SparkSession, sf_dir: str, name: str = "orders", key: str = "o_orderkey") -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(key).alias("k"))


def catalogue(spark: SparkSession) -> DataFrame:
    return registry.rows(spark, DEFINITIONS)


def part_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as definitions: some ids come twice, names are brands and types."""
    p = table(spark, sf_dir, "part")
    return p.selectExpr(
        "concat('m', IF(p_partkey % 50 = 0, 50, p_partkey)) AS metric_id", "p_name AS display_name", "IF(p_partkey % 97 = 0, array('shared'), array()) AS aliases",
        "CAST(p_partkey % 4 AS INT) AS version", "'f1' AS formula", "p_size", "p_partkey AS k",
    )


def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.collisions(part_definitions(spark, sf_dir))


def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of metrics with blanks, unknown ones, and ones whose definition has findings."""
    names = keyed(spark, sf_dir).select("k", rule("name", "' current ratio '", "'debt ratio'", "'weather'", "'quick_ratio'", "'Leverage'"))
    faulty = spark.createDataFrame([("quick_ratio", "R9")], "metric_id string, code string")
    return registry.resolved(names, registry.names(catalogue(spark)), faulty).select("k", "metric_id", "refusal_code")


def whole_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as whole definitions: fields by the words of their names, faults by their types and sizes."""
    number = "CAST(NULL AS ARRAY<STRING>)"
    return table(spark, sf_dir, "part").selectExpr("*", "split(p_name, ' ')[0] AS a", "split(p_name, ' ')[1] AS b").selectExpr(
        "concat(p_partkey, '.json') AS path", "concat('m', p_partkey) AS metric_id", "p_name AS display_name", "array(p_brand) AS aliases", "p_size AS version",
        "IF(p_type = 'PROMO', concat('bs.', a, ' ** 2'), concat('bs.', a, ' / is.', b)) AS formula",
        f"array(named_struct('id', concat('bs.', a), 'sign', 'plus', 'missing', 'null', 'kind', 'number', 'values', {number}), named_struct('id', concat('is.', b), 'sign', CAST(NULL AS STRING), 'missing', CAST(NULL AS STRING), 'kind', IF(p_type = 'SMALL', 'enum', 'number'), 'values', {number})) AS fields",
        "array(named_struct('expr', concat('is_missing(bs.', a, ')'), 'reason', 'r'), named_struct('expr', concat('bs.', a, ' > ', IF(p_type = 'ECONOMY', '', CAST(p_size AS STRING))), 'reason', 'r')) AS conditions",
        "array(named_struct('name', p_brand, 'trigger', CASE WHEN p_size < 10 THEN concat('comparison_period.version != ', p_size) WHEN p_size > 45 THEN concat('is.', a, ' ==') ELSE concat('is.', b, ' == ', p_size) END)) AS flags",
        "array(named_struct('name', 's', 'version', '1')) AS basis", "named_struct('allow', true, 'note', 'n') AS derivation",
        "array(named_struct('text', 't', 'enforced_by', IF(p_type = 'LARGE', 'nowhere', 'undefined_conditions[0]'), 'advisory', false)) AS pitfalls",
        "IF(p_type = 'MEDIUM' AND p_size < 4, 'not to be read', NULL) AS parse_error",
    )


def declared_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.declared(whole_definitions(spark, sf_dir))


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of large parts' names, and the second ones under another statement."""
    p = table(spark, sf_dir, "part").filter("p_size > 25")
    return p.selectExpr("explode(array(concat('bs.', split(p_name, ' ')[0]), concat('cfs.', split(p_name, ' ')[1]))) AS field_id")


def mapping_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.differences(registry.declared(whole_definitions(spark, sf_dir)), _mapped(spark, sf_dir))


def fields_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.outside(_mapped(spark, sf_dir), registry.declared(whole_definitions(spark, sf_dir)))


def mapping_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows of a mapping, with keys missing, forbidden or wrong by rule."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS k").select(
        F.expr("concat(IF(k % 8 = 0, 'is.', 'bs.'), 'f', IF(k % 40 = 0, 40, k))").alias("field_id"), F.lit("balance").alias("statement"),
        rule("kind", "'row'", "'note'", "'presence'", "'other'"), F.expr("IF(k % 3 = 0, NULL, array(array('x')))").alias("variants"),
        F.expr("IF(k % 4 = 0, '期末余额', NULL)").alias("role"), F.expr("IF(k % 5 = 0, NULL, 's')").alias("section"), F.expr("IF(k % 6 = 0, NULL, 'h')").alias("header"), F.expr("CAST(k % 7 AS INT)").alias("version"),
    )
    return registry.mapping_findings(rows)


def registry_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.snapshot(registry.names(whole_definitions(spark, sf_dir)), "alias")


def definition_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of every definition; of several of one name, its highest."""
    return registry.versions(whole_definitions(spark, sf_dir).withColumn("metric_id", F.replace("display_name", F.lit(" "), F.lit("_"))))


def silent_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of parts after an edit: of prose, of a formula with and without a new version."""
    p = table(spark, sf_dir, "part").selectExpr(
        "concat('m', p_partkey) AS metric_id", "p_partkey AS k", "2 AS version", "'f1' AS formula", "named_struct('allow', true, 'note', 'n') AS derivation",
        "array(named_struct('text', 't', 'enforced_by', 'derivation', 'advisory', false)) AS pitfalls", "array(named_struct('expr', 'e', 'reason', 'r')) AS conditions",
    )
    edited = p.withColumn("formula", F.expr("IF(k % 4 IN (1, 2), 'f2', formula)")).withColumn("version", F.expr("IF(k % 4 = 2, 3, version)"))
    edited = edited.withColumn("derivation", F.expr("IF(k % 4 = 3, named_struct('allow', true, 'note', 'other'), derivation)"))
    return registry.silent_changes(registry.fingerprints(p.drop("k")), registry.fingerprints(edited.drop("k")))


def short_field_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = "array(named_struct('id', 'bs.total'), named_struct('id', IF(k % 3 = 0, 'is.total', 'is.cost')), named_struct('id', 'notes.x.y'))"
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS k").selectExpr("concat('m', k) AS metric_id", f"{fields} AS fields")
    return registry.short_names(rows)


def text_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of definitions that can't be read."""
    return registry.text_findings(whole_definitions(spark, sf_dir))


def checked_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that rules and readers find in definitions, in one call."""
    terms = rules.Terms(("entity", "period_type"), ("annual",), ("flow",), ("positive", "negative"), ("Brand#1", "Brand#2"), ("Brand#3",))
    return registry.all_findings(whole_definitions(spark, sf_dir), terms)


def deferred_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of definitions that only two compared periods can decide."""
    return registry.deferred_flags(whole_definitions(spark, sf_dir))


def gated_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for good, unreadable, foreign, unknown and undeclared definitions, with and without a version."""
    undeclared = registry.rows(spark, [Definition("undeclared", "is.a / is.b", ("is_missing(is.a)",))]).withColumn("fields", F.array().cast("array<struct<id:string,sign:string,missing:string,kind:string,values:array<string>>>"))
    odd = [("", d.metric_id, d.display, [], 2, d.formula, [], [(c, c) for c in d.conditions], [], [], None, [], None) for d in STRANGE]
    broken = [("x.json", "broken", None, None, 2, None, None, None, None, None, None, None, "{")]
    extra = spark.createDataFrame(odd + broken, f"path string, {registry.SCHEMA}, parse_error string")
    requests = keyed(spark, sf_dir).select(
        "k", rule("metric_id", "'current_ratio'", "'broken'", "'unread_condition'", "'foreign_space'", "'undeclared'", "'nothing'", "'free_cash_flow'"), F.expr("CASE k % 3 WHEN 1 THEN 2 WHEN 2 THEN 3 END").alias("expected_version")
    )
    return registry.gate(requests, catalogue(spark).unionByName(undeclared).unionByName(extra)).select("k", "gate", "failed_check", "refusal_code")


def incoherent_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(spark, sf_dir).select(
        F.col("k").alias("key"), rule("retrieval", "'GOT_VALUE'", "'ABSENT'", "'ATTEMPTED_UNKNOWN'"), rule("state", "'VALUE_PRESENT'", "'ROW_ABSENT'", "NULL", "'EMPTY_CELL'"),
        F.expr("CAST(CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 0 ELSE 7 END AS DECIMAL(12,2))").alias("value"), rule("status", "'SUCCESS'", "'PARTIAL'", "'REFUSED'", "'SUCCESS'", "'SUCCESS'", "'SUCCESS'", "'PARTIAL'"),
        F.expr("IF(k % 2 = 0, map('dropped', 1L), CAST(map() AS MAP<STRING,BIGINT>))").alias("stats"), rule("kind", "'AMOUNT'", "'NOTE'"), F.expr("IF(k % 9 = 0, NULL, 'b')").alias("basis"),
    )
    return evidence.incoherent(rows)


def truncation_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(spark, sf_dir).select(
        F.col("k").alias("key"), rule("status", "'SUCCESS'", "'PARTIAL'", "NULL"), F.expr("CASE k % 4 WHEN 0 THEN map('dropped', 0L) WHEN 1 THEN map('dropped', 3L) WHEN 2 THEN CAST(map() AS MAP<STRING,BIGINT>) END").alias("stats")
    )
    return evidence.truncation(rows)


def evidence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(spark, sf_dir).select(
        F.col("k").alias("key"), rule("kind", "'AMOUNT'", "'NOTE'", "'OTHER'"), rule("source_url", "'u'", "NULL", "' '", "'N/A'", "'u'"), F.lit("b").alias("batch_id"), rule("column_header", "'h'", "'待定'"),
        F.expr("CAST(IF(k % 7 = 0, 0, k) AS INT)").alias("page"), F.expr("IF(k % 11 = 0, NULL, 1)").alias("mapping_version"), rule("freshness", "'FETCHED_THIS_RUN'", "'UNKNOWN'", "'REUSED_CACHED'", "NULL"),
    )
    return evidence.gaps(rows)


def answer_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(spark, sf_dir).select(F.col("k").alias("key"), rule("metric_id", "'m'", "NULL"), rule("metric_version", "2", "NULL", "0"), rule("data_source", "'s'", "'unknown'", "''"), rule("execution_hash", "'h'", "'h'", "'h'", "NULL"))
    return evidence.answer_gaps(rows)


def execution_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = "array(named_struct('field_id', 'a', 'shown', CAST(k AS STRING)), named_struct('field_id', 'b', 'shown', CAST(NULL AS STRING)))"
    rows = keyed(spark, sf_dir).selectExpr("k", "concat('q', k) AS question", "IF(k % 4 = 0, NULL, 'm') AS metric_id", "2 AS version", "'000001' AS entity", "2023 AS period", "IF(k % 3 = 0, 'UNAVAILABLE', NULL) AS refusal_code", "'s' AS data_source", f"{inputs} AS inputs")
    return evidence.execution_hash(rows).select("k", "execution_hash")


def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(spark, sf_dir).select("k", rule("v", "'0'", "''", "NULL", "'true'", "'false'", "'12.5'"), rule("kind", "'x'", "'x'", "'x'", "'boolean'", "'boolean'", "'x'"))
    return rows.select("k", evidence.shown(F.col("v"), F.col("kind")).alias("shown"))


def coerced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw cells as numbers where they are numbers, else kept; and what counts as missing."""
    rows = keyed(spark, sf_dir).select(
        "k", rule("raw", "'1,234.5'", "'abc'", "NULL", "'-'", "'0'"), rule("there", "true", "true", "true", "true", "true", "true", "false"), rule("rep", "'-'", "NULL", "'0'"), rule("same", "true", "false")
    )
    n = evidence.numeric(F.col("raw"))
    clean = evidence.normalised(F.col("raw"), F.col("there"), F.col("rep"), F.col("same"))
    return rows.select("k", n["value"].cast("double").alias("value"), n["kept"].alias("kept"), clean.alias("normalised"))


def plain_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(spark, sf_dir).select("k", rule("name", "'甲公司（集团）'", "'甲（集团）公司'", "'乙公司'"))
    return rows.select("k", evidence.plain_name(F.col("name")).alias("name"))


def merged_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with one brand; synthetic where any part of the name isn't real."""
    digest = F.when(F.col("p_partkey") % 3 != 0, F.sha2("p_name", 256))
    rows = table(spark, sf_dir, "part").select(F.concat("p_type", F.col("p_partkey") % 500).alias("name"), F.concat("p_brand", F.lit("")).alias("code"), evidence.nature(F.when(F.col("p_partkey") % 5 != 0, "real"), digest).alias("nature"))
    return evidence.merged_names(rows)


def sourced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows asked for, of the first source that has them; none stands in for a row that isn't there."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.lit(0).alias("ord"), F.col("s_name").alias("name"))
    c = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit(1).alias("ord"), F.col("c_name").alias("name"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return evidence.sourced(asked, s.unionByName(c), ["k"], "ord").select("k", "name", "source")


def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_custkey") % 3 == 0, "real").otherwise("synthetic").alias("nature"), F.substring("o_orderpriority", 1, 1).alias("fixture"), F.col("o_custkey").alias("code"), F.year("o_orderdate").alias("year")
    )
    return evidence.coverage(rows)


def entity_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as names of their nations' codes; those in debt are synthetic."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("code"), F.when(F.col("s_acctbal") < 0, "synthetic").otherwise("real").alias("nature"))
    return evidence.entities(rows)


def derived_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements' equity, with a derived value only where there is no record."""
    rows = statements(spark, sf_dir).selectExpr("suppkey", "period", "kpi_roe_weighted_average_disclosed AS c")
    value = evidence.with_derived(F.col("c.v"), F.col("c.state").isNotNull(), F.lit("0.5").cast("decimal(28,6)"))
    return rows.select("suppkey", "period", value.cast("double").alias("value"))


def judged_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases of five categories, some void, not run, refused or answered wrongly, with layers."""
    rows = keyed(spark, sf_dir).select(
        "k", F.expr("concat('C', k % 5 + 1)").alias("category"), F.expr("IF(k % 20 = 0, 'broken', '')").alias("voided"), rule("code", "NULL", "'METRIC_NOT_DEFINED'", "'UNAVAILABLE'", "'RECONCILIATION_FAILED'"), rule("want_code", "'METRIC_NOT_DEFINED'", "NULL", "'UNAVAILABLE'"), F.expr("IF(k % 6 = 0, ' foreseen  here ', NULL)").alias("hint")
    )
    rows = judging.partition(rows).withColumnRenamed("state", "part")
    refused = judging.refusals(rows).withColumn("kind", F.expr("IF(category = 'C1' AND code IS NOT NULL, 'REFUSED_BUT_SHOULD_ANSWER', IF(category = 'C1', NULL, kind))"))
    refused = refused.withColumn("status", F.expr("CASE part WHEN 'RUN' THEN IF(kind IS NULL, 'PASS', 'FAIL') ELSE part END"))
    return judging.attributed(refused)


def case_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_cases(spark, sf_dir).select("k", "status", F.expr("IF(status IN ('PASS', 'FAIL'), kind, NULL)").alias("kind"), F.array_join("layers", ",").alias("layers"), "unmapped")


def layer_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.layer_usage(judged_cases(spark, sf_dir))


def reachable_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.reachable(judged_cases(spark, sf_dir))


def case_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.summary(judged_cases(spark, sf_dir))


def suite_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.suite_gate(judged_cases(spark, sf_dir))


def case_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judging.hints(judged_cases(spark, sf_dir).withColumnRenamed("k", "case_id"))
    return rows.withColumn("layers", F.array_join("layers", ","))


def claim_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and produced claims of texts that differ by rule."""
    claim = lambda t, v, i: f"named_struct('text', {t}, 'verdict', {v}, 'inherited', {i})"
    want = keyed(spark, sf_dir).selectExpr("k AS case_id", "'STATEMENT' AS read_as", f"array({claim("'a  b'", "'CONSISTENT'", 'CAST(NULL AS STRING)')}, {claim("'c'", "'NOT_COVERED'", "IF(k % 2 = 0, 'x', NULL)")}) AS claims")
    got = keyed(spark, sf_dir).filter("k % 13 <> 0").selectExpr(
        "k AS case_id", "IF(k % 3 = 0, 'QUESTION', 'STATEMENT') AS read_as",
        f"array({claim("IF(k % 5 = 0, 'ab', 'a b')", "IF(k % 7 = 0, 'INCONSISTENT', 'CONSISTENT')", 'CAST(NULL AS STRING)')}, {claim("'c'", "'NOT_COVERED'", "IF(k % 11 = 0, NULL, 'x')")}) AS claims",
    )
    return judging.claim_cases(want, got)


def freeze_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of a frozen suite: some gone, some changed, some not listed."""
    path = F.expr("concat(IF(k % 2 = 0, 'cases/', 'other/'), k)").alias("path")
    files = keyed(spark, sf_dir).filter("k % 7 <> 0").select(path, F.expr("CAST(concat(k, IF(k % 5 = 0, '!', '')) AS BINARY)").alias("content"))
    manifest = keyed(spark, sf_dir).filter("k % 11 <> 0").select(path, F.sha2(F.col("k").cast("string").cast("binary"), 256).alias("sha256"))
    return judging.freeze(files, manifest)


def case_preconditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(spark, sf_dir).selectExpr(
        "concat('f', lpad(CAST(k AS STRING), 10, '0')) AS file", "CAST(IF(k % 100 = 0, 100, k) AS STRING) AS id", "IF(k % 2 = 0, 'C1', 'C2') AS category", "IF(k % 9 = 0, NULL, 'q') AS question", "'e' AS expected", "'r' AS required_evidence", "'j' AS judging",
        "CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'weather' ELSE 'liquidity' END AS target_name", "IF(k % 3 = 0, 'nothing', 'current_ratio') AS metric_id", "IF(k % 7 = 0, 'gone', 'one') AS fixture",
    )
    fixtures = spark.createDataFrame([("one",)], "fixture string")
    return judging.preconditions(rows, registry.names(catalogue(spark)), fixtures)


def baseline_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a plain model: fenced, wrapped in prose, or no JSON; numbers with commas and percent signs."""
    body = "concat('{\"refused\": ', IF(k % 3 = 0, 'true', 'false'), ', \"refusal_kind\": \"', IF(k % 2 = 0, 'Data_Missing', 'metric_ambiguous'), '\", \"value\": \"', IF(k % 7 = 0, '1,000', IF(k % 7 = 1, '1000%', 'x')), '\"}')"
    rows = keyed(spark, sf_dir).selectExpr(
        "k", "CASE k % 10 WHEN 9 THEN 'C5' ELSE 'C1' END AS category", f"CASE k % 4 WHEN 0 THEN {body} WHEN 1 THEN concat('```json\\n', {body}, '\\n```') WHEN 2 THEN concat('I say ', {body}, ' so') ELSE 'no idea' END AS raw",
        "CAST(1000 AS DOUBLE) AS want", "IF(k % 6 < 3, 'UNDEFINED_CONDITION_HIT', 'METRIC_NOT_DEFINED') AS want_code", "k % 5 = 0 AS refusal_expected", "CAST(NULL AS DOUBLE) AS abs_tol", "CAST(NULL AS DOUBLE) AS rel_tol",
    )
    return judging.baseline(rows).select("k", "status")


def packet_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as packets of their source's page; items of the benchmark that show on it."""
    packets = table(spark, sf_dir, "documents").select(F.col("source").alias("page"), F.col("doc_id").alias("packet_id"), F.col("text").alias("body"))
    pages = packets.select("page").distinct()
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("packet_id"), F.col("text").alias("probe"))
    probes = items.join(pages, F.length("probe") > 0)  # each item is looked for on each of the few pages
    return judging.leaks(packets, probes).select("packet_id", "page", F.sha2("probe", 256).alias("probe"))


def packet_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as packets in a seeded order."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    return judging.shuffled(rows, "k", 7).select("k", "place")


def review_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes on packets beside the results of their cases."""
    packets = keyed(spark, sf_dir).selectExpr("concat('H', k) AS packet_id", "k AS case_id")
    results = keyed(spark, sf_dir).filter("k % 3 <> 0").selectExpr("k AS case_id", "IF(k % 2 = 0, 'PASS', 'FAIL') AS status")
    sheet = keyed(spark, sf_dir).filter("k % 5 <> 0").selectExpr("concat('H', k) AS packet_id", "'对' AS vote")
    return judging.reviewed(packets, results, sheet)


def ranked_pitfalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands by the share of their advisory pitfalls."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("metric_id"), F.when(k % 2 == 0, "flags").alias("enforced_by"), (k % 3 == 0).alias("advisory"))
    return judging.by_ratio(review.pitfall_statistics(rows)).select("metric_id", "rank")


def pitfall_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.lit("m").alias("metric_id"), F.lit(None).cast("string").alias("enforced_by"), (k % 2 == 0).alias("advisory"))
    return judging.over_limit(review.pitfall_statistics(rows), 0.5)


def blocked_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.lit("PASS").alias("status"), F.lit(review.RIGHT).alias("vote"))
    return judging.blocked(review.review_score(rows), F.lit(False)).select("gate", "blocks", "final")


def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files of a repository, with findings of each kind in their order."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS k").selectExpr(
        "concat(IF(k % 4 = 0, 'data/', 'src/'), k, IF(k % 6 = 0, '.pdf', '.md')) AS path", "k % 10 = 0 AS ignored",
        "concat('x ', IF(k % 7 = 0, 'api_key = abcdefgh1', ''), IF(k % 9 = 0, ' /home/me', ''), IF(k % 5 = 0, ' source_pdf_sha256: 1', '')) AS content",
    )
    return judging.ordered(judging.scanned(rows))


def scanned_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files of a repository whose ignore file names the types of its largest parts; small ones are ignored."""
    p = table(spark, sf_dir, "part")
    files = p.select(
        F.concat(F.when(F.col("p_size") > 25, "data/").otherwise("src/"), F.col("p_partkey").cast("string"), F.when(F.col("p_type") == "PROMO", ".pdf").otherwise(".md")).alias("path"),
        F.concat("p_name", F.when(F.col("p_brand") == "Brand#1", F.concat(F.lit(" secret: "), F.replace("p_name", F.lit(" "), F.lit("_")))).otherwise(""), F.when(F.col("p_brand") == "Brand#2", " source_pdf_sha256: x").otherwise("")).alias("content"),
        (F.col("p_size") < 5).alias("ignored"),
    )
    types = p.filter("p_size = 50 AND p_type < 'P'").agg(F.lit(".gitignore").alias("path"), F.array_join(F.collect_set(F.concat(F.lit(" "), "p_type")), "\n").alias("content"), F.lit(False).alias("ignored"))  # six types
    return judging.scan(files.unionByName(types), ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "data/raw"])


QUERIES = {
    f.__name__: f
    for f in (
        name_collisions, resolved_names, declared_fields, mapping_differences, fields_outside, mapping_findings, registry_snapshot, definition_versions,
        silent_changes, short_field_names, text_findings, checked_catalogue, deferred_flags, gated_requests, incoherent_records, truncation_problems, evidence_gaps, answer_gaps,
        execution_hashes, shown_values, coerced_values, plain_names, merged_names, sourced_rows, source_coverage, entity_snapshot, derived_values,
        case_attribution, layer_usage, reachable_layers, case_summary, suite_gate, case_hints, claim_cases, freeze_problems, case_preconditions,
        baseline_judgements, packet_leaks, packet_order, review_packets, ranked_pitfalls, pitfall_limit, blocked_review, scanned_files, scanned_repository,
    )
}

O = "FROM (SELECT o_orderkey AS k FROM orders)"
FLAGGED = ("notes_restatement_flag", "notes_consolidation_scope_change", "notes_reporting_period_months")
DECLARED = sorted({f for r in READS.values() for f in r} | set(FLAGGED))
ALIASES = sorted({m for m in READS} | {m.replace("_", " ") for m in READS} | {
    "payable days", "receivable days", "liquidity", "debt ratio", "leverage", "gross margin", "inventory days", "net margin", "working capital", "acid test", "asset return", "revenue growth", "asset turnover",
})
values = lambda xs: ", ".join(f"('{x}')" for x in xs)
dotted = lambda f: f.replace("_", ".", 1)
JUDGED = f"""WITH c AS (SELECT k, 'C' || (k % 5 + 1) AS category, k % 20 = 0 AS void, [NULL, 'METRIC_NOT_DEFINED', 'UNAVAILABLE', 'RECONCILIATION_FAILED'][k % 4 + 1] AS code, ['METRIC_NOT_DEFINED', NULL, 'UNAVAILABLE'][k % 3 + 1] AS want, k % 6 = 0 AS hinted {O}),
j AS (SELECT *, CASE WHEN category = 'C1' THEN CASE WHEN code IS NOT NULL THEN 'REFUSED_BUT_SHOULD_ANSWER' END WHEN code IS NULL THEN 'ANSWERED_BUT_SHOULD_REFUSE' WHEN want <> code THEN 'WRONG_REFUSAL_CODE' END AS kind FROM c),
s AS (SELECT *, CASE WHEN void THEN 'VOIDED' WHEN category IN ('C4', 'C5') THEN 'NOT_RUN' WHEN kind IS NULL THEN 'PASS' ELSE 'FAIL' END AS status FROM j),
a AS (SELECT *, CASE WHEN status = 'FAIL' THEN CASE WHEN kind <> 'REFUSED_BUT_SHOULD_ANSWER' THEN '口径层' WHEN code = 'UNAVAILABLE' THEN '检索层' WHEN code = 'RECONCILIATION_FAILED' THEN '检索层,计算层' ELSE '口径层' END END AS layers FROM s)"""
BY_CATEGORY = """count(k) AS authored, count(*) FILTER (WHERE status = 'VOIDED') AS voided, count(*) FILTER (WHERE status IN ('PASS', 'FAIL')) AS executed, count(*) FILTER (WHERE status = 'PASS') AS passed"""
FIELD_SETS = """WITH d AS (SELECT DISTINCT unnest(['bs.' || split_part(p_name, ' ', 1), 'is.' || split_part(p_name, ' ', 2)]) AS field_id FROM part),
m AS (SELECT DISTINCT unnest(['bs.' || split_part(p_name, ' ', 1), 'cfs.' || split_part(p_name, ' ', 2)]) AS field_id FROM part WHERE p_size > 25)"""
PARTS = """WITH p AS (SELECT *, 'm' || p_partkey AS metric_id, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_type = 'MEDIUM' AND p_size < 4 AS broken FROM part), t AS (
  SELECT metric_id, 'R0.YAML_UNPARSEABLE' AS code, '' AS place FROM p WHERE broken UNION ALL SELECT metric_id, 'R4.TRIGGER_UNPARSEABLE', p_brand FROM p WHERE NOT broken AND p_size > 45
  UNION ALL SELECT metric_id, 'R6.ENUM_WITHOUT_VALUES', 'is.' || b FROM p WHERE p_type = 'SMALL' UNION ALL SELECT metric_id, 'R7.EXPR_UNPARSEABLE', 'bs.' || a || ' > ' FROM p WHERE p_type = 'ECONOMY'
  UNION ALL SELECT metric_id, 'R8.ENFORCED_BY_UNRESOLVED', 'nowhere' FROM p WHERE p_type = 'LARGE' UNION ALL SELECT metric_id, 'FORMULA_UNPARSEABLE', '' FROM p WHERE p_type = 'PROMO'
)"""
ORACLES = {
    "name_collisions": """WITH d AS (SELECT 'm' || CASE WHEN p_partkey % 50 = 0 THEN 50 ELSE p_partkey END AS id, p_name, p_partkey % 97 = 0 AS other FROM part), n AS (SELECT DISTINCT id AS name, id FROM d UNION SELECT p_name, id FROM d UNION SELECT 'shared', id FROM d WHERE other)
SELECT id AS name, 'DUPLICATE_ID' AS kind, id AS metric_ids FROM d GROUP BY id HAVING count(*) > 1 UNION ALL SELECT name, 'ALIAS_AMBIGUOUS', string_agg(DISTINCT id, ',' ORDER BY id) FROM n WHERE name <> '' GROUP BY name HAVING count(DISTINCT id) > 1""",
    "resolved_names": f"SELECT k, ['current_ratio', 'debt_to_asset_ratio', NULL, 'quick_ratio', NULL][k % 5 + 1] AS metric_id, [NULL, NULL, 'METRIC_NOT_DEFINED', 'DEFINITION_NONCONFORMANT', 'METRIC_NOT_DEFINED'][k % 5 + 1] AS refusal_code {O}",
    "declared_fields": "SELECT DISTINCT unnest(['bs.' || split_part(p_name, ' ', 1), 'is.' || split_part(p_name, ' ', 2)]) AS field_id FROM part",
    "mapping_differences": f"""{FIELD_SETS} SELECT field_id, 'mapping' AS missing_in FROM (SELECT * FROM d EXCEPT SELECT * FROM m) UNION ALL SELECT field_id, 'definitions' FROM (SELECT * FROM m EXCEPT SELECT * FROM d)""",
    "fields_outside": f"{FIELD_SETS} SELECT * FROM m EXCEPT SELECT * FROM d",
    "mapping_findings": """WITH m AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 8 = 0 THEN 'is.' ELSE 'bs.' END || 'f' || CASE WHEN p_partkey % 40 = 0 THEN 40 ELSE p_partkey END AS field_id, p_partkey % 4 AS kind, p_partkey % 3 <> 0 AS v, p_partkey % 4 = 0 AS r, p_partkey % 5 <> 0 AS s, p_partkey % 6 <> 0 AS h FROM part)
SELECT field_id, c.code FROM m, (VALUES ('MISSING_KEY:variants'), ('MISSING_KEY:role'), ('MISSING_KEY:section'), ('MISSING_KEY:header'), ('FORBIDDEN_KEY:section'), ('FORBIDDEN_KEY:variants'), ('FORBIDDEN_KEY:role'), ('UNKNOWN_KIND'), ('VERSION_TOO_LOW'), ('WRONG_PREFIX')) c(code)
WHERE CASE c.code WHEN 'MISSING_KEY:variants' THEN kind = 0 AND NOT v WHEN 'MISSING_KEY:role' THEN kind = 0 AND NOT r WHEN 'MISSING_KEY:section' THEN kind = 1 AND NOT s WHEN 'MISSING_KEY:header' THEN kind = 2 AND NOT h WHEN 'FORBIDDEN_KEY:section' THEN kind = 0 AND s
WHEN 'FORBIDDEN_KEY:variants' THEN kind IN (1, 2) AND v WHEN 'FORBIDDEN_KEY:role' THEN kind IN (1, 2) AND r WHEN 'UNKNOWN_KIND' THEN kind = 3 WHEN 'VERSION_TOO_LOW' THEN k % 7 = 0 ELSE k % 8 = 0 END
UNION ALL SELECT field_id, 'REPEATED_FIELD' FROM m GROUP BY 1 HAVING count(*) > 1""",
    "registry_snapshot": """WITH n AS (SELECT DISTINCT unnest(['m' || p_partkey, p_name, p_brand]) AS x FROM part), d AS (SELECT sha256(x) AS d FROM n), a AS (SELECT left(d, 4) AS p, sha256(string_agg(d, '' ORDER BY d)) AS x FROM d GROUP BY 1), b AS (SELECT left(p, 2) AS p, sha256(string_agg(x, '' ORDER BY p)) AS x FROM a GROUP BY left(p, 2))
SELECT (SELECT count(*) FROM n) AS n, sha256(string_agg(x, '' ORDER BY p)) AS sha256 FROM b""",
    "definition_versions": "SELECT replace(p_name, ' ', '_') AS metric_id, max(p_size) AS version FROM part GROUP BY 1",
    "silent_changes": "SELECT 'm' || p_partkey AS metric_id FROM part WHERE p_partkey % 4 = 1",
    "short_field_names": """WITH p AS (SELECT p_partkey AS k, 'm' || p_partkey AS metric_id FROM part) SELECT metric_id, 'bs.total' AS field_id, CASE WHEN k % 3 = 0 THEN 'bs.total' ELSE 'total' END AS short FROM p
UNION ALL SELECT metric_id, CASE WHEN k % 3 = 0 THEN 'is.total' ELSE 'is.cost' END, CASE WHEN k % 3 = 0 THEN 'is.total' ELSE 'cost' END FROM p UNION ALL SELECT metric_id, 'notes.x.y', 'y' FROM p""",
    "checked_catalogue": f"""{PARTS}, r AS (
  SELECT metric_id, 'R2.BAD_SIGN_CONVENTION' AS code, 'bs.' || a AS place FROM p WHERE NOT broken UNION ALL SELECT metric_id, 'R2.NO_SIGN_CONVENTION', 'is.' || b FROM p WHERE NOT broken AND p_type <> 'PROMO'
  UNION ALL SELECT metric_id, CASE WHEN p_brand = 'Brand#3' THEN 'R4.SYSTEM_SCOPE_FLAG_DECLARED' ELSE 'R4.FLAG_NOT_IN_VOCABULARY' END, p_brand FROM p WHERE NOT broken AND p_brand NOT IN ('Brand#1', 'Brand#2')
  UNION ALL SELECT metric_id, 'R4.TRIGGER_UNDECLARED_FIELD', p_brand || ':is.' || a FROM p WHERE NOT broken AND p_size > 45 AND a <> b UNION ALL SELECT metric_id, 'R6.NO_MISSING_REPRESENTATION', 'is.' || b FROM p WHERE NOT broken
  UNION ALL SELECT metric_id, 'R8.TOO_FEW_PITFALLS', '' FROM p WHERE NOT broken UNION ALL SELECT metric_id, 'R9.VERSION_TOO_LOW', '' FROM p WHERE NOT broken AND p_size < 2
) SELECT * FROM r UNION ALL SELECT * FROM t""",
    "deferred_flags": "SELECT 'm' || p_partkey AS metric_id, p_brand AS flag, p_size < 10 AS deferred FROM part",
    "text_findings": f"{PARTS} SELECT metric_id, code, place FROM t",
    "gated_requests": f"""WITH r AS (SELECT k, ['', 'conformant', 'closed', 'namespace', 'declared', 'resolve', ''][k % 7 + 1] AS f, k % 3 = 2 AS other {O}), t AS (SELECT k, CASE WHEN f IN ('resolve', 'conformant') THEN f WHEN other THEN 'version' ELSE nullif(f, '') END AS f FROM r)
SELECT k, CASE WHEN f IS NULL THEN 'passed' ELSE 'refused' END AS gate, f AS failed_check, CASE f WHEN 'resolve' THEN 'METRIC_NOT_DEFINED' WHEN 'conformant' THEN 'DEFINITION_NONCONFORMANT' WHEN 'version' THEN 'CROSS_VERSION_COMPARISON' WHEN 'closed' THEN 'UNEVALUABLE_CONDITION' WHEN 'namespace' THEN 'UNEVALUABLE_CONDITION' WHEN 'declared' THEN 'UNEVALUABLE_CONDITION' END AS refusal_code FROM t""",
    "incoherent_records": f"""WITH r AS (SELECT k AS key, ['GOT', 'ABSENT', 'UNKNOWN'][k % 3 + 1] AS r, ['V', 'A', NULL, 'E'][k % 4 + 1] AS s, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 0 ELSE 7 END AS v, ['S', 'P', 'R', 'S', 'S', 'S', 'P'][k % 7 + 1] AS status, k % 2 = 0 AS stats, k % 2 = 0 AS amount, k % 9 <> 0 AS basis {O})
SELECT key, p.problem FROM r, (VALUES ('UNKNOWN_WITH_VALUE'), ('KNOWN_WITHOUT_STATE'), ('PRESENT_WITHOUT_VALUE'), ('EMPTY_NOT_ZERO'), ('ABSENT_WITH_VALUE'), ('PARTIAL_WITHOUT_STATS'), ('STATS_WITHOUT_PARTIAL'), ('BASIS_MISSING'), ('BASIS_FORBIDDEN')) p(problem)
WHERE CASE p.problem WHEN 'UNKNOWN_WITH_VALUE' THEN r = 'UNKNOWN' AND (s IS NOT NULL OR v IS NOT NULL) WHEN 'KNOWN_WITHOUT_STATE' THEN r <> 'UNKNOWN' AND s IS NULL WHEN 'PRESENT_WITHOUT_VALUE' THEN s = 'V' AND (r <> 'GOT' OR v IS NULL)
WHEN 'EMPTY_NOT_ZERO' THEN s = 'E' AND (r <> 'GOT' OR v IS NULL OR v <> 0) WHEN 'ABSENT_WITH_VALUE' THEN s = 'A' AND (r <> 'ABSENT' OR v IS NOT NULL) WHEN 'PARTIAL_WITHOUT_STATS' THEN status = 'P' AND NOT stats WHEN 'STATS_WITHOUT_PARTIAL' THEN status <> 'P' AND stats
WHEN 'BASIS_MISSING' THEN amount AND NOT basis ELSE NOT amount AND basis END""",
    "truncation_problems": f"""SELECT * FROM (SELECT k AS key, CASE WHEN k % 3 = 2 OR k % 4 = 3 THEN 'NO_STATUS' WHEN k % 3 = 0 AND k % 4 < 2 THEN 'SUCCESS_WITH_STATS' WHEN k % 3 = 1 AND k % 4 = 2 THEN 'PARTIAL_WITHOUT_STATS' WHEN k % 3 = 1 AND k % 4 = 0 THEN 'PARTIAL_OF_ZERO' END AS problem {O}) WHERE problem IS NOT NULL""",
    "evidence_gaps": f"""WITH r AS (SELECT k, k % 3 AS kind, [NULL, 'source_url:null', 'source_url:blank', 'source_url:placeholder', NULL][k % 5 + 1] AS u, CASE WHEN k % 2 = 1 THEN 'column_header:placeholder' END AS h, CASE WHEN k % 7 = 0 THEN 'page:not_positive' END AS p, CASE WHEN k % 11 = 0 THEN 'mapping_version:null' END AS m, [NULL, 'freshness:unknown', NULL, 'freshness:null'][k % 4 + 1] AS f {O}),
g AS (SELECT k, CASE kind WHEN 0 THEN 6 WHEN 1 THEN 4 ELSE 0 END AS total, CASE kind WHEN 0 THEN list_filter([u, h, p, m, f], lambda x: x IS NOT NULL) WHEN 1 THEN list_filter([u, p, f], lambda x: x IS NOT NULL) ELSE [] END AS found FROM r)
SELECT k AS key, total - len(found) AS filled, total, CASE WHEN total = 0 THEN 0 ELSE round((total - len(found)) / total, 6) END AS rate, array_to_string(found, ',') AS gaps FROM g""",
    "answer_gaps": f"""SELECT k AS key, concat_ws(',', CASE WHEN k % 2 = 1 THEN CASE WHEN k % 3 <> 1 THEN 'metric_version:not_applicable' END ELSE [NULL, 'metric_version:null', 'metric_version:zero'][k % 3 + 1] END, [NULL, 'data_source:placeholder', 'data_source:blank'][k % 3 + 1], CASE WHEN k % 4 = 3 THEN 'execution_hash:null' END) AS gaps {O}""",
    "execution_hashes": f"""SELECT k, CASE WHEN k % 3 = 0 THEN sha256(concat_ws(chr(1), 'refusal', 'q' || k, CASE WHEN k % 4 = 0 THEN chr(0) ELSE 'm' END, 'UNAVAILABLE', 's')) ELSE sha256(concat_ws(chr(1), 'value', 'q' || k, CASE WHEN k % 4 = 0 THEN chr(0) ELSE 'm' END, '2', '000001', '2023', 'a=' || k || chr(2) || 'b=' || chr(0))) END AS execution_hash {O}""",
    "shown_values": f"SELECT k, ['0', '（空值）', '（缺失：数据源里没有这一行）', '是', '否', '12.5'][k % 6 + 1] AS shown {O}",
    "coerced_values": f"""WITH r AS (SELECT k, ['1,234.5', 'abc', NULL, '-', '0'][k % 5 + 1] AS raw, k % 7 <> 6 AS there, ['-', NULL, '0'][k % 3 + 1] AS rep, k % 2 = 0 AS same {O})
SELECT k, CASE raw WHEN '1,234.5' THEN 1234.5 WHEN '0' THEN 0.0 END AS value, CASE WHEN raw IN ('abc', '-') THEN raw END AS kept, CASE WHEN there AND NOT (rep IS NULL AND raw IS NULL) AND NOT (same AND coalesce(raw = rep, false)) THEN raw END AS normalised FROM r""",
    "plain_names": f"SELECT k, ['甲公司', '甲（集团）公司', '乙公司'][k % 3 + 1] AS name {O}",
    "merged_names": """SELECT p_type || p_partkey % 500 AS name, min(p_brand) AS code, max(CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 3 <> 0 THEN 'real' ELSE 'synthetic' END) AS nature FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1""",
    "sourced_rows": """SELECT c_custkey AS k, coalesce(s_name, CASE WHEN c_custkey % 2 = 0 THEN c_name END) AS name, CASE WHEN s_name IS NOT NULL THEN '0' WHEN c_custkey % 2 = 0 THEN '1' ELSE 'EMPTY' END AS source FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""",
    "source_coverage": """SELECT CASE WHEN o_custkey % 3 = 0 THEN 'real' ELSE 'synthetic' END AS nature, count(DISTINCT o_custkey) AS entities, count(DISTINCT (o_custkey, year(o_orderdate))) AS periods, count(DISTINCT substr(o_orderpriority, 1, 1)) AS fixtures FROM orders GROUP BY 1""",
    "entity_snapshot": """WITH d AS (SELECT DISTINCT sha256(s_name) AS d FROM supplier), a AS (SELECT left(d, 4) AS p, sha256(string_agg(d, '' ORDER BY d)) AS x FROM d GROUP BY 1), b AS (SELECT left(p, 2) AS p, sha256(string_agg(x, '' ORDER BY p)) AS x FROM a GROUP BY left(p, 2))
SELECT count(DISTINCT s_nationkey) AS entities, count(DISTINCT s_name) AS name_count, count(DISTINCT s_nationkey) FILTER (WHERE s_acctbal < 0) AS synthetic, (SELECT sha256(string_agg(x, '' ORDER BY p)) FROM b) AS sha256 FROM supplier""",
    "derived_values": f"{WITH} SELECT suppkey, period, CASE WHEN kpi_roe_weighted_average_disclosed_state IS NULL THEN 0.5 ELSE CAST(kpi_roe_weighted_average_disclosed AS DOUBLE) END AS value FROM st",
    "case_attribution": f"{JUDGED} SELECT k, status, CASE WHEN status IN ('PASS', 'FAIL') THEN kind END AS kind, layers, false AS unmapped FROM a",
    "layer_usage": f"{JUDGED} SELECT l.layer, count(k) AS n FROM (VALUES ('意图层'), ('检索层'), ('口径层'), ('计算层'), ('表达层')) l(layer) LEFT JOIN a ON status = 'FAIL' AND contains(layers, l.layer) GROUP BY 1",
    "reachable_layers": f"{JUDGED} SELECT l.layer, l.layer <> '表达层' AS reachable, count(k) > 0 AS reached FROM (VALUES ('意图层'), ('检索层'), ('口径层'), ('计算层'), ('表达层')) l(layer) LEFT JOIN a ON status = 'FAIL' AND contains(layers, l.layer) GROUP BY l.layer",
    "case_summary": f"{JUDGED}, g AS (SELECT category, {BY_CATEGORY} FROM a GROUP BY 1) SELECT *, authored - voided AS surviving, CASE WHEN executed = 0 THEN 'NOT_RUN' WHEN passed = executed THEN 'PASS' ELSE 'FAIL' END AS status FROM g",
    "suite_gate": f"""{JUDGED} SELECT count(*) AS authored, count(*) FILTER (WHERE status = 'VOIDED') AS voided, count(*) FILTER (WHERE status IN ('PASS', 'FAIL')) AS scored, count(*) FILTER (WHERE status = 'NOT_RUN') AS not_run, count(*) FILTER (WHERE status = 'PASS') AS passed,
round(count(*) FILTER (WHERE status = 'VOIDED') / count(*), 4) AS void_ratio, count(*) FILTER (WHERE status = 'VOIDED') / count(*) <= 0.1 AS void_within, count(*) FILTER (WHERE category = 'C2' AND status = 'FAIL') = 0 AS refusal_gate FROM a""",
    "case_hints": f"{JUDGED} SELECT k AS case_id, layers, CASE WHEN hinted THEN 'foreseen here' END AS hint FROM a WHERE status = 'FAIL'",
    "claim_cases": f"""WITH p AS (SELECT k, CASE WHEN k % 13 = 0 OR k % 3 = 0 THEN 'READ_AS' WHEN k % 5 = 0 THEN 'SEGMENTATION' WHEN k % 7 = 0 THEN 'VERDICT' WHEN k % 2 = 0 AND k % 11 = 0 THEN 'INHERITED' END AS problem {O}) SELECT k AS case_id, problem IS NULL AS passed, problem FROM p""",
    "freeze_problems": f"""WITH f AS (SELECT k, CASE WHEN k % 2 = 0 THEN 'cases/' ELSE 'other/' END || k AS path {O}) SELECT path, problem FROM (SELECT path, CASE WHEN k % 7 = 0 THEN CASE WHEN k % 11 <> 0 THEN 'MISSING_FILE' END WHEN k % 11 = 0 THEN CASE WHEN k % 2 = 0 THEN 'NOT_LISTED' END WHEN k % 5 = 0 THEN 'CHANGED' END AS problem FROM f) WHERE problem IS NOT NULL""",
    "case_preconditions": f"""WITH r AS (SELECT k, 'f' || lpad(CAST(k AS VARCHAR), 10, '0') AS file {O}), h AS (SELECT min(file) AS first FROM r WHERE k % 100 = 0)
SELECT file, p.problem FROM r, h, (VALUES ('MISSING:question'), ('REPEATED_ID'), ('NO_TARGET'), ('TARGET_EXISTS'), ('UNKNOWN_METRIC'), ('UNKNOWN_FIXTURE')) p(problem)
WHERE CASE p.problem WHEN 'MISSING:question' THEN k % 9 = 0 WHEN 'REPEATED_ID' THEN k % 100 = 0 AND file <> first WHEN 'NO_TARGET' THEN k % 2 = 1 AND k % 5 = 0 WHEN 'TARGET_EXISTS' THEN k % 2 = 1 AND k % 5 > 1 WHEN 'UNKNOWN_METRIC' THEN k % 2 = 0 AND k % 3 = 0 ELSE k % 7 = 0 END""",
    "baseline_judgements": f"""SELECT k, CASE WHEN k % 4 = 3 THEN 'ERROR' WHEN k % 10 = 9 THEN 'NOT_COMPARABLE' WHEN k % 5 = 0 THEN CASE WHEN k % 3 = 0 AND ((k % 6 < 3 AND k % 2 = 0) OR (k % 6 >= 3 AND k % 2 = 1)) THEN 'PASS' ELSE 'FAIL' END WHEN k % 3 = 0 OR k % 7 > 1 THEN 'FAIL' ELSE 'PASS' END AS status {O}""",
    "packet_leaks": "SELECT DISTINCT item_id AS packet_id, source AS page, sha256(b.text) AS probe FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) > 0",
    "packet_order": "SELECT c_custkey AS k, row_number() OVER (ORDER BY sha256('7:' || c_custkey), c_custkey) AS place FROM customer",
    "review_packets": f"SELECT k AS case_id, CASE WHEN k % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN k % 5 <> 0 THEN '对' END AS vote {O} WHERE k % 3 <> 0",
    "ranked_pitfalls": "SELECT p_brand AS metric_id, row_number() OVER (ORDER BY round(count(*) FILTER (WHERE p_partkey % 3 = 0) / count(*), 6) DESC, p_brand) AS rank FROM part GROUP BY 1",
    "pitfall_limit": "SELECT round(count(*) FILTER (WHERE p_partkey % 2 = 0) / count(*), 6) AS advisory_ratio, round(count(*) FILTER (WHERE p_partkey % 2 = 0) / count(*), 6) > 0.5 AS fails FROM part",
    "blocked_review": "SELECT 'PASS' AS gate, 'not_blind,no_wrong_case' AS blocks, 'BLOCKED' AS final",
    "scanned_repository": """WITH f AS (SELECT *, CASE WHEN p_size > 25 THEN 'data/' ELSE 'src/' END || p_partkey || CASE WHEN p_type = 'PROMO' THEN '.pdf' ELSE '.md' END AS path FROM part WHERE p_size >= 5)
SELECT path, 'forbidden_type' AS rule, '.pdf' AS detail FROM f WHERE p_type = 'PROMO' UNION ALL SELECT path, 'secret', 'secret: ' || replace(p_name, ' ', '_') FROM f WHERE p_brand = 'Brand#1' AND length(p_name) >= 8
UNION ALL SELECT path, 'statement_elsewhere', '' FROM f WHERE p_brand = 'Brand#2' AND p_size <= 25
UNION ALL SELECT '.gitignore', 'ignore_coverage_lost', x FROM (SELECT unnest(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD', 'data/raw']) AS x) WHERE x NOT IN (SELECT p_type FROM part WHERE p_size = 50 AND p_type < 'P')""",
    "scanned_files": """WITH f AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN 'data/' ELSE 'src/' END || p_partkey || CASE WHEN p_partkey % 6 = 0 THEN '.pdf' ELSE '.md' END AS path FROM part)
SELECT path, r.rule, r.detail FROM f, (VALUES ('forbidden_type', '.pdf'), ('secret', 'api_key = abcdefgh1'), ('absolute_path', '/home/me'), ('statement_elsewhere', '')) r(rule, detail)
WHERE (k % 10 <> 0 OR k % 4 = 0) AND CASE r.rule WHEN 'forbidden_type' THEN k % 6 = 0 WHEN 'secret' THEN k % 7 = 0 WHEN 'absolute_path' THEN k % 9 = 0 ELSE k % 5 = 0 AND k % 4 <> 0 END""",
}
