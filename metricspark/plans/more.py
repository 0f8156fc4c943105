"""Queries on intake, stated numbers and review, with their SQL; cases are set by rule on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricspark.operators import intake, numbers, review
from metricspark.sources.statements import table

PRICE = "CAST(o_totalprice AS DECIMAL(12,2))"


def orders(spark: SparkSession, sf_dir: str):
    return table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(12,2)")


def text_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of every text with its white space made plain."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(numbers.normalised(F.col("text")).cast("binary"), 256).alias("fingerprint"))


def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences on orders with a code, a year, and one to three numbers."""
    o, k, price = orders(spark, sf_dir)
    unit = F.when(k % 5 == 0, "万元").when(k % 5 == 1, "%").when(k % 5 == 2, "个百分点").when(k % 5 == 3, "").otherwise("亿")
    code = F.lpad((F.col("o_custkey") % 1000000).cast("string"), 6, "0")
    said = F.concat(
        code, F.lit(" 2023 年 total "), F.format_number(price, 2), unit,
        F.when(k % 6 == 0, " against 7.5").otherwise(""), F.when(k % 4 == 0, ", 123456 万元").otherwise(""), F.when(k % 7 == 0, "; 2022年").otherwise(""),
    )
    return o.select(k.alias("key"), said.alias("text"))


def stated_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = told(spark, sf_dir).select("key", F.posexplode(numbers.stated(F.col("text"))).alias("pos", "x"))
    return rows.select("key", "pos", F.col("x.value").cast("double").alias("value"), "x.tolerance", "x.delta")


STATED_SQL = f"""WITH s AS (SELECT o_orderkey AS k, {PRICE} AS p, CASE o_orderkey % 5 WHEN 0 THEN 10000.0 WHEN 1 THEN 0.01 WHEN 2 THEN 0.01 WHEN 3 THEN 1.0 ELSE 100000000.0 END AS f FROM orders)
SELECT k AS key, 0 AS pos, CAST(p * CAST(f AS DECIMAL(11,2)) AS DOUBLE) AS value, round(CAST(f AS DOUBLE) / 200, 10) AS tolerance, k % 5 = 2 AS delta FROM s UNION ALL
SELECT k, 1, 7.5, 0.05, false FROM s WHERE k % 6 = 0 UNION ALL
SELECT k, CASE WHEN k % 6 = 0 THEN 2 ELSE 1 END, 1234560000.0, 5000.0, false FROM s WHERE k % 4 = 0"""


def stated_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many codes and years a sentence names, and the year if it is one."""
    codes, years = numbers.codes(F.col("text")), numbers.years(F.col("text"))
    rows = told(spark, sf_dir)
    return rows.select("key", F.size(codes).alias("codes"), F.size(years).alias("years"), F.when(F.size(years) == 1, years[0]).alias("year"))


def unit_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k, _ = orders(spark, sf_dir)
    said = (
        F.when(k % 6 == 0, "单位:元 币种:人民币").when(k % 6 == 1, "单位：万元 币种：人民币").when(k % 6 == 2, "编制单位:某公司 单位:亿元 币种:美元")
        .when(k % 6 == 3, "单位:吨 币种:人民币").when(k % 6 == 4, "编制单位:某公司 币种:人民币")
    )
    return o.select(k.alias("key"), intake.unit_header(said).alias("u")).select("key", "u.*")


def annual_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k, _ = orders(spark, sf_dir)
    titles = ("2023年年度报告", "2023年年度报告摘要", "2022年年度报告", "2023年年度报告（英文版）", "2023年年度报告（更正）")
    title = F.element_at(F.array(*map(F.lit, titles)), (k % 5 + 1).cast("int"))
    said = o.select(F.col("o_custkey").alias("code"), F.lit(2023).alias("year"), title.alias("title"), F.col("o_orderdate").alias("time"), k.cast("string").alias("url"))
    return intake.annual_reports(said)


def reference_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    total, cash = F.create_map(F.lit("total"), k.cast("string")), F.create_map(F.lit("cash"), F.when(k % 3 == 2, "1"))
    rows = table(spark, sf_dir, "customer").select(k.alias("key"), F.when(k % 3 == 0, total).otherwise(F.map_concat(total, cash)).alias("row"))
    return intake.references(rows, (("bs_total", "total"), ("bs_cash", "cash"), ("bs_debt", "debt")))


def batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k, _ = orders(spark, sf_dir)
    digest = F.when(k % 10 == 0, "unread").otherwise(F.sha2(k.cast("string").cast("binary"), 256))
    code = F.lpad(F.col("o_custkey").cast("string"), 8, "0")
    return o.select(k.alias("key"), intake.batch_id(code, 1990 + k % 30, digest).alias("batch_id"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), price.alias("price"))


def row_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as rows of a statement with three fields; some cells are empty."""
    amount = F.when(F.col("p") % 4 != 0, F.col("price"))
    rows = lines(spark, sf_dir).select(F.col("k").alias("doc"), (F.col("n") % 3).cast("int").alias("field"), amount.alias("amount"))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"))
    return intake.row_facts(docs, rows, [0, 1, 2]).withColumn("amount", F.col("amount").cast("double"))


def verified_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as batches and lines as fields; some lists have a wrong value, a field too many or another digest."""
    k = F.col("batch")
    records = lines(spark, sf_dir).groupBy(F.col("k").alias("batch"), F.col("n").alias("field")).agg(F.sum("price").alias("value"))
    listed = records.filter("field <= 2")
    expected = F.when((k % 7 == 0) & (F.col("field") == 1), F.col("value") + 1).otherwise(F.col("value"))
    field = F.when((k % 11 == 0) & (F.col("field") == 2), 9).otherwise(F.col("field"))
    allowed = listed.select("batch", field.alias("field"), expected.alias("expected"))
    o, key, _ = orders(spark, sf_dir)
    batches = o.select(key.alias("batch"), F.lit("a").alias("digest"), F.when(key % 13 == 0, "b").when(key % 2 == 0, "a").alias("checked_digest"))
    return intake.verified(records, allowed, batches).withColumn("value", F.col("value").cast("double"))


def pitfall_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("metric_id"), F.when(k % 2 == 0, "flags").alias("enforced_by"), (k % 3 == 0).alias("advisory"))
    return review.pitfall_statistics(rows)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as answers with wanted values, metrics and versions, some of them missed."""
    o, k, price = orders(spark, sf_dir)
    cent = F.lit("0.01").cast("decimal(12,2)")
    rows = o.select(
        k.alias("key"), (k % 9 == 0).alias("refused"), F.when(k % 10 != 0, price).alias("value"),
        F.when(k % 5 == 0, "b").otherwise("a").alias("metric_id"), F.lit(2).alias("version"),
        F.when(k % 17 != 0, price + (k % 4).cast("decimal(2,0)") * cent).alias("want"), (k % 12 != 0).alias("want_scalar"),
        F.when(k % 7 != 0, "a").alias("want_metric"), F.when(k % 8 == 0, 1).otherwise(2).alias("want_version"),
        cent.alias("abs_tol"), F.lit(None).cast("decimal(18,6)").alias("rel_tol"),
        F.array_repeat(F.lit("layer"), (k % 3).cast("int")).alias("layers"), F.array_repeat(F.lit("gap"), (k % 2).cast("int")).alias("gaps"),
    )
    return review.judged(rows)


CASES_SQL = """WITH j AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN 'REFUSED_BUT_SHOULD_ANSWER' WHEN o_orderkey % 10 = 0 THEN 'NO_VALUE_NO_REFUSAL' WHEN o_orderkey % 12 = 0 THEN 'EXPECTED_NON_SCALAR'
WHEN o_orderkey % 17 = 0 OR o_orderkey % 4 > 1 THEN 'VALUE_OUT_OF_TOLERANCE' WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0 THEN 'WRONG_METRIC' WHEN o_orderkey % 8 = 0 THEN 'WRONG_VERSION' END AS kind FROM orders)"""


def answer_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("key", "status", "kind")


def answer_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.rates(cases(spark, sf_dir))


def counted(name: str, of: str, hit: str) -> str:
    return f"SELECT '{name}' AS rate_name, count(*) FILTER (WHERE ({of}) AND ({hit})) AS hits, count(*) FILTER (WHERE {of}) AS total FROM j"


RATES_SQL = f"{CASES_SQL} SELECT *, round(hits / nullif(total, 0), 6) AS rate FROM (" + " UNION ALL ".join(
    counted(*x)
    for x in (
        ("answers", "k % 17 <> 0", "kind IS NULL"),
        ("definitions", "k % 7 <> 0", "k % 5 <> 0 AND k % 8 <> 0"),
        ("attribution", "kind IS NOT NULL", "k % 3 > 0"),
        ("evidence", "true", "k % 2 = 0"),
    )
) + ")"


def review_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    vote = F.when(k % 5 == 0, review.CANNOT).when(k % 5 == 1, review.WRONG).otherwise(review.RIGHT)
    return review.review_score(table(spark, sf_dir, "customer").select(F.when(k % 4 == 0, "FAIL").otherwise("PASS").alias("status"), vote.alias("vote")))


def version_comparability(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("version"))
    pairs = table(spark, sf_dir, "part").select(
        k.alias("key"), F.lit(2).alias("version_a"), F.when(k % 4 == 0, 3).otherwise(2).alias("version_b"),
        F.array(s("s0", k), s("s1", k % 2), s("s2", k % 3)).alias("basis_a"), F.array(s("s1", F.lit(1)), s("s2", F.lit(1)), s("s3", k)).alias("basis_b"),
    )
    return review.comparable(pairs).select("key", "code", "basis")


QUERIES = {
    f.__name__: f
    for f in (
        text_fingerprints, stated_numbers, stated_subjects, unit_headers, annual_reports, reference_values, batch_ids, row_facts,
        verified_exports, pitfall_statistics, answer_judgements, answer_rates, review_score, version_comparability,
    )
}

COUNTS = "count(*) AS total, count(*) FILTER (WHERE p_partkey % 2 = 0 AND p_partkey % 3 <> 0) AS enforced, count(*) FILTER (WHERE p_partkey % 3 = 0) AS advisory, count(*) FILTER (WHERE p_partkey % 2 = 1 AND p_partkey % 3 <> 0) AS unclassified, round(count(*) FILTER (WHERE p_partkey % 3 = 0) / count(*), 6) AS advisory_ratio FROM part"
ORACLES = {
    "text_fingerprints": rf"SELECT doc_id, sha256(trim(regexp_replace(text, '{numbers.BLANK}', ' ', 'g'), ' ')) AS fingerprint FROM documents",
    "stated_numbers": STATED_SQL,
    "stated_subjects": "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 4 = 0 AND o_custkey % 1000000 <> 123456 THEN 2 ELSE 1 END AS codes, CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS years, CASE WHEN o_orderkey % 7 <> 0 THEN '2023' END AS year FROM orders",
    "unit_headers": """SELECT o_orderkey AS key, CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 10000 WHEN 2 THEN 100000000 END AS scale, CASE o_orderkey % 6 WHEN 0 THEN '人民币' WHEN 1 THEN '人民币' WHEN 2 THEN '美元' END AS currency,
CASE o_orderkey % 6 WHEN 3 THEN 'UNKNOWN_UNIT' WHEN 4 THEN 'UNREADABLE' WHEN 5 THEN 'EMPTY' END AS error FROM orders""",
    "annual_reports": """WITH a AS (SELECT o_custkey AS code, CAST(o_orderdate AS VARCHAR) AS t, CAST(o_orderkey AS VARCHAR) AS url, CASE o_orderkey % 5 WHEN 0 THEN '2023年年度报告' ELSE '2023年年度报告（更正）' END AS title FROM orders WHERE o_orderkey % 5 IN (0, 4))
SELECT code, 2023 AS year, arg_min(title, (t, url)) AS title, arg_min(url, (t, url)) AS url FROM a GROUP BY 1""",
    "reference_values": """SELECT c_custkey AS key, 'bs_total' AS field_id, true AS present, CAST(c_custkey AS VARCHAR) AS raw FROM customer UNION ALL
SELECT c_custkey, 'bs_cash', c_custkey % 3 > 0, CASE WHEN c_custkey % 3 = 2 THEN '1' END FROM customer UNION ALL SELECT c_custkey, 'bs_debt', false, NULL FROM customer""",
    "batch_ids": "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 10 <> 0 THEN substr(sha256(concat_ws(':', lpad(CAST(o_custkey AS VARCHAR), 8, '0'), 1990 + o_orderkey % 30, sha256(CAST(o_orderkey AS VARCHAR)))), 1, 16) END AS batch_id FROM orders",
    "row_facts": """WITH r AS (SELECT l_orderkey AS doc, l_linenumber % 3 AS field, count(*) AS n, min(CASE WHEN l_partkey % 4 <> 0 THEN CAST(l_extendedprice AS DECIMAL(12,2)) END) AS v FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey AS doc, f.field, CASE WHEN n IS NULL THEN 'ABSENT' WHEN n = 1 THEN 'GOT_VALUE' ELSE 'ATTEMPTED_UNKNOWN' END AS retrieval,
CASE WHEN n IS NULL THEN 'ROW_ABSENT' WHEN n = 1 THEN CASE WHEN v IS NULL THEN 'EMPTY_CELL' ELSE 'VALUE_PRESENT' END END AS state, CASE WHEN n = 1 THEN CAST(coalesce(v, 0) AS DOUBLE) END AS amount
FROM orders, (VALUES (0), (1), (2)) f(field) LEFT JOIN r ON r.doc = o_orderkey AND r.field = f.field""",
    "verified_exports": """WITH r AS (SELECT l_orderkey AS batch, l_linenumber AS field, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS value FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2),
bad AS (SELECT DISTINCT batch FROM r WHERE (batch % 7 = 0 AND field = 1) OR (batch % 11 = 0 AND field = 2) OR batch % 13 = 0)
SELECT batch, field, CAST(value AS DOUBLE) AS value FROM r WHERE batch NOT IN (SELECT batch FROM bad) AND batch IN (SELECT o_orderkey FROM orders)""",
    "pitfall_statistics": f"SELECT p_brand AS metric_id, false AS overall, {COUNTS} GROUP BY 1 UNION ALL SELECT NULL, true, {COUNTS}",
    "answer_judgements": f"{CASES_SQL} SELECT k AS key, CASE WHEN kind IS NULL THEN 'PASS' ELSE 'FAIL' END AS status, kind FROM j",
    "answer_rates": RATES_SQL,
    "review_score": """WITH v AS (SELECT c_custkey % 4 = 0 AS bad, c_custkey % 5 AS m FROM customer), c AS (SELECT count(*) AS n, count(*) FILTER (WHERE (bad AND m = 1) OR (NOT bad AND m > 1)) AS agreed, count(*) FILTER (WHERE m = 0) AS undecidable,
count(*) FILTER (WHERE bad) AS wrong, count(*) FILTER (WHERE bad AND m = 1) AS wrong_agreed FROM v)
SELECT *, round(agreed / n, 6) AS agreed_rate, round(undecidable / n, 6) AS undecidable_rate, CASE WHEN agreed / n >= 0.8 THEN 'PASS' WHEN agreed / n >= 0.6 THEN 'PARTIAL' ELSE 'FAIL' END AS gate, undecidable / n <= 0.2 AS within_limit FROM c""",
    "version_comparability": """SELECT p_partkey AS key, CASE WHEN p_partkey % 4 = 0 THEN 'CROSS_VERSION_COMPARISON' WHEN p_partkey % 2 = 0 OR p_partkey % 3 <> 1 THEN 'CROSS_BASIS_VERSION_COMPARISON' END AS code,
CASE WHEN p_partkey % 4 <> 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 's1' WHEN p_partkey % 3 <> 1 THEN 's2' END END AS basis FROM part""",
}
