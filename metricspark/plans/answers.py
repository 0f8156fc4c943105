"""Queries on questions and their answers, conditions, and layouts kept as text, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricspark import storage
from metricspark.operators import checks, expressions, intake, intent, metrics, numbers, pages, registry, text
from metricspark.plans import catalogue
from metricspark.plans.definitions import DEFINITIONS
from metricspark.plans.metric_sql import METRICS
from metricspark.sources.statements import entity, statements, table

#: Texts of conditions on x (a number that may be missing) and y (a boolean that may be).
CONDITIONS = {
    "either": "bs.x <= 0 or notes.y == true",
    "both": "is_missing(bs.x) and notes.y != false",
    "neither": "not (bs.x > 2 or is_missing(notes.y))",
    "null_test": "bs.x == null or bs.x != 1.5",
    "mixed": "notes.y == 'yes' or bs.x >= -1",
    "order_of_null": "bs.x < null",
}


def condition_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each condition on each order: true, false, or null where it can't be decided."""
    cell = lambda p: ("x", "number") if p == "bs.x" else ("y", "boolean")
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderkey % 4 AS DECIMAL(12,2)) * 1.5 END AS x", "CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS y")
    return rows.selectExpr("k", *(f"{expressions.condition(t, cell)} AS {n}" for n, t in CONDITIONS.items()))


def company(code: Column) -> Column:
    return F.concat(F.lit("Co"), F.translate(code, "0123456789", "ABCDEFGHIJ"))


#: Names that questions use, in a fixed order.
SAID = sorted((a, d.metric_id) for d in DEFINITIONS for a in (d.display, *d.aliases))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question for each order, on the suppliers of its lines, its year and, by its customer, a metric: by code or name, in doubt, on several, of no period, of no metric."""
    kind = F.col("o_orderkey") % 12
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b"))
    code, second = entity(F.col("a")), entity(F.col("b"))
    who = F.when(kind == 1, company(code)).when(kind == 2, F.concat(F.lit("南"), company(code))).when(kind == 3, F.concat(company(code), F.lit("集团"))).when(kind == 4, F.concat(company(code), F.lit("股份有限公司")))
    who = who.when(kind == 5, F.concat(company(code), F.lit(" "), company(second))).when(kind == 6, F.concat(code, F.lit(" "), second)).when(kind == 7, F.lit("someone")).otherwise(code)
    year = F.concat(F.year("o_orderdate").cast("string"), F.lit("年 "))
    year = F.when(kind == 8, F.lit("")).when(kind == 9, F.concat(year, (F.year("o_orderdate") + 1).cast("string"), F.lit("年 "))).otherwise(year)
    name = F.element_at(F.array(*(F.lit(a) for a, _ in SAID)), (F.col("o_custkey") % len(SAID) + 1).cast("int"))
    metric = F.when(kind == 10, F.lit("weather")).when(kind == 11, F.lit("bearing debt ratio")).otherwise(name)
    return table(spark, sf_dir, "orders").join(own, "o_orderkey").select(F.col("o_orderkey").alias("k"), F.concat(who, F.lit(" "), year, metric).alias("text"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(entity(F.col("s_suppkey")).alias("code"))
    return rows.select(company(F.col("code")).alias("name"), "code")


def company_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = storage.kept(asked(spark, sf_dir), "asked")  # read twice
    found = intent.companies_in(questions, companies(spark, sf_dir), text.aliases(spark), "k")
    return found.select("k", F.array_join("codes", ",").alias("codes"), "doubt")


def question_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from a question to a value or a typed refusal."""
    questions = storage.kept(asked(spark, sf_dir), "asked")  # read three times
    read = intent.intents(questions, text.aliases(spark), companies(spark, sf_dir), "k")
    found = intent.answers(read, metrics.metric_values(statements(spark, sf_dir)))
    return found.select("k", "metric_id", "entity", "period", "value", "refusal_code", "reason")


def plain_near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near misses among names without blanks, of which any character counts."""
    names = spark.createDataFrame([("毛利率", "a", "毛利率"), ("综合毛利率", "b", "综合毛利率"), ("调整后毛利率", "c", "调整后毛利率")], "alias string, metric_id string, display string")
    rows = catalogue.keyed(spark, sf_dir).select("k", catalogue.rule("q", "'看毛利率'", "'看合毛利率'", "'看综合毛利率'", "'看后毛利率'", "'天气'"))
    return text.near_misses(text.named(rows, names, "q", ["k"]), names, "q", blanks=True).select("k", "alias", "near")


def masked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "concat('a ', lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0'), CASE o_orderkey % 3 WHEN 0 THEN ' 万元' WHEN 1 THEN '' ELSE ' 2023 年' END, ' 1.5') AS t")
    return rows.select("k", numbers.masked(F.col("t")).alias("masked"))


def long_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of up to thirty claims, of which the first 24 are checked; and texts without numbers, which are questions."""
    n = F.col("s_suppkey") % 31
    one = F.concat(F.lit("000001 1996年 weather is "), F.when(F.col("s_suppkey") % 7 == 0, "fine").otherwise("0.5"))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.array_join(F.array_repeat(one, n.cast("int")), "。").alias("text"))
    none = spark.createDataFrame([], "entity string, period long, metric_id string, value decimal(38,10), refusal_code string")
    judged = intent.claims(rows, none, text.aliases(spark), companies(spark, sf_dir))
    return judged.select("doc_id", "pos", "read_as", "verdict", "why")


def cross_source_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why two sources can't be compared, all seven reasons in their order."""
    k = F.col("k")
    rows = catalogue.keyed(spark, sf_dir)
    amount = F.lit("10.00").cast("decimal(12,2)")
    ours = rows.select(k.alias("key"), F.when(k % 17 != 0, amount).alias("value"), F.lit("元").alias("unit"), F.lit("20231231").alias("period"), F.lit("人民币").alias("currency"))
    theirs = rows.select(
        k.alias("key"), (k % 2 != 0).alias("present"), F.when(k % 19 != 0, amount).alias("value"), F.when(k % 13 == 0, "吨").otherwise("元").alias("unit"),
        F.when(k % 7 == 0, "20221231").otherwise("20231231").alias("period"), F.when(k % 11 == 0, "美元").when(k % 3 == 0, "CNY").otherwise("人民币").alias("currency"), F.when(k % 5 == 0, "母公司").otherwise("合并").alias("scope"),
    )
    return checks.compared(ours, theirs, ["key"])


def kept_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as views of statements, written as JSON and read again."""
    line = F.struct(F.array(F.concat(F.lit("line "), "l_linenumber")).alias("labels"), F.array(F.col("l_quantity").cast("decimal(12,2)").cast("string")).alias("cells"))
    views = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_sort(F.collect_list(line)).alias("rows"))
    back = pages.read_views(pages.kept_views(views.select("doc", F.lit("合并资产负债表").alias("title"), F.lit("元").alias("unit"), "rows")))
    return back.select("doc", "title", F.size("rows").alias("n"), F.array_join(F.transform("rows", lambda x: x["cells"][0]), ",").alias("cells"))


def pruned_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of recorded customers only the columns that are mapped, tell the source, or are evidence."""
    payload = F.create_map(F.lit("total"), F.col("c_acctbal").cast("string"), F.lit("noise"), F.col("c_name"), F.lit("report_date"), F.col("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), intake.pruned(payload, ["total", "report_date"]).alias("kept"))
    return rows.select("key", F.array_join(F.map_keys("kept"), ",").alias("columns"), F.col("kept")["report_date"].alias("report_date"))


def rendered_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused answers as JSON with fixed keys."""
    return intent.rendered(question_answers(spark, sf_dir)).select("k", "refusal")


def statement_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows of a mapping; those of the balance sheet."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("field_id"), F.when(F.col("p_size") % 2 == 0, "balance").otherwise("income").alias("statement"))
    return registry.of_statement(rows, "balance").select("field_id")


def extraction_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of several steps in one batch; later steps may lack columns."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.lit("bs").alias("step"), F.lit(1).alias("page"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.lit("notes").alias("step"))
    return a.unionByName(b, allowMissingColumns=True)


def page_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue.keyed(spark, sf_dir).select("k", catalogue.rule("t", "'2023年年度报告'", "'12 / 140'", "'编制单位：甲'", "'货币资金'", "'2023年年度报告摘要'", "'单位:元'"))
    return rows.select("k", pages.furniture(F.col("t")).alias("furniture"))


QUERIES = {
    f.__name__: f
    for f in (
        condition_values, company_mentions, question_answers, plain_near_misses, masked_texts, long_texts, cross_source_reasons,
        kept_views, pruned_payloads, rendered_refusals, statement_mapping, extraction_steps, page_furniture,
    )
}

O = "FROM (SELECT o_orderkey AS k FROM orders)"
XY = "WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey % 4 * 1.5 END AS x, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS y FROM orders)"
ASKED = f"""q AS (
  SELECT o_orderkey AS k, o_orderkey % 12 AS kind, year(o_orderdate) AS y, lpad(CAST(min(l_suppkey) AS VARCHAR), 6, '0') AS a, lpad(CAST(max(l_suppkey) AS VARCHAR), 6, '0') AS b,
    [{", ".join(f"'{m}'" for _, m in SAID)}][o_custkey % {len(SAID)} + 1] AS m
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate, o_custkey
)"""
ANSWERED = f"""{METRICS}, {ASKED}, r AS (
  SELECT *, CASE WHEN kind = 2 THEN 'name_prefix' WHEN kind = 3 THEN 'name_suffix' WHEN kind IN (5, 6) AND a <> b THEN 'many_entities' WHEN kind = 7 THEN 'no_entity' WHEN kind = 8 THEN 'no_period'
    WHEN kind = 9 THEN 'many_periods' WHEN kind = 10 THEN 'no_metric' WHEN kind = 11 THEN 'near_miss' END AS reason FROM q
), a AS (SELECT k, CASE kind WHEN 10 THEN NULL WHEN 11 THEN 'debt_to_asset_ratio' ELSE m END AS metric_id, CASE WHEN reason IS NULL THEN a END AS entity, CASE WHEN reason IS NULL THEN y END AS period, reason FROM r),
f AS (SELECT a.*, mv.value, coalesce(CASE WHEN reason IN ('no_metric', 'near_miss') THEN 'METRIC_NOT_DEFINED' WHEN reason IS NOT NULL THEN 'INTENT_INCOMPLETE' END, CASE WHEN mv.metric_id IS NULL THEN 'UNAVAILABLE' END, mv.refusal_code) AS refusal_code
  FROM a LEFT JOIN mv ON mv.entity = a.entity AND mv.period = a.period AND mv.metric_id = a.metric_id)"""
ORACLES = {
    "condition_values": f"""{XY} SELECT k, CASE WHEN x IS NULL THEN NULL WHEN x <= 0 THEN true ELSE y END AS either, CASE WHEN x IS NOT NULL THEN false ELSE y END AS both,
CASE WHEN x IS NULL THEN NULL WHEN x > 2 THEN false ELSE y IS NOT NULL END AS neither, CASE WHEN x IS NOT NULL THEN x <> 1.5 END AS null_test, CASE WHEN y IS NOT NULL THEN x >= -1 END AS mixed, CAST(NULL AS BOOLEAN) AS order_of_null FROM r""",
    "company_mentions": f"""WITH {ASKED}
SELECT k, CASE WHEN kind = 5 AND a <> b THEN a || ',' || b ELSE a END AS codes, CASE kind WHEN 2 THEN 'PREFIX' WHEN 3 THEN 'SUFFIX' END AS doubt FROM q WHERE kind BETWEEN 1 AND 5""",
    "question_answers": f"{ANSWERED} SELECT k, metric_id, entity, period, value, refusal_code, reason FROM f",
    "plain_near_misses": f"SELECT k, ['毛利率', '毛利率', '综合毛利率', '毛利率', NULL][k % 5 + 1] AS alias, [NULL, '综合毛利率', NULL, '调整后毛利率', NULL][k % 5 + 1] AS near {O}",
    "masked_texts": f"SELECT k, 'a ' || CASE k % 3 WHEN 0 THEN lpad(CAST(k % 1000000 AS VARCHAR), 6, '0') || ' 万元' WHEN 1 THEN '　　　　　　' ELSE '　　　　　　 　　　　 　' END || ' 1.5' AS masked {O}",
    "long_texts": """WITH s AS (SELECT s_suppkey AS k, unnest(range(s_suppkey % 31)) AS pos FROM supplier)
SELECT k AS doc_id, pos, CASE WHEN k % 7 = 0 THEN 'QUESTION' ELSE 'STATEMENT' END AS read_as, CASE WHEN k % 7 = 0 THEN 'NOT_CHECKABLE' ELSE 'NOT_COVERED' END AS verdict, CASE WHEN k % 7 = 0 THEN 'no_number' WHEN pos >= 24 THEN 'too_many' ELSE 'no_metric' END AS why FROM s""",
    "cross_source_reasons": f"""WITH r AS (SELECT k, CASE WHEN k % 2 = 0 THEN 'ABSENT' WHEN k % 5 = 0 THEN 'SCOPE' WHEN k % 7 = 0 THEN 'PERIOD' WHEN k % 11 = 0 THEN 'CURRENCY' WHEN k % 13 = 0 THEN 'UNIT' WHEN k % 17 = 0 THEN 'OUR_VALUE' WHEN k % 19 = 0 THEN 'NOT_A_NUMBER' END AS reason {O})
SELECT k AS key, CASE WHEN reason IS NULL THEN 'AGREE' ELSE 'INCOMPARABLE' END AS verdict, reason FROM r""",
    "kept_views": "SELECT l_orderkey AS doc, '合并资产负债表' AS title, count(*) AS n, string_agg(CAST(CAST(l_quantity AS DECIMAL(12,2)) AS VARCHAR), ',' ORDER BY 'line ' || l_linenumber, CAST(CAST(l_quantity AS DECIMAL(12,2)) AS VARCHAR)) AS cells FROM lineitem GROUP BY 1",
    "pruned_payloads": "SELECT c_custkey AS key, 'total,report_date' AS columns, c_mktsegment AS report_date FROM customer",
    "rendered_refusals": f"""{ANSWERED} SELECT k, '{{"refused":true,"code":"' || refusal_code || '","detail":"' || coalesce(reason, '') || '"}}' AS refusal FROM f WHERE refusal_code IS NOT NULL""",
    "statement_mapping": "SELECT p_partkey AS field_id FROM part WHERE p_size % 2 = 0",
    "extraction_steps": "SELECT s_suppkey AS key, 'bs' AS step, 1 AS page FROM supplier UNION ALL SELECT s_suppkey, 'notes', NULL FROM supplier",
    "page_furniture": f"SELECT k, k % 6 NOT IN (3, 4) AS furniture {O}",
}
