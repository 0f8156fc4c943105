"""One query for each operator over the driver's tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metricspark import storage
from metricspark.operators import checks, evaluation, intent, layout, metrics, numbers, rules, text
from metricspark.operators.expressions import readable_sql
from metricspark.plans import answers, catalogue, files, more, reports, whole
from metricspark.plans.definitions import DEFINITIONS
from metricspark.plans.metric_sql import COMPUTED, INPUTS, METRICS, WITH
from metricspark.sources.statements import FIELDS, entity, statements, table


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with values of ten places."""
    return metrics.metric_values(statements(spark, sf_dir)).drop("value").withColumnRenamed("amount", "value")


def metric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of all entities and periods: value, of 28 significant digits, or typed refusal, and the flags."""
    return metrics.metric_values(statements(spark, sf_dir)).drop("suppkey", "amount").withColumn("flags", F.array_join("flags", ","))


def computed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics as computations behind the reconciliation gate, with units and the state of flags."""
    return metrics.computed_metrics(statements(spark, sf_dir)).drop("amount").withColumn("flags", F.array_join("flags", ","))


def metric_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operands of every computation in their order."""
    rows = metrics.metric_inputs(statements(spark, sf_dir)).withColumn("field_id", F.replace("field_id", F.lit("."), F.lit("_")))
    return rows.withColumn("amount", F.col("amount").cast("double"))


def debt_to_asset_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = tuple(d for d in DEFINITIONS if d.metric_id == "debt_to_asset_ratio")
    return metrics.metric_values(statements(spark, sf_dir), one).select("entity", "period", "value", "refusal_code", "condition_index")


def statement_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: one row for each entity, period and field, with how the cell was found."""
    cells = ", ".join(f"named_struct('field_id', '{f}', 'state', {f}.state, 'amount', CAST({readable_sql(f)} AS DOUBLE))" for f in FIELDS)
    return statements(spark, sf_dir).selectExpr("entity", "period", f"inline(array({cells}))")


RECORDS_SQL = WITH + " " + " UNION ALL ".join(
    f"SELECT entity, period, '{f}' AS field_id, {f}_state AS state, CAST({f} AS DOUBLE) AS amount FROM st" for f in FIELDS
)


def refusal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered and refused rows of each metric, by code."""
    code = F.coalesce("refusal_code", F.lit("ANSWERED"))
    return values(spark, sf_dir).groupBy("metric_id", code.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def comparability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of neighbouring periods and whether a flag of either forbids comparing them."""
    v = values(spark, sf_dir).filter("value IS NOT NULL").withColumn("flags", F.array_join("flags", ","))
    # Rows lie by supplier already, so the window needs no shuffle of its own.
    w = Window.partitionBy("suppkey", "metric_id").orderBy("period")
    both = v.withColumn("last", F.lag("period").over(w)).withColumn("last_flags", F.lag("flags").over(w)).filter("last = period - 1")
    free = (F.col("flags") == "") & (F.col("last_flags") == "")
    return both.select("entity", "period", "metric_id", free.alias("comparable"), F.when(F.col("flags") != "", F.col("flags")).otherwise(F.col("last_flags")).alias("flags"))


def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.reconcile(statements(spark, sf_dir))


def second_source(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Synthetic: our sums of orders' lines in 元, the second source in varying units, with gaps."""
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    ours = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key"))
    ours = ours.agg(F.sum(price).cast("decimal(22,6)").alias("value"), F.lit("元").alias("unit"))
    k, total = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(12,2)").cast("decimal(18,6)")
    theirs = table(spark, sf_dir, "orders").select(
        k.alias("key"),
        (k % 11 != 0).alias("present"),
        F.when(k % 7 != 0, F.when(k % 5 == 0, total * F.lit("0.0001").cast("decimal(5,4)")).otherwise(total)).cast("decimal(22,6)").alias("value"),
        F.when(k % 13 == 0, "bushel").when(k % 5 == 0, "万元").otherwise("元").alias("unit"),
    )
    return ours, theirs


def cross_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours, theirs = second_source(spark, sf_dir)
    return checks.compared(ours, theirs, ["key"])


def cross_source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.comparison_summary(cross_source(spark, sf_dir).withColumn("part", F.col("key") % 10), ["part"])


CROSS = """WITH ours AS (SELECT l_orderkey AS key, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(22,6)) AS value FROM lineitem GROUP BY 1),
both_ AS (
  SELECT ours.key, ours.value, o_orderkey % 11 <> 0 AS present,
    CAST(CASE WHEN o_orderkey % 7 <> 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_totalprice AS DECIMAL(12,2)) * CAST(0.0001 AS DECIMAL(5,4)) ELSE CAST(o_totalprice AS DECIMAL(12,2)) END END AS DECIMAL(22,6)) AS other,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 10000 ELSE 1 END AS scale
  FROM ours LEFT JOIN orders ON o_orderkey = ours.key
), reasons AS (
  SELECT *, CASE WHEN NOT coalesce(present, false) THEN 'ABSENT' WHEN scale IS NULL THEN 'UNIT' WHEN value IS NULL THEN 'OUR_VALUE' WHEN other IS NULL THEN 'NOT_A_NUMBER' END AS reason FROM both_
), cross_ AS (
  SELECT key, reason, CASE WHEN reason IS NOT NULL THEN 'INCOMPARABLE' WHEN round_even(abs(value - other * scale), 2) <= 0.01 THEN 'AGREE' ELSE 'DISAGREE' END AS verdict FROM reasons
)"""


def text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.segments(table(spark, sf_dir, "documents"))


def named_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest alias in each question; questions are synthetic sentences on suppliers."""
    return text.named(questions(spark, sf_dir), text.aliases(spark), "question", ["suppkey"]).select("suppkey", "alias", "metric_id")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = sorted((a, d.metric_id) for d in DEFINITIONS for a in (d.display, *d.aliases))
    names = F.array(*(F.lit(a) for a, _ in listed))
    k = F.col("s_suppkey")
    name = F.when(k % 10 != 0, F.element_at(names, (k % len(listed) + 1).cast("int"))).otherwise("the weather")
    return table(spark, sf_dir, "supplier").select(k.alias("suppkey"), F.concat(F.lit("what is the "), name, F.lit(" of "), "s_name").alias("question"))


ALIASES = sorted((a, d.metric_id, d.display) for d in DEFINITIONS for a in (d.display, *d.aliases))
NAMES_SQL = "names(alias, metric_id, display) AS (VALUES " + ", ".join(f"('{a}', '{m}', '{d}')" for a, m, d in ALIASES) + ")"
NAMED_SQL = f"""WITH {NAMES_SQL}, q AS (
  SELECT s_suppkey AS suppkey, 'what is the ' || CASE WHEN s_suppkey % 10 <> 0 THEN [{", ".join(f"'{a}'" for a, _, _ in ALIASES)}][s_suppkey % {len(ALIASES)} + 1] ELSE 'the weather' END || ' of ' || s_name AS question FROM supplier
)
SELECT suppkey, arg_min(alias, (-length(alias), alias)) AS alias, arg_min(metric_id, (-length(alias), alias)) AS metric_id
FROM q LEFT JOIN names ON contains(question, alias) GROUP BY suppkey"""

#: Sorts of claims, one for each supplier's number modulo this.
CLAIM_KINDS = 13


def company_name(code: Column) -> Column:
    return F.concat(F.lit("Co"), F.translate(code, "0123456789", "ABCDEFGHIJ"))


def claim_texts(v: DataFrame) -> DataFrame:
    """Synthetic texts on every computed value: some off, vague, by another name, by company, or in two sentences."""
    v = v.filter(F.col("value").isNotNull())
    shown = {d.metric_id: (d.display, d.aliases[0] if d.aliases else d.display) for d in DEFINITIONS}
    pick = lambda i: F.create_map(*(F.lit(x) for m, n in shown.items() for x in (m, n[i])))[F.col("metric_id")]
    kind = F.col("suppkey") % CLAIM_KINDS
    amount = F.col("metric_id").isin("free_cash_flow", "net_profit_attributable_excl_nonrecurring", "net_working_capital")
    number = F.bround(F.when(amount, F.col("value") / F.lit("10000").cast("decimal(5,0)")).otherwise(F.col("value")), 2).cast("decimal(20,2)")
    number = F.when(kind == 1, number + F.lit("0.05").cast("decimal(4,2)")).otherwise(number).cast("decimal(20,2)").cast("string")
    number = F.when(kind == 6, F.concat(number, F.lit(" 个百分点"))).when(amount, F.concat(number, F.lit(" 万元"))).otherwise(number)
    year = F.when(kind == 7, F.col("period") + 50).otherwise(F.col("period")).cast("string")
    who = F.when(kind == 11, company_name(F.col("entity"))).otherwise(F.col("entity"))
    name = F.when(kind == 3, pick(1)).when(kind == 9, F.lit("weather")).otherwise(pick(0))
    says = F.when(kind == 2, F.lit(" is fine")).when(kind == 8, F.concat(F.lit(" 增长 "), number)).otherwise(F.concat(F.lit(" is "), number))
    more = F.when(kind == 4, " in Q1").when(kind == 5, " not 7.5").when(kind == 12, " or 2050年").otherwise("")
    between = F.when(kind == 10, "年；").otherwise("年 ")
    said = F.concat(who, F.lit(" "), year, between, name, says, more)
    return v.select(F.concat_ws("/", "entity", "period", "metric_id").alias("claim_id"), said.alias("text"))


def claim_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The values are read several times, for the texts and to judge them.
    v = storage.kept(values(spark, sf_dir), "values")
    texts = claim_texts(v)
    companies = table(spark, sf_dir, "supplier").select(entity(F.col("s_suppkey")).alias("code"))
    companies = companies.select(company_name(F.col("code")).alias("name"), "code")
    # Codes are as long as keys.
    judged = intent.claims(texts, v, text.aliases(spark), companies, "claim_id", code=numbers.LONG_CODE)
    return judged.select("claim_id", "pos", "read_as", "verdict", "inherited")


def claim_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.verdict_counts(claim_verdicts(spark, sf_dir))


CLAIMS_SQL = f"""{METRICS}, told AS (
  SELECT concat_ws('/', entity, period, metric_id) AS claim_id, suppkey % 13 AS kind,
    metric_id IN ({", ".join(f"'{d.metric_id}'" for d in DEFINITIONS if d.aliases)}) AS has_other FROM mv WHERE value IS NOT NULL
), verdicts AS (
  SELECT claim_id, CASE WHEN kind = 10 THEN 1 ELSE 0 END AS pos, CASE WHEN kind = 2 THEN 'QUESTION' ELSE 'STATEMENT' END AS read_as,
    CASE kind WHEN 1 THEN 'INCONSISTENT' WHEN 2 THEN 'NOT_CHECKABLE' WHEN 3 THEN CASE WHEN has_other THEN 'AMBIGUOUS_BASIS' ELSE 'CONSISTENT' END
      WHEN 0 THEN 'CONSISTENT' WHEN 10 THEN 'CONSISTENT' WHEN 11 THEN 'CONSISTENT' ELSE 'NOT_COVERED' END AS verdict,
    CASE WHEN kind = 10 THEN 'entity,period' ELSE '' END AS inherited
  FROM told
  UNION ALL SELECT claim_id, 0, 'STATEMENT', 'NOT_CHECKABLE', '' FROM told WHERE kind = 10
)"""


def conversation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role of the first user turn before each other turn, as an inherited context."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("own"))
    return text.inherited(turns, "conv_id", "turn", "own").select("conv_id", "turn", F.col("context").cast("long").alias("context"))


def first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the supplier's and the customer's row for a key the supplier's wins."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit(0).alias("source"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit(1).alias("source"))
    return evaluation.first_source(s.unionByName(c), ["key"], "source")


def settled_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, as names, whose lines come from one supplier only."""
    return evaluation.settled_names(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_suppkey").alias("code")))


def evidence_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "text", F.nullif("lang", F.lit("en")).alias("lang"), "n_chars")
    return evaluation.completeness(rows, ["text", "lang", "n_chars"], ["source"])


def evaluation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as judged cases: their status letter is the outcome, their priority the category."""
    status = F.when(F.col("o_orderstatus") == "F", "PASSED").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("VOID")
    cases = table(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).alias("category"), status.alias("status"))
    return evaluation.rollup(cases, list("123459"))


def section_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as anchors: the line number is the page, the part the place on it."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("y"))
    return layout.sections(rows.distinct())


def word_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a cell of some width, in one of three columns of a sheet."""
    x0 = (F.col("p_partkey") % 97).cast("double")
    cells = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cell_id"), x0.alias("x0"), (x0 + F.col("p_size")).alias("x1"))
    sheet = spark.createDataFrame([("item", 0.0, 20.0), ("current", 30.0, 60.0), ("prior", 65.0, 90.0)], "role string, c0 double, c1 double")
    return layout.in_columns(cells, sheet).select("cell_id", "role")


TERMS = rules.Terms(("entity", "period_type"), ("annual", "quarter"), ("flow", "stock"), ("positive", "negative"), ("restated",), ("stale",))


def definition_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic definitions, one for each part, with faults by rule, and what the rules find in them."""
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    by = lambda n, *values: F.element_at(F.array(*values), (F.least(k % n, F.lit(len(values) - 1)) + 1).cast("int"))
    word = F.lit
    field = lambda i, sign, missing: F.struct(word(i).alias("id"), sign.alias("sign"), missing.alias("missing"))
    flag = F.struct(by(7, word("homemade"), word("stale"), word("restated")).alias("name"), F.array(word("f1"), by(8, word("f9"), word("f2"))).alias("refs"))
    basis = F.struct(word("std").alias("name"), by(11, word(" "), word("1")).alias("version"))
    pitfall = F.struct(by(2, word("flags"), none).alias("enforced_by"), (k % 3 == 0).alias("advisory"))
    rows = table(spark, sf_dir, "part").select(
        F.concat(word("m"), k.cast("string")).alias("metric_id"),
        F.when(k % 9 != 0, k % 4).cast("int").alias("version"),
        F.create_map(word("entity"), word("supplier"), word("period_type"), by(5, none, word("week"), word("annual"))).alias("grain"),
        by(6, word("flux"), word("flow")).alias("semantics"),
        word("f1 - f2").alias("formula"),
        F.array(field("f1", by(3, none, word("odd"), word("positive")), word("null")), field("f2", word("negative"), by(6, none, word("null"))), field("f3", none, word("null"))).alias("fields"),
        F.when(k % 14 != 0, F.struct(F.when(k % 15 != 0, F.lit(True)).alias("allow"), by(16, word(""), word("n")).alias("note"))).alias("derivation"),
        F.when(k % 17 != 0, F.array(flag)).alias("flags"),
        F.when(k % 10 == 0, F.array().cast("array<struct<name:string,version:string>>")).otherwise(F.array(basis)).alias("basis"),
        F.when(k % 12 != 0, F.array(F.struct(word("f2 == 0").alias("expr"), by(13, word(""), word("r")).alias("reason")))).alias("conditions"),
        F.array_repeat(pitfall, (k % 5 + 1).cast("int")).alias("pitfalls"),
    )
    return rules.findings(rows, TERMS)


RULED = (  # code, place, test on k
    ("R1.MISSING_GRAIN", "'period_type'", "k % 5 = 0"),
    ("R1.BAD_PERIOD_TYPE", "'period_type'", "k % 5 = 1"),
    ("R1.BAD_PERIOD_TYPE", "'semantics'", "k % 6 = 0"),
    ("R2.NO_SIGN_CONVENTION", "'f1'", "k % 3 = 0"),
    ("R2.BAD_SIGN_CONVENTION", "'f1'", "k % 3 = 1"),
    ("R3.DERIVATION_MISSING", "''", "k % 14 = 0"),
    ("R3.DERIVATION_NOT_BOOLEAN", "''", "k % 14 <> 0 AND k % 15 = 0"),
    ("R3.DERIVATION_NOTE_EMPTY", "''", "k % 14 <> 0 AND k % 16 = 0"),
    ("R4.FLAGS_KEY_MISSING", "''", "k % 17 = 0"),
    ("R4.FLAG_NOT_IN_VOCABULARY", "'homemade'", "k % 17 <> 0 AND k % 7 = 0"),
    ("R4.SYSTEM_SCOPE_FLAG_DECLARED", "'stale'", "k % 17 <> 0 AND k % 7 = 1"),
    ("R4.TRIGGER_UNDECLARED_FIELD", "CASE k % 7 WHEN 0 THEN 'homemade' WHEN 1 THEN 'stale' ELSE 'restated' END || ':f9'", "k % 17 <> 0 AND k % 8 = 0"),
    ("R5.BASIS_NOT_STRUCTURED", "''", "k % 10 = 0"),
    ("R5.BASIS_FIELD_EMPTY", "'version'", "k % 10 <> 0 AND k % 11 = 0"),
    ("R6.NO_MISSING_REPRESENTATION", "'f2'", "k % 6 = 0"),
    ("R7.NO_UNDEFINED_CONDITIONS", "''", "k % 12 = 0"),
    ("R7.REASON_EMPTY", "'f2 == 0'", "k % 12 <> 0 AND k % 13 = 0"),
    ("R8.TOO_FEW_PITFALLS", "''", "k % 5 < 2"),
    ("R9.VERSION_NOT_INT", "''", "k % 9 = 0"),
    ("R9.VERSION_TOO_LOW", "''", "k % 9 <> 0 AND k % 4 < 2"),
)
FINDINGS_SQL = "WITH p AS (SELECT p_partkey AS k, 'm' || p_partkey AS metric_id FROM part) " + " UNION ALL ".join(
    [f"SELECT metric_id, '{code}' AS code, {place} AS place FROM p WHERE {test}" for code, place, test in RULED]
    + [
        f"SELECT metric_id, '{code}' AS code, {place} AS place FROM (SELECT *, unnest(range(k % 5 + 1)) FROM p) WHERE {test}"
        for code, place, test in (("R8.BOTH_ENFORCED_AND_ADVISORY", "'flags'", "k % 2 = 0 AND k % 3 = 0"), ("R8.PITFALL_UNBACKED", "''", "k % 2 = 1 AND k % 3 <> 0"))
    ]
)


def near_miss_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions on suppliers that name a metric wholly, in part, with other words, or not at all."""
    k = F.col("s_suppkey")
    said = F.when(k % 4 == 0, "interest bearing debt ratio").when(k % 4 == 1, "bearing debt ratio").when(k % 4 == 2, "net debt ratio").otherwise("weather")
    asked = table(spark, sf_dir, "supplier").select(k.alias("suppkey"), F.concat(F.lit("show "), said, F.lit(" of "), "s_name").alias("question"))
    names = text.aliases(spark)
    return text.near_misses(text.named(asked, names, "question", ["suppkey"]), names, "question").select("suppkey", "alias", "near")


NEAR_SQL = f"""WITH {NAMES_SQL}, q AS (
  SELECT s_suppkey AS suppkey, 'show ' || CASE s_suppkey % 4 WHEN 0 THEN 'interest bearing debt ratio' WHEN 1 THEN 'bearing debt ratio' WHEN 2 THEN 'net debt ratio' ELSE 'weather' END || ' of ' || s_name AS question FROM supplier
), hit AS (
  SELECT suppkey, any_value(question) AS question, arg_min(alias, (-length(alias), alias)) AS alias, arg_min(metric_id, (-length(alias), alias)) AS metric_id FROM q LEFT JOIN names ON contains(question, alias) GROUP BY suppkey
), tried AS (
  SELECT suppkey, question, hit.alias, o.alias AS other, unnest(range(1, length(o.alias) - length(hit.alias) + 1)) AS n
  FROM hit JOIN names o ON ends_with(o.alias, hit.alias) AND o.alias <> hit.alias AND o.metric_id <> hit.metric_id
), near_ AS (
  SELECT suppkey, arg_min(other, (-n, other)) AS near FROM tried
  WHERE ends_with(substr(question, 1, instr(question, alias) - 1), substr(other, length(other) - length(alias) - n + 1, n)) AND trim(substr(other, length(other) - length(alias) - n + 1, n)) <> '' GROUP BY suppkey
)
SELECT hit.suppkey, alias, near FROM hit LEFT JOIN near_ USING (suppkey)"""


QUERIES = {
    f.__name__: f
    for f in (
        metric_values, computed_metrics, metric_inputs, debt_to_asset_ratio, statement_records, refusal_summary, comparability, reconciliation, cross_source,
        cross_source_summary, text_segments, named_metrics, claim_verdicts, claim_counts, conversation_context, first_source,
        settled_names, evidence_completeness, evaluation_rollup, section_spans, word_columns,
        definition_findings, near_miss_names,
    )
}

ORACLES = {
    "metric_values": f"{METRICS} SELECT entity, period, metric_id, version, value, refusal_code, condition_index, flags FROM mv",
    "computed_metrics": COMPUTED,
    "metric_inputs": INPUTS,
    "debt_to_asset_ratio": f"{METRICS} SELECT entity, period, value, refusal_code, condition_index FROM mv WHERE metric_id = 'debt_to_asset_ratio'",
    "statement_records": RECORDS_SQL,
    "refusal_summary": f"{METRICS} SELECT metric_id, coalesce(refusal_code, 'ANSWERED') AS outcome, count(*) AS n FROM mv GROUP BY 1, 2",
    "comparability": f"""{METRICS} SELECT entity, period, metric_id, flags = '' AND last_flags = '' AS comparable, CASE WHEN flags <> '' THEN flags ELSE last_flags END AS flags
FROM (SELECT *, lag(period) OVER w AS last, lag(flags) OVER w AS last_flags FROM mv WHERE value IS NOT NULL WINDOW w AS (PARTITION BY suppkey, metric_id ORDER BY period)) WHERE last = period - 1""",
    "reconciliation": f"""{WITH} SELECT entity, period, coalesce(abs(bs_total_assets - (bs_total_liabilities + bs_total_equity)) <= 0.01, false) AS passed,
concat_ws(',', CASE WHEN bs_total_assets IS NULL THEN 'bs_total_assets' END, CASE WHEN bs_total_liabilities IS NULL THEN 'bs_total_liabilities' END, CASE WHEN bs_total_equity IS NULL THEN 'bs_total_equity' END) AS missing FROM st""",
    "cross_source": f"{CROSS} SELECT key, verdict, reason FROM cross_",
    "cross_source_summary": f"""{CROSS} SELECT key % 10 AS part, count(*) FILTER (WHERE verdict <> 'INCOMPARABLE') AS comparable, count(*) FILTER (WHERE verdict = 'INCOMPARABLE') AS incomparable,
count(*) FILTER (WHERE verdict = 'DISAGREE') AS disagreements, count(*) FILTER (WHERE verdict = 'DISAGREE') * 3 > count(*) FILTER (WHERE verdict <> 'INCOMPARABLE') AS suspected FROM cross_ GROUP BY 1""",
    "text_segments": r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[。；;！!？?\n，,]+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS parts FROM documents)
SELECT doc_id, i - 1 AS pos, parts[i] AS segment FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM s)""",
    "named_metrics": NAMED_SQL,
    "claim_verdicts": f"{CLAIMS_SQL} SELECT claim_id, pos, read_as, verdict, inherited FROM verdicts",
    "claim_counts": f"{CLAIMS_SQL} SELECT " + ", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v.lower()}" for v in text.VERDICTS) + " FROM verdicts",
    "conversation_context": """SELECT conv_id, turn, coalesce(CASE WHEN role = 'user' THEN turn END,
first_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS context FROM conversations""",
    "first_source": """SELECT s_suppkey AS key, s_name AS name, 0 AS source FROM supplier UNION ALL
SELECT c_custkey, c_name, 1 FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""",
    "settled_names": "SELECT l_orderkey AS name, min(l_suppkey) AS code FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1",
    "evidence_completeness": """SELECT source, CAST(sum(f) AS BIGINT) AS filled, count(*) * 3 AS total, round(sum(f) / (count(*) * 3), 6) AS rate FROM (
SELECT source, CASE WHEN text IS NULL OR trim(text, ' ') IN ('', 'UNKNOWN') THEN 0 ELSE 1 END + CASE WHEN lang IS NULL OR lang = 'en' OR trim(lang, ' ') IN ('', 'UNKNOWN') THEN 0 ELSE 1 END + CASE WHEN n_chars IS NULL THEN 0 ELSE 1 END AS f FROM documents) GROUP BY 1""",
    "evaluation_rollup": """SELECT c AS category, count(*) FILTER (WHERE o_orderstatus = 'F') AS passed, count(*) FILTER (WHERE o_orderstatus = 'O') AS failed,
count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS void FROM (SELECT unnest(['1', '2', '3', '4', '5', '9']) AS c) LEFT JOIN orders ON substr(o_orderpriority, 1, 1) = c GROUP BY 1""",
    "definition_findings": FINDINGS_SQL,
    "near_miss_names": NEAR_SQL,
    "section_spans": """SELECT doc, page, y, lead(page) OVER w AS next_page, lead(y) OVER w AS next_y FROM (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS page, l_partkey AS y FROM lineitem)
WINDOW w AS (PARTITION BY doc ORDER BY page, y)""",
    "word_columns": """WITH c(role, c0, c1) AS (VALUES ('item', 0.0, 20.0), ('current', 30.0, 60.0), ('prior', 65.0, 90.0)), p AS (SELECT p_partkey AS cell_id, p_partkey % 97 AS x0, p_partkey % 97 + p_size AS x1 FROM part)
SELECT cell_id, arg_max(role, (least(x1, c1) - greatest(x0, c0), -c0)) AS role FROM p LEFT JOIN c ON least(x1, c1) - greatest(x0, c0) > 0 GROUP BY 1""",
}

for part in (more, reports, catalogue, answers, files, whole):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
