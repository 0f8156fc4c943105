"""Reports printed from statements over several pages, read again, with their SQL: what is read is what was printed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricspark import storage
from metricspark.operators import extraction, intake
from metricspark.operators.extraction import AFTER, KEY_DATA, SCOPE, SECTION, STATEMENTS
from metricspark.plans.metric_sql import WITH
from metricspark.sources.statements import FLAG_FIELDS, statements

BALANCE, INCOME, CASH = STATEMENTS
#: field, statement, role, lines of the label as printed; the page, and whether the amount stands in the second column.
PRINTED = (
    ("bs_inventory", BALANCE, "期末余额", ("存货",), 1, False),
    ("bs_total_current_assets", BALANCE, "期末余额", ("流动资产合计",), 2, False),
    ("bs_total_current_liabilities_period_end", BALANCE, "期末余额", ("流动负债合计",), 2, False),
    ("bs_total_liabilities", BALANCE, "期末余额", ("负债合计",), 2, False),
    ("bs_total_equity", BALANCE, "期末余额", ("所有者权益", "合计"), 2, False),
    ("bs_total_assets", BALANCE, "期末余额", ("资产总计",), 2, False),
    ("is_operating_revenue_current", INCOME, "本期金额", ("营业收入",), 3, False),
    ("is_operating_cost", INCOME, "本期金额", ("营业成本",), 4, False),
    ("is_net_profit", INCOME, "本期金额", ("净利润",), 4, False),
    ("cfs_net_cash_flow_from_operating_activities", CASH, "本期金额", ("经营活动产生的现金流量净额",), 5, False),
    ("cfs_cash_paid_for_fixed_intangible_and_other_long_term_assets", CASH, "本期金额", ("购建固定资产、无形资产", "支付的现金"), 6, False),
)
#: Beside the revenue stands that of the year before, in a column of its own.
PRIOR = "is_operating_revenue_prior_as_presented"


def money(field: str) -> str:
    return f"IF({field}.state = 'VALUE_PRESENT', format_number(CAST({field}.v AS DECIMAL(28,2)), 2), NULL)"


def template() -> list[tuple[int, float, int, int, str]]:
    """(page, top, x0, x1, text) of all words; texts are expressions over a statement, null where nothing is printed."""
    date = lambda back: f"concat(CAST(period - {back} AS STRING), '年12月31日')"
    year = lambda back: f"concat(CAST(period - {back} AS STRING), '年度')"
    out = [(1, 20.0, 0, 20, "'二、'"), (1, 20.0, 20, 60, f"'{SECTION}'")]

    def title(page: int, top: float, name: str, unit: str) -> None:
        out.extend([(page, top, 0, 40, f"'{name}'"), (page, top + 10, 0, 30, f"concat('单位:', {unit})"), (page, top + 10, 40, 70, "IF(notes_reporting_period_months = 12, '币种:人民币', NULL)")])

    def header(page: int, top: float, column, shift: float = 0) -> None:
        out.extend([(page, top, 0, 20, "'项目'"), (page, top, 100 + shift, 150 + shift, column(0)), (page, top, 200 + shift, 250 + shift, column(1))])

    title(1, 300, BALANCE, "'元'")
    header(1, 320, date)
    title(3, 50, INCOME, "'元'")
    header(3, 70, year)
    header(4, 30, year, 30)
    title(5, 50, CASH, "cfs_unit")
    header(5, 70, year)
    tops = {1: 340.0, 2: 40.0, 3: 90.0, 4: 50.0, 5: 90.0, 6: 40.0}
    for field, _, _, label, page, _ in PRINTED:
        # An absent row isn't printed, one that can't be told is printed twice.
        for n in range(2):
            there = f"{field}.state {'<>' if n == 0 else '='} '{'ROW_ABSENT' if n == 0 else 'UNKNOWN'}'"
            top, right = tops[page], 30 if page == 4 else 0
            first, *second = label
            out.append((page, top, 0, 60, f"IF({there}, '{first}', NULL)"))
            middle = top + (6 if second else 0)
            out.append((page, middle, 100 + right, 160 + right, f"IF({there}, {money(field)}, NULL)"))
            if field == "is_operating_revenue_current":
                out.append((page, middle, 200, 260, f"IF({there}, {money(PRIOR)}, NULL)"))
            out += [(page, top + 12, 0, 30, f"IF({there}, '{second[0]}', NULL)")] if second else []
            tops[page] = top + 24
    out += [(2, 10.0, 0, 50, "concat(CAST(period AS STRING), '年年度报告')"), (2, 700.0, 0, 30, "'2 / 9'"), (6, 400.0, 0, 40, "'母公司资产负债表'"), (6, 420.0, 0, 20, "'存货'"), (6, 420.0, 100, 150, "'1.00'")]
    out += [(7, 20.0, 0, 20, "'三、'"), (7, 20.0, 20, 60, f"'{AFTER}'"), (7, 40.0, 0, 40, f"'{BALANCE}'"), (8, 20.0, 0, 20, "'九、'"), (8, 20.0, 20, 80, f"'{SCOPE}'")]
    for n, item in enumerate(extraction.ITEMS):
        ticked = f"notes_consolidation_scope_change AND {'suppkey % 2 = 0' if n == 0 else 'true'}"
        out += [(8, 40.0 + 20 * n, 0, 60, f"'{n + 1}、{item}'"), (8, 50.0 + 20 * n, 0, 60, f"IF({ticked}, '√适用□不适用', '□适用√不适用')")]
    out += [(9, 20.0, 0, 20, "'七、'"), (9, 20.0, 20, 100, f"IF(notes_restatement_flag IS NULL, NULL, '{KEY_DATA}')"), (9, 40.0, 0, 50, "IF(notes_restatement_flag, '调整后', '调整前')")]
    return out


def whole_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of all reports: three statements over two pages each, with headers repeated or inherited, and two notes."""
    words, reports, mapping = printed(spark, sf_dir)
    records, _ = extraction.extracted(words, reports, mapping)
    batch = intake.batch_id(F.col("doc").cast("string"), F.lit(1), F.sha2(F.col("doc").cast("string").cast("binary"), 256))
    return records.select(
        "doc", "step", "field_id", "retrieval", "state", F.col("amount").cast("string").alias("amount"), "unit", "currency", "anchor_page", "page", "header", "header_inherited", "flag",
        F.array_join("types", ",").alias("types"), batch.alias("batch_id"),
    )


def refused_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of which some statement can't be read, and why."""
    words, reports, mapping = printed(spark, sf_dir)
    return extraction.extracted(words, reports, mapping)[1]


def printed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words by page, reports, mapping. Statements are written once, and each prints its pages whole."""
    rows = statements(spark, sf_dir).withColumn("doc", F.col("suppkey") * 10_000 + F.col("period"))
    used = [*(f for f, *_ in PRINTED), PRIOR, *FLAG_FIELDS]
    rows = storage.kept(rows.select("doc", "suppkey", "period", "cfs_unit", *used), "values")
    on = {}
    for page, top, x0, x1, text in template():
        on.setdefault(page, []).append(f"named_struct('top', {float(top)}D, 'x0', {float(x0)}D, 'x1', {float(x1)}D, 'text', {text})")
    each = ", ".join(f"named_struct('page', {p}L, 'w', filter(array({', '.join(w)}), x -> x.text IS NOT NULL))" for p, w in on.items())
    words = rows.selectExpr("doc", f"inline(array({each}))").filter("size(w) > 0")
    fields = [(f, title, role, [list(label)]) for f, title, role, label, _, _ in PRINTED] + [(PRIOR, INCOME, "上期金额", [["营业收入"]])]
    mapping = spark.createDataFrame(fields, "field_id string, title string, role string, variants array<array<string>>")
    return words, rows.select("doc", F.col("period").alias("year")), mapping


QUERIES = {f.__name__: f for f in (whole_reports, refused_reports)}


def _record(field: str, title: str, role: str, page: int, inherited: bool) -> str:
    state, anchor = f"{field}_state", {BALANCE: 1, INCOME: 3, CASH: 5}[title]
    of_row = "is_operating_revenue_current_state" if field == PRIOR else state
    said = "'年12月31日'" if title == BALANCE else "'年度'"
    year = "period - 1" if role == "上期金额" else "period"
    clear = f"{of_row} NOT IN ('ROW_ABSENT', 'UNKNOWN')"
    amount = f"CASE WHEN {state} = 'VALUE_PRESENT' THEN CAST(CAST({field} AS DECIMAL(28,2)) AS DECIMAL(28,6)) ELSE 0 END"
    return f"""SELECT doc, '{title}' AS step, '{field}' AS field_id, CASE {of_row} WHEN 'ROW_ABSENT' THEN 'ABSENT' WHEN 'UNKNOWN' THEN 'ATTEMPTED_UNKNOWN' ELSE 'GOT_VALUE' END AS retrieval,
      CASE WHEN {of_row} = 'ROW_ABSENT' THEN 'ROW_ABSENT' WHEN {clear} THEN CASE WHEN {state} = 'VALUE_PRESENT' THEN 'VALUE_PRESENT' ELSE 'EMPTY_CELL' END END AS state,
      CASE WHEN {clear} THEN CAST(CAST({amount} AS DECIMAL(28,6)) AS VARCHAR) END AS amount, {"CASE WHEN suppkey % 23 = 0 THEN '万元' ELSE '元' END" if title == CASH else "'元'"} AS unit, '人民币' AS currency, {anchor} AS anchor_page,
      CASE WHEN {clear} THEN {page} END AS page, CASE WHEN {clear} THEN CAST({year} AS VARCHAR) || {said} END AS header, CASE WHEN {clear} THEN {str(inherited).lower()} END AS header_inherited, CAST(NULL AS BOOLEAN) AS flag, CAST(NULL AS VARCHAR) AS types FROM r"""


_EACH = [_record(f, t, role, page, page in (2, 6)) for f, t, role, _, page, _ in PRINTED] + [_record(PRIOR, INCOME, "上期金额", 3, False)]
_NOTE = "CAST(NULL AS VARCHAR) AS amount, CAST(NULL AS VARCHAR) AS unit, CAST(NULL AS VARCHAR) AS currency, CAST(NULL AS INTEGER) AS anchor_page"
_EACH += [
    f"""SELECT doc, '{SCOPE}', 'notes.consolidation_scope_change', 'GOT_VALUE', 'VALUE_PRESENT', {_NOTE}, NULL, NULL, NULL, notes_consolidation_scope_change,
      CASE WHEN NOT notes_consolidation_scope_change THEN '' WHEN suppkey % 2 = 0 THEN '同一控制下企业合并,非同一控制下企业合并' ELSE '同一控制下企业合并' END FROM r""",
    f"""SELECT doc, '{KEY_DATA}', 'notes.restatement_flag', CASE WHEN notes_restatement_flag IS NULL THEN 'ATTEMPTED_UNKNOWN' ELSE 'GOT_VALUE' END, CASE WHEN notes_restatement_flag IS NOT NULL THEN 'VALUE_PRESENT' END, {_NOTE},
      CASE WHEN notes_restatement_flag THEN 9 END, NULL, NULL, notes_restatement_flag, NULL FROM r""",
]
ORACLES = {
    "whole_reports": f"""{WITH}, r AS (SELECT *, suppkey * 10000 + period AS doc FROM st WHERE notes_reporting_period_months = 12), x AS ({" UNION ALL ".join(_EACH)})
SELECT *, substr(sha256(concat_ws(':', doc, 1, sha256(CAST(doc AS VARCHAR)))), 1, 16) AS batch_id FROM x""",
    "refused_reports": f"""{WITH} SELECT suppkey * 10000 + period AS doc, 'UNAVAILABLE' AS code, t.title, 'no_unit' AS problem FROM st, (VALUES {", ".join(f"('{t}')" for t in STATEMENTS)}) t(title) WHERE notes_reporting_period_months <> 12""",
}
