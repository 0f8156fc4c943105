"""Every query with SQL gives the rows of that SQL."""

import itertools
from decimal import Decimal
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from metricspark.operators import checks, expressions, intent, metrics, numbers, pages, rules
from metricspark.plans.queries import ORACLES, QUERIES, TERMS
from metricspark.sources.statements import FIELDS


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_as_sql(spark, con, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    def shown(x):
        if pd.isna(x):
            return "~"
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        return f"{x:.6f}" if isinstance(x, (int, float, np.number)) or type(x) is Decimal else str(x)

    plain = lambda d: sorted(tuple(map(shown, r)) for r in d[columns].itertuples(index=False))
    assert len(got) == len(want) > 0
    assert plain(got) == plain(want)


def test_line_begins_by_its_first_word(spark):
    words = spark.createDataFrame([(1, 0, float(x), x + 1.0, float(x), str(x)) for x in (0, 2, 4, 6)], "doc long, page long, x0 double, x1 double, top double, text string")
    assert [r["text"] for r in pages.lines(words, between=" ").orderBy("line").collect()] == ["0 2", "4 6"]


def test_stitching_takes_rows_one_after_the_other(spark):
    """All sequences of label, amounts and both up to eight rows, against a loop that takes them greedily."""
    sequences = [s for n in (3, 5, 7, 8) for s in itertools.product("LCB", repeat=n)]
    rows = [(d, 0, i, float(i), f"l{i}" if x in "LB" else "", [(0.0, 1.0, f"c{i}")] if x in "CB" else []) for d, s in enumerate(sequences) for i, x in enumerate(s)]
    got = pages.stitched(spark.createDataFrame(rows, "doc int, page int, line int, y double, label string, cells array<struct<x0:double,x1:double,text:string>>"), ["page", "line"])
    found = {}
    for r in got.orderBy("doc", "y").collect():
        found.setdefault(r["doc"], []).append((r["labels"], [c["text"] for c in r["cells"]]))
    for d, s in enumerate(sequences):
        want, i = [], 0
        while i < len(s):
            if "".join(s[i : i + 3]) == "LCL":
                want.append(([f"l{i}", f"l{i + 2}"], [f"c{i + 1}"]))
                i += 3
            else:
                want.append(([f"l{i}"] if s[i] in "LB" else [], [f"c{i}"] if s[i] in "CB" else []))
                i += 1
        assert found[d] == want, s


#: One published report: its figures, and the values that it must give.
REPORT = {
    "bs.accounts_payable": "3093091103.67", "bs.accounts_receivable": "60373410.41", "bs.bonds_payable": None, "bs.inventory": "46435185061.53",
    "bs.lease_liabilities": "266636234.04", "bs.long_term_borrowings": None, "bs.minority_interests": "7987897687.39",
    "bs.non_current_liabilities_due_within_one_year": "57054879.48", "bs.short_term_borrowings": None, "bs.total_assets": "272699660092.25",
    "bs.total_current_assets": "225172517821.28", "bs.total_current_liabilities_period_end": "48697611501.20", "bs.total_equity": "223656469294.82",
    "bs.total_liabilities": "49043190797.43", "bs.trading_financial_liabilities": None,
    "cfs.cash_paid_for_fixed_intangible_and_other_long_term_assets": "2619755888.79", "cfs.net_cash_flow_from_operating_activities": "66593247721.09",
    "is.administrative_expense": "9729389252.31", "is.financial_expense": "-1789503701.48", "is.net_profit": "77521476277.80",
    "is.net_profit_attributable_to_parent": "74734071550.75", "is.operating_cost": "11867273851.78", "is.operating_revenue_current": "147693604994.14",
    "is.operating_revenue_prior_as_presented": "124099843771.99", "is.selling_expense": "4648613585.82",
}
GOLDEN = {
    "debt_to_asset_ratio": "0.1798432413917914711797119101", "current_ratio": "4.623892443179299031292014007", "quick_ratio": "3.670351116817004026158851655",
    "net_working_capital": "176474906320.08", "interest_bearing_debt_ratio": "0.001186987594375806682042917962", "gross_profit_margin": "0.9196493724135797573790928685",
    "period_expense_ratio": "0.08523388089246972163777756369", "free_cash_flow": "63973491832.3", "net_profit_margin_attributable": "0.5060074981155426732183636527",
}


def statement(spark, figures, restated=True, gate=True, states=None):
    """One statement; a field set to None is an empty cell, ``states`` overrides how cells were found."""
    cells = []
    for f in FIELDS:
        path = f.replace("_", ".", 1)
        found = "EMPTY_CELL" if path in figures and figures[path] is None else "VALUE_PRESENT" if path in figures else None
        found = (states or {}).get(path, found)
        amount = figures.get(path)
        cells.append(f"named_struct('v', CAST({repr(amount) if amount else 'NULL'} AS DECIMAL(28,6)), 'state', CAST({repr(found) if found else 'NULL'} AS STRING)) AS {f}")
    flag = {True: "true", False: "false", None: "CAST(NULL AS BOOLEAN)"}[restated]
    return spark.range(1).selectExpr(
        "id AS suppkey", "'600519' AS entity", "2023L AS period", f"{flag} AS notes_restatement_flag", "true AS notes_consolidation_scope_change",
        "12 AS notes_reporting_period_months", "'元' AS cfs_unit", f"{str(gate).lower()} AS gate_ran", *cells,
    )


def by_metric(rows):
    return {r["metric_id"]: r for r in rows.collect()}


def test_golden_values(spark):
    """Figures of one real report give the published values on both paths."""
    one = statement(spark, REPORT)
    for rows in (by_metric(metrics.metric_values(one)), by_metric(metrics.computed_metrics(one))):
        for metric_id, want in GOLDEN.items():
            assert rows[metric_id]["value"] == want, metric_id
            assert rows[metric_id]["version"] == 2
        assert rows["debt_to_asset_ratio"]["flags"] == ["restated"]
        assert rows["roe_weighted_average"]["value"] is None


def test_refusals_of_an_answer(spark):
    """The first condition that holds refuses with its index; undecided flags refuse last."""
    def outcome(figures, **k):
        r = by_metric(metrics.metric_values(statement(spark, figures, **k)))["quick_ratio"]
        return r["refusal_code"], r["condition_index"]

    without = lambda *names: {k: v for k, v in REPORT.items() if k not in names}
    assert outcome(REPORT) == (None, None)
    assert outcome(without("bs.total_current_liabilities_period_end")) == ("UNDEFINED_CONDITION_HIT", 0)
    assert outcome(REPORT | {"bs.total_current_liabilities_period_end": "-1"}) == ("UNDEFINED_CONDITION_HIT", 1)
    assert outcome(without("bs.inventory")) == ("UNDEFINED_CONDITION_HIT", 3)
    assert outcome(REPORT, restated=None) == ("UNEVALUABLE_CONDITION", None)


def test_refusals_of_a_computation(spark):
    """Gate, then operands from left to right; undecided flags are noted beside the value."""

    def outcome(figures, metric_id="quick_ratio", **k):
        r = by_metric(metrics.computed_metrics(statement(spark, figures, **k)))[metric_id]
        return r["refusal_code"], r["source"], r["unit"], r["flags_status"]

    assert outcome(REPORT, restated=None) == (None, None, "无量纲", "unevaluable")
    assert outcome(REPORT, "free_cash_flow") == (None, None, "元", "evaluated")
    assert outcome(REPORT, gate=False)[:2] == ("RECONCILIATION_FAILED", "reconcile:not_run")
    assert outcome(REPORT | {"bs.total_equity": "1"})[:2] == ("RECONCILIATION_FAILED", "reconcile:balance_sheet_identity")
    assert outcome({k: v for k, v in REPORT.items() if k != "bs.inventory"})[:2] == ("UNAVAILABLE", "formula")
    for state in ("UNKNOWN", "ROW_ABSENT"):
        assert outcome(REPORT, states={"bs.inventory": state})[:2] == ("UNEVALUABLE_CONDITION", "formula")
    assert outcome(REPORT | {"bs.total_current_liabilities_period_end": None})[:2] == ("UNEVALUABLE_CONDITION", "formula")


def test_conditions_short_circuit(spark):
    """True, false and undecided operands in all combinations: what the left side settles hides the right, nothing hides the left."""
    cell = lambda p: (p.split(".")[1], "boolean")
    rows = spark.sql("SELECT * FROM VALUES (true), (false), (CAST(NULL AS BOOLEAN)) AS t(x)").crossJoin(spark.sql("SELECT * FROM VALUES (true), (false), (CAST(NULL AS BOOLEAN)) AS t(y)"))
    texts = {"and": "bs.x == true and bs.y == true", "or": "bs.x == true or bs.y == true", "not": "not (bs.x == true)", "none": "is_missing(bs.x)", "null": "bs.x != null"}
    got = rows.selectExpr("x", "y", *(f"{expressions.condition(t, cell)} AS `{n}`" for n, t in texts.items())).collect()
    assert len(got) == 9
    for r in got:
        x, y = r["x"], r["y"]
        assert r["and"] == (None if x is None else False if not x else y)
        assert r["or"] == (None if x is None else True if x else y)
        assert r["not"] == (None if x is None else not x)
        assert r["none"] == (x is None)
        assert r["null"] == (None if x is None else True)


@pytest.mark.parametrize("text", ["", "bs.x", "bs.x = 1", "bs.x + 1 > 2", "f(bs.x)", "is_missing(1)", "foo.x > 1", "bs.x < null and", "x > 1", "1 < bs.x < 2", "bs.x == [1]", "bs.x < 'a'"])
def test_unreadable_conditions(text):
    assert expressions.unreadable(text)


@pytest.mark.parametrize("text", ["is.a / bs.b", "-is.a * 365", "(is.a - is.b) / is.a", "1.5"])
def test_readable_formulas(text):
    assert expressions.unreadable(text, as_formula=True) is None
    assert expressions.unreadable(text + " ** 2", as_formula=True)
    assert expressions.is_ratio(text) == ("/" in text)


def test_masks_keep_places(spark):
    said = "600519 2023 年 12.5% 与 639735 万元"
    row = spark.createDataFrame([(said,)], "t string").select(numbers.masked(F.col("t")).alias("m"), numbers.stated(F.col("t")).alias("s")).first()
    assert len(row["m"]) == len(said) and "600519" not in row["m"] and "2023" not in row["m"] and "639735 万元" in row["m"]
    assert [(float(x["value"]), x["tolerance"]) for x in row["s"]] == [(0.125, 0.0005), (6397350000.0, 5000.0)]


def test_company_names_need_boundaries(spark):
    names = spark.createDataFrame([("毛利率", "gross_profit_margin", "毛利率")], "alias string, metric_id string, display string")
    companies = spark.createDataFrame([("华鑫科技", "900001"), ("贵州茅台", "600519"), ("茅台", "600519")], "name string, code string")
    asked = {
        "华鑫科技 2023 年毛利率": (None, "900001"),
        "华鑫科技毛利率2023年": (None, "900001"),
        "南华鑫科技 2023 年毛利率": ("name_prefix", None),
        "华鑫科技集团有限公司 2023 年毛利率": ("name_suffix", None),
        "华鑫科技股份有限公司 2023 年毛利率": (None, "900001"),
        "华鑫科技与贵州茅台 2023 年毛利率": ("many_entities", None),
        "贵州茅台2023年毛利率": (None, "600519"),
        "2023年毛利率": ("no_entity", None),
        "600519 毛利率": ("no_period", None),
        "600519 2022年 2023年毛利率": ("many_periods", None),
        "600519 900001 2023年毛利率": ("many_entities", None),
        "600519 2023年天气": ("no_metric", None),
    }
    rows = spark.createDataFrame(list(enumerate(asked)), "id int, text string")
    got = {r["text"]: (r["reason"], r["entity"]) for r in intent.intents(rows, names, companies, "id").collect()}
    assert got == asked
    guessed = intent.intents(rows.filter("text LIKE '%天气'"), names, companies, "id", ask=lambda t: F.lit("毛利率")).first()
    assert (guessed["reason"], guessed["resolved_by"], guessed["metric_id"]) == (None, "model", "gross_profit_margin")


def test_claims_take_the_first_company_and_stop(spark):
    names = spark.createDataFrame([("毛利率", "m", "毛利率")], "alias string, metric_id string, display string")
    companies = spark.createDataFrame([("华鑫科技", "900001")], "name string, code string")
    values = spark.sql("SELECT '900001' AS entity, 2023L AS period, 'm' AS metric_id, CAST(0.5 AS DECIMAL(38,10)) AS value, CAST(NULL AS STRING) AS refusal_code")
    texts = [
        (1, "华鑫科技 2023 年很好。毛利率 50%。毛利率 40%；毛利率提高 50%；600519 与 900001 毛利率 50%"),
        (2, "毛利率怎么样？"),
        (3, "900001 2023年，" + "毛利率 50%，" * 26),
    ]
    got = intent.claims(spark.createDataFrame(texts, "doc_id int, text string"), values, names, companies).orderBy("doc_id", "pos").collect()
    first = [(r["verdict"], r["why"]) for r in got if r["doc_id"] == 1]
    assert first == [("NOT_CHECKABLE", "no_number"), ("CONSISTENT", "value"), ("INCONSISTENT", "off_value"), ("NOT_COVERED", "change"), ("NOT_COVERED", "many_entities")]
    assert [r["read_as"] for r in got if r["doc_id"] == 2] == ["QUESTION"]
    assert [r["why"] for r in got if r["doc_id"] == 3] == ["no_number"] + ["value"] * 24 + ["too_many"] * 2


def test_tolerance_and_reasons(spark):
    ours = spark.sql("SELECT * FROM VALUES (1, 1.00, '元'), (2, 1.00, '元'), (3, 1.00, '元'), (4, 1.00, '元'), (5, NULL, '元') AS t(key, value, unit)")
    theirs = spark.sql("SELECT * FROM VALUES (1, true, 1.01, '元'), (2, true, 1.02, '元'), (3, true, 1.00, 'x'), (5, true, 1.00, '元') AS t(key, present, value, unit)")
    got = [(r["verdict"], r["reason"]) for r in checks.compared(ours, theirs, ["key"]).orderBy("key").collect()]
    assert got == [("AGREE", None), ("DISAGREE", None), ("INCOMPARABLE", "UNIT"), ("INCOMPARABLE", "ABSENT"), ("INCOMPARABLE", "OUR_VALUE")]


def test_rules_of_an_empty_definition(spark):
    """What is absent is found once; a rule on items of an absent list finds nothing."""
    row = ("m", *[None] * 10)
    got = [r["code"] for r in rules.findings(spark.createDataFrame([row], rules.SCHEMA), TERMS).collect()]
    assert sorted(got) == [
        "R1.BAD_PERIOD_TYPE", "R1.MISSING_GRAIN", "R1.MISSING_GRAIN", "R3.DERIVATION_MISSING", "R4.FLAGS_KEY_MISSING",
        "R5.BASIS_NOT_STRUCTURED", "R7.NO_UNDEFINED_CONDITIONS", "R8.TOO_FEW_PITFALLS", "R9.VERSION_NOT_INT",
    ]
    assert rules.findings(spark.createDataFrame([], rules.SCHEMA), TERMS).count() == 0


def test_tasks_of_whole_reports_hold_few_rows(spark):
    """Rows that shrink in the shuffle are dealt by their number, and two titles at one place don't count each other's lines."""
    from metricspark import storage
    from metricspark.operators import extraction

    kept = storage.kept(spark.range(3 * storage.ROWS + 1).select(F.lit("x").alias("t")), "lines")
    assert storage.parts(kept) == max(4, spark.sparkContext.defaultParallelism) and storage.parts(kept.union(kept).union(kept)) >= 10
    places = [(1, 1, 5.0, "a"), (1, 1, 5.0, "b"), (1, 1, 7.0, "c"), (1, 2, 1.0, "d"), (2, 1, 1.0, "e"), (None, 1, 1.0, "f")]
    spans = pages.spans(spark.createDataFrame(places, "doc int, page int, y double, title string")).collect()
    assert {r["title"]: (r["next_page"], r["next_y"]) for r in spans} == {"a": (1, 7.0), "b": (1, 7.0), "c": (2, 1.0), "d": (None, None), "e": (None, None)}

    words = [(1, float(10 * k), 0.0, 20.0, "x") for k in range(3, 13)] + [(1, 20.0, 0.0, 40.0, t) for t in extraction.STATEMENTS[1:]]
    words += [(1, 22.0, 0.0, 30.0, "单位:元"), (1, 22.5, 40.0, 70.0, "币种:人民币")] + [(1, 130.0, x, x + 20, t) for x, t in ((0.0, "项目"), (100.0, "2023年度"))]
    rows = spark.createDataFrame([(1, *w) for w in words], "doc long, page long, top double, x0 double, x1 double, text string").replace(22.0, 24.0, "top").replace(22.5, 24.5, "top")
    found = extraction.sheets(pages.lines(rows), pages.spans(pages.statement_anchors(rows)), spark.createDataFrame([(1, 2023)], "doc long, year long"), 3)
    got = sorted((r["title"], r["problem"], r["y"]) for r in found.collect())
    assert got == sorted([(extraction.STATEMENTS[0], "no_title", None), *((t, None, 130.0) for t in extraction.STATEMENTS[1:])])
    assert found.rdd.getNumPartitions() == 3


def test_words_of_a_page_are_not_shuffled_where_they_are_together(spark):
    """Pages of words give the lines of the words; reports are printed from statements that were worked out once."""
    from metricspark.plans import whole

    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    words, reports, _ = whole.printed(spark, SMALL)
    assert "Exchange" not in plan(pages.lines(words)) and "lineitem" not in plan(words) + plan(reports)
    each = words.select("doc", "page", F.explode(F.shuffle("w")).alias("x")).select("doc", "page", "x.*")
    got, want = (pages.lines(d).withColumn("words", F.to_json("words")) for d in (words, each))
    assert got.count() > 1000 and got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


def test_sections_by_one_look(spark):
    rows = [("九、a.b",), ("a.b",), ("九、axb",), ("九、九、a.b",), ("a.b\n",), ("二、 ​ a.b",), ("一、c",), (None,), ("x九、a.b",)]
    lines = spark.createDataFrame(rows, "text string").select(F.lit(1).alias("doc"), F.lit(1).alias("page"), F.lit(1.0).alias("y"), "text")
    got = sorted((r["title"], r["prefix"]) for r in pages.section_anchors(lines, ["a.b", "一、c"]).collect())
    from metricspark.operators.numbers import visible

    seen = [r["v"] for r in lines.select(visible(F.col("text")).alias("v")).collect()]
    want = sorted([(t, p) for v in seen if v is not None for t in ("a.b", "一、c") for p in ("", "九、", "二、") if v == p + t])
    assert got == want and ("a.b", "九、") in got and ("一、c", "") in got


def test_texts_are_shuffled_and_not_their_words(spark, tmp_path):
    """Long texts, empty ones, nulls and an id that comes twice are laid out as word by word."""
    long = " ".join(f"w{i}" for i in range(1234))
    rows = [(1, long), (2, ""), (3, None), (4, " a  b "), (5, "x y"), (5, "p q r\ns"), (5, None), (None, "n"), (6, " ".join("abc"[i % 3] for i in range(400)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["word_lines"](spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    n = F.col("n")
    said = spark.read.parquet(str(tmp_path / "documents.parquet")).select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", r"\s+")).alias("n", "text"))
    placed = said.select("doc", (n / 400).cast("long").alias("page"), (n % 10 * 50.0).alias("x0"), (n % 10 * 50.0 + 40).alias("x1"), (F.floor(n % 400 / 10) * 12.0 + n % 3).cast("double").alias("top"), "text")
    want = pages.lines(placed, between=" ").drop("words")
    assert rows.count() == want.count() == 124 + 1 + 1 + 1 + 1 + 40 and rows.exceptAll(want).count() == 0 == want.exceptAll(rows).count()
