"""Nulls, empty tables and ties of intake, stated numbers and review."""

from decimal import Decimal

import duckdb
from pyspark.sql import functions as F

from metricspark.operators import intake, intent, numbers, review
from metricspark.operators import text as text_operators
from metricspark.plans.queries import CLAIM_KINDS, ORACLES, QUERIES

VOTES = "status string, vote string"


def test_numbers_of_a_sentence(spark):
    text = "600519 2023 年 现金流 639735 万元，增长 -1,477.50%"
    rows = spark.createDataFrame([(text,), ("",), (None,)], "text string").select(numbers.stated(F.col("text")).alias("x"))
    first, empty, null = (r["x"] for r in rows.collect())
    assert [(x["value"], x["tolerance"], x["unit"]) for x in first] == [
        (Decimal("6397350000"), 5000.0, "万元"),
        (Decimal("-14.775"), 0.00005, "%"),
    ]
    assert empty == [] and null is None


def test_plain_forms(spark):
    row = spark.createDataFrame([("　a  \n b​ ",)], "t string").select(
        numbers.normalised(F.col("t")).alias("n"), numbers.visible(F.col("t")).alias("v")
    ).first()
    assert row["n"] == "a b​" and row["v"] == "　a   b "


def test_first_report_of_equal_times(spark):
    rows = [("c", 2023, "2023年年度报告", "t", u) for u in ("b", "a")] + [("c", 2023, None, "s", "0"), ("d", 2023, "2023年年度报告摘要", "s", "0")]
    told = spark.createDataFrame(rows, "code string, year int, title string, time string, url string")
    assert [(r["code"], r["url"]) for r in intake.annual_reports(told).collect()] == [("c", "a")]
    assert intake.annual_reports(told.limit(0)).count() == 0


def test_null_payload_has_no_columns(spark):
    rows = spark.createDataFrame([(1, {"a": None}), (2, None)], "key int, row map<string,string>")
    got = intake.references(rows, (("f", "a"),)).orderBy("key").collect()
    assert [(r["present"], r["raw"]) for r in got] == [(True, None), (False, None)]


def test_batch_is_left_out_whole(spark):
    records = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1), (3, "a", None)], "batch int, field string, value int")
    allowed = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (2, "a", 1), (3, "a", None), (4, "a", 1)], "batch int, field string, expected int")
    batches = spark.createDataFrame([(k, "d", None) for k in (1, 2, 3, 4)], "batch int, digest string, checked_digest string")
    assert sorted(r["batch"] for r in intake.verified(records, allowed, batches).collect()) == [2, 3]


def test_no_votes_and_no_cases(spark):
    row = review.review_score(spark.createDataFrame([], VOTES)).first()
    assert (row["n"], row["agreed_rate"], row["undecidable_rate"], row["gate"]) == (0, 0.0, 0.0, "FAIL")
    schema = "metric_id string, version int, want int, want_metric string, want_version int, status string, layers array<string>, gaps array<string>"
    assert {(r["rate_name"], r["total"], r["rate"]) for r in review.rates(spark.createDataFrame([], schema)).collect()} == {
        (k, 0, None) for k in ("answers", "definitions", "attribution", "evidence")
    }


def test_null_vote_agrees_with_nothing(spark):
    row = review.review_score(spark.createDataFrame([("PASS", None), ("FAIL", review.WRONG)], VOTES)).first()
    assert (row["n"], row["agreed"], row["wrong_agreed"]) == (2, 1, 1)


def test_whole_part_of_a_long_number_is_no_code(spark):
    text = "600519 2023 年 比率 125324.77，现金流 -123456.5 万元。见600519."
    row = spark.createDataFrame([(text,)], "text string").select(numbers.stated(F.col("text")).alias("x"), numbers.codes(F.col("text")).alias("codes")).first()
    assert [(x["value"], x["tolerance"], x["unit"]) for x in row["x"]] == [(Decimal("125324.77"), 0.005, ""), (Decimal("-1234565000"), 500.0, "万元")]
    assert row["codes"] == ["600519"]


def test_long_values_are_claimed_and_judged(spark):
    names = spark.createDataFrame([("毛利率", "m", "毛利率")], "alias string, metric_id string, display string")
    companies = spark.createDataFrame([("华鑫科技", "900001")], "name string, code string")
    values = spark.sql("SELECT '900001' AS entity, 2023L AS period, 'm' AS metric_id, CAST(125324.7742635 AS DECIMAL(38,10)) AS value, CAST(NULL AS STRING) AS refusal_code")
    texts = [(1, "900001 2023年 毛利率 125324.77"), (2, "华鑫科技 2023年 毛利率 125324.77"), (3, "900001 2023年；毛利率 125324.77"), (4, "900001 2023年 毛利率 125324.82")]
    verdicts = intent.claims(spark.createDataFrame(texts, "doc_id int, text string"), values, names, companies)
    got = [r["verdict"] for r in verdicts.orderBy("doc_id", "pos").collect()]
    assert got == ["CONSISTENT", "CONSISTENT", "NOT_CHECKABLE", "CONSISTENT", "INCONSISTENT"]
    counts = text_operators.verdict_counts(verdicts).first().asDict()
    assert counts == {"consistent": 3, "inconsistent": 1, "ambiguous_basis": 0, "not_covered": 0, "not_checkable": 1}


def test_longer_codes_are_masked_where_asked_for(spark):
    said = "1000123 2023 年 12.5% 与 1234567 万元"
    t = F.col("t")
    row = spark.createDataFrame([(said,)], "t string").select(
        numbers.masked(t, numbers.LONG_CODE).alias("m"), numbers.codes(t, numbers.LONG_CODE).alias("c"), numbers.stated(t, numbers.LONG_CODE).alias("s"), numbers.stated(t).alias("plain")
    ).first()
    assert row["m"] == "　" * 7 + " " + "　" * 4 + " 　 12.5% 与 1234567 万元" and len(row["m"]) == len(said)
    assert row["c"] == ["1000123", "1234567"] and [float(x["value"]) for x in row["s"]] == [0.125, 12345670000.0]
    assert [float(x["value"]) for x in row["plain"]] == [1000123.0, 0.125, 12345670000.0]


def test_claims_of_long_keys_and_values_are_those_of_sql(spark, tmp_path):
    """Suppliers of all kinds with keys of up to eleven digits and profits near zero, so that a ratio has six digits before the point."""
    keys = [first + i for first in (26, 1_000_012, 60_000_000_001) for i in range(CLAIM_KINDS)]
    lines = [(k, price, discount, tax) for k in keys for price, discount, tax in ((100000.0, 0.05, 0.05), (10.0, 0.01, 0.0))]
    con = duckdb.connect()
    con.execute(f"CREATE TABLE supplier AS SELECT unnest({keys})::BIGINT AS s_suppkey, 500.0::DOUBLE AS s_acctbal")
    con.execute("CREATE TABLE lineitem (l_suppkey BIGINT, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR DEFAULT 'N', l_shipdate TIMESTAMP DEFAULT '1996-05-05')")
    con.executemany("INSERT INTO lineitem (l_suppkey, l_extendedprice, l_discount, l_tax) VALUES (?, ?, ?, ?)", lines)
    for t in ("supplier", "lineitem"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    got = QUERIES["claim_verdicts"](spark, str(tmp_path)).select("claim_id", "pos", "read_as", "verdict", "inherited")
    want = con.execute(f"SELECT claim_id, pos, read_as, verdict, inherited FROM ({ORACLES['claim_verdicts']})").fetchall()
    assert len(want) > 300 and sorted(tuple(r) for r in got.collect()) == sorted(want)
