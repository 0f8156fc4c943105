"""Statements of entities by period, derived from the star schema.

Suppliers stand for entities and ship years for periods. The rules below are synthetic:
they exercise the semantics of present, empty, absent and unknown cells and are no
financial facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metricspark.operators.expressions import ABSENT, EMPTY, UNKNOWN, VALUE, readable

__all__ = ["FIELDS", "FLAG_FIELDS", "STATEMENTS_SQL", "readable", "statements", "table"]

#: Field -> amount over the yearly sums and the supplier; decimals throughout.
FIELDS = {
    "is_operating_revenue_current": "revenue",
    "is_operating_revenue_prior_as_presented": "prior",
    "is_operating_cost": "cost",
    "is_net_profit": "revenue - cost - tax",
    "is_net_profit_attributable_to_parent": "(revenue - cost - tax) * 0.90",
    "is_selling_expense": "tax * 0.50",
    "is_administrative_expense": "tax * 0.30",
    "is_financial_expense": "tax * 0.20",
    "bs_total_equity": "equity",
    "bs_total_liabilities": "cost * 0.50",
    "bs_total_assets": "cost * 0.50 + equity + CASE WHEN suppkey % 13 = 0 THEN 1.00 ELSE 0.00 END",
    "bs_total_current_assets": "revenue * 0.60",
    "bs_total_current_liabilities_period_end": "cost * 0.40",
    "bs_inventory": "cost * 0.10",
    "bs_accounts_receivable": "revenue * 0.20",
    "bs_accounts_payable": "cost * 0.15",
    "bs_minority_interests": "equity * 0.10",
    "bs_short_term_borrowings": "cost * 0.01",
    "bs_trading_financial_liabilities": "cost * 0.02",
    "bs_non_current_liabilities_due_within_one_year": "cost * 0.03",
    "bs_long_term_borrowings": "cost * 0.04",
    "bs_bonds_payable": "cost * 0.05",
    "bs_lease_liabilities": "cost * 0.06",
    "cfs_net_cash_flow_from_operating_activities": "revenue * 0.30 - tax",
    "cfs_cash_paid_for_fixed_intangible_and_other_long_term_assets": "tax * 2.00",
    "notes_nonrecurring_pl_net_attributable_to_parent": "CASE WHEN period % 2 = 1 THEN tax * 0.10 END",
    "kpi_roe_weighted_average_disclosed": "CASE WHEN period % 2 = 0 THEN 0.10 END",
}
#: The inventory cell goes through all states of a cell.
INVENTORY_STATE = (
    f"CASE suppkey % 17 WHEN 0 THEN '{UNKNOWN}' WHEN 1 THEN '{ABSENT}' WHEN 2 THEN '{EMPTY}' ELSE '{VALUE}' END"
)


#: Fields that no extraction step reads: where they have no amount there is no record.
UNREAD = ("notes_nonrecurring_pl_net_attributable_to_parent", "kpi_roe_weighted_average_disclosed")


def state_rule(field: str) -> str:
    """How a cell was found, null if there is no record of it."""
    if field == "bs_inventory":
        return INVENTORY_STATE
    if field in UNREAD:
        return f"CASE WHEN ({FIELDS[field]}) IS NOT NULL THEN '{VALUE}' END"
    return f"CASE WHEN ({FIELDS[field]}) IS NULL THEN '{ABSENT}' ELSE '{VALUE}' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity(key: Column) -> Column:
    """A code of six digits, or more where the key is longer."""
    text = key.cast("string")
    return F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, period, suppkey, the yearly sums, flags: one row for each supplier and ship year."""
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    sums = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("suppkey"), F.year("l_shipdate").cast("long").alias("period"))
        .agg(
            F.sum(price).cast("decimal(24,4)").alias("revenue"),
            F.sum(price * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(24,4)").alias("cost"),
            F.sum(price * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(24,4)").alias("tax"),
            (F.count_if(F.col("l_returnflag") == "R") * 3 > F.count(F.lit(1))).alias("restated"),
        )
    )
    # The exchange that the window needs, in as many parts as the session says: rows are few, but all metrics come of each.
    sums = sums.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "suppkey")
    # A supplier's years are few, so the window's groups are bounded.
    before = F.lag("revenue").over(Window.partitionBy("suppkey").orderBy("period"))
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("suppkey"), F.col("s_acctbal").cast("decimal(24,4)").alias("equity")
    )
    return (
        sums.withColumn("prior", before)
        .join(supplier, "suppkey")
        .withColumn("entity", entity(F.col("suppkey")))
        .withColumn("notes_restatement_flag", F.when(F.col("suppkey") % 29 != 0, F.col("restated")))
        .withColumn("notes_consolidation_scope_change", F.col("suppkey") % 11 == 0)
        .withColumn("notes_reporting_period_months", F.when(F.col("suppkey") % 19 == 0, 9).otherwise(12))
    )


FLAG_FIELDS = ("notes_restatement_flag", "notes_consolidation_scope_change", "notes_reporting_period_months")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide statements: entity, period, flags, units, and a cell (v, state) for each field.

    Amounts are in 元, but for some cash flow statements; some statements were never reconciled.
    """
    rows = yearly(spark, sf_dir)
    cells = [F.expr(f"named_struct('v', CAST({rule} AS DECIMAL(28,6)), 'state', {state_rule(f)}) AS {f}") for f, rule in FIELDS.items()]
    gate = F.when(F.col("suppkey") % 31 != 0, F.lit(True)).alias("gate_ran")
    return rows.select("suppkey", "entity", "period", *FLAG_FIELDS, F.when(F.col("suppkey") % 23 == 0, "万元").otherwise("元").alias("cfs_unit"), gate, *cells)


#: The same rules for the SQL check.
STATEMENTS_SQL = f"""
yearly AS (
  SELECT l_suppkey AS suppkey, CAST(year(l_shipdate) AS BIGINT) AS period,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(24,4)) AS revenue,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DECIMAL(24,4)) AS cost,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(24,4)) AS tax,
    count(*) FILTER (WHERE l_returnflag = 'R') * 3 > count(*) AS restated
  FROM lineitem GROUP BY 1, 2
), based AS (
  SELECT yearly.*, lag(revenue) OVER (PARTITION BY suppkey ORDER BY period) AS prior,
    CAST(s_acctbal AS DECIMAL(24,4)) AS equity, CASE WHEN suppkey < 1000000 THEN lpad(CAST(suppkey AS VARCHAR), 6, '0') ELSE CAST(suppkey AS VARCHAR) END AS entity,
    CASE WHEN suppkey % 29 <> 0 THEN restated END AS notes_restatement_flag,
    suppkey % 11 = 0 AS notes_consolidation_scope_change,
    CASE WHEN suppkey % 19 = 0 THEN 9 ELSE 12 END AS notes_reporting_period_months
  FROM yearly JOIN supplier ON s_suppkey = suppkey
), st AS MATERIALIZED (
  SELECT suppkey, entity, period, {", ".join(FLAG_FIELDS)},
    {", ".join(f"{state_rule(f)} AS {f}_state, CASE {state_rule(f)} WHEN '{VALUE}' THEN CAST({rule} AS DECIMAL(28,6)) WHEN '{EMPTY}' THEN 0 END AS {f}" for f, rule in FIELDS.items())}
  FROM based
)"""
