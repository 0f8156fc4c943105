"""The SQL checks of the metrics, written apart from their definitions."""

from __future__ import annotations

from metricspark.sources.statements import STATEMENTS_SQL

#: metric, numerator, divisor, what refuses in order, trigger of its flag, the flag's name.
RESTATED = ("notes_restatement_flag", "restated")
BY_HAND = (
    ("accounts_payable_turnover_days", "365 * bs_accounts_payable", "is_operating_cost", ("is_operating_cost IS NULL", "is_operating_cost <= 0", "bs_accounts_payable IS NULL"), None),
    ("accounts_receivable_turnover_days", "365 * bs_accounts_receivable", "is_operating_revenue_current", ("is_operating_revenue_current IS NULL", "is_operating_revenue_current <= 0", "bs_accounts_receivable IS NULL"), None),
    ("current_ratio", "bs_total_current_assets", "bs_total_current_liabilities_period_end", ("bs_total_current_liabilities_period_end IS NULL", "bs_total_current_liabilities_period_end <= 0", "bs_total_current_assets IS NULL"), RESTATED),
    ("debt_to_asset_ratio", "bs_total_liabilities", "bs_total_assets", ("bs_total_assets IS NULL", "bs_total_assets <= 0", "bs_total_liabilities IS NULL"), RESTATED),
    ("free_cash_flow", "cfs_net_cash_flow_from_operating_activities - cfs_cash_paid_for_fixed_intangible_and_other_long_term_assets", None, ("cfs_net_cash_flow_from_operating_activities IS NULL", "cfs_cash_paid_for_fixed_intangible_and_other_long_term_assets IS NULL"), None),
    ("gross_profit_margin", "is_operating_revenue_current - is_operating_cost", "is_operating_revenue_current", ("is_operating_revenue_current IS NULL", "is_operating_revenue_current <= 0", "is_operating_cost IS NULL"), RESTATED),
    ("interest_bearing_debt_ratio", "bs_short_term_borrowings + bs_trading_financial_liabilities + bs_non_current_liabilities_due_within_one_year + bs_long_term_borrowings + bs_bonds_payable + bs_lease_liabilities", "bs_total_assets", ("bs_total_assets IS NULL", "bs_total_assets <= 0", "bs_short_term_borrowings IS NULL OR bs_trading_financial_liabilities IS NULL OR bs_non_current_liabilities_due_within_one_year IS NULL OR bs_long_term_borrowings IS NULL OR bs_bonds_payable IS NULL OR bs_lease_liabilities IS NULL"), None),
    ("inventory_turnover_days", "365 * bs_inventory", "is_operating_cost", ("is_operating_cost IS NULL", "is_operating_cost <= 0", "bs_inventory IS NULL"), None),
    ("minority_interest_share", "bs_minority_interests", "bs_total_equity", ("bs_total_equity IS NULL", "bs_total_equity = 0", "bs_minority_interests IS NULL"), ("notes_consolidation_scope_change", "scope_change")),
    ("net_profit_attributable_excl_nonrecurring", "is_net_profit_attributable_to_parent - notes_nonrecurring_pl_net_attributable_to_parent", None, ("notes_nonrecurring_pl_net_attributable_to_parent IS NULL", "is_net_profit_attributable_to_parent IS NULL"), RESTATED),
    ("net_profit_margin_attributable", "is_net_profit_attributable_to_parent", "is_operating_revenue_current", ("is_operating_revenue_current IS NULL", "is_operating_revenue_current <= 0", "is_net_profit_attributable_to_parent IS NULL"), RESTATED),
    ("net_working_capital", "bs_total_current_assets - bs_total_current_liabilities_period_end", None, ("bs_total_current_assets IS NULL", "bs_total_current_liabilities_period_end IS NULL"), RESTATED),
    ("ocf_to_net_profit_attributable", "cfs_net_cash_flow_from_operating_activities", "is_net_profit_attributable_to_parent", ("is_net_profit_attributable_to_parent IS NULL", "is_net_profit_attributable_to_parent <= 0", "cfs_net_cash_flow_from_operating_activities IS NULL"), RESTATED),
    ("operating_cash_flow_ratio", "cfs_net_cash_flow_from_operating_activities", "bs_total_current_liabilities_period_end", ("bs_total_current_liabilities_period_end IS NULL", "bs_total_current_liabilities_period_end <= 0", "cfs_net_cash_flow_from_operating_activities IS NULL"), ("notes_reporting_period_months <> 12", "period_length_mismatch")),
    ("period_expense_ratio", "is_selling_expense + is_administrative_expense + is_financial_expense", "is_operating_revenue_current", ("is_operating_revenue_current IS NULL", "is_operating_revenue_current <= 0", "is_selling_expense IS NULL", "is_administrative_expense IS NULL", "is_financial_expense IS NULL"), RESTATED),
    ("quick_ratio", "bs_total_current_assets - bs_inventory", "bs_total_current_liabilities_period_end", ("bs_total_current_liabilities_period_end IS NULL", "bs_total_current_liabilities_period_end <= 0", "bs_total_current_assets IS NULL", "bs_inventory IS NULL"), RESTATED),
    ("return_on_total_assets", "is_net_profit", "bs_total_assets", ("bs_total_assets IS NULL", "bs_total_assets <= 0", "is_net_profit IS NULL"), RESTATED),
    ("revenue_growth_yoy", "is_operating_revenue_current - is_operating_revenue_prior_as_presented", "is_operating_revenue_prior_as_presented", ("is_operating_revenue_prior_as_presented IS NULL", "is_operating_revenue_prior_as_presented <= 0", "is_operating_revenue_current IS NULL"), RESTATED),
    ("roe_weighted_average", "kpi_roe_weighted_average_disclosed", None, ("kpi_roe_weighted_average_disclosed IS NULL",), RESTATED),
    ("total_asset_turnover", "is_operating_revenue_current", "bs_total_assets", ("bs_total_assets IS NULL", "bs_total_assets <= 0", "is_operating_revenue_current IS NULL"), None),
)


def exact(source: str, target: str) -> str:
    """CTEs from ``source``, with decimals ``top`` and ``over``, to ``target``, with their quotient as text: 28 digits, half to even; top alone where over is null."""
    length = "length(CAST(abs({}) AS VARCHAR))"
    power = "CAST(rpad('1', CAST({} + 1 AS INTEGER), '0') AS HUGEINT)"
    step = lambda rest, places: (f"({rest} * {power.format(places)}) // y", f"({rest} * {power.format(places)}) % y")
    whole = lambda c: f"CAST(replace(CAST({c} AS VARCHAR), '.', '') AS HUGEINT)"
    scaled = lambda c: f"abs({c}) * {power.format(f'(28 - l{c})')}"
    return f"""{target}_1 AS (SELECT *, {whole("top")} AS n, {whole("over")} AS d FROM {source}
), {target}_2 AS (SELECT *, {length.format("n")} AS ln, {length.format("d")} AS ld FROM {target}_1
), {target}_3 AS (SELECT *, {scaled("n")} AS x, {scaled("d")} AS y FROM {target}_2
), {target}_4 AS (SELECT *, x // y AS q0, x % y AS r0 FROM {target}_3
), {target}_5 AS (SELECT *, {step("r0", 10)[0]} AS q1, {step("r0", 10)[1]} AS r1 FROM {target}_4
), {target}_6 AS (SELECT *, {step("r1", 10)[0]} AS q2, {step("r1", 10)[1]} AS r2 FROM {target}_5
), {target}_7 AS (SELECT *, q0 * {power.format(28)} + q1 * {power.format(18)} + q2 * {power.format(8)} + {step("r2", 8)[0]} AS q, {step("r2", 8)[1]} AS r FROM {target}_6
), {target}_8 AS (SELECT *, ln - ld - 28 + CASE WHEN q0 > 0 THEN 1 ELSE 0 END AS e, CAST(CASE WHEN q0 > 0
    THEN q // 10 + CASE WHEN q % 10 > 5 OR (q % 10 = 5 AND (r > 0 OR (q // 10) % 2 = 1)) THEN 1 ELSE 0 END
    ELSE q + CASE WHEN 2 * r > y OR (2 * r = y AND q % 2 = 1) THEN 1 ELSE 0 END END AS VARCHAR) AS digits FROM {target}_7
), {target} AS MATERIALIZED (SELECT *, CASE WHEN over IS NULL OR n = 0 THEN rtrim(rtrim(CAST(top AS VARCHAR), '0'), '.')
    ELSE CASE WHEN (n < 0) <> (d < 0) THEN '-' ELSE '' END || CASE WHEN e >= 0 THEN digits || repeat('0', e)
      WHEN length(digits) + e > 0 THEN rtrim(rtrim(left(digits, length(digits) + e) || '.' || substr(digits, length(digits) + e + 1), '0'), '.')
      ELSE rtrim('0.' || repeat('0', -e - length(digits)) || digits, '0') END END AS quotient FROM {target}_8
)"""


def _parts(top: str, over: str | None) -> str:
    return f"CAST({top} AS DECIMAL(38,6)) AS top, CAST({over or 'NULL'} AS DECIMAL(38,6)) AS over"


def _answer(metric, top, over, refuses, flag) -> str:
    at = "CASE " + " ".join(f"WHEN {test} THEN {i}" for i, test in enumerate(refuses)) + " END"
    trigger, name = flag or ("false", "")
    return f"SELECT suppkey, entity, period, '{metric}' AS metric_id, {_parts(top, over)}, {at} AS condition_index, {trigger} AS trigger_on, '{name}' AS flag_name FROM st"


WITH = f"WITH {STATEMENTS_SQL}"
METRICS = f"""{WITH}, tried AS (
  {" UNION ALL ".join(_answer(*m) for m in BY_HAND)}
), {exact("tried", "shown")}, mv AS MATERIALIZED (
  SELECT suppkey, entity, period, metric_id, 2 AS version, condition_index,
    CASE WHEN condition_index IS NOT NULL THEN 'UNDEFINED_CONDITION_HIT' WHEN trigger_on IS NULL THEN 'UNEVALUABLE_CONDITION' END AS refusal_code,
    CASE WHEN condition_index IS NULL AND trigger_on IS NOT NULL THEN quotient END AS value,
    CASE WHEN trigger_on THEN flag_name WHEN trigger_on IS NOT NULL THEN '' END AS flags
  FROM shown
)"""

#: A computation refuses by the gate, then by the operands from left to right, then by units.
READS = {
    "accounts_payable_turnover_days": ("bs_accounts_payable", "is_operating_cost"),
    "accounts_receivable_turnover_days": ("bs_accounts_receivable", "is_operating_revenue_current"),
    "current_ratio": ("bs_total_current_assets", "bs_total_current_liabilities_period_end"),
    "debt_to_asset_ratio": ("bs_total_liabilities", "bs_total_assets"),
    "free_cash_flow": ("cfs_net_cash_flow_from_operating_activities", "cfs_cash_paid_for_fixed_intangible_and_other_long_term_assets"),
    "gross_profit_margin": ("is_operating_revenue_current", "is_operating_cost", "is_operating_revenue_current"),
    "interest_bearing_debt_ratio": ("bs_short_term_borrowings", "bs_trading_financial_liabilities", "bs_non_current_liabilities_due_within_one_year", "bs_long_term_borrowings", "bs_bonds_payable", "bs_lease_liabilities", "bs_total_assets"),
    "inventory_turnover_days": ("bs_inventory", "is_operating_cost"),
    "minority_interest_share": ("bs_minority_interests", "bs_total_equity"),
    "net_profit_attributable_excl_nonrecurring": ("is_net_profit_attributable_to_parent", "notes_nonrecurring_pl_net_attributable_to_parent"),
    "net_profit_margin_attributable": ("is_net_profit_attributable_to_parent", "is_operating_revenue_current"),
    "net_working_capital": ("bs_total_current_assets", "bs_total_current_liabilities_period_end"),
    "ocf_to_net_profit_attributable": ("cfs_net_cash_flow_from_operating_activities", "is_net_profit_attributable_to_parent"),
    "operating_cash_flow_ratio": ("cfs_net_cash_flow_from_operating_activities", "bs_total_current_liabilities_period_end"),
    "period_expense_ratio": ("is_selling_expense", "is_administrative_expense", "is_financial_expense", "is_operating_revenue_current"),
    "quick_ratio": ("bs_total_current_assets", "bs_inventory", "bs_total_current_liabilities_period_end"),
    "return_on_total_assets": ("is_net_profit", "bs_total_assets"),
    "revenue_growth_yoy": ("is_operating_revenue_current", "is_operating_revenue_prior_as_presented", "is_operating_revenue_prior_as_presented"),
    "roe_weighted_average": ("kpi_roe_weighted_average_disclosed",),
    "total_asset_turnover": ("is_operating_revenue_current", "bs_total_assets"),
}


def _computed(metric, top, over, _, flag) -> str:
    reads = READS[metric]
    tests = " ".join(f"WHEN {f}_state IS NULL THEN 'UNAVAILABLE' WHEN {f} IS NULL THEN 'UNEVALUABLE_CONDITION'" for f in dict.fromkeys(reads))
    zero = f" WHEN {over} = 0 THEN 'UNEVALUABLE_CONDITION'" if over else ""
    mixed = len({f.split("_")[0] for f in reads}) > 1 and any(f.startswith("cfs_") for f in reads)
    unit = "'无量纲'" if over else ("CASE WHEN suppkey % 23 = 0 THEN '万元' ELSE '元' END" if reads[0].startswith("cfs_") else "'元'")
    trigger, name = flag or ("false", "")
    return (
        f"SELECT suppkey, entity, period, bs_total_assets - bs_total_liabilities - bs_total_equity AS apart, '{metric}' AS metric_id, {_parts(top, over)},"
        f" CASE {tests}{zero} END AS operand, {'suppkey % 23 = 0' if mixed else 'false'} AS mixed, {unit} AS unit, {trigger} AS trigger_on, '{name}' AS flag_name FROM st"
    )


COMPUTED = f"""{WITH}, tried AS (
  {" UNION ALL ".join(_computed(*m) for m in BY_HAND)}
), {exact("tried", "shown")}, judged AS (
  SELECT *, CASE WHEN suppkey % 31 = 0 THEN 'reconcile:not_run' WHEN NOT coalesce(abs(apart) <= 0.01, false) THEN 'reconcile:balance_sheet_identity'
    WHEN operand IS NOT NULL OR mixed THEN 'formula' END AS source FROM shown
)
SELECT entity, period, metric_id, 2 AS version, CASE WHEN source IS NULL THEN quotient END AS value,
  CASE WHEN source IS NULL THEN unit END AS unit,
  CASE WHEN source LIKE 'reconcile%' THEN 'RECONCILIATION_FAILED' WHEN operand IS NOT NULL THEN operand WHEN mixed THEN 'UNEVALUABLE_CONDITION' END AS refusal_code,
  source, CASE WHEN source IS NULL THEN CASE WHEN trigger_on THEN flag_name ELSE '' END END AS flags,
  CASE WHEN source IS NULL THEN CASE WHEN trigger_on IS NULL THEN 'unevaluable' ELSE 'evaluated' END END AS flags_status
FROM judged"""

INPUTS = f"""{WITH}, f(metric_id, pos, field_id) AS (VALUES {", ".join(f"('{m}', {i}, '{f}')" for m, reads in READS.items() for i, f in enumerate(reads))}),
cells AS ({" UNION ALL ".join(f"SELECT entity, period, '{f}' AS field_id, {f}_state AS state, CAST({f} AS DOUBLE) AS amount FROM st" for f in sorted({f for r in READS.values() for f in r}))})
SELECT entity, period, metric_id, pos, field_id, state, amount FROM cells JOIN f USING (field_id)"""
