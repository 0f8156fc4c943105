"""Metric definitions as data: formula, ordered refusal conditions, comparability flags."""

from __future__ import annotations

from dataclasses import dataclass

RESTATED = ("restated", "notes.restatement_flag == true")
SCOPE = ("scope_change", "notes.consolidation_scope_change == true")
PERIOD = ("period_length_mismatch", "notes.reporting_period_months != 12")
#: Fields that are no amounts, by kind.
KINDS = {
    "notes.restatement_flag": "boolean",
    "notes.consolidation_scope_change": "boolean",
    "notes.reporting_period_months": "number",
}


@dataclass(frozen=True)
class Definition:
    """``conditions`` refuse in their order; ``flags`` are (name, trigger). All are texts.

    ``missing`` are (field, value): a field of that value, of its own kind, counts as missing in conditions.
    """

    metric_id: str
    formula: str
    conditions: tuple[str, ...]
    flags: tuple[tuple[str, str], ...] = ()
    aliases: tuple[str, ...] = ()
    version: int | None = 2
    missing: tuple[tuple[str, object], ...] = ()

    @property
    def display(self) -> str:
        return self.metric_id.replace("_", " ")


def define(metric_id, formula, over, operands, flag=None, sign="<= 0", aliases=()):
    """The usual conditions: the divisor is there and has the right sign, then each operand is there."""
    first = [f"is_missing({over})", f"{over} {sign}"] if over else []
    missing = [" or ".join(f"is_missing({f})" for f in each.split()) for each in operands]
    whole = f"{formula} / {over}" if over else formula
    return Definition(metric_id, whole, (*first, *missing), (flag,) if flag else (), aliases)


REVENUE, COST, ASSETS = "is.operating_revenue_current", "is.operating_cost", "bs.total_assets"
CURRENT, DUE = "bs.total_current_assets", "bs.total_current_liabilities_period_end"
PARENT, CASH = "is.net_profit_attributable_to_parent", "cfs.net_cash_flow_from_operating_activities"
PRIOR, CAPEX = "is.operating_revenue_prior_as_presented", "cfs.cash_paid_for_fixed_intangible_and_other_long_term_assets"
EXPENSES = ("is.selling_expense", "is.administrative_expense", "is.financial_expense")
ONE_OFF = "notes.nonrecurring_pl_net_attributable_to_parent"
DEBTS = (
    "bs.short_term_borrowings",
    "bs.trading_financial_liabilities",
    "bs.non_current_liabilities_due_within_one_year",
    "bs.long_term_borrowings",
    "bs.bonds_payable",
    "bs.lease_liabilities",
)

DEFINITIONS = (
    define("accounts_payable_turnover_days", "365 * bs.accounts_payable", COST, ["bs.accounts_payable"], aliases=("payable days",)),
    define("accounts_receivable_turnover_days", "365 * bs.accounts_receivable", REVENUE, ["bs.accounts_receivable"], aliases=("receivable days",)),
    define("current_ratio", CURRENT, DUE, [CURRENT], RESTATED, aliases=("liquidity",)),
    define("debt_to_asset_ratio", "bs.total_liabilities", ASSETS, ["bs.total_liabilities"], RESTATED, aliases=("debt ratio", "leverage")),
    define("free_cash_flow", f"{CASH} - {CAPEX}", None, [CASH, CAPEX]),
    define("gross_profit_margin", f"({REVENUE} - {COST})", REVENUE, [COST], RESTATED, aliases=("gross margin",)),
    define("interest_bearing_debt_ratio", f"({' + '.join(DEBTS)})", ASSETS, [" ".join(DEBTS)]),
    define("inventory_turnover_days", "365 * bs.inventory", COST, ["bs.inventory"], aliases=("inventory days",)),
    define("minority_interest_share", "bs.minority_interests", "bs.total_equity", ["bs.minority_interests"], SCOPE, "== 0"),
    define("net_profit_attributable_excl_nonrecurring", f"{PARENT} - {ONE_OFF}", None, [ONE_OFF, PARENT], RESTATED),
    define("net_profit_margin_attributable", PARENT, REVENUE, [PARENT], RESTATED, aliases=("net margin",)),
    define("net_working_capital", f"{CURRENT} - {DUE}", None, [CURRENT, DUE], RESTATED, aliases=("working capital",)),
    define("ocf_to_net_profit_attributable", CASH, PARENT, [CASH], RESTATED),
    define("operating_cash_flow_ratio", CASH, DUE, [CASH], PERIOD),
    define("period_expense_ratio", f"({' + '.join(EXPENSES)})", REVENUE, list(EXPENSES), RESTATED),
    define("quick_ratio", f"({CURRENT} - bs.inventory)", DUE, [CURRENT, "bs.inventory"], RESTATED, aliases=("acid test",)),
    define("return_on_total_assets", "is.net_profit", ASSETS, ["is.net_profit"], RESTATED, aliases=("asset return",)),
    define("revenue_growth_yoy", f"({REVENUE} - {PRIOR})", PRIOR, [REVENUE], RESTATED, aliases=("revenue growth",)),
    define("roe_weighted_average", "kpi.roe_weighted_average_disclosed", None, ["kpi.roe_weighted_average_disclosed"], RESTATED),
    define("total_asset_turnover", REVENUE, ASSETS, [REVENUE], aliases=("asset turnover",)),
)
