"""Reconciliation within a statement and comparison with a second source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricspark.operators.expressions import readable

TOLERANCE = "0.01"
BALANCE = ("bs_total_assets", "bs_total_liabilities", "bs_total_equity")
#: The unit names of statements and their scales in the base unit.
UNITS = {"元": 1, "万元": 10_000, "亿元": 100_000_000}


#: The scope that can be compared, and other names of a currency.
CONSOLIDATED, CURRENCIES = "合并", {"CNY": "人民币", "RMB": "人民币"}


def currency(name: Column) -> Column:
    out = name
    for other, own in CURRENCIES.items():
        out = F.when(name == other, own).otherwise(out)
    return out


def scale_of(unit: Column) -> Column:
    """The unit's scale, null for an unknown unit."""
    out = F.lit(None).cast("long")
    for name, scale in UNITS.items():
        out = F.when(unit == name, F.lit(scale).cast("long")).otherwise(out)
    return out


def balanced() -> Column:
    """Assets equal liabilities and equity within TOLERANCE; false where any can't be read."""
    a, l, e = (readable(F.col(p)) for p in BALANCE)  # noqa: E741
    return F.coalesce(F.abs(a - (l + e)) <= F.lit(TOLERANCE).cast("decimal(4,2)"), F.lit(False))


def reconcile(statements: DataFrame) -> DataFrame:
    """(entity, period, passed, missing): assets equal liabilities and equity within TOLERANCE.

    What can't be read fails and is listed.
    """
    missing = F.array_join(F.filter(F.array(*(F.when(readable(F.col(p)).isNull(), p) for p in BALANCE)), lambda x: x.isNotNull()), ",")
    return statements.select("entity", "period", balanced().alias("passed"), missing.alias("missing"))


def compared(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, verdict, reason of all of ours: AGREE, DISAGREE or INCOMPARABLE, reasons in fixed order.

    ours: value, unit; theirs: present, value, unit. Where both have them, scope, period
    and currency are compared too: theirs must be consolidated, of the same period, and of
    the same currency or one of its other names. Values are scaled to the base unit; their
    difference is rounded to cents, half to even, before it meets TOLERANCE.
    """
    more = [c for c in ("period", "currency") if c in ours.columns and c in theirs.columns and c not in keys]
    extra = [F.col(c).alias(f"other_{c}") for c in more] + ([F.col("scope").alias("other_scope")] if "scope" in theirs.columns else [])
    both = ours.join(theirs.select(*keys, F.col("present"), F.col("value").alias("other"), F.col("unit").alias("other_unit"), *extra), keys, "left")
    reason = F.when(~F.coalesce("present", F.lit(False)), "ABSENT")
    if "scope" in theirs.columns:
        reason = reason.when(~F.coalesce(F.col("other_scope") == CONSOLIDATED, F.lit(False)), "SCOPE")
    if "period" in more:
        reason = reason.when(~F.col("period").eqNullSafe(F.col("other_period")), "PERIOD")
    if "currency" in more:
        reason = reason.when(~currency(F.col("currency")).eqNullSafe(currency(F.col("other_currency"))), "CURRENCY")
    reason = (
        reason.when(scale_of(F.col("other_unit")).isNull() | scale_of(F.col("unit")).isNull(), "UNIT")
        .when(F.col("value").isNull(), "OUR_VALUE")
        .when(F.col("other").isNull(), "NOT_A_NUMBER")
    )
    apart = F.abs(F.col("value") * scale_of(F.col("unit")) - F.col("other") * scale_of(F.col("other_unit")))
    agree = F.bround(apart, 2) <= F.lit(TOLERANCE).cast("decimal(4,2)")
    verdict = F.when(reason.isNotNull(), "INCOMPARABLE").when(agree, "AGREE").otherwise("DISAGREE")
    return both.select(*keys, verdict.alias("verdict"), reason.alias("reason"))


def comparison_summary(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """Counts for each group; a group is suspected if over a third of what is comparable disagrees."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    out = verdicts.groupBy(*by).agg(
        (n("AGREE") + n("DISAGREE")).alias("comparable"), n("INCOMPARABLE").alias("incomparable"), n("DISAGREE").alias("disagreements")
    )
    return out.withColumn("suspected", F.col("disagreements") * 3 > F.col("comparable"))
