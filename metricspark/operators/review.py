"""Judged answers, their rates, reviewers' votes and counts over definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Agreement from which a review passes or passes in part; most that may be undecidable.
PASS, PARTIAL, UNDECIDABLE = 0.80, 0.60, 0.20
#: The votes of a reviewer.
RIGHT, WRONG, CANNOT = "对", "错", "无法判断"


def ratio(n: Column, of: Column) -> Column:
    """n over a count, to six places; null where there is nothing to count."""
    return F.round(F.try_divide(n.cast("double"), of.cast("double")), 6)


def pitfall_statistics(pitfalls: DataFrame) -> DataFrame:
    """Counts of pitfalls (metric_id, enforced_by, advisory) for each metric and for all.

    An advisory pitfall isn't enforced, whatever it names; one that is neither counts as
    unclassified and not as advisory. Partial sums meet before the shuffle.
    """
    advisory = F.coalesce("advisory", F.lit(False))
    named = F.trim(F.coalesce("enforced_by", F.lit(""))) != ""
    out = pitfalls.rollup("metric_id").agg(
        F.grouping("metric_id").cast("boolean").alias("overall"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(named & ~advisory).alias("enforced"),
        F.count_if(advisory).alias("advisory"),
        F.count_if(~named & ~advisory).alias("unclassified"),
    )
    return out.withColumn("advisory_ratio", F.coalesce(ratio(F.col("advisory"), F.col("total")), F.lit(0.0)))


def judged(cases: DataFrame) -> DataFrame:
    """cases with ``status`` (PASS or FAIL) and ``kind``, the first fault in order.

    cases: refused, value, metric_id, version; want, want_scalar, want_metric,
    want_version, abs_tol, rel_tol. A null tolerance is 0; a null wanted metric or version
    matches any.
    """
    c = F.col
    apart = F.abs(c("value") - c("want"))
    none = F.lit(0).cast("decimal(18,6)")
    near = (apart <= F.coalesce("abs_tol", none)) | ((c("want") != 0) & (apart <= F.coalesce("rel_tol", none) * F.abs("want")))
    kind = (
        F.when(F.coalesce("refused", F.lit(False)), "REFUSED_BUT_SHOULD_ANSWER")
        .when(c("value").isNull(), "NO_VALUE_NO_REFUSAL")
        .when(~F.coalesce("want_scalar", F.lit(True)), "EXPECTED_NON_SCALAR")
        .when(~F.coalesce(near, F.lit(False)), "VALUE_OUT_OF_TOLERANCE")
        .when(c("want_metric").isNotNull() & ~c("metric_id").eqNullSafe(c("want_metric")), "WRONG_METRIC")
        .when(c("want_version").isNotNull() & ~c("version").eqNullSafe(c("want_version")), "WRONG_VERSION")
    )
    return cases.withColumn("kind", kind).withColumn("status", F.when(F.col("kind").isNull(), "PASS").otherwise("FAIL"))


def rates(cases: DataFrame) -> DataFrame:
    """(rate_name, hits, total, rate) of judged cases with ``layers`` and ``gaps`` (arrays).

    Each rate has its own denominator: answers count cases with a wanted value, definitions
    those with a wanted metric, attribution the failed ones, evidence all. Without cases to
    count the rate is null, neither 0 nor 1.
    """
    c = F.col
    same = c("metric_id").eqNullSafe(c("want_metric")) & c("version").eqNullSafe(c("want_version"))
    failed = c("status") == "FAIL"
    parts = {
        "answers": (c("want").isNotNull(), c("status") == "PASS"),
        "definitions": (c("want_metric").isNotNull(), same),
        "attribution": (failed, F.size("layers") > 0),
        "evidence": (F.lit(True), F.size("gaps") <= 0),
    }
    sums = cases.agg(F.array(*(F.struct(F.lit(k).alias("rate_name"), F.count_if(of & hit).alias("hits"), F.count_if(of).alias("total")) for k, (of, hit) in parts.items())).alias("r"))
    rows = sums.select(F.explode("r").alias("r")).select("r.*")
    return rows.withColumn("rate", ratio(F.col("hits"), F.col("total")))


def review_score(votes: DataFrame) -> DataFrame:
    """One row over votes (status, vote): agreement, what couldn't be judged, the wrong ones, the gate.

    A vote that can't judge agrees with nothing but counts as a vote; without votes both
    rates are 0.
    """
    c = F.col
    wrong = c("status") == "FAIL"
    agreed = F.coalesce(c("vote") == F.when(c("status") == "PASS", RIGHT).otherwise(WRONG), F.lit(False))
    out = votes.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(agreed).alias("agreed"), F.count_if(c("vote") == CANNOT).alias("undecidable"),
        F.count_if(wrong).alias("wrong"), F.count_if(wrong & agreed).alias("wrong_agreed"),
    )
    for name in ("agreed", "undecidable"):
        out = out.withColumn(f"{name}_rate", F.coalesce(ratio(c(name), c("n")), F.lit(0.0)))
    gate = F.when(c("agreed_rate") >= PASS, "PASS").when(c("agreed_rate") >= PARTIAL, "PARTIAL").otherwise("FAIL")
    return out.withColumn("gate", gate).withColumn("within_limit", c("undecidable_rate") <= UNDECIDABLE)


def comparable(pairs: DataFrame) -> DataFrame:
    """pairs with ``code`` and ``basis``: why two versions of a definition can't be compared, or nulls.

    pairs: version_a, version_b and basis_a, basis_b (arrays of name, version). Another
    version comes before another version of a standard that both name; the first such
    standard of the first definition is given.
    """
    c = F.col
    theirs = lambda x: F.try_element_at(F.filter("basis_b", lambda y: y["name"] == x["name"]), F.lit(-1))
    apart = F.filter("basis_a", lambda x: theirs(x).isNotNull() & ~theirs(x)["version"].eqNullSafe(x["version"]))
    first = F.try_element_at(apart, F.lit(1))["name"]
    other = ~c("version_a").eqNullSafe(c("version_b"))
    code = F.when(other, "CROSS_VERSION_COMPARISON").when(first.isNotNull(), "CROSS_BASIS_VERSION_COMPARISON")
    return pairs.withColumn("code", code).withColumn("basis", F.when(~other, first))
