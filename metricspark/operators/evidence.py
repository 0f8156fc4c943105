"""Records, their coherence and provenance, and what evidence an answer must show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricspark.operators.expressions import ABSENT, EMPTY, UNKNOWN, VALUE

#: Texts that stand for nothing.
PLACEHOLDERS = ("unknown", "n/a", "na", "none", "null", "-", "待定", "未知", "无")


def blank(c: Column) -> Column:
    return F.trim(c.cast("string")) == ""


def placeholder(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string"))).isin(*PLACEHOLDERS)


def incoherent(records: DataFrame) -> DataFrame:
    """(key, problem) of records that contradict themselves.

    records: key, retrieval (GOT_VALUE, ABSENT, ATTEMPTED_UNKNOWN), state, value, status
    (SUCCESS, PARTIAL, REFUSED), stats (map<string,long>), kind, basis. Unknown has neither
    state nor value; a present value has one; an empty cell is 0; an absent row has none.
    PARTIAL, and nothing else, says what was cut off. Amounts need a basis, other kinds
    must have none.
    """
    r, s, v = F.col("retrieval"), F.col("state"), F.col("value")
    stats = F.coalesce(F.size("stats"), F.lit(0)) > 0
    amount = F.col("kind") == "AMOUNT"
    tests = [
        ("UNKNOWN_WITH_VALUE", (r == "ATTEMPTED_UNKNOWN") & (s.isNotNull() | v.isNotNull())),
        ("KNOWN_WITHOUT_STATE", (r != "ATTEMPTED_UNKNOWN") & s.isNull()),
        ("PRESENT_WITHOUT_VALUE", (s == VALUE) & ((r != "GOT_VALUE") | v.isNull())),
        ("EMPTY_NOT_ZERO", (s == EMPTY) & ((r != "GOT_VALUE") | ~F.coalesce(v == 0, F.lit(False)))),
        ("ABSENT_WITH_VALUE", (s == ABSENT) & ((r != "ABSENT") | v.isNotNull())),
        ("PARTIAL_WITHOUT_STATS", (F.col("status") == "PARTIAL") & ~stats),
        ("STATS_WITHOUT_PARTIAL", (F.col("status") != "PARTIAL") & stats),
        ("BASIS_MISSING", amount & F.col("basis").isNull()),
        ("BASIS_FORBIDDEN", ~amount & F.col("basis").isNotNull()),
    ]
    found = F.filter(F.array(*(F.when(t, n) for n, t in tests)), lambda x: x.isNotNull())
    return records.select("key", F.explode(found).alias("problem"))


def truncation(records: DataFrame) -> DataFrame:
    """(key, problem) on what records read back say of truncation: counts that are all zero tell nothing."""
    stats = F.col("stats")
    some = F.size(stats) > 0
    problem = (
        F.when(F.col("status").isNull() | stats.isNull(), "NO_STATUS")
        .when((F.col("status") == "SUCCESS") & some, "SUCCESS_WITH_STATS")
        .when((F.col("status") == "PARTIAL") & ~some, "PARTIAL_WITHOUT_STATS")
        .when((F.col("status") == "PARTIAL") & ~F.exists(F.map_values(stats), lambda n: n > 0), "PARTIAL_OF_ZERO")
    )
    return records.select("key", problem.alias("problem")).filter("problem IS NOT NULL")


#: Keys of a record's evidence by kind, and how each is judged.
TEXT_KEYS, COUNT_KEYS = ("source_url", "batch_id", "column_header"), ("page", "mapping_version")
KEYS_OF_KIND = {"AMOUNT": ("source_url", "batch_id", "column_header", "page", "mapping_version", "freshness"), "NOTE": ("source_url", "batch_id", "page", "freshness")}


def gaps(records: DataFrame) -> DataFrame:
    """(key, filled, total, rate, gaps) of records: evidence that is there, and what is wrong with the rest.

    A text may be neither null, blank nor a placeholder, a count is 1 at least, and UNKNOWN
    freshness says nothing. Which keys count depends on the kind; a kind without keys has rate 0.
    """

    def wrong(k: str) -> Column:
        c = F.col(k)
        if k in COUNT_KEYS:
            return F.when(c.isNull(), "null").when(c < 1, "not_positive")
        why = F.when(c.isNull(), "null").when(blank(c), "blank")
        return why.when(c == UNKNOWN, "unknown") if k == "freshness" else why.when(placeholder(c), "placeholder")

    total, found = F.lit(0), F.array().cast("array<string>")
    for kind, keys in KEYS_OF_KIND.items():
        own = F.filter(F.array(*(F.when(wrong(k).isNotNull(), F.concat(F.lit(f"{k}:"), wrong(k))) for k in keys)), lambda x: x.isNotNull())
        total = F.when(F.col("kind") == kind, len(keys)).otherwise(total)
        found = F.when(F.col("kind") == kind, own).otherwise(found)
    rows = records.select("key", total.alias("total"), found.alias("found"))
    filled = F.col("total") - F.size("found")
    rate = F.round(F.coalesce(F.try_divide(filled, F.col("total")), F.lit(0.0)), 6)
    return rows.select("key", filled.alias("filled"), "total", rate.alias("rate"), F.array_join("found", ",").alias("gaps"))


def answer_gaps(answers: DataFrame) -> DataFrame:
    """(key, gaps) of answers (metric_id, metric_version, data_source, execution_hash).

    All three keys need a value that is no placeholder and not zero; where no metric was
    found the version doesn't apply and must be absent.
    """
    none = F.col("metric_id").isNull()

    def wrong(k: str) -> Column:
        c = F.col(k)
        return F.when(c.isNull(), f"{k}:null").when(blank(c), f"{k}:blank").when(placeholder(c), f"{k}:placeholder").when(c.cast("string") == "0", f"{k}:zero")

    version = F.when(none, F.when(F.col("metric_version").isNotNull(), "metric_version:not_applicable")).otherwise(wrong("metric_version"))
    found = F.filter(F.array(version, wrong("data_source"), wrong("execution_hash")), lambda x: x.isNotNull())
    return answers.select("key", F.array_join(found, ",").alias("gaps"))


def execution_hash(answers: DataFrame) -> DataFrame:
    """answers with ``execution_hash``: the digest of what was asked, of the inputs in their order and of the outcome.

    A refusal has one of its own form, over the question, the metric, the code and the source.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
    joined = lambda *cs: F.sha2(F.concat_ws("\u0001", *cs), 256)
    inputs = F.array_join(F.transform("inputs", lambda i: F.concat_ws("=", i["field_id"], F.coalesce(i["shown"], F.lit("\u0000")))), "\u0002")
    own = joined(F.lit("value"), text("question"), text("metric_id"), text("version"), text("entity"), text("period"), inputs)
    refused = joined(F.lit("refusal"), text("question"), text("metric_id"), text("refusal_code"), text("data_source"))
    return answers.withColumn("execution_hash", F.when(F.col("refusal_code").isNull(), own).otherwise(refused))


#: How no record, an empty text and truth are shown.
MISSING_SHOWN, EMPTY_SHOWN, YES, NO = "（缺失：数据源里没有这一行）", "（空值）", "是", "否"


def shown(value: Column, kind: Column) -> Column:
    """A value as text; a missing one, an empty one and zero look different. kind: boolean or else."""
    truth = F.when(value == "true", YES).otherwise(NO)
    return F.when(value.isNull(), MISSING_SHOWN).when(kind == "boolean", truth).when(F.trim(value) == "", EMPTY_SHOWN).otherwise(value)


def numeric(raw: Column) -> Column:
    """(value, kept): the text as a decimal, or the text itself where it is none."""
    value = F.replace(raw, F.lit(","), F.lit("")).try_cast("decimal(38,10)")
    return F.struct(value.alias("value"), F.when(value.isNull(), raw).alias("kept"))


def normalised(raw: Column, there: Column, representation: Column, same_type: Column) -> Column:
    """The raw value, null where it is missing: no key, or what the definition says missing looks like.

    A value of another type than the representation's isn't missing, though it looks the
    same; null is missing where the representation is null.
    """
    missing = ~there | (representation.isNull() & raw.isNull()) | (same_type & F.coalesce(raw == representation, F.lit(False)))
    return F.when(~missing, raw)


def plain_name(name: Column) -> Column:
    """A full name without full-width brackets at its end."""
    return F.regexp_replace(name, "（[^（）]*）$", "")


def nature(kind: Column, digest: Column) -> Column:
    """real only for rows marked real that carry a digest of 64 hexadecimal digits."""
    return F.when((kind == "real") & F.coalesce(F.regexp_like(digest, F.lit("^[0-9a-f]{64}$")), F.lit(False)), "real").otherwise("synthetic")


def merged_names(names: DataFrame) -> DataFrame:
    """(name, code, nature): names with one code; synthetic if any source says so. names: name, code, nature."""
    out = names.groupBy("name").agg(F.min("code").alias("code"), F.max("code").alias("last"), F.max("nature").alias("nature"))
    return out.filter(F.col("code") == F.col("last")).drop("last")


def sourced(asked: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """asked with the columns of the first source that holds the row, and ``source`` EMPTY where none does.

    No other source stands in for a row that isn't there.
    """
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*(c for c in rows.columns if c not in keys)), F.col(order)).alias("r"))
    both = asked.join(first, keys, "left")
    return both.select(*asked.columns, "r.*").withColumn("source", F.coalesce(F.col(order).cast("string"), F.lit("EMPTY")))


def coverage(rows: DataFrame) -> DataFrame:
    """(nature, entities, periods, fixtures): what the sources cover; rows: nature, fixture, code, year."""
    n = F.count_distinct
    return rows.groupBy("nature").agg(n("code").alias("entities"), n("code", "year").alias("periods"), n("fixture").alias("fixtures"))


def set_digest(items: DataFrame, column: str) -> DataFrame:
    """(n, sha256): how many distinct values there are, and the digest of their set, whatever the order and partitions.

    Values are dealt over 65536 parts by their own digests. A part's digest is that of its
    sorted values' digests, 256 parts' digests make one of the next level, and 256 of those
    the last: no row holds more than a part. No values have the digest of no text.
    """
    digest = F.sha2(F.col(column).cast("string"), 256)
    rows = items.filter(F.col(column).isNotNull()).select(digest.alias("d")).distinct()
    level = rows.groupBy(F.left("d", F.lit(4)).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("d")), "").alias("all"))
    level = level.select("part", "n", F.sha2("all", 256).alias("d"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: x["d"]), "")
    level = level.groupBy(F.left("part", F.lit(2)).alias("up")).agg(F.sum("n").alias("n"), listed.alias("all")).select(F.col("up").alias("part"), "n", F.sha2("all", 256).alias("d"))
    return level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.coalesce(listed, F.lit("")), 256).alias("sha256"))


def entities(names: DataFrame) -> DataFrame:
    """One row: how many companies and names are known, how many of them synthetic, and the digest of the set of names."""
    code = lambda t: F.count_distinct(F.when(t, F.col("code")))
    out = names.agg(code(F.lit(True)).alias("entities"), code(F.col("nature") == "synthetic").alias("synthetic"))
    told = set_digest(names, "name").select(F.col("n").alias("name_count"), "sha256")
    return out.crossJoin(told).select("entities", "name_count", "synthetic", "sha256")  # a row of each


def with_derived(record: Column, there: Column, derived: Column) -> Column:
    """A record's value, or the derived one only where there is no record at all; a null record stays null."""
    return F.when(there, record).otherwise(derived)


def stamped(facts: DataFrame, batch_id: Column, url: Column, version: Column) -> DataFrame:
    """facts with a ``provenance`` struct; the one place where it is made."""
    return facts.withColumn("provenance", F.struct(batch_id.alias("batch_id"), url.alias("source_url"), version.alias("mapping_version"), F.col("page")))
