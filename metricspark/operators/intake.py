"""What is read before metrics are computed: reports, references, units, row facts, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricspark.operators.checks import scale_of

#: What the title of an annual report holds, and what it must not hold.
REPORT, NO_REPORT = "年度报告", ("摘要", "英文", "已取消", "取消")
#: The unit and the currency of a sheet's header; the preparer isn't a unit.
UNIT, CURRENCY = r"(?U)(?<!编制)单位[:：]\s*(\S+?)(?=\s|币种|$)", r"(?U)币种[:：]\s*(\S+)"


def annual_reports(announcements: DataFrame) -> DataFrame:
    """(code, year, title, url): the first published annual report of each code and year asked for.

    announcements: code, year, title, time, url. Summaries, translations and cancelled
    reports don't count; of equal times the first url wins. A null title is no report.
    """
    title = F.col("title")
    report = title.contains(REPORT) & title.contains(F.col("year").cast("string"))
    for word in NO_REPORT:
        report = report & ~title.contains(word)
    first = F.min(F.struct(F.coalesce(F.col("time").cast("string"), F.lit("")).alias("time"), F.coalesce("url", F.lit("")).alias("url"), "title")).alias("r")
    return announcements.filter(report).groupBy("code", "year").agg(first).select("code", "year", "r.title", "r.url")


def references(payloads: DataFrame, mapping: tuple[tuple[str, str], ...]) -> DataFrame:
    """(key, field_id, present, raw) of payloads (key, row map<string,string>).

    Every entry of ``mapping`` (field, column) gives a row. A column that is there with a
    null differs from one that is not: only the first is present.
    """
    entries = F.explode(F.array(*(F.struct(F.lit(f).alias("field_id"), F.lit(c).alias("column")) for f, c in mapping)))
    rows = payloads.select("key", "row", entries.alias("e"))
    there = F.coalesce(F.array_contains(F.map_keys("row"), F.col("e.column")), F.lit(False))
    return rows.select("key", "e.field_id", there.alias("present"), F.when(there, F.try_element_at("row", F.col("e.column"))).alias("raw"))


def unit_header(text: Column) -> Column:
    """Struct (scale, currency, error) of a sheet's header; nothing is guessed.

    Errors: EMPTY, UNREADABLE (no unit or no currency), UNKNOWN_UNIT. With an error the
    other parts are null.
    """
    unit, currency = F.regexp_extract(text, UNIT, 1), F.regexp_extract(text, CURRENCY, 1)
    error = (
        F.when(text.isNull() | (F.trim(text) == ""), "EMPTY")
        .when((unit == "") | (currency == ""), "UNREADABLE")
        .when(scale_of(unit).isNull(), "UNKNOWN_UNIT")
    )
    return F.struct(F.when(error.isNull(), scale_of(unit)).alias("scale"), F.when(error.isNull(), currency).alias("currency"), error.alias("error"))


def batch_id(code: Column, year: Column, digest: Column) -> Column:
    """A batch's id from its code, year and the report's SHA-256; null if one of them isn't valid."""
    valid = (F.trim(code) != "") & year.isNotNull() & digest.rlike("^[0-9a-f]{64}$")
    return F.when(valid, F.substring(F.sha2(F.concat_ws(":", code, year.cast("string"), digest), 256), 1, 16))


def row_facts(docs: DataFrame, rows: DataFrame, fields: list[int]) -> DataFrame:
    """(doc, field, retrieval, state, amount) for every field of every document of ``docs``.

    rows: doc, field, amount. No row is ABSENT; more than one can't be decided; one is its
    amount, or 0 if its cell is empty.
    """
    found = rows.groupBy("doc", "field").agg(F.count(F.lit(1)).alias("n"), F.min("amount").alias("amount"))
    every = docs.select("doc", F.explode(F.array(*map(F.lit, fields))).alias("field"))
    one = F.col("n") == 1
    retrieval = F.when(F.col("n").isNull(), "ABSENT").when(one, "GOT_VALUE").otherwise("ATTEMPTED_UNKNOWN")
    state = F.when(F.col("n").isNull(), "ROW_ABSENT").when(one & F.col("amount").isNull(), "EMPTY_CELL").when(one, "VALUE_PRESENT")
    amount = F.when(one, F.coalesce("amount", F.lit(0).cast(rows.schema["amount"].dataType)))
    return every.join(found, ["doc", "field"], "left").select("doc", "field", retrieval.alias("retrieval"), state.alias("state"), amount.alias("amount"))


def verified(records: DataFrame, allowed: DataFrame, batches: DataFrame) -> DataFrame:
    """Records (batch, field, value) that ``allowed`` (batch, field, expected) lists.

    A batch is left out whole if a listed field is absent or has another value, or if its
    digest isn't the one that was checked; batches: batch, digest, checked_digest, where a
    null checked digest matches any.
    """
    same = F.col("checked_digest").isNull() | F.col("digest").eqNullSafe(F.col("checked_digest"))
    listed = allowed.join(records.withColumn("found", F.lit(True)), ["batch", "field"], "left")
    right = F.coalesce("found", F.lit(False)) & F.col("value").eqNullSafe(F.col("expected"))
    good = listed.groupBy("batch").agg(F.bool_and(right).alias("good")).filter("good").select("batch")
    sound = batches.filter(same).select("batch")
    return listed.select("batch", "field", "value").join(good, "batch", "left_semi").join(sound, "batch", "left_semi")


def pruned(payload: Column, columns: list[str]) -> Column:
    """Of a recorded row, a map, only the columns that are mapped, tell the source or are evidence."""
    return F.map_filter(payload, lambda k, _: k.isin(*columns))
