"""Whole reports: from words on pages to the records of three statements and two notes, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricspark import storage
from metricspark.operators import pages

#: The section of the statements and the one after it, the statements that are read, the sections of the
#: notes that are, the items of the first and the mark that the second is looked through for.
SECTION, AFTER = "财务报表", "公司基本情况"
STATEMENTS = ("合并资产负债表", "合并利润表", "合并现金流量表")
SCOPE, KEY_DATA = "合并范围的变更", "近三年主要会计数据和财务指标"
ITEMS = ("非同一控制下企业合并", "同一控制下企业合并")
ADJUSTED = ("调整后",)


def inside(anchors: DataFrame, sections: DataFrame) -> DataFrame:
    """Anchors of statements in their section, if a document has exactly one; else all: a title that a note names is no statement.

    anchors, sections: doc, page, y, title. The section ends where the next section anchor stands.
    """
    ends = pages.spans(sections).filter(F.col("title") == SECTION).groupBy("doc").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("page", "y")).alias("a"), F.min(F.struct(F.col("next_page").alias("page"), F.col("next_y").alias("y"))).alias("b")
    )
    at = F.struct("page", "y")
    rows = anchors.join(ends, "doc", "left")
    kept = (F.coalesce(F.col("n"), F.lit(0)) != 1) | ((at > F.col("a")) & (F.col("b.page").isNull() | (at < F.col("b"))))
    return rows.filter(kept).select(anchors.columns)


def sheets(line_rows: DataFrame, anchors: DataFrame, reports: DataFrame, parts: int) -> DataFrame:
    """(doc, title, anchor_page, anchor_y, next_page, next_y, page, y, unit, currency, columns, problem): each statement of each report (doc, year).

    anchors: see ``pages.spans``. There must be exactly one, and a header that can be read below it, see
    ``pages.headers``. Rows are dealt into ``parts`` partitions.
    """
    place = F.struct("page", "y", "next_page", "next_y")
    found = anchors.groupBy("doc", "title").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at"))
    every = reports.select("doc", "year", F.explode(F.array(*map(F.lit, STATEMENTS))).alias("title")).repartition(parts, "doc", "title").join(found, ["doc", "title"], "left")
    every = every.select("doc", "year", "title", "n", F.col("at.page").alias("anchor_page"), F.col("at.y").alias("anchor_y"), "at.next_page", "at.next_y")
    one = every.filter("n = 1").select("doc", "year", "title", F.col("anchor_page").alias("page"), F.col("anchor_y").alias("y"))
    heads = pages.headers(line_rows.repartition(parts, "doc", "page"), one, keep=("title",)).select("doc", "title", "y", "unit", "currency", "columns", F.col("problem").alias("why"))
    out = every.join(heads, ["doc", "title"], "left")
    problem = F.when(F.coalesce(F.col("n"), F.lit(0)) == 0, "no_title").when(F.col("n") > 1, "several_titles").otherwise(F.col("why"))
    return out.select("doc", "year", "title", "anchor_page", "anchor_y", "next_page", "next_y", F.col("anchor_page").alias("page"), "y", "unit", "currency", "columns", problem.alias("problem"))


def sheet_rows(line_rows: DataFrame, readable: DataFrame) -> DataFrame:
    """(doc, title, page, y, labels, cells, columns, header_inherited): the rows of readable sheets over all their pages.

    A row's columns are those of the last header before it in the document. A page that
    repeats the header has its own; one that doesn't inherits it, and the row says so.
    Headers themselves, running heads and lines on units are no rows. Lines and sheets meet by
    document only, so all the rest is done where they met.
    """
    end = F.when(F.col("next_page").isNotNull(), F.struct(F.col("next_page").alias("page"), F.col("next_y").alias("y")))
    own = readable.select("doc", "title", "year", F.col("page").alias("head_page"), F.col("y").alias("head_y"), F.col("columns").alias("first"), end.alias("end"))
    rows = line_rows.join(own, "doc").filter(F.col("end").isNull() | (F.struct("page", "y") < F.col("end"))).drop("end")
    at = F.struct("page", "y")
    rows = rows.filter((at > F.struct(F.col("head_page").alias("page"), F.col("head_y").alias("y"))) & ~pages.furniture(F.col("text")))
    repeated = F.exists("words", lambda w: w["text"] == pages.HEADER)
    upto = Window.partitionBy("doc", "title").orderBy("page", "y", "line").rowsBetween(Window.unboundedPreceding, 0)
    columns = pages.columns(F.col("words"), F.col("year"))
    last = F.last(F.when(repeated, F.struct("page", columns.alias("columns"))), ignorenulls=True).over(upto)
    rows = rows.withColumn("repeated", repeated).withColumn("head", F.coalesce(last, F.struct(F.col("head_page").alias("page"), F.col("first").alias("columns"))))
    rows = rows.filter(~F.col("repeated")).withColumn("columns", F.col("head.columns")).withColumn("inherited", F.col("page") != F.col("head.page"))
    parts = pages.split(rows, F.array_min(F.transform("columns", lambda c: c["x0"])))
    return pages.stitched(parts, ["page", "y", "line"], ["doc", "title"], ["columns", "inherited"]).withColumnRenamed("inherited", "header_inherited")


def line_records(rows: DataFrame, sheets: DataFrame, mapping: DataFrame, parts: int) -> DataFrame:
    """Records of all mapped fields (field_id, title, role, variants) of readable sheets; amounts are as printed, in the sheet's unit.

    No row with a field's labels is ABSENT, several can't be decided, and neither can a cell in a column
    of which there are two; a row without an amount in its column is an empty cell, 0. The
    mapping goes to all tasks: by its labels all rows of one label would be one task's.
    """
    wanted = mapping.select("field_id", "title", "role")
    variants = mapping.select("field_id", "title", "role", F.explode("variants").alias("labels"))
    hits = rows.join(F.broadcast(variants), ["title", "labels"])
    own = F.filter("columns", lambda c: c["role"] == F.col("role"))
    column = F.get(own, F.lit(0))
    over = F.transform("cells", lambda c: F.struct((F.least(c["x1"], column["x1"]) - F.greatest(c["x0"], column["x0"])).alias("over"), (-c["x0"]).alias("first"), c["text"].alias("text")))
    cell = F.array_max(F.filter(over, lambda c: c["over"] > 0))["text"]
    hits = hits.select("doc", "title", "field_id", "page", "header_inherited", F.size(own).alias("alike"), column["header"].alias("header"), pages.amount(cell).alias("amount"))
    found = hits.groupBy("doc", "title", "field_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page", "header_inherited", "alike", "header", "amount")).alias("x"))
    every = sheets.filter("problem IS NULL").select("doc", "title", "unit", "currency", "anchor_page").join(F.broadcast(wanted), "title")
    every = every.repartition(parts, "doc", "title", "field_id").join(found, ["doc", "title", "field_id"], "left")
    clear = (F.col("n") == 1) & (F.col("x.alike") == 1)
    retrieval = F.when(F.col("n").isNull(), "ABSENT").when(clear, "GOT_VALUE").otherwise("ATTEMPTED_UNKNOWN")
    state = F.when(F.col("n").isNull(), "ROW_ABSENT").when(clear & F.col("x.amount").isNull(), "EMPTY_CELL").when(clear, "VALUE_PRESENT")
    amount = F.when(clear, F.coalesce("x.amount", F.lit(0).cast("decimal(28,6)")))
    place = lambda c: F.when(clear, F.col(f"x.{c}")).alias(c)
    return every.select("doc", F.col("title").alias("step"), "field_id", retrieval.alias("retrieval"), state.alias("state"), amount.alias("amount"), "unit", "currency", "anchor_page", place("page"), place("header"), place("header_inherited"))


def extracted(words: DataFrame, reports: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, refused): all that is read of reports (doc, year) from their words, see ``pages.lines``, and those of which a statement can't be read, as (doc, code, title, problem).

    A report is refused whole. Five steps make one table of records: three statements, the
    change of scope and the restatement, which have a truth value (and types) instead of an
    amount and are unknown where their section can't be read. Disclosed key figures aren't read.
    Lines, titles and sheets are written once, as every step reads them. Everything is dealt by
    document into as many partitions as the number of lines asks for, see ``storage.parts``.
    """
    lines = storage.kept(pages.lines(words), "lines")
    parts = storage.parts(lines)
    by_doc = lambda rows: rows.repartition(parts, "doc")
    titles = pages.statement_anchors(lines.select("doc", "page", F.explode("words").alias("w")).select("doc", "page", "w.*")).select("doc", "page", "y", "title")
    titles = by_doc(storage.kept(titles, "lines"))
    sections = by_doc(storage.kept(pages.section_anchors(lines, [SECTION, AFTER, SCOPE, KEY_DATA]), "lines"))
    anchors = pages.spans(inside(titles, sections.filter(F.col("title").isin(SECTION, AFTER)).select("doc", "page", "y", "title")))
    found = storage.kept(sheets(lines, anchors, reports, parts), "sheets")
    refused = found.filter("problem IS NOT NULL").select("doc", F.lit("UNAVAILABLE").alias("code"), "title", "problem")
    bad = F.bool_or(F.col("problem").isNotNull()).over(Window.partitionBy("doc"))
    sound = by_doc(found).withColumn("bad", bad).filter("NOT bad").drop("bad")
    kept = sound.filter(F.col("title") == STATEMENTS[0]).select("doc")
    records = line_records(sheet_rows(by_doc(lines), sound), sound, mapping, parts)
    boxes = pages.applicability(pages.within(by_doc(lines.drop("words")), pages.spans(sections).filter(F.col("title") == SCOPE)), list(ITEMS))
    scope = kept.join(pages.scope_change(boxes, ITEMS), "doc", "left").select("doc", F.lit(SCOPE).alias("step"), F.lit("notes.consolidation_scope_change").alias("field_id"), F.col("changed").alias("flag"), "types")
    again = pages.restated(lines, sections, KEY_DATA, ADJUSTED)
    restated = kept.join(again, "doc", "left").select("doc", F.lit(KEY_DATA).alias("step"), F.lit("notes.restatement_flag").alias("field_id"), F.col("restated").alias("flag"), F.array_min("pages").alias("page"))
    notes = scope.unionByName(restated, allowMissingColumns=True).withColumn("retrieval", F.when(F.col("flag").isNull(), "ATTEMPTED_UNKNOWN").otherwise("GOT_VALUE"))
    notes = notes.withColumn("state", F.when(F.col("flag").isNotNull(), "VALUE_PRESENT"))
    return records.unionByName(notes, allowMissingColumns=True), refused
