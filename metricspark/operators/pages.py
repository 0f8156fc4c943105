"""From words on pages to statements: lines, anchors, sheet headers, rows, readings of notes.

Words are (doc, page, x0, x1, top, text); lines (doc, page, line, y, text, words). What
can't be read is a reason in a column, never an exception.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricspark.operators.numbers import visible

#: Titles of statements, marks of headers and boxes, forms of dates, numerals and page furniture.
TITLES = ("合并资产负债表", "母公司资产负债表", "合并利润表", "母公司利润表", "合并现金流量表", "母公司现金流量表", "合并所有者权益变动表", "母公司所有者权益变动表")
KEYS = ("资产负债表", "利润表", "现金流量表", "权益变动表")
HEADER = "项目"
ROLES = {"期末余额": "期末余额", "期初余额": "期初余额", "上年年末余额": "期初余额"}
DATE = r"^(\d{4})年\d{1,2}月\d{1,2}日$"
PERIOD = r"^(\d{4})年度$"
NUMERAL = r"^([一二三四五六七八九十百]+、)"
ITEM_NUMERAL = r"^(\d+\s*[、.．]\s*)"
APPLIES, NOT_APPLIES = "√适用□不适用", "□适用√不适用"
RUNNING_HEAD, FOOTER = r"^\d{4}年年度报告$", r"^\d+\s*/\s*\d+$"
META = ("编制单位", "单位:", "单位：", "币种")
AMOUNT = r"^-?[\d,]+\.\d{2}$"
#: Lines below an anchor in which its header is looked for; titles shown that nearly match.
SEARCHED, SHOWN = 12, 6


def lines(words: DataFrame, gap: float = 3.0, between: str = "") -> DataFrame:
    """(doc, page, line, y, text, words): a word begins a line when it lies more than ``gap`` below the line's first word.

    The place of a line's first word decides, so no window expresses it; a page's sorted
    words are one array that an aggregate walks. A page's words are bounded. y is the
    place of the leftmost word. Where the words of a page are together already, ``words``
    may be (doc, page, w), a row for each page with its words (top, x0, x1, text) in an
    array; then nothing is shuffled.
    """
    word = F.struct("top", "x0", "x1", "text")
    pages = words if "w" in words.columns else words.groupBy("doc", "page").agg(F.collect_list(word).alias("w"))
    # No element is null, so this is array_sort without its comparator, which is slow.
    pages = pages.select("doc", "page", F.sort_array("w").alias("w"))
    walk = f"""aggregate(w, named_struct('first', CAST(NULL AS DOUBLE), 'n', 0, 'starts', CAST(array() AS ARRAY<INT>)),
      (a, x) -> IF(a.first IS NULL OR x.top - a.first > {gap},
        named_struct('first', x.top, 'n', a.n + 1, 'starts', array_append(a.starts, a.n)),
        named_struct('first', a.first, 'n', a.n + 1, 'starts', a.starts))).starts"""
    cut = "transform(starts, (s, i) -> slice(w, s + 1, coalesce(get(starts, i + 1), size(w)) - s))"
    rows = pages.selectExpr("doc", "page", "w", f"{walk} AS starts").selectExpr("doc", "page", f"posexplode({cut}) AS (line, own)")
    rows = rows.selectExpr("doc", "page", "CAST(line AS BIGINT) AS line", "sort_array(transform(own, w -> named_struct('x0', w.x0, 'text', w.text, 'x1', w.x1, 'top', w.top))) AS words")
    text = F.array_join(F.transform("words", lambda w: w["text"]), between)
    return rows.select("doc", "page", "line", F.get("words", F.lit(0))["top"].alias("y"), text.alias("text"), "words")


def statement_anchors(words: DataFrame) -> DataFrame:
    """(doc, page, y, title, consolidated): words that are a statement's title, invisible characters aside."""
    title = visible(F.col("text"))
    return words.filter(title.isin(*TITLES)).select("doc", "page", F.col("top").alias("y"), title.alias("title"), F.startswith(title, F.lit("合并")).alias("consolidated"))


def near_titles(words: DataFrame) -> DataFrame:
    """(doc, nth, title): the first SHOWN distinct words that nearly are titles, for people to read only."""
    title = visible(F.col("text"))
    rows = words.filter(title.rlike("|".join(KEYS)) & ~title.isin(*TITLES) & (F.length(title) <= 40))
    first = rows.groupBy("doc", title.alias("title")).agg(F.min(F.struct("page", "top", "x0")).alias("at"))
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("at", "title"))
    return first.select("doc", nth.alias("nth"), "title").filter(F.col("nth") <= SHOWN)


def section_anchors(line_rows: DataFrame, titles: list[str]) -> DataFrame:
    """(doc, page, y, title, prefix): lines that are a title, with or without a numeral before it."""
    text = visible(F.col("text"))
    # One look at each line; only those that pass are taken apart.
    line_rows = line_rows.filter(text.rlike(f"^(?:{NUMERAL[1:]})?(?:{'|'.join(map(re.escape, titles))})\\z"))
    prefix = F.when(text.isin(*titles), "").otherwise(F.regexp_extract(text, NUMERAL, 1))
    title = F.substring(text, F.length(prefix) + 1, F.length(text))
    return line_rows.filter(title.isin(*titles)).select("doc", "page", "y", title.alias("title"), prefix.alias("prefix"))


def single(anchors: DataFrame, docs: DataFrame, title: str) -> DataFrame:
    """(doc, page, y, code): the one anchor of a title, UNAVAILABLE where there are none or several."""
    found = anchors.filter(F.col("title") == title).groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page", "y")).alias("at"))
    rows = docs.select("doc").join(found, "doc", "left")
    one = F.coalesce(F.col("n"), F.lit(0)) == 1
    return rows.select("doc", F.when(one, F.col("at.page")).alias("page"), F.when(one, F.col("at.y")).alias("y"), F.when(~one, "UNAVAILABLE").alias("code"))


def spans(anchors: DataFrame) -> DataFrame:
    """Anchors with the place of the next one after them; anchors at one place have the same."""
    at = F.struct("page", "y")
    rows = anchors.filter("doc IS NOT NULL").withColumn("at", at).withColumn("nth", F.dense_rank().over(Window.partitionBy("doc").orderBy("at")))
    after = F.first("at").over(Window.partitionBy("doc").orderBy("nth").rangeBetween(1, 1))
    return rows.withColumn("next", after).select(*anchors.columns, F.col("next.page").alias("next_page"), F.col("next.y").alias("next_y"))


def within(line_rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Lines strictly after an anchor and before the next one, with the anchor's title."""
    own = spans.select("doc", "title", F.struct("page", "y").alias("a"), F.when(F.col("next_page").isNotNull(), F.struct(F.col("next_page").alias("page"), F.col("next_y").alias("y"))).alias("b"))
    at = F.struct("page", "y")
    both = line_rows.join(own, "doc").filter((at > F.col("a")) & (F.col("b").isNull() | (at < F.col("b"))))
    return both.drop("a", "b")


def furniture(text: Column) -> Column:
    """Running heads, page numbers and lines on units: no data."""
    return text.rlike(f"{RUNNING_HEAD}|{FOOTER}|^(?:{'|'.join(META)})")


def role_of(header: Column, year: Column) -> Column:
    """The role of a printed column header in a fiscal year; null if it is another year's or unknown."""
    date, period = F.regexp_extract(header, DATE, 1), F.regexp_extract(header, PERIOD, 1)
    out = F.lit(None).cast("string")
    for text, role in ROLES.items():
        out = F.when(header == text, role).otherwise(out)
    year, before = year.cast("string"), (year - 1).cast("string")
    out = F.when(date == year, "期末余额").when((date == before), "期初余额").otherwise(out)
    return F.when(period == year, "本期金额").when(period == before, "上期金额").otherwise(out)


def columns(words: Column, year: Column) -> Column:
    """The columns (header, role, x0, x1) of a header line's words."""
    return F.transform(
        F.filter(words, lambda w: w["text"] != HEADER),
        lambda w: F.struct(w["text"].alias("header"), role_of(w["text"], year).alias("role"), w["x0"].alias("x0"), w["x1"].alias("x1")),
    )


def headers(line_rows: DataFrame, anchors: DataFrame, year: str = "year", keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, doc, page, y, unit, currency, columns, label_max_x, problem) of the sheet below each anchor (*keep, doc, page, y, ``year``).

    The header is the first of SEARCHED lines with a word HEADER; its other words are the
    columns (header, role, x0, x1). Without it, or without unit and currency, or with
    two columns of one role there is a problem and nothing is guessed.
    """
    own = anchors.select("doc", "page", F.col("y").alias("anchor_y"), F.col(year).alias("year"), *keep).distinct()
    rows = line_rows.select(F.col("doc").alias("of"), F.col("page").alias("on"), "y", "line", "text", "words")
    below = own.join(rows, (F.col("doc") == F.col("of")) & (F.col("page") == F.col("on")) & (F.col("y") > F.col("anchor_y")), "left")
    nth = F.row_number().over(Window.partitionBy("doc", "page", "anchor_y", *keep).orderBy("y", "line"))
    below = below.withColumn("nth", nth).filter(F.col("nth") <= SEARCHED)
    marked = F.exists("words", lambda w: w["text"] == HEADER)
    unit = F.nullif(F.regexp_extract("text", r"(?<!编制)单位[:：]\s*([^\s币]+)", 1), F.lit(""))
    currency = F.nullif(F.regexp_extract("text", r"币种[:：]\s*(\S+)", 1), F.lit(""))
    head = F.min_by(F.when(marked, F.struct("y", "words")), F.when(marked, F.col("nth")))
    found = below.groupBy("doc", "page", "anchor_y", "year", *keep).agg(
        head.alias("h"), F.min_by(unit, F.when(unit.isNotNull(), F.col("nth"))).alias("unit"), F.min_by(currency, F.when(currency.isNotNull(), F.col("nth"))).alias("currency")
    )
    found = found.withColumn("columns", columns(F.col("h.words"), F.col("year")))
    roles = F.filter(F.transform("columns", lambda c: c["role"]), lambda r: r.isNotNull())
    problem = (
        F.when(F.col("h").isNull(), "no_header")
        .when(F.col("unit").isNull() | F.col("currency").isNull(), "no_unit")
        .when(F.size(roles) != F.size(F.array_distinct(roles)), "ambiguous_role")
    )
    left = F.array_min(F.transform("columns", lambda c: c["x0"]))
    return found.select(*keep, "doc", "page", F.col("h.y").alias("y"), "anchor_y", "unit", "currency", "columns", left.alias("label_max_x"), problem.alias("problem"))


def split(line_rows: DataFrame, label_max_x: Column) -> DataFrame:
    """Lines with their label, the words left of the columns, and their cells, the amounts right of them."""
    label = F.array_join(F.transform(F.filter("words", lambda w: w["x1"] <= label_max_x), lambda w: w["text"]), "")
    amounts = F.filter("words", lambda w: (w["x1"] > label_max_x) & F.regexp_like(w["text"], F.lit(AMOUNT)))
    cells = F.transform(amounts, lambda w: F.struct(w["x0"].alias("x0"), w["x1"].alias("x1"), w["text"].alias("text")))
    rows = line_rows.withColumn("label", label).withColumn("cells", cells)
    return rows.filter((F.col("label") != "") | (F.size("cells") > 0))


def stitched(rows: DataFrame, order: list[str], within: tuple[str, ...] | list[str] = ("doc",), keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(*within, page, y, labels, cells, *keep): rows in which a label, amounts alone and a label on one page are one row with two lines of label.

    Such triples may share a label line; of a chain of them every other one counts, from
    the first on, as if rows were taken one after the other.
    """
    w = Window.partitionBy(*within).orderBy(*order)
    label_only = (F.col("label") != "") & (F.size("cells") == 0)
    cells_only = (F.col("label") == "") & (F.size("cells") > 0)
    rows = rows.withColumn("label_only", label_only).withColumn("n", F.row_number().over(w))
    same = (F.lead("page", 1).over(w) == F.col("page")) & (F.lead("page", 2).over(w) == F.col("page"))
    begins = F.col("label_only") & F.coalesce(F.lead(cells_only, 1).over(w), F.lit(False)) & F.coalesce(F.lead("label_only", 2).over(w), F.lit(False)) & same
    rows = rows.withColumn("begins", F.coalesce(begins, F.lit(False)))
    # A chain: triples that begin two rows apart. Of each chain the first, third, ... count.
    heads = rows.withColumn("before", F.coalesce(F.lag("begins", 2).over(w), F.lit(False)))
    head = F.max(F.when(F.col("begins") & ~F.col("before"), F.col("n"))).over(Window.partitionBy(*within, F.col("n") % 2).orderBy("n"))
    heads = heads.withColumn("taken", F.col("begins") & ((F.col("n") - head) % 4 == 0))
    second = F.coalesce(F.lag("taken", 1).over(w), F.lit(False))
    third = F.coalesce(F.lag("taken", 2).over(w), F.lit(False))
    parts = F.when(F.col("taken"), F.array("label", F.lead("label", 2).over(w))).otherwise(F.when(F.col("label") != "", F.array("label")).otherwise(F.array().cast("array<string>")))
    out = heads.withColumn("labels", parts).withColumn("values", F.when(F.col("taken"), F.lead("cells", 1).over(w)).otherwise(F.col("cells")))
    out = out.withColumn("gone", second | third)
    place = lambda c: F.when(F.col("taken"), F.lead(c, 1).over(w)).otherwise(F.col(c))
    out = out.withColumn("at", place("y"))
    return out.filter(~F.col("gone")).select(*within, "page", F.col("at").alias("y"), "labels", F.col("values").alias("cells"), *keep)


def matched(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows whose lines of label are exactly one of a field's variants: (doc, field_id, role, page, y, cells).

    mapping: field_id, role, variants (arrays of labels). It is as small as a catalogue and goes
    to all tasks: by its labels all rows of one label would be one task's.
    """
    variants = mapping.select("field_id", "role", F.explode("variants").alias("labels"))
    return rows.join(F.broadcast(variants), "labels").select("doc", "field_id", "role", "page", "y", "cells")


def unmatched_fields(docs: DataFrame, mapping: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, field_id) of fields of which no row of a document tells: a mapping that is wrong, not an absent row."""
    every = docs.select("doc", F.explode(F.array(*(F.lit(f) for f in _fields(mapping)))).alias("field_id"))
    return every.join(found.select("doc", "field_id"), ["doc", "field_id"], "left_anti")


def _fields(mapping: DataFrame) -> list[str]:
    """Field ids of a mapping, which is as small as a catalogue."""
    return sorted(r["field_id"] for r in mapping.select("field_id").distinct().collect())


def binding(records: DataFrame, mapping: DataFrame, year: str = "fiscal_year") -> DataFrame:
    """(doc, passed, checked, mismatches, not_applicable): whether the printed header of every record is its field's column.

    Records without a header or a mapped column aren't checked; those that only look for
    a header's presence are listed.
    """
    both = records.join(mapping.select("field_id", F.col("role").alias("wanted")), "field_id", "left")
    both = both.withColumn("role", role_of(F.col("header"), F.col(year)))
    looked = F.col("wanted").isNotNull() & F.col("header").isNotNull()
    presence = F.coalesce(F.col("kind") == "COLUMN_HEADER_PRESENCE", F.lit(False))
    checked = looked & ~presence
    bad = checked & ~F.col("role").eqNullSafe(F.col("wanted"))
    out = both.groupBy("doc").agg(
        F.count_if(checked).alias("checked"),
        F.array_sort(F.collect_list(F.when(bad, F.col("field_id")))).alias("mismatches"),
        F.array_sort(F.collect_list(F.when(looked & presence, F.col("field_id")))).alias("not_applicable"),
    )
    return out.select("doc", (F.size("mismatches") == 0).alias("passed"), "checked", F.array_join("mismatches", ",").alias("mismatches"), F.array_join("not_applicable", ",").alias("not_applicable"))


def applicability(line_rows: DataFrame, titles: list[str]) -> DataFrame:
    """(doc, problem, applies): for each of the titles whether the first box below it, before the next title, is ticked.

    All or nothing: a title that is missing, comes twice or has no box is a problem, and
    then nothing applies or doesn't.
    """
    text = visible(F.col("text"))
    body = F.regexp_replace(text, ITEM_NUMERAL, "")
    body = F.when(text.isin(*titles), text).when(body.isin(*titles), body).otherwise(text)
    rows = line_rows.withColumn("body", body).withColumn("at", F.struct("page", "y", "line"))
    upto = Window.partitionBy("doc").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("item", F.last(F.when(F.col("body").isin(*titles), F.struct("body", "at")), ignorenulls=True).over(upto))
    box = F.col("body").isin(APPLIES, NOT_APPLIES)
    items = rows.filter("item IS NOT NULL").groupBy("doc", "item").agg(F.min_by(F.when(box, F.col("body") == APPLIES), F.when(box, F.col("at"))).alias("on"))
    name = F.col("item.body")
    out = items.groupBy("doc").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(name).alias("names"), F.count_if(F.col("on").isNull()).alias("unread"),
        F.array_sort(F.collect_list(F.struct(name.alias("name"), F.col("on").alias("on")))).alias("read"),
    )
    problem = F.when(F.col("n") > F.col("names"), "repeated").when(F.col("unread") > 0, "no_box").when(F.col("names") < len(titles), "missing")
    every = line_rows.select("doc").distinct().join(out, "doc", "left")
    problem = F.when(F.col("n").isNull(), "missing").otherwise(problem)
    return every.select("doc", problem.alias("problem"), F.when(problem.isNull(), F.col("read")).alias("applies"))


def scope_change(applies: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """(doc, changed, types): any item applies; those of ``types`` that do, sorted; null where undecidable."""
    on = F.filter("applies", lambda x: x["on"])
    names = F.array_sort(F.filter(F.transform(on, lambda x: x["name"]), lambda n: n.isin(*types)))
    return applies.select(
        "doc", F.when(F.col("applies").isNotNull(), F.size(on) > 0).alias("changed"), F.when(F.col("applies").isNotNull(), names).alias("types")
    )


def restated(line_rows: DataFrame, anchors: DataFrame, section: str, headers: tuple[str, ...]) -> DataFrame:
    """(doc, restated, pages): whether a line of the section holds one of the headers.

    Null where the section hasn't exactly one anchor: not read isn't not restated.
    """
    docs = line_rows.select("doc").distinct()
    counts = anchors.filter(F.col("title") == section).groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    hit = F.lit(False)
    for h in headers:
        hit = hit | F.contains(visible(F.col("text")), F.lit(h))
    found = within(line_rows, spans(anchors)).filter((F.col("title") == section) & hit).groupBy("doc")
    found = found.agg(F.array_sort(F.collect_set("page")).alias("pages"))
    rows = docs.join(counts, "doc", "left").join(found, "doc", "left")
    one = F.coalesce(F.col("n"), F.lit(0)) == 1
    return rows.select("doc", F.when(one, F.col("pages").isNotNull()).alias("restated"), F.when(one, F.coalesce("pages", F.array().cast("array<long>"))).alias("pages"))


#: Months of a report's period by its type; an unknown type has none.
MONTHS = {"annual": 12}


def months(report_type: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, n in MONTHS.items():
        out = F.when(report_type == name, n).otherwise(out)
    return out


def amount(text: Column) -> Column:
    """A cell's amount, null unless it has exactly two decimals."""
    return F.when(F.regexp_like(text, F.lit(AMOUNT)), F.replace(text, F.lit(","), F.lit("")).try_cast("decimal(28,6)"))


#: A statement's layout as it is kept: its lines of label and cells as printed.
VIEW = "doc long, title string, unit string, rows array<struct<labels:array<string>,cells:array<string>>>"


def kept_views(views: DataFrame) -> DataFrame:
    """(view): views of the form VIEW as JSON texts; null cells stay apart from absent ones."""
    return views.select(F.to_json(F.struct("doc", "title", "unit", "rows"), {"ignoreNullFields": "false"}).alias("view"))


def read_views(kept: DataFrame) -> DataFrame:
    """Views again; a text that is none is left out."""
    read = F.from_json("view", f"{VIEW}, bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    return kept.select(read.alias("v")).select("v.*").filter("bad IS NULL AND doc IS NOT NULL").drop("bad")
