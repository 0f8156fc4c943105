"""What a question asks for, and what the sentences of a text claim; refusals are columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricspark import storage
from metricspark.operators import lookup, model, numbers
from metricspark.operators.text import named, near_misses, segments

#: Characters that end a company's name, and what may follow it without making it another's.
BOUNDARY = "的和与及或在于对从把被为是年月日季度报去今明这那该它其呢吗么了过各全历"
ORGANISATION = ("股份有限公司", "有限责任公司", "有限公司", "股份", "公司")
#: Words of a period within a year, and of a change.
SUB_ANNUAL = ("季度", "季报", "半年", "中期", "上半年", "下半年", "前三季", "Q1", "Q2", "Q3", "Q4", "H1", "H2")
CHANGE = ("同比", "环比", "增长", "下降", "提升", "提高", "上升", "回落", "增加", "减少", "改善", "恶化")
#: Claims of one text that are checked.
MOST_CLAIMS = 24


def ideograph(c: Column) -> Column:
    return c.between("一", "鿿")


def holds_any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def companies_in(texts: DataFrame, companies: DataFrame, names: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, names, codes, doubt) of the rows of texts that name a company of ``companies`` (name, code).

    Candidates come from an index of the names' rarest grams and are looked for in the
    texts that have any. Of a name with several codes the first counts. A name
    inside another one found is left out. With one code, doubt is PREFIX if the name
    follows an ideograph that is no boundary, SUFFIX if what follows is no boundary, no
    form of organisation and no metric's name. Keys are distinct; null and empty texts name nothing.
    """
    coded = companies.filter(F.col("code").isNotNull()).groupBy("name").agg(F.min("code").alias("code"))
    rows = lookup.candidates(texts.select(F.col(key).alias("key"), F.col(text_col).alias("text")), coded.select("name", "code"), ["code"])
    rows = texts.select(key, F.col(text_col).alias("text")).join(rows.withColumnRenamed("key", key), key)
    there = F.filter(F.transform("names", lambda x: F.struct(x["name"].alias("name"), F.instr(F.col("text"), x["name"]).alias("at"), x["code"].alias("code"))), lambda x: x["at"] > 0)
    hits = rows.select(key, "text", there.alias("hits")).filter(F.size("hits") > 0)
    whole = F.filter("hits", lambda x: ~F.exists("hits", lambda y: (y["name"] != x["name"]) & F.contains(y["name"], x["name"])))
    hits = hits.withColumn("hits", whole)
    listed = names.agg(F.collect_list("alias").alias("aliases"))
    before = lambda x: F.substring(F.col("text"), x["at"] - 1, F.lit(1))
    rest = lambda x: F.substring(F.col("text"), x["at"] + F.length(x["name"]), F.length("text"))
    bound = lambda c: ~ideograph(c) | F.contains(F.lit(BOUNDARY), c)

    def right(x: Column) -> Column:
        org = rest(x).rlike(f"^(?:{'|'.join(ORGANISATION)})")
        return bound(F.left(rest(x), F.lit(1))) | (rest(x) == "") | org | F.exists("aliases", lambda a: F.startswith(rest(x), a))

    codes = F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["code"])))
    one = F.size("codes") == 1
    doubt = F.when(one & F.exists("hits", lambda x: (x["at"] > 1) & ~bound(before(x))), "PREFIX").when(
        one & F.exists("hits", lambda x: ~right(x)), "SUFFIX"
    )
    hits = hits.withColumn("codes", codes).crossJoin(F.broadcast(listed))
    return hits.select(key, F.transform("hits", lambda x: x["name"]).alias("names"), "codes", doubt.alias("doubt"))


def intents(
    texts: DataFrame,
    names: DataFrame,
    companies: DataFrame | None,
    key: str,
    text_col: str = "text",
    ask: Callable[[Column], Column] | model.Ask | None = None,
    blanks: bool = False,
    model_limits: dict | None = None,
    code: str = numbers.CODE,
) -> DataFrame:
    """Rows of texts with metric_id, alias, display, resolved_by, entity, period, refusal_code and reason.

    In this order refuse: a metric's name that is another's end; no name, unless ``ask``
    gives an existing one: an expression of the text, or with ``model_limits`` (see
    ``model.answered``) a function that is called for the distinct texts without a name; several codes, or without codes a company in doubt, several
    companies or none; no year, or several. Keys are distinct. Without ``companies`` texts
    has named_codes and doubt already. ``code``: the form of codes.
    """
    found = near_misses(named(texts, names, text_col, [key]), names, text_col, blanks)
    text = F.col(text_col)
    if ask is not None and model_limits is not None:
        unnamed = found.filter(F.col("alias").isNull() & F.col("near").isNull())
        told = model.guesses(unnamed, names, ask, text_col, **model_limits).select(F.col("text").alias("asked_text"), F.col("guess").alias("model_said"))
        found = found.join(told, F.col("alias").isNull() & (text == F.col("asked_text")), "left").drop("asked_text")
        ask = lambda _: F.col("model_said")
    if ask is None:
        found = found.withColumn("resolved_by", F.when(F.col("alias").isNotNull(), "alias_table"))
    else:
        guess = names.select(F.col("alias").alias("said"), F.col("metric_id").alias("m2"), F.col("display").alias("d2"))
        found = found.withColumn("said", F.when(F.col("alias").isNull(), numbers.normalised(ask(text))))
        found = found.join(F.broadcast(guess), "said", "left")  # as many rows as definitions have names
        found = found.withColumn("resolved_by", F.when(F.col("alias").isNotNull(), "alias_table").when(F.col("m2").isNotNull(), "model"))
        found = found.withColumn("alias", F.coalesce("alias", F.when(F.col("m2").isNotNull(), F.col("said"))))
        found = found.withColumn("metric_id", F.coalesce("metric_id", "m2")).withColumn("display", F.coalesce("display", "d2")).drop("said", "m2", "d2")
    found = found.withColumn("codes", numbers.codes(text, code)).withColumn("years", numbers.years(text))
    if companies is not None:
        by_name = companies_in(texts.filter(F.size(numbers.codes(text, code)) == 0), companies, names, key, text_col)
        found = found.join(by_name.select(key, F.col("codes").alias("named_codes"), "doubt"), key, "left")
    entities = F.when(F.size("codes") > 0, F.col("codes")).otherwise(F.coalesce("named_codes", F.array().cast("array<string>")))
    found = found.withColumn("entities", entities)
    reason = (
        F.when(F.col("near").isNotNull(), "near_miss")
        .when(F.col("alias").isNull(), "no_metric")
        .when((F.size("codes") == 0) & F.col("doubt").isNotNull(), F.concat(F.lit("name_"), F.lower("doubt")))
        .when(F.size("entities") == 0, "no_entity")
        .when(F.size("entities") > 1, "many_entities")
        .when(F.size("years") == 0, "no_period")
        .when(F.size("years") > 1, "many_periods")
    )
    found = found.withColumn("reason", reason)
    refusal = F.when(F.col("reason").isin("near_miss", "no_metric"), "METRIC_NOT_DEFINED").when(F.col("reason").isNotNull(), "INTENT_INCOMPLETE")
    clear = F.col("reason").isNull()
    return found.select(
        *(c for c in texts.columns if c not in ("named_codes", "doubt")), "metric_id", "alias", "display", "resolved_by",
        F.when(clear, F.get("entities", F.lit(0))).alias("entity"),
        F.when(clear, F.get("years", F.lit(0)).cast("long")).alias("period"),
        refusal.alias("refusal_code"), "reason",
    )


def answers(asked: DataFrame, values: DataFrame) -> DataFrame:
    """Intents with the value of what they ask for; a row that isn't there is UNAVAILABLE."""
    v = values.select("entity", "period", "metric_id", "value", F.col("refusal_code").alias("value_code"), F.lit(True).alias("there"))
    both = asked.join(v, ["entity", "period", "metric_id"], "left")
    code = F.coalesce("refusal_code", F.when(F.col("there").isNull(), "UNAVAILABLE"), "value_code")
    return both.withColumn("refusal_code", code).drop("there", "value_code")


def rendered(refused: DataFrame) -> DataFrame:
    """Refused answers with ``refusal``, their JSON with fixed keys: refused, code, detail."""
    said = F.to_json(F.struct(F.lit(True).alias("refused"), F.col("refusal_code").alias("code"), F.coalesce("reason", F.lit("")).alias("detail")))
    return refused.filter(F.col("refusal_code").isNotNull()).withColumn("refusal", said)


def own_entity(pieces: DataFrame, companies: DataFrame, names: DataFrame, key: str, code: str = numbers.CODE) -> DataFrame:
    """pieces with ``own``: the one code or company that a piece names, and ``vague``: it names several or one in doubt.

    named_codes and doubt tell of companies named where no code is.
    A number of a code's form (``code``) before a unit of money is an amount.
    """
    codes = F.array_distinct(F.regexp_extract_all("segment", F.lit(code + numbers.MONEY), F.lit(1)))
    rows = pieces.withColumn("codes", codes)
    by_name = companies_in(rows.filter(F.size("codes") == 0), companies, names, key, "segment")
    rows = rows.join(by_name.select(key, F.col("codes").alias("named_codes"), "doubt"), key, "left")
    all_codes = F.when(F.size("codes") > 0, F.col("codes")).otherwise(F.coalesce("named_codes", F.array().cast("array<string>")))
    vague = F.col("doubt").isNotNull() | (F.size(all_codes) > 1)
    own = F.when(~vague, F.get(all_codes, F.lit(0)))
    return rows.withColumn("own", own).withColumn("vague", vague).drop("codes")


def claims(
    texts: DataFrame, values: DataFrame, names: DataFrame, companies: DataFrame, key: str = "doc_id", blanks: bool = False, code: str = numbers.CODE
) -> DataFrame:
    """(key, pos, segment, read_as, verdict, why, metric_id, entity, period, inherited) of every segment of texts.

    A text without a number is a QUESTION. A segment without one is NOT_CHECKABLE. One
    that names no company or year takes the first that an earlier segment gave; one that
    names several neither gives nor takes. After MOST_CLAIMS segments with numbers the
    rest is NOT_COVERED. The first of these decides on the others: a period within a
    year, several numbers, a difference in points, a refusal, a word of change outside
    the metric's name: NOT_COVERED; a name that isn't the metric's own, or was guessed:
    AMBIGUOUS_BASIS; then the value, within half a unit of the last written place.
    ``code``: the form of companies' codes.
    """
    seg = F.col("segment")
    rows = segments(texts.select(key, numbers.normalised(F.col("text")).alias("text")), key)
    rows = rows.withColumn("id", F.concat_ws("\u0001", F.col(key).cast("string"), F.col("pos").cast("string")))
    # Three branches read the segments, and one plan with each of them is large for the driver.
    rows = storage.kept(rows.withColumn("said", numbers.stated(seg, code)).withColumn("own_years", numbers.years(seg)), "segments")
    rows = own_entity(rows, companies, names, "id", code)
    earlier = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    checkable = F.size("said") > 0
    own_year = F.when(F.size("own_years") == 1, F.get("own_years", F.lit(0)))
    rows = (
        rows.withColumn("entity_before", F.first("own", ignorenulls=True).over(earlier))
        .withColumn("year_before", F.first(own_year, ignorenulls=True).over(earlier))
        .withColumn("nth", F.sum(checkable.cast("int")).over(upto))
        .withColumn("read_as", F.when(F.max(checkable).over(whole), "STATEMENT").otherwise("QUESTION"))
    )
    takes_entity = F.col("own").isNull() & ~F.col("vague") & F.col("entity_before").isNotNull()
    takes_year = (F.size("own_years") == 0) & F.col("year_before").isNotNull()
    before = F.concat(
        F.when(takes_entity, F.concat("entity_before", F.lit(" "))).otherwise(""),
        F.when(takes_year, F.concat("year_before", F.lit("年 "))).otherwise(""),
    )
    rows = rows.withColumn("inherited", F.concat_ws(",", F.when(takes_entity, "entity"), F.when(takes_year, "period"))).withColumn("asked", F.concat(before, seg))
    known = answers(intents(rows, names, None, "id", "asked", blanks=blanks, code=code), values)
    first = F.get("said", F.lit(0))
    apart = F.abs(F.col("value") - first["value"]) <= first["tolerance"].cast("decimal(28,10)")
    bare = F.replace(seg, F.coalesce("alias", F.lit("")), F.lit(""))
    why = (
        F.when(~checkable, "no_number")
        .when(F.col("nth") > MOST_CLAIMS, "too_many")
        .when(holds_any(seg, SUB_ANNUAL), "sub_annual")
        .when(F.size("said") > 1, "many_numbers")
        .when(first["delta"], "difference")
        .when(F.col("refusal_code").isNotNull(), F.coalesce("reason", F.lower("refusal_code")))
        .when(holds_any(F.when(F.col("alias").isNotNull(), bare).otherwise(seg), CHANGE), "change")
        .when(F.col("resolved_by") == "model", "guessed_name")
        .when(F.col("alias") != F.col("display"), "other_name")
        .when(apart, "value")
        .otherwise("off_value")
    )
    known = known.withColumn("why", why)
    verdict = (
        F.when(F.col("why") == "no_number", "NOT_CHECKABLE")
        .when(F.col("why").isin("guessed_name", "other_name"), "AMBIGUOUS_BASIS")
        .when(F.col("why") == "value", "CONSISTENT")
        .when(F.col("why") == "off_value", "INCONSISTENT")
        .otherwise("NOT_COVERED")
    )
    return known.select(key, "pos", "segment", "read_as", verdict.alias("verdict"), "why", "metric_id", "entity", "period", "inherited")
