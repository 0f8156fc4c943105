"""Judging of frozen cases: refusals, claims, attribution, summaries, reviews and their preconditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metricspark.operators import lookup

#: Layers of a failure, and where each refusal code and each other kind of failure belongs.
INTENT, RETRIEVAL, DEFINITION, COMPUTATION, PRESENTATION = "意图层", "检索层", "口径层", "计算层", "表达层"
LAYERS = (INTENT, RETRIEVAL, DEFINITION, COMPUTATION, PRESENTATION)
LAYER_OF_CODE = {
    "INTENT_INCOMPLETE": (INTENT,), "METRIC_NOT_DEFINED": (DEFINITION,), "ALIAS_AMBIGUOUS": (DEFINITION,),
    "DEFINITION_NONCONFORMANT": (DEFINITION,), "UNDEFINED_CONDITION_HIT": (DEFINITION,), "UNEVALUABLE_CONDITION": (DEFINITION,),
    "CROSS_VERSION_COMPARISON": (DEFINITION,), "CROSS_BASIS_VERSION_COMPARISON": (DEFINITION,), "UNAVAILABLE": (RETRIEVAL,),
    "RECONCILIATION_FAILED": (RETRIEVAL, COMPUTATION),
}
LAYER_OF_KIND = {
    "ANSWERED_BUT_SHOULD_REFUSE": (DEFINITION,), "WRONG_REFUSAL_CODE": (DEFINITION,), "NO_VALUE_NO_REFUSAL": (COMPUTATION,),
    "EXPECTED_NON_SCALAR": (COMPUTATION,), "VALUE_OUT_OF_TOLERANCE": (COMPUTATION,), "WRONG_METRIC": (DEFINITION,), "WRONG_VERSION": (DEFINITION,),
}
#: Categories that can be run, most void cases, least refusal cases, kinds of refusal that stand for a code.
RUNNABLE, MOST_VOID, LEAST_REFUSALS = ("C1", "C2", "C3"), 0.10, 3
CATEGORIES = ("C1", "C2", "C3", "C4", "C5")
KINDS_OF_CODE = {"METRIC_NOT_DEFINED": ("metric_not_defined", "metric_ambiguous"), "UNDEFINED_CONDITION_HIT": ("data_missing",)}


def partition(cases: DataFrame, only: str | None = None) -> DataFrame:
    """cases (category, voided) with ``state``: VOIDED, NOT_RUN, or RUN where neither holds."""
    state = F.when(F.trim(F.coalesce("voided", F.lit(""))) != "", "VOIDED")
    if only is not None:
        state = state.when(F.col("category") != only, "NOT_RUN")
    return cases.withColumn("state", state.when(~F.col("category").isin(*RUNNABLE), "NOT_RUN").otherwise("RUN"))


def refusals(cases: DataFrame) -> DataFrame:
    """cases (code, want_code) of which a refusal is wanted, with status and kind; code is null for an answer."""
    kind = F.when(F.col("code").isNull(), "ANSWERED_BUT_SHOULD_REFUSE").when(
        F.coalesce(F.col("want_code") != F.col("code"), F.lit(False)), "WRONG_REFUSAL_CODE"
    )
    return cases.withColumn("kind", kind).withColumn("status", F.when(kind.isNull(), "PASS").otherwise("FAIL"))


def attributed(cases: DataFrame) -> DataFrame:
    """Failed cases (kind, code) with the ``layers`` of their failure, and ``unmapped`` where no layer is known.

    A refusal in place of an answer belongs where its code does; other kinds where they do.
    """
    table = lambda t: F.create_map(*(x for k, v in t.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    layers = F.when(F.col("kind") == "REFUSED_BUT_SHOULD_ANSWER", F.try_element_at(table(LAYER_OF_CODE), F.coalesce("code", F.lit("")))).otherwise(
        F.try_element_at(table(LAYER_OF_KIND), F.coalesce("kind", F.lit("")))
    )
    rows = cases.withColumn("layers", F.when(F.col("status") == "FAIL", layers))
    return rows.withColumn("unmapped", (F.col("status") == "FAIL") & F.col("layers").isNull())


def reachable(cases: DataFrame) -> DataFrame:
    """(layer, reachable, reached): whether any failure can belong to a layer, and whether one of the cases does."""
    some = {x for t in (LAYER_OF_CODE, LAYER_OF_KIND) for v in t.values() for x in v}
    return layer_usage(cases).select("layer", F.col("layer").isin(*some).alias("reachable"), (F.col("n") > 0).alias("reached"))


def layer_usage(cases: DataFrame) -> DataFrame:
    """(layer, n) of failed cases with layers; layers without failures count 0. No shuffle of cases: counts only."""
    counts = [F.struct(F.lit(x).alias("layer"), F.count_if((F.col("status") == "FAIL") & F.array_contains(F.coalesce("layers", F.array().cast("array<string>")), x)).alias("n")) for x in LAYERS]
    return cases.agg(F.array(*counts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def summary(cases: DataFrame) -> DataFrame:
    """(category, authored, voided, surviving, executed, passed, status) of the whole domain; cases: category, status."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    found = cases.groupBy("category").agg(
        F.count(F.lit(1)).alias("authored"), n("VOIDED").alias("voided"), n("PASS", "FAIL").alias("executed"), n("PASS").alias("passed")
    )
    every = cases.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    rows = F.broadcast(every).join(found, "category", "left").na.fill(0)
    rows = rows.withColumn("surviving", F.col("authored") - F.col("voided"))
    status = F.when(F.col("executed") == 0, "NOT_RUN").when(F.col("passed") == F.col("executed"), "PASS").otherwise("FAIL")
    return rows.withColumn("status", status)


def suite_gate(cases: DataFrame) -> DataFrame:
    """One row: counts, the share of void cases and its limit, and whether all of enough refusal cases passed."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    c2 = F.col("category") == "C2"
    out = cases.agg(
        F.count(F.lit(1)).alias("authored"), n("VOIDED").alias("voided"), n("PASS", "FAIL").alias("scored"), n("NOT_RUN").alias("not_run"), n("PASS").alias("passed"),
        F.count_if(c2 & (F.col("status") != "VOIDED")).alias("surviving"), F.count_if(c2 & F.col("status").isin("PASS", "FAIL")).alias("ran"), F.count_if(c2 & (F.col("status") == "PASS")).alias("right"),
    )
    ratio = F.coalesce(F.try_divide(F.col("voided").cast("double"), F.col("authored").cast("double")), F.lit(0.0))
    holds = (F.col("ran") > 0) & (F.col("surviving") >= LEAST_REFUSALS) & (F.col("right") == F.col("ran"))
    return out.select("authored", "voided", "scored", "not_run", "passed", F.round(ratio, 4).alias("void_ratio"), (ratio <= MOST_VOID).alias("void_within"), holds.alias("refusal_gate"))


def claim_cases(expected: DataFrame, produced: DataFrame) -> DataFrame:
    """(case_id, passed, problem) of claim cases: what a text was read as, how it was cut, and each verdict.

    expected, produced: case_id, read_as, claims (array of text, verdict, inherited).
    Verdicts are compared only where the cut is right, by place; a wanted inheritance must be there.
    """
    both = expected.join(produced.select("case_id", F.col("read_as").alias("got_as"), F.col("claims").alias("got")), "case_id", "left")
    texts = lambda c: F.transform(c, lambda x: F.trim(F.regexp_replace(x["text"], r"\s+", " ")))
    cut = F.coalesce(texts("claims") == texts("got"), F.lit(False))
    pairs = F.arrays_zip("claims", "got")
    wrong = F.exists(pairs, lambda p: ~p["claims"]["verdict"].eqNullSafe(p["got"]["verdict"]))
    lost = F.exists(pairs, lambda p: p["claims"]["inherited"].isNotNull() & ~p["claims"]["inherited"].eqNullSafe(p["got"]["inherited"]))
    problem = F.when(~F.col("read_as").eqNullSafe(F.col("got_as")), "READ_AS").when(~cut, "SEGMENTATION").when(wrong, "VERDICT").when(lost, "INHERITED")
    return both.select("case_id", problem.isNull().alias("passed"), problem.alias("problem"))


def freeze(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, problem) of a frozen suite: listed files that are gone or changed, cases that aren't listed.

    files: path, content (binary), as the binaryFile source reads them; manifest: path, sha256.
    """
    own = files.select("path", F.sha2("content", 256).alias("got"), F.lit(True).alias("there"))
    both = own.join(manifest.select("path", "sha256", F.lit(True).alias("listed")), "path", "full")
    problem = (
        F.when(F.col("there").isNull(), "MISSING_FILE")
        .when(F.col("listed").isNull(), F.when(F.startswith("path", F.lit("cases/")), "NOT_LISTED"))
        .when(F.col("got") != F.col("sha256"), "CHANGED")
    )
    return both.select("path", problem.alias("problem")).filter("problem IS NOT NULL")


REQUIRED = ("id", "category", "question", "expected", "required_evidence", "judging")


def preconditions(cases: DataFrame, known: DataFrame, fixtures: DataFrame) -> DataFrame:
    """(file, problem) of cases before a freeze: missing keys, repeated ids, soft targets, unknown metrics and fixtures.

    cases: file, REQUIRED keys as texts, target_name, metric_id, fixture. A refusal case
    needs a target that no metric is called; others must name metrics that exist.
    """
    names = known.select(F.col("alias").alias("n1"), F.lit(True).alias("target_known"))
    metrics = known.select(F.col("alias").alias("n2"), F.lit(True).alias("metric_known")).distinct()
    there = fixtures.select(F.col("fixture").alias("n3"), F.lit(True).alias("fixture_known")).distinct()
    again = cases.filter("id IS NOT NULL").groupBy("id").agg(F.min("file").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("n4"), "first")
    rows = cases.join(names.distinct(), F.col("target_name") == F.col("n1"), "left").join(metrics, F.col("metric_id") == F.col("n2"), "left")
    rows = rows.join(there, F.col("fixture") == F.col("n3"), "left").join(again, F.col("id") == F.col("n4"), "left")
    c2 = F.col("category") == "C2"
    tests = [F.when(F.col(k).isNull(), f"MISSING:{k}") for k in REQUIRED]
    tests += [
        F.when(F.col("n4").isNotNull() & (F.col("file") != F.col("first")), "REPEATED_ID"),
        F.when(c2 & F.col("target_name").isNull(), "NO_TARGET"),
        F.when(c2 & F.col("target_known"), "TARGET_EXISTS"),
        F.when(~c2 & F.col("metric_id").isNotNull() & F.col("metric_known").isNull(), "UNKNOWN_METRIC"),
        F.when(F.col("fixture").isNotNull() & F.col("fixture_known").isNull(), "UNKNOWN_FIXTURE"),
    ]
    return rows.select("file", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("problem"))


ANSWER = "refused boolean, refusal_kind string, value string, reasoning string"


def parsed(raw: Column) -> Column:
    """A model's text as ANSWER: fences off, or else the outermost braces of it; null if there are none to be read."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```[a-zA-Z]*\n?", ""), r"\n?```\s*$", "")
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    read = lambda c: F.when(F.try_parse_json(c).isNotNull() & F.startswith(F.trim(c), F.lit("{")), F.from_json(c, ANSWER))
    return F.coalesce(read(bare), read(F.when(inner != "", inner)))


def number(text: Column) -> Column:
    """A number as models write it: commas and a percent sign are left out."""
    return F.rtrim(F.replace(F.trim(text), F.lit(","), F.lit("")), F.lit("% ")).try_cast("double")


def baseline(cases: DataFrame) -> DataFrame:
    """cases (category, raw, want, want_code, refusal_expected, abs_tol, rel_tol) of a plain model with status.

    Output that can't be read is an ERROR and no wrong answer. A wanted refusal must be of
    a kind that stands for its code, if one stands for it.
    """
    rows = cases.withColumn("a", parsed(F.col("raw")))
    refused = F.coalesce("a.refused", F.lit(False))
    allowed = F.lit(None).cast("array<string>")
    for code, kinds in KINDS_OF_CODE.items():
        allowed = F.when(F.col("want_code") == code, F.array(*map(F.lit, kinds))).otherwise(allowed)
    kind = F.lower(F.trim(F.coalesce("a.refusal_kind", F.lit(""))))
    got = number(F.col("a.value"))
    near = F.abs(got - F.col("want")) <= F.greatest(F.coalesce("abs_tol", F.lit(1e-6)), F.abs("want") * F.coalesce("rel_tol", F.lit(1e-9)))
    status = (
        F.when(F.col("a").isNull(), "ERROR")
        .when(F.col("category") == "C5", "NOT_COMPARABLE")
        .when(F.col("refusal_expected") & ~refused, "FAIL")
        .when(F.col("refusal_expected"), F.when(allowed.isNull() | F.array_contains(allowed, kind), "PASS").otherwise("FAIL"))
        .when(refused | ~F.coalesce(near, F.lit(False)), "FAIL")
        .otherwise("PASS")
    )
    return rows.withColumn("status", status).drop("a")


def hints(cases: DataFrame) -> DataFrame:
    """(case_id, layers, hint) of failed cases: where they failed beside what their author foresaw; no rate of it."""
    return cases.filter("status = 'FAIL'").select("case_id", "layers", F.nullif(F.trim(F.regexp_replace("hint", r"\s+", " ")), F.lit("")).alias("hint"))


def leaks(packets: DataFrame, probes: DataFrame) -> DataFrame:
    """(packet_id, page, probe): texts of judging that show in a packet of their page. packets: page, packet_id, body; probes: packet_id, page, probe.

    A probe is looked for in each body of its page, whoever's packet that is; bodies are
    cut into grams and only those that share a probe's rarest one are read. Empty and null probes show nowhere.
    """
    said = probes.filter(F.length("probe") > 0).select("page", F.col("probe").alias("name")).distinct()
    bodies = packets.select(F.struct("page", "packet_id", F.xxhash64("body").alias("body")).alias("key"), "page", F.col("body").alias("text")).dropDuplicates(["key"])
    found = bodies.join(lookup.candidates(bodies, said, [], ("page",)).drop("page"), "key").select("page", "text", F.explode("names").alias("x"))
    shown = found.filter(F.contains("text", F.col("x.name"))).select("page", F.col("x.name").alias("probe")).distinct()
    return probes.join(shown, ["page", "probe"]).select("packet_id", "page", "probe")


def shuffled(packets: DataFrame, key: str, seed: int) -> DataFrame:
    """packets with ``place`` from 1, in the order of a digest of seed and key, then of the key: the same on every run.

    Rows are numbered in 4096 parts by the digest's first letters; a part's first number
    follows from the sizes of those before it, so no task has more than a part.
    """
    rows = packets.withColumn("digest", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)).withColumn("part", F.left("digest", F.lit(3)))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("part").orderBy("digest", key))
    placed = rows.withColumn("own", own).join(F.broadcast(sizes.select("part", before.alias("before"))), "part")  # 4096 rows
    return placed.select(*packets.columns, (F.col("before") + F.col("own")).cast("long").alias("place"))


def reviewed(packets: DataFrame, results: DataFrame, sheet: DataFrame) -> DataFrame:
    """(case_id, status, vote): packets (packet_id, case_id) with results and votes; a packet without a vote has null."""
    return packets.join(results.select("case_id", "status"), "case_id").join(sheet.select("packet_id", "vote"), "packet_id", "left").select("case_id", "status", "vote")


def by_ratio(statistics: DataFrame) -> DataFrame:
    """Statistics of metrics with ``rank``: the largest advisory ratio first, then by name."""
    return statistics.filter("NOT overall").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("advisory_ratio"), "metric_id")))


def over_limit(statistics: DataFrame, limit: float) -> DataFrame:
    """One row: whether the overall ratio is over a limit, which itself is allowed."""
    return statistics.filter("overall").select("advisory_ratio", (F.col("advisory_ratio") > limit).alias("fails"))


def ordered(findings: DataFrame) -> DataFrame:
    """Findings (path, rule, detail) in the order of all three."""
    return findings.orderBy("path", "rule", "detail")


def blocked(score: DataFrame, blind: Column, least_wrong: int = 1) -> DataFrame:
    """A review's score with ``blocks``: a build that wasn't blind, or too few wrong cases to learn from, blocks a pass."""
    reasons = F.filter(F.array(F.when(~F.coalesce(blind, F.lit(False)), "not_blind"), F.when(F.col("wrong") < least_wrong, "no_wrong_case"), F.when(~F.col("within_limit"), "undecidable")), lambda x: x.isNotNull())
    rows = score.withColumn("blocks", F.array_join(reasons, ","))
    return rows.withColumn("final", F.when(F.col("blocks") != "", "BLOCKED").otherwise(F.col("gate")))


#: What a repository mustn't hold: kinds of files, patterns of contents, statements outside their folder.
SCANNED = {"forbidden_type": r"\.(pdf|xlsx?|zip)$", "secret": r"(?i)(api[_-]?key|secret)\s*[:=]\s*\S{8,}", "absolute_path": r"/(home|Users)/\w+"}


def scanned(files: DataFrame, patterns: dict[str, str] = SCANNED, data_prefix: str = "data/") -> DataFrame:
    """(path, rule, detail): forbidden kinds of files, contents that match a pattern, statements elsewhere than in their folder.

    files: path, content (text), ignored. Ignored files are left out, but for those in the data's folder.
    """
    rows = files.filter(~F.coalesce("ignored", F.lit(False)) | F.startswith("path", F.lit(data_prefix)))
    found = [F.when(F.regexp_like("path", F.lit(patterns["forbidden_type"])), F.struct(F.lit("forbidden_type").alias("rule"), F.regexp_extract("path", patterns["forbidden_type"], 0).alias("detail")))]
    for rule, pattern in patterns.items():
        if rule != "forbidden_type":
            found.append(F.when(F.regexp_like("content", F.lit(pattern)), F.struct(F.lit(rule).alias("rule"), F.regexp_extract("content", pattern, 0).alias("detail"))))
    elsewhere = F.contains("content", F.lit("source_pdf_sha256:")) & ~F.startswith("path", F.lit(data_prefix))
    found.append(F.when(elsewhere, F.struct(F.lit("statement_elsewhere").alias("rule"), F.lit("").alias("detail"))))
    return rows.select("path", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f")).select("path", "f.*")


IGNORE = ".gitignore"


def uncovered(files: DataFrame, required: list[str]) -> DataFrame:
    """(path, rule, detail): entries that the ignore file must have, as whole lines but for blanks at their ends, and hasn't; all if there is no such file."""
    lines = files.filter(F.col("path") == IGNORE).select(F.explode(F.split("content", r"\r?\n")).alias("line")).select(F.trim("line").alias("detail")).distinct()
    wanted = files.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(required)], "detail string")
    return wanted.join(lines, "detail", "left_anti").select(F.lit(IGNORE).alias("path"), F.lit("ignore_coverage_lost").alias("rule"), "detail")


def scan(files: DataFrame, required: list[str], patterns: dict[str, str] = SCANNED, data_prefix: str = "data/") -> DataFrame:
    """All findings of a repository's files in one call: ``scanned`` and ``uncovered``."""
    return scanned(files, patterns, data_prefix).unionByName(uncovered(files, required))
