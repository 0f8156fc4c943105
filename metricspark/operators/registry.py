"""The catalogue of definitions as data: loading, names, mappings, fingerprints, and the gate before execution.

Definitions, vocabularies and mappings are catalogues of some dozens or hundreds of rows;
where a step needs them on the driver it says so. What they are applied to is not.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from decimal import Decimal
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricspark.operators import evidence, expressions, metrics, reading, rules
from metricspark.plans.definitions import KINDS, Definition

SCHEMA = (
    "metric_id string, display_name string, aliases array<string>, version int, formula string,"
    " fields array<struct<id:string,sign:string,missing:string,kind:string,values:array<string>>>,"
    " conditions array<struct<expr:string,reason:string>>, flags array<struct<name:string,trigger:string>>,"
    " basis array<struct<name:string,version:string>>, derivation struct<allow:boolean,note:string>,"
    " pitfalls array<struct<text:string,enforced_by:string,advisory:boolean>>"
)
VOCABULARY = "name string, scope string, affects_comparability boolean, meaning string, set_by string"
#: What a pitfall may be enforced by.
ENFORCERS = ("undefined_conditions", "comparability_flags", "derivation", "sign_convention", "missing_representation")


def load(spark: SparkSession, folder: str) -> DataFrame:
    """Definitions, one a file of JSON or YAML, of a folder, as ``parsed`` gives them.

    Files whose names begin with ``_`` are left out.
    """
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="[!_]*.{json,yaml,yml}")
    return parsed(files.select(F.col("_metadata.file_name").alias("path"), "value")).orderBy("path")


def parsed(files: DataFrame) -> DataFrame:
    """path, SCHEMA and ``parse_error`` of files (path, value), told apart by the ends of their paths.

    A file that is no definition gives a row whose ``parse_error`` is its text; nothing is raised.
    """
    files = spread(files, "path")
    text = F.when(F.endswith("path", F.lit(".json")), F.col("value")).otherwise(_of_yaml(F.col("value")))
    read = F.from_json("text", f"{SCHEMA}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = files.withColumn("text", text).withColumn("d", F.when(F.col("text").isNotNull(), read))
    error = F.when(F.col("text").isNull(), F.col("value")).otherwise(F.col("d._corrupt_record"))
    return rows.select("path", "d.*", error.alias("parse_error")).drop("_corrupt_record")


def spread(definitions: DataFrame, *keys: str) -> DataFrame:
    """Definitions dealt over as many parts as the session says: a small file is one task, and reading texts takes far longer than their bytes tell."""
    return definitions.repartition(int(definitions.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def of_yaml(text: str | None) -> str | None:
    """A definition in YAML as JSON of the form SCHEMA; null if it can't be read. What is no mapping is an empty definition."""
    import yaml

    try:
        raw = yaml.load(text or "", Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except yaml.YAMLError:
        return None
    raw = raw if isinstance(raw, dict) else {}
    listed = lambda key: [e for e in raw.get(key) or [] if isinstance(e, dict)] if isinstance(raw.get(key), list) else []
    said = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=str)
    derivation = raw.get("derivation") if isinstance(raw.get("derivation"), dict) else None
    version = raw.get("version")

    def field(e: dict) -> dict:
        values = e.get("enum_values")
        kind = "number" if values is None else "boolean" if values and all(isinstance(v, bool) for v in values) else "enum"
        missing = (said(e["missing_representation"]) or "null") if "missing_representation" in e else None
        return {"id": said(e.get("id")), "sign": said(e.get("sign_convention")), "missing": missing, "kind": kind, "values": values and [said(v) for v in values]}

    out = {
        "metric_id": said(raw.get("metric_id")), "display_name": said(raw.get("display_name")), "aliases": [said(a) for a in raw.get("aliases") or []],
        "version": version if type(version) is int else None, "formula": (said(raw.get("formula")) or "").strip() or None, "fields": [field(e) for e in listed("source_fields")],
        "conditions": [{"expr": said(e.get("expr")), "reason": said(e.get("reason"))} if isinstance(e, dict) else {"expr": None, "reason": said(e)} for e in raw.get("undefined_conditions") or []],
        "flags": [{"name": said(e.get("name")), "trigger": said(e.get("trigger"))} for e in listed("flags")] if "flags" in raw else None,
        "basis": [{"name": said(e.get("name")), "version": said(e.get("version"))} for e in listed("standard_basis")],
        "derivation": derivation and {"allow": derivation.get("allow_from_components") if isinstance(derivation.get("allow_from_components"), bool) else None, "note": said(derivation.get("note"))},
        "pitfalls": [{"text": said(e.get("text")), "enforced_by": said(e.get("enforced_by")), "advisory": e.get("advisory_only") is True} for e in listed("common_pitfalls")],
    }
    return json.dumps(out, ensure_ascii=False)


def _of_yaml(text: Column) -> Column:
    """YAML has no reader in Spark; libyaml's, where it is there, takes a tenth of the time."""
    return F.udf(of_yaml, "string", useArrow=True)(text)


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """The flags of a folder's ``flags.jsonl``; a row without all five keys is an error, raised at once."""
    rows = spark.read.schema(f"{VOCABULARY}, parse_error string").option("columnNameOfCorruptRecord", "parse_error").json(f"{folder}/flags.jsonl")
    bad = rows.filter(F.col("parse_error").isNotNull() | F.greatest(*(F.col(c.split()[0]).isNull() for c in VOCABULARY.split(", "))))
    if faults := bad.limit(1).collect():
        raise ValueError(f"a flag lacks one of its keys: {faults[0].asDict()}")
    return rows.drop("parse_error")


def names(definitions: DataFrame) -> DataFrame:
    """(alias, metric_id, display): id, display name and aliases of every definition that has an id."""
    alias = F.explode(F.array_distinct(F.filter(F.concat(F.array("metric_id", "display_name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: F.length(x) > 0)))
    return definitions.filter("metric_id IS NOT NULL").select(alias.alias("alias"), "metric_id", F.coalesce("display_name", "metric_id").alias("display"))


def collisions(definitions: DataFrame) -> DataFrame:
    """(name, kind, metric_ids): ids that come twice and names that stand for several metrics."""
    ids = definitions.filter("metric_id IS NOT NULL").groupBy(F.col("metric_id").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    ids = ids.filter("n > 1").select("name", F.lit("DUPLICATE_ID").alias("kind"), F.col("name").alias("metric_ids"))
    many = names(definitions).groupBy(F.col("alias").alias("name")).agg(F.array_sort(F.collect_set("metric_id")).alias("m"))
    many = many.filter(F.size("m") > 1).select("name", F.lit("ALIAS_AMBIGUOUS").alias("kind"), F.array_join("m", ",").alias("metric_ids"))
    return ids.unionByName(many)


def checked(definitions: DataFrame) -> DataFrame:
    """The definitions, or an error if names collide: a catalogue with two meanings for a name isn't loaded."""
    if faults := collisions(definitions).limit(1).collect():
        raise ValueError(f"{faults[0]['kind']}: {faults[0]['name']} stands for {faults[0]['metric_ids']}")
    return definitions


def compiled(definitions: DataFrame) -> tuple[Definition, ...]:
    """Definitions for the metric plans; the catalogue comes to the driver."""
    rows = definitions.filter("parse_error IS NULL AND metric_id IS NOT NULL").orderBy("metric_id").collect()
    return tuple(
        Definition(
            r["metric_id"], r["formula"], tuple(c["expr"] or "" for c in r["conditions"] or ()),
            tuple((f["name"], f["trigger"]) for f in r["flags"] or () if f["name"] and f["trigger"]), tuple(r["aliases"] or ()), r["version"],
            tuple((f["id"], represented(f["missing"])) for f in r["fields"] or () if f["id"] and represented(f["missing"]) is not None),
        )
        for r in rows
    )


def represented(said: str | None) -> Decimal | str | bool | None:
    """What stands for a missing value, as it is declared: null, true, false, a number, or another text."""
    if said is None or said == "null":
        return None
    if said in ("true", "false"):
        return said == "true"
    return Decimal(said) if re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", said) else said


def resolved(asked: DataFrame, catalogue: DataFrame, findings: DataFrame, name: str = "name") -> DataFrame:
    """asked with metric_id and refusal_code: METRIC_NOT_DEFINED, or DEFINITION_NONCONFORMANT where a definition has findings.

    A name is looked up as it is but for blanks at its ends.
    """
    faulty = findings.select("metric_id").distinct().withColumn("faulty", F.lit(True))
    known = catalogue.select(F.col("alias").alias("__name"), "metric_id").join(faulty, "metric_id", "left")
    rows = asked.withColumn("__name", F.trim(F.col(name))).join(known, "__name", "left")
    code = F.when(F.col("metric_id").isNull(), "METRIC_NOT_DEFINED").when(F.col("faulty"), "DEFINITION_NONCONFORMANT")
    return rows.withColumn("refusal_code", code).drop("__name", "faulty")


def declared(definitions: DataFrame) -> DataFrame:
    """(field_id): fields that any definition declares, once each."""
    return definitions.select(F.explode("fields.id").alias("field_id")).distinct()


def differences(declared: DataFrame, mapped: DataFrame) -> DataFrame:
    """(field_id, missing_in): fields of either side that the other lacks."""
    a, b = declared.select("field_id").distinct(), mapped.select("field_id").distinct()
    return a.join(b, "field_id", "left_anti").withColumn("missing_in", F.lit("mapping")).unionByName(
        b.join(a, "field_id", "left_anti").withColumn("missing_in", F.lit("definitions"))
    )


def outside(part: DataFrame, whole: DataFrame) -> DataFrame:
    """(field_id): fields of ``part`` that ``whole`` lacks; none if it is a subset."""
    return part.select("field_id").distinct().join(whole.select("field_id"), "field_id", "left_anti")


#: Keys that a mapping's row needs and those that it must not have, by its kind.
NEEDS = {"row": ("variants", "role"), "note": ("section",), "presence": ("header",)}
FORBIDS = {"row": ("section",), "note": ("variants", "role"), "presence": ("variants", "role")}
STATEMENT_ROOTS = {"balance": "bs", "income": "is", "cash": "cfs", "notes": "notes", "kpi": "kpi"}


def mapping_findings(mapping: DataFrame) -> DataFrame:
    """(field_id, code): keys that are missing or forbidden for a kind, wrong prefixes, repeated fields, versions below 1.

    mapping: field_id, statement, kind, variants, role, section, header, version.
    """
    there = lambda k: (F.size(k) > 0) if k == "variants" else F.col(k).isNotNull()
    tests = [F.when((F.col("kind") == kind) & ~F.coalesce(there(k), F.lit(False)), f"MISSING_KEY:{k}") for kind, keys in NEEDS.items() for k in keys]
    tests += [F.when((F.col("kind") == kind) & F.coalesce(there(k), F.lit(False)), f"FORBIDDEN_KEY:{k}") for kind, keys in FORBIDS.items() for k in keys]
    tests += [F.when(~F.coalesce(F.col("kind").isin(*NEEDS), F.lit(False)), "UNKNOWN_KIND"), F.when(F.coalesce(F.col("version"), F.lit(0)) < 1, "VERSION_TOO_LOW")]
    root = F.create_map(*(F.lit(x) for kv in STATEMENT_ROOTS.items() for x in kv))[F.col("statement")]
    tests.append(F.when(~F.coalesce(F.startswith("field_id", F.concat(root, F.lit("."))), F.lit(False)), "WRONG_PREFIX"))
    own = mapping.select("field_id", F.explode(F.filter(F.array(*tests), lambda c: c.isNotNull())).alias("code"))
    again = mapping.groupBy("field_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("field_id", F.lit("REPEATED_FIELD").alias("code"))
    return own.unionByName(again)


def of_statement(mapping: DataFrame, statement: str) -> DataFrame:
    """Rows of a mapping for one statement."""
    return mapping.filter(F.col("statement") == statement)


def snapshot(items: DataFrame, column: str) -> DataFrame:
    """(n, sha256): how many distinct values a catalogue has, and the digest of their set (``evidence.set_digest``)."""
    return evidence.set_digest(items, column)


def versions(definitions: DataFrame) -> DataFrame:
    """(metric_id, version): the version of every metric as it is now, the highest where an id comes twice."""
    return definitions.filter("metric_id IS NOT NULL").groupBy("metric_id").agg(F.max("version").alias("version"))


def fingerprints(definitions: DataFrame) -> DataFrame:
    """(metric_id, version, fingerprint): the digest of all that a definition says but for its prose.

    Prose is the derivation's note, the pitfalls' text and the conditions' reasons; every
    other column is kept, also ones that are added later.
    """
    prose = {
        "derivation": F.struct(F.col("derivation.allow").alias("allow")),
        "pitfalls": F.transform("pitfalls", lambda p: F.struct(p["enforced_by"].alias("enforced_by"), p["advisory"].alias("advisory"))),
        "conditions": F.transform("conditions", lambda c: F.struct(c["expr"].alias("expr"))),
    }
    own = [c for c in sorted(definitions.columns) if c not in ("path", "parse_error")]
    said = F.to_json(F.struct(*((prose[c] if c in prose else F.col(c)).alias(c) for c in own)), {"ignoreNullFields": "false"})
    return definitions.select("metric_id", "version", F.sha2(said, 256).alias("fingerprint"))


def silent_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric_id): definitions that changed other than in prose without a new version."""
    both = before.join(after.select("metric_id", F.col("version").alias("v"), F.col("fingerprint").alias("f")), "metric_id")
    return both.filter((F.col("version") == F.col("v")) & (F.col("fingerprint") != F.col("f"))).select("metric_id")


def short_names(definitions: DataFrame) -> DataFrame:
    """(metric_id, field_id, short): a field's last part, or its whole path where two fields of a metric would share it."""
    rows = definitions.select("metric_id", F.explode(F.array_distinct("fields.id")).alias("field_id"))
    rows = rows.withColumn("last", F.element_at(F.split("field_id", r"\."), -1))
    shared = rows.groupBy("metric_id", "last").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(shared, ["metric_id", "last"])
    return rows.select("metric_id", "field_id", F.when(F.col("n") == 1, F.col("last")).otherwise(F.col("field_id")).alias("short"))


def text_findings(definitions: DataFrame) -> DataFrame:
    """(metric_id, code, place): texts of definitions that are no conditions or formulas, and what only their reading tells.

    R0.YAML_UNPARSEABLE stops the other rules. Texts are read where their definitions are, each once.
    """
    return _text_findings(spread(definitions, "metric_id", "path"))


def _text_findings(definitions: DataFrame) -> DataFrame:
    read = F.udf(_findings, "array<struct<code:string,place:string>>", useArrow=True)
    parts = F.struct("parse_error", "flags", "fields", "conditions", "pitfalls", "formula")
    rows = definitions.select(F.coalesce("metric_id", "path").alias("metric_id"), F.explode(read(parts)).alias("f"))
    return rows.select("metric_id", "f.code", "f.place")


@lru_cache(1 << 16)
def _unreadable(text: str, as_formula: bool = False) -> str | None:
    return expressions.unreadable(text, lambda p: KINDS.get(p, "number"), as_formula)


def _findings(d) -> list[tuple[str, str]]:
    """What is found in one definition."""
    if d["parse_error"] is not None:
        return [("R0.YAML_UNPARSEABLE", "")]
    found = [("R4.TRIGGER_UNPARSEABLE", f["name"]) for f in d["flags"] or () if f["trigger"] and _unreadable(f["trigger"])]
    found += [("R6.ENUM_WITHOUT_VALUES", f["id"]) for f in d["fields"] or () if f["kind"] == "enum" and not f["values"]]
    found += [("R7.EXPR_UNPARSEABLE", c["expr"]) for c in d["conditions"] or () if c["expr"] and _unreadable(c["expr"])]
    found += [("R8.ENFORCED_BY_UNRESOLVED", p["enforced_by"]) for p in d["pitfalls"] or () if p["enforced_by"] and p["enforced_by"].split("[")[0].split(".")[0] not in ENFORCERS]
    if d["formula"] and _unreadable(d["formula"], True):
        found.append(("FORMULA_UNPARSEABLE", ""))
    return found


def all_findings(definitions: DataFrame, terms: rules.Terms) -> DataFrame:
    """(metric_id, code, place): what the rules and the reading of the texts find, once each; the one call that validates a catalogue.

    definitions: SCHEMA with ``path`` and ``parse_error``. Of one that can't be read at all nothing else is found.
    Grain and semantics are those of ``terms`` where SCHEMA has none of them.
    """
    definitions = spread(definitions, "metric_id", "path")
    rows = definitions.filter("parse_error IS NULL")
    for name, kind in (("grain", "map<string,string>"), ("semantics", "string")):
        if name not in rows.columns:
            given = F.create_map(*(F.lit(x) for k in terms.grain for x in (k, terms.period_types[0]))) if name == "grain" else F.lit(terms.semantics[0])
            rows = rows.withColumn(name, given.cast(kind))
    refs = F.udf(lambda trigger: [p for p in reading.named(trigger or "") if p.split(".")[0] in expressions.DATA_ROOTS], "array<string>", useArrow=True)
    flags = F.transform("flags", lambda f: F.struct(f["name"].alias("name"), F.array().cast("array<string>").alias("refs")))
    ruled = rules.findings(rows.withColumn("flags", flags), terms)
    triggers = rows.select("metric_id", "fields", F.explode("flags").alias("f")).select("metric_id", "fields", "f.name", refs("f.trigger").alias("refs"))
    triggers = triggers.select("metric_id", "fields", "name", F.explode(F.array_distinct("refs")).alias("ref"))
    ids = F.coalesce(F.transform("fields", lambda f: f["id"]), F.array().cast("array<string>"))
    undeclared = triggers.filter(~F.array_contains(ids, F.col("ref"))).select("metric_id", F.lit("R4.TRIGGER_UNDECLARED_FIELD").alias("code"), F.concat_ws(":", "name", "ref").alias("place"))
    return ruled.unionByName(undeclared).unionByName(_text_findings(definitions)).distinct()


def deferred_flags(definitions: DataFrame) -> DataFrame:
    """(metric_id, flag, deferred): the flags of definitions, and whether only two compared periods can decide them."""
    late = F.udf(metrics.deferred, "boolean", useArrow=True)
    return spread(definitions, "metric_id").select("metric_id", F.explode("flags").alias("f")).filter("f.trigger IS NOT NULL").select("metric_id", F.col("f.name").alias("flag"), late("f.trigger").alias("deferred"))


#: Checks of the gate in their order, as (name, code).
CHECKS = (
    ("conformant", "DEFINITION_NONCONFORMANT"),
    ("version", "CROSS_VERSION_COMPARISON"),
    ("closed", "UNEVALUABLE_CONDITION"),
    ("namespace", "UNEVALUABLE_CONDITION"),
    ("declared", "UNEVALUABLE_CONDITION"),
)


def gate(requests: DataFrame, definitions: DataFrame) -> DataFrame:
    """requests (metric_id, expected_version, ...) with version, referenced, gate, failed_check and refusal_code.

    All texts that would be evaluated are read before: the conditions, the formula and
    the triggers. Passed and refused requests carry the same trace. A null expected
    version asks for none.
    """
    known = []
    for r in definitions.collect():  # the catalogue
        texts = [c["expr"] for c in r["conditions"] or () if c["expr"]] + [f["trigger"] for f in r["flags"] or () if f["trigger"]]
        every = [*texts, *([r["formula"]] if r["formula"] else [])]
        readable = [t for t in every if not expressions.unreadable(t, lambda p: KINDS.get(p, "number"), t == r["formula"])]
        paths = list(dict.fromkeys(p for t in every for p in reading.named(t)))
        spaces = [p for p in paths if p.split(".")[0] not in expressions.DATA_ROOTS + expressions.OWN_ROOTS]
        own = {f["id"] for f in r["fields"] or ()}
        undeclared = [p for p in paths if p.split(".")[0] in expressions.DATA_ROOTS and p not in own]
        closed = len(readable) == len(every) or bool(spaces)
        known.append((r["metric_id"], r["version"], ",".join(paths), r["parse_error"] is None, closed, not spaces, not undeclared))
    schema = "metric_id string, version int, referenced string, conformant boolean, closed boolean, namespace boolean, declared boolean"
    table = definitions.sparkSession.createDataFrame(known, schema)
    rows = requests.join(F.broadcast(table), "metric_id", "left")  # one row for each definition
    passes = {"version": F.col("expected_version").isNull() | (F.col("expected_version") == F.col("version"))}
    failed, code = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, refusal in reversed(CHECKS):
        bad = ~passes.get(name, F.col(name))
        failed, code = F.when(bad, name).otherwise(failed), F.when(bad, refusal).otherwise(code)
    unknown = F.col("conformant").isNull()
    rows = rows.withColumn("failed_check", F.when(unknown, "resolve").otherwise(failed))
    rows = rows.withColumn("refusal_code", F.when(unknown, "METRIC_NOT_DEFINED").otherwise(code))
    rows = rows.withColumn("gate", F.when(F.col("failed_check").isNull(), "passed").otherwise("refused"))
    return rows.drop("conformant", "closed", "namespace", "declared")


def rows(spark: SparkSession, definitions: Iterable[Definition]) -> DataFrame:
    """Compiled definitions as rows of SCHEMA, with all that their texts read declared."""
    out = []
    for d in definitions:
        texts = [t for t in (d.formula, *d.conditions, *(t for _, t in d.flags)) if t]
        paths = list(dict.fromkeys(p for t in texts for p in reading.named(t)))
        out.append((
            "", d.metric_id, d.display, list(d.aliases), d.version, d.formula,
            [(p, "gain-positive", "null", KINDS.get(p, "number"), None) for p in paths], [(c, c) for c in d.conditions], list(d.flags),
            [("standard", "1")], (False, "by definition"), [("p", "undefined_conditions", None)] * 3, None,
        ))
    return spark.createDataFrame(out, f"path string, {SCHEMA}, parse_error string")


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""
