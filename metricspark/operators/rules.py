"""Rules that metric definitions must keep; each breach is a row, and none stops the others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pitfalls that a definition must name at least, and its least version.
PITFALLS, VERSION = 3, 2

SCHEMA = (
    "metric_id string, version int, grain map<string,string>, semantics string, formula string,"
    " fields array<struct<id:string,sign:string,missing:string>>, derivation struct<allow:boolean,note:string>,"
    " flags array<struct<name:string,refs:array<string>>>, basis array<struct<name:string,version:string>>,"
    " conditions array<struct<expr:string,reason:string>>, pitfalls array<struct<enforced_by:string,advisory:boolean>>"
)


@dataclass(frozen=True)
class Terms:
    """The words that definitions may use; ``flags`` are those declared, ``system`` those set at run time."""

    grain: tuple[str, ...]
    period_types: tuple[str, ...]
    semantics: tuple[str, ...]
    signs: tuple[str, ...]
    flags: tuple[str, ...]
    system: tuple[str, ...]


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def one(hit: Column, code: str, place: Column) -> tuple[Column, Column]:
    """Zero or one finding; an undecided test finds nothing."""
    return F.array(F.struct(F.lit(code).alias("code"), place.cast("string").alias("place"))), F.coalesce(hit, F.lit(False))


def many(items: Column, hit, code: str, place) -> tuple[Column, Column]:
    """A finding for each item that ``hit`` holds for; a null list has no items."""
    found = F.filter(items, lambda x: F.coalesce(hit(x), F.lit(False)))
    rows = F.transform(found, lambda x: F.struct(F.lit(code).alias("code"), place(x).cast("string").alias("place")))
    return rows, found.isNotNull()


def findings(definitions: DataFrame, terms: Terms) -> DataFrame:
    """(metric_id, code, place) of all breaches of definitions of the form SCHEMA.

    A null or empty part counts as absent; no definitions give no rows. All rules are
    lists of one projection, so nothing is shuffled however many definitions there are.
    """
    c, here = F.col, F.lit("")
    ids = F.transform("fields", lambda f: f["id"])
    period_type = c("grain")["period_type"]
    used = lambda f: F.contains(c("formula"), f["id"])
    enforced = lambda p: ~blank(p["enforced_by"])
    advisory = lambda p: F.coalesce(p["advisory"], F.lit(False))
    gone = lambda items: F.coalesce(F.size(items) <= 0, F.lit(True))
    undeclared = F.flatten(F.transform("flags", lambda f: F.transform(F.array_distinct(f["refs"]), lambda r: F.struct(f["name"].alias("name"), r.alias("ref")))))
    empty = F.flatten(
        F.transform("basis", lambda b: F.filter(F.array(F.when(blank(b["name"]), F.lit("name")), F.when(blank(b["version"]), F.lit("version"))), lambda x: x.isNotNull()))
    )
    rules = [
        *(one(blank(c("grain")[k]) | c("grain").isNull(), "R1.MISSING_GRAIN", F.lit(k)) for k in terms.grain),
        one(~period_type.isin(*terms.period_types), "R1.BAD_PERIOD_TYPE", F.lit("period_type")),
        one(c("semantics").isNull() | ~c("semantics").isin(*terms.semantics), "R1.BAD_PERIOD_TYPE", F.lit("semantics")),
        many(c("fields"), lambda f: used(f) & blank(f["sign"]), "R2.NO_SIGN_CONVENTION", lambda f: f["id"]),
        many(c("fields"), lambda f: used(f) & ~blank(f["sign"]) & ~f["sign"].isin(*terms.signs), "R2.BAD_SIGN_CONVENTION", lambda f: f["id"]),
        one(c("derivation").isNull(), "R3.DERIVATION_MISSING", here),
        one(c("derivation").isNotNull() & c("derivation.allow").isNull(), "R3.DERIVATION_NOT_BOOLEAN", here),
        one(c("derivation").isNotNull() & blank(c("derivation.note")), "R3.DERIVATION_NOTE_EMPTY", here),
        one(c("flags").isNull(), "R4.FLAGS_KEY_MISSING", here),
        many(c("flags"), lambda f: ~f["name"].isin(*terms.flags, *terms.system), "R4.FLAG_NOT_IN_VOCABULARY", lambda f: f["name"]),
        many(c("flags"), lambda f: f["name"].isin(*terms.system), "R4.SYSTEM_SCOPE_FLAG_DECLARED", lambda f: f["name"]),
        many(undeclared, lambda x: ~F.array_contains(F.coalesce(ids, F.array().cast("array<string>")), x["ref"]), "R4.TRIGGER_UNDECLARED_FIELD", lambda x: F.concat_ws(":", x["name"], x["ref"])),
        one(gone(c("basis")), "R5.BASIS_NOT_STRUCTURED", here),
        many(empty, lambda x: x.isNotNull(), "R5.BASIS_FIELD_EMPTY", lambda x: x),
        many(c("fields"), lambda f: blank(f["missing"]), "R6.NO_MISSING_REPRESENTATION", lambda f: f["id"]),
        one(gone(c("conditions")), "R7.NO_UNDEFINED_CONDITIONS", here),
        many(c("conditions"), lambda x: blank(x["reason"]), "R7.REASON_EMPTY", lambda x: x["expr"]),
        one(F.coalesce(F.size("pitfalls"), F.lit(0)) < PITFALLS, "R8.TOO_FEW_PITFALLS", here),
        many(c("pitfalls"), lambda p: enforced(p) & advisory(p), "R8.BOTH_ENFORCED_AND_ADVISORY", lambda p: p["enforced_by"]),
        many(c("pitfalls"), lambda p: ~enforced(p) & ~advisory(p), "R8.PITFALL_UNBACKED", lambda p: here),
        one(c("version").isNull(), "R9.VERSION_NOT_INT", here),
        one(c("version") < VERSION, "R9.VERSION_TOO_LOW", here),
    ]
    none = F.array().cast("array<struct<code:string,place:string>>")
    found = F.concat(*(F.when(hit, rows.cast("array<struct<code:string,place:string>>")).otherwise(none) for rows, hit in rules))
    return definitions.select("metric_id", F.explode(found).alias("f")).select("metric_id", "f.code", "f.place")
