"""All metrics of all entities and periods in one plan; refusals are columns.

Two paths share the compiled definitions. An answer runs the refusal conditions and
refuses where a flag can't be decided; a computation needs a passed reconciliation, runs
no conditions, and records undecided flags beside the value.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricspark.operators import checks, exact, expressions
from metricspark.operators.expressions import Unreadable
from metricspark.plans.definitions import DEFINITIONS, KINDS, Definition
from metricspark.sources.statements import FLAG_FIELDS

#: The ten codes of refusals.
CODES = (
    "METRIC_NOT_DEFINED", "ALIAS_AMBIGUOUS", "DEFINITION_NONCONFORMANT", "UNDEFINED_CONDITION_HIT", "UNEVALUABLE_CONDITION",
    "CROSS_VERSION_COMPARISON", "CROSS_BASIS_VERSION_COMPARISON", "UNAVAILABLE", "RECONCILIATION_FAILED", "INTENT_INCOMPLETE",
)
#: Fixed value: what stands for the unit of a ratio.
NO_UNIT = "无量纲"


def column(path: str) -> str:
    return path.replace(".", "_")


def texts(d: Definition) -> list[str]:
    return [t for t in (d.formula, *d.conditions, *(x for _, x in d.flags)) if t]


def paths(d: Definition) -> set[str]:
    """Fields that a definition's readable texts name."""
    found: set[str] = set()
    for t in texts(d):
        try:
            found |= set(expressions.fields(t))
        except Unreadable:
            continue  # refused at its place, see ``metric``
    return found


def used(definitions: Iterable[Definition], statements: DataFrame) -> list[str]:
    """Cells of the statements that the definitions read, in the statements' order."""
    wanted = {column(p) for d in definitions for p in paths(d)}
    return [f.name for f in statements.schema.fields if f.name in wanted and f.dataType.typeName() == "struct"]


def row_struct(cells: list[str], flags: list[str]) -> str:
    """Each field's amount and state once, as one struct: what metrics read of a statement."""
    parts = [f"'{f}', {expressions.readable_sql(f)}, '{f}__state', {f}.state" for f in cells]
    return "named_struct(" + ", ".join([*(f"'{f}', {f}" for f in flags), *parts, "'', ''"]) + ")"


class Row:
    """How the fields of a statement, the struct ``a``, are read; one that statements don't have is missing everywhere."""

    def __init__(self, cells: list[str], flags: list[str], missing: dict[str, object]):
        self.cells, self.flags, self.missing = set(cells), set(flags), missing

    def amount(self, path: str) -> str:
        return f"a.{column(path)}" if column(path) in self.cells else "CAST(NULL AS DECIMAL(28,6))"

    def state(self, path: str) -> str:
        return f"a.{column(path)}__state" if column(path) in self.cells else "CAST(NULL AS STRING)"

    def cell(self, path: str) -> tuple[str, str]:
        """A field for conditions: its expression, null if missing or of the value that stands for that, and its kind."""
        kind = KINDS.get(path, "number")
        there = f"a.{column(path)}" if column(path) in self.flags else self.amount(path)
        if there.startswith("CAST") and kind != "number":
            there = f"CAST(NULL AS {kind.upper()})"
        stands = self.missing.get(path)
        if stands is None or expressions.kind(stands) != kind:
            return there, kind
        return f"nullif({there}, {expressions.literal(stands)})", kind


def deferred(trigger: str) -> bool:
    """A flag on two periods compared; one period can't decide it."""
    try:
        return any(p.startswith("comparison_period.") for p in expressions.fields(trigger))
    except Unreadable:
        return False


def condition(text: str, row: Row) -> str:
    """A condition that can't be read is never decided; an empty one never holds."""
    if not text:
        return "false"
    try:
        return expressions.condition(text, row.cell)
    except Unreadable:
        return "CAST(NULL AS BOOLEAN)"


def formula(text: str | None, row: Row) -> tuple[exact.Program, list[str], bool]:
    """(program, name spaces, whether it is a ratio); without a formula the definition itself is refused."""
    if not text:
        return exact.Program([exact.refused("'DEFINITION_NONCONFORMANT'")], []), [], False
    try:
        spaces = sorted({p.split(".")[0] for p in expressions.fields(text)})
        return expressions.formula(text, row.amount, row.state), spaces, expressions.is_ratio(text)
    except Unreadable:
        return exact.Program([exact.refused("'UNEVALUABLE_CONDITION'")], []), [], False


def metric(d: Definition, row: Row) -> str:
    """Struct of one metric over ``a``: conditions, the formula's numbers and steps, triggers of flags, undecided where null."""
    program, spaces, ratio = formula(d.formula, row)
    numbers, steps = program.sql()
    triggers = [f"named_struct('name', {expressions.literal(name)}, 'on', {condition(t, row)})" for name, t in d.flags if t and not deferred(t)]
    return f"""named_struct('metric_id', {expressions.literal(d.metric_id)}, 'version', CAST({expressions.literal(None) if d.version is None else d.version} AS INT),
      'conditions', CAST(array({", ".join(condition(c, row) for c in d.conditions)}) AS ARRAY<BOOLEAN>), 'numbers', {numbers}, 'steps', {steps},
      'triggers', CAST(array({", ".join(triggers)}) AS ARRAY<STRUCT<name: STRING, on: BOOLEAN>>),
      'roots', CAST(array({", ".join(f"'{r}'" for r in spaces)}) AS ARRAY<STRING>), 'ratio', {expressions.literal(ratio)})"""


def evaluated(statements: DataFrame, definitions: tuple[Definition, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """(suppkey, entity, period, *keep, m.*, value, amount): a row for each statement and metric.

    No shuffle: the metrics are structs of one projection, exploded in place. Generating
    the row's amounts first keeps each of them from being written out in every metric.
    ``value`` has all 28 digits, as text; ``amount`` ten places, null beyond 28 digits before them.
    """
    keys = ["suppkey", "entity", "period", *keep]
    cells, flags = used(definitions, statements), [f for f in FLAG_FIELDS if f in statements.columns]
    rows = statements.selectExpr(*keys, f"explode(array({row_struct(cells, flags)})) AS a")
    compiled = ", ".join(metric(d, Row(cells, flags, dict(d.missing))) for d in definitions)
    rows = rows.selectExpr(*keys, f"explode(array({compiled})) AS m").select(*keys, "m.*")
    # Generated, so that no filter on a value is pushed below and works the number out for each use of it.
    out = [c for c in rows.columns if c not in ("numbers", "steps")]
    rows = rows.selectExpr(*out, f"explode(array({exact.value_of('numbers', 'steps', 'UNEVALUABLE_CONDITION')})) AS number")
    far = f"number.c <> 0 AND abs(length(CAST(abs(number.c) AS STRING)) + number.e) > {exact.FARTHEST}"
    rows = rows.withColumn("operand", F.expr(f"IF({far}, 'UNEVALUABLE_CONDITION', number.code)"))
    rows = rows.withColumn("value", F.expr(f"IF(operand IS NULL, {exact.shown('number')}, NULL)"))
    return rows.withColumn("amount", F.expr("try_cast(value AS DECIMAL(38,10))")).drop("number")


def first(items: Column, hit) -> Column:
    """Place of the first item that ``hit`` holds for, from 0; null if none."""
    return F.nullif(F.array_position(F.transform(items, hit), F.lit(True)), F.lit(0)) - 1


def on(triggers: Column) -> Column:
    """Names of the flags that are on, sorted; null if one can't be decided."""
    names = F.array_sort(F.transform(F.filter(triggers, lambda x: x["on"]), lambda x: x["name"]))
    return F.when(~F.exists(triggers, lambda x: x["on"].isNull()), names)


def metric_values(statements: DataFrame, definitions: tuple[Definition, ...] = DEFINITIONS) -> DataFrame:
    """Answers: (suppkey, entity, period, metric_id, version, value, amount, refusal_code, condition_index, flags).

    In this order refuse: the first condition that holds, can't be decided or can't be read,
    with its index; the first operand of the formula, or the formula itself; flags that
    can't be decided. ``value`` is a text of 28 significant digits, ``amount`` a decimal.
    A row has a value or a refusal, never both and never neither.
    """
    m = evaluated(statements, definitions)
    m = m.withColumn("condition_index", first(F.col("conditions"), lambda c: F.coalesce(c, F.lit(True))).cast("int"))
    m = m.withColumn("flags", on(F.col("triggers")))
    hit = F.when(F.get("conditions", "condition_index").isNull(), "UNEVALUABLE_CONDITION").otherwise("UNDEFINED_CONDITION_HIT")
    code = F.when(F.col("condition_index").isNotNull(), hit).when(F.col("operand").isNotNull(), F.col("operand"))
    code = code.when(F.col("flags").isNull(), "UNEVALUABLE_CONDITION")
    m = m.withColumn("refusal_code", code)
    return m.select(
        "suppkey", "entity", "period", "metric_id", "version",
        *(F.when(F.col("refusal_code").isNull(), F.col(c)).alias(c) for c in ("value", "amount")),
        "refusal_code", "condition_index", "flags",
    )


def computed_metrics(statements: DataFrame, definitions: tuple[Definition, ...] = DEFINITIONS) -> DataFrame:
    """Computations: (entity, period, metric_id, version, value, amount, unit, refusal_code, source, flags, flags_status).

    In this order refuse: a reconciliation that hasn't run or hasn't passed, the first
    operand or division, inputs of several units. ``flags_status`` is unevaluable where a
    trigger can't be decided; that refuses nothing here.
    """
    gated = statements.withColumn("passed", checks.balanced())
    m = evaluated(gated, definitions, ("gate_ran", "passed", "cfs_unit"))
    units = F.array_distinct(F.transform("roots", lambda r: F.when(r == "cfs", F.col("cfs_unit")).otherwise("元")))
    m = m.withColumn("units", units).withColumn("on", on(F.col("triggers")))
    source = F.when(~F.coalesce("gate_ran", F.lit(False)), "reconcile:not_run").when(~F.col("passed"), "reconcile:balance_sheet_identity")
    source = source.when(F.col("operand").isNotNull() | (F.size("units") > 1), "formula")
    m = m.withColumn("source", source)
    code = F.when(F.startswith("source", F.lit("reconcile")), "RECONCILIATION_FAILED").when(F.col("operand").isNotNull(), F.col("operand"))
    m = m.withColumn("refusal_code", code.when(F.size("units") > 1, "UNEVALUABLE_CONDITION"))
    passed = F.col("refusal_code").isNull()
    return m.select(
        "entity", "period", "metric_id", "version",
        *(F.when(passed, F.col(c)).alias(c) for c in ("value", "amount")),
        F.when(passed, F.when(F.col("ratio"), NO_UNIT).otherwise(F.get("units", F.lit(0)))).alias("unit"),
        "refusal_code", "source",
        F.when(passed, F.coalesce("on", F.array().cast("array<string>"))).alias("flags"),
        F.when(passed, F.when(F.col("on").isNull(), "unevaluable").otherwise("evaluated")).alias("flags_status"),
    )


def metric_inputs(statements: DataFrame, definitions: tuple[Definition, ...] = DEFINITIONS) -> DataFrame:
    """(entity, period, metric_id, pos, field_id, state, amount): a formula's operands from left to right, repeats included; none of one that can't be read."""
    cells = used(definitions, statements)
    listed = []
    for d in definitions:
        if not expressions.unreadable(d.formula or "", as_formula=True):
            listed += [f"named_struct('metric_id', {expressions.literal(d.metric_id)}, 'pos', {i}, 'field_id', '{p}')" for i, p in enumerate(expressions.fields(d.formula))]
    none = "named_struct('state', CAST(NULL AS STRING), 'amount', CAST(NULL AS DECIMAL(28,6)))"
    each = ", ".join([f"'', {none}", *(f"'{f}', named_struct('state', {f}.state, 'amount', {expressions.readable_sql(f)})" for f in cells)])
    rows = statements.selectExpr("entity", "period", f"map({each}) AS cells", f"explode(CAST(array({', '.join(listed)}) AS ARRAY<STRUCT<metric_id: STRING, pos: INT, field_id: STRING>>)) AS x")
    return rows.selectExpr("entity", "period", "x.*", "cells[replace(x.field_id, '.', '_')] AS c").select("entity", "period", "metric_id", "pos", "field_id", "c.*")
