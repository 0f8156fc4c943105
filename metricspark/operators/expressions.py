"""Conditions and formulas of metric definitions, given as text, compiled to Spark SQL expressions.

A condition is true, false or, where an operand is missing, undecided: it is null then. ``and``
and ``or`` look at their right side only when the left leaves it open, so an undecided left
side is never hidden, unlike in SQL's three-valued logic. Texts that can't be read raise
``Unreadable``; plans refuse at their place. Every part of a text is written once, so that
expressions grow as their texts do.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal, localcontext

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricspark.operators import exact, reading
from metricspark.operators.reading import DATA_ROOTS, OWN_ROOTS, Unreadable

__all__ = ["ABSENT", "DATA_ROOTS", "EMPTY", "OWN_ROOTS", "UNKNOWN", "VALUE", "Unreadable", "condition", "fields", "formula", "is_ratio", "literal", "readable", "readable_sql", "unreadable"]

Cell = Callable[[str], tuple[str, str]]
#: Places of an amount, and its digits before them.
PLACES, BEFORE = 6, 22


def kind(value) -> str:
    return {bool: "boolean", str: "string"}.get(type(value), "number")


def literal(value) -> str:
    if value is None or isinstance(value, bool):
        return {None: "NULL", True: "true", False: "false"}[value]
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"({value:f})" if value < 0 else f"{value:f}"


def condition(text: str, cell: Cell) -> str:
    """The condition as a boolean expression, null where it can't be decided.

    ``cell(path)`` gives a field's expression, null where it is missing, and its kind: number,
    boolean or string. Equality across kinds is false; an order across kinds is unreadable.
    Numbers of fields have at most six places.
    """
    return _condition(reading.condition(text), cell)


def _condition(node: reading.Node, cell: Cell) -> str:
    if isinstance(node, reading.Missing):
        return f"({cell(node.path)[0]} IS NULL)"
    if isinstance(node, reading.Negated):
        return f"(NOT {_condition(node.part, cell)})"
    if isinstance(node, reading.Compared):
        return _compared(node, cell)
    *parts, out = (_condition(p, cell) for p in node.parts)
    for left in reversed(parts):
        # The left side as a place in a list: where it is null, so is what stands there.
        sides = f"false, {out}" if isinstance(node, reading.Every) else f"{out}, true"
        out = f"get(array({sides}), CAST({left} AS INT))"
    return out


#: What turns a comparison round.
TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}


def _compared(node: reading.Compared, cell: Cell) -> str:
    sign, left, right = node
    if isinstance(left, reading.Value) and isinstance(right, reading.Field):
        sign, left, right = TURNED[sign], right, left
    if isinstance(left, reading.Value):
        return literal(_constant(sign, left.value, right.value))
    a, ka = cell(left.path)
    if isinstance(right, reading.Field):
        b, kb = cell(right.path)
        if ka == kb:
            return f"({a} {sign} {b})"
        return _unlike(sign, ka, kb, f"{a} IS NULL OR {b} IS NULL")
    if right.value is None:
        # A present value differs from null; null has no place in an order.
        return _decided(sign == "!=", f"{a} IS NULL") if sign in ("==", "!=") else "CAST(NULL AS BOOLEAN)"
    if ka != kind(right.value):
        return _unlike(sign, ka, kind(right.value), f"{a} IS NULL")
    return _against_number(sign, a, right.value) if ka == "number" else f"({a} {sign} {literal(right.value)})"


def _decided(value: bool, missing: str) -> str:
    return f"IF({missing}, CAST(NULL AS BOOLEAN), {literal(value)})"


def _unlike(sign: str, ka: str, kb: str, missing: str) -> str:
    if sign not in ("==", "!="):
        raise Unreadable(f"{ka} {sign} {kb}")
    return _decided(sign == "!=", missing)


def _constant(sign: str, a, b) -> bool | None:
    if a is None or b is None:
        return (a is b) == (sign == "==") if sign in ("==", "!=") else None
    if kind(a) != kind(b):
        if sign not in ("==", "!="):
            raise Unreadable(f"{kind(a)} {sign} {kind(b)}")
        return sign == "!="
    return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[sign]


def _against_number(sign: str, a: str, value: Decimal) -> str:
    """A field against a literal of any length, exactly: what lies between two amounts is moved to the nearer one on the right side."""
    if abs(value) >= 10**BEFORE:
        return _decided(sign in ("!=", "<", "<=") if value > 0 else sign in ("!=", ">", ">="), f"{a} IS NULL")
    with localcontext() as c:
        c.prec = 100 + len(value.as_tuple().digits)
        place = Decimal(1).scaleb(-PLACES)
        low, high = value.quantize(place, ROUND_FLOOR), value.quantize(place, ROUND_CEILING)
    if low != high:
        if sign in ("==", "!="):
            return _decided(sign == "!=", f"{a} IS NULL")
        sign, low = {"<": ("<=", low), "<=": ("<=", low), ">": (">=", high), ">=": (">=", high)}[sign]
    return f"({a} {sign} CAST({literal(low)} AS DECIMAL(28,6)))"


def fields(text: str) -> list[str]:
    """Fields of a condition or formula from left to right, repeats included; ``Unreadable`` if it is neither."""
    return reading.paths(reading.either(text))


#: How a cell was found.
VALUE, EMPTY, ABSENT, UNKNOWN = "VALUE_PRESENT", "EMPTY_CELL", "ROW_ABSENT", "UNKNOWN"


def readable(cell: Column) -> Column:
    """The amount that arithmetic may use: an empty cell is 0, an absent or unknown one null."""
    return F.when(cell["state"] == VALUE, cell["v"]).when(cell["state"] == EMPTY, F.lit(0).cast("decimal(28,6)"))


def readable_sql(name: str) -> str:
    """``readable`` of the cell in a column, as text."""
    return f"CASE {name}.state WHEN '{VALUE}' THEN {name}.v WHEN '{EMPTY}' THEN CAST(0 AS DECIMAL(28,6)) END"


def formula(text: str, amount: Callable[[str], str], state: Callable[[str], str]) -> exact.Program:
    """A formula as a program of exact numbers: its value has 28 significant digits, or the code of the first refusal.

    Operands come from left to right. A field without a record is UNAVAILABLE, one that is
    unknown, absent or no number UNEVALUABLE_CONDITION; a division by zero is for ``exact.run``.
    """
    # Numbers come before the results of steps, so places of results are known once all numbers are.
    numbers: list[str] = []
    steps: list[tuple[str, object, object]] = []

    def leaf(number: str) -> tuple[str, int]:
        numbers.append(number)
        return "number", len(numbers) - 1

    def result(sign: str, left, right) -> tuple[str, int]:
        steps.append((sign, left, right))
        return "step", len(steps) - 1

    def code(path: str) -> str:
        return f"IF({state(path)} IS NULL, 'UNAVAILABLE', IF({amount(path)} IS NULL, 'UNEVALUABLE_CONDITION', NULL))"

    def one(node: reading.Node) -> tuple[str, int]:
        if isinstance(node, reading.Sum) and all(isinstance(part, reading.Field) for _, part in node.parts) and len(node.parts) <= exact.TERMS:
            return leaf(exact.sum_of_amounts([(sign, amount(part.path), code(part.path)) for sign, part in node.parts]))
        if isinstance(node, reading.Sum | reading.Product):
            (_, first), *rest = node.parts
            left = one(first)
            for sign, part in rest:
                left = result(sign, left, one(part))
            return left
        if isinstance(node, reading.Minus):
            return result("-", leaf(exact.number("0", 0)), one(node.part))
        if isinstance(node, reading.Field):
            why = code(node.path)
            return leaf(f"IF({why} IS NOT NULL, {exact.refused(why)}, {exact.of_amount(amount(node.path))})")
        try:
            return leaf(exact.constant(node.value))
        except ValueError as e:
            raise Unreadable(str(e)) from e

    one(reading.formula(text))
    place = lambda x: x[1] if x[0] == "number" else len(numbers) + x[1]
    return exact.Program(numbers, [(sign, place(left), place(right)) for sign, left, right in steps])


def is_ratio(text: str) -> bool:
    """True if the outermost operation divides: the result has no unit then."""
    node = reading.formula(text)
    return isinstance(node, reading.Product) and node.parts[-1][0] == "/"


def unreadable(text: str, types: Callable[[str], str] = lambda _: "number", as_formula: bool = False) -> str | None:
    """Why a text is no condition (or formula), null if it is one. Needs no session."""
    try:
        if as_formula:
            formula(text, lambda p: p, lambda p: p)
        else:
            condition(text, lambda p: (p, types(p)))
    except Unreadable as e:
        return str(e)
    return None
