"""Decimal arithmetic of 28 significant digits by Spark SQL expressions.

A number is a struct of a refusal code, a whole number ``c`` of at most 28 digits and an
exponent ``e`` of ten; c is null where code isn't. Sums, products and quotients are
exact, then rounded half to even to 28 digits, as decimals are by default in many
languages. All of it is decimal(38, 0), which no step leaves, so nothing overflows under
ANSI or becomes null without it.
"""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

DIGITS = 28
WHOLE = "DECIMAL(38,0)"
TYPE = f"STRUCT<code: STRING, c: {WHOLE}, e: INT>"
#: Exponents that a result may have.
FARTHEST = 999_999

def number(c: str, e: str | int) -> str:
    return f"named_struct('code', CAST(NULL AS STRING), 'c', CAST({c} AS {WHOLE}), 'e', CAST({e} AS INT))"


def refused(code: str) -> str:
    """``code`` is an expression."""
    return f"named_struct('code', {code}, 'c', CAST(NULL AS {WHOLE}), 'e', CAST(NULL AS INT))"


def constant(value: Decimal) -> str:
    """A literal; ``ValueError`` if it has more digits than a number."""
    sign, digits, e = value.as_tuple()
    whole = "".join(map(str, digits)).lstrip("0")
    short = whole.rstrip("0")
    if len(short) > DIGITS:
        raise ValueError(f"{value} has more than {DIGITS} digits")
    return number(("-" if sign and short else "") + (short or "0"), e + len(whole) - len(short) if short else 0)


def of_amount(amount: str) -> str:
    """The number of an amount with six places."""
    return number(f"CAST({amount} AS DECIMAL(28,6)) * CAST(1000000 AS DECIMAL(7,0))", -6)


def ten(n: str) -> str:
    """Ten to the power of n, from 0 to 37."""
    return f"CAST(rpad('1', {n} + 1, '0') AS {WHOLE})"


def length(c: str) -> str:
    return f"length(CAST(abs({c}) AS STRING))"


def over(a: str, b: str) -> str:
    """The whole quotient of a by b, rounded down; b is positive."""
    return f"CAST(({a} - pmod({a}, {b})) / {b} AS {WHOLE})"


#: Terms of a sum of amounts that is one number of a program.
TERMS = 100


def sum_of_amounts(terms: list[tuple[str, str, str]]) -> str:
    """The number of a sum of amounts (sign, amount, code), a program's shorter way: each partial sum is rounded to 28 digits.

    Amounts are below 10**22 and have six places, so sums of TERMS of them have 25 digits before the point at most.
    """
    code = f"coalesce({', '.join(code for _, _, code in terms)})"
    amounts = ", ".join(f"CAST({'-' if sign == '-' else ''}{amount} AS DECIMAL(38,6))" for sign, amount, _ in terms)
    t = "CAST(s + t AS DECIMAL(38,6))"
    limit = lambda digits: f"CAST({ten(str(digits))} AS DECIMAL(38,6))"
    cut = lambda places: f"CAST(bround({t}, {places}) AS DECIMAL(38,6))"
    partial = f"IF(abs(s + t) < {limit(22)}, {t}, IF(abs(s + t) < {limit(23)}, {cut(5)}, IF(abs(s + t) < {limit(24)}, {cut(4)}, {cut(3)})))"
    # A rounded sum of more digits before the point has three places at most.
    short, long = number("s * CAST(1000000 AS DECIMAL(7,0))", -6), number("s * CAST(1000 AS DECIMAL(4,0))", -3)
    total = f"aggregate(array({amounts}), CAST(0 AS DECIMAL(38,6)), (s, t) -> {partial}, s -> IF(abs(s) < {limit(22)}, {short}, {long}))"
    return f"IF({code} IS NOT NULL, {refused(code)}, {total})"


class Program(NamedTuple):
    """Numbers, and steps (sign, left, right) over the places of numbers and of earlier results."""

    numbers: list[str]
    steps: list[tuple[str, int, int]]

    def sql(self) -> tuple[str, str]:
        steps = ", ".join(f"named_struct('sign', '{s}', 'l', {l}, 'r', {r})" for s, l, r in self.steps)
        numbers = ", ".join(f"CAST({n} AS {TYPE})" for n in self.numbers)
        return f"array({numbers})", f"CAST(array({steps}) AS ARRAY<STRUCT<sign: STRING, l: INT, r: INT>>)"


def chain(start: str, *stages: dict[str, str]) -> str:
    """Structs made one from the other; each stage is flat and reads the one before as ``r``.

    What is needed twice is a field, so nothing is written or computed again, and stages
    aren't nested in one another's bodies, whose types Spark would work out over and over.
    """
    fields = lambda stage: ", ".join(f"'{name}', {sql}" for name, sql in stage.items())
    out = f"array({start})"
    for stage in stages:
        out = f"transform({out}, r -> named_struct({fields(stage)}))"
    return f"{out}[0]"


def step(by_zero: str) -> str:
    """The number of one step ``s`` over the numbers ``n``; ``by_zero`` is the code of a division by zero."""
    none = f"CAST(NULL AS {WHOLE})"
    half, full, e10, e9 = ten("14"), ten(str(DIGITS)), ten("10"), ten("9")
    pick = lambda sum_, product, quotient: f"CASE r.op WHEN '+' THEN {sum_} WHEN '*' THEN {product} WHEN '/' THEN {quotient} END"
    kept = lambda *names: {name: f"r.{name}" for name in names}
    operands = {
        "op": "IF(r.sign = '-', '+', r.sign)", "ac": "r.a.c", "ae": "r.a.e", "bc": "IF(r.sign = '-', -r.b.c, r.b.c)", "be": "r.b.e",
    }
    # A sum: the number that goes farther left, the other, how far apart they are, and how far the first may be moved.
    # A product: low and high halves of both. A quotient: both with 28 digits.
    whole = lambda x: f"abs({x}) * {ten(f'{DIGITS} - {length(x)}')}"
    first, alone = "(r.ac <> 0 AND (r.bc = 0 OR r.ae > r.be))", "(r.ac = 0 OR r.bc = 0)"
    registers = kept("op", "ac", "bc") | {
        "negative": "(r.ac < 0) <> (r.bc < 0)",
        "x": pick(f"IF({first}, r.ac, r.bc)", f"abs(r.ac) % {half}", whole("r.ac")),
        "y": pick(f"IF({alone}, CAST(0 AS {WHOLE}), IF({first}, r.bc, r.ac))", f"abs(r.bc) % {half}", whole("r.bc")),
        "xh": f"IF(r.op = '*', {over('abs(r.ac)', half)}, {none})",
        "yh": f"IF(r.op = '*', {over('abs(r.bc)', half)}, {none})",
        "apart": pick(f"IF({alone}, 0, abs(r.ae - r.be))", f"{length('r.ac')} + {length('r.bc')}", "0"),
        "room": pick(f"36 - {length(f'IF({first}, r.ac, r.bc)')}", "0", "0"),
        "e": pick(f"IF({alone}, IF({first}, r.ae, r.be), least(r.ae, r.be))", "r.ae + r.be", f"r.ae + {length('r.ac')} - r.be - {length('r.bc')}"),
    }
    # What a product's middle and lower parts are, and what a quotient's first two divisions leave.
    halves = kept("op", "ac", "bc", "negative", "x", "y", "xh", "yh", "apart", "room", "e") | {
        "mid": pick(none, "r.xh * r.y + r.x * r.yh", "r.x % r.y"),
        "low": pick(none, f"r.x * r.y + (r.xh * r.y + r.x * r.yh) % {half} * {half}", f"r.x % r.y * {e10} % r.y"),
    }
    below = f"least(r.apart - r.room, {DIGITS})"
    far = f"(r.x * {ten('r.room')} + IF(r.apart - r.room > {DIGITS}, IF(r.y < 0, -1, 0), {over('r.y', ten(below))})) * 10 + IF(r.apart - r.room > {DIGITS} OR pmod(r.y, {ten(below)}) <> 0, 1, 0)"
    last = f"(r.low * {e10} % r.y * {e9})"
    quotient = f"(((CAST(r.x div r.y AS {WHOLE}) * {e10} + (r.mid * {e10}) div r.y) * {e10} + (r.low * {e10}) div r.y) * {e9} + {last} div r.y)"
    combined = kept("op", "negative") | {
        "c": pick(
            f"IF(r.apart <= r.room, r.x * {ten('least(r.apart, r.room)')} + r.y, {far})", f"IF(r.apart <= 38, r.ac * r.bc, r.low % {full})",
            f"IF(r.negative, -1, 1) * ({quotient} * 10 + IF({last} % r.y > 0, 1, 0))",
        ),
        "upper": f"IF(r.op = '*' AND r.apart > 38, r.xh * r.yh + {over('r.mid', half)} + {over('r.low', full)}, {none})",
        "e": pick("IF(r.apart <= r.room, r.e, r.e + r.apart - r.room - 1)", "r.e", "r.e - 30"),
    }
    # Of a long product's 56 digits the first 37, and whether anything is left.
    cut = f"({length('r.upper')} - 9)"
    long = f"(r.upper * {ten(f'{DIGITS} - {cut}')} + {over('r.c', ten(cut))}) * 10 + IF(r.c % {ten(cut)} > 0, 1, 0)"
    joined = {"c": f"IF(r.upper IS NULL, r.c, IF(r.negative, -1, 1) * ({long}))", "e": f"IF(r.upper IS NULL, r.e, r.e + {cut} - 1)"}
    digits = kept("c", "e") | {"d": f"greatest({length('r.c')} - {DIGITS}, 0)"}
    parted = kept("c", "e", "d") | {"p": ten("r.d"), "q": f"IF(r.d = 0, abs(r.c), {over('abs(r.c)', ten('r.d'))})"}
    rest = "(abs(r.c) - r.q * r.p)"
    rounded = kept("c", "e", "d") | {"z": f"r.q + IF({rest} * 2 > r.p OR ({rest} * 2 = r.p AND r.q % 2 = 1), 1, 0)"}
    held, carry = f"IF(r.z = {full}, {ten(str(DIGITS - 1))}, r.z)", f"IF(r.z = {full}, 1, 0)"
    result = {"code": "CAST(NULL AS STRING)", "c": f"CAST(IF(r.c < 0, -{held}, {held}) AS {WHOLE})", "e": f"CAST(r.e + r.d + {carry} AS INT)"}
    start = "named_struct('sign', s.sign, 'a', n[s.l], 'b', n[s.r])"
    computed = chain(start, operands, registers, halves, combined, joined, digits, parted, rounded, result)
    code = f"coalesce(n[s.l].code, n[s.r].code, IF(s.sign = '/' AND n[s.r].c = 0, '{by_zero}', NULL))"
    return f"IF({code} IS NOT NULL, {refused(code)}, {computed})"


def value_of(numbers: str, steps: str, by_zero: str) -> str:
    """The last number once all steps are done, of arrays as ``Program.sql`` gives them."""
    return f"element_at(aggregate({steps}, {numbers}, (n, s) -> concat(n, array(CAST({step(by_zero)} AS {TYPE})))), -1)"


def shown(n: str) -> str:
    """The number as a text without an exponent, zeros at the end of its places left out."""
    digits = f"CAST(abs({n}.c) AS STRING)"
    sign = f"IF({n}.c < 0, '-', '')"
    point = f"{length(f'{n}.c')} + {n}.e"
    places = f"IF({point} > 0, concat(substring({digits}, 1, {point}), '.', substring({digits}, {point} + 1)), concat('0.', repeat('0', -({point})), {digits}))"
    return f"IF({n}.c = 0, '0', concat({sign}, IF({n}.e >= 0, concat({digits}, repeat('0', {n}.e)), rtrim('.', rtrim('0', {places})))))"
