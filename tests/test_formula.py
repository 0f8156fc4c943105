"""Formulas and conditions: 28 significant digits against Python's decimals, refusals in place, texts that can and can't be read."""

import random
from decimal import Decimal, InvalidOperation, localcontext

import pytest

from metricspark.operators import exact, expressions, metrics, reading, registry
from metricspark.plans.definitions import Definition
from tests.test_queries import REPORT, by_metric, statement


def operands(n, seed=4):
    r = random.Random(seed)

    def one():
        places = r.choice([1, 3, 9, 14, 15, 20, 27, 28])
        c = r.choice([r.randrange(10**places), 10**places - 1, 5 * 10 ** (places - 1), 10 ** (places - 1), 0])
        return r.choice([-1, 1]) * min(c, 10**28 - 1), r.choice([-6, -6, 0, -30, 5, r.randrange(-60, 60)])

    ties = [(r.randrange(10**27, 10**28), 3, sign * 5 * 10 ** r.randrange(20), -r.randrange(25)) for sign in (1, -1) for _ in range(n // 10)]
    return [(*one(), *one()) for _ in range(n)] + ties + [(10**28 - 1, 0, 5, -1), (10**28 - 1, -6, 1, -6), (1, 0, 3, 0), (0, 0, 0, 0)]


def test_four_signs_against_decimals(spark):
    """Every digit and every rounding, halves included, as Python's decimals of 28 digits; only a division by zero has none."""
    rows = operands(1500)
    d = spark.createDataFrame([(i, str(a), b, str(c), e) for i, (a, b, c, e) in enumerate(rows)], "i int, ac string, ae int, bc string, be int").repartition(8)
    numbers = [exact.number("CAST(ac AS DECIMAL(38,0))", "ae"), exact.number("CAST(bc AS DECIMAL(38,0))", "be")]
    each = ", ".join(f"named_struct('sign', '{s}', 'n', {exact.Program(numbers, [(s, 0, 1)]).sql()[0]}, 's', {exact.Program(numbers, [(s, 0, 1)]).sql()[1]})" for s in "+-*/")
    got = d.selectExpr("i", f"inline(array({each}))").selectExpr("i", "sign", f"{exact.value_of('n', 's', 'ZERO')} AS x").selectExpr("i", "sign", "x.code", f"{exact.shown('x')} AS said")
    with localcontext() as context:
        context.prec = 28
        for r in got.collect():
            a, ae, b, be = rows[r["i"]]
            x, y = Decimal(a).scaleb(ae), Decimal(b).scaleb(be)
            try:
                want = {"+": x.__add__, "-": x.__sub__, "*": x.__mul__, "/": x.__truediv__}[r["sign"]](y)
            except (ZeroDivisionError, InvalidOperation):
                assert (r["code"], r["said"]) == ("ZERO", None)
                continue
            assert r["code"] is None and Decimal(r["said"]) == want and "E" not in r["said"], (r, x, y)


A, B, C = "is.net_profit", "bs.total_equity", "bs.total_assets"


def outcomes(spark, formulas, figures):
    """{formula: (value, code)} of formulas over the three fields, on both paths."""
    definitions = tuple(Definition(f"m{i}", f, ()) for i, f in enumerate(formulas))
    one = statement(spark, dict(zip((A, B, C), figures)))
    rows = by_metric(metrics.metric_values(one, definitions))
    return {f: (rows[f"m{i}"]["value"], rows[f"m{i}"]["refusal_code"]) for i, f in enumerate(formulas)}


FORMULAS = [
    f"{A} / ({B} / {C})", f"{A} / {B} / 3", f"{A} / {B} / {C}", f"{A} * {B}", f"{A} * {B} * {C}", f"{A} + {B} - {C}", f"{A} - {B} * {C}", f"-({A} + {B}) / {C}", f"365 * {A} / {C}",
    f"({A} + 0.5) * ({B} - 1.25) / ({C} * {C})", f"{A} / 0.000000000000000000000001", f"- - {A}", "1234567890123456789012345678", f"{A} * 0 / {C}", f"({A} - {A}) * 3",
]


@pytest.mark.parametrize("figures", [("2", "1", "100000000"), ("1", "100000000", "3"), ("0.000001", "999999999999999999999.999999", "7"), ("-900000000000000000000.000001", "0.000003", "123456789.123456"), ("9e21", "9999999999999999999999.999999", "9999999999999999999999.999999")])
def test_formulas_of_all_sizes(spark, figures):
    """Amounts from a millionth to 10**21 and beyond: always a value, and the one that decimals give."""
    got = outcomes(spark, FORMULAS, figures)
    with localcontext() as context:
        context.prec = 28
        a, b, c = map(Decimal, figures)
        for f in FORMULAS:
            text = f.replace(A, "a").replace(B, "b").replace(C, "c")
            want = eval("".join(f"Decimal('{w}')" if w[0].isdigit() else w for w in __import__("re").split(r"(\d+(?:\.\d+)?)", text) if w), {"a": a, "b": b, "c": c, "Decimal": Decimal})
            value, code = got[f]
            assert code is None and Decimal(value) == want, (f, value, want)


def test_refusals_of_formulas(spark):
    """Division by zero, by what is zero only after a subtraction, absent fields, unreadable and missing formulas."""
    formulas = [f"{A} / ({B} - {B})", f"{A} / is.operating_cost", f"{A} / 0", f"{A} / kpi.never_heard_of", f"{A} ** 2", "", f"({A}", "12345678901234567890123456789", f"0 / {A}"]
    got = outcomes(spark, formulas, ("2", "1", "3"))
    zero, unavailable, without = (None, "UNEVALUABLE_CONDITION"), (None, "UNAVAILABLE"), (None, "DEFINITION_NONCONFORMANT")
    assert list(got.values()) == [zero, unavailable, zero, unavailable, zero, without, zero, zero, ("0", None)]


def test_one_large_amount_spoils_nothing(spark):
    rows = by_metric(metrics.metric_values(statement(spark, REPORT | {"bs.total_liabilities": "900000000000000000000"})))
    assert rows["debt_to_asset_ratio"]["value"] == str(Decimal("900000000000000000000") / Decimal(REPORT["bs.total_assets"])) and rows["current_ratio"]["value"] == "4.623892443179299031292014007"


def test_sums_round_each_partial_sum(spark):
    """A sum of more than 28 digits is rounded, half to even, before the next term comes."""
    terms = ["9999999999999999999999.999999", "0.000002", "-5", "9999999999999999999999.999995", "0.000005", "-9999999999999999999999.999999"]
    rows = spark.createDataFrame([tuple(map(Decimal, terms))], ", ".join(f"t{i} decimal(28,6)" for i in range(6)))
    sql = exact.sum_of_amounts([("-" if i == 2 else "+", f"t{i}", "CAST(NULL AS STRING)") for i in range(6)])
    said = rows.selectExpr(f"{sql} AS x").selectExpr(f"{exact.shown('x')} AS s").first()["s"]
    with localcontext() as context:
        context.prec = 28
        want = Decimal(0)
        for i, t in enumerate(terms):
            want = want - Decimal(t) if i == 2 else want + Decimal(t)
    assert Decimal(said) == want


def test_unreadable_texts_refuse_in_place(spark):
    """Other definitions are answered; a condition or trigger that can't be read refuses at its own place, an empty one is passed over."""
    definitions = (
        Definition("late", f"{A} / {C}", (f"is_missing({A})", "", f"{C} = 3")),
        Definition("early", f"{A} / {C}", (f"is_missing({A})", f"{C} > 1", "nonsense(")),
        Definition("flagged", f"{A} / {C}", (), (("odd", "notes.restatement_flag == "),)),
        Definition("unknown", f"{A} / {C}", ("is_missing(notes.never_heard_of)",)),
        Definition("ordered", f"{A} / {C}", (f"{C} < 'a'",)),
        Definition("quoted's", f"{A} / {C}", (), version=None),
    )
    got = by_metric(metrics.metric_values(statement(spark, {A: "1", C: "3"}), definitions))
    said = {m: (r["refusal_code"], r["condition_index"]) for m, r in got.items()}
    assert said == {
        "late": ("UNEVALUABLE_CONDITION", 2), "early": ("UNDEFINED_CONDITION_HIT", 1), "flagged": ("UNEVALUABLE_CONDITION", None), "unknown": ("UNDEFINED_CONDITION_HIT", 0),
        "ordered": ("UNEVALUABLE_CONDITION", 0), "quoted's": (None, None),
    }
    assert got["quoted's"]["version"] is None and got["quoted's"]["value"] == "0.3333333333333333333333333333"


def test_a_value_may_stand_for_missing(spark):
    """In conditions only, and of the field's own kind: an amount against a number, a flag against a word."""
    tests = ("is_missing(bs.total_equity)", "bs.total_equity == 0")
    definitions = tuple(Definition(f"m{i}", B, tests, missing=((B, stands),)) for i, stands in enumerate([None, Decimal(-1), Decimal("-1.0"), "-1", True]))
    got = by_metric(metrics.metric_values(statement(spark, {B: "-1"}), definitions))
    assert [got[f"m{i}"]["condition_index"] for i in range(5)] == [None, 0, 0, None, None]
    assert got["m0"]["value"] == "-1"
    assert [registry.represented(x) for x in (None, "null", "true", "-1.5", "n/a")] == [None, None, True, Decimal("-1.5"), "n/a"]


@pytest.mark.parametrize("text", ["bs.x == 0x10", "bs.x == 1_000", "bs.x == 1 # c", "notes.y == 'a' 'b'", "bs.x < 1e400", "bs.x.", "bs..x > 1", "bs.x == 'open", "not", "bs.x and bs.y > 1", "not bs.x", "is_missing(bs.x", "is_missing(bs.x > 1)", "(bs.x > 1) == true", "bs.x > 1 bs.y", "and bs.x > 1", "bs.x > 1 or", "((bs.x > 1)", "is_missing bs.x", "bs.x == - 1", "bs.x ! 1", "(" * 100 + "bs.x > 1" + ")" * 100])
def test_more_unreadable_conditions(text):
    assert expressions.unreadable(text)


@pytest.mark.parametrize("text", ["is.a % 2", "is.a // 2", "f(is.a)", "is.a 2", "1e5", "is.a / ", "'a'", "is.a > 1", "a", "metric.version + 1", "1__0", "1.", ".5", "is.a + + is.b"])
def test_unreadable_formulas(text):
    assert expressions.unreadable(text, as_formula=True)


def test_words_of_conditions(spark):
    """Names that are words of Python, literals as they are written, long decimals, parentheses, signs turned round."""
    cells = {"bs.class": ("x", "number"), "notes.is": ("t", "string"), "bs.n": ("n", "number")}
    tests = {
        "bs.class == -1.5": True, "(bs.class) == (-1.5)": True, "-1.5 == bs.class": True, "0 > bs.class": True, "notes.is == 'is.a  b'": True, 'notes.is == "is.a b"': False, "notes.is != 'is_.a  b'": True,
        "bs.n == 0.12345678901234567890123": False, "bs.n < 0.12345678901234567890123": True, "bs.n <= 0.123456": True, "bs.n > 0.12345599999999999999999999999999999999999999": True, "bs.n >= 0.1234560000000000000000000000000000000000001": False,
        "bs.n < 99999999999999999999999999999999999999999999999999": True, "bs.n > -99999999999999999999999999999999999999999999999999": True, "bs.n == 99999999999999999999999999999999999999999999999999": False,
        "1 < 2": True, "'a' == 1": False, "null == null": True, "null < 1": None, "not not is_missing(bs.gone)": True, "bs.gone == 1 or bs.n > 0": None, "bs.n > 0 or bs.gone == 1": True, "bs.n < 0 and bs.gone == 1": False,
        "bs.n < 0 or (bs.n > 0 and not (bs.class > 0 or bs.gone > 1)) or bs.n > 0": None,
    }
    row = spark.sql("SELECT CAST(-1.5 AS DECIMAL(28,6)) AS x, 'is.a  b' AS t, CAST(0.123456 AS DECIMAL(28,6)) AS n")
    cell = lambda p: cells.get(p, ("CAST(NULL AS DECIMAL(28,6))", "number"))
    got = row.selectExpr(*(f"{expressions.condition(t, cell)} AS c{i}" for i, t in enumerate(tests))).first()
    assert dict(zip(tests, got)) == tests


def test_texts_grow_as_they_are_nested():
    def nested(levels):
        text = "bs.x > 1"
        for i in range(levels):
            text = f"({text} {('and', 'or')[i % 2]} bs.x < {i}) {('or', 'and')[i % 2]} not (bs.y == {i})"
        return len(expressions.condition(text, lambda p: ("x", "number")))

    assert nested(16) < 2.2 * nested(8) < 5 * nested(4)


def test_fields_in_their_order():
    assert expressions.fields("is.a / (bs.b + is.a) * -cfs.c") == ["is.a", "bs.b", "is.a", "cfs.c"]
    assert expressions.fields("is_missing(is.a) or not (metric.v == 1 and 2 < bs.b)") == ["is.a", "metric.v", "bs.b"]
    assert reading.named("foo.x ** bar.y") == ["foo.x", "bar.y"] and reading.named("foo.x $ 1") == []
