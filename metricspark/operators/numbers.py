"""Plain forms of texts, and the codes, years and numbers that they state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of all scripts, the forms of a code, a year, a unit of money after a number
#: and a number, and the scales of units. Six digits before a point and a digit are an amount's and no code.
BLANK = r"[\x{1C}-\x{20}\x{09}-\x{0D}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
INVISIBLE = r"[\p{Cc}\p{Cf}]"
CODE = r"(?<!\d)(\d{6})(?!\d|\.\d)"
#: A code of six digits or more, for entities whose keys are longer.
LONG_CODE = r"(?<!\d)(\d{6,})(?!\d|\.\d)"
YEAR = r"((?:19|20)\d{2})\s*年"
MONEY = r"(?!\s*(?:万元|亿元|万|亿|元))"
NUMBER = r"(?<![\d.])(-?\d+(?:,\d{3})*(?:\.\d+)?)\s*(个百分点|百分点|%|％|亿元|亿|万元|万)?"
SCALES = {"%": "0.01", "％": "0.01", "个百分点": "0.01", "百分点": "0.01", "亿": "100000000", "亿元": "100000000", "万": "10000", "万元": "10000"}
#: Units of a difference, which no level of one year can confirm.
DELTA = ("个百分点", "百分点")


def normalised(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANK, " "))


def visible(text: Column) -> Column:
    """Without control and format characters; for comparison only."""
    return F.regexp_replace(text, INVISIBLE, "")


def codes(text: Column, code: str = CODE) -> Column:
    """Distinct codes, of six digits by default, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(code), F.lit(1)))


def years(text: Column) -> Column:
    """Distinct years in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)))


def masked(text: Column, code: str = CODE) -> Column:
    """Codes that are no amounts, and years, replaced by as many wide blanks, so that places stay."""
    wide = "　"
    # Digit by digit from where a code begins, as codes may differ in length.
    out = F.regexp_replace(text, rf"(?:\G(?!^)|(?={code}{MONEY}))\d", wide)
    out = F.regexp_replace(out, r"(?:19|20)\d{2}(?=\s*年)", wide * 4)
    return F.regexp_replace(out, f"(?<={wide * 4}\\s{{0,64}})年", wide)


def scale(unit: Column) -> Column:
    out = F.lit("1").cast("decimal(11,2)")
    for name, by in SCALES.items():
        out = F.when(unit == name, F.lit(by).cast("decimal(11,2)")).otherwise(out)
    return out


def stated(text: Column, code: str = CODE) -> Column:
    """All numbers of a text but its codes and years: array of (value, tolerance, unit, delta).

    The value is in its unit's scale; the tolerance half a unit in its last written place.
    A number of a code's form (``code``) before a unit of money is an amount and no code. A number that is
    too long for a decimal has a null value.
    """
    bare = masked(text, code)
    found = F.arrays_zip(
        F.regexp_extract_all(bare, F.lit(NUMBER), F.lit(1)).alias("raw"), F.regexp_extract_all(bare, F.lit(NUMBER), F.lit(2)).alias("unit")
    )

    def read(x: Column) -> Column:
        places = F.length(F.regexp_extract(x["raw"], r"\.(\d+)$", 1))
        by = scale(x["unit"])
        value = F.replace(x["raw"], F.lit(","), F.lit("")).try_cast("decimal(28,6)") * by
        half = F.round(F.pow(F.lit(10.0), -places) * by.cast("double") / 2, 10)
        return F.struct(value.alias("value"), half.alias("tolerance"), x["unit"].alias("unit"), x["unit"].isin(*DELTA).alias("delta"))

    return F.transform(found, read)
