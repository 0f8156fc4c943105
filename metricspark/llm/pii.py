"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, schemes and words
that announce an identifier. Small deterministic parsers grow each anchor to its
bounds and check what they find, so the cost of a text doesn't depend on patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from metricspark.llm.common import mapped

#: Kinds in the order in which spans with one start are listed; the first four are the
#: base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "iban", "account")
BASE = KINDS[:4]

#: The characters and forms of the base kinds.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

SCHEMES = ("http://", "https://", "ftp://")
URL_BODY = re.compile(r"[^\s<>\"'`{}|\\^\[\]]+")
CUES = ("account", "acct", "konto", "compte", "cuenta")
#: What may stand between a cue and its number, and the number.
AFTER_CUE = re.compile(r"[ \t]*(?:no\.?|nr\.?|number|num\.?|#)?[ \t]*[:#=]?[ \t]*([0-9](?:[ -]?[0-9]){5,19})(?![0-9])")
IBAN = re.compile(r"[ \t]*[:#=]?[ \t]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")

Span = tuple[int, int, str]


@lru_cache(maxsize=1)
def anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for s in SCHEMES:
        for form in (s, s.upper(), s.capitalize()):
            found.add_word(form, ("scheme", len(s)))
    for kind, names in (("cue", CUES), ("iban", ("iban",))):
        for s in names:
            for form in (s, s.upper(), s.capitalize()):
                found.add_word(form, (kind, len(s)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    """The check of two digits modulo 97."""
    t = text.replace(" ", "")
    return 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def email_at(text: str, at: int, free: int) -> Span | None:
    """The address around the at-sign ``at`` that begins at ``free`` or later."""
    start = at
    while start > free and text[start - 1] in LOCAL:
        start -= 1
    domain = DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end(), "email") if domain else None


def digit_spans(text: str, start: int, end: int) -> Iterator[Span]:
    """Network addresses and card numbers of a stretch of digits and single separators."""
    for m in QUAD.finditer(text, start, end):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield m.start(), m.end(), "ip"
    if end - start >= 14:
        for m in DIGITS.finditer(text, start, end):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.start(), m.end(), "card"


def spans(text: str) -> list[Span]:
    """All spans of a text as (start, end, kind) in code points, sorted by start and kind."""
    out: list[Span] = []
    free = linked = first = last = -1
    for stop, (kind, size) in anchors().iter(text):
        if kind == "digit":
            # Digits with at most one character between them make one stretch.
            if first >= 0 and stop - last > 2:
                out.extend(digit_spans(text, first, last + 1))
                first = stop
            elif first < 0:
                first = stop
            last = stop
        elif kind == "at":
            if found := email_at(text, stop, max(free, 0)):
                out.append(found)
                free = found[1]
        elif kind == "plus":
            if (m := PHONE.match(text, stop)) and 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
        elif kind == "scheme":
            # A scheme inside an address is part of it.
            if stop + 1 - size >= linked and (m := URL_BODY.match(text, stop + 1)):
                end = m.start() + len(m[0].rstrip(".,;:!?)"))
                linked = m.end()
                if end > m.start():
                    out.append((stop + 1 - size, end, "url"))
        elif kind == "cue":
            if m := AFTER_CUE.match(text, stop + 1):
                out.append((m.start(1), m.end(1), "account"))
        elif (m := IBAN.match(text, stop + 1)) and iban_ok(m[1]):
            out.append((m.start(1), m.end(1), "iban"))
    if first >= 0:
        out.extend(digit_spans(text, first, last + 1))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def listed(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def redacted(text: str, found: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    out, done = [], 0
    for a, b, kind in found:
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every whole text: (id, counts of the base kinds, base, spans, redacted).

    ``base`` and ``spans`` list ``kind:start:end`` by start, then kind, joined by commas;
    ``base`` has the base kinds only. Null and empty texts have none; rows with the same
    or a null id stand for themselves; other columns are left out; no rows give none.
    """
    source = df.select(id_col, text_col)
    id_type = source.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            found = [spans(t) for t in texts]
            counts = [pa.array([sum(s[2] == k for s in f) for f in found], pa.int64()) for k in BASE]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *counts,
                    pa.array([listed([s for s in f if s[2] in BASE]) for f in found], pa.string()),
                    pa.array([listed(f) for f in found], pa.string()),
                    pa.array([redacted(t, f) for t, f in zip(texts, found)], pa.string()),
                ],
                names=[id_col, *(f"n_{k}" for k in BASE), "base", "spans", "redacted"],
            )

    counts = ", ".join(f"n_{k} long" for k in BASE)
    return source.mapInArrow(run, f"`{id_col}` {id_type}, {counts}, base string, spans string, redacted string")


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with personal data in ``text_col`` replaced by its kind, all columns kept.

    Texts without any, null and empty ones stay as they are; no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            clean = [t and redacted(t, spans(t)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return mapped(df, run)
