"""Conversations repaired at the least cost, each distinct structure once.

A row of a conversation is one letter of a compact string, its signature: the initial of
its role in lower case, in upper case if the text breaks off, ``x`` if it must go. Many
conversations share a signature, so the cheapest edits are sought once for each distinct
one, by memoised recursion over halves of it: for every state before and after a half, the
least cost and the edits. They are joined back, and replayed row by row.

Signatures are put together from sorted light rows without texts, range-partitioned, so
that one conversation may spread over many tasks; each task sends on short segments. Only
the replay, whose order is the order of the result, has all rows of a conversation in one
stream; it holds no more than one row and the edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricspark.llm.common import cut, join_salted

BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
#: Costs of edits, and of a kept text that breaks off.
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 3, 4, 3, 3
#: Roles that may follow one another, by their initials.
LEGAL = ("su", "ua", "au")
#: Letters of a segment of a signature.
SEGMENT = 4096
#: What may come next before anything, after a system, a user and an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ROLES = {"u": "user", "a": "assistant"}

Ways = dict[tuple[int, int], tuple[int, str]]


def expected(state: int) -> str:
    """The initial of the only role that can be inserted or assigned in a state."""
    return "a" if state == USER else "u"


def inserted(state: int) -> Iterator[tuple[int, int, str]]:
    """(state, cost, edits) after no, one or two insertions; a third leads nowhere new."""
    for n in range(3):
        yield state, n * INSERT, "I" * n
        state = NEXT[state][expected(state)]


def least(ways: Ways, ends: tuple[int, int], way: tuple[int, str]) -> None:
    if ends not in ways or way < ways[ends]:
        ways[ends] = way


def one_row(letter: str) -> Ways:
    """Edits of one row for every state before and after it."""
    ways: Ways = {}
    role, broken = letter.lower(), BROKEN if letter.isupper() else 0
    for start in range(4):
        for state, cost, edits in inserted(start):
            least(ways, (start, state), (cost + DELETE, edits + "D"))
            if role == "x":
                continue
            if role in NEXT[state]:
                least(ways, (start, NEXT[state][role]), (cost + KEEP + broken, edits + "K"))
            least(ways, (start, NEXT[state][expected(state)]), (cost + REROLE + broken, edits + "R"))
    return ways


def joined(left: Ways, right: Ways) -> Ways:
    """Of equally cheap edits between two states none begins another, so the least of each half make the least whole."""
    ways: Ways = {}
    for (a, b), (cost, edits) in left.items():
        for c in range(4):
            if (b, c) in right:
                more, rest = right[b, c]
                least(ways, (a, c), (cost + more, edits + rest))
    return ways


@lru_cache(maxsize=1 << 14)
def short_ways(signature: str) -> Ways:
    return one_row(signature) if len(signature) == 1 else halves(signature)


def halves(signature: str) -> Ways:
    middle = len(signature) // 2
    return joined(ways_of(signature[:middle]), ways_of(signature[middle:]))


def ways_of(signature: str) -> Ways:
    """Long parts aren't kept; they hardly recur."""
    return short_ways(signature) if len(signature) <= 32 else halves(signature)


def solve(signature: str) -> tuple[int, str]:
    """(cost, edits) of the cheapest repair; of equally cheap ones the first in ASCII order."""
    found: Ways = {}
    for (start, end), (cost, edits) in ways_of(signature).items() if signature else [((START, START), (0, ""))]:
        if start == START:
            for state, more, rest in inserted(end):
                if state in (START, ASSISTANT):
                    least(found, (0, 0), (cost + more, edits + rest))
    return found[0, 0]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [solve(s) for s in b.column(0).to_pylist()]
        arrays = [b.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([e for _, e in found], pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=["signature", "cost", "audit"])


def light_rows(rows: DataFrame) -> DataFrame:
    """(key, turn, role, digest, n, blank, broken): rows without texts; equal rows of one turn are one of n."""
    tail = F.rtrim(F.col("text"), F.lit(BLANKS))
    light = rows.select("key", "turn", "role", "digest", (tail == "").alias("blank"), (~F.right(tail, F.lit(1)).isin(*ENDS)).alias("broken"))
    return light.groupBy("key", "turn", "role", "digest", "blank", "broken").agg(F.count(F.lit(1)).alias("n"))


def place() -> Column:
    """What rows of a conversation with one role and text are ordered by."""
    return F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))


def marked(light: DataFrame) -> DataFrame:
    """Adds ``again``: the role and text have come in an earlier turn."""
    several = light.filter(~F.col("blank")).groupBy("key", "digest").agg(F.count(F.lit(1)).alias("turns"), F.min(place()).alias("first"))
    several = several.filter("turns > 1").select("key", "digest", "first")
    out = join_salted(light, several, ["key", "digest"], "left")
    return out.withColumn("again", F.coalesce(place() > F.col("first"), F.lit(False))).drop("first")


SEGMENTS = (
    "key string, known boolean, turn long, role string, digest binary, piece long, signature string, blank long, duplicate long, "
    "truncated long, illegal long, first string, last string, first_turn long, last_turn long, low long, high long, turns long"
)


def segments(length: int):
    """A function over sorted rows: stretches of one conversation with a part of its signature and what can be counted within."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
        schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in SEGMENTS.split(", ")])
        out: list[dict] = []
        now: dict | None = None
        parts: list[str] = []
        size = 0

        def end() -> None:
            nonlocal now, size
            if now is not None:
                out.append(now | {"signature": "".join(parts)})
            parts.clear()
            now, size = None, 0

        def begin(r: dict, piece: int) -> dict:
            at = {"key": r["key"], "known": r["turn"] is not None, "turn": r["turn"], "role": r["role"], "digest": r["digest"], "piece": piece}
            counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
            return at | counts | {"first": r["initial"], "last": None, "first_turn": r["turn"], "last_turn": None, "low": r["turn"], "high": None}

        for batch in batches:
            for r in batch.to_pylist():
                if now is not None and (now["key"] != r["key"] or size >= length):
                    end()
                gone = r["blank"] or r["again"]
                left, piece = r["n"], 0
                while left:
                    # A row that repeats very often ends segments of its own.
                    if now is not None and size >= length:
                        end()
                    if now is None:
                        now = begin(r, piece)
                    n = min(left, length)
                    kept = not gone and piece == 0
                    letter = (r["initial"] if r["initial"] in ("s", "u", "a") else "o") if kept else "x"
                    parts.append((letter.upper() if kept and r["broken"] else letter) + "x" * (n - 1))
                    now["blank"] += n if r["blank"] else 0
                    now["duplicate"] += 0 if r["blank"] else n - kept
                    now["truncated"] += kept and r["broken"]
                    now["illegal"] += n - 1 + (now["last"] is not None and now["last"] + r["initial"] not in LEGAL)
                    now["turns"] += r["turn"] is not None and (now["last_turn"] is None or now["last_turn"] != r["turn"])
                    now["low"] = r["turn"] if now["low"] is None else now["low"]
                    now |= {"last": r["initial"], "last_turn": r["turn"], "high": r["turn"]}
                    size += n
                    left -= n
                    piece += 1
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        end()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def conversations(light: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(key, signature, blank, duplicate, truncated, illegal, gaps) from light rows with ``again``."""
    initial = F.when(F.col("role") == "", " ").otherwise(F.left("role", F.lit(1)))
    rows = light.select("key", "turn", "role", "digest", "n", "blank", "broken", "again", initial.alias("initial"))
    order = ["key", "turn", "role", "digest"]
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(segments(segment), SEGMENTS)
    own = [x.split()[0] for x in SEGMENTS.split(", ")[1:]]
    parts_of = F.col("segments")
    total = lambda c: F.aggregate(parts_of, F.lit(0).cast("long"), lambda a, x: a + x[c])
    before = lambda i: F.get(parts_of, i - 1)
    seams = F.size(F.filter(parts_of, lambda x, i: (i > 0) & ~F.concat(before(i)["last"], x["first"]).isin(*LEGAL)))
    shared = F.size(F.filter(parts_of, lambda x, i: (i > 0) & (before(i)["last_turn"] == x["first_turn"])))
    low, high = F.array_min(F.transform(parts_of, lambda x: x["low"])), F.array_max(F.transform(parts_of, lambda x: x["high"]))
    whole = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*own))).alias("segments"))
    return whole.select(
        "key",
        F.array_join(F.transform(parts_of, lambda x: x["signature"]), "").alias("signature"),
        *(total(c).alias(c) for c in ("blank", "duplicate", "truncated")),
        (total("illegal") + seams).alias("illegal"),
        F.coalesce(high - low + 1 - (total("turns") - shared), F.lit(0)).cast("long").alias("gaps"),
    )


def own_rows(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(key, turn, role, text, digest); null roles and texts are one space."""
    role, text = (F.coalesce(df[f"`{c}`"].cast("string"), F.lit(" ")) for c in (role_col, text_col))
    rows = df.select(
        key_of(df[f"`{conv_col}`"]).alias("key"), df[f"`{turn_col}`"].cast("long").alias("turn"), role.alias("role"), text.alias("text"),
    )
    return rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))


def repair(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT
) -> tuple[DataFrame, DataFrame]:
    """(audits, repaired) of conversations.

    audits: a row for each conversation: key, gaps, blank, duplicate, truncated, illegal, cost, audit.
    repaired: its rows after the edits: key, pos, edit, role, text, in order within their
    partition, all of a conversation in one. Deleted rows are left out. ``key_of`` is the key.

    Rows are taken by turn, null turns first, rows of one turn by role and a digest of role
    and text. A null conversation id is one conversation. Null roles and texts are one
    space; an empty role has a space for its initial. Rows that repeat are duplicates. An
    empty table has no conversations.
    """
    rows = own_rows(df, conv_col, turn_col, role_col, text_col)
    light = cut(light_rows(rows))
    found = cut(conversations(marked(light), segment))
    solved = found.select("signature").distinct().mapInArrow(_solve, "signature string, cost long, audit string")
    audits = cut(join_salted(found, solved, ["signature"], "inner").drop("signature"))
    return audits, replayed(rows, audits)


def key_of(conv: Column) -> Column:
    """A conversation's key, never null."""
    return F.coalesce(F.concat(F.lit("v"), conv.cast("string")), F.lit("n"))


REPLAYED = "key string, pos long, edit string, role string, text string"


def replayed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows of every conversation with its edits carried out; its audit comes first in the stream."""
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    heads = audits.select("key", F.lit(False).alias("is_row"), none("turn", "long"), none("role", "string"), none("digest", "binary"), F.col("audit").alias("text"))
    both = heads.unionByName(rows.select("key", F.lit(True).alias("is_row"), "turn", "role", "digest", "text"))
    both = both.repartition("key").sortWithinPartitions("key", "is_row", "turn", "role", "digest")
    return both.select("key", "is_row", "role", "text").mapInArrow(_replay, REPLAYED)


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    key, audit, at, state, pos = None, "", 0, START, 0

    def add(edit: str, role: str, text: str, initial: str) -> None:
        nonlocal state, pos
        state = NEXT[state][initial]
        out.append((key, pos, edit, role, text))
        pos += 1

    def insertions() -> None:
        nonlocal at
        while audit[at : at + 1] == "I":
            add("I", ROLES[expected(state)], "", expected(state))
            at += 1

    def flush() -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[x.split()[0] for x in REPLAYED.split(", ")])
        out.clear()
        return batch

    for batch in batches:
        for own, is_row, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not is_row:
                insertions()  # those after the last row of the conversation before
                key, audit, at, state, pos = own, text, 0, START, 0
                continue
            insertions()
            edit = audit[at]
            at += 1
            if edit == "K":
                add("K", role, text, role[:1])
            elif edit == "R":
                add("R", ROLES[expected(state)], text, expected(state))
        if out:
            yield flush()
    insertions()
    if out:
        yield flush()


def digests(repaired: DataFrame) -> DataFrame:
    """(key, repaired_sha256) of ``role:text`` lines, from repaired rows as ``repair`` leaves them; one row is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h = None, None
        for batch in batches:
            found = []
            for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "role", "text"))):
                if key != last:
                    if last is not None:
                        found.append((last, h.hexdigest()))
                    last, h = key, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["key", "repaired_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([h.hexdigest()])], names=["key", "repaired_sha256"])

    return repaired.mapInArrow(run, "key string, repaired_sha256 string")
