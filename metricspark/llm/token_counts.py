"""Token counts of the sections of texts, by offset-mapped attribution.

A text is encoded once, whole. Its tokens' spans are then joined to the spans of its
sections, so the counts of a text's sections add up to the text's own count, which
separate encodings of the sections wouldn't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from metricspark.llm.arrays import offsets
from metricspark.llm.bpe import coder

RULES = ("first", "last", "most", "share")


def line_starts(raw: np.ndarray) -> np.ndarray:
    """Where the lines of a text begin, in bytes; the line feed ends its line."""
    at = np.flatnonzero(raw[:-1] == 10) + 1 if len(raw) else np.zeros(0, dtype=np.int64)
    return np.concatenate([[0], at])


def attribute(token_ends: np.ndarray, starts: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. token_ends: byte ends of the tokens; starts: of the sections.

    A token that crosses a boundary goes to the section of its first byte, of its last
    byte, of most of its bytes (the earlier on a tie), or to all by their share of it.
    """
    out = np.zeros(len(starts))
    if not len(token_ends):
        return out
    begin = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(starts, begin, side="right") - 1
    last = np.searchsorted(starts, token_ends - 1, side="right") - 1
    if rule == "last":
        np.add.at(out, last, 1)
        return out
    if rule == "first":
        np.add.at(out, first, 1)
        return out
    np.add.at(out, first[first == last], 1)
    stops = np.append(starts[1:], token_ends[-1])
    for t in np.flatnonzero(first != last):
        sections = np.arange(first[t], last[t] + 1)
        held = np.minimum(stops[sections], token_ends[t]) - np.maximum(starts[sections], begin[t])
        if rule == "most":
            out[sections[held.argmax()]] += 1
        else:
            out[sections] += held / held.sum()
    return out


def section_tokens(
    df: DataFrame, tokenizer: str, rule: str = "first", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokens of every line of every text: (id, section, start, end, n_tokens, doc_tokens).

    start and end are code points, end exclusive; ``n_tokens`` is a double, whole but
    for the rule ``share``. ``tokenizer`` is a byte-level file on every machine. A null
    or empty text has one section from 0 to 0 with no tokens; rows with the same or a
    null id are counted on their own; other columns are left out; no rows give none.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    source = df.select(id_col, text_col)
    id_type = source.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(tokenizer)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for i, j, ids, at in bpe.encode_slices(texts):
                ends = np.cumsum(bpe.n_bytes[ids])
                rows, first, stop, tokens = [], [], [], []
                for k in range(i, j):
                    raw = np.frombuffer(texts[k].encode(), dtype=np.uint8)
                    a, b = at[k - i], at[k - i + 1]
                    own = ends[a:b] - (ends[a - 1] if a else 0)
                    starts = line_starts(raw)
                    # Code points before each byte: those that begin there or earlier.
                    chars = offsets((raw & 0xC0) != 0x80)[np.append(starts, len(raw))]
                    rows.append(len(starts))
                    first.append(chars[:-1])
                    stop.append(chars[1:])
                    tokens.append(attribute(own, starts, rule))
                n = np.array(rows)
                which = np.repeat(np.arange(i, j), n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(which)),
                        pa.array(np.concatenate([np.arange(x) for x in rows])),
                        pa.array(np.concatenate(first)),
                        pa.array(np.concatenate(stop)),
                        pa.array(np.concatenate(tokens)),
                        pa.array(np.repeat(at[1:] - at[:-1], n)),
                    ],
                    names=[id_col, "section", "start", "end", "n_tokens", "doc_tokens"],
                )

    return source.mapInArrow(
        run, f"`{id_col}` {id_type}, section long, start long, end long, n_tokens double, doc_tokens long"
    )
