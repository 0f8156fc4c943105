"""Names looked up in texts by an index of their rarest stretches, without texts in any row that is moved."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricspark import storage

#: Letters of the widest stretch, bits of the filter of the index's stretches, letters that are hashed at once,
#: and parts that the rows of a stretch are dealt over.
WIDEST, BITS, AT_ONCE, SALTS = 64, 1 << 23, 1 << 20, 8


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(texts: list[bytes], widths: set[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, text, hash): all stretches of those widths, powers of two, of texts in UTF-8."""
    letters = [np.frombuffer(t.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    text = np.repeat(np.arange(len(texts)), [len(x) for x in letters])
    h = _mixed(np.concatenate(letters).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) if len(text) else np.zeros(0, dtype=np.uint64)
    width = 1
    while len(h):
        if width in widths:
            inside = text[: len(h)] == text[width - 1 :]
            yield width, text[: len(h)][inside], h[inside].view(np.int64)
        if width >= max(widths, default=0) or len(h) <= width:
            return
        h = _mixed(h[:-width] * np.uint64(0xD1342543DE82EF95) + h[width:] + np.uint64(width))
        width *= 2


def _parts(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of AT_ONCE bytes together, or of one text."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > AT_ONCE:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def _stretches(rows: DataFrame, column: str, hashed) -> DataFrame:
    """The columns of rows but for the text, with ``gram`` for each stretch that ``hashed(texts)`` gives as (text, gram)."""
    keep = [c for c in rows.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for a, b in _parts(texts):
                text, gram = hashed(texts[a:b])
                took = pa.array(text + a)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(took) for i in range(len(keep))), pa.array(gram)], names=[*keep, "gram"])

    schema = rows.select(*keep).withColumn("gram", F.lit(0).cast("long")).schema
    return rows.select(*keep, F.col(column).cast("binary").alias(column)).mapInArrow(run, schema)


def _of_names(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every name's stretches of half its letters or more: of the largest power of two that it has, or of WIDEST."""
    letters = np.array([len(n.decode("utf-8", "surrogateescape")) for n in names])
    own = np.minimum(1 << np.frexp(letters)[1].astype(np.int64) - 1, WIDEST)
    found = [(text[m], gram[m]) for width, text, gram in _hashed(names, set(own.tolist())) for m in [own[text] == width]]
    text, gram = (np.concatenate(x) for x in zip(*found))
    _, once = np.unique(np.stack([text, gram]), axis=1, return_index=True)
    return text[once], gram[once]


def index(names: DataFrame, keep: list[str], within: list[str]) -> DataFrame:
    """(*within, gram, width, name, *keep): every name under that stretch of it which the fewest names have, then the first.

    A stretch has half a name's letters at least, or WIDEST, so that few names share one however many
    there are. Empty and null names are left out. Names are distinct in ``within``.
    """
    named = names.filter(F.length("name") > 0).select(*within, *keep, "name", F.col("name").alias("letters"))
    rows = _stretches(named, "letters", _of_names)
    shared = rows.groupBy(*within, "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min_by(F.struct("gram", *keep), F.struct("n", "gram")).alias("x")
    width = F.least(F.pow(F.lit(2), F.floor(F.log2(F.length("name").cast("double")))).cast("int"), F.lit(WIDEST))
    return rows.join(shared, [*within, "gram"]).groupBy(*within, "name").agg(rarest).select(*within, "x.gram", width.alias("width"), "name", *(f"x.{c}" for c in keep))


def candidates(texts: DataFrame, names: DataFrame, keep: list[str], within: tuple[str, ...] = ()) -> DataFrame:
    """(key, *within, names): of each text (key, text) the names, as structs with ``keep``, whose rarest stretch it has.

    The index is written once. A text gives those of its stretches, each once, that pass a filter of fixed size
    (BITS, which comes to the driver) of the index's; a name lies under one stretch, so rows follow the
    possible matches. Rows of a stretch that many texts have are dealt over SALTS parts.
    ``within``: columns of both sides that must agree. Whether a text has the name is for the caller to see.
    """
    known = storage.kept(index(names, keep, list(within)), "names")
    widths = {r["width"] for r in known.select("width").distinct().collect()}  # seven at most
    bit = F.pmod("gram", F.lit(BITS))
    words = known.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(pmod(gram, 64) AS INT)))").alias("bits")).toArrow()
    held = np.zeros(BITS // 64, dtype=np.int64)
    held[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    filled = held.view(np.uint64)

    def passing(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [(np.zeros(0, dtype=np.int64),) * 2]
        for _, text, gram in _hashed(texts, widths):
            at = gram & np.int64(BITS - 1)
            there = (filled[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            found.append((text[there], gram[there]))
        text, gram = (np.concatenate(x) for x in zip(*found))
        _, once = np.unique(np.stack([text, gram]), axis=1, return_index=True)
        return text[once], gram[once]

    said = _stretches(texts.filter(F.length("text") > 0).select("key", *within, "text"), "text", passing)
    said = said.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    salted = known.drop("width").withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    found = said.join(salted, [*within, "gram", "salt"]).select("key", *within, F.struct("name", *keep).alias("x"))
    return found.groupBy("key", *within).agg(F.collect_list("x").alias("names"))
