"""Exact duplicates by content-defined chunk recipes.

A normalised text is cut where a hash of its last bytes says so, hence equal passages
give equal chunks wherever they stand. A chunk's identifier is a digest; one pass
over the distinct chunks verifies that no two share an identifier. From then on a text
is its recipe, the ordered list of its chunks' identifiers, and only recipes are moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricspark.llm.arrays import slices, span_hash
from metricspark.llm.common import cut, join_salted

#: The characters that don't count, `[\x20\x09-\x0D]`.
DROPPED = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes that the cutting hash sees; least and most bytes of a chunk; one place in so
#: many is a cut.
SEEN, LEAST, MOST, ONE_IN = 16, 256, 8192, 1024


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(None, DROPPED)


def chunk_ends(raws: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each byte string; each depends on that string alone."""
    b = np.frombuffer(b"".join(raws), dtype=np.uint8)
    h = span_hash(21)
    h.prepare(b)
    if len(b) >= SEEN:
        window = (h.sums[SEEN:] - h.sums[:-SEEN]) * h.down[: len(b) - SEEN + 1]
        places = np.flatnonzero(window >> np.uint64(40) < (1 << 24) // ONE_IN) + SEEN
    else:
        places = np.zeros(0, dtype=np.int64)
    out, begin = [], 0
    for raw in raws:
        size, last, ends = len(raw), 0, []
        i, j = np.searchsorted(places, [begin + SEEN, begin + size])
        for p in [*(places[i:j] - begin).tolist(), size]:
            while p - last > MOST:
                last += MOST
                ends.append(last)
            if p - last >= LEAST or (p == size and p > last):
                last = p
                ends.append(p)
        out.append(ends)
        begin += size
    return out


def chunks_of(texts: list[str | None]) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """(place, normalised text, its chunks) of every text."""
    for i, j in slices([t or "" for t in texts]):
        raws = [normalised(t) for t in texts[i:j]]
        for k, (raw, ends) in enumerate(zip(raws, chunk_ends(raws))):
            yield i + k, raw, [raw[a:b] for a, b in zip([0, *ends], ends)]


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bytes: int = 16) -> DataFrame:
    """One row for each row of df: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when the same after DROPPED is taken out; null counts as empty, and
    all empty texts are equal. Of equal texts the row with the most code points in its
    own text stays, then the smallest id, a null id last. Rows that share the staying
    row's id are kept with it. No rows give none; other columns are left out.

    ``id_bytes``: length of the identifiers before verification.
    """
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    name = lambda c: hashlib.blake2b(c, digest_size=id_bytes).digest()

    def recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [(len(texts[k] or ""), hashlib.sha256(raw).hexdigest(), b"".join(map(name, c))) for k, raw, c in chunks_of(texts)]
            n, sha, recipe = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(recipe, pa.binary())],
                names=["id", "n", "sha", "recipe"],
            )

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, bytes] = {}
            for _, _, parts in chunks_of(batch.column(1).to_pylist()):
                held.update((c, name(c)) for c in parts if c not in held)
                if len(held) > 4096:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(held.values(), pa.binary()), pa.array(held, pa.binary())], names=["chunk_id", "chunk"]
                    )
                    held = {}
            yield pa.RecordBatch.from_arrays(
                [pa.array(held.values(), pa.binary()), pa.array(held, pa.binary())], names=["chunk_id", "chunk"]
            )

    distinct = source.mapInArrow(chunks, "chunk_id binary, chunk binary").distinct()
    shared = cut(distinct.groupBy("chunk_id").count().filter("count > 1").select("chunk_id"))
    rows = source.mapInArrow(recipes, f"id {id_type}, n long, sha string, recipe binary")
    if shared.isEmpty():
        rows = cut(rows)
    else:
        rows = cut(_verified(source, name, distinct, shared, id_type))

    first = F.min(F.struct(-F.col("n"), F.col("id").isNull(), F.col("id").alias("id")))
    groups = rows.groupBy("recipe").agg(first["id"].alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    copies = groups.filter("group_size > 1")
    out = join_salted(rows, copies, ["recipe"], "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _verified(source: DataFrame, name, distinct: DataFrame, shared: DataFrame, id_type: str) -> DataFrame:
    """Recipes of identifiers made distinct where different chunks share one.

    Such chunks get a number within their identifier; the recipes are put together anew.
    """
    order = Window.partitionBy("chunk_id").orderBy("chunk")
    numbers = distinct.join(shared, "chunk_id", "left_semi").withColumn("number", F.row_number().over(order))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            rows = [
                (k, len(texts[k] or ""), hashlib.sha256(raw).hexdigest(), pos, name(c), c)
                for k, raw, cs in chunks_of(texts)
                for pos, c in enumerate(cs or [b""])
            ]
            k, n, sha, pos, ids, c = zip(*rows) if rows else ((),) * 6
            take = pa.array(k, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(n, pa.int64()), pa.array(sha, pa.string()),
                 pa.array(pos, pa.int64()), pa.array(ids, pa.binary()), pa.array(c, pa.binary())],
                names=["row", "id", "n", "sha", "pos", "chunk_id", "chunk"],
            )

    keyed = source.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    schema = f"row long, id {id_type}, n long, sha string, pos long, chunk_id binary, chunk binary"
    exploded = join_salted(keyed.mapInArrow(parts, schema), numbers, ["chunk_id", "chunk"], "left")
    item = F.struct("pos", F.concat_ws(":", F.hex("chunk_id"), F.coalesce("number", F.lit(0)).cast("string")).alias("x"))
    return (
        exploded.groupBy("row", "id", "n", "sha")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
        .select("id", "n", "sha", F.array_join("items.x", ",").cast("binary").alias("recipe"))
    )
