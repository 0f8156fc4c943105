"""Hard negatives by bit-sliced integer products.

Vectors are integers and travel as bit planes. A block of candidates meets a block of
anchors; the planes are taken most significant first. What is known of a candidate after
some planes puts its score into an interval: the planes to come add at most their weights
times the anchor's positive components, and take off at most those times its negative ones.
A pair is dropped once its interval lies outside the band of scores that is asked for, or
below the scores already found; what is left after the last plane has its exact score.

Positives come from blocks of one label, negatives from blocks of all rows. Anchors and
candidates are both dealt into blocks, so that no task holds more than two of them, however
many rows there are or share a label. The number of pairs is anchors times rows, which is
what the search is asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricspark.llm.common import by_group, cut, join_salted


@dataclass(frozen=True)
class Mining:
    """positives, negatives: of an anchor, of a pair; low, high: a negative's score as shares (numerator, denominator) of the
    positive's; anchors, rows: of a block at most; scale: of components."""

    positives: int = 5
    negatives: int = 10
    low: tuple[int, int] = (30, 100)
    high: tuple[int, int] = (90, 100)
    anchors: int = 4096
    rows: int = 65_536
    scale: int = 256


#: Vectors of this length or more have products beyond 64 bits and take no part.
LONGEST = 2.0**31
#: Planes of the first product: fewer leave intervals that hold every score.
FIRST = 6
#: Anchors that are compared at once, and candidates at first and at most.
STRIP, CANDIDATES = 512, (256, 4096)
#: Below this share of pairs left, they are looked at one by one.
SPARSE = 0.05
#: Pairs of which components are gathered at once.
GATHER = 1 << 15
NONE = -(1 << 62)


def finite(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the lists of each length."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        places = np.flatnonzero(size == n)
        yield places, column.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).reshape(len(places), int(n))


def packed(q: np.ndarray) -> list[bytes]:
    """Rows of integers as bit planes: the number of planes, that of components, the planes of the two's complement, highest first."""
    width = 1 + np.frexp(np.where(q < 0, ~q, q).max(axis=1, initial=0).astype(np.float64))[1]
    out: list[bytes] = [b""] * len(q)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        planes = (q[rows][:, None, :] >> np.arange(w - 1, -1, -1)[None, :, None]) & 1
        raw = np.packbits(planes.astype(np.uint8), axis=2).reshape(len(rows), -1)
        head = bytes([w]) + int(q.shape[1]).to_bytes(4, "little")
        for i, r in zip(rows, raw):
            out[i] = head + r.tobytes()
    return out


def unpacked(column: pa.ChunkedArray) -> np.ndarray:
    """Integers of packed rows; shorter ones are filled up with zeros."""
    raw = column.to_pylist()
    size = [int.from_bytes(r[1:5], "little") for r in raw]
    out = np.zeros((len(raw), max(size, default=0)), dtype=np.int64)
    forms: dict[tuple[int, int], list[int]] = {}
    for i, (r, n) in enumerate(zip(raw, size)):
        forms.setdefault((r[0], n), []).append(i)
    for (w, n), rows in forms.items():
        if n:
            bits = np.frombuffer(b"".join(raw[i][5:] for i in rows), dtype=np.uint8).reshape(len(rows), w, -1)
            weights = np.left_shift(np.int64(1), np.arange(w - 1, -1, -1))
            weights[0] *= -1
            out[np.array(rows), :n] = np.einsum("nwd,w->nd", np.unpackbits(bits, axis=2)[:, :, :n].astype(np.int64), weights)
    return out


class Top:
    """The best k scores of every request of every anchor, in order, ties to the smaller id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.score = np.full((*low.shape, k), NONE, dtype=np.int64)
        self.id = np.zeros((*low.shape, k), dtype=np.int64)

    def band(self, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that some request of each anchor can use."""
        least = np.maximum(self.low[rows], self.score[rows, :, -1])
        return least.min(axis=1), self.high[rows].max(axis=1)

    def add(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        for p in range(self.low.shape[1]):
            fit = (score >= np.maximum(self.low[row, p], self.score[row, p, -1])) & (score <= self.high[row, p])
            if not fit.any():
                continue
            own = np.unique(row[fit])
            r = np.concatenate([np.repeat(own, self.k), row[fit]])
            s = np.concatenate([self.score[own, p].ravel(), score[fit]])
            i = np.concatenate([self.id[own, p].ravel(), ids[fit]])
            order = np.lexsort((i, -s, r))
            r, s, i = r[order], s[order], i[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            keep = (rank < self.k) & (s > NONE)
            self.score[own, p], self.id[own, p] = NONE, 0
            self.score[r[keep], p, rank[keep]], self.id[r[keep], p, rank[keep]] = s[keep], i[keep]


def arithmetic(a: np.ndarray, width: int):
    """The fastest numbers that hold every partial product exactly."""
    most = 2 * int(np.abs(a).sum(axis=1).max(initial=0)) << (width - 1)
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object


def search(a: np.ndarray, q: np.ndarray, ids: np.ndarray, top: Top, fits) -> None:
    """Put the scores of rows q of anchors a into ``top``, of pairs that ``fits(anchors, rows)`` holds for."""
    if not len(a) or not len(q) or not top.low.size:
        return
    width = 1 + int(max(np.where(q < 0, ~q, q).max(initial=0), 0)).bit_length()
    number = arithmetic(a, width)
    limit = {np.float32: 1 << 24, np.float64: 1 << 53}.get(number, 1 << 62)
    first = max(0, width - FIRST)
    high = ((q >> first) << first).astype(number)
    for x in range(0, len(a), STRIP):
        rows = slice(x, min(x + STRIP, len(a)))
        own = a[rows].astype(number)
        up, down = np.maximum(a[rows], 0).sum(axis=1), np.minimum(a[rows], 0).sum(axis=1)
        y, step = 0, CANDIDATES[0]
        while y < len(q):
            part = slice(y, min(y + step, len(q)))
            found = planes(own, a[rows], q[part], high[part], first, up, down, top.band(rows), number, limit)
            i, j, score = found
            good = fits(i + x, j + y)
            top.add(i[good] + x, ids[j[good] + y], score[good].astype(np.int64))
            y, step = part.stop, min(2 * step, CANDIDATES[1])


def planes(own, a, q, high, rest, up, down, band, number, limit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs whose score lies in their anchor's band."""

    def bounds(rest: int) -> tuple[np.ndarray, np.ndarray]:
        open_, more = (1 << rest) - 1, object if number is object else np.int64
        low = np.clip(band[0].astype(more) - open_ * up.astype(more), -limit, limit)
        top = np.clip(band[1].astype(more) - open_ * down.astype(more), -limit, limit)
        return low.astype(number), top.astype(number)

    score = own @ high.T
    low, top = bounds(rest)
    left = (score >= low[:, None]) & (score <= top[:, None])
    while rest and left.sum() > SPARSE * left.size:
        rest -= 1
        score = score + (own @ ((q >> rest) & 1).astype(number).T) * number(1 << rest) if number is not object else score + (own @ ((q >> rest) & 1).astype(object).T) * (1 << rest)
        low, top = bounds(rest)
        left = (score >= low[:, None]) & (score <= top[:, None])
    i, j = np.nonzero(left)
    s = score[i, j].astype(object if number is object else np.int64)
    while rest and len(i):
        rest -= 1
        for at in range(0, len(i), GATHER):
            g = slice(at, at + GATHER)
            bit = (q[j[g]] >> rest) & 1
            s[g] += (a[i[g]].astype(object) * bit).sum(axis=1) * (1 << rest) if number is object else (a[i[g]] * bit).sum(axis=1) << rest
        low, top = bounds(rest)
        more = (s >= low[i]) & (s <= top[i])
        i, j, s = i[more.astype(bool)], j[more.astype(bool)], s[more.astype(bool)]
    return i, j, s


def shares(score: np.ndarray, low: tuple[int, int], high: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest integers between the shares of a score, without products beyond 64 bits."""
    up = lambda n, d: score // d * n - -(score % d) * n // d
    return up(*low), score // high[1] * high[0] + score % high[1] * high[0] // high[1]


ROWS = "id long, label long, is_anchor boolean, planes binary"


def integers(df: DataFrame, is_anchor: Column, p: Mining, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, is_anchor, planes) of the rows that take part."""
    source = df.select(
        df[f"`{id_col}`"].cast("long").alias("id"), df[f"`{label_col}`"].cast("long").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), df[f"`{vector_col}`"].cast("array<double>").alias("x"),
    )
    source = source.filter(finite(F.col("x")) & F.col("id").isNotNull() & F.col("label").isNotNull())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, x in by_size(batch.column("x")):
                with np.errstate(over="ignore"):
                    x = np.floor(x * p.scale)
                    held = np.flatnonzero((x * x).sum(axis=1) < LONGEST**2)
                part = batch.take(pa.array(places[held])).select(["id", "label", "is_anchor"])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(packed(x[held].astype(np.int64)), pa.binary())], names=["id", "label", "is_anchor", "planes"])

    return cut(source.mapInArrow(pack, ROWS))


def dealt(rows: DataFrame, anchors: DataFrame, group: str, p: Mining) -> DataFrame:
    """Rows and anchors of each group in every pair of their blocks: (group, ablock, rblock, asked, id, label, planes, positives)."""
    wide = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = F.col("n")
    # Blocks of few rows are made as long as there are free tasks for them.
    size = F.least(F.lit(p.rows), F.greatest(F.lit(min(1024, p.rows)), F.ceil(n / wide)))
    count = rows.groupBy(F.col(group).alias("group")).agg(F.count(F.lit(1)).alias("n"))
    asked = anchors.groupBy(F.col(group).alias("group")).agg(F.ceil(F.count(F.lit(1)) / p.anchors).alias("ablocks"))
    count = cut(count.join(asked, "group").select("group", "ablocks", F.ceil(n / size).alias("rblocks")))
    own = lambda c: F.pmod(F.xxhash64(F.lit(11), "id", "label"), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    out = ["group", "ablock", "rblock", "asked", "id", "label", "planes", "positives"]

    def side(d: DataFrame, ablock: Column, rblock: Column, asked: bool) -> DataFrame:
        d = join_salted(d.withColumn("group", F.col(group)), count, ["group"], "inner").withColumn("asked", F.lit(asked))
        return d.withColumn("ablock", ablock).withColumn("rblock", rblock).select(out)

    positives = F.lit(None).cast("array<struct<positive: long, score: long>>")
    left = side(rows.withColumn("positives", positives), every("ablocks"), own("rblocks"), False)
    right = side(anchors if "positives" in anchors.columns else anchors.withColumn("positives", positives), own("ablocks"), every("rblocks"), True)
    return left.unionByName(right)


def single(t: pa.Table, asked: np.ndarray) -> np.ndarray:
    """Places of the rows without those that repeat an id and a label."""
    keys = np.stack([asked, t.column("id").to_numpy(), t.column("label").to_numpy()])
    order = np.lexsort(keys)
    again = (keys[:, order][:, 1:] == keys[:, order][:, :-1]).all(axis=0)
    if not again.any():
        return np.arange(len(order))
    keep: dict[tuple, tuple[bytes, int]] = {}
    for i, (key, planes) in enumerate(zip(keys.T.tolist(), t.column("planes").to_pylist())):
        keep[tuple(key)] = min(keep.get(tuple(key), (planes, i)), (planes, i))
    return np.array(sorted(i for _, i in keep.values()))


FOUND = "id long, label long, positive long, positive_score long, other long, score long"


def meeting(t: pa.Table, k: int, p: Mining) -> pa.RecordBatch | None:
    """What one block of rows has for one block of anchors: the best k rows of each anchor, or of each of its positives."""
    asked = t.column("asked").to_numpy()
    t = t.take(pa.array(single(t, asked)))
    asked = t.column("asked").to_numpy()
    at, rt = t.filter(pa.array(asked)), t.filter(pa.array(~asked))
    if not at.num_rows or not rt.num_rows:
        return None
    aid, alabel = at.column("id").to_numpy(), at.column("label").to_numpy()
    rid, rlabel = rt.column("id").to_numpy(), rt.column("label").to_numpy()
    both = unpacked(pa.chunked_array([*at.column("planes").chunks, *rt.column("planes").chunks]))
    a, q = both[: len(aid)], both[len(aid) :]
    lists = at.column("positives").to_pylist()
    if lists[0] is None:
        low, high = np.full((len(aid), 1), NONE, dtype=np.int64), np.full((len(aid), 1), -NONE, dtype=np.int64)
        fits = lambda i, j: aid[i] != rid[j]
    else:
        many = max(map(len, lists))
        low, high = np.full((len(aid), many), -NONE, dtype=np.int64), np.full((len(aid), many), NONE, dtype=np.int64)
        for i, own in enumerate(lists):
            low[i, : len(own)], high[i, : len(own)] = shares(np.array([x["score"] for x in own], dtype=np.int64), p.low, p.high)
        fits = lambda i, j: alabel[i] != rlabel[j]
    top = Top(low, high, k)
    search(a, q, rid, top, fits)
    i, r, _ = np.nonzero(top.score > NONE)
    other, score = top.id[top.score > NONE], top.score[top.score > NONE]
    if lists[0] is None:
        asked_for = [pa.nulls(len(i), pa.int64())] * 2
    else:
        asked_for = [pa.array([lists[x][y][c] for x, y in zip(i, r)], pa.int64()) for c in ("positive", "score")]
    return pa.RecordBatch.from_arrays([pa.array(aid[i]), pa.array(alabel[i]), *asked_for, pa.array(other), pa.array(score)], names=[x.split()[0] for x in FOUND.split(", ")])


def best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k of what all blocks found, with their rank; Spark keeps k of each key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "other"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(
    df: DataFrame, is_anchor: Column, p: Mining = Mining(), id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x); a score is the integer product of two vectors.
    An anchor's positives are its best other rows of the same label. A positive's
    negatives are the anchor's best rows of other labels with a score between two shares of
    the positive's. Higher scores come first, ties by smaller id.

    Rows take no part that have a null id, label or vector, a null or non-finite component, or
    a vector so long (2**31) that a product may exceed 64 bits. Shorter vectors are filled up
    with zeros, an empty one is zero. Rows that repeat an id and a label count once, with the
    vector whose planes come first in the order of bytes. An id with several labels takes
    part with each. An empty table has none.
    """
    rows = integers(df, is_anchor, p, id_col, label_col, vector_col)
    anchors = cut(rows.filter("is_anchor").groupBy("id", "label").agg(F.min("planes").alias("planes")))
    run = lambda k: lambda _, t: meeting(t, k, p)
    keys = ["group", "ablock", "rblock"]
    near = by_group(dealt(rows, anchors, "label", p), keys, run(p.positives), FOUND)
    near = best(near, ["id", "label"], p.positives)
    lists = near.groupBy("id", "label").agg(F.collect_list(F.struct(F.col("other").alias("positive"), "score")).alias("positives"))
    anchors = cut(anchors.join(lists, ["id", "label"]))
    everything = lambda d: d.withColumn("all", F.lit(0).cast("long"))
    negatives = by_group(dealt(everything(rows), everything(anchors), "all", p), keys, run(p.negatives), FOUND)
    negatives = best(negatives, ["id", "label", "positive", "positive_score"], p.negatives)
    return negatives.select(
        F.col("id").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
