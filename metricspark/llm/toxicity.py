"""Toxicity scores by FTRL-proximal logistic regression over hashed word grams.

A document's features are its words, pairs of neighbours and pairs with one word between
them, hashed. Every coordinate has its own learning rate; the L1 term leaves few weights
other than zero, which makes a small model to broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricspark.llm.arrays import mix, slices, words

#: Hashed coordinates; the last is the constant.
BITS = 20
#: Score from which a document counts as toxic.
TOXIC = 0.5


@dataclass(frozen=True)
class Rates:
    """Parameters of FTRL-proximal.

    The L1 term is ``l1`` times the square root of a shard's toxic rows, so a coordinate
    needs more than a few of them to get a weight. ``positive`` weighs toxic rows.
    """

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.36
    l2: float = 0.1
    positive: float = 3.0
    epochs: int = 2


def gram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of all grams of the texts, repeats included."""
    h, at = words(texts, seed=9)
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    shift = np.uint64(64 - BITS)
    rows, found = [row], [mix(h) >> shift]
    for gap, tag in ((1, 0x51ED), (2, 0x7A31)):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            pair = mix(h[:-gap] + np.uint64(tag)) ^ h[gap:]
            rows.append(row[:-gap][same])
            found.append(mix(pair[same]) >> shift)
    return np.concatenate(rows), np.concatenate(found).astype(np.int64)


def distinct(row: np.ndarray, coordinate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each coordinate once for each row, by row."""
    key = np.unique(row << BITS | coordinate)
    return key >> BITS, key & ((1 << BITS) - 1)


class Ftrl:
    """The learner's state: sums of adjusted gradients and of squared gradients."""

    def __init__(self, rates: Rates, toxic_rows: int):
        self.rates = rates
        self.l1 = rates.l1 * max(1, toxic_rows) ** 0.5
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, i: np.ndarray) -> np.ndarray:
        r, z = self.rates, self.z[i]
        w = -(z - np.sign(z) * self.l1) / ((r.beta + np.sqrt(self.n[i])) / r.alpha + r.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, i: np.ndarray, label: float) -> None:
        w = self.weights(i)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
        g = (p - label) * (self.rates.positive if label > 0.5 else 1.0)
        step = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.rates.alpha
        self.z[i] += g - step * w
        self.n[i] += g * g


@dataclass(frozen=True)
class Model:
    """Coordinates with a weight, their weights, and the constant."""

    coordinates: np.ndarray
    weights: np.ndarray
    constant: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, dtype=np.float32)
        out[self.coordinates] = self.weights
        return out


def fit(
    df: DataFrame,
    sample: DataFrame,
    rates: Rates = Rates(),
    shards: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Learn from the documents of ``sample`` (id, label 0.0 or 1.0), which is bounded.

    The sample is dealt over ``shards``, one unless it is made larger; each learns on its own, in an order set by a hash
    of the id, and the shards' weights are averaged. Only weights other than zero leave
    a shard.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(sample.select(F.col(id_col).alias("id"), "label")), "id")
    rows = rows.select(
        F.pmod(F.xxhash64(F.lit(91), "id"), F.lit(shards)).cast("int").alias("shard"),
        F.xxhash64(F.lit(92), "id").alias("turn"),
        F.xxhash64("text").alias("tie"),
        "label",
        F.coalesce("text", F.lit("")).alias("text"),
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct coordinates instead of texts, so no text is shuffled."""
        for batch in batches:
            texts = batch.column(4).to_pylist()
            for i, j in slices(texts):
                row, c = distinct(*gram_hashes(texts[i:j]))
                ends = np.searchsorted(row, np.arange(j - i + 1))
                raw = c.astype("<i4").tobytes()
                packed = [raw[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], pa.array(packed, pa.binary())], names=["shard", "turn", "tie", "label", "c"]
                )

    rows = rows.mapInArrow(hashed, "shard int, turn long, tie long, label double, c binary")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("turn", "ascending"), ("tie", "ascending")])
        labels = table.column("label").to_pylist()
        coordinates = [np.frombuffer(c, dtype="<i4") for c in table.column("c").to_pylist()]
        examples = [(np.append(c, np.int32(1 << BITS)), label) for c, label in zip(coordinates, labels)]
        learner = Ftrl(rates, sum(x > 0.5 for x in labels))
        for _ in range(rates.epochs):
            for c, label in examples:
                learner.learn(c, label)
        w = learner.weights(np.arange((1 << BITS) + 1))
        some = np.flatnonzero(w)
        return pa.table({"coordinate": pa.array(some, pa.int32()), "w": pa.array(w[some])})

    parts = rows.groupBy("shard").applyInArrow(run, "coordinate int, w double")
    mean = parts.groupBy("coordinate").agg((F.sum(F.col("w").cast("decimal(28,14)")) / shards).cast("double").alias("w"))
    found = mean.orderBy("coordinate").toPandas()  # 2**BITS + 1 rows at most
    c, w = found["coordinate"].to_numpy(np.int64), found["w"].to_numpy(np.float64)
    constant = float(w[c == 1 << BITS].sum())
    return Model(c[c < 1 << BITS], w[c < 1 << BITS], constant)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row; predicted is 1 from TOXIC on.

    Null counts as an empty text, whose score is the constant's. Rows with the same or a
    null id stand for themselves; other columns are left out; no rows give none.
    """
    source = df.select(id_col, text_col)
    id_type = source.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.dense()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in slices(texts):
                row, c = gram_hashes(texts[i:j])
                some = weights[c] != 0
                row, c = distinct(row[some], c[some])
                z = model.constant + np.bincount(row, weights=weights[c], minlength=j - i)
                s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(s), pa.array((s >= TOXIC).astype(np.int32))],
                    names=[id_col, "score", "predicted"],
                )

    return source.mapInArrow(run, f"`{id_col}` {id_type}, score double, predicted int")
