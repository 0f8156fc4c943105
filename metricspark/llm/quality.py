"""Quality scores from preference pairs, by the Bradley-Terry model.

A document's strength is a linear function of features of its text. Of two documents
with different labels the better one should win; the logistic loss of the pairs'
feature differences gives the weights. A quantile of the learned strengths is the
threshold of acceptance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricspark.llm.arrays import LETTER, NUMBER, OTHER, SPACE, classes, code_points, mix, slices, words
from metricspark.llm.common import cut, mapped

#: Score at and above which a document is accepted.
ACCEPT = 0.7
#: Documents of the other label that each sampled document is compared with, and the weight of the
#: quadratic penalty for each pair.
OPPONENTS, PENALTY = 8, 1e-3


def sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def repeats(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many values of each row were there before in the same row."""
    out = np.zeros(len(at) - 1)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        s = np.sort(h[a:b])
        out[i] = np.count_nonzero(s[1:] == s[:-1])
    return out


def features(texts: list[str]) -> np.ndarray:
    """One row for each text; shares are of its characters or words, so length hardly counts."""
    cp, at = code_points(texts)
    k = classes(cp)
    n = np.maximum(np.diff(at), 1).astype(np.float64)
    upper = ((cp >= 0x41) & (cp <= 0x5A)) | ((cp >= 0xC0) & (cp <= 0xDE) & (cp != 0xD7))
    letters = np.maximum(sums(k == LETTER, at), 1)
    plain = np.isin(cp, [ord(c) for c in ".,;:'\"-()?"])
    h, wat = words(texts)
    m = np.diff(wat).astype(np.float64)
    many = np.maximum(m, 1)
    first = np.zeros(len(h), dtype=bool)
    starts = wat[:-1][np.diff(wat) > 0]
    first[starts] = True
    twice = np.zeros(len(h), dtype=bool)
    twice[1:] = h[1:] == h[:-1]
    twice[first] = False
    pair = h.copy()
    pair[1:] = mix(h[:-1]) ^ h[1:]
    triple = pair.copy()
    triple[2:] = mix(pair[1:-1]) ^ h[2:]
    again = repeats(h, wat) / many
    return np.column_stack(
        [
            sums(k == OTHER, at) / n,
            sums((k == OTHER) & ~plain, at) / n,
            np.sqrt(sums((k == OTHER) & ~plain, at) / n),
            sums(cp == ord("!"), at) / n,
            sums(cp == ord("|"), at) / n,
            sums(k == NUMBER, at) / n,
            sums(k == SPACE, at) / n,
            sums(cp == 10, at) / n,
            sums(upper, at) / letters,
            sums(twice, wat) / many,
            np.sqrt(sums(twice, wat) / many),
            again / np.log(many + 3),
            repeats(pair, wat) / many,
            repeats(triple, wat) / many,
            np.sqrt(repeats(triple, wat) / many),
            letters / many / 10,
            np.log1p(m) / 10,
            (m < 4).astype(np.float64),
        ]
    )


@dataclass(frozen=True)
class Ranking:
    """Weights of standardised features, and the strength at the threshold with its scale."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.deviation, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; ACCEPT at the threshold."""
        z = (self.strength(x) - self.threshold) / self.scale + np.log(ACCEPT / (1 - ACCEPT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(df: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 8) -> Ranking | None:
    """Learn from the documents of ``sample`` (id, label 0.0 or 1.0), which is bounded.

    Every sampled document meets OPPONENTS of the other label, paired by their place in a
    hashed order. Newton's steps sum gradient and curvature of the pairs' loss on the
    executors. The threshold is the quantile of the sample's strengths that splits the
    labels best. None if one label is missing.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(sample.select(F.col(id_col).alias("id"), "label")), "id")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in slices(texts):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i),
                     pa.array(list(features(texts[i:j])), pa.list_(pa.float64()))],
                    names=["id", "label", "x"],
                )

    id_type = rows.schema["id"].dataType.simpleString()
    described = cut(rows.select("id", "text", "label").mapInArrow(describe, f"id {id_type}, label double, x array<double>"))
    # The sample is bounded, so its features are: rows times 18 doubles.
    table = described.orderBy(F.xxhash64(F.lit(5), "id"), "id").toPandas()
    if table["label"].nunique() < 2:
        return None
    x, good = np.array(table["x"].tolist()), table["label"].to_numpy() > 0.5
    mean, deviation = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    turns = np.arange(OPPONENTS * max(len(better), len(worse)))
    pairs = np.column_stack([better[turns % len(better)], worse[(turns * 7919 + turns // len(worse)) % len(worse)]])
    spark = df.sparkSession
    z = np.clip((x - mean) / deviation, -8, 8)
    shared = spark.sparkContext.broadcast(z)
    games = cut(spark.createDataFrame(pa.table({"better": pairs[:, 0], "worse": pairs[:, 1]})).repartition(8))
    d = x.shape[1]

    def step(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g, c = np.zeros(d), np.zeros((d, d))
            for batch in batches:
                diff = shared.value[batch.column(0).to_numpy()] - shared.value[batch.column(1).to_numpy()]
                lose = 1 / (1 + np.exp(np.clip(diff @ weights, -30, 30)))
                g += lose @ diff
                c += (diff * (lose * (1 - lose))[:, None]).T @ diff
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([g, c.ravel()]).tolist()])], names=["s"])

        parts = sorted(r["s"] for r in games.mapInArrow(run, "s array<double>").collect())
        total = np.sum(np.array(parts), axis=0)
        return total[:d], total[d:].reshape(d, d)

    weights, ridge = np.zeros(d), PENALTY * len(pairs)
    for _ in range(rounds):
        g, c = step(weights)
        move = np.linalg.solve(c + ridge * np.eye(d), g - ridge * weights)
        weights = weights + move
        if np.abs(move).max() < 1e-4:
            break
    shared.unpersist()
    strengths = z @ weights
    levels = np.quantile(strengths, np.linspace(0, 1, 1001))
    balance = [(strengths[good] >= t).mean() + (strengths[~good] < t).mean() for t in levels]
    best = np.flatnonzero(np.isclose(balance, max(balance)))
    threshold = float(levels[best[len(best) // 2]])
    return Ranking(mean, deviation, weights, threshold, float(max(strengths.std() / 2, 1e-6)))


def score(df: DataFrame, model: Ranking | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row; predicted is 1 from ACCEPT on.

    Null counts as an empty text, which is scored like any other. Without a model every
    score is ACCEPT. Rows with the same or a null id stand for themselves; other columns
    are left out; no rows give none.
    """
    source = df.select(id_col, text_col)
    id_type = source.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in slices(texts):
                s = np.full(j - i, ACCEPT) if model is None else model.score(features(texts[i:j]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(s), pa.array((s >= ACCEPT).astype(np.int32))],
                    names=[id_col, "score", "predicted"],
                )

    return source.mapInArrow(run, f"`{id_col}` {id_type}, score double, predicted int")


def accepted(df: DataFrame, model: Ranking | None, text_col: str = "text") -> DataFrame:
    """The rows of df that ``score`` accepts, with all their columns.

    Null counts as an empty text, which is scored like any other. Without a model all
    rows stay; no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            for i, j in slices(texts):
                good = model.score(features(texts[i:j])) >= ACCEPT
                yield batch.slice(i, j - i).filter(pa.array(good))

    return df if model is None else mapped(df, run)
