"""Language identification by hyperdimensional profiles.

Every letter has a random vector of signs. The vector of an n-gram binds (multiplies)
its letters' vectors, each permuted by its place; a text's vector bundles (adds) those
of its n-grams, a language's prototype those of its texts. A text gets the language
whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricspark.llm.arrays import LETTER, classes, code_points, mix, slices
from metricspark.llm.common import sampled

#: Signs of a vector; letters of an n-gram; bits of a letter's code point, 0 standing for no letter.
DIMENSIONS, GRAM, BITS = 1024, 3, 21
#: N-grams whose vectors are multiplied at once.
BLOCK = 4096


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """One row of signs for each letter, from the hash of its code point."""
    words = np.arange(DIMENSIONS // 64, dtype=np.uint64) + np.uint64(20 << 32)
    bits = mix(mix(letters.astype(np.uint64))[:, None] + words * np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """Bound vectors of n-gram codes; the vector of a letter is rolled by its distance from the end."""
    out = np.ones((len(codes), DIMENSIONS), dtype=np.int8)
    for place in range(GRAM):
        found, back = np.unique(codes >> BITS * place & (1 << BITS) - 1, return_inverse=True)
        out *= np.roll(letter_vectors(found), place, axis=1)[back]
    return out.astype(np.float32)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts and where each text's begin; what isn't a letter is one 0."""
    cp, at = code_points([f" {t.lower()} " for t in texts])
    cp = cp.astype(np.int64)
    letter = classes(cp.astype(np.uint32)) == LETTER
    s = np.where(letter, cp, 0)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    keep[at[:-1]] = True
    return s[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def text_vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bundled vectors of the texts, and which have a letter."""
    s, at = symbols(texts)
    codes = np.zeros(max(0, len(s) - GRAM + 1), dtype=np.int64)
    for place in range(GRAM):
        codes += s[GRAM - 1 - place : len(s) - place] << BITS * place
    row = np.searchsorted(at, np.arange(len(codes)), side="right") - 1
    inside = np.arange(len(codes)) + GRAM <= at[row + 1]
    row, codes = row[inside], codes[inside]
    known, column = np.unique(codes, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float64)
    for b in range(0, len(known), BLOCK):
        n = min(BLOCK, len(known) - b)
        i, j = np.searchsorted(column, [b, b + n])
        counts = np.bincount(row[i:j] * n + column[i:j] - b, minlength=len(texts) * n)
        out += counts.reshape(len(texts), n).astype(np.float32) @ gram_vectors(known[b : b + n])
    some = np.concatenate([[0], np.cumsum(s > 0)])[at]
    return out, some[1:] > some[:-1]


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    prototypes: np.ndarray  # one row of length 1 for each


def fit(
    df: DataFrame, learn: Column, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> Profiles:
    """Prototypes of the languages of the rows that pass ``learn`` and have a language.

    At most about ``max_rows`` of them are read, chosen by a hash of the id. Texts count
    by their direction, so long ones don't outweigh the rest. What comes to the driver
    is one vector for each language.
    """
    rows = df.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).alias("id"))
    n = rows.count()
    if n > max_rows:
        rows = rows.filter(sampled(F.col("id"), 6, max_rows / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in slices(texts):
                vectors, some = text_vectors(texts[i:j])
                vectors = vectors[some] / np.maximum(np.linalg.norm(vectors[some], axis=1), 1e-12)[:, None]
                own = np.array(langs[i:j], dtype=object)[some]
                for x in set(own):
                    total[x] = total.get(x, 0) + vectors[own == x].sum(axis=0)
        names = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([total[x].tolist() for x in names], pa.list_(pa.float64()))],
            names=["lang", "vector"],
        )

    parts = rows.select("text", "lang").mapInArrow(run, "lang string, vector array<double>")
    cells = parts.select("lang", F.posexplode("vector").alias("place", "x"))
    # Rounded sums don't depend on the order in which tasks end.
    sums = cells.groupBy("lang", "place").agg(F.sum(F.col("x").cast("decimal(28,12)")).cast("double").alias("x"))
    found = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("v")).orderBy("lang").collect()
    prototypes = np.array([[c["x"] for c in r["v"]] for r in found]).reshape(-1, DIMENSIONS)
    # What all languages share tells none of them apart.
    if len(prototypes) > 1:
        prototypes = prototypes / np.linalg.norm(prototypes, axis=1)[:, None]
        prototypes = prototypes - prototypes.mean(axis=0)
    return Profiles([r["lang"] for r in found], prototypes / np.maximum(np.linalg.norm(prototypes, axis=1), 1e-12)[:, None])


def predict(df: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row: the language of largest cosine, and (1 + cosine) / 2.

    A text that is null or has no letter, and any text if no language was learned, is
    ``und`` with score 0. The first language in order wins a tie. Other columns are left
    out; no rows give none.
    """
    source = df.select(id_col, text_col)
    id_type = source.schema[id_col].dataType.simpleString()
    names = np.array([*profiles.languages, "und"], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for i, j in slices(texts):
                best, score = np.full(j - i, len(names) - 1), np.zeros(j - i)
                vectors, some = text_vectors(texts[i:j])
                if len(names) > 1 and some.any():
                    v = vectors[some] / np.maximum(np.linalg.norm(vectors[some], axis=1), 1e-12)[:, None]
                    cosines = v @ profiles.prototypes.T
                    best[some], score[some] = cosines.argmax(axis=1), np.clip((1 + cosines.max(axis=1)) / 2, 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(names[best], pa.string()), pa.array(score)],
                    names=[id_col, "lang_pred", "score"],
                )

    return source.mapInArrow(run, f"`{id_col}` {id_type}, lang_pred string, score double")
