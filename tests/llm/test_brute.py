"""Learned operators against plain loops: features and ranking, bound letters, and the FTRL learner."""

import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from metricspark.llm import language, quality, toxicity
from metricspark.llm import queries as Q
from metricspark.llm.arrays import WHITE_SPACE
from metricspark.llm.common import bucket, labelled_sample, table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SMALL}/documents.parquet")


def kind(ch):
    return "S" if ch in WHITE_SPACE else {"L": "L", "N": "N"}.get(unicodedata.category(ch)[0], "O")


def plain_features(text):
    k = Counter(kind(c) for c in text)
    n = max(1, len(text))
    w = re.findall(r"[^\W_]+", text.lower())
    w = ["".join(c for c in x if kind(c) in "LN") for x in w]
    m = max(1, len(w))
    odd = sum(kind(c) == "O" and c not in ".,;:'\"-()?" for c in text) / n
    twice = sum(a == b for a, b in zip(w, w[1:])) / m
    again = lambda xs: (len(xs) - len(set(xs))) / m
    pairs = [(None, w[0])] * bool(w) + list(zip(w, w[1:]))
    triples = [(None, *p) if i < 2 else (w[i - 2], *p) for i, p in enumerate(pairs)]
    letters = max(1, k["L"])
    upper = sum("A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") for c in text) / letters
    return [
        k["O"] / n, odd, odd**0.5, text.count("!") / n, text.count("|") / n, k["N"] / n, k["S"] / n, text.count("\n") / n, upper,
        twice, twice**0.5, again(w) / math.log(m + 3), again(pairs), again(triples), again(triples) ** 0.5, letters / m / 10, math.log1p(len(w)) / 10, float(len(w) < 4),
    ]


def test_quality_features_and_ranking(spark, documents):
    """Features equal plain counts; the weights are where the gradient of all games' loss is nought; scores follow from them."""
    texts = [t or "" for t in documents.text]
    x = quality.features(texts)
    plain = np.array([plain_features(t) for t in texts])
    counted = [i for i in range(18) if i not in (12, 13, 14)]
    assert np.allclose(x[:, counted], plain[:, counted], atol=1e-9)
    assert np.abs(x[:, 12:14] - plain[:, 12:14]).max() < 0.51  # a text's first words count as pairs with nothing
    labels = table(spark, SMALL, "labels")
    sample = labelled_sample(labels, bucket(F.col("doc_id"), 4) != 2, "quality", max_rows=20_000)
    model = quality.fit(table(spark, SMALL, "documents"), sample)
    order = sample.select("doc_id", "label").join(table(spark, SMALL, "documents").select("doc_id"), "doc_id").orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").toPandas()
    by_id = {i: row for i, row in zip(documents.doc_id, x)}
    z = np.array([by_id[i] for i in order.doc_id])
    z = np.clip((z - z.mean(axis=0)) / np.maximum(z.std(axis=0), 1e-6), -8, 8)
    good, bad = np.flatnonzero(order.label > 0.5), np.flatnonzero(order.label < 0.5)
    gradient, games = np.zeros(18), quality.OPPONENTS * max(len(good), len(bad))
    for t in range(games):
        a, b = z[good[t % len(good)]], z[bad[(t * 7919 + t // len(bad)) % len(bad)]]
        gradient += (a - b) / (1 + math.exp(float((a - b) @ model.weights)))
    assert np.abs(gradient - quality.PENALTY * games * model.weights).max() < 1e-2 * games**0.5
    rows = Q.op5_quality(spark, SMALL).toPandas().set_index("doc_id").score.reindex(documents.doc_id)
    strength = np.clip((x - model.mean) / model.deviation, -8, 8) @ model.weights
    want = 1 / (1 + np.exp(-np.clip((strength - model.threshold) / model.scale + math.log(0.7 / 0.3), -30, 30)))
    assert np.allclose(rows.to_numpy(), want, atol=1e-9)


def test_language_against_bound_letters(spark, documents):
    """Every trigram's vector bound letter by letter and added up in a loop gives the same languages and scores."""
    vectors = {}

    def letter(ch):
        if ch not in vectors:
            code = 0 if ch == " " else ord(ch)
            vectors[ch] = language.letter_vectors(np.array([code]))[0].astype(np.int64)
        return vectors[ch]

    def bundle(text):
        s = re.sub(" +", " ", "".join(c if unicodedata.category(c)[0] == "L" else " " for c in f" {text.lower()} "))
        total = np.zeros(language.DIMENSIONS)
        for gram, n in Counter(s[i : i + 3] for i in range(len(s) - 2)).items():
            total += n * np.roll(letter(gram[0]), 2) * np.roll(letter(gram[1]), 1) * letter(gram[2])
        return total / max(np.linalg.norm(total), 1e-12), any(c != " " for c in s)

    own = [bundle(t or "") for t in documents.text]
    learned = {}
    for (v, some), i, lang in zip(own, documents.doc_id, documents.lang):
        if some and lang is not None and zlib.crc32(str(i).encode()) % 5:
            learned[lang] = learned.get(lang, 0) + v
    names = sorted(learned)
    p = np.array([learned[x] / np.linalg.norm(learned[x]) for x in names])
    p -= p.mean(axis=0)
    p /= np.linalg.norm(p, axis=1)[:, None]
    rows = Q.op6_language(spark, SMALL).toPandas().set_index("doc_id")
    for (v, some), r in zip(own, documents.itertuples()):
        cosines = p @ v
        if not some or r.text is None:
            assert rows.lang_pred[r.doc_id] == "und"
            continue
        assert abs(rows.score[r.doc_id] - (1 + cosines.max()) / 2) < 1e-5
        assert rows.lang_pred[r.doc_id] == names[int(cosines.argmax())] or np.ptp(np.sort(cosines)[-2:]) < 1e-5


def test_toxicity_against_a_loop(spark, documents):
    """FTRL-proximal with a dictionary for each sum, one example after the other."""
    rates = toxicity.Rates()
    labels = table(spark, SMALL, "labels")
    sample = labelled_sample(labels, bucket(F.col("doc_id"), 5) != 0, "toxic", max_rows=16_000)
    order = sample.orderBy(F.xxhash64(F.lit(92), "doc_id")).toPandas()
    text = dict(zip(documents.doc_id, documents.text))
    order = order[order.doc_id.isin(text)]

    def coordinates(t):
        return sorted(set(toxicity.gram_hashes([t or ""])[1].tolist())) + [1 << toxicity.BITS]

    l1 = rates.l1 * max(1, int((order.label > 0.5).sum())) ** 0.5
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        if abs(zi) <= l1:
            return 0.0
        return -(zi - math.copysign(l1, zi)) / ((rates.beta + math.sqrt(n.get(i, 0.0))) / rates.alpha + rates.l2)

    for _ in range(rates.epochs):
        for doc_id, label in zip(order.doc_id, order.label):
            c = coordinates(text[doc_id])
            w = [weight(i) for i in c]
            g = (1 / (1 + math.exp(-max(-30, min(30, sum(w))))) - label) * (rates.positive if label > 0.5 else 1.0)
            for i, wi in zip(c, w):
                step = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / rates.alpha
                z[i] = z.get(i, 0.0) + g - step * wi
                n[i] = n.get(i, 0.0) + g * g
    rows = Q.op9_toxicity(spark, SMALL).toPandas().set_index("doc_id")
    for r in documents.itertuples():
        s = sum(weight(i) for i in coordinates(r.text))
        assert abs(rows.score[r.doc_id] - 1 / (1 + math.exp(-max(-30, min(30, s))))) < 1e-5


def test_learners_without_much_to_learn_from(spark):
    """Empty samples, one label, nulls and repeated ids neither crash nor reject."""
    docs = spark.createDataFrame([(1, "good words here"), (2, None), (2, "again"), (3, ""), (None, "x")], "doc_id long, text string")
    for rows in ([], [(1, 1.0)], [(1, 1.0), (2, 1.0)]):
        sample = spark.createDataFrame(rows, "doc_id long, label double")
        assert quality.fit(docs, sample) is None
        model = toxicity.fit(docs, sample)
        assert toxicity.score(docs, model).count() == 5
    assert quality.accepted(docs, None).count() == 5
    both = spark.createDataFrame([(1, 1.0), (2, 0.0)], "doc_id long, label double")
    assert quality.accepted(docs, quality.fit(docs, both)).columns == docs.columns
