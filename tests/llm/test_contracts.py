"""Every query over the smallest tables against a brute-force version."""

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from metricspark.llm import queries as Q
from metricspark.llm.bpe import tokenizer_path
from metricspark.llm.common import table

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SMALL}/documents.parquet")


def library(name):
    t = Tokenizer.from_file(tokenizer_path(name))
    t.no_padding()
    t.no_truncation()
    return t


def u32(ids):
    return np.array(ids, dtype="<u4").tobytes()


def check_packing(rows, documents):
    t = library("word_bpe_49k.json")
    ids = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [1] for r in documents.itertuples()}
    assert set(rows.doc_id) == set(ids)
    for doc_id, own in rows.sort_values("start").groupby("doc_id"):
        at = 0
        for r in own.itertuples():
            assert r.start == at and r.doc_tokens == len(ids[doc_id])
            assert r.ids_crc32 == zlib.crc32(u32(ids[doc_id][at : at + r.length]))
            at += r.length
        assert at == len(ids[doc_id])
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        at = 0
        for r in own.itertuples():
            assert r.offset == at
            at += r.length
        assert at <= 2048 and len(own) <= 128
    assert rows.n_loss.groupby(rows.sequence_id).sum().max() <= 2047


def test_packing(spark, documents):
    rows = Q.op1_packing(spark, SMALL).toPandas()
    check_packing(rows, documents)
    assert rows.length.sum() / (2048 * rows.sequence_id.nunique()) > 0.8


def test_bpe(spark, documents):
    rows = Q.op2_bpe(spark, SMALL).toPandas().set_index("doc_id")
    t = library("byte_bpe_50k.json")
    assert len(rows) == len(documents)
    for r in documents.itertuples():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert rows.n_tokens[r.doc_id] == len(ids)
        assert rows.ids_sha256[r.doc_id] == hashlib.sha256(u32(ids)).hexdigest()
        text = t.decode(ids, skip_special_tokens=False)
        assert rows.decoded_sha256[r.doc_id] == hashlib.sha256(text.encode()).hexdigest()


def test_exact_dedup(spark):
    rows = Q.op3_exact_dedup(spark, MIDDLE).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{MIDDLE}/documents.parquet'")
    want = con.execute(Q.OP3_SQL).df()
    by = lambda d: d.sort_values("doc_id").reset_index(drop=True)[sorted(d.columns)]
    pd.testing.assert_frame_equal(by(rows), by(want), check_dtype=False)


def reach(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_neighbours(spark):
    rows = Q.op4_neighbours(spark, SMALL).toPandas().set_index("vec_id")
    e = pd.read_parquet(f"{SMALL}/embeddings.parquet")
    v = np.array(e.embedding.tolist(), dtype=np.float64)
    v /= np.linalg.norm(v, axis=1)[:, None]
    close = np.argwhere(np.triu(v @ v.T >= 0.9, 1))
    ids = e.vec_id.to_numpy()
    want = pd.Series(0, index=ids)
    for i, j in close:
        want[ids[i]] += 1
        want[ids[j]] += 1
    root = reach(ids.tolist(), [(ids[i], ids[j]) for i, j in close])
    assert len(rows) == len(e)
    assert (rows.n_links.reindex(ids) <= want).all()
    assert rows.n_links.sum() >= 0.97 * want.sum()
    assert np.mean([rows.component_id[i] == root[i] for i in ids]) > 0.97
    assert (rows.kept == (rows.index == rows.component_id)).all()


def auc(score, label):
    rank = pd.Series(score).rank().to_numpy()
    good = np.asarray(label) == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def labelled(rows, column):
    labels = pd.read_parquet(f"{MIDDLE}/labels.parquet").dropna(subset=[column])
    return rows.merge(labels, on="doc_id").query("held_out")


def test_quality(spark):
    rows = Q.op5_quality(spark, MIDDLE).toPandas()
    assert len(rows) == 1000 and rows.score.between(0, 1).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    assert (rows.predicted == (rows.score >= 0.7)).all()
    held = labelled(rows, "quality")
    assert auc(held.score, held.quality) > 0.9 and (held.predicted == held.quality).mean() > 0.85


def test_language(spark):
    rows = Q.op6_language(spark, MIDDLE).toPandas()
    documents = pd.read_parquet(f"{MIDDLE}/documents.parquet")
    assert len(rows) == len(documents) and rows.score.between(0, 1).all()
    held = rows[rows.held_out].merge(documents, on="doc_id").dropna(subset=["lang"])
    held = held[held.text.fillna("").str.len() >= 60]
    assert (held.lang == held.lang_pred).mean() > 0.95


def test_toxicity(spark):
    rows = Q.op9_toxicity(spark, MIDDLE).toPandas()
    assert len(rows) == 1000 and (rows.predicted == (rows.score >= 0.5)).all()
    held = labelled(rows, "toxic")
    assert auc(held.score, held.toxic) > 0.85


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd = [int(d) for d in digits[-1::-2]]
    even = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def base_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), n, m.end(), kind))
    return [(k, a, b) for a, _, b, k in sorted(out)]


def test_pii(spark):
    rows = Q.op7_pii(spark, MIDDLE).toPandas().set_index("doc_id")
    for r in pd.read_parquet(f"{MIDDLE}/documents.parquet").itertuples():
        want = base_spans(r.text or "")
        got = rows.loc[r.doc_id]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [got[f"n_{k}"] for k in BASE] == [sum(w[0] == k for w in want) for k in BASE]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(got.spans.split(","))


def grams(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_join(documents):
    sets = {r.doc_id: grams(r.text) for r in documents.itertuples()}
    held = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            held[g].append(i)
    pairs = {p for ids in held.values() for p in combinations(sorted(ids), 2)}
    return sets, [(a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]


def test_ngram_join(spark):
    documents = pd.read_parquet(f"{MIDDLE}/documents.parquet")
    rows = Q.op8_ngram_join(spark, MIDDLE).toPandas().set_index("doc_id")
    sets, links = brute_join(documents)
    want = pd.Series(0, index=list(sets))
    for a, b in links:
        want[a] += 1
        want[b] += 1
    root = reach(list(sets), links)
    assert len(rows) == len(documents)
    assert (rows.n_links.reindex(want.index) == want).all()
    assert all(rows.class_id[i] == root[i] for i in sets)


def test_token_counts(spark, documents):
    rows = Q.op10_token_counts(spark, SMALL).toPandas()
    t = library("byte_bpe_50k.json")
    text = documents.set_index("doc_id").text
    for doc_id, own in rows.groupby("doc_id"):
        e = t.encode(text[doc_id] or "", add_special_tokens=False)
        begins = np.array([a for a, _ in e.offsets])
        own = own.sort_values("section")
        assert own.n_tokens.sum() == len(e.ids) == own.doc_tokens.iloc[0]
        for r in own.itertuples():
            assert r.n_tokens == ((begins >= r.start) & (begins < r.end)).sum()


def test_pipeline(spark, documents):
    docs = table(spark, SMALL, "documents")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        kept.append(out.toPandas())
        docs = spark.createDataFrame(kept[-1], docs.schema)
    good, exact, near, clean = kept
    model = Q.quality_model(spark, SMALL)
    from metricspark.llm.quality import features

    scores = model.score(features([t or "" for t in documents.text]))
    assert set(good.doc_id) == set(documents.doc_id[scores >= 0.7])
    plain = good.assign(t=good.text.fillna("").str.replace(r"[\x20\x09-\x0D]", "", regex=True), n=-good.text.fillna("").str.len())
    assert set(exact.doc_id) == set(plain.sort_values(["n", "doc_id"]).drop_duplicates("t").doc_id)
    root = reach(exact.doc_id.tolist(), brute_join(exact)[1])
    assert set(near.doc_id) == {i for i, r in root.items() if i == r}
    assert set(clean.doc_id) == set(near.doc_id) and not any(base_spans(t or "") for t in clean.text)
    packed = corpus_pipeline.run(spark, SMALL).toPandas()
    assert set(packed.doc_id) == set(clean.doc_id)
    packed["ids_crc32"] = [zlib.crc32(x) for x in packed.ids]
    check_packing(packed, clean)
