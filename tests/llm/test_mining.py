"""Hard negatives, the k-means tree and conversation repair against brute force, and on odd rows."""

import hashlib
import itertools
import sys
import zlib
from functools import lru_cache

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from metricspark.llm import hard_negatives, kmeans_tree, repair
from metricspark.llm import queries as Q

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"
CLASH = "`group` string, id string, key string, `all` string, score string, `a.b` string"
NONE = (None,) * 6


def by_sql(name, sf):
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.execute(Q.ORACLES[name]).df()


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_repair"])
@pytest.mark.parametrize("sf", [SMALL, MIDDLE])
def test_against_sql(spark, name, sf):
    by = lambda d: d[sorted(d.columns)].sort_values(sorted(d.columns)).reset_index(drop=True)
    pd.testing.assert_frame_equal(by(Q.QUERIES[name](spark, sf).toPandas()), by(by_sql(name, sf)), check_dtype=False)


def mined(rows, positives, negatives, low=(30, 100), high=(90, 100)):
    """rows: {(id, label): vector}; every id divisible by 10 is an anchor."""
    wide = max((len(v) for v in rows.values()), default=0)
    q = {k: [int(np.floor(256 * float(x))) for x in v] + [0] * (wide - len(v)) for k, v in rows.items()}
    q = {k: v for k, v in q.items() if sum(float(x) ** 2 for x in v) < 2.0**62}
    dot = lambda a, b: sum(x * y for x, y in zip(q[a], q[b]))
    out = []
    for a in q:
        if a[0] % 10:
            continue
        same = sorted((-dot(a, b), b[0]) for b in q if b[1] == a[1] and b[0] != a[0])[:positives]
        other = sorted((-dot(a, b), b[0]) for b in q if b[1] != a[1])
        for s, i in same:
            fit = [(n, j) for n, j in other if low[0] * -s * high[1] <= -n * low[1] * high[1] and -n * high[1] <= high[0] * -s][:negatives]
            out += [(a[0], i, rank, j, -s, -n) for rank, (n, j) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 3e4, 3e6])
def test_hard_negatives_of_all_sizes(spark, scale):
    """Single and double precision and whole numbers of Python give the same, whatever the blocks; ties go to the smaller id."""
    r = np.random.default_rng(5)
    v = r.standard_normal((400, 12)) * scale / 10
    v[50:80] = v[50]
    v[100] = 0
    label = r.integers(0, 3, 400)
    label[:150] = 0
    rows = [(int(i), int(c), x.tolist()) for i, (c, x) in enumerate(zip(label, v))]
    d = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5)
    want = mined({(i, c): x for i, c, x in rows}, 5, 10)
    for p in (hard_negatives.Mining(), hard_negatives.Mining(anchors=7, rows=40)):
        got = hard_negatives.mine(d, F.col("vec_id") % 10 == 0, p)
        assert sorted(map(tuple, got.collect())) == want


def test_hard_negatives_of_odd_rows(spark):
    rows = [
        (0, 1, [0.5, 0.5]), (1, 1, [0.6, 0.5]), (1, 1, [0.6, 0.5]), (2, 2, [0.3, 0.25]), (3, 2, [0.3, 0.25, 0.0]), (4, None, [1.0, 1.0]), (5, 2, None), (6, 2, [1.0, None]),
        (7, 2, [float("nan"), 1.0]), (8, 2, [float("inf"), 1.0]), (None, 2, [0.3, 0.3]), (9, 2, []), (10, 2, [0.4, 0.4]), (11, 3, [1e30, 1.0]), (12, 3, [0.2]), (10, 3, [0.1, 0.4]),
    ]
    d = spark.createDataFrame([(*r, *NONE) for r in rows], "vec_id long, label int, embedding array<double>, " + CLASH)
    fit = {(i, c): v for i, c, v in rows if i is not None and c is not None and v is not None and None not in v and np.isfinite(v).all() and i != 11}
    got = sorted(map(tuple, hard_negatives.mine(d, F.col("vec_id") % 10 == 0).collect()))
    assert got == mined(fit, 5, 10) and len(got) > 0
    assert hard_negatives.mine(d.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def near(v, ids, queries, k):
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(queries):
        s = unit @ unit[i]
        s[ids == ids[i]] = -9
        out[int(ids[i])] = ids[np.lexsort((ids, -np.round(s, 12)))[:k]].tolist()
    return out


def test_tree_recall_and_order(spark):
    rows = Q.op12_kmeans_tree(spark, MIDDLE).toPandas()
    e = pd.read_parquet(f"{MIDDLE}/embeddings.parquet")
    v, ids = np.array(e.embedding.tolist(), dtype=np.float64), e.vec_id.to_numpy()
    want = near(v, ids, ids % 50 == 0, 5)
    assert set(rows.query_id) == set(want) and (rows.groupby("query_id")["rank"].apply(list) == pd.Series([[1, 2, 3, 4, 5]] * len(want), index=sorted(want))).all()
    own = rows.sort_values("rank").groupby("query_id").vec_id.apply(set)
    assert np.mean([len(own[i] & set(w)) / 5 for i, w in want.items()]) >= 0.9
    place = {x: i for i, x in enumerate(ids)}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    exact = [float(unit[place[a]] @ unit[place[b]]) for a, b in zip(rows.query_id, rows.vec_id)]
    assert np.allclose(rows.score, exact, atol=1e-12)


def test_tree_with_few_leaves_visited_and_small_blocks(spark):
    """Topics, a third of all rows one vector, blocks far smaller than leaves: recall holds and copies come by id."""
    r = np.random.default_rng(8)
    topic = r.standard_normal((12, 24))
    v = np.concatenate([topic[r.integers(0, 12, 1600)] + 0.6 * r.standard_normal((1600, 24)), np.repeat(topic[:1], 800, axis=0)])
    ids = r.permutation(len(v))
    d = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<double>").repartition(6)
    p = kmeans_tree.Search(leaf=40, sample=900, rows=30, queries=5)
    rows = kmeans_tree.search(d, F.col("vec_id") % 20 == 0, p).toPandas()
    want = near(v, ids, ids % 20 == 0, 5)
    own = rows.sort_values("rank").groupby("query_id").vec_id.apply(list)
    assert np.mean([len(set(own[i]) & set(w)) / 5 for i, w in want.items()]) >= 0.9
    copies = np.sort(ids[1600:])
    for i in copies[copies % 20 == 0]:
        assert own[i] == [x for x in copies[:6] if x != i][:5]
    assert rows.calibrated_recall.iloc[0] >= 0.97 and rows.visits.iloc[0] < 40


def test_tree_of_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0, None]), (None, [1.0, 0.0]), (50, [1.0, 0.0, 0.0]), (6, []),
        (1, [2.0, 0.0]), (7, [1e-200, 1e-200]), (8, [1e200, -1e200]), (100, [5.0, 0.0, 0.0]),
    ]
    d = spark.createDataFrame([(*r, *NONE) for r in rows], "vec_id long, embedding array<double>, " + CLASH)
    got = kmeans_tree.search(d, F.col("vec_id") % 50 == 0).toPandas().sort_values(["query_id", "rank"])
    assert got[got.query_id == 0].vec_id.tolist() == [1, 7, 8]
    assert np.allclose(got[got.query_id == 0].score, [1, 0.5**0.5, 0.5**0.5])
    assert got[got.query_id == 50].vec_id.tolist() == [100] and got[got.query_id == 100].vec_id.tolist() == [50]
    assert kmeans_tree.search(d.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert kmeans_tree.search(d, F.lit(False)).count() == 0


def plain_repair(rows):
    """(cost, audit, lines) of the cheapest edits of (role, text, must go, broken) rows, by suffixes."""

    @lru_cache(maxsize=None)
    def best(i, state, run):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        role = "assistant" if state == "u" else "user"
        if run < 3:
            c, a, t = best(i, role[0], run + 1)
            found.append((c + 3, "I" + a, (role + ":", *t)))
        if i < len(rows):
            own, text, gone, broken = rows[i]
            c, a, t = best(i + 1, state, 0)
            found.append((c + 4, "D" + a, t))
            if not gone:
                c, a, t = best(i + 1, role[0], 0)
                found.append((c + 3 + 3 * broken, "R" + a, (f"{role}:{text}", *t)))
                if own[:1] == role[0] or (state == "" and own[:1] == "s"):
                    c, a, t = best(i + 1, own[0], 0)
                    found.append((c + 3 * broken, "K" + a, (f"{own}:{text}", *t)))
        return min(found, default=(10**6, "~", ()))

    sys.setrecursionlimit(20_000)
    return best(0, "", 0)


def test_repair_of_all_short_signatures():
    for n in range(5):
        for s in itertools.product("suaoxSUAO", repeat=n):
            rows = tuple(({"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "tool"), "", c == "x", c.isupper()) for c in s)
            assert repair.solve("".join(s)) == plain_repair(rows)[:2], s


def plain_audit(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of one conversation's (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, marked, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        body = text.rstrip(repair.BLANKS)
        fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else 3
        seen.add((role, text))
        if fault < 3:
            counts[fault] += 1
        marked.append((role, text, fault < 2, fault == 2))
    initials = [r[:1] or " " for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, lines = plain_repair(tuple(marked))
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_repair_of_odd_conversations(spark):
    long = "word " * 30_000 + "end."
    conversations = {
        1: [(0, "system", "S."), (1, "user", "u."), (2, "assistant", "a.")],
        2: [(None, "user", "first."), (0, "assistant", "second."), (5, None, None), (9, "user", " \n")],
        3: [(1, "user", "same."), (1, "user", "same."), (2, "user", "same."), (3, "assistant", "open")],
        4: [(0, "", "no role."), (1, "tool", "x."), (2, "assistant", long), (3, "user", long)],
        None: [(0, "user", "of no id?"), (1, "assistant", "Yes!")],
        5: [(i, ("user", "assistant")[i % 2], f"turn {i}" + "." * (i % 5 > 0)) for i in range(300)],
        6: [(0, "user", "")],
        7: [(-3, "user", "é."), (4, "assistant", "ü!")],
    }
    rows = [(c, t, r, x, *NONE) for c, own in conversations.items() for t, r, x in own]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, " + CLASH).repartition(3)
    audits, repaired = repair.repair(d)
    got = {r["key"]: r for r in audits.join(repair.digests(repaired), "key", "left").collect()}
    assert len(got) == len(conversations)
    for c, own in conversations.items():
        r = got["n" if c is None else f"v{c}"]
        want = plain_audit(sorted(own, key=lambda x: (x[0] is not None, x[0] or 0)))
        digest = r["repaired_sha256"] or hashlib.sha256(b"").hexdigest()
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], digest) == want, c
    texts = [r["text"] for r in sorted(repaired.collect(), key=lambda r: r["pos"]) if r["key"] == "v1"]
    assert texts == ["S.", "u.", "a."]
    audits, repaired = repair.repair(d.limit(0))
    assert audits.count() == 0 and repaired.count() == 0


def test_repair_of_one_long_conversation(spark):
    """One conversation over many partitions and short segments, with a row that repeats often."""
    rows = [(i // 2, ("user", "assistant", "system")[(i * i) % 3], f"text {i % 40}" + ".?x"[i % 3]) for i in range(200)] + [(33, "user", "again.")] * 40
    rows.sort(key=lambda x: x[0])
    d = spark.createDataFrame([(1, *r) for r in rows], "conv_id long, turn long, role string, text string").repartition(5)
    audits, repaired = repair.repair(d, segment=7)
    r = audits.join(repair.digests(repaired), "key").first()
    digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    want = plain_audit(sorted(rows, key=lambda x: (x[0], x[1], digest(*x[1:]))))
    assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) == want


def test_damage_leaves_conversations_without_rows(spark, tmp_path):
    """Original conversations all of whose rows are dropped are listed, and so is the null id."""
    dropped = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    rows = [(c, 0, "user", "hello.") for c in dropped[:3]] + [(None, 1, "user", "x."), (9_999, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in Q.op13_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {*dropped[:3], None, 9_999}
    none = hashlib.sha256(b"").hexdigest()
    assert all((got[c]["cost"], got[c]["audit"], got[c]["repaired_sha256"]) == (0, "", none) for c in dropped[:3])


def test_conversations_are_packed_under_three_limits(spark):
    """Every answer with the turn before it: whole, in sequences within all limits, of which the loss is the one that binds."""
    from tokenizers import Tokenizer

    from metricspark.llm.bpe import tokenizer_path

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = Q.packed_conversations(spark, MIDDLE).toPandas()
    talk = pd.read_parquet(f"{MIDDLE}/conversations.parquet").sort_values(["conv_id", "turn"])
    talk["prompt"] = talk.groupby("conv_id").text.shift()
    want = {}
    for r in talk[talk.role == "assistant"].itertuples():
        prompt = t.encode(r.prompt or "", add_special_tokens=False).ids if isinstance(r.prompt, str) else []
        want[f"{r.conv_id}:{r.turn}"] = (len(prompt), [*prompt, *t.encode(r.text or "", add_special_tokens=False).ids, 1])
    assert set(rows.doc_id) == set(want)
    for doc_id, own in rows.sort_values("start").groupby("doc_id"):
        free, ids = want[doc_id]
        at = 0
        for r in own.itertuples():
            piece = ids[at : at + r.length]
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(piece, dtype="<u4").tobytes())
            assert r.n_loss == max(0, at + r.length - max(at + 1, free))
            at += r.length
        assert at == len(ids)
    sums = rows.groupby("sequence_id").agg(tokens=("length", "sum"), loss=("n_loss", "sum"), n=("length", "size"))
    assert sums.tokens.max() <= 2048 and sums.loss.max() <= 1024 and sums.n.max() <= 64
    assert ((sums.loss > 1000) & (sums.tokens < 1800)).any()
