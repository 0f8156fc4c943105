"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from metricspark.llm import encode, exact_dedup, language, neighbours, packing, pii, quality, set_join, token_counts, toxicity
from metricspark.llm import queries as Q
from metricspark.llm.bpe import tokenizer_path

SMALL = "/root/testdata/sf0.001"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, id long, node long, `key` string, sketch binary, kept string, score string, label string, `__key` string, `__whole` string, `a.b` string"
LONG = "word and other words of a very long text " * 20_000
TEXTS = [(1, "one two three four five six seven"), (2, None), (3, ""), (4, " \n\t "), (5, "ONE two three four five six seven"), (1, "one two three four five six seven"), (None, "one two three four five six seven"), (6, LONG), (7, "a@b.co 10.0.0.1"), (8, LONG)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, None, None, None, 9, 9, "k", b"s", "x", "x", "x", "own key", "own whole", "dotted") for r in TEXTS], DOCUMENT)


@pytest.fixture(scope="module")
def model(spark):
    return Q.quality_model(spark, SMALL)


def operators(spark, model):
    word, byte = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
    learned = toxicity.Model(*(x := __import__("numpy")).zeros((2, 0), dtype=int), 0.0)
    return {
        "packing": lambda d: packing.pack(d, word),
        "encode": lambda d: encode.encode(d, byte),
        "exact": exact_dedup.dedup,
        "quality": lambda d: quality.score(d, model),
        "no model": lambda d: quality.score(d, None),
        "language": lambda d: language.predict(d, language.fit(d, F.lit(True))),
        "pii": pii.find,
        "join": set_join.jaccard_join,
        "toxicity": lambda d: toxicity.score(d, learned),
        "tokens": lambda d: token_counts.section_tokens(d, byte),
    }


@pytest.mark.parametrize("name", ["packing", "encode", "exact", "quality", "no model", "language", "pii", "join", "toxicity", "tokens"])
def test_odd_and_empty_rows(spark, odd, model, name):
    run = operators(spark, model)[name]
    rows = run(odd).toPandas()
    assert set(rows.doc_id.dropna()) == {1, 2, 3, 4, 5, 6, 7, 8} and rows.doc_id.isna().sum() >= 1
    if name not in ("packing", "tokens"):
        assert len(rows) == len(TEXTS)
    assert run(odd.limit(0)).count() == 0


def test_exact_ties(spark, odd):
    rows = exact_dedup.dedup(odd).toPandas()
    own = rows[rows.doc_id.isin([2, 3, 4])].set_index("doc_id")
    assert (own.keep_id == 4).all() and (own.group_size == 3).all() and own.kept[4]
    same = rows[(rows.doc_id == 1) | rows.doc_id.isna()]
    assert (same.keep_id == 1).all() and (same.group_size == 3).all()
    assert rows[rows.doc_id == 8].keep_id.item() == 6


def test_exact_survives_colliding_identifiers(spark, odd):
    """Identifiers of no bytes all collide; verification still tells the chunks apart."""
    by = lambda d: sorted(map(str, d.drop("text_sha256").collect()))
    assert by(exact_dedup.dedup(odd, id_bytes=1)) == by(exact_dedup.dedup(odd))


def test_join_counts_copies(spark, odd):
    rows = set_join.jaccard_join(odd).toPandas()
    ones = rows[rows.doc_id.isin([1, 5])]
    assert (ones.class_id == 1).all() and (ones.n_links == 2).all()
    assert (rows[rows.doc_id.isin([2, 3, 4])].n_links == 0).all()


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0, 0.1]), (8, [-1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [])]
    d = spark.createDataFrame([(*r, 3, "n") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    got = neighbours.near_dedup(d).toPandas()
    assert len(got) == len(rows)
    own = got.dropna(subset=["vec_id"]).set_index("vec_id")
    assert own.component_id.to_dict() == {1: 1, 2: 1, 7: 1, 3: 3, 4: 4, 5: 5, 6: 6, 8: 8, 9: 9, 10: 10}
    assert own.n_links.to_dict() == {1: 2, 2: 2, 7: 2, 3: 0, 4: 0, 5: 0, 6: 0, 8: 0, 9: 0, 10: 0}
    assert neighbours.near_dedup(d.limit(0)).count() == 0


def test_stages(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        if name == "packing":
            assert {r["doc_id"] for r in stage(spark, docs, SMALL).collect()} == {None, *range(1, 9)}
            continue
        assert stage(spark, docs, SMALL).columns == odd.columns
        kept = stage(spark, docs, SMALL).select("__key", "__whole", "`a.b`").distinct().collect()
        assert [tuple(r) for r in kept] == [("own key", "own whole", "dotted")], name
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    assert sorted(r["doc_id"] for r in corpus_pipeline.exact(spark, docs, SMALL).collect()) == [1, 4, 5, 6, 7]


def crowded(spark, pairs=150, group=600, alone=3000, hot=0):
    """Vectors with planted pairs of cosine 0.91 to 0.95, one group of near copies, strangers; ``hot``: of them in one topic."""
    r = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    topic = unit(r.standard_normal(64))
    base = unit(r.standard_normal((alone + pairs, 64)))
    base[:hot] = unit(0.84 * topic + 0.54 * base[:hot])
    twins = unit(base[:pairs] + r.uniform(0.33, 0.45, (pairs, 1)) * unit(r.standard_normal((pairs, 64))))
    near = unit(unit(r.standard_normal(64)) + 0.1 * unit(r.standard_normal((group, 64))))
    v = np.concatenate([base, twins, near])
    place = r.permutation(len(v))
    d = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(place, v)], "vec_id long, embedding array<double>")
    return d.repartition(4), v, place, alone + pairs


def test_lost_pairs_beside_a_large_group(spark):
    """Trees that lose most planted pairs: the links of a large group don't hide it, nor does a sample without links."""
    d, v, place, first = crowded(spark)
    want = np.zeros(len(v), dtype=int)
    want[place] = (v @ v.T >= 0.9).sum(axis=1) - 1
    for audited in (512, 2):
        p = neighbours.Descent(trees=1, reach=0.01, rounds=0, leaf=32, audited=audited, attempts=1)
        rows = neighbours.near_dedup(d, p).toPandas().set_index("vec_id").sort_index()
        assert (rows.n_links.to_numpy() <= want).all()
        lone = want < 100
        assert rows.n_links[lone].sum() >= 0.97 * want[lone].sum() > 0
        assert (rows.audited_recall >= 0.97).all()


def test_trees_follow_depth():
    p = neighbours.Descent()
    assert p.trees_of(50_000, 0) == 4 < p.trees_of(50_000_000, 0) < p.trees_of(50_000_000, 1)


def test_trees_split_a_hot_topic(spark):
    """Half of the vectors in one topic: leaves are split by planes, so near pairs stay together."""
    d, v, place, first = crowded(spark, pairs=400, group=0, alone=3000, hot=3000)
    vectors = d.select(F.col("vec_id").alias("node"), "embedding").mapInPandas(
        lambda b: (x.assign(v=[np.array(e, dtype=np.float32).tobytes() for e in x.embedding])[["node", "v"]] for x in b), "node long, v binary"
    )
    p = neighbours.Descent(leaf=64, block=32, trees=12)
    edges = neighbours.tree_edges(vectors, len(v), p, 0).select("u", "v").distinct().toPandas()
    found = set(map(tuple, edges.to_numpy()))
    pairs = [(place[i], place[j]) for i, j in np.argwhere(np.triu(v @ v.T >= 0.9, 1))]
    assert len(pairs) > 300 and np.mean([(a, b) in found for a, b in pairs]) > 0.8


def test_copies_that_no_plane_splits(spark):
    """Parts of a tight group overlap and differ between trees: its lists connect it."""
    d, v, place, first = crowded(spark, pairs=0, group=900, alone=0)
    r = np.random.default_rng(5)
    tight = 1.0 + 1e-4 * r.standard_normal((900, 64))
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(tight)], "vec_id long, embedding array<double>")
    vectors = d.select(F.col("vec_id").alias("node"), "embedding").mapInPandas(
        lambda b: (x.assign(v=[np.array(e, dtype=np.float32).tobytes() for e in x.embedding])[["node", "v"]] for x in b), "node long, v binary"
    )
    edges = neighbours.tree_edges(vectors, 100, neighbours.Descent(leaf=64, block=32, trees=2, reach=0.01, neighbours=3), 0)
    from metricspark.llm.common import components

    assert components(edges).select("component").distinct().count() == 1 and edges.select("u").distinct().count() == 900


def test_runs_cover_the_deepest_split():
    """A pair at the limit is missed with 1 - recall at most, in the model of branching paths, after all splits."""
    for p in (set_join.Join(), set_join.Join(depth=1), set_join.Join(depth=8)):
        together = 1.0
        for _ in range(1 + p.steps * p.depth):
            together = 1 - np.exp(-together)
        assert (1 - together) ** p.runs <= 1 - p.recall and p.runs_of(1) <= p.runs == p.runs_of(p.depth)
        assert {r for r, _ in set_join.first_keys(p.runs, p.similarity)} == set(range(p.runs))


def test_rows_that_repeat_or_reuse_an_id(spark):
    """Repeated rows leave one; an id's other, unlinked text stays; near copies under one id leave one."""
    far, other = "alpha beta gamma delta epsilon zeta eta theta iota kappa", "one quite different text that is linked with nothing here"
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(0, far), (1, far), (1, other), (2, other), (2, other), (3, near), (3, near + " end"), (None, far), (None, far)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = lambda d: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in d.collect())
    assert kept(corpus_pipeline.exact(spark, docs, SMALL)) == sorted([(False, 0, far), (False, 1, other), (False, 3, near), (False, 3, near + " end")])
    joined = kept(corpus_pipeline.ngram_join(spark, docs, SMALL))
    assert joined[:3] == [(False, 0, far), (False, 1, other), (False, 3, joined[2][2])] and joined[3:] == [(True, 0, far)]
    classes = set_join.jaccard_join(docs).toPandas()
    assert sorted(classes[classes.doc_id == 1].class_id) == [0, 1]


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_words_that_defeat_polynomial_hashes():
    """The Thue-Morse word and its complement have equal polynomial hashes modulo 2**64, not equal ids."""
    from metricspark.llm.arrays import words
    from metricspark.llm.bpe import coder
    from tokenizers import Tokenizer

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = Tokenizer.from_file(tokenizer_path(name))
        library.no_truncation()
        library.no_padding()
        for n in (512, 1024, 2048):
            one = thue_morse(n)
            two = one.translate(str.maketrans("ab", "ba"))
            ids, at = coder(tokenizer_path(name)).encode_batch([one, two, one + " " + two])
            for k, t in enumerate([one, two, one + " " + two]):
                assert ids[at[k] : at[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids
    for seed in (1, 8, 9):
        h, _ = words([thue_morse(1024), thue_morse(1024).translate(str.maketrans("ab", "ba"))], seed)
        assert h[0] != h[1]


def test_long_digits_and_nested_addresses():
    assert [s for s in pii.spans("0" * 5000 + "1.2.3.4") if s[2] == "ip"] == [(0, 5007, "ip")]
    found = pii.spans("http://" * 20_000)
    assert len(found) == 1 and found[0][2] == "url"
    assert [s[2] for s in pii.spans("http://a.b/c http://d.e")] == ["url", "url"]


def test_letters_beyond_the_basic_plane(spark):
    gothic, deseret = "".join(chr(0x10330 + i % 20) for i in range(60)), "".join(chr(0x10400 + i % 30) for i in range(60))
    rows = spark.createDataFrame([(1, gothic, "got"), (2, deseret, "dsr"), (3, gothic[:30], None), (4, "\U0001f600" * 9, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(rows, language.fit(rows, F.lit(True))).collect()}
    assert got == {1: "got", 2: "dsr", 3: "got", 4: "und"}
    assert len(set_join.shingles([" ".join(gothic[i : i + 9] for i in range(0, 54, 9))], 5)[0]) == 2


def test_samples_of_huge_tables():
    from metricspark.llm.common import STEPS

    assert STEPS * 20_000 / 5e10 > 1


def test_several_labels_of_one_id(spark):
    from metricspark.llm.common import labelled_sample

    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, None), (None, 1)], "doc_id long, quality int")
    assert sorted(map(tuple, labelled_sample(labels, F.lit(True), "quality", 10).collect())) == [(1, 0.0), (2, 1.0)]


def test_loss_limit_binds(spark):
    """Prompts bear no loss, so a sequence holds more of them than of answers."""
    rows = [(i, "question " * 40, "answer " * 20) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, prompt string, text string").repartition(1)
    limits = packing.Limits(tokens=512, segments=16, loss=64)
    got = packing.pack(d, tokenizer_path("word_bpe_49k.json"), limits, prompt_col="prompt").toPandas()
    by = got.groupby("sequence_id").agg(loss=("n_loss", "sum"), length=("length", "sum"))
    assert by.loss.max() == 64 and by.length.max() < 512
    assert got.length.sum() == 40 * 61 and got.n_loss.sum() >= 40 * 20


def test_documents_of_frequent_passages(spark):
    """Near copies among documents put together from few passages, with small leaves: every link is found in deep splits."""
    r = np.random.default_rng(7)
    passages = [" ".join(f"p{i}w{j}" for j in range(30)) for i in range(6)]
    texts = []
    for i in range(300):
        own = " ".join(f"d{i}x{j}" for j in range(90))
        text = f"{passages[i % 6]} {own} {passages[(i + 1) % 6]}"
        texts += [text, text + f" tail{i} end{i}"] if i % 3 == 0 else [text]
    texts += [f"{passages[0]} {passages[1]} " + " ".join(f"c{j}" if r.random() > 0.02 else f"z{i}y{j}" for j in range(150)) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    want = np.zeros(len(texts), dtype=int)
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                want[i] += 1
                want[j] += 1
    got = [set_join.jaccard_join(docs, set_join.Join(leaf=32, whole=w)).toPandas().set_index("doc_id").sort_index() for w in (0, 512)]
    for rows in got:
        assert want.sum() > 400 and (rows.n_links.to_numpy() <= want).all()
        assert rows.n_links.sum() >= 0.999 * want.sum()


def test_blocks_that_meet_are_sent_as_rows_of_their_own(spark):
    """A large bucket that is compared whole makes as many rows as it has pairs of blocks, not its sets times its blocks; every pair of sets meets."""
    sets = spark.range(600).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("node"), F.expr("CAST(id % 3 AS STRING)").cast("binary").alias("sketch"), F.lit(5).cast("long").alias("n"))
    rows = set_join.packed(sets).collect()
    assert len(rows) == 25 and len({r["pair"] for r in rows}) == 15
    met = {}
    for r in rows:
        assert len(r["nodes"]) == len(r["sketches"])
        met.setdefault(r["pair"], set()).update(r["nodes"])
    assert sum(len({(a, b) for a in nodes for b in nodes if a < b}) for nodes in met.values()) >= 600 * 599 // 2
    assert {(a, b) for nodes in met.values() for a in nodes for b in nodes if a < b} == {(a, b) for b in range(600) for a in range(b)}
