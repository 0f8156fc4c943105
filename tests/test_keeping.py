"""Names looked up in texts, digests of sets, orders, leaks, exports, sources, a model's answers, definitions in YAML."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from metricspark.operators import evidence, exports, intent, judging, lookup, model, registry
from metricspark.plans import answers

NAMES = "alias string, metric_id string, display string"


def test_names_in_texts_against_a_loop(spark):
    """Names of one to nine letters, some inside others, in short and very long texts: what a loop over all pairs finds."""
    r = random.Random(3)
    word = lambda n: "".join(r.choice("甲乙丙丁ab") for _ in range(n))
    names = sorted({word(r.randint(1, 9)) for _ in range(120)})
    texts = ["x".join(word(r.randint(0, 12)) for _ in range(4)) for _ in range(150)] + ["", None, "甲" * 16_000, word(16_000), "zz" * 8_000 + names[-1]]
    rows = spark.createDataFrame(list(enumerate(texts)), "key int, text string").repartition(4)
    known = spark.createDataFrame([(n, f"c{i}") for i, n in enumerate(names)] + [("", "e"), (None, "n")], "name string, code string")
    found = rows.join(lookup.candidates(rows, known, ["code"]), "key").select("key", F.filter("names", lambda x: F.contains("text", x["name"])).alias("names"))
    got = {x["key"]: sorted((y["name"], y["code"]) for y in x["names"]) for x in found.collect() if x["names"]}
    want = {i: sorted((n, f"c{j}") for j, n in enumerate(names) if n in t) for i, t in enumerate(texts) if t}
    assert got == {i: w for i, w in want.items() if w}


def test_long_texts_take_time_as_their_length(spark):
    """A text of 160,000 letters isn't met with itself: ten texts of it in less than a quarter of a minute."""
    rows = spark.range(10).select(F.col("id").alias("key"), F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(32_000)), lambda i: F.lpad((i * 7919 + F.col("id")).cast("string"), 5, "0")), ""), F.lit("贵州茅台2023")).alias("text"))
    companies = spark.createDataFrame([("贵州茅台", "600519")], "name string, code string")
    names = spark.createDataFrame([("毛利率", "m", "毛利率")], NAMES)
    intent.companies_in(rows.limit(1), companies, names, "key").collect()
    began = time.time()
    got = intent.companies_in(rows, companies, names, "key").collect()
    assert len(got) == 10 and all(r["codes"] == ["600519"] and r["doubt"] is None for r in got) and time.time() - began < 15


def test_set_digests_do_not_depend_on_partitions(spark):
    rows = spark.range(3000).select(F.concat(F.lit("name "), F.col("id") % 700).alias("name"))
    some = [evidence.set_digest(rows.repartition(n), "name").first() for n in (1, 7)]
    assert some[0] == some[1] and some[0]["n"] == 700
    assert evidence.set_digest(rows.filter("name <> 'name 1'"), "name").first()["sha256"] != some[0]["sha256"]
    empty = evidence.set_digest(rows.limit(0), "name").first()
    assert (empty["n"], empty["sha256"]) == (0, hashlib.sha256(b"").hexdigest())
    by = lambda d: hashlib.sha256(d.encode()).hexdigest()
    d = sorted(by(f"name {i}") for i in range(700))
    parts, ups = {}, {}
    for x in d:
        parts.setdefault(x[:4], []).append(x)
    for p in sorted(parts):
        ups.setdefault(p[:2], []).append(by("".join(parts[p])))
    assert some[0]["sha256"] == by("".join(by("".join(ups[u])) for u in sorted(ups)))


def test_order_of_a_seed(spark):
    rows = spark.range(5000).select(F.col("id").alias("k"), F.lit("x").alias("part"))
    places = [{r["k"]: r["place"] for r in judging.shuffled(rows.repartition(n), "k", 7).collect()} for n in (1, 9)]
    want = sorted(range(5000), key=lambda k: (hashlib.sha256(f"7:{k}".encode()).hexdigest(), k))
    assert places[0] == places[1] == {k: i + 1 for i, k in enumerate(want)}
    assert judging.shuffled(rows.limit(0), "k", 7).count() == 0


def test_leaks_stay_within_their_page(spark):
    packets = spark.createDataFrame([("p", 1, "the judge noted 甲"), ("p", 2, "nothing"), ("q", 3, "he noted it"), ("q", 3, None)], "page string, packet_id int, body string")
    probes = spark.createDataFrame([(1, "p", "noted"), (2, "p", "noted"), (2, "p", "he noted"), (3, "q", "甲"), (3, "q", ""), (3, "q", None), (9, "r", "noted"), (3, "q", "noted it")], "packet_id int, page string, probe string")
    got = sorted((r["packet_id"], r["page"], r["probe"]) for r in judging.leaks(packets, probes).collect())
    assert got == [(1, "p", "noted"), (2, "p", "noted"), (3, "q", "noted it")]


RECORDS = "batch int, field string, value int"


def test_exports_are_whole_and_written_once(spark, tmp_path):
    """Wrong batches stay out, a second run writes nothing, a changed batch replaces its last, a damaged one is refused whole."""
    folder = str(tmp_path / "kept")
    records = [(1, "a", 1), (1, "b", 2), (2, "a", 5), (2, "b", 6), (3, "a", 7), (4, "a", None)]
    allowed = [(1, "a", 1), (1, "b", 2), (2, "a", 5), (2, "b", 7), (3, "a", 7), (4, "a", None), (5, "a", 1)]

    def put(records, allowed):
        batches = spark.createDataFrame([(b, "d", "d" if b != 3 else "other") for b in range(1, 6)], "batch int, digest string, checked_digest string")
        return exports.write(spark.createDataFrame(records, RECORDS), spark.createDataFrame(allowed, RECORDS.replace("value", "expected")), batches, folder)

    def got():
        rows, refused = exports.read(spark, folder)
        return sorted((r["batch"], r["field"], r["value"] or 0) for r in rows.collect()), sorted(map(tuple, refused.collect()))

    with pytest.raises(FileNotFoundError):
        exports.read(spark, folder)
    first = put(records, allowed)
    assert got() == ([(1, "a", 1), (1, "b", 2), (4, "a", 0)], [])
    assert put(records, allowed) is None and got()[0] == [(1, "a", 1), (1, "b", 2), (4, "a", 0)]
    second = put([(1, "a", 10), (1, "b", 2)], [(1, "a", 10), (1, "b", 2)])
    assert second > first and got() == ([(1, "a", 10), (1, "b", 2), (4, "a", 0)], [])
    spark.createDataFrame([(1, "c", 3)], RECORDS).write.mode("append").parquet(f"{folder}/rows/run={second}")
    assert got() == ([(4, "a", 0)], [(1, "DIGEST_DIFFERS")])
    spark.createDataFrame([(9, "c", 3)], RECORDS).write.parquet(f"{folder}/rows/run=r99999999999999999999")
    assert got() == ([(4, "a", 0)], [(1, "DIGEST_DIFFERS")])


def test_sources_that_cannot_be_read_are_counted(spark, tmp_path):
    digest = "a" * 64
    files = {
        "one.json": '{"meta": {"kind": "real", "source_sha256": "%s", "short_name": "n"}, "rows": [{"code": "1", "year": "2023"}, {"code": "1", "year": "x"}, {"year": "2023"}]}' % digest,
        "two.json": '{"meta": {"kind": "real", "fixture_id": "f", "source_sha256": "short", "short_name": "n"}, "rows": [{"code": "2", "year": "2022"}]}',
        "three.json": '{"meta": {"kind": ', "four.json": '{"rows": [{"code": "4", "year": "2021"}]}',
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    rows, counts = exports.covered(spark, str(tmp_path), "real")
    assert sorted(map(tuple, rows.collect())) == [("real", "one", "1", 2023, "n"), ("synthetic", "f", "2", 2022, ""), ("synthetic", "four", "4", 2021, "")]
    assert tuple(counts.first()) == (3, 1)
    assert {r["nature"] for r in exports.covered(spark, str(tmp_path), "synthetic")[0].collect()} == {"synthetic"}


def test_model_is_asked_once_for_each_text(spark):
    """Calls follow the distinct texts without a name; slow, failing and unknown answers are none."""
    asked = spark.sparkContext.accumulator(0)

    def ask(texts):
        asked.add(len(texts))
        if "fails" in texts[0]:
            raise ValueError("no")
        if "slow" in texts[0]:
            time.sleep(3)
        return [{"one": "毛利率", "two": " 毛利率 ", "three": "made up"}.get(t.split()[0]) for t in texts]

    names = spark.createDataFrame([("毛利率", "m", "毛利率")], NAMES)
    texts = ["one 600519 2023年", "two 600519 2023年", "three 600519 2023年", "four 600519 2023年", "fails 600519 2023年", "slow 600519 2023年", "毛利率 600519 2023年", "", None] * 5
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    got = intent.intents(rows, names, spark.createDataFrame([], "name string, code string"), "id", ask=ask, model_limits={"batch": 1, "seconds": 1.0, "in_flight": 2})
    said = {r["text"]: (r["metric_id"], r["resolved_by"], r["reason"]) for r in got.collect()}
    known = ("m", "model", None)
    assert said == {
        texts[0]: known, texts[1]: known, **{t: (None, None, "no_metric") for t in texts[2:6]}, texts[6]: ("m", "alias_table", None), "": (None, None, "no_metric"), None: (None, None, "no_metric"),
    }
    assert asked.value == 6
    short = model.answered(rows, lambda t: t[:-1], batch=4)
    assert all(r["said"] is None for r in short.collect())


def test_definitions_in_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "good.yaml").write_text("""
metric_id: ratio
display_name: 流动比率
aliases: [流动资产负债比, current ratio]
version: 2
source_fields:
  - {id: bs.total_current_assets, sign_convention: plus, missing_representation: null}
  - {id: bs.inventory, missing_representation: -1}
  - {id: notes.restatement_flag, enum_values: [true, false]}
  - {id: notes.kinds, enum_values: [a, b]}
formula: >
  bs.total_current_assets
  / bs.inventory
undefined_conditions:
  - {expr: is_missing(bs.inventory), reason: none}
  - just a text
flags:
  - {name: restated, trigger: notes.restatement_flag == true}
derivation: {allow_from_components: false, note: n}
standard_basis: [{name: s, version: "2014"}]
common_pitfalls: [{text: t, enforced_by: source_fields.id}, {text: u, advisory_only: true}]
""")
    (tmp_path / "bad.yaml").write_text("a: [")
    (tmp_path / "list.yml").write_text("- 1\n- 2\n")
    (tmp_path / "_flags.yaml").write_text("flags: []")
    rows = {r["path"]: r for r in registry.load(spark, str(tmp_path)).collect()}
    assert set(rows) == {"good.yaml", "bad.yaml", "list.yml"}
    assert rows["bad.yaml"]["parse_error"] == "a: [" and rows["list.yml"]["metric_id"] is None and rows["list.yml"]["parse_error"] is None
    g = rows["good.yaml"]
    assert (g["metric_id"], g["aliases"], g["version"], g["formula"]) == ("ratio", ["流动资产负债比", "current ratio"], 2, "bs.total_current_assets / bs.inventory")
    assert [(f["id"], f["kind"], f["missing"]) for f in g["fields"]] == [("bs.total_current_assets", "number", "null"), ("bs.inventory", "number", "-1"), ("notes.restatement_flag", "boolean", None), ("notes.kinds", "enum", None)]
    (d,) = registry.compiled(registry.load(spark, str(tmp_path)))
    assert d.missing == (("bs.inventory", -1),) and d.conditions == ("is_missing(bs.inventory)", "") and d.flags == (("restated", "notes.restatement_flag == true"),)
    assert sorted(r["alias"] for r in registry.names(registry.load(spark, str(tmp_path))).collect()) == sorted(["ratio", "流动比率", "流动资产负债比", "current ratio"])


def test_possible_names_do_not_grow_with_the_names(spark):
    """Of 20,000 names of one alphabet a text gets its own and hardly another; names longer than the widest stretch are found too."""
    names = spark.range(20_000).select(F.concat(F.lit("Co"), F.translate(F.lpad(F.col("id").cast("string"), 6, "0"), "0123456789", "ABCDEFGHIJ")).alias("name"), F.col("id").alias("code"))
    long = spark.createDataFrame([("甲乙" * 60 + "丙", -1), ("甲乙" * 60 + "丁", -2)], "name string, code long")
    rows = names.filter("code % 10 = 0").select(F.col("code").alias("key"), F.concat("name", F.lit(" 1996年 gross margin")).alias("text")).unionByName(long.select(F.col("code").alias("key"), F.concat(F.lit("x"), "name").alias("text")))
    found = rows.join(lookup.candidates(rows, names.unionByName(long), ["code"]), "key")
    counts = found.select("key", F.size("names").alias("n"), F.size(F.filter("names", lambda x: F.contains("text", x["name"]) & (x["code"] == F.col("key")))).alias("own")).collect()
    assert len(counts) == 2002 and all(r["own"] == 1 for r in counts) and sum(r["n"] for r in counts) < 2 * 2002


def test_segments_of_claims_and_questions_are_written_once(spark):
    """Plans of claims read the segments as they were written, and plans of questions read no orders again."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    texts = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("000001 1996年 weather is 0.5").alias("text"))
    none = spark.createDataFrame([], "entity string, period long, metric_id string, value decimal(38,10), refusal_code string")
    judged = intent.claims(texts, none, spark.createDataFrame([("毛利率", "m", "毛利率")], NAMES), spark.createDataFrame([("甲", "000001")], "name string, code string"))
    assert "Range (" not in plan(judged) and [r["why"] for r in judged.collect()] == ["no_metric"] * 3
    assert "o_custkey" not in plan(answers.question_answers(spark, "/root/testdata/sf0.001"))
