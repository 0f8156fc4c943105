"""Loading of definitions and vocabularies, names that collide, the stream of statements."""

import json

import pytest
from pyspark.sql import functions as F

from metricspark.operators import metrics, registry, rules
from metricspark.plans.definitions import DEFINITIONS
from metricspark.sources.statements import statements
from metricspark.streaming.answers import answered, written

SMALL = "/root/testdata/sf0.001"
GOOD = {
    "metric_id": "equity_ratio", "display_name": "equity ratio", "aliases": ["own share"], "version": 2, "formula": "bs.total_equity / bs.total_assets",
    "fields": [{"id": "bs.total_equity"}, {"id": "bs.total_assets"}], "conditions": [{"expr": "is_missing(bs.total_assets)", "reason": "r"}, {"expr": "bs.total_assets <= 0", "reason": "r"}],
    "flags": [{"name": "restated", "trigger": "notes.restatement_flag == true"}],
}


def test_definitions_load_from_files(spark, tmp_path):
    """Files in the order of their names, those with a leading underscore left out, unreadable ones as a parse error; the rest can be evaluated."""
    (tmp_path / "b.json").write_text(json.dumps(GOOD))
    (tmp_path / "a.json").write_text("{not json")
    (tmp_path / "_flags.json").write_text("{}")
    rows = registry.load(spark, str(tmp_path))
    found = rows.collect()
    assert [(r["path"], r["metric_id"], r["parse_error"] is None) for r in found] == [("a.json", None, False), ("b.json", "equity_ratio", True)]
    assert [r["code"] for r in registry.text_findings(rows).collect()] == ["R0.YAML_UNPARSEABLE"]
    d = registry.compiled(rows)
    assert [x.metric_id for x in d] == ["equity_ratio"] and len(d[0].conditions) == 2
    got = metrics.metric_values(statements(spark, SMALL), d)
    assert got.count() == 70 and got.filter("amount > 0 OR refusal_code IS NOT NULL").count() > 0


def test_vocabulary_needs_all_keys(spark, tmp_path):
    flag = {"name": "restated", "scope": "metric", "affects_comparability": True, "meaning": "m", "set_by": "trigger"}
    (tmp_path / "flags.jsonl").write_text(json.dumps(flag))
    assert registry.vocabulary(spark, str(tmp_path)).count() == 1
    (tmp_path / "flags.jsonl").write_text(json.dumps(flag) + "\n" + json.dumps({"name": "x"}))
    with pytest.raises(ValueError):
        registry.vocabulary(spark, str(tmp_path))


def test_colliding_names_are_not_loaded(spark):
    rows = registry.rows(spark, DEFINITIONS)
    assert registry.checked(rows) is rows
    with pytest.raises(ValueError):
        registry.checked(rows.unionByName(rows.limit(1)))


def test_stream_equals_batch(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    whole = statements(spark, SMALL)
    few = DEFINITIONS[:3]
    for part in range(2):
        whole.filter(f"suppkey % 2 = {part}").write.mode("append").parquet(source)
        written(answered(spark, source, whole.schema, few), target, str(tmp_path / "checkpoint")).awaitTermination()
    key = ["entity", "period", "metric_id"]
    got, want = (d.select(*key, "value", "refusal_code", "condition_index").orderBy(*key).collect() for d in (spark.read.parquet(target), metrics.metric_values(whole, few)))
    assert got == want and len(got) == 210


def test_definitions_are_read_in_many_tasks(spark):
    """Definitions that lie in one part are dealt out before Python reads them, and give what they gave."""
    rows = registry.rows(spark, DEFINITIONS).unionByName(registry.rows(spark, DEFINITIONS[:1]).withColumn("formula", F.lit("bs.x **"))).coalesce(1)
    found = registry.text_findings(rows)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [r["code"] for r in found.collect()] == ["FORMULA_UNPARSEABLE"]


def test_yaml_is_read_in_many_tasks(spark):
    files = spark.createDataFrame([(f"{i}.yaml", f"metric_id: m{i}\nversion: {i}") for i in range(40)] + [("x.yaml", "a: [")], "path string, value string").coalesce(1)
    rows = registry.parsed(files)
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {r["path"]: (r["metric_id"], r["version"]) for r in rows.collect()} == {f"{i}.yaml": (f"m{i}", i) for i in range(40)} | {"x.yaml": (None, None)}


def test_a_whole_catalogue_is_checked_in_many_tasks(spark):
    terms = rules.Terms(("entity",), ("annual",), ("flow",), ("positive",), (), ())
    rows = registry.rows(spark, DEFINITIONS).coalesce(1)
    plan = registry.all_findings(rows, terms)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [metric_id") >= 3
