"""Small operators: loaders of shards, training text, slashes, checks on sets of records, the evaluator."""

import json
import math

import pytest
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import metrics, packing, records
from quillmill.sources import jsonl, sinks

KEY = "instruction string, input string, response string, category string, id string, split string"


def test_shards_of_a_split(spark, tmp_path):
    for name, n in (("train-00000", 0), ("train-00001", 1), ("test-00000", 2)):
        rows = [{"instruction": f"i{n}", "input": "n", "response": "r", "category": c} for c in ("a", "b")]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    assert sorted((r["instruction"], r["category"]) for r in jsonl.sharded(spark, str(tmp_path), "train").collect()) == [(f"i{n}", c) for n in (0, 1) for c in "ab"]
    assert [r["instruction"] for r in jsonl.sharded(spark, str(tmp_path), "test", categories=("b",)).collect()] == ["i2"]


def test_training_text_in_order(spark, tmp_path):
    rows = spark.range(50).select("id", T.training_text(F.lit("i"), F.col("id").cast("string"), F.lit("r")).alias("training_text"))
    sinks.write_training_text(rows.orderBy(F.rand(3)), str(tmp_path / "out"), ["id"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "".join(f"### Instruction\ni\n\n### Input\n{i}\n\n### Response\nr\n\n" for i in range(50))


def test_manifest_is_written_over(spark, tmp_path):
    for counts in ({"a": 1, "é": {"b": 2}}, {"a": 2}):
        sinks.write_manifest(spark, str(tmp_path / "m.json"), counts)
        assert json.loads((tmp_path / "m.json").read_text()) == counts


def test_slashes(spark):
    assert spark.range(1).select(T.slashes(F.lit("a\\b/c\\\\d")).alias("x")).first()["x"] == "a/b/c//d"


def test_checks_on_sets_of_records(spark):
    rows = spark.createDataFrame([("i", "n", "r", "c", "1", "train"), ("i", "n", "r", "d", "2", "test"), ("i", "m", "r", "c", "1", "test"), ("i", None, "r", "c", "3", "test")], KEY)
    assert [(r["input"], r["count"]) for r in records.same_key_twice(rows).collect()] == [("n", 2)]
    assert [r["id"] for r in records.split_overlap(rows).collect()] == ["1"]
    assert records.same_key_twice(rows.limit(0)).count() == records.split_overlap(rows.limit(0)).count() == 0


def test_first_of_each_key_by_its_parts(spark):
    rows = spark.createDataFrame([("a\nb", "c", "r", 2), ("a", "b\nc", "r", 1), ("a", "b\nc", "r", 0), ("a", None, "r", 3), ("a", "", "r", 4)], "instruction string, input string, response string, n int")
    assert sorted(r["n"] for r in records.distinct_records(rows, ["n"]).collect()) == [0, 2, 3]


def test_evaluation_of_a_split(spark):
    ids = spark.createDataFrame([(0, list(range(10))), (1, list(range(10, 21)))], "n int, ids array<int>")
    windows = packing.lm_windows(ids, ["n"], 4, 4).withColumnRenamed("k", "k")
    loss = lambda given, wanted: F.aggregate(wanted, F.lit(0.0), lambda a, x: a + F.log(x + 1.0)) / F.size(given)
    out = metrics.evaluation(windows, loss, batch_size=3).first()
    each = [sum(math.log(x + 1) for x in range(s + 1, s + 5)) / 4 for s in range(0, 17, 4)]
    batches = [each[i : i + 3] for i in range(0, len(each), 3)]
    wanted = sum(sum(b) / len(b) for b in batches) / len(batches)
    assert (out["sequences"], out["batches"]) == (len(each), len(batches))
    assert out["loss"] == pytest.approx(wanted) and out["perplexity"] == pytest.approx(math.exp(wanted))
    assert metrics.evaluation(windows, loss, most=1.0).first()["perplexity"] == pytest.approx(math.e)
    with pytest.raises(ValueError):
        metrics.evaluation(windows, loss, batch_size=0)
    with pytest.raises(Exception, match="no complete sequence"):
        metrics.evaluation(windows.limit(0), loss).collect()
