"""S1-S6 and K2-K5 edge cases on small files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from evalspark.sources import readers as R
from evalspark.sources import sinks as K


def test_load_splits_reports_missing(spark, tmp_path):
    base = str(tmp_path)
    spark.range(3).write.parquet(f"{base}/easy-00000-of-00001.parquet")
    paths = R.split_paths(base, "data", ["easy", "hard"])
    frame, missing = R.load_splits(spark, paths)
    assert missing == ["hard"] and frame.count() == 3 and frame.select("split").distinct().collect()[0][0] == "easy"
    assert R.split_paths(base, "bench", ["easy"])["easy"].endswith("easy_test.parquet")


def test_jsonl_quarantine_and_difficulty_filter(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    good = {"user_role": "r", "permissions": {"a": [1]}, "query": "q", "expected_response": "full", "synthetic": True}
    (d / "train_HARD.jsonl").write_text(json.dumps(good) + "\n\n{'user_role': 'x'}\n" +
                                        json.dumps({"user_role": "r", "query": "q"}) + "\n")
    (d / "easy.jsonl").write_text(json.dumps(good) + "\n")
    ok, bad = R.jsonl_records(spark, str(d), glob="*.jsonl", name_filter="hard")
    assert ok.count() == 1
    row = ok.collect()[0]
    assert json.loads(row["permissions"]) == {"a": [1]} and "synthetic" not in ok.columns
    reasons = sorted((r["reason"], r["missing"]) for r in bad.collect())
    assert reasons == [("malformed", ""), ("missing_fields", "expected_response,permissions")]


def test_results_documents(spark, tmp_path):
    d = tmp_path / "res"
    d.mkdir()
    doc1 = {"model_name": "m1", "results": {"medium": {"predictions": [
        {"index": 0, "prediction": "full", "ground_truth": "p", "correct": False},
        {"index": 1, "prediction": None, "ground_truth": "rejected", "correct": False}]},
        "hard": {"predictions": [{"index": 9, "prediction": "full", "ground_truth": "full", "correct": True}]}}}
    doc2 = {"model_name": "m2", "results": {"hard": {"details": [
        {"index": 0, "prediction": "approve", "ground_truth": "deny", "correct": False}]}}}
    doc3 = {"model_name": "m3"}
    for i, doc in enumerate((doc1, doc2, doc3)):
        (d / f"run{i}_results.json").write_text(json.dumps(doc, indent=2))
    (d / "notes.json").write_text("{}")
    flat, bad = R.read_results(spark, str(d))
    rows = sorted((r["model_name"], r["difficulty"], r["index"], r["prediction"], r["ground_truth"])
                  for r in flat.collect())
    assert rows == [("m1", "medium", 0, "full", "partial"), ("m1", "medium", 1, "", "rejected"),
                    ("m2", "hard", 0, "full", "rejected")]  # first difficulty present wins; '' stays invalid
    assert [r["reason"] for r in bad.collect()] == ["no_layout"]


def test_merge_zero_rows_writes_nothing(spark, tmp_path):
    existing = spark.createDataFrame([("a",)], "user_role string")
    empty = spark.createDataFrame([], "record string").select(F.parse_json("record").alias("record"))
    out = str(tmp_path / "v1")
    assert K.merge_into(existing, empty, "record", out) == 0 and not os.path.exists(out)


def test_versioned_write_and_formats(spark, tmp_path):
    base = str(tmp_path / "tbl")
    K.versioned_write(spark, spark.range(2), base)
    K.versioned_write(spark, spark.range(5), base)
    assert K.read_current(spark, base).count() == 5
    with pytest.raises(ValueError):
        K.save_output(spark.range(1), str(tmp_path / "x"), "json")
    with pytest.raises(ValueError):
        K.save_output(spark.range(1), str(tmp_path / "y"), "xml")


def test_merge_rejects_records_without_required_fields(spark, tmp_path):
    from evalspark.functions.json import parse_json
    from evalspark.operators.clean import CORE_SCHEMA
    from evalspark.sources import sinks as K
    old = spark.createDataFrame([("r", "{}", "q", "full", None)], CORE_SCHEMA)
    good = '{"user_role": "x", "permissions": {"a": 1}, "query": null, "expected_response": "full"}'
    recs = spark.createDataFrame([(good,), ('{"user_role": "x"}',), (good + " oops",), ("[]",)], "t string")
    recs = recs.select(parse_json("t").alias("rec"))
    assert K.merge_into(old, recs, "rec", str(tmp_path / "v1")) == 1
    assert spark.read.parquet(str(tmp_path / "v1")).count() == 2
    assert K.merge_into(old, recs.limit(0), "rec", str(tmp_path / "v2")) == 0 and not (tmp_path / "v2").exists()


def test_corrupt_parquet_split_is_reported(spark, tmp_path):
    from evalspark.sources import readers as R
    (tmp_path / "bad.parquet").write_bytes(b"not parquet at all")
    spark.range(3).write.parquet(str(tmp_path / "good.parquet"))
    out, missing = R.load_splits(spark, {"a": str(tmp_path / "bad.parquet"), "b": str(tmp_path / "good.parquet"), "c": str(tmp_path / "none")})
    assert missing == ["a", "c"] and out.count() == 3


def test_checkpoint_folder_is_not_made_up_on_a_cluster():
    import pytest
    from evalspark.session import ensure_checkpoint_dir

    class Conf(dict):
        get = dict.get

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())
