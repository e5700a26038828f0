"""C1, C3, C4 (FIXTURES 3.4), C9, C10, C11."""

import json

import pytest
from pyspark.sql import functions as F

from evalspark.functions.json import extract_json, lenient_object, parse_status
from evalspark.operators import clean as C


def test_lenient_parse_cases(spark):
    cases = ['{"a": [1, 2]}', "{'a': 'x'}", "{'a': True}", "[1, 2]", "", None, '{"a": 1, "a": 2}']
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, p string")
    rows = df.select("i", parse_status("p").alias("s"), F.to_json(lenient_object("p")).alias("j")).orderBy("i").collect()
    status = [r["s"] for r in rows]
    assert status == ["object", "object_requoted", "invalid", "not_object", "empty", "empty", "object"]
    assert json.loads(rows[1]["j"]) == {"a": "x"}
    assert rows[2]["j"] is None and rows[3]["j"] is None
    assert json.loads(rows[6]["j"]) == {"a": 2}  # duplicate key keeps the last value


def test_missing_vs_null(spark):
    df = spark.createDataFrame([('{"user_role": null, "permissions": {}, "query": "q", "expected_response": "f"}',),
                                ('{"user_role": "x", "query": "q"}',)], "line string")
    got = [r["m"] for r in df.select(C.missing_fields(F.try_parse_json("line")).alias("m")).collect()]
    assert got == [[], ["expected_response", "permissions"]]


def test_conform_raises_on_bad_cast(spark):
    from pyspark.sql import types as T
    df = spark.createDataFrame([('{"n": "abc"}',)], "line string")
    schema = T.StructType([T.StructField("n", T.IntegerType())])
    with pytest.raises(Exception):
        df.select(*C.conform(F.try_parse_json("line"), schema)).collect()
    ok = spark.createDataFrame([('{"permissions": {"a": [1]}, "extra": 1}',)], "line string")
    r = ok.select(*C.conform(F.try_parse_json("line"), C.CORE_SCHEMA)).collect()[0]
    assert json.loads(r["permissions"]) == {"a": [1]} and r["query"] is None


def test_extract_json_model_output(spark):
    texts = ['```json\n{"a": 1}\n```', '```\n{"a": 2}\n```', '\x07{"a": 3}', '{"a": "line1\nline2"}', "nope", "[1]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", F.to_json(extract_json("t")).alias("j")).orderBy("i").collect()
    assert [json.loads(r["j"]) if r["j"] else None for r in rows] == [
        {"a": 1}, {"a": 2}, {"a": 3}, {"a": "line1\nline2"}, None, [1]]


def test_validate_generated_reasons(spark):
    good = {"user_role": "r", "permissions": {"a": 1}, "query": "x" * 25, "expected_response": " Approve ",
            "rationale": "y"}
    cases = [good, [1], {k: v for k, v in good.items() if k != "rationale"}, dict(good, expected_response="partial"),
             dict(good, query="   short   "), dict(good, permissions="none")]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "i int, t string")
    got = [r["r"] for r in df.select("i", C.validate_generated(F.parse_json("t")).alias("r")).orderBy("i").collect()]
    assert got == [None, "not_object", "missing_fields", "bad_label", "short_query", "permissions_not_object"]


def test_dedup_keeps_smallest_id_and_is_idempotent(spark):
    rows = [(5, " Hello World "), (2, "hello world"), (9, "HELLO WORLD"), (3, "other"), (4, "Other ")]
    df = spark.createDataFrame(rows, "id int, q string").repartition(3)
    once = C.dedup_exact(df, "q", "id")
    assert sorted(r["id"] for r in once.collect()) == [2, 3]
    twice = C.dedup_exact(once.drop("query_hash"), "q", "id")
    assert sorted(r["id"] for r in twice.collect()) == [2, 3]
