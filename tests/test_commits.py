"""Commit log (K3) and line numbers."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from evalspark.operators.clean import EXAMPLE_SCHEMA
from evalspark.sources import commits as C
from evalspark.sources import readers as R
from evalspark.sources import sinks as K

RECORD = '{"user_role": "r", "permissions": {"a": [1]}, "query": "q%d", "expected_response": "full"}'


def files(base):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(base) for f in names if f.endswith(".parquet")}


def records(spark, ids):
    return spark.createDataFrame([(RECORD % i,) for i in ids], "t string").select(F.parse_json("t").alias("record"))


def queries(df):
    return sorted(r["query"] for r in df.select("query").collect())


@pytest.fixture
def base(spark, tmp_path):
    path = str(tmp_path / "table")
    C.append(spark.createDataFrame([("r", "{}", "old", "full", None, "1", None)], EXAMPLE_SCHEMA), path)
    return path


def test_merges_leave_old_files_alone(spark, base):
    before = files(base)
    for ids in ([1, 2], [3]):
        entry, n = K.merge_append(spark, base, records(spark, ids), "record")
        assert n == len(ids) and entry.rows == C.last(spark, base).rows
    now = files(base)
    assert {f: now[f] for f in before} == before
    assert queries(C.read(spark, base)) == ["old", "q1", "q2", "q3"]
    assert queries(C.read(spark, base, 2)) == ["old", "q1", "q2"]  # earlier entries stay readable


def test_rejected_records_and_empty_merges(spark, base):
    bad = spark.createDataFrame([('{"query": "x"}',), (None,), ("[1]",)], "t string").select(F.try_parse_json("t").alias("record"))
    assert K.merge_append(spark, base, bad, "record") == (None, 0)
    assert C.last(spark, base).number == 1
    with pytest.raises(ValueError):
        K.merge_append(spark, base + "-none", bad, "record")


def test_writer_that_dies_before_its_commit_is_invisible(spark, base):
    C.write_batch(C.read(spark, base), base)
    open(f"{base}/_commits/draft-dead", "w").close()
    assert queries(C.read(spark, base)) == ["old"]
    K.merge_append(spark, base, records(spark, [7]), "record")
    assert queries(C.read(spark, base)) == ["old", "q7"]


def test_two_writers_of_one_number(spark, base):
    seen = C.last(spark, base)
    K.merge_append(spark, base, records(spark, [1]), "record", before=seen)
    with pytest.raises(C.CommitConflict):
        K.merge_append(spark, base, records(spark, [2]), "record", before=seen)
    assert queries(C.read(spark, base)) == ["old", "q1"]
    assert not [f for f in os.listdir(f"{base}/_commits") if f.startswith("draft")]


def test_compaction_keeps_rows(spark, base):
    for i in range(3):
        K.merge_append(spark, base, records(spark, [i]), "record")
    rows = queries(C.read(spark, base))
    assert C.compact(spark, base, least=9) is None
    entry = C.compact(spark, base)
    assert len(entry.batches) == 1 and entry.rows == 4 and queries(C.read(spark, base)) == rows


def test_line_numbers_over_many_splits(spark, tmp_path):
    folder = tmp_path / uuid.uuid4().hex
    folder.mkdir()
    want = {}
    for name, n, end in (("a.jsonl", 900, "\n"), ("b.jsonl", 333, "\r\n"), ("empty.jsonl", 0, "\n")):
        lines = []
        for i in range(1, n + 1):
            kind = i % 7
            lines.append("" if kind == 0 else "{broken" if kind == 3 else RECORD % i if kind < 6 else '{"query": "%s"}' % ("x" * (i % 50)))
            if kind in (3, 6):
                want[(name, i)] = "malformed" if kind == 3 else "missing_fields"
        (folder / name).write_bytes((end.join(lines) + (end if n % 2 == 0 else "")).encode())
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "700")
        t = R.jsonl_numbered(spark, str(folder))
        assert t.select("line_no").count() == sum(1 for n in (900, 333) for i in range(1, n + 1) if i % 7)
        got = {(os.path.basename(r["file_path"]), r["line_no"]): r["reason"] for r in t.where("reason IS NOT NULL").collect()}
    finally:
        spark.conf.set(key, old)
    assert got == want
    assert "line_no" in R.conform_tagged(t).columns
