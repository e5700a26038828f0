"""A1-A8 invariants: subset ⊆ original, item/field counts in range, tags,
dense ranks equal a sort, draws unique before reuse, one outcome per attempt."""

import json

from pyspark.sql import functions as F

from evalspark.functions.common import md5_bigint
from evalspark.operators import augment as A

PERM = json.dumps({"department": ["a", "b", "c", "d", "e"], "access_level": "x", "allowed_actions": ["r", "w"],
                   "flag": True, "other": 1, "extra": "y", "more": [1, 2, 3]})


def test_subset_and_reduced(spark):
    df = spark.range(400).withColumnRenamed("id", "draw_no").withColumn("permissions", F.lit(PERM))
    for strategy, tags in (("subset", {"subset"}), ("reduced", {"reduced"}), ("all_active", {"all_active"})):
        out = A.sample_permissions(df.withColumn("strategy", F.lit(strategy)), level="hard").collect()
        assert {r["strategy_used"] for r in out} == tags
        for r in out:
            m = json.loads(r["modified_permissions"])
            orig = json.loads(PERM)
            if strategy == "subset":
                assert set(m) == set(orig)
                assert 2 <= len(m["department"]) <= 4 and set(m["department"]) <= set(orig["department"])
                assert m["allowed_actions"] == ["r", "w"]  # lists of <= 2 items stay
                assert 2 <= len(m["more"]) <= 3
            elif strategy == "reduced":
                dropped = set(orig) - set(m)
                assert 1 <= len(dropped) <= 2 and not dropped & set(A.CORE_FIELDS) and len(m) >= 5
            else:
                assert m == orig
    small = spark.createDataFrame([(0, json.dumps({"department": ["a"], "b": 1}))], "draw_no long, permissions string")
    tag = A.sample_permissions(small.withColumn("strategy", F.lit("reduced"))).collect()[0]["strategy_used"]
    assert tag == "reduced_minimal"
    core = spark.createDataFrame([(0, json.dumps({c: 1 for c in ["department", "access_level", "allowed_actions",
                                                                   "a", "b", "c"]}))], "draw_no long, permissions string")
    med = A.sample_permissions(core.withColumn("strategy", F.lit("minimal_reduce")), level="medium").collect()[0]
    assert med["strategy_used"] == "minimal_reduce_skip"


def test_strategy_shares(spark):
    df = A.assign_strategy(spark.range(20000).withColumnRenamed("id", "draw_no"))
    share = {r["strategy"]: r["count"] / 20000 for r in df.groupBy("strategy").count().collect()}
    assert abs(share["all_active"] - 0.35) < 0.02 and abs(share["subset"] - 0.40) < 0.02
    assert abs(share["reduced"] - 0.25) < 0.02


def test_dense_rank_equals_sort(spark):
    df = spark.range(5000, numPartitions=5).withColumn("h", md5_bigint(F.lit("s"), F.col("id")))
    ranked = A.dense_rank_by_hash(df, "h", "id").collect()
    got = {r["id"]: r["pos"] for r in ranked}
    want = {i: k for k, (_, i) in enumerate(sorted((r["h"], r["id"]) for r in ranked))}
    assert got == want


def test_draws_unique_then_reused(spark):
    elig = spark.range(50).withColumnRenamed("id", "sid")
    unused = elig.filter("sid < 20")
    d = A.draw_sources(spark, unused, elig, "sid", 30, seed=1).collect()
    assert sorted(r["draw_no"] for r in d) == list(range(60))
    first = [r for r in d if not r["reused"]]
    assert len(first) == 20 and len({r["source_id"] for r in first}) == 20
    assert all(r["draw_no"] >= 20 for r in d if r["reused"])


def test_outcomes_and_summary(spark):
    good = '{"user_role": "r", "permissions": {"a": 1}, "query": "%s", "expected_response": "full", "rationale": "x"}'
    rows = [(0, good % ("same query text long enough",)), (1, good % ("same query text long enough",)),
            (2, None), (3, good.replace('"full"', '"partial"') % ("another query that is long",)),
            (4, good % ("a different query entirely ok",))]
    df = spark.createDataFrame(rows, "draw_no long, response string").withColumn("reused", F.lit(False)) \
        .withColumn("strategy_used", F.lit("subset"))
    out = {r["draw_no"]: r["outcome"] for r in A.generation_outcomes(df).collect()}
    assert out == {0: "success", 1: "duplicate", 2: "failed_api", 3: "failed_validation", 4: "success"}
    s = {r["metric"]: r["value"] for r in A.attempt_summary(A.generation_outcomes(df)).collect()}
    assert s["attempts"] == 5 and s["success"] == 2 and s["strategy:subset"] == 5
    first = A.first_n_successes(A.generation_outcomes(df), 1).collect()
    assert [r["draw_no"] for r in first] == [0]


def test_tracking_round_trip(spark, tmp_path):
    path = str(tmp_path / "track")
    key = A.tracking_key("train.parquet")
    assert len(key) == 8
    assert A.read_used(spark, path, key).count() == 0
    A.record_attempts(spark.range(5).withColumnRenamed("id", "source_id"), path, key)
    assert A.read_used(spark, path, key).count() == 5
    assert A.read_used(spark, path, key, reset=True).count() == 0
