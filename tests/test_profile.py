"""P1-P7 and the skew-safe top-N against brute force."""

import random
from collections import Counter

from pyspark.sql import functions as F

from evalspark.operators import profile as P

# permission shapes of the inline cases (invented values)
PERMS = [
    '{"department": ["Legal", "Finance", "Ops"], "access_level": "standard", "session_timeout": 30, '
    '"automation_restriction": true, "deadline": "2025-01-31"}',
    '{"department": ["Legal"], "access_level": "elevated", "session_timeout": "30", "automation_restriction": false}',
    "{'department': ['Ops', 'Legal'], 'budget': 12.5}",
    "not json",
]


def test_value_counting_rules(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(PERMS)], "id int, permissions string")
    top = P.field_value_top_n(df, "id", "permissions")
    got = {(r["field"], r["value"], r["value_kind"]): r["n"] for r in top.collect()}
    assert got[("department", "Legal", "text")] == 3
    assert got[("session_timeout", "30", "number")] == 1 and got[("session_timeout", "30", "text")] == 1
    assert got[("automation_restriction", "True", "text")] == 1
    assert got[("department_count", "3", "number")] == 1 and got[("department_count", "1", "number")] == 1
    assert got[("budget", "12.5", "number")] == 1
    types = {r["field"]: r["types"] for r in P.field_types(df, "id", "permissions").collect()}
    assert types["session_timeout"] == "int, str" and types["department"] == "list" and types["budget"] == "float"
    mean = P.mean_fields(df, "permissions").collect()[0]
    assert mean["n_rows_with_fields"] == 3 and abs(mean["mean_fields"] - (5 + 4 + 2) / 3) < 1e-6


def test_top_n_with_tail_matches_brute_force_under_skew(spark):
    rnd = random.Random(3)
    values = ["hot"] * 3000 + [f"v{rnd.randint(0, 400)}" for _ in range(6000)]
    rows = [(g, v) for g in ("x", "y") for v in values]
    df = spark.createDataFrame(rows, "g string, v string")
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    c = Counter(values)
    ranked = sorted(c.items(), key=lambda kv: (-kv[1], kv[0]))
    for buckets in (1, 8, 64):
        out = P.top_n_with_tail(counts, ["g"], "v", "n", 20, lambda k: F.concat(F.lit("more "), k.cast("string")), buckets=buckets)
        for g in ("x", "y"):
            got = [(r["v"], r["n"]) for r in out.filter(F.col("g") == g).orderBy("rank").collect()]
            assert got[:20] == ranked[:20]
            assert got[20] == (f"more {len(ranked) - 20}", sum(n for _, n in ranked[20:]))


def test_permission_tokens_sources(spark):
    rows = [(1, '["read", "write"]', None), (2, "read, export", None), (3, None, "x permissions: ['a', \"b\" , c]"),
            (4, '{"a": 1}', "permissions: [z]")]
    df = spark.createDataFrame(rows, "id int, permissions string, user_request string")
    t = {r["id"]: r["tokens"] for r in P.permission_token_lists(df, request_col="user_request").collect()}
    assert t == {1: ["read", "write"], 2: ["read, export"], 3: ["a", "b", "c"], 4: []}
    c = {r["id"]: r["tokens"] for r in P.permission_token_lists(df, request_col="user_request", split_mode="comma").collect()}
    assert c[2] == ["read", "export"]
    msgs = spark.createDataFrame([(1, [("user", "no"), ("user", "Permissions: [x, y]")])],
                                 "id int, messages array<struct<role string, content string>>")
    m = P.permission_token_lists(msgs.withColumn("permissions", F.lit(None).cast("string")),
                                 messages_col="messages").collect()[0]
    assert m["tokens"] == ["x", "y"]


def test_pluggable_token_counter(spark):
    from evalspark.operators import prompts as G
    df = spark.createDataFrame([("a bb  ccc",), ("",), (None,)], "t string")
    counter = G.token_counter(str.split)
    rows = [r["n"] for r in df.select(counter("t").alias("n")).collect()]
    assert rows == [3, 0, None]
    stats = G.sequence_lengths(df.withColumn("n", counter("t")), "t", max_len=2, tokens_col="n").collect()[0]
    assert stats["max_tokens"] == 3 and stats["n_over_cap"] == 1


def test_sequence_percentiles(spark):
    from evalspark.operators import prompts as G
    df = spark.createDataFrame([(" ".join(["w"] * n),) for n in range(1, 101)], "t string")
    p = G.sequence_percentiles(df, "t").collect()[0]["p"]
    assert p == [50, 95, 99]


def _one_split(spark, n):
    """``n`` rows in one partition: a list, a number, and text that is requoted or no JSON."""
    text = F.when(F.col("example_id") % 7 == 0, "nope").when(F.col("example_id") % 3 == 0, "{'d': ['a', 1.5], 'k': 'x'}").otherwise(
        F.concat(F.lit('{"d": ["a", "b"], "k": '), F.col("example_id") % 5, F.lit("}")))
    return spark.range(0, n, 1, 1).select(F.col("id").alias("example_id"), F.lit("r").alias("user_role"), text.alias("permissions"))


def test_permission_database_deals_the_rows_of_one_split(spark):
    df = _one_split(spark, 2100)
    db = P.permission_database(df)
    assert P._tagged(df, "user_role", "permissions").rdd.getNumPartitions() == 4  # the session's shuffle partitions
    assert db["examples"].rdd.getNumPartitions() == 4
    got = {(r["field"], r["value"]): r["count"] for r in db["values"].collect()}
    assert got == {("d", "a"): 1800, ("d", "1.5"): 600, ("d", "b"): 1200, ("k", "x"): 600, **{("k", str(i)): 240 for i in range(5)}}
    assert db["metadata"].first()["total_samples"] == db["examples"].select("index").distinct().count() == 2100


def test_type_of_a_value_is_read_once(spark):
    one = P._tagged(_one_split(spark, 3), "user_role", "permissions")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert one.replace("_", "").count("schemaofvariant(") == 2  # of a field, and of a list's element


def test_field_entries_deal_the_rows_of_one_split(spark):
    df = _one_split(spark, 2100)
    assert P.permission_entries(df, "example_id", "permissions").rdd.getNumPartitions() == 4
    sketches = P.distinct_sketches(df.withColumn("batch", F.col("example_id") % 8), "batch", "permissions")
    got = {r["field"]: (r["approx_values"], r["total_occurrences"]) for r in P.approx_distinct(P.merge_sketches(sketches)).collect()}
    assert got == {"d": (3, 3600), "d_count": (1, 1800), "k": (6, 1800)}

