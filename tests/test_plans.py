"""Plan shape: every registered query reads each source table at most once in
its final physical plan (shared aggregates are checkpointed, not recomputed)."""

from collections import Counter

import pytest

from conftest import SF_SMALL
from evalspark.plans.queries import QUERIES

# two predictors compared on the same rows come from the same table by design
SELF_JOINS = {"paired_comparison"}


def _scans(node, acc):
    cls = node.getClass().getSimpleName()
    if cls == "AdaptiveSparkPlanExec":
        return _scans(node.executedPlan(), acc)
    if cls.endswith("QueryStageExec"):
        return _scans(node.plan(), acc)
    if cls == "InMemoryTableScanExec" or cls.startswith("Reused"):
        return acc
    if cls == "FileSourceScanExec":
        acc[node.relation().location().rootPaths().toString()] += 1
    subs = node.subqueries()
    for i in range(subs.size()):
        _scans(subs.apply(i), acc)
    ch = node.children()
    for i in range(ch.size()):
        _scans(ch.apply(i), acc)
    return acc


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SELF_JOINS))
def test_each_source_read_once(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    scans = _scans(df._jdf.queryExecution().executedPlan(), Counter())
    assert all(n == 1 for n in scans.values()), dict(scans)


def test_json_texts_are_parsed_once(spark):
    """However often a parsed text is referred to, the plan holds one parse of it."""
    import re

    from pyspark.sql import functions as F

    from evalspark.functions import json as J
    from evalspark.operators import clean as C
    from evalspark.operators import profile as P
    texts = spark.range(3).select("id", F.concat(F.lit('{"a": '), F.col("id").cast("string"), F.lit("}")).alias("t"))

    def parses(df):
        return len(re.findall(r"from_json\(|parse_?json\(", df._jdf.queryExecution().optimizedPlan().toString(), re.IGNORECASE))
    assert parses(texts.select(J.extract_json("t").alias("v"))) == 1
    assert parses(texts.select(J.parse_json("t").alias("v"))) == 1
    assert parses(texts.select(J.parse_status("t").alias("v"))) == 2  # as it stands, and with other quotes
    assert parses(C.parse_model_output(texts, "t").select(C.validate_generated(F.col("generated")).alias("v"))) == 1
    assert parses(P.permission_token_lists(texts, "t").select("tokens")) == 1
    assert parses(P.lenient_json_parse(texts, "id", "t")) == 4  # the object and the status, each as it stands and with other quotes
    assert parses(P.mean_fields(texts, "t")) == 2
