"""Property tests (hypothesis): exact split sizes for any n and fraction equal the
row_number definition; normalisation is idempotent on canonical labels and maps
every dialect's output of canonical labels to itself."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalspark.functions.labels import DIALECTS, normalize_label
from evalspark.operators import split as T
from evalspark.streaming import running as S

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(sizes=st.lists(st.integers(min_value=0, max_value=400), min_size=1, max_size=4),
       fraction=st.sampled_from([0.0, 0.1, 0.5, 0.7, 0.8, 0.999, 1.0]),
       seed=st.integers(min_value=0, max_value=10_000), parts=st.integers(min_value=1, max_value=6))
def test_exact_cut_sizes(spark, sizes, fraction, seed, parts):
    rows = [(i * 1000 + j, f"s{i}") for i, n in enumerate(sizes) for j in range(n)]
    if not rows:
        return
    df = spark.createDataFrame(rows, "id long, s string").repartition(parts)
    got = {r["s"]: r["k"] for r in T.exact_cut(df, "id", "s", fraction, seed=seed)
           .groupBy("s").agg(F.count_if("in_first").alias("k")).collect()}
    for i, n in enumerate(sizes):
        if n:
            assert got[f"s{i}"] == int(n * fraction)


@SETTINGS
@given(labels=st.lists(st.one_of(st.none(), st.text(max_size=12),
                                 st.sampled_from(["full", "partial", "rejected", "P", " r ", "deny", "approve x"])),
                       min_size=1, max_size=20))
def test_normalisation_idempotent(spark, labels):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, raw string")
    for d in ("repair", "results", "eval"):
        once = df.select("i", normalize_label("raw", d).alias("a"))
        twice = once.select("i", "a", normalize_label("a", d).alias("b")).collect()
        for r in twice:
            if r["a"] in ("full", "partial", "rejected"):
                assert r["b"] == r["a"]
    canon = spark.createDataFrame([("full",), ("partial",), ("rejected",)], "raw string")
    for d in DIALECTS:
        assert sorted(x[0] for x in canon.select(normalize_label("raw", d)).collect()) == ["full", "partial", "rejected"]


def test_stop_status(spark, tmp_path):
    base = str(tmp_path)
    spark.createDataFrame([(1, "r", "full", "full")], "id long, run string, truth string, prediction string") \
        .write.parquet(f"{base}/in")
    stream = spark.readStream.schema("id long, run string, truth string, prediction string").parquet(f"{base}/in")
    q = S.start_running_metrics(stream, f"{base}/ck", f"{base}/snap", by=["run"])
    q.awaitTermination()
    assert S.stop_running_metrics(spark, q, f"{base}/snap", f"{base}/final") == "complete"
    assert spark.read.parquet(f"{base}/final").collect()[0]["status"] == "complete"
    assert S.stop_running_metrics(spark, q, f"{base}/none", f"{base}/final2") == "interrupted_no_data"
