"""I1 retries / failures, I3, R1 resume from checkpoint, R2 dedup."""

import json
import os
import time

from pyspark.sql import functions as F

from evalspark.operators import infer as I
from evalspark.streaming import running as S


def test_batch_inference_retries(spark):
    class Flaky:  # defined here so workers receive it by value
        def __call__(self, messages, attempt):
            text = messages[-1]["content"]
            if text == "always":
                raise RuntimeError("down")
            if text == "once" and attempt == 1:
                raise TimeoutError("slow")
            return "This is partially allowed"

    rows = [(1, [("user", "fine")]), (2, [("user", "once")]), (3, [("user", "always")])]
    df = spark.createDataFrame(rows, "id long, messages array<struct<role string, content string>>")
    res = {r["id"]: r for r in I.batch_inference(df, Flaky(), retry_delay=0.0).collect()}
    assert res[1]["prediction"] == "partial" and res[1]["attempts"] == 1
    assert res[2]["success"] and res[2]["attempts"] == 2
    assert not res[3]["success"] and res[3]["prediction"] == "rejected" and res[3]["attempts"] == 5
    assert "RuntimeError" in res[3]["error"]
    errs = I.inference_errors(I.batch_inference(df, Flaky(), retry_delay=0.0)).collect()
    assert [(r["index"], r["user_role"]) for r in errs] == [(3, "unknown")]


def test_batch_inference_calls_overlap_in_order(spark):
    class Slow:
        def __call__(self, messages, attempt):
            import time
            time.sleep(0.25)
            if messages[-1]["content"].endswith("7") and attempt == 1:
                raise TimeoutError("slow")
            return f"{messages[-1]['content']} is rejected"

    df = spark.createDataFrame([(i, [("user", f"row {i}")]) for i in range(24)], "id long, messages array<struct<role string, content string>>").coalesce(1)
    import time
    t = time.time()
    res = I.batch_inference(df, Slow(), retry_delay=0.0, workers=8).collect()
    assert time.time() - t < 5  # one after another they take 6.5 s
    assert [r["id"] for r in res] == list(range(24))
    assert all(r["response"].startswith(f"row {r['id']} ") and r["attempts"] == 1 + (r["id"] % 10 == 7) for r in res)


def test_batch_inference_holds_small_batches_of_long_texts(spark):
    class Held:
        def __call__(self, messages, attempt):
            with open("/proc/self/status") as f:
                return next(x.split()[1] for x in f if x.startswith("RssAnon"))

    text = F.repeat(F.lit("0123456789"), 300)  # 20000 rows of 6 KB with the passthrough
    rows = spark.range(0, 20000, 1, 1).select("id", F.concat(text, F.col("id").cast("string")).alias("query"))
    df = rows.select("id", "query", F.array(F.struct(F.lit("user").alias("role"), F.col("query").alias("content"))).alias("messages"))
    res = I.batch_inference(df, Held(), retry_delay=0.0, passthrough=("query",))
    kb, ids, texts = res.agg(F.max(F.col("response").cast("int")), F.count_distinct("id"),
                             F.sum((F.substring("query", 3001, 9) == F.col("id").cast("string")).cast("int"))).first()
    assert ids == texts == 20000
    assert kb < 200_000


def test_batch_inference_keeps_columns_and_nulls(spark):
    rows = [(1, "a", None, [1, None], [("user", "x")]), (2, None, 5, None, [("system", ""), ("user", "é\U0001f600")])]
    df = spark.createDataFrame(rows, "id int, s string, n int, l array<int>, messages array<struct<role string, content string>>")

    class Echo:
        def __call__(self, messages, attempt):
            return f"{[tuple(m.items()) for m in messages]}"
    got = sorted(I.batch_inference(df, Echo(), retry_delay=0.0, passthrough=("s", "n", "l")).collect())
    assert [(r["id"], r["s"], r["n"], r["l"], r["error"]) for r in got] == [(1, "a", None, [1, None], None), (2, None, 5, None, None)]
    assert got[1]["response"] == str([(("role", "system"), ("content", "")), (("role", "user"), ("content", "é\U0001f600"))])


def test_details_profile_holds_small_batches_of_long_texts(spark, tmp_path, monkeypatch):
    from evalspark.plans import queries as Q

    class Held:  # a call fails, and its row is not counted, where the worker holds too much
        def __call__(self, messages, attempt):
            with open("/proc/self/status") as f:
                kb = next(int(x.split()[1]) for x in f if x.startswith("RssAnon"))
            if kb >= 200_000:
                raise MemoryError(f"{kb} kB")
            return "Fully approved"

    ids = spark.range(0, 10000, 1, 1).withColumnRenamed("id", "doc_id")
    text = F.concat(F.repeat(F.lit("0123456789"), 300), F.col("doc_id").cast("string"))
    docs = ids.select("doc_id", text.alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("doc_id") % 3).alias("source"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    ids.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(Q.B, "RulePredictor", Held)
    assert [tuple(r) for r in Q.QUERIES["details_profile"](spark, str(tmp_path)).collect()] == [(10000, 2.0)]


def test_running_metrics_resume(spark, tmp_path):
    base = str(tmp_path)
    rows = [(i, "r", ["full", "partial", "rejected"][i % 3], ["full", "partial", "rejected"][(i // 2) % 3])
            for i in range(60)]
    df = spark.createDataFrame(rows, "id long, run string, truth string, prediction string")
    df.filter("id < 30").repartition(3).write.parquet(f"{base}/in/a")
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{base}/in")
    S.start_running_metrics(stream, f"{base}/ck", f"{base}/snap", by=["run"]).awaitTermination()
    assert S.read_snapshot(spark, f"{base}/snap").collect()[0]["n_total"] == 30
    df.filter("id >= 30").repartition(2).write.parquet(f"{base}/in/b")
    S.start_running_metrics(stream, f"{base}/ck", f"{base}/snap", by=["run"]).awaitTermination()
    # a write that was stopped leaves files that no reader takes
    os.makedirs(f"{base}/snap/batch=99/_temporary/0")
    snap = S.read_snapshot(spark, f"{base}/snap").collect()[0]
    from evalspark.operators.metrics import summary_metrics
    batch = summary_metrics(df, by=["run"]).collect()[0]
    assert snap["n_total"] == 60 and snap["accuracy"] == batch["accuracy"]  # no double count after restart


def test_stream_dedup(spark, tmp_path):
    base = str(tmp_path)
    rows = [(i, t) for i, t in enumerate(["A b", "a B ", "c", "C", "d"])]
    spark.createDataFrame(rows, "id long, text string").repartition(2).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("id long, text string").parquet(f"{base}/in")
    S.start_dedup(stream, "text", f"{base}/ck", f"{base}/out").awaitTermination()
    assert spark.read.parquet(f"{base}/out").select("query_hash").distinct().count() == 3
    assert spark.read.parquet(f"{base}/out").count() == 3


def scored_rows(spark, n, shift=0):
    classes = ["full", "partial", "rejected"]
    rows = [(i, f"run{i % 3}", classes[i % 3], (classes + ["other", None])[(i // 2) % 5]) for i in range(shift, shift + n)]
    return spark.createDataFrame(rows, "id long, run string, truth string, prediction string")


def summary(spark, df):
    from evalspark.operators.metrics import summary_metrics
    return {r["run"]: (r["n_total"], r["accuracy"], r["f1_macro"]) for r in summary_metrics(df, by=["run"]).collect()}


def test_run_metrics_after_a_stop(spark, tmp_path):
    """Stopped between batches and started again: the metrics of one run; stopped runs are marked without a caller."""
    base = str(tmp_path)
    df = scored_rows(spark, 400)
    df.repartition(8, "id").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    q = S.start_run_metrics(stream, f"{base}/ck", f"{base}/runs", processing_time="0 seconds", idle=3600)
    while not q.recentProgress or q.recentProgress[-1]["batchId"] < 1:
        time.sleep(0.1)
    q.stop()
    wait_for(lambda: {r.status for r in S.run_metrics(spark, f"{base}/runs").collect()} == {"interrupted"})
    S.start_run_metrics(stream, f"{base}/ck", f"{base}/runs", idle=3600).awaitTermination()
    got = {r.run: (r.n_total, r.accuracy, r.f1_macro) for r in S.run_metrics(spark, f"{base}/runs").collect()}
    assert got == summary(spark, df)
    assert len([f for f in os.listdir(f"{base}/runs") if f.startswith("batch-")]) <= 3  # old snapshots are removed


def test_run_metrics_are_closed_by_the_timer(spark, tmp_path):
    base = str(tmp_path)
    df = scored_rows(spark, 60)
    df.coalesce(2).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{base}/in")
    q = S.start_run_metrics(stream, f"{base}/ck", f"{base}/runs", processing_time="0 seconds", idle=0.5)
    try:
        wait_for(lambda: statuses(spark, f"{base}/runs") == {"complete"})
        scored_rows(spark, 9, 60).coalesce(1).write.mode("append").parquet(f"{base}/in")  # a closed run that goes on
        wait_for(lambda: sum(r.n_total for r in S.run_metrics(spark, f"{base}/runs").collect()) == 69)
        wait_for(lambda: statuses(spark, f"{base}/runs") == {"complete"})
    finally:
        q.stop()
    got = {r.run: (r.n_total, r.accuracy, r.f1_macro) for r in S.run_metrics(spark, f"{base}/runs").collect()}
    assert got == summary(spark, scored_rows(spark, 69))


def statuses(spark, base):
    from evalspark.sources import commits
    return {r.status for r in S.run_metrics(spark, base).collect()} if commits.last(spark, base) else set()


def wait_for(condition, seconds=60):
    end = time.time() + seconds
    while True:
        try:
            if condition():
                return
        except Exception:  # noqa: BLE001 - a snapshot was replaced while it was read
            pass
        assert time.time() < end, "condition not met in time"
        time.sleep(0.3)


def test_bounded_dedup_over_many_batches(spark, tmp_path):
    """State stays bounded, stored keys stop old copies, batches that ran before count once."""
    from evalspark.sources import commits
    base, n = str(tmp_path), 50
    texts = {}
    os.makedirs(f"{base}/in")
    for i in range(n):
        rows = [(i * 100 + j, f"Text {(i * 7 + j * j) % 90}" + " " * (j % 3)) for j in range(12)]
        texts.update({t.lower().strip(): None for _, t in rows})
        with open(f"{base}/in/{i:03d}.json", "w") as f:
            f.writelines(json.dumps({"id": k, "text": t}) + "\n" for k, t in rows)
    stream = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).json(f"{base}/in")
    q = S.start_bounded_dedup(stream, "text", f"{base}/ck", f"{base}/out", recent="0 seconds", compact_after=12)
    q.awaitTermination()
    rows = commits.read(spark, f"{base}/out").collect()
    assert sorted(r.text.lower().strip() for r in rows) == sorted(texts)
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert len(states) >= n and max(states) <= 3 * 12 < len(texts)
    assert len(commits.last(spark, f"{base}/out").batches) < 14
    before = commits.last(spark, f"{base}/out").number
    os.rename(f"{base}/ck", f"{base}/ck-lost")  # every batch comes again
    S.start_bounded_dedup(stream, "text", f"{base}/ck", f"{base}/out", recent="0 seconds").awaitTermination()
    assert commits.read(spark, f"{base}/out").count() == len(rows) and commits.last(spark, f"{base}/out").number <= before + 2
