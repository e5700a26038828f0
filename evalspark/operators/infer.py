"""Batch inference and response parsing: I1-I4.

The only Python boundary of the library: rows travel to a predictor through
``mapInArrow`` (batches that Spark bounds in rows and bytes), one partition per task,
so parallelism is the partition count.  The predictor is injected (no network client ships here):
``predict_fn(messages, attempt) -> str`` where ``messages`` is a list of
``{"role", "content"}`` dicts.  Label extraction (I2) runs afterwards as a
native expression.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import extract_label

MAX_RETRIES = 4          # attempts = MAX_RETRIES + 1
RETRY_DELAY_SEC = 40.0
WORKERS = 8              # calls under way at a time in one task
FAILED_PREDICTION = "rejected"
UNKNOWN_ROLE = "unknown"

INFER_SCHEMA = "id long, response string, success boolean, error string, attempts int"


def _call_with_retries(predict_fn, messages, max_retries: int, delay: float):
    last = None
    for attempt in range(1, max_retries + 2):
        try:
            return predict_fn(messages, attempt), None, attempt
        except Exception as e:  # noqa: BLE001 - any predictor failure is retried
            last = f"{type(e).__name__}: {e}"
            if attempt <= max_retries and delay > 0:
                time.sleep(delay)
    return None, last, max_retries + 1


def batch_inference(df: DataFrame, predict_fn, id_col: str = "id", messages_col: str = "messages",
                    max_retries: int = MAX_RETRIES, retry_delay: float = RETRY_DELAY_SEC,
                    passthrough=(), workers: int = WORKERS, partitions: int | None = None) -> DataFrame:
    """Run ``predict_fn`` over every row; one bad row never fails the job.

    A task keeps up to ``workers`` calls under way at a time (the predictor must
    allow that; retries of a row stay in its own call, and rows keep their order).
    ``partitions`` spreads a table of few files over more tasks first.

    Output ``id, response, success, error, attempts, prediction`` plus the
    ``passthrough`` columns (carried through the batch, so nothing is joined
    back): on success the prediction is I2 of the response; after
    ``max_retries + 1`` failed attempts it is ``rejected`` with
    ``success = false`` and the last error.

    A worker holds two Arrow batches at most: a row's messages become Python objects for its own
    calls only, and passthrough columns leave as the buffers they came in.
    """
    keep = [c for c in passthrough if c not in (id_col, messages_col)]

    def run(batches):
        def call(asked, i):
            messages = [{"role": m["role"], "content": m["content"]} for m in asked[i].as_py()]
            return _call_with_retries(predict_fn, messages, max_retries, retry_delay)

        def answered(batch, calls):
            done = [c.result() for c in calls]
            return pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] is None for d in done], pa.bool_()),
                 pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.int32()), *[batch.column(c) for c in keep]],
                ["id", "response", "success", "error", "attempts", *keep])

        with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
            held = []
            for batch in batches:  # the next batch's calls go out before the last ones of a batch are back
                held.append((batch, [pool.submit(call, batch.column("messages"), i) for i in range(batch.num_rows)]))
                if len(held) > 1:
                    yield answered(*held.pop(0))
            for h in held:
                yield answered(*h)

    from ..session import workers as python_workers
    python_workers(df.sparkSession)  # they unpickle this module's code and the predictor
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(messages_col).alias("messages"), *keep)
    if partitions:
        src = src.repartition(partitions)
    schema = INFER_SCHEMA + "".join(f", {c} {src.schema[c].dataType.simpleString()}" for c in keep)
    res = src.mapInArrow(run, schema)
    pred = F.when(F.col("success"), F.coalesce(extract_label("response"), F.lit(FAILED_PREDICTION))) \
            .otherwise(F.lit(FAILED_PREDICTION))
    return res.withColumn("prediction", pred).withColumnRenamed("id", id_col)


def inference_errors(results: DataFrame, id_col: str = "id", role_col: str | None = None,
                     max_retries: int = MAX_RETRIES, top: int | None = 5) -> DataFrame:
    """Failed rows with error, attempts (default max+1) and role (default ``unknown``);
    the first ``top`` by index when ``top`` is given."""
    role = F.coalesce(F.col(role_col), F.lit(UNKNOWN_ROLE)) if role_col else F.lit(UNKNOWN_ROLE)
    e = results.filter(~F.col("success") & F.col("error").isNotNull()).select(
        F.col(id_col).alias("index"), "error", F.coalesce(F.col("attempts"), F.lit(max_retries + 1)).alias("attempts"),
        role.alias("user_role"))
    return e.orderBy("index").limit(top) if top else e


def full_details(columns) -> Column:
    """I4: what a saved prediction keeps of its row, as a struct: role (default
    ``unknown``), permissions, query, the model's response and the expected rationale
    (default empty); null for failed calls."""
    def own(c, default):
        return F.coalesce(F.col(c).cast("string"), F.lit(default)) if c in columns else F.lit(default)
    return F.when(F.col("success"), F.struct(
        own("user_role", UNKNOWN_ROLE).alias("user_role"), own("permissions", None).alias("permissions"), own("query", None).alias("query"),
        F.col("response").alias("model_response"), own("rationale", "").alias("expected_rationale")))


def detailed_predictions(results: DataFrame, truth_raw_col: str = "truth_raw", truth_col: str = "truth",
                         id_col: str = "id", details: bool = False) -> DataFrame:
    """I4: per prediction ``correct_raw`` (against the raw label, as the reference
    stores it) and ``correct_norm`` (against the normalised label); with ``details``
    also :func:`full_details`."""
    if details:
        results = results.withColumn("full_details", full_details(results.columns))
        return results.select(F.col(id_col).alias("index"), "prediction", F.col(truth_raw_col).alias("ground_truth"),
                              (F.col("prediction") == F.col(truth_raw_col)).alias("correct_raw"),
                              (F.col("prediction") == F.col(truth_col)).alias("correct_norm"), "full_details")
    return results.select(F.col(id_col).alias("index"), "prediction", F.col(truth_raw_col).alias("ground_truth"),
                          (F.col("prediction") == F.col(truth_raw_col)).alias("correct_raw"),
                          (F.col("prediction") == F.col(truth_col)).alias("correct_norm"))
