"""Structured Streaming: R1 running metrics and R2 continuous dedup.

R1 keeps the nine confusion counts per group as streaming state (complete
mode: the state is one small row per group) and turns them into metrics in
``foreachBatch``; the checkpoint makes an interrupted run resume where it
stopped instead of re-counting.  :func:`start_run_metrics` keeps them per run with
timers, so that a run that has gone quiet is closed by the engine.  R2 deduplicates on the
C10 key against everything seen: in state alone (which grows with the keys, unless an
event time bounds it), or in two tiers (:func:`start_bounded_dedup`), recent keys in state and
older ones in the output table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.labels import CLASSES
from ..operators.clean import query_hash
from ..operators.metrics import confusion_counts, summary_from_counts
from ..session import ship_package
from ..sources import commits


def running_confusion(stream: DataFrame, truth: str = "truth", pred: str = "prediction", by=()) -> DataFrame:
    """Streaming wide confusion counts (one state row per group)."""
    return confusion_counts(stream, truth, pred, by)


def start_running_metrics(stream: DataFrame, checkpoint: str, snapshot_path: str, truth: str = "truth",
                          pred: str = "prediction", by=(), available_now: bool = True,
                          processing_time: str | None = None) -> StreamingQuery:
    """Running accuracy / F1 per group, a snapshot after every batch.

    Each batch writes a folder of its own, ``batch=<id>``, with ``status``
    (``running``); files appear in it when the write commits, so a run that is
    stopped at any moment leaves the earlier snapshots whole
    (:func:`read_snapshot`).  Restarting with the same checkpoint continues from
    the committed offsets.
    """
    by = list(by)
    counts = running_confusion(stream, truth, pred, by)

    def publish(batch: DataFrame, batch_id: int) -> None:
        snap = summary_from_counts(batch, by).withColumn("status", F.lit("running"))
        snap.write.mode("overwrite").parquet(f"{snapshot_path}/batch={batch_id}")

    w = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(publish)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def read_snapshot(spark, snapshot_path: str) -> DataFrame:
    """The last snapshot that was written whole (column ``batch`` is its id)."""
    every = spark.read.parquet(snapshot_path)
    last = every.agg(F.max("batch")).first()[0]
    return every.where(F.col("batch") == F.lit(last))


# --- R1 per run, closed by the engine ----------------------------------------

CELLS = [f"c_{t}{p}" for t in range(len(CLASSES)) for p in range(len(CLASSES))] + ["n_total"]
SHARDS = 16
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def _count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, idle_ms: int) -> Iterator[pd.DataFrame]:
    """Counts of one (run, shard): added to with every batch, closed by the timer."""
    counts = list(state.get) if state.exists else [0] * len(CELLS)
    if state.hasTimedOut:
        status = "complete"  # the counts stay: a run that goes on later is opened again
    else:
        status = "running"
        for f in frames:
            t, p = (f[c].map({x: i for i, x in enumerate(CLASSES)}) for c in ("truth", "prediction"))
            for (i, j), n in pd.DataFrame({"t": t, "p": p}).dropna().astype(int).value_counts().items():
                counts[i * len(CLASSES) + j] += int(n)
            counts[-1] += len(f)
        state.setTimeoutDuration(idle_ms)
    state.update(tuple(counts))
    yield pd.DataFrame([[*key, *counts, status]], columns=["run", "shard", *CELLS, "status"])


class _Stopped(StreamingQueryListener):
    """When the query ends, runs that are still open are marked ``interrupted``."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base, self.run_id = spark, base, None

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if str(event.runId) != self.run_id:
            return
        self.spark.streams.removeListener(self)
        at = commits.last(self.spark, self.base)
        if at is not None:
            status = F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status"))
            commits.replace(commits.read(self.spark, self.base).withColumn("status", status), self.base, at, at.meta)


def start_run_metrics(stream: DataFrame, checkpoint: str, base: str, run_col: str = "run", id_col: str = "id", truth: str = "truth",
                      pred: str = "prediction", idle: float = 60.0, processing_time: str | None = None) -> StreamingQuery:
    """R1 per run: confusion counts in keyed state, a status per run, one live snapshot.

    A run's rows are dealt over ``SHARDS`` state keys by id, so that one large run is counted by
    several tasks.  A key without rows for ``idle`` seconds is closed by its timer (status
    ``complete``; without ``processing_time`` timers go off in the next start); what is open when the
    query ends becomes ``interrupted`` by a listener, without a caller.  Each batch replaces the
    snapshot below ``base`` by a commit that names the batch, so a batch that is run again after a
    failure counts once; snapshots but the last two are removed.
    """
    spark = stream.sparkSession
    ship_package(spark)
    cells = ", ".join(f"{c} bigint" for c in CELLS)
    rows = stream.select(F.col(run_col).cast("string").alias("run"), F.pmod(F.xxhash64(id_col), F.lit(SHARDS)).cast("int").alias("shard"),
                         F.col(truth).alias("truth"), F.col(pred).alias("prediction"))
    idle_ms = int(idle * 1000)
    counted = rows.groupBy("run", "shard").applyInPandasWithState(
        lambda key, frames, state: _count(key, frames, state, idle_ms), f"run string, shard int, {cells}, status string", cells,
        "update", GroupStateTimeout.ProcessingTimeTimeout)

    def publish(batch: DataFrame, batch_id: int) -> None:
        here, staged = batch.sparkSession, f"{base}/staged"
        batch.write.mode("overwrite").parquet(staged)  # computed once, and whole even where it was committed before
        at = commits.last(here, base)
        if at is not None and at.meta.get("batch", -1) >= batch_id:
            return
        new = here.read.schema(batch.schema).parquet(staged)
        if at is not None:  # rows of (run, shard) that this batch did not touch stay as they are
            new = new.unionByName(commits.read(here, base).join(new, ["run", "shard"], "left_anti"))
        commits.replace(new, base, at, {"batch": batch_id})

    listener = _Stopped(spark, base)
    w = counted.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(publish)
    spark.streams.addListener(listener)
    if processing_time:
        query = w.trigger(processingTime=processing_time).start()
    else:  # timers ask for batches without data for ever, so a run over what is there has none
        own = spark.conf.get(NO_DATA)
        spark.conf.set(NO_DATA, "false")
        query = w.trigger(availableNow=True).start()  # has its own copy of the settings from here on
        spark.conf.set(NO_DATA, own)
    listener.run_id = str(query.runId)
    return query


def run_metrics(spark: SparkSession, base: str) -> DataFrame:
    """The live snapshot: metrics and ``status`` of every run (closed once all its shards are)."""
    rows = commits.read(spark, base)
    status = F.when(F.bool_or(F.col("status") == "running"), "running").when(F.bool_or(F.col("status") == "interrupted"), "interrupted").otherwise("complete")
    per_run = rows.groupBy("run").agg(*[F.sum(c).alias(c) for c in CELLS], status.alias("status"))
    return summary_from_counts(per_run, ["run", "status"])


# --- R2 -----------------------------------------------------------------------

def dedup_stream(stream: DataFrame, text_col: str, watermark_col: str | None = None,
                 watermark_delay: str = "1 hour") -> DataFrame:
    """R2: drop rows whose C10 key was seen before in this stream.

    With ``watermark_col`` the state is bounded (``dropDuplicatesWithinWatermark``);
    without it every key seen is kept in state.
    """
    keyed = stream.withColumn("query_hash", query_hash(text_col))
    if watermark_col:
        return keyed.withWatermark(watermark_col, watermark_delay).dropDuplicatesWithinWatermark(["query_hash"])
    return keyed.dropDuplicates(["query_hash"])


def start_dedup(stream: DataFrame, text_col: str, checkpoint: str, out_path: str,
                watermark_col: str | None = None, available_now: bool = True) -> StreamingQuery:
    """R2 sink: append the first occurrence of each key to Parquet."""
    w = (dedup_stream(stream, text_col, watermark_col).writeStream.outputMode("append")
         .option("checkpointLocation", checkpoint).format("parquet").option("path", out_path))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def start_bounded_dedup(stream: DataFrame, text_col: str, checkpoint: str, base: str, recent: str = "10 minutes",
                        compact_after: int = 32, compact_rows: int = 1_000_000, available_now: bool = True) -> StreamingQuery:
    """R2, exact with bounded state: first occurrences are appended to the commit log ``base``.

    Keys of the last ``recent`` (by arrival) are in keyed state, which the watermark expires, and stop
    copies there.  What passes is held against the older tier, the keys of the output table itself: a
    batch semi-joins the stored keys (one column) with its own, planned by their size, and
    keeps the rows whose key is not stored.  A batch that is run again after a failure is skipped if
    it was committed.  Every ``compact_after`` batches the small ones are written as one.
    """
    arrived = stream.withColumn("query_hash", query_hash(text_col)).withColumn("__arrived", F.current_timestamp())
    fresh = arrived.withWatermark("__arrived", recent).dropDuplicatesWithinWatermark(["query_hash"]).drop("__arrived")

    def publish(batch: DataFrame, batch_id: int) -> None:
        here, staged = batch.sparkSession, f"{base}/staged"
        batch.write.mode("overwrite").parquet(staged)  # computed once, and whole even where it was committed before
        at = commits.last(here, base)
        if at is not None and at.meta.get("batch", -1) >= batch_id:
            return
        new = here.read.schema(batch.schema).parquet(staged)
        if at is not None:
            stored = commits.read(here, base).select("query_hash").join(new.select("query_hash"), "query_hash", "left_semi")
            new = new.join(stored, "query_hash", "left_anti")
        done = commits.append(new, base, at, {"batch": batch_id})
        if len(done.batches) >= compact_after:
            commits.compact(here, base, compact_after // 2, compact_rows)

    w = fresh.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(publish)
    return (w.trigger(availableNow=True) if available_now else w).start()


def stop_running_metrics(spark, query: StreamingQuery, snapshot_path: str, out_path: str) -> str:
    """R1 on shutdown: stop the query and write the last snapshot with a final
    status to ``out_path``.

    ``complete`` when the query had already finished on its own, otherwise
    ``interrupted``; ``interrupted_no_metrics`` when a snapshot exists but holds
    no rows, ``interrupted_no_data`` when no batch was ever published.  Resuming
    is real: restart with the same checkpoint.
    """
    from pyspark.sql.utils import AnalysisException
    finished = not query.isActive
    if not finished:
        query.stop()
    try:
        snap = read_snapshot(spark, snapshot_path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        spark.createDataFrame([("interrupted_no_data",)], "status string").write.mode("overwrite").parquet(out_path)
        return "interrupted_no_data"
    if snap.limit(1).count() == 0:
        status = "interrupted_no_metrics"
    else:
        status = "complete" if finished else "interrupted"
    snap.withColumn("status", F.lit(status)).write.mode("overwrite").parquet(out_path)
    return status
