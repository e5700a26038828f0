"""Generation runs: A2, A7 and A8 in one loop that calls the model through I1 and stops at a target.

The draws stand in order (``draw_no``); the run takes them in waves.  A wave's prompts go
through :func:`..operators.infer.batch_inference` once, its replies are classified (C11, C9, C10) against
each other and against the successes of earlier waves, and the wave is committed as a batch of
the run's commit log together with the run's state.  The next wave is as long as the measured
share of successes says is needed.  The attempt that brings the target is the run's last: later
replies of its wave are not attempts, are not tracked as used, and no wave follows.

A run that is started again on the same folder goes on after its last committed wave.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import materialize
from ..sources import commits
from .augment import generation_outcomes, record_attempts
from .infer import MAX_RETRIES, RETRY_DELAY_SEC, WORKERS, batch_inference

MAX_WAVE = 100_000


class JsonReplies:
    """A predictor whose reply counts only if it holds JSON, so that I1 tries again otherwise."""

    def __init__(self, predict_fn):
        self.predict_fn = predict_fn

    def __call__(self, messages, attempt):
        reply = self.predict_fn(messages, attempt)
        text = (reply or "").strip().removeprefix("```json").removeprefix("```").removesuffix("```")
        json.loads(text, strict=False)  # raises on anything else
        return reply


@dataclass(frozen=True)
class Run:
    """Where a run stands: attempts and successes so far, the draw after the last one used."""

    base: str
    target: int
    attempts: int = 0
    successes: int = 0
    next_draw: int = 0
    waves: int = 0

    @property
    def reached(self) -> bool:
        return self.successes >= self.target

    def wave_size(self, draws: int, most: int = MAX_WAVE) -> int:
        """How many draws the next wave takes of ``draws`` in all: what is missing over the share of successes."""
        share = self.successes / self.attempts if self.attempts else 1.0
        want = math.ceil((self.target - self.successes) / max(share, 1 / 16))
        return 0 if self.reached else max(0, min(want, most, draws - self.next_draw))


def run_state(spark, base: str, target: int) -> Run:
    """The state that the last committed wave left."""
    entry = commits.last(spark, base)
    return Run(base, target, **entry.meta) if entry else Run(base, target)


def _wave(draws: DataFrame, run: Run, size: int, predict_fn, earlier: DataFrame | None, **calls) -> tuple[DataFrame, Run]:
    """The attempts of one wave, cut after the one that reaches the target, and the state after it."""
    rows = draws.where(F.col("draw_no").between(run.next_draw, run.next_draw + size - 1))
    keep = [c for c in draws.columns if c not in ("draw_no", "messages")]
    replies = batch_inference(rows, predict_fn, "draw_no", "messages", passthrough=keep, **calls)
    replies = materialize(replies.withColumnRenamed("attempts", "calls").drop("prediction", "success"))  # every call is made here
    done = materialize(generation_outcomes(replies, "response", "draw_no", seen=earlier))
    missing = run.target - run.successes
    hits = done.where("outcome = 'success'").select("draw_no").orderBy("draw_no").limit(missing)
    n, last = hits.agg(F.count(F.lit(1)), F.max("draw_no")).first()
    stop = last if n == missing else run.next_draw + size - 1
    used = done.where(F.col("draw_no") <= stop)
    after = Run(run.base, run.target, run.attempts + used.count(), run.successes + n, stop + 1, run.waves + 1)
    return used.withColumn("wave", F.lit(after.waves)), after


def generation_run(draws: DataFrame, predict_fn, base: str, target: int, tracking: str | None = None, key: str | None = None,
                   max_wave: int = MAX_WAVE, max_waves: int | None = None, max_retries: int = MAX_RETRIES,
                   retry_delay: float = RETRY_DELAY_SEC, workers: int = WORKERS, partitions: int | None = None) -> Run:
    """Run (or go on with) the generation below ``base`` until ``target`` distinct valid examples
    are there or the draws end; :func:`attempts` reads the log.

    ``draws``: ``draw_no`` (from 0, without gaps), ``messages``, ``source_id`` and what else the
    log shall hold; it must give the same rows each time.  Sources of attempts are recorded
    as used in ``tracking`` under ``key`` after every wave.  ``max_waves`` ends earlier.
    """
    spark, n_draws = draws.sparkSession, draws.count()
    run = run_state(spark, base, target)
    if tracking and run.waves:  # the last wave may have been committed without its tracking
        record_attempts(attempts(spark, base).where(F.col("wave") == run.waves), tracking, key)
    started = run.waves
    while (size := run.wave_size(n_draws, max_wave)) and (max_waves is None or run.waves - started < max_waves):
        earlier = attempts(spark, base).where("outcome = 'success'").select("query_hash") if run.waves else None
        used, run = _wave(draws, run, size, JsonReplies(predict_fn), earlier, max_retries=max_retries, retry_delay=retry_delay,
                          workers=workers, partitions=partitions)
        meta = {"attempts": run.attempts, "successes": run.successes, "next_draw": run.next_draw, "waves": run.waves}
        commits.append(used, base, meta=meta)
        if tracking:
            record_attempts(used, tracking, key)
    return run


def attempts(spark, base: str) -> DataFrame:
    """The log of a run: one row per attempt, with its ``outcome`` and the ``wave`` it was in."""
    return commits.read(spark, base)
