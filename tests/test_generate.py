"""Generation runs (A2, A7, A8 through I1): stop at the target, waves, tracking, resumption."""

import os

import pytest
from pyspark.sql import functions as F

from evalspark.operators import augment as A
from evalspark.operators import generate as N


def model_of(folder):
    """Answers by the prompt's number and writes down every call."""
    class Model:  # defined here so workers receive it by value
        def __call__(self, messages, attempt):
            import json
            import uuid
            n = int(messages[0]["content"])
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(f"{n} {attempt}")
            if n % 11 == 3 or (n % 11 == 4 and attempt == 1):
                raise TimeoutError("busy")
            if n % 11 == 5:
                return "no JSON"
            text = n - 10 if n % 11 == 7 and n > 10 else n  # a copy of an earlier prompt's text
            return json.dumps({"user_role": "r", "permissions": {"a": 1}, "query": f"please open the report no. {text:05d}",
                               "expected_response": "partial" if n % 11 == 6 else "full", "rationale": "ok"})
    return Model()


def outcome(n, seen):
    if n % 11 in (3, 5):
        return "failed_api"
    if n % 11 == 6:
        return "failed_validation"
    text = n - 10 if n % 11 == 7 and n > 10 else n
    if text in seen:
        return "duplicate"
    seen.add(text)
    return "success"


def expected(n_draws, target):
    out, seen, hits = [], set(), 0
    for n in range(n_draws):
        if hits == target:
            break
        out.append((n, outcome(n, seen)))
        hits += out[-1][1] == "success"
    return out


@pytest.fixture
def setting(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    draws = spark.range(300).select(F.col("id").alias("draw_no"), (F.col("id") % 250).alias("source_id"), (F.col("id") >= 250).alias("reused"),
                                    F.lit("subset").alias("strategy_used"),
                                    F.array(F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))).alias("messages"))
    draws.write.parquet(str(tmp_path / "draws"))
    options = dict(base=str(tmp_path / "run"), tracking=str(tmp_path / "track"), key="k", max_retries=2, retry_delay=0)
    return spark.read.parquet(str(tmp_path / "draws")), model_of(str(calls)), calls, options


def log(spark, options):
    return [(r.draw_no, r.outcome) for r in N.attempts(spark, options["base"]).orderBy("draw_no").collect()]


def called(calls):
    return sorted(int((calls / f).read_text().split()[0]) for f in os.listdir(calls))


def test_stops_at_the_target(spark, setting):
    draws, model, calls, options = setting
    run = N.generation_run(draws, model, target=100, **options)
    want = expected(300, 100)
    assert log(spark, options) == want
    assert run.reached and (run.successes, run.attempts) == (100, len(want)) and {o for _, o in want} == set(A.OUTCOMES)
    assert run.waves > 1 and max(called(calls)) < 300
    waves = {r.wave: (r.a, r.z) for r in N.attempts(spark, options["base"]).groupBy("wave").agg(
        F.min("draw_no").alias("a"), F.max("draw_no").alias("z")).collect()}
    assert waves[1] == (0, 99) and all(waves[w][1] + 1 == waves[w + 1][0] for w in range(1, run.waves))
    # the last wave was as long as the share of successes asked for; nothing was called after it
    before = sum(o == "success" for n, o in want if n <= waves[run.waves - 1][1])
    size = -(-(100 - before) * (waves[run.waves - 1][1] + 1) // before)
    assert max(called(calls)) == waves[run.waves][0] + size - 1
    used = {r.source_id for r in A.read_used(spark, options["tracking"], "k").collect()}
    assert used == {n % 250 for n, _ in want}
    tries = {r.draw_no: r.calls for r in N.attempts(spark, options["base"]).collect()}
    assert all(tries[n] == (3 if n % 11 in (3, 5) else 2 if n % 11 == 4 else 1) for n, _ in want)
    n = len(called(calls))
    assert N.generation_run(draws, model, target=100, **options) == run and len(called(calls)) == n  # nothing is left to do


def test_draws_run_out(spark, setting):
    draws, model, _, options = setting
    run = N.generation_run(draws, model, target=1000, max_wave=120, **options)
    assert not run.reached and run.attempts == 300 and log(spark, options) == expected(300, 1000)


def test_interrupted_run_goes_on(spark, setting):
    draws, model, calls, options = setting
    first = N.generation_run(draws, model, target=100, max_wave=40, max_waves=1, **options)
    assert (first.waves, first.next_draw) == (1, 40)
    # the process dies before the wave's tracking, and a second wave before its commit
    os.rename(options["tracking"], options["tracking"] + "-lost")
    from evalspark.sources import commits
    commits.write_batch(N.attempts(spark, options["base"]), options["base"])
    N.generation_run(draws, model, target=100, max_wave=40, **options)
    assert log(spark, options) == expected(300, 100)
    assert [n for n in called(calls) if n < 40 and n % 11 not in (3, 4, 5)] == [n for n in range(40) if n % 11 not in (3, 4, 5)]
    assert {r.source_id for r in A.read_used(spark, options["tracking"], "k").collect()} == {n for n, _ in expected(300, 100)}


def test_replies_without_json_are_tried_again():
    tries = []

    def model(messages, attempt):
        tries.append(attempt)
        return '```json\n{"a": 1}\n```' if attempt > 1 else "hm"
    keen = N.JsonReplies(model)
    with pytest.raises(ValueError):
        keen([], 1)
    assert keen([], 2) == '```json\n{"a": 1}\n```' and tries == [1, 2]
