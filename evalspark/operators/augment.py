"""Augmentation: A1-A9.

Randomness is deterministic per row: every draw is an md5 of (seed, purpose,
draw number[, field, position]) mapped to [0, 1), so results do not depend on
partitioning or task timing.  The contract follows the reference's sizes, ranges
and probabilities, not its PRNG sequence.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.common import attach_one_row, evaluate_once, materialize, md5_bigint, md5_uniform, ratio
from ..functions.json import lenient_object
from ..operators.labels import label_distribution, repair_labels

# ---------------------------------------------------------------------------
# Fixed values of the two augmentation levels.
# ---------------------------------------------------------------------------
HARD_MIN_FIELDS = 5
MEDIUM_FIELD_RANGE = (6, 7)
CORE_FIELDS = ["department", "access_level", "allowed_actions"]
HARD_STRATEGIES = [(0.35, "all_active"), (0.75, "subset"), (None, "reduced")]
MEDIUM_STRATEGIES = [(0.50, "all_active"), (0.90, "subset"), (None, "minimal_reduce")]
SUBSET_MAX_ITEMS = {"hard": 4, "medium": 3}
SUBSET_MIN_ITEMS = 2
BOOL_TRUE_SHARE = 0.75
HARD_KEEP_FIELDS = 5
MEDIUM_REDUCE_MIN_FIELDS = 7
DRAW_FACTOR = 2  # sources drawn per requested example


def eligible_sources(df: DataFrame, perm_col: str = "permissions", level: str = "hard") -> DataFrame:
    """A1: rows whose permissions parse to an object with enough fields.

    hard: at least 5 fields; medium: 6 or 7.  Adds ``n_fields``.
    """
    # parsed once per row; the filter below reads the result instead of re-parsing
    out = evaluate_once(df, __m=lenient_object(perm_col))
    out = out.withColumn("n_fields", F.when(F.col("__m").isNotNull(), F.size("__m"))).drop("__m")
    if level == "hard":
        return out.filter(F.col("n_fields") >= HARD_MIN_FIELDS)
    if level == "medium":
        lo, hi = MEDIUM_FIELD_RANGE
        return out.filter(F.col("n_fields").between(lo, hi))
    raise ValueError(f"unknown level {level!r}")


# ---------------------------------------------------------------------------
# A2: used-source tracking
# ---------------------------------------------------------------------------

def tracking_key(input_name: str) -> str:
    """A2: first 8 hex digits of md5(input file name)."""
    return hashlib.md5(input_name.encode()).hexdigest()[:8]


def read_used(spark: SparkSession, tracking_path: str, key: str, reset: bool = False) -> DataFrame:
    """Used source ids for ``key`` (empty after ``reset`` or when nothing is tracked)."""
    empty = spark.createDataFrame([], "source_id bigint")
    if reset:
        return empty
    try:
        t = spark.read.parquet(tracking_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty
    return t.filter(F.col("tracking_key") == key).select("source_id").distinct()


def record_attempts(attempts: DataFrame, tracking_path: str, key: str, source_col: str = "source_id") -> None:
    """A2: append every attempted source id (failed attempts count as used)."""
    (attempts.select(F.lit(key).alias("tracking_key"), F.col(source_col).cast("bigint").alias("source_id"))
     .distinct().write.mode("append").partitionBy("tracking_key").parquet(tracking_path))


def unused_sources(eligible: DataFrame, used: DataFrame, id_col: str) -> DataFrame:
    """A2: eligible sources not used before (anti join)."""
    return eligible.join(used.withColumnRenamed("source_id", id_col), id_col, "left_anti")


# ---------------------------------------------------------------------------
# A3: draw sources
# ---------------------------------------------------------------------------

def dense_rank_by_hash(df: DataFrame, h_col: str, id_col: str, out: str = "pos", bucket_bits: int = 16) -> DataFrame:
    """0-based position of each row in (hash, id) order without a global sort.

    Rows are counted per hash bucket (at most 2^bucket_bits counts, a proven
    bound, broadcast back as offsets); positions inside a bucket come from a
    window over that bucket only (about n / 2^bucket_bits rows each, spread over
    all tasks).
    """
    b = F.shiftright(F.col(h_col), 60 - bucket_bits).alias("__b")
    keyed = df.withColumn("__b", b)
    counts = keyed.groupBy("__b").agg(F.count(F.lit(1)).alias("__nb"))
    offs = counts.withColumn("__off", F.sum("__nb").over(
        Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__nb"))
    j = keyed.join(F.broadcast(offs.select("__b", "__off")), "__b")
    w = Window.partitionBy("__b").orderBy(F.col(h_col), F.col(id_col))
    return j.withColumn(out, F.col("__off") + F.row_number().over(w) - 1).drop("__b", "__off")


def draw_sources(spark: SparkSession, unused: DataFrame, eligible: DataFrame, id_col: str, n_examples: int,
                 seed: int = 42, n_unused: int | None = None, n_eligible: int | None = None) -> DataFrame:
    """A3: ``2 * n_examples`` draws: without replacement while unused sources
    last, then with replacement from all eligible sources (``reused = true``).

    Output: ``draw_no`` (attempt order, 0-based), ``source_id``, ``reused``.
    Pass ``n_unused`` / ``n_eligible`` when known to skip the two counts.
    """
    n_draws = DRAW_FACTOR * n_examples
    # the unused-id set feeds the count, the bucket counts and the ranks: read it once
    u = materialize(unused.select(F.col(id_col).alias("source_id")))
    u = u.withColumn("__h", md5_bigint(F.lit(str(seed)), F.lit("draw"), F.col("source_id")))
    ranked = dense_rank_by_hash(u, "__h", "source_id", "draw_no").filter(F.col("draw_no") < n_draws)
    unique = ranked.select("draw_no", "source_id", F.lit(False).alias("reused"))
    n_unique = n_unused if n_unused is not None else u.count()
    n_reuse = max(0, n_draws - n_unique)
    if n_reuse == 0:
        return unique
    e = eligible.select(F.col(id_col).alias("source_id"))
    e = e.withColumn("__h", md5_bigint(F.lit(str(seed)), F.lit("pool"), F.col("source_id")))
    indexed = dense_rank_by_hash(e, "__h", "source_id", "pool_pos").drop("__h")
    n_elig = n_eligible if n_eligible is not None else e.count()
    if n_elig == 0:
        return unique
    draws = spark.range(n_unique, n_draws).withColumnRenamed("id", "draw_no")
    draws = draws.withColumn("pool_pos", F.pmod(md5_bigint(F.lit(str(seed)), F.lit("reuse"), F.col("draw_no")),
                                               F.lit(n_elig)))
    reused = draws.join(indexed, "pool_pos").select("draw_no", "source_id", F.lit(True).alias("reused"))
    return unique.unionByName(reused)


# ---------------------------------------------------------------------------
# Strategy and permission sampling
# ---------------------------------------------------------------------------

def assign_strategy(df: DataFrame, draw_col: str = "draw_no", seed: int = 42, level: str = "hard") -> DataFrame:
    """A4: strategy from a uniform draw: hard 35/40/25 %, medium 50/40/10 %."""
    u = md5_uniform(F.lit(str(seed)), F.lit("strategy"), F.col(draw_col))
    cuts = HARD_STRATEGIES if level == "hard" else MEDIUM_STRATEGIES
    e = None
    for cut, name in cuts:
        if cut is None:
            e = e.otherwise(name)
        else:
            e = F.when(u < cut, name) if e is None else e.when(u < cut, name)
    return df.withColumn("strategy", e)


def _subset(m, draw, seed: int, max_items: int):
    """A5 on a permission map: long lists keep 2..max items, booleans redrawn."""
    def one(k, v):
        t = F.schema_of_variant(v)
        arr = v.try_cast("array<variant>")
        n = F.size(arr)
        keep = F.lit(SUBSET_MIN_ITEMS) + F.floor(
            md5_uniform(F.lit(str(seed)), F.lit("k"), draw, k) * (F.least(F.lit(max_items), n) - 1)).cast("int")
        # variants are not orderable: sort (hash, position) pairs, then pick by position
        keyed = F.transform(arr, lambda x, i: F.struct(
            md5_bigint(F.lit(str(seed)), F.lit("item"), draw, k, i).alias("o"), i.alias("i")))
        picked = F.transform(F.slice(F.array_sort(keyed), 1, keep), lambda s: F.get(arr, s["i"]))
        coin = md5_uniform(F.lit(str(seed)), F.lit("bool"), draw, k) < BOOL_TRUE_SHARE
        return (F.when(t.startswith("ARRAY") & (n > 2), F.to_variant_object(picked))
                .when(t == "BOOLEAN", F.when(coin, F.parse_json(F.lit("true"))).otherwise(F.parse_json(F.lit("false"))))
                .otherwise(v))
    return F.transform_values(m, one)


def _drop_fields(m, draw, seed: int, how_many):
    """Drop ``how_many`` non-core fields, chosen by hash order."""
    droppable = F.array_except(F.map_keys(m), F.array(*[F.lit(c) for c in CORE_FIELDS]))
    order = F.transform(droppable, lambda k: F.struct(md5_bigint(F.lit(str(seed)), F.lit("drop"), draw, k).alias("o"),
                                                      k.alias("k")))
    to_drop = F.transform(F.slice(F.array_sort(order), 1, how_many), lambda s: s["k"])
    return F.map_filter(m, lambda k, v: ~F.array_contains(to_drop, k))


def sample_permissions(df: DataFrame, perm_col: str = "permissions", strategy_col: str = "strategy",
                       draw_col: str = "draw_no", seed: int = 42, level: str = "hard") -> DataFrame:
    """Modified permissions (``modified`` as JSON text) and the tag used.

    Output adds ``modified_permissions`` (JSON) and ``strategy_used``; the
    ``reduced`` tags are reduced / reduced_minimal / reduced_no_drop (hard) and
    minimal_reduce / minimal_reduce_skip / minimal_reduce_no_drop (medium).
    """
    m = lenient_object(perm_col)
    out = df.withColumn("__m", m)
    mc, draw = F.col("__m"), F.col(draw_col)
    n = F.size(mc)
    droppable_n = F.size(F.array_except(F.map_keys(mc), F.array(*[F.lit(c) for c in CORE_FIELDS])))
    s = F.col(strategy_col)
    subset = _subset(mc, draw, seed, SUBSET_MAX_ITEMS[level])
    if level == "hard":
        want = F.lit(1) + F.floor(md5_uniform(F.lit(str(seed)), F.lit("ndrop"), draw) * 2).cast("int")
        k_drop = F.least(want, droppable_n, n - F.lit(HARD_KEEP_FIELDS))
        reduced_tag = (F.when(n <= HARD_KEEP_FIELDS, "reduced_minimal")
                       .when(droppable_n == 0, "reduced_no_drop").otherwise("reduced"))
        reduce_name = "reduced"
    else:
        k_drop = F.lit(1)
        reduced_tag = (F.when(n < MEDIUM_REDUCE_MIN_FIELDS, "minimal_reduce_skip")
                       .when(droppable_n == 0, "minimal_reduce_no_drop").otherwise("minimal_reduce"))
        reduce_name = "minimal_reduce"
    reduced = F.when(reduced_tag == reduce_name, _drop_fields(mc, draw, seed, k_drop)).otherwise(mc)
    new_map = F.when(s == "subset", subset).when(s == reduce_name, reduced).otherwise(mc)
    tag = F.when(s == reduce_name, reduced_tag).otherwise(s)
    return (out.withColumn("modified_permissions", F.to_json(new_map))
               .withColumn("strategy_used", tag).drop("__m"))


# ---------------------------------------------------------------------------
# A7-A9
# ---------------------------------------------------------------------------

OUTCOMES = ["success", "failed_api", "failed_validation", "duplicate"]


def attempt_summary(attempts: DataFrame, outcome_col: str = "outcome", strategy_col: str = "strategy_used",
                    reused_col: str = "reused") -> DataFrame:
    """One row of totals plus one row per strategy with its share of attempts.

    Output: ``metric, value, pct`` where metric is ``attempts``, an outcome,
    ``reused`` or ``strategy:<name>``.
    """
    tot = attempts.agg(F.count(F.lit(1)).alias("attempts"),
                       *[F.count_if(F.col(outcome_col) == o).alias(o) for o in OUTCOMES],
                       F.count_if(F.col(reused_col)).alias("reused"))
    names = ["attempts"] + OUTCOMES + ["reused"]
    stack = ", ".join(f"'{c}', CAST({c} AS BIGINT)" for c in names)
    totals = tot.select(F.expr(f"stack({len(names)}, {stack}) AS (metric, value)"))
    totals = attach_one_row(totals, tot.select("attempts"))
    per = attempts.groupBy(F.concat(F.lit("strategy:"), F.col(strategy_col)).alias("metric")).agg(
        F.count(F.lit(1)).alias("value"))
    per = attach_one_row(per, tot.select("attempts"))
    return totals.unionByName(per).select("metric", "value", ratio("value", "attempts", 100.0).alias("pct"))


def first_n_successes(attempts: DataFrame, n: int, order_col: str = "draw_no",
                      outcome_col: str = "outcome") -> DataFrame:
    """The first ``n`` successful attempts in attempt order (TakeOrdered)."""
    return attempts.filter(F.col(outcome_col) == "success").orderBy(order_col).limit(n)


def balanced_union(original: DataFrame, synthetic: DataFrame, label_col: str = "expected_response",
                   dialect: str = "repair"):
    """Original rows plus synthetic rows, labels repaired with ``dialect``.

    Returns ``(combined, distribution_before, distribution_after)``; the
    distributions are L1 over the original and over the combined rows.
    """
    cols = original.columns
    combined = original.unionByName(synthetic.select(*cols))
    repaired = repair_labels(combined, label_col, dialect, keep_original=None)
    return (repaired, label_distribution(original, label_col, "distribution"),
            label_distribution(repaired, label_col, "distribution"))


def generation_outcomes(df: DataFrame, response_col: str = "response", draw_col: str = "draw_no",
                        seen: DataFrame | None = None) -> DataFrame:
    """Attempt outcomes for one generation run, or for a part of it after the successes whose keys are ``seen``.

    ``failed_api`` (no response, or one without a parseable, non-empty value),
    ``failed_validation`` (C9 reject), ``duplicate`` (same C10 key as an earlier valid attempt of this run, or a seen one)
    or ``success``.  The first valid attempt per key wins; winners are matched
    back on (key, draw), which is unique, so a hot key never meets in one task.
    """
    from ..functions.common import evaluate_once
    from ..functions.json import extract_json
    from .clean import query_hash, validate_generated
    g = evaluate_once(df, generated=extract_json(response_col))
    reason = F.when(F.col("generated").isNull(), F.lit("unparseable")).otherwise(validate_generated(F.col("generated")))
    g = evaluate_once(g, reject_reason=reason,
                      query_hash=query_hash(F.variant_get(F.col("generated"), "$.query", "string")))
    valid = F.col(response_col).isNotNull() & F.col("reject_reason").isNull()
    winners = (g.filter(valid).groupBy("query_hash").agg(F.min(draw_col).alias(draw_col))
                .withColumn("__first", F.lit(True)))
    if seen is not None:
        winners = winners.join(seen.select("query_hash").distinct(), "query_hash", "left_anti")
    j = g.join(winners, ["query_hash", draw_col], "left")
    nothing = F.col("generated").isNull() | F.to_json("generated").isin("{}", "[]", "null", '""', "0", "false")
    outcome = (F.when(F.col(response_col).isNull() | nothing, "failed_api")
               .when(F.col("reject_reason").isNotNull(), "failed_validation")
               .when(F.col("__first"), "success").otherwise("duplicate"))
    return j.withColumn("outcome", outcome).drop("__first")
