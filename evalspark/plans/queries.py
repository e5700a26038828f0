"""Registered queries: one per operator group of SURVEY §2, over the driver tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> DuckDB SQL``.
Columns are aliased identically on both sides; ratios are rounded to 6 places.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import evaluate_once, materialize, spread
from ..functions.labels import DIALECTS, normalize_label
from ..operators import labels as L
from ..operators import metrics as M
from . import bindings as B
from . import oracle as O

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def scored(spark, d, predictor="a"):
    """Predictions paired with truth (M1), truth normalised in the results dialect (M2)."""
    paired, _ = M.pair_predictions(B.predictions(spark, d, predictor), B.truth(spark, d), "id")
    return paired.withColumn("truth", normalize_label("truth_raw", "results"))


# ---------------------------------------------------------------------------
# labels: C5 C6 C7 C8 L1 L2 L3 M3
# ---------------------------------------------------------------------------

_pct = "(n * 1.0 / n_total) * 100.0"
register("label_distribution", f"""
WITH b AS ({O.labelled_orders_sql()}),
lab AS (SELECT {O.normalize('expected_response', 'distribution')} AS label FROM b),
per AS (SELECT label, count(*) AS n FROM lab GROUP BY label),
tot AS (SELECT sum(n) AS n_total, sum(CASE WHEN label IS NOT NULL THEN n ELSE 0 END) AS n_labelled FROM per)
SELECT label, n, round({_pct}, 6) AS pct,
       repeat('█', CAST(floor({_pct} / 2.0) AS INTEGER)) AS bar,
       CAST(n_labelled AS BIGINT) AS n_labelled, CAST(n_total AS BIGINT) AS n_total
FROM per, tot WHERE label IS NOT NULL
""")(lambda spark, d: L.label_distribution(B.labelled_orders(spark, d), dialect="distribution"))


def _dialect_cols_sql():
    cols = []
    for dl in DIALECTS:
        e = O.normalize("expected_response", dl)
        if dl == "results":
            e = f"CASE WHEN {e} IN ('full', 'partial', 'rejected') THEN {e} ELSE 'error' END"
        cols.append(f"{e} AS {dl}")
    return ", ".join(cols)


@register("label_dialects", f"""
SELECT expected_response AS raw_label, {_dialect_cols_sql()}, count(*) AS n
FROM ({O.labelled_orders_sql()}) b GROUP BY ALL
""")
def _label_dialects(spark, d):
    raw = L.raw_label_counts(B.labelled_orders(spark, d), "expected_response")
    cols = []
    for dl in DIALECTS:
        e = normalize_label("raw", dl)
        if dl == "results":
            e = F.when(e.isin("full", "partial", "rejected"), e).otherwise(F.lit("error"))
        cols.append(e.alias(dl))
    return raw.select(F.col("raw").alias("raw_label"), *cols, "n")


register("label_change_log", f"""
SELECT expected_response AS original, {O.normalize('expected_response', 'repair')} AS normalized, count(*) AS n
FROM ({O.labelled_orders_sql()}) b
WHERE expected_response IS DISTINCT FROM {O.normalize('expected_response', 'repair')}
GROUP BY ALL
""")(lambda spark, d: L.label_change_log(B.labelled_orders(spark, d), "expected_response", "repair"))

register("corrupted_tally", f"""
WITH b AS (SELECT lower(trim(expected_response, {O.WS})) AS original, {O.normalize('expected_response', 'distribution')} AS normalized
           FROM ({O.labelled_orders_sql()}) x)
SELECT original, normalized, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM b), 6) AS pct
FROM b WHERE original IN ('p', 'r', 'f') AND original IS DISTINCT FROM normalized GROUP BY ALL
""")(lambda spark, d: L.corrupted_tally(B.labelled_orders(spark, d)))

register("label_change_log_conservative", f"""
SELECT expected_response AS original, {O.normalize('expected_response', 'conservative')} AS normalized, count(*) AS n
FROM ({O.labelled_orders_sql()}) b
WHERE expected_response IS DISTINCT FROM {O.normalize('expected_response', 'conservative')}
GROUP BY ALL
""")(lambda spark, d: L.label_change_log(B.labelled_orders(spark, d), "expected_response", "conservative"))

_norm_r = O.normalize("expected_response", "repair")
register("label_dry_run", f"""
SELECT count(*) AS n_rows,
       count(*) FILTER (WHERE expected_response IS DISTINCT FROM {_norm_r}) AS n_changed,
       count(DISTINCT CASE WHEN expected_response IS DISTINCT FROM {_norm_r}
             THEN coalesce(expected_response, 'None') || '→' || {_norm_r} END) AS n_distinct_changes
FROM ({O.labelled_orders_sql()}) b
""")(lambda spark, d: L.label_dry_run(B.labelled_orders(spark, d), "expected_response", "repair"))

register("split_label_stats", f"""
SELECT split, count(*) AS total,
       count(*) FILTER (WHERE expected_response = 'full') AS "full",
       count(*) FILTER (WHERE expected_response = 'partial') AS "partial",
       count(*) FILTER (WHERE expected_response = 'rejected') AS "rejected",
       round(100.0 * count(*) FILTER (WHERE expected_response = 'full') / count(*), 6) AS full_pct,
       round(100.0 * count(*) FILTER (WHERE expected_response = 'partial') / count(*), 6) AS partial_pct,
       round(100.0 * count(*) FILTER (WHERE expected_response = 'rejected') / count(*), 6) AS rejected_pct
FROM ({O.labelled_orders_sql()}) b GROUP BY split
""")(lambda spark, d: L.split_label_stats(B.labelled_orders(spark, d), "split", "expected_response"))


@register("dataset_sizes", """
SELECT dataset, count(*) AS n_rows FROM (
  SELECT 'documents' AS dataset FROM documents UNION ALL SELECT 'labels' FROM labels
  UNION ALL SELECT 'conversations' FROM conversations UNION ALL SELECT 'benchmark' FROM benchmark
  UNION ALL SELECT 'orders' FROM orders) GROUP BY dataset
""")
def _dataset_sizes(spark, d):
    parts = [B.read(spark, d, t).select(F.lit(t).alias("dataset"))
             for t in ("documents", "labels", "conversations", "benchmark", "orders")]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return L.dataset_sizes(u, "dataset")


_norm_res = O.normalize("expected_response", "results")
register("invalid_label_offenders", f"""
SELECT label, n FROM (
  SELECT {_norm_res} AS label, count(*) AS n FROM ({O.labelled_orders_sql()}) b GROUP BY 1)
WHERE label IS NULL OR label NOT IN ('full', 'partial', 'rejected')
ORDER BY n DESC, label ASC NULLS FIRST LIMIT 10
""")(lambda spark, d: L.invalid_label_offenders(
    B.labelled_orders(spark, d).select(normalize_label("expected_response", "results").alias("results")), "results"))


# ---------------------------------------------------------------------------
# metrics: M1 M2 M4-M11 M13
# ---------------------------------------------------------------------------

register("pair_predictions", f"SELECT id, run, prediction, truth_raw, truth FROM ({O.scored_sql()})")(
    lambda spark, d: scored(spark, d).select("id", "run", "prediction", "truth_raw", "truth"))

register("unmatched_predictions", f"""
SELECT id, 'prediction_only' AS side FROM ({O.predictions_sql()}) p WHERE id NOT IN (SELECT id FROM ({O.truth_sql()}))
UNION ALL
SELECT id, 'truth_only' AS side FROM ({O.truth_sql()}) t WHERE id NOT IN (SELECT id FROM ({O.predictions_sql()}))
""")(lambda spark, d: M.pair_predictions(B.predictions(spark, d), B.truth(spark, d), "id")[1])



def _grid_sql(by: str = "") -> str:
    sel = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""
WITH s AS ({O.scored_sql()}),
runs AS (SELECT {sel}count(*) AS n_total FROM s {grp}),
grid AS (SELECT {sel}t.truth, p.prediction FROM runs,
         (VALUES ('full'), ('partial'), ('rejected')) t(truth), (VALUES ('full'), ('partial'), ('rejected')) p(prediction)),
cnt AS (SELECT {sel}truth, prediction, count(*) AS n FROM s {('GROUP BY ' + by + ', truth, prediction') if by else 'GROUP BY truth, prediction'})
SELECT {('g.' + by + ', ') if by else ''}g.truth, g.prediction, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM grid g LEFT JOIN cnt c ON g.truth = c.truth AND g.prediction = c.prediction {('AND g.' + by + ' = c.' + by) if by else ''}
"""


register("confusion_matrix", _grid_sql("run"))(
    lambda spark, d: M.confusion_matrix(scored(spark, d), "truth", "prediction", ["run"]))

register("confusion_matrix_present", f"""
WITH g AS ({_grid_sql('run')}),
pres AS (SELECT run, truth AS cls FROM ({O.scored_sql()}) UNION SELECT run, prediction FROM ({O.scored_sql()}))
SELECT g.run, g.truth, g.prediction, g.n FROM g
WHERE (g.run, g.truth) IN (SELECT run, cls FROM pres) AND (g.run, g.prediction) IN (SELECT run, cls FROM pres)
""")(lambda spark, d: M.confusion_matrix(scored(spark, d), "truth", "prediction", ["run"], labels="present"))


def _per_class_sql() -> str:
    return f"""
WITH s AS ({O.scored_sql()}),
cls AS (SELECT * FROM (VALUES ('full'), ('partial'), ('rejected')) v(label)),
k AS (SELECT label,
        (SELECT count(*) FROM s WHERE truth = label AND prediction = label) AS tp,
        (SELECT count(*) FROM s WHERE truth = label) AS support,
        (SELECT count(*) FROM s WHERE prediction = label) AS predicted FROM cls)
SELECT label, tp, support, predicted,
  CASE WHEN predicted = 0 THEN 0.0 ELSE tp * 1.0 / predicted END AS p,
  CASE WHEN support = 0 THEN 0.0 ELSE tp * 1.0 / support END AS r,
  CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2.0 * tp / (support + predicted) END AS f
FROM k"""


register("per_class_accuracy", f"""
SELECT label, round(r, 6) AS class_accuracy, CAST(support AS BIGINT) AS support FROM ({_per_class_sql()})
""")(lambda spark, d: M.per_class_stats(scored(spark, d)).select("label", "class_accuracy", "support"))

register("classification_report", f"""
WITH k AS ({_per_class_sql()}), n AS (SELECT sum(support) AS n, sum(tp) AS tp FROM k)
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(support AS BIGINT) AS support FROM k
UNION ALL SELECT 'accuracy', NULL, NULL, round(CASE WHEN n = 0 THEN 0.0 ELSE tp * 1.0 / n END, 6), CAST(n AS BIGINT) FROM n
UNION ALL SELECT 'macro avg', round(sum(p) / 3.0, 6), round(sum(r) / 3.0, 6), round(sum(f) / 3.0, 6), CAST(sum(support) AS BIGINT) FROM k
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
                 round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM k
""")(lambda spark, d: M.classification_report(scored(spark, d)))


def _summary_sql(by: str = "", scored_rows: str = "") -> str:
    sel = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    on = f"USING ({by})" if by else "ON TRUE"
    return f"""
WITH s AS ({scored_rows or O.scored_sql()}),
k AS (SELECT {sel}c.label,
        count(*) FILTER (WHERE truth = c.label AND prediction = c.label) AS tp,
        count(*) FILTER (WHERE truth = c.label) AS support,
        count(*) FILTER (WHERE prediction = c.label) AS predicted
      FROM s, (VALUES ('full'), ('partial'), ('rejected')) c(label) GROUP BY {sel}c.label),
m AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp * 1.0 / predicted END AS p,
        CASE WHEN support = 0 THEN 0.0 ELSE tp * 1.0 / support END AS r,
        CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2.0 * tp / (support + predicted) END AS f FROM k),
a AS (SELECT {sel}sum(tp) AS diag, sum(support) AS n_true,
        count(*) FILTER (WHERE support + predicted > 0) AS n_present,
        sum(f) AS sf, sum(p) AS sp, sum(r) AS sr, sum(f * support) AS wf FROM m {grp}),
t AS (SELECT {sel}count(*) AS n_total FROM s {grp})
SELECT {sel}CAST(n_total AS BIGINT) AS n_total, round(diag * 1.0 / n_total, 6) AS accuracy,
  round(sf / n_present, 6) AS f1_macro, round(wf / n_true, 6) AS f1_weighted,
  round(sp / n_present, 6) AS precision_macro, round(sr / n_present, 6) AS recall_macro
FROM a JOIN t {on}"""


register("summary_metrics", _summary_sql())(lambda spark, d: M.summary_metrics(scored(spark, d)))

register("compare_runs", f"""
SELECT run, n_total, accuracy, f1_macro, f1_weighted FROM ({_summary_sql('run')})
""")(lambda spark, d: M.compare_runs(scored(spark, d), run="run"))

register("corrupted_share", f"""
SELECT run, count(*) AS n_rows,
  count(*) FILTER (WHERE truth_raw IS NULL OR truth_raw NOT IN ('full', 'partial', 'rejected')) AS corrupted_truth,
  count(*) FILTER (WHERE prediction IS NULL OR prediction NOT IN ('full', 'partial', 'rejected')) AS corrupted_prediction,
  round(count(*) FILTER (WHERE truth_raw IS NULL OR truth_raw NOT IN ('full', 'partial', 'rejected')) * 1.0 / count(*), 6) AS corrupted_truth_share,
  round(count(*) FILTER (WHERE prediction IS NULL OR prediction NOT IN ('full', 'partial', 'rejected')) * 1.0 / count(*), 6) AS corrupted_prediction_share
FROM ({O.scored_sql()}) GROUP BY run
""")(lambda spark, d: L.corrupted_share(scored(spark, d), "truth_raw", "prediction", ["run"]))


@register("paired_comparison", f"""
WITH a AS ({O.scored_sql('a')}), b AS ({O.predictions_sql('b')}),
j AS (SELECT (a.prediction = a.truth)::INT AS ca, (b.prediction = a.truth)::INT AS cb FROM a JOIN b USING (id)),
s AS (SELECT count(*) AS n, avg(ca) AS acc_a, avg(cb) AS acc_b, avg(ca - cb) AS mean_diff,
             stddev_samp(ca - cb) AS sd_diff, count(*) FILTER (WHERE ca - cb > 0) AS a_only_correct,
             count(*) FILTER (WHERE ca - cb < 0) AS b_only_correct FROM j)
SELECT n, round(acc_a, 6) AS acc_a, round(acc_b, 6) AS acc_b, round(mean_diff, 6) AS mean_diff,
       round(sd_diff, 6) AS sd_diff,
       round(CASE WHEN sd_diff IS NULL OR sd_diff = 0 THEN NULL ELSE mean_diff / (sd_diff / sqrt(n)) END, 6) AS t_stat,
       a_only_correct, b_only_correct FROM s
""")
def _paired(spark, d):
    return M.paired_comparison(scored(spark, d, "a"), B.predictions(spark, d, "b"), "id")


register("error_categories", f"""
SELECT truth, prediction, count(*) AS n FROM ({O.scored_sql()}) WHERE truth <> prediction GROUP BY ALL
""")(lambda spark, d: M.error_categories(scored(spark, d)))


# ---------------------------------------------------------------------------
# semi-structured profiling: C4 P1-P8 K4
# ---------------------------------------------------------------------------

from ..operators import profile as P  # noqa: E402

_ex = O.examples_sql()
_alt = "replace(permissions, '''', '\"')"
register("lenient_json_parse", f"""
SELECT example_id,
  CASE WHEN permissions IS NULL OR permissions = '' THEN 'empty'
       WHEN json_valid(permissions) AND json_type(permissions) = 'OBJECT' THEN 'object'
       WHEN json_valid(permissions) THEN 'not_object'
       WHEN json_valid({_alt}) AND json_type({_alt}) = 'OBJECT' THEN 'object_requoted'
       WHEN json_valid({_alt}) THEN 'not_object' ELSE 'invalid' END AS parse_status,
  coalesce(CAST(len(json_keys({O.lenient_object_sql('permissions')})) AS INTEGER), 0) AS n_fields,
  coalesce(array_to_string(list_sort(json_keys({O.lenient_object_sql('permissions')})), ','), '') AS field_names
FROM ({_ex})
""")(lambda spark, d: P.lenient_json_parse(B.examples(spark, d), "example_id", "permissions"))


def _topn_sql(counts: str, part: str, value: str, top: int, tail_suffix: str, extra_cols: str = "") -> str:
    """Rank ``counts`` (value, n) within ``part`` and append the tail row."""
    pby = f"PARTITION BY {part}" if part else ""
    sel = f"{part}, " if part else ""
    return f"""
WITH c AS ({counts}),
r AS (SELECT *, row_number() OVER ({pby} ORDER BY n DESC, {value} ASC NULLS FIRST) AS rank,
             count(*) OVER ({pby}) AS n_values, sum(n) OVER ({pby}) AS group_total FROM c)
SELECT {sel}CAST(rank AS BIGINT) AS rank, {extra_cols}{value} AS value, CAST(n AS BIGINT) AS n,
       CAST(n_values AS BIGINT) AS n_values, CAST(group_total AS BIGINT) AS group_total, false AS is_tail
FROM r WHERE rank <= {top}
UNION ALL
SELECT {sel}CAST({top + 1} AS BIGINT), {'NULL, ' if extra_cols else ''}'... and ' || CAST(max(n_values) - {top} AS VARCHAR) || '{tail_suffix}',
       CAST(sum(n) AS BIGINT), CAST(max(n_values) AS BIGINT), CAST(max(group_total) AS BIGINT), true
FROM r WHERE rank > {top} {('GROUP BY ' + part) if part else 'HAVING count(*) > 0'}"""


register("role_top_n_with_tail", f"""
SELECT rank, value AS role, n, {O.pct_sql('n', 'group_total')} AS pct, n_values AS n_roles FROM (
{_topn_sql(f"SELECT user_role AS role, count(*) AS n FROM ({_ex}) GROUP BY 1", '', 'role', 30, ' more roles')})
""")(lambda spark, d: P.role_top_n(B.examples(spark, d), "user_role"))

register("field_value_top_n", f"""
SELECT field, rank, CASE WHEN is_tail THEN value ELSE split_part(value, chr(1), 1) END AS value,
       CASE WHEN is_tail THEN 'tail' ELSE split_part(value, chr(1), 2) END AS value_kind,
       n, {O.pct_sql('n', 'group_total')} AS pct, n_values, group_total AS total_occurrences FROM (
{_topn_sql(f"SELECT field, value || chr(1) || value_kind AS vkey, n FROM ({O.value_counts_sql()})", 'field', 'vkey', 20, ' more')})
""")(lambda spark, d: P.field_value_top_n(B.examples(spark, d), "example_id", "permissions"))

register("field_list_lengths", f"""
SELECT field || '_count' AS field, CAST(json_array_length(v) AS INTEGER) AS list_length, count(*) AS n
FROM ({O.entries_sql()}) WHERE jt = 'ARRAY' GROUP BY ALL
""")(lambda spark, d: P.field_list_lengths(B.examples(spark, d), "example_id", "permissions"))

register("field_types", f"""
SELECT field, string_agg(DISTINCT {O.type_name_sql('jt')}, ', ' ORDER BY {O.type_name_sql('jt')}) AS types
FROM ({O.entries_sql()}) GROUP BY field
""")(lambda spark, d: P.field_types(B.examples(spark, d), "example_id", "permissions"))

register("field_distinct", f"""
WITH per AS (SELECT field, count(*) AS unique_values, sum(n) AS total_occurrences FROM ({O.value_counts_sql()}) GROUP BY field)
SELECT field, CAST(unique_values AS BIGINT) AS unique_values, CAST(total_occurrences AS BIGINT) AS total_occurrences,
       CAST((SELECT count(*) FROM per) AS BIGINT) AS n_fields FROM per
""")(lambda spark, d: P.field_distinct(B.examples(spark, d), "example_id", "permissions"))

@register("field_distinct_sketches", f"""
SELECT field, CAST(sum(n) AS BIGINT) AS total_occurrences, true AS any_grouping, true AS within_2_percent
FROM ({O.value_counts_sql()}) GROUP BY field
""")
def _field_distinct_sketches(spark, d):
    """P5 by sketches of 8 stored batches: merged at once, and first by halves; held against the exact count."""
    ex, path = B.examples(spark, d), shared_dir(spark, "sketches")
    P.distinct_sketches(ex.withColumn("batch", F.col("example_id") % 8), "batch", "permissions").write.parquet(path)
    stored = spark.read.parquet(path)
    once = P.approx_distinct(P.merge_sketches(stored))
    halves = P.merge_sketches(stored.where("batch < 4")).unionByName(P.merge_sketches(stored.where("batch >= 4")))
    twice = P.approx_distinct(P.merge_sketches(materialize(halves))).select("field", F.col("approx_values").alias("again"))
    exact = P.field_distinct(ex, "example_id", "permissions").select("field", "unique_values")
    off = F.abs(F.col("approx_values") - F.col("unique_values"))
    return once.join(twice, "field").join(exact, "field").select(
        "field", "total_occurrences", (F.col("approx_values") == F.col("again")).alias("any_grouping"),
        (off <= 0.02 * F.col("unique_values")).alias("within_2_percent"))


register("mean_fields", f"""
SELECT count(*) AS n_rows_with_fields, round(avg(k), 6) AS mean_fields FROM (
  SELECT len(json_keys({O.lenient_object_sql('permissions')})) AS k FROM ({_ex})) WHERE k > 0
""")(lambda spark, d: P.mean_fields(B.examples(spark, d), "permissions"))


def _tokens_binding(spark, d):
    """Examples plus a free-text request naming permissions in brackets on some rows."""
    ex = B.examples(spark, d)
    req = F.when(F.col("example_id") % 3 == 0,
                 F.concat(F.col("query"), F.lit(" with permissions_requested: [\"view_"),
                          F.lower(F.split(F.col("user_role"), "_")[0]), F.lit("\", 'export' , audit]")))
    return ex.withColumn("user_request", req)


def _tokens_sql(split_mode: str) -> str:
    req = ("CASE WHEN example_id % 3 = 0 THEN query || ' with permissions_requested: [\"view_' || "
           "lower(split_part(user_role, '_', 1)) || '\", ''export'' , audit]' END")
    ws = O.WS
    fallback = ("[permissions]" if split_mode == "json"
                else f"list_transform(string_split(permissions, ','), lambda x: trim(x, {ws}))")
    return f"""
WITH e AS (SELECT *, {req} AS user_request FROM ({_ex})),
p AS (SELECT *, CASE WHEN permissions IS NULL OR permissions = '' THEN NULL
                     WHEN NOT json_valid(permissions) THEN {fallback}
                     WHEN json_type(permissions) = 'ARRAY' THEN CASE WHEN json_array_length(permissions) > 0
                       THEN list_transform(from_json(permissions, '["JSON"]'), lambda x: json_extract_string(x, '$')) END
                     WHEN json_type(permissions) = 'OBJECT' THEN CASE WHEN len(json_keys(permissions)) > 0 THEN []::VARCHAR[] END
                     ELSE []::VARCHAR[] END AS t1,
             regexp_extract(user_request, '(?i)permissions[^:]*:\\s*\\[([^\\]]+)\\]', 1) AS m FROM e),
t AS (SELECT CASE WHEN t1 IS NOT NULL THEN t1
                  WHEN coalesce(m, '') <> '' THEN list_transform(string_split(m, ','), lambda x: trim(trim(x, {ws}), '"'''))
                  ELSE []::VARCHAR[] END AS tokens FROM p),
rows AS (SELECT count(*) AS n_rows FROM t),
c AS (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM t) GROUP BY token),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, token ASC NULLS FIRST) AS rank,
             count(*) OVER () AS n_tokens, sum(n) OVER () AS total FROM c)
SELECT CAST(rank AS BIGINT) AS rank, token, CAST(n AS BIGINT) AS n, {O.pct_sql('n', 'n_rows')} AS pct,
       CAST(n_tokens AS BIGINT) AS n_tokens, CAST(total AS BIGINT) AS total_occurrences,
       round(CAST(total AS DOUBLE) / n_rows, 6) AS mean_per_row
FROM r, rows WHERE rank <= 20"""


register("permission_tokens", _tokens_sql("json"))(
    lambda spark, d: P.permission_tokens(_tokens_binding(spark, d), perm_col="permissions",
                                         request_col="user_request", split_mode="json"))
register("permission_tokens_comma", _tokens_sql("comma"))(
    lambda spark, d: P.permission_tokens(_tokens_binding(spark, d), perm_col="permissions",
                                         request_col="user_request", split_mode="comma"))

register("permission_database_roles", f"""
SELECT user_role AS role, count(*) AS count,
       round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM ({_ex})) * 100.0, 6) AS percentage
FROM ({_ex}) WHERE user_role IS NOT NULL AND user_role <> '' GROUP BY 1
""")(lambda spark, d: P.permission_database(B.examples(spark, d))["roles"])

_k4_vals = f"""
SELECT field, value, count(*) AS count FROM (
  SELECT field, {O.py_text_sql('v', 'jt')} AS value FROM ({O.entries_sql()}) WHERE jt <> 'ARRAY'
  UNION ALL
  SELECT field, {O.py_text_sql('x', 'json_type(x)')} FROM (
    SELECT field, unnest(from_json(v, '["JSON"]')) AS x FROM ({O.entries_sql()}) WHERE jt = 'ARRAY')
) GROUP BY ALL"""
register("permission_database_values", f"""
WITH v AS ({_k4_vals}), t AS (SELECT field, sum(count) AS tot FROM v GROUP BY field)
SELECT field, value, count, {O.pct_sql('count', 'tot')} AS percentage FROM v JOIN t USING (field)
""")(lambda spark, d: P.permission_database(B.examples(spark, d))["values"])

register("permission_database_fields", f"""
WITH v AS ({_k4_vals}),
u AS (SELECT field, count(*) AS unique_values FROM v GROUP BY field),
ty AS (SELECT field, string_agg(DISTINCT {O.type_name_sql('jt')}, ', ' ORDER BY {O.type_name_sql('jt')}) AS types
       FROM ({O.entries_sql()}) GROUP BY field)
SELECT field, types, CAST(unique_values AS BIGINT) AS unique_values FROM ty JOIN u USING (field)
""")(lambda spark, d: P.permission_database(B.examples(spark, d))["fields"])


# ---------------------------------------------------------------------------
# splits: T1-T5, K6
# ---------------------------------------------------------------------------

from ..operators import split as T  # noqa: E402
from ..session import shared_dir  # noqa: E402


def _h_sql(*parts) -> str:
    return "('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 15))::BIGINT"


_SPLIT_SQL = f"""
WITH d AS (SELECT doc_id, lang FROM documents),
h AS (SELECT doc_id, lang, {_h_sql("'42'", 'lang', 'CAST(doc_id AS VARCHAR)')} AS h FROM d WHERE lang <> 'es'),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS rn,
             count(*) OVER (PARTITION BY lang) AS n FROM h),
pool AS (SELECT doc_id, lang, {_h_sql("'42'", "'pool'", "'pool'", 'CAST(doc_id AS VARCHAR)')} AS h2
         FROM r WHERE rn <= floor(n * 0.7::DOUBLE)),
p2 AS (SELECT *, row_number() OVER (ORDER BY h2, doc_id) AS rn2, count(*) OVER () AS n2 FROM pool)
SELECT doc_id, lang, 'test' AS split FROM d WHERE lang = 'es'
UNION ALL SELECT doc_id, lang, 'test' FROM r WHERE rn > floor(n * 0.7::DOUBLE)
UNION ALL SELECT doc_id, lang, CASE WHEN rn2 <= floor(n2 * 0.8::DOUBLE) THEN 'train' ELSE 'validation' END FROM p2"""


def _split_docs(spark, d):
    docs = B.read(spark, d, "documents").select("doc_id", "lang")
    return T.three_way_split(docs, "doc_id", "lang", holdout_strata=["es"], pool_fraction=0.70,
                             train_fraction=0.80, seed=42)


register("exact_split", _SPLIT_SQL)(lambda spark, d: _split_docs(spark, d).select("doc_id", "lang", "split"))

register("exact_cut_part_types", f"""
SELECT p_partkey, p_type, rn <= floor(n * 0.7::DOUBLE) AS in_first FROM (
  SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY
         {_h_sql("'7'", 'p_type', 'CAST(p_partkey AS VARCHAR)')}, p_partkey) AS rn,
         count(*) OVER (PARTITION BY p_type) AS n FROM part)
""")(lambda spark, d: T.exact_cut(B.read(spark, d, "part").select("p_partkey", "p_type"),
                                  "p_partkey", "p_type", 0.70, seed=7).select("p_partkey", "p_type", "in_first"))

FRACTIONS = (0.10, 0.25, 0.50)
_SUBSET_SQL = f"""
SELECT doc_id, lang, CASE WHEN rn <= floor(n * 0.1::DOUBLE) THEN 0.1::DOUBLE WHEN rn <= floor(n * 0.25::DOUBLE) THEN 0.25::DOUBLE
                          WHEN rn <= floor(n * 0.5::DOUBLE) THEN 0.5::DOUBLE END AS subset
FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_h_sql("'42'", "'subset'", 'lang', 'CAST(doc_id AS VARCHAR)')}, doc_id) AS rn,
             count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang IS NOT NULL)"""


def _subsets(spark, d):
    docs = B.read(spark, d, "documents").select("doc_id", "lang").where("lang IS NOT NULL")
    return T.nested_subsets(docs, "doc_id", "lang", FRACTIONS)


register("nested_subsets", _SUBSET_SQL)(lambda spark, d: _subsets(spark, d).select("doc_id", "lang", "subset"))

_ABLATION_ROWS = f"""
SELECT x.name AS subset, s.truth, s.prediction FROM ({O.scored_sql()}) s JOIN ({_SUBSET_SQL}) u ON u.doc_id = s.id,
     (VALUES ('p10', 0.1, NULL), ('p25', 0.25, NULL), ('p50', 0.5, NULL), ('en only', 1.0, 'en'), ('de only', 1.0, 'de'), ('combined', 1.0, NULL)) x(name, f, l)
WHERE coalesce(u.subset, 1.0) <= x.f AND (x.l IS NULL OR x.l = u.lang)"""


@register("ablation_metrics", _summary_sql("subset", _ABLATION_ROWS))
def _ablation(spark, d):
    """Metrics of nested samples of 10, 25 and 50 % per language, of single languages, and of all."""
    subsets = materialize(_subsets(spark, d).select(F.col("doc_id").alias("id"), "lang", F.col("subset").alias("least")))
    s = scored(spark, d).join(subsets, "id")
    least = F.coalesce("least", F.lit(1.0))
    return M.ablation_metrics(s, {"p10": least <= 0.10, "p25": least <= 0.25, "p50": least <= 0.50, "en only": F.col("lang") == "en",
                                  "de only": F.col("lang") == "de", "combined": F.lit(True)})


@register("seeded_shuffle", f"""
SELECT CAST(row_number() OVER (ORDER BY {_h_sql("'42'", "'all'", 'CAST(id AS VARCHAR)')}, id) - 1 AS BIGINT) AS ordinal, id, split
FROM ({O.labelled_orders_sql()})
""")
def _seeded_shuffle(spark, d):
    rows = B.labelled_orders(spark, d).select("id", "split")
    return T.seeded_shuffle(rows, "id", shared_dir(spark, "shuffled"), partitions=16)


@register("split_manifest", f"""
WITH s AS ({_SPLIT_SQL}), t AS ({O.truth_sql()})
SELECT split, CAST(42 AS BIGINT) AS seed, count(*) AS total,
       count(*) FILTER (WHERE truth_raw = 'full') AS "full",
       count(*) FILTER (WHERE truth_raw = 'partial') AS "partial",
       count(*) FILTER (WHERE truth_raw = 'rejected') AS "rejected",
       {O.pct_sql("count(*) FILTER (WHERE truth_raw = 'full')", 'count(*)')} AS full_pct,
       {O.pct_sql("count(*) FILTER (WHERE truth_raw = 'partial')", 'count(*)')} AS partial_pct,
       {O.pct_sql("count(*) FILTER (WHERE truth_raw = 'rejected')", 'count(*)')} AS rejected_pct
FROM s LEFT JOIN t ON s.doc_id = t.id GROUP BY split
""")
def _split_manifest(spark, d):
    s = _split_docs(spark, d).join(B.truth(spark, d).withColumnRenamed("id", "doc_id"), "doc_id", "left")
    st = L.split_label_stats(s, "split", "truth_raw")
    return st.select("split", F.lit(42).cast("bigint").alias("seed"), *[c for c in st.columns if c != "split"])


register("head_n", """
SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 25
""")(lambda spark, d: T.head_n(B.read(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id", 25))


# ---------------------------------------------------------------------------
# model output cleaning: C9 C10 C11
# ---------------------------------------------------------------------------

from ..operators import clean as C  # noqa: E402


def generated_checked(spark, d):
    """Generated outputs parsed (C11) and validated (C9): adds ``generated`` and ``reject_reason``."""
    g = C.parse_model_output(B.generated_outputs(spark, d), "model_output", "generated")
    reason = F.when(F.col("generated").isNull(), F.lit("unparseable")).otherwise(
        C.validate_generated(F.col("generated")))
    return evaluate_once(g, reject_reason=reason)


_GEN = f"SELECT doc_id, source, {O.extract_json_sql('model_output')} AS g FROM ({O.generated_sql()})"

register("extract_json", f"""
SELECT doc_id, g IS NOT NULL AS parse_ok,
       CASE WHEN g IS NULL THEN 'none' WHEN json_type(g) = 'OBJECT' THEN 'object'
            WHEN json_type(g) = 'ARRAY' THEN 'array' ELSE 'scalar' END AS kind,
       CAST(CASE WHEN json_type(g) = 'OBJECT' THEN len(json_keys(g)) END AS INTEGER) AS n_keys
FROM ({_GEN})
""")(lambda spark, d: C.parse_model_output(B.generated_outputs(spark, d), "model_output", "g").select(
    "doc_id", F.col("g").isNotNull().alias("parse_ok"),
    F.when(F.col("g").isNull(), "none").when(F.schema_of_variant("g").startswith("OBJECT"), "object")
     .when(F.schema_of_variant("g").startswith("ARRAY"), "array").otherwise("scalar").alias("kind"),
    F.size(C.record_keys(F.col("g"))).alias("n_keys")).withColumn(
    "n_keys", F.when(F.col("kind") == "object", F.col("n_keys"))))

_ws = O.WS
_REASON_SQL = f"""
SELECT doc_id, source, g,
  CASE WHEN g IS NULL THEN 'unparseable'
       WHEN json_type(g) <> 'OBJECT' THEN 'not_object'
       WHEN NOT list_has_all(json_keys(g), ['user_role', 'permissions', 'query', 'expected_response', 'rationale']) THEN 'missing_fields'
       WHEN coalesce(lower(trim(json_extract_string(g, '$.expected_response'), {_ws})), 'none') NOT IN ('full', 'f', 'allow', 'approve') THEN 'bad_label'
       WHEN length(coalesce(trim(json_extract_string(g, '$.query'), {_ws}), '')) < 20 THEN 'short_query'
       WHEN json_type(g, '$.permissions') <> 'OBJECT' THEN 'permissions_not_object'
  END AS reject_reason
FROM ({_GEN})"""

register("validate_generated", f"SELECT doc_id, reject_reason FROM ({_REASON_SQL})")(
    lambda spark, d: generated_checked(spark, d).select("doc_id", "reject_reason"))

register("dedup_exact", f"""
WITH v AS (SELECT doc_id, md5(lower(trim(json_extract_string(g, '$.query'), {_ws}))) AS query_hash
           FROM ({_REASON_SQL}) WHERE reject_reason IS NULL)
SELECT min(doc_id) AS doc_id, query_hash FROM v GROUP BY query_hash
""")(lambda spark, d: C.dedup_exact(
    generated_checked(spark, d).filter(F.col("reject_reason").isNull())
    .select("doc_id", F.variant_get("generated", "$.query", "string").alias("query")), "query", "doc_id",
    columns=["doc_id"]).select("doc_id", "query_hash"))

register("duplicate_report", f"""
SELECT count(*) AS n_rows, count(DISTINCT h) AS n_unique, count(*) - count(DISTINCT h) AS n_duplicates
FROM (SELECT md5(lower(trim(text, {_ws}))) AS h FROM documents)
""")(lambda spark, d: C.duplicate_report(B.read(spark, d, "documents"), "text"))


# ---------------------------------------------------------------------------
# sources / sinks round trips: S2 S3 S4 S5 S6 K1-K5 C1-C3 I4
# Files are written below the session's spark.checkpoint.dir and read back.
# ---------------------------------------------------------------------------

from ..operators.profile import permission_database  # noqa: E402
from ..functions.json import lenient_object  # noqa: E402
from ..sources import readers as R  # noqa: E402
from ..sources import sinks as K  # noqa: E402

_NO_NULL_DROP = {"ignoreNullFields": "false"}


def _jsonl_lines(spark, d, keep_id: bool = False):
    """Examples as JSON Lines with defects: blank (% 43), truncated (% 41), no ``query`` key (% 37)."""
    ex = B.examples(spark, d)
    k = F.col("example_id")
    idc = k.cast("string").alias("id")
    full = F.to_json(F.struct(idc, "user_role", "permissions", "query", "expected_response"), _NO_NULL_DROP)
    noq = F.to_json(F.struct(idc, "user_role", "permissions", "expected_response"), _NO_NULL_DROP)
    line = (F.when(k % 43 == 0, F.lit("")).when(k % 41 == 0, F.regexp_replace(full, "}$", ""))
            .when(k % 37 == 0, noq).otherwise(full))
    diff = F.when(F.col("expected_response") == "rejected", "hard").when(
        F.col("expected_response") == "partial", "medium").otherwise("easy")
    return ex.select(line.alias("line"), diff.alias("difficulty"), *([k] if keep_id else []))


@register("jsonl_quarantine", f"""
SELECT CASE WHEN example_id % 41 = 0 THEN NULL ELSE CAST(example_id AS VARCHAR) END AS id,
       CASE WHEN example_id % 41 = 0 THEN 'malformed' WHEN example_id % 37 = 0 THEN 'missing_fields' ELSE 'ok' END AS status,
       CASE WHEN example_id % 41 <> 0 AND example_id % 37 = 0 THEN 'query' ELSE '' END AS missing,
       CASE WHEN example_id % 41 <> 0 AND example_id % 37 <> 0 THEN user_role END AS user_role,
       CASE WHEN example_id % 41 <> 0 AND example_id % 37 <> 0 THEN query END AS query,
       CASE WHEN example_id % 41 <> 0 AND example_id % 37 <> 0 THEN expected_response END AS expected_response
FROM ({_ex}) WHERE example_id % 43 <> 0
""")
def _jsonl_quarantine(spark, d):
    path = shared_dir(spark, "jsonl-quarantine")
    _jsonl_lines(spark, d).select("line").write.mode("overwrite").text(path)
    from ..operators.clean import EXAMPLE_SCHEMA
    t = R.conform_tagged(R.jsonl_tagged(spark, path), EXAMPLE_SCHEMA)  # one scan of the files
    return t.select(F.try_variant_get("record", "$.id", "string").alias("id"),
                    F.coalesce("reason", F.lit("ok")).alias("status"), "missing", "user_role", "query",
                    "expected_response")


_LINES = f"""(SELECT *, CAST(example_id % 16 AS INTEGER) AS part, row_number() OVER (PARTITION BY example_id % 16 ORDER BY example_id) AS line_no FROM ({_ex}))"""
@register("jsonl_line_numbers", f"""
SELECT part, line_no, CASE WHEN example_id % 41 = 0 THEN 'malformed' ELSE 'missing_fields' END AS reason
FROM {_LINES} WHERE example_id % 43 <> 0 AND (example_id % 41 = 0 OR example_id % 37 = 0)
""")
def _jsonl_line_numbers(spark, d):
    """File and line number of every quarantined line, in 16 files of ordered lines, some of them blank."""
    path = shared_dir(spark, "jsonl-lines")
    lines = _jsonl_lines(spark, d, keep_id=True).withColumn("part", F.col("example_id") % 16)
    (lines.repartition(16, "part").sortWithinPartitions("part", "example_id").select("part", "line")
     .write.partitionBy("part").text(path))
    t = R.jsonl_numbered(spark, path)
    part = F.regexp_extract("file_path", r"part=(\d+)", 1).cast("int")
    return t.filter(F.col("reason").isNotNull()).select(part.alias("part"), F.col("line_no"), "reason")


@register("jsonl_multi_file", f"""
SELECT CAST(example_id AS VARCHAR) AS id, user_role, query
FROM ({_ex}) WHERE expected_response = 'rejected' AND example_id % 43 <> 0 AND example_id % 41 <> 0
  AND example_id % 37 <> 0
""")
def _jsonl_multi_file(spark, d):
    # files named after their difficulty, below a folder whose name misleads
    base = shared_dir(spark, "jsonl-multi")
    path = f"{base}/hard-drive"
    _jsonl_lines(spark, d).write.mode("overwrite").partitionBy("difficulty").text(f"{base}/parts")
    to = spark._jvm.org.apache.hadoop.fs.Path
    fs = to(base).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(to(path))
    for level in R.DIFFICULTIES:
        for i, f in enumerate(fs.globStatus(to(f"{base}/parts/difficulty={level}/part-*")) or []):
            fs.rename(f.getPath(), to(f"{path}/{level}_{i}.txt"))
    from ..operators.clean import EXAMPLE_SCHEMA
    good, _ = R.jsonl_records(spark, path, glob="*.txt", name_filter="hard", schema=EXAMPLE_SCHEMA)
    return good.select("id", "user_role", "query")


@register("conform_and_merge", f"""
SELECT CAST(example_id AS VARCHAR) AS id, user_role, permissions, query, expected_response FROM ({_ex})
""")
def _conform_and_merge(spark, d):
    from ..operators.clean import EXAMPLE_SCHEMA, conform
    base = shared_dir(spark, "merge")
    ex = B.examples(spark, d)
    rec = F.to_json(F.struct(F.col("example_id").cast("string").alias("id"), "user_role", "permissions", "query",
                             "expected_response", F.col("example_id").alias("source_index"),
                             F.lit("subset").alias("generation_strategy"), F.lit(True).alias("synthetic")),
                    _NO_NULL_DROP)
    existing_rows = ex.filter(F.col("example_id") % 2 == 0).select(
        *conform(F.parse_json(rec), EXAMPLE_SCHEMA))
    existing_rows.write.mode("overwrite").parquet(f"{base}/v0")
    existing = spark.read.parquet(f"{base}/v0")
    new = ex.filter(F.col("example_id") % 2 == 1).select(F.parse_json(rec).alias("record"))
    K.merge_into(existing, new, "record", f"{base}/v1")
    return spark.read.parquet(f"{base}/v1").select("id", "user_role", "permissions", "query", "expected_response")


@register("merge_append_only", f"""
SELECT CAST(example_id AS VARCHAR) AS id, user_role, permissions, query, expected_response,
       CASE WHEN example_id % 3 = 0 THEN 1 WHEN example_id % 3 = 1 THEN 2 ELSE 3 END AS entry
FROM ({_ex}) WHERE example_id % 3 = 0 OR example_id % 37 <> 0
""")
def _merge_append_only(spark, d):
    """K3 by commits: a first table and two merges; rows without a query are rejected by C1.
    Each row is read back with the entry that brought it."""
    from ..operators.clean import EXAMPLE_SCHEMA, conform
    from ..sources import commits
    base = shared_dir(spark, "merge-append")
    ex = B.examples(spark, d)
    fields = [F.col("example_id").cast("string").alias("id"), "user_role", "permissions", "expected_response"]
    rec = F.parse_json(F.when((F.col("example_id") % 3 != 0) & (F.col("example_id") % 37 == 0), F.to_json(F.struct(*fields), _NO_NULL_DROP))
                       .otherwise(F.to_json(F.struct(*fields, "query"), _NO_NULL_DROP)))
    commits.append(ex.where("example_id % 3 = 0").select(*conform(rec, EXAMPLE_SCHEMA)), base)
    for part in (1, 2):
        K.merge_append(spark, base, ex.where(F.col("example_id") % 3 == part).select(rec.alias("record")), "record")
    names = [b for b, _ in commits.last(spark, base).batches]
    entry = F.create_map(*[F.lit(x) for i, b in enumerate(names, 1) for x in (b, i)])
    live = commits.read(spark, base)
    return live.select("id", "user_role", "permissions", "query", "expected_response",
                       F.try_element_at(entry, F.regexp_extract("_metadata.file_path", "batch-[0-9a-f]+", 0)).alias("entry"))


register("versioned_replace", f"""
SELECT id, {O.normalize('expected_response', 'repair')} AS expected_response, expected_response AS expected_response_raw
FROM ({O.labelled_orders_sql()})
""")(lambda spark, d: _versioned_replace(spark, d))


def _versioned_replace(spark, d):
    base = shared_dir(spark, "versions")
    lo = B.labelled_orders(spark, d).select("id", "expected_response")
    K.versioned_write(spark, lo, base)                      # original version (the backup)
    K.versioned_write(spark, L.repair_labels(K.read_current(spark, base), "expected_response", "repair"), base)
    return K.read_current(spark, base).select("id", "expected_response", "expected_response_raw")


_DIFF_SQL = "CASE WHEN right(run, 1) IN ('0', '2', '4', '6', '8') THEN 'easy' ELSE 'hard' END"
@register("results_flatten", f"""
SELECT run AS model_name, {_DIFF_SQL} AS difficulty, id AS "index", prediction, truth_raw AS ground_truth_raw,
       truth AS ground_truth, prediction = truth_raw AS correct, prediction = truth AS correct_norm
FROM ({O.scored_sql()})
""")
def _results_flatten(spark, d):
    path = shared_dir(spark, "results")
    s = scored(spark, d)
    docs_in = s.select(F.col("run"), F.when(F.substring("run", -1, 1).isin("0", "2", "4", "6", "8"), "easy")
                       .otherwise("hard").alias("difficulty"), F.col("id").alias("index"), "prediction",
                       F.col("truth_raw").alias("ground_truth"),
                       (F.col("prediction") == F.col("truth_raw")).alias("correct"),
                       F.col("run").endswith("7").alias("legacy"))
    K.write_results_documents(docs_in, path, "run", "difficulty", "index", legacy_col="legacy")
    flat, _ = R.read_results(spark, path, glob="*.txt", multi_line=False)
    return flat.select("model_name", "difficulty", "index", "prediction",
                       F.col("ground_truth_raw"), "ground_truth", "correct",
                       (F.col("prediction") == F.col("ground_truth")).alias("correct_norm"))


register("permission_database_examples", f"""
SELECT example_id AS "index", user_role, CAST(len(json_keys({O.lenient_object_sql('permissions')})) AS INTEGER) AS n_fields
FROM ({_ex}) WHERE len(json_keys({O.lenient_object_sql('permissions')})) >= 5
""")(lambda spark, d: _permission_db_examples(spark, d))


def _permission_db_examples(spark, d):
    path = shared_dir(spark, "permission-db")
    K.write_permission_database(permission_database(B.examples(spark, d)), path)
    ex = R.read_permission_examples(spark, path)
    ex = evaluate_once(spread(ex.select("index", "user_role", "permissions")), n_fields=F.size(lenient_object("permissions")))
    return ex.select("index", "user_role", "n_fields").filter(F.col("n_fields") >= 5)


# ---------------------------------------------------------------------------
# augmentation: A1-A9, C12, G5
# ---------------------------------------------------------------------------

from ..operators import augment as A  # noqa: E402
from ..operators import prompts as G  # noqa: E402


TRACKING_KEY = A.tracking_key("examples.parquet")


def _unused(spark, d, track: str | None = None, level: str = "hard"):
    """Examples, the ids of eligible sources (checkpointed once) and the unused ones.

    The tracking table starts with the sources an earlier run used (customers
    with a fulfilled order)."""
    ex = B.examples(spark, d)
    elig = materialize(A.eligible_sources(ex, "permissions", level).select("example_id"))
    track = track or shared_dir(spark, "tracking")
    A.record_attempts(B.used_sources(spark, d), track, TRACKING_KEY)
    return ex, elig, A.unused_sources(elig, A.read_used(spark, track, TRACKING_KEY), "example_id")


def _drawn(ex, draws):
    """Draws with their source's columns."""
    cols = ex.select(F.col("example_id").alias("source_id"), "user_role", "permissions", "query")
    return draws.join(cols, "source_id")


def augment_run(spark, d, seed: int = 42):
    """Draw sources (n = number of unused sources), sample permissions, build the
    generation prompt, get the offline reply and classify each attempt.  The
    attempt log is checkpointed: every report reads it instead of re-running it."""
    track = shared_dir(spark, "tracking")
    ex, elig, unused = _unused(spark, d, track)
    n_examples = unused.count()
    draws = A.draw_sources(spark, unused, elig, "example_id", n_examples, seed, n_unused=n_examples)
    s = A.sample_permissions(A.assign_strategy(_drawn(ex, draws), "draw_no", seed, "hard"), "permissions", "strategy",
                             "draw_no", seed, "hard")
    s = s.withColumn("prompt", G.generation_prompt("user_role", "modified_permissions"))
    s = s.withColumn("response", B.rule_reply(seed))
    attempts = A.generation_outcomes(s, "response", "draw_no").checkpoint()
    A.record_attempts(attempts, track, TRACKING_KEY)  # failed attempts count as used too
    return attempts, n_examples


def _u_sql(*parts) -> str:
    return "(('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 8))::BIGINT / 4294967296.0)"


_LEN = f"len(json_keys({O.lenient_object_sql('permissions')}))"
register("eligible_sources", f"""
SELECT example_id, CAST({_LEN} AS INTEGER) AS n_fields FROM ({_ex}) WHERE {_LEN} >= 5
""")(lambda spark, d: A.eligible_sources(B.examples(spark, d)).select("example_id", "n_fields"))

register("eligible_sources_medium", f"""
SELECT example_id, CAST({_LEN} AS INTEGER) AS n_fields FROM ({_ex}) WHERE {_LEN} BETWEEN 6 AND 7
""")(lambda spark, d: A.eligible_sources(B.examples(spark, d), level="medium").select("example_id", "n_fields"))

def _elig_sql(level: str = "hard") -> str:
    cond = f"{_LEN} >= 5" if level == "hard" else f"{_LEN} BETWEEN 6 AND 7"
    return f"SELECT example_id, user_role, permissions, query FROM ({_ex}) WHERE {cond}"


def _unused_sql(level: str = "hard") -> str:
    return (f"SELECT example_id FROM ({_elig_sql(level)}) WHERE example_id NOT IN "
            f"(SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")


_ELIG = _elig_sql("hard")
_UNUSED = _unused_sql("hard")
register("unused_sources", f"SELECT example_id FROM ({_UNUSED})")(
    lambda spark, d: _unused(spark, d)[2].select("example_id"))

def _draws_sql(level: str = "hard") -> str:
    return f"""
WITH un AS ({_unused_sql(level)}), el AS ({_elig_sql(level)}),
nu AS (SELECT count(*) AS n FROM un), ne AS (SELECT count(*) AS n FROM el),
uniq AS (SELECT example_id AS source_id, row_number() OVER (ORDER BY {_h_sql("'42'", "'draw'", 'CAST(example_id AS VARCHAR)')}, example_id) - 1 AS draw_no, false AS reused FROM un),
pool AS (SELECT example_id AS source_id, row_number() OVER (ORDER BY {_h_sql("'42'", "'pool'", 'CAST(example_id AS VARCHAR)')}, example_id) - 1 AS pool_pos FROM el),
rd AS (SELECT unnest(generate_series(nu.n, 2 * nu.n - 1)) AS draw_no FROM nu),
rp AS (SELECT draw_no, {_h_sql("'42'", "'reuse'", 'CAST(draw_no AS VARCHAR)')} % (SELECT n FROM ne) AS pool_pos FROM rd)
SELECT draw_no, source_id, reused FROM uniq
UNION ALL SELECT rp.draw_no, pool.source_id, true FROM rp JOIN pool USING (pool_pos)"""


_DRAWS = _draws_sql("hard")

register("draw_sources", f"SELECT CAST(draw_no AS BIGINT) AS draw_no, source_id, reused FROM ({_DRAWS})")(
    lambda spark, d: _draw(spark, d))


def _draw(spark, d):
    ex, elig, unused = _unused(spark, d)
    n = unused.count()
    return A.draw_sources(spark, unused, elig, "example_id", n, 42, n_unused=n)


_CORE = "('department', 'access_level', 'allowed_actions')"
def _aug_sql(level: str = "hard") -> str:
    if level == "hard":
        cut1, cut2, red, max_items = 0.35, 0.75, "reduced", 4
        kdrop = f"least(1 + floor({_u_sql(chr(39) + '42' + chr(39), chr(39) + 'ndrop' + chr(39), 'CAST(s.draw_no AS VARCHAR)')} * 2), c.dn, c.n - 5)"
        skip_cond, skip_tag = "c.n <= 5", "reduced_minimal"
    else:
        cut1, cut2, red, max_items = 0.50, 0.90, "minimal_reduce", 3
        kdrop = "1"
        skip_cond, skip_tag = "c.n < 7", "minimal_reduce_skip"
    return f"""
WITH dr AS ({_draws_sql(level)}),
src AS (SELECT dr.draw_no, dr.source_id, dr.reused, e.user_role, e.query, {O.lenient_object_sql('e.permissions')} AS j,
          CASE WHEN {_u_sql("'42'", "'strategy'", 'CAST(dr.draw_no AS VARCHAR)')} < {cut1}::DOUBLE THEN 'all_active'
               WHEN {_u_sql("'42'", "'strategy'", 'CAST(dr.draw_no AS VARCHAR)')} < {cut2}::DOUBLE THEN 'subset'
               ELSE '{red}' END AS strategy
        FROM dr JOIN ({_ex}) e ON e.example_id = dr.source_id),
fl AS (SELECT draw_no, field, json_extract(j, '$."' || field || '"') AS v,
              json_type(json_extract(j, '$."' || field || '"')) AS jt
       FROM (SELECT draw_no, j, unnest(json_keys(j)) AS field FROM src)),
cnt AS (SELECT draw_no, count(*) AS n, count(*) FILTER (WHERE field NOT IN {_CORE}) AS dn FROM fl GROUP BY draw_no),
tag AS (SELECT s.*, c.n, c.dn,
          {kdrop} AS k_drop,
          CASE WHEN s.strategy <> '{red}' THEN s.strategy WHEN {skip_cond} THEN '{skip_tag}'
               WHEN c.dn = 0 THEN '{red}_no_drop' ELSE '{red}' END AS strategy_used
        FROM src s JOIN cnt c USING (draw_no)),
rk AS (SELECT fl.*, t.strategy_used, t.k_drop,
          CASE WHEN field NOT IN {_CORE} THEN row_number() OVER (PARTITION BY fl.draw_no, field NOT IN {_CORE}
               ORDER BY {_h_sql("'42'", "'drop'", 'CAST(fl.draw_no AS VARCHAR)', 'field')}) END AS drop_rank
       FROM fl JOIN tag t USING (draw_no)),
kept AS (SELECT * FROM rk WHERE NOT (strategy_used = '{red}' AND drop_rank IS NOT NULL AND drop_rank <= k_drop)),
per AS (SELECT draw_no,
          count(*) AS n_after,
          string_agg(field, ',' ORDER BY field) AS fields_after,
          sum(CASE WHEN jt = 'ARRAY' THEN
                CASE WHEN strategy_used = 'subset' AND json_array_length(v) > 2
                     THEN 2 + floor({_u_sql("'42'", "'k'", 'CAST(draw_no AS VARCHAR)', 'field')} * (least({max_items}, json_array_length(v)) - 1))
                     ELSE json_array_length(v) END ELSE 0 END) AS list_items_after,
          count(*) FILTER (WHERE jt = 'BOOLEAN' AND CASE WHEN strategy_used = 'subset'
                THEN {_u_sql("'42'", "'bool'", 'CAST(draw_no AS VARCHAR)', 'field')} < 0.75::DOUBLE
                ELSE json_extract_string(v, '$') = 'true' END) AS true_bools_after
        FROM kept GROUP BY draw_no)
SELECT t.draw_no, t.source_id, t.reused, t.user_role, t.query, t.strategy, t.strategy_used, t.n AS n_fields_before,
       p.n_after AS n_fields_after, p.fields_after, p.list_items_after, p.true_bools_after
FROM tag t JOIN per p USING (draw_no)"""


_AUG = _aug_sql("hard")

def _aug_out_sql(level: str) -> str:
    return f"""
SELECT CAST(draw_no AS BIGINT) AS draw_no, source_id, strategy, strategy_used, CAST(n_fields_before AS INTEGER) AS n_fields_before,
       CAST(n_fields_after AS INTEGER) AS n_fields_after, fields_after, CAST(list_items_after AS BIGINT) AS list_items_after,
       CAST(true_bools_after AS BIGINT) AS true_bools_after FROM ({_aug_sql(level)})
"""


register("augment_permissions", _aug_out_sql("hard"))(lambda spark, d: _augment_permissions(spark, d, "hard"))
register("augment_permissions_medium", _aug_out_sql("medium"))(
    lambda spark, d: _augment_permissions(spark, d, "medium"))


def _augment_permissions(spark, d, level: str = "hard"):
    ex, elig, unused = _unused(spark, d, level=level)
    n = unused.count()
    draws = A.draw_sources(spark, unused, elig, "example_id", n, 42, n_unused=n)
    s = A.sample_permissions(A.assign_strategy(_drawn(ex, draws), "draw_no", 42, level), "permissions", "strategy", "draw_no", 42,
                             level)
    before = lenient_object("permissions")
    after = lenient_object("modified_permissions")
    vals = F.map_values(after)
    items = F.aggregate(vals, F.lit(0).cast("bigint"), lambda acc, v: acc + F.coalesce(
        F.size(v.try_cast("array<variant>")).cast("bigint"), F.lit(0).cast("bigint")))
    trues = F.aggregate(vals, F.lit(0).cast("bigint"), lambda acc, v: acc + F.when(
        (F.schema_of_variant(v) == "BOOLEAN") & F.coalesce(F.try_variant_get(v, "$", "boolean"), F.lit(False)), 1)
        .otherwise(0).cast("bigint"))
    return s.select("draw_no", "source_id", "strategy", "strategy_used", F.size(before).alias("n_fields_before"),
                    F.size(after).alias("n_fields_after"), F.array_join(F.array_sort(F.map_keys(after)), ",")
                    .alias("fields_after"), items.alias("list_items_after"), trues.alias("true_bools_after"))


_OUT = f"""
WITH a AS ({_AUG}),
r AS (SELECT a.*, CASE WHEN {_u_sql("'42'", "'api'", 'CAST(draw_no AS VARCHAR)')} < 0.05::DOUBLE THEN 'failed_api'
                       WHEN {_u_sql("'42'", "'label'", 'CAST(draw_no AS VARCHAR)')} < 0.1::DOUBLE THEN 'failed_validation'
                  END AS fail,
          md5(lower(trim(query || ' [' || strategy_used || ']', {_ws}))) AS query_hash FROM a),
w AS (SELECT query_hash, min(draw_no) AS first_draw FROM r WHERE fail IS NULL GROUP BY query_hash)
SELECT r.*, coalesce(fail, CASE WHEN r.draw_no = w.first_draw THEN 'success' ELSE 'duplicate' END) AS outcome
FROM r LEFT JOIN w USING (query_hash)"""

register("attempt_outcomes", f"""
SELECT CAST(draw_no AS BIGINT) AS draw_no, source_id, reused, strategy_used, outcome FROM ({_OUT})
""")(lambda spark, d: augment_run(spark, d)[0].select("draw_no", "source_id", "reused", "strategy_used", "outcome"))

register("attempt_summary", f"""
WITH o AS ({_OUT}), t AS (SELECT count(*) AS attempts FROM o),
m AS (SELECT 'attempts' AS metric, count(*) AS value FROM o
      UNION ALL SELECT 'success', count(*) FILTER (WHERE outcome = 'success') FROM o
      UNION ALL SELECT 'failed_api', count(*) FILTER (WHERE outcome = 'failed_api') FROM o
      UNION ALL SELECT 'failed_validation', count(*) FILTER (WHERE outcome = 'failed_validation') FROM o
      UNION ALL SELECT 'duplicate', count(*) FILTER (WHERE outcome = 'duplicate') FROM o
      UNION ALL SELECT 'reused', count(*) FILTER (WHERE reused) FROM o
      UNION ALL SELECT 'strategy:' || strategy_used, count(*) FROM o GROUP BY strategy_used)
SELECT metric, CAST(value AS BIGINT) AS value, {O.pct_sql('value', 'attempts')} AS pct FROM m, t
""")(lambda spark, d: A.attempt_summary(augment_run(spark, d)[0]))

register("first_n_successes", f"""
WITH o AS ({_OUT}), n AS (SELECT count(*) // 2 AS k FROM o)
SELECT CAST(draw_no AS BIGINT) AS draw_no, source_id FROM (
  SELECT draw_no, source_id, row_number() OVER (ORDER BY draw_no) AS rn FROM o WHERE outcome = 'success'), n
WHERE rn <= n.k
""")(lambda spark, d: _first_n(spark, d))


def _first_n(spark, d):
    att, n_examples = augment_run(spark, d)
    return A.first_n_successes(att, n_examples).select("draw_no", "source_id")


from ..operators import generate as N  # noqa: E402

_SHARE = "(('0x' || substr(md5(user_role || ':' || fields_after), 1, 8))::BIGINT / 4294967296.0)"
_F1, _F2, _F3, _F4 = (f"{x}::DOUBLE" for x in B.GENERATOR_SHARES)
_RUN = f"""
WITH un AS (SELECT count(*) AS n FROM ({_UNUSED})),
a AS (SELECT draw_no, source_id, reused, strategy_used, {_SHARE} AS share, md5(lower('As ' || user_role || ' I need ' || fields_after)) AS h,
             (SELECT n * 3 // 4 FROM un) AS target FROM ({_AUG}) WHERE draw_no < 2 * (SELECT n * 3 // 4 FROM un)),
w AS (SELECT h, min(draw_no) AS first_draw FROM a WHERE share >= {_F1} AND (share < {_F2} OR share >= {_F4}) GROUP BY h),
o AS (SELECT a.*, CASE WHEN share < {_F1} OR (share >= {_F2} AND share < {_F3}) THEN 'failed_api'
                       WHEN share >= {_F3} AND share < {_F4} THEN 'failed_validation'
                       WHEN draw_no = first_draw THEN 'success' ELSE 'duplicate' END AS outcome,
             CASE WHEN share < {_F1} OR (share >= {_F2} AND share < {_F3}) THEN 5 WHEN share < {_F2} THEN 2 ELSE 1 END AS calls
      FROM a LEFT JOIN w USING (h)),
r AS (SELECT *, sum(CASE WHEN outcome = 'success' THEN 1 ELSE 0 END) OVER (ORDER BY draw_no) - CASE WHEN outcome = 'success' THEN 1 ELSE 0 END AS before FROM o)
SELECT * FROM r WHERE before < target"""


def _generation_run(spark, d):
    """A2 + A7 + A8: three quarters of the unused sources as target, prompts answered through I1."""
    track, base = shared_dir(spark, "tracking"), shared_dir(spark, "generation")
    ex, elig, unused = _unused(spark, d, track)
    target = unused.count() * 3 // 4
    draws = A.draw_sources(spark, unused, elig, "example_id", target, 42)
    s = A.sample_permissions(A.assign_strategy(_drawn(ex, draws), "draw_no", 42, "hard"), "permissions", "strategy", "draw_no", 42, "hard")
    prompt = F.struct(F.lit("user").alias("role"), G.generation_prompt("user_role", "modified_permissions").alias("content"))
    s = s.select("draw_no", "source_id", "reused", "strategy_used", F.array(prompt).alias("messages"))
    path = shared_dir(spark, "draws")
    s.write.parquet(path)
    N.generation_run(spark.read.parquet(path), B.RuleGenerator(), base, target, track, TRACKING_KEY, retry_delay=0, partitions=8)
    return N.attempts(spark, base), A.read_used(spark, track, TRACKING_KEY)


register("generation_run", f"SELECT CAST(draw_no AS BIGINT) AS draw_no, source_id, reused, strategy_used, outcome, CAST(calls AS INTEGER) AS calls FROM ({_RUN})")(
    lambda spark, d: _generation_run(spark, d)[0].select("draw_no", "source_id", "reused", "strategy_used", "outcome", "calls"))

register("generation_run_tracking", f"""
SELECT DISTINCT o_custkey AS source_id FROM orders WHERE o_orderstatus = 'F'
UNION SELECT CAST(source_id AS BIGINT) FROM ({_RUN})
""")(lambda spark, d: _generation_run(spark, d)[1])


register("provenance", f"""
SELECT CAST(draw_no AS BIGINT) AS draw_no, CAST(source_id AS INTEGER) AS source_index, strategy_used AS generation_strategy,
       true AS synthetic FROM ({_OUT}) WHERE outcome = 'success'
""")(lambda spark, d: C.tag_provenance(augment_run(spark, d)[0].filter(F.col("outcome") == "success"),
                                       "source_id", "strategy_used")
     .select("draw_no", "source_index", "generation_strategy", "synthetic"))

register("balanced_union", f"""
WITH u AS (SELECT expected_response FROM ({_ex})
           UNION ALL SELECT 'full' FROM ({_OUT}) WHERE outcome = 'success'),
lab AS (SELECT {O.normalize(O.normalize('expected_response', 'repair'), 'distribution')} AS label FROM u),
per AS (SELECT label, count(*) AS n FROM lab GROUP BY label),
tot AS (SELECT sum(n) AS n_total, sum(CASE WHEN label IS NOT NULL THEN n ELSE 0 END) AS n_labelled FROM per)
SELECT label, n, round({_pct}, 6) AS pct, repeat('█', CAST(floor({_pct} / 2.0) AS INTEGER)) AS bar,
       CAST(n_labelled AS BIGINT) AS n_labelled, CAST(n_total AS BIGINT) AS n_total FROM per, tot WHERE label IS NOT NULL
""")(lambda spark, d: _balanced(spark, d))


def _balanced(spark, d):
    att, _ = augment_run(spark, d)
    syn = att.filter(F.col("outcome") == "success").select(
        F.variant_get("generated", "$.expected_response", "string").alias("expected_response"))
    orig = B.examples(spark, d).select("expected_response")
    _, _, after = A.balanced_union(orig, syn, "expected_response", "repair")
    return after


@register("generation_prompts", f"""
SELECT CAST(draw_no AS BIGINT) AS draw_no, source_id, strategy_used, user_role, fields_after AS fields,
       CAST(n_fields_after AS INTEGER) AS n_fields FROM ({_aug_sql('hard')})
""")
def _generation_prompts(spark, d):
    """G5 over every draw: the role and the permission fields read back from the JSON part of the prompt."""
    att = augment_run(spark, d)[0].withColumn("payload", G.prompt_payload("prompt"))
    fields = F.map_keys(F.try_variant_get("payload", "$.permissions", "map<string,variant>"))
    return att.select("draw_no", "source_id", "strategy_used", F.try_variant_get("payload", "$.user_role", "string").alias("user_role"),
                      F.array_join(F.array_sort(fields), ",").alias("fields"), F.size(fields).alias("n_fields"))


# ---------------------------------------------------------------------------
# prompts and inference: G1-G4 G6 I1-I4 M12
# ---------------------------------------------------------------------------

from ..operators import infer as I  # noqa: E402
from ..functions.labels import extract_label  # noqa: E402

_NL = "chr(10)"
_USER_SQL = f"'Role permissions:' || {_NL} || coalesce(permissions, 'None') || {_NL} || {_NL} || 'Request:' || {_NL} || coalesce(query, 'None')"
_ASSIST_SQL = f"'Response type: ' || coalesce(expected_response, 'None') || {_NL} || {_NL} || 'Rationale: ' || coalesce(rationale, 'None')"
_EX_R = f"SELECT *, CASE WHEN example_id % 5 = 0 THEN NULL ELSE 'Balance band ' || expected_response END AS rationale FROM ({_ex})"


def _examples_r(spark, d):
    ex = B.examples(spark, d)
    return ex.withColumn("rationale", F.when(F.col("example_id") % 5 == 0, F.lit(None).cast("string"))
                         .otherwise(F.concat(F.lit("Balance band "), F.col("expected_response"))))


register("eval_prompts", f"""
SELECT example_id, 2 AS n_messages, 'system,user' AS roles, {_USER_SQL} AS user_content FROM ({_ex})
""")(lambda spark, d: B.examples(spark, d).select("example_id", G.eval_messages().alias("m")).select(
    "example_id", F.size("m").alias("n_messages"), F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"),
    F.col("m")[1]["content"].alias("user_content")))

register("train_messages", f"""
SELECT example_id, 3 AS n_messages, {_ASSIST_SQL} AS assistant_content FROM ({_EX_R})
""")(lambda spark, d: _examples_r(spark, d).select("example_id", G.train_messages().alias("m")).select(
    "example_id", F.size("m").alias("n_messages"), F.col("m")[2]["content"].alias("assistant_content")))

_SYS = G.SYSTEM_PROMPT.replace("'", "''")
register("prompt_formats", f"""
SELECT example_id, f.format, f.n_messages, f.first_role, length(f.last_content) AS last_content_chars FROM ({_ex}),
LATERAL (VALUES ('with_system', 2, 'system', {_USER_SQL}),
                ('without_system', 1, 'user', {_USER_SQL}),
                ('instructions_in_user', 1, 'user', 'Instructions: ' || '{_SYS}' || {_NL} || {_NL} || {_USER_SQL})
        ) f(format, n_messages, first_role, last_content)
""")(lambda spark, d: G.prompt_formats(B.examples(spark, d)).select(
    "example_id", "format", F.size("messages").alias("n_messages"), F.col("messages")[0]["role"].alias("first_role"),
    F.length(F.element_at("messages", -1)["content"]).cast("bigint").alias("last_content_chars")))


@register("chat_export", f"""
SELECT 3 AS n_messages, {_ASSIST_SQL} AS assistant_content FROM ({_EX_R})
""")
def _chat_export(spark, d):
    path = shared_dir(spark, "chat")
    G.chat_export(_examples_r(spark, d).select(G.train_messages().alias("messages")), path)
    back = spark.read.schema("messages array<struct<role string, content string>>").json(path)
    return back.select(F.size("messages").alias("n_messages"), F.col("messages")[2]["content"].alias("assistant_content"))


_RENDER_SQL = (f"'<system>: {_SYS}' || {_NL} || '<user>: ' || {_USER_SQL} || {_NL} || '<assistant>: ' || {_ASSIST_SQL}")
register("sequence_lengths", f"""
WITH t AS (SELECT expected_response, len(regexp_extract_all({_RENDER_SQL}, '[^ \\t\\n\\r]+')) AS n FROM ({_EX_R}))
SELECT expected_response, count(*) AS n_rows, round(avg(n), 6) AS mean_tokens, CAST(min(n) AS BIGINT) AS min_tokens,
       CAST(max(n) AS BIGINT) AS max_tokens, count(*) FILTER (WHERE n > 2048) AS n_over_cap,
       round(avg(least(n, 2048)), 6) AS mean_truncated FROM t GROUP BY expected_response
""")(lambda spark, d: G.sequence_lengths(
    _examples_r(spark, d).select("expected_response", G.render_chat(G.train_messages()).alias("text")), "text",
    by=["expected_response"]))

register("sequence_lengths_conversations", """
WITH t AS (SELECT conv_id, len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS n FROM conversations),
c AS (SELECT conv_id, sum(n) AS n FROM t GROUP BY conv_id)
SELECT count(*) AS n_rows, round(avg(n), 6) AS mean_tokens, CAST(min(n) AS BIGINT) AS min_tokens,
       CAST(max(n) AS BIGINT) AS max_tokens, count(*) FILTER (WHERE n > 2048) AS n_over_cap,
       round(avg(least(n, 2048)), 6) AS mean_truncated FROM c
""")(lambda spark, d: G.sequence_lengths(
    B.read(spark, d, "conversations").groupBy("conv_id").agg(F.sum(G.word_tokens("text")).alias("tok")),
    "tok", tokens_col="tok"))

_DOC_PERMS = "'{\"department\": [\"' || lang || '\"], \"access_level\": \"standard\"}'"
_EVAL_SQL = (f"SELECT d.doc_id AS id, d.source AS run, {_DOC_PERMS} AS permissions, d.text AS query, t.truth_raw, "
             f"{O.normalize('t.truth_raw', 'results')} AS truth FROM documents d JOIN ({O.truth_sql()}) t ON t.id = d.doc_id")
_INFER_SQL = f"""
WITH e AS ({_EVAL_SQL}), l AS (SELECT e.*, length({_USER_SQL}) AS n FROM e)
SELECT id, run, truth_raw, truth,
  n % 97 <> 0 AS success,
  CASE WHEN n % 97 = 0 THEN 'RuntimeError: model unavailable' END AS error,
  CAST(CASE WHEN n % 97 = 0 THEN 5 WHEN n % 13 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempts,
  CASE WHEN n % 97 = 0 THEN 'rejected' WHEN n % 3 = 0 THEN 'full' WHEN n % 3 = 1 THEN 'partial' ELSE 'rejected' END AS prediction
FROM l"""


def inference_run(spark, d, more=()):
    rows = B.eval_rows(spark, d)
    rows = rows.withColumn("truth", normalize_label("truth_raw", "results"))
    return I.batch_inference(rows.select("id", "run", "truth_raw", "truth", *more, G.eval_messages().alias("messages")),
                             B.RulePredictor(), "id", "messages", retry_delay=0.0,
                             passthrough=("run", "truth_raw", "truth", *more))


register("batch_inference", f"SELECT id, prediction, success, error, attempts FROM ({_INFER_SQL})")(
    lambda spark, d: inference_run(spark, d).select("id", "prediction", "success", "error", "attempts"))

register("inference_errors", f"""
SELECT id AS "index", error, attempts, 'unknown' AS user_role FROM ({_INFER_SQL}) WHERE NOT success
""")(lambda spark, d: I.inference_errors(inference_run(spark, d), "id", top=None))

register("detailed_predictions", f"""
SELECT id AS "index", prediction, truth_raw AS ground_truth, prediction = truth_raw AS correct_raw,
       prediction = truth AS correct_norm FROM ({_INFER_SQL})
""")(lambda spark, d: I.detailed_predictions(inference_run(spark, d)))

register("inference_metrics", f"""
SELECT * FROM ({_summary_sql().replace(O.scored_sql(), _INFER_SQL)})
""")(lambda spark, d: M.summary_metrics(inference_run(spark, d)))

_WORDS = ["Rejected: partial access only", "partially", "Fully granted", "no idea"]
register("extract_label", f"""
SELECT doc_id, CASE WHEN strpos(lower(r), 'rejected') > 0 THEN 'rejected' WHEN strpos(lower(r), 'partial') > 0 THEN 'partial'
                    WHEN strpos(lower(r), 'full') > 0 THEN 'full' ELSE 'rejected' END AS label
FROM (SELECT doc_id, CASE doc_id % 4 {' '.join(f"WHEN {i} THEN {O.q(w)}" for i, w in enumerate(_WORDS))} END
      || ' ' || text AS r FROM documents)
""")(lambda spark, d: B.read(spark, d, "documents").select(
    "doc_id", extract_label(F.concat(B._case(F.col("doc_id") % 4, _WORDS, F.lit(None)), F.lit(" "), F.col("text")))
    .alias("label")))


def format_comparison_rows(spark, d):
    rows = B.eval_rows(spark, d).withColumn("truth", normalize_label("truth_raw", "results"))
    f = G.prompt_formats(rows.select("id", "permissions", "query", "truth"))
    res = I.batch_inference(f.select("id", "format", "truth", "messages"), B.RulePredictor(), "id", "messages",
                            retry_delay=0.0, passthrough=("format", "truth"))
    return res.withColumn("correct", F.col("prediction") == F.col("truth"))


register("prompt_format_comparison", f"""
WITH e AS ({_EVAL_SQL}),
f AS (SELECT e.truth, v.format, v.n FROM e, LATERAL (VALUES
        ('with_system', length({_USER_SQL})), ('without_system', length({_USER_SQL})),
        ('instructions_in_user', length('Instructions: ' || '{_SYS}' || {_NL} || {_NL} || {_USER_SQL}))) v(format, n)),
p AS (SELECT format, (CASE WHEN n % 97 = 0 THEN 'rejected' WHEN n % 3 = 0 THEN 'full' WHEN n % 3 = 1 THEN 'partial'
                          ELSE 'rejected' END) = truth AS correct FROM f),
a AS (SELECT avg(CASE WHEN format = 'with_system' AND correct THEN 1.0 WHEN format = 'with_system' THEN 0.0 END) AS ws,
             avg(CASE WHEN format = 'without_system' AND correct THEN 1.0 WHEN format = 'without_system' THEN 0.0 END) AS wo,
             avg(CASE WHEN format = 'instructions_in_user' AND correct THEN 1.0 WHEN format = 'instructions_in_user' THEN 0.0 END) AS iu FROM p)
SELECT round(iu, 6) AS acc_instructions_in_user, round(ws, 6) AS acc_with_system, round(wo, 6) AS acc_without_system,
       round(ws - wo, 6) AS drop_without_system,
       CASE WHEN abs(ws - wo) < 0.05 THEN 'LOW' WHEN abs(ws - wo) < 0.15 THEN 'MODERATE' ELSE 'HIGH' END AS dependency FROM a
""")(lambda spark, d: M.prompt_format_comparison(format_comparison_rows(spark, d), "format", "correct"))


# ---------------------------------------------------------------------------
# streaming: R1 R2 (availableNow over files written from the tables)
# ---------------------------------------------------------------------------

from ..streaming import running as S  # noqa: E402


@register("stream_running_metrics", f"SELECT run, n_total, accuracy, f1_macro, f1_weighted, precision_macro, recall_macro FROM ({_summary_sql('run')})")
def _stream_running_metrics(spark, d):
    base = shared_dir(spark, "stream-metrics")
    sc = scored(spark, d).select("id", "run", "truth", "prediction")
    sc.write.mode("overwrite").parquet(f"{base}/in")
    stream = spark.readStream.schema(sc.schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/in")
    q = S.start_running_metrics(stream, f"{base}/ckpt", f"{base}/snapshot", by=["run"])
    q.awaitTermination()
    return S.read_snapshot(spark, f"{base}/snapshot").select(
        "run", "n_total", "accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro")


@register("stream_run_metrics", f"SELECT run, n_total, accuracy, f1_macro, f1_weighted, precision_macro, recall_macro FROM ({_summary_sql('run')})")
def _stream_run_metrics(spark, d):
    base = shared_dir(spark, "stream-runs")
    sc = scored(spark, d).select("id", "run", "truth", "prediction")
    sc.repartition(6, "id").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(sc.schema).option("maxFilesPerTrigger", 3).parquet(f"{base}/in")
    S.start_run_metrics(stream, f"{base}/ckpt", f"{base}/runs").awaitTermination()
    return S.run_metrics(spark, f"{base}/runs").select(
        "run", "n_total", "accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro")


@register("stream_dedup_bounded", f"""
SELECT DISTINCT md5(lower(trim(text, {_ws}))) AS query_hash FROM documents
""")
def _stream_dedup_bounded(spark, d):
    from ..sources import commits
    base = shared_dir(spark, "stream-dedup-bounded")
    docs = B.read(spark, d, "documents").select("doc_id", "text")
    docs.repartition(6, "doc_id").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    S.start_bounded_dedup(stream, "text", f"{base}/ckpt", f"{base}/out", recent="1 second").awaitTermination()
    return commits.read(spark, f"{base}/out").select("query_hash")


@register("stream_dedup", f"""
SELECT DISTINCT md5(lower(trim(text, {_ws}))) AS query_hash FROM documents
""")
def _stream_dedup(spark, d):
    base = shared_dir(spark, "stream-dedup")
    docs = B.read(spark, d, "documents").select("doc_id", "text")
    docs.write.mode("overwrite").parquet(f"{base}/in")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/in")
    q = S.start_dedup(stream, "text", f"{base}/ckpt", f"{base}/out")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("query_hash")


# ---------------------------------------------------------------------------
# split files: K1 write, S1 named-split load, K6 manifest
# ---------------------------------------------------------------------------

@register("split_roundtrip", f"SELECT doc_id, lang, split FROM ({_SPLIT_SQL})")
def _split_roundtrip(spark, d):
    base = shared_dir(spark, "splits")
    K.write_splits(_split_docs(spark, d), f"{base}/data", "split")
    paths = {s: f"{base}/data/split={s}" for s in ("train", "validation", "test", "extra")}
    frame, missing = R.load_splits(spark, paths, schema=None)
    assert missing == ["extra"], missing  # an absent split is skipped and reported
    K.write_manifest(L.split_label_stats(frame, "split", "lang"), f"{base}/manifest")
    return frame.select("doc_id", "lang", "split")


register("invalid_policy_default_rejected", f"""
SELECT CASE WHEN r IN ('full', 'partial', 'rejected') THEN r ELSE 'rejected' END AS label, count(*) AS n
FROM (SELECT {O.normalize('expected_response', 'results')} AS r FROM ({O.labelled_orders_sql()})) GROUP BY 1
""")(lambda spark, d: L.apply_invalid_policy(
    B.labelled_orders(spark, d).select(normalize_label("expected_response", "results").alias("label")),
    "label", "default_rejected").groupBy("label").agg(F.count(F.lit(1)).alias("n")))


register("label_distribution_lineitem", f"""
WITH lab AS (SELECT {O.normalize('l_returnflag', 'distribution')} AS label FROM lineitem),
per AS (SELECT label, count(*) AS n FROM lab GROUP BY label),
tot AS (SELECT sum(n) AS n_total, sum(CASE WHEN label IS NOT NULL THEN n ELSE 0 END) AS n_labelled FROM per)
SELECT label, n, round({_pct}, 6) AS pct, repeat('█', CAST(floor({_pct} / 2.0) AS INTEGER)) AS bar,
       CAST(n_labelled AS BIGINT) AS n_labelled, CAST(n_total AS BIGINT) AS n_total FROM per, tot WHERE label IS NOT NULL
""")(lambda spark, d: L.label_distribution(B.read(spark, d, "lineitem"), "l_returnflag", "distribution"))


register("balanced_union_before", f"""
WITH lab AS (SELECT {O.normalize('expected_response', 'distribution')} AS label FROM ({_ex})),
per AS (SELECT label, count(*) AS n FROM lab GROUP BY label),
tot AS (SELECT sum(n) AS n_total, sum(CASE WHEN label IS NOT NULL THEN n ELSE 0 END) AS n_labelled FROM per)
SELECT label, n, round({_pct}, 6) AS pct, repeat('█', CAST(floor({_pct} / 2.0) AS INTEGER)) AS bar,
       CAST(n_labelled AS BIGINT) AS n_labelled, CAST(n_total AS BIGINT) AS n_total FROM per, tot WHERE label IS NOT NULL
""")(lambda spark, d: L.label_distribution(B.examples(spark, d).select("expected_response"), "expected_response"))


# ---------------------------------------------------------------------------
# traps of the text rules: S2 C4 C11 P2 K4 (expected values by rule from the row id)
# ---------------------------------------------------------------------------

def _by_id(spark, d, texts):
    """``id, t``: customers with a text chosen by ``id % len(texts)``; ``@`` stands for the id."""
    k = F.col("c_custkey")
    t = F.lit(None).cast("string")
    for i, text in enumerate(texts):
        t = F.when(k % len(texts) == i, F.replace(F.lit(text), F.lit("@"), k.cast("string"))).otherwise(t)
    return B.read(spark, d, "customer").select(k.alias("id"), t.alias("t"))


_JSON_TRAPS = ['{"a": @}', '{"a": @} oops', '{"a": @}{"b": 2}', '[@] x', '{"a": 1, "a": @}', '{"a": "x\t@"}', '{"a": "x\r\n  @"}',
               "{'a': @}", '{"a": NaN}', '@', '{"a": @}, "b": 2', '@, "x"]']


@register("json_text_traps", """
SELECT CAST(c_custkey AS BIGINT) AS id,
       CASE c_custkey % 12 WHEN 0 THEN 'object' WHEN 4 THEN 'object' WHEN 7 THEN 'object_requoted' WHEN 9 THEN 'not_object' ELSE 'invalid' END AS status,
       CASE WHEN c_custkey % 12 IN (0, 4, 7) THEN CAST(c_custkey AS VARCHAR) END AS lenient,
       CASE WHEN c_custkey % 12 IN (0, 4) THEN CAST(c_custkey AS VARCHAR) WHEN c_custkey % 12 = 5 THEN 'x' || chr(9) || c_custkey
            WHEN c_custkey % 12 = 6 THEN 'x' || chr(13) || chr(10) || '  ' || c_custkey END AS model
FROM customer
""")
def _json_text_traps(spark, d):
    from ..functions.json import extract_json, lenient_variant, parse_status
    a = lambda v: F.try_variant_get(v, "$.a", "string")
    return _by_id(spark, d, _JSON_TRAPS).select("id", parse_status("t").alias("status"), a(lenient_variant("t")).alias("lenient"),
                                                a(extract_json("t")).alias("model"))


@register("jsonl_trailing_text", """
SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey % 12 IN (0, 4, 8) THEN 'ok' ELSE 'malformed' END AS status FROM customer
""")
def _jsonl_trailing_text(spark, d):
    path = shared_dir(spark, "jsonl-trailing")
    texts = ['{"id": @}', '{"id": @} oops #@', '{"id": @}{"id": 2} #@', '[@] x #@', '{"id": 1, "id": @}', "{'id': @} #@", '@ #@', '#@',
             ' {"id": @, "x": {"y": [1, {}]}} ', '{"id": @ #@', '{"id": @}, "b": 2 #@', '{"id": @}, "x"] #@']
    _by_id(spark, d, texts).select("t").write.mode("overwrite").text(path)
    t = R.jsonl_tagged(spark, path, required=["id"])
    key = F.coalesce(F.try_variant_get("record", "$.id", "bigint"), F.regexp_extract("line", "#([0-9]+)$", 1).try_cast("bigint"),
                     F.regexp_extract("line", '"id": ([0-9]+)', 1).try_cast("bigint"))
    return t.select(key.alias("id"), F.coalesce("reason", F.lit("ok")).alias("status"))


_VALUE_TRAPS = ['{"v": 30}', '{"v": 30.0}', '{"v": [1, 1.0, 2.50, 2.5]}', '{"v": "x\\u0001y"}', '{"v": "30 days, read"}']
_VALUE_N = "n AS (SELECT " + ", ".join(f"count(*) FILTER (c_custkey % 5 = {i}) AS n{i}" for i in range(5)) + " FROM customer)"


@register("field_value_text_rules", f"""
WITH {_VALUE_N},
c AS (SELECT 'v' AS field, '30' AS value, 'number' AS value_kind, n0 + n1 AS n FROM n UNION ALL SELECT 'v', '1', 'text', n2 FROM n
      UNION ALL SELECT 'v', '1.0', 'text', n2 FROM n UNION ALL SELECT 'v', '2.5', 'text', 2 * n2 FROM n
      UNION ALL SELECT 'v_count', '4', 'number', n2 FROM n UNION ALL SELECT 'v', 'x' || chr(1) || 'y', 'text', n3 FROM n
      UNION ALL SELECT 'v', '30 days, read', 'text', n4 FROM n),
t AS (SELECT field, count(*) AS n_values, sum(n)::BIGINT AS total_occurrences FROM c GROUP BY field)
SELECT field, row_number() OVER (PARTITION BY field ORDER BY n DESC, value, value_kind) AS rank, value, value_kind, n::BIGINT AS n,
       round(100.0 * n / total_occurrences, 6) AS pct, n_values, total_occurrences
FROM c JOIN t USING (field)
""")
def _field_value_text_rules(spark, d):
    return P.field_value_top_n(_by_id(spark, d, _VALUE_TRAPS), "id", "t")


@register("permission_database_text_rules", f"""
WITH {_VALUE_N},
c AS (SELECT '30' AS value, n0 AS n FROM n UNION ALL SELECT '30.0', n1 FROM n UNION ALL SELECT '1', n2 FROM n UNION ALL SELECT '1.0', n2 FROM n
      UNION ALL SELECT '2.5', 2 * n2 FROM n UNION ALL SELECT 'x' || chr(1) || 'y', n3 FROM n UNION ALL SELECT '30 days, read', n4 FROM n)
SELECT 'v' AS field, value, n::BIGINT AS count, round(100.0 * n / (SELECT sum(n) FROM c), 6) AS percentage FROM c
""")
def _permission_database_text_rules(spark, d):
    df = _by_id(spark, d, _VALUE_TRAPS).select(F.col("id").alias("example_id"), F.lit("r").alias("user_role"), F.col("t").alias("permissions"))
    return P.permission_database(df)["values"]


@register("token_text_rules", f"""
WITH {_VALUE_N}, c AS (SELECT '30 days' AS token, n4 AS n FROM n UNION ALL SELECT 'read', n4 FROM n)
SELECT row_number() OVER (ORDER BY n DESC, token) AS rank, token, n::BIGINT AS n,
       round(100.0 * n / (SELECT count(*) FROM customer), 6) AS pct, 2::BIGINT AS n_tokens, (SELECT sum(n) FROM c)::BIGINT AS total_occurrences,
       round((SELECT sum(n) FROM c)::DOUBLE / (SELECT count(*) FROM customer), 6) AS mean_per_row
FROM c
""")
def _token_text_rules(spark, d):
    texts = ['{"v": 30}', '30.0', '[]', '', "30 days, read"]
    return P.permission_tokens(_by_id(spark, d, texts), perm_col="t", split_mode="comma")


_REPLIES = ["Decision: Fully approved.", "Partially allowed: only the read part.", "Rejected: not permitted."]


@register("batch_inference_details", f"""
SELECT i.id AS "index", prediction, CASE WHEN success THEN md5(e.query) END AS query_md5, CASE WHEN success THEN e.permissions END AS permissions,
       CASE WHEN success THEN 'unknown' END AS user_role, CASE WHEN success THEN '' END AS expected_rationale,
       CASE WHEN NOT success THEN NULL WHEN prediction = 'full' THEN '{_REPLIES[0]}' WHEN prediction = 'partial' THEN '{_REPLIES[1]}' ELSE '{_REPLIES[2]}' END AS model_response
FROM ({_INFER_SQL}) i JOIN ({_EVAL_SQL}) e ON i.id = e.id
""")
def _batch_inference_details(spark, d):
    det = I.detailed_predictions(inference_run(spark, d, ("permissions", "query")), details=True)
    f = "full_details."
    return det.select("index", "prediction", F.md5(f + "query").alias("query_md5"), F.col(f + "permissions").alias("permissions"),
                      F.col(f + "user_role").alias("user_role"), F.col(f + "expected_rationale").alias("expected_rationale"),
                      F.col(f + "model_response").alias("model_response"))


@register("details_profile", f"""
SELECT count(*) AS n_rows_with_fields, 2.0::DOUBLE AS mean_fields FROM ({_INFER_SQL}) WHERE success
""")
def _details_profile(spark, d):
    """I4 to K, S4 to P6: permissions are found in the details of saved predictions."""
    path = shared_dir(spark, "results-details")
    det = I.detailed_predictions(inference_run(spark, d, ("permissions", "query")), details=True)
    docs = det.select("index", "prediction", "ground_truth", F.col("correct_raw").alias("correct"), "full_details",
                      F.lit("m").alias("run"), F.lit("easy").alias("difficulty"))
    K.write_results_documents(docs, path)
    flat, _ = R.read_results(spark, path, glob="*.txt", multi_line=False)
    return P.mean_fields(flat, "permissions")


@register("results_bad_files", """
WITH s AS (SELECT DISTINCT source FROM documents)
SELECT 'unreadable' AS reason, count(*) AS n FROM s WHERE source LIKE '%3' HAVING count(*) > 0
UNION ALL SELECT 'no_layout', count(*) FROM s WHERE source LIKE '%5' HAVING count(*) > 0
""")
def _results_bad_files(spark, d):
    path = shared_dir(spark, "results-bad")
    runs = B.read(spark, d, "documents").select(F.col("source").alias("run")).distinct()
    good = F.concat(F.lit('{"model_name": "'), "run", F.lit('", "results": {"easy": {"predictions": []}}}'))
    line = (F.when(F.col("run").endswith("3"), F.lit('{"model_name": "cut off'))
            .when(F.col("run").endswith("5"), F.lit('{"model_name": "x", "results": {"other": {}}}')).otherwise(good))
    runs.select(line.alias("value")).write.text(path)
    _, bad = R.read_results(spark, path, glob="*.txt", multi_line=False)
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


_STRATEGY = {"training": "70% of each language but the held-out one, split 80/20 for train and validation",
             "benchmark": "the other 30% and the held-out language"}
_OUTPUTS = {"train": "train.parquet", "validation": "validation.parquet", "test": "test.parquet"}


@register("manifest_full", f"""
WITH s AS ({_SPLIT_SQL}), t AS ({O.truth_sql()})
SELECT 42::BIGINT AS seed, '{_STRATEGY["training"]}' AS training, '{_STRATEGY["benchmark"]}' AS benchmark, split || '.parquet' AS output,
       count(*) AS "rows", count(*) FILTER (WHERE truth_raw = 'full') AS "full", count(*) FILTER (WHERE truth_raw = 'partial') AS "partial",
       count(*) FILTER (WHERE truth_raw = 'rejected') AS rejected
FROM s LEFT JOIN t ON s.doc_id = t.id GROUP BY split
""")
def _manifest_full(spark, d):
    s = _split_docs(spark, d).join(B.truth(spark, d).withColumnRenamed("id", "doc_id"), "doc_id", "left")
    path = shared_dir(spark, "manifest")
    K.write_manifest(K.manifest(L.split_label_stats(s, "split", "truth_raw"), _OUTPUTS, _STRATEGY, 42), path)
    m = spark.read.json(path)
    rows = m.select("seed", "split_strategy.*", F.explode("datasets").alias("o"), "label_distributions")
    own = F.get(F.filter("label_distributions", lambda x: F.concat(x["split"], F.lit(".parquet")) == F.col("o.output")), 0)
    return rows.select("seed", "training", "benchmark", F.col("o.output").alias("output"), F.col("o.rows").alias("rows"),
                       own["full"].alias("full"), own["partial"].alias("partial"), own["rejected"].alias("rejected"))
