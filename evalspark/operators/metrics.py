"""Classification metrics and run comparison: M1, M4-M10, M12, M13.

The only step that touches data at scale is :func:`confusion_counts`: one
aggregate with nine conditional counts per group (``run`` etc.), partially
aggregated on the map side and zero-filled by construction.  Everything after it
is arithmetic over a handful of rows per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import ratio0
from ..functions.labels import CLASSES

_IDX = {c: i for i, c in enumerate(CLASSES)}


def _cell(t: str, p: str) -> str:
    return f"c_{_IDX[t]}{_IDX[p]}"


def pair_predictions(pred: DataFrame, truth: DataFrame, key: str = "id"):
    """M1: pair predictions with truth by an explicit key (inner equi-join).

    Returns ``(paired, unmatched)``; ``unmatched`` lists keys present on one side
    only, with ``side`` = ``prediction_only`` / ``truth_only``.
    """
    paired = pred.join(truth, key, "inner")
    # one full outer join on the keys finds both kinds of unmatched rows
    p = pred.select(key, F.lit(True).alias("__p"))
    t = truth.select(key, F.lit(True).alias("__t"))
    both = p.join(t, key, "full_outer")
    unmatched = both.filter(F.col("__p").isNull() | F.col("__t").isNull()).select(
        key, F.when(F.col("__t").isNull(), "prediction_only").otherwise("truth_only").alias("side"))
    return paired, unmatched


def confusion_counts(df: DataFrame, truth: str = "truth", pred: str = "prediction", by=()) -> DataFrame:
    """Wide confusion matrix: one row per group with ``c_<t><p>`` and ``n_total``.

    Rows whose truth or prediction is outside the three classes count only in
    ``n_total`` (apply :func:`..labels.apply_invalid_policy` first to decide).
    """
    by = list(by)
    t, p = F.col(truth), F.col(pred)
    aggs = [F.count_if((t == a) & (p == b)).alias(_cell(a, b)) for a in CLASSES for b in CLASSES]
    aggs.append(F.count(F.lit(1)).alias("n_total"))
    return (df.groupBy(*by) if by else df.groupBy()).agg(*aggs)


def confusion_matrix(df: DataFrame, truth: str = "truth", pred: str = "prediction", by=(),
                     labels: str = "all") -> DataFrame:
    """M4: long form ``(by..., truth, prediction, n)``; rows = truth.

    ``labels="all"`` gives the zero-filled 3x3 grid.  ``labels="present"`` keeps
    only classes seen in truth or prediction of the group (the matrix shrinks).
    """
    by = list(by)
    w = confusion_counts(df, truth, pred, by)
    stack = ", ".join(f"'{a}', '{b}', {_cell(a, b)}" for a in CLASSES for b in CLASSES)
    out = w.select(*by, *[_present(c) for c in CLASSES],
                   F.expr(f"stack(9, {stack}) as (truth, prediction, n)"))
    if labels == "present":
        ok_t = F.expr(" OR ".join(f"(truth = '{c}' AND present_{c})" for c in CLASSES))
        ok_p = F.expr(" OR ".join(f"(prediction = '{c}' AND present_{c})" for c in CLASSES))
        out = out.filter(ok_t & ok_p)
    elif labels != "all":
        raise ValueError("labels must be 'all' or 'present'")
    return out.select(*by, "truth", "prediction", F.col("n").cast("bigint").alias("n"))


def _row_sum(c: str):
    return sum((F.col(_cell(c, b)) for b in CLASSES), F.lit(0))


def _col_sum(c: str):
    return sum((F.col(_cell(a, c)) for a in CLASSES), F.lit(0))


def _present(c: str):
    return ((_row_sum(c) + _col_sum(c)) > 0).alias(f"present_{c}")


def _prec(c: str):
    return F.coalesce(F.try_divide(F.col(_cell(c, c)).cast("double"), _col_sum(c).cast("double")), F.lit(0.0))


def _rec(c: str):
    return F.coalesce(F.try_divide(F.col(_cell(c, c)).cast("double"), _row_sum(c).cast("double")), F.lit(0.0))


def _f1(c: str):
    return F.coalesce(F.try_divide((F.col(_cell(c, c)) * 2).cast("double"),
                                   (_row_sum(c) + _col_sum(c)).cast("double")), F.lit(0.0))


def per_class_stats(df: DataFrame, truth: str = "truth", pred: str = "prediction", by=()) -> DataFrame:
    """M6/M8: per class precision, recall, F1, support and per-class accuracy.

    Undefined ratios are 0 (``zero_division=0``).  Per-class accuracy is the
    diagonal over the row sum, i.e. recall.  One aggregate; the three class rows
    come from one ``inline`` of that row.
    """
    by = list(by)
    w = confusion_counts(df, truth, pred, by)
    rows = F.array(*[F.struct(F.lit(c).alias("label"), F.col(_cell(c, c)).alias("tp"),
                              _row_sum(c).alias("support"), _col_sum(c).alias("predicted")) for c in CLASSES])
    u = w.select(*by, F.inline(rows))
    return u.select(*by, "label",
                    ratio0("tp", "predicted").alias("precision"),
                    ratio0("tp", "support").alias("recall"),
                    ratio0(F.col("tp") * 2, F.col("support") + F.col("predicted")).alias("f1"),
                    F.col("support").cast("bigint").alias("support"),
                    F.col("predicted").cast("bigint").alias("predicted"),
                    ratio0("tp", "support").alias("class_accuracy"))


def summary_metrics(df: DataFrame, truth: str = "truth", pred: str = "prediction", by=()) -> DataFrame:
    """M5/M7: accuracy, macro/weighted F1, macro precision/recall per group.

    Macro averages run over classes present in truth or prediction (what
    ``f1_score(average='macro')`` does without ``labels=``).  Weighted F1 weights
    by support.
    """
    return summary_from_counts(confusion_counts(df, truth, pred, by), by)


def summary_from_counts(w: DataFrame, by=()) -> DataFrame:
    """M5/M7 from wide counts (the output of :func:`confusion_counts`), so a
    streaming aggregate can feed it batch by batch."""
    by = list(by)
    diag = sum((F.col(_cell(c, c)) for c in CLASSES), F.lit(0))
    n_present = sum((F.when((_row_sum(c) + _col_sum(c)) > 0, 1).otherwise(0) for c in CLASSES), F.lit(0))
    sum_f1 = sum((_f1(c) for c in CLASSES), F.lit(0.0))
    sum_p = sum((_prec(c) for c in CLASSES), F.lit(0.0))
    sum_r = sum((_rec(c) for c in CLASSES), F.lit(0.0))
    wf1 = sum((_f1(c) * _row_sum(c) for c in CLASSES), F.lit(0.0))
    n_true = sum((_row_sum(c) for c in CLASSES), F.lit(0))
    return w.select(*by,
                    F.col("n_total").cast("bigint").alias("n_total"),
                    ratio0(diag, "n_total").alias("accuracy"),
                    F.round(F.coalesce(F.try_divide(sum_f1, n_present.cast("double")), F.lit(0.0)), 6).alias("f1_macro"),
                    F.round(F.coalesce(F.try_divide(wf1, n_true.cast("double")), F.lit(0.0)), 6).alias("f1_weighted"),
                    F.round(F.coalesce(F.try_divide(sum_p, n_present.cast("double")), F.lit(0.0)), 6).alias("precision_macro"),
                    F.round(F.coalesce(F.try_divide(sum_r, n_present.cast("double")), F.lit(0.0)), 6).alias("recall_macro"))


def classification_report(df: DataFrame, truth: str = "truth", pred: str = "prediction", by=()) -> DataFrame:
    """M6+M9: the three class rows, then ``accuracy``, ``macro avg``, ``weighted avg``.

    The report always lists the three classes, and its averages run over those
    three (as ``classification_report(labels=[0,1,2])`` does).  The accuracy row
    carries accuracy in ``f1`` and the total in ``support``.  One aggregate; all
    six rows are projected from it.
    """
    by = list(by)
    w = confusion_counts(df, truth, pred, by)
    n = sum((_row_sum(c) for c in CLASSES), F.lit(0))
    nd = n.cast("double")
    diag = sum((F.col(_cell(c, c)) for c in CLASSES), F.lit(0))

    def r6(x):
        return F.round(x, 6)

    def wavg(f):
        return r6(F.coalesce(F.try_divide(sum((f(c) * _row_sum(c) for c in CLASSES), F.lit(0.0)), nd), F.lit(0.0)))

    none = F.lit(None).cast("double")
    rows = [F.struct(F.lit(c).alias("label"), r6(_prec(c)).alias("precision"), r6(_rec(c)).alias("recall"),
                     r6(_f1(c)).alias("f1"), _row_sum(c).cast("bigint").alias("support")) for c in CLASSES]
    rows.append(F.struct(F.lit("accuracy").alias("label"), none.alias("precision"), none.alias("recall"),
                         ratio0(diag, n).alias("f1"), n.cast("bigint").alias("support")))
    rows.append(F.struct(F.lit("macro avg").alias("label"),
                         r6(sum((_prec(c) for c in CLASSES), F.lit(0.0)) / 3.0).alias("precision"),
                         r6(sum((_rec(c) for c in CLASSES), F.lit(0.0)) / 3.0).alias("recall"),
                         r6(sum((_f1(c) for c in CLASSES), F.lit(0.0)) / 3.0).alias("f1"),
                         n.cast("bigint").alias("support")))
    rows.append(F.struct(F.lit("weighted avg").alias("label"), wavg(_prec).alias("precision"),
                         wavg(_rec).alias("recall"), wavg(_f1).alias("f1"), n.cast("bigint").alias("support")))
    return w.select(*by, F.inline(F.array(*rows)))


def compare_runs(df: DataFrame, truth: str = "truth", pred: str = "prediction", run: str = "run") -> DataFrame:
    """One row per run (all runs in one job): accuracy, macro F1, weighted F1."""
    return summary_metrics(df, truth, pred, [run]).select(run, "n_total", "accuracy", "f1_macro", "f1_weighted")


def dependency_level(drop_col) -> F.Column:
    """M12 bucket: ``|drop| < 0.05`` LOW, ``< 0.15`` MODERATE, else HIGH."""
    a = F.abs(drop_col)
    return F.when(a < 0.05, "LOW").when(a < 0.15, "MODERATE").otherwise("HIGH")


from .prompts import PROMPT_FORMATS  # noqa: E402


def prompt_format_comparison(df: DataFrame, fmt: str = "format", correct: str = "correct",
                             base: str = "with_system", other: str = "without_system", by=(),
                             formats=PROMPT_FORMATS) -> DataFrame:
    """Accuracy per prompt format, drop = base - other, dependency bucket.

    ``df`` has one row per (example, format) with a boolean ``correct``; the
    pivot values are given, so no extra job collects the distinct formats.
    """
    by = list(by)
    acc = (df.groupBy(*by).pivot(fmt, sorted(formats)).agg(F.avg(F.col(correct).cast("double"))))
    fmts = [c for c in acc.columns if c not in by]
    drop = F.col(base) - F.col(other)
    return acc.select(*by, *[F.round(F.col(c), 6).alias(f"acc_{c}") for c in fmts],
                      F.round(drop, 6).alias("drop_without_system"),
                      dependency_level(drop).alias("dependency"))


def paired_comparison(a: DataFrame, b: DataFrame, key: str = "id", truth: str = "truth",
                      pred: str = "prediction") -> DataFrame:
    """Paired comparison of two predictors on the same rows.

    Equi-join on ``key``; per row ``d = correct_a - correct_b``; paired
    t = mean(d) / (stddev_samp(d) / sqrt(n)) (null when undefined).
    """
    j = (a.select(key, F.col(truth).alias("truth"), F.col(pred).alias("pred_a"))
          .join(b.select(key, F.col(pred).alias("pred_b")), key))
    d = (F.col("pred_a") == F.col("truth")).cast("int") - (F.col("pred_b") == F.col("truth")).cast("int")
    s = j.select(d.alias("d"), (F.col("pred_a") == F.col("truth")).cast("int").alias("ca"),
                 (F.col("pred_b") == F.col("truth")).cast("int").alias("cb"))
    g = s.agg(F.count(F.lit(1)).alias("n"), F.avg("ca").alias("acc_a"), F.avg("cb").alias("acc_b"),
              F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd_diff"),
              F.count_if(F.col("d") > 0).alias("a_only_correct"), F.count_if(F.col("d") < 0).alias("b_only_correct"))
    t = F.try_divide(F.col("mean_diff"), F.try_divide(F.col("sd_diff"), F.sqrt(F.col("n").cast("double"))))
    return g.select("n", F.round("acc_a", 6).alias("acc_a"), F.round("acc_b", 6).alias("acc_b"),
                    F.round("mean_diff", 6).alias("mean_diff"), F.round("sd_diff", 6).alias("sd_diff"),
                    F.round(t, 6).alias("t_stat"), "a_only_correct", "b_only_correct")


def error_categories(df: DataFrame, truth: str = "truth", pred: str = "prediction", by=()) -> DataFrame:
    """M13 error categories: counts of each (truth, prediction) pair that is wrong."""
    by = list(by)
    return confusion_matrix(df, truth, pred, by).filter((F.col("truth") != F.col("prediction")) & (F.col("n") > 0))


def ablation_metrics(df: DataFrame, subsets: dict, truth: str = "truth", pred: str = "prediction") -> DataFrame:
    """M13 ablation: summary metrics of every named subset (name -> predicate) of the scored rows,
    which may overlap, in one aggregate.  A subset without rows has no line."""
    names = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in subsets.items()]))
    tagged = df.select(truth, pred, F.explode(names).alias("subset"))
    return summary_from_counts(confusion_counts(tagged, truth, pred, ["subset"]), ["subset"])
