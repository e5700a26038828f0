"""Label cleaning and label statistics: C5-C8, L1-L3, M3, M11.

All operators aggregate once with partial (map-side) aggregation; a global total
is a one-row aggregate broadcast back, never a window over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import attach_one_row, evaluate_once, materialize, ratio
from ..functions.labels import CLASSES, is_canonical, lower_strip, normalize_label

LABEL_CANDIDATES = ("expected_response", "label", "ground_truth")


def choose_label_column(df: DataFrame, candidates=LABEL_CANDIDATES) -> str:
    """First existing column of ``candidates`` (schema-time choice)."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of {candidates} in {df.columns}")


def with_normalized(df: DataFrame, label_col: str, dialect: str, out: str = "label") -> DataFrame:
    """C5 as a projection: keep the raw value and add the normalised one."""
    return df.withColumn(out, normalize_label(label_col, dialect))


def raw_label_counts(df: DataFrame, label_col: str) -> DataFrame:
    """Rows per distinct raw label (``raw``, ``n``).

    Every dialect is a pure function of the raw value, so the operators below
    count first (partial aggregation on the map side) and normalise only the
    distinct values: the per-row work is a hash-aggregate update.
    """
    return df.groupBy(F.col(label_col).alias("raw")).agg(F.count(F.lit(1)).alias("n"))


def label_distribution(df: DataFrame, label_col: str | None = None,
                       dialect: str = "distribution") -> DataFrame:
    """L1: count and percent **of all rows** per normalised label, plus a bar.

    Output: ``label, n, pct, bar, n_labelled, n_total``.  Rows whose label is null
    or empty are not counted as a label but do count in ``n_total``.
    """
    label_col = label_col or choose_label_column(df)
    raw = raw_label_counts(df, label_col)
    per = materialize(raw.select(normalize_label("raw", dialect).alias("label"), "n")
                         .groupBy("label").agg(F.sum("n").alias("n")))  # rows and totals read it
    totals = per.agg(F.sum("n").alias("n_total"),
                     F.sum(F.when(F.col("label").isNotNull(), F.col("n")).otherwise(0)).alias("n_labelled"))
    out = attach_one_row(per.filter(F.col("label").isNotNull()), totals)
    pct = (F.col("n") / F.col("n_total")) * F.lit(100.0)
    return out.select(
        "label", F.col("n").cast("bigint").alias("n"),
        F.round(pct, 6).alias("pct"),
        F.repeat(F.lit("█"), F.floor(pct / F.lit(2.0)).cast("int")).alias("bar"),
        F.col("n_labelled").cast("bigint").alias("n_labelled"),
        F.col("n_total").cast("bigint").alias("n_total"),
    )


def dataset_sizes(df: DataFrame, dataset_col: str = "dataset") -> DataFrame:
    """L2: rows per dataset over a union of datasets, in one pass."""
    return df.groupBy(dataset_col).agg(F.count(F.lit(1)).alias("n_rows"))


def split_label_stats(df: DataFrame, split_col: str = "split", label_col: str = "expected_response") -> DataFrame:
    """L3: wide per-split stats on **raw** labels.

    ``total`` counts every row, so corrupted labels only inflate it.  Percentages
    are ``100*n/total``; an empty split gives null instead of dividing by zero.
    """
    lab = F.col(label_col)
    aggs = [F.count(F.lit(1)).alias("total")]
    aggs += [F.count_if(lab == c).alias(c) for c in CLASSES]
    g = df.groupBy(split_col).agg(*aggs)
    return g.select(split_col, "total", *CLASSES,
                    *[ratio(c, "total", 100.0).alias(f"{c}_pct") for c in CLASSES])


def _normalized_distinct(df: DataFrame, label_col: str, dialect: str) -> DataFrame:
    """Distinct raw labels with counts and their normalised value, evaluated once
    per distinct value (kept behind a generator so filters stay above it)."""
    return evaluate_once(raw_label_counts(df, label_col), normalized=normalize_label("raw", dialect))


def label_change_log(df: DataFrame, label_col: str = "expected_response", dialect: str = "repair") -> DataFrame:
    """One row per ``original -> normalised`` pair that differs, with counts.

    The comparison is null-safe, so a null label repaired to ``rejected`` is a
    change.  Output: ``original, normalized, n`` (order by ``n`` desc to report).
    """
    d = _normalized_distinct(df, label_col, dialect)
    return (d.filter(~F.col("raw").eqNullSafe(F.col("normalized")))
             .select(F.col("raw").alias("original"), "normalized", "n"))


def corrupted_tally(df: DataFrame, label_col: str = "expected_response", dialect: str = "distribution") -> DataFrame:
    """How often each of the clipped labels p, r and f (any case, blanks around) was
    repaired to another value.  Output: ``original, normalized, n, pct`` (of all rows)."""
    counts = materialize(df.groupBy(F.col(label_col).alias("raw")).agg(F.count(F.lit(1)).alias("n")))
    d = evaluate_once(counts, original=lower_strip(F.col("raw")), normalized=normalize_label("raw", dialect))
    total = counts.agg(F.sum("n").alias("n_rows"))
    hit = d.where(F.col("original").isin("p", "r", "f") & ~F.col("original").eqNullSafe(F.col("normalized")))
    hit = hit.groupBy("original", "normalized").agg(F.sum("n").alias("n"))
    return attach_one_row(hit, total).select("original", "normalized", "n", ratio("n", "n_rows", 100.0).alias("pct"))


def label_dry_run(df: DataFrame, label_col: str = "expected_response", dialect: str = "repair") -> DataFrame:
    """The change summary a dry run reports; nothing is written.

    Output: one row ``n_rows, n_changed, n_distinct_changes``.  The caller decides
    whether to write :func:`repair_labels` afterwards.
    """
    d = _normalized_distinct(df, label_col, dialect)
    changed = ~F.col("raw").eqNullSafe(F.col("normalized"))
    return d.agg(F.sum("n").cast("bigint").alias("n_rows"),
                 F.sum(F.when(changed, F.col("n")).otherwise(0)).cast("bigint").alias("n_changed"),
                 F.count_if(changed).alias("n_distinct_changes"))


def repair_labels(df: DataFrame, label_col: str = "expected_response", dialect: str = "repair",
                  keep_original: str | None = "expected_response_raw") -> DataFrame:
    """Replace the label by its normalised value, keeping the raw one if asked."""
    out = df
    if keep_original:
        out = out.withColumn(keep_original, F.col(label_col))
    return out.withColumn(label_col, normalize_label(label_col, dialect))


class InvalidLabelError(ValueError):
    pass


def apply_invalid_policy(df: DataFrame, cols, policy: str = "default_rejected") -> DataFrame:
    """M3: what happens to labels outside the three classes.

    * ``default_rejected``: replaced by ``rejected``.
    * ``raise``: a bounded check (top-10 offenders per column) raises
      :class:`InvalidLabelError` if any exist.
    * ``key_error``: the same check raises ``KeyError`` with the most frequent offender.
    * ``keep``: left as they are (they then count in no matrix cell).
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    if policy == "default_rejected":
        for c in cols:
            df = df.withColumn(c, F.when(is_canonical(c), F.col(c)).otherwise(F.lit("rejected")))
        return df
    if policy == "raise":
        for c in cols:
            bad = invalid_label_offenders(df, c).collect()  # at most 10 rows
            if bad:
                listing = ", ".join(f"{r['label']!r}: {r['n']}" for r in bad)
                raise InvalidLabelError(f"invalid labels in {c}: {listing}")
        return df
    if policy == "key_error":
        for c in cols:
            bad = invalid_label_offenders(df, c, 1).collect()
            if bad:
                raise KeyError(bad[0]["label"])
        return df
    if policy == "keep":
        return df
    raise ValueError(f"unknown policy {policy!r}")


def invalid_label_offenders(df: DataFrame, c: str, top: int = 10) -> DataFrame:
    """M3: the most frequent labels outside the three classes (null included)."""
    return (df.filter(~F.coalesce(is_canonical(c), F.lit(False)))
              .groupBy(F.col(c).alias("label")).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), F.asc_nulls_first("label")).limit(top))


def corrupted_share(df: DataFrame, truth: str, pred: str, by=()) -> DataFrame:
    """Rows whose **raw** truth / prediction is not a canonical class."""
    by = list(by)
    g = df.groupBy(*by) if by else df.groupBy()
    out = g.agg(F.count(F.lit(1)).alias("n_rows"),
                F.count_if(~F.coalesce(is_canonical(truth), F.lit(False))).alias("corrupted_truth"),
                F.count_if(~F.coalesce(is_canonical(pred), F.lit(False))).alias("corrupted_prediction"))
    return out.select(*by, "n_rows", "corrupted_truth", "corrupted_prediction",
                      ratio("corrupted_truth", "n_rows").alias("corrupted_truth_share"),
                      ratio("corrupted_prediction", "n_rows").alias("corrupted_prediction_share"))
