"""Sinks K1-K6.  Writers take a DataFrame and a path on shared storage; nothing
is collected.  Versioned outputs never overwrite the path being read."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.common import materialize
from ..operators.clean import REQUIRED_FIELDS, conform, missing_fields
from . import commits


def write_splits(df: DataFrame, path: str, split_col: str = "split", mode: str = "overwrite") -> None:
    """K1: every split in one job, one directory per split value."""
    df.write.mode(mode).partitionBy(split_col).parquet(path)


def save_output(df: DataFrame, path: str, fmt: str = "jsonl", mode: str = "overwrite") -> None:
    """K2: JSON Lines output.  The single JSON-array form needs one writer holding
    every row, so it is not offered; any other format is an error."""
    if fmt == "jsonl":
        df.write.mode(mode).json(path)
        return
    if fmt == "json":
        raise ValueError("a single JSON array cannot be written by a distributed job; use 'jsonl'")
    raise ValueError(f"unknown output format {fmt!r}")


def merge_into(existing: DataFrame, new_records: DataFrame, record_col: str, out_path: str, required=REQUIRED_FIELDS) -> int:
    """K3 as a whole new version: reject records without the required fields (C1), conform the others to
    the existing schema (C3), and write them with the existing rows to ``out_path``
    (a new version directory, since Spark cannot overwrite a path it reads).  Every old
    row is written again; :func:`merge_append` only writes the new ones.

    Returns the number of appended rows; zero valid rows means nothing is written.
    """
    known = F.col(record_col).isNotNull() & (F.size(missing_fields(F.col(record_col), required)) == 0)
    conformed = materialize(new_records.where(known).select(*conform(F.col(record_col), existing.schema)))  # parsed once
    n_new = conformed.count()
    if n_new == 0:
        return 0
    existing.unionByName(conformed).write.mode("errorifexists").parquet(out_path)
    return n_new


def merge_append(spark: SparkSession, base: str, new_records: DataFrame, record_col: str, required=REQUIRED_FIELDS,
                 before="last") -> tuple:
    """K3 at the cost of the new rows: reject records without the required fields (C1), conform
    the others to the table's schema (C3), and commit them as one more batch of the table below
    ``base`` (:mod:`.commits`).  Old files are neither read nor written.

    Returns ``(entry, appended rows)``; zero valid rows means nothing is committed (entry
    None).  Another writer in between raises ``CommitConflict`` where ``before`` is given.
    """
    at = commits.last(spark, base) if before == "last" else before
    if at is None:
        raise ValueError(f"no commits under {base}")
    schema = T.StructType.fromJson(json.loads(at.schema))
    known = F.col(record_col).isNotNull() & (F.size(missing_fields(F.col(record_col), required)) == 0)
    done = commits.append(new_records.where(known).select(*conform(F.col(record_col), schema)), base, at)
    return done, (done.rows - at.rows if done else 0)


def versioned_write(spark: SparkSession, df: DataFrame, base: str, keep_backup: bool = True) -> str:
    """K5: write ``df`` as a new version below ``base`` and point ``_current`` at it.

    The previous version stays in place and is the backup; ``keep_backup=False``
    only records that it may be dropped (deleting is left to the storage's
    lifecycle rules).  Returns the new version path.
    """
    version = (_last_version(spark, base) or 0) + 1
    path = f"{base}/v-{version:08d}"  # of two writers of one version the later fails
    df.write.mode("errorifexists").parquet(path)
    pointer = spark.createDataFrame([(version, path, keep_backup)], "version long, path string, keep_previous boolean") \
        .withColumn("written_at", F.current_timestamp())
    pointer.coalesce(1).write.mode("append").parquet(f"{base}/_current")
    return path


def read_current(spark: SparkSession, base: str) -> DataFrame:
    """K5 read side: the newest version named by the ``_current`` pointer table."""
    last = _last_version(spark, base)
    if last is None:
        raise ValueError(f"no versions under {base}")
    return spark.read.parquet(f"{base}/v-{last:08d}")


def _last_version(spark: SparkSession, base: str) -> int | None:
    """The largest version number in the pointer table; None where there is none."""
    try:
        return spark.read.parquet(f"{base}/_current").agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_manifest(df: DataFrame, path: str) -> None:
    """K6: the split manifest (a few rows) as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def manifest(stats: DataFrame, outputs: dict, strategy: dict, seed: int, split_col: str = "split") -> DataFrame:
    """K6: the whole manifest as one row: time, seed, strategy texts, rows of every output
    (``outputs``: split -> file name) and the label distribution of every split (L3)."""
    names = F.create_map(*[F.lit(x) for kv in sorted(outputs.items()) for x in kv])
    each = F.struct(F.try_element_at(names, F.col(split_col)).alias("output"), F.col("total").alias("rows"))
    row = stats.agg(F.array_sort(F.collect_list(each)).alias("datasets"),
                    F.array_sort(F.collect_list(F.struct(split_col, *[c for c in stats.columns if c != split_col]))).alias("label_distributions"))
    return row.select(F.current_timestamp().cast("string").alias("timestamp"), F.lit(seed).alias("seed"),
                      F.struct(*[F.lit(v).alias(k) for k, v in strategy.items()]).alias("split_strategy"), "datasets", "label_distributions")


def write_permission_database(db: dict, path: str) -> None:
    """K4: each table of the permission database side by side below ``path``."""
    for name, frame in db.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")


def write_results_documents(df: DataFrame, path: str, run_col: str = "run", difficulty_col: str = "difficulty",
                            index_col: str = "index", rows_per_doc: int = 5000,
                            legacy_col: str | None = None) -> None:
    """Write evaluation result documents (F4 layout) as JSON Lines, one document per
    line: ``{model_name, results: {<difficulty>: {total_samples, predictions}}}``.

    A run is cut into documents of at most ``rows_per_doc`` predictions (by index
    range), so no single task has to hold a whole run.  When ``legacy_col`` is
    true for a row's run the array is written under the old key ``details``.
    """
    chunk = F.floor(F.col(index_col) / F.lit(rows_per_doc))
    extra = ["full_details"] if "full_details" in df.columns else []
    pred = F.struct(F.col(index_col).alias("index"), "prediction", "ground_truth", "correct", *extra)
    keys = [run_col, difficulty_col, chunk.alias("__chunk")] + ([legacy_col] if legacy_col else [])
    docs = df.groupBy(*keys).agg(F.sort_array(F.collect_list(pred)).alias("preds"))
    body_new = F.struct(F.size("preds").alias("total_samples"), F.col("preds").alias("predictions"))
    body_old = F.struct(F.size("preds").alias("total_samples"), F.col("preds").alias("details"))
    doc_new = F.to_json(F.struct(F.col(run_col).alias("model_name"),
                                 F.create_map(F.col(difficulty_col), body_new).alias("results")))
    doc_old = F.to_json(F.struct(F.col(run_col).alias("model_name"),
                                 F.create_map(F.col(difficulty_col), body_old).alias("results")))
    line = F.when(F.col(legacy_col), doc_old).otherwise(doc_new) if legacy_col else doc_new
    docs.select(line.alias("value")).write.mode("overwrite").text(path)
