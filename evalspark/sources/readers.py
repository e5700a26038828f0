"""Sources S1-S6.

Every reader is a distributed scan; a file that fails to parse is reported as
rows (quarantine), never as a driver-side loop over files.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.common import materialize
from ..functions.json import parse_json
from ..functions.labels import PY_WHITESPACE, normalize_label
from ..operators.clean import CORE_SCHEMA, REQUIRED_FIELDS, conform, missing_fields

# Difficulty names and the two path templates of S1.
DIFFICULTIES = ["easy", "medium", "hard"]
BENCH_TEMPLATE = "{base}/{split}_test.parquet"
DATA_TEMPLATE = "{base}/{split}-00000-of-00001.parquet"


def load_splits(spark: SparkSession, paths: dict, schema: T.StructType | None = None):
    """Read named Parquet splits into one frame with a ``split`` column.

    A split whose path cannot be read is skipped and reported.  Returns
    ``(frame_or_None, missing_names)``.
    """
    frames, missing = [], []
    for name, path in paths.items():
        try:
            r = spark.read.schema(schema) if schema is not None else spark.read
            frames.append(r.parquet(path).withColumn("split", F.lit(name)))
        except (PySparkException, Py4JJavaError):  # no such path, or no Parquet footer
            missing.append(name)
    if not frames:
        return None, missing
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out, missing


def split_paths(base: str, mode: str = "data", splits=DIFFICULTIES) -> dict:
    """S1 path templates: ``bench`` -> ``{split}_test.parquet``, else HF-style names."""
    tpl = BENCH_TEMPLATE if mode == "bench" else DATA_TEMPLATE
    return {s: tpl.format(base=base, split=s) for s in splits}


def _text_lines(spark: SparkSession, path: str, glob: str | None, name_filter: str | None) -> DataFrame:
    """Every line with its ``file_path`` and the byte its input split starts at (``block``)."""
    r = spark.read
    if glob:
        r = r.option("pathGlobFilter", glob)
    lines = r.option("recursiveFileLookup", "true").text(path)
    if name_filter:
        lines = lines.filter(F.lower(F.col("_metadata.file_name")).contains(name_filter.lower()))
    return lines.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"),
                        F.col("value").alias("line"))


def _not_blank(line):
    return F.btrim(line, F.lit(PY_WHITESPACE)) != ""


def read_jsonl_lines(spark: SparkSession, path: str, glob: str | None = None,
                     name_filter: str | None = None) -> DataFrame:
    """S2/S3 scan: one row per non-blank line with ``file_path`` and ``record``.

    ``record`` is the strict parse (single quotes are not JSON); ``name_filter``
    keeps files whose lower-cased name contains it (S3's difficulty filter).
    """
    lines = _text_lines(spark, path, glob, name_filter).drop("block")
    return lines.filter(_not_blank(F.col("line"))).withColumn("record", parse_json("line"))


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """``line_no`` (from 1, blank lines count) of the lines of :func:`_text_lines`.

    A split's lines stand in the file's order in one task, so a row's number within its
    (file, split) is its running id less the split's first.  The lines are written once with that
    id, whatever the splits of a later scan; splits are counted, counts are summed
    up along each file (a row per split), and every line adds its split's sum.
    """
    from ..session import shared_dir
    spark = lines.sparkSession
    path = shared_dir(spark, "numbered-lines")
    numbered = lines.withColumn("__at", F.monotonically_increasing_id())
    numbered.write.parquet(path)
    numbered = spark.read.schema(numbered.schema).parquet(path)
    splits = numbered.groupBy("file_path", "block").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    along = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("__before", F.coalesce(F.sum("__n").over(along), F.lit(0)))
    out = numbered.join(materialize(splits), ["file_path", "block"])  # a row per split: planned by its size
    return out.select(*lines.columns, (F.col("__before") + F.col("__at") - F.col("__first") + 1).alias("line_no"))


def jsonl_numbered(spark: SparkSession, path: str, glob: str | None = None, name_filter: str | None = None,
                   required=REQUIRED_FIELDS) -> DataFrame:
    """:func:`jsonl_tagged` with ``line_no``, the line's number in its file as an editor shows it."""
    lines = with_line_numbers(_text_lines(spark, path, glob, name_filter)).drop("block")
    return _tagged(lines.filter(_not_blank(F.col("line"))).withColumn("record", parse_json("line")), required)


def jsonl_tagged(spark: SparkSession, path: str, glob: str | None = None, name_filter: str | None = None,
                 required=REQUIRED_FIELDS) -> DataFrame:
    """S2 + C1 in one pass: every non-blank line with ``record`` (VARIANT),
    ``reason`` (null, ``malformed`` or ``missing_fields``) and ``missing``."""
    return _tagged(read_jsonl_lines(spark, path, glob, name_filter), required)


def _tagged(lines: DataFrame, required) -> DataFrame:
    is_obj = F.col("record").try_cast("map<string,variant>").isNotNull()
    miss = missing_fields(F.col("record"), required)
    return lines.withColumn("missing", F.when(is_obj, miss)).withColumn(
        "reason", F.when(~is_obj | F.col("record").isNull(), "malformed")
                  .when(F.size("missing") > 0, "missing_fields"))


def conform_tagged(tagged: DataFrame, schema: T.StructType = CORE_SCHEMA) -> DataFrame:
    """C2/C3 on a tagged frame, one row per line: conformed columns for good rows
    (null for quarantined ones) next to ``reason`` and the ``missing`` list."""
    good = F.col("reason").isNull()
    cols = [F.when(good, c).alias(f.name) for f, c in zip(schema.fields, conform(F.col("record"), schema))]
    number = ["line_no"] if "line_no" in tagged.columns else []
    return tagged.select("file_path", *number, "line", "record", "reason",
                         F.array_join(F.coalesce("missing", F.array().cast("array<string>")), ",").alias("missing"),
                         *cols)


def jsonl_records(spark: SparkSession, path: str, glob: str | None = None, name_filter: str | None = None,
                  required=REQUIRED_FIELDS, schema: T.StructType = CORE_SCHEMA):
    """S2 + C1 + C2/C3: ``(good, quarantine)``.

    ``good`` holds conformed rows (``schema`` order; objects become JSON text).
    ``quarantine`` holds ``file_path, line, reason, missing`` for malformed lines
    (reason ``malformed``: not JSON or not an object) and rows with absent keys.
    Both are filters of :func:`jsonl_tagged`; use :func:`conform_tagged` to get
    them from a single scan.
    """
    tagged = jsonl_tagged(spark, path, glob, name_filter, required)
    good = tagged.filter(F.col("reason").isNull()).select("file_path", *conform(F.col("record"), schema))
    quarantine = tagged.filter(F.col("reason").isNotNull()).select(
        "file_path", "line", "reason", F.array_join(F.coalesce("missing", F.array().cast("array<string>")), ",")
        .alias("missing"))
    return good, quarantine


# ---------------------------------------------------------------------------
# Evaluation result documents
# ---------------------------------------------------------------------------

DETAILS = T.StructType([T.StructField(c, T.StringType()) for c in (
    "user_role", "permissions", "query", "model_response", "expected_rationale")])
PREDICTION = T.StructType([
    T.StructField("index", T.LongType()),
    T.StructField("prediction", T.StringType()),
    T.StructField("ground_truth", T.StringType()),
    T.StructField("correct", T.BooleanType()),
    T.StructField("full_details", DETAILS),
])
SPLIT_RESULT = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("total_samples", T.LongType()),
    T.StructField("errors", T.LongType()),
    T.StructField("predictions", T.ArrayType(PREDICTION)),
    T.StructField("details", T.ArrayType(PREDICTION)),
])
RESULTS_DOC = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("results", T.StructType([T.StructField(d, SPLIT_RESULT) for d in DIFFICULTIES])),
    T.StructField("_corrupt_record", T.StringType()),
])


def read_results(spark: SparkSession, path: str, glob: str = "*results*.json", multi_line: bool = True) -> tuple:
    """S4 + S5: flatten result documents to one row per prediction.

    All files are read in one job (one document per file with ``multi_line``,
    else one per line); the file path is the run key.
    Per document the first of easy/medium/hard present is used, its
    ``predictions`` array or else the legacy ``details``; missing labels become
    ``''``; both labels are normalised in the ``results`` dialect.  Returns
    ``(predictions, bad_files)``; a document matching no layout is a bad file.
    """
    docs = (spark.read.schema(RESULTS_DOC).option("multiLine", str(multi_line).lower()).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "true").json(path)
            .withColumn("file_path", F.col("_metadata.file_path")))
    r = F.col("results")
    chosen = F.coalesce(*[F.when(r[d].isNotNull(), F.struct(F.lit(d).alias("difficulty"), r[d].alias("res")))
                          for d in DIFFICULTIES])
    d2 = docs.withColumn("chosen", chosen)
    rows = F.coalesce(F.col("chosen.res.predictions"), F.col("chosen.res.details"))
    bad = d2.filter(F.col("_corrupt_record").isNotNull() | rows.isNull()).select(
        "file_path", F.when(F.col("_corrupt_record").isNotNull(), "unreadable").otherwise("no_layout").alias("reason"))
    good = d2.filter(F.col("_corrupt_record").isNull() & rows.isNotNull())
    flat = good.select("file_path", "model_name", F.col("chosen.difficulty").alias("difficulty"),
                       F.explode(rows).alias("p"))
    flat = flat.select("file_path", "model_name", "difficulty", F.col("p.index").alias("index"),
                       F.coalesce(F.col("p.prediction"), F.lit("")).alias("prediction_raw"),
                       F.coalesce(F.col("p.ground_truth"), F.lit("")).alias("ground_truth_raw"),
                       F.col("p.correct").alias("correct"), F.col("p.full_details").alias("full_details"))
    flat = flat.withColumn("prediction", normalize_label("prediction_raw", "results")) \
               .withColumn("ground_truth", normalize_label("ground_truth_raw", "results"))
    return flat, bad


def read_permission_examples(spark: SparkSession, db_path: str) -> DataFrame:
    """The ``examples`` table of a permission database written by K4."""
    try:
        return spark.read.parquet(f"{db_path}/examples")
    except AnalysisException as e:
        raise ValueError(f"permission database at {db_path} has no examples table") from e
