"""Record cleaning: C1-C3 (required fields, projection, schema conformance) and
C9-C12 (generated-row validation, exact dedup, model-output JSON, provenance).

Records arrive as raw JSON text; the decision "key absent" vs "key present but
null" is made on the text (C1), before any schema is applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import col, evaluate_once
from ..functions.json import extract_json
from ..functions.labels import GENERATED_FULL_WORDS, lower_strip, py_strip

# Required record fields (C2 also keeps ``rationale`` when present).
REQUIRED_FIELDS = ["user_role", "permissions", "query", "expected_response"]
GENERATED_REQUIRED = ["user_role", "permissions", "query", "expected_response", "rationale"]
MIN_QUERY_CHARS = 20

# C2 keeps the required fields plus ``rationale``; synthetic metadata is dropped.
# Target schema of the examples table (F1).
EXAMPLE_SCHEMA = T.StructType([
    T.StructField("user_role", T.StringType()),
    T.StructField("permissions", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("expected_response", T.StringType()),
    T.StructField("rationale", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("query_timestamp", T.StringType()),
])
CORE_SCHEMA = T.StructType(EXAMPLE_SCHEMA.fields[:5])


def record_keys(v: Column) -> Column:
    """Keys of a parsed JSON object (null when it is not an object)."""
    return F.map_keys(v.try_cast("map<string,variant>"))


def missing_fields(v: Column, required=REQUIRED_FIELDS) -> Column:
    """Sorted array of required keys absent from the record (present-but-null passes)."""
    req = F.array(*[F.lit(x) for x in required])
    return F.array_sort(F.array_except(req, F.coalesce(record_keys(v), F.array().cast("array<string>"))))


def conform(v: Column, schema: T.StructType = EXAMPLE_SCHEMA) -> list:
    """Columns of ``schema`` in its order, read from variant record ``v``.

    Absent keys give null, extra keys are dropped, objects/lists bound for a
    string column become JSON text, and a value that cannot be cast raises
    (``variant_get`` is the raising cast).
    """
    out = []
    for f in schema.fields:
        path = f"$.{f.name}"
        if isinstance(f.dataType, T.StringType):
            out.append(F.variant_get(v, path, "string").alias(f.name))
        else:
            out.append(F.variant_get(v, path, f.dataType.simpleString()).alias(f.name))
    return out


def validate_generated(v: Column) -> Column:
    """Rejection reason for a generated record (null when valid).

    Order of checks: not an object; a required field missing; label not one of
    full/f/allow/approve after lower+strip; query shorter than 20 characters after
    strip; permissions not an object.
    """
    keys = record_keys(v)
    req = F.array(*[F.lit(x) for x in GENERATED_REQUIRED])
    label = F.coalesce(lower_strip(F.variant_get(v, "$.expected_response", "string")), F.lit("none"))
    query = F.coalesce(py_strip(F.variant_get(v, "$.query", "string")), F.lit(""))
    perm_is_obj = F.variant_get(v, "$.permissions", "variant").try_cast("map<string,variant>").isNotNull()
    return (F.when(keys.isNull(), "not_object")
            .when(F.size(F.array_except(req, keys)) > 0, "missing_fields")
            .when(~label.isin(*GENERATED_FULL_WORDS), "bad_label")
            .when(F.length(query) < MIN_QUERY_CHARS, "short_query")
            .when(~perm_is_obj, "permissions_not_object")
            .otherwise(F.lit(None).cast("string")))


def query_hash(text) -> Column:
    """C10 key: md5 of lower-cased, stripped text."""
    return F.md5(lower_strip(col(text)))


def dedup_exact(df: DataFrame, text_col: str, id_col: str, columns=None) -> DataFrame:
    """Keep one row per ``md5(lower(strip(text)))``, the one with the smallest id.

    A hash aggregate finds the smallest id of each key (combined on the map side, so
    a hot group sends one small row per partition).  Adds ``query_hash``.  With
    ``columns`` beyond the id, rows are then picked by a semi join on (key, id);
    ids must be unique.
    """
    keyed = df.withColumn("query_hash", query_hash(text_col))
    keep = list(dict.fromkeys([id_col, *(columns or keyed.columns), "query_hash"]))
    best = keyed.groupBy("query_hash").agg(F.min(id_col).alias(id_col))
    if set(keep) == {id_col, "query_hash"}:
        return best.select(*keep)
    return keyed.select(*keep).join(best, ["query_hash", id_col], "left_semi").select(*keep)


def duplicate_report(df: DataFrame, text_col: str) -> DataFrame:
    """C10 counts: rows, distinct keys, surplus duplicates (one row)."""
    h = df.select(query_hash(text_col).alias("h"))
    return h.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("h").alias("n_unique"),
                 (F.count(F.lit(1)) - F.count_distinct("h")).alias("n_duplicates"))


def parse_model_output(df: DataFrame, text_col: str, out: str = "generated") -> DataFrame:
    """C11: add the parsed model output (VARIANT, null when unparseable), parsed once per row."""
    return evaluate_once(df, **{out: extract_json(text_col)})


def tag_provenance(df: DataFrame, source_index_col: str, strategy_col: str) -> DataFrame:
    """``source_index``, ``generation_strategy`` and ``synthetic = true``."""
    return df.withColumns({
        "source_index": F.col(source_index_col).cast("int"),
        "generation_strategy": F.col(strategy_col),
        "synthetic": F.lit(True),
    })
