"""Lenient JSON handling on VARIANT (C4, C11) and Python-style value rendering."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .common import col


#: stands after the value in the array that a text is parsed in; what it closes can't be text
_END = "3f0c8a52-end-of-value"


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` taken once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def parse_json(c, control_chars: bool = False) -> Column:
    """The whole text as one JSON value (VARIANT), else null.

    Spark's parsers stop after the first value; here the text is parsed as the
    first of two elements, so anything after the value leaves null.  Repeated
    keys keep the last value in any session.  ``control_chars`` accepts raw
    control characters inside strings.  ``NaN`` and single quotes are not JSON.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None:  # read when the plan is made
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    held = F.concat(F.lit("["), col(c), F.lit(f',"{_END}"]'))
    if control_chars:
        v = F.from_json(held, "variant", {"allowUnquotedControlChars": "true", "allowNonNumericNumbers": "false",
                                          "allowSingleQuotes": "false"})
    else:
        v = F.try_parse_json(held)

    def first(parts: Column) -> Column:
        whole = (F.size(parts) == 2) & (F.try_variant_get(F.get(parts, 1), "$", "string") == _END)
        return F.when(whole, F.get(parts, 0))
    return bound(F.try_variant_get(v, "$", "array<variant>"), first)


def lenient_variant(c) -> Column:
    """C4 parse: JSON as is, else with every ``'`` replaced by ``"``; else null."""
    c = col(c)
    return F.coalesce(parse_json(c), parse_json(F.replace(c, F.lit("'"), F.lit('"'))))


def lenient_object(c) -> Column:
    """C4: the parsed object as ``map<string, variant>``; null when the text is
    empty, unparseable, or parses to something other than an object (a list or a
    scalar is ignored by callers)."""
    return lenient_variant(c).try_cast("map<string,variant>")


def parse_status(c) -> Column:
    """How C4 resolved the text: empty / object / object_requoted / not_object / invalid."""
    c = col(c)

    def kind(v: Column, name: str, otherwise) -> Column:
        return F.when(v.isNull(), otherwise).when(v.try_cast("map<string,variant>").isNotNull(), name).otherwise("not_object")
    requoted = bound(parse_json(F.replace(c, F.lit("'"), F.lit('"'))), lambda v: kind(v, "object_requoted", F.lit("invalid")))
    return F.when(c.isNull() | (c == ""), "empty").otherwise(bound(parse_json(c), lambda v: kind(v, "object", requoted)))


def type_name(vtype: Column) -> Column:
    """Python type name from ``schema_of_variant`` text."""
    def name(t: Column) -> Column:
        return (F.when(t.startswith("ARRAY"), "list")
                .when(t.startswith("OBJECT"), "dict")
                .when(t == "BOOLEAN", "bool")
                .when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "int")
                .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "float")
                .when(t == "STRING", "str")
                .when(t == "VOID", "NoneType")
                .otherwise(F.lower(t)))
    return bound(vtype, name)  # a schema reads the whole value: once


def py_text(v: Column, tname: Column) -> Column:
    """``str(value)`` for a scalar variant: booleans True/False, null None.

    Objects and lists render as compact JSON (Python would print its repr).
    A float keeps its fraction: ``30.0`` is not ``30``.
    """
    number = v.cast("string")
    return (F.when(tname == "bool", F.when(F.try_variant_get(v, "$", "boolean"), "True").otherwise("False"))
            .when(tname == "NoneType", "None")
            .when(tname.isin("dict", "list"), F.to_json(v))
            .when((tname == "float") & number.rlike(r"^-?[0-9]+$"), F.concat(number, F.lit(".0")))
            .otherwise(v.cast("string")))


# Fence and control-character patterns of the model-output cleaner.
FENCE_JSON = "```json"
FENCE = "```"
CONTROL_CHARS = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"


def extract_json_text(c) -> Column:
    """C11 cleaning: strip, drop a leading ```json then a leading ```, drop a
    trailing ```, strip again, remove control characters (keeps \\t \\n \\r).

    Written as a linear chain (each step reads the previous one once) so the
    expression stays small inside whole-stage codegen.
    """
    from .labels import py_strip
    t = py_strip(col(c))
    t = F.regexp_replace(t, "^" + FENCE_JSON, "")
    t = F.regexp_replace(t, "^" + FENCE, "")
    t = F.regexp_replace(t, FENCE + "\\z", "")
    t = py_strip(t)
    return F.regexp_replace(t, CONTROL_CHARS, "")


def extract_json(c) -> Column:
    """C11: parsed model output as VARIANT, raw control characters inside strings accepted; else null."""
    return parse_json(extract_json_text(c), control_chars=True)
