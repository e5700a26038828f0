"""Semi-structured field profiling: C4, P1-P8, K4.

Permissions are parsed once to ``map<string, variant>`` (C4) and exploded to one
row per (example, field).  Counting is a plain ``groupBy`` with partial
aggregation, so hot values (``department``) cost nothing extra; ranking happens
only after the aggregate, on a bounded candidate set (see :func:`top_n_with_tail`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import attach_one_row, evaluate_once, materialize, ratio, spread
from ..functions.json import bound, lenient_object, lenient_variant, parse_json, parse_status, py_text, type_name
from ..functions.labels import PY_WHITESPACE

# How many values a report ranks, and what its last line says of the others.
TAIL, TAIL_ROLES, TAIL_TOKENS = " more", " more roles", " more permissions"
TOP_ROLES = 30
TOP_VALUES = 20
TOP_TOKENS = 20


def _tail(what: str):
    return lambda k: F.concat(F.lit("... and "), k.cast("string"), F.lit(what))


def top_n_with_tail(counts: DataFrame, group_cols, value_col: str, n_col: str, top: int,
                    tail_text, extra=(), buckets: int = 64) -> DataFrame:
    """Exact top-``top`` rows per group by (count desc, value asc, ``extra`` asc) plus one tail row.

    Skew-safe: ranks are first taken inside (group, hash bucket of the value), so
    a group with millions of distinct values never meets in one task, and only
    ``buckets * top`` candidates per group meet.  A bucket's candidates bring its number of
    values and its sum along (its first one counts), so the group's totals need no second
    pass over the counts.  The tail row (rank ``top + 1``) carries the number of
    remaining values and the sum of their counts: group totals less what is ranked.

    Output: ``group_cols..., rank, value, extra..., n, n_values, group_total, is_tail``
    (``extra`` is null in the tail).  ``tail_text(k)`` builds the tail row's value
    from the column of remaining count.
    """
    g, extra = list(group_cols), list(extra)
    order = [F.desc(n_col), F.asc_nulls_first(value_col), *[F.asc_nulls_first(x) for x in extra]]
    types = dict(counts.dtypes)
    in_bucket = Window.partitionBy(*g, F.pmod(F.xxhash64(value_col, *extra), F.lit(buckets)))
    cand = counts.withColumns({"__r": F.row_number().over(in_bucket.orderBy(*order)),
                               "__bn": F.count(F.lit(1)).over(in_bucket), "__bs": F.sum(n_col).over(in_bucket)}).filter(F.col("__r") <= top)
    of_group = Window.partitionBy(*g)
    ranked = cand.withColumns({"rank": F.row_number().over(of_group.orderBy(*order)),
                               "n_values": F.sum(F.when(F.col("__r") == 1, F.col("__bn"))).over(of_group),
                               "group_total": F.sum(F.when(F.col("__r") == 1, F.col("__bs"))).over(of_group)}).filter(F.col("rank") <= top)
    out = ranked.withColumn("__top", F.sum(n_col).over(of_group))

    def row(rank, value, others, n, tail: bool):
        return F.struct(rank.cast("bigint").alias("rank"), value.alias(value_col), *[o.alias(x) for x, o in zip(extra, others)],
                        n.alias(n_col), "n_values", "group_total", F.lit(tail).alias("is_tail"))
    own = row(F.col("rank"), F.col(value_col), [F.col(x) for x in extra], F.col(n_col), False)
    tail = row(F.lit(top + 1), tail_text(F.col("n_values") - top), [F.lit(None).cast(types[x]) for x in extra],
               F.col("group_total") - F.col("__top"), True)
    # the first ranked row of a group brings the group's tail along
    return out.select(*g, F.inline(F.when((F.col("rank") == 1) & (F.col("n_values") > top), F.array(own, tail)).otherwise(F.array(own))))


# ---------------------------------------------------------------------------
# C4
# ---------------------------------------------------------------------------

def lenient_json_parse(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """C4 per row: ``id, parse_status, n_fields, field_names`` (sorted, comma-joined)."""
    out = evaluate_once(df, __m=lenient_object(text_col))
    return out.select(id_col, parse_status(text_col).alias("parse_status"),
                      F.coalesce(F.size("__m"), F.lit(0)).alias("n_fields"),
                      F.coalesce(F.array_join(F.array_sort(F.map_keys("__m")), ","), F.lit("")).alias("field_names"))


# ---------------------------------------------------------------------------
# entries: one row per (example, field)
# ---------------------------------------------------------------------------

def _permissions(df: DataFrame, perm_col: str) -> str:
    """The permissions column, or the one kept in ``full_details`` where the table has none."""
    return perm_col if perm_col in df.columns or "full_details" not in df.columns else f"full_details.{perm_col}"


def permission_entries(df: DataFrame, id_col: str, perm_col: str) -> DataFrame:
    """``id, field, v (variant), tname`` for every field of every object."""
    texts = spread(df.select(id_col, F.col(_permissions(df, perm_col)).alias("__p")))
    e = texts.select(id_col, F.explode(lenient_object("__p")).alias("field", "v"))
    return e.withColumn("tname", type_name(F.schema_of_variant("v")))


def _value_rows(field, v, tname, with_lengths: bool = True, with_kind: bool = True):
    """Per (field, value) entry, the value rows it contributes, as one array:
    each list element as text (plus ``<field>_count`` with the list length), or
    the scalar itself (numbers keep kind ``number``)."""
    def row(f, val, kind):
        parts = [f.alias("field"), val.alias("value")]
        if with_kind:
            parts.append(kind.alias("value_kind"))
        return F.struct(*parts)

    def items(arr):
        each = F.transform(arr, lambda x: row(field, bound(type_name(F.schema_of_variant(x)), lambda t: py_text(x, t)), F.lit("text")))
        if with_lengths:
            each = F.concat(each, F.array(row(F.concat(field, F.lit("_count")), F.size(arr).cast("string"),
                                              F.lit("number"))))
        return each
    # numbers that count by value have one text for 30 and 30.0
    text = F.when(tname.isin("int", "float"), v.cast("string")).otherwise(py_text(v, tname)) if with_kind else py_text(v, tname)
    scalar = F.array(row(field, text,
                         F.when(tname.isin("int", "float"), F.lit("number")).otherwise(F.lit("text"))))
    return F.when(tname == "list", bound(v.try_cast("array<variant>"), items)).otherwise(scalar)


def field_value_counts(entries: DataFrame) -> DataFrame:
    """P2/P3 counting rule: ``field, value, value_kind, n``.

    Lists count each element as text and add pseudo-field ``<field>_count`` with
    the list length (a number); booleans count as ``True``/``False``; numbers
    count by value (kind ``number``, so ``30`` and ``"30"`` differ); other values
    as text.  One pass: each entry emits its rows through one ``inline``.
    """
    rows = entries.select(F.inline(_value_rows(F.col("field"), F.col("v"), F.col("tname"))))
    return rows.groupBy("field", "value", "value_kind").agg(F.count(F.lit(1)).alias("n"))


def field_value_top_n(df: DataFrame, id_col: str, perm_col: str, top: int = TOP_VALUES) -> DataFrame:
    """Per field, top values with percent of the field's occurrences + tail row.

    Output: ``field, rank, value, value_kind, n, pct, n_values, total_occurrences``.
    Values are ranked by (count desc, value asc, kind asc).
    """
    counts = field_value_counts(permission_entries(df, id_col, perm_col))
    t = top_n_with_tail(counts, ["field"], "value", "n", top,
                        _tail(TAIL), extra=["value_kind"])
    return t.select("field", "rank", "value",
                    F.when(F.col("is_tail"), F.lit("tail")).otherwise(F.col("value_kind")).alias("value_kind"),
                    "n", ratio("n", "group_total", 100.0).alias("pct"),
                    "n_values", F.col("group_total").alias("total_occurrences"))


def field_list_lengths(df: DataFrame, id_col: str, perm_col: str) -> DataFrame:
    """List-length distribution per list field (pseudo-field ``<field>_count``)."""
    e = permission_entries(df, id_col, perm_col).filter(F.col("tname") == "list")
    return (e.select(F.concat(F.col("field"), F.lit("_count")).alias("field"),
                     F.size(F.col("v").try_cast("array<variant>")).alias("list_length"))
             .groupBy("field", "list_length").agg(F.count(F.lit(1)).alias("n")))


def field_types(df: DataFrame, id_col: str, perm_col: str) -> DataFrame:
    """Sorted set of observed Python type names per field, comma-joined."""
    e = permission_entries(df, id_col, perm_col)
    return e.groupBy("field").agg(F.array_join(F.array_sort(F.collect_set("tname")), ", ").alias("types"))


def field_distinct(df: DataFrame, id_col: str, perm_col: str) -> DataFrame:
    """P5: unique values and total occurrences per field (pseudo-fields included).

    ``n_fields`` repeats the number of unique fields on every row.
    """
    counts = field_value_counts(permission_entries(df, id_col, perm_col))
    per = materialize(counts.groupBy("field").agg(F.count(F.lit(1)).alias("unique_values"),
                                                  F.sum("n").alias("total_occurrences")))
    nf = per.agg(F.count(F.lit(1)).alias("n_fields"))
    return attach_one_row(per, nf)


def distinct_sketches(df: DataFrame, batch_col: str, perm_col: str, log2_size: int = 14) -> DataFrame:
    """P5, opt-in approximation: per batch and field a mergeable sketch of its values (HyperLogLog,
    ``2**log2_size`` registers: standard error 0.8 % at 14) and its occurrences.  Stored per
    batch, sketches are merged (:func:`merge_sketches`) without reading old rows again."""
    rows = permission_entries(df, batch_col, perm_col).select(batch_col, F.inline(_value_rows(F.col("field"), F.col("v"), F.col("tname"))))
    key = F.concat_ws(":", "value_kind", "value")  # 30 and "30" differ, as in the exact count
    return rows.groupBy(batch_col, "field").agg(F.hll_sketch_agg(key, log2_size).alias("sketch"), F.count(F.lit(1)).alias("occurrences"))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """The sketches of all batches as one per field."""
    return sketches.groupBy("field").agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("occurrences").alias("occurrences"))


def approx_distinct(sketches: DataFrame) -> DataFrame:
    """``field, approx_values, total_occurrences`` of merged sketches."""
    return sketches.select("field", F.hll_sketch_estimate("sketch").alias("approx_values"), F.col("occurrences").alias("total_occurrences"))


def mean_fields(df: DataFrame, perm_col: str) -> DataFrame:
    """Mean number of fields over rows whose parse gave a non-empty object."""
    sizes = evaluate_once(df.select(F.col(_permissions(df, perm_col)).alias("__p")), k=F.size(lenient_object("__p")))
    return sizes.filter(F.col("k") > 0).agg(
        F.count(F.lit(1)).alias("n_rows_with_fields"), F.round(F.avg("k"), 6).alias("mean_fields"))


def role_top_n(df: DataFrame, role_col: str = "user_role", top: int = TOP_ROLES) -> DataFrame:
    """Role counts with percent of **all rows**, top ``top`` + one tail row.

    Output: ``rank, role, n, pct, n_roles``.
    """
    counts = df.groupBy(F.col(role_col).alias("role")).agg(F.count(F.lit(1)).alias("n"))
    t = top_n_with_tail(counts, [], "role", "n", top,
                        _tail(TAIL_ROLES))
    return t.select("rank", "role", "n", ratio("n", "group_total", 100.0).alias("pct"),
                    F.col("n_values").alias("n_roles"))


# ---------------------------------------------------------------------------
# Permission tokens from mixed encodings
# ---------------------------------------------------------------------------

# Fixed value: the bracket pattern searched in free text (case-insensitive).
PERMISSION_LIST_PATTERN = r"(?i)permissions[^:]*:\s*\[([^\]]+)\]"


def _split_tokens(text):
    parts = F.split(text, ",")
    return F.transform(parts, lambda p: F.btrim(F.btrim(p, F.lit(PY_WHITESPACE)), F.lit("\"'")))


def permission_token_lists(df: DataFrame, perm_col: str = "permissions", request_col: str | None = None,
                           messages_col: str | None = None, split_mode: str = "json") -> DataFrame:
    """Per row, the token list P7 would count (``tokens`` array, possibly empty).

    Order of sources: ``perm_col`` - a JSON list gives its items, a non-JSON
    string gives itself (``split_mode='json'``) or its comma-split parts
    (``'comma'``, P8), a non-empty object gives nothing (objects belong to P2);
    only when that value is empty (null, ``''``, ``[]``, ``{}``) the bracket
    pattern in ``request_col`` is tried, then the first message mentioning
    "permissions" whose content matches.
    """
    p = F.col(perm_col)
    empty = F.array().cast("array<string>")
    none = F.lit(None).cast("array<string>")
    if split_mode == "json":
        fallback = F.array(p)
    elif split_mode == "comma":
        fallback = F.transform(F.split(p, ","), lambda x: F.btrim(x, F.lit(PY_WHITESPACE)))
    else:
        raise ValueError(split_mode)

    def of_value(v):
        as_list, as_obj = v.try_cast("array<variant>"), v.try_cast("map<string,variant>")
        listed = F.transform(as_list, lambda x: x.cast("string"))
        return (F.when(v.isNull(), fallback)
                .when(as_list.isNotNull(), F.when(F.size(as_list) > 0, listed).otherwise(none))
                .when(as_obj.isNotNull(), F.when(F.size(as_obj) > 0, empty).otherwise(none))
                .otherwise(empty))
    # null = undecided (falsy in the reference): try the next source
    tokens = F.when(p.isNull() | (p == ""), none).otherwise(bound(parse_json(p), of_value))
    if request_col:
        m = F.regexp_extract(F.col(request_col), PERMISSION_LIST_PATTERN, 1)
        tokens = F.coalesce(tokens, F.when(F.coalesce(m, F.lit("")) != "", _split_tokens(m)))
    if messages_col:
        hit = F.filter(F.col(messages_col), lambda x: F.lower(x["content"]).contains("permissions")
                       & (F.regexp_extract(x["content"], PERMISSION_LIST_PATTERN, 1) != ""))
        first = F.get(hit, 0)
        tokens = F.coalesce(tokens, F.when(first.isNotNull(), _split_tokens(
            F.regexp_extract(first["content"], PERMISSION_LIST_PATTERN, 1))))
    tokens = F.coalesce(tokens, empty)
    return df.withColumn("tokens", tokens)


def permission_tokens(df: DataFrame, top: int = TOP_TOKENS, **kw) -> DataFrame:
    """Token frequency, top ``top`` with percent of **rows**.

    Output: ``rank, token, n, pct, n_tokens, total_occurrences, mean_per_row``.
    """
    t = permission_token_lists(df, **kw)
    # one pass: every row adds a marker (null token), so the marker's count is
    # the row count and the other groups are the token counts
    marked = t.select(F.explode(F.concat("tokens", F.array(F.lit(None).cast("string")))).alias("token"))
    all_counts = materialize(marked.groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    rows = all_counts.filter(F.col("token").isNull()).select(F.col("n").alias("n_rows"))
    counts = all_counts.filter(F.col("token").isNotNull())
    ranked = top_n_with_tail(counts, [], "token", "n", top,
                             _tail(TAIL_TOKENS))
    ranked = attach_one_row(ranked.filter(~F.col("is_tail")), rows)
    return ranked.select("rank", "token", "n", ratio("n", "n_rows", 100.0).alias("pct"),
                         F.col("n_values").alias("n_tokens"), F.col("group_total").alias("total_occurrences"),
                         ratio("group_total", "n_rows").alias("mean_per_row"))


# ---------------------------------------------------------------------------
# K4: permission database as four tables
# ---------------------------------------------------------------------------

def _tagged(df: DataFrame, role_col: str, perm_col: str) -> DataFrame:
    """``tag, a, b`` rows to count: (role, name, -) for every row, (type, field, type name) for
    every field of an object and (value, field, text) for each of its values."""
    texts = spread(df.select(F.col(role_col).alias("role"), F.col(_permissions(df, perm_col)).alias("__p")))
    parsed = evaluate_once(texts, __m=lenient_object("__p"))

    def row(tag: str, a, b):
        return F.struct(F.lit(tag).alias("tag"), a.cast("string").alias("a"), b.cast("string").alias("b"))

    def of_field(e):
        def rows(tname):
            values = F.transform(_value_rows(e["key"], e["value"], tname, False, False), lambda r: row("value", r["field"], r["value"]))
            return F.concat(F.array(row("type", e["key"], tname)), values)
        return bound(type_name(F.schema_of_variant(e["value"])), rows)

    fields = F.flatten(F.transform(F.map_entries("__m"), of_field))
    none = F.array().cast("array<struct<tag:string,a:string,b:string>>")
    return parsed.select(F.inline(F.concat(F.array(row("role", F.col("role"), F.lit(None))), F.coalesce(fields, none))))


def permission_database(df: DataFrame, id_col: str = "example_id", role_col: str = "user_role",
                        perm_col: str = "permissions") -> dict:
    """K4: ``metadata``, ``roles``, ``fields``, ``values`` and ``examples`` frames.

    Unlike P2, every value counts by its text (``30`` and ``"30"`` are one key),
    there are no ``_count`` pseudo-fields, and empty roles are skipped.  One aggregate over
    tagged rows, which parses each text once, counts roles, types and values together; the
    other tables are parts of its result.  ``examples`` is one more pass, row by row.
    """
    counts = materialize(_tagged(df, role_col, perm_col).groupBy("tag", "a", "b").agg(F.count(F.lit(1)).alias("count")))
    all_roles = counts.filter(F.col("tag") == "role")  # null and empty roles included: their sum is the row count
    meta = all_roles.agg(F.sum("count").cast("bigint").alias("total_samples"))
    roles = all_roles.filter(F.col("a").isNotNull() & (F.col("a") != "")).select(F.col("a").alias("role"), "count")
    roles = attach_one_row(roles, meta).select("role", "count", ratio("count", "total_samples", 100.0).alias("percentage"))
    vals = counts.filter(F.col("tag") == "value").select(F.col("a").alias("field"), F.col("b").alias("value"), "count")
    per_field = vals.groupBy("field").agg(F.count(F.lit(1)).alias("unique_values"), F.sum("count").alias("field_total"))
    values = vals.join(per_field, "field").select(
        "field", "value", "count", ratio("count", "field_total", 100.0).alias("percentage"))
    types = counts.filter(F.col("tag") == "type").groupBy(F.col("a").alias("field")).agg(F.array_sort(F.collect_set("b")).alias("types"))
    types = types.select("field", F.array_join("types", ", ").alias("types"))
    fields = types.join(per_field, "field").select("field", "types", "unique_values")
    text = bound(lenient_variant(perm_col), lambda v: F.when(v.try_cast("map<string,variant>").isNotNull(), F.to_json(v)).otherwise(F.lit("{}")))
    kept = [c for c in dict.fromkeys((id_col, role_col, perm_col, "expected_response", "query")) if c in df.columns]
    examples = spread(df.select(*kept)).select(F.col(id_col).alias("index"), F.col(role_col).alias("user_role"), text.alias("permissions"),
                         *[c for c in ("expected_response", "query") if c in df.columns])
    return {"metadata": meta, "roles": roles, "fields": fields, "values": values, "examples": examples}
