"""DuckDB SQL for the oracle check: bindings and label dialects as plain SQL.

The tables ``orders documents labels customer nation conversations part ...`` are
views in the checker.  Every query string built here must give the same rows as
the Spark query registered under the same name.
"""

from __future__ import annotations

from .bindings import DIRTY_LABELS

# ---------------------------------------------------------------------------
# Fixed values, typed in here a second time, so that the check does not read the
# tables that it checks: code points of white space, and the spellings of each
# class in the dialects.
# ---------------------------------------------------------------------------
SPACES = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199,
          8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288]
SHORT = {"full": ["full", "f"], "partial": ["partial", "p"], "rejected": ["rejected", "r"]}
RESULTS = {"full": ["full", "f", "allow", "approve", "complete"], "partial": ["partial", "p", "approve_partial"],
           "rejected": ["rejected", "r", "deny", "reject"]}
RESULTS_PARTS = [("full", ["approve", "allow", "complete"]), ("rejected", ["reject", "deny"]), ("partial", ["partial"])]
REPAIR = {"full": ["full", "f", "approve", "approved", "allow", "allowed", "accept", "complete", "grant", "permitted", "execute", "authorize"],
          "partial": ["partial", "p", "summary_only", "limited", "require_approval"],
          "rejected": ["rejected", "r", "reject", "deny", "denied", "refuse", "block", "blocked", "restrict"]}
REPAIR_FULL_PARTS = ["approve", "allow", "accept", "grant", "permit", "authorize", "execute"]
REPAIR_REJECTED_PARTS = ["deny", "reject", "refuse", "block", "restrict"]
REPAIR_PARTIAL_PARTS = ["partial", "limited", "only"]

WS = "||".join(f"chr({c})" for c in SPACES)


def q(s) -> str:
    if s is None:
        return "NULL"
    return "'" + s.replace("'", "''").replace("\t", "'||chr(9)||'") + "'"


def strip_lower(x: str) -> str:
    return f"lower(trim({x}, {WS}))"


def case_map(x: str, spellings: dict, default: str) -> str:
    whens = " ".join(f"WHEN {q(word)} THEN {q(label)}" for label, words in spellings.items() for word in words)
    return f"(CASE {x} {whens} ELSE {default} END)"


def any_contains(x: str, words) -> str:
    return "(" + " OR ".join(f"strpos({x}, {q(w)}) > 0" for w in words) + ")"


def normalize(x: str, dialect: str) -> str:
    if dialect == "distribution":
        t = strip_lower(x)
        return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN NULL ELSE {case_map(t, SHORT, t)} END)"
    if dialect == "eval":
        return f"coalesce({case_map(x, SHORT, 'NULL')}, 'rejected')"
    if dialect == "results":
        t = f"coalesce({strip_lower(x)}, 'none')"
        parts = " ".join(f"WHEN {any_contains(t, words)} THEN {q(label)}" for label, words in RESULTS_PARTS)
        return f"coalesce({case_map(t, RESULTS, 'NULL')}, CASE {parts} ELSE {t} END)"
    if dialect == "repair":
        t = strip_lower(x)
        a, r, p = (any_contains(t, words) for words in (REPAIR_FULL_PARTS, REPAIR_REJECTED_PARTS, REPAIR_PARTIAL_PARTS))
        return (f"(CASE WHEN {x} IS NULL OR {x} = '' THEN 'rejected' ELSE coalesce({case_map(t, REPAIR, 'NULL')}, "
                f"CASE WHEN ({a} AND {r}) OR {p} THEN 'partial' WHEN {a} THEN 'full' WHEN {r} THEN 'rejected' ELSE 'partial' END) END)")
    if dialect == "conservative":
        t = strip_lower(x)
        return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN 'rejected' ELSE coalesce({case_map(t, REPAIR, 'NULL')}, {x}) END)"
    raise ValueError(dialect)


def labelled_orders_sql() -> str:
    whens = " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(DIRTY_LABELS))
    return (f"SELECT o_orderkey AS id, o_orderpriority AS split, o_orderstatus AS status_label, "
            f"CASE o_orderkey % 16 {whens} ELSE o_orderstatus END AS expected_response FROM orders")


def _truth_clean() -> str:
    return "CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'full' ELSE 'partial' END"


def truth_sql() -> str:
    c = _truth_clean()
    return (f"SELECT doc_id AS id, CASE WHEN doc_id % 25 = 0 THEN substr({c}, 1, 1) "
            f"WHEN doc_id % 25 = 1 THEN upper({c}) ELSE {c} END AS truth_raw FROM labels")


def predictions_sql(predictor: str = "a") -> str:
    cut = 300 if predictor == "b" else 600
    return (f"SELECT doc_id AS id, source AS run, CASE WHEN n_chars < {cut} THEN 'rejected' "
            f"WHEN lang = 'en' THEN 'full' ELSE 'partial' END AS prediction FROM documents")


def scored_sql(predictor: str = "a") -> str:
    """Paired rows with truth normalised in the ``results`` dialect."""
    return (f"SELECT p.id, p.run, p.prediction, t.truth_raw, {normalize('t.truth_raw', 'results')} AS truth "
            f"FROM ({predictions_sql(predictor)}) p JOIN ({truth_sql()}) t USING (id)")


def _js(x: str) -> str:
    return f"'\"' || {x} || '\"'"


def permission_json_sql() -> str:
    k = "c_custkey"
    dept = (f"CASE WHEN {k} % 4 = 0 THEN '[' || {_js('c_mktsegment')} || ']' "
            f"WHEN {k} % 4 = 1 THEN '[' || {_js('c_mktsegment')} || ', ' || {_js('n_name')} || ']' "
            f"WHEN {k} % 4 = 2 THEN '[' || {_js('c_mktsegment')} || ', ' || {_js('n_name')} || ', \"Ops\"]' "
            f"ELSE '[' || {_js('c_mktsegment')} || ', ' || {_js('n_name')} || ', \"Ops\", \"Finance\", \"Legal\"]' END")
    level = "CASE WHEN c_acctbal < 0 THEN 'restricted' WHEN c_acctbal < 5000 THEN 'standard' ELSE 'elevated' END"
    actions = (f"CASE {k} % 5 WHEN 0 THEN '[\"read\"]' WHEN 1 THEN '[\"read\", \"write\"]' "
               f"WHEN 2 THEN '[\"read\", \"write\", \"approve\"]' WHEN 3 THEN '[\"read\", \"write\", \"approve\", \"export\"]' "
               f"WHEN 4 THEN '[\"read\", \"write\", \"approve\", \"export\", \"delete\"]' END")
    timeout = f"CASE WHEN {k} % 10 = 0 THEN '\"30\"' ELSE CAST((c_nationkey % 6 + 1) * 15 AS VARCHAR) END"
    parts = [
        f"'\"department\": ' || ({dept})",
        f"'\"access_level\": ' || {_js('(' + level + ')')}",
        f"'\"allowed_actions\": ' || ({actions})",
        f"'\"session_timeout\": ' || ({timeout})",
        f"CASE WHEN {k} % 3 <> 1 THEN '\"automation_restriction\": ' || CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END END",
        f"CASE WHEN {k} % 2 = 0 THEN '\"deadline\": \"2025-' || lpad(CAST({k} % 12 + 1 AS VARCHAR), 2, '0') || '-15\"' END",
        f"CASE WHEN {k} % 3 = 0 THEN '\"budget_limit\": ' || CAST({k} % 50 AS VARCHAR) || '.5' END",
        f"CASE WHEN {k} % 4 = 0 THEN '\"location_restriction\": [' || {_js('n_name')} || ']' END",
        f"CASE WHEN {k} % 7 = 0 THEN '\"collaboration_access\": []' "
        f"WHEN {k} % 7 = 1 THEN '\"collaboration_access\": [' || {_js('c_mktsegment')} || ']' END",
        f"CASE WHEN {k} % 9 = 0 THEN '\"approver\": null' END",
    ]
    obj = "'{' || concat_ws(', ', " + ", ".join(parts) + ") || '}'"
    single = f"replace({obj}, '\"', '''')"
    return (f"CASE WHEN {k} % 23 = 0 THEN NULL WHEN {k} % 19 = 0 THEN '' "
            f"WHEN {k} % 29 = 0 THEN 'read, write, export' "
            f"WHEN {k} % 17 = 0 THEN '[' || {_js('c_mktsegment')} || ']' "
            f"WHEN {k} % 13 = 0 THEN replace({single}, 'true', 'True') "
            f"WHEN {k} % 11 = 0 THEN {single} ELSE {obj} END")


def examples_sql() -> str:
    return (f"SELECT c_custkey AS example_id, c_mktsegment || '_' || replace(n_name, ' ', '_') AS user_role, "
            f"{permission_json_sql()} AS permissions, "
            f"'Request from ' || c_name || ' to review the ' || lower(c_mktsegment) || ' account ledger' AS query, "
            f"CASE WHEN c_acctbal < 0 THEN 'rejected' WHEN c_acctbal < 5000 THEN 'partial' ELSE 'full' END AS expected_response "
            f"FROM customer JOIN nation ON c_nationkey = n_nationkey")


def lenient_object_sql(x: str) -> str:
    """C4 in SQL: JSON text of the object, or NULL when it is not an object."""
    alt = f"replace({x}, '''', '\"')"
    parsed = f"(CASE WHEN json_valid({x}) THEN {x} WHEN json_valid({alt}) THEN {alt} END)"
    return f"(CASE WHEN json_type({parsed}) = 'OBJECT' THEN {parsed} END)"


def entries_sql() -> str:
    """CTE body: one row per (example_id, field) with the JSON value and its type."""
    return (f"SELECT example_id, field, json_extract(j, '$.\"' || field || '\"') AS v, "
            f"json_type(json_extract(j, '$.\"' || field || '\"')) AS jt "
            f"FROM (SELECT example_id, j, unnest(json_keys(j)) AS field FROM "
            f"(SELECT example_id, {lenient_object_sql('permissions')} AS j FROM ({examples_sql()})) "
            f"WHERE j IS NOT NULL)")


def py_text_sql(v: str, jt: str) -> str:
    return (f"(CASE {jt} WHEN 'BOOLEAN' THEN (CASE WHEN json_extract_string({v}, '$') = 'true' THEN 'True' ELSE 'False' END) "
            f"WHEN 'NULL' THEN 'None' WHEN 'OBJECT' THEN CAST({v} AS VARCHAR) WHEN 'ARRAY' THEN CAST({v} AS VARCHAR) "
            f"ELSE json_extract_string({v}, '$') END)")


def type_name_sql(jt: str) -> str:
    return (f"(CASE {jt} WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'dict' WHEN 'BOOLEAN' THEN 'bool' "
            f"WHEN 'BIGINT' THEN 'int' WHEN 'UBIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' "
            f"WHEN 'VARCHAR' THEN 'str' WHEN 'NULL' THEN 'NoneType' ELSE lower({jt}) END)")


def value_counts_sql() -> str:
    """P2 counting rule as SQL: field, value, value_kind, n."""
    return f"""
SELECT field, value, value_kind, count(*) AS n FROM (
  SELECT field, {py_text_sql('v', 'jt')} AS value,
         CASE WHEN jt IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'number' ELSE 'text' END AS value_kind
  FROM ({entries_sql()}) WHERE jt <> 'ARRAY'
  UNION ALL
  SELECT field, {py_text_sql('x', 'json_type(x)')}, 'text' FROM (
    SELECT field, unnest(from_json(v, '["JSON"]')) AS x FROM ({entries_sql()}) WHERE jt = 'ARRAY')
  UNION ALL
  SELECT field || '_count', CAST(json_array_length(v) AS VARCHAR), 'number' FROM ({entries_sql()}) WHERE jt = 'ARRAY'
) GROUP BY ALL"""


def pct_sql(n: str, total: str) -> str:
    return f"round(CAST({n} AS DOUBLE) / {total} * 100.0, 6)"


def generated_sql() -> str:
    """SQL twin of ``bindings.generated_outputs``."""
    k = "doc_id"
    from .bindings import GENERATED_LABELS
    label = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(GENERATED_LABELS)) + " END"
    perms = "struct_pack(department := [lang], access_level := 'standard')"
    head = "user_role := 'Analyst_' || lang"
    rest = f"query := text, expected_response := {label}"
    rat = "rationale := 'Granted for ' || source"
    with_obj = (f"CASE WHEN {k} % 11 = 0 THEN to_json(struct_pack({head}, permissions := {perms}, {rest}))::VARCHAR "
                f"ELSE to_json(struct_pack({head}, permissions := {perms}, {rest}, {rat}))::VARCHAR END")
    with_str = f"to_json(struct_pack({head}, permissions := 'none', {rest}, {rat}))::VARCHAR"
    p1 = f"(CASE WHEN {k} % 13 = 0 THEN {with_str} ELSE {with_obj} END)"
    p2 = f"(CASE WHEN {k} % 17 = 0 THEN left({p1}, length({p1}) - 1) ELSE {p1} END)"
    p3 = f"(CASE WHEN {k} % 19 = 0 THEN '[\"not\", \"an\", \"object\"]' ELSE {p2} END)"
    p4 = f"(CASE WHEN {k} % 5 = 0 THEN chr(7) || {p3} ELSE {p3} END)"
    text = (f"CASE WHEN {k} % 3 = 0 THEN '```json' || chr(10) || {p4} || chr(10) || '```' "
            f"WHEN {k} % 3 = 1 THEN '```' || chr(10) || {p4} || chr(10) || '```' ELSE {p4} END")
    return f"SELECT doc_id, source, {text} AS model_output FROM documents"


def extract_json_sql(x: str) -> str:
    """C11 cleaning + parse in SQL: JSON text or NULL."""
    t0 = f"trim({x}, {WS})"
    t1 = f"(CASE WHEN starts_with({t0}, '```json') THEN substr({t0}, 8) ELSE {t0} END)"
    t2 = f"(CASE WHEN starts_with({t1}, '```') THEN substr({t1}, 4) ELSE {t1} END)"
    t3 = f"(CASE WHEN ends_with({t2}, '```') THEN left({t2}, length({t2}) - 3) ELSE {t2} END)"
    t4 = f"regexp_replace(trim({t3}, {WS}), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')"
    nl = "chr(10)"
    r = f"replace({t4}, {nl}, '\\n')"
    for a, b in ((f"'\\n  '", f"{nl} || '  '"), (f"'\\n}}'", f"{nl} || '}}'"), (f"'\\n{{'", f"{nl} || '{{'"),
                 (f"'[\\n'", f"'[' || {nl}"), (f"'\\n]'", f"{nl} || ']'")):
        r = f"replace({r}, {a}, {b})"
    return f"(CASE WHEN json_valid({t4}) THEN {t4} WHEN json_valid({r}) THEN {r} END)"
