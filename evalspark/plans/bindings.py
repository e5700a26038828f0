"""Bindings: how the driver tables stand in for the labelled decision data.

Each binding is a DataFrame derived from the given tables with built-in
expressions only, so its size grows with the tables.  ``plans/oracle.py`` holds
the same definitions as DuckDB SQL.

* labelled orders: ``orders`` -> raw labels (status letters F/O/P plus dirty
  trap strings), split key ``o_orderpriority``.
* predictions: ``documents`` (+ ``labels`` for truth) -> truth / prediction / run.
* examples: ``customer`` + ``nation`` -> a permission JSON text per row with list,
  string, int, float, bool and null members, plus lenient-parse variants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (test inputs): dirty label strings by ``o_orderkey % 16``; keys
# 14 and 15 use the order status letter itself.
# ---------------------------------------------------------------------------
DIRTY_LABELS = [
    "full", "P", "r", "approve", "denied", "incomplete", "not allowed", "access denied",
    "approve competitor analysis, reject budget change", "summary_only", None, "", " Partial\t",
    "rejected",
]

def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(key, values, default):
    e = None
    for i, v in enumerate(values):
        lit = F.lit(v).cast("string")
        e = F.when(key == i, lit) if e is None else e.when(key == i, lit)
    return e.otherwise(default)


def labelled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, split, status_label, expected_response`` over all orders."""
    o = read(spark, sf_dir, "orders")
    dirty = _case(F.col("o_orderkey") % 16, DIRTY_LABELS, F.col("o_orderstatus"))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("split"),
                    F.col("o_orderstatus").alias("status_label"), dirty.alias("expected_response"))


def _truth_raw():
    clean = (F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "full")
             .otherwise("partial"))
    k = F.col("doc_id") % 25
    # a few corrupted spellings: first letter, upper case
    return F.when(k == 0, F.substring(clean, 1, 1)).when(k == 1, F.upper(clean)).otherwise(clean)


def _prediction_rule(prefix: str = ""):
    n = F.col("n_chars")
    if prefix == "b":  # second predictor for paired comparisons
        return F.when(n < 300, "rejected").when(F.col("lang") == "en", "full").otherwise("partial")
    return F.when(n < 600, "rejected").when(F.col("lang") == "en", "full").otherwise("partial")


def predictions(spark: SparkSession, sf_dir: str, predictor: str = "a") -> DataFrame:
    """Prediction side: ``id, run, prediction`` for every document."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("run"),
                    _prediction_rule(predictor).alias("prediction"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth side: ``id, truth_raw`` for every labelled document."""
    lab = read(spark, sf_dir, "labels")
    return lab.select(F.col("doc_id").alias("id"), _truth_raw().alias("truth_raw"))


def _jstr(c):
    return F.concat(F.lit('"'), c, F.lit('"'))


def permission_json():
    """Column expression building the permission JSON text from customer+nation."""
    k = F.col("c_custkey")
    seg, nat = F.col("c_mktsegment"), F.col("n_name")
    dept = (F.when(k % 4 == 0, F.concat(F.lit("["), _jstr(seg), F.lit("]")))
            .when(k % 4 == 1, F.concat(F.lit("["), _jstr(seg), F.lit(", "), _jstr(nat), F.lit("]")))
            .when(k % 4 == 2, F.concat(F.lit("["), _jstr(seg), F.lit(", "), _jstr(nat), F.lit(', "Ops"]')))
            .otherwise(F.concat(F.lit("["), _jstr(seg), F.lit(", "), _jstr(nat),
                                F.lit(', "Ops", "Finance", "Legal"]'))))
    level = (F.when(F.col("c_acctbal") < 0, "restricted").when(F.col("c_acctbal") < 5000, "standard")
             .otherwise("elevated"))
    actions = _case(k % 5, ['["read"]', '["read", "write"]', '["read", "write", "approve"]',
                            '["read", "write", "approve", "export"]',
                            '["read", "write", "approve", "export", "delete"]'], F.lit(None))
    timeout = F.when(k % 10 == 0, F.lit('"30"')).otherwise(((F.col("c_nationkey") % 6 + 1) * 15).cast("string"))
    parts = [
        F.concat(F.lit('"department": '), dept),
        F.concat(F.lit('"access_level": '), _jstr(level)),
        F.concat(F.lit('"allowed_actions": '), actions),
        F.concat(F.lit('"session_timeout": '), timeout),
        F.when(k % 3 != 1, F.concat(F.lit('"automation_restriction": '),
                                    F.when(F.col("c_acctbal") > 0, "true").otherwise("false"))),
        F.when(k % 2 == 0, F.concat(F.lit('"deadline": "2025-'),
                                    F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit('-15"'))),
        F.when(k % 3 == 0, F.concat(F.lit('"budget_limit": '), (k % 50).cast("string"), F.lit(".5"))),
        F.when(k % 4 == 0, F.concat(F.lit('"location_restriction": ['), _jstr(nat), F.lit("]"))),
        F.when(k % 7 == 0, F.lit('"collaboration_access": []'))
         .when(k % 7 == 1, F.concat(F.lit('"collaboration_access": ['), _jstr(seg), F.lit("]"))),
        F.when(k % 9 == 0, F.lit('"approver": null')),
    ]
    obj = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    single = F.regexp_replace(obj, '"', "'")
    return (F.when(k % 23 == 0, F.lit(None).cast("string"))
            .when(k % 19 == 0, F.lit(""))
            .when(k % 29 == 0, F.lit("read, write, export"))
            .when(k % 17 == 0, F.concat(F.lit("["), _jstr(seg), F.lit("]")))
            .when(k % 13 == 0, F.regexp_replace(single, "true", "True"))
            .when(k % 11 == 0, single)
            .otherwise(obj))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``example_id, user_role, permissions, query, expected_response``.

    ``query`` is a short request built from the customer row; the label comes
    from the balance so it is deterministic.
    """
    c = read(spark, sf_dir, "customer")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # nation is a fixed 25-row dimension: broadcasting it has a proven bound
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    role = F.concat_ws("_", F.col("c_mktsegment"), F.regexp_replace(F.col("n_name"), " ", "_"))
    query = F.concat(F.lit("Request from "), F.col("c_name"), F.lit(" to review the "),
                     F.lower(F.col("c_mktsegment")), F.lit(" account ledger"))
    label = (F.when(F.col("c_acctbal") < 0, "rejected").when(F.col("c_acctbal") < 5000, "partial")
             .otherwise("full"))
    return j.select(F.col("c_custkey").alias("example_id"), role.alias("user_role"),
                    permission_json().alias("permissions"), query.alias("query"),
                    label.alias("expected_response"))


# Fixed values (test inputs): label spellings in generated outputs by ``doc_id % 7``.
GENERATED_LABELS = ["full", "F", " Approve ", "allow", "partial", "rejected", "FULL"]


def generated_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-output texts (one per document) for C9-C12.

    The payload is a JSON object with the whole document text as ``query``;
    variations by ``doc_id``: label spelling (% 7), no rationale (% 11),
    permissions not an object (% 13), markdown fences (% 3), a control character
    (% 5), a truncated payload (% 17) and a JSON list instead of an object (% 19).
    """
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    k = F.col("doc_id")
    label = _case(k % 7, GENERATED_LABELS, F.lit(None))
    perms = F.struct(F.array(F.col("lang")).alias("department"), F.lit("standard").alias("access_level"))
    base = [F.concat(F.lit("Analyst_"), F.col("lang")).alias("user_role")]
    rest = [F.col("text").alias("query"), label.alias("expected_response")]
    rationale = F.concat(F.lit("Granted for "), F.col("source")).alias("rationale")
    with_obj = F.when(k % 11 == 0, F.to_json(F.struct(*base, perms.alias("permissions"), *rest))) \
                .otherwise(F.to_json(F.struct(*base, perms.alias("permissions"), *rest, rationale)))
    with_str = F.to_json(F.struct(*base, F.lit("none").alias("permissions"), *rest, rationale))
    # staged projections: each step reads the previous column once
    d = d.withColumn("__p", F.when(k % 13 == 0, with_str).otherwise(with_obj))
    p = F.col("__p")
    d = d.withColumn("__p", F.when(k % 19 == 0, F.lit('["not", "an", "object"]'))
                     .otherwise(F.substring(p, F.lit(1), F.length(p) - F.when(k % 17 == 0, 1).otherwise(0))))
    d = d.withColumn("__p", F.concat(F.when(k % 5 == 0, F.lit("\x07")).otherwise(F.lit("")), p))
    text = F.concat(F.when(k % 3 == 0, F.lit("```json\n")).when(k % 3 == 1, F.lit("```\n")).otherwise(F.lit("")),
                    p, F.when(k % 3 == 2, F.lit("")).otherwise(F.lit("\n```")))
    return d.select(F.col("doc_id"), F.col("source"), text.alias("model_output"))


# Fixed values (test inputs) of the offline generation stand-in.
REPLY_API_FAILURE_SHARE = 0.05
REPLY_WRONG_LABEL_SHARE = 0.10
REPLY_RATIONALE = "All requested actions are within the granted permissions."


def rule_reply(seed: int = 42):
    """Offline stand-in for the generation model (reads the row, not the prompt
    text): a JSON reply built from the source row; no reply for ~5 % of draws
    and a non-``full`` label for ~10 %, both decided by md5 draws."""
    from ..functions.common import md5_uniform
    d = F.col("draw_no")
    reply = F.to_json(F.struct(
        F.col("user_role"), F.parse_json(F.col("modified_permissions")).alias("permissions"),
        F.concat(F.col("query"), F.lit(" ["), F.col("strategy_used"), F.lit("]")).alias("query"),
        F.when(md5_uniform(F.lit(str(seed)), F.lit("label"), d) < REPLY_WRONG_LABEL_SHARE, "partial")
         .otherwise("full").alias("expected_response"),
        F.lit(REPLY_RATIONALE).alias("rationale")))
    return F.when(md5_uniform(F.lit(str(seed)), F.lit("api"), d) < REPLY_API_FAILURE_SHARE,
                  F.lit(None).cast("string")).otherwise(reply)


def used_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources used by an earlier run: customers that already have a fulfilled order."""
    o = read(spark, sf_dir, "orders")
    return o.filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("source_id")).distinct()


# Fixed values (test inputs) of the offline predictor.
RULE_REPLIES = ["Decision: Fully approved.", "Partially allowed: only the read part.", "Rejected: not permitted."]
ALWAYS_FAIL_MOD = 97
TRANSIENT_FAIL_MOD = 13


class RulePredictor:
    """Offline stand-in for a served model (picklable).

    The reply depends on the length of the last message; a length divisible by
    97 always fails, one divisible by 13 fails on the first attempt only.
    """

    def __call__(self, messages, attempt):
        n = len(messages[-1]["content"])
        if n % ALWAYS_FAIL_MOD == 0:
            raise RuntimeError("model unavailable")
        if n % TRANSIENT_FAIL_MOD == 0 and attempt == 1:
            raise TimeoutError("request timed out")
        return RULE_REPLIES[n % 3]


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as evaluation rows: ``id, run, permissions, query, truth_raw``."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    perms = F.concat(F.lit('{"department": ["'), F.col("lang"), F.lit('"], "access_level": "standard"}'))
    rows = d.select(F.col("doc_id").alias("id"), F.col("source").alias("run"), perms.alias("permissions"),
                    F.col("text").alias("query"))
    return rows.join(truth(spark, sf_dir), "id")


# Fixed values (test inputs) of the offline generator: upper ends of the shares of prompts that
# always fail, fail on the first call, never give JSON, and give another label than ``full``.
GENERATOR_SHARES = (0.04, 0.10, 0.14, 0.24)


class RuleGenerator:
    """Offline stand-in for the generation model (picklable): reads role and permission
    fields from the prompt's last JSON part and answers by the md5 of both."""

    def __call__(self, messages, attempt):
        import hashlib
        import json

        from ..operators.prompts import GENERATION_HEAD, GENERATION_SUFFIX
        given = json.loads(messages[-1]["content"].rpartition(GENERATION_HEAD)[2].partition(GENERATION_SUFFIX)[0])
        role, fields = given["user_role"], ",".join(sorted(given["permissions"]))
        share = int(hashlib.md5(f"{role}:{fields}".encode()).hexdigest()[:8], 16) / 2 ** 32
        fails, once, no_json, label = GENERATOR_SHARES
        if share < fails or (share < once and attempt == 1):
            raise TimeoutError("model unavailable")
        if share < no_json and share >= once:
            return "I cannot answer in that form."
        return "```json\n" + json.dumps({**given, "query": f"As {role} I need {fields}", "rationale": REPLY_RATIONALE,
                                         "expected_response": "partial" if no_json <= share < label else "full"}) + "\n```"
