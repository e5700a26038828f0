"""Prompt and conversation shaping: G1-G6.

Messages are ``array<struct<role string, content string>>`` built row by row
with native expressions; the wording of the templates is this library's own.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import col
from ..functions.json import parse_json

# ---------------------------------------------------------------------------
# Template texts.
# ---------------------------------------------------------------------------
SYSTEM_PROMPT = (
    "You review access requests against a user's role-based permissions. "
    "Answer with one decision: full (everything requested is allowed), partial "
    "(only part of the request is allowed) or rejected (nothing is allowed), then "
    "explain the decision."
)
USER_TEMPLATE = ("Role permissions:\n", "\n\nRequest:\n", "")
INSTRUCTIONS_IN_USER_PREFIX = "Instructions: "
ASSISTANT_TEMPLATE = ("Response type: ", "\n\nRationale: ", "")
GENERATION_PREFIX = (
    "Write one new access request that the role below may fully perform with "
    "these permissions. Reply with a JSON object with the keys user_role, "
    "permissions, query, expected_response (always \"full\") and rationale.\n\n"
)
GENERATION_EXAMPLES = (
    ({"user_role": "Shift_Planner", "permissions": {"access_level": "elevated", "department": ["planning"]}},
     {"query": "Please list this week's open shifts in planning.", "expected_response": "full",
      "rationale": "The planning department is within the role's reach."}),
    ({"user_role": "Store_Clerk", "permissions": {"budget": 50}},
     {"query": "May I order printer paper for 30 from the office budget?", "expected_response": "full",
      "rationale": "The amount is below the budget."}),
)
GENERATION_HEAD = "Role and permissions:\n"
GENERATION_SUFFIX = "\n\nJSON:"
UNKNOWN_ROLE = "Unknown_Role"
MAX_SEQ_LENGTH = 2048
PROMPT_FORMATS = ["with_system", "without_system", "instructions_in_user"]
# word-split token proxy (not a model tokenizer): runs of non-blank characters
WORD_PATTERN = "[^ \t\n\r]+"


def _msg(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def user_content(perm_col, query_col) -> Column:
    """G1 user turn: permissions and query interpolated verbatim."""
    a, b, c = USER_TEMPLATE
    return F.concat(F.lit(a), F.coalesce(col(perm_col), F.lit("None")), F.lit(b),
                    F.coalesce(col(query_col), F.lit("None")), F.lit(c))


def eval_messages(perm_col="permissions", query_col="query") -> Column:
    """G1: system + user messages."""
    return F.array(_msg("system", F.lit(SYSTEM_PROMPT)), _msg("user", user_content(perm_col, query_col)))


def assistant_content(label_col="expected_response", rationale_col="rationale", null_as: str | None = "None") -> Column:
    """G2 assistant turn; a null rationale renders as ``None`` unless ``null_as`` is changed."""
    a, b, c = ASSISTANT_TEMPLATE
    r = col(rationale_col)
    if null_as is not None:
        r = F.coalesce(r, F.lit(null_as))
    return F.concat(F.lit(a), F.coalesce(col(label_col), F.lit("None")), F.lit(b), r, F.lit(c))


def train_messages(perm_col="permissions", query_col="query", label_col="expected_response",
                   rationale_col="rationale", null_as: str | None = "None") -> Column:
    """G1 plus the assistant answer."""
    return F.array(_msg("system", F.lit(SYSTEM_PROMPT)), _msg("user", user_content(perm_col, query_col)),
                   _msg("assistant", assistant_content(label_col, rationale_col, null_as)))


def prompt_formats(df: DataFrame, perm_col="permissions", query_col="query") -> DataFrame:
    """One row per (example, format) with ``format`` and ``messages``."""
    u = user_content(perm_col, query_col)
    folded = F.concat(F.lit(INSTRUCTIONS_IN_USER_PREFIX), F.lit(SYSTEM_PROMPT), F.lit("\n\n"), u)
    variants = F.array(
        F.struct(F.lit("with_system").alias("format"),
                 F.array(_msg("system", F.lit(SYSTEM_PROMPT)), _msg("user", u)).alias("messages")),
        F.struct(F.lit("without_system").alias("format"), F.array(_msg("user", u)).alias("messages")),
        F.struct(F.lit("instructions_in_user").alias("format"), F.array(_msg("user", folded)).alias("messages")),
    )
    return df.select("*", F.inline(variants))


def chat_export(df: DataFrame, path: str, messages_col: str = "messages") -> None:
    """``{"messages": [...]}`` per line (K2 JSON Lines writer)."""
    from ..sources.sinks import save_output
    save_output(df.select(F.col(messages_col).alias("messages")), path, "jsonl")


def generation_prompt(role_col="user_role", perm_json_col="modified_permissions") -> Column:
    """Few-shot generation prompt; the role and its permissions stand last, as
    indented JSON."""
    role = F.coalesce(col(role_col), F.lit(UNKNOWN_ROLE))
    payload = F.to_json(F.struct(role.alias("user_role"), F.parse_json(col(perm_json_col)).alias("permissions")), {"pretty": "true"})
    shots = "".join(f"{GENERATION_HEAD}{json.dumps(given, indent=2)}{GENERATION_SUFFIX}\n{json.dumps({**given, **answer}, indent=2)}\n\n"
                    for given, answer in GENERATION_EXAMPLES)
    return F.concat(F.lit(GENERATION_PREFIX + shots + GENERATION_HEAD), payload, F.lit(GENERATION_SUFFIX))


def prompt_payload(prompt) -> Column:
    """The JSON part of a generation prompt (VARIANT): what stands between the last head and the end."""
    last = F.substring_index(col(prompt), GENERATION_HEAD, -1)
    return parse_json(F.substring_index(last, GENERATION_SUFFIX, 1))


def render_chat(messages_col="messages") -> Column:
    """Plain rendering of a message list (``<role>: content`` blocks) for length profiles."""
    return F.array_join(F.transform(col(messages_col),
                                    lambda m: F.concat(F.lit("<"), m["role"], F.lit(">: "), m["content"])), "\n")


def word_tokens(text) -> Column:
    """Token-count proxy: number of blank-separated words (not a model tokenizer)."""
    return F.regexp_count(col(text), F.lit(WORD_PATTERN)).cast("bigint")


def sequence_lengths(df: DataFrame, text_col: str, max_len: int = MAX_SEQ_LENGTH, tokens_col: str | None = None,
                     by=()) -> DataFrame:
    """Length profile over **all** rows: mean / min / max of the token count,
    rows over the cap and mean after truncation to ``max_len`` (percentiles:
    :func:`sequence_percentiles`).

    ``tokens_col`` lets a caller pass counts from a pluggable tokenizer (for
    example a ``pandas_udf``); the default is :func:`word_tokens`.
    """
    by = list(by)
    n = F.col(tokens_col) if tokens_col else word_tokens(text_col)
    t = df.select(*by, n.alias("n"))
    g = t.groupBy(*by) if by else t.groupBy()
    return g.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("n"), 6).alias("mean_tokens"),
                 F.min("n").alias("min_tokens"), F.max("n").alias("max_tokens"),
                 F.count_if(F.col("n") > max_len).alias("n_over_cap"),
                 F.round(F.avg(F.least(F.col("n"), F.lit(max_len))), 6).alias("mean_truncated"))


def sequence_percentiles(df: DataFrame, text_col: str, tokens_col: str | None = None) -> DataFrame:
    """G6 distribution: approximate p50/p95/p99 of the token count (mergeable sketch)."""
    n = F.col(tokens_col) if tokens_col else word_tokens(text_col)
    return df.select(n.alias("n")).agg(F.percentile_approx("n", [0.5, 0.95, 0.99], 10000).alias("p"))


def token_counter(encode_fn):
    """Pluggable tokenizer for G6: a ``pandas_udf`` (Arrow batches) returning
    ``len(encode_fn(text))`` per row, for use as ``tokens_col``.

    ``encode_fn`` must be picklable (e.g. a model tokenizer's ``encode``); the
    package ships to executors the same way as for I1.
    """
    from ..session import ship_package
    from pyspark.sql import SparkSession
    active = SparkSession.getActiveSession()
    if active is not None:
        ship_package(active)

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else len(encode_fn(t))).astype("Int64")

    return count
