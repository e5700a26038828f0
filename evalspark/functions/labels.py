"""Label normalisation (C5) and label extraction from free text.

Five dialects disagree on purpose; each is kept as its own data table and its own
expression.  All expressions are native Spark SQL (no UDF) so they stay inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the behaviour being reproduced.
# ---------------------------------------------------------------------------

# The three canonical classes, in confusion-matrix order.
CLASSES = ["full", "partial", "rejected"]
CLASS_CODE = {"full": 0, "partial": 1, "rejected": 2}

# Characters removed by Python's str.strip() with no argument (str.isspace()).
PY_WHITESPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
                 "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000")

# 'distribution' and 'eval' dialects: six direct entries.
SHORT_MAP = {
    "full": "full",
    "partial": "partial",
    "rejected": "rejected",
    "p": "partial",
    "r": "rejected",
    "f": "full",
}

# 'results' dialect: direct entries.
RESULTS_MAP = {
    "full": "full",
    "partial": "partial",
    "rejected": "rejected",
    "p": "partial",
    "r": "rejected",
    "f": "full",
    "allow": "full",
    "approve": "full",
    "deny": "rejected",
    "reject": "rejected",
    "complete": "full",
    "approve_partial": "partial",
}
# 'results' dialect: substring rules, tested in this order.
RESULTS_FULL_WORDS = ["approve", "allow", "complete"]
RESULTS_REJECT_WORDS = ["reject", "deny"]
RESULTS_PARTIAL_WORDS = ["partial"]

# 'repair' and 'conservative' dialects: the 26-entry mapping.
REPAIR_MAP = {
    "full": "full",
    "partial": "partial",
    "rejected": "rejected",
    "reject": "rejected",
    "approve": "full",
    "allow": "full",
    "deny": "rejected",
    "f": "full",
    "p": "partial",
    "r": "rejected",
    "accept": "full",
    "complete": "full",
    "grant": "full",
    "permitted": "full",
    "allowed": "full",
    "approved": "full",
    "denied": "rejected",
    "refuse": "rejected",
    "block": "rejected",
    "blocked": "rejected",
    "execute": "full",
    "authorize": "full",
    "summary_only": "partial",
    "restrict": "rejected",
    "limited": "partial",
    "require_approval": "partial",
}
REPAIR_APPROVE_WORDS = ["approve", "allow", "accept", "grant", "permit", "authorize", "execute"]
REPAIR_REJECT_WORDS = ["deny", "reject", "refuse", "block", "restrict"]
REPAIR_PARTIAL_WORDS = ["partial", "limited", "only"]

# Generated-row validation (C9): accepted spellings of 'full'.
GENERATED_FULL_WORDS = ["full", "f", "allow", "approve"]

# Response parsing (I2): substring tests in this order, then the default.
EXTRACT_ORDER = ["rejected", "partial", "full"]
EXTRACT_DEFAULT = "rejected"

DIALECTS = ("distribution", "eval", "results", "repair", "conservative")


# ---------------------------------------------------------------------------
# helpers
# ---------------------------------------------------------------------------

def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: Spark's ``trim`` removes blanks only."""
    return F.btrim(_col(c), F.lit(PY_WHITESPACE))


def lower_strip(c) -> Column:
    return F.lower(py_strip(c))


def _lookup(key: Column, table: dict) -> Column:
    """Literal-map lookup; null when the key is absent."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(m, key)


def _any_contains(c: Column, words) -> Column:
    out = None
    for w in words:
        t = c.contains(w)
        out = t if out is None else (out | t)
    return out


# ---------------------------------------------------------------------------
# dialects
# ---------------------------------------------------------------------------

def normalize_label(c, dialect: str) -> Column:
    """Normalised label of ``c`` under one of the five dialects.

    * ``distribution``: lower+strip, six-entry map, otherwise the lower-cased text
      itself; null and ``''`` give null (not counted).
    * ``eval``: exact, case-sensitive six-entry map; anything else is ``rejected``.
    * ``results``: lower+strip (null reads as ``'none'``), 12-entry map, then
      substring rules; unmatched text is returned as-is (invalid downstream).
    * ``repair``: 26-entry map, keyword rules, default ``partial``; null/``''`` give
      ``rejected``.
    * ``conservative``: 26-entry map, otherwise the original text unchanged;
      null/``''`` give ``rejected``.
    """
    raw = _col(c)
    if dialect == "distribution":
        t = lower_strip(raw)
        return F.when(raw.isNull() | (raw == ""), F.lit(None).cast("string")).otherwise(
            F.coalesce(_lookup(t, SHORT_MAP), t))
    if dialect == "eval":
        return F.coalesce(_lookup(raw, SHORT_MAP), F.lit("rejected"))
    if dialect == "results":
        t = F.coalesce(lower_strip(raw), F.lit("none"))
        return (F.when(_lookup(t, RESULTS_MAP).isNotNull(), _lookup(t, RESULTS_MAP))
                .when(_any_contains(t, RESULTS_FULL_WORDS), "full")
                .when(_any_contains(t, RESULTS_REJECT_WORDS), "rejected")
                .when(_any_contains(t, RESULTS_PARTIAL_WORDS), "partial")
                .otherwise(t))
    if dialect == "repair":
        t = lower_strip(raw)
        appr = _any_contains(t, REPAIR_APPROVE_WORDS)
        rej = _any_contains(t, REPAIR_REJECT_WORDS)
        part = _any_contains(t, REPAIR_PARTIAL_WORDS)
        return (F.when(raw.isNull() | (raw == ""), "rejected")
                .when(_lookup(t, REPAIR_MAP).isNotNull(), _lookup(t, REPAIR_MAP))
                .when((appr & rej) | part, "partial")
                .when(appr, "full")
                .when(rej, "rejected")
                .otherwise("partial"))
    if dialect == "conservative":
        t = lower_strip(raw)
        return (F.when(raw.isNull() | (raw == ""), "rejected")
                .otherwise(F.coalesce(_lookup(t, REPAIR_MAP), raw)))
    raise ValueError(f"unknown dialect {dialect!r}; expected one of {DIALECTS}")


def is_canonical(c) -> Column:
    """True when the value is one of the three canonical classes."""
    return _col(c).isin(*CLASSES)


def class_code(c) -> Column:
    """full=0, partial=1, rejected=2 (null for anything else)."""
    return _lookup(_col(c), CLASS_CODE)


def extract_label(text) -> Column:
    """Label from free model output by plain substring tests.

    ``partially`` therefore counts as partial and ``fully`` as full.  Null text
    stays null (the caller treats it as a failed prediction).
    """
    t = F.lower(_col(text))
    e = None
    for w in EXTRACT_ORDER:
        e = F.when(t.contains(w), w) if e is None else e.when(t.contains(w), w)
    return F.when(t.isNull(), F.lit(None).cast("string")).otherwise(e.otherwise(EXTRACT_DEFAULT))
