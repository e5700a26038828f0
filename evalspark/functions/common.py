"""Small expression helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUND = 6  # ratios are rounded so both engines agree on doubles


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num, den, scale: float = 1.0) -> Column:
    """``scale * num / den`` rounded; null when ``den`` is 0 (``try_divide``)."""
    r = F.try_divide(col(num).cast("double"), col(den).cast("double"))
    if scale != 1.0:
        r = r * F.lit(scale)
    return F.round(r, ROUND)


def ratio0(num, den, scale: float = 1.0) -> Column:
    """Like :func:`ratio` but 0 when undefined (sklearn ``zero_division=0``)."""
    return F.coalesce(ratio(num, den, scale), F.lit(0.0))


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame (a global aggregate) to every row.

    Each column becomes a scalar subquery: evaluated once, its value is a
    constant in the outer plan, so ``df`` is neither joined nor shuffled (the
    optimizer merges subqueries over the same aggregate into one).
    """
    return df.select("*", *[one_row.select(c).scalar().alias(c) for c in one_row.columns])


def md5_uniform(*parts) -> Column:
    """Deterministic uniform draw in [0, 1) from md5 of the parts (first 8 hex)."""
    h = F.md5(F.concat_ws(":", *[col(p).cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def md5_bigint(*parts) -> Column:
    """Non-negative 60-bit integer from the first 15 hex digits of md5."""
    h = F.md5(F.concat_ws(":", *[col(p).cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")


def evaluate_once(df: DataFrame, **cols) -> DataFrame:
    """Add expensive columns (JSON parses, regex chains) evaluated once per row.

    A projected expression can be copied by the optimizer into every later
    reference (filters are pushed through projections by alias substitution).
    Columns produced by a generator are not substituted, so the values are
    projected through a one-element ``inline`` and later operators read them.
    """
    keep = [F.col(c) for c in df.columns if c not in cols]
    packed = F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))
    return df.select(*keep, F.inline(packed))


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a derived table that several branches consume.

    A reliable checkpoint below ``spark.checkpoint.dir``: the source is read
    once, and a lost executor re-reads the checkpoint instead of recomputing.
    Meant for aggregates (small next to their input).
    """
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows round-robin over ``spark.sql.shuffle.partitions`` tasks before costly work per row.

    Scans are split by bytes: a table whose rows are short on disk is read by one task
    or a few, however many rows it has.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
