"""Document fingerprints by a homomorphic multiset hash of paragraphs.

A text is the multiset of its paragraphs: non-empty pieces between line breaks, cut
after sentence ends too.  A paragraph is hashed to a wide vector, which itself is the
sum of its whole and of its runs of up to ``RUN`` words, so that a change in a long
paragraph stays local.  A text's fingerprint is the sum over its paragraphs of

* ``WORDS`` words of the SHA-256 of each paragraph, added modulo 2^32: equality of multisets,
* the count of runs, and of each run ``SIGNS`` bits of seeded XXH64, counted in lanes of
  20 bits, three to a word, added modulo 2^60: a count c over n runs stands for the sum
  2c - n of signs.

Sums do not depend on order of paragraphs, and a paragraph is inserted or deleted by adding or
subtracting its vector (:func:`add`, :func:`subtract`); texts need not be read again.
The sums of signs estimate likeness: with squared norms a, b of two fingerprints and d
of their difference, it is 1 - d / (a + b), cut to 0..1 (standard error about 0.09), and
1 for equal fingerprints.  A lane counts up to 2^20 runs: the likeness (not the equality) of texts or
unions of more runs than that is unreliable.

The next document is found without ranking all rows in one place: ids are counted in
cells of equal width, neighbouring cells are joined to buckets of about ``bucket_rows``
rows, and each bucket is sorted with a copy of the next bucket's first row at its end.

Defined cases: null text is empty; an empty text has the zero vector; null ids come after
all others; rows of equal id are ordered by text, repeated rows follow each other; the
last document is followed by the first, an only one by itself; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import broadcast_under

RUN = 8
WORDS, SIGN_HASHES, LANES, LANE_BITS = 8, 2, 3, 20
SIGNS = SIGN_HASHES * LANES * LANE_BITS
SIZE = 1 + WORDS + SIGN_HASHES * LANE_BITS
_ONE_PER_LANE = sum(1 << (LANE_BITS * k) for k in range(LANES))
_WORD, _PACKED = (1 << 32) - 1, (1 << (LANE_BITS * LANES)) - 1
MAX_CELLS = 1 << 20


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\n+|(?<=[.!?]) +", -1), lambda p: p != "")


def _modulus(acc: Column, i: Column) -> Column:
    """``acc`` modulo the power of two of slot ``i``."""
    return acc.bitwiseAND(F.when((i > 0) & (i <= WORDS), F.lit(_WORD)).otherwise(F.lit(_PACKED)))


def _paragraph(sha: Column) -> Column:
    words = [F.conv(F.substring(sha, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(WORDS)]
    return F.array(F.lit(0).cast("bigint"), *words)


def _run(h: Column) -> Column:
    signs = [F.shiftrightunsigned(h[f"s{k}"], j).bitwiseAND(F.lit(_ONE_PER_LANE))
             for k in range(SIGN_HASHES) for j in range(LANE_BITS)]
    return F.array(F.lit(1).cast("bigint"), *signs)


def add(a: Column, b: Column) -> Column:
    """Fingerprint of the union of two multisets of paragraphs."""
    return F.transform(F.zip_with(a, b, lambda x, y: x + y), _modulus)


def subtract(a: Column, b: Column) -> Column:
    """Fingerprint after the paragraphs of ``b`` are deleted from ``a``."""
    return F.transform(F.zip_with(a, b, lambda x, y: x - y), _modulus)


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text as an array of ``SIZE`` words: count of runs, words, signs."""
    whole = F.transform(paragraphs(text), lambda p: F.sha2(p, 256))
    runs = F.flatten(F.transform(paragraphs(text), lambda p: F.regexp_extract_all(p, F.lit(r"(?:\S+\s*){1,%d}" % RUN), F.lit(0))))
    hashed = F.transform(runs, lambda r: F.struct(
        *[F.xxhash64(F.lit(f"sign{k}"), F.rtrim(r)).alias(f"s{k}") for k in range(SIGN_HASHES)]))
    signs = F.aggregate(hashed, F.array_repeat(F.lit(0).cast("bigint"), SIZE - WORDS), lambda acc, h: F.zip_with(
        acc, _run(h), lambda x, y: (x + y).bitwiseAND(F.lit(_PACKED))))
    words = F.aggregate(whole, F.array_repeat(F.lit(0).cast("bigint"), WORDS + 1), lambda acc, h: F.zip_with(
        acc, _paragraph(h), lambda x, y: (x + y).bitwiseAND(F.lit(_WORD))))
    return F.concat(F.slice(signs, 1, 1), F.slice(words, 2, WORDS), F.slice(signs, 2, SIZE - WORDS - 1))


def as_text(fp: Column) -> Column:
    return F.lower(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of the paragraphs' runs in common, 0 to 1."""
    lanes = F.array(*[F.lit(LANE_BITS * k) for k in range(LANES)])

    def signs(fp: Column) -> Column:
        packed = F.slice(fp, 2 + WORDS, SIGN_HASHES * LANE_BITS)
        return F.flatten(F.transform(packed, lambda x: F.transform(lanes, lambda s: (
            2 * F.call_function("shiftrightunsigned", x, s).bitwiseAND(F.lit((1 << LANE_BITS) - 1)) - F.get(fp, 0)).cast("double"))))

    def square(c: Column) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda t, x: t + x * x)

    sa, sb = signs(a), signs(b)
    both = square(sa) + square(sb)
    apart = square(F.zip_with(sa, sb, lambda x, y: x - y))
    return (F.when(a == b, F.lit(1.0)).when(both == 0, F.lit(0.0))
            .otherwise(F.round(F.greatest(F.lit(0.0), 1 - apart / both), 6)))


def with_next(docs: DataFrame, key: str, order: list[str], carry: dict[str, Column], bucket_rows: int = 2000) -> DataFrame:
    """``docs`` with the carried columns (name to expression, taken once for each row) and
    ``next_<name>`` for each, from the next row by ``key`` and ``order``."""
    stats = docs.agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    n, lo, hi = stats["n"], stats["lo"] or 0, stats["hi"] or 0
    n_cells = min(MAX_CELLS, max(1, n * 64 // bucket_rows))
    width = max(1, -(-(hi - lo + 1) // n_cells))
    cell = F.coalesce(F.floor((F.col(key) - lo) / width).cast("bigint"), F.lit(n_cells + 1))
    cells = docs.groupBy(cell.alias("__cell")).agg(F.count("*").alias("c"))  # at most MAX_CELLS + 1 rows
    cells = cells.select("__cell", F.floor((F.sum("c").over(Window.orderBy("__cell")) - F.col("c")) / bucket_rows).alias("__bucket"))
    bucketed = docs.withColumn("__cell", cell).join(broadcast_under(cells, n_cells, 32, 64 << 20), "__cell").drop("__cell")

    keyed = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"))
    least = bucketed.groupBy("__bucket").agg(F.min(keyed).alias("__k"))  # a row for each bucket
    around = Window.orderBy("__bucket")
    least = least.select(F.col("__bucket").alias("__of"), "__k",
                         F.coalesce(F.lag("__bucket").over(around), F.max("__bucket").over(Window.partitionBy())).alias("__to"))
    least = broadcast_under(least, max(1, n // bucket_rows) * 64 + 2, 48)
    firsts = (bucketed.join(least, (F.col("__bucket") == F.col("__of")) & keyed.eqNullSafe(F.col("__k")))
              .groupBy("__to").agg(F.min(F.struct(*order, *[c for c in docs.columns if c not in order])).alias("__f"))
              .select(F.col("__to").alias("__bucket"), "__f.*", F.lit(True).alias("__end")))
    rows = bucketed.withColumn("__end", F.lit(False)).unionByName(firsts).withColumns(carry)
    w = Window.partitionBy("__bucket").orderBy("__end", F.col(key).asc_nulls_last(), *order)
    return (rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry])
            .where("not __end").drop("__end", "__bucket"))


def edit_report(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_rows: int = 2000) -> DataFrame:
    """Fingerprint of every text and of its edited text (last half replaced from the next document)."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = with_next(rows, "doc_id", ["text"], {"text": F.col("text"), "fp": fingerprint(F.col("text"))}, bucket_rows)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    # kept apart: the fingerprints are taken once and read by several columns
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       F.inline(F.array(F.struct(F.col("fp").alias("fp"), fingerprint(F.col("edited")).alias("edited_fp"),
                                                 F.col("next_fp").alias("next_fp")))))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"),
                       as_text(F.col("edited_fp")).alias("edited_fingerprint"),
                       likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                       likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
