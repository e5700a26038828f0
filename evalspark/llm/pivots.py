"""Vector codes by an integer product quantizer whose nearest entries are found by LAESA pivots.

Each component x becomes the integer floor(256 x); a vector is cut into ``parts`` equal
consecutive parts, and each part position has a codebook of ``entries`` integer entries that
starts as that part of the vectors of the smallest keys.  In each round every part goes to its
nearest entry (squared Euclidean distance, ties to the lower index) and each entry becomes
floor(sum / count) of its parts' components; unused entries stay.  Then parts are assigned
once more: the code is the entries' indices, the error the sum of the squared distances.

LAESA: a few fixed pivots per part position are chosen among the first entries, farthest first,
and every part's distances to them are computed once and written beside it.  In a round only
the entries' distances to the pivots are new; by the triangle inequality the largest
difference of a part's and an entry's distance to a pivot is a lower bound of their distance.  Entries
are taken in the order of their bounds, the exact integer distance is evaluated, and a part is
done when the next bound exceeds its best distance.  Bounds are lowered by more than
floating-point error can add, so the result is that of comparing all entries.

Rounds read the written parts and leave each task as sums per (part, entry, position), of
which the driver sees ``parts * entries`` entries; rows are never shuffled.

Defined cases: a vector that is null, or holds a null, a non-finite component or one of
magnitude 2^20 or more (its squared distances do not fit a long) is dropped; so is one whose
length is not that of the first kept vector (smallest key, nulls last), or no multiple of
``parts``; fewer rows than ``entries`` give smaller codebooks; rows of one key are ordered by
their vectors; repeated rows are kept and counted; an empty table gives no rows and empty
codebooks; other columns are kept (names that begin with two underscores are the operator's).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StructField, StructType

from .util import workers, written

SCALE, LIMIT = 256, 1 << 20


def usable(vec: Column) -> Column:
    """Not null and of finite components below the limit."""
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT)), F.lit(False))


def integers(vec: Column) -> Column:
    return F.transform(vec, lambda x: F.floor(x.cast("double") * SCALE).try_cast("int"))  # unusable vectors may pass here before they are dropped


def matrix(column: pa.Array, kind) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind)


def cut(vectors: np.ndarray, parts: int) -> np.ndarray:
    return vectors.reshape(len(vectors), parts, -1)


def distances(parts_: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Euclidean distances (rows x others) of integer vectors."""
    return np.sqrt(((parts_[:, None, :] - others[None, :, :]) ** 2).sum(axis=2).astype(np.float64))


def choose_pivots(entries: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first entries: each has the largest sum of distances to those before it."""
    chosen, total = [0], np.zeros(len(entries))
    while len(chosen) < min(count, len(entries)):
        total += distances(entries, entries[chosen[-1:]])[:, 0]
        total[chosen] = -1
        chosen.append(int(total.argmax()))
    return entries[chosen]


def nearest(parts_: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, of_entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of every part's nearest entry, and how many exact
    distances were evaluated."""
    n, k = len(parts_), len(entries)
    lower = np.zeros((n, k))
    for p in range(to_pivots.shape[1]):
        np.maximum(lower, np.abs(to_pivots[:, p, None] - of_entries[None, :, p]), out=lower)
    lower -= 1e-6 * (1 + to_pivots.max(axis=1, initial=0.0)[:, None] + of_entries.max(axis=1, initial=0.0)[None, :])
    bound = np.maximum(lower, 0) ** 2
    order = np.argsort(bound, axis=1, kind="stable")
    best, index = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    active, evaluated = np.arange(n), 0
    for rank in range(k):
        entry = order[active, rank]
        near = bound[active, entry] <= best[active]
        active, entry = active[near], entry[near]
        if not len(active):
            break
        d = ((parts_[active] - entries[entry]) ** 2).sum(axis=1)
        better = (d < best[active]) | ((d == best[active]) & (entry < index[active]))
        best[active[better]], index[active[better]] = d[better], entry[better]
        evaluated += len(active)
    return index, best, evaluated


def assign(batch: pa.RecordBatch, books: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts (rows x parts x width), their entries and squared distances (rows x parts)."""
    parts_ = cut(matrix(batch.column("__v"), np.int64), len(books))
    to_pivots = cut(matrix(batch.column("__p"), np.float64), len(books))
    found = [nearest(parts_[:, j], to_pivots[:, j], books[j], distances(books[j], pivots[j])) for j in range(len(books))]
    return parts_, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def with_pivots(kept: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``__p``: every part's distances to the pivots of its position."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = cut(matrix(batch.column("__v"), np.int64), len(pivots))
            d = np.concatenate([distances(v[:, j], pivots[j]) for j in range(len(pivots))], axis=1).astype(np.float32)
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "__p"])
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("__p", ArrayType(FloatType()))]))


def improved(rows: DataFrame, books: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            parts_, index, _ = assign(batch, books, pivots)
            for j in range(len(books)):
                np.add.at(total[j], index[:, j], parts_[:, j])
                count[j] += np.bincount(index[:, j], minlength=books.shape[1])
        part, entry, pos = np.indices(books.shape)
        cols = [part, entry, pos, total, np.broadcast_to(count[:, :, None], books.shape)]
        used = cols[4].ravel() > 0
        yield pa.RecordBatch.from_arrays([pa.array(c.ravel()[used].astype(np.int64)) for c in cols], ["part", "entry", "pos", "total", "n"])

    sums = rows.select("__v", "__p").mapInArrow(run, "part bigint, entry bigint, pos bigint, total bigint, n bigint")
    out = books.copy()
    for r in sums.groupBy("part", "entry", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # a row per component of the codebooks
        out[r["part"], r["entry"], r["pos"]] = r["total"] // r["n"]
    return out


def compress(df: DataFrame, vec: str = "embedding", key: str = "vec_id", parts: int = 16, entries: int = 64, rounds: int = 2,
             n_pivots: int = 4) -> tuple[DataFrame, np.ndarray]:
    """Kept rows without ``vec``, with ``__code`` (entry indices in part order) and ``__error``;
    and the codebooks (parts x entries x width)."""
    workers(df.sparkSession)
    kept = df.where(usable(F.col(vec))).withColumn("__v", integers(F.col(vec))).drop(vec)
    first = [F.col(key).asc_nulls_last(), "__v"]
    head = kept.where((F.size("__v") > 0) & (F.size("__v") % parts == 0)).orderBy(*first).select("__v").limit(1).collect()
    out_schema = StructType([*kept.drop("__v").schema.fields, StructField("__code", ArrayType(IntegerType())), StructField("__error", LongType())])
    if not head:
        return df.sparkSession.createDataFrame([], out_schema), np.zeros((parts, 0, 0), np.int64)
    kept = kept.where(F.size("__v") == len(head[0][0]))
    seeds = np.array([r[0] for r in kept.orderBy(*first).select("__v").limit(entries).collect()], np.int64)
    books = cut(seeds, parts).transpose(1, 0, 2).copy()
    pivots = np.stack([choose_pivots(b, n_pivots) for b in books])
    rows = written(with_pivots(kept, pivots), "pivots")
    for _ in range(rounds):
        books = improved(rows, books, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, index, dist = assign(batch, books, pivots)
            offsets = pa.array(np.arange(len(index) + 1, dtype=np.int32) * parts)
            codes = pa.ListArray.from_arrays(offsets, pa.array(index.ravel().astype(np.int32)))
            kept_columns = [batch.column(n) for n in out_schema.names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept_columns, codes, pa.array(dist.sum(axis=1))], out_schema.names)
    return rows.mapInArrow(run, out_schema), books
