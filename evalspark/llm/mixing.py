"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of ``block_rows`` rows.  With integer parts p_i of a
total D, block j (from 1) of source i may start at slot floor((j-1) D / p_i), its
release, and must be placed before slot ceil(j D / p_i), its deadline.  Earliest
deadline first over the released blocks (ties: the source of smaller name) places every
block inside its window, so at any slot each source is less than one block away from
its target share.  Windows repeat every D slots: one period is scheduled, as an expression
over the parts or, beyond ``MAX_PERIOD`` slots, with a heap of one entry per source on the
driver that writes its slots in pieces; block j takes its slot from the pattern.

No row is dropped: when a source ends, its later slots stay empty and the others go on
in their slots; ``in_horizon`` is true before the release of the first missing block.

A row's place in its source is drawn by hash.  Ranks are taken in (source, hash bucket)
groups whose number follows the row count, then shifted by the counts of the earlier
buckets, so a source with a third of all rows is ranked by many tasks.

Defined cases: a null source is a source of its own and sorts first.  Sources that have
no parts given take ``default_parts``; parts of absent sources count towards D, so their
slots are empty.  Parts must be positive.  Rows with equal ids are all kept (ties by text
hash).  An empty table gives no rows.  Input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heappush
from itertools import islice
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import md5_bigint
from ..session import shared_dir
from .util import broadcast_under

MAX_PERIOD = 20_000  # slots of a period that one expression schedules
PIECE = 200_000  # slots written at once beyond it
OUT = ("block", "release", "deadline", "slot", "mix_order", "in_horizon")


def pattern(parts: list[int]) -> Column:
    """EDF order of one period: array of source indexes (from 0), one per slot."""
    d, p = sum(parts), F.array(*[F.lit(x) for x in parts])

    def pick(acc: Column, t: Column) -> Column:
        # of each source that is released at t and not done: (deadline, index) of its next block
        ready = F.filter(F.transform(acc["done"], lambda n, i: F.struct(
            F.ceil((n + 1) * d / F.get(p, i)).alias("deadline"), i.alias("i"),
            ((F.floor(n * d / F.get(p, i)) <= t) & (n < F.get(p, i))).alias("ready"))), lambda c: c["ready"])
        chosen = F.array_min(ready)["i"]
        return F.struct(F.transform(acc["done"], lambda n, i: n + F.when(i == chosen, 1).otherwise(0)).alias("done"),
                        F.concat(acc["order"], F.array(chosen)).alias("order"))

    zero = F.struct(F.array(*[F.lit(0) for _ in parts]).alias("done"), F.array().cast("array<int>").alias("order"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(d - 1)), zero, pick)["order"]


def schedule(parts: list[int]) -> Iterator[tuple[int, int, int]]:
    """The same order as :func:`pattern`, slot by slot: (source index, its block, slot)."""
    d, done, ready = sum(parts), [0] * len(parts), []
    waiting = [(0, i) for i in range(len(parts))]  # by release
    heapify(waiting)
    for t in range(d):
        while waiting and waiting[0][0] <= t:
            i = heappop(waiting)[1]
            heappush(ready, (-(-(done[i] + 1) * d // parts[i]), i))
        i = heappop(ready)[1]
        yield i, done[i], t
        done[i] += 1
        if done[i] < parts[i]:
            heappush(waiting, (done[i] * d // parts[i], i))


def _long_period(spark, parts: list[int]) -> DataFrame:
    """``__i, __k, __at`` of :func:`schedule`, written in pieces."""
    path, kind, slots = shared_dir(spark, "llm-mix-slots"), "__i int, __k bigint, __at bigint", schedule(parts)
    while piece := list(islice(slots, PIECE)):
        spark.createDataFrame(piece, kind).write.mode("append").parquet(path)
    return spark.read.schema(kind).parquet(path)


def pfair_mix(docs: DataFrame, parts: dict | None = None, default_parts: int = 1, source: str = "source",
              key: str = "doc_id", text: str = "text", block_rows: int = 64, bucket_rows: int = 50_000) -> DataFrame:
    """``docs`` plus block, release, deadline, slot, mix_order and in_horizon."""
    spark, keep = docs.sparkSession, [c for c in docs.columns if c not in OUT]
    counts = docs.groupBy(F.col(source).alias("__s")).agg(F.count("*").alias("__n"))
    sizes = {r["__s"]: r["__n"] for r in counts.collect()}  # one number per source
    parts = {s: int((parts or {}).get(s, default_parts)) for s in {**sizes, **(parts or {})}}
    if any(p <= 0 for p in parts.values()):
        raise ValueError("parts must be positive")
    g = reduce(gcd, parts.values(), 0) or 1
    names = sorted(parts, key=lambda s: (s is not None, s or ""))
    parts = {s: parts[s] // g for s in names}
    period = sum(parts.values())
    horizon = min(((-(-sizes.get(s, 0) // block_rows)) * period // p for s, p in parts.items()), default=0)

    index = spark.createDataFrame([(i, s, parts[s]) for i, s in enumerate(names)], "__i int, __s string, __p int")
    small_index = broadcast_under(index, len(names), 200)
    if period > MAX_PERIOD:
        slots = _long_period(spark, [parts[s] for s in names])
    else:
        slots = (spark.range(1).select(F.posexplode(pattern([parts[s] for s in names])).alias("__at", "__i"))
                 if names else spark.createDataFrame([], "__at int, __i int"))
        w = Window.partitionBy("__i").orderBy("__at")
        slots = slots.withColumn("__k", (F.row_number().over(w) - 1).cast("bigint"))
    slots = slots.join(small_index, "__i").select("__i", "__s", "__p", "__k", "__at")

    total = sum(sizes.values())
    buckets = max(256, -(-total // bucket_rows))
    h = md5_bigint(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("mix"))  # 60 bits
    rows = docs.select(*keep, h.alias("__h"), F.col(source).alias("__s"))
    rows = rows.withColumn("__b", F.floor(F.shiftright("__h", 30) * buckets / (1 << 30)))  # rises with the hash
    before = (rows.groupBy("__s", "__b").agg(F.count("*").alias("__c"))
              .withColumn("__off", F.sum("__c").over(Window.partitionBy("__s").orderBy("__b")) - F.col("__c")))
    before = before.select(F.col("__s").alias("__s2"), F.col("__b").alias("__b2"), "__off")
    tie = [F.col("__h"), F.col(key), F.xxhash64(text) if text in keep else F.lit(0)]
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__s", "__b").orderBy(*tie)))
    n_groups = buckets * max(1, len(sizes))
    small = F.broadcast(before) if n_groups <= 100_000 else before
    placed = (ranked.join(small, F.col("__s").eqNullSafe(F.col("__s2")) & (F.col("__b") == F.col("__b2")))
              .withColumn("__r", (F.col("__r") + F.col("__off") - 1).cast("bigint"))
              .withColumn("block", F.floor(F.col("__r") / block_rows).cast("bigint")))
    p_of = broadcast_under(index.select(F.col("__i").alias("__i3"), F.col("__s").alias("__s3"), F.col("__p").alias("__p3")), len(names), 200)
    placed = placed.join(p_of, F.col("__s").eqNullSafe(F.col("__s3")))
    placed = placed.withColumn("__turn", F.floor(F.col("block") / F.col("__p3"))).withColumn("__k3", F.col("block") % F.col("__p3"))
    at = broadcast_under(slots.select(F.col("__i").alias("__i4"), F.col("__k").alias("__k4"), "__at"), period, 40)
    placed = placed.join(at, (F.col("__i3") == F.col("__i4")) & (F.col("__k3") == F.col("__k4")))
    slot = F.col("__turn") * period + F.col("__at")
    return placed.select(
        *keep, F.col("block"), F.floor(F.col("block") * period / F.col("__p3")).alias("release"),
        F.ceil((F.col("block") + 1) * period / F.col("__p3")).alias("deadline"), slot.alias("slot"),
        (slot * block_rows + F.col("__r") % block_rows).alias("mix_order"), (slot < horizon).alias("in_horizon"))
