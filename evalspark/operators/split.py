"""Seeded, exact per-stratum splits: T1-T5, with K1/K6 in ``sources.sinks``.

T2 needs "the first ``floor(n * f)`` rows of a seeded shuffle" per stratum.  A
global sort per stratum would funnel a stratum through one task, so the cut is
found on a small table instead:

1. every row gets ``h`` = first 15 hex digits of md5(seed:stratum:id) as BIGINT
   (the shuffle order, ties broken by id) and ``bucket`` = its top
   ``bucket_bits`` bits (default 20);
2. rows are counted per (stratum, bucket) - at most 2^20 (about 1M) rows per
   stratum, only non-empty buckets appear;
3. a running sum over that small table finds, per stratum, the boundary bucket
   that holds position ``k``;
4. only rows of the boundary bucket (about n / 2^20 per stratum, ~1M rows at
   10^12 rows) are ranked, to find the k-th pair (h, id);
5. every row is flagged by comparing its own pair with its stratum's: one row per
   stratum is attached, and no row of the table is joined by id.

The result equals ``row_number() over (partition by stratum order by h, id) <= k``
for any partitioning of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import attach_one_row, materialize, md5_bigint

HASH_BITS = 60     # md5 prefix of 15 hex digits
BUCKET_BITS = 20   # per-stratum bucket table <= 2^20 rows; boundary bucket ~ n / 2^20 rows


def shuffle_key(seed, stratum_col, id_col, salt: str | None = None):
    """The seeded shuffle order as a BIGINT column (md5 of seed:[salt:]stratum:id)."""
    parts = [F.lit(str(seed))] + ([F.lit(salt)] if salt else []) + [stratum_col, id_col]
    return md5_bigint(*parts)


def _keyed(df: DataFrame, id_col: str, strat, seed, salt, bucket_bits: int, h: str, b: str) -> DataFrame:
    return (df.withColumn(h, shuffle_key(seed, strat, F.col(id_col), salt))
              .withColumn(b, F.shiftright(F.col(h), HASH_BITS - bucket_bits)))


def _threshold(members: DataFrame, g, id_col: str, h: str, b: str, fraction: float) -> DataFrame:
    """Per stratum the k-th pair ``__cut`` (h, id) of the seeded order, over ``members`` (the
    rows of the strata being cut); null where k is 0."""
    per_bucket = members.groupBy(*g, b).agg(F.count(F.lit(1)).alias("__nb"))
    # running sum over the bucket table (<= 2^bucket_bits rows per stratum)
    w = (Window.partitionBy(*g) if g else Window).orderBy(b).rowsBetween(Window.unboundedPreceding, 0)
    cum = (per_bucket.withColumn("__cum", F.sum("__nb").over(w))
                     .withColumn("__n", F.sum("__nb").over(Window.partitionBy(*g))))
    cum = cum.withColumn("__k", F.floor(F.col("__n") * F.lit(float(fraction))).cast("bigint"))
    boundary = (cum.filter((F.col("__cum") >= F.col("__k")) & (F.col("__cum") - F.col("__nb") < F.col("__k")))
                   .select(*g, F.col(b).alias("__bb"), (F.col("__k") - (F.col("__cum") - F.col("__nb"))).alias("__need")))
    in_bb = members.join(boundary, g) if g else attach_one_row(members, boundary)
    in_bb = in_bb.filter(F.col(b) == F.col("__bb"))
    rw = (Window.partitionBy(*g) if g else Window).orderBy(F.col(h), F.col(id_col))
    last = in_bb.withColumn("__r", F.row_number().over(rw)).filter(F.col("__r") == F.col("__need"))
    return materialize(last.select(*g, F.struct(F.col(h).alias("h"), F.col(id_col).alias("i")).alias("__cut")))


def _apply_cut(keyed: DataFrame, cut: DataFrame, g, id_col: str, h: str, out_col: str) -> DataFrame:
    """Row-wise flag: the row's pair is not above its stratum's threshold."""
    j = keyed.join(cut, g, "left") if g else attach_one_row(keyed, cut)
    flag = F.struct(F.col(h).alias("h"), F.col(id_col).alias("i")) <= F.col("__cut")
    return j.withColumn(out_col, F.coalesce(flag, F.lit(False))).drop("__cut")


def exact_cut(df: DataFrame, id_col: str, stratum_col: str | None, fraction: float, seed: int = 42,
              salt: str | None = None, out_col: str = "in_first", bucket_bits: int = BUCKET_BITS,
              stratum_label: str = "all") -> DataFrame:
    """Flag the first ``floor(n * fraction)`` rows of each stratum's seeded shuffle.

    Adds boolean ``out_col``; ``n`` is the stratum size.  Exact, no global sort,
    and the output is one row-wise pass over ``df`` with one row per stratum
    attached.  ``stratum_col=None`` treats the whole frame as one stratum named
    ``stratum_label``.  Ids must be unique.
    """
    h, b = "__h", "__bucket"
    g = [stratum_col] if stratum_col else []
    strat = F.col(stratum_col) if stratum_col else F.lit(stratum_label)
    keyed = _keyed(df, id_col, strat, seed, salt, bucket_bits, h, b)
    cut = _threshold(keyed.select(id_col, *g, h, b), g, id_col, h, b, fraction)
    return _apply_cut(keyed, cut, g, id_col, h, out_col).drop(h, b)


def three_way_split(df: DataFrame, id_col: str, stratum_col: str, holdout_strata=(),
                    pool_fraction: float = 0.70, train_fraction: float = 0.80, seed: int = 42,
                    bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """Per stratum keep ``floor(n*pool_fraction)`` for the pool, rest is
    test; the pooled rows are cut again (one stratum, second salt) into train /
    validation with ``floor(n_pool*train_fraction)`` train rows; holdout strata go
    to test whole.  Adds column ``split``.

    The thresholds are computed over the key columns only; the final assignment
    is a single row-wise pass over ``df`` (no union, no shuffle of rows).
    """
    hold = F.col(stratum_col).isin(*holdout_strata) if holdout_strata else F.lit(False)
    base = df.withColumn("__hold", hold)
    k1 = _keyed(base, id_col, F.col(stratum_col), seed, None, bucket_bits, "__h1", "__b1")
    keys1 = k1.filter(~F.col("__hold")).select(id_col, stratum_col, "__h1", "__b1")
    f1 = _apply_cut(k1, _threshold(keys1, [stratum_col], id_col, "__h1", "__b1", pool_fraction), [stratum_col], id_col, "__h1", "__pool")
    k2 = _keyed(f1, id_col, F.lit("pool"), seed, "pool", bucket_bits, "__h2", "__b2")
    keys2 = k2.filter(~F.col("__hold") & F.col("__pool")).select(id_col, "__h2", "__b2")
    f2 = _apply_cut(k2, _threshold(keys2, [], id_col, "__h2", "__b2", train_fraction), [], id_col, "__h2", "__train")
    split = (F.when(F.col("__hold") | ~F.col("__pool"), "test")
             .when(F.col("__train"), "train").otherwise("validation"))
    return f2.withColumn("split", split).drop("__hold", "__h1", "__b1", "__pool", "__h2", "__b2", "__train")


def head_n(df: DataFrame, order_col: str, n: int) -> DataFrame:
    """T5: first ``n`` rows by ordinal, clamped to the table size (TakeOrdered)."""
    return df.orderBy(order_col).limit(n)


def nested_subsets(df: DataFrame, id_col: str, stratum_col: str, fractions, seed: int = 42, out_col: str = "subset",
                   bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """M13 samples: ``out_col`` is the smallest of the ``fractions`` whose sample holds the row (null: none).

    The sample of a fraction f is the first ``floor(n * f)`` rows of each stratum in one seeded
    order, so sizes are exact and a smaller sample lies in every larger one.  All
    thresholds come from one count of the buckets and one ranking of the boundary buckets'
    rows; the rows themselves are flagged in one pass.  Ids must be unique.
    """
    fractions, g = sorted(fractions), [stratum_col]
    keyed = _keyed(df, id_col, F.col(stratum_col), seed, "subset", bucket_bits, "__h", "__bucket")
    members = keyed.select(id_col, *g, "__h", "__bucket")
    along = Window.partitionBy(*g).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    cum = (members.groupBy(*g, "__bucket").agg(F.count(F.lit(1)).alias("__nb"))
           .withColumns({"__cum": F.sum("__nb").over(along), "__n": F.sum("__nb").over(Window.partitionBy(*g))}))
    cuts = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.floor(F.col("__n") * F.lit(float(f))).cast("bigint").alias("k"))
                               for i, f in enumerate(fractions)]))
    boundary = (cum.withColumn("__c", cuts).where((F.col("__cum") >= F.col("__c.k")) & (F.col("__cum") - F.col("__nb") < F.col("__c.k")))
                .select(*g, "__bucket", F.col("__c.f").alias("__f"), (F.col("__c.k") - F.col("__cum") + F.col("__nb")).alias("__need")))
    ranked = members.join(boundary, [*g, "__bucket"]).withColumn(
        "__r", F.row_number().over(Window.partitionBy(*g, "__f").orderBy("__h", id_col)))
    pair = F.struct(F.col("__h").alias("h"), F.col(id_col).alias("i"))
    last = ranked.where(F.col("__r") == F.col("__need")).groupBy(*g).agg(
        *[F.max(F.when(F.col("__f") == i, pair)).alias(f"__cut{i}") for i in range(len(fractions))])
    flagged = keyed.join(materialize(last), g, "left")
    smallest = F.coalesce(*[F.when(pair <= F.col(f"__cut{i}"), F.lit(float(f))) for i, f in enumerate(fractions)])
    return flagged.withColumn(out_col, smallest).drop("__h", "__bucket", *[f"__cut{i}" for i in range(len(fractions))])


def seeded_shuffle(df: DataFrame, id_col: str, path: str, seed: int = 42, label: str = "all", partitions: int | None = None) -> DataFrame:
    """T1 as an output: the rows of ``df`` in the seeded order, written below ``path`` with
    ``ordinal`` (0, 1, ... without gaps, ties of the key by id).

    Rows are dealt into ranges of the 60-bit key and sorted there (the only shuffle); a row's ordinal
    is its place in its range, which the running id gives, plus the rows of the ranges before.  Only the
    ranges' counts, a row for each, are summed up in one place.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("__h", shuffle_key(seed, F.lit(label), F.col(id_col)))
    ranged = keyed.repartitionByRange(parts, "__h", id_col).sortWithinPartitions("__h", id_col).drop("__h")
    staged = ranged.withColumn("__at", F.monotonically_increasing_id())
    staged.write.parquet(f"{path}/ranges")
    staged = spark.read.schema(staged.schema).parquet(f"{path}/ranges").withColumn("__range", F.shiftright("__at", 33))
    sizes = staged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = F.broadcast(sizes.select("__range", before.alias("__before")))  # a row per range: at most ``parts``
    place = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)
    staged.join(sizes, "__range").select(place.alias("ordinal"), *df.columns).write.parquet(f"{path}/rows")
    return spark.read.parquet(f"{path}/rows")
