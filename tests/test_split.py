"""Exact sizes (FIXTURES 3.3), disjoint + complete, partition independence,
equality with the row_number definition."""

from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from evalspark.operators import split as T


def _frame(spark, sizes, parts=4):
    rows = spark.range(sum(sizes.values()), numPartitions=parts)
    bounds, acc = [], 0
    for name, n in sizes.items():
        bounds.append((name, acc, acc + n))
        acc += n
    stratum = None
    for name, lo, hi in bounds:
        cond = (F.col("id") >= lo) & (F.col("id") < hi)
        stratum = F.when(cond, name) if stratum is None else stratum.when(cond, name)
    return rows.withColumn("stratum", stratum)


def test_published_sizes(spark):
    df = _frame(spark, {"easy": 38280, "medium": 6907, "hard": 10613})
    out = T.three_way_split(df, "id", "stratum", holdout_strata=["hard"])
    c = {(r["stratum"], r["split"]): r["count"] for r in out.groupBy("stratum", "split").count().collect()}
    assert c[("easy", "test")] == 11484 and c[("medium", "test")] == 2073 and c[("hard", "test")] == 10613
    train = sum(v for (s, sp), v in c.items() if sp == "train")
    val = sum(v for (s, sp), v in c.items() if sp == "validation")
    assert (train, val) == (25304, 6326)  # floor(31630 * 0.8)
    assert out.count() == 38280 + 6907 + 10613
    assert out.select("id").distinct().count() == out.count()


def test_cut_equals_row_number_and_ignores_partitioning(spark):
    df = _frame(spark, {"a": 1234, "b": 7, "c": 1, "d": 500}, parts=3)
    cut = T.exact_cut(df, "id", "stratum", 0.7, seed=11)
    key = T.shuffle_key(11, F.col("stratum"), F.col("id"))
    w = Window.partitionBy("stratum").orderBy(key, "id")
    ref = (df.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("stratum")))
             .withColumn("ref", F.col("rn") <= F.floor(F.col("n") * 0.7)))
    j = cut.join(ref.select("id", "ref"), "id")
    assert j.filter(F.col("in_first") != F.col("ref")).count() == 0
    again = T.exact_cut(df.repartition(7), "id", "stratum", 0.7, seed=11).filter("in_first").select("id")
    assert again.exceptAll(cut.filter("in_first").select("id")).count() == 0
    sizes = {r["stratum"]: r["count"] for r in cut.filter("in_first").groupBy("stratum").count().collect()}
    assert sizes == {"a": 863, "b": 4, "d": 350}  # floor(n * 0.7); stratum c (n=1) keeps none


def test_head_n_clamps(spark):
    df = spark.range(10)
    assert [r["id"] for r in T.head_n(df, "id", 3).collect()] == [0, 1, 2]
    assert T.head_n(df, "id", 50).count() == 10


def test_nested_subsets_are_exact_and_nested(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(3001)] + [(9000, "one")]
    df = spark.createDataFrame(rows, "id long, s string").repartition(7)
    for bits in (3, 20):
        out = T.nested_subsets(df, "id", "s", [0.5, 0.1, 0.25], bucket_bits=bits).collect()
        sizes, got = Counter(s for _, s in rows), Counter((r.s, r.subset) for r in out)
        assert len(out) == len(rows)
        for s, n in sizes.items():
            cum = 0
            for f in (0.1, 0.25, 0.5):
                cum += got[(s, f)]
                assert cum == int(n * f)
    order = {r.id: (r.h, r.id) for r in df.select("id", T.shuffle_key(42, F.col("s"), F.col("id"), "subset").alias("h")).collect()}
    for s in sizes:
        ranked = sorted((order[r.id], r.subset or 1.0) for r in out if r.s == s)
        assert [f for _, f in ranked] == sorted(f for _, f in ranked)  # the first of one order


def test_seeded_shuffle_is_a_permutation(spark, tmp_path):
    df = spark.range(5000, numPartitions=5).withColumn("x", F.col("id") * 2)
    out = T.seeded_shuffle(df, "id", str(tmp_path / "s"), seed=3, partitions=7)
    rows = out.withColumn("h", T.shuffle_key(3, F.lit("all"), F.col("id"))).collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.ordinal)] == [r.id for r in sorted(rows, key=lambda r: (r.h, r.id))]
    assert sorted(r.ordinal for r in rows) == list(range(5000)) and all(r.x == 2 * r.id for r in rows)
    again = T.seeded_shuffle(df.repartition(3), "id", str(tmp_path / "t"), seed=3, partitions=2)
    assert {(r.ordinal, r.id) for r in again.collect()} == {(r.ordinal, r.id) for r in rows}
    assert T.seeded_shuffle(df.limit(0), "id", str(tmp_path / "e"), partitions=2).count() == 0
