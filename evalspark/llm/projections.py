"""Near-duplicate embeddings by collision counting over sorted one-dimensional projections.

Every distinct vector is projected on random directions.  There are ``orders`` sorted orders;
one sorts by the signs of ``signs`` projections and then by the value of a further one.  With a
vector as query, its window holds the vectors of equal signs whose value is within ``window`` of its
own: they collide with it in this order.  Pairs that collide in at least ``least`` orders are
verified by their cosine in double precision.

Calibration: for two vectors at the threshold's angle t, a sign agrees with probability
1 - t/pi and a Gaussian projection of unit vectors differs by a normal deviate of variance
2 - 2 cos t, whatever the data.  So the chance to collide in an order is known; ``calibrate`` takes
the signs that leave about ``room`` vectors in a run of equal signs and the fewest orders whose
binomial chance of ``least`` collisions reaches the wanted recall at the threshold (nearer pairs
collide more often).

A run of equal signs is a Spark group and its windows are walked in one task.  A pair is judged
in the first order it collides in, from the signs and values of all orders that its rows
carry; so it is judged once, and tasks emit no pairs: a row for each linked vector with its
number of links there and the vector it hangs on in the run's spanning forest.

Large groups: equal vectors are one row with a multiplicity.  Up to ``2**BALL_SIGNS`` leaders (the
first vector of every combination of signs) form balls of half the threshold's angle: members of one
ball link by the triangle inequality, are counted by the ball's size and never compared.
A run of more than ``4 * room`` rows is dealt in chunks and judged by pairs of chunks, without
those inside one ball; no task holds more than two chunks, and no pair is left out.

Defined cases: a vector that is null, empty or zero, or holds a null or non-finite component
links with nothing; vectors of different lengths do not link; rows of equal vectors link; ids may
repeat (every row is a vector of its own) or be null (ignored by a component's smallest
id unless there is no other); an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .simhash import components
from .util import broadcast_under, workers, written

SEED = 20_250
BALL_SIGNS = 10
#: queries compared at once, and pairs verified at once
QUERIES, PAIRS = 256, 1 << 16


@dataclass(frozen=True)
class Plan:
    cosine: float
    signs: int
    orders: int
    window: float
    least: int


def calibrate(n: int, cosine: float, recall: float = 0.98, room: int = 4096, least: int = 2, inside: float = 0.95) -> Plan:
    """The plan for ``n`` vectors; ``inside`` is the chance that a pair at the threshold is in a window."""
    signs = max(0, math.ceil(math.log2(max(n, 1) / room)))
    p = inside * (1 - math.acos(cosine) / math.pi) ** signs
    orders = least
    while sum(math.comb(orders, c) * p ** c * (1 - p) ** (orders - c) for c in range(least)) > 1 - recall:
        orders += 1
    return Plan(cosine, signs, orders, NormalDist().inv_cdf((1 + inside) / 2) * math.sqrt(2 - 2 * cosine), least)


def usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow below
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def directions(dim: int, count: int, purpose: int) -> np.ndarray:
    return np.random.default_rng((SEED, dim, purpose)).standard_normal((count, dim))


def by_length(column: pa.Array):
    """(dimension, row numbers, unit vectors) of the list column's vectors of each length."""
    lengths = np.asarray(column.value_lengths())
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        rows = column.take(pa.array(at))
        yield int(dim), at, unit(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim))


def packed(bits: np.ndarray) -> np.ndarray:
    return bits.astype(np.int64) @ (1 << np.arange(bits.shape[-1], dtype=np.int64))


def flat_list(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def leaders(distinct: DataFrame, vec_type: str) -> dict[int, tuple[list, np.ndarray]]:
    """By vector length: the first vectors (number, unit vector) of every combination of signs."""
    def run(batches):
        first: dict = {}
        for batch in batches:
            u = batch.column("u").to_numpy()
            for dim, at, x in by_length(batch.column("v")):
                sign = packed(x @ directions(dim, BALL_SIGNS, 0).T > 0)
                for i in np.argsort(u[at], kind="stable"):
                    k = (dim, int(sign[i]))
                    if k not in first or u[at[i]] < first[k][0]:
                        first[k] = (int(u[at[i]]), batch.column("v")[int(at[i])].as_py())
        if first:
            yield pa.RecordBatch.from_pydict({"dim": pa.array([k[0] for k in first], pa.int32()), "sign": [k[1] for k in first],
                                              "u": [x[0] for x in first.values()], "v": pa.array([x[1] for x in first.values()], vec_pa)})
    vec_pa = pa.list_(pa.float64())
    tasks = distinct.select("u", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "dim int, sign bigint, u bigint, v array<double>")
    rows = tasks.groupBy("dim", "sign").agg(F.min_by(F.struct("u", "v"), "u").alias("x")).collect()  # 2**BALL_SIGNS vectors of a length
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r["dim"], r["sign"])):
        out.setdefault(r["dim"], []).append(r["x"])
    return {d: ([x["u"] for x in xs], unit(np.array([x["v"] for x in xs]))) for d, xs in out.items()}


def sketches(distinct: DataFrame, plan: Plan, vec_type: str) -> DataFrame:
    """``distinct`` with ``dim``, ``ball`` (its leader's number, or -1), and each order's ``cells`` and ``values``."""
    lead = leaders(distinct, vec_type)
    half = math.cos(math.acos(plan.cosine) / 2 - 1e-7)

    def run(batches):
        for batch in batches:
            n = len(batch)
            dims, ball = np.zeros(n, np.int32), np.full(n, -1, np.int64)
            cells, values = np.zeros((n, plan.orders), np.int64), np.zeros((n, plan.orders), np.float32)
            for dim, at, x in by_length(batch.column("v")):
                dims[at] = dim
                ids, units = lead[dim]
                cos = x @ units.T
                near = cos.argmax(axis=1)
                ball[at] = np.where(cos[np.arange(len(at)), near] >= half, np.array(ids)[near], -1)
                p = (x @ directions(dim, plan.orders * (plan.signs + 1), 1).T).reshape(len(at), plan.orders, plan.signs + 1)
                cells[at], values[at] = packed(p[:, :, 1:] > 0), p[:, :, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(ball), flat_list(cells), flat_list(values)],
                                             [*batch.schema.names, "dim", "ball", "cells", "values"])
    cols = "u bigint, times bigint, v " + vec_type + ", dim int, ball bigint, cells array<bigint>, values array<float>"
    return distinct.select("u", "times", "v").mapInArrow(run, cols)


# --- runs, dealt in chunks where they are large ------------------------------

RUN = ["run_order", "dim", "cell"]


def dealt(sk: DataFrame, plan: Plan, most: int) -> DataFrame:
    """Rows of every run: ``block`` names the pair of chunks ('' for a run of one), ``side`` its chunk."""
    rows = sk.select("*", F.posexplode("cells").alias("run_order", "cell"))
    if plan.least > 1:  # a pair first seen in the last orders cannot reach the count
        rows = rows.where(F.col("run_order") <= plan.orders - plan.least)
    sizes = written(rows.groupBy(*RUN, "ball").agg(F.count("*").alias("n")), "runs")
    hot = sizes.groupBy(*RUN).agg(F.sum("n").alias("all")).where(F.col("all") > most).select(*RUN)
    sizes = sizes.join(hot, RUN).withColumn("part", F.when((F.col("ball") >= 0) & (F.col("n") > most // 2), F.col("ball")).otherwise(-1))
    parts = sizes.groupBy(*RUN, "part").agg(F.ceil(F.sum("n") / most).cast("int").alias("chunks"))
    of_ball = written(sizes.select(*RUN, "ball", "part").join(parts, [*RUN, "part"]), "parts")
    n_parts = of_ball.count()
    if n_parts == 0:
        return rows.withColumns({"block": F.lit(""), "side": F.lit(0)})
    chunk = parts.select(*RUN, "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i")).select(*RUN, F.struct("part", "i").alias("c"))
    two = chunk.withColumnRenamed("c", "l").join(chunk.withColumnRenamed("c", "r"), RUN)
    two = two.where((F.col("l") <= F.col("r")) & ~((F.col("l.part") >= 0) & (F.col("l.part") == F.col("r.part"))))
    block = F.concat_ws(":", "l.part", "l.i", "r.part", "r.i")
    ends = F.when(F.col("l") == F.col("r"), F.array(F.struct(F.col("l").alias("c"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("l").alias("c"), F.lit(0).alias("side")), F.struct(F.col("r").alias("c"), F.lit(1).alias("side"))))
    goes = two.select(*RUN, block.alias("block"), F.inline(ends)).select(*RUN, "c.part", "c.i", "block", "side")
    goes = written(goes.groupBy(*RUN, "part", "i").agg(F.collect_list(F.struct("block", "side")).alias("goes")), "blocks")
    rows = rows.join(broadcast_under(of_ball, n_parts, 40), [*RUN, "ball"], "left")
    rows = rows.withColumn("i", F.pmod(F.xxhash64("u"), F.col("chunks")).cast("int"))
    own = [*sk.columns, "run_order", "cell"]
    split = rows.where("chunks IS NOT NULL").join(goes, [*RUN, "part", "i"]).select(*own, F.inline("goes"))
    return rows.where("chunks IS NULL").select(*own, F.lit("").alias("block"), F.lit(0).alias("side")).unionByName(split)


def hook(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after links (i, j): larger roots hang on smaller ones until none differ."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def judge(t: pa.Table, plan: Plan) -> pa.Table:
    """Links of one run or pair of chunks: ``u, n, root`` of every vector with links there."""
    order = t["run_order"][0].as_py()
    value = np.stack(t["values"].combine_chunks().flatten().to_numpy().reshape(len(t), -1))
    u = t["u"].to_numpy()
    at = np.lexsort((u, value[:, order]))
    cell = t["cells"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)[at]
    value, u, times, ball, side = value[at], u[at], t["times"].to_numpy()[at], t["ball"].to_numpy()[at], t["side"].to_numpy()[at]
    x = unit(t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)[at])
    p, n, root = value[:, order], np.zeros(len(u), np.int64), np.arange(len(u))
    two_sided = bool(side.any())
    for start in range(0, len(u), QUERIES):
        q = slice(start, min(start + QUERIES, len(u)))
        w = slice(start, np.searchsorted(p, p[q][-1] + np.float32(plan.window), "right"))
        # windows to the right of each query: the pair's other half is its own query's
        open_ = (np.arange(w.start, w.stop)[None, :] > np.arange(q.start, q.stop)[:, None]) & (p[w][None, :] - p[q][:, None] <= plan.window)
        open_ &= (ball[q][:, None] < 0) | (ball[q][:, None] != ball[w][None, :])
        if two_sided:
            open_ &= side[q][:, None] != side[w][None, :]
        count = np.ones(open_.shape, np.uint8)
        for other in range(plan.orders):
            if other != order:
                i, j = np.nonzero(open_ & (cell[q, other][:, None] == cell[w, other][None, :]))
                hit = np.abs(value[q.start + i, other] - value[w.start + j, other]) <= plan.window
                i, j = i[hit], j[hit]
                if other < order:  # judged in that order's run
                    open_[i, j] = False
                else:
                    count[i, j] += 1
        i, j = np.nonzero(open_ & (count >= plan.least))
        i, j = verified(x, i + q.start, j + w.start, plan.cosine)
        np.add.at(n, i, times[j])
        np.add.at(n, j, times[i])
        root = hook(root, i, j)
    linked = n > 0
    return pa.table({"u": u[linked], "n": n[linked], "root": u[root[linked]]})


def verified(x: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    good = np.zeros(len(i), bool)
    for a in range(0, len(i), PAIRS):
        s = slice(a, a + PAIRS)
        good[s] = np.einsum("ij,ij->i", x[i[s]], x[j[s]]) >= cosine
    return i[good], j[good]


def near_duplicates(df: DataFrame, key: str = "vec_id", vec: str = "embedding", cosine: float = 0.9, recall: float = 0.98,
                    room: int = 4096) -> DataFrame:
    """One row per row of ``df``: its key, ``n_links`` (other vectors linked directly) and
    ``component_id`` (smallest key reachable)."""
    workers(df.sparkSession)
    own = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]  # 128 bits name a vector
    rows = df.select(F.col(key).alias("k"), F.col(vec).alias("v")).withColumn("good", usable(F.col("v")))
    hashed = rows.where("good").select("k", "v", *own)
    distinct = hashed.groupBy("h1", "h2").agg(F.any_value("v").alias("v"), F.count("*").alias("times"), F.min("k").alias("least"))
    distinct = written(distinct.withColumn("u", F.monotonically_increasing_id()), "vectors")
    plan = calibrate(distinct.count(), cosine, recall, room)
    sk = written(sketches(distinct, plan, df.schema[vec].dataType.simpleString()), "sketches")
    found = dealt(sk, plan, 4 * room).groupBy(*RUN, "block").applyInArrow(lambda t: judge(t, plan), "u bigint, n bigint, root bigint")
    found = written(found, "links")
    in_ball = sk.where("ball >= 0").groupBy("dim", "ball").agg(F.sum("times").alias("all"))  # 2**BALL_SIGNS balls of a length
    links = found.groupBy("u").agg(F.sum("n").alias("n"))
    # a node sorts by its smallest key, so that a component's root knows the smallest of all
    node = F.struct(F.col("least").isNull().alias("none"), "least", "u").alias("node")
    nodes = distinct.select("u", node)
    edges = found.select("u", F.col("root").alias("to")).union(sk.where("ball >= 0").select("u", "ball")).where("u <> to").distinct()
    edges = edges.join(nodes.withColumnRenamed("node", "a"), "u").join(nodes.select(F.col("u").alias("to"), F.col("node").alias("b")), "to")
    of = components(edges.select("a", "b")).select(F.col("node.u").alias("u"), F.col("root.least").alias("reached"))
    n_links = F.col("times") - 1 + F.coalesce(F.col("all") - F.col("times"), F.lit(0)) + F.coalesce("n", F.lit(0))
    known = (distinct.select("h1", "h2", "u", "least", "times").join(sk.select("u", "dim", "ball"), "u").join(in_ball, ["dim", "ball"], "left")
             .join(links, "u", "left").join(of.withColumn("joined", F.lit(True)), "u", "left")
             .select("h1", "h2", n_links.alias("n_links"), F.when(F.col("joined"), F.col("reached")).otherwise(F.col("least")).alias("component_id")))
    good = hashed.drop("v").join(known, ["h1", "h2"]).select("k", "n_links", "component_id")
    rest = rows.where("NOT good").select("k", F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"))
    return good.unionByName(rest).withColumnRenamed("k", key)
