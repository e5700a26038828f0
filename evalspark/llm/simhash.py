"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint: texts are lower-cased (A-Z), split at ASCII white space, and every shingle
of ``shingle`` words (repeats included) is hashed with XXH64, seed 42; a bit is set
where more than half the hashes have it.  Texts of fewer words are one shingle; texts
without words have fingerprint zero and link like any other.

Linking at ``max_bits`` differing bits: the 64 bits are grouped into parts, correlated
bits together.  If the parts get thresholds t_i >= -1 with sum(t_i + 1) = max_bits + 1,
two fingerprints within ``max_bits`` agree within t_i bits on some part (a part at -1 is
not probed).  Candidate counts of every part and threshold are estimated from the value
counts of all distinct fingerprints, and a dynamic program allots the thresholds of the
least total.  A fingerprint is dealt to its value on each probed part and, for t_i >= 1,
to the values that differ in up to t_i bits.

Groups of one probed value are refined by the same principle on the other bits: a group
key holds the part's value and the value of one of ``max_bits + 1`` pieces of the rest,
so keys are narrow even if one part's value is very common.  Within a group equal
values never form all pairs: members are linked by verified distances to a spanning
forest (at most one link per member), whose links alone leave the task.  Components
of these links are found by alternating hooking to the smallest neighbour and pointer jumping.

Defined cases: null text is empty; an empty table gives no rows; repeated rows and ids
stay; a null id is ignored by the component's smallest id unless there is no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import broadcast_under, workers, written

SEED = 42


def fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return 0
    whole, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [h(whole, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[: len(words) - shingle])).tolist()
        hashes = [h(whole[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[i:i + (1 << 15)], dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``key, fp`` for every row."""
    workers(docs.sparkSession)

    @F.pandas_udf("bigint")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")
    return docs.select(F.col(key).alias("doc_id"), fp(F.col(text)).alias("fp"))


# --- parts and thresholds ---------------------------------------------------

def bits_of(fps: np.ndarray) -> np.ndarray:
    return ((fps.astype(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)


def _moments(distinct: DataFrame) -> tuple[np.ndarray, int]:
    """Correlation of the 64 bits over all distinct fingerprints (sums are taken by the tasks)."""
    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, n = np.zeros((65, 65)), 0
        for f in frames:
            b = bits_of(f["fp"].to_numpy()).astype(np.float32)
            b = np.hstack([b, np.ones((len(b), 1), np.float32)])
            gram, n = gram + b.T @ b, n + len(b)
        yield pd.DataFrame({"i": np.arange(65 * 65), "v": gram.ravel()})

    rows = distinct.select("fp").mapInPandas(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # 4,225 rows
    g = np.zeros(65 * 65)
    for r in rows:
        g[r["i"]] = r["v"]
    g = g.reshape(65, 65)
    n = int(g[64, 64])
    if n == 0:
        return np.eye(64), 0
    mean = g[:64, 64] / n
    cov = g[:64, :64] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    return np.abs(cov / np.outer(sd, sd)), n


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """``m`` parts of near equal width; a part takes the free bit most correlated with its own."""
    free, parts = set(range(64)), []
    for i in range(m):
        width = len(free) // (m - i)
        seed = min(free, key=lambda b: (-corr[b, list(free)].sum(), b))
        part = [seed]
        free.discard(seed)
        while len(part) < width:
            best = min(free, key=lambda b: (-corr[b, part].sum(), b))
            part.append(best)
            free.discard(best)
        parts.append(sorted(part))
    return parts


def allot(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = budget and the least sum of costs[i][t_i + 1]."""
    best = {0: (0.0, [])}
    for c in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (total, ts) in best.items():
            for k in range(min(budget - used, len(c) - 1) + 1):
                cand = (total + c[k], ts + [k - 1])
                if used + k not in new or cand < new[used + k]:
                    new[used + k] = cand
        best = new
    return best[budget]


def pack(bits: np.ndarray, part: list[int]) -> np.ndarray:
    """Values of the given bits as integers."""
    return bits[:, part].astype(np.int64) @ (np.int64(1) << np.arange(len(part), dtype=np.int64))


def _flips(part: list[int], t: int) -> list[int]:
    """Masks over a part's value of up to ``t`` bits."""
    masks = {0}
    for _ in range(t):
        masks |= {m ^ (1 << i) for m in masks for i in range(len(part))}
    return sorted(masks)


def choose_parts(distinct: DataFrame, max_bits: int) -> tuple[list[list[int]], list[int]]:
    """Parts and thresholds of the least estimated cost (candidates and dealt rows)."""
    corr, n = _moments(distinct)
    choices = []
    for m in sorted({2, max_bits + 1} - {0, 1}) or [1]:
        parts = group_bits(corr, m)

        def values(frames, parts=parts):
            for f in frames:
                b = bits_of(f["fp"].to_numpy())
                yield pd.concat([pd.DataFrame({"part": i, "v": pack(b, p)}) for i, p in enumerate(parts)])

        seen = (distinct.select("fp").mapInPandas(values, "part int, v bigint").groupBy("part", "v").agg(F.count("*").alias("c"))
                .groupBy("part").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("pairs")).collect())
        pairs = {r["part"]: r["pairs"] for r in seen}
        costs = []
        for i, p in enumerate(parts):
            own, c = pairs.get(i, 0.0), [0.0]
            for t in range(max_bits + 1):
                k = len(_flips(p, t)) if len(p) <= 32 or t < 2 else 1 << 20
                # values around a value hold about as many as the mean value: n / 2^width
                c.append(n * k + own + (k - 1) * n * n / 2 / float(2 ** len(p)))
            costs.append(c)
        choices.append((allot(costs, max_bits + 1), m, parts))
    (_, thresholds), _, parts = min(choices, key=lambda x: (x[0][0], x[1]))
    return parts, thresholds


# --- links within groups ----------------------------------------------------

BLOCK = 512


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest (index pairs) of the links of distinct fingerprints: sub-groups by
    pieces of the bits, compared in blocks."""
    n, out = len(fps), []
    parent = np.arange(n)

    def compare(ix: np.ndarray) -> None:
        for a in range(0, len(ix), BLOCK):
            left = fps[ix[a:a + BLOCK]]
            for b in range(a, len(ix), BLOCK):
                near = np.bitwise_count(left[:, None] ^ fps[ix[b:b + BLOCK]][None, :]) <= max_bits
                for i, j in zip(*np.nonzero(near)):
                    x, y = ix[a + i], ix[b + j]
                    if x < y:
                        rx, ry = _find(parent, x), _find(parent, y)
                        if rx != ry:
                            parent[max(rx, ry)] = min(rx, ry)
                            out.append((int(x), int(y)))

    def split(ix: np.ndarray, pieces: list[list[int]]) -> None:
        if len(ix) <= 2 * BLOCK or not pieces:
            compare(ix)
            return
        # pieces of equal value on one of max_bits + 1 disjoint bit sets
        for k, piece in enumerate(pieces):
            v = pack(bits_of(fps[ix]), piece)
            order = np.argsort(v, kind="stable")
            cuts = np.flatnonzero(np.diff(v[order])) + 1
            for g in np.split(order, cuts):
                if len(g) > 1:
                    compare(ix[np.sort(g)])

    varying = [b for b in range(64) if len(np.unique(fps >> np.uint64(b) & np.uint64(1))) > 1] if n else []
    m = max_bits + 1
    split(np.arange(n), [varying[i::m] for i in range(m)] if len(varying) >= 4 * m else [])
    return out


def links(distinct: DataFrame, parts: list[list[int]], thresholds: list[int], max_bits: int) -> DataFrame:
    """Links ``a, b`` of distinct fingerprints whose components are those of all links."""
    workers(distinct.sparkSession)
    probed = [(i, p, t) for i, (p, t) in enumerate(zip(parts, thresholds)) if t >= 0]

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = f["fp"].to_numpy()
            bits = bits_of(fp)
            for i, part, t in probed:
                rest = [b for b in range(64) if b not in part]
                value = pack(bits, part)
                for j in range(max_bits + 1):
                    piece = rest[j::max_bits + 1]
                    sub = pack(bits, piece)
                    for flip in _flips(part, t):
                        yield pd.DataFrame({"part": i * 8 + j, "v": value ^ flip, "sub": sub, "fp": fp})

    dealt = distinct.select("fp").mapInPandas(deal, "part int, v bigint, sub bigint, fp bigint")
    # a piece beside the part holds no difference or the pair differs there: max_bits + 1 pieces suffice
    shared = dealt.repartition("part", "v", "sub").sortWithinPartitions("part", "v", "sub", "fp")

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            keys = f[["part", "v", "sub"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            ready = cuts[-1] if len(cuts) else 0
            held = f.iloc[ready:]
            yield pairs(f["fp"].to_numpy()[:ready], cuts[:-1])
        if held is not None:
            yield pairs(held["fp"].to_numpy(), [])

    def pairs(fp: np.ndarray, cuts) -> pd.DataFrame:
        a, b, u = [], [], fp.view(np.uint64) if len(fp) else fp.astype(np.uint64)
        bounds = np.concatenate(([0], cuts, [len(fp)])).astype(int)
        for k in np.flatnonzero(np.diff(bounds) > 1):
            g = np.unique(u[bounds[k]:bounds[k + 1]])
            for i, j in forest(g, max_bits):
                a.append(g[i])
                b.append(g[j])
        return pd.DataFrame({"a": np.array(a, np.uint64).view(np.int64), "b": np.array(b, np.uint64).view(np.int64)})

    return shared.mapInPandas(link, "a bigint, b bigint").distinct()


# --- components -------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable.  Rounds of hooking every node to the
    smallest root among its neighbours' and jumping to the root's root; each round is written."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b"), "edges")
    label = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = (both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("m")))
        hooked = label.join(near, label["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        # a node's old root learns of the smaller one too, then all jump
        hook = hooked.groupBy(F.col("old").alias("r")).agg(F.min("root").alias("m"))
        step = hooked.join(hook, hooked["root"] == hook["r"], "left").select(
            "node", "old", F.least("root", "m").alias("root"))
        step = written(step, "labels")
        if not step.where("old <> root").limit(1).count():
            return step.select("node", "root")
        label = step.select("node", "root")


def assign(prints: DataFrame, max_bits: int) -> DataFrame:
    """``doc_id, fp`` rows with ``component_id`` and ``component_fp``."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    parts, thresholds = choose_parts(distinct, max_bits)
    comp = components(links(distinct, parts, thresholds, max_bits))
    of = distinct.join(comp, distinct["fp"] == comp["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("component_fp"))
    ids = of.groupBy("component_fp").agg(F.min("least").alias("component_id"))
    of = of.join(ids, "component_fp").select("fp", "component_fp", "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id", "component_fp")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id`` (smallest id reachable) and
    ``component_fp`` (smallest fingerprint reachable)."""
    return assign(written(fingerprints(docs, key, text, shingle), "simhash"), max_bits)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (of rows with one id the
    smallest fingerprint, of rows equal in both any)."""
    workers(docs.sparkSession)

    @F.pandas_udf("bigint")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")
    keyed = written(docs.withColumn("__fp", fp(F.col(text))), "simhash-docs")
    of = written(assign(keyed.select(F.col(key).alias("doc_id"), F.col("__fp").alias("fp")), max_bits), "simhash-of")
    least = of.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_fp").agg(F.min("fp").alias("rep"))
    judged = of.join(least, "component_fp")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("rep"))
    out = judged.where(~stays).select(F.col("doc_id").alias("__id"), F.col("fp").alias("__other")).distinct()
    again = judged.where(stays).groupBy(F.col("doc_id").alias("__id"), F.col("fp").alias("__other")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    again = written(again, "simhash-again")
    gone = written(out.unionByName(again), "simhash-gone")
    same = keyed[key].eqNullSafe(F.col("__id")) & (keyed["__fp"] == F.col("__other"))
    kept = keyed.join(broadcast_under(gone, gone.count(), 32), same, "left_anti")
    if again.limit(1).count():  # rows of one id and one fingerprint: any one of them
        kept = kept.unionByName(keyed.join(again, same, "left_semi").dropDuplicates([key, "__fp"]))
    return kept.drop("__fp")
