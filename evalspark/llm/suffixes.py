"""Repeated passages by column-wise construction of suffix orders and common prefixes.

A byte goes if it is covered by a string of ``LENGTH`` bytes that starts anywhere else too,
in the same or another document.

Inserting one symbol of every document per round would take as many rounds, each over the
whole collection, as the longest document has bytes.  So the strings are first aligned:

1. Every window of ``LENGTH`` bytes names one anchor in it, the ``GRAM`` bytes of least
   hash (the rightmost of equals).  Equal windows name equal anchors at the same place, so
   an anchor whose bytes occur once lies in no repeated window.  Counting (aggregated
   before the shuffle) leaves the anchors that occur again.
2. Anchors are counted with their context, ``SIDE`` bytes to each side.  Where the whole
   context occurs again, all of it is repeated; this settles copies without comparing them.
3. The different contexts of one anchor, one of each, are the aligned collection.
   They go column by column from the right: each round inserts one byte of every context,
   sorts the suffixes stably by it within their anchor (the order of the Burrows-Wheeler
   transform of the column), and updates the common prefixes of neighbours with range
   minima.  A suffix with a neighbour that shares ``LENGTH`` bytes is a repeated window.

The files that the rounds read in sequence are the sorted shuffle files of Spark; a task
holds ``BATCH`` contexts at a time.  An anchor with more than ``MAX_GROUP`` contexts is
split before: windows that start at a range of places share a core, contexts are dealt
by core, and ranges are halved until groups are small or a range is one place, where
equal cores are equal windows.  Nothing is dropped.

Bytes are compared as such in 3.; 1. and 2. rest on XXH3 values of 64 bits for an
anchor and 192 bits for one with its context.

Defined cases: null text is empty; a text shorter than ``LENGTH`` has no repeated bytes;
rows of one id are documents of their own and repeat each other; texts of any length are
taken in pieces; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import workers, written

LENGTH, GRAM = 400, 200
SIDE = LENGTH - GRAM
WINDOW = LENGTH - GRAM + 1   # places of an anchor in a window
WIDTH = GRAM + 2 * SIDE
PIECE = 1 << 19
MAX_GROUP, BATCH = 32_768, 8192  # contexts of WIDTH bytes: a task holds a batch or one larger group, 100 MB at most
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=None)
def _powers(base: int) -> np.ndarray:
    n = PIECE + LENGTH
    out, k = np.ones(n, np.uint64), 1
    with np.errstate(over="ignore"):
        while k < n:
            m = min(k, n - k)
            out[k:k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
            k += m
    return out


@lru_cache(maxsize=None)
def _codes() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _piece_anchors(b: np.ndarray) -> np.ndarray:
    """Anchors of all windows of a piece, ascending."""
    n, low = len(b), np.uint64((1 << 20) - 1)
    with np.errstate(over="ignore"):
        total = np.concatenate(([np.uint64(0)], np.cumsum(_codes()[b] * _powers(_BASE)[:n], dtype=np.uint64)))
        w = (total[GRAM:] - total[:-GRAM]) * _powers(pow(_BASE, -1, 1 << 64))[:n - GRAM + 1]
        for _ in range(2):
            w = (w ^ (w >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    key = (w & ~low) | (low - np.arange(len(w), dtype=np.uint64))  # of equals the rightmost is least
    k = 1
    while 2 * k <= WINDOW:
        key = np.minimum(key[:-k], key[k:])
        k *= 2
    if k < WINDOW:
        key = np.minimum(key[:-(WINDOW - k)], key[WINDOW - k:])
    at = (low - (key & low)).astype(np.int64)
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


def anchors_of(raw: bytes) -> list[int]:
    b, out = np.frombuffer(raw, np.uint8), []
    for s in range(0, len(b) - LENGTH + 1, PIECE):
        out.append(_piece_anchors(b[s:s + PIECE + LENGTH - 1]) + s)
    return np.unique(np.concatenate(out)).tolist() if out else []


def _signed(x: list[int]) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def _anchors(docs: DataFrame, contexts: bool) -> DataFrame:
    """``h`` of every anchor; with contexts also ``uid, pos, l, r, nl, nr``."""
    h = xxhash.xxh3_64_intdigest

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), 256):
                uid, pos, hs, ls, rs, nl, nr = [], [], [], [], [], [], []
                for u, text in zip(f["uid"].iloc[i:i + 256], f["text"].iloc[i:i + 256]):
                    raw = text.encode() if text else b""
                    at = anchors_of(raw) if len(raw) >= LENGTH else []
                    hs += [h(raw[p:p + GRAM]) for p in at]
                    if contexts:
                        uid += [u] * len(at)
                        pos += at
                        ls += [h(raw[max(0, p - SIDE):p]) for p in at]
                        rs += [h(raw[p + GRAM:p + GRAM + SIDE]) for p in at]
                        nl += [min(SIDE, p) for p in at]
                        nr += [min(SIDE, len(raw) - p - GRAM) for p in at]
                yield (pd.DataFrame({"uid": np.array(uid, np.int64), "pos": np.array(pos, np.int64), "h": _signed(hs), "l": _signed(ls),
                                     "r": _signed(rs), "nl": np.array(nl, np.int16), "nr": np.array(nr, np.int16)})
                       if contexts else pd.DataFrame({"h": _signed(hs)}))
    return docs.mapInPandas(run, "uid bigint, pos bigint, h bigint, l bigint, r bigint, nl smallint, nr smallint" if contexts else "h bigint")


def columns(rows: np.ndarray, nl: np.ndarray, nr: np.ndarray, group: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Column-wise insertion.  ``rows``: aligned contexts (m, WIDTH); ``group``: ascending number of
    the anchor; windows that start ``first`` to ``last`` bytes before the anchor are asked for.
    Returns the largest and the least such distance with a repeated window (-1: none)."""
    m = len(rows)
    by_column = np.ascontiguousarray(rows.T)
    order, common = np.arange(m), np.zeros(m + 1, np.int32)  # common[i]: prefix shared by order[i - 1] and order[i]
    most, least = np.full(m, -1), np.full(m, -1)
    for c in range(WIDTH - 1, -1, -1):
        key = group[order] * 256 + by_column[c][order]
        perm = np.argsort(key, kind="stable")
        key, new = key[perm], order[perm]
        outside = (c < SIDE - nl[new]) | (c >= SIDE + GRAM + nr[new])
        same = np.flatnonzero((key[1:] == key[:-1]) & ~outside[1:] & ~outside[:-1])
        fresh = np.zeros(m + 1, np.int32)
        if len(same):
            span = np.empty(2 * len(same), np.int64)
            span[0::2], span[1::2] = perm[same] + 1, perm[same + 1] + 1
            fresh[same + 1] = np.minimum.reduceat(common, span)[::2] + 1
        order, common = new, fresh
        if c <= SIDE:
            x = SIDE - c
            hit = order[np.maximum(common[:-1], common[1:]) >= LENGTH]
            hit = hit[(first[hit] <= x) & (x <= last[hit])]
            most[hit] = x
            least[hit] = np.where(least[hit] < 0, x, least[hit])
    return most, least


def _compare(items: DataFrame) -> DataFrame:
    """Spans ``uid, start, end`` of the single contexts with repeated windows, group by group."""
    workers(items.sparkSession)

    def spans(f: pd.DataFrame) -> pd.DataFrame:
        f = f.reset_index(drop=True)
        nl, nr = f["nl"].to_numpy(np.int64), f["nr"].to_numpy(np.int64)
        raw = b"".join(b"\0" * (SIDE - a) + bytes(c) + b"\0" * (SIDE - z) for c, a, z in zip(f["ctx"], nl.tolist(), nr.tolist()))
        rows = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
        group = np.cumsum(np.concatenate(([0], f["g"].to_numpy()[1:] != f["g"].to_numpy()[:-1])))
        most, least = columns(rows, nl, nr, group, f["first"].to_numpy(np.int64), f["last"].to_numpy(np.int64))
        hit = (most >= 0) & f["single"].to_numpy()
        pos = f["pos"].to_numpy()[hit]
        return pd.DataFrame({"uid": f["uid"].to_numpy()[hit], "start": pos - most[hit], "end": pos + LENGTH - least[hit]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for f in frames:
            held.append(f)
            size += len(f)
            if size >= BATCH:  # whole groups go, the last one waits
                every = pd.concat(held, ignore_index=True)
                g = every["g"].to_numpy()
                cut = int(np.flatnonzero(g == g[-1])[0])
                if cut:
                    yield spans(every.iloc[:cut])
                held, size = [every.iloc[cut:]], len(every) - cut
        if size:
            yield spans(pd.concat(held, ignore_index=True))

    dealt = items.repartition("g").sortWithinPartitions("g")
    return dealt.mapInPandas(run, "uid bigint, start bigint, end bigint")


def _split(items: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Groups of more than MAX_GROUP contexts by cores of ever shorter ranges of windows:
    parts with small groups, and spans of windows that are equal outright."""
    small, spans = [], []
    while True:
        middle = F.floor((F.col("first") + F.col("last")) / 2).cast("int")
        halves = items.withColumn("__r", F.explode(F.array(
            F.struct(F.col("first").alias("a"), middle.alias("z")), F.struct((middle + 1).alias("a"), F.col("last").alias("z")))))
        halves = halves.drop("first", "last").select("*", F.col("__r.a").alias("first"), F.col("__r.z").alias("last")).drop("__r")
        halves = halves.where("first <= last and nl >= first and nr >= %d - last" % SIDE)
        # what all windows that start `first` to `last` bytes before the anchor have in common
        core = F.substring(F.col("ctx"), F.col("nl").cast("int") - F.col("first") + 1, F.col("first") + GRAM + SIDE - F.col("last"))
        halves = written(halves.withColumn("g", F.xxhash64(F.col("h"), "first", "last", core)), "suffix-halves")
        sizes = halves.groupBy("g").agg(F.count("*").alias("k"), F.max("single").alias("asks")).where("k > 1 and asks")
        dealt = written(halves.drop("k").join(sizes.select("g", "k"), "g"), "suffix-dealt")
        spans.append(dealt.where("first = last and single").select(
            "uid", (F.col("pos") - F.col("first")).alias("start"), (F.col("pos") - F.col("first") + LENGTH).alias("end")))
        small.append(dealt.where(f"first < last and k <= {MAX_GROUP}"))
        items = dealt.where(f"first < last and k > {MAX_GROUP}")
        if not items.limit(1).count():
            return small, spans


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``text`` and ``removed``: ascending runs (start, end) of repeated bytes."""
    spark = docs.sparkSession
    workers(spark)
    rows = docs.select(F.col(key).alias(key), F.col(text).alias("text"))
    n = rows.agg(F.count("*").alias("n"), F.count_distinct(key).alias("d")).first()
    if n["n"] == n["d"] and dict(rows.dtypes)[key] == "bigint":
        rows = rows.withColumn("uid", F.col(key))
    else:  # ids that are null or repeated can't tell rows apart: number them once, in files
        rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "suffix-docs")
    plain = rows.select("uid", "text")

    # written, so that the join reads two plain exchanges and a common anchor's rows can be split
    again = written(_anchors(plain, False).groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "suffix-again")
    hits = written(_anchors(plain, True).join(again, "h"), "suffix-hits")
    contexts = written(hits.groupBy("h", "l", "r").agg(F.count("*").alias("n"), F.min(F.struct("uid", "pos", "nl", "nr")).alias("x")), "suffix-contexts")
    whole = (hits.join(contexts.where("n > 1").select("h", "l", "r"), ["h", "l", "r"])
             .select("uid", (F.col("pos") - F.col("nl")).alias("start"), (F.col("pos") + GRAM + F.col("nr")).alias("end")))

    groups = contexts.groupBy("h").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1").select("h", "k")
    asked = contexts.join(groups, "h").select("h", "k", "x.*", (F.col("n") == 1).alias("single"))
    per_doc = written(asked.groupBy("uid").agg(F.collect_list(F.struct("h", "k", "pos", "nl", "nr", "single")).alias("at")), "suffix-asked")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), 64):
                out = []
                for u, text, at in zip(f["uid"].iloc[i:i + 64], f["text"].iloc[i:i + 64], f["at"].iloc[i:i + 64]):
                    raw = text.encode()
                    out += [(a["h"], a["k"], u, a["pos"], a["nl"], a["nr"], a["single"], raw[a["pos"] - a["nl"]:a["pos"] + GRAM + a["nr"]]) for a in at]
                yield pd.DataFrame(out, columns=["h", "k", "uid", "pos", "nl", "nr", "single", "ctx"])

    items = plain.join(per_doc.hint("merge"), "uid").mapInPandas(  # the same plan at every size
        cut, "h bigint, k bigint, uid bigint, pos bigint, nl smallint, nr smallint, single boolean, ctx binary")
    items = items.select("*", F.col("h").alias("g"), F.lit(0).alias("first"), F.lit(SIDE).alias("last"))
    hot = groups.where(f"k > {MAX_GROUP}").limit(1).count() > 0
    parts, direct = [items.where(f"k <= {MAX_GROUP}")], []
    if hot:
        items = written(items, "suffix-items")
        parts, direct = [items.where(f"k <= {MAX_GROUP}")], []
        more, direct = _split(items.where(f"k > {MAX_GROUP}"))
        parts += more
    names = ["g", "uid", "pos", "nl", "nr", "single", "ctx", "first", "last"]
    union = parts[0].select(*names)
    for p in parts[1:]:
        union = union.unionByName(p.select(*names))
    spans = whole.unionByName(_compare(union))
    for d in direct:
        spans = spans.unionByName(d)
    spans = written(spans.groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("s")).select("uid", merged(F.col("s")).alias("removed")),
                    "suffix-spans")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return rows.join(spans.hint("merge"), "uid", "left").select(
        key, "text", F.coalesce("removed", none).alias("removed"))


def merged(spans: Column) -> Column:
    """Union of spans as ascending runs that don't touch."""
    @F.pandas_udf("array<struct<start:bigint,end:bigint>>")
    def run(all_spans: pd.Series) -> pd.Series:
        out = []
        for spans in all_spans:
            ordered = np.array(sorted((s["start"], s["end"]) for s in spans), np.int64)
            reach = np.maximum.accumulate(ordered[:, 1])
            new = np.flatnonzero(np.concatenate(([True], ordered[1:, 0] > reach[:-1])))
            ends = reach[np.concatenate((new[1:] - 1, [len(ordered) - 1]))]
            out.append([{"start": int(a), "end": int(z)} for a, z in zip(ordered[new, 0], ends)])
        return pd.Series(out, dtype=object)
    return run(spans)


def kept(raw: bytes, removed) -> bytes:
    """The bytes outside the removed runs."""
    out, at = [], 0
    for r in removed:
        out.append(raw[at:r["start"]])
        at = r["end"]
    return b"".join([*out, raw[at:]])
