"""Benchmark decontamination by the q-gram lemma.

Texts are compared in lower case with runs of white space as one blank.  Every stretch of
``window`` characters of a benchmark item, at any start, is a window (items up to that
length are one); a document leaks an item if some window aligns with a part of it within
``rate * length`` edits.  Two strings within e edits share at least ``n + 1 - q (e + 1)``
q-grams, all on e + 1 neighbouring diagonals (document position minus item position); q
is halved until the lemma asks for at least one.  So per document:

1. q-grams of the document are looked up; stretches with too few known q-grams go.
2. Hits are counted by item, cell of ``window`` item positions and diagonal band; a window
   lies within two cells, any e + 1 neighbouring diagonals within two bands.
3. Where these reach the lemma's count, a window is verified by banded alignment if e
   stretches of q neighbouring q-grams (what e edits can break) hold all that it lacks.

The work is row by row over whole texts, with the benchmark's index at hand in every
task.  A benchmark of more than ``block_chars`` characters is taken in blocks (by hash of
the item id): ``mark`` collects, runs, writes and releases one block before the next.

Defined cases: a null or empty text leaks nothing; null, empty and repeated items are
ignored; items under ``min_chars`` characters must occur exactly and between word
boundaries, and those under 8 are ignored (they would match by chance); an empty
benchmark finds nothing; rows are kept as they are, repeated ids included.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import workers, written

Q = 8
MULT = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 19  # characters taken at once


@dataclass
class Index:
    q: int
    texts: list[np.ndarray]
    items: np.ndarray      # item id of each text
    exact: np.ndarray      # must it occur as it is?
    width: np.ndarray      # of its windows
    budget: np.ndarray     # edits allowed
    need: np.ndarray       # q-grams that must be shared
    hashes: list[np.ndarray]
    cells: np.ndarray      # number of each text's first cell
    cell: int              # positions in a cell
    grams: np.ndarray      # sorted distinct q-gram hashes
    first: np.ndarray      # start of each q-gram's places
    where: np.ndarray      # text of each place
    offset: np.ndarray     # position in the text
    known: np.ndarray      # table of known q-grams by their top bits
    shift: int
    longest: int           # of the windows
    reach: int             # of the texts


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams (q a power of two), by doubling."""
    h, width, factor = c.astype(np.uint64) + np.uint64(7), 1, np.uint64(1_000_003)
    with np.errstate(over="ignore"):
        while width < q:
            h = h[:-width] * factor + h[width:]
            width, factor = 2 * width, factor * factor
        return h * MULT


def build_index(items: list[tuple[int, str]], window: int, rate: float, min_chars: int, q: int = Q) -> Index:
    seen, texts, ids = set(), [], []
    for item, text in sorted(items, key=lambda x: (x[0], x[1])):
        t = normal(text)
        if len(t) < Q or (item, t) in seen:
            continue
        seen.add((item, t))
        texts.append(codes(t))
        ids.append(item)
    n = np.array([len(t) for t in texts], np.int64)
    exact, width = n < min_chars, np.minimum(n, max(window, Q))
    budget = np.where(exact, 0, np.floor(rate * width)).astype(np.int64)
    while q > 1 and (budget > width // q - 1).any():  # the lemma needs at least one shared q-gram
        q //= 2
    need = np.maximum(1, width + 1 - q * (budget + 1))
    hashes = [gram_hashes(t, q) for t in texts]
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    where = np.repeat(np.arange(len(texts)), [len(g) for g in hashes]) if hashes else np.zeros(0, np.int64)
    offset = np.concatenate([np.arange(len(g)) for g in hashes]) if hashes else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    uniq, first = np.unique(flat[order], return_index=True)
    bits = max(16, int(len(uniq)).bit_length() + 5)
    known = np.zeros(1 << bits, bool)
    known[(uniq >> np.uint64(64 - bits)).astype(np.int64)] = True
    longest = int(width.max(initial=1))
    cells = np.cumsum(np.concatenate(([0], n // longest + 2)))  # one more than it has: the last has a next one
    return Index(q, texts, np.array(ids, np.int64), exact, width, budget, need, hashes, cells, longest, uniq, np.append(first, len(flat)),
                 where[order], offset[order], known, 64 - bits, longest, int(n.max(initial=0)))


def band_distance(patterns: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Least edit distance of each pattern (one for all, or one a row) to any substring of its
    region, rows of equal width; the regions are narrow bands, so a row of the table is a band
    of the alignment."""
    k = np.arange(regions.shape[1] + 1)
    row = np.zeros((len(regions), len(k)), np.int32)
    for i, c in enumerate(np.atleast_2d(patterns).T):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (regions != c[:, None]), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - k, axis=1) + k
    return row.min(axis=1)


def _verify(ix: Index, c: np.ndarray, h: np.ndarray, w: int, cell: int, low: int) -> int | None:
    """Where in the document a window of text ``w`` aligns that starts in ``cell`` (of the text), on the
    diagonals from ``low``; None if none does."""
    e, n, t = int(ix.budget[w]), int(ix.width[w]), ix.texts[w]
    if ix.exact[w]:
        for d in (low, low + 1):
            if d >= 0 and d + n <= len(c) and (c[d:d + n] == t).all():
                before, after = (chr(c[x]) if 0 <= x < len(c) else " " for x in (d - 1, d + n))
                if not (before.isalnum() and chr(t[0]).isalnum()) and not (after.isalnum() and chr(t[-1]).isalnum()):
                    return d
        return None
    # windows that start in this cell, or before it with their q-grams in it
    first, last = max(0, cell * ix.cell - n + 1), min(len(t) - n, (cell + 1) * ix.cell - 1)
    own = ix.hashes[w][first:last + n]
    if last < first or not len(own):
        return None
    at = low + np.arange(2 * (e + 1))[:, None] + np.arange(first, first + len(own))
    same = (h[np.clip(at, 0, len(h) - 1)] == own) & (at >= 0) & (at < len(h))
    starts = np.arange(first, last + 1)
    total = np.concatenate(([0], np.cumsum(same.any(axis=0))))
    starts = starts[total[starts - first + n - ix.q + 1] - total[starts - first] >= ix.need[w]]
    if not len(starts):
        return None
    total = np.concatenate((np.zeros((1, len(own)), np.int64), np.cumsum(same, axis=0)))
    shared = total[e + 1:] - total[:-e - 1] > 0  # on each e + 1 neighbouring diagonals
    # an edit breaks at most q neighbouring q-grams: do e such stretches hold all that are broken?
    places = np.arange(len(own) + 1)
    broken = np.concatenate((np.where(shared, len(own), places[:-1]), np.full((len(shared), 1), len(own))), axis=1)
    broken = np.minimum.accumulate(broken[:, ::-1], axis=1)[:, ::-1]  # the next broken one
    line = np.arange(len(shared))[:, None]
    pos = np.broadcast_to(starts - first, (len(shared), len(starts)))
    for _ in range(e):
        pos = np.minimum(broken[line, pos] + ix.q, len(own))
    pos = broken[line, pos]
    starts = starts[(pos > starts - first + n - ix.q).any(axis=0)]
    starts = np.concatenate((starts[len(starts) // 2:], starts[:len(starts) // 2]))
    done = 0
    while done < len(starts):  # the middle one alone first
        s = starts[done:done + (256 if done else 1)]
        at = (s + low - (e + 1))[:, None] + np.arange(n + 4 * (e + 1))
        regions = np.where((at >= 0) & (at < len(c)), c[np.clip(at, 0, len(c) - 1)], 0)
        good = np.flatnonzero(band_distance(t[s[:, None] + np.arange(n)], regions) <= e)
        if len(good):
            return int(s[good[0]]) + low + n // 2
        done += len(s)
    return None


def leaked(ix: Index, texts: list[str | None]) -> list[list[int]]:
    """For each text the ids of the items that it leaks, ascending.  Texts are laid end to
    end, in chunks, with gaps wider than any band's region; long texts go in pieces that overlap."""
    found: list[set[int]] = [set() for _ in texts]
    gap = "\0" * (ix.longest + 8 * (int(ix.budget.max(initial=0)) + 1))
    own, pieces, size = [], [], 0

    def flush() -> None:
        nonlocal own, pieces, size
        if pieces:
            starts = np.cumsum([0] + [len(p) + len(gap) for p in pieces[:-1]])
            for doc, item in _leaked(ix, gap.join(pieces), starts):
                found[own[doc]].add(item)
        own, pieces, size = [], [], 0

    for i, text in enumerate(texts):
        t = normal(text)
        for start in range(0, len(t) if len(t) >= ix.q and ix.texts else 0, CHUNK):
            own.append(i)
            pieces.append(t[start:start + CHUNK + 2 * len(gap)])
            size += len(pieces[-1])
            if size >= CHUNK:
                flush()
    flush()
    return [sorted(f) for f in found]


def _leaked(ix: Index, t: str, starts: np.ndarray) -> set[tuple[int, int]]:
    """(piece, item) of all verified bands."""
    c, longest = codes(t), ix.longest
    h = gram_hashes(c, ix.q)
    at = np.flatnonzero(ix.known[(h >> np.uint64(ix.shift)).astype(np.int64)])
    g = np.minimum(np.searchsorted(ix.grams, h[at]), len(ix.grams) - 1)
    ok = ix.grams[g] == h[at]
    at, g = at[ok], g[ok]
    least = int(ix.need.min())
    if len(at) < least:
        return set()
    # a band's hits lie within the window and its edits: keep places with `least` hits in that reach
    reach = longest + int(ix.budget.max())
    tight = at[least - 1:] - at[:len(at) - least + 1] <= reach
    mark = np.zeros(len(at) + 1, np.int64)
    mark[:len(tight)] += tight
    mark[least:least + len(tight)] -= tight
    dense = np.cumsum(mark[:-1]) > 0
    at, g = at[dense], g[dense]
    keys, counts, span = [], [], len(c) + ix.reach + 4
    for i in range(0, len(at), 1 << 15):  # places of each hit
        a, n = at[i:i + (1 << 15)], ix.first[g[i:i + (1 << 15)] + 1] - ix.first[g[i:i + (1 << 15)]]
        place = np.repeat(ix.first[g[i:i + (1 << 15)]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        w, o = ix.where[place], ix.offset[place]
        band = (np.repeat(a, n) - o + ix.reach) // (ix.budget[w] + 1) + 1
        k, m = np.unique((ix.cells[w] + o // ix.cell) * span + band, return_counts=True)
        keys.append(k)
        counts.append(m)
    if not keys:
        return set()
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)

    def hits(k: np.ndarray) -> np.ndarray:
        x = np.minimum(np.searchsorted(key, k), len(key) - 1)
        return np.where(key[x] == k, count[x], 0)

    # two bands of e + 1 diagonals and two cells: where only the second band or cell has hits, too
    start = np.unique(np.concatenate((key, key - 1)))
    both = hits(start) + hits(start + 1) + hits(start + span) + hits(start + span + 1)
    w = np.searchsorted(ix.cells, start // span, side="right") - 1
    pick = (both >= ix.need[w]) & ((hits(start) > 0) | (hits(start + span) > 0))  # else the next band holds the same
    start, w = start[pick], w[pick]
    cell, low = start // span - ix.cells[w], (start % span - 1) * (ix.budget[w] + 1) - ix.reach
    found: set[tuple[int, int]] = set()
    for one, x, d in zip(w.tolist(), cell.tolist(), low.tolist()):
        # the piece by the middle of the two cells' reach: settled pairs need no second look
        near = max(0, int(np.searchsorted(starts, d + x * ix.cell + ix.cell // 2, side="right")) - 1)
        if (near, int(ix.items[one])) in found:
            lo, hi = d + x * ix.cell - 2 * ix.cell, d + (x + 2) * ix.cell + 2 * ix.cell
            if near == max(0, int(np.searchsorted(starts, lo, side="right")) - 1) == max(0, int(np.searchsorted(starts, hi, side="right")) - 1):
                continue
        hit = _verify(ix, c, h, one, x, d)
        if hit is not None:
            found.add((max(0, int(np.searchsorted(starts, hit, side="right")) - 1), int(ix.items[one])))
    return found


def _column(index: Index, text: str) -> Column:
    @F.pandas_udf("array<bigint>")
    def leaked_items(texts: pd.Series) -> pd.Series:
        return pd.Series(leaked(index, texts.tolist()), dtype=object)
    return leaked_items(F.col(text))


def _blocks(benchmark: DataFrame, item: str, item_text: str, window: int, rate: float, min_chars: int, block_chars: int):
    """Number of blocks, and a function that builds the index of one; each holds ``block_chars``
    characters, give or take an item."""
    bench = benchmark.select(F.col(item).cast("bigint").alias("item"), F.col(item_text).alias("t")).where("item is not null and t is not null").distinct()
    blocks = max(1, -(-(bench.agg(F.sum(F.length("t"))).first()[0] or 0) // block_chars))

    def index(b: int) -> Index:
        rows = bench.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == b).collect()
        return build_index([(r["item"], r["t"]) for r in rows], window, rate, min_chars)
    return blocks, index


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
          window: int = 120, rate: float = 0.1, min_chars: int = 40, block_chars: int = 1_000_000) -> Column:
    """Column for ``docs``: ascending ids of the benchmark items that the row's text leaks.  A column holds
    all blocks at once; :func:`mark` takes one at a time."""
    workers(docs.sparkSession)
    blocks, index = _blocks(benchmark, item, item_text, window, rate, min_chars, block_chars)
    found = [_column(index(b), text) for b in range(blocks)]
    return found[0] if len(found) == 1 else F.array_sort(F.array_distinct(F.concat(*found)))


def mark(docs: DataFrame, benchmark: DataFrame, out: str, text: str = "text", item: str = "item_id", item_text: str = "text",
         window: int = 120, rate: float = 0.1, min_chars: int = 40, block_chars: int = 1_000_000) -> DataFrame:
    """``docs`` with the column ``out`` of :func:`leaks`.  Of several blocks only one is in the driver and
    the workers at a time; its hits are written before the next is built."""
    workers(docs.sparkSession)
    blocks, index = _blocks(benchmark, item, item_text, window, rate, min_chars, block_chars)
    if blocks == 1:
        return docs.withColumn(out, _column(index(0), text))
    base = written(docs.withColumn("__row", F.monotonically_increasing_id()), "decontam-docs")
    hits = None
    for b in range(blocks):
        one = written(base.select(F.col("__row").alias("__row2"), F.explode(_column(index(b), text)).alias("__item")), f"decontam-{b}")
        hits = one if hits is None else hits.unionByName(one)
    of_row = hits.groupBy("__row2").agg(F.array_sort(F.collect_set("__item")).alias("__found"))
    joined = base.join(of_row, F.col("__row") == F.col("__row2"), "left")
    return joined.withColumn(out, F.coalesce("__found", F.array().cast("array<bigint>"))).select(*[c for c in docs.columns if c != out], out)
