"""Cross-tokenizer alignment: how two tokenizations of one text cut it at the same bytes.

Tokenizer A encodes a space and the text, tokenizer B the text (it adds the space itself),
both without special tokens.  A byte offset where tokens of both end is a common end: common
ends cut the text into groups, and the two tokens that end there are a link.  A pair of ids
counts as often as a link holds it in the whole corpus.

The pipeline is Arrow's within a task and Spark's between tasks.  A batch of token lists is
flattened to one column with its parent indices; token lengths, looked up by id, are summed
cumulatively and set back at each document's start; an Acero hash join on (document, end)
gives the links.  Texts are tokenized and linked once: what is written are each document's
totals and its id pairs with their occurrences.  ``Table.group_by`` adds these up within a task, and
Spark adds the partial counts.

Each pair's corpus count is looked up by a second hash join.  The pairs of the highest counts
go to every task, at most ``hot_rows`` of them (17 bytes each); the rest of a document's pairs
leave the task as (pair, occurrences) rows and meet their counts in a Spark join, so every
pair is counted whatever the vocabulary's size.

Defined cases: a text that is null or empty, or whose tokens' bytes joined are not the space
and the text (a tokenizer that normalises), has no tokens, zero counts and an empty digest;
special tokens' strings inside texts are plain text; ids may be null or repeated (every row
has its own result); an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import broadcast_under, workers, written

#: characters of text that a worker tokenizes and aligns at once (a longer text is taken alone)
CHUNK_CHARS = 1 << 20
#: partial pair counts that a task holds before it hands them on
PARTIAL_ROWS = 1 << 20


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer by the content of its file; workers load it once."""

    kind: str  # byte_bpe (a tokenizers JSON file) or piece_bpe (a sentencepiece model)
    content: bytes

    @classmethod
    def read(cls, kind: str, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(kind, f.read())


def byte_alphabet() -> dict[str, int]:
    """Character to byte in byte-level vocabularies: printable bytes stand for themselves,
    the others in order for the characters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


# Fixed value: how byte-level pre-tokenizers split texts.
BYTE_LEVEL_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: beyond these letters the classes of characters differ between versions of Unicode
BEYOND_LATIN = re.compile("[^\x00-\u024f]")


def byte_bpe(content: bytes):
    """``encode`` and the pieces of a tokenizers JSON file.  Where its merges are in the order of
    the ids they make, merging by ids is the same and much faster: Latin texts are encoded so."""
    import tiktoken
    from tokenizers import Tokenizer
    spec, tok = json.loads(content), Tokenizer.from_str(content.decode())
    tok.encode_special_tokens = True
    bytes_of = byte_alphabet()

    def raw(piece):
        return bytes(bytes_of[c] for c in piece)
    added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    pieces = [b""] * tok.get_vocab_size(with_added_tokens=True)
    for piece, i in spec["model"]["vocab"].items():
        if i not in added:
            pieces[i] = raw(piece)
    for i, piece in added.items():
        pieces[i] = piece
    vocab, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    made = [vocab["".join(m)] for m in merges]
    usual = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if made != sorted(set(made)) or not usual or spec["normalizer"] is not None:
        return lambda texts: [e.ids for e in tok.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], pieces
    by_rank = tiktoken.Encoding("by_rank", pat_str=BYTE_LEVEL_WORDS, special_tokens={},
                                mergeable_ranks={p: i for i, p in enumerate(pieces) if i not in added})

    def encode(texts):
        return [tok.encode(" " + t, add_special_tokens=False).ids if BEYOND_LATIN.search(t) else by_rank.encode_to_numpy(" " + t) for t in texts]
    return encode, pieces


class Loaded:
    """A tokenizer at work: ``encode`` of texts, and ``pieces``, the bytes of every id."""

    def __init__(self, v: Vocabulary):
        if v.kind == "byte_bpe":
            self.encode, pieces = byte_bpe(v.content)
        else:
            from sentencepiece import SentencePieceProcessor
            sp = SentencePieceProcessor(model_proto=v.content)
            pieces = []
            for i in range(sp.get_piece_size()):
                p = sp.id_to_piece(i)
                one = re.fullmatch("<0x([0-9A-F]{2})>", p) if sp.is_byte(i) else None
                pieces.append(bytes([int(one[1], 16)]) if one else p.replace("▁", " ").encode())
            self.encode = lambda texts: [sp.encode_as_numpy(t) for t in texts]
        self.pieces = pa.array(pieces, pa.binary())
        self.lengths = pc.cast(pc.binary_length(self.pieces), pa.int64())
        self.names = pc.cast(pa.array(range(len(pieces)), pa.int32()), pa.string())


@lru_cache(maxsize=4)
def loaded(v: Vocabulary) -> Loaded:
    return Loaded(v)


def lists(rows: list) -> pa.ListArray:
    """A list column of one sequence of ids per row."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate([np.zeros(0, np.int32), *(np.asarray(r, np.int32) for r in rows)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of at most ``most`` in size, a row that is larger alone."""
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(batch):
        yield batch.slice(start)


def joined_bytes(tokens: pa.ListArray, v: Loaded) -> pa.Array:
    flat = pa.ListArray.from_arrays(tokens.offsets, v.pieces.take(tokens.values))
    return pc.binary_join(flat, pa.scalar(b"", pa.binary()))


def encode(texts: list[str], a: Loaded, b: Loaded) -> tuple[pa.ListArray, pa.ListArray]:
    """Token lists of both tokenizers; empty where either's bytes are not space and text."""
    both = (a.encode(texts), b.encode(texts))
    whole = pa.array([b" " + t.encode() if t else None for t in texts], pa.binary())
    cols = [lists(x) for x in both]
    good = pc.fill_null(pc.and_(pc.equal(joined_bytes(cols[0], a), whole), pc.equal(joined_bytes(cols[1], b), whole)), False).to_pylist()
    if not all(good):
        cols = [lists([r if g else [] for r, g in zip(x, good)]) for x in both]
    return cols[0], cols[1]


def ends(tokens_: pa.ListArray, v: Loaded) -> pa.Table:
    """One row per token: ``doc`` (parent index), ``end`` (bytes from the document's start), ``id``, ``at``."""
    ids, doc = pc.list_flatten(tokens_), pc.list_parent_indices(tokens_)
    upto = pc.cumulative_sum(v.lengths.take(ids))
    first = np.concatenate(([0], np.cumsum(pc.list_value_length(tokens_).to_numpy(zero_copy_only=False))))[:-1]
    before = np.concatenate(([0], upto.to_numpy()))[first]  # the sum at each document's start
    end = pc.subtract(upto, pa.array(before, pa.int64()).take(doc))
    return pa.table({"doc": pc.cast(doc, pa.int64()), "end": end, "id": ids, "at": pa.array(np.arange(len(ids)))})


def links(a: pa.ListArray, b: pa.ListArray, va: Loaded, vb: Loaded) -> pa.Table:
    """The links of a batch: ``doc, end``, the tokens' ids and places, and ``pair`` (both ids in one)."""
    left = ends(a, va).rename_columns(["doc", "end", "a", "at_a"])
    right = ends(b, vb).rename_columns(["doc", "end", "b", "at_b"])
    t = left.join(right, keys=["doc", "end"], join_type="inner", use_threads=False)
    pair = pc.add(pc.multiply(pc.cast(t["a"], pa.int64()), 1 << 32), pc.cast(t["b"], pa.int64()))
    return t.append_column("pair", pair)


_PAIRS = pa.struct([("pair", pa.int64()), ("times", pa.int64())])


def pair_lists(t: pa.Table, n: int) -> pa.ListArray:
    """The rows (doc, pair, times) of ``t`` as a list for each of ``n`` documents."""
    t = t.sort_by("doc").combine_chunks()
    at = np.searchsorted(t["doc"].to_numpy(), np.arange(n + 1)).astype(np.int32)
    each = [pa.concat_arrays([pa.array([], pa.int64()), *t[c].chunks]) for c in ("pair", "times")]
    return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(each, fields=list(_PAIRS)))


def aligned(docs: DataFrame, a: Vocabulary, b: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``k`` (the key), ``n_a, n_b, n_groups, groups_sha256`` and ``pairs``, the links' id pairs
    (A's id times 2^32 plus B's) with their occurrences, of every text."""
    workers(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb = loaded(a), loaded(b)
        for batch in batches:
            for part in slices(batch, pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(), CHUNK_CHARS):
                ta, tb = encode([t or "" for t in part.column(1).to_pylist()], va, vb)
                t = links(ta, tb, va, vb)
                n_groups = np.bincount(t["doc"].to_numpy(), minlength=len(part))
                times = t.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["doc", "pair", "times"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pc.cast(pc.list_value_length(ta), pa.int64()), pc.cast(pc.list_value_length(tb), pa.int64()),
                     pa.array(n_groups), digests(t, ta, tb, va, vb, n_groups), pair_lists(times, len(part))],
                    ["k", "n_a", "n_b", "n_groups", "groups_sha256", "pairs"])
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(
        run, f"k {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, pairs array<struct<pair:bigint,times:bigint>>")


def flat_pairs(pairs: pa.ListArray) -> pa.Table:
    flat = pc.list_flatten(pairs)
    return pa.table({"doc": pc.cast(pc.list_parent_indices(pairs), pa.int64()), "pair": pc.struct_field(flat, "pair"),
                     "times": pc.struct_field(flat, "times")})


def pair_counts(docs: DataFrame) -> DataFrame:
    """``pair, b, n``: how many links of the corpus hold a pair of ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(added([flat_pairs(batch.column(0)).select(["pair", "times"])]))
            if sum(len(x) for x in held) > PARTIAL_ROWS:
                held = [added(held)]
                if len(held[0]) > PARTIAL_ROWS // 2:
                    yield from held.pop().to_batches(10_000)
        if held:
            yield from added(held).to_batches(10_000)

    def added(parts: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(parts).group_by("pair", use_threads=False).aggregate([("times", "sum")])
        return t.rename_columns(["pair", "times"]).combine_chunks()

    partial = docs.select("pairs").mapInArrow(run, "pair bigint, times bigint")
    return partial.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b", F.col("pair") % (1 << 32))


def scored_pairs(counts: DataFrame, b_size: int) -> DataFrame:
    """``pair, n, best``: best (0 or 1) where no pair of the same B id counts higher."""
    top = counts.groupBy("b").agg(F.max("n").alias("top"))  # at most one row per id of B
    return counts.join(broadcast_under(top, b_size, 16), "b").select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))


def most_frequent(pairs: DataFrame, hot_rows: int) -> tuple[pa.Table, int]:
    """The pairs counted at least ``floor`` times, and ``floor``, the least power of two that
    leaves at most ``hot_rows`` of them."""
    by_power = F.floor(F.log2("n")).cast("int").alias("p")
    sizes = {r["p"]: r["c"] for r in pairs.groupBy(by_power).agg(F.count("*").alias("c")).collect()}  # at most 63 rows
    power, held = 63, 0
    while power > 0 and held + sizes.get(power - 1, 0) <= hot_rows:
        power -= 1
        held += sizes.get(power, 0)
    return pairs.where(F.col("n") >= 2 ** power).toArrow(), 2 ** power


def align(docs: DataFrame, a: Vocabulary, b: Vocabulary, key: str = "doc_id", text: str = "text", hot_rows: int = 1 << 18) -> DataFrame:
    """One row per document: its key, ``n_a, n_b`` tokens, ``n_groups``, ``n_links`` (no token is
    empty: every common end ends one group and makes one link), ``n_best`` (links whose pair
    counts as high as any of its B id), ``count_sum`` (of the links' pairs) and
    ``groups_sha256`` (of the ids by group; '' without tokens)."""
    rows = written(aligned(docs, a, b, key, text).withColumn("rid", F.monotonically_increasing_id()), "align-pairs")
    pairs = written(scored_pairs(written(pair_counts(rows), "align-counts"), len(loaded(b).pieces)), "align-scores")
    hot, floor = most_frequent(pairs, hot_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [batch.column(c) for c in range(len(plain))] + looked_up(batch.column("pairs"), hot)
            yield pa.RecordBatch.from_arrays(sums, [*plain, "n_best", "count_sum", "rare"])

    plain = ["rid", "k", "n_a", "n_b", "n_groups", "groups_sha256"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in plain)
    out = rows.select(*plain, "pairs").mapInArrow(run, f"{kinds}, n_best bigint, count_sum bigint, rare array<struct<pair:bigint,times:bigint>>")
    if floor > 1:  # pairs below the floor meet their counts here
        out = written(out, "align-reports")
        rare = out.select("rid", F.inline("rare")).join(pairs.where(F.col("n") < floor), "pair")
        more = rare.groupBy("rid").agg(F.sum(F.col("times") * F.col("n")).alias("s"), F.sum(F.col("times") * F.col("best")).alias("t"))
        out = out.join(more, "rid", "left").withColumns({
            "count_sum": F.col("count_sum") + F.coalesce("s", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("t", F.lit(0))})
    return out.select(F.col("k").alias(key), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")


def looked_up(pairs: pa.ListArray, hot: pa.Table) -> list[pa.Array]:
    """For every document ``n_best`` and ``count_sum`` over its pairs in ``hot``, and the list of those that it lacks."""
    t = flat_pairs(pairs).join(hot, keys="pair", join_type="left outer", use_threads=False)
    doc, times = t["doc"].to_numpy(), t["times"].to_numpy()
    out = []
    for c in ("best", "n"):
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, doc, times * pc.fill_null(t[c], 0).to_numpy())
        out.append(pa.array(total))
    return [*out, pair_lists(t.filter(pc.is_null(t["n"])), len(pairs))]


def digests(t: pa.Table, a: pa.ListArray, b: pa.ListArray, va: Loaded, vb: Loaded, n_groups: np.ndarray) -> pa.Array:
    """SHA-256 of ``a1,a2|b1;...`` for every document.  The last tokens of a document end
    together, so the common ends cut the flat columns without rest."""
    t = t.sort_by("at_a")

    def side(ids: pa.ListArray, v: Loaded, at: str) -> pa.Array:
        cuts = np.concatenate(([0], t[at].to_numpy() + 1)).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), v.names.take(pc.list_flatten(ids))), ",")

    groups = pc.binary_join_element_wise(side(a, va, "at_a"), side(b, vb, "at_b"), "|")
    cuts = np.concatenate(([0], np.cumsum(n_groups))).astype(np.int32)
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), groups), ";").to_pylist()
    return pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in whole], pa.string())
