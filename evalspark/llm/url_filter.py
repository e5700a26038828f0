"""URL filter: a blocked Bloom filter in front of an exact hash join.

Listed entries are canonical ``host + path prefix`` keys with a verdict.  A URL is
matched by an entry whose host is the URL's host or a parent domain of it and whose
path is a prefix of the URL's path; the longest entry wins (ties: the smaller key).

Every distinct (host, path) is expanded into the keys that could be listed (host
suffixes x prefixes of listed path lengths).  The filter, one 64-bit word per block
with all bits of a key in one block, lets possible hits through; an exact join with
the list removes the false positives.  Both joins are on hashed keys; the filter and
the list are broadcast only when their counted size is small, and shuffled beyond it.

Defined cases: null URL or no ``://``: host and path empty, never listed.  Listed rows
with a null or empty host are ignored; a null path counts as empty; one key listed with
both verdicts blocks.  Repeated pages are all returned.  Input columns named like an
output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import ascii_lower, broadcast_under

BITS_PER_KEY = 16
HASHES = 4


def url_parts(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and the path up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _mask(key: Column) -> Column:
    """``HASHES`` bits of one 64-bit word, from six bits of a second hash each."""
    h, out = F.xxhash64(key, F.lit("bit")), F.lit(0).cast("bigint")
    for i in range(HASHES):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return out


def build_filter(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """Blocked Bloom filter as a table ``block, word`` (empty blocks are absent)."""
    return keys.groupBy(_block(F.col(key), n_blocks).alias("__block")).agg(F.bit_or(_mask(F.col(key))).alias("__word"))


def url_filter(pages: DataFrame, listed: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` plus ``host, path, rule, verdict``; ``listed`` has ``host, path, verdict``."""
    rules = (listed.select(ascii_lower(F.col("host")).alias("__h"), F.coalesce("path", F.lit("")).alias("__p"), "verdict")
             .where("__h is not null and __h <> ''")
             .groupBy(F.concat("__h", "__p").alias("__key"))
             .agg(F.max("verdict").alias("__verdict"), F.max(F.size(F.split("__h", r"\."))).alias("__labels"),
                  F.first(F.length("__p")).alias("__len")))
    known = rules.agg(F.count("*").alias("n"), F.max("__labels").alias("labels"), F.max(F.length("__key")).alias("w"),
                      F.collect_set("__len").alias("lens")).first()  # distinct path lengths: bounded by the URL length
    n, lens = known["n"], sorted(known["lens"])
    n_blocks = 1 << max(0, (n * BITS_PER_KEY // 64).bit_length())

    h, p = url_parts(F.col(url))
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    pages = pages.select(*keep, h.alias("host"), p.alias("path"))
    if not n:
        return pages.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    labels = F.split("host", r"\.")
    first = F.greatest(F.lit(1), F.size(labels) - known["labels"] + 1)
    suffixes = F.transform(F.sequence(first, F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(x) for x in lens]), lambda x: x <= F.length("path")),
                           lambda x: F.substring(F.col("path"), F.lit(1), x))
    tried = (pages.where("host <> ''").select("host", "path").distinct()
             .select("host", "path", F.explode(suffixes).alias("__s"))
             .select("host", "path", "__s", F.explode(prefixes).alias("__x"))
             .select("host", "path", F.concat("__s", "__x").alias("__key"))
             .withColumn("__block", _block(F.col("__key"), n_blocks)))
    bloom = broadcast_under(build_filter(rules, "__key", n_blocks), n_blocks, 32)
    possible = (tried.join(bloom, "__block")
                .where(F.col("__word").bitwiseAND(_mask(F.col("__key"))) == _mask(F.col("__key")))
                .select("host", "path", "__key"))
    exact = broadcast_under(rules.select("__key", "__verdict"), n, 64 + 4 * known["w"])
    best = (possible.join(exact, "__key").groupBy("host", "path")
            .agg(F.min(F.struct((-F.length("__key")).alias("n"), F.col("__key").alias("rule"),
                                F.col("__verdict").alias("verdict"))).alias("__best")))
    return pages.join(best, ["host", "path"], "left").select(
        *keep, "host", "path", F.col("__best.rule").alias("rule"),
        F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))
