"""Commit log: a table of immutable batch folders, and numbered entries that list the live ones.

``<base>/batch-<id>/`` holds the Parquet files of one write and is never changed.
``<base>/_commits/<number>.json`` is an entry: every live batch, with its row count, and free
``meta``.  A writer writes its batch first, then puts the entry of the next number in place
by a rename that fails if the number is taken; so an entry is whole or absent, a writer that
dies before it leaves nothing that a reader sees, and of two writers of one number one
fails (where the store's rename is atomic).  Readers take the last entry; old batches are
neither read nor rewritten by an append.

The driver handles entries (a line per batch), never rows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CommitConflict(RuntimeError):
    """Another writer took the number first."""


@dataclass(frozen=True)
class Entry:
    number: int
    batches: tuple  # (folder, rows) of each live batch
    schema: str     # of the table, as JSON
    meta: dict = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.batches)


def _fs(spark: SparkSession, path: str):
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    return to, to.getFileSystem(spark._jsc.hadoopConfiguration())


def _entry_path(base: str, number: int) -> str:
    return f"{base}/_commits/{number:010d}.json"


def last(spark: SparkSession, base: str) -> Entry | None:
    """The newest entry; None where there is none."""
    folder, fs = _fs(spark, f"{base}/_commits")
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
    return entry(spark, base, max(numbers)) if numbers else None


def entry(spark: SparkSession, base: str, number: int) -> Entry:
    text = spark.read.text(_entry_path(base, number), wholetext=True).first()[0]
    raw = json.loads(text)
    return Entry(number, tuple((b, n) for b, n in raw["batches"]), raw["schema"], raw["meta"])


def read(spark: SparkSession, base: str, number: int | None = None) -> DataFrame:
    """The live rows at an entry (the newest by default)."""
    at = last(spark, base) if number is None else entry(spark, base, number)
    if at is None:
        raise ValueError(f"no commits under {base}")
    schema = T.StructType.fromJson(json.loads(at.schema))
    folders = [f"{base}/{b}" for b, n in at.batches if n]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def write_batch(df: DataFrame, base: str) -> tuple[str, int]:
    """A new batch folder, not yet live, and its row count (counted by the write itself)."""
    name, seen = f"batch-{uuid.uuid4().hex}", Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{base}/{name}")
    return name, seen.get["n"]


def commit(spark: SparkSession, base: str, batches, schema: T.StructType, before: Entry | None, meta: dict | None = None) -> Entry:
    """Put the entry after ``before`` in place; :class:`CommitConflict` if its number is taken."""
    new = Entry((before.number if before else 0) + 1, tuple(batches), json.dumps(schema.jsonValue()), meta or {})
    draft, fs = _fs(spark, f"{base}/_commits/draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps({"batches": [list(b) for b in new.batches], "schema": new.schema, "meta": new.meta}).encode()))
    out.close()
    to = spark._jvm.org.apache.hadoop.fs.Path(_entry_path(base, new.number))
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark._jsc.hadoopConfiguration())
    options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)  # none: do not overwrite
    try:
        context.rename(draft, to, options)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception.getClass().getName()):
            raise
        fs.delete(draft, False)
        raise CommitConflict(f"commit {new.number} under {base} was taken by another writer") from e
    return new


def append(df: DataFrame, base: str, before: Entry | None | str = "last", meta: dict | None = None) -> Entry | None:
    """Write ``df`` as a new batch and commit it after ``before`` (default: the newest entry now).
    Without rows there is no commit, unless it is the first or brings ``meta``; its batch is not listed."""
    spark = df.sparkSession
    at = last(spark, base) if before == "last" else before
    name, n = write_batch(df, base)
    if n == 0 and at is not None and not meta:
        return None
    schema = T.StructType.fromJson(json.loads(at.schema)) if at else df.schema
    return commit(spark, base, [*(at.batches if at else ()), *([(name, n)] if n else [])], schema, at, meta)


def compact(spark: SparkSession, base: str, least: int = 2, most_rows: int | None = None) -> Entry | None:
    """Write the small batches (under ``most_rows`` rows; all by default) as one, if there are ``least`` of them."""
    at = last(spark, base)
    small = [(b, n) for b, n in at.batches if n and (most_rows is None or n < most_rows)] if at else []
    if len(small) < least:
        return None
    schema = T.StructType.fromJson(json.loads(at.schema))
    merged = write_batch(spark.read.schema(schema).parquet(*[f"{base}/{b}" for b, _ in small]), base)
    kept = [b for b in at.batches if b not in small and b[1]]
    return commit(spark, base, [*kept, merged], schema, at, at.meta)


def replace(df: DataFrame, base: str, before: Entry | None, meta: dict | None = None, keep: int = 2) -> Entry:
    """Commit ``df`` as the only live batch; batches that none of the last ``keep`` entries lists are removed."""
    spark = df.sparkSession
    batch = write_batch(df, base)
    new = commit(spark, base, [batch], df.schema, before, meta)
    recent = {b for n in range(max(1, new.number - keep + 1), new.number + 1) for b, _ in entry(spark, base, n).batches}
    old = {b for b, _ in entry(spark, base, new.number - keep).batches} if new.number > keep else set()
    for name in old - recent:
        folder, fs = _fs(spark, f"{base}/{name}")
        fs.delete(folder, True)
    return new
