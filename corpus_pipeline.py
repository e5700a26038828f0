"""Corpus pipeline over ``documents``: language ID, near-duplicates, decontamination, PII, mixing.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and
read again as the next stage's ``docs``.  All but the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import decontam, langid, mixing, pii, simhash
from evalspark.llm.queries import MIX_BLOCK, MIX_DEFAULT, MIX_PARTS, PII, SIMHASH
from evalspark.llm.util import table, written

#: a text whose best language has less than this share of its words' mass is rejected
MIN_SHARE = 0.34


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5; texts without letters and texts of no prevailing language go."""
    model = langid.fit(docs)
    marked = docs.withColumn("__p", langid.predict(model, F.col("text"), spark))
    return marked.where((F.col("__p.lang") != "und") & (F.col("__p.score") >= MIN_SHARE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7; the document of the smallest id of each group stays."""
    return simhash.keep_one(docs, **SIMHASH).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8; documents that leak a benchmark item go."""
    found = decontam.mark(docs, table(spark, sf_dir, "benchmark"), "__items")
    return found.where(F.size("__items") == 0).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2; spans are replaced in the text, and ``n_chars`` counts the new text."""
    clean = pii.sanitise(docs, **PII).withColumn("text", pii.cleaned())
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast("long"))
    return clean.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4; every document gets its place in the mix."""
    return mixing.pfair_mix(docs, MIX_PARTS, MIX_DEFAULT, block_rows=MIX_BLOCK)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
]

#: SQL has no CRF, XXH64 fingerprints or alignment; tests hold the pipeline against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
