"""The pipeline against its stages' plain versions, and its stages on odd rows."""

import hashlib
import random

import brute
import pytest

import corpus_pipeline
from evalspark.llm import decontam, langid
from evalspark.llm.queries import MIX_BLOCK, MIX_DEFAULT, MIX_PARTS
from evalspark.llm.util import table

SF = "/root/testdata/sf0.001"
MARK = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def clean(text):
    out, at = [], 0
    for a, z, k in sorted((a, z, MARK[k]) for k, s in brute.pii_spans(text).items() for a, z in s):
        if a >= at:
            out += [text[at:a], k]
        at = max(at, z)
    return "".join(out) + text[at:]


@pytest.fixture(scope="module")
def fixture_dir(spark, tmp_path_factory):
    """The small tables with rows that each stage must treat."""
    path = str(tmp_path_factory.mktemp("pipe"))
    docs = table(spark, SF, "documents")
    rows = [tuple(r) for r in docs.collect()]
    item = table(spark, SF, "benchmark").first().text
    base = next(r for r in rows if r[1] and len(r[1]) > 600)
    words = base[1].split(" ")
    odd = [(9001, base[1], "en", "src0", len(base[1])), (9001, base[1], "en", "src0", 0), (9002, base[1] + " " + words[0], "en", None, 0),
           (9003, None, "en", "src1", 0), (9004, "", None, "src1", 0), (9005, "12 %% 34", None, "src1", 0),
           (9006, " ".join(random.Random(1).sample(words, len(words))) + " " + item, "en", "src2", 0),
           (9007, " ".join(random.Random(2).sample(words, len(words))) + " mail me@ex.com or +1 (22) 333-4444 now", "en", "src2", 0)]
    spark.createDataFrame(rows + odd, docs.schema).write.parquet(f"{path}/documents.parquet")
    table(spark, SF, "benchmark").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_against_plain_stages(spark, fixture_dir):
    got = corpus_pipeline.run(spark, fixture_dir).collect()
    docs = [tuple(r) for r in table(spark, fixture_dir, "documents").collect()]
    model = langid.fit(table(spark, fixture_dir, "documents"))
    mass = langid.label(model, [r[1] or "" for r in docs])
    kept = [r for r, m in zip(docs, mass) if m.sum() > 0 and m.max() / m.sum() >= corpus_pipeline.MIN_SHARE]
    comp = brute.components([r[0] for r in kept], [brute.simhash(r[1]) for r in kept])
    kept = list({r[0]: r for r, c in zip(kept, comp) if r[0] == c}.values())
    items = [decontam.normal(r.text) for r in table(spark, fixture_dir, "benchmark").collect()]
    kept = [r for r in kept if not any(t in decontam.normal(r[1]) for t in items)]
    want = {r[0]: (clean(r[1]), r[2], r[3]) for r in kept}
    assert {r.doc_id: (r.text, r.lang, r.source) for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)
    assert not {9003, 9004, 9005, 9006} & set(want) and want[9007][0].endswith(" mail [EMAIL] or [PHONE] now")
    # places in the mix
    names = sorted({r[3] for r in kept}, key=lambda s: (s is not None, s or ""))
    names = sorted({*names, *MIX_PARTS}, key=lambda s: (s is not None, s or ""))
    parts = [MIX_PARTS.get(n, MIX_DEFAULT) for n in names]
    d, order = sum(parts), brute.edf(parts)
    for i, n in enumerate(names):
        own = sorted((int(hashlib.md5(f"{r[0]}:mix".encode()).hexdigest()[:15], 16), r[0]) for r in kept if r[3] == n)
        slots = [s for s, x in enumerate(order) if x == i]
        places = {doc: ((k // MIX_BLOCK) // parts[i] * d + slots[(k // MIX_BLOCK) % parts[i]]) * MIX_BLOCK + k % MIX_BLOCK for k, (_, doc) in enumerate(own)}
        assert {r.doc_id: r.mix_order for r in got if r.source == n} == places


def test_stages_on_odd_tables(spark, fixture_dir):
    docs = table(spark, fixture_dir, "documents").withColumnRenamed("n_chars", "fp").selectExpr("*", "lang as component_id")
    docs = docs.unionByName(docs.limit(1).selectExpr("cast(null as bigint) doc_id", "text", "lang", "source", "fp", "component_id"))
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, fixture_dir)
        assert out.columns[:len(docs.columns)] == docs.columns, name
        assert out.count() > 150
        none = stage(spark, empty, fixture_dir)
        assert none.count() == 0 and none.columns[:len(docs.columns)] == docs.columns


def test_stages_are_as_declared():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontaminate", "personal_data", "mix_sources"]
