"""URL filter, PII, mixing, chat formatting and fingerprints: brute force and defined cases."""

import hashlib
import itertools
import json
import random
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from evalspark.llm import chat, mixing, multiset, pii, url_filter
from evalspark.llm.queries import TRICKY, conversation_records

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonMapInArrow")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- 1 ----------------------------------------------------------------------

URLS = [None, "", "no scheme", "http://", "http:///x", "HTTP://A.Example.NET/en/1?x#y", "http://example.net/en/", "http://example.net/en",
        "http://xexample.net/en/", "http://a.org/fr/z", "http://org/fr/", "http://a.org#/fr/", "x://a.net?/de/", "http://a.net/", "http://é.net/",
        "http://a://b.net/", "http://example.com/de/x", "http://sub.example.com/deutsch", "http://" + "a." * 3000 + "net/" + "p" * 30000]
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = brute.upper_ascii_lower(rest[:cut]), rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(URLS + URLS[:7])], "page_id long, url string, host string, `__key` int")
    listed = spark.createDataFrame(RULES + [RULES[0], (None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string")
    out = url_filter.url_filter(pages, listed)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got == {i: judge(u) for i, u in enumerate(URLS + URLS[:7])}
    assert not any(n in plan(out) for n in PYTHON_NODES)
    assert url_filter.url_filter(pages.limit(0), listed).count() == 0
    none = url_filter.url_filter(pages, listed.limit(0)).collect()
    assert {r.verdict for r in none} == {"allow"} and len(none) == len(URLS) + 7


def test_url_filter_conflict_blocks_and_prefix_inside_a_segment(spark):
    listed = spark.createDataFrame([("a.net", "/x", "allow"), ("A.net", "/x", "block"), ("a.net", None, "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([("http://a.net/xyz",), ("http://a.net",), ("http://b.net/x",)], "url string")
    got = {r.url: (r.rule, r.verdict) for r in url_filter.url_filter(pages, listed).collect()}
    assert got == {"http://a.net/xyz": ("a.net/x", "block"), "http://a.net": ("a.net", "allow"), "http://b.net/x": (None, "allow")}


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(500).select(F.concat(F.lit("h"), "id").alias("k"))
    bloom = url_filter.build_filter(keys, "k", 64)
    hit = keys.withColumn("__block", url_filter._block(F.col("k"), 64)).join(bloom, "__block")
    assert hit.where(F.col("__word").bitwiseAND(url_filter._mask(F.col("k"))) == url_filter._mask(F.col("k"))).count() == 500


# --- 2 ----------------------------------------------------------------------

TEXTS = [None, "", "a@b.c_d@e.f x@y 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 é😀 4111 1111 1111 1111 +1 (22) 333-4444x +1    ",
         "a.b@c.d.e@f.g-h..@x.y", "9" * 30000 + " " + "a" * 50000 + " 1.2.3" + ".4" * 3000, "+1234567890123456 +12345678 9 +1-2-3-4-5-6-7-8-9-",
         "@ + 1 . - 4111-1111-1111-1111 4111111111111112 +", "x" * 100 + "\n\ta@b.co\r\n"]


def test_pii_base_spans(spark):
    docs = spark.createDataFrame([(i, t, "e") for i, t in enumerate(TEXTS + TEXTS[2:4])] + [(None, "q@w.er", "e")], "doc_id long, text string, `email` string")
    out = pii.sanitise(docs).withColumn("base", pii.span_text()).withColumn("clean", pii.cleaned())
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        assert r.base == brute.pii_text(r.text), r.text
        assert r.email == "e"
        spans = sorted(s for k in brute.pii_spans(r.text).values() for s in k)
        if not spans:
            assert r.clean == r.text
        else:
            assert not any(r.text[a:z] in r.clean for a, z in spans if "@" in r.text[a:z])
    assert not any(n in plan(out) for n in PYTHON_NODES)
    assert pii.sanitise(docs.limit(0)).count() == 0


def test_pii_disclosing_terms(spark):
    # "Zephyr" stands only with one address, in different contexts; "about" stands everywhere
    rows = [(0, "write Zephyr about it at z@y.xx today"), (1, "the note by Zephyr, about z@y.xx, came late"), (2, "nothing about this"),
            (3, "about time and about Zeppelin"), (4, "again about q@y.xx we hear"), (5, "all about nothing")] + [(i, "filler about text") for i in range(6, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = pii.sanitise(docs).withColumn("clean", pii.cleaned())
    got = {r.doc_id: (r["__term"], r.clean) for r in out.collect()}
    assert [s.value for s in got[0][0]] == ["Zephyr"] and [s.value for s in got[1][0]] == ["Zephyr"]
    assert got[0][1] == "write  about it at [EMAIL] today"
    assert all(not t for i, (t, _) in got.items() if i > 1)
    found = pii.detect(docs).withColumn("__spans", pii._all()).where("size(__spans) > 0")
    share = {(r.entity, r.term): r.disclosure for r in pii.disclosing_terms(found, docs, generalise_at=-9.0).collect()}
    assert share[("0:z@y.xx", "zephyr")] == pytest.approx(brute.log_share(2, 2, 2, 20))
    assert share[("0:z@y.xx", "about")] == pytest.approx(brute.log_share(2, 20, 2, 20))


def test_pii_terms_go_in_texts_without_the_entity(spark):
    # three documents hold the address and the name, five the name alone; ids repeat and are null
    rows = [(i, f"write{i % 26 * 'x'} to Zephyr at z@y.xx today") for i in range(3)] + [(None if i % 2 else 1, f"so says Zephyr in note {i}") for i in range(5)]
    docs = spark.createDataFrame(rows + [(100 + i, "filler about text") for i in range(400)], "doc_id long, text string")
    for salted in (False, True):
        pii.broadcast_under, keep = (lambda df, *_: df) if salted else pii.broadcast_under, pii.broadcast_under
        try:
            got = pii.sanitise(docs).withColumn("clean", pii.cleaned()).select("text", "clean", "__terms").collect()
        finally:
            pii.broadcast_under = keep
        assert len(got) == len(rows) + 400
        for r in got:
            assert "Zephyr" not in r.clean
            assert {t.term for t in r["__terms"] or []} <= set(r.text.lower().split())
            assert ("Zephyr" in r.text) == ("zephyr" in {t.term for t in r["__terms"] or []})


@pytest.mark.parametrize("one, term, gone", [
    ('"Zephyr" <z@y.xx> wrote {}', "zephyr", "Zephyr"), ("see (Zephyr) z@y.xx {}", "zephyr", "Zephyr"), ("Name:Zephyr z@y.xx {}", "zephyr", "Zephyr"),
    ("Li z@y.xx {}", "li", "Li"), ("{} z@y.xx " + "1 " * 200 + "Zephyr", "zephyr", "Zephyr"), ("z@y.xx {} 是王小明的信", "王小", "王小明")])
def test_pii_words_by_letter_boundaries(spark, one, term, gone):
    rows = [(i, one.format("abcd"[i] * 5)) for i in range(3)] + [(9, f"so {gone}, again")]
    docs = spark.createDataFrame(rows + [(100 + i, "filler so again wrote see name") for i in range(400)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.sanitise(docs).withColumn("clean", pii.cleaned()).collect()}
    for i, _ in rows:
        assert term in {t.term for t in got[i]["__terms"]} and gone not in got[i].clean


def test_pii_counts_documents_once(spark):
    # in two of four documents with the address, one of them with two contexts
    rows = [(0, "Zephyr z@y.xx one and far on " + "1 " * 60 + " Zephyr z@y.xx two"), (1, "Zephyr z@y.xx three"), (2, "z@y.xx four"), (3, "z@y.xx five")]
    docs = spark.createDataFrame(rows + [(9 + i, "filler") for i in range(60)], "doc_id long, text string")
    found = pii.detect(docs).withColumn("__spans", pii._all()).where("size(__spans) > 0")
    share = {r.term: r.disclosure for r in pii.disclosing_terms(found, docs, generalise_at=-9.0).collect()}
    assert share["zephyr"] == pytest.approx(brute.log_share(2, 2, 4, 64))
    rows[3] = (3, "z@y.xx five Zephyr not in the span's 48 code points: " + "1 " * 60 + "Zephyr")
    docs = spark.createDataFrame(rows + [(9 + i, "filler Zephyr" if i < 4 else "filler") for i in range(60)], "doc_id long, text string")
    share = {r.term: r.disclosure for r in pii.disclosing_terms(found, docs, generalise_at=-9.0).collect()}
    assert share["zephyr"] == pytest.approx(brute.log_share(3, 7, 4, 64))


def test_pii_copies_are_one_context(spark):
    docs = spark.createDataFrame([(i, "reach Quillon at a@b.cc now") for i in range(5)] + [(9, "other text")], "doc_id long, text string")
    assert pii.sanitise(docs).where("size(__term) > 0").count() == 0


def chance_corpus(rng, n=2500):
    """Texts of words drawn by rank (Zipf) that know nothing of the 200 addresses in two of them each,
    and 12 names, each with its own address in five texts and once alone."""
    words = ["w" + "".join(chr(97 + int(c)) for c in str(i)) for i in range(9000)]
    weights = list(itertools.accumulate(1 / (i + 1) for i in range(len(words))))
    rows = []
    for i in range(n):
        t = rng.choices(words, cum_weights=weights, k=rng.randint(20, 250))
        if i < 400:
            t.insert(rng.randrange(len(t)), f"p{i // 2}@mail.xx")
        elif i < 472:
            k = (i - 400) // 6
            t.insert(rng.randrange(len(t)), "zzname" + chr(97 + k))
            if (i - 400) % 6 < 5:
                t.insert(rng.randrange(len(t)), f"n{k}@own.yy")
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize("literal_terms", [2000, 0])  # terms in the plan, and joined
def test_pii_terms_against_chance(spark, literal_terms):
    rows = chance_corpus(random.Random(5))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = pii.sanitise(docs, chance=0.01, literal_terms=literal_terms).select("doc_id", "__term", pii.cleaned().alias("clean"), "text").collect()
    clean = [r for r in out if r.doc_id >= 472]
    assert sum(r.clean != r.text for r in clean) < 0.01 * len(clean)
    named = [r for r in out if 400 <= r.doc_id < 472]
    assert sum("zzname" not in r.clean for r in named) >= 0.9 * len(named)
    if literal_terms:  # without the test, words that two texts share by chance go
        loose = pii.sanitise(docs).where("doc_id >= 472 AND size(__term) > 0").count()
        assert loose > 0.01 * len(clean)


def test_pii_counts_on_a_random_corpus(spark):
    """Counts and disclosure of every pair against plain Python."""
    rng = random.Random(11)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "zu") for b in ("r", "st", "n", "ph", "x")]
    rows = []
    for i in range(160):
        t = rng.choices(vocab, k=rng.randint(2, 14))
        for e in rng.sample(["a@b.cc", "c@d.ee", "+491234567890"], rng.choice([0, 0, 1, 1, 2])):
            t.insert(rng.randrange(len(t) + 1), e)
        rows.append((i, " ".join(t)))
    n, has_e, has_t, both = len(rows), Counter(), Counter(), Counter()
    for _, t in rows:
        es = {f"{3 if w[0] == '+' else 0}:{w}" for w in t.split() if w[0] == "+" or "@" in w}
        ts = {w for w in t.split() if w.isalpha()}
        has_e.update(es)
        has_t.update(ts)
        both.update(itertools.product(es, ts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.entity, r.term): r.disclosure for r in pii.scored_terms(docs, generalise_at=-99.0, support=1).collect()}
    assert got.keys() == both.keys()
    for (e, t), share in got.items():
        assert share == pytest.approx(brute.log_share(both[(e, t)], has_t[t], has_e[e], n))


# --- 4 ----------------------------------------------------------------------

def test_pattern_is_edf(spark):
    rng = random.Random(3)
    for parts in [[1], [1, 1], [10, 3, 3], [5, 2, 7, 1]] + [[rng.randint(1, 9) for _ in range(rng.randint(2, 8))] for _ in range(4)]:
        order = spark.range(1).select(mixing.pattern(parts).alias("p")).first().p
        assert order == brute.edf(parts)
        d, done = sum(parts), [0] * len(parts)
        for t, i in enumerate(order, 1):
            done[i] += 1
            assert all(abs(done[k] - t * p / d) < 1 for k, p in enumerate(parts))


def test_mix_keeps_all_rows_and_target_shares(spark):
    rows = [(i, "hot" if i % 3 else None if i % 2 else "b", "t", 7) for i in range(600)] + [(5, "hot", "again", 7), (5, "hot", "t", 7), (None, "b", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, slot int")
    out = mixing.pfair_mix(docs, {"hot": 2, "absent": 1}, 1, block_rows=4, bucket_rows=50)
    got = out.collect()
    assert len(got) == len(rows) and sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert len({r.mix_order for r in got}) == len(rows)
    slots = {}
    for r in got:
        assert r.release <= r.slot < r.deadline
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    parts = {None: 1, "absent": 1, "b": 1, "hot": 2}
    names, d = list(parts), 5
    order = brute.edf([parts[n] for n in names])
    for s, (src, block) in slots.items():
        assert names[order[s % d]] == src
    # equal again, with any partitioning
    again = mixing.pfair_mix(docs.repartition(7), {"hot": 2, "absent": 1}, 1, block_rows=4, bucket_rows=50)
    assert sorted((str(r.doc_id), r.text or "", r.mix_order) for r in again.collect()) == sorted((str(r.doc_id), r.text or "", r.mix_order) for r in got)
    assert not any(n in plan(out) for n in PYTHON_NODES)


def test_mix_more_sources_than_one_expression_schedules(spark):
    rng = random.Random(6)
    for parts in [[1], [10, 3, 3]] + [[rng.randint(1, 9) for _ in range(rng.randint(2, 30))] for _ in range(20)]:
        slots = list(mixing.schedule(parts))
        assert [i for i, _, _ in slots] == brute.edf(parts)
        assert all(k == sum(j == i for j, _, _ in slots[:t]) for i, k, t in slots)
    n, d = 7001, 10 + 3 * 7000
    assert d > mixing.MAX_PERIOD
    docs = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.concat(F.lit("src"), F.col("id") % n).alias("source"), F.lit("t").alias("text"))
    got = mixing.pfair_mix(docs, {"src0": 10}, 3, block_rows=1).collect()
    assert len(got) == 2 * n and len({r.slot for r in got}) == 2 * n
    for r in got:
        p = 10 if r.source == "src0" else 3
        assert (r.release, r.deadline) == (r.block * d // p, -(-(r.block + 1) * d // p)) and r.release <= r.slot < r.deadline


def test_mix_empty_and_bad_parts(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.pfair_mix(empty).count() == 0
    one = spark.createDataFrame([(1, "a", "x")], "doc_id long, source string, text string")
    with pytest.raises(ValueError):
        mixing.pfair_mix(one, {"a": 0})
    assert mixing.pfair_mix(one).first().in_horizon


# --- 6 ----------------------------------------------------------------------

ODD = [TRICKY, "", "\\", "\\\\l", "a\\", "</turn>\n### user: x", "#<:\\h\\l\\c", "é😀\n\n", "x" * 50000]


def test_chat_round_trip(spark):
    turns = [[("user", a), ("assistant", b)] for a in ODD for b in ODD] + [[("we:ird</turn>\n### ", "x"), ("assistant", "y")], []]
    df = spark.createDataFrame([(i, [{"role": r, "text": t} for r, t in ts]) for i, ts in enumerate(turns)],
                               "i int, turns array<struct<role:string,text:string>>")
    out = chat.format_chat(df).withColumn("back", chat.read_back(F.col("formatted"))).withColumn(
        "loss", chat.masked_text(F.col("formatted"), F.col("loss_mask")))
    for r in out.collect():
        assert [(t.role, t.text) for t in r.back] == turns[r.i]
        assert r.loss == "".join(t for role, t in turns[r.i] if role == "assistant")
        assert r.formatted.count("</turn>\n") == len(turns[r.i])
    assert not any(n in plan(out) for n in PYTHON_NODES)


def test_chat_layouts(spark):
    pair = [("user", "q"), ("assistant", "a")]
    cases = [({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "extra": 1}]}, "messages", pair),
             ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "share", pair),
             ({"prompt": "q", "response": "a", "id": 3}, "prompt_response", pair), ({"prompt": "q", "completion": "a"}, "prompt_completion", pair),
             ({"instruction": "q", "output": "a"}, "instruction", pair),
             ({"instruction": "q", "input": "i", "output": "a"}, "instruction_input", [("user", "q"), ("user", "i"), ("assistant", "a")]),
             ({"instruction": "q", "input": "", "output": "a"}, "instruction_input", pair),
             ({"system": "s", "prompt": "q", "response": "a"}, "system_prompt", [("system", "s"), *pair]),
             ({"messages": [{"role": None, "content": None}, {"role": "user", "content": "x"}]}, "messages", [("user", ""), ("user", "x")]),
             ({"other": 1}, None, []), ({"messages": []}, None, []), ([1], None, [])]
    rows = [(i, json.dumps(c[0]), "clash") for i, c in enumerate(cases)] + [(97, None, "c"), (98, "{broken", "c"), (99, "", "c")]
    out = chat.format_chat(chat.to_turns(spark.createDataFrame(rows, "i int, record string, turns string")))
    for r in out.collect():
        want = cases[r.i][1:] if r.i < 90 else (None, [])
        assert (r.layout, [(t.role, t.text) for t in r.turns]) == want, rows[min(r.i, len(rows) - 1)]
    assert out.limit(0).count() == 0


def test_chat_conversations_of_null_roles_alone(spark, tmp_path):
    rows = [(1, 0, None, "odd"), (2, 0, None, "even"), (2, 1, None, "more"), (3, 0, None, "b"), (3, 0, "assistant", "a")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: (r.layout, [(t.role, t.text) for t in r.turns]) for r in chat.to_turns(conversation_records(spark, str(tmp_path))).collect()}
    assert got[1] == ("share", [("user", "odd")]) and got[2] == ("messages", [("user", "even"), ("user", "more")])
    assert got[3] == ("share", [("assistant", "a"), ("user", "b")])  # by turn, then role, as the SQL orders them


# --- 9 ----------------------------------------------------------------------

def fp(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.f for r in df.select("i", multiset.fingerprint(F.col("t")).alias("f")).orderBy("i").collect()]


def test_fingerprint_is_a_multiset_sum(spark):
    a, b, ab, ba, aab = fp(spark, "One line here.", "Another one.", "One line here.\nAnother one.", "Another one.\n\nOne line here.",
                           "One line here.\nOne line here.\nAnother one.")
    assert ab == ba and ab != aab and a != b
    df = spark.createDataFrame([(a, b, ab, aab)], "a array<bigint>, b array<bigint>, ab array<bigint>, aab array<bigint>")
    r = df.select(multiset.add(F.col("a"), F.col("b")).alias("s"), multiset.subtract(F.col("aab"), F.col("a")).alias("d"),
                  multiset.subtract(F.col("b"), F.col("b")).alias("z")).first()
    assert r.s == ab and r.d == ab and set(r.z) == {0}
    # incremental results survive sums that wrap around
    back = df.select(multiset.add(multiset.subtract(F.col("a"), F.col("aab")), F.col("aab")).alias("x")).first()
    assert back.x == a


def test_edit_report(spark):
    texts = {3: "a.\nb c d. e", 1: None, 7: "", 9: "é😀x" * 50 + "\nline two. And three! " * 30, 12: "word " * 20000, 13: "word " * 20000}
    rows = [(i, t, "x") for i, t in texts.items()] + [(None, "last of all", "x"), (3, "a second three", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    order = sorted(((i is None, i or 0, t or "") for i, t, _ in rows))
    for bucket in (2000, 1):
        out = multiset.edit_report(docs, bucket_rows=bucket)
        got = {(r.doc_id, r.n_chars): r for r in out.collect()}
        assert len(got) == len(rows)
        for k, (no, i, t) in enumerate(order):
            nxt = order[(k + 1) % len(order)][2]
            half = len(t) // 2
            r = got[(None if no else i, len(t))]
            assert r.edited_sha256 == brute.sha(t[:len(t) - half] + nxt[:half])
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            if t == nxt:
                assert r.near_next == 1.0
        assert not any(n in plan(out) for n in PYTHON_NODES)
    assert multiset.edit_report(docs.limit(0)).count() == 0
    only = multiset.edit_report(docs.where("doc_id = 9")).first()
    assert only.near_next == 1.0


def test_likeness_follows_shared_text(spark):
    rng = random.Random(1)
    line = lambda: " ".join(rng.choice("abcdefghijklmnop") * 3 + str(rng.random()) for _ in range(8)) + "."
    a = [line() for _ in range(40)]
    mix = [a[:40 - n] + [line() for _ in range(n)] for n in (0, 10, 20, 40)]
    f = fp(spark, *["\n".join(m) for m in mix])
    df = spark.createDataFrame([(f[0], x) for x in f], "a array<bigint>, b array<bigint>")
    near = [r.x for r in df.select(multiset.likeness(F.col("a"), F.col("b")).alias("x")).collect()]
    assert near[0] == 1.0
    for x, want in zip(near[1:], (0.75, 0.5, 0.0)):
        assert abs(x - want) < 0.3
    assert near[1] > near[2] > near[3]


def test_chat_problems_and_role_names(spark):
    rows = [(0, '{"messages": [{"role": "human", "content": "a"}, {"role": "bot", "content": "b"}]}'),
            (1, '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}'),
            (2, None), (3, "no JSON"), (4, '{"other": 1}')]
    df = spark.createDataFrame(rows, "i int, record string")
    got = {r.i: (r.layout, [t.role for t in r.turns], r.problem) for r in chat.to_turns(df).collect()}
    assert got == {0: ("messages", ["human", "bot"], None), 1: ("share", ["user", "assistant"], None), 2: (None, [], "null"),
                   3: (None, [], "unparsed"), 4: (None, [], "unknown layout")}
    assert chat.to_turns(df.where("i < 2"), strict=True).count() == 2
    for i in (2, 3, 4):
        with pytest.raises(Exception, match="no known layout"):
            chat.to_turns(df.where(f"i = {i}"), strict=True).select("turns").collect()


def test_chat_query_keeps_role_names(spark, tmp_path):
    convs = [(c, t, r, f"text {c} {t}") for c in range(4) for t, r in enumerate(["human", "gpt", "tool"] if c < 2 else ["user", "model"])]
    spark.createDataFrame(convs, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    from evalspark.llm.queries import QUERIES
    got = {r.conv_id: (r.n_turns, r.turns_sha256) for r in QUERIES["op6_chat_format"](spark, str(tmp_path)).collect()}
    for c in range(4):
        own = [(r, x) for k, _, r, x in convs if k == c]
        assert got[c] == (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest())
    assert len(got) == 5
