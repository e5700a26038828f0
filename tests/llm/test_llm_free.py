"""SimHash, decontamination, language ID, toxicity and repeated bytes: brute force and defined cases."""

import itertools
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.llm import decontam, langid, simhash, suffixes, toxicity
from evalspark.llm.util import crc_mod

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


# --- 7 ----------------------------------------------------------------------

@pytest.mark.parametrize("text", [None, "", " \t\n\x0b\x0c\r", "One", "One two", "One two three", "A b C d É É é\x85x\xa0y", "same " * 5000,
                                  " ".join(str(i) for i in range(40000)), "x" * 100000, "　a b c"])
def test_simhash_fingerprint(text):
    assert simhash.fingerprint(text, 3) & (1 << 64) - 1 == brute.simhash(text)


def near(rng, fp, k):
    for b in rng.sample(range(64), k):
        fp ^= 1 << b
    return fp


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_simhash_links(spark, bits):
    rng = random.Random(bits)
    fps = [rng.getrandbits(64) for _ in range(150)] + [0, (1 << 64) - 1, 1]
    for _ in range(250):
        fps.append(near(rng, rng.choice(fps), rng.choice([1, 2, 2, 3, 4])))
    fps += fps[:20]
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    got = {r.doc_id: r.component_id for r in simhash.assign(spark.createDataFrame(rows, "doc_id long, fp long"), bits).collect()}
    assert [got[i] for i in range(len(fps))] == brute.components(list(range(len(fps))), fps, bits)


def test_simhash_large_near_group(spark):
    """A ball of near fingerprints in one group: linked through the split, without all pairs."""
    rng, center = random.Random(5), random.Random(9).getrandbits(64)
    fps = sorted({near(rng, center, rng.randint(1, 4)) for _ in range(2500)})
    pairs = simhash.forest(np.array(fps, dtype=np.uint64), 2)
    assert len(pairs) < len(fps)
    want, parent = brute.components(list(range(len(fps))), fps), list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(i) for i in range(len(fps))] == want


def test_thresholds_keep_the_budget():
    for costs in ([[0, 5, 9, 30], [0, 1, 100, 100], [0, 7, 8, 9]], [[0, 1, 2, 3]], [[0, 3, 50, 90], [0, 3, 50, 90]]):
        total, ts = simhash.allot(costs, 3)
        want = min((sum(c[t + 1] for c, t in zip(costs, pick)), pick) for pick in itertools.product(range(-1, 3), repeat=len(costs))
                   if sum(t + 1 for t in pick) == 3)
        assert total == want[0] and sum(t + 1 for t in ts) == 3


def test_simhash_rows_and_keep_one(spark):
    rows = [(5, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (None, "a b c d e f g"), (9, None), (8, ""), (7, "other words here now"),
            (None, "only null ids here"), (None, "only null ids here"), (7, "quite another text with id seven")]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], DOCS + ", fp int, component_id string")
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    of = {}
    for r in out:
        of.setdefault(r.doc_id, set()).add(r.component_id)
    assert of[5] == of[3] == {3} and of[9] == of[8] == {8} and of[7] == {7} and of[None] == {3, None}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted([
        ("3", rows[0][1]), ("8", ""), ("7", rows[6][1]), ("None", rows[7][1]), ("7", rows[9][1])])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_simhash_query_on_table(spark):
    from evalspark.llm.queries import QUERIES
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash"](spark, SF).collect()}
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    fps = [brute.simhash(t) for _, t in docs]
    want = brute.components([i for i, _ in docs], fps)
    assert got == {i: (f"{f:016x}", c) for (i, _), f, c in zip(docs, fps, want)}


# --- 8 ----------------------------------------------------------------------

def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        p = rng.randrange(len(s))
        s[p:p + rng.choice([0, 1])] = rng.choice(["", "z", "q"])
    return "".join(s)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_decontam_finds_edited_items_and_leaves_clean_texts():
    rng = random.Random(4)
    items = [(i, sentence(rng, rng.randint(10, 60))) for i in range(30)]
    index = decontam.build_index(items, 120, 0.1, 40)
    texts, want = [], []
    for k in range(120):
        body, leak = sentence(rng, 150), []
        if k % 2:
            i, t = rng.choice(items)
            at = rng.randrange(len(body))
            body, leak = body[:at] + edited(rng, t, int(0.06 * len(t))).upper() + body[at:], [i]
        texts.append(body)
        want.append(leak)
    assert decontam.leaked(index, texts) == want
    # and one by one, at any place of a chunk
    assert [decontam.leaked(index, [t])[0] for t in texts] == want


def test_decontam_agrees_with_alignment_at_the_edge():
    """Windows at and beyond the budget, against the full alignment table."""
    rng = random.Random(8)
    item = sentence(rng, 30)[:120].strip()
    index = decontam.build_index([(1, item)], 120, 0.1, 40)
    n, budget = len(item), int(index.budget[0])
    for k in range(60):
        text = sentence(rng, 12) + " " + edited(rng, item, rng.randint(0, 2 * budget)) + " " + sentence(rng, 12)
        want = brute.edit_distance_to_part(decontam.normal(item), decontam.normal(text)) <= budget
        assert bool(decontam.leaked(index, [text])[0]) == want, (k, n)


def test_decontam_windows_start_anywhere():
    rng = random.Random(11)
    item = sentence(rng, 200)
    index = decontam.build_index([(1, item)], 120, 0.1, 40)
    t = decontam.normal(item)
    for start in range(1, 400, 13):
        body = sentence(rng, 20)
        assert decontam.leaked(index, [body + " " + t[start:start + 130] + " " + body]) == [[1]], start
    assert decontam.leaked(index, [sentence(rng, 300)]) == [[]]


@pytest.mark.parametrize("n", [40, 46, 50, 54, 60, 62, 70, 119])
def test_decontam_short_items_have_their_whole_budget(n):
    rng = random.Random(n)
    item = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    index = decontam.build_index([(1, item)], 120, 0.1, 40)
    e = n // 10
    assert index.budget[0] == e
    for k in range(e + 3):  # edits as far apart as can be
        changed = list(item)
        for j in range(k):
            changed[(j + 1) * n // (k + 1)] = "0"
        assert decontam.leaked(index, ["lead " + "".join(changed) + " tail"]) == [[1] if k <= e else []]


def test_decontam_items_under_40_characters_match_exactly():
    index = decontam.build_index([(1, "What is 2+2?"), (2, "the red fox"), (3, "tiny")], 120, 0.1, 40)
    texts = ['he asked "what  is 2+2?" twice', "what is 2+3?", "The red fox.", "the red foxes", "bathe red fox", "tiny"]
    assert decontam.leaked(index, texts) == [[1], [], [2], [], [], []]


def test_decontam_blocks_one_at_a_time(spark, monkeypatch):
    rng = random.Random(5)
    items = [sentence(rng, 30) for _ in range(4)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(1, items[0] + " " + items[3]), (1, items[2]), (None, items[1]), (4, sentence(rng, 50))], DOCS)
    most, write = [], decontam.written

    def seen(df, name):
        most.append(df._jdf.queryExecution().optimizedPlan().toString().count("leaked_items("))
        return write(df, name)
    monkeypatch.setattr(decontam, "written", seen)
    got = decontam.mark(docs, bench, "x", block_chars=100).select("doc_id", "x").collect()
    assert sorted((str(r.doc_id), r.x) for r in got) == [("1", [0, 3]), ("1", [2]), ("4", []), ("None", [1])]
    assert len(most) > 2 and max(most) <= 1


def test_decontam_defined_cases(spark):
    rng = random.Random(2)
    a, b = sentence(rng, 40), sentence(rng, 25)
    bench = spark.createDataFrame([(1, a, 0), (1, a, 0), (2, b, 0), (3, None, 0), (4, "", 0), (5, "tiny", 0), (None, b, 0)], "item_id long, text string, x int")
    long = sentence(rng, 60000)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "tiny"), (4, long[:300000] + a + long[300000:]), (5, long), (6, a + " " + b), (6, a + " " + b),
                                  (None, b), (8, "tiny " * 5000)], DOCS)
    for block in (1_000_000, 100):  # in one block, and in several
        out = docs.select("doc_id", decontam.leaks(docs, bench, block_chars=block).alias("x")).collect()
        assert sorted((str(r.doc_id), r.x) for r in out) == sorted([
            ("1", []), ("2", []), ("3", []), ("4", [1]), ("5", []), ("6", [1, 2]), ("6", [1, 2]), ("None", [2]), ("8", [])])
    none = docs.select(decontam.leaks(docs, bench.limit(0)).alias("x")).collect()
    assert all(r.x == [] for r in none)
    assert docs.limit(0).select(decontam.leaks(docs, bench).alias("x")).count() == 0


# --- 5 ----------------------------------------------------------------------

def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(1)
    t, k = 5, 3
    e, a, s = rng.normal(size=(1, t, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    total, post = 0.0, np.zeros((t, k))
    for path in itertools.product(range(k), repeat=t):
        w = np.exp(s[path[0]] + sum(e[0, i, y] for i, y in enumerate(path)) + sum(a[x, y] for x, y in zip(path, path[1:])))
        total += w
        for i, y in enumerate(path):
            post[i, y] += w
    gamma = langid.forward_backward(e, np.array([t]), a, s)[0][0]
    assert np.allclose(gamma, post / total)
    # a shorter chain beside a longer one is not touched by the padding
    both = langid.forward_backward(np.concatenate([e, np.pad(e[:, :3], ((0, 0), (0, 2), (0, 0)))]), np.array([t, 3]), a, s)[0]
    alone = langid.forward_backward(e[:, :3], np.array([3]), a, s)[0]
    assert np.allclose(both[0], gamma) and np.allclose(both[1, :3], alone[0])


def test_features_count_words():
    for text in ("", "12 34 !!", "one", " one  two,three.\n", "é x" * 50, "a1b", "\U0001F600 z"):
        grams, words, first = langid.features(text)
        n = len(langid.features_first(text))
        assert len(words) == len(first) == n
    one, two = langid.features("Haus"), langid.features("so haus")
    assert one[1][0] == two[1][1]
    assert set(one[0].ravel()) <= set(two[0].ravel())


def test_langid_accuracy_and_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs, per_lang=80)
    out = docs.withColumn("held", crc_mod("doc_id", 4) == 2).withColumn("p", langid.predict(model, F.col("text"), spark)).where("held").collect()
    right = sum(r.p.lang == r.lang for r in out)
    assert right / len(out) > 0.95
    odd = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (2, "123 !?", None), (None, out[0].text, None), (4, out[0].text * 100, None), (5, "a", None)],
                                DOCS + ", lang string")
    got = {(r.doc_id, r.text): (r.p.lang, r.p.score) for r in odd.withColumn("p", langid.predict(model, F.col("text"), spark)).collect()}
    assert got[(1, None)] == got[(1, "")] == got[(2, "123 !?")] == ("und", 0.0)
    assert got[(None, out[0].text)][0] == got[(4, out[0].text * 100)][0] == out[0].p.lang
    assert all(0 <= s <= 1 for _, s in got.values()) and got[(5, "a")][0] in model.langs
    none = langid.fit(docs.limit(0))
    assert odd.withColumn("p", langid.predict(none, F.col("text"), spark)).where("p.lang <> 'und' or p.score <> 0").count() == 0


def test_langid_code_switch():
    """Words of two invented languages are told apart inside one text."""
    rng = random.Random(6)
    a = [" ".join(rng.choice(["ka", "kora", "kutik", "rokak"]) for _ in range(60)) for _ in range(40)]
    b = [" ".join(rng.choice(["eli", "lemie", "suelle", "ie"]) for _ in range(60)) for _ in range(40)]
    model = langid.train([(t, "a") for t in a] + [(t, "b") for t in b])
    mass = langid.label(model, [a[0] + " " + b[0][:len(b[0]) // 2], b[1]])
    assert 0.5 < mass[0, 0] / mass[0].sum() < 0.8 and mass[1, 1] / mass[1].sum() > 0.95


def test_langid_learns_every_language_and_long_texts(spark):
    """More than 200 languages, one of them in long texts only."""
    rng = random.Random(2)
    langs = [f"l{i:03d}" for i in range(210)]
    stems = {x: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(4)] for x in langs}

    def text(x, n):
        return " ".join(rng.choice(stems[x]) for _ in range(n))
    rows = [(i, text(x, 30 if x != "l007" else 900), x) for i, x in enumerate(langs * 3)]
    model = langid.fit(spark.createDataFrame(rows, DOCS + ", lang string"), folds=1, held=1, per_lang=3, max_chars=2000)
    assert model.langs == langs
    mass = langid.label(model, [text("l007", 40), text("l209", 40)])
    assert [model.langs[i] for i in mass.argmax(axis=1)] == ["l007", "l209"]


def test_langid_pieces_end_at_blanks(monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 50)
    rng = random.Random(3)
    text = " ".join("w" * rng.randint(1, 30) for _ in range(400)) + "\n" + "y" * 130 + " z"
    parts = list(langid.pieces(text))
    assert "".join(parts) == text and all(len(p) <= 50 for p in parts)
    cut = [a for a, b in zip(parts, parts[1:]) if not a[-1].isspace() and not b[0].isspace()]
    assert all(set(p) <= {"y", "\n"} for p in cut)  # only the word that is longer than a piece
    assert list(langid.pieces("")) == []


# --- 3 ----------------------------------------------------------------------

def test_toxicity_pieces_of_any_length():
    def hits(text):
        return dict(zip(toxicity.NAMES, toxicity.features(text, {})))["obfuscated_hits"]
    plain = hits("you 1d10t now")
    assert plain > 0 and hits("you/1d10t now") == plain and hits("(1d10t) now") == plain and hits("[see]/x/{1d10t} now") == plain
    assert hits("m" + "." * 60 + "o.r.o.n now") == plain  # one word, set apart widely
    assert hits("https://a1.example/b2/c3 now") == 0


def test_toxicity_features():
    f = dict(zip(toxicity.NAMES, toxicity.features("You IDIOT!!! you 1d10t, m.o.r.o.n", {"blorf": 2.0, "grum*": 3.0})))
    assert f["insult_hits"] > 0 and f["obfuscated_hits"] > 0 and f["near_person"] > 0 and f["exclaims"] > 0 and f["shouted"] > 0
    assert toxicity.features(None, {}) == toxicity.features("", {}) == [0.0] * len(toxicity.NAMES)
    assert dict(zip(toxicity.NAMES, toxicity.features("blorf grumkin grum", {"blorf": 2.0, "grum*": 3.0})))["learned_max"] == 3.0
    assert all(np.isfinite(toxicity.features("!" * 100000, {})))


def test_toxicity_held_out_and_cases(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(-1, None, "x"), (-2, "", "x"), (-2, "", "x"), (None, "you idiot " * 3000, "x")], DOCS + ", score string")
    all_docs = docs.select("doc_id", "text").withColumn("score", F.lit("x")).unionByName(odd)
    noise = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(all_docs, labels.select("doc_id", "toxic").unionByName(noise))
    out = toxicity.score(all_docs, model)
    rows = out.collect()
    assert len(rows) == docs.count() + 4 and out.columns == ["doc_id", "text", "score"]
    assert all(0 <= r.score <= 1 for r in rows)
    toxic = {r.doc_id: r.toxic for r in labels.where(crc_mod("doc_id", 3) == 1).collect()}
    held = [(r.score >= 0.7, toxic[r.doc_id]) for r in rows if r.doc_id in toxic]
    assert sum(p and not y for p, y in held) <= 1
    assert sum(p and y for p, y in held) >= 0.7 * sum(y for _, y in held)
    none = toxicity.fit(all_docs, labels.limit(0))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.0}
    assert toxicity.score(all_docs.limit(0), model).count() == 0


# --- 10 ---------------------------------------------------------------------

def check_repeats(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    docs = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts)], DOCS + ", uid int")
    got = sorted((str(r.doc_id), (r.text or ""), [tuple(x) for x in r.removed]) for r in suffixes.repeated(docs).collect())
    raws = [(t or "").encode() for t in texts]
    want = brute.repeated_bytes(raws)
    res = []
    for i, (t, raw, (n, spans, kept)) in enumerate(zip(texts, raws, want)):
        res.append((str(ids[i]), t or "", n, spans, kept))
    for (i, t, removed), (j, u, n, spans, kept) in zip(got, sorted(res)):
        raw = t.encode()
        assert (i, t) == (j, u)
        assert sum(z - a for a, z in removed) == n and len(removed) == spans
        assert suffixes.kept(raw, [{"start": a, "end": z} for a, z in removed]) == kept


def passages(rng):
    common = sentence(rng, 90)
    texts = [sentence(rng, rng.randint(0, 200)) + common[rng.randint(0, 60):rng.randint(430, len(common))] + sentence(rng, rng.randint(0, 200)) for _ in range(25)]
    texts += [t[:400] for t in texts[:2]] + [t[:399] for t in texts[:2]]
    copy = sentence(rng, 300)
    texts += [copy, copy, copy[:700] + "Z" + copy[701:], copy[:350] + "Y" + copy[351:], copy + copy]
    texts += ["a" * 399, "a" * 400, "a" * 401, "This " * 200, "ab" * 300, "é" * 350, "", None, sentence(rng, 400)]
    return texts


def test_repeated_bytes(spark):
    check_repeats(spark, passages(random.Random(11)))


def test_repeated_bytes_split_groups(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "MAX_GROUP", 3)
    monkeypatch.setattr(suffixes, "BATCH", 4)
    check_repeats(spark, passages(random.Random(12)))


def test_repeated_bytes_rows_that_ids_do_not_tell_apart(spark):
    rng = random.Random(3)
    t = sentence(rng, 120)
    check_repeats(spark, [t, t, sentence(rng, 120), None], [4, 4, 4, None])
    docs = spark.createDataFrame([], DOCS)
    assert suffixes.repeated(docs).count() == 0


def test_anchors_in_pieces(monkeypatch):
    raw = sentence(random.Random(5), 3000).encode()
    whole = suffixes.anchors_of(raw)
    monkeypatch.setattr(suffixes, "PIECE", 1000)
    suffixes._powers.cache_clear()
    assert suffixes.anchors_of(raw) == whole
    suffixes._powers.cache_clear()


def test_columns_against_sorted_suffixes():
    rng = np.random.default_rng(2)
    rows = rng.integers(97, 99, (40, suffixes.WIDTH)).astype(np.uint8)
    rows[1::2] = rows[::2]
    for i in range(1, 40, 2):
        rows[i, rng.integers(0, suffixes.WIDTH)] ^= 7
    m = len(rows)
    side = np.full(m, suffixes.SIDE)
    group = np.repeat(np.arange(20), 2)
    most, least = suffixes.columns(rows, side, side, group, np.zeros(m, int), side)
    for i in range(m):
        hits = [x for x in range(suffixes.SIDE + 1) if any(
            j != i and group[j] == group[i] and (rows[j, suffixes.SIDE - x:][:suffixes.LENGTH] == rows[i, suffixes.SIDE - x:][:suffixes.LENGTH]).all() for j in range(m))]
        assert (most[i], least[i]) == ((max(hits), min(hits)) if hits else (-1, -1))
