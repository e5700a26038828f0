"""Cross-tokenizer alignment against a plain walk over both token lists."""

import hashlib
from collections import Counter
from functools import lru_cache

import pytest

from evalspark.llm import align
from evalspark.llm.queries import QUERIES, TOKENIZERS

A_FILE, B_FILE = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "a", "Hello world, it's 1234 o'clock!", "<|endoftext|> <s> </s> <unk> <0x41>", "▁piece mark", "two  blanks\t\ttabs\r\n\r\nlines ",
         "äöüß ñ çéè", "\U0001F600\U0001F468‍\U0001F469 ok", "中文句子。日本語のテスト", "עברית العربية हिन्दी", "é é ﬁ Ａ", "x" * 3000,
         "the " * 5000, "\x00 zero \x07", "a\u0085b c　d", "don't DON'T we'LL ʼs", "end with blank ", "\n", "١٢٣ ⅷ ²", "\U00010400\U0001E900 new letters"]


@lru_cache
def walkers():
    import sentencepiece
    from tokenizers import Tokenizer
    tok, sp = Tokenizer.from_file(A_FILE), sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    tok.encode_special_tokens = True
    names, alphabet = {i: t for t, i in tok.get_vocab().items()}, align.byte_alphabet()

    def a_bytes(i):
        return bytes(alphabet[c] for c in names[i])

    def b_bytes(i):
        return bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    return lambda t: tok.encode(" " + t, add_special_tokens=False).ids, lambda t: sp.encode(t), a_bytes, b_bytes


def walk(texts):
    enc_a, enc_b, a_bytes, b_bytes = walkers()
    counts, docs = Counter(), []
    for t in texts:
        a, b = (enc_a(t), enc_b(t)) if t else ([], [])
        if not t or b"".join(map(a_bytes, a)) != (" " + t).encode() or b"".join(map(b_bytes, b)) != (" " + t).encode():
            docs.append(None)
            continue
        i = j = at_a = at_b = 0
        groups, own, links = [], ([], []), []
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                at_a, i = at_a + len(a_bytes(a[i])), i + 1
                own[0].append(a[i - 1])
            else:
                at_b, j = at_b + len(b_bytes(b[j])), j + 1
                own[1].append(b[j - 1])
            if at_a == at_b:
                links.append((own[0][-1], own[1][-1]))
                groups.append("|".join(",".join(map(str, x)) for x in own))
                own = ([], [])
        counts.update(links)
        docs.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, y), c in counts.items():
        best[y] = max(c, best.get(y, 0))
    return [(0, 0, 0, 0, 0, 0, "") if d is None else
            (d[0], d[1], d[2], len(d[3]), sum(counts[x] == best[x[1]] for x in d[3]), sum(counts[x] for x in d[3]), d[4]) for d in docs]


def rows_of(df, key="doc_id"):
    return [(r[key], (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in df.collect()]


@pytest.fixture(scope="module")
def vocabularies():
    return align.Vocabulary.read("byte_bpe", A_FILE), align.Vocabulary.read("piece_bpe", B_FILE)


@pytest.mark.parametrize("hot_rows", [1 << 18, 40, 0])  # all counts sent to the tasks, some, none
def test_alignment_of_odd_texts(spark, vocabularies, hot_rows):
    texts = TEXTS + TEXTS[4:9]
    ids = [None if i == 3 else 7 if i in (5, 6) else i for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts)], "doc_id long, text string, n_a int, pairs string").repartition(3)
    got = rows_of(align.align(docs, *vocabularies, hot_rows=hot_rows))
    want = list(zip(ids, walk(texts)))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(w[1] == 0 for _, w in want) < len(texts) // 2


def test_alignment_query_and_empty_table(spark, vocabularies):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    assert dict(rows_of(QUERIES["op12_token_align"](spark, SF))) == dict(zip([r.doc_id for r in rows], walk([r.text for r in rows])))
    assert align.align(docs.limit(0), *vocabularies).count() == 0
    assert rows_of(align.align(docs.limit(0).unionByName(spark.createDataFrame([(1, None)], docs.schema)), *vocabularies)) == [(1, (0, 0, 0, 0, 0, 0, ""))]


def test_fast_encoding_is_the_tokenizer_s(vocabularies):
    """Texts that take the way by ranks have the ids of the tokenizers file."""
    enc_a = walkers()[0]
    texts = [t for t in TEXTS if t]
    a = align.loaded(vocabularies[0])
    assert [list(map(int, x)) for x in a.encode(texts)] == [enc_a(t) for t in texts]
    assert sum(align.BEYOND_LATIN.search(t) is None for t in texts) > 8


def test_slices_hold_long_rows_alone():
    import numpy as np
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"x": list(range(6))})
    parts = list(align.slices(batch, np.array([3, 3, 20, 1, 1, 9]), 8))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1], [2], [3, 4], [5]]
    assert list(align.slices(batch.slice(0, 0), np.array([]), 8)) == []
