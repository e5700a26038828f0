"""Registered queries of this package: ``QUERIES[name](spark, sf_dir)`` and DuckDB SQL in ``ORACLE``."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F

from . import align, chat, decontam, langid, mixing, multiset, pii, pivots, projections, simhash, suffixes, toxicity, url_filter
from .util import broadcast_under, crc_mod, table, written

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# --- 1: URL filters ---------------------------------------------------------

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@register("op1_url_filter", """
WITH u AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT *, host = 'net' OR host LIKE '%.net' AS net, host = 'example.net' OR host LIKE '%.example.net' AS exnet,
             host = 'example.com' OR host LIKE '%.example.com' AS excom, host = 'org' OR host LIKE '%.org' AS org FROM p),
r AS (SELECT page_id, host, path,
             CASE WHEN exnet AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN excom AND starts_with(path, '/de/') THEN 'example.com/de/'
                  WHEN org AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN net AND starts_with(path, '/') THEN 'net/' END AS rule FROM m)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
""")
def q_url_filter(spark, d):
    listed = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.url_filter(table(spark, d, "pages").select("page_id", "url"), listed).select(
        "page_id", "host", "path", "rule", "verdict")


# --- 6: chat formatting -----------------------------------------------------

TRICKY = "\\### Assistant: </turn> ok"


def conversation_records(spark, d):
    """Every conversation as one JSON record: conversations of user and assistant alone as prompt
    and response or instruction and output, with a system text as system prompt, others as messages
    in one of two layouts (by conv_id)."""
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    t = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))))
    convs = rows.groupBy("conv_id").agg(t.alias("t"))
    roles, odd = F.transform("t", lambda x: x["role"]), F.col("conv_id") % 2 != 0
    aliases = F.exists(roles, lambda r: r.isin(*chat.ROLES))  # the shared layout would rename these
    pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    triple = (roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))) & (F.get("t", 0)["content"] != "")

    def at(i):
        return F.get("t", i)["content"]
    record = (F.when(pair & odd, F.to_json(F.struct(at(0).alias("prompt"), at(1).alias("response"))))
              .when(pair, F.to_json(F.struct(at(0).alias("instruction"), at(1).alias("output"))))
              .when(triple, F.to_json(F.struct(at(0).alias("system"), at(1).alias("prompt"), at(2).alias("response"))))
              .when(odd & ~aliases, F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("from"), x["content"].alias("value"))).alias("conversations"))))
              .otherwise(F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"], x["content"])).alias("messages")))))
    return convs.select("conv_id", record.alias("record"))


@register("op6_chat_format", r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) + 4 + 2 + 8
             + length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) AS n FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""")
def q_chat_format(spark, d):
    out = chat.format_chat(chat.to_turns(conversation_records(spark, d), strict=True))
    out = (out.withColumn("back", chat.read_back(F.col("formatted")))
           .withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_mask"))))
    digest = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))


# --- 4: mixing sources ------------------------------------------------------

MIX_PARTS, MIX_DEFAULT, MIX_BLOCK = {"src0": 10}, 3, 64


@register("op4_pfair_mix", """
WITH RECURSIVE src AS (SELECT row_number() OVER (ORDER BY source NULLS FIRST) AS i, source, CASE WHEN source = 'src0' THEN 10 ELSE 3 END AS p
                       FROM (SELECT DISTINCT source FROM documents)),
g AS (SELECT CASE WHEN count(*) FILTER (p <> 3) = 0 THEN 3 WHEN count(*) FILTER (p = 3) = 0 THEN 10 ELSE 1 END AS g FROM src),
parts AS (SELECT i, source, (p // g)::BIGINT AS p FROM src, g),
d AS (SELECT sum(p)::BIGINT AS period, list(p ORDER BY i) AS ps, count(*) AS n FROM parts),
edf AS (SELECT -1::BIGINT AS t, 0::BIGINT AS pick, list_transform(ps, lambda x: 0::BIGINT) AS done FROM d
        UNION ALL
        SELECT t + 1, c, list_transform(done, lambda x, k: x + CASE WHEN k = c THEN 1 ELSE 0 END)
        FROM (SELECT t, done, list_min(list_filter(list_transform(range(1, n + 1), lambda k: {
                  'deadline': (((done[k] + 1) * period + ps[k] - 1) // ps[k])::BIGINT, 'k': k::BIGINT,
                  'free': (done[k] * period) // ps[k] <= t + 1 AND done[k] < ps[k]}), lambda z: z.free)).k AS c
              FROM edf, d WHERE t + 1 < period)),
slots AS (SELECT pick AS i, t AS pos, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM edf WHERE t >= 0),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 15))::BIGINT, doc_id) - 1 AS r FROM documents),
b AS (SELECT doc_id, r.source, r, (r // 64)::BIGINT AS block, i, p FROM ranked r JOIN parts s ON r.source IS NOT DISTINCT FROM s.source),
h AS (SELECT min(((c + 63) // 64) * period // p) AS horizon FROM (SELECT i, any_value(p) AS p, count(*) AS c FROM b GROUP BY i), d)
SELECT doc_id, source, block, block * period // p AS release, ((block + 1) * period + p - 1) // p AS deadline,
       ((block // p) * period + pos)::BIGINT AS slot, (((block // p) * period + pos) * 64 + r % 64)::BIGINT AS mix_order,
       (block // p) * period + pos < horizon AS in_horizon
FROM b JOIN slots USING (i), d, h WHERE k = block % p
""")
def q_pfair_mix(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return mixing.pfair_mix(docs, MIX_PARTS, MIX_DEFAULT, block_rows=MIX_BLOCK).drop("text")


# --- 7: SimHash near-duplicates ---------------------------------------------

SIMHASH = {"shingle": 3, "max_bits": 2}


@register("op7_simhash")
def q_simhash(spark, d):
    out = simhash.near_duplicates(table(spark, d, "documents"), **SIMHASH)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- 8: benchmark decontamination -------------------------------------------

@register("op8_decontaminate")
def q_decontaminate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = decontam.mark(docs, table(spark, d, "benchmark"), "item_ids")
    return out.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids")


# --- 9: document fingerprints -----------------------------------------------

@register("op9_multiset_hash")
def q_multiset_hash(spark, d):
    return multiset.edit_report(table(spark, d, "documents"))


# --- 2: personal data -------------------------------------------------------

#: terms must stand with their entity against chance at this level over all pairs
PII = {"chance": 0.01}


@register("op2_pii")
def q_pii(spark, d):
    out = pii.sanitise(table(spark, d, "documents").select("doc_id", "text"), keep_text=False, **PII)
    base = F.sha2(pii.span_text(), 256)
    return out.select("doc_id", *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in pii.KINDS], base.alias("base_sha256"),
                      pii.span_text((*pii.KINDS, "term")).alias("spans"), F.size("__term").cast("long").alias("n_term"))


# --- 5: language identification ---------------------------------------------

@register("op5_langid")
def q_langid(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    out = docs.select("doc_id", (F.coalesce(crc_mod("doc_id", 4), F.lit(-1)) == 2).alias("held_out"),
                      langid.predict(model, F.col("text"), spark).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


# --- 3: toxicity ------------------------------------------------------------

@register("op3_toxicity")
def q_toxicity(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, d, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (F.coalesce(crc_mod("doc_id", 3), F.lit(-1)) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


# --- 10: repeated passages --------------------------------------------------

@register("op10_repeated_bytes")
def q_repeated_bytes(spark, d):
    @F.pandas_udf("n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    def digest(texts: pd.Series, removed: pd.Series) -> pd.DataFrame:
        rows = []
        for t, r in zip(texts, removed):
            raw = (t or "").encode()
            left = suffixes.kept(raw, r)
            rows.append((len(raw), len(raw) - len(left), len(r), hashlib.sha256(left).hexdigest()))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
    out = suffixes.repeated(table(spark, d, "documents"))
    return out.select("doc_id", digest("text", "removed").alias("x")).select("doc_id", "x.*")


# --- 12: cross-tokenizer alignment ------------------------------------------

#: folder of the public tokenizers' files
TOKENIZERS = "/opt/tokenizers"


@register("op12_token_align")
def q_token_align(spark, d):
    a = align.Vocabulary.read("byte_bpe", f"{TOKENIZERS}/byte_bpe_50k.json")
    b = align.Vocabulary.read("piece_bpe", f"{TOKENIZERS}/piece_bpe_32k.model")
    return align.align(table(spark, d, "documents"), a, b)


# --- 11: vector code compression --------------------------------------------

#: rows of one label are dealt to so many partitions where the labels' sums are too many to broadcast
LABEL_SALTS = 16


def _assign_sql(books: str) -> str:
    """Every part with the least (distance, entry) of its position's codebook."""
    return f"""SELECT vec_id, label, p, any_value(x) AS x, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) AS m
               FROM parts JOIN {books} USING (p) GROUP BY vec_id, label, p"""


def _improve_sql(books: str, assigned: str) -> str:
    """Entries as the floor of their parts' means; unused ones stay."""
    return f"""SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM {books} b LEFT JOIN (
                 SELECT p, e, list(v ORDER BY i) AS c FROM (
                   SELECT p, m.e AS e, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS v FROM {assigned}, range(1, 5) t(i) GROUP BY p, m.e, i) GROUP BY p, e) n
               ON n.p = b.p AND n.e = b.e"""


@register("op11_pivot_codes", f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, p, v[p * 4 + 1 : p * 4 + 4] AS x FROM k, range(16) t(p)),
b0 AS (SELECT p, e, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 64),
a0 AS ({_assign_sql('b0')}), b1 AS ({_improve_sql('b0', 'a0')}),
a1 AS ({_assign_sql('b1')}), b2 AS ({_improve_sql('b1', 'a1')}),
a2 AS ({_assign_sql('b2')}),
r AS (SELECT vec_id, label, string_agg(format('{{:02x}}', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a2 GROUP BY vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256 FROM r
""")
def q_pivot_codes(spark, d):
    rows, books = pivots.compress(table(spark, d, "embeddings").select("vec_id", "embedding", "label"))
    rows = written(rows, "codes")
    salt = F.explode(F.sequence(F.lit(0), F.lit(LABEL_SALTS - 1)))
    sums = written(rows.groupBy("label").agg(F.sum("__error").alias("label_error")), "label-errors")
    by = sums.select(F.col("label").alias("of"), "label_error", salt.alias("salt"))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "__code"), F.lit(LABEL_SALTS)).cast("int"))
    same = F.col("label").eqNullSafe(F.col("of")) & (dealt["salt"] == by["salt"])
    out = dealt.join(broadcast_under(by, sums.count() * LABEL_SALTS, 24), same)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    code = F.array_join(F.transform("__code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return out.select("vec_id", code.alias("code"), F.col("__error").alias("error"), "label_error", F.lit(digest).alias("codebooks_sha256"))


# --- 13: embedding near-duplicates ------------------------------------------

@register("op13_embedding_dedup", """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
                     WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS norm FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.9),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT vec_id, b FROM reach JOIN links ON r = a),
c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
""")
def q_embedding_dedup(spark, d):
    out = projections.near_duplicates(table(spark, d, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
