"""Personal data: base patterns, and terms that disclose the people they stand next to.

Base spans are found with regular expressions, leftmost and non-overlapping per kind;
matches that fail their check (parts of an address, digits of a number, Luhn sum) are
dropped without retries.  Their values are the protected entities.

Information-theoretic part: a term is a run of letters of any length outside the base
spans; in scripts without blanks (Chinese, Japanese, Thai, Lao, Khmer, Burmese) every two
neighbouring letters, or a letter that stands alone.  Over the whole corpus, with N
documents, n_t holding the term, n_e the entity and n_te both, at any distance, the
point-wise mutual information log2(n_te N / (n_t n_e)) over the entity's information
log2(N / n_e) is the share of the entity that the term discloses.  Terms seen with the
entity in at least ``support`` documents whose contexts (``context`` code points to each
side of the entity) differ, so that copies are one, are generalised from
``generalise_at`` on and removed from ``remove_at`` on, in every document that holds the
term, with or without the entity; of two actions the stronger is taken.

Chance: two long documents share rare words.  With ``chance`` set, a pair counts only if it
is unlikely under independence: of W words in all documents (distinct in each), W_e stand in the
entity's, so the term is expected there n_t W_e / W times.  The Poisson tail of the number of
independent documents (Chernoff's bound) must be below ``chance`` over the number of pairs that
could be tried, entities times terms.  Near copies are not independent: the documents of an entity
are grouped by a signature (its contexts, or one of ``SIGNATURES`` min-hashes of neighbouring words,
whichever puts most together), and groups of n_i documents count as
(sum n_i)^2 / sum n_i^2 documents.

Everything is DataFrame functions.  Words of all texts are counted once (combined on the map
side).  Where the terms are at most ``LITERAL_TERMS`` every row looks its own words up in
the plan's constant set, and no text is shuffled; beyond it rows and terms are joined.

Defined cases: null text is empty (no spans); an entity in every document has nothing to
disclose; every row has the terms of its own text, whatever its id; repeated rows are kept
and counted; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import evaluate_once
from ..functions.json import bound
from .util import broadcast_under, written

_TERMS = "array<struct<term:string,action:string>>"
_SPAN = "array<struct<start:int,end:int,value:string>>"
#: the four kinds in order.  A match starts where its run of characters starts, or where the
#: last match ended, so a run is tried once; possessive parts never need to give back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
_MAY = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
        "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": lambda t: t.contains("+")}
_DENSE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}&&[\p{L}\p{M}]]"
#: runs of letters; in dense scripts (without blanks) only those that stand alone
WORD = rf"[\p{{L}}\p{{M}}&&[^{_DENSE}]]++|(?<!{_DENSE}){_DENSE}(?!{_DENSE})"
PAIR = rf"(?=({_DENSE}{{2}}))"
ACTIONS = {"generalise": "[TERM]", "remove": ""}  # the stronger sorts last
SALT = 64
SIGNATURES = 6
#: so many terms stand in the plan as a constant set
LITERAL_TERMS = 2000


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.transform(F.split(F.reverse(digits), "", F.length(digits)), lambda c, i: F.when(
        i % 2 == 1, F.get(F.array(*[F.lit(x * 2 - 9 * (x > 4)) for x in range(10)]), c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(back, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
                        & (F.right(F.concat(F.lit("00"), p), F.lit(3)).cast("int") <= 255))
    n = F.length(_digits(m))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(13, 19), _luhn(_digits(m))).otherwise(F.lit(False))


def spans(text: Column, pattern: Column, valid) -> Column:
    """Valid matches as (start, end, value): what lies between matches gives the offsets."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    zipped = F.zip_with(F.split(text, pattern, -1), found, lambda a, m: F.struct(F.length(a).alias("a"), m.alias("m")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["a"]
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value")))
        return F.struct(end.alias("at"), F.when(x["m"].isNotNull() & valid(x["m"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))
    return F.aggregate(zipped, zero, step)["out"]


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add one column of spans for each kind, named ``__email`` and so on."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(_SPAN)
    return evaluate_once(docs, **{f"__{k}": F.when(_MAY[k](t), spans(t, F.lit(PATTERNS[k]), lambda m, k=k: _valid(k, m))).otherwise(none)
                                  for k in KINDS})


def _all(kinds=KINDS) -> Column:
    """All base spans of a row with their kind's number."""
    def numbered(i: int, k: str) -> Column:
        return F.transform(f"__{k}", lambda s: F.struct(
            F.lit(i).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return F.flatten(F.array(*[numbered(i, k) for i, k in enumerate(kinds)]))


def _entity(s: Column) -> Column:
    return F.concat(s["kind"].cast("string"), F.lit(":"), F.lower(s["value"]))


def words(t: Column) -> Column:
    """Distinct words of a text, in lower case."""
    found = F.concat(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), F.regexp_extract_all(t, F.lit(PAIR), F.lit(1)))
    plain = F.regexp_extract_all(t, F.lit(r"[\p{L}\p{M}]++"), F.lit(0))  # the same where no dense script can be, and faster
    found = F.when(t.rlike(r"[^\x{0}-\x{DFF}\x{2000}-\x{20FF}]"), found).otherwise(plain)
    return F.array_distinct(F.transform(found, lambda w: F.lower(w)))


def _pairs_in(text: Column, names: Column) -> Column:
    """Spans of neighbouring letters that are one of ``names``; they may overlap."""
    chars = F.split(text, "")
    each = F.zip_with(chars, F.slice(chars, F.lit(2), F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, b))
    each = F.transform(each, lambda v, i: F.struct(i.alias("start"), (i + 2).alias("end"), v.alias("value")))
    return F.filter(each, lambda s: F.coalesce(F.array_contains(names, F.lower(s["value"])), F.lit(False)) & s["value"].rlike(PAIR))


def _outside(text: Column) -> Column:
    """The text with a blank for every base span."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.array(F.when(s["start"] > acc["at"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"])).otherwise(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    ordered = F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    rest = F.aggregate(ordered, zero, step, lambda acc: F.concat(
        F.array_join(acc["out"], " "), F.lit(" "), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size("__spans") > 0, rest).otherwise(F.coalesce(text, F.lit("")))


def by_term(held: DataFrame, terms: DataFrame, how: str) -> DataFrame:
    """Join rows with a word ``t`` to the few ``terms``; beyond a broadcast a frequent word is dealt over ``SALT`` tasks."""
    n = terms.count()
    small = broadcast_under(terms, n, 100)
    if small is not terms:
        return held.join(small, "t", how)
    salted = terms.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return held.withColumn("__salt", F.pmod("__row", F.lit(SALT)).cast("int")).join(salted, ["t", "__salt"], how).drop("__salt")


def with_entities(docs: DataFrame, text: str, context: int) -> DataFrame:
    """``__row, es, ts`` of the rows with base spans: their entities, each with one fingerprint of
    its contexts (copies of a text have the same), and their distinct words."""
    def near_text(s: Column) -> Column:
        from_ = F.greatest(F.lit(1), s["start"] + 1 - context)
        left = F.substring(F.col(text), from_, s["start"] + 1 - from_)
        right = F.substring(F.col(text), s["end"] + 1, F.lit(context))
        left = F.when(from_ > 1, F.regexp_replace(left, r"^\S+", "")).otherwise(left)
        right = F.when(F.length(right) == context, F.regexp_replace(right, r"\S+$", "")).otherwise(right)
        return F.concat(left, F.lit(" "), right)

    each = F.array_sort(F.array_distinct(F.transform("__spans", lambda s: F.struct(
        _entity(s).alias("e"), F.xxhash64(near_text(s)).alias("c")))))
    first = bound(each, lambda es: F.filter(es, lambda x, i: (i == 0) | (F.get(es, i - 1)["e"] != x["e"])))
    found = detect(docs, text).withColumn("__spans", _all()).where(F.size("__spans") > 0)
    found = evaluate_once(found.select(F.monotonically_increasing_id().alias("__row"), first.alias("es"), F.col(text), "__spans"),
                          ts=words(_outside(F.col(text)))).drop(text, "__spans")
    beside = F.zip_with("ts", F.slice("ts", 2, F.greatest(F.size("ts"), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return found.withColumn("sigs", F.array(*[F.array_min(F.transform(beside, lambda p, j=j: F.xxhash64(F.lit(j), p["a"], p["b"])))
                                              for j in range(SIGNATURES)]))


def word_counts(docs: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """``t, n_t``: documents that hold each word outside base spans."""
    rest = detect(docs, text).withColumn("__spans", _all()).where(F.size("__spans") == 0)
    every = rest.select(words(F.coalesce(F.col(text), F.lit(""))).alias("ts")).unionByName(found.select("ts"))
    return every.select(F.explode("ts").alias("t")).groupBy("t").agg(F.count("*").alias("n_t"))


def signature_of(found: DataFrame, entities: DataFrame) -> DataFrame:
    """``e, j``: which signature (0: contexts, else a min-hash) puts most of the entity's documents together."""
    each = F.posexplode(F.concat(F.array("c"), "sigs")).alias("j", "s")
    rows = found.select("sigs", F.inline("es")).join(entities.select("e"), "e", "left_semi").select("e", each)
    sizes = rows.groupBy("e", "j", "s").agg(F.count("*").alias("n")).groupBy("e", "j").agg(F.sum(F.col("n") * F.col("n")).alias("q"))
    return sizes.groupBy("e").agg(F.max_by("j", F.struct("q", -F.col("j"))).alias("j"))


def together(found: DataFrame, entities: DataFrame, support: int) -> DataFrame:
    """``e, t, n_te, contexts, documents`` (how many independent ones) for the entities that are kept,
    their documents told apart by signature ``j``."""
    n = entities.count()
    own = F.when(F.col("j") == 0, F.col("c")).otherwise(F.get("sigs", F.col("j") - 1)).alias("c")
    if n * 100 > 8 << 20:  # too many to send: regroup by row, so that words are dealt by row, not by entity
        of_row = (found.select("__row", "sigs", F.inline("es")).join(entities.select("e", "j"), "e").select("__row", "e", own)
                  .groupBy("__row").agg(F.collect_list(F.struct("e", "c")).alias("kept")))
        both = found.join(of_row, "__row").select("ts", F.inline("kept"))
    else:
        both = found.select("ts", "sigs", F.inline("es")).join(broadcast_under(entities.select("e", "j"), n, 100), "e").select("ts", "e", own)
    # every pair of a row comes once, so counting rows needs no distinct
    seen = both.select("e", "c", F.explode("ts").alias("t")).groupBy("e", "t", "c").agg(F.count("*").alias("n"))
    alike = F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))
    return seen.groupBy("e", "t").agg(F.sum("n").alias("n_te"), F.count("*").alias("contexts"), alike.alias("documents")).where(F.col("contexts") >= support)


def _share(n: int) -> Column:
    own = F.log2(F.lit(float(n)) / F.col("n_e"))
    return F.when(own > 0, F.log2(F.col("n_te") * F.lit(float(n)) / (F.col("n_t") * F.col("n_e"))) / own).otherwise(F.lit(0.0))


def scored_terms(docs: DataFrame, text: str = "text", context: int = 48, support: int = 2, generalise_at: float = 0.7,
                 remove_at: float = 0.9, chance: float | None = None) -> DataFrame:
    """``entity, term, disclosure, action`` over all ``docs``."""
    found = written(with_entities(docs, text, context), "pii-found")
    counts = written(word_counts(docs, found, text), "pii-words")
    per_context = found.select(F.inline("es"), F.size("ts").alias("w")).groupBy("e", "c").agg(F.count("*").alias("n"), F.max("w").alias("w"))
    entities = per_context.groupBy("e").agg(F.sum("n").alias("n_e"), F.count("*").alias("contexts"), F.sum("w").alias("w_e"))
    entities = written(entities.where(F.col("contexts") >= support).drop("contexts"), "pii-entities")
    n = docs.count()
    if chance is None:
        entities = entities.withColumn("j", F.lit(0))
    else:
        entities = written(entities.join(signature_of(found, entities), "e"), "pii-signatures")
    pairs = together(found, entities, support).join(counts, "t").join(entities, "e").withColumn("disclosure", _share(n))
    pairs = pairs.where(F.col("disclosure") >= generalise_at)
    if chance is not None:
        n_terms, n_words = counts.agg(F.count("*"), F.sum("n_t")).first()
        tried = math.log(max(1, entities.count() * n_terms) / chance)
        k, expected = F.col("documents"), F.col("n_t") * F.col("w_e") / F.lit(float(n_words or 1))
        pairs = pairs.where((k > expected) & (k * F.log(k / expected) - k + expected >= tried))
    return pairs.select(F.col("e").alias("entity"), F.col("t").alias("term"), "disclosure",
                        F.when(F.col("disclosure") >= remove_at, "remove").otherwise("generalise").alias("action"))


def disclosing_terms(found: DataFrame, docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """``entity, term, disclosure, action`` over all ``docs`` (``found``, the rows with spans, follow from them)."""
    return scored_terms(docs, text, **limits)


def _looked_up(docs: DataFrame, text: str, actions: dict[str, str]) -> DataFrame:
    """``__terms`` of every row from the constant ``actions``; null where a row has none."""
    if not actions:
        return docs.withColumn("__terms", F.lit(None).cast(_TERMS))
    stronger = [t for t, a in actions.items() if a == "remove"]
    one = F.filter(words(_outside(F.col(text))), lambda w: w.isin(list(actions)))
    action = (lambda w: F.when(w.isin(stronger), "remove").otherwise("generalise")) if stronger else (lambda w: F.lit("generalise"))
    return docs.withColumn("__terms", bound(one, lambda ts: F.when(F.size(ts) > 0, F.transform(
        ts, lambda w: F.struct(w.alias("term"), action(w).alias("action"))))))


def _joined(docs: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """``__terms`` by joining every row's words with the terms."""
    base = written(docs.withColumn("__row", F.monotonically_increasing_id()), "pii-base")
    every = base.select("__row", F.explode(words(_outside(F.col(text)))).alias("t"))
    of_row = (by_term(every, terms, "inner").groupBy("__row")
              .agg(F.collect_list(F.struct(F.col("t").alias("term"), "action")).alias("__terms")))
    of_row = written(of_row, "pii-rows").withColumnRenamed("__row", "__row2")
    of_row = broadcast_under(of_row, of_row.count(), 500)
    return base.join(of_row, base["__row"] == of_row["__row2"], "left").drop("__row", "__row2")


def sanitise(docs: DataFrame, text: str = "text", keep_text: bool = True, literal_terms: int | None = None, **limits) -> DataFrame:
    """``docs`` with ``__email .. __phone``, ``__term`` spans; rows without any spans keep their
    text only if ``keep_text``."""
    terms = scored_terms(docs, text, **limits).groupBy(F.col("term").alias("t")).agg(F.max("action").alias("action"))
    terms = written(terms, "pii-terms")
    base = detect(docs, text).withColumn("__spans", _all())
    if terms.count() <= (LITERAL_TERMS if literal_terms is None else literal_terms):
        out = _looked_up(base, text, {r["t"]: r["action"] for r in terms.collect()})  # at most LITERAL_TERMS
    else:
        out = _joined(base, text, terms)
    names = F.transform("__terms", lambda t: t["term"])
    in_text = spans(F.col(text), F.lit(WORD), lambda m: F.array_contains(names, F.lower(m)))
    in_text = F.concat(in_text, F.when(F.exists(names, lambda t: t.rlike(PAIR)), _pairs_in(F.col(text), names)).otherwise(F.array().cast(_SPAN)))
    clear = F.filter(in_text, lambda s: ~F.exists("__spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    out = out.withColumn("__term", F.when(F.col("__terms").isNotNull(), clear).otherwise(F.array().cast(_SPAN)))
    if not keep_text:
        out = out.withColumn(text, F.when((F.size("__spans") > 0) | (F.size("__term") > 0), F.col(text)))
    return out


def span_text(kinds=KINDS) -> Column:
    """``kind:start:end`` by kind as listed, then start, comma-joined."""
    def named(k: str) -> Column:
        return F.transform(f"__{k}", lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(F.flatten(F.array(*[named(k) for k in kinds])), ",")


def cleaned(text: str = "text") -> Column:
    """The text with every base span as ``[KIND]`` and every term as its action says;
    overlapping spans become one."""
    act = F.map_from_entries(F.coalesce("__terms", F.array().cast(_TERMS)))
    marks = F.map_from_arrays(F.array(*[F.lit(a) for a in ACTIONS]), F.array(*[F.lit(x) for x in ACTIONS.values()]))

    def marked(k: str) -> Column:
        return F.transform(f"__{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{k.upper()}]").alias("mark")))
    term = F.transform("__term", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.coalesce(
        F.try_element_at(marks, F.try_element_at(act, F.lower(s["value"]))), F.lit(ACTIONS["generalise"])).alias("mark")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.array(F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), s["mark"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= acc["at"], F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text))))
    every = F.array_sort(F.flatten(F.array(*[marked(k) for k in KINDS], term)))
    return F.when(F.size(every) > 0, F.aggregate(every, zero, step, finish)).otherwise(F.col(text))
