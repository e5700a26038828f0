"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of a fixed lexicon of insults and of a learned one, how many
hits stand near the second person, rates of second person, capitals, shouted words,
punctuation, repeated marks and obfuscated words (letters swapped for digits or signs,
or set apart by signs; those that read as a lexicon word once undone count as hits; what
slashes or brackets set apart is judged by itself, at any length).

Learning takes a bounded sample of the labelled rows outside the held-out fold: at most
``max_rows``, drawn by hash of the id, so all that is learned (lexicon, trees,
calibration) works on a bounded table.  The lexicon holds up to ``MAX_LEXICON`` words
and stems (word beginnings, written with a star) whose share among toxic texts is much
larger than among clean ones; copies of a text count once.  The trees see each half of the
sample through the lexicon of the other half, and a quarter of it calibrates them; the
lexicon of the whole sample is used from then on.  All texts are scored.

Defined cases: null or empty texts have all-zero features and get the model's score for
those; several labels of one id: toxic wins; null labels or ids are ignored; without rows
of both classes every score is the toxic share of the sample (0 without a sample).
Rows and repeated ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import crc_mod, workers, written

#: fixed word lists: insults, and the second person in English, German, French and Spanish
INSULTS = frozenset("""
idiot moron loser stupid dumb scum trash worthless pathetic disgusting clown vermin coward fool imbecile cretin
jerk creep filth filthy garbage scumbag bastard bitch asshole dumbass retard liar ugly
""".split())
SECOND_PERSON = frozenset("""
you your yours yourself du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos
tú ti tus usted ustedes vosotros vuestro vuestra
""".split())
UNDO = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
WORD = re.compile(r"[^\W\d_]+")
SIGN, LATIN, APART = re.compile(r"[@$*!|0134570._-]"), re.compile("[A-Za-z]"), re.compile(r"[/\\()\[\]{}<>]+")
RUNS = re.compile(r"[!?.]{2,}|[*#$%&@]{2,}")
MAX_LEXICON, MAX_CANDIDATES, NEAR, DEPTH = 200, 20_000, 5, 2
STEMS = (4, 5, 6)
NAMES = ("insults", "insult_hits", "learned", "learned_hits", "learned_max", "near_person", "person", "capitals", "shouted",
         "exclaims", "punctuation", "mark_runs", "obfuscated", "obfuscated_hits", "words")
_PUNCT = np.array([chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for i in range(256)])


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    share: float


def weight(word: str, lexicon: dict[str, float]) -> float:
    """Log odds of the word or of its stems, 0 where none is listed."""
    best = lexicon.get(word, 0.0)
    for k in STEMS:
        if len(word) > k:
            best = max(best, lexicon.get(word[:k] + "*", 0.0))
    return best


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    if not text:
        return [0.0] * len(NAMES)
    words = WORD.findall(text)
    low = [w.lower() for w in words]
    n = max(1, len(low))
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    insult = [i for i, w in enumerate(low) if w in INSULTS]
    of = {w: weight(w, lexicon) for w in set(low)} if lexicon else {}
    learned = [i for i, w in enumerate(low) if of.get(w)]
    person = [i for i, w in enumerate(low) if w in SECOND_PERSON]
    hits = sorted({*insult, *learned})
    at = np.array(person)
    near = sum(bool(len(at)) and bool(np.abs(at - i).min() <= NEAR) for i in hits)
    mixed = [c for t in text.split() if not t.isalpha() for p in APART.split(t) if _is_mixed(c := p.strip(".,;:!?\"'"))] if _may_mix(raw) else []
    undone = [re.sub(r"[^a-z]", "", m.lower().translate(UNDO)) for m in mixed]
    hidden = sum(u in INSULTS or bool(weight(u, lexicon)) for u in undone)
    shouted = sum(len(w) > 2 and w.isupper() for w in words)
    return [100.0 * (len(insult) + hidden) / n, math.log1p(len(insult) + hidden), 100.0 * sum(of[low[i]] for i in learned) / n,
            math.log1p(len(learned)), max((of[low[i]] for i in learned), default=0.0), near / max(1, len(hits)),
            100.0 * len(person) / n, float(((raw >= 65) & (raw <= 90)).mean()), 100.0 * shouted / n,
            100.0 * text.count("!") / n, float(_PUNCT[raw].mean()), 100.0 * len(RUNS.findall(text)) / n,
            100.0 * len(mixed) / n, math.log1p(hidden), math.log1p(len(low))]


def _is_mixed(token: str) -> bool:
    return len(token) >= 3 and not token.isalpha() and bool(SIGN.search(token)) and bool(LATIN.search(token))


def _may_mix(raw: np.ndarray) -> bool:
    return bool((((raw >= 48) & (raw <= 57)) | (raw == 64) | (raw == 36) | (raw == 42) | (raw == 33) | (raw == 124) | (raw == 45)
                 | (raw == 95) | (raw == 46)).any())


def feature_column(text: Column, lexicon: dict[str, float], spark) -> Column:
    workers(spark)

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t, lexicon) for t in texts], dtype=object)
    return run(text)


def training_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, folds: int, held: int, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled rows ``text, y, part`` (0 to 7) outside the held-out fold."""
    known = (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("y"))
             .where(crc_mod(key, folds) != held))
    n = known.count()
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.where(draw < 0.95 * max_rows / max(n, 1)).limit(max_rows)
    rows = docs.select(key, text).where(F.col(text).isNotNull()).join(F.broadcast(drawn), key)  # max_rows small rows
    return rows.select(F.col(text).alias("text"), "y", F.pmod(F.xxhash64(text, F.lit("part")), F.lit(8)).alias("part"))


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Words and stems of toxic texts with their log odds, chosen to cover the toxic texts."""
    once = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.min("y").alias("y"), F.first("text").alias("text"))
    sizes = {r["y"]: r["n"] for r in once.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return {}
    whole = F.transform(F.regexp_extract_all("text", F.lit(r"\p{L}{3,}"), F.lit(0)), lambda w: F.lower(w))

    def stems(k: int) -> Column:
        return F.transform(F.filter("whole", lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))
    words = once.select("h", "y", F.array_distinct(whole).alias("whole"))
    words = words.select("h", "y", F.explode(F.array_distinct(F.concat("whole", *[stems(k) for k in STEMS]))).alias("w"))
    counts = words.groupBy("w").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0"))
    odds = F.log(((F.col("c1") + 0.5) / (n1 + 1.0)) / ((F.col("c0") + 0.5) / (n0 + 1.0)))
    sure = F.col("odds") / F.sqrt(1 / (F.col("c1") + 0.5) + 1 / (F.col("c0") + 0.5))
    least = max(3, n1 // 100)
    best = (counts.where(F.col("c1") >= least).withColumn("odds", odds).where("odds >= 3").withColumn("sure", sure)
            .orderBy(F.desc("sure"), F.desc("c1"), "w").limit(MAX_CANDIDATES).select("w", "odds"))
    hits = (words.where("y = 1").join(F.broadcast(best), "w").groupBy("w").agg(F.first("odds").alias("odds"), F.collect_list("h").alias("h"))
            .orderBy(F.desc("odds"), "w").collect())  # at most MAX_CANDIDATES units over the bounded sample
    return cover([(r["w"], float(r["odds"]), r["h"]) for r in hits], least)


def cover(units: list[tuple[str, float, list[int]]], least: int) -> dict[str, float]:
    """Units that together explain the toxic texts: the one with the most texts that are not yet
    hit ``DEPTH`` times is taken next, so chance words of explained texts stay out."""
    if not units:
        return {}
    texts = {h: i for i, h in enumerate(sorted({h for _, _, hs in units for h in hs}))}
    text = np.array([texts[h] for _, _, hs in units for h in hs])
    unit = np.repeat(np.arange(len(units)), [len(hs) for _, _, hs in units])
    times, out = np.zeros(len(texts), int), {}
    while len(out) < MAX_LEXICON:
        gain = np.bincount(unit[times[text] < DEPTH], minlength=len(units))
        gain[[i for i, (w, _, _) in enumerate(units) if w in out]] = 0
        best = int(gain.argmax())
        if gain[best] < least:
            break
        out[units[best][0]] = units[best][1]
        times[text[unit == best]] += 1
    return out


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 3, held: int = 1,
        max_rows: int = 20_000) -> Model:
    """Model from labelled rows whose crc32 of the id modulo ``folds`` is not ``held``."""
    spark = docs.sparkSession
    rows = written(training_sample(docs, labels, key, text, label, folds, held, max_rows), "toxicity-sample")
    half = [rows.where(f"part % 2 = {i}") for i in (0, 1)]
    seen = [h.select(feature_column(F.col("text"), learn_lexicon(other), spark).alias("x"), F.col("y").cast("double").alias("label"),
                     (F.col("part") >= 6).alias("calibrates")) for h, other in zip(half, reversed(half))]
    lexicon = learn_lexicon(rows)
    made = written(seen[0].union(seen[1]), "toxicity-features").select(array_to_vector("x").alias("features"), "label", "calibrates").coalesce(8)
    parts = {(r["calibrates"], r["label"]) for r in made.select("calibrates", "label").distinct().collect()}
    share = made.agg(F.avg("label")).first()[0] or 0.0
    if len(parts) < 4:  # a class is absent from a part
        return Model(lexicon, None, None, share)
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.2, subsamplingRate=1.0, seed=7).fit(made.where("not calibrates"))
    scored = trees.transform(made.where("calibrates"))
    iso = IsotonicRegression(featuresCol="probability", featureIndex=1).fit(scored.select("probability", "label"))
    return Model(lexicon, trees, iso, share)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` plus ``score``."""
    keep = [c for c in docs.columns if c != "score"]
    if model.trees is None:
        return docs.select(*keep, F.lit(float(model.share)).alias("score"))
    made = docs.withColumn("__x", array_to_vector(feature_column(F.col(text), model.lexicon, docs.sparkSession)))
    trees = model.trees.copy().setFeaturesCol("__x").setProbabilityCol("__p").setRawPredictionCol("__r").setPredictionCol("__y")
    iso = model.calibration.copy().setFeaturesCol("__p").setPredictionCol("__s")
    out = iso.transform(trees.transform(made))
    return out.select(*keep, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("__s"))).alias("score"))
