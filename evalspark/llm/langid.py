"""Language identification with a linear-chain conditional random field over words.

A text is its words: runs of letters, in lower case.  The score of a language for a word
is the sum of learned weights of the word's hashed features: all character 2- to 4-grams
including the word's edges (edge n-grams are its affixes) and the whole word (lexicon).
Learned transitions link neighbouring words, so code-switched text changes language where
the evidence does; forward-backward gives every word's language distribution.  A text's
language is the one with the most posterior mass, its score the share of that mass.

Training maximises the conditional likelihood (AdaGrad on expected minus observed
features) over chains of ``CHAIN`` words which are spliced from runs of several sampled
documents, so that transitions between languages are seen.  The sample is bounded:
about ``per_lang`` documents of each language, drawn by text hash, each with its first
``max_chars`` characters at most (scoring reads whole texts).  A document of the sample whose words are mostly given another
language by a first fit is left out of the second fit.

The model, a table of ``1 << HASH_BITS`` rows by languages (each labelled language is
learned), goes to every task; texts are labelled row by row in bounded pieces, cut at blanks, and chains of ``CHAIN`` words are taken at a time.

Defined cases: null text, and text without letters: ``und``, score 0.  No labelled rows:
every text with letters is ``und`` too.  Ties go to the alphabetically first language.
Rows and repeated ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import crc_mod, workers

HASH_BITS, CHAIN = 17, 128
PIECE = 1 << 16       # characters labelled at once
GRAMS = (2, 3, 4)
_LETTER: np.ndarray | None = None


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray      # (features + 1, languages); the last row is zero
    transitions: np.ndarray  # (languages, languages)
    start: np.ndarray


def letters() -> np.ndarray:
    """Table of the code points that are letters or marks on them."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _LETTER


def features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams (one row for each place, zero-weight where none starts), the hashed
    whole words and the first place of each word.  Places are the letters, each word led by an edge."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ok = letters()[c]
    edge_or_letter = ok.copy()
    edge_or_letter[1:] |= ok[:-1]  # one edge after each word
    s = np.where(ok, c, 0)[edge_or_letter].astype(np.uint64)
    if not len(s) or not ok.any():
        return np.zeros((0, len(GRAMS)), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.concatenate(([np.uint64(0)], s[1:] if s[0] == 0 else s, [np.uint64(0)]))
    if s[-2] == 0:
        s = s[:-1]
    n, zero, none = len(s) - 1, s == 0, 1 << HASH_BITS
    first = np.flatnonzero(zero[:-1])
    out = np.full((len(GRAMS), n), none, np.int64)
    mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - HASH_BITS)
    with np.errstate(over="ignore"):
        h, inner = s + np.uint64(1), np.zeros(len(s), bool)
        for k in range(1, max(GRAMS)):
            # h: hash of k characters from each place; inner: an edge lies after the first and before the next
            if k > 1:
                inner = inner[:-1] | zero[k - 1:][:len(inner) - 1]
            else:
                inner = inner[:-1]
            h = h[:-1] * np.uint64(1_000_003) + s[k:] + np.uint64(1)
            g = k + 1
            if g in GRAMS and len(h):
                idx = ((h + np.uint64(g)) * mix >> shift).astype(np.int64)
                m = min(n, len(h))
                out[GRAMS.index(g), :m] = np.where(inner[:m], none, idx[:m])
        # the whole word: sum of mixed characters times powers of their place
        place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(place.max()), np.uint64(0x100000001B3)))))
        word = np.add.reduceat(s[:-1] * power[place], first)
    return out.T, (word * mix >> shift).astype(np.int64), first


def emissions(weights: np.ndarray, grams: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Scores (words, languages)."""
    total = weights.take(grams[:, 0], axis=0, mode="clip")
    for k in range(1, grams.shape[1]):
        total += weights.take(grams[:, k], axis=0, mode="clip")
    return np.add.reduceat(total, first, axis=0) + weights[words]


def forward_backward(e: np.ndarray, length: np.ndarray, transitions: np.ndarray, start: np.ndarray):
    """Posteriors (chains, words, languages) and expected transitions summed; chains are padded."""
    s, t, k = e.shape
    a = np.exp(transitions - transitions.max())
    p = np.exp(e - e.max(axis=2, keepdims=True))
    alpha, beta = np.empty_like(p), np.ones_like(p)
    now = p[:, 0] * np.exp(start - start.max())
    alpha[:, 0] = now / now.sum(axis=1, keepdims=True)
    for i in range(1, t):
        now = (alpha[:, i - 1] @ a) * p[:, i]
        alpha[:, i] = now / now.sum(axis=1, keepdims=True)
    for i in range(t - 2, -1, -1):
        now = (beta[:, i + 1] * p[:, i + 1]) @ a.T
        now /= now.sum(axis=1, keepdims=True)
        beta[:, i] = np.where((i + 1 < length)[:, None], now, 1.0)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    return gamma, alpha, beta, p, a


def _pad(e: np.ndarray, length: np.ndarray) -> np.ndarray:
    out = np.zeros((len(length), int(length.max()), e.shape[1]), e.dtype)
    at = np.arange(out.shape[1])[None, :] < length[:, None]
    out[at] = e
    return out


def _chains(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the chains of texts with ``n_words`` words, and each chain's text."""
    per = -(-n_words // CHAIN)
    owner = np.repeat(np.arange(len(n_words)), per)
    last = np.cumsum(per) - 1
    length = np.full(len(owner), CHAIN)
    length[last[per > 0]] = (n_words - (per - 1) * CHAIN)[per > 0]
    return length, owner


def label(model: Model, texts: list[str]) -> np.ndarray:
    """Posterior mass of each language in each text, (texts, languages)."""
    k, mass = len(model.langs), np.zeros((len(texts), len(model.langs)))
    group: list[tuple[int, str]] = []

    def flush() -> None:
        if not group:
            return
        # texts are set apart by an edge; their words are counted by place
        grams, words, first = features("\n".join(t for _, t in group))
        if len(first):
            counts = np.array([len(features_first(t)) for _, t in group])
            e = emissions(model.weights, grams, words, first)
            length, owner = _chains(counts)
            gamma = forward_backward(_pad(e, length), length, model.transitions, model.start)[0]
            at = np.arange(gamma.shape[1])[None, :] < length[:, None]
            each = np.where(at[:, :, None], gamma, 0).sum(axis=1)
            for j in range(k):
                mass[:, j] += np.bincount(np.array([i for i, _ in group])[owner], weights=each[:, j], minlength=len(texts))
        group.clear()

    size = 0
    for i, t in enumerate(texts):
        for piece in pieces(t):
            group.append((i, piece))
            size += len(piece)
            if size >= PIECE:
                flush()
                size = 0
    flush()
    return mass


def pieces(text: str):
    """Parts of at most ``PIECE`` characters that end before a blank, so that no word is cut
    (one of more than ``PIECE`` characters without any is)."""
    at = 0
    while len(text) - at > PIECE:
        end = max(text.rfind(b, at + 1, at + PIECE + 1) for b in " \n\t")
        end = end if end > at else at + PIECE
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


def features_first(text: str) -> np.ndarray:
    """Word starts alone."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ok = letters()[c]
    return np.flatnonzero(ok & ~np.concatenate(([False], ok[:-1]))) if len(ok) else np.zeros(0, np.int64)


# --- training ---------------------------------------------------------------

def train(rows: list[tuple[str, str]], epochs: int = 4, batch: int = 64, seed: int = 7) -> Model:
    """Fit on (text, lang) rows; see the module's text."""
    langs = sorted({lang for _, lang in rows})
    model = Model(langs, np.zeros(((1 << HASH_BITS) + 1, max(1, len(langs))), np.float32),
                  np.zeros((len(langs),) * 2, np.float32), np.zeros(len(langs), np.float32))
    docs = [(features(t), langs.index(lang), t) for t, lang in sorted(rows)]
    docs = [d for d in docs if len(d[0][2])]
    if len(langs) < 2 or not docs:
        return model
    _fit(model, docs, 1, batch, seed)
    kept = []
    for (f, y, t), m in zip(docs, label(model, [d[2] for d in docs])):
        if m[y] >= 0.5 * m.sum():
            kept.append((f, y, t))
    _fit(model, kept or docs, epochs, batch, seed + 1)
    return model


def _fit(model: Model, docs: list, epochs: int, batch: int, seed: int) -> None:
    rng, k = np.random.default_rng(seed), len(model.langs)
    runs = []  # (document, first word, end): runs of 8 to 64 words
    for d, ((_, _, first), _, _) in enumerate(docs):
        at = 0
        while at < len(first):
            end = min(len(first), at + int(rng.integers(8, 65)))
            runs.append((d, at, end))
            at = end
    g_w, g_t = np.full(model.weights.shape, 1e-6, np.float32), np.full((k, k), 1e-6, np.float32)
    for _ in range(epochs):
        order, chains, chain, size = rng.permutation(len(runs)), [], [], 0
        for r in order:
            chain.append(runs[r])
            size += runs[r][2] - runs[r][1]
            if size >= CHAIN:
                chains.append(chain)
                chain, size = [], 0
        chains += [chain] if chain else []
        for b in range(0, len(chains), batch):
            feats, words, first, y, length, place = [], [], [], [], [], 0
            for c in chains[b:b + batch]:
                n = 0
                for d, lo, hi in c:
                    (f, whole, starts), lang, _ = docs[d]
                    a, z = starts[lo], starts[hi] if hi < len(starts) else len(f)
                    feats.append(f[a:z])
                    words.append(whole[lo:hi])
                    first.append(starts[lo:hi] - a + place)
                    y.append(np.full(hi - lo, lang))
                    place, n = place + z - a, n + hi - lo
                length.append(n)
            feats, words, first, y = (np.concatenate(x) for x in (feats, words, first, y))
            length = np.array(length)
            e = _pad(emissions(model.weights, feats, words, first), length)
            gamma, alpha, beta, p, a = forward_backward(e, length, model.transitions, model.start)
            real = np.arange(e.shape[1])[None, :] < length[:, None]
            seen = np.zeros_like(gamma)
            seen[real] = np.eye(k, dtype=gamma.dtype)[y]
            # expected and observed transitions
            pair = (alpha[:, :-1, :, None] * a) * (p * beta)[:, 1:, None, :]
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            both = real[:, 1:, None, None]
            grad_t = (np.where(both, pair, 0).sum(axis=(0, 1)) - np.einsum("sti,stj->ij", seen[:, :-1], seen[:, 1:]))
            diff = (gamma - seen)[real]
            of_place = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(feats))))
            flat = np.concatenate([feats.T.ravel(), words])
            touched, inverse = np.unique(flat, return_inverse=True)
            owner = np.concatenate([np.tile(of_place, feats.shape[1]), np.arange(len(words))])
            grad = np.stack([np.bincount(inverse, weights=diff[owner, j], minlength=len(touched)) for j in range(k)], axis=1).astype(np.float32)
            g_w[touched] += grad ** 2
            model.weights[touched] -= 0.1 * grad / np.sqrt(g_w[touched]) + 1e-6 * model.weights[touched]
            model.weights[-1] = 0
            g_t += (grad_t ** 2).astype(np.float32)
            model.transitions -= (0.1 * grad_t / np.sqrt(g_t)).astype(np.float32)


def sample(docs: DataFrame, per_lang: int, max_chars: int, text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """About ``per_lang`` labelled rows of each language, by text hash; at most 4 per_lang x languages."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}  # a row per language, as the model has
    if not counts:
        return []
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, per_lang / n)))])
    draw = F.pmod(F.xxhash64(text), F.lit(1 << 30)) / float(1 << 30)
    rows = (known.where(draw < F.try_element_at(share, F.col(lang))).select(F.substring(text, 1, max_chars).alias("t"), F.col(lang).alias("l"))
            .distinct().limit(4 * per_lang * len(counts)).collect())
    return sorted((r["t"], r["l"]) for r in rows)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held: int = 2,
        per_lang: int = 300, max_chars: int = 20_000) -> Model:
    """Model from labelled rows outside the held-out fold (crc32 of the id modulo ``folds``)."""
    learn = docs.where(F.coalesce(crc_mod(key, folds), F.lit(-1)) != held)
    return train(sample(learn, per_lang, max_chars, text, lang))


def predict(model: Model, text: Column, spark) -> Column:
    """Struct ``lang, score`` for every text."""
    workers(spark)

    @F.pandas_udf("lang string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        mass = label(model, [t or "" for t in texts]) if model.langs else np.zeros((len(texts), 1))
        best, total = mass.argmax(axis=1), mass.sum(axis=1)
        some = total > 0
        return pd.DataFrame({
            "lang": [model.langs[b] if s else "und" for b, s in zip(best, some)],
            "score": np.where(some, mass[np.arange(len(mass)), best] / np.where(some, total, 1), 0.0).clip(0, 1)})
    return run(text)
