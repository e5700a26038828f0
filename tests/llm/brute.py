"""Plain Python versions of the operators, for comparison."""

import hashlib
import math
import re

import numpy as np
import xxhash


def upper_ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def simhash(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", upper_ascii_lower(text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k:k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(ids, fps, bits=2):
    """Smallest id reachable for each of the lists' rows (ids without nulls)."""
    v, parent = np.array(fps, dtype=np.uint64), list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(v[i] ^ v[i + 1:]) <= bits) + i + 1:
            a, b = find(i), find(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = min(d, least.get(r, d))
    return [least[find(i)] for i in range(len(ids))]


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "phone":
        return 9 <= len(d) <= 15
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return 13 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def pii_spans(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if _valid(k, m.group())] for k, p in PII.items()}


def pii_text(text):
    return ",".join(f"{k}:{a}:{z}" for k, s in pii_spans(text).items() for a, z in s)


def edf(parts):
    """EDF order of one period by simulation."""
    d, done, order = sum(parts), [0] * len(parts), []
    for t in range(d):
        ready = [(-(-(done[i] + 1) * d // p), i) for i, p in enumerate(parts) if done[i] < p and done[i] * d // p <= t]
        i = min(ready)[1]
        done[i] += 1
        order.append(i)
    return order


def repeated_bytes(docs, length=400):
    """[(n_removed, n_spans, kept)] by counting every string of ``length`` bytes."""
    seen = {}
    for b in docs:
        for p in range(len(b) - length + 1):
            seen[b[p:p + length]] = seen.get(b[p:p + length], 0) + 1
    out = []
    for b in docs:
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                mark[p:p + length] = b"\1" * length
        spans = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        out.append((sum(mark), spans, bytes(c for c, m in zip(b, mark) if not m)))
    return out


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def edit_distance_to_part(pattern, text):
    """Least edit distance of the pattern to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def log_share(n_te, n_t, n_e, n):
    own = math.log2(n / n_e)
    return math.log2(n_te * n / (n_t * n_e)) / own if own > 0 else 0.0
