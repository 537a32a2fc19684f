"""Plain models of scorers and set selection, written from their definitions."""

from __future__ import annotations

import math
import re
from collections import Counter


def tokens(text):
    low = text.lower()
    found = re.findall(r"[a-z0-9_]+|[一-鿿]", low)
    return found or ([low.strip()] if low.strip() else [])


def bm25(docs, query, k1=1.5, b=0.75):
    lists = [tokens(d) for d in docs]
    n, mean = len(docs), sum(map(len, lists)) / max(len(docs), 1)
    df = Counter(t for x in lists for t in set(x))
    out = []
    for x in lists:
        tf = Counter(x)
        s = 0.0
        for t in tokens(query):
            if tf[t]:
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                s += idf * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(x) / max(mean, 1e-9)))
        out.append(s)
    return out


def tfidf(docs, query):
    lists = [tokens(d) for d in docs]
    n, df = len(docs), Counter(t for x in map(tokens, docs) for t in set(x))

    def vector(x):
        return {t: c / len(x) * (math.log((n + 1) / (df[t] + 1)) + 1) for t, c in Counter(x).items()}

    q = vector(tokens(query))
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = []
    for x in lists:
        v = vector(x)
        both = sum(w * v.get(t, 0.0) for t, w in q.items())
        out.append(both / (norm(q) * norm(v)) if norm(q) and norm(v) else 0.0)
    return out


def order(scores, k):
    """Indices of the k best, ties in input order."""
    return sorted(range(len(scores)), key=lambda i: -round(scores[i], 9))[:k]


def greedy(candidates, target, most, output):
    """candidates: (slots, share, score) in order; the chosen indices."""
    left = sorted(range(len(candidates)), key=lambda i: -round(candidates[i][2], 9))
    picked, covered = [], set()
    while left and len(picked) < most and covered != target:
        best = max(left, key=lambda i: (len(candidates[i][0] - covered), candidates[i][1], round(candidates[i][2], 9)))
        if picked and not candidates[best][0] - covered:
            break
        picked.append(best)
        covered |= candidates[best][0]
        left.remove(best)
    if not picked and left:
        picked.append(left.pop(0))
    rest = [i for i in sorted(range(len(candidates)), key=lambda i: -round(candidates[i][2], 9)) if i not in picked]
    return (picked + rest)[:output]


def chunks(text, financial, number):
    """Page text by lines: a financial line alone, others gathered to 260 characters."""
    out, held = [], []
    for line in (" ".join(x.split()) for x in text.splitlines()):
        if not line:
            continue
        if any(k in line for k in financial) and re.search(number, line):
            out += [" ".join(held)] if held else []
            held = []
            out.append(line)
            continue
        held.append(line)
        if len(" ".join(held)) >= 260:
            out.append(" ".join(held))
            held = []
    return out + ([" ".join(held)] if held else [])
