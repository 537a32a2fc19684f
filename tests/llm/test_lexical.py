import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from pagelode.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, term string, score int"
ITEMS = "item_id long, text string, doc_id long"


def _terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    counts = [Counter(_terms(t)) for _, t in docs]
    size = sum(1 for c in counts if c)
    total = sum(c.total() for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item_id, text in items:
        found = []
        for (doc_id, _), c in zip(docs, counts, strict=True):
            m = 50 + 50 * c.total() * size // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(_terms(text)) if c[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k], 1)]
    return out


def _rows(n, seed):
    random.seed(seed)
    words = [f"w{int(random.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(i, " ".join(random.choices(words, k=random.randrange(1, 60)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, ",.;"), (3, docs[3][1]), (None, docs[5][1]), (None, "w1 w2"), (n + 3, "É é w1 W1 été"), (n + 4, "w1 " * 20_000)]
    items = [(i, " ".join(random.choices(words, k=12))) for i in range(15)] + [(90, None), (91, ""), (92, "never-seen"), (93, "w1"), (93, "w1 É")]
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    docs, items = _rows(400, 1)
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], DOCS).repartition(3)
    q = spark.createDataFrame([(*r, 1) for r in items], ITEMS)
    for k, block in ((50, 1000), (7, 4)):
        index = lexical.write_index(d)
        got = [tuple(r) for r in lexical.search(index, q, k, block).collect()]
        assert sorted(got, key=str) == sorted(brute(docs, items, k), key=str)


def test_empty_tables(spark):
    d, q = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a", 1)], ITEMS)
    assert lexical.search_documents(d, q).count() == 0
    full = spark.createDataFrame([(1, "a", "x", 1)], DOCS)
    assert lexical.search_documents(full, q.limit(0)).count() == 0
    assert [tuple(r) for r in lexical.search_documents(full, q).collect()] == brute([(1, "a")], [(1, "a")])


def _shard(docs):
    held = lexical._Shard()
    held.add([i for i, _ in docs], pa.array([(t or "").encode() for _, t in docs], pa.binary()))
    return lexical._row(held.batch(), 0)


def test_shards_share_thresholds_and_skip():
    """Copies of the best documents come first; far shards of other words are hardly read."""
    random.seed(3)
    good = [(i, "rare words here " * (1 + i % 3)) for i in range(100)]
    other = [(1000 + i, ("words " if i % 3 == 0 else "") + "common filler " * random.randrange(20, 60)) for i in range(3000)]
    rows = [_shard(good), _shard(other)]
    docs = [*good, *other]
    counts = [Counter(_terms(t)) for _, t in docs]
    df = Counter(t for c in counts for t in c)
    asked = ["rare", "words", "here"]
    search = lexical.Search([[(i, lexical.weight(len(docs), df[t])) for i, t in enumerate(asked)]])
    for row in rows:
        search.visit(lexical.shard_lists(row, {t: i for i, t in enumerate(asked)}, len(docs), sum(c.total() for c in counts)))
    assert search.read < 0.3 * search.postings
    want = brute(docs, [(0, "rare words here")])
    assert list(zip(*(x.tolist() for x in search.best[0]), strict=True)) == [(d, s) for _, _, d, s in want]


def test_blocks_cost_least():
    """Against all ways to cut short lists."""
    random.seed(5)
    lists = [np.array([random.randrange(10) for _ in range(n)], np.int64) for n in (1, 2, 5, 9, 10, 3)]
    lengths = np.array([len(x) for x in lists])
    starts = np.cumsum(lengths) - lengths
    found = lexical.block_ends(np.concatenate(lists), starts, lengths, cost=7, longest=4)

    def cost(values, ends):
        begin = [0, *ends[:-1]]
        return sum(7 + (e - b) * max(values[b:e]) for b, e in zip(begin, ends, strict=True))

    for values, ends in zip(lists, found, strict=True):
        n = len(values)
        every = ([i + 1 for i in range(n - 1) if cut >> i & 1] + [n] for cut in range(2 ** (n - 1)))
        short = [e for e in every if max(np.diff([0, *e])) <= 4]
        assert cost(values, list(ends)) == min(cost(values, e) for e in short)
        assert max(np.diff([0, *ends])) <= 4


def test_term_bytes():
    text = "Ab-c_d ÉX\x7f\x80é1\t\n  "
    row, words = lexical.terms_of(pa.array([text.encode(), b"", text.encode()], pa.binary())[1:])
    assert words.to_pylist() == _terms(text) and set(row.tolist()) == {1}
