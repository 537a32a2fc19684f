import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pagelode.llm import ppm

SCHEMA = "doc_id long, text string, row string, score int"


class Plain:
    """PPM by method C with exclusion, one symbol at a time."""

    def __init__(self, texts, order):
        self.order, self.seen = order, defaultdict(Counter)
        for t in texts:
            s = bytes([255]) * order + t + b"\xff"
            for i in range(order, len(s)):
                for k in range(order + 1):
                    self.seen[s[i - k : i]][s[i]] += 1

    def p(self, context, symbol):
        out, excluded = 1.0, set()
        for k in range(self.order, -1, -1):
            counts = self.seen.get(context[len(context) - k :])
            if not counts:
                continue
            left = {s: n for s, n in counts.items() if s not in excluded}
            if left:
                whole = sum(left.values()) + len(left)
                if symbol in left:
                    return out * left[symbol] / whole
                out *= len(left) / whole
            excluded |= counts.keys()
        return out / max(1, 256 - len(excluded))

    def score(self, t):
        s = bytes([255]) * self.order + t + b"\xff"
        return sum(math.log10(self.p(s[i - self.order : i], s[i])) for i in range(self.order, len(s)))


def model(texts, order):
    u, c = np.unique(ppm.framed(texts, order)[0], return_counts=True)
    return ppm.Trie(u, c.astype(float), order)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_equals_plain_model(order):
    rng = random.Random(order)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(0, 30))).encode()
    texts = [word() for _ in range(60)]
    plain, trie = Plain(texts, order), model(texts, order)
    new = [word() for _ in range(40)] + [b"", b"zzz", b"abz\x00", texts[0]]
    assert trie.score(new, most=50) == pytest.approx([plain.score(t) for t in new], rel=1e-9)


def test_probabilities_sum_to_one():
    trie = model([b"abracadabra", b"banana", b""], 3)
    for context in (b"\xff\xff\xff", b"abr", b"xyz", b"xan"):
        keys = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert (10 ** trie.log10(keys)).sum() == pytest.approx(1)


def test_documents(spark):
    rng = random.Random(3)
    vocabulary = ["the", "of", "Éa", "und", *(f"w{i}" for i in range(80))]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40))), "x", 1) for i in range(200)]
    rows += [(900, None, "x", 1), (901, "", "x", 1), (None, "THE of", "x", 1), (5, rows[5][1], "x", 1), (902, "long word " * 20000, "x", 1)]
    got = ppm.score_documents(spark.createDataFrame(rows, SCHEMA), order=3, frequent=20).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    low = lambda t: (t or "").encode().translate(ppm.LOWER_BYTES)
    train = [low(t) for i, t, *_ in rows if not held(i)]
    counts = Counter(w for t in train for w in [*t.split(), None])
    n, v = sum(counts.values()), len(counts)
    plain = Plain(train, 3)
    want = sorted(
        (-1 if i is None else i, held(i), len(low(t).split()) + 1, sum(counts[w] > 0 for w in [*low(t).split(), None]), n)
        + (round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*low(t).split(), None]), 5),)
        for i, t, *_ in rows
    )
    have = sorted((-1 if x["doc_id"] is None else x["doc_id"], x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 5)) for x in got)
    assert [w[:5] for w in want] == [h[:5] for h in have]
    assert [w[5] for w in want] == pytest.approx([h[5] for h in have], abs=1e-3)
    scores = {x["doc_id"]: x["score"] for x in got}
    for i, t, *_ in rows[:40] + rows[200:204]:
        assert scores[i] == pytest.approx(plain.score(low(t)), rel=1e-9)


def test_empty(spark):
    assert ppm.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    only = ppm.score_documents(spark.createDataFrame([(held, "ab", "x", 1)], SCHEMA)).first()
    assert only["score"] == pytest.approx(-3 * math.log10(256)) and only["n_known"] == 0


def test_pruned_model_is_proper():
    u, c = np.unique(ppm.framed([b"abracadabra", b"banana"], 3)[0], return_counts=True)
    trie = ppm.Trie(u[c > 1], c[c > 1].astype(float), 3)
    keys = np.array([int.from_bytes(b"bra" + bytes([s]), "big") for s in range(256)], np.uint64)
    assert (10 ** trie.log10(keys)).sum() == pytest.approx(1)


def test_no_gram_is_lost_beyond_the_broadcast_ones(spark):
    rng = random.Random(11)
    rows = [(i, "".join(rng.choices("abcdeé ", k=rng.randint(0, 60))), "x", 1) for i in range(80)]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    plain = Plain([t.encode() for i, t, *_ in rows if not held(i)], 3)
    for most in (0, 40):
        got = {x["doc_id"]: x["score"] for x in ppm.score_documents(spark.createDataFrame(rows, SCHEMA), order=3, max_nodes=most).collect()}
        for i, t, *_ in rows:
            assert got[i] == pytest.approx(plain.score(t.encode()), rel=1e-9)


def test_long_texts_go_through_in_parts():
    """Parts of a text give the same grams and the same score as the whole."""
    import numpy as np

    from pagelode.llm import ppm

    rng = np.random.default_rng(4)
    text = rng.integers(97, 102, 5000).astype(np.uint8).tobytes()
    whole, _ = ppm.framed([text], 5)
    assert (np.concatenate(list(ppm.framed_parts(text, 5, 700))) == whole).all()
    grams = np.unique(whole)[::2]
    table, logs = ppm.HashTable(grams), -rng.random(len(grams))
    one, many = (ppm.look_up(table, logs, [b"ab", text, b"cd"], 5, most) for most in (1_000_000, 500))
    assert np.allclose(one[0], many[0])
    total = lambda x: sorted((int(o), int(g), int(sum(x[3][(x[1] == o) & (x[2] == g)]))) for o, g in set(zip(x[1].tolist(), x[2].tolist(), strict=True)))
    assert total(one) == total(many)


def test_counting_holds_little_and_counts_all():
    """Twelve million characters without repeats: the grams of four million at once took 490 MB."""
    import tracemalloc

    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 123, 60_000, dtype=np.uint8)).decode() for _ in range(200)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 20)), pa.array(texts[k : k + 20])], ["doc_id", "text"]) for k in range(0, 200, 20)]
    tracemalloc.start()
    try:
        total = sum(sum(b.column(2).filter(b.column(1).is_valid()).to_pylist()) for b in ppm.counted(iter(batches), ppm.ORDER))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert total == 200 * 60_001
    assert peak < 250_000_000
