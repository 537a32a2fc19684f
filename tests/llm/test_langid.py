import zlib
import random

import numpy as np
import pytest

from pagelode.llm import langid

SCHEMA = "doc_id long, text string, lang string, score int"
WORDS = {"aa": ["ka", "kato", "mika", "tok"], "bb": ["zeß", "zür", "würz", "grüz"], "cc": ["lle", "ella", "oll", "leo"]}


def corpus(n, seed=0):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[lang := rng.choice(list(WORDS))], k=rng.randint(3, 60))).capitalize(), lang, 1) for i in range(n)]


def test_gradients():
    net = langid.BiGru(["a", "b", "c"], hidden=3, seed=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 101, (5, 4)).astype(np.uint8), np.array([0, 2, 1, 1])
    mask = np.ones((5, 4), np.float32)
    mask[3:, 1] = 0
    _, g = net.gradients(x, y, mask)
    for k, p in net.p.items():
        for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(4)] + ([(98, 1), (99, 7)] if "table" in k else []):
            old, step = p[at], 1e-2
            p[at] = old + step
            up = net.gradients(x, y, mask)[0]
            p[at] = old - step
            down = net.gradients(x, y, mask)[0]
            p[at] = old
            assert g[k][at] == pytest.approx((up - down) / (2 * step), abs=2e-4)


def test_pooling_equals_positions():
    net = langid.BiGru(["a", "b"], hidden=4, seed=1)
    text = b"some bytes " * 40
    parts = [text[k : k + langid.WINDOW] for k in range(0, len(text), langid.WINDOW)]
    mean = np.concatenate([net.positions(langid._columns([p], len(p))[0])[:, 0] for p in parts]).mean(0)
    assert net.pooled([text, b"", b"x"])[0] == pytest.approx(mean, abs=1e-5)
    assert net.pooled([b""])[0].tolist() == [0, 0]
    spans = net.spans(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_held_out_accuracy(spark):
    rows = corpus(400)
    rows += [(900, None, "aa", 1), (901, "", "aa", 1), (902, "12 !?", None, 1), (903, "kato mika tok ka", None, 1), (None, "würz grüz zür", "bb", None)]
    rows += [(904, "kato mika " * 20000, "aa", 1), (3, rows[3][1], rows[3][2], 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = langid.predict(docs, langid.train(docs, steps=120)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    held = [x for x in got if x["held_out"] and x["doc_id"] < 400]
    assert sum(x["lang_pred"] == truth[x["doc_id"]] for x in held) / len(held) > 0.97
    by = {x["doc_id"]: x for x in got}
    assert [by[i]["lang_pred"] for i in (900, 901, 902, 903, None, 904)] == ["und", "und", "und", "aa", "bb", "aa"]
    assert all(0 <= x["score"] <= 1 for x in got)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert langid.predict(docs, langid.train(docs)).count() == 0
    one = spark.createDataFrame([(1, "abc", None, 1)], SCHEMA)
    assert langid.predict(one, langid.train(one)).first()["lang_pred"] == "und"


def plain_label(net, text):
    """One byte and one direction at a time, in double precision."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    h_n, probabilities = net.hidden, []
    for at in range(0, len(text), langid.WINDOW):
        part, states = text[at : at + langid.WINDOW], {}
        for d, order in (("f", range(len(part))), ("b", range(len(part) - 1, -1, -1))):
            h, states[d] = np.zeros(h_n), {}
            for t in order:
                x, inner = net.p[f"table_{d}"][part[t]].astype(float), h @ net.p[f"rec_{d}"].astype(float)
                z, r = sig(x[:h_n] + inner[:h_n]), sig(x[h_n : 2 * h_n] + inner[h_n : 2 * h_n])
                n = np.tanh(x[2 * h_n :] + r * inner[2 * h_n :])
                h = n + z * (h - n)
                states[d][t] = h
        for t in range(len(part)):
            e = np.exp(np.r_[states["f"][t], states["b"][t]] @ net.p["out"].astype(float) + net.p["bias"])
            probabilities.append(e / e.sum())
    mean = np.mean(probabilities, axis=0)
    return net.languages[int(mean.argmax())], float(mean.max())


def test_predictions_against_a_plain_network(spark):
    rows = corpus(60, seed=5)
    docs = spark.createDataFrame(rows, SCHEMA)
    net = langid.train(docs, steps=60)
    got = {x["doc_id"]: x for x in langid.predict(docs, net).collect()}
    for i, text, *_ in rows:
        lang, score = plain_label(net, text.lower().encode())
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score, abs=1e-4)


def test_every_language_is_learned(spark):
    rows = [(i, f"text number {i} of a language", f"l{i % 300:03d}", 1) for i in range(3000)] + [(9000 + i, "hot words", "hot", 1) for i in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = langid.training_pieces(docs, 7, 2).groupBy("lang").count().collect()
    assert len(got) == 301 and all(x["count"] <= 7 for x in got) and {x["lang"]: x["count"] for x in got}["hot"] == 7
    assert len(langid.train(docs, per_language=5, pieces=1, steps=1).languages) == 301


def test_languages_of_repeated_or_missing_ids_are_learned(spark):
    """Thousands of rows of one id, of no id, and of one document: none of their languages is lost."""
    rows = [(1, f"one id number {i}", "en", 1) for i in range(3000)] + [(None, f"no id number {i}", "fr", 1) for i in range(3000)]
    rows += [(10_000 + i, f"own id {i}", "de", 1) for i in range(300)] + [(2, "always the same row", "es", 1)] * 3000
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["lang"]: r["count"] for r in langid.training_pieces(docs, 200, 2).groupBy("lang").count().collect()}
    held = {i for i in range(300) if zlib.crc32(str(10_000 + i).encode()) % 5 == 0}
    assert zlib.crc32(b"1") % 5 and zlib.crc32(b"2") % 5
    assert got == {"en": 200, "fr": 200, "de": min(200, 300 - len(held)), "es": 1}


def test_a_thousand_languages(spark):
    rows = [(i, f"text {i} of a language", f"l{i % 1000:04d}", 1) for i in range(4000)]
    got = langid.training_pieces(spark.createDataFrame(rows, SCHEMA), 600, 1).groupBy("lang").count()
    learned = {lang for i, _, lang, _ in rows if zlib.crc32(str(i).encode()) % 5}
    assert {r["lang"] for r in got.collect()} == learned
