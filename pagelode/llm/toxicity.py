"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on the fragments
of toxic text that ordinary text lacks. A window is compressed with the ordinary
dictionary and with both; how much shorter it gets is its margin. The fragments are
the byte n-grams that far more toxic than ordinary documents hold and that stand
between many different neighbours, so passages that copies repeat do not count.
Windows are whole words, cover the whole text, and are weighed per document by
thresholds on the margin whose weights a logistic regression calibrates on labelled
documents that the dictionaries have not seen, a missed toxic document counting
``miss_cost`` times.

Training uses at most ``most_toxic`` and ``most_ordinary`` labelled rows, those with
the smallest hash of their id, and at most ``most_chars`` characters of them.

Defined cases: null or empty text has no window and gets the score of a document
without any margin; unlabelled or null labels teach nothing; without rows of both
labels every score is the share of label 1 (0 without labels); repeated rows are
scored alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import _groups, release_memory
from .ppm import _lowered, is_held_out

WINDOW = 64
_GRAMS = (5, 6)
_FEATURES = 8


def windows(raw: bytes, width: int = WINDOW) -> Iterator[bytes]:
    """Consecutive pieces of about ``width`` bytes, cut at spaces where there are any."""
    at, n = 0, len(raw)
    while at < n:
        end = at + width
        if end < n:
            space = raw.rfind(b" ", at + width // 2, end)
            if space > 0:
                end = space
        yield raw[at:end] + b" "
        at = end


def _compressor(content: bytes):
    parameters = zstandard.ZstdCompressionParameters(
        window_log=15, chain_log=15, hash_log=15, search_log=6, min_match=6, target_length=64,
        strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters).compress


def _summary(margins: list[int]) -> list[float]:
    m = sorted(margins, reverse=True) or [0]
    n = len(m)
    high, very = sum(x >= 3 for x in m), sum(x >= 5 for x in m)
    top = (m + [0, 0])[:3]
    return [*map(float, top), min(10, high), min(10, very), high / n, very / n, math.log(n)]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def scorer(self):
        if not self.toxic:
            return lambda texts: [self.prior] * len(texts)
        plain, both = _compressor(self.ordinary), _compressor(self.toxic + self.ordinary)

        def score(texts: list[bytes]) -> list[float]:
            rows = [_summary([len(plain(w)) - len(both(w)) for w in windows(t)]) for t in texts]
            z = (np.array(rows, float).reshape(-1, _FEATURES) - self.center) / self.scale
            return (1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -40, 40)))).tolist()

        return score


def _grams(word: bytes) -> Iterator[tuple[int, bytes]]:
    p = b" " + word + b" "
    for n in _GRAMS:
        for k in range(len(p) - n + 1):
            yield k, p[k : k + n]


def _fragments(toxic: list[bytes], ordinary: list[bytes]) -> Counter:
    """Stretches of words that are typical of toxic documents, with the number of their neighbourhoods."""
    in_toxic: Counter = Counter()
    in_ordinary: Counter = Counter()
    for texts, counts in ((toxic, in_toxic), (ordinary, in_ordinary)):
        for t in texts:
            counts.update({g for w in set(t.split()) for _, g in _grams(w)})
    least, ratio = max(4, 0.005 * len(toxic)), 12 * len(toxic) / max(1, len(ordinary))
    strong = {g for g, c in in_toxic.items() if c >= least and c >= ratio * (in_ordinary[g] + 0.5)}
    del in_toxic, in_ordinary
    around: dict[bytes, set] = {}
    for t in toxic:
        words = t.split()
        for k, w in enumerate(words):
            marked = bytearray(len(w) + 2)
            for at, g in _grams(w) if len(w) > 2 else ():
                if g in strong:
                    marked[at : at + len(g)] = b"1" * len(g)
            if any(marked):
                p, at = b" " + w + b" ", 0
                while at < len(p):
                    end = at
                    while end < len(p) and marked[end]:
                        end += 1
                    if end > at:
                        around.setdefault(p[at:end], set()).add((words[k - 1] if k else b"", words[k + 1] if k + 1 < len(words) else b""))
                    at = end + 1
    wide = Counter({f: len(x) for f, x in around.items()})
    # a gram counts with all fragments that hold it
    support: Counter = Counter()
    for f, n in wide.items():
        support.update({g: n for _, g in _grams(f[1:-1]) if g in strong} | {f[k : k + 5]: n for k in range(len(f) - 4)})
    return Counter({f: n for f, n in wide.items() if max((support[f[k : k + 5]] for k in range(len(f) - 4)), default=0) >= 2 * least and n >= max(3, least / 2)})


def _trained(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little text: the text itself is the dictionary
        return b"".join(samples)[-size:]


def fit(toxic: list[bytes], ordinary: list[bytes], prior: float, miss_cost: float = 3.0, seed: int = 0) -> Model:
    """Train on lower-cased texts; ``prior`` is the share of label 1 in all labelled rows."""
    none = np.zeros(0)
    if not toxic or not ordinary:
        return Model(b"", b"", none, none, none, prior)
    rng = random.Random(seed)
    cut_t, cut_o = max(1, len(toxic) * 7 // 10), max(1, len(ordinary) * 7 // 10)
    found = _fragments(toxic[:cut_t], ordinary[:cut_o])
    if not found:
        return Model(b"", b"", none, none, none, prior)
    chunks = [t[k : k + 256] for t in ordinary[:1500] for k in range(0, len(t), 256)]
    plain = _trained(chunks[:40_000], 16_384)
    repeated = [f for f, n in found.items() for _ in range(min(n, 40))]
    rng.shuffle(repeated)
    joined = [b"".join(repeated[k : k + 12]) for k in range(0, len(repeated), 12)]
    special = _trained(joined, 4096)
    model = Model(plain[512:] or plain, special, none, none, none, prior)
    one, two = _compressor(model.ordinary), _compressor(special + model.ordinary)
    tests = [(t, 1.0) for t in toxic[cut_t:] or toxic] + [(t, 0.0) for t in ordinary[cut_o:] or ordinary]
    x = np.array([_summary([len(one(w)) - len(two(w)) for w in windows(t)]) for t, _ in tests])
    y = np.array([v for _, v in tests])
    share = y.mean()
    weight = np.where(y > 0, miss_cost * prior / share, (1 - prior) / (1 - share))
    model.center, model.scale = x.mean(0), x.std(0) + 1e-6
    z = np.c_[(x - model.center) / model.scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(len(w)), z.T @ (weight * (p - y)) + 0.5 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w
    return model


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = 2000, most_ordinary: int = 4000, most_chars: int = 20_000_000) -> Model:
    """Fit on labelled rows whose crc32(doc_id as text) mod 5 is not 0."""
    known = labels.where("toxic is not null and doc_id is not null").where(~is_held_out(F.col("doc_id"), 0)).select("doc_id", "toxic")
    counts = {bool(r["toxic"]): r["n"] for r in known.groupBy((F.col("toxic") == 1).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = counts.get(True, 0) / max(1, sum(counts.values()))
    texts: dict[bool, list[bytes]] = {True: [], False: []}
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    for kind, most in ((True, most_toxic), (False, most_ordinary)):
        some = known.where((F.col("toxic") == 1) == F.lit(kind)).orderBy(order, "doc_id").limit(most).select(F.col("doc_id").alias("__id"))
        chosen = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("__id")).select("doc_id", "text")
        left = most_chars // 2
        for row in chosen.orderBy(order, "doc_id", "text").toLocalIterator():
            if len(row["text"]) > left:  # shorter texts may still fit
                continue
            left -= len(row["text"])
            texts[kind].append(_lowered(row["text"]))
    model = fit(texts[True], texts[False], prior)
    release_memory()  # of the driver
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return docs.select("doc_id", "text").mapInArrow(_scorer(docs, model), "doc_id long, score double").select(
        "doc_id",
        is_held_out(F.col("doc_id"), 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def _scorer(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for ids, texts in _groups(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(scorer([_lowered(t) for t in texts]), pa.float64())], ["doc_id", "score"]
            )

    return score


def ordinary_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below one half, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            passed = [scorer([_lowered(t.as_py() or "")])[0] < 0.5 for t in texts]
            yield batch.filter(pa.array(passed, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
