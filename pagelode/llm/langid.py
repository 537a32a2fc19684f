"""Language identification by a bidirectional gated recurrent network over bytes.

The network is written and trained in numpy by backpropagation through time: each
byte looks up its input terms, one GRU reads forwards and one backwards, and a softmax
over both states labels every position. A document's probabilities are the mean over
all its positions. Texts are read whole, in windows of ``WINDOW`` bytes that go through
the network many at a time, so the cost is linear and the memory bounded.

Training takes at most ``per_language`` documents of every language (smallest hash of
the id first) and at most ``pieces`` windows of each, in one pass over the texts.

Defined cases: a null text or one without a letter is ``und`` with score 0; so is
everything when no language was learned; a null id belongs to the training part; ties
go to the first language in code-point order; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packing import _groups
from .ppm import _lowered, is_held_out
from .storage import materialize

WINDOW = 128
_BATCH = 2048
_LETTER = re.compile(r"[^\W\d_]")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.clip(x, -30, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class BiGru:
    """Parameters per direction: table (256, 3H), recurrent (H, 3H); output (2H, L) and bias."""

    def __init__(self, languages: list[str], hidden: int = 12, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        f32 = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p[f"table_{d}"] = f32(256, 3 * hidden, s=0.3)
            self.p[f"rec_{d}"] = f32(hidden, 3 * hidden, s=hidden**-0.5)
        self.p["out"] = f32(2 * hidden, len(languages), s=hidden**-0.5)
        self.p["bias"] = np.zeros(len(languages), np.float32)

    def _steps(self, x: np.ndarray, d: str, keep: bool, mask: np.ndarray | None = None):
        """States (T, B, H) of one direction and, for training, the gates; states stay 0 on padding."""
        full = len(x) if mask is None else int(mask.sum(0).min())
        h_n, table, rec = self.hidden, self.p[f"table_{d}"], self.p[f"rec_{d}"]
        t_n, b = x.shape
        states = np.empty((t_n, b, h_n), np.float32)
        gates = []
        h = np.zeros((b, h_n), np.float32)
        for t in range(t_n) if d == "f" else range(t_n - 1, -1, -1):
            inputs, inner = table[x[t]], h @ rec
            zr = _sigmoid(inputs[:, : 2 * h_n] + inner[:, : 2 * h_n])
            z, r = zr[:, :h_n], zr[:, h_n:]
            n = np.tanh(inputs[:, 2 * h_n :] + r * inner[:, 2 * h_n :])
            new = n + z * (h - n)
            if t >= full:
                new *= mask[t][:, None]
            if keep:
                gates.append((t, h, z, r, n, inner[:, 2 * h_n :]))
            states[t] = h = new
        return states, gates

    @staticmethod
    def _softmax(logits: np.ndarray) -> np.ndarray:
        logits = np.exp(logits - logits.max(-1, keepdims=True))
        return logits / logits.sum(-1, keepdims=True)

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (T, B, L) for bytes (T, B)."""
        f, b = self._steps(x, "f", False)[0], self._steps(x, "b", False)[0]
        h = self.hidden
        return self._softmax(f @ self.p["out"][:h] + b @ self.p["out"][h:] + self.p["bias"])

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions and its gradients by backpropagation through time."""
        h_n = self.hidden
        f, gates_f = self._steps(x, "f", True, mask)
        b, gates_b = self._steps(x, "b", True, mask)
        both = np.concatenate([f, b], -1)
        probabilities = self._softmax(both @ self.p["out"] + self.p["bias"])
        weight = (mask / max(1.0, mask.sum())).astype(np.float32)
        picked = np.take_along_axis(probabilities, np.broadcast_to(y[None, :, None], (*x.shape, 1)), -1)[..., 0]
        loss = float(-(weight * np.log(picked + 1e-12)).sum())
        delta = probabilities.copy()
        np.put_along_axis(delta, np.broadcast_to(y[None, :, None], (*x.shape, 1)), picked[..., None] - 1, -1)
        delta *= weight[..., None]
        g = {"out": np.tensordot(both, delta, ((0, 1), (0, 1))), "bias": delta.sum((0, 1))}
        back = delta @ self.p["out"].T
        for d, gates, part in (("f", gates_f, back[..., :h_n]), ("b", gates_b, back[..., h_n:])):
            rec = self.p[f"rec_{d}"]
            g_table, g_rec = np.zeros_like(self.p[f"table_{d}"]), np.zeros_like(rec)
            dh = np.zeros(part.shape[1:], np.float32)
            for t, h, z, r, n, inner_n in reversed(gates):
                dh = (dh + part[t]) * mask[t][:, None]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * inner_n * r * (1 - r)
                d_in = np.concatenate([dz, dr, dn], 1)
                d_rec = np.concatenate([dz, dr, dn * r], 1)
                np.add.at(g_table, x[t], d_in)
                g_rec += h.T @ d_rec
                dh = dh * z + d_rec @ rec.T
            g[f"table_{d}"], g[f"rec_{d}"] = g_table, g_rec
        return loss, g

    def fit(self, windows: list[bytes], labels: list[int], steps: int = 350, batch: int = 192, rate: float = 0.02, seed: int = 1) -> None:
        """Adam over random batches."""
        rng = np.random.default_rng(seed)
        y_all = np.array(labels)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(windows), min(batch, len(windows)))
            x, mask = _columns([windows[i] for i in pick], max(len(windows[i]) for i in pick))
            _, g = self.gradients(x, y_all[pick], mask)
            norm = float(np.sqrt(sum((a * a).sum() for a in g.values())))
            now = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for k, a in g.items():
                a = a * min(1.0, 1.0 / (norm + 1e-9))
                m[k] += 0.1 * (a - m[k])
                v[k] += 0.01 * (a * a - v[k])
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities (documents, L) over all positions of each text; empty texts get zeros."""
        owners: list[int] = []
        parts: list[bytes] = []
        for i, t in enumerate(texts):
            for k in range(0, len(t), WINDOW):
                owners.append(i)
                parts.append(t[k : k + WINDOW])
        sums = np.zeros((len(texts), len(self.languages)))
        order = sorted(range(len(parts)), key=lambda k: len(parts[k]))  # little padding
        h = self.hidden
        for k in range(0, len(order), _BATCH):
            pick = order[k : k + _BATCH]
            x, mask = _columns([parts[i] for i in pick], len(parts[pick[-1]]))
            forward = self._steps(x, "f", False, mask)[0]
            backward = self._steps(x, "b", False, mask)[0]
            logits = forward @ self.p["out"][:h]
            logits += backward @ self.p["out"][h:]
            logits += self.p["bias"]
            np.clip(logits, -60, 60, out=logits)
            np.exp(logits, out=logits)
            logits *= (mask / logits.sum(-1))[..., None]
            np.add.at(sums, [owners[i] for i in pick], logits.sum(0))
        return sums / np.maximum(1, [len(t) for t in texts])[:, None]

    def spans(self, text: bytes) -> list[tuple[int, int, str]]:
        """Runs of one language (start, end, language) by the label of every byte."""
        labels = [
            int(k)
            for at in range(0, len(text), WINDOW)
            for k in self.positions(_columns([text[at : at + WINDOW]], len(text[at : at + WINDOW]))[0])[:, 0].argmax(-1)
        ]
        out: list[tuple[int, int, str]] = []
        for i, k in enumerate(labels):
            if i and labels[i - 1] == k:
                out[-1] = (out[-1][0], i + 1, out[-1][2])
            else:
                out.append((i, i + 1, self.languages[k]))
        return out


def _columns(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (T, B), padded with 0, and the mask of real ones."""
    lengths = np.array([len(p) for p in parts])
    x = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width).T
    return np.ascontiguousarray(x), (np.arange(width)[:, None] < lengths).astype(np.float32)


def training_pieces(docs: DataFrame, per_language: int, pieces: int) -> DataFrame:
    """lang, parts: up to ``pieces`` spread windows of the ``per_language`` documents with the smallest hash in each language.

    A document is its id and text; repeated rows are one document. Languages are counted
    first, so that only documents whose hash lies in the smallest share of their language,
    about twice what is wanted, are cut and shuffled. A language of which that leaves fewer
    than are wanted, as repeated rows can, is read again without the share.
    """
    known = docs.where("lang is not null").where(~is_held_out(F.col("doc_id"), 0))
    counts = materialize(known.groupBy("lang").agg(F.count(F.lit(1)).alias("documents")).withColumnRenamed("lang", "of"), "languages")
    order = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit("language")), 1)
    low = order <= F.least(F.lit(1.0), F.lit(2.0 * per_language) / F.col("documents")) * F.lit(float(2**63))
    texts = known.where("text is not null")
    picked = materialize(_smallest(texts.join(counts, F.col("lang") == F.col("of")).where(low), order, per_language, pieces), "pieces")
    have = picked.groupBy(F.col("lang").alias("got")).agg(F.count(F.lit(1)).alias("have"))
    wanted = F.least(F.lit(per_language), F.col("documents"))
    # a share of 1 has left nothing out
    short = counts.where(F.col("documents") > 2 * per_language).join(have, F.col("of") == F.col("got"), "left").where(F.coalesce("have", F.lit(0)) < wanted)
    short = materialize(short.select("of"), "short")
    if not short.limit(1).count():
        return picked
    whole = _smallest(texts.join(short, F.col("lang") == F.col("of"), "left_semi"), order, per_language, pieces)
    return picked.join(short, F.col("lang") == F.col("of"), "left_anti").unionByName(whole)


def _smallest(rows: DataFrame, order: Column, per_language: int, pieces: int) -> DataFrame:
    """The documents with the smallest hashes, first in 64 groups of a language and then among these, cut by Spark so that no long text reaches the driver."""
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(pieces - 1)),
        lambda i: F.substring(F.col("text"), (F.floor(F.length("text") * i / pieces) + 1).cast("int"), F.lit(WINDOW // 2)),
    )
    cut = rows.select("lang", order.alias("h"), F.array_distinct(spread).alias("parts"))
    # equal documents combine before the shuffle
    cut = cut.groupBy("lang", "h").agg(F.min("parts").alias("parts"))
    for keys in (("lang", F.pmod(F.col("h"), F.lit(64))), ("lang",)):
        w = Window.partitionBy(*keys).orderBy("h")
        cut = cut.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_language).drop("place")
    return cut.select("lang", "parts")


def train(docs: DataFrame, per_language: int = 600, pieces: int = 6, hidden: int = 12, steps: int = 350) -> BiGru | None:
    """Learn from documents whose crc32(doc_id as text) mod 5 is not 0 and whose language is known."""
    windows: list[bytes] = []
    names: list[str] = []
    for row in training_pieces(docs, per_language, pieces).toLocalIterator():
        for part in row["parts"]:
            if _LETTER.search(part):
                windows.append(_lowered(part))
                names.append(row["lang"])
    if not windows:
        return None
    languages = sorted(set(names))
    model = BiGru(languages, hidden)
    place = {lang: k for k, lang in enumerate(languages)}
    pairs = sorted((w, place[lang]) for w, lang in zip(windows, names, strict=True))  # the order rows arrive in does not matter
    model.fit([w for w, _ in pairs], [k for _, k in pairs], steps)
    return model


def predict(docs: DataFrame, model: BiGru | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for ids, texts in _groups(batches, 4_000_000):  # windows of many texts fill the batches of the network
            lang, score = ["und"] * len(ids), np.zeros(len(ids))
            real = [i for i, t in enumerate(texts) if net and _LETTER.search(t)]
            if real:
                pooled = net.pooled([_lowered(texts[i]) for i in real])
                for i, row in zip(real, pooled, strict=True):
                    k = int(row.argmax())
                    lang[i], score[i] = net.languages[k], min(1.0, float(row[k]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"])

    found = docs.select("doc_id", "text").mapInArrow(label, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", is_held_out(F.col("doc_id"), 0).alias("held_out"), "lang_pred", "score")
