r"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of `passage` words, all of the text. Each
passage becomes features of its characters and words and goes through an
encoder h = tanh(E x); gated attention w . (tanh(V h) * sigmoid(U h)) gives it
a weight by softmax within its document; the weighted representation is scored
by a logistic unit. All weights, the attention's too, are learnt from document
labels alone, by Adam on the log loss, in NumPy on the driver.

The training set is a bounded sample: the `max_documents` labelled rows with
the smallest hashes of doc_id among those not held out (of equal hashes the
smallest ids), each with all its passages. Scoring reads every passage of every
document; a document's score depends on its text alone.

Defined edge cases: a null or empty text is one passage without words; rows
without a label, or with a null one, do not train; several labels of a doc_id
count as their maximum; repeated rows are scored row by row (and train as one, with
the least of their texts); without any
training row the score is 0.5; a score equal to the threshold predicts 1; a row
without a doc_id counts as an empty id, so it is held out and never
trains; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterql.llm.common import ASCII_SPACE, crc_mod, utf8

PASSAGE, BUCKETS, HIDDEN, ATTENTION = 64, 32, 16, 8
MAX_DOCUMENTS, STEPS, RATE, DECAY = 3000, 200, 0.02, 1e-4
HELD_OUT_MODULUS, HELD_OUT_REMAINDER, THRESHOLD = 5, 0, 0.3
CHARS_AT_ONCE = 1 << 22

_CLASSES = 9
_CLASS = np.full(256, 7, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!", b".?", b",;:")):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 8
_SPACE = np.zeros(256, bool)
_SPACE[list(ASCII_SPACE)] = True
_MIX = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
N_FEATURES = _CLASSES + 7 + BUCKETS


def featurise(texts: Iterable[str | None], passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, number of passages of each text)."""
    raw = [utf8(t) + b" " for t in texts]
    lengths = np.array([len(b) for b in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    doc = np.repeat(np.arange(len(raw)), lengths)
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]  # texts end in a space, so words never cross into the next
    starts = np.flatnonzero(first)
    n_words = np.bincount(doc[starts], minlength=len(raw))
    bags = np.maximum(1, -(-n_words // passage))
    base = np.cumsum(bags) - bags
    total = int(bags.sum())
    out = np.zeros((total, N_FEATURES), np.float32)
    if len(starts):
        nth = np.arange(len(starts)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
        of_word = base[doc[starts]] + nth // passage
        word = np.cumsum(first) - 1
        inside = np.flatnonzero(~space)
        counts = np.bincount(of_word[word[inside]] * _CLASSES + _CLASS[data[inside]], minlength=total * _CLASSES).reshape(total, _CLASSES)
        chars, words = counts.sum(1), np.bincount(of_word, minlength=total)
        lines = np.flatnonzero(data == 10)
        lines = lines[word[lines] >= 0]
        lines = lines[doc[starts[word[lines]]] == doc[lines]]
        with np.errstate(over="ignore"):
            place = inside - starts[word[inside]]
            hashes = np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * _MIX[place & 63] * (place.astype(np.uint64) + np.uint64(1)), np.searchsorted(inside, starts))
        hashes ^= hashes >> np.uint64(31)
        again = np.zeros(len(starts), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
        order = np.lexsort((hashes, of_word))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
        n, m = np.maximum(words, 1), np.maximum(chars, 1)
        out[:, :_CLASSES] = counts / m[:, None]
        out[:, _CLASSES] = np.log1p(chars / n)
        out[:, _CLASSES + 1] = np.log1p(words)
        out[:, _CLASSES + 2] = np.bincount(of_word[word[lines]], minlength=total) / n
        out[:, _CLASSES + 3] = np.bincount(of_word[again], minlength=total) / n
        out[:, _CLASSES + 4] = np.bincount(of_word[order][fresh], minlength=total) / n
        out[:, _CLASSES + 5] = np.bincount(of_word[(data[starts] >= 65) & (data[starts] <= 90)], minlength=total) / n
        out[:, _CLASSES + 7 :] = np.bincount(of_word * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=total * BUCKETS).reshape(total, BUCKETS) / n[:, None]
    out[:, _CLASSES + 6] = np.repeat(np.log1p(n_words), bags)
    return out, bags


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Encoder E, attention V, U, w and output c, after standardising the features."""

    def __init__(self) -> None:
        rng = np.random.default_rng(3)
        draw = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.p = {"E": draw(N_FEATURES, HIDDEN), "e": np.zeros(HIDDEN), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION, 1)[:, 0], "c": np.zeros(HIDDEN), "b": np.zeros(1)}
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)

    def _forward(self, x: np.ndarray, bags: np.ndarray) -> tuple:
        p, starts = self.p, np.cumsum(bags) - bags
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        logits = (v * u) @ p["w"]
        weight = np.exp(logits - np.repeat(np.maximum.reduceat(logits, starts), bags))
        a = weight / np.repeat(np.add.reduceat(weight, starts), bags)
        z = np.add.reduceat(a[:, None] * h, starts)
        return h, v, u, a, z, _sigmoid(z @ p["c"] + p["b"])

    def fit(self, x: np.ndarray, bags: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Model:
        if not len(bags):
            return self
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        p, moments = self.p, {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        starts = np.cumsum(bags) - bags
        for step in range(1, steps + 1):
            h, v, u, a, z, y = self._forward(x, bags)
            d = (y - labels) / len(labels)
            dz = d[:, None] * p["c"]
            each = np.repeat(dz, bags, axis=0)
            da = (each * h).sum(1)
            dl = a * (da - np.repeat(np.add.reduceat(a * da, starts), bags))
            dv, du = dl[:, None] * p["w"] * u * (1 - v * v), dl[:, None] * p["w"] * v * u * (1 - u)
            dh = (each * a[:, None] + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
            grads = {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ dl, "c": z.T @ d, "b": d.sum(keepdims=True)}
            for k, g in grads.items():
                g = g + DECAY * p[k]
                first, second = moments[k]
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                p[k] -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        """Probability of label 1 of each text."""
        texts = list(texts)
        out, at = np.zeros(len(texts)), 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= CHARS_AT_ONCE):
                size += len(texts[end] or "")
                end += 1
            x, bags = featurise(texts[at:end])
            out[at:end] = self._forward((x - self.mean) / self.scale, bags)[-1]
            at = end
        return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", max_documents: int = MAX_DOCUMENTS,
          modulus: int = HELD_OUT_MODULUS, remainder: int = HELD_OUT_REMAINDER) -> Model:
    """A model of the bounded sample of labelled rows that aren't held out."""
    usable = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (crc_mod(key, modulus) != remainder))
    chosen = usable.groupBy(F.col(key).alias("key")).agg(F.max(label).alias("label")).orderBy(F.xxhash64("key"), "key").limit(max_documents)
    sample = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "key")
    sample = sample.groupBy("key", "label").agg(F.min("text").alias("text"))  # a doc_id of many rows trains as one

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                x, bags = featurise(part["text"])
                ends = np.cumsum(bags)
                yield pd.DataFrame({"key": part["key"].astype(str), "label": part["label"].astype(float), "x": [x[e - n : e].astype("<f4").tobytes() for n, e in zip(bags, ends)]})

    rows = sorted({(r.key, r.label, bytes(r.x)) for r in sample.mapInPandas(run, "key string, label double, x binary").collect()})
    bags = [np.frombuffer(x, "<f4").reshape(-1, N_FEATURES) for _, _, x in rows]
    return Model().fit(np.concatenate(bags).astype(float), np.array([len(b) for b in bags]), np.array([y for _, y, _ in rows])) if rows else Model()


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", modulus: int = HELD_OUT_MODULUS, remainder: int = HELD_OUT_REMAINDER,
           threshold: float = THRESHOLD) -> DataFrame:
    """(key, held_out, score, predicted) per row."""
    handle = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(handle.value.score(texts))

    out = docs.select(F.col(key).alias(key), (crc_mod(key, modulus) == remainder).alias("held_out"), score(F.col(text).cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
