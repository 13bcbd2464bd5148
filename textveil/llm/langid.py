"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads a word's bytes (with its bounds) in both directions and labels every byte position; a
document's probabilities are the mean over all its positions. It is trained on the driver by backpropagation
through time, on the words of a bounded sample of labelled documents, which tasks count. Since a word is read by itself, a
worker reads each distinct word once and pools by look-up.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, narrow, remembered, slices, text_rows

#: Bounds of the training sample and the network: documents a language, words of these a language (the most frequent), bytes of
#: a word that teaches, units a direction.
SAMPLE, VOCABULARY, LONGEST, UNITS, STEPS, BATCH = 300, 50_000, 28, 14, 500, 192
WORD = re.compile(rb"[a-z\x80-\xff]+")
#: Words that a worker remembers: some 180 bytes each.
MEMORY = 400_000


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def forward(p: dict, x: np.ndarray, side: str):
    """States of one direction. x: (batch, time) bytes, in reading order."""
    n, steps = x.shape
    units = p["U" + side].shape[0]
    h, kept, states = np.zeros((n, units), np.float32), [], []
    for t in range(steps):
        a, u = p["X" + side][x[:, t]], h @ p["U" + side]
        g = _sigmoid(a[:, : 2 * units] + u[:, : 2 * units])
        z, r = g[:, :units], g[:, units:]
        c = np.tanh(a[:, 2 * units :] + r * u[:, 2 * units :])
        new = c + z * (h - c)
        kept.append((h, z, r, c, u[:, 2 * units :]))
        h = new
        states.append(h)
    return states, kept


def backward(p: dict, x: np.ndarray, side: str, kept: list, dstates: list, grads: dict) -> None:
    dx, du, carry = np.zeros_like(p["X" + side]), np.zeros_like(p["U" + side]), 0
    for t in range(x.shape[1] - 1, -1, -1):
        h, z, r, c, uc = kept[t]
        d = dstates[t] + carry
        da_c = d * (1 - z) * (1 - c * c)
        da_z = d * (h - c) * z * (1 - z)
        da_r = da_c * uc * r * (1 - r)
        pre = np.concatenate([da_z, da_r, da_c], 1)
        rec = np.concatenate([da_z, da_r, da_c * r], 1)
        np.add.at(dx, x[:, t], pre)
        du += h.T @ rec
        carry = d * z + rec @ p["U" + side].T
    grads["X" + side], grads["U" + side] = dx, du


def position_probabilities(p: dict, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """(batch, time, languages) and what backward needs."""
    f, kf = forward(p, x, "f")
    b, kb = forward(p, x[:, ::-1], "b")
    h = np.concatenate([np.stack(f, 1), np.stack(b[::-1], 1)], 2)
    y = h @ p["V"] + p["c"]
    y = np.exp(y - y.max(2, keepdims=True))
    return y / y.sum(2, keepdims=True), (h, kf, kb)


def train(words: dict[str, dict[bytes, int]], steps: int = STEPS, units: int = UNITS, batch: int = BATCH, seed: int = 7) -> dict:
    """words: language -> how often each word (bytes) stands in its sample. Every language counts alike."""
    langs = sorted(words)
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * 0.2).astype(np.float32) for k, s in {"Xf": (256, 3 * units), "Xb": (256, 3 * units), "Uf": (units, 3 * units), "Ub": (units, 3 * units), "V": (2 * units, len(langs))}.items()}
    p["c"] = np.zeros(len(langs), np.float32)
    by_size: dict[int, list] = defaultdict(list)
    for i, lang in enumerate(langs):
        total = sum(words[lang].values())
        for w, n in words[lang].items():
            if len(w) <= LONGEST:
                by_size[len(w) + 2].append((bounded(w), i, n / total))
    sizes = sorted(by_size)
    table = {}
    for s in sizes:
        data = np.frombuffer(b"".join(w for w, _, _ in by_size[s]), np.uint8).reshape(-1, s)
        weight = np.array([n for _, _, n in by_size[s]])
        table[s] = data, np.array([i for _, i, _ in by_size[s]]), np.cumsum(weight)
    mass = np.array([table[s][2][-1] for s in sizes])
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    for step in range(1, steps + 1):
        s = sizes[rng.choice(len(sizes), p=mass / mass.sum())]
        data, label, cum = table[s]
        at = np.minimum(np.searchsorted(cum, rng.random(batch) * cum[-1]), len(cum) - 1)
        x, y = data[at], label[at]
        prob, (h, kf, kb) = position_probabilities(p, x)
        d = prob.copy()
        d[np.arange(batch), :, y] -= 1
        d /= batch
        g = {"V": np.einsum("bth,btk->hk", h, d), "c": d.sum((0, 1))}
        dh = d @ p["V"].T
        backward(p, x, "f", kf, [dh[:, t, :units] for t in range(s)], g)
        backward(p, x[:, ::-1], "b", kb, [dh[:, s - 1 - t, units:] for t in range(s)], g)
        rate = 0.01 * min(1, step / 20) * (1 - 0.9 * step / steps)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return {"langs": langs, "params": p}


def bounded(word: bytes) -> bytes:
    return b" " + word + b" "


def states(p: dict, x: np.ndarray, side: str) -> np.ndarray:
    """(batch, time, units): as forward, without what training needs."""
    n, steps = x.shape
    units = p["U" + side].shape[0]
    out, h = np.empty((n, steps, units), np.float32), np.zeros((n, units), np.float32)
    for t in range(steps):
        a, u = p["X" + side][x[:, t]], h @ p["U" + side]
        g = _sigmoid(a[:, : 2 * units] + u[:, : 2 * units])
        c = np.tanh(a[:, 2 * units :] + g[:, units:] * u[:, 2 * units :])
        h = c + g[:, :units] * (h - c)
        out[:, t] = h
    return out


def summed(p: dict, words: list[bytes]) -> np.ndarray:
    """For each word (of any length): the sums of its positions' probabilities, and how many positions it has."""
    out = np.zeros((len(words), len(p["c"]) + 1))
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        upto = at + 1
        while upto < len(order) and (upto - at + 1) * (len(words[order[upto]]) + 2) <= 60_000:
            upto += 1
        own = order[at:upto]
        data = [np.frombuffer(bounded(words[i]), np.uint8) for i in own]
        size = np.array([len(d) for d in data])
        x, back = (np.zeros((len(own), size[-1]), np.uint8) for _ in range(2))  # padded behind the end in reading order
        for k, d in enumerate(data):
            x[k, : len(d)], back[k, : len(d)] = d, d[::-1]
        turned = np.maximum(size[:, None] - 1 - np.arange(size[-1]), 0)
        h = np.concatenate([states(p, x, "f"), np.take_along_axis(states(p, back, "b"), turned[:, :, None], 1)], 2)
        y = h @ p["V"] + p["c"]
        y = np.exp(y - y.max(2, keepdims=True))
        y /= y.sum(2, keepdims=True)
        y[np.arange(size[-1]) >= size[:, None]] = 0
        out[own, :-1], out[own, -1] = y.sum(1), size
        at = upto
    return out


def split_words(text: str) -> list[bytes]:
    return WORD.findall(text.lower().encode("utf-8", "surrogatepass"))


class Reader:
    """Sums of position probabilities of every distinct word, remembered up to a bound."""

    def __init__(self, model: dict):
        self.model, self.index, self.rows = model, {}, np.zeros((0, len(model["langs"]) + 1))

    def learn(self, words: set[bytes]) -> None:
        if len(self.index) > MEMORY:
            self.index, self.rows = {}, self.rows[:0]
        new = list(filterfalse(self.index.__contains__, words))
        if new:
            self.index.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate([self.rows, summed(self.model["params"], new)])

    def label(self, words: list[bytes]) -> tuple[str, float]:
        total = self.rows[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))].sum(0)
        p = total[:-1] / total[-1]
        best = int(p.argmax())
        return self.model["langs"][best], float(min(1.0, max(0.0, p[best])))


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict | None:
    """The model from ``sample`` documents a language at most, chosen by a hash of the id among those that are
    not held out. None if no row has a language and a text."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    able = keyed.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    # the rows of least hash in each language; a cut at three times their share leaves few rows to rank
    draw, span = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), float(1 << 40)
    sizes = cut(able.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    sizes = narrow(sizes, sizes.count())
    few = able.select("doc_id", "lang", draw.alias("h")).join(sizes, "lang").where(F.col("h") < F.lit(span) * F.least(F.lit(1.0), F.lit(3.0 * sample) / F.col("n")))
    order = W.partitionBy("lang").orderBy("h", "doc_id")
    chosen = few.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample).select("doc_id", "lang").distinct()
    # one text for each chosen id, that of least hash; tasks count its words, and the driver gets the most frequent
    texts = able.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text"))).alias("t"))

    def count(batches):
        for batch in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for at, own in slices(batch.column(1)):
                for lang, t in zip(batch.column(0).slice(at, len(own)).to_pylist(), own):
                    seen[lang].update(split_words(t))
            rows = [(lang, w, n) for lang, own in seen.items() for w, n in own.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.int64()))], names=["lang", "word", "n"])

    counted = texts.select("lang", "t.text").mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = counted.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("k") <= VOCABULARY)
    words: dict[str, dict[bytes, int]] = defaultdict(dict)
    for r in top.select("lang", "word", "n").orderBy("lang", "k").collect():  # within the bound
        words[r["lang"]][bytes(r["word"])] = r["n"]
    return train(words) if words else None


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, held_out, lang_pred, score; a row for each row of docs.

    lang_pred is ``und`` with score 0 for null texts and those without a letter, and for all where there is no model. Of
    languages of equal probability the first in the order of names is taken. Repeated rows and ids are judged row by row; texts are read
    whole; an empty table gives an empty result. Only the text is read."""

    def run(batches):
        reader = remembered(("langid", zlib.crc32(model["params"]["V"].tobytes())), lambda: Reader(model)) if model else None
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                words = [split_words(t) if t and reader and any(map(str.isalpha, t)) else [] for t in texts]
                if reader:
                    reader.learn(set().union(*words))
                said = [reader.label(own) if own else ("und", 0.0) for own in words]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], names=["doc_id", "lang_pred", "score"])

    found = text_rows(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
