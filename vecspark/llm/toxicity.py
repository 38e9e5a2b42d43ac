"""Toxicity by averaged subword-bag embeddings and a linear softmax.

A word is the mean of the vectors of its hashed character n-grams and of the word itself, a window
of words the mean of its words, and a linear softmax scores the window. Embeddings and softmax are
trained together in numpy. Misspellings share most of their n-grams with the word they mimic.

What the dealt method doesn't have is the pooling: bags are windows of two words, not documents, as
an average over a long text would drown one insult. A document is toxic if some window is: its logit
is a soft maximum of the windows' logits while training, so the gradient flows to the windows that
carry it, and the maximum when scoring. A maximum over more windows can only grow, so long clean
texts score higher than short ones; the bias is moved to where the training rows are parted best. A
test bounds the false positives among long and among short clean held-out texts.

After training a word acts only through one number, its vector times the softmax's difference of
classes; workers compute it once per different word and average numbers instead of vectors.

Defined cases: NULL and empty texts get the score of an empty window, the bias; without labelled
rows, or with one label only, scores are the share of label 1 (0 without any); labels other than 0
and 1 are ignored; repeated rows give repeated results; rows with a NULL id are scored but never
learned from; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import crc_mod, held_out
from vecspark.llm.sampling import labelled_sample


@dataclass(frozen=True)
class Params:
    dim: int = 8
    bucket_bits: int = 18
    ngrams: tuple[int, ...] = (3, 4, 5)
    #: Words of a window; windows overlap by half.
    window: int = 2
    #: Labelled rows of each label that the model may learn from.
    rows_per_label: int = 3000
    epochs: int = 4
    batch: int = 48
    rate: float = 0.15
    #: Sharpness of the soft maximum over windows while training.
    sharpness: float = 1.0
    decay: float = 1e-9
    #: What Adagrad starts from: the square of a gradient that is worth a full step.
    floor: float = 1e-8
    seed: int = 5


#: Word characters in bytes: letters, digits, beyond ASCII, and signs that stand in for letters.
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c in b"@$*" else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def subwords(batch: list[bytes], params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of the words, one word after another, and how many each has."""
    shift, size = np.uint64(64 - params.bucket_bits), np.array([len(w) + 2 for w in batch])
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in batch), np.uint8).astype(np.uint64) + np.uint64(1)
    start = np.cumsum(size) - size
    word, left = np.repeat(np.arange(len(batch)), size), np.repeat(start + size, size) - np.arange(len(data))
    mul = np.uint64(0x9E3779B97F4A7C15)
    scrambled = lambda h: ((h ^ (h >> np.uint64(29))) * mul) >> shift
    owner, found, h = [], [], np.zeros(len(data), np.uint64)
    longest = max(params.ngrams)
    for n in range(longest):
        if n:
            h[:-n] = h[:-n] * np.uint64(1_000_003) + data[n:] if n < len(data) else h[:-n]
        else:
            h = data.copy()
        if n + 1 in params.ngrams:
            ok = left > n
            owner.append(word[ok])
            found.append(scrambled(h[ok] * np.uint64(31) + np.uint64(n)))
    weights = data * (np.uint64(0xC2B2AE3D27D4EB4F) * (np.arange(len(data), dtype=np.uint64) - np.repeat(start, size).astype(np.uint64)) + mul)
    owner.append(np.arange(len(batch)))
    found.append(scrambled(np.add.reduceat(weights ^ (weights >> np.uint64(31)), start)))
    owner, found = np.concatenate(owner), np.concatenate(found).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return found[order], np.bincount(owner, minlength=len(batch))


def windows(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the half-overlapping windows over n words; one empty window for none."""
    start = np.arange(0, max(1, n - size // 2), max(1, size // 2))
    return start, np.minimum(start + size, n)


@dataclass
class Model:
    params: Params
    #: A number per bucket: its vector times the difference of the classes' softmax weights.
    values: np.ndarray
    bias: float

    def word_values(self, batch: list[bytes]) -> np.ndarray:
        found, n = subwords(batch, self.params)
        return np.add.reduceat(self.values[found], np.cumsum(n) - n) / n


class Scorer:
    """Scores texts; keeps a bounded table of words' numbers."""

    def __init__(self, model: Model, most: int = 600_000):
        self.model, self.most, self.table = model, most, {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out, table = np.empty(len(texts)), self.table
        for k, text in enumerate(texts):
            found = words(text)
            if len(table) > self.most:
                table.clear()
            if new := list({w for w in found if w not in table}):
                table.update(zip(new, self.model.word_values(new).tolist(), strict=True))
            sums = np.zeros(len(found) + 1)
            np.cumsum(np.fromiter(map(table.__getitem__, found), float, len(found)), out=sums[1:])
            a, b = windows(len(found), self.model.params.window)
            out[k] = ((sums[b] - sums[a]) / np.maximum(1, b - a)).max()
        return 1 / (1 + np.exp(-np.clip(out + self.model.bias, -50, 50)))


def train(texts: list[str | None], labels: list[int], params: Params) -> Model:
    """Adagrad over batches of documents, both labels alike."""
    p, y = params, np.array(labels, float)
    size = 1 << p.bucket_bits
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.0
        return Model(p, np.zeros(size), float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20)))
    rng = np.random.default_rng(p.seed)
    vocabulary: dict[bytes, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words(t)], np.int32) for t in texts]
    known = list(vocabulary)
    parts = [subwords(known[s : s + 20_000], p) for s in range(0, len(known), 20_000)]  # bounded tables in between
    found = np.concatenate([x.astype(np.int32) for x, _ in parts]) if parts else np.empty(0, np.int32)
    n = np.concatenate([x.astype(np.int32) for _, x in parts]) if parts else np.empty(0, np.int32)
    first = np.cumsum(n) - n
    del parts, known
    table = rng.normal(0, 0.02, (size, p.dim))
    out = rng.normal(0, 1.0, (p.dim, 2))
    bias, seen = np.zeros(2), np.full(size, p.floor)
    seen_out, seen_bias = 1e-3, 1e-3
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    steps = p.epochs * -(-len(docs) // p.batch)
    at = 0
    for _ in range(p.epochs):
        order = rng.permutation(len(docs))
        for s in range(0, len(docs), p.batch):
            rate = p.rate * (1 - at / steps)
            at += 1
            chosen = order[s : s + p.batch]
            ids, inverse = np.unique(np.concatenate([docs[k] for k in chosen]), return_inverse=True)
            grams = np.concatenate([found[first[w] : first[w] + n[w]] for w in ids]) if len(ids) else np.empty(0, np.int32)
            begin = np.cumsum(n[ids]) - n[ids]
            vectors = np.add.reduceat(table[grams], begin, axis=0) / n[ids][:, None] if len(ids) else np.zeros((0, p.dim))
            sums = np.zeros((len(inverse) + 1, p.dim))
            np.cumsum(vectors[inverse], axis=0, out=sums[1:])
            a, b, owner, offset = [], [], [], 0
            for i, k in enumerate(chosen):
                x, z = windows(len(docs[k]), p.window)
                a.append(x + offset)
                b.append(z + offset)
                owner.append(np.full(len(x), i))
                offset += len(docs[k])
            a, b, owner = np.concatenate(a), np.concatenate(b), np.concatenate(owner)
            width = np.maximum(1, b - a)[:, None]
            bags = (sums[b] - sums[a]) / width
            logits = bags @ out + bias
            d = (logits[:, 1] - logits[:, 0]) * p.sharpness
            start = np.searchsorted(owner, np.arange(len(chosen)))
            e = np.exp(d - np.maximum.reduceat(d, start)[owner])
            part = e / np.add.reduceat(e, start)[owner]  # each window's share in its document
            pooled = np.add.reduceat(part * d / p.sharpness, start)
            err = (1 / (1 + np.exp(-np.clip(pooled, -50, 50))) - y[chosen]) * weight[chosen] / len(chosen)
            g = (part * err[owner])[:, None] * np.array([-1.0, 1.0])
            d_out, d_bags = bags.T @ g, (g @ out.T) / width
            delta = np.zeros_like(sums)
            np.add.at(delta, a, d_bags)
            np.subtract.at(delta, b, d_bags)
            per_word = np.cumsum(delta[:-1], axis=0)
            d_vec = np.stack([np.bincount(inverse, per_word[:, j], len(ids)) for j in range(p.dim)], axis=1) if len(ids) else vectors
            d_gram = np.repeat(d_vec / n[ids][:, None], n[ids], axis=0)
            rows, back = np.unique(grams, return_inverse=True)
            step = np.stack([np.bincount(back, d_gram[:, j], len(rows)) for j in range(p.dim)], axis=1) + p.decay * table[rows]
            seen[rows] += (step * step).mean(axis=1)
            table[rows] -= rate * step / np.sqrt(seen[rows])[:, None]
            seen_out += (d_out * d_out).mean()
            out -= rate * d_out / np.sqrt(seen_out)
            seen_bias += float((g.sum(axis=0) ** 2).mean())
            bias -= rate * g.sum(axis=0) / np.sqrt(seen_bias)
    model = Model(p, table @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))
    return calibrated(model, texts, y)


def calibrated(model: Model, texts: list[str | None], y: np.ndarray) -> Model:
    """Moves the bias to where the training rows are parted best, midway to the nearest scores."""
    score = Scorer(model)(texts)
    logit = np.log(score + 1e-12) - np.log(1 - score + 1e-12)
    order = np.argsort(logit)
    right = np.concatenate([[0], np.cumsum(1 - y[order])]) + (y.sum() - np.concatenate([[0], np.cumsum(y[order])]))
    cut = int(np.median(np.nonzero(right == right.max())[0]))
    low = logit[order[cut - 1]] if cut else logit.min() - 1
    high = logit[order[cut]] if cut < len(y) else logit.max() + 1
    return Model(model.params, model.values, model.bias - float(low + high) / 2)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, params: Params) -> Model:
    """Learns from labelled rows outside the held-out part (crc32 mod 5 = 0)."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1)")
    marks = marks.where(crc_mod("id", 5) != 0).groupBy("id").agg(F.max("label").alias("label"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = labelled_sample(marks, "label", "id", params.rows_per_label)
    if not chosen:
        return train([], [], params)
    # The sample is bounded; only its rows are taken from the documents, by a filter on the id, and
    # one text of each, where ids repeat.
    label = {r.id: r.label for r in chosen}
    found = rows.where(F.col("id").isin(list(label))).groupBy("id").agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda r: r.id)
    return train([r.text for r in found], [label[r.id] for r in found], params)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", params: Params | None = None) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, params or Params()))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(id_col, 5, 0).alias("held_out"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model.value)
        for pdf in batches:
            s = scorer(list(pdf["text"]))
            yield pd.DataFrame({"id": pdf["id"], "held_out": pdf["held_out"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    out = source.mapInPandas(run, f"id {kind}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_col)
