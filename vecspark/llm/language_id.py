"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's lower-cased UTF-8 bytes in segments, forwards and backwards, labels every
position from both states, and pools the positions' probabilities to those of the document. It is
trained here, in numpy, by backpropagation through time, on a bounded sample of labelled rows; the
weights are a few tens of kilobytes whatever the input's size, and texts are scored where they lie.

Defined cases: a NULL text or one without letters is ``und`` with score 0; without any labelled
rows every text is ``und``; repeated rows give repeated results; rows with a NULL id are predicted
but never learned from; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.llm.common import crc_mod, held_out
from vecspark.llm.sampling import labelled_sample

UNDETERMINED = "und"


@dataclass(frozen=True)
class Params:
    hidden: int = 12
    #: Bytes that the states run over before they start anew.
    segment: int = 64
    #: Labelled rows per language that the network may learn from, and segments of each.
    rows_per_language: int = 1500
    segments_per_row: int = 4
    batch: int = 256
    steps: int = 400
    rate: float = 0.015
    seed: int = 11
    #: Segments that are run at once when texts are scored.
    width: int = 4096


def has_letter(text: str | None) -> bool:
    """Whether some character is in one of Unicode's letter categories; number signs such as ² or Ⅷ
    are not."""
    return bool(text) and (text.isalpha() or any(map(str.isalpha, text)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    x *= 2
    x = _sigmoid(x)
    x *= 2
    x -= 1
    return x


def segments(data: bytes, size: int) -> np.ndarray:
    """The bytes in rows of ``size``, the last one filled up with zeros."""
    return np.frombuffer(data.ljust(-(-len(data) // size) * size, b"\0"), np.uint8).reshape(-1, size)


class Network:
    """Weights by name: per direction ``in`` (256 x 3h: a byte's share of the update, reset and
    candidate gates), ``rec`` (3h x h), ``out`` (languages x h); one ``bias``."""

    def __init__(self, hidden: int, n_labels: int, seed: int):
        rng, h = np.random.default_rng(seed), hidden
        self.h, self.w = h, {"bias": np.zeros((n_labels, 1), np.float32)}
        for d in "fb":
            self.w[f"in_{d}"] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.w[f"rec_{d}"] = rng.normal(0, 1 / np.sqrt(h), (3 * h, h)).astype(np.float32)
            self.w[f"out_{d}"] = rng.normal(0, 1 / np.sqrt(h), (n_labels, h)).astype(np.float32)

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States (T, h, B) for bytes x (T, B) in direction d; with ``keep``, what the way back needs."""
        h, (steps, width) = self.h, x.shape
        table, rec = np.ascontiguousarray(self.w[f"in_{d}"].T), self.w[f"rec_{d}"]
        states, kept, state = np.empty((steps, h, width), np.float32), [None] * steps, np.zeros((h, width), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = table.take(x[t], axis=1)
            g = rec @ state
            gates = _sigmoid(a[: 2 * h] + g[: 2 * h])
            z, r = gates[:h], gates[h:]
            n = r * g[2 * h :]
            n += a[2 * h :]
            n = _tanh(n)
            new = states[t]
            np.subtract(state, n, out=new)
            new *= z
            new += n
            if keep:
                kept[t] = (state, z, r, n, g[2 * h :])
            state = new
        return states, kept

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Label probabilities (T, labels, B) of every position of x (T, B)."""
        f, b = self._run(x, "f", False)[0], self._run(x, "b", False)[0]
        logits = self.w["out_f"] @ f + self.w["out_b"] @ b + self.w["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the positions that hold text, and its gradient."""
        runs = {d: self._run(x, d, True) for d in "fb"}
        logits = self.w["out_f"] @ runs["f"][0] + self.w["out_b"] @ runs["b"][0] + self.w["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        mask = (x > 0).astype(np.float32)[:, None, :]
        total = max(1.0, float(mask.sum()))
        target = np.eye(p.shape[1], dtype=np.float32)[labels].T[None]
        loss = -float((np.log(np.maximum((p * target).sum(axis=1, keepdims=True), 1e-9)) * mask).sum()) / total
        err = (p - target) * mask / total
        out = {"bias": err.sum(axis=(0, 2))[:, None]}
        h = self.h
        for d in "fb":
            states, kept = runs[d]
            rec = self.w[f"rec_{d}"]
            out[f"out_{d}"] = np.einsum("tlb,thb->lh", err, states)
            from_out = self.w[f"out_{d}"].T @ err
            d_rec, d_in = np.zeros_like(rec), np.empty((x.shape[0], 3 * h, x.shape[1]), np.float32)
            back = np.zeros((h, x.shape[1]), np.float32)
            for t in range(x.shape[0] - 1, -1, -1) if d == "f" else range(x.shape[0]):
                state, z, r, n, q = kept[t]
                g = from_out[t] + back
                da_n = g * (1 - z) * (1 - n * n)
                da_z = g * (state - n) * z * (1 - z)
                da_r = da_n * q * r * (1 - r)
                gates = np.concatenate([da_z, da_r, da_n * r])
                d_rec += gates @ state.T
                back = g * z + rec.T @ gates
                d_in[t, : 2 * h], d_in[t, 2 * h :] = gates[: 2 * h], da_n
            flat, order = d_in.transpose(0, 2, 1).reshape(-1, 3 * h), np.argsort(x.ravel(), kind="stable")
            seen, first = np.unique(x.ravel()[order], return_index=True)
            d_table = np.zeros((256, 3 * h), np.float32)
            d_table[seen] = np.add.reduceat(flat[order], first, axis=0)
            out[f"rec_{d}"], out[f"in_{d}"] = d_rec, d_table
        return loss, out


def some_segments(text: str, params: Params) -> np.ndarray:
    """Up to ``segments_per_row`` segments of the text, at random by a hash of it; none for a text
    without letters."""
    if not has_letter(text):
        return np.empty((0, params.segment), np.uint8)
    data = text.lower().encode("utf-8", "surrogatepass")
    rows = segments(data, params.segment)
    return rows[np.random.default_rng((params.seed, zlib.crc32(data))).permutation(len(rows))[: params.segments_per_row]]


def train(samples: list[np.ndarray], labels: list[str], params: Params) -> tuple[Network, list[str]]:
    """The network and its labels, from Adam over random batches of the rows' segments, balanced by
    label."""
    p = params
    names = sorted(set(labels))
    rng = np.random.default_rng(p.seed)
    by_label: list[list[np.ndarray]] = [[] for _ in names]
    for some, label in zip(samples, labels, strict=True):
        if len(some):
            by_label[names.index(label)].append(some)
    names, by_label = [n for n, x in zip(names, by_label, strict=True) if x], [np.concatenate(x) for x in by_label if x]
    net = Network(p.hidden, max(1, len(names)), p.seed)
    if len(names) < 2:
        return net, names
    m, v = ({k: np.zeros_like(w) for k, w in net.w.items()} for _ in range(2))
    for step in range(1, p.steps + 1):
        label = rng.integers(0, len(names), p.batch)
        x = np.stack([by_label[k][rng.integers(0, len(by_label[k]))] for k in label])
        _, grads = net.gradients(np.ascontiguousarray(x.T), label)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = p.rate * (0.02 + 0.98 * (1 + np.cos(np.pi * step / p.steps)) / 2)
        for k, g in grads.items():
            g = g * min(1.0, 5.0 / max(norm, 1e-9))
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            net.w[k] -= (rate * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net, names


def pooled(net: Network, texts: list[str | None], params: Params) -> np.ndarray:
    """Mean label probabilities over all positions of each text; NaN for texts without letters."""
    rows, owner = [], []
    for i, text in enumerate(texts):
        if has_letter(text):
            rows.append(segments(text.lower().encode("utf-8", "surrogatepass"), params.segment))
            owner.append(np.full(len(rows[-1]), i))
    n_labels = len(net.w["bias"])
    total, count = np.zeros((len(texts), n_labels)), np.zeros(len(texts))
    if rows:
        x, owner = np.concatenate(rows), np.concatenate(owner)
        for s in range(0, len(x), params.width):
            part = np.ascontiguousarray(x[s : s + params.width].T)
            mask = part > 0
            p = net.probabilities(part)
            p *= mask[:, None, :]
            sums, at = p.sum(axis=0), owner[s : s + params.width]
            for k in range(n_labels):
                total[:, k] += np.bincount(at, sums[k], len(texts))
            count += np.bincount(at, mask.sum(axis=0), len(texts))
    with np.errstate(invalid="ignore", divide="ignore"):
        return total / count[:, None]


def fit(docs: DataFrame, id_col: str, text_col: str, label_col: str, params: Params) -> tuple[Network, list[str]]:
    """Learns from rows with an id outside the held-out part (crc32 mod 3 = 1), a text and a label."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    rows = rows.where(F.col("text").isNotNull() & F.col("label").isNotNull() & (crc_mod("id", 3) != 1))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = [some_segments(t, params).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(some, pa.binary())], names=["id", "label", "some"])

    schema = f"id {kinds['id']}, label {kinds['label']}, some binary"
    found = labelled_sample(rows, "label", "id", params.rows_per_language, lambda df: df.select("id", "label", "text").mapInArrow(cut, schema))
    return train([np.frombuffer(r.some, np.uint8).reshape(-1, params.segment) for r in found], [r.label for r in found], params)


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", params: Params | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score. With ``keep``: those columns of the
    input as they are, then __lang_pred and __score."""
    p = params or Params()
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, label_col, p))  # its size depends on the parameters only
    carried = [F.col(id_col).alias("c0"), held_out(id_col, 3, 1).alias("c1")] if keep is None else [F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]
    source = docs.select(*carried, F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, names = model.value
        for batch in batches:
            probs = np.nan_to_num(pooled(net, batch.column("text").to_pylist(), p), nan=-1.0)
            known = probs[:, 0] >= 0 if names else np.zeros(batch.num_rows, bool)
            best = probs.argmax(axis=1)
            pred = [names[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
            score = np.where(known, np.clip(probs[np.arange(len(best)), best], 0, 1), 0.0)
            columns = [c for c, f in zip(batch.columns, batch.schema.names, strict=True) if f != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=out_names)

    kept = [f for f in source.schema.fields if f.name != "text"]
    out_names = [*(f.name for f in kept), "pred", "score"]
    out = source.mapInArrow(run, T.StructType([*kept, T.StructField("pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    names = [id_col, "held_out", "lang_pred", "score"] if keep is None else [*keep, "__lang_pred", "__score"]
    return out.toDF(*names)
