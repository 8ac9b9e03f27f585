"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words, the whole text over. Each passage is encoded by counts of byte kinds, word shapes and hashed words,
all from array operations, and a learned layer. Gated attention (a tanh branch times a sigmoid branch) weighs the passages of a document, and
their weighted mean is scored by a logistic unit. Only the label of a document is needed to learn which of its passages matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscape.llm.common import SLICE_BYTES, bounded_batches, slices, utf8, word_hashes, words

PASSAGE_WORDS = 128
HASHED_BITS = 7
HASHED = 1 << HASHED_BITS
HIDDEN, GATE = 32, 16
#: The bound of the sample that the model is fitted on, in documents; all their passages count.
TRAIN_ROWS = 6_000
#: Bytes of one text whose passages are encoded at a time.
PART_BYTES = 1 << 20

KINDS = 12
_KIND = np.full(256, 10, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 3
_KIND[[32, 9, 11, 12, 13]], _KIND[10], _KIND[33], _KIND[124], _KIND[[46, 63]], _KIND[44] = 4, 5, 6, 7, 8, 9
_KIND[[35, 36, 37, 38, 42, 64, 94, 126]] = 11
FEATURES = KINDS + 8 + HASHED


def passages(raw: np.ndarray, at: np.ndarray, size: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, first passage of each text and the number of all); a text without words has one passage, all zero."""
    starts, ends, first = words(raw, at)
    counts = np.diff(first)
    each = np.maximum(1, -(-counts // size))
    bag = np.concatenate([[0], np.cumsum(each)])
    n, out = int(bag[-1]), np.zeros((int(bag[-1]), FEATURES))
    if not len(starts):
        return out, bag
    text = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(starts)) - first[:-1][text]
    of = bag[:-1][text] + inside // size
    per = np.bincount(of, minlength=n).astype(float)
    some = np.maximum(per, 1)
    length = (ends - starts).astype(float)
    # bytes from the first word of a passage up to the next passage's, or the text's end
    begin = np.flatnonzero(np.diff(of, prepend=-1))
    stop = np.append(starts[begin[1:]], at[-1])
    stop = np.minimum(stop, at[1:][text[begin]])
    spans = stop - starts[begin]
    where = np.repeat(starts[begin] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
    kinds = np.bincount(np.repeat(of[begin], spans) * KINDS + _KIND[raw[where]], minlength=n * KINDS).reshape(n, KINDS)
    out[:, :KINDS] = kinds / np.maximum(1, kinds.sum(axis=1, keepdims=True))
    h = word_hashes(raw, starts, ends)
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    last = _KIND[raw[ends - 1]]
    buckets = np.bincount(of * HASHED + (h >> np.uint64(64 - HASHED_BITS)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED)
    mean = np.bincount(of, length, n) / some
    shape = [mean / 10, np.sqrt(np.maximum(0, np.bincount(of, length**2, n) / some - mean**2)) / 10, np.bincount(of, again, n) / some]
    shape += [np.bincount(of, last == k, n) / some for k in (6, 8, 11)]
    shape += [(buckets > 0).sum(axis=1) / np.minimum(some, HASHED), np.log1p(per) / 5]
    out[:, KINDS : KINDS + 8] = np.stack(shape, axis=1)
    out[:, KINDS + 8 :] = np.sqrt(buckets / some[:, None])
    return out, bag


def long_passages(text: np.ndarray, size: int = PASSAGE_WORDS, most: int = PART_BYTES) -> np.ndarray:
    """The features of one text's passages, part by part: a part ends where a passage does."""
    out, low = [], 0
    while True:
        high = min(len(text), low + most)
        if high < len(text):
            starts, _, _ = words(text[low:high], np.array([0, high - low]))
            whole = (len(starts) - 1) // size * size  # the last word may go on
            if whole <= 0:
                most *= 2
                continue
            high = low + int(starts[whole])
        x, _ = passages(text[low:high], np.array([0, high - low]), size)
        out.append(x)
        if high == len(text):
            # white space alone, after the last whole passage, is none
            return np.concatenate(out[:-1] if len(out) > 1 and not x.any() else out)
        low = high


def bags(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features of all passages, first passage of each text and the number of all), slice of texts by slice."""
    raw, at = utf8(column)
    for i, j in slices(at, SLICE_BYTES):
        if at[j] - at[i] > PART_BYTES:  # one long text
            x = long_passages(raw[at[i] : at[j]])
            yield x, np.array([0, len(x)])
        else:
            yield passages(raw[at[i] : at[j]], at[i : j + 1] - at[i])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """mean, scale: of the features; weights: encoder, tanh branch, sigmoid branch, attention, output."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        w, size = self.weights, np.diff(bag)
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ w["enc"] + w["enc0"])
        t, s = np.tanh(h @ w["tan"]), _sigmoid(h @ w["sig"])
        e = (t * s) @ w["att"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, bag[:-1]), size))
        a = e / np.repeat(np.add.reduceat(e, bag[:-1]), size)
        z = np.add.reduceat(a[:, None] * h, bag[:-1])
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "p": _sigmoid(z @ w["out"] + w["out0"])}

    def score(self, x: np.ndarray, bag: np.ndarray) -> np.ndarray:
        return self.forward(x, bag)["p"] if len(bag) > 1 else np.empty(0)

    def gradient(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f, size = self.weights, self.forward(x, bag), np.diff(bag)
        d = (f["p"] - y) / len(y)
        dz = np.repeat(d, size)[:, None] * w["out"]
        da = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, bag[:-1]), size))
        dt, ds = de[:, None] * w["att"] * f["s"] * (1 - f["t"] ** 2), de[:, None] * w["att"] * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dz + dt @ w["tan"].T + ds @ w["sig"].T) * (1 - f["h"] ** 2)
        return {"enc": f["x"].T @ dh, "enc0": dh.sum(axis=0), "tan": f["h"].T @ dt, "sig": f["h"].T @ ds, "att": (f["t"] * f["s"]).T @ de, "out": f["z"].T @ d, "out0": d.sum(keepdims=True)}


def fit(x: np.ndarray, bag: np.ndarray, y: np.ndarray, *, epochs: int = 40, batch: int = 64, rate: float = 3e-3, decay: float = 1e-3, seed: int = 4) -> Model:
    """Adam over mini-batches of bags; the same input gives the same model."""
    rng = np.random.default_rng(seed)
    shapes = {"enc": (FEATURES, HIDDEN), "enc0": (HIDDEN,), "tan": (HIDDEN, GATE), "sig": (HIDDEN, GATE), "att": (GATE,), "out": (HIDDEN,), "out0": (1,)}
    model = Model(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3), {k: np.zeros(s) if k.endswith("0") else rng.normal(0, s[0] ** -0.5, s) for k, s in shapes.items()})
    m, v = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            chosen = order[i : i + batch]
            rows = np.concatenate([np.arange(bag[k], bag[k + 1]) for k in chosen])
            own = np.concatenate([[0], np.cumsum(bag[chosen + 1] - bag[chosen])])
            step += 1
            for k, g in model.gradient(x[rows], own, y[chosen]).items():
                g = g + (0 if k.endswith("0") else decay * model.weights[k])
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                model.weights[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(key: str = "doc_id", folds: int = 5) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds == 0


def train(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS, target: str = "quality") -> Model:
    """Fit on at most `rows` labelled documents outside the held-out fold, those of least hash of doc_id, by all their passages.

    Rows of a null doc_id or label are not learned from; repeated labels of a document are averaged. No label at all: every score is 0.5.
    """
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col(target).cast("double")).alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def featured(batches):
        for batch in bounded_batches(batches, 1):
            lists = [x[a:b].ravel() for x, bag in bags(batch.column(1)) for a, b in zip(bag[:-1], bag[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lists, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    # bounded: `rows` ids and labels; what comes back is the passages of as many documents, less than their texts
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")
    found = joined.mapInArrow(featured, "doc_id long, y double, x array<double>").toArrow()
    if not found.num_rows:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), {k: np.zeros(s) for k, s in {"enc": (FEATURES, HIDDEN), "enc0": (HIDDEN,), "tan": (HIDDEN, GATE), "sig": (HIDDEN, GATE), "att": (GATE,), "out": (HIDDEN,), "out0": (1,)}.items()})
    column = found["x"].combine_chunks()
    sizes = np.diff(column.offsets.to_numpy()) // FEATURES
    x = column.flatten().to_numpy().reshape(-1, FEATURES)
    each = np.split(x, np.cumsum(sizes)[:-1])
    order = sorted(range(len(each)), key=lambda k: (found["doc_id"][k].as_py(), each[k].sum()))
    y = found["y"].to_numpy()[order]
    return fit(np.concatenate([each[k] for k in order]), np.concatenate([[0], np.cumsum(sizes[order])]), y)


def scorer(model: Model):
    """A Column function of the text: its score. A null text is empty."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.empty(0), *(model.score(*part) for part in bags(text))]), pa.float64())

    return score


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; only the text is an input of the score.

    Null and empty texts are one empty passage. Repeated rows come out repeated; a null doc_id stays (its fold is that of an empty text). Other
    columns aren't read. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), scorer(model)(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, that score at least `threshold`."""
    return docs.where(scorer(model)(F.col("text")) >= threshold)
