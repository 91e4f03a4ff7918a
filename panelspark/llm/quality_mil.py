"""Quality classifier: attention-based multiple-instance learning.

A text is a bag of passages of 64 words. Every passage is encoded from its bytes and
words by a learned layer; gated attention, learned from the labels of whole texts
only, says how much each passage counts, and the weighted passage representation is
scored. Trained in numpy on a bounded sample; texts are scored whole, batch by
batch, where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.labelled import FIT_ROWS, fitting_rows
from panelspark.llm.scratch import crc_mod
from panelspark.llm.words import LOWER, Words, chunks

PASSAGE = 64  # words
CODE, GATE = 24, 12  # width of a passage's code, of the attention's hidden layer
# Passages of one text that the fit sees, at most; scores use all.
FIT_PASSAGES = 64
EPOCHS, BATCH, RATE, DECAY = 40, 64, 3e-3, 1e-4
SEED = 11

# Byte classes: each ASCII punctuation mark by itself, and six kinds of others.
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_CLASS[10] = 5
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS[_MARKS] = 6 + np.arange(len(_MARKS))
CLASSES = 6 + len(_MARKS)
FEATURES = CLASSES + 6


def passages(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the first passage of each text.

    A text without words is one passage without words.
    """
    counts = words.counts
    per_text = np.maximum(1, -(-counts // PASSAGE))
    first = np.r_[0, np.cumsum(per_text)]
    total = first[-1]
    owner = words.owner()
    of_word = first[owner] + (np.arange(len(owner)) - words.first[owner]) // PASSAGE
    # A passage's bytes go from its first word (a text's first: from its start) on.
    begin = np.zeros(total, np.int64)
    begin[first[:-1]] = words.text[:-1]
    head = np.flatnonzero(np.diff(of_word, prepend=-1))
    later = head[(head - words.first[owner[head]]) > 0]
    begin[of_word[later]] = words.start[later]
    size = np.diff(np.r_[begin, len(words.data)])
    of_byte = np.repeat(np.arange(total), size)
    marks = np.bincount(of_byte * CLASSES + _CLASS[words.data], minlength=total * CLASSES).reshape(total, CLASSES)
    n = np.bincount(of_word, minlength=total)
    some = np.maximum(n, 1)
    length = words.end - words.start
    code = words.hashes(LOWER)
    order = np.lexsort((code, of_word))
    new = np.ones(len(code), bool)
    new[1:] = (code[order][1:] != code[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    again = np.zeros(len(code))
    again[1:] = (code[1:] == code[:-1]) & (of_word[1:] == of_word[:-1])
    sums = lambda w: np.bincount(of_word, weights=w, minlength=total)
    mean = sums(length) / some
    extra = np.stack(
        [
            n / PASSAGE, mean / 10, np.sqrt(np.maximum(sums(length**2) / some - mean**2, 0)) / 10,
            sums(length <= 3) / some, np.bincount(of_word[order][new], minlength=total) / some, sums(again) / some,
        ],
        1,
    )
    return np.c_[np.sqrt(marks / np.maximum(size, 1)[:, None]), extra], first


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """``p`` holds the learned arrays; ``mean`` and ``scale`` standardise features."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["enc"] + p["enc0"])
        t, s = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * s) @ p["w"]
        lead = first[:-1]
        owner = np.repeat(np.arange(len(lead)), np.diff(first))
        a = np.exp(e - np.maximum.reduceat(e, lead)[owner])
        a /= np.add.reduceat(a, lead)[owner]
        z = np.add.reduceat(a[:, None] * h, lead, axis=0)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "owner": owner, "score": _sigmoid(z @ p["out"] + p["out0"])}

    def score(self, words: Words) -> np.ndarray:
        return self.forward(*passages(words))["score"]

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over the texts."""
        p, f = self.p, self.forward(x, first)
        lead, owner = first[:-1], f["owner"]
        d = (f["score"] - y) / len(y)
        dz = np.outer(d, p["out"])[owner]
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, lead)[owner])
        dt = np.outer(de, p["w"]) * f["s"] * (1 - f["t"] ** 2)
        ds = np.outer(de, p["w"]) * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dz + dt @ p["v"].T + ds @ p["u"].T) * (1 - f["h"] ** 2)
        return {
            "out": f["z"].T @ d, "out0": np.array(d.sum()), "w": (f["t"] * f["s"]).T @ de,
            "v": f["h"].T @ dt, "u": f["h"].T @ ds, "enc": f["x"].T @ dh, "enc0": dh.sum(0),
        }


def _bags(most: int):
    """Rows (id, label, text) with the number and the features of up to ``most`` passages, spread over the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in chunks(batch.column(2)):
                x, first = passages(words)
                some = batch.slice(words.row, words.texts)
                bags = [
                    x[a + np.arange(min(n, most)) * n // min(n, most)].astype(np.float32)
                    for a, n in zip(first.tolist(), np.diff(first).tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array([len(b) for b in bags], pa.int64()), pa.array([b.tobytes() for b in bags], pa.binary())],
                    names=["id", "label", "n", "x"],
                )

    return run


def train(sizes: np.ndarray, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Adam on shuffled batches of whole bags; the seed fixes the result.

    Bag i has the next ``sizes[i]`` rows of ``x`` and the label ``y[i]``.
    """
    rng = np.random.default_rng(SEED)
    starts = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    mean = x.mean(0) if len(x) else np.zeros(FEATURES)
    scale = x.std(0) + 1e-2 if len(x) else np.ones(FEATURES)
    draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    model = Model(
        mean, scale,
        {
            "enc": draw(FEATURES, CODE), "enc0": np.zeros(CODE), "v": draw(CODE, GATE), "u": draw(CODE, GATE),
            "w": draw(GATE), "out": draw(CODE), "out0": np.array(np.log(share / (1 - share))),
        },
    )
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for epoch in range(epochs):
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            take = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in pick])
            step += 1
            for k, g in model.gradient(x[take], np.r_[0, np.cumsum(sizes[pick])], y[pick]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                model.p[k] = model.p[k] - rate * (move + DECAY * model.p[k])
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``rows`` labelled documents outside the held-out quarter, of each at most ``FIT_PASSAGES`` passages.

    The features of passages are made in the tasks; only they reach the driver.
    """
    sample = fitting_rows(docs, labels, "quality", rows, id_col, text_col)
    found = sample.select("id", "label", "text").mapInArrow(_bags(FIT_PASSAGES), "id long, label int, n long, x binary")
    found = found.toArrow().sort_by("id")
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float32).reshape(-1, FEATURES).astype(np.float64)
    return train(found.column("n").to_numpy(), x, found.column("label").to_numpy().astype(np.float64))


def _score(model: Model):
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(words) for words in chunks(batch.column(1))]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), pa.array(np.concatenate(found))], schema=schema
                )

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``score`` and ``predicted`` (score of 0.7 or more) of every row.

    A null text scores as an empty one, which is one passage without words. Null and
    repeated ids keep their rows; extra columns are not read.
    """
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_score(model), "id long, score double")
    return out.select(
        F.col("id").alias(id_col), (crc_mod("id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
