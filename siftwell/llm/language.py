"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

Two networks of gated units read each stretch of bytes, one from either end; their joined states label every position.
A document's probabilities are the mean over all its positions that belong to letters. Training is backpropagation
through time over stretches of a bounded sample of documents; prediction reads every byte of every document, in
stretches side by side, so that a task computes on wide arrays whatever the lengths of its texts.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.batches import slices
from siftwell.llm.shared import ship
from siftwell.llm.training import Adam, fold, sampled, shuffled, windows

UNITS, STRETCH, PAD = 8, 128, 256
# Training: documents per language, stretches of each, rounds.
SAMPLE_PER_LANGUAGE = 300
STRETCHES, ROUNDS, BATCH, RATE = 4, 5, 128, 1e-2
# Stretches that are read together.
TOGETHER = 4096
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]")
# Bytes of letters: ASCII letters, and all bytes of longer characters.
_IS_LETTER = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)] + [False])

Weights = dict[str, np.ndarray]


def _start(languages: int, rng: np.random.Generator) -> Weights:
    w = {}
    for way in "fb":
        w[way + "in"] = rng.normal(0, 0.4, (PAD + 1, 3 * UNITS))
        w[way + "state"] = rng.normal(0, 0.3, (UNITS, 3 * UNITS))
        w[way + "bias"] = np.zeros(3 * UNITS)
    w |= {"out": rng.normal(0, 0.3, (2 * UNITS, languages)), "out_bias": np.zeros(languages)}
    return {k: v.astype(np.float32) for k, v in w.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _read(w: Weights, way: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (position, stretch, unit) of one direction; x is (position, stretch). `keep` gets what backpropagation needs."""
    steps, n = x.shape
    table, u, bias = w[way + "in"], w[way + "state"], w[way + "bias"]
    states = np.empty((steps, n, UNITS), np.float32)
    h = np.zeros((n, UNITS), np.float32)
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        given = table[x[t]]
        own = h @ u
        own += bias
        gates = _sigmoid(given[:, : 2 * UNITS] + own[:, : 2 * UNITS])
        reset, update = gates[:, :UNITS], gates[:, UNITS:]
        new = np.tanh(given[:, 2 * UNITS :] + reset * own[:, 2 * UNITS :])
        if keep is not None:
            keep.append((t, h, reset, update, new, own[:, 2 * UNITS :]))
        h = new + update * (h - new)
        states[t] = h
    return states


def _back(w: Weights, way: str, x: np.ndarray, kept: list, d_states: np.ndarray) -> Weights:
    """Backpropagation through time of one direction."""
    u = w[way + "state"]
    d_table = np.empty((*x.shape, 3 * UNITS), np.float32)
    du, db, dh = np.zeros_like(u), np.zeros(3 * UNITS, np.float32), 0
    for t, before, reset, update, new, own in reversed(kept):
        dh = dh + d_states[t]
        d_new = dh * (1 - update) * (1 - new**2)
        d_update = dh * (before - new) * update * (1 - update)
        d_reset = d_new * own * reset * (1 - reset)
        d_own = np.hstack([d_reset, d_update, d_new * reset])
        d_table[t] = np.hstack([d_reset, d_update, d_new])
        du += before.T @ d_own
        db += d_own.sum(0)
        dh = dh * update + d_own @ u.T
    seen, flat = x.ravel(), d_table.reshape(-1, 3 * UNITS)
    d_in = np.stack([np.bincount(seen, flat[:, k], PAD + 1) for k in range(3 * UNITS)], 1).astype(np.float32)
    return {way + "in": d_in, way + "state": du, way + "bias": db}


def _softmax(z: np.ndarray) -> np.ndarray:
    """In place."""
    z -= z.max(axis=-1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=-1, keepdims=True)
    return z


def _grads(w: Weights, x: np.ndarray, y: np.ndarray) -> Weights:
    """x (position, stretch), y the language of each stretch; every letter position should tell it."""
    keep_f: list = []
    keep_b: list = []
    states = np.concatenate([_read(w, "f", x, keep_f), _read(w, "b", x, keep_b)], axis=2)
    d = _softmax(states @ w["out"] + w["out_bias"])
    d[:, np.arange(len(y)), y] -= 1
    mask = _IS_LETTER[x]
    d *= (mask / max(1, mask.sum())).astype(np.float32)[:, :, None]
    flat, d_flat = states.reshape(-1, 2 * UNITS), d.reshape(-1, d.shape[2])
    d_states = d @ w["out"].T
    return {
        "out": flat.T @ d_flat, "out_bias": d_flat.sum(0),
        **_back(w, "f", x, keep_f, d_states[:, :, :UNITS]), **_back(w, "b", x, keep_b, d_states[:, :, UNITS:]),
    }


def train(texts: list[str], labels: list[str], seed: int = 5) -> tuple[list[str], Weights]:
    """The languages, in order, and the weights."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    w = _start(len(languages), rng)
    if len(languages) < 2:
        return languages, w
    raw = [t.encode() for t in texts]
    rows, owner = windows(raw, STRETCH, STRETCH, PAD)
    y = np.array([languages.index(label) for label in labels])[owner]
    # A few stretches of each document, whichever part of it they come from.
    rank = np.argsort(np.argsort(owner + rng.random(len(owner)) * 0.999)) - np.searchsorted(owner, owner)
    use = np.flatnonzero((rank < STRETCHES) & _IS_LETTER[rows].any(axis=1))
    adam = Adam(w, RATE)
    for k in range(ROUNDS):
        adam.rate = RATE * (1 - k / ROUNDS) + 5e-4
        for some in shuffled(len(use), BATCH, rng):
            grads = _grads(w, np.ascontiguousarray(rows[use[some]].T), y[use[some]])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            adam.step({name: g / max(1.0, norm) for name, g in grads.items()})
    return languages, w


def probabilities(w: Weights, texts: list[str]) -> np.ndarray:
    """(text, language): the mean over all letter positions of the whole text."""
    raw = [t.encode() for t in texts]
    rows, owner = windows(raw, STRETCH, STRETCH, PAD)
    sums = np.zeros((len(rows), w["out"].shape[1]))
    for i in range(0, len(rows), TOGETHER):
        x = np.ascontiguousarray(rows[i : i + TOGETHER].T)
        z = _read(w, "f", x).reshape(-1, UNITS) @ w["out"][:UNITS]
        z += _read(w, "b", x).reshape(-1, UNITS) @ w["out"][UNITS:]
        z += w["out_bias"]
        p = _softmax(z).reshape(*x.shape, -1)
        sums[i : i + TOGETHER] = np.einsum("tnl,tn->nl", p, _IS_LETTER[x].astype(np.float32))
    total = np.zeros((len(texts), sums.shape[1]))
    np.add.at(total, owner, sums)
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-9)


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], Weights]:
    """Train on about `per_language` documents of each language outside the held-out fold; the sample is collected."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), 5) != 0))
    rows = sampled(known.select("doc_id", "lang", "text"), "lang", per_language).orderBy("doc_id", "text", "lang").collect()
    return train([r.text for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: tuple[list[str], Weights]) -> DataFrame:
    """doc_id, lang_pred and score of each whole text.

    Null texts, texts without a letter and all texts of a model without languages are undetermined, with a score of 0.
    A model of one language gives that one with a score of 1. Repeated rows are labelled one by one.
    """
    ship(docs.sparkSession)
    languages, weights = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                able = [i for i, t in enumerate(texts) if languages and t and _LETTER.search(t)]
                found: list[str] = [UNDETERMINED] * len(texts)
                score = np.zeros(len(texts))
                if able:
                    p = probabilities(weights, [texts[i] for i in able])
                    for i, row in zip(able, p):
                        found[i] = languages[int(row.argmax())]
                        score[i] = min(1.0, float(row.max()))
                columns = [part.column("doc_id"), pa.array(found, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    kind = docs.select("doc_id").dtypes[0][1]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    found = identify(docs, fit(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
