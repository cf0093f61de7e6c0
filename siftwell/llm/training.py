"""Bounded samples of labelled documents for models trained on the driver, and their optimiser."""

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id written as text, modulo `folds`; a null doc_id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0))


def sampled(keys: DataFrame, label: str, per_label: int) -> DataFrame:
    """About `per_label` rows of `keys` (doc_id and `label`) for each label, chosen by hash of the doc_id.

    One count and one filter; the chance of a row follows from how many rows its label has. The counts, one for each
    label that a model has to tell apart, become part of the filter, so no row moves before it is chosen.
    """
    counts = {r[0]: r[1] for r in keys.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    if not counts:
        return keys.limit(0)
    chance = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, per_label / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    return keys.where(draw < F.try_element_at(chance, F.col(label)))


def excerpt(text: Column, most: int, stretches: int = 16) -> Column:
    """The text or, where it has more than `most` characters, evenly spaced stretches of it with so many together."""
    length, size = F.char_length(text), most // stretches
    step = (length - size) / float(stretches - 1)
    cut = F.transform(F.sequence(F.lit(0), F.lit(stretches - 1)), lambda k: F.substring(text, (F.lit(1) + F.floor(k * step)).cast("int"), F.lit(size)))
    return F.when(length <= most, text).otherwise(F.array_join(cut, ""))


class Adam:
    """Steps for a dict of arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.steps = weights, rate, 0
        self.mean = {k: np.zeros_like(w) for k, w in weights.items()}
        self.square = {k: np.zeros_like(w) for k, w in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.steps += 1
        size = self.rate * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for k, g in grads.items():
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.001 * (g * g - self.square[k])
            self.weights[k] -= (size * self.mean[k] / (np.sqrt(self.square[k]) + 1e-8)).astype(self.weights[k].dtype)


def shuffled(n: int, size: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    order = rng.permutation(n)
    for i in range(0, n, size):
        yield order[i : i + size]


def windows(raw: list[bytes], length: int, step: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of every text in rows of `length`, each starting `step` after the one before, and the text of each row.

    Rows are filled up with `pad`; an empty text has one row of it.
    """
    sizes = np.array([len(r) for r in raw], np.int64)
    counts = 1 + np.maximum(0, -(-(sizes - length) // step))
    owner = np.repeat(np.arange(len(raw)), counts)
    firsts = np.cumsum(counts) - counts
    begin = (np.arange(len(owner)) - firsts[owner]) * step
    data = np.frombuffer(b"".join(raw) or b"\0", np.uint8)
    offsets = np.cumsum(sizes) - sizes
    inside = begin[:, None] + np.arange(length)[None, :]
    valid = inside < sizes[owner][:, None]
    place = np.minimum(inside + offsets[owner][:, None], len(data) - 1)
    return np.where(valid, data[place], np.int16(pad)).astype(np.int16), owner
