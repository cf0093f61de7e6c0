"""Quality classifier: a byte-level convolutional network in numpy.

The bytes of a document, whole, are laid out in overlapping chunks, so that no filter window is lost between them.
Learned filters slide over each chunk; each filter's largest response stands for the chunk. The mean and the maximum
over all chunks of a document, with its length, go through a small hidden layer into one probability. Training uses a
bounded sample of labelled documents; scoring is one pass over the corpus with the weights sent along.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.batches import slices, with_columns
from siftwell.llm.shared import ship
from siftwell.llm.training import Adam, excerpt, fold, sampled, shuffled, windows
from siftwell.storage import staged

CHUNK, WIDTH, STRIDE, PAD = 512, 8, 2, 256
STEP = CHUNK - WIDTH
EMBED, FILTERS, HIDDEN = 8, 32, 16
# Training: documents per label, chunks seen of each in a round, rounds.
SAMPLE_PER_LABEL = 1_200
SEEN, ROUNDS, BATCH, RATE = 4, 14, 64, 3e-3
# Characters of a sampled text that are trained on, and sampled ids that are broadcast.
EXCERPT, MOST_BROADCAST = 1 << 15, 100_000
# Chunks that are scored together.
TOGETHER = 128

Weights = dict[str, np.ndarray]


def _start(rng: np.random.Generator) -> Weights:
    w = {
        "embed": rng.normal(0, 1, (PAD + 1, EMBED)), "filter": rng.normal(0, 1 / 8, (WIDTH * EMBED, FILTERS)),
        "bias": np.zeros(FILTERS), "in": rng.normal(0, 0.3, (2 * FILTERS + 1, HIDDEN)), "in_bias": np.zeros(HIDDEN),
        "out": rng.normal(0, 0.3, HIDDEN), "out_bias": np.zeros(1),
    }
    return {k: v.astype(np.float32) for k, v in w.items()}


def _patches(w: Weights, chunks: np.ndarray) -> np.ndarray:
    """Each filter window of each chunk as one vector."""
    embedded = w["embed"][chunks]
    n, places = len(chunks), (CHUNK - WIDTH) // STRIDE + 1
    a, b, c = embedded.strides
    view = np.lib.stride_tricks.as_strided(embedded, (n, places, WIDTH * EMBED), (a, b * STRIDE, c))
    return view.reshape(n * places, WIDTH * EMBED)


def _responses(w: Weights, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All responses of the filters, zero where a window begins in the padding, and the windows."""
    patches = _patches(w, chunks)
    out = (patches @ w["filter"]).reshape(len(chunks), -1, FILTERS)
    out += w["bias"]
    np.maximum(out, 0, out=out)
    out *= (chunks[:, : CHUNK - WIDTH + 1 : STRIDE] != PAD)[:, :, None]
    return out, patches


def _pooled(w: Weights, chunks: np.ndarray) -> np.ndarray:
    out = np.empty((len(chunks), FILTERS), np.float32)
    for i in range(0, len(chunks), TOGETHER):
        out[i : i + TOGETHER] = _responses(w, chunks[i : i + TOGETHER])[0].max(axis=1)
    return out


def _log_length(sizes: np.ndarray) -> np.ndarray:
    return (np.log1p(np.minimum(sizes, 8 * CHUNK)) / 4 - 1).astype(np.float32)


def _logit(w: Weights, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(features @ w["in"] + w["in_bias"])
    return hidden @ w["out"] + w["out_bias"], hidden


def scores(w: Weights, texts: list[str | None]) -> np.ndarray:
    """One probability for each whole text; null counts as empty."""
    raw = [t.encode() if t else b"" for t in texts]
    if not raw:
        return np.zeros(0)
    chunks, owner = windows(raw, CHUNK, STEP, PAD)
    pooled = _pooled(w, chunks)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    mean = np.add.reduceat(pooled, first) / np.diff(np.append(first, len(owner)))[:, None]
    peak = np.maximum.reduceat(pooled, first)
    features = np.hstack([mean, peak, _log_length(np.array(list(map(len, raw))))[:, None]])
    logit = _logit(w, features)[0] * w["scale"] + w["shift"]
    return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))


def _grads(w: Weights, chunks: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Weights:
    """Gradients over documents of SEEN chunks each; only the winning window of a filter passes any on."""
    n = len(y)
    flat = chunks.reshape(n * SEEN, CHUNK)
    out, patches = _responses(w, flat)
    best = out.argmax(axis=1)
    pooled = np.take_along_axis(out, best[:, None, :], 1)[:, 0].reshape(n, SEEN, FILTERS)
    peak_at = pooled.argmax(axis=1)
    features = np.hstack([pooled.mean(axis=1), pooled.max(axis=1), _log_length(sizes)[:, None]])
    logit, hidden = _logit(w, features)
    d = (weight * (1 / (1 + np.exp(-logit)) - y) / n).astype(np.float32)
    dh = d[:, None] * w["out"] * (1 - hidden**2)
    df = dh @ w["in"].T
    dp = np.repeat(df[:, None, :FILTERS] / SEEN, SEEN, axis=1)
    np.put_along_axis(dp, peak_at[:, None, :], np.take_along_axis(dp, peak_at[:, None, :], 1) + df[:, None, FILTERS : 2 * FILTERS], 1)
    dp = (dp * (pooled > 0)).reshape(n * SEEN, FILTERS)
    winners = patches.reshape(n * SEEN, -1, WIDTH * EMBED)[np.arange(n * SEEN)[:, None], best]
    dwin = dp[:, :, None] * w["filter"].T[None]
    at = best[:, :, None] * STRIDE + np.arange(WIDTH)
    symbols = flat[np.arange(n * SEEN)[:, None, None], at].ravel()
    spread = dwin.reshape(-1, EMBED)
    return {
        "embed": np.stack([np.bincount(symbols, spread[:, e], PAD + 1) for e in range(EMBED)], 1).astype(np.float32),
        "filter": np.einsum("cf,cfk->kf", dp, winners), "bias": dp.sum(0), "in": features.T @ dh, "in_bias": dh.sum(0),
        "out": hidden.T @ d, "out_bias": d.sum(keepdims=True),
    }


def _calibrate(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make probabilities of logits, fitted on documents kept aside, by Newton's method."""
    x = np.stack([logit, np.ones_like(logit)], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 0.02 * (theta - [1.0, 0.0])
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(2)
        theta = theta - np.linalg.solve(curve, slope)
        theta[0] = np.clip(theta[0], 0.2, 3.0)
    return float(theta[0]), float(theta[1])


def _cropped(raw: bytes, rng: np.random.Generator) -> bytes:
    """A stretch of a text, so that short texts of either kind are seen in training."""
    size = int(np.exp(rng.uniform(np.log(24), np.log(CHUNK))))
    start = int(rng.integers(0, max(1, len(raw) - size)))
    return raw[start : start + size]


def train(texts: list[str], labels: list[int], share: float, seed: int = 3) -> Weights:
    """Weights from labelled texts; `share` is how common label 1 is among all labelled documents.

    Labels of one kind only, or none, give a network that always answers `share`.
    """
    rng = np.random.default_rng(seed)
    w = _start(rng)
    if len(set(labels)) < 2:
        w["scale"], w["shift"] = np.float32(0), np.float32(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return w
    whole = [t.encode() for t in texts]
    raw = whole + [_cropped(t, rng) for t in whole]
    y = np.array([*labels, *labels], np.float32)
    sizes = np.array(list(map(len, raw)))
    chunks, owner = windows(raw, CHUNK, STEP, PAD)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    count = np.diff(np.append(first, len(owner)))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    aside = rng.random(len(whole)) < 0.15
    learn = np.flatnonzero(~np.append(aside, aside))
    adam = Adam(w, RATE)
    for k in range(ROUNDS):
        adam.rate = RATE * (1 - k / ROUNDS) + 1e-4
        for some in shuffled(len(learn), BATCH, rng):
            rows = learn[some]
            draw = (rng.random((len(rows), 1)) * count[rows][:, None] + np.arange(SEEN) * np.maximum(1, count[rows][:, None] // SEEN)).astype(int)
            seen = chunks[first[rows][:, None] + draw % count[rows][:, None]]
            adam.step(_grads(w, seen, sizes[rows], y[rows], weight[rows]))
    w["scale"], w["shift"] = np.float32(1), np.float32(0)
    p = np.clip(scores(w, [texts[i] for i in np.flatnonzero(aside)]), 1e-9, 1 - 1e-9)
    kept = y[: len(whole)][aside]
    common = np.where(kept == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    if len(set(kept)) == 2:
        scale, shift = _calibrate(np.log(p / (1 - p)), kept, common)
        w["scale"], w["shift"] = np.float32(scale), np.float32(shift)
    return w


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Weights:
    """Train on about `per_label` documents of each label outside the held-out fold.

    The sample is bounded, in texts and in what is taken of each, so it is collected; label shares come from all labels.
    Nulls in text or label are left out; of rows with equal doc_id one is taken.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), 4) != 2))
    known = known.select("doc_id", F.col("quality").cast("int").alias("label")).distinct()
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    picked = staged(sampled(known, "label", per_label))
    # The ids are as many as the sample, whatever the corpus; one text of each is taken, and of a long one an excerpt.
    near = F.broadcast(picked) if picked.count() <= MOST_BROADCAST else picked.hint("merge")
    texts = docs.where("text is not null").select("doc_id", excerpt(F.col("text"), EXCERPT).alias("text")).join(near, "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = texts.orderBy("doc_id", "text", "label").collect()
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    return train([r.text for r in rows], [r.label for r in rows], share)


def score(docs: DataFrame, weights: Weights, text: str = "text", column: str = "score") -> DataFrame:
    """`docs` with the probability that its label is 1; a column of that name is replaced.

    Null counts as an empty text, which gets a score like any other; repeated rows get equal scores, an empty table none.
    The length, one feature of many, counts up to eight chunks; the chunks of longer texts are all looked at.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield with_columns(part, **{column: pa.array(scores(weights, part.column(text).to_pylist()), pa.float64())})

    kept = [f for f in docs.schema.fields if f.name != column]
    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(column, T.DoubleType())]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    held_out = fold(F.col("doc_id"), 4) == 2
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
