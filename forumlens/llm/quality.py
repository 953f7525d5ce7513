"""Quality classifier: a byte-level convolutional network in numpy.

A filter looks at WIDTH bytes in a row; its response at a place is the sum of one
learned number per byte value and offset. A document is covered by overlapping
chunks (two halves of HALF bytes, each half in two chunks), every filter keeps its
largest response per chunk, and mean, maximum and minimum over the chunks go
through one hidden layer into one probability.

Training takes a bounded sample: the SAMPLE labelled documents with the smallest
hash of their id, or fewer if those hold more than SAMPLE_BYTES. Fitting and scoring
cover every byte of a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.llm.common import binary_texts, fold, slices, written

WIDTH, FILTERS, HIDDEN, HALF = 5, 16, 16, 256
#: Most documents, and bytes of whole texts, that the network is trained on.
SAMPLE, SAMPLE_BYTES = 3000, 1 << 25
EPOCHS, BATCH = 6, 32
#: Learning rates; filters see many places per step and move slowly.
RATES = {"filters": 0.002, "hidden": 0.01, "bias": 0.01, "out": 0.01, "shift": 0.01}
#: Places whose responses are held at a time.
PLACES = 1 << 16

Weights = dict[str, np.ndarray]


def fresh_weights(seed: int = 7) -> Weights:
    rng = np.random.default_rng(seed)
    features = 3 * FILTERS + 1
    return {
        "filters": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
        "hidden": rng.normal(0, 1 / np.sqrt(features), (features, HIDDEN)).astype(np.float32),
        "bias": np.zeros(HIDDEN, np.float32),
        "out": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN).astype(np.float32),
        "shift": np.zeros(1, np.float32),
        # Centre and scale of the features, measured once and not learned.
        "centre": np.zeros(features, np.float32), "scale": np.ones(features, np.float32),
    }


def halves(text: bytes | None) -> np.ndarray:
    """A text as rows of HALF bytes and the WIDTH - 1 that follow; 0 where it ends."""
    text = text or b""
    n = -(-len(text) // HALF)
    padded = np.frombuffer(text.ljust(n * HALF, b"\0") + bytes(WIDTH - 1), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, HALF + WIDTH - 1)[::HALF] if n else np.zeros(
        (0, HALF + WIDTH - 1), np.uint8)


def _responses(rows: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Responses (rows, HALF, FILTERS) of all filters at all places."""
    out = filters[0][rows[:, :HALF]]
    for j in range(1, WIDTH):
        out += filters[j][rows[:, j:j + HALF]]
    return out


def _gathered(pooled: np.ndarray, counts: np.ndarray, sizes: np.ndarray):
    """Features of documents from the pooled halves of all of them, and what the gradient needs."""
    features = np.zeros((len(counts), 3 * FILTERS + 1), np.float32)
    features[:, -1] = np.log1p(sizes) / 8
    picks = []
    begin = 0
    for d, n in enumerate(counts):
        if n:
            own = pooled[begin:begin + n]
            second = own[1:] > own[:-1] if n > 1 else np.zeros((1, FILTERS), bool)
            chunks = np.maximum(own[:-1], own[1:]) if n > 1 else own
            hi, lo = chunks.argmax(0), chunks.argmin(0)
            across = np.arange(FILTERS)
            features[d, :-1] = np.concatenate([chunks.mean(0), chunks[hi, across], chunks[lo, across]])
            picks.append((d, begin, second, hi, lo))
        begin += n
    return features, picks


def _probability(weights: Weights, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    features = (features - weights["centre"]) / weights["scale"]
    hidden = np.tanh(features @ weights["hidden"] + weights["bias"])
    return 1 / (1 + np.exp(-(hidden @ weights["out"] + weights["shift"][0]))), hidden


def _gradient(weights: Weights, texts: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray) -> Weights:
    rows, counts = np.concatenate(texts), np.array([len(t) for t in texts])
    step = max(1, PLACES // HALF)
    best, pooled = np.empty((len(rows), FILTERS), np.int64), np.empty((len(rows), FILTERS), weights["filters"].dtype)
    for i in range(0, len(rows), step):
        responses = _responses(rows[i:i + step], weights["filters"])
        best[i:i + step] = responses.argmax(1)
        pooled[i:i + step] = np.take_along_axis(responses, best[i:i + step, None], 1)[:, 0]
    features, picks = _gathered(np.maximum(pooled, 0), counts, sizes)
    probability, hidden = _probability(weights, features)
    d_logit = ((probability - labels) / len(labels)).astype(np.float32)
    d_hidden = np.outer(d_logit, weights["out"]) * (1 - hidden ** 2)
    d_features = d_hidden @ weights["hidden"].T / weights["scale"]
    d_pooled = np.zeros_like(pooled)
    across = np.arange(FILTERS)
    for d, begin, second, hi, lo in picks:
        g_mean, g_hi, g_lo = d_features[d, :-1].reshape(3, FILTERS)
        d_chunks = np.tile(g_mean / len(second), (len(second), 1))
        d_chunks[hi, across] += g_hi
        d_chunks[lo, across] += g_lo
        at = begin + np.arange(len(second))[:, None] + second
        np.add.at(d_pooled, (at, np.broadcast_to(across, at.shape)), d_chunks)
    d_pooled *= pooled > 0
    d_filters = np.zeros_like(weights["filters"])
    one, who = np.nonzero(d_pooled)
    for j in range(WIDTH):
        np.add.at(d_filters[j], (rows[one, best[one, who] + j], who), d_pooled[one, who])
    return {
        "filters": d_filters, "hidden": ((features - weights["centre"]) / weights["scale"]).T @ d_hidden, "bias": d_hidden.sum(0),
        "out": hidden.T @ d_logit, "shift": d_logit.sum(keepdims=True),
    }


def train(rows: list[tuple[int, np.ndarray, int]], seed: int = 7) -> Weights:
    """Weights from (label, halves, bytes of the text) of each sampled document; Adam with a falling rate."""
    weights = fresh_weights(seed)
    if not rows:
        return weights
    rng = np.random.default_rng(seed)
    start = np.concatenate([
        _features(weights, [r[1] for r in rows[i:i + BATCH]], np.array([r[2] for r in rows[i:i + BATCH]]))
        for i in range(0, len(rows), BATCH)])
    weights["centre"], weights["scale"] = start.mean(0), start.std(0) + 0.1
    first, second = ({k: np.zeros_like(weights[k]) for k in RATES} for _ in range(2))
    step, total = 0, EPOCHS * -(-len(rows) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for begin in range(0, len(rows), BATCH):
            part = [rows[i] for i in order[begin:begin + BATCH]]
            found = _gradient(
                weights, [r[1] for r in part], np.array([r[2] for r in part]), np.array([r[0] for r in part]))
            step += 1
            for k, g in found.items():
                rate = RATES[k] * (1 - step / (total + 1))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                weights[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
    return weights


def _features(weights: Weights, texts: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Features of documents given as halves, from all places of them."""
    rows, step = np.concatenate(texts), max(1, PLACES // HALF)
    pooled = [_responses(rows[i:i + step], weights["filters"]).max(1) for i in range(0, len(rows), step)]
    pooled = np.maximum(np.concatenate(pooled), 0) if pooled else np.zeros((0, FILTERS), np.float32)
    return _gathered(pooled, np.array([len(t) for t in texts]), sizes)[0]


def score(weights: Weights, texts: list[bytes | None]) -> np.ndarray:
    """Probability of label 1 for each text."""
    found = _features(weights, [halves(t) for t in texts], np.array([len(t or b"") for t in texts]))
    return _probability(weights, found)[0].astype(float)


def fit(docs: DataFrame, labels: DataFrame) -> Weights:
    """Train on labelled documents outside the held-out fold, crc32(doc_id) mod 3 = 1.

    docs (doc_id, text), labels (doc_id, label). Rows without a label or an id are
    not used; ids that either side lacks bring nothing.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).filter(
        "doc_id IS NOT NULL AND label IS NOT NULL").filter(fold(F.col("doc_id"), 3) != 1)
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(SAMPLE)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # At most SAMPLE ids.
    found = written(texts.join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "label", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")), "labelled")
    sizes = found.groupBy("doc_id").agg(F.sum(F.length("text")).alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    fit_in = int(np.searchsorted(np.cumsum([r["size"] for r in sizes]), SAMPLE_BYTES, "right"))
    if fit_in < len(sizes):
        # Whole texts of the first ids that fit, and of one in any case.
        found = found.filter(F.col("doc_id").isin([r["doc_id"] for r in sizes[:max(1, fit_in)]]))
    rows = sorted((r["doc_id"], r["label"], bytes(r["text"])) for r in found.collect())
    return train([(label, halves(text), len(text)) for _, label, text in rows])


def _scores(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = binary_texts(batch, "text"), batch.column("doc_id")
            for first, last in slices(texts):
                yield pa.record_batch({
                    "doc_id": ids.slice(first, last - first),
                    "score": pa.array(score(weights, texts[first:last]), pa.float64()),
                })

    return run


def is_good(weights: Weights):
    """A test of texts: whether label 1 is likelier for each."""
    def run(texts: list[bytes | None]) -> np.ndarray:
        return score(weights, texts) >= 0.5

    return run


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs (doc_id, text).

    A NULL text counts as empty, and empty texts get the score of a document
    without chunks. NULL ids count as '' for the fold. Rows that repeat an id are
    scored one by one. Other columns are ignored. Without labels the network stays
    as it was initialised.
    """
    weights = fit(docs, labels)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(_scores(weights), "doc_id long, score double")
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
