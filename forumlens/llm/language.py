"""Language identification as inference in a mixture of languages.

Each language has a distribution over hashed byte trigrams of lower-cased letters
(anything else is a blank), counted on a bounded sample per language. A text is
drawn from a mixture of them: expectation-maximisation estimates the proportions
of a set of languages, and the set is chosen by penalised likelihood. It starts
with all languages and drops the smallest while that does not cost more
likelihood than the penalty for a language. The text's language is the largest
proportion of the set that is left.

If all languages together gain less over the best single one than the penalty of
one more language, no other set can win, and the single language stands. That
settles most texts after one estimate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.functions.keyed import keep_top
from forumlens.llm.common import binary_texts, fold, mixed, slices
from forumlens.llm.pretokens import LETTER, kinds

#: Hash buckets of trigrams.
BUCKETS = 1 << 15
#: Documents per language that the distributions are counted on.
SAMPLE = 1000
#: Languages at most: the model has a column for each.
LANGUAGES = 1000
#: Most estimates per set of languages, and the change at which they end.
STEPS, STILL = 12, 1e-3
#: Log-likelihood that one more language must bring, per unit of log(trigrams).
#: Neighbouring trigrams overlap, so it is well above the 0.5 of independent ones.
PENALTY = 3.0
UNKNOWN = "und"

_table: np.ndarray | None = None


def _bucket_of() -> np.ndarray:
    """Parts of the bucket number for a byte at each of three places."""
    global _table
    if _table is None:
        _table = mixed(np.arange(1, 3 * 256 + 1, dtype=np.uint64)).astype(np.uint32).reshape(3, 256)
    return _table


def trigrams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, bucket and count of the trigrams of each text, in order of documents.

    A document without a letter has none.
    """
    lowered = [(t or b"").decode().lower() for t in texts]
    chars = np.frombuffer(" ".join(lowered).join("  ").encode("utf-32-le"), np.uint32)
    letter = kinds(chars) == LETTER
    # Runs of anything else become one blank.
    keep = letter | np.append(True, letter[:-1])
    borders = np.cumsum([0] + [len(t) + 1 for t in lowered])
    doc = np.repeat(np.arange(len(texts)), np.diff(borders))
    doc = np.append(0, doc)[:len(chars)][keep]
    chars = np.where(letter, chars, 0x20)[keep]
    width = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
    data = np.frombuffer(chars.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
    doc = np.repeat(doc, width)
    if len(data) < 3:
        none = np.zeros(0, np.int64)
        return none, none, none
    part = _bucket_of()
    bucket = (part[0][data[:-2]] ^ part[1][data[1:-1]] ^ part[2][data[2:]]) % np.uint32(BUCKETS)
    inside = data[1:-1] != 0x20
    key, count = np.unique(doc[1:-1][inside] * BUCKETS + bucket[inside], return_counts=True)
    return key // BUCKETS, key % BUCKETS, count


@dataclass
class Model:
    languages: list[str]
    chance: np.ndarray  # buckets x languages


def _penalised(chance: np.ndarray, doc: np.ndarray, count: np.ndarray, starts: np.ndarray, allowed: np.ndarray):
    """Proportions (docs x languages) within the allowed sets, and their log-likelihood."""
    share = allowed / allowed.sum(1, keepdims=True)
    total = np.add.reduceat(count, starts)[:, None]
    moving = np.ones(len(starts), bool)
    for _ in range(STEPS):
        part = share[doc] * chance
        part *= (count / part.sum(1))[:, None]
        after = np.add.reduceat(part, starts, axis=0) / total
        # Each document stops by itself: its result does not hang on its neighbours.
        still = np.abs(after - share).max(1) < STILL
        share = np.where(moving[:, None], after, share)
        moving &= ~still
        if not moving.any():
            break
    likelihood = np.add.reduceat(count * np.log((share[doc] * chance).sum(1)), starts)
    return share, likelihood


def mixtures(model: Model, doc: np.ndarray, bucket: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents named in doc, and their proportions by the chosen set of languages."""
    ids, starts = np.unique(doc, return_index=True)
    chance = model.chance[bucket]
    count = count.astype(float)
    local = np.searchsorted(ids, doc)
    n_lang = len(model.languages)
    price = PENALTY * np.log1p(np.add.reduceat(count, starts))
    alone = np.add.reduceat(count[:, None] * np.log(chance), starts, axis=0)
    allowed = np.ones((len(ids), n_lang))
    share, likelihood = _penalised(chance, local, count, starts, allowed)
    result = np.zeros_like(share)
    best = alone.argmax(1)
    result[np.arange(len(ids)), best] = 1
    open_docs = np.flatnonzero(likelihood - alone.max(1) > price)
    if len(open_docs) and n_lang > 2:
        # Smaller sets for the documents that more than one language explains.
        worth = likelihood - price * (n_lang - 1)
        result[open_docs] = share[open_docs]
        single = alone.max(1)
        swap = open_docs[single[open_docs] > worth[open_docs]]
        worth[swap] = single[swap]
        result[swap] = np.eye(n_lang)[best[swap]]
        current = share
        for size in range(n_lang - 1, 1, -1):
            weakest = np.where(allowed > 0, current, np.inf).argmin(1)
            allowed[np.arange(len(ids)), weakest] = 0
            rows = np.flatnonzero(np.isin(local, open_docs))
            own = np.searchsorted(open_docs, local[rows])
            begin = np.searchsorted(own, np.arange(len(open_docs)))
            less, value = _penalised(chance[rows], own, count[rows], begin, allowed[open_docs])
            value = value - price[open_docs] * (size - 1)
            current = current.copy()
            current[open_docs] = less
            better = value > worth[open_docs]
            worth[open_docs[better]] = value[better]
            result[open_docs[better]] = less[better]
    elif len(open_docs):
        result[open_docs] = share[open_docs]
    return ids, result


def predict(model: Model, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
    """Language and its proportion for each text."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    doc, bucket, count = trigrams(texts)
    if len(doc) and model.languages:
        ids, share = mixtures(model, doc, bucket, count)
        for d, row in zip(ids.tolist(), share):
            k = int(row.argmax())
            names[d], scores[d] = model.languages[k], min(1.0, float(row[k]))
    return names, scores


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = binary_texts(batch, "text"), batch.column("lang").to_pylist()
        for first, last in slices(texts):
            doc, bucket, count = trigrams(texts[first:last])
            of = np.array(langs[first:last], object)[doc]
            for lang in set(of.tolist()):
                mine = of == lang
                sums = held.setdefault(lang, np.zeros(BUCKETS))
                sums += np.bincount(bucket[mine], count[mine], BUCKETS)
    for lang, sums in held.items():
        at = np.flatnonzero(sums)
        yield pa.record_batch({
            "lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int64()),
            "n": pa.array(sums[at].astype(np.int64), pa.int64()),
        })


def fit(docs: DataFrame) -> Model:
    """Trigram distributions from documents with a lang outside the held-out fold, crc32(doc_id) mod 5 = 0.

    Per language the SAMPLE documents with the smallest hash of their id. What
    reaches the driver is a row per language and bucket, for LANGUAGES languages at most.
    Rows whose lang, id or text is NULL are not used.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").filter(
        "doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").filter(fold(F.col("doc_id"), 5) != 0)
    sizes = known.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    # Hashes are even: a bound on them leaves about four samples of each language to be ranked.
    bound = [(r["lang"], -(1 << 63) + int((1 << 64) * min(1 - 2 ** -53, 4 * SAMPLE / r["count"]))) for r in sizes]
    bounds = docs.sparkSession.createDataFrame(bound, "lang string, bound long")
    few = known.select("doc_id", "lang").join(F.broadcast(bounds), "lang").filter(F.xxhash64("doc_id") <= F.col("bound")).drop("bound")
    chosen = keep_top(few, ["lang"], [F.xxhash64("doc_id"), F.col("doc_id")], SAMPLE)
    counts = known.join(F.broadcast(chosen.distinct()), ["doc_id", "lang"]).select("lang", "text").mapInArrow(
        _counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    held: dict[str, np.ndarray] = {}
    for r in counts.collect():
        held.setdefault(r["lang"], np.zeros(BUCKETS))[r["bucket"]] = r["n"]
    languages = sorted(held)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)))
    counted = np.stack([held[name] for name in languages], axis=1) + 0.1
    return Model(languages, counted / counted.sum(0))


def _predicted(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = binary_texts(batch, "text"), batch.column("doc_id")
            for first, last in slices(texts):
                names, scores = predict(model, texts[first:last])
                yield pa.record_batch({
                    "doc_id": ids.slice(first, last - first), "lang_pred": pa.array(names, pa.string()),
                    "score": pa.array(scores, pa.float64()),
                })

    return run


def is_language(model: Model, least: float):
    """A test of texts: whether a known language makes up so much of each."""
    def run(texts: list[bytes | None]) -> np.ndarray:
        names, scores = predict(model, texts)
        return np.array([name != UNKNOWN and score >= least for name, score in zip(names, scores)], bool)

    return run


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of docs (doc_id, text, lang).

    NULL and empty texts and those without a letter are ``und`` with score 0, and
    so is every text if no language could be learned. NULL ids count as '' for the
    fold. Rows that repeat an id are predicted one by one. The number of
    languages is taken to be small: the model has one column for each.
    """
    model = fit(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(_predicted(model), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
