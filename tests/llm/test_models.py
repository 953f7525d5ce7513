"""Quality and language models: held-out accuracy, edges, whole texts."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from forumlens.llm import language, quality
from forumlens.llm.common import table
from tests.llm.odd import ROWS, no_docs, odd_docs

SF_DIR = "/root/testdata/sf0.01"


def test_quality_on_held_out_documents(spark):
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    found = quality.classify(docs, labels.select("doc_id", labels["quality"].alias("label")))
    rows = found.join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_gradient_matches_differences():
    rng = np.random.default_rng(2)
    weights = {k: w.astype(np.float64) for k, w in quality.fresh_weights().items()}
    texts = [quality.halves(rng.integers(97, 122, n).astype(np.uint8).tobytes()) for n in (10, 700, 1500)]
    sizes, labels = np.array([10, 700, 1500]), np.array([1, 0, 1])

    def loss():
        p = quality._probability(weights, quality._features(weights, texts, sizes).astype(np.float64))[0]
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    found = quality._gradient(weights, texts, sizes, labels)
    for name in ("hidden", "bias", "out", "shift", "filters"):
        at = np.unravel_index(np.abs(found[name]).argmax(), found[name].shape)
        base, step = weights[name][at], 1e-4
        weights[name][at] = base + step
        up = loss()
        weights[name][at] = base - step
        slope = (up - loss()) / (2 * step)
        weights[name][at] = base
        assert found[name][at] == pytest.approx(slope, rel=0.05, abs=1e-5)


def test_quality_sees_the_whole_text():
    weights = quality.fresh_weights()
    texts = [b"a" * 100_000, b"a" * 99_990 + b"#*$%&|<>!!"]
    a, b = quality._features(weights, [quality.halves(t) for t in texts], np.array([100_000, 100_000]))
    assert not np.allclose(a, b)


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (77, 0), (5, None)], "doc_id long, label int")
    rows = quality.classify(odd_docs(spark), labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.classify(no_docs(spark), labels).count() == 0
    assert quality.classify(odd_docs(spark), labels.limit(0)).count() == len(ROWS)


def test_quality_is_fitted_on_whole_texts(spark, monkeypatch):
    texts = {i: " ".join(f"w{i}x{k}" for k in range(40 * i * i)) for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    given = []
    monkeypatch.setattr(quality, "train", given.extend)
    used = {i: t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 3 != 1}

    def whole(rows):
        return sorted(halves[:, :quality.HALF].tobytes()[:size].decode() for _, halves, size in rows)

    quality.fit(docs, labels)
    assert whole(given) == sorted(used.values()) and max(map(len, used.values())) > 100_000
    # A bound on bytes leaves out documents and cuts none.
    given.clear()
    monkeypatch.setattr(quality, "SAMPLE_BYTES", sum(map(len, used.values())) // 2)
    quality.fit(docs, labels)
    assert 0 < len(given) < len(used) and set(whole(given)) <= set(used.values())
    assert sum(r[2] for r in given) <= quality.SAMPLE_BYTES
    given.clear()
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 0)
    quality.fit(docs, labels)
    assert len(given) == 1 and set(whole(given)) <= set(used.values())


def test_language_on_held_out_documents(spark):
    docs = table(spark, SF_DIR, "documents")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_mixtures_find_the_parts():
    rng = np.random.default_rng(0)
    words = {"x": ["foo", "fab", "fubar"], "y": ["kiki", "koko", "kaki"], "z": ["mum", "mom", "mima"]}
    text = {k: " ".join(rng.choice(v, 400)).encode() for k, v in words.items()}
    counted = []
    for k in words:
        _, bucket, count = language.trigrams([text[k]])
        counted.append(np.bincount(bucket, count, language.BUCKETS) + 0.1)
    chance = np.stack(counted, axis=1)
    model = language.Model(list(words), chance / chance.sum(0))
    mix = text["x"] + b" " + text["y"][:len(text["y"]) // 2]
    doc, bucket, count = language.trigrams([mix, text["z"]])
    _, share = language.mixtures(model, doc, bucket, count)
    assert share[0, 2] == 0 and share[0, 0] > share[0, 1] > 0.2 and share[1].tolist() == [0, 0, 1]


def test_language_odd_rows(spark):
    found = language.identify(odd_docs(spark)).collect()
    assert len(found) == len(ROWS)
    for r in found:
        if r["doc_id"] in (3, 4, 6, 9):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] in (1, 2, 5, 7):
            assert r["lang_pred"] in ("en", "de")
    assert language.identify(no_docs(spark)).count() == 0
    unlabelled = odd_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(unlabelled).collect()} == {"und"}
