"""Periodic runs against a search that tries every period at every word."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from forumlens.llm import runs
from forumlens.llm.queries import op12_periodic_runs
from tests.llm.odd import ROWS, no_docs, odd_docs


def every_run(words):
    """(start, length, period) of every run, by the definition."""
    ids = np.unique(words, return_inverse=True)[1]
    found = {}
    for q in range(1, len(words) // 4 + 1):
        equal = np.concatenate([[0], ids[:-q] == ids[q:], [0]])
        for i, j in np.flatnonzero(np.diff(equal)).reshape(-1, 2).tolist():
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)  # the smallest period comes first
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def wanted(doc_id, text, planted=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if planted and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = every_run(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    told = "".join("%d,%d,%d\n" % r for r in found)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def some_words(rng):
    words = []
    while rng.random() < 0.8 and len(words) < 150:
        kind = rng.randrange(4)
        if kind == 0:
            words += [rng.randrange(3) for _ in range(rng.randrange(20))]
        elif kind == 1:
            words += ([rng.randrange(4) for _ in range(rng.randrange(1, 7))] * rng.randrange(1, 9))[:rng.randrange(1, 60)]
        elif kind == 2 and words:
            i = rng.randrange(len(words))
            words += words[i:i + rng.randrange(40)]
        else:
            words += [rng.randrange(50) for _ in range(rng.randrange(10))]
    return words


def found_in(texts):
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return list(zip(*(c.tolist() for c in runs.all_runs(np.array(sum(texts, []), np.int64), doc))))


def expected_in(texts):
    base, out = 0, []
    for words in texts:
        out += [(base + s, n, q) for s, n, q in every_run(words)]
        base += len(words)
    return out


def test_runs_of_small_texts():
    rng = random.Random(11)
    for _ in range(600):
        texts = [some_words(rng) for _ in range(rng.randrange(1, 5))]
        assert found_in(texts) == expected_in(texts), texts


def test_wrong_hashes_do_not_matter(monkeypatch):
    monkeypatch.setattr(runs, "mixed", lambda x: x & np.uint64(1))
    rng = random.Random(12)
    for _ in range(200):
        texts = [some_words(rng) for _ in range(2)]
        assert found_in(texts) == expected_in(texts), texts


def test_grammar_spells_the_texts_and_shares_copies():
    rng = random.Random(13)
    text = [rng.randrange(40) for _ in range(400)]
    texts = [text, text, [1], [], text[:300] + [41]]
    ids = np.array(sum(texts, []), np.int64)
    grammar, top, place = runs.compress(ids, np.repeat(np.arange(5), [len(t) for t in texts]))
    left, right, length, where = grammar.closed()

    def spelled(symbol):
        return [symbol] if left[symbol] < 0 else spelled(left[symbol]) + spelled(right[symbol])

    assert [spelled(s) for s in top] == [t for t in texts if t]
    assert all(spelled(s) == ids[where[s]:where[s] + length[s]].tolist() for s in range(grammar.words, grammar.size))
    assert grammar.size - grammar.words < 700 < len(ids)


@pytest.mark.parametrize("words, run", [
    ([0] * 300_000, (0, 300_000, 1)), (list(range(700)) * 300, (0, 210_000, 700)),
    (np.random.default_rng(0).integers(0, 10**6, 300_000).tolist(), None),
])
def test_long_texts(words, run):
    assert found_in([words]) == ([run] if run else [])


def test_every_row(spark):
    rows = sorted((tuple(r) for r in runs.periodic_runs(odd_docs(spark), planted=True).collect()), key=repr)
    assert rows == sorted((wanted(i, t) for i, t, _, _ in ROWS), key=repr)
    assert runs.periodic_runs(no_docs(spark)).count() == 0


def test_op12_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = sorted(tuple(r) for r in op12_periodic_runs(spark, "/root/testdata/sf0.001").collect())
    assert rows == sorted(wanted(i, t) for i, t in docs) and any(r[1] for r in rows)
