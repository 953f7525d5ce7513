from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from forumlens.llm import neardup
from forumlens.llm.components import components
from tests.llm.odd import ROWS, no_docs, odd_docs


def sets_of(texts, width):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        out.append({(len(w) if k < width else width, *w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    return out


def brute(rows, width, percent=80):
    """Component of each row by comparing all pairs."""
    ids, sets = [r[0] for r in rows], sets_of([r[1] for r in rows], width)
    parent = {i: i for i in ids if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if None in (ids[a], ids[b]) or not sets[a] or not sets[b]:
                continue
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(ids[a]), root(ids[b])))
                parent[y] = x
    return sorted(
        ((i, len(s), root(i) if i is not None else None, i is None or root(i) == i) for i, s in zip(ids, sets)), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def mutated(seed, groups=4, copies=40, words=60):
    """Groups of copies around the limit of similarity, so that many pairs just miss it."""
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(300)}" for _ in range(words)]
        for c in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
                text[rng.randrange(words)] = f"x{rng.randrange(10_000)}"
            rows.append((g * 1000 + rng.randrange(10_000_000), " ".join(text), "en", "s"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_components_match_brute_force(spark, width):
    rows = mutated(width)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert result(neardup.near_duplicates(df, width=width)) == brute(rows, width)


def test_blocks_of_a_large_host_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 500)
    rows = mutated(11, groups=2, copies=60)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert result(neardup.near_duplicates(df, width=2)) == brute(rows, 2)


def test_odd_rows(spark):
    assert result(neardup.near_duplicates(odd_docs(spark), width=2)) == brute(ROWS, 2)
    assert neardup.near_duplicates(no_docs(spark)).count() == 0


def test_one_id_with_several_texts_is_one_document(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [
        (2, a), (10, a), (10, b), (11, b + " more"), (20, c), (21, c), (21, None), (22, ""), (22, c),
        (30, "x y z"), (31, "p q r"), (32, "x y z"), (32, "p q r"), (32, ""), (None, a),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = result(neardup.near_duplicates(df, width=2))
    assert found == brute(rows, 2)
    assert {r[2] for r in found if r[0] in (2, 10, 11)} == {2} and {r[2] for r in found if r[0] in (30, 31, 32)} == {30}


def test_empty_texts_of_ids_in_open_buckets(spark):
    rows = mutated(2, groups=2, copies=40)
    rows += [(i, t, "en", "s") for i, *_ in rows[:40] for t in ("", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert result(neardup.near_duplicates(df, width=2)) == brute(rows, 2)
    group = pa.table({
        "host": [1, 1, 1], "p": [0, 0, 0], "q": [0, 0, 0], "doc_id": [1, 2, 2], "label": [1, 2, 2], "block": [0, 0, 0],
        "text": ["a b c", "a b c", ""]})
    assert neardup._compare(2, 80)(group).to_pylist() == [{"u": 2, "v": 1}]


def test_pi_is_a_permutation_and_signatures_estimate_similarity():
    y = np.arange(1 << 16, dtype=np.uint32)
    assert len(np.unique(neardup._pi(y.copy()))) == len(y)
    rng = np.random.default_rng(3)
    common = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 100, dtype=np.uint64)])) for _ in range(2))
    s = neardup.circulant_signatures([a, b], 512)
    assert abs((s[:, 0] == s[:, 1]).mean() - 0.8) < 0.08


def test_chain_and_star_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100 + i, 100) for i in range(1, 50)] + [(7, 7), (None, 3)]
    found = dict(map(tuple, components(spark.createDataFrame(chain, "u long, v long")).collect()))
    assert all(found[i] == 1 for i in range(1, 41)) and all(found[100 + i] == 100 for i in range(50))
    assert len(found) == 90


def test_comparing_a_block_holds_few_copies_of_it(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 62, 20_000).astype(np.uint64)) for _ in range(40)]
    sets += [sets[0][:15_000], sets[1]]
    whole = sum(s.nbytes for s in sets)
    want = np.unique(np.concatenate(sets), return_inverse=True)
    tracemalloc.start()
    places, size = neardup._places(list(sets))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size == len(want[0]) and np.array_equal(places, want[1])
    assert peak < 3.2 * whole
    back = []
    monkeypatch.setattr(neardup, "hand_back", lambda: back.append(1))
    monkeypatch.setattr(neardup, "SLICE_BYTES", 10)
    texts = ["a b c d e f g h", "a b c d e f g h i", None, "x y"]
    group = pa.table({
        "doc_id": [1, 2, 3, 4], "label": [1, 2, 3, 4], "block": [0, 0, 0, 0], "host": [1] * 4, "p": [0] * 4, "q": [0] * 4,
        "text": texts})
    assert neardup._compare(2, 80)(group).to_pylist() == [{"u": 2, "v": 1}] and back
