"""A search over blocks that know where they lie gives what a full search gives."""

from __future__ import annotations

import numpy as np
import pytest

from forumlens.operators import located, retrieval
from forumlens.operators.located import read_located, retrieve_located, write_located
from forumlens.operators.retrieval import retrieve


def frames(spark, asked, vectors):
    questions = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(asked)], "question_id long, embedding array<double>")
    index = spark.createDataFrame(
        [(f"p{i:04}", None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], "post_id string, embedding array<double>")
    return questions, index


def rows(df):
    return sorted((r["question_id"], r["rank"], r["post_id"], r["score"]) for r in df.collect())


def clusters(rng, n, width=16, centres=12):
    middle = rng.normal(size=(centres, width)) * 4
    return middle[rng.integers(0, centres, n)] + rng.normal(size=(n, width)) * 0.1


@pytest.mark.parametrize("kind", ["clusters", "uniform"])
def test_same_rows_as_the_full_search(spark, tmp_path, kind):
    rng = np.random.default_rng(6)
    vectors = clusters(rng, 600) if kind == "clusters" else rng.normal(size=(600, 16))
    vectors[3] = 0
    vectors[40:60] = vectors[7]          # equals go by id
    odd = [*vectors, None, [], [1.0, 2.0], [2.0, 1.0]]
    asked = [*vectors[rng.integers(0, 600, 25)] * 3, *rng.normal(size=(4, 16)), np.zeros(16), [1.0, 1.0], [1.0, 2.0, 3.0]]
    questions, index = frames(spark, asked, odd)
    table = str(tmp_path / "t")
    write_located(index, table, per_block=30)
    blocks = read_located(spark, table)
    found = retrieve_located(questions, blocks, 5)
    assert rows(found.top) == rows(retrieve(questions, index, 5))
    assert found.top.columns == retrieve(questions, index, 5).columns
    every = 30 * blocks.filter("width = 16").count()
    scored = found.scored.count()
    assert found.scored.distinct().count() == scored
    if kind == "clusters":
        assert scored < 0.35 * every
    else:
        # The defined worst case: no block can be left out, none is scored twice.
        assert 0.9 * every < scored <= every + 2


def test_blocks_are_bounded_and_empty_sides(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(located, "PIVOTS", 3)
    rng = np.random.default_rng(7)
    questions, index = frames(spark, rng.normal(size=(3, 8)), clusters(rng, 200, 8, 2))
    blocks = write_located(index, str(tmp_path / "t"), per_block=20)
    sizes = [r["size"] for r in blocks.select("size").collect()]
    assert sum(sizes) == 200 and max(sizes) <= 30 and len(sizes) >= 10
    assert rows(retrieve_located(questions, blocks, 300).top) == rows(retrieve(questions, index, 300))
    assert retrieve_located(questions.limit(0), blocks).top.count() == 0
    none = write_located(index.limit(0), str(tmp_path / "none"))
    assert retrieve_located(questions, none).top.count() == 0


@pytest.mark.parametrize("some", [False, True])
def test_scores_are_worked_out_whole_only_where_they_may_reach_a_floor(monkeypatch, some):
    rng = np.random.default_rng(8)
    questions, vectors = (retrieval._unit(rng.normal(size=(n, 16))) for n in (40, 3000))
    vectors[100:130] = vectors[7]
    ids, who = rng.permutation(3000), np.arange(0, 40, 3) if some else None
    monkeypatch.setattr(retrieval, "TILE_SCORES", 20_000)
    held, dense = retrieval._Best(40, 5), []
    add = retrieval._Best.add
    monkeypatch.setattr(retrieval._Best, "add", lambda self, scores, *rest: (dense.append(scores.size), add(self, scores, *rest)))
    for at in range(0, 3000, 1000):
        retrieval._search(held, questions, vectors[at:at + 1000], ids[at:at + 1000], who)
    scores = np.round(questions @ vectors.T, 6)
    want = {(q, i) for q in (range(40) if who is None else who) for i in ids[np.lexsort((ids, -scores[q]))[:5]]}
    assert set(zip(held.question.tolist(), held.id.tolist())) == want
    # The first tile alone, of 3000 scores for each question.
    assert sum(dense) <= 20_000 < 3000 * (40 if who is None else len(who))
