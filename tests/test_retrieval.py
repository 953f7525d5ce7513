"""Chunks, vectors and exact search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from forumlens.operators import retrieval as rt
from tests.fixture import combined_row, frame, values


def post(pid, **more):
    return {"id": pid, "subreddit": "A", "author": "x", "created_at": "t", "title": f" T{pid}\n", "selftext": "body ",
            "content": "content", "permalink": f"/{pid}", "score": "1", "downloaded_at": "d", **more}


def said(pid, n, body=None):
    return {"post_id": pid, "comment_rank": str(n), "comment_id": f"{pid}_{n}", "body": f"c{n}" if body is None else body}


def test_chunks(spark):
    posts = frame(spark, [post("1"), post("2", selftext=""), post("3", selftext=None, title=None), post("")])
    comments = frame(spark, [said("1", n) for n in range(12, 0, -1)] + [said("2", 1, " \n"), said("2", 2, " x "), said("", 1)])
    got = dict(values(rt.build_chunks(posts, comments), "post_id", "text"))
    assert got == {
        "1": "Title: T1\nPost: body\n" + "\n".join(f"Comment {n}: c{n}" for n in range(1, 6)),
        "2": "Title: T2\nComment 1: x", "3": "Title: ",
    }
    fallback = dict(values(rt.build_chunks(posts, None, fallback_to_content=True), "post_id", "text"))
    assert fallback["2"] == "Title: T2\nPost: content" and fallback["1"] == "Title: T1\nPost: body"
    assert "Comment 2" not in dict(values(rt.build_chunks(posts, comments, 1), "post_id", "text"))["1"]


def test_chunks_of_combined(spark):
    rows = frame(spark, [
        combined_row("1", "b", "2"), combined_row("1", "a", "1"), combined_row("1", "c", "3", comment_body=" "),
        combined_row("2", post_selftext="", post_content="link"), combined_row("", ""),
    ])
    assert dict(values(rt.chunks_from_combined(rows), "post_id", "text")) == {
        "1": "Title: T\nPost: body\nComment 1: says a\nComment 2: says b", "2": "Title: T\nPost: link"}


def index(spark, vectors, partitions=3):
    rows = [(f"p{i:03}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "post_id string, embedding array<float>").repartition(partitions)


def questions(spark, vectors):
    return spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "question_id long, embedding array<float>")


def by_hand(asked, vectors, k):
    def unit(m):
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, length, out=np.zeros_like(m), where=length > 0)

    scores = np.round(unit(np.float32(asked).astype(float)) @ unit(np.float32(vectors).astype(float)).T, 6) + 0.0
    found = []
    for q, row in enumerate(scores):
        best = sorted((-s, f"p{i:03}") for i, s in enumerate(row))[:k]
        found += [(q, p, -s, rank) for rank, (s, p) in enumerate(best, 1)]
    return found


@pytest.mark.parametrize("k", [1, 4, 50])
@pytest.mark.parametrize("tile, page", [(4_000_000, 1 << 26), (37, 600), (1, 1)])
def test_retrieve_against_brute_force(spark, monkeypatch, k, tile, page):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(43, 6))
    vectors[7] = 0
    vectors[20:26] = vectors[5]          # equals go by id
    vectors[30] = vectors[5] * 3         # only the direction counts
    asked = np.vstack([rng.normal(size=(21, 6)), vectors[5], np.zeros(6)])
    monkeypatch.setattr(rt, "TILE_SCORES", tile)
    monkeypatch.setattr(rt, "PAGE_BYTES", page)
    got = rt.retrieve(questions(spark, asked), index(spark, vectors), k).collect()
    want = by_hand(asked, vectors, k)
    assert sorted((r.question_id, r["rank"], r.post_id) for r in got) == sorted((q, rank, p) for q, p, _, rank in want)
    scores = {(q, p): s for q, p, s, _ in want}
    assert all(r.score == pytest.approx(scores[r.question_id, r.post_id], abs=1e-6) for r in got)


def test_retrieve_edges(spark):
    some, asked = index(spark, np.eye(3)), questions(spark, np.eye(3)[:1])
    assert rt.retrieve(asked, some, 10).count() == 3
    assert rt.retrieve(asked, some, 0).count() == rt.retrieve(asked, some, -1).count() == 0
    assert rt.retrieve(asked, some.limit(0), 5).count() == 0
    assert rt.retrieve(asked.limit(0), some, 5).count() == 0
    assert rt.retrieve(asked, some, 0).columns == rt.retrieve(asked, some, 2).columns


def test_context_and_sources(spark):
    chunks = frame(spark, [{"post_id": f"p00{i}", "subreddit": s, "title": f"t{i}", "text": f"text {i}", "permalink": f"/{i}"}
                           for i, s in enumerate(["A", None, "C"])])
    top = rt.with_chunks(rt.retrieve(questions(spark, np.eye(3)[:2]), index(spark, np.eye(3)), 2), chunks)
    got = dict(values(rt.context(top)))
    assert got[0] == "[r/A | p000 | /0]\ntext 0\n\n---\n\n[r/unknown | p001 | /1]\ntext 1"
    assert got[1] == "[r/unknown | p001 | /1]\ntext 1\n\n---\n\n[r/A | p000 | /0]\ntext 0"
    assert sorted(values(rt.sources(top)))[0] == (0, 1, "A", "p000", "/0", "t0")


def test_default_vectors(spark):
    texts = spark.createDataFrame([("a", "One two, two"), ("b", "TWO one two!"), ("c", "éß"), ("d", "...")], "id string, text string")
    got = {r.id: np.array(r.embedding) for r in rt.embed(texts, dimensions=64).collect()}
    assert np.array_equal(got["a"], got["b"]) and not np.array_equal(got["a"], got["c"])
    assert [len(v) for v in got.values()] == [64] * 4
    assert [round(float(np.linalg.norm(got[i])), 5) for i in "abcd"] == [1, 1, 1, 0]
    assert sorted(np.unique(got["a"])) == pytest.approx([0, 1 / 5 ** 0.5, 2 / 5 ** 0.5])
    assert dict(rt.embed(texts).dtypes)["embedding"] == "array<float>"


def test_injected_embedder_gets_small_batches(spark):
    def embedder(texts):
        assert len(texts) <= 50
        return [[len(t), len(texts)] for t in texts]

    df = spark.range(130).select(F.col("id").cast("string").alias("text")).coalesce(1)
    got = values(rt.embed(df, "text", embedder), "text", "embedding")
    assert all(v[0] == len(t) for t, v in got) and sorted({v[1] for _, v in got}) == [30, 50]


def test_build_index(spark):
    df = rt.build_index(index(spark, [[3, 4], [0, 0]]))
    assert sorted((r.norm, [round(x, 6) for x in r.embedding]) for r in df.collect()) == [(0.0, [0, 0]), (5.0, [0.6, 0.8])]


def test_the_norm_is_not_worked_out_per_element(spark):
    chunks = spark.createDataFrame([("a", "one two"), ("b", ""), ("c", None)], "post_id string, text string")
    buckets = rt.build_index(rt.embed(chunks)).select("post_id", F.posexplode("embedding").alias("bucket", "weight")).filter("weight > 0")
    assert values(buckets.groupBy("post_id").count()) == [("a", 2)]
    # Spark moves a filter on the vector down to where it is made; the length is then no part of a lambda.
    plan = buckets._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (size(" in plan and "CASE WHEN (SQRT(" not in plan


def test_vectors_without_a_length(spark):
    df = spark.createDataFrame([(0, None), (1, []), (2, [1.0, None]), (3, [0.0, 0.0])], "n int, embedding array<float>")
    got = {r.n: (r.embedding, r.norm) for r in rt.build_index(df).collect()}
    assert got == {0: (None, None), 1: ([], 0.0), 2: ([None, None], None), 3: ([0.0, 0.0], 0.0)}
