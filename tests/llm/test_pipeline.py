"""Filtering stages by rows: repeated and missing ids, and what a plan shuffles."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from forumlens.llm import language, quality
from forumlens.llm.common import table
from tests.llm.odd import PLAIN, ROWS, odd_docs

SF_DIR = "/root/testdata/sf0.001"
NAMES = ["doc_id", "text", "lang", "source"]


def rows(df):
    return Counter(tuple(r) for r in df.select(*NAMES).collect())


def mixed_docs(spark):
    """Given rows, twice under one id, once without an id, next to the odd ones."""
    docs = table(spark, SF_DIR, "documents").select(*NAMES)
    few = docs.limit(40).collect()
    junk = "### %% 00 !!! $$$ |||"
    extra = [tuple(r) for r in few] + [(few[i]["doc_id"], junk * 30, "en", "x") for i in range(5)]
    extra += [(None, r["text"], r["lang"], r["source"]) for r in few[:6]] + [(None, junk * 30, "en", "x")]
    made = spark.createDataFrame([*extra, *ROWS], odd_docs(spark).select(*NAMES).schema)
    return docs.unionByName(made)


def test_models_judge_every_row(spark):
    docs = mixed_docs(spark)
    labels = table(spark, SF_DIR, "labels").selectExpr("doc_id", "quality AS label")
    weights, model = quality.fit(docs, labels), language.fit(docs)
    whole = [tuple(r) for r in docs.collect()]
    texts = [None if r[1] is None else r[1].encode() for r in whole]
    good = [quality.score(weights, [t])[0] >= 0.5 for t in texts]
    assert rows(corpus_pipeline.quality_classifier(spark, docs, SF_DIR)) == Counter(r for r, g in zip(whole, good) if g)
    assert 0 < sum(good) < len(whole)
    known = []
    for t in texts:
        names, scores = language.predict(model, [t])
        known.append(names[0] != language.UNKNOWN and scores[0] >= corpus_pipeline.LANGUAGE_SHARE)
    assert rows(corpus_pipeline.language_id(spark, docs, SF_DIR)) == Counter(r for r, k in zip(whole, known) if k)


def test_models_shuffle_no_text(spark):
    docs = table(spark, SF_DIR, "documents")
    for _, stage in corpus_pipeline.STAGES[:2]:
        plan = stage(spark, docs, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan and "MapInArrow" in plan


def test_near_dedup_keeps_one_row_of_a_group(spark):
    docs = odd_docs(spark)
    kept = rows(corpus_pipeline.near_dedup(spark, docs, SF_DIR))
    # Ids 1 (twice), 2 and NULL share a text: one row of id 1 stays. The rest stands alone, rows without a word too.
    wanted = Counter(r for r in ROWS if r[1] is None or not r[1].startswith(PLAIN.strip()[:20])) + Counter([ROWS[0]])
    assert kept == wanted
    near = spark.createDataFrame([
        (None, PLAIN), (9, PLAIN + "more"), (9, PLAIN), (4, "quite another text that shares nothing with it"), (4, PLAIN)], "doc_id long, text string")
    assert Counter(tuple(r) for r in corpus_pipeline.near_dedup(spark, near, SF_DIR).collect()) == Counter(
        [(4, PLAIN), (4, "quite another text that shares nothing with it")])


def test_results_do_not_hang_on_neighbours(spark):
    docs = table(spark, SF_DIR, "documents")
    model = language.fit(docs)
    texts = [r[0].encode() for r in docs.select("text").limit(60).collect()]
    names, scores = language.predict(model, texts)
    for i, t in enumerate(texts):
        alone = language.predict(model, [t])
        assert alone[0][0] == names[i] and abs(alone[1][0] - scores[i]) < 1e-9
