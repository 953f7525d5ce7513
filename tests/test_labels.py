"""The label queue, labelers and what is made of their answers."""

from __future__ import annotations

import re
import time
from collections import Counter
from types import SimpleNamespace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from forumlens import fixed, schemas
from forumlens.operators import labels as lb
from forumlens.plans import steps
from forumlens.plans.steps import label_step
from forumlens.sources.deltas import KeyedTable
from tests.fixture import evidence, labels, values


def test_queue(spark):
    rows = evidence(spark).withColumn("text", F.when(F.col("score") == 1, "0123456789").when(
        F.col("score") != 2, F.lit("0123456789a")))
    rows = rows.withColumn("created_at", F.when(F.col("score") != 3, F.col("created_at")))
    done = labels(spark).filter("evidence_id > 'post_006'")
    assert sorted(values(lb.label_queue(rows, done), "evidence_id")) == [("post_003",), ("post_004",), ("post_005",), ("post_006",)]
    assert values(lb.label_queue(rows, done, limit=2), "evidence_id") == [("post_004",), ("post_005",)]
    assert values(lb.label_queue(rows, done, limit=9), "evidence_id")[-1] == ("post_003",)
    assert lb.label_queue(rows, done, limit=0).count() == 4
    assert lb.label_queue(rows, done, source_type="comment").count() == 0


def test_estimate_and_progress(spark):
    queue = evidence(spark)
    row = lb.label_estimate(queue, workers=8).first()
    assert (row.pending, row.calls, row.input_tokens, row.output_tokens) == (20, 20.0, 14000.0, 2400.0)
    assert row.estimated_cost_usd == pytest.approx(20 * 0.000177) and row.estimated_minutes == pytest.approx(5 / 60)
    none, all_ = labels(spark).limit(0), labels(spark)
    assert values(lb.label_progress(queue, none), "state") == [("missing",)]
    assert values(lb.label_progress(queue, all_.limit(3)), "state") == [("partial",)]
    assert values(lb.label_progress(queue, all_), "state") == [("done",)]


def test_prompt(spark):
    df = spark.createDataFrame([("1", "A", "T", "x" * 3000), ("2", None, None, None)], "evidence_id string, subreddit string, title string, text string")
    got = dict(values(lb.with_prompt(df), "evidence_id", "prompt"))
    assert got == {"1": "r/A\nTitle: T\n\n" + "x" * 3000, "2": "r/\nTitle: \n\n"}


ANSWERS = [
    ("full", 'Here: {"brand": "GMC", "model": "Sierra", "powertrain": "EV", "is_pain_point": true, "pain_theme": "recall", '
     '"is_delight": false, "delight_theme": null, "sentiment": "negative", "confidence": 0.8}\nDone', None),
    ("empty", "{}", None),
    ("texts", '{"is_pain_point": "TRUE", "is_delight": "false", "pain_theme": "null", "delight_theme": "", "confidence": "high"}', None),
    ("range", '{"confidence": 7, "brand": null, "sentiment": "' + "s" * 30 + '"}', None),
    ("below", '{"confidence": -1, "is_pain_point": 1}', None),
    ("broken", '{"brand": ', None),
    ("words", "no json at all", None),
    ("list", "[1, 2]", None),
    ("late", None, "TimeoutError: slow"),
]


def test_parse_labels(spark):
    good, bad = lb.parse_labels(spark.createDataFrame(ANSWERS, "evidence_id string, raw string, error string"))
    got = {r.evidence_id: tuple(r)[1:] for r in good.collect()}
    assert got["full"] == ("GMC", "Sierra", "EV", True, "recall", False, None, "negative", pytest.approx(0.8))
    assert got["empty"] == ("unknown", "unknown", "unknown", False, None, False, None, "neutral", 0.5)
    assert got["texts"][3:7] == (True, None, False, None) and got["texts"][-1] == 0.5
    assert got["range"][0] == "unknown" and got["range"][-1] == 1.0 and got["range"][-2] == "s" * 30
    assert got["below"][-1] == 0.0 and got["below"][3] is False
    assert sorted(values(bad, "evidence_id")) == [("broken",), ("late",), ("list",), ("words",)]
    assert good.dtypes == [(f.name, f.dataType.simpleString()) for f in schemas.LABELS]
    cut, _ = lb.parse_labels(spark.createDataFrame(ANSWERS, "evidence_id string, raw string, error string"), widths=fixed.LABEL_WIDTHS)
    assert {r.sentiment for r in cut.filter("evidence_id = 'range'").collect()} == {"s" * 20}


def labeler(prompt):
    if "number 3" in prompt:
        raise RuntimeError("refused")
    return '{"brand": "Buick", "confidence": 1}'


def test_ask_labeler(spark):
    good, bad = lb.label_evidence(evidence(spark).limit(5), labeler, backoff=0.0, workers=3, partitions=2)
    assert sorted(values(good, "evidence_id", "brand")) == [(f"post_00{n}", "Buick") for n in (1, 2, 4, 5)]
    assert values(bad) == [("post_003", "RuntimeError: refused")]


def test_a_run_tells_what_failed(spark, tmp_path):
    told = steps.label_run(evidence(spark).limit(5), str(tmp_path / "labels"), str(tmp_path / "answers"), labeler)
    assert told.labels.count() == 4 and values(told.counts) == [(4, 1)]
    assert values(told.failures) == [("post_003", "RuntimeError: refused")]
    rules = steps.label_run(evidence(spark).limit(5), str(tmp_path / "rules"))
    assert values(rules.counts) == [(5, 0)] and rules.failures.count() == 0


def test_long_texts_and_values_stay_whole(spark):
    long = " ".join(["word"] * 20_000)
    df = spark.createDataFrame([("1", "A", "T", long)], "evidence_id string, subreddit string, title string, text string")
    assert values(lb.with_prompt(df), "prompt")[0][0].endswith(long)
    assert values(lb.with_prompt(df, 100), "prompt")[0][0].endswith("word " * 20)
    raw = df.select("evidence_id", *[F.lit("x" * 300).alias(c) for c in lb.RAW_FIELDS])
    assert [len(v) for v in values(lb.coerce_labels(raw), "brand", "model", "powertrain", "sentiment")[0]] == [300] * 4
    cut = lb.coerce_labels(raw, widths=fixed.LABEL_WIDTHS)
    assert [len(v) for v in values(cut, "brand", "model", "powertrain", "sentiment")[0]] == [50, 100, 20, 20]


def test_a_labeler_is_asked_again(spark, tmp_path):
    folder = tmp_path

    def flaky(prompt):
        mark = folder / str(abs(hash(prompt)))
        if not mark.exists():
            mark.write_text("")
            raise ConnectionError("first time")
        return "{}"

    good, bad = lb.label_evidence(evidence(spark).limit(3), flaky, backoff=0.0)
    assert good.count() == 3 and bad.count() == 0


def test_rules(spark):
    texts = [
        ("ev", "My Chevy Bolt battery failed", "Chevy", "Bolt", "EV", True, "other", "negative"),
        ("ice", "Sierra transmission is grinding, dealer service terrible", "GMC", "Sierra", "ICE", True, "transmission", "negative"),
        ("phev", "plug-in hybrid lyriq, love it", "Cadillac", "Lyriq", "PHEV", False, None, "positive"),
        ("none", "gmcx sierras failedx clover", "unknown", "unknown", "unknown", False, None, "neutral"),
        ("both", "GM: great truck, terrible price", "GM", "unknown", "ICE", True, "pricing", "mixed"),
        ("phrase", "general  motors and general motors.", "GM", "unknown", "ICE", False, None, "neutral"),
    ]
    df = spark.createDataFrame([(i, "", t) for i, t, *_ in texts], "evidence_id string, title string, text string")
    got = {r.evidence_id: r for r in lb.rule_labels(df).collect()}
    for name, _, brand, model, power, pain, theme, felt in texts:
        r = got[name]
        assert (r.brand, r.model, r.powertrain, r.is_pain_point, r.pain_theme, r.sentiment) == (brand, model, power, pain, theme, felt)
    assert lb.rule_labels(df).dtypes == [(f.name, f.dataType.simpleString()) for f in schemas.LABELS]
    good, bad = lb.label_evidence(df)
    assert good.count() == 6 and bad.count() == 0


def test_rules_stay_in_the_label_domains():
    assert set(lb.BRAND_WORDS) <= set(fixed.BRANDS) and set(lb.POWERTRAIN_WORDS) <= set(fixed.POWERTRAINS)
    assert set(lb.PAIN_WORDS) <= set(fixed.PAIN_THEMES) and set(lb.DELIGHT_WORDS) <= set(fixed.DELIGHT_THEMES)


WORD = st.sampled_from(["ev", "bolt", "dealer", "great dealer", "plug-in hybrid", "x", "evs", "-", " ", "  ", ".", "é", "EV"])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.lists(WORD, max_size=8).map("".join), min_size=1, max_size=30))
def test_mentions_are_words_standing_alone(spark, texts):
    words = ["ev", "bolt", "great dealer", "plug-in hybrid"]
    said = lb.Mentions(words)
    df = spark.createDataFrame(list(enumerate(texts)), "n long, t string")
    got = dict(values(said.prepare(df, F.col("t")).select("n", said.any_of(words).alias("hit"))))
    alone = re.compile("(^|[^a-z0-9])(" + "|".join(map(re.escape, words)) + ")([^a-z0-9]|$)")
    assert got == {n: bool(alone.search(t.lower())) for n, t in enumerate(texts)}


def test_clear(spark):
    rows = evidence(spark).withColumn("source_type", F.when(F.col("score") < 5, "comment").otherwise("post"))
    assert lb.clear_labels(labels(spark), rows, "comment").count() == 16
    assert lb.clear_labels(labels(spark), rows).count() == 0
    assert lb.clear_labels(labels(spark), rows, "post").columns == labels(spark).columns


def test_label_step_labels_only_what_is_open(spark, tmp_path):
    table = str(tmp_path / "labels")
    assert label_step(evidence(spark), table, limit=7).count() == 7
    done = label_step(evidence(spark), table, str(tmp_path / "answers"), labeler)
    assert done.count() == 20 and done.filter("brand = 'Buick'").count() == 13
    assert label_step(evidence(spark), table).count() == 20
    with pytest.raises(ValueError):
        label_step(evidence(spark), table, labeler=labeler)


def counting_labeler(folder, allowed):
    """A labeler that notes every prompt it answers, and is down after some of them."""
    def ask(prompt):
        import glob
        import hashlib
        import os
        import uuid

        if len(glob.glob(f"{folder}/*")) >= allowed:
            raise lb.LabelerDown("spent")
        open(os.path.join(folder, f"{hashlib.md5(prompt.encode()).hexdigest()}-{uuid.uuid4().hex}"), "w").close()
        return "no json" if "number 3" in prompt else '{"brand": "Buick"}'

    return ask


def asked(folder):
    import os

    return [name.split("-")[0] for name in os.listdir(folder)]


def test_a_run_that_dies_asks_nothing_twice(spark, tmp_path):
    notes, table, answers = tmp_path / "notes", str(tmp_path / "labels"), str(tmp_path / "answers")
    notes.mkdir()
    for allowed in (7, 12):
        with pytest.raises(lb.LabelerDown):
            steps.label_run(evidence(spark), table, answers, counting_labeler(str(notes), allowed), run_id="r", chunk=5)
        assert allowed <= len(asked(notes)) == len(set(asked(notes))) < 20
        assert KeyedTable(spark, table, "evidence_id").read() is None
    done = steps.label_run(evidence(spark), table, answers, counting_labeler(str(notes), 99), run_id="r", chunk=5)
    assert len(asked(notes)) == len(set(asked(notes))) == 20
    assert done.labels.count() == 19 and values(done.counts) == [(19, 1)] and values(done.failures, "evidence_id") == [("post_003",)]
    # The same run again asks nothing, another one asks the failure once more.
    again = steps.label_run(evidence(spark), table, answers, counting_labeler(str(notes), 99), run_id="r", chunk=5)
    assert len(asked(notes)) == 20 and again.labels.count() == 19
    steps.label_run(evidence(spark), table, answers, counting_labeler(str(notes), 99), chunk=5)
    assert len(asked(notes)) == 21 and len(set(asked(notes))) == 20


def test_answers_of_a_killed_run_are_kept(spark, tmp_path, monkeypatch):
    """Killed after some chunks were committed: those are not asked again."""
    notes, table, answers = tmp_path / "notes", str(tmp_path / "labels"), str(tmp_path / "answers")
    notes.mkdir()
    kept, commits = KeyedTable.upsert, []

    def killed(self, *args, **options):
        if len(commits) == 2:
            raise KeyboardInterrupt
        commits.append(1)
        return kept(self, *args, **options)

    monkeypatch.setattr(KeyedTable, "upsert", killed)
    with pytest.raises(KeyboardInterrupt):
        steps.label_run(evidence(spark), table, answers, counting_labeler(str(notes), 99), chunk=5)
    monkeypatch.setattr(KeyedTable, "upsert", kept)
    logged = KeyedTable(spark, answers, "evidence_id").read().count()
    first = len(asked(notes))
    assert 0 < logged < first <= 20
    done = steps.label_run(evidence(spark), table, answers, counting_labeler(str(notes), 99), chunk=50)
    assert done.labels.count() == 19 and 20 - logged <= len(asked(notes)) - first <= 21 - logged


def test_prompts_that_fail_hold_up_no_other(spark, tmp_path, monkeypatch):
    """Waits of failures are shared: by all of a batch, and in a run by later chunks."""
    (notes := tmp_path / "notes").mkdir()

    def refusing(prompt):
        import hashlib
        import os
        import uuid

        open(os.path.join(str(notes), f"{hashlib.md5(prompt.encode()).hexdigest()}-{uuid.uuid4().hex}"), "w").close()
        raise RuntimeError("refused")

    began = time.monotonic()
    _, bad = lb.label_evidence(evidence(spark), refusing, workers=1, partitions=1, backoff=1.0)
    # One wait of 1 s and one of 2 s for all twenty.
    assert bad.filter("error = 'RuntimeError: refused'").count() == 20 and 3 <= time.monotonic() - began < 20
    assert Counter(Counter(asked(notes)).values()) == {3: 20}
    tasks, slept = [], []
    kept = steps.ask_once
    monkeypatch.setattr(steps, "ask_once", lambda prompts, *a: tasks.append(prompts.count()) or kept(prompts, *a))
    clock = SimpleNamespace(monotonic=time.monotonic, sleep=lambda s: slept.append(s) or time.sleep(s))
    monkeypatch.setattr(steps, "time", clock)
    done = steps.label_run(evidence(spark), str(tmp_path / "labels"), str(tmp_path / "answers"), refusing, run_id="r", chunk=4)
    assert done.failures.count() == 20 and done.labels.count() == 0
    assert Counter(Counter(asked(notes)).values()) == {6: 20} and sum(tasks) == 60
    # Five chunks at most; what failed in them goes with the next ones, and waits only after the last.
    assert sum(slept) <= 3 and len(tasks) <= 5 + 2 * 3


def test_an_update_lists_nothing_stored(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a", 1)], "evidence_id string, n int")
    table = KeyedTable(spark, str(tmp_path / "t"), "evidence_id")
    table.upsert(rows)
    monkeypatch.setattr(KeyedTable, "read", None)
    table.upsert(rows.withColumn("n", F.lit(2)))
    monkeypatch.undo()
    assert values(table.read()) == [("a", 2)]
