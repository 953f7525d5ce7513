"""License scan, chats, line rules, top-k search and the pipeline against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from forumlens.llm import chat, licenses, lines, topk
from forumlens.llm.common import table
from tests.llm.odd import LONG, ROWS, no_docs, odd_docs
from tests.llm.test_neardup import brute

SF_DIR = "/root/testdata/sf0.001"


# --- licenses -------------------------------------------------------------

def license_brute(rows):
    def shingles(text):
        w = [x.rstrip(".") for x in re.split("[^a-z0-9.]+", text.lower())]
        w = [x for x in w if x]
        return {tuple(w[i:i + 3]) for i in range(len(w) - 2)}

    known = {k: shingles(t) for k, t in licenses.TEMPLATES.items()}
    return sorted((
        (doc_id, k, len(own & shingles(text)), len(own)) for doc_id, text in rows if text is not None for k, own in known.items()
        if 100 * len(own & shingles(text)) >= 80 * len(own)), key=repr)


def test_licenses_match_containment(spark):
    rng = random.Random(4)
    rows = [(i, r) for i, r in enumerate(r[1] for r in ROWS)]
    for i in range(120):
        notice = rng.choice(list(licenses.TEMPLATES.values())).split()
        for _ in range(rng.randrange(3)):
            notice[rng.randrange(len(notice))] = "changed"
        around = ["the", "license", "of", "version", "word", "under"] * 40
        at = rng.randrange(len(around))
        rows.append((1000 + i, " ".join(around[:at] + notice + around[at:])))
    rows.append((5000, LONG + ". " + licenses.TEMPLATES["MIT-notice"].upper() + "... end"))
    rows.append((5000, licenses.TEMPLATES["MIT"]))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("clash")).withColumn("row", F.lit(1))
    found = sorted((tuple(r) for r in licenses.scan(df).select("doc_id", "license", "shared", "shingles").collect()), key=repr)
    assert found == license_brute(rows) and len(found) > 60
    assert licenses.scan(no_docs(spark)).count() == 0
    assert licenses.scan(df, templates={"short": "too short"}).count() == 0


def test_license_lines_of_the_documents_are_found(spark):
    """Lines as they stand in the documents, whatever TEMPLATES holds."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    told = re.compile(r"\blicen[sc]e|rights reserved|copyright", re.I)
    wanted = defaultdict(set)
    for doc_id, text in docs.select("doc_id", "text").collect():
        for line in (text or "").split("\n"):
            if told.search(line):
                wanted[line].add(doc_id)
    assert "All rights reserved." in wanted and len(wanted) >= 5
    found = defaultdict(set)
    for r in licenses.scan(docs).collect():
        found[r["license"]].add(r["doc_id"])
    assert found["All-rights-reserved"] == wanted["All rights reserved."]
    assert all(any(ids <= have for have in found.values()) for ids in wanted.values())


def test_no_short_template_is_missed(spark):
    rng = random.Random(6)
    rows, wanted = [], set()
    for i in range(1500):
        words = [f"w{rng.randrange(1_000_000)}" for _ in range(30)]
        at = rng.randrange(28)
        if i % 3 == 0:
            words[at:at] = ["one", "two", "three"]
            wanted.add((i, "one", 1, 1))
        elif i % 3 == 1:
            words[at:at] = ["red", "green", "blue", "white"]
            wanted.add((i, "two", 2, 2))
        else:
            words = ["red", "green", "blue", *words, "green", "blue", "white"]
            wanted.add((i, "two", 2, 2))
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    templates = {"one": "one two three", "two": "red green blue white"}
    found = {tuple(r) for r in licenses.scan(df, templates=templates).select("doc_id", "license", "shared", "shingles").collect()}
    assert found == wanted


# --- chats ----------------------------------------------------------------

def test_fold_of_deltas_edits_and_regenerations(spark):
    events = [
        (1, 0, 0, 0, "start", "user"), (1, 0, 0, 1, "delta", "Hel"), (1, 0, 0, 2, "delta", "lo"),
        (1, 1, 1, 0, "start", "assistant"), (1, 1, 1, 1, "delta", "bad"), (1, 1, 1, 2, "regenerate", None),
        (1, 1, 1, 3, "delta", "go"), (1, 1, 1, 4, "delta", "od"), (1, 2, 2, 0, "start", "user"), (1, 2, 2, 1, "delta", "x"),
        (1, 2, 2, 2, "edit", "new"), (1, 2, 2, 3, "delta", "!"), (2, 0, 3, 5, "delta", "no start"), (2, 1, 4, 0, "regenerate", None),
    ]
    random.Random(1).shuffle(events)
    log = spark.createDataFrame(events, "conv_id long, turn long, message long, seq int, kind string, text string")
    found = {r["message"]: (r["role"], r["text"]) for r in chat.messages(log.withColumn("log", F.lit(1))).collect()}
    assert found == {0: ("user", "Hello"), 1: ("assistant", "good"), 2: ("user", "new!"), 3: ("", "no start"), 4: ("", "")}


def test_chats_round_trip(spark):
    rng = random.Random(3)
    bits = ["</turn>\n", "<turn assistant>\n", "\\", "\\s", "\\l", "<", ">\n", "é🙂", " ", "\n", "### ", "\\\\"]
    rows = [(c, t, rng.choice(["user", "assistant", "sys>\n\\tem<", None]), rng.choice([None, "", *[
        "".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(5)]])) for c in [1, 2, 3, None] for t in range(150)]
    rows += [(4, None, "user", "a"), (4, None, "assistant", "b"), (4, 0, "user", "c"), (4, 0, "user", "c"), (5, 0, "assistant", "é" * 5000)]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit(1))
    found = chat.format_chats(chat.messages(chat.turn_events(turns)))
    found = found.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(
        F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted").collect()
    wanted = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        wanted[c].append((role or "", text or ""))
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in found} == wanted
    assert {r["conv_id"]: r["loss"] for r in found} == {c: "".join(t for role, t in m if role == "assistant") for c, m in wanted.items()}
    empty = turns.limit(0)
    assert chat.format_chats(chat.messages(chat.turn_events(empty))).count() == 0


# --- line rules -------------------------------------------------------------

def rules_brute(rows, limit):
    def split(text):
        return re.findall("[^\x20\x09-\x0d]+", text)

    def lower(text):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)

    seen = defaultdict(set)
    for doc_id, text, _, source in rows:
        for line in (text or "").split("\n"):
            if split(line):
                seen[source, " ".join(split(lower(line)))].add(doc_id)
    out = []
    for doc_id, text, _, source in rows:
        text = text or ""
        words = split(text)
        three = Counter(zip(words, words[1:], words[2:]))
        covered = {i + j for i in range(len(words) - 2) if three[tuple(words[i:i + 3])] > 1 for j in range(3)}
        used = [x for x in text.split("\n") if split(x)]
        kept = len(words) - sum(len(split(x)) for x in used if len(seen[source, " ".join(split(lower(x)))]) > limit)
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        out.append((
            doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(used) - len(set(used)), len(covered),
            failed, not failed and kept >= 50 and 100 * kept >= 20 * len(words), kept))
    return sorted(out, key=repr)


def test_line_rules_match_brute_force(spark):
    rng = random.Random(8)
    common = [" ".join(f"c{rng.randrange(50)}" for _ in range(rng.randrange(1, 40))) for _ in range(12)]
    rows = list(ROWS)
    for i in range(150):
        own = [" ".join(f"o{rng.randrange(400)}" for _ in range(rng.randrange(30))) for _ in range(rng.randrange(4))]
        mixed = own + rng.sample(common, rng.randrange(5)) + ([own[0]] if own and rng.random() < 0.3 else [])
        text = rng.choice(["\n", "\n\n", " \n"]).join(x.upper() if rng.random() < 0.2 else x.replace(" ", "  ", 1) for x in mixed)
        rows.append((100 + i, text + rng.choice(["", "#|é\x0b\x0cx"]), "en", rng.choice(["h", "h", "g", None])))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = lines.quality_rules(df.withColumn("host", F.lit("clash")).withColumn("line", F.lit(1)), line_docs=10)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == rules_brute(rows, 10)
    assert lines.quality_rules(no_docs(spark)).count() == 0
    assert lines.quality_rules(odd_docs(spark)).count() == len(ROWS)


# --- top-k ------------------------------------------------------------------

def topk_brute(data, asked, k):
    def whole(v):
        return [int(np.floor(np.float64(x) * 1024)) for x in v]

    def good(r):
        return r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1])

    chosen = {}
    for i, v in filter(good, asked):
        chosen[i] = min(chosen.get(i, v), v)
    out = []
    for q, v in chosen.items():
        scored = sorted((-sum(a * b for a, b in zip(whole(v), whole(w))), i) for i, w in filter(good, data) if i != q and len(w) == len(v))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.1, 2.0])
def test_topk_matches_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "DATA_BLOCK", 150)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (5, 8))
    data = [(i, (centres[i % 5] + rng.normal(0, spread, 8)).tolist()) for i in range(500)]
    data += [(i, data[i - 1000][1]) for i in range(1000, 1080)] + [(7, data[7][1]), (None, [1.0] * 8), (2000, None), (2001, []),
             (2002, [1.0, None] * 4), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8), (2005, [1.0, 2.0]), (2006, [2.0, 1.0])]
    asked = [r for r in data if r[0] is not None and r[0] % 20 in (0, 5)]
    schema = "vec_id long, embedding array<double>"
    found = topk.top_k(spark.createDataFrame(data, schema).withColumn("block", F.lit(1)), spark.createDataFrame(asked, schema), 6)
    assert sorted(map(tuple, found.collect())) == topk_brute(data, asked, 6)
    none = spark.createDataFrame([], schema)
    assert topk.top_k(none, none).count() == topk.top_k(spark.createDataFrame(data, schema), none).count() == 0


def test_topk_sheets_meet_once_each_and_nothing_is_broadcast(spark, monkeypatch):
    # Queries times blocks were broadcast, by the size they had before they met.
    for name, value in {"DATA_BLOCK": 40, "QUERY_BLOCK": 6, "DATA_SHEET": 90, "SHEET_BYTES": 3000}.items():
        monkeypatch.setattr(topk, name, value, raising=False)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 8 * 8 * 30, raising=False)
    rng = np.random.default_rng(7)
    data = [(i, rng.normal(0, 1, 8 if i % 7 else 3).tolist()) for i in range(600)]
    data += [(i, data[i - 700][1]) for i in range(700, 760)] + [(5000 + i, [1e6 + i] * 8) for i in range(30)]
    asked = [r for r in data if r[0] % 10 in (0, 3)]
    schema, batch = "vec_id long, embedding array<double>", "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "7")
    try:
        found = topk.top_k(spark.createDataFrame(data, schema), spark.createDataFrame(asked, schema), 4)
        rows = sorted(map(tuple, found.collect()))
    finally:
        spark.conf.set(batch, before)
    assert rows == topk_brute(data, asked, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan


def test_blocks_of_data_raise_the_floor_of_the_next():
    rng = np.random.default_rng(8)
    data, queries = rng.normal(0, 900, (900, 16)).round(), rng.normal(0, 900, (50, 16)).round()
    data_ids, ids = np.arange(900), np.arange(5000, 5050)
    cell, looked, best = topk._Cell(16, 5, 100, 20), [], topk.Best.add
    topk.Best.add = lambda self, q, i, s: (looked.append(int((s >= self.scores[q, -1:]).sum())), best(self, q, i, s))[1]
    try:
        found = [*cell.take(False, ids, queries)]
        for first in range(0, 900, 250):
            found += cell.take(True, data_ids[first:first + 250], data[first:first + 250])
        found += cell.found()
        together = sum(looked)
        looked.clear()
        for first in range(0, 900, 100):
            topk.dual_tree(queries, ids, data[first:first + 100], data_ids[first:first + 100], 5)
    finally:
        topk.Best.add = best
    whole = topk.dual_tree(queries, ids, data, data_ids, 5)
    rows = [tuple(r.values()) for b in found for r in b.to_pylist()]
    assert sorted(rows) == sorted(
        (int(q), int(i), int(s)) for q, some, scores in zip(ids, whole.ids, whole.scores) for i, s in zip(some, scores))
    assert together < 0.7 * sum(looked)


def test_large_numbers_stay_exact(spark):
    data = [(i, [1e6 + i, 3e5 - i, float(i)]) for i in range(30)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, df, 3).collect())) == topk_brute(data, data, 3)


def test_cover_tree_covers_and_separates():
    rng = np.random.default_rng(1)
    vectors = rng.normal(0, 1, (1500, 4))
    stack, leaves = [topk.cover_tree(vectors, 32)], []
    while stack:
        node = stack.pop()
        reach = np.sqrt(((vectors[node.points] - vectors[node.centre]) ** 2).sum(1))
        assert reach.max() <= node.radius
        if node.children:
            centres = vectors[[c.centre for c in node.children]]
            apart = np.sqrt(((centres[:, None] - centres) ** 2).sum(2)) + np.eye(len(centres)) * 1e9
            assert apart.min() > node.radius * topk.SHRINK * (1 - 1e-6)
            stack += node.children
        else:
            leaves += node.points.tolist()
    assert sorted(leaves) == list(range(1500))


def test_the_bound_drops_pairs():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 900, (20, 16)).round()
    data = (centres[rng.integers(0, 20, 4000)] + rng.normal(0, 20, (4000, 16))).round()
    looked = []
    best = topk.Best.add
    topk.Best.add = lambda self, q, ids, s: (looked.append(s.size), best(self, q, ids, s))[1]
    try:
        topk.dual_tree(data[:200], np.arange(200), data, np.arange(4000), 10)
    finally:
        topk.Best.add = best
    assert sum(looked) < 0.7 * 200 * 4000


# --- the pipeline -------------------------------------------------------------

def test_pipeline_stages(spark):
    docs = table(spark, SF_DIR, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
        docs = stage(spark, docs, SF_DIR).cache()
        assert docs.columns == columns
        after = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
        assert set(after) <= set(before) and len(after) > 0.5 * len(before)
        if name == "near dedup":
            assert sorted(r[0] for r in after) == sorted(r[0] for r in brute(before, 5) if r[3])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_pipeline_takes_odd_rows(spark):
    docs = odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.columns[0] == "doc_id"
    empty = no_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF_DIR)
    assert empty.count() == 0


def test_a_missing_id_is_a_document_of_its_own(spark):
    line = "one line that three documents share and no other"
    rows = [(i, f"{line}\n" + " ".join(f"w{n}x{i}" for n in range(80)), "s") for i in (-1, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    gone = {limit: {r["n_words"] - r["kept_words"] for r in lines.quality_rules(docs, limit).collect()} for limit in (2, 3)}
    assert gone == {2: {len(line.split())}, 3: {0}}
