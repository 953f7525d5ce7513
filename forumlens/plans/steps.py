"""From a feed or exports to evidence, labels and an index, one written table per step."""

from __future__ import annotations

import functools
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlens.fixed import LABEL_RETRIES
from forumlens.functions.keyed import arrival, keep_one
from forumlens.operators.collect import collect, date_window, new_run_id, save, seen_ids
from forumlens.operators.evidence import load_evidence
from forumlens.operators.labels import (
    ANSWERS,
    ASKED,
    LabelerDown,
    ask_once,
    label_queue,
    parse_labels,
    rule_labels,
    with_prompt,
)
from forumlens.operators.merge import merge_into
from forumlens.operators.retrieval import build_index, embed
from forumlens.schemas import EVIDENCE
from forumlens.session import scratch_folder
from forumlens.sources.deltas import KeyedTable
from forumlens.sources.exports import export_kind, path_exists
from forumlens.sources.runs import write_run
from forumlens.sources.tables import read_version, write_version

#: Prompts of a chunk of a label run, and chunks at most: a commit costs some seconds.
LABEL_CHUNK, LABEL_CHUNKS = 2000, 200
#: Buckets of a new log of answers.
LOG_BUCKETS = 8


def merge_step(spark: SparkSession, folder: str, exports: list[DataFrame], reset: bool = False) -> DataFrame:
    """Merge uploaded exports into the stored ones; kinds are told by columns."""
    files: dict[str, DataFrame] = {}
    for export in exports:
        kind = export_kind(export.columns)
        if kind is None or kind in files:
            raise ValueError("unknown export" if kind is None else f"a second {kind} export")
        files[kind] = export
    return merge_into(spark, folder, files, reset)


def load_step(
    spark: SparkSession, folder: str, table: str, reset: bool = False, mode: str = "ignore", run_id: str | None = None
) -> DataFrame:
    """Load the evidence of a folder of exports into a stored table.

    ``mode='ignore'`` only adds what is not stored yet, ``mode='update'`` takes over
    rows that come again, and ``reset`` starts from nothing. Each is one commit of the
    table: a reader sees it before or after, also if the load is killed in between.
    With a ``run_id`` a load that came through already changes nothing.
    """
    stored = evidence_table(spark, table)
    if reset:
        found = load_evidence(spark, folder, mode=mode)
        stored.replace(keep_one(found, ["evidence_id"], arrival(found, newest_first=mode == "update")), run_id)
    else:
        stored.upsert(load_evidence(spark, folder, mode=mode), run_id, mode)
    return stored.read(columns=EVIDENCE.fieldNames()).select(*EVIDENCE.fieldNames())


def evidence_table(spark: SparkSession, path: str) -> KeyedTable:
    """The stored evidence; a plain folder of Parquet files, as loads wrote before, is taken over."""
    table = KeyedTable(spark, path, "evidence_id", partition_by=["source_type"])
    if table.state() is None and path_exists(spark, path) and not path_exists(spark, f"{path}/data"):
        table.replace(spark.read.parquet(path))
    return table


def collect_step(
    spark: SparkSession,
    feed: DataFrame,
    folder: str,
    now: datetime,
    since_days: int = 0,
    since_date: str = "",
    until_date: str = "",
    cap: int = 0,
    comments_limit: int | None = None,
    dry_run: bool = False,
) -> DataFrame:
    """One collection run over a landed feed into a folder; returns its summary."""
    since, until = date_window(since_days, since_date, until_date, now)
    posts = spark.read.parquet(f"{folder}/posts") if path_exists(spark, f"{folder}/posts") else None
    state = spark.read.parquet(f"{folder}/seen") if path_exists(spark, f"{folder}/seen") else None
    run_id, started = new_run_id(now), now.astimezone(timezone.utc).isoformat()
    done = save(
        collect(feed, seen_ids(posts, state), run_id, started, since, until, cap, comments_limit, dry_run), folder
    )
    # Counted once: the record, the manifest and the caller read the same table.
    told = scratch_folder(spark, "summary")
    done.summary.write.parquet(told)
    summary = spark.read.parquet(told)
    write_run(
        summary, f"{folder}/runs", run_id, started, datetime.now(timezone.utc).isoformat(),
        since.isoformat() if since else "", until.isoformat() if until else "", dry_run, None, comments_limit,
    )
    return summary


@dataclass(frozen=True)
class Labelled:
    """The label table after a run, what could not be labelled, and how many of each."""

    labels: DataFrame
    failures: DataFrame
    counts: DataFrame


def label_step(evidence: DataFrame, table: str, *args, **options) -> DataFrame:
    """The label table after ``label_run`` with the same arguments."""
    return label_run(evidence, table, *args, **options).labels


def label_run(
    evidence: DataFrame,
    table: str,
    answers: str | None = None,
    labeler: Callable[[str], str] | None = None,
    limit: int | None = None,
    source_type: str | None = None,
    run_id: str | None = None,
    chunk: int = LABEL_CHUNK,
) -> Labelled:
    """Label what has no label and bring it into the label table.

    Failures are (evidence_id, error), counts (labelled, failed) of this run. Asking a
    labeler is what costs, so its answers go to a log in the folder ``answers`` first,
    by chunks of about ``chunk`` prompts that are committed one by one. A run that died
    is started again with the same arguments: it asks only what has no answer yet.
    With the same ``run_id`` that includes prompts whose answer was a failure; without
    one, or with another, these are asked again. A labeler that raises
    ``LabelerDown`` ends the run, and what it answered until then is kept.
    """
    spark = evidence.sparkSession
    run_id = run_id or uuid.uuid4().hex
    labels_table = KeyedTable(spark, table, "evidence_id")
    stored = labels_table.read()
    empty = rule_labels(evidence).limit(0)
    queue = label_queue(evidence, empty if stored is None else stored.select("evidence_id"), limit, source_type)
    if labeler is None:
        # Used twice below; the texts are to be searched once.
        staged = scratch_folder(spark, "labels")
        rule_labels(queue).write.parquet(staged)
        found = spark.read.parquet(staged)
        failures = found.limit(0).select("evidence_id", F.lit("").alias("error"))
    else:
        if not answers:
            raise ValueError("a labeler needs a folder for its answers")
        log, asked = answer_queue(queue, labeler, answers, run_id, chunk)
        found, failures = parse_labels(log.read().join(asked, "evidence_id", "left_semi"))
    labels_table.upsert(found, order=[F.lit(0)])
    tally = found.select(F.lit(1).alias("ok")).unionByName(failures.select(F.lit(0).alias("ok")))
    counts = tally.agg(F.count_if(F.col("ok") == 1).alias("labelled"), F.count_if(F.col("ok") == 0).alias("failed"))
    return Labelled(labels_table.read(), failures, counts)


def answer_queue(
    queue: DataFrame, labeler: Callable[[str], str], answers: str, run_id: str, chunk: int = LABEL_CHUNK, backoff: float = 1.0
) -> tuple[KeyedTable, DataFrame]:
    """Ask a labeler what the log of answers lacks: the log, and the ids of the queue."""
    spark = queue.sparkSession
    # Every chunk writes a file per bucket it touches, and nothing compacts the log: few buckets.
    log = KeyedTable(spark, answers, "evidence_id", buckets=LOG_BUCKETS)
    staged, known = scratch_folder(spark, "queue"), log.read()
    rows = spark.read.schema(queue.schema).parquet(_written(queue, staged))
    left = rows
    if known is not None:
        good, _ = parse_labels(known)
        done = good.select("evidence_id").unionByName(known.filter(F.col("run_id") == run_id).select("evidence_id"))
        left = rows.join(done, "evidence_id", "left_anti").select(*rows.columns)
    # Dealt once, so that a chunk reads its own prompts only.
    count = left.count()
    chunks = max(1, min(LABEL_CHUNKS, -(-count // chunk)))
    dealt = scratch_folder(spark, "chunks")
    left.withColumn("_chunk", F.pmod(F.xxhash64("evidence_id"), F.lit(chunks))).write.partitionBy("_chunk").parquet(dealt)
    # A row per chunk.
    sizes = dict(spark.read.parquet(dealt).groupBy("_chunk").count().collect()) if count else {}
    # What failed is asked again along with a later chunk: its wait holds up no task and no other prompt.
    ahead, failed, begun = sorted(sizes), [], 0
    while ahead or failed:
        if not ahead:
            time.sleep(max(0.0, min(due for due, _, _ in failed) - time.monotonic()))
        now = time.monotonic()
        frames, n_asked = [f for due, _, f in failed if due <= now], sum(n for due, n, _ in failed if due <= now)
        failed = [f for f in failed if f[0] > now]
        if ahead:
            number, begun = ahead.pop(0), begun + 1
            n_asked += sizes[number]
            frames.append(with_prompt(spark.read.schema(rows.schema).parquet(f"{dealt}/_chunk={number}")).select(
                "evidence_id", "prompt", F.lit(0).alias("tries")))
        told = scratch_folder(spark, "answers")
        # Written before anything counts or moves them: nothing is asked twice.
        ask_once(functools.reduce(DataFrame.unionByName, frames), labeler).write.parquet(told)
        now = time.monotonic()
        found = spark.read.schema(ASKED).parquet(told)
        again = F.col("error").isNotNull() & (F.col("tries") < LABEL_RETRIES)
        n_tries = {r["tries"]: r["count"] for r in found.groupBy(F.when(again, F.col("tries")).alias("tries")).count().collect()}
        if None in n_tries:
            log.upsert(found.filter(~again).select("evidence_id", "raw", "error", F.lit(run_id).alias("run_id")), order=[F.lit(0)])
        missing = n_asked - sum(n_tries.values())
        if missing:
            raise LabelerDown(f"the labeler stopped {missing} prompts before the end of chunk {begun} of {len(sizes)}")
        failed += [
            (now + backoff * 2 ** t, n, found.filter(again & (F.col("tries") == t)).select(
                "evidence_id", "prompt", F.lit(t + 1).alias("tries")))
            for t, n in n_tries.items() if t is not None]
    if log.state() is None:
        log.upsert(spark.createDataFrame([], f"{ANSWERS}, run_id string"))
    return log, rows.select("evidence_id")


def _written(df: DataFrame, path: str) -> str:
    df.write.parquet(path)
    return path


def index_step(chunks: DataFrame, table: str, embedder: Callable[[list[str]], list] | None = None) -> DataFrame:
    """Embed chunks and write the index as a table with one vector per row."""
    write_version(build_index(embed(chunks, "text", embedder)), table)
    return read_version(chunks.sparkSession, table)
