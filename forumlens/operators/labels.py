"""Labelling: queue, labeler, checks on what it returns, and the label table."""

from __future__ import annotations

import itertools
import re
import threading
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.fixed import (
    CONFIDENCE_DEFAULT,
    LABEL_RATES,
    LABEL_RETRIES,
    LABEL_WORKERS,
    MIN_LABEL_TEXT,
)
from forumlens.functions.columns import clamp01
from forumlens.schemas import LABELS

# What a labeler is asked and says.
ANSWERS = "evidence_id string, raw string, error string"
ASKED = ANSWERS + ", prompt string, tries int"
# Labels as a labeler may return them: every field as text.
RAW_FIELDS = [f.name for f in LABELS if f.name != "evidence_id"]


class LabelerDown(Exception):
    """Raised by a labeler that cannot go on: its budget is spent, or its service is away."""


def label_queue(
    evidence: DataFrame, labels: DataFrame, limit: int | None = None, source_type: str | None = None
) -> DataFrame:
    """Evidence still to be labelled: without a label and with enough text.

    The oldest come first. Only with a limit are the rows put in that order,
    as a top-n; without one no consumer depends on it and a global sort of the
    whole table would be wasted.
    """
    rows = evidence.filter(F.length(F.coalesce("text", F.lit(""))) > MIN_LABEL_TEXT)
    if source_type:
        rows = rows.filter(F.col("source_type") == source_type)
    open_rows = rows.join(labels.select("evidence_id"), "evidence_id", "left_anti").select(
        "evidence_id", "subreddit", "title", "text", "created_at"
    )
    if limit:
        open_rows = open_rows.orderBy(F.asc_nulls_last("created_at"), "evidence_id").limit(limit)
    return open_rows


def with_prompt(queue: DataFrame, text_chars: int | None = None) -> DataFrame:
    """Add the text a labeler is asked about; ``text_chars`` limits the body, by default it is whole."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    body = text("text") if text_chars is None else F.substring(text("text"), 1, text_chars)
    return queue.withColumn("prompt", F.concat(
        F.lit("r/"), text("subreddit"), F.lit("\nTitle: "), text("title"), F.lit("\n\n"), body,
    ))


def coerce_labels(
    raw: DataFrame, confidence_default: float = CONFIDENCE_DEFAULT, widths: Mapping[str, int] | None = None
) -> DataFrame:
    """Label rows from text fields: defaults, flags and confidence.

    A flag is true for true or the text 'true' only, and a theme of 'null' is
    no theme. ``widths`` cuts text columns for a store of fixed column widths,
    such as ``LABEL_WIDTHS``; by default nothing is cut.
    """
    def cut(name: str, default: str) -> Column:
        value = F.coalesce(F.col(name).cast("string"), F.lit(default))
        return F.substring(value, 1, widths[name]) if widths and name in widths else value

    def flag(name: str) -> Column:
        return F.coalesce(F.lower(F.trim(F.col(name).cast("string"))) == "true", F.lit(False))

    def theme(name: str) -> Column:
        value = F.col(name).cast("string")
        return F.when(~F.lower(F.trim(value)).isin("", "null"), value)

    return raw.select(
        "evidence_id",
        cut("brand", "unknown").alias("brand"),
        cut("model", "unknown").alias("model"),
        cut("powertrain", "unknown").alias("powertrain"),
        flag("is_pain_point").alias("is_pain_point"),
        theme("pain_theme").alias("pain_theme"),
        flag("is_delight").alias("is_delight"),
        theme("delight_theme").alias("delight_theme"),
        cut("sentiment", "neutral").alias("sentiment"),
        clamp01(F.col("confidence").cast("string"), confidence_default).cast("float").alias("confidence"),
    )


def parse_labels(
    answers: DataFrame, confidence_default: float = CONFIDENCE_DEFAULT, widths: Mapping[str, int] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Labels and failures from (evidence_id, raw, error).

    ``raw`` may have words around its JSON object. What cannot be read as JSON
    is a failure and stays unlabelled.
    """
    schema = ", ".join(f"{name} string" for name in [*RAW_FIELDS, "_bad"])
    body = F.nullif(F.regexp_extract(F.coalesce("raw", F.lit("")), r"(?s)\{.*\}", 0), F.lit(""))
    parsed = answers.withColumn(
        "label", F.from_json(body, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    )
    good = F.col("error").isNull() & F.col("label").isNotNull() & F.col("label._bad").isNull()
    labels = parsed.filter(good).select("evidence_id", *[f"label.{n}" for n in RAW_FIELDS])
    failures = parsed.filter(~good).select(
        "evidence_id", F.coalesce("error", F.lit("answer is no JSON object")).alias("error")
    )
    return coerce_labels(labels, confidence_default, widths), failures


def ask_labeler(
    queue: DataFrame,
    labeler: Callable[[str], str],
    workers: int = LABEL_WORKERS,
    retries: int = LABEL_RETRIES,
    backoff: float = 1.0,
    partitions: int | None = None,
    text_chars: int | None = None,
) -> DataFrame:
    """Send each prompt to a labeler on the executors: (evidence_id, raw, error).

    A labeler that raises ``LabelerDown`` is asked nothing more by that task, and what it
    has not answered is left out of the result.

    The labeler mostly waits for a model, so each task asks from a few threads.
    What failed is asked again once the rest of its batch was, after one wait for all of it.
    A queue of short texts would be packed into few tasks; it is spread over
    more, four per core unless ``partitions`` says otherwise, which also keeps
    small what a lost executor has to ask again.
    """
    prompts = with_prompt(queue, text_chars).select("evidence_id", "prompt", F.lit(0).alias("tries"))
    return _dealt(prompts, partitions).mapInPandas(_asking(labeler, workers, retries, backoff), ASKED).select(
        "evidence_id", "raw", "error")


def ask_once(
    prompts: DataFrame, labeler: Callable[[str], str], workers: int = LABEL_WORKERS, partitions: int | None = None
) -> DataFrame:
    """Send each of (evidence_id, prompt, tries) to a labeler as ``ask_labeler`` does, but without a second try.

    Returns (evidence_id, raw, error, prompt, tries); the prompt comes back where it failed.
    """
    return _dealt(prompts, partitions).mapInPandas(_asking(labeler, workers, 0, 0.0), ASKED)


def _dealt(prompts: DataFrame, partitions: int | None) -> DataFrame:
    return prompts.repartition(partitions or 4 * prompts.sparkSession.sparkContext.defaultParallelism, "evidence_id")


def _asking(labeler: Callable[[str], str], workers: int, retries: int, backoff: float):
    def ask(prompt: str, down: threading.Event) -> tuple[str | None, str | None] | None:
        if down.is_set():
            return None
        try:
            return labeler(prompt), None
        except LabelerDown:
            down.set()
            return None
        except Exception as problem:
            return None, f"{type(problem).__name__}: {problem}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        down = threading.Event()
        with ThreadPoolExecutor(max_workers=workers) as pool:
            for batch in batches:
                prompts = batch["prompt"].tolist()
                answers = list(pool.map(ask, prompts, itertools.repeat(down)))
                for attempt in range(retries):
                    failed = [i for i, a in enumerate(answers) if a is not None and a[1] is not None]
                    if not failed:
                        break
                    if not down.is_set():
                        time.sleep(backoff * 2 ** attempt)
                    for i, answer in zip(failed, pool.map(ask, [prompts[i] for i in failed], itertools.repeat(down))):
                        answers[i] = answer
                told = [
                    (i, *a, p if a[1] is not None else None, n)
                    for i, a, p, n in zip(batch["evidence_id"], answers, prompts, batch["tries"].tolist()) if a is not None]
                yield pd.DataFrame(told, columns=["evidence_id", "raw", "error", "prompt", "tries"], dtype=object)

    return run


def label_evidence(
    queue: DataFrame,
    labeler: Callable[[str], str] | None = None,
    confidence_default: float = CONFIDENCE_DEFAULT,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Labels and failures for a queue; without a labeler by keyword rules.

    Asking is the expensive part and both results come from the same answers:
    write or persist the answers of ``ask_labeler`` when both are needed.
    """
    if labeler is None:
        labels = rule_labels(queue)
        return labels, labels.limit(0).select("evidence_id", F.lit("").alias("error"))
    return parse_labels(ask_labeler(queue, labeler, **options), confidence_default)


# Keyword rules of the offline labeler: value -> words that speak for it, the
# first value with a match wins. They are ours and meant to be replaced.
BRAND_WORDS: dict[str, Sequence[str]] = {
    "GMC": ["gmc", "sierra", "yukon"],
    "Cadillac": ["cadillac", "escalade", "lyriq"],
    "Buick": ["buick", "enclave", "encore"],
    "Chevy": ["chevy", "chevrolet", "silverado", "bolt", "tahoe", "equinox", "blazer", "corvette", "camaro"],
    "GM": ["gm", "general motors"],
}
MODEL_WORDS: dict[str, Sequence[str]] = {
    "Silverado": ["silverado"], "Equinox": ["equinox"], "Tahoe": ["tahoe"], "Sierra": ["sierra"],
    "Blazer": ["blazer"], "Escalade": ["escalade"], "Corvette": ["corvette"], "Camaro": ["camaro"],
    "Bolt": ["bolt"], "Lyriq": ["lyriq"],
}
POWERTRAIN_WORDS: dict[str, Sequence[str]] = {
    "PHEV": ["phev", "plug-in hybrid"],
    "EV": ["ev", "electric", "battery", "bolt", "lyriq", "blazer ev"],
}
PAIN_WORDS: dict[str, Sequence[str]] = {
    "transmission": ["transmission", "shifting", "gearbox"],
    "dealer_service": ["dealer service", "dealership", "dealer"],
    "infotainment": ["infotainment", "touchscreen", "carplay"],
    "battery_range": ["range", "degradation"],
    "charging": ["charging", "charger"],
    "build_quality": ["build quality", "rattle", "panel gap"],
    "recall": ["recall"],
    "warranty": ["warranty"],
    "pricing": ["price", "pricing", "markup"],
    "performance": ["slow", "sluggish"],
    "comfort": ["uncomfortable", "harsh ride"],
    "reliability": ["reliability", "unreliable", "breakdown"],
}
DELIGHT_WORDS: dict[str, Sequence[str]] = {
    "comfort": ["comfortable", "smooth"],
    "performance": ["fast", "powerful"],
    "value": ["great value", "good deal"],
    "technology": ["technology", "super cruise"],
    "design": ["beautiful", "gorgeous"],
    "safety": ["safe", "safety"],
    "dealer_service": ["great dealer", "helpful dealer"],
    "reliability": ["rock solid", "reliable"],
}
NEGATIVE_WORDS = [
    "terrible", "failed", "failure", "problem", "problems", "issue", "issues", "broken", "worst",
    "disappointed", "frustrating", "nightmare", "ridiculous", "abysmal", "grinding", "slipping",
]
POSITIVE_WORDS = ["love", "great", "best", "satisfied", "happy", "excellent", "rock solid", "smooth"]


def _single(word: str) -> bool:
    return word.isascii() and word.isalnum()


class Mentions:
    """Which words of a vocabulary a text has, standing alone.

    A text is cut into words once, and what is left of it is the few that are
    in the vocabulary; every rule looks only at those. Phrases are searched for
    in the text, with a pattern only where the phrase occurs at all.
    """

    TEXT, WORDS = "_text", "_words"

    def __init__(self, *vocabularies: Sequence[str]):
        every = {w for words in vocabularies for w in words}
        self.singles = sorted(w for w in every if _single(w))

    def prepare(self, df: DataFrame, text: Column) -> DataFrame:
        """Add the lower-case text and the vocabulary words in it."""
        lower = df.withColumn(self.TEXT, F.lower(text))
        vocabulary = F.array(*[F.lit(w) for w in self.singles]).cast("array<string>")
        return lower.withColumn(
            self.WORDS, F.array_intersect(F.split(self.TEXT, "[^a-z0-9]+"), vocabulary)
        )

    def any_of(self, words: Sequence[str]) -> Column:
        """Whether one of the words is mentioned."""
        found = F.lit(False)
        singles = [w for w in words if _single(w)]
        if singles:
            found = F.arrays_overlap(self.WORDS, F.array(*[F.lit(w) for w in singles]))
        for phrase in (w for w in words if not _single(w)):
            alone = F.col(self.TEXT).rlike("(^|[^a-z0-9])" + re.escape(phrase) + "([^a-z0-9]|$)")
            found = found | (F.col(self.TEXT).contains(phrase) & alone)
        return found

    def first_of(self, rules: Mapping[str, Sequence[str]], default: Column) -> Column:
        """The first value one of whose words is mentioned."""
        return F.coalesce(*[F.when(self.any_of(words), F.lit(v)) for v, words in rules.items()], default)


def rule_labels(
    queue: DataFrame,
    brands: Mapping[str, Sequence[str]] = BRAND_WORDS,
    models: Mapping[str, Sequence[str]] = MODEL_WORDS,
    powertrains: Mapping[str, Sequence[str]] = POWERTRAIN_WORDS,
    pains: Mapping[str, Sequence[str]] = PAIN_WORDS,
    delights: Mapping[str, Sequence[str]] = DELIGHT_WORDS,
    negative: Sequence[str] = tuple(NEGATIVE_WORDS),
    positive: Sequence[str] = tuple(POSITIVE_WORDS),
) -> DataFrame:
    """Labels by keywords in title and text, without leaving the JVM.

    A text about no known brand has no powertrain either; one about a brand
    runs on fuel unless it says otherwise.
    """
    rules = [*brands.values(), *models.values(), *powertrains.values(), *pains.values(), *delights.values()]
    said = Mentions(*rules, negative, positive)
    unknown, other, none = F.lit("unknown"), F.lit("other"), F.lit(None).cast("string")
    texts = said.prepare(queue, F.concat_ws(" ", "title", "text"))
    marked = texts.select(
        "evidence_id",
        said.first_of(brands, unknown).alias("brand"),
        said.first_of(models, unknown).alias("model"),
        said.first_of(powertrains, none).alias("_power"),
        said.first_of(pains, other).alias("_pain"),
        said.first_of(delights, other).alias("_delight"),
        said.any_of(negative).alias("_bad"),
        said.any_of(positive).alias("_good"),
    )
    known = F.col("brand") != "unknown"
    pain, delight = F.col("_bad"), F.col("_good") & ~F.col("_bad")
    return marked.select(
        "evidence_id", "brand", "model",
        F.coalesce("_power", F.when(known, F.lit("ICE")).otherwise(unknown)).alias("powertrain"),
        pain.alias("is_pain_point"),
        F.when(pain, F.col("_pain")).alias("pain_theme"),
        delight.alias("is_delight"),
        F.when(delight, F.col("_delight")).alias("delight_theme"),
        F.when(pain & F.col("_good"), F.lit("mixed")).when(pain, F.lit("negative"))
        .when(delight, F.lit("positive")).otherwise(F.lit("neutral")).alias("sentiment"),
        F.when(known, F.lit(0.9)).otherwise(F.lit(0.1)).cast("float").alias("confidence"),
    )


def clear_labels(labels: DataFrame, evidence: DataFrame, source_type: str | None = None) -> DataFrame:
    """Labels left after clearing those of a source type, or all of them."""
    if not source_type:
        return labels.limit(0)
    gone = evidence.filter(F.col("source_type") == source_type).select("evidence_id")
    return labels.join(gone, "evidence_id", "left_anti").select(*labels.columns)


def label_estimate(
    queue: DataFrame, rates: Mapping[str, float] = LABEL_RATES, workers: int = LABEL_WORKERS
) -> DataFrame:
    """Calls, tokens, cost and minutes that labelling the queue would take."""
    n = F.col("pending").cast("double")
    tokens_in = n * rates["prompt_tokens_per_item"]
    tokens_out = n * rates["completion_tokens_per_item"]
    cost = (
        tokens_in / 1_000_000 * rates["usd_per_1m_input_tokens"]
        + tokens_out / 1_000_000 * rates["usd_per_1m_output_tokens"]
    )
    return queue.agg(F.count("*").alias("pending")).select(
        "pending",
        n.alias("calls"),
        tokens_in.alias("input_tokens"),
        tokens_out.alias("output_tokens"),
        cost.alias("estimated_cost_usd"),
        (n * rates["seconds_per_item_serial"] / max(workers, 1) / 60).alias("estimated_minutes"),
    )


def label_progress(evidence: DataFrame, labels: DataFrame) -> DataFrame:
    """Evidence and label counts and whether labelling is missing, partial or done."""
    rows = evidence.select(F.lit(1).alias("e"), F.lit(0).alias("l")).unionByName(
        labels.select(F.lit(0).alias("e"), F.lit(1).alias("l"))
    )
    counts = rows.agg(F.count_if(F.col("e") == 1).alias("evidence"), F.count_if(F.col("l") == 1).alias("labels"))
    return counts.withColumn(
        "state",
        F.when(F.col("labels") == 0, "missing").when(F.col("labels") < F.col("evidence"), "partial")
        .otherwise("done"),
    )
