"""Quality rules: counts inside a document, and lines that a host repeats.

Inside a document, from its words (runs of bytes other than space and 0x09-0x0D):
sizes, symbols, repeated lines and repeated three-word windows. Across documents:
a line is normalised (A-Z lower-cased, words joined by one blank) and hashed, the
distinct documents of each (host, line) are counted, and a line in more than
LINE_DOCS documents of a host is taken out of all of them. A document that keeps
fewer than KEPT_WORDS words, or less than a fifth of its words, is depleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.llm.common import binary_texts, mixed, slices, word_hashes, words_of, written

#: Distinct documents of a host above which a line is taken out.
LINE_DOCS = 30
#: Words a document must have, and keep once such lines are gone.
LEAST_WORDS = KEPT_WORDS = 50
#: Least percentage of its words that a document must keep.
KEPT_PERCENT = 20
#: Most percentage of words in repeated three-word windows.
REPEAT_PERCENT = 50

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


def _per_text(flags: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """How many bytes of each text are flagged."""
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[borders[1:]] - sums[borders[:-1]]


def measures(texts: list[bytes | None]) -> tuple[dict[str, np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Counts for each text; the distinct normalised lines of each, and their words."""
    n = len(texts)
    joined, starts, ends, first = words_of(texts)
    data = np.frombuffer(joined, np.uint8)
    borders = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
    doc = np.repeat(np.arange(n), np.diff(first))
    in_word = np.zeros(len(joined) + 1, np.int8)
    in_word[starts] += 1
    in_word[ends] -= 1
    in_word = np.cumsum(in_word[:-1]) > 0
    salt = mixed(np.arange(1, n + 1, dtype=np.uint64))

    # Lines of the text as it stands; a line end closes each text.
    line_end = np.flatnonzero(data == 0x0A)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    line_of_word = np.searchsorted(line_end, starts)
    used = np.unique(line_of_word)
    line_doc = np.searchsorted(borders, line_start[used], "right") - 1
    exact = word_hashes(joined, line_start[used], line_end[used]) ^ salt[line_doc]
    _, seen = np.unique(exact, return_index=True)
    again = np.ones(len(used), bool)
    again[seen] = False

    # Words in windows of three that the text has twice or more.
    hashes = word_hashes(joined, starts, ends)
    repeated = np.zeros(len(hashes), bool)
    if len(hashes) >= 3:
        window = mixed(mixed(mixed(hashes[:-2] + salt[doc[:-2]]) + hashes[1:-1]) + hashes[2:])
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        _, which, times = np.unique(window[inside], return_inverse=True, return_counts=True)
        twice = inside[times[which] > 1]
        for j in range(3):
            repeated[twice + j] = True

    counts = {
        "n_words": np.diff(first),
        "word_chars": _per_text(in_word & ((data & 0xC0) != 0x80), borders),
        "n_symbols": _per_text(_SYMBOL[data], borders),
        "n_dup_lines": np.bincount(line_doc[again], minlength=n),
        "n_repeat_words": np.bincount(doc[repeated], minlength=n),
    }

    # Normalised lines: hashes of lower-cased words, each with its place in the line.
    lowered = word_hashes(joined.lower(), starts, ends)
    begin = np.searchsorted(line_of_word, used)
    words = np.diff(np.append(begin, len(starts)))
    place = np.arange(len(starts)) - np.repeat(begin, words)
    lines = np.add.reduceat(mixed(lowered + mixed(place.astype(np.uint64) + np.uint64(1))), begin) if len(begin) else lowered
    lines = mixed(lines + words.astype(np.uint64))
    order = np.lexsort((lines, line_doc))
    new = np.ones(len(order), bool)
    new[1:] = (lines[order][1:] != lines[order][:-1]) | (line_doc[order][1:] != line_doc[order][:-1])
    at = np.flatnonzero(new)
    total = np.add.reduceat(words[order], at) if len(at) else words
    cut = np.searchsorted(line_doc[order][at], np.arange(1, n))
    return counts, np.split(lines[order][at].view(np.int64), cut), np.split(total, cut)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = binary_texts(batch, "text")
        for first, last in slices(texts):
            counts, lines, words = measures(texts[first:last])
            size = last - first
            yield pa.record_batch({
                "row": batch.column("row").slice(first, size), "doc_id": batch.column("doc_id").slice(first, size),
                "host": batch.column("host").slice(first, size),
                **{c: pa.array(counts[c], pa.int64()) for c in COUNTS},
                "lines": pa.array(lines, pa.list_(pa.int64())), "words": pa.array(words, pa.list_(pa.int64())),
            })


def quality_rules(docs: DataFrame, line_docs: int = LINE_DOCS) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, kept_words: one row per row of docs (doc_id, text, source).

    A NULL or empty text has no words, so it fails the base rules. A NULL source
    is a host of its own, and rows with a NULL doc_id count as one document of
    their host, as rows that repeat an id do. Other columns are ignored. An empty
    table gives no rows.
    """
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("host"),
        F.col("text").cast("string").alias("text"))
    schema = "row long, doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS)
    measured = written(texts.mapInArrow(_measured, schema + ", lines array<long>, words array<long>"), "measured")
    lines = measured.select("row", "host", "doc_id", F.explode(F.arrays_zip("lines", "words")).alias("of")).select(
        "row", "host", "doc_id", F.col("of.lines").alias("line"), F.col("of.words").alias("words"))
    # First one row per document, so that no line of a hot host meets in one task.
    documents = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    common = lines.groupBy("host", "line").agg(documents.alias("docs")).filter(F.col("docs") > line_docs)
    gone = lines.join(common.select("host", "line"), ["host", "line"]).groupBy("row").agg(F.sum("words").alias("gone"))
    rows = measured.select("row", "doc_id", *COUNTS).join(gone, "row", "left")
    kept_words = F.col("n_words") - F.coalesce("gone", F.lit(0))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.select(
        "doc_id", *COUNTS, failed.alias("base_failed"),
        (~failed & (kept_words >= KEPT_WORDS) & (100 * kept_words >= KEPT_PERCENT * F.col("n_words"))).alias("kept"),
        kept_words.alias("kept_words"))
