"""Packing by column generation for the cutting-stock problem.

Documents are cut into pieces of at most one sequence. The lengths of the pieces,
in units of UNIT tokens, form a histogram with at most capacity / UNIT rows; only
that goes to the driver. There a linear program over patterns (how many pieces of
each length fill one sequence) is solved: its columns are priced by dynamic
programming for the knapsack of the dual prices until no pattern is worth more
than one sequence. Pattern counts are rounded down, what is left over is filled
greedily, and pieces take their places by their rank within their length.

Ranks come from two levels, so that a length which a third of all pieces share
is counted in as many parts as the shuffle has.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forumlens.llm.common import hand_back, text_slices, written
from forumlens.llm.pretokens import encoded, word_ids

CAPACITY = 2048
#: Tokens in a unit of length; a piece fills whole units in a pattern.
UNIT = 8
#: Id that ends every document.
END_ID = 1
#: The linear program is left once its value is proven so close to the optimum.
GAP = 1e-3
#: Bytes of text that a task encodes at a time.
ENCODE_BYTES = 1 << 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(tokenizer: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, last, texts in text_slices(batch, "text", ENCODE_BYTES):
                ids, at = encoded(texts, ids_of)
                rows = []
                for doc_id, i, j in zip(doc_ids[first:last], at[:-1], at[1:]):
                    own = np.append(ids[i:j], np.uint32(END_ID)).astype("<u4")
                    for start in range(0, len(own), capacity):
                        piece = own[start:start + capacity]
                        rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(own)))
                columns = list(zip(*rows))
                yield pa.record_batch({
                    name: pa.array(column, pa.int64())
                    for name, column in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), columns)
                })
            hand_back()

    return run


@dataclass
class Pattern:
    """Pieces of each size in one sequence, and how many sequences are filled so."""

    pieces: dict[int, int]
    times: int


def _best_column(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable filling of one sequence: an unbounded knapsack."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fit = np.searchsorted(sizes, room, "right")
        value[room] = value[room - 1]
        if fit:
            gain = value[room - sizes[:fit]] + prices[:fit]
            k = int(gain.argmax())
            if gain[k] > value[room] + 1e-12:
                value[room], choice[room] = gain[k], k
    column, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            column[choice[room]] += 1
            room -= sizes[choice[room]]
    return value[capacity], column


def cutting_stock(counts: dict[int, int], capacity: int, gap: float = GAP) -> list[Pattern]:
    """Patterns that hold at least the counted pieces of each size (1 to capacity)."""
    sizes = np.array(sorted(s for s, n in counts.items() if n > 0))
    if not len(sizes):
        return []
    demand = np.array([counts[s] for s in sizes], float)
    # One pattern of each size alone is the first basis.
    columns = np.diag((capacity // sizes).astype(float))
    inverse, used = np.diag(1 / np.diag(columns)), demand / np.diag(columns)
    bound = 0.0
    while True:
        prices = inverse.sum(axis=0)
        worth, column = _best_column(sizes, np.maximum(prices, 0), capacity)
        # Prices divided by the worth of the best column are feasible dual prices.
        bound = max(bound, used.sum() / worth)
        if used.sum() <= bound * (1 + gap):
            break
        change = inverse @ column
        positive = change > 1e-9
        steps = np.where(positive, used / np.where(positive, change, 1), np.inf)
        out = int(steps.argmin())
        step = steps[out]
        used = used - step * change
        used[out] = step
        columns[:, out] = column
        row = inverse[out] / change[out]
        inverse = inverse - np.outer(change, row)
        inverse[out] = row
    found, left = [], demand.copy()
    for k in np.flatnonzero(used >= 1):
        times = int(used[k] + 1e-6)
        found.append(Pattern({int(sizes[i]): int(columns[i, k]) for i in np.flatnonzero(columns[:, k])}, times))
        left = np.maximum(left - times * columns[:, k], 0)
    return found + _greedy(sizes, left.astype(np.int64), capacity)



def _greedy(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[Pattern]:
    """Sequences for what rounding left: the largest piece that fits, again and again."""
    found = []
    while left.any():
        room, pieces = capacity, {}
        for i in range(len(sizes) - 1, -1, -1):
            n = min(left[i], room // sizes[i])
            if n:
                pieces[i] = int(n)
                room -= int(n) * int(sizes[i])
        times = int(min(left[i] // n for i, n in pieces.items()))
        for i, n in pieces.items():
            left[i] -= n * times
        found.append(Pattern({int(sizes[i]): n for i, n in pieces.items()}, times))
    return found


def _places(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """size, first rank, end rank, first sequence, pieces of the size in each sequence."""
    out, ranks, sequence = [], {}, 0
    for pattern in patterns:
        for size, n in pattern.pieces.items():
            first = ranks.get(size, 0)
            ranks[size] = first + n * pattern.times
            out.append((size, first, ranks[size], sequence, n))
        sequence += pattern.times
    return out


def pack(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, unit: int = UNIT
) -> DataFrame:
    """One row per piece of a document with its place in a sequence.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_length (tokens of the sequence before padding). A NULL or empty text
    is the end id alone. Rows that repeat a doc_id, and NULL ids, are packed like
    any other row. Columns other than doc_id and text are ignored. An empty table
    gives no rows. ``capacity`` is a multiple of ``unit``.
    """
    if capacity <= 0 or capacity % unit:
        raise ValueError(f"capacity {capacity} is no multiple of {unit}")
    spark = docs.sparkSession
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(docs.mapInArrow(_pieces(tokenizer, capacity), PIECES), "pieces").withColumn(
        "size", F.ceil(F.col("length") / F.lit(unit)))
    counts = {r["size"]: r["count"] for r in pieces.groupBy("size").count().collect()}  # at most capacity / unit rows
    places = spark.createDataFrame(
        _places(cutting_stock(counts, capacity // unit)), "size long, first long, last long, sequence long, each long")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)))
    before = dealt.groupBy("size", "part").count().withColumn(
        "before", F.sum("count").over(W.partitionBy("size").orderBy("part")) - F.col("count"))
    own = W.partitionBy("size", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(own) - 1).join(
        before.drop("count"), ["size", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    # A few rows per pattern, however many documents there are.
    placed = ranked.join(F.broadcast(places), "size").filter("rank >= first AND rank < last").withColumn(
        "sequence_id", F.col("sequence") + F.floor((F.col("rank") - F.col("first")) / F.col("each")))
    inside = W.partitionBy("sequence_id")
    ordered = inside.orderBy(F.desc("length"), "doc_id", "start", "rank")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        (F.sum("length").over(ordered) - F.col("length")).alias("offset"),
        F.sum("length").over(inside).alias("sequence_length"),
    )
