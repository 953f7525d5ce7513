"""What the operators of this folder share: reading, scratch tables, hashing.

Words are runs of bytes other than space and 0x09-0x0D of the UTF-8 text, as
``bytes.split()`` gives them; ``bytes.lower()`` touches A-Z alone.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlens.session import scratch_folder

#: Bytes of text that a task turns into arrays at a time.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, written in the shared folder and read again.

    That cuts the lineage: a lost executor later costs a read, not a second run.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; NULL ids count as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the word hash and of its inverse, modulo 2**64."""
    global _BASE, _INVERSE
    if len(_BASE) < n:
        base, size = 0x9E3779B97F4A7C15, max(n + n // 8, SLICE_BYTES * 5 // 4)
        _BASE, _INVERSE = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        _BASE[0] = _INVERSE[0] = 1
        np.cumprod(_BASE, out=_BASE), np.cumprod(_INVERSE, out=_INVERSE)
    return _BASE, _INVERSE


def powers_of(n: int) -> np.ndarray:
    """The first n powers of the base of the word hash, modulo 2**64."""
    return _powers(n)[0][:n]


_BASE = _INVERSE = np.zeros(0, np.uint64)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def words_of(texts: list[bytes | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Texts joined by line ends; start and end of each word in that; first word of each text and one more.

    Nothing is split or looked up one by one, so memory follows the bytes given.
    """
    joined = b"\n".join(t or b"" for t in texts) + b"\n"
    space = np.concatenate([[True], _SPACE[np.frombuffer(joined, np.uint8)]])
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    borders = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
    return joined, starts, ends, np.searchsorted(starts, borders)


def word_hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a polynomial over mixed bytes, and the length."""
    base, inverse = _powers(len(joined))
    values = mixed(np.arange(1, 257, dtype=np.uint64))[np.frombuffer(joined, np.uint8)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * base[:len(joined)])])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash per window of so many words, in order.

    Fewer words than that are one shingle, no words none.
    """
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    out = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        out = mixed(out + hashes[j:n - width + 1 + j])
    return out


def binary_texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A text column of a batch as bytes, without decoding it."""
    return batch.column(name).cast(pa.large_binary()).to_pylist()


def rows_where(
    docs: DataFrame, test: Callable[[list[bytes | None]], np.ndarray], name: str = "text", size: int = SLICE_BYTES
) -> DataFrame:
    """The rows of docs whose text passes a test of many texts, as they are and where they are: nothing is shuffled.

    ``size`` bytes of text or a little more are tested at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in text_slices(batch, name, size):
                yield batch.slice(first, last - first).filter(pa.array(test(texts), pa.bool_()))
            hand_back()

    return docs.mapInArrow(run, docs.schema)


def hand_back() -> None:
    """Give freed memory back to the system: a worker outlives its task, and the stages that follow share its machine."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def text_slices(batch: pa.RecordBatch, name: str, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """Runs of rows (first, last + 1) of about so many bytes with their texts; only those of one run are copied."""
    column = batch.column(name)
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        done = ends[first - 1] if first else 0
        last = min(int(np.searchsorted(ends, done + size)) + 1, len(ends))
        yield first, last, column.slice(first, last - first).cast(pa.large_binary()).to_pylist()
        first = last


def slices(texts: list[bytes | None], size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, last + 1) of about so many bytes; long texts stand alone."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or b"")
        if held >= size:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
