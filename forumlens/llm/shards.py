"""Token sequences in training order, as shards of fixed stride.

Documents are encoded, each ends with END_ID, and the stream of all of them is cut
into sequences of ``length`` tokens. A keyed Feistel permutation over the sequence
numbers 0..n-1 gives every sequence its slot in the training order; results beyond
n are permuted again until they fall inside (cycle walking), so slots are dense.
Shard s holds slots s * per_shard onwards, each in ``length`` numbers of two or
four bytes: slot k starts at byte (k mod per_shard) * stride of its shard, and a
reader can stop and go on anywhere.

Slots are dealt to tasks by range, and a task writes its shards one after the
other, each under a name of its own that is changed when it is whole, so a task
that runs twice leaves one file.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forumlens.llm.common import binary_texts, mixed, slices, written
from forumlens.llm.packing import ENCODE_BYTES
from forumlens.llm.pretokens import encoded, word_ids
from forumlens.session import scratch_folder

LENGTH, PER_SHARD, END_ID, ROUNDS = 2048, 1024, 1, 4


@dataclass(frozen=True)
class Order:
    """A permutation of 0..count-1 by a key."""

    count: int
    key: int

    @property
    def half(self) -> np.uint64:
        """Bits of each half of a number."""
        return np.uint64(max(1, -(-max(self.count - 1, 1).bit_length() // 2)))

    def _round(self, x: np.ndarray, k: int) -> np.ndarray:
        secret = mixed(np.array([(self.key + k * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64))
        return mixed(x ^ secret) & ((np.uint64(1) << self.half) - np.uint64(1))

    def _walked(self, x: np.ndarray, step) -> np.ndarray:
        x = step(np.asarray(x).astype(np.uint64))
        while (outside := x >= np.uint64(self.count)).any():
            x[outside] = step(x[outside])
        return x.astype(np.int64)

    def slots(self, sequences: np.ndarray) -> np.ndarray:
        def step(x):
            left, right = x >> self.half, x & ((np.uint64(1) << self.half) - np.uint64(1))
            for k in range(ROUNDS):
                left, right = right, left ^ self._round(right, k)
            return (left << self.half) | right

        return self._walked(sequences, step)

    def sequences(self, slots: np.ndarray) -> np.ndarray:
        """The other way round."""
        def step(x):
            left, right = x >> self.half, x & ((np.uint64(1) << self.half) - np.uint64(1))
            for k in reversed(range(ROUNDS)):
                left, right = right ^ self._round(left, k), left
            return (left << self.half) | right

        return self._walked(slots, step)


def _encoded(tokenizer: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, before = word_ids(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, doc_ids = binary_texts(batch, "text"), batch.column("doc_id")
            for first, last in slices(texts, ENCODE_BYTES):
                ids, at = encoded(texts[first:last], ids_of)
                streams = [np.append(ids[i:j], np.uint32(END_ID)).astype(kind) for i, j in zip(at[:-1], at[1:])]
                sizes = np.array([len(s) for s in streams])
                yield pa.record_batch({
                    "part": pa.array([part] * len(sizes), pa.int64()),
                    "start": pa.array(before + np.cumsum(sizes) - sizes, pa.int64()),
                    "doc_id": doc_ids.slice(first, last - first), "n": pa.array(sizes, pa.int64()),
                    "ids": pa.array([s.tobytes() for s in streams], pa.binary()),
                })
                before += int(sizes.sum())

    return run


def _cut(order: Order, length: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Ids of two bytes hardly shrink by Spark's own compression of the shuffle.
        zipped = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            sequence, place, doc, pieces = [], [], [], []
            for start, doc_id, data in zip(*(batch.column(c).to_pylist() for c in ("start", "doc_id", "ids"))):
                at, end = start, start + len(data) // width
                while at < end:
                    until = min(end, (at // length + 1) * length)
                    sequence.append(at // length)
                    place.append(at % length)
                    doc.append(doc_id)
                    pieces.append(zipped(data[(at - start) * width:(until - start) * width]))
                    at = until
            yield pa.record_batch({
                "slot": pa.array(order.slots(np.array(sequence, np.int64)), pa.int64()),
                "sequence": pa.array(sequence, pa.int64()), "place": pa.array(place, pa.int64()),
                "doc_id": pa.array(doc, pa.int64()), "ids": pa.array(pieces, pa.binary()),
            })

    return run


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _write_shards(folder: str, kind: str, length: int, per_shard: int, count: int):
    """Writes the shards of a partition one after the other, from rows sorted by slot."""
    def write(shard: int, rows: np.ndarray) -> None:
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        partial = posixpath.join(path, f".{shard_name(shard)}.{uuid.uuid4().hex}")
        with system.open_output_stream(partial) as out:
            out.write(rows.tobytes())
        system.move(partial, posixpath.join(path, shard_name(shard)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzipped, open_shard = zstandard.ZstdDecompressor().decompress, None
        rows = filled = sequences = docs = None

        def closed() -> pa.RecordBatch:
            write(open_shard, rows)
            slots = open_shard * per_shard + np.arange(len(rows))
            return pa.record_batch({
                "slot": pa.array(slots, pa.int64()), "sequence": pa.array(sequences, pa.int64()),
                "shard": pa.array([open_shard] * len(rows), pa.int64()),
                "byte_offset": pa.array(np.arange(len(rows)) * rows.strides[0], pa.int64()),
                "n_tokens": pa.array(filled, pa.int64()), "first_doc_id": pa.array(docs, pa.int64()),
            })

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("slot", "sequence", "place", "doc_id", "ids"))
            for slot, sequence, place, doc_id, data in zip(*columns):
                if slot // per_shard != open_shard:
                    if open_shard is not None:
                        yield closed()
                    open_shard = slot // per_shard
                    n = min(per_shard, count - open_shard * per_shard)
                    rows = np.full((n, length), END_ID, kind)
                    filled, sequences, docs = np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n
                at, ids = slot % per_shard, np.frombuffer(unzipped(data), kind)
                rows[at, place:place + len(ids)] = ids
                filled[at] += len(ids)
                sequences[at] = sequence
                if place == 0:
                    docs[at] = doc_id
        if open_shard is not None:
            yield closed()

    return run


@dataclass(frozen=True)
class Written:
    """A folder of shards: its manifest (a row per slot) and its shape."""

    folder: str
    manifest: DataFrame
    count: int
    length: int
    per_shard: int
    kind: str


def write_shards(
    docs: DataFrame, folder: str, key: int = 0, tokenizer: str | None = None, length: int = LENGTH,
    per_shard: int = PER_SHARD, kind: str = "<u2",
) -> Written:
    """Encode docs (doc_id, text) and write all their sequences in training order.

    A NULL or empty text is the end id alone; NULL and repeated ids are rows like
    any other; other columns are ignored. The last sequence is filled up with the
    end id, ``n_tokens`` tells how far it is real. Without rows there are no
    shards. ``folder`` is a path or URI that all executors reach; ``kind`` must
    hold the largest id of the tokenizer.
    """
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    streams = texts.mapInArrow(_encoded(tokenizer, kind), "part long, start long, doc_id long, n long, ids binary")
    # Encoded once; long pages of ids are worth a higher level of compression.
    kept = scratch_folder(spark := docs.sparkSession, "tokens")
    streams.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", 6).parquet(kept)
    tokens = spark.read.schema(streams.schema).parquet(kept)
    # One row per partition of the scan.
    parts = tokens.groupBy("part").agg(F.sum("n").alias("n")).withColumn(
        "before", F.sum("n").over(W.orderBy("part")) - F.col("n"))
    total = tokens.agg(F.sum("n")).first()[0] or 0
    count = -(-total // length)
    moved = tokens.join(F.broadcast(parts.select("part", "before")), "part").select(
        (F.col("start") + F.col("before")).alias("start"), "doc_id", "ids")
    width = np.dtype(kind).itemsize
    pieces = moved.mapInArrow(
        _cut(Order(count, key), length, width), "slot long, sequence long, place long, doc_id long, ids binary")
    # Partition p has the shards from p * run onwards. Slots are dense and shards of one
    # size, so these ranges are even without a sample, whatever the documents are.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    run = max(1, -(-count // (per_shard * tasks))) * per_shard
    ranged = pieces.repartitionById(tasks, F.floor(F.col("slot") / F.lit(run)).cast("int"))
    shards = ranged.sortWithinPartitions("slot", "place").mapInArrow(
        _write_shards(folder, kind, length, per_shard, count),
        "slot long, sequence long, shard long, byte_offset long, n_tokens long, first_doc_id long")
    return Written(folder, written(shards, "manifest"), count, length, per_shard, kind)


def read_slots(spark: SparkSession, shards: Written, first: int = 0, last: int | None = None) -> DataFrame:
    """slot, ids (binary) of the slots first..last-1, read from the shards that hold them."""
    last = shards.count if last is None else min(last, shards.count)
    schema, stride = "slot long, ids binary", shards.length * np.dtype(shards.kind).itemsize
    if first >= last:
        return spark.createDataFrame([], schema)
    paths = [
        posixpath.join(shards.folder, shard_name(s)) for s in range(first // shards.per_shard, (last - 1) // shards.per_shard + 1)]
    per_shard = shards.per_shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                begin = int(path.rsplit("shard-", 1)[1].split(".")[0]) * per_shard
                slots = range(begin, begin + len(content) // stride)
                keep = [s for s in slots if first <= s < last]
                yield pa.record_batch({
                    "slot": pa.array(keep, pa.int64()),
                    "ids": pa.array([content[(s - begin) * stride:(s - begin + 1) * stride] for s in keep], pa.binary()),
                })

    reader = spark.read.format("binaryFile")
    # All shards of the folder are named by it, not one by one.
    files = reader.load(paths) if len(paths) <= 1000 else reader.option("pathGlobFilter", "shard-*.bin").load(shards.folder)
    return files.select("path", "content").mapInArrow(run, schema)


def training_order(docs: DataFrame, key: int = 0) -> DataFrame:
    """slot, sequence, shard, byte_offset, n_tokens, first_doc_id, ids_crc32: the manifest, and what reading back gives.

    The crc is of the whole record as it lies in the shard. ``first_doc_id`` is the
    document that the sequence begins in.
    """
    spark = docs.sparkSession
    shards = write_shards(docs, scratch_folder(spark, "shards"), key)
    read = read_slots(spark, shards).select("slot", F.crc32("ids").alias("ids_crc32"))
    return shards.manifest.join(read, "slot")
