"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct word shingles as 64-bit hashes. Two
permutations make the whole signature: sigma moves each element to a place on a
circle of 2**32 places, pi ranks the places, and coordinate k is the smallest
rank after the circle is turned by k places. Both are bijections computed by
multiply and shift, so no table of them is needed.

Steps, each of which is a distributed job:

1. one pass over the texts: set size, fingerprint of the set, band keys;
2. equal sets are one class, represented by its smallest doc_id; an id of several
   rows is linked with the representatives of all of them;
3. band keys of the representatives: a bucket of two or more names its smallest
   and largest id as pivots, every member is paired with both. That is every
   pair in a bucket of three, and one star, not all pairs, in a large one;
4. pairs are verified on the full sets of their texts;
5. components of the links. A bucket whose members all fell into one component
   has nothing left to tell. In the others, members of different components
   are compared on their full sets, in pairs of blocks of bounded size.

A pair of Jaccard 0.8 shares no band with probability (1 - 0.8**6)**48 = 5e-7;
a pair that does share one is either verified or known to be connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.llm.common import (
    SLICE_BYTES, binary_texts, hand_back, mixed, shingle_hashes, slices, text_slices, word_hashes, words_of, written)
from forumlens.llm.components import components

BANDS, ROWS = 48, 6
#: Shingles of a block of documents that are compared each with each.
BLOCK_SHINGLES = 1_000_000
#: Rows of a batch whose texts are copied at a time.
ROWS_AT_ONCE = 500
#: Bits of the filter that tells which texts are named in a pair.
FILTER_BITS = 1 << 23


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    joined, starts, ends, first = words_of([t and t.lower() for t in texts])
    hashes = word_hashes(joined, starts, ends)
    return [np.unique(shingle_hashes(hashes[i:j], width)) for i, j in zip(first[:-1], first[1:])]


def _sigma(x: np.ndarray) -> np.ndarray:
    """Places on the circle for elements."""
    return (mixed(x ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def _pi(y: np.ndarray) -> np.ndarray:
    """Ranks of places: a permutation of the 32-bit numbers. Overwrites y."""
    y ^= y >> np.uint32(16)
    y *= np.uint32(0x7FEB352D)
    y ^= y >> np.uint32(15)
    y *= np.uint32(0x846CA68B)
    y ^= y >> np.uint32(16)
    return y


def circulant_signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Signatures (coordinates x sets) of non-empty sets."""
    places = _sigma(np.concatenate(sets))
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((coordinates, len(sets)), np.uint32)
    for k in range(coordinates):
        out[k] = np.minimum.reduceat(_pi(places + np.uint32(k)), starts)
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per set and band; the number of the band is part of it."""
    keys = np.empty((signatures.shape[1], bands), np.uint64)
    for b in range(bands):
        key = np.full(signatures.shape[1], b + 1, np.uint64)
        for row in signatures[b * rows:(b + 1) * rows]:
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + row)
        keys[:, b] = key
    return keys.view(np.int64)


def _sketch(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield from sketched(batch.slice(begin, ROWS_AT_ONCE))
            hand_back()

    def sketched(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("doc_id")
        for first, last, texts in text_slices(batch, "text"):
            sets = shingle_sets(texts, width)
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(circulant_signatures(full, bands * rows), bands, rows) if full else ())
            yield pa.record_batch({
                "doc_id": ids.slice(first, last - first),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "same": pa.array([xxhash.xxh3_128_digest(s) if len(s) else None for s in sets], pa.binary()),
                "keys": pa.array([next(keys) if len(s) else [] for s in sets], pa.list_(pa.int64())),
            })

    return run


def _overlap(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        for batch in batches:
            both, total = [], []
            for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(begin, ROWS_AT_ONCE)
                us, left, right = part.column("u").to_pylist(), binary_texts(part, "u_text"), binary_texts(part, "v_text")
                for first, end in slices(right):
                    for i, y in enumerate(shingle_sets(right[first:end], width), first):
                        if last[0] != (us[i], left[i]):
                            last = ((us[i], left[i]), shingle_sets([left[i]], width)[0])
                        x = last[1]
                        both.append(len(np.intersect1d(x, y, assume_unique=True)))
                        total.append(len(x) + len(y) - both[-1])
            yield pa.record_batch({
                "u": batch.column("u"), "v": batch.column("v"),
                "shared": pa.array(both, pa.int64()), "total": pa.array(total, pa.int64()),
            })
            hand_back()

    return run


def _bits(ids: np.ndarray, size: int) -> np.ndarray:
    """Two bits of a filter of so many for each id."""
    return (mixed(ids.view(np.uint64)[:, None] + np.array([1, 1 << 40], np.uint64)) % np.uint64(size)).astype(np.int64)


def _named(filled: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            at = _bits(ids, 8 * len(filled))
            yield batch.filter(pa.array(((filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)))

    return run


def only_named(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of texts (doc_id, text) that may be among the ids (id): all that are, and few others.

    A Bloom filter of at most FILTER_BITS bits, made by a distributed aggregate,
    spares the other texts the shuffle of the joins that follow. With many more
    ids than bits it lets more pass, and the joins decide as before.
    """
    size = 1 << 16
    count = ids.count()
    while size < min(FILTER_BITS, 16 * count):
        size *= 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bits(batch.column("id").to_numpy(), size).ravel()
            yield pa.record_batch({"byte": at >> 3, "bit": np.int64(1) << (at & 7)})

    rows = ids.select("id").mapInArrow(places, "byte long, bit long").groupBy("byte").agg(F.bit_or("bit").alias("bit"))
    filled = np.zeros(size // 8, np.uint8)
    for batch in rows.toArrow().to_batches():
        filled[batch.column("byte").to_numpy()] = batch.column("bit").to_numpy()
    return texts.filter("doc_id IS NOT NULL").mapInArrow(_named(filled), "doc_id long, text string")


def overlaps(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """u, v, shared, total: sizes of intersection and union of the full sets of each pair.

    Only texts named in a pair travel. A pivot of many pairs is a hot key of
    inner joins, which Spark splits by their measured size.
    """
    ids = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    texts = only_named(texts, ids)
    for side in "vu":
        own = texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"{side}_text"))
        pairs = pairs.join(own, side)
    return pairs.select("u", "v", "u_text", "v_text").mapInArrow(_overlap(width), "u long, v long, shared long, total long")


def _links(measured: DataFrame, percent: int) -> DataFrame:
    return measured.filter(f"shared > 0 AND 100 * shared >= {percent} * total").select("u", "v")


def _unsettled(members: DataFrame, found: DataFrame, sizes: DataFrame) -> DataFrame:
    """host, doc_id, n, label: members of buckets that span several components.

    The host of a bucket is the component most of its members belong to; buckets
    with the same host are taken together, so a document travels once and not
    once per band.
    """
    labelled = members.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn(
        "label", F.coalesce("component_id", "doc_id"))
    held = labelled.groupBy("key", "label").count()
    hosts = held.groupBy("key").agg(F.max(F.struct("count", "label")).alias("most"), F.count("*").alias("labels"))
    hosts = hosts.filter("labels > 1").select("key", F.col("most.label").alias("host"))
    left = labelled.join(hosts, "key").select("host", "doc_id", "label").distinct()
    return left.join(sizes.select("doc_id", F.col("most").alias("n")), "doc_id")


def _places(sets: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """The number of each element, in order of all that occur, set by set; how many occur. Uses up the sets.

    An array as large as all sets is held three times at most.
    """
    values = np.concatenate(sets)
    values.sort()
    values = values[np.concatenate([[True], values[1:] != values[:-1]])]
    places, at = np.empty(sum(map(len, sets)), np.int64), 0
    for i, own in enumerate(sets):
        places[at:at + len(own)] = np.searchsorted(values, own)
        at += len(own)
        sets[i] = None
    return places, len(values)


def _compare(width: int, percent: int):
    def run(group: pa.Table) -> pa.Table:
        found = compared(group)
        if group.nbytes >= SLICE_BYTES:
            hand_back()
        return found

    def compared(group: pa.Table) -> pa.Table:
        ids, labels, block = (group.column(c).to_numpy() for c in ("doc_id", "label", "block"))
        host, p, q = (group.column(c)[0].as_py() for c in ("host", "p", "q"))
        # Of the texts only those of a slice are copied.
        sets = [
            s for batch in group.select(["text"]).to_batches() for _, _, texts in text_slices(batch, "text")
            for s in shingle_sets(texts, width)]
        # Another row of an id may have no shingles: it has no links, and reduceat no place for it.
        full = np.array([len(s) > 0 for s in sets], bool)
        ids, labels, block, sets = ids[full], labels[full], block[full], [s for s in sets if len(s)]
        if not sets:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        sizes = np.array([len(s) for s in sets])
        starts = np.cumsum(sizes) - sizes
        places, size = _places(sets)
        marked = np.zeros(size, np.int32)
        us, vs = [], []
        # Any pair of two components has a member outside the host.
        for x in np.flatnonzero(labels != host):
            mine = places[starts[x]:starts[x] + sizes[x]]
            marked[mine] = 1
            shared = np.add.reduceat(marked[places], starts)
            marked[mine] = 0
            links = (100 * shared >= percent * (sizes + sizes[x] - shared)) & (labels != labels[x])
            if p != q:
                links &= block != block[x]
            # One link to each other component tells as much as all of them.
            _, one = np.unique(labels[links], return_index=True)
            vs += ids[links][one].tolist()
            us += [int(ids[x])] * len(one)
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def _compared(left: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between components, from every pair of members of different ones.

    Members of a host beyond BLOCK_SHINGLES are cut into blocks, and a group is
    a pair of blocks: no task holds more than two blocks.
    """
    blocks = left.groupBy("host").agg(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).alias("blocks"))
    placed = left.join(blocks, "host").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select(
        "host", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "doc_id", "label", "block")
    full = placed.join(only_named(texts, left.select(F.col("doc_id").alias("id")).distinct()), "doc_id")
    return full.groupBy("host", "p", "q").applyInArrow(_compare(width, percent), "u long, v long")


def _close(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose set sizes can reach the similarity."""
    for side in "uv":
        pairs = pairs.join(sizes.select(
            F.col("doc_id").alias(side), F.col("least").alias(f"least_{side}"), F.col("most").alias(f"most_{side}")), side)
    return pairs.filter(f"100 * most_u >= {percent} * least_v AND 100 * most_v >= {percent} * least_u").select("u", "v")


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs (doc_id, text).

    NULL and empty texts have no shingles and are linked with nothing. Rows that
    repeat a doc_id are one document with the links of all of them. A NULL
    doc_id has no component (NULL) and is kept. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, same binary, keys array<long>"
    sketch = written(docs.mapInArrow(_sketch(width, bands, rows), schema), "sketch")
    alike = sketch.filter("same IS NOT NULL AND doc_id IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("rep"))
    same = sketch.select("doc_id", "n_shingles", "same").join(alike, "same", "left").withColumn(
        "rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    repeated = written(sketch.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1"), "repeated")

    first = sketch.filter("doc_id IS NOT NULL").join(
        alike.select("same", F.col("rep").alias("doc_id")), ["same", "doc_id"], "left_semi")
    keyed = first.select("doc_id", F.explode("keys").alias("key"))
    ends = keyed.groupBy("key").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("size")).filter("lo < hi")
    members = written(keyed.join(ends, "key"), "members")
    pairs = members.filter("doc_id != lo").select(F.col("lo").alias("u"), F.col("doc_id").alias("v")).unionByName(
        members.filter("doc_id != lo AND doc_id != hi").select(F.col("hi").alias("u"), F.col("doc_id").alias("v"))
    ).distinct()
    sizes = first.groupBy("doc_id").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    pairs = written(_close(pairs, sizes, percent), "close")
    measured = written(overlaps(pairs, docs, width), "pairs")
    links = _links(measured, percent)
    if not repeated.isEmpty():
        links = links.unionByName(written(same.join(repeated, "doc_id", "left_semi").filter("rep != doc_id").select(
            F.col("rep").alias("u"), F.col("doc_id").alias("v")).distinct(), "own"))
    found = written(components(links), "found")
    left = written(_unsettled(members.filter("size > 3").select("key", "doc_id"), found, sizes), "open")
    if not left.isEmpty():
        links = links.unionByName(_compared(left, docs, width, percent))
        found = written(components(links), "found")
    rooted = same.join(found.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "rep", "doc_id"))
    return rooted.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
