"""Exact nearest chunks from an index whose blocks know where they lie.

``write_located`` deals vectors to blocks by the nearest of some pivots and keeps with
each block its centre and its radius, the greatest angle between them. No vector
of a block can be nearer to a question than the angle to its centre less its radius. A
search scores the HOME most promising blocks of each question first; their k-th score is a
floor, and only blocks whose bound reaches it are scored as well. The result is that
of ``retrieve``. How many pairs of question and block are scored depends on the
data: few where vectors lie in clusters, and at worst, where all blocks overlap, all
of them, as ``retrieve`` does, besides two passes over the centres.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlens.functions.keyed import keep_top
from forumlens.operators.retrieval import PAGE_BYTES, PAGE_ROWS, _Best, _in_blocks, _matrix, _scored, _search, _unit
from forumlens.session import scratch_folder
from forumlens.sources.tables import read_version, write_version

#: Pivots of a width at most, bytes of all pivots, blocks of a question that are scored first.
PIVOTS, PIVOT_BYTES, HOME = 1024, 8 << 20, 2
#: Angles are computed to about this; scores of ``retrieve`` are rounded to six digits.
SLACK = 1e-6


def _pivots(rows: DataFrame, key: str, count: int, width: int, per_block: int) -> dict[int, np.ndarray]:
    """Some vectors of each width, by a hash of their key: one for each block, within bounds."""
    wanted = max(1, min(PIVOTS, PIVOT_BYTES // (8 * width), -(-count // per_block)))
    order = F.xxhash64(key, "embedding")
    if count > 4 * wanted:
        # Hashes are even: about four times as many are left to be sorted.
        rows = rows.filter(order < -(1 << 63) + int((1 << 64) * 4 * wanted / count))
    held: dict[int, list] = {}
    for row in rows.select("width", "embedding").orderBy(order).limit(wanted).collect():
        held.setdefault(row["width"], []).append(row["embedding"])
    return {w: _unit(np.array(v, np.float64)) for w, v in held.items()}


def _nearest(pivots: dict[int, np.ndarray], key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int64)
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths):
                if width in pivots:
                    at = np.flatnonzero(widths == width)
                    rows = _unit(_matrix(batch.column("embedding").take(pa.array(at))))
                    cell[at] = (rows @ pivots[width].T).argmax(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("width"), pa.array(cell), batch.column(key), batch.column("embedding")],
                ["width", "cell", key, "embedding"])

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Centre, radius and the number of rows of each block, and whether it has a vector of length 0."""
    for batch in batches:
        centres, radii, zeros, sizes = [], [], [], []
        for row in range(batch.num_rows):
            vectors = _unit(_matrix(batch.column("told")[row].values.field(1)))
            long = np.abs(vectors).sum(1) > 0
            centre = _unit(vectors[long].sum(0, keepdims=True))[0]
            near = np.clip(vectors[long] @ centre, -1, 1).min(initial=1.0) if centre.any() else -1.0
            centres.append(centre)
            radii.append(float(np.arccos(near)))
            zeros.append(not long.all())
            sizes.append(len(vectors))
        yield pa.RecordBatch.from_arrays([
            batch.column("width"), batch.column("block"), batch.column("told"), pa.array(centres, pa.list_(pa.float64())),
            pa.array(radii, pa.float64()), pa.array(zeros, pa.bool_()), pa.array(sizes, pa.int64())],
            ["width", "block", "told", "centre", "radius", "zero", "size"])


def write_located(index: DataFrame, table: str, key: str = "post_id", per_block: int | None = None) -> DataFrame:
    """Write an index (key, embedding) by blocks of like vectors as a new version of a table; returns its blocks.

    Rows without a vector, or with a NULL in it, are left out. A cell of a pivot that
    is larger than a block becomes several blocks.
    """
    spark = index.sparkSession
    whole = index.select(key, "embedding").filter(
        F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())).withColumn(
        "width", F.size("embedding")).filter("width > 0")
    count, width = whole.agg(F.count("*"), F.max("width")).first()
    per_block = max(1, min(PAGE_BYTES // (8 * (width or 1)), per_block or PAGE_BYTES))
    pivots = _pivots(whole, key, count, width or 1, per_block)
    kinds = dict(whole.dtypes)
    dealt = scratch_folder(spark, "located")
    schema = f"width int, cell long, `{key}` {kinds[key]}, embedding {kinds['embedding']}"
    whole.select("width", key, "embedding").mapInArrow(_nearest(pivots, key), schema).write.parquet(dealt)
    rows = spark.read.schema(schema).parquet(dealt)
    # A row per pivot; rows are numbered where they lie, in a table that does not change.
    parts = rows.groupBy("width", "cell").agg(F.ceil(F.count("*") / F.lit(per_block)).alias("parts"))
    blocks = rows.withColumn("number", F.monotonically_increasing_id()).join(F.broadcast(parts), ["width", "cell"]).select(
        "width", (F.col("cell") * F.lit(1 << 32) + F.pmod("number", "parts")).alias("block"), F.struct(key, "embedding").alias("row"))
    packed = blocks.groupBy("width", "block").agg(F.collect_list("row").alias("told"))
    told = dict(packed.dtypes)["told"]
    write_version(packed.mapInArrow(
        _placed, f"width int, block long, told {told}, centre array<double>, radius double, zero boolean, size long"), table)
    return read_version(spark, table)


def read_located(spark: SparkSession, table: str) -> DataFrame | None:
    """The blocks of the newest version."""
    return read_version(spark, table)


def _bounds(asked: pa.Array, page: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The best score any vector of each block can have with each question, and the blocks."""
    questions, centres = _unit(_matrix(asked.field(1))), _matrix(page.field("centre"))
    radius, zero = (page.field(c).to_numpy(zero_copy_only=False) for c in ("radius", "zero"))
    angle = np.arccos(np.clip(questions @ centres.T, -1, 1)) - radius[None, :]
    bound = np.cos(np.maximum(angle, 0)) + SLACK
    return np.where(zero[None, :], np.maximum(bound, SLACK), bound), page.field("block").to_numpy()


def _promising(home: int):
    """The blocks with the highest bounds for each question of a page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                asked = batch.column("asked")[row].values
                bound, block = _bounds(asked, batch.column("page")[row].values)
                best = np.argsort(-bound, axis=1, kind="stable")[:, :home]
                who = np.repeat(np.arange(len(best)), best.shape[1])
                yield pa.RecordBatch.from_arrays([
                    asked.field(0).take(pa.array(who)), pa.array(block[best.ravel()]),
                    pa.array(np.take_along_axis(bound, best, 1).ravel())], ["question_id", "block", "bound"])

    return run


def _open(asked: pa.Array, page: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which blocks have a bound that reaches the floor of each question, but for those that were scored; the blocks."""
    bound, block = _bounds(asked, page)
    open_ = bound >= asked.field("floor").to_numpy(zero_copy_only=False)[:, None] - SLACK
    done = asked.field("home")
    who = np.repeat(np.arange(len(done)), pc.list_value_length(done).to_numpy(zero_copy_only=False))
    order = np.argsort(block)
    homes = done.flatten().to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(block[order], homes), len(block) - 1)
    here = block[order][at] == homes
    open_[who[here], order[at[here]]] = False
    return open_, block


def _reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The open blocks of each question."""
    for batch in batches:
        for row in range(batch.num_rows):
            asked = batch.column("asked")[row].values
            open_, block = _open(asked, batch.column("page")[row].values)
            who, which = np.nonzero(open_)
            yield pa.RecordBatch.from_arrays(
                [asked.field(0).take(pa.array(who)), pa.array(block[which])], ["question_id", "block"])


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks that are open for any question of a sheet."""
    for batch in batches:
        for row in range(batch.num_rows):
            open_, block = _open(batch.column("asked")[row].values, batch.column("page")[row].values)
            block = block[open_.any(0)]
            yield pa.RecordBatch.from_arrays([
                pa.array([batch.column(c)[row].as_py()] * len(block), batch.column(c).type) for c in ("width", "sheet")]
                + [pa.array(block)], ["width", "sheet", "block"])


def _scored_open(k: int, key: str):
    """Best k chunks per question of a sheet, from the blocks that are open for it.

    Rows of one sheet that follow each other share its floors, which rise as blocks are scored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sheet = names = questions = held = kind = None

        def best() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [names.take(pa.array(held.question)), pa.array(held.id, kind), pa.array(held.score)],
                ["question_id", key, "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                own = tuple(batch.column(c)[row].as_py() for c in ("width", "sheet"))
                asked, place = batch.column("asked")[row].values, batch.column("place").slice(row, 1)
                if own != sheet:
                    if held is not None and len(held.question):
                        yield best()
                    sheet, names, questions = own, asked.field(0), _unit(_matrix(asked.field(1)))
                    held = _Best(len(names), k)
                    held.floor = asked.field("floor").to_numpy(zero_copy_only=False).copy()
                told = batch.column("told")[row].values
                kind = told.field(0).type
                # Against the floors as they came, so that what is scored does not hang on the order of rows.
                who = np.flatnonzero(_open(asked, place)[0][:, 0])
                if len(who):
                    _search(held, questions, _unit(_matrix(told.field(1))), told.field(0).to_numpy(zero_copy_only=False), who)
        if held is not None and len(held.question):
            yield best()

    return run


@dataclass(frozen=True)
class Found:
    """The nearest chunks, and the pairs (question_id, block) that were scored for them."""

    top: DataFrame
    scored: DataFrame


def retrieve_located(
    questions: DataFrame, blocks: DataFrame, k: int = 5, question_id: str = "question_id", key: str = "post_id", home: int = HOME
) -> Found:
    """The k chunks most similar to each question, by exact cosine, as ``retrieve`` gives them.

    ``blocks`` comes from ``write_located``. Questions have distinct ids.
    """
    key_type = blocks.schema["told"].dataType.elementType[key].dataType.simpleString()
    id_type = dict(questions.dtypes)[question_id]
    own = questions.select(F.col(question_id).alias("question_id"), "embedding")
    number, per_page = F.xxhash64("question_id"), max(1, PAGE_ROWS // max(k, 1))

    # Centres in pages of bounded size, which every page of questions meets once.
    places = blocks.select("width", "block", "centre", "radius", "zero")
    located, width = blocks.agg(F.count("*"), F.max("width")).first()
    pages = max(1, -(-located * max(width or 1, 1) * 8 // PAGE_BYTES))
    paged = places.withColumn("number", F.pmod(F.xxhash64("block"), F.lit(pages).cast("long"))).groupBy("width", "number").agg(
        F.collect_list(F.struct("block", "centre", "radius", "zero")).alias("page"))
    meets = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pages - 1).cast("long"))).alias("number")

    def against(asked: DataFrame) -> DataFrame:
        told, _ = _in_blocks(asked, "asked", number, per_page)
        return told.select("width", "asked", meets).join(paged, ["width", "number"]).select("asked", "page")

    def scores(pairs: DataFrame) -> DataFrame:
        """Best k rows of each question and block, from pages of the questions that ask for a block."""
        vectors = own.withColumn("width", F.size("embedding"))
        parts = max(1, -(-own.count() // per_page))
        listed = pairs.join(vectors, "question_id").withColumn("part", F.pmod(number, F.lit(parts).cast("long"))).groupBy(
            "width", "block", "part").agg(F.collect_list(F.struct("question_id", "embedding")).alias("asked"))
        both = listed.join(blocks.select("width", "block", "told"), ["width", "block"]).select("asked", "told")
        return both.mapInArrow(_scored(k, key), f"question_id {id_type}, `{key}` {key_type}, score double")

    order = [F.desc("score"), F.col(key).asc()]
    best = against(own).mapInArrow(_promising(home), f"question_id {id_type}, block long, bound double")
    first = _stored(keep_top(best, ["question_id"], [F.desc("bound"), F.asc("block")], home).select("question_id", "block"), "home")
    near = _stored(keep_top(scores(first), ["question_id"], order, k), "near")
    # Fewer than k so far: no floor.
    floors = near.groupBy("question_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).select(
        "question_id", F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(-2.0)).alias("floor"))
    homes = first.groupBy("question_id").agg(F.collect_list("block").alias("home"))
    told = own.join(floors, "question_id").join(homes, "question_id").withColumn("width", F.size("embedding"))

    # Questions lie in sheets by a block of their own, so that those of a sheet need much the same
    # blocks. Sheets and blocks meet in a grid of about as many rows and columns, so that each
    # travels as often as the square root of their number tells, not once per pair.
    count, per_sheet = told.count(), max(1, min(per_page, PAGE_BYTES // (8 * (width or 1))))
    sheets, columns = max(1, -(-count // per_sheet)), max(1, math.isqrt(located))
    lines = max(1, sheets // columns)
    near_block = F.array_min("home")
    parts = told.groupBy(near_block.alias("near")).agg(F.ceil(2 * F.count("*") / F.lit(per_sheet)).alias("parts"))
    dealt = told.withColumn("near", near_block).join(F.broadcast(parts), "near").withColumn(
        "sheet", F.pmod(F.xxhash64("near", F.pmod(number, "parts")), F.lit(sheets).cast("long")))
    asked = _stored(dealt.groupBy("width", "sheet").agg(
        F.collect_list(F.struct("question_id", "embedding", "floor", "home")).alias("asked")), "asked")
    meeting = asked.select("width", "sheet", "asked", meets).join(paged, ["width", "number"])
    column = F.pmod(F.xxhash64("block"), F.lit(columns).cast("long")).alias("column")
    line = F.pmod(F.xxhash64("sheet"), F.lit(lines).cast("long"))
    needed = _stored(meeting.select("width", "sheet", "asked", "page").mapInArrow(
        _needed, "width int, sheet long, block long"), "needed")
    wanted = needed.groupBy("width", "sheet", column).agg(F.collect_list("block").alias("wanted"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lines - 1).cast("long"))).alias("line")
    sent = asked.join(wanted, ["width", "sheet"]).withColumn("line", line)
    chunks = blocks.select("width", column, F.struct("block", "centre", "radius", "zero").alias("place"), "told", every)
    both = sent.join(chunks, ["width", "column", "line"]).filter(F.array_contains("wanted", F.col("place.block")))
    others = both.select("width", "sheet", "asked", "place", "told").mapInArrow(
        _scored_open(k, key), f"question_id {id_type}, `{key}` {key_type}, score double")
    second = meeting.select("asked", "page").mapInArrow(_reaching, f"question_id {id_type}, block long")
    top = keep_top(near.unionByName(others), ["question_id"], order, k, rank_as="rank")
    return Found(top.withColumnRenamed("question_id", question_id), first.unionByName(second))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
