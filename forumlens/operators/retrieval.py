"""Text chunks, their vectors, and exact nearest chunks for questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forumlens.fixed import CHUNK_COMMENTS, CONTEXT_SEPARATOR, EMBED_BATCH, TOP_K
from forumlens.functions.columns import first_text, l2_norm, present, strip, to_int
from forumlens.functions.keyed import arrival, keep_one, keep_top

# Bytes of vectors in a block of the index or of the questions, and rows that a
# task holds for a block of questions (questions times k).
PAGE_BYTES, PAGE_ROWS = 4 * 1024 * 1024, 1_000_000
# Scores of a page and a tile of chunks held at a time, per task: 32 MB.
TILE_SCORES = 4_000_000
SCORE_DIGITS = 6


def build_chunks(
    posts: DataFrame,
    comments: DataFrame | None,
    max_comments: int = CHUNK_COMMENTS,
    fallback_to_content: bool = False,
) -> DataFrame:
    """One text per post: title, body and its first comments that have text.

    Comments are cut to the first ``max_comments`` per post before they are
    gathered, so no list grows with the number of comments.
    """
    body = F.col("selftext")
    if fallback_to_content:
        body = first_text(body, F.col("content"))
    first = keep_one(posts.filter(present(F.col("id"))), ["id"], arrival(posts)).select(
        F.col("id").alias("post_id"), "subreddit", "author", "created_at",
        strip(F.coalesce("title", F.lit(""))).alias("title"),
        strip(F.coalesce(body, F.lit(""))).alias("_body"),
        "permalink", "score",
    )
    if comments is None:
        joined = first.withColumn("_comments", F.array().cast("array<string>"))
    else:
        said = strip(F.coalesce("body", F.lit("")))
        rank = to_int(F.col("comment_rank").cast("string"))
        ordered = [rank.asc_nulls_last(), F.col("comment_id").asc_nulls_last()]
        top = keep_top(
            comments.withColumn("_said", said).filter((F.col("_said") != "") & present(F.col("post_id"))),
            ["post_id"], ordered, max_comments, rank_as="_place",
        )
        lists = top.groupBy("post_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("_place", "_said"))), lambda c: c["_said"])
            .alias("_comments")
        )
        joined = first.join(lists, "post_id", "left")
    numbered = F.transform(
        F.coalesce("_comments", F.array().cast("array<string>")),
        lambda said, i: F.concat(F.lit("Comment "), (i + 1).cast("string"), F.lit(": "), said),
    )
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Title: "), F.col("title")),
        F.when(F.col("_body") != "", F.concat(F.lit("Post: "), F.col("_body"))),
        numbered,
    )
    return joined.withColumn("text", text).select(
        "post_id", "subreddit", "author", "created_at", "title", "text", "permalink", "score"
    )


def chunks_from_combined(combined: DataFrame, max_comments: int = CHUNK_COMMENTS) -> DataFrame:
    """The same from a combined export; an empty body falls back to the content."""
    named = {
        "id": "post_id", "subreddit": "post_subreddit", "author": "post_author",
        "created_at": "post_created_at", "title": "post_title", "selftext": "post_selftext",
        "content": "post_content", "permalink": "post_permalink", "score": "post_score",
    }
    rank = to_int(F.col("comment_rank"))
    posts = keep_one(
        combined.filter(present(F.col("post_id"))), ["post_id"],
        [rank.asc_nulls_last(), F.col("comment_id").asc_nulls_last(), *arrival(combined)],
    ).select(*[F.col(old).alias(new) for new, old in named.items()])
    comments = combined.filter(present(F.col("comment_id"))).select(
        "post_id", "comment_rank", "comment_id", F.col("comment_body").alias("body")
    )
    return build_chunks(posts, comments, max_comments, fallback_to_content=True)


def embed(
    df: DataFrame,
    text: str = "text",
    embedder: Callable[[list[str]], list] | None = None,
    dimensions: int = 256,
    batch: int = EMBED_BATCH,
) -> DataFrame:
    """Add ``embedding``: from a model, or hashed word counts without one.

    A model is called on the executors with a few texts at a time. The default
    needs no model, gives the same vector for the same text everywhere and has
    length 1. The bucket of a word is the first eight digits of its MD5, modulo
    the dimensions, which any engine can repeat.
    """
    if embedder is None:
        words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        buckets = F.transform(words, lambda w: (
            F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dimensions).cast("string"))
        names = [str(i) for i in range(dimensions)]
        counted = CountVectorizerModel.from_vocabulary(names, inputCol="_words", outputCol="_counts").transform(
            df.withColumn("_words", F.coalesce(buckets, F.array().cast("array<string>")))
        )
        unit = Normalizer(p=2.0, inputCol="_counts", outputCol="_unit").transform(counted)
        vector = vector_to_array(F.col("_unit"), "float32")
        return unit.withColumn("embedding", vector).drop("_words", "_counts", "_unit")

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in columns:
            found = []
            for at in range(0, len(texts), batch):
                part = embedder(list(texts.iloc[at:at + batch]))
                found.extend(np.asarray(v, dtype=np.float32) for v in part)
            yield pd.Series(found, index=texts.index)

    return df.withColumn("embedding", vectors(F.col(text)))


def build_index(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Scale vectors to length 1; a zero vector stays zero."""
    # The norm is no part of the lambda: where Spark moves a filter on the vector down, it would be worked out per element.
    norms = F.array_repeat("norm", F.size(vector))
    return df.withColumn("norm", l2_norm(F.col(vector))).withColumn(
        vector,
        F.zip_with(
            vector, norms, lambda x, norm: F.when(norm == 0, F.lit(0.0)).otherwise(x.cast("double") / norm).cast("float")
        ),
    )


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of vectors as a matrix, taken from the Arrow buffer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.float64)


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


class _Best:
    """The k best chunks per question seen so far in one partition."""

    def __init__(self, questions: int, k: int):
        self.k = k
        self.question = np.empty(0, dtype=np.int64)
        self.id: np.ndarray | None = None
        self.score = np.empty(0)
        # Score a chunk has to reach to be among the k of a question.
        self.floor = np.full(questions, -np.inf)

    def add(self, scores: np.ndarray, ids: np.ndarray, who: np.ndarray | None = None) -> None:
        """Take in the scores of some chunks, a row per question (of those in ``who``)."""
        need = self.floor if who is None else self.floor[who]
        if scores.shape[1] > self.k:
            need = np.maximum(need, np.partition(scores, -self.k, axis=1)[:, -self.k])
        question, chunk = np.nonzero(scores >= need[:, None])
        self.take(question if who is None else who[question], ids[chunk], scores[question, chunk])

    def take(self, question: np.ndarray, found: np.ndarray, score: np.ndarray) -> None:
        """Take in single scores: question, chunk and score of each."""
        if not len(question):
            return
        question = np.concatenate([self.question, question])
        found = found if self.id is None else np.concatenate([self.id, found])
        score = np.concatenate([self.score, score])
        # By question, best score first, equals by id.
        order = np.lexsort((np.unique(found, return_inverse=True)[1], -score, question))
        question = question[order]
        _, start, size = np.unique(question, return_index=True, return_counts=True)
        place = np.arange(len(question)) - np.repeat(start, size)
        keep = order[place < self.k]
        self.question, self.id, self.score = question[place < self.k], found[keep], score[keep]
        full = place[place < self.k] == self.k - 1
        self.floor[self.question[full]] = self.score[full]


def _search(held: _Best, questions: np.ndarray, vectors: np.ndarray, ids: np.ndarray, who: np.ndarray | None = None) -> None:
    """Take in a block of chunks, for all questions or those in ``who``.

    Once every question has a floor, scores are worked out in four bytes first, and
    again in eight where they may reach it; ``slack`` is more than those can differ
    and rounding can add.
    """
    if who is not None:
        questions = questions[who]
    rough, slack = questions.astype(np.float32), 2e-6 + (questions.shape[1] + 8) * 2.0 ** -23
    step = max(1, TILE_SCORES // max(1, len(questions)))
    for at in range(0, len(ids), step):
        part, names = vectors[at:at + step], ids[at:at + step]
        floor = held.floor if who is None else held.floor[who]
        if not np.isneginf(floor).any():
            near = rough @ part.astype(np.float32).T >= (floor - slack).astype(np.float32)[:, None]
            # A few of many: their vectors are gathered.
            if np.count_nonzero(near) <= TILE_SCORES // (2 * questions.shape[1]):
                question, chunk = np.nonzero(near)
                scores = np.round(np.einsum("ij,ij->i", questions[question], part[chunk]), SCORE_DIGITS) + 0.0
                good = scores >= floor[question]
                question, chunk, scores = question[good], chunk[good], scores[good]
                held.take(question if who is None else who[question], names[chunk], scores)
                continue
        held.add(np.round(questions @ part.T, SCORE_DIGITS) + 0.0, names, who)


def _scored(k: int, key: str):
    """Best k chunks per question for rows that hold a block of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                asked, told = batch.column("asked")[row].values, batch.column("told")[row].values
                names, ids = asked.field(0), told.field(0).to_numpy(zero_copy_only=False)
                questions, vectors = _unit(_matrix(asked.field(1))), _unit(_matrix(told.field(1)))
                held = _Best(len(questions), k)
                _search(held, questions, vectors, ids)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(held.question)), pa.array(held.id, told.field(0).type), pa.array(held.score)],
                    ["question_id", key, "score"],
                )

    return run


def _in_blocks(df: DataFrame, name: str, number: Column, rows: int | None = None) -> tuple[DataFrame, int]:
    """(width, block, name): vectors dealt by a number to blocks of bounded size, and how many there are.

    Rows without a vector, or with a NULL in it, are left out.
    """
    whole = df.filter(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())).withColumn(
        "width", F.size("embedding")).filter("width > 0")
    count, width = whole.agg(F.count("*"), F.max("width")).first()
    per_block = max(1, min(PAGE_BYTES // (8 * (width or 1)), rows or PAGE_BYTES))
    blocks = max(1, -(-count // per_block))
    dealt = whole.withColumn("block", F.pmod(number, F.lit(blocks).cast("long")))
    items = F.collect_list(F.struct(*df.columns)).alias(name)
    return dealt.groupBy("width", "block").agg(items), blocks


def retrieve(
    questions: DataFrame,
    index: DataFrame,
    k: int = TOP_K,
    question_id: str = "question_id",
    key: str = "post_id",
) -> DataFrame:
    """The k chunks most similar to each question, by exact cosine.

    Questions and index are both cut into blocks of bounded size, and each block
    of questions meets each block of the index once. A task scores such a pair as
    matrix products and returns k rows per question, which are then ranked, so
    neither side is held by the driver and no pair of question and chunk leaves
    its task. Rows without a vector take no part, and vectors meet only those of
    their width. Scores are rounded so that the order of equals goes by key and
    does not depend on how rows were batched. ``index`` is to be read from a table.
    """
    key_type, id_type = dict(index.dtypes)[key], dict(questions.dtypes)[question_id]
    if k <= 0:
        return index.select(
            F.lit(None).cast(id_type).alias(question_id), key, F.lit(0.0).alias("score"), F.lit(1).alias("rank")
        ).limit(0)
    # A task that runs again must deal alike: the index is read from a table, questions may come out of a shuffle.
    told, count = _in_blocks(index.select(key, "embedding"), "told", F.monotonically_increasing_id())
    asked, _ = _in_blocks(
        questions.select(question_id, "embedding"), "asked", F.xxhash64(question_id, "embedding"), PAGE_ROWS // k)
    # Blocks of the index are all of one size, so their numbers are even keys.
    meets = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("block")
    pairs = told.join(asked.select("width", "asked", meets), ["width", "block"]).select("asked", "told")
    found = pairs.mapInArrow(_scored(k, key), f"question_id {id_type}, {key} {key_type}, score double")
    order = [F.desc("score"), F.col(key).asc()]
    top = keep_top(found, ["question_id"], order, k, rank_as="rank")
    return top.withColumnRenamed("question_id", question_id)


def with_chunks(top: DataFrame, chunks: DataFrame, key: str = "post_id") -> DataFrame:
    """Add title, text and link to retrieved rows."""
    return top.join(chunks.drop("embedding", "norm", *[c for c in top.columns if c != key]), key)


def context(top: DataFrame, question_id: str = "question_id") -> DataFrame:
    """The retrieved chunks of a question as one text, best first."""
    def text(name: str, default: str = "") -> Column:
        return F.coalesce(name, F.lit(default))

    block = F.concat(
        F.lit("[r/"), text("subreddit", "unknown"), F.lit(" | "), text("post_id"), F.lit(" | "),
        text("permalink"), F.lit("]\n"), text("text"),
    )
    # k blocks per question at most.
    blocks = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return top.groupBy(question_id).agg(
        F.array_join(F.transform(blocks, lambda b: b["block"]), CONTEXT_SEPARATOR).alias("context")
    )


def sources(top: DataFrame, question_id: str = "question_id") -> DataFrame:
    """Where the retrieved chunks come from."""
    return top.select(question_id, "rank", *[
        F.coalesce(c, F.lit("")).alias(c) for c in ("subreddit", "post_id", "permalink", "title")
    ])
