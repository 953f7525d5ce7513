"""Exact top-k by inner product: dual-tree search over cover trees.

Vectors become whole numbers, floor(1024 x) for each component. Data and queries
are dealt to sheets, and a task takes one sheet of each. It holds the queries, in
blocks with a cover tree each; the data pass by in blocks, on each of which a tree
is built once. Pairs of nodes of two trees are walked. For a query node with centre
q and covering radius s and
a data node with centre p and radius r no inner product inside exceeds

    q.p + s |p| + r |q| + s r

so the pair is dropped if that is below the worst k-th score among the queries of
the node, which the blocks before have raised. What is left ends in products of
leaves, which are exact in float64 as long as no sum of products reaches 2**53;
larger ones are summed as Python integers. Each task returns at most k rows per
query (and as many per block of numbers that large), and the best k of those of
all sheets are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.functions.keyed import keep_top

SCALE = 1024
#: Vectors of a data block and of a query block, and of a leaf of each.
DATA_BLOCK, QUERY_BLOCK, DATA_LEAF, QUERY_LEAF = 4096, 1024, 32, 32
#: Bytes that a task holds of a block of data, and of a sheet of queries with their best.
BLOCK_BYTES, SHEET_BYTES = 16 << 20, 16 << 20
#: Vectors of a sheet of data at most; while there are fewer sheets than four for each core, they are smaller.
DATA_SHEET = 65536
#: Points of data that a leaf of queries is multiplied with at a time.
CHUNK = 512
#: Each level of a cover tree covers with this part of the radius above it.
SHRINK = 0.7


@dataclass
class Node:
    centre: int
    radius: float
    points: np.ndarray
    children: list[Node] = field(default_factory=list)


def cover_tree(vectors: np.ndarray, leaf: int) -> Node:
    """A tree whose nodes cover their points within a radius; siblings stand apart.

    The children of a node are a greedy net: the centre itself, then again and
    again a point that no child covers yet. Equal points end in one leaf.
    """
    root = Node(0, 0.0, np.arange(len(vectors)))
    open_nodes = [root]
    while open_nodes:
        node = open_nodes.pop()
        # The factor covers the rounding of the distances.
        node.radius = float(np.sqrt(((vectors[node.points] - vectors[node.centre]) ** 2).sum(1).max())) * (1 + 1e-9)
        if len(node.points) <= leaf or node.radius == 0:
            continue
        reach, left, at = node.radius * SHRINK, node.points, node.centre
        while len(left):
            far = np.sqrt(((vectors[left] - vectors[at]) ** 2).sum(1))
            mine = far <= reach
            node.children.append(Node(int(at), 0.0, left[mine]))
            left, far = left[~mine], far[~mine]
            if len(left):
                at = left[int(far.argmax())]
        open_nodes += node.children
    return root


class Best:
    """The k best (score, id) of each query so far, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def worst(self, queries: np.ndarray) -> float:
        return self.scores[queries, -1].min()

    def add(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        for row in np.flatnonzero((scores >= self.scores[queries, -1:]).any(1)):
            q = queries[row]
            good = np.flatnonzero((scores[row] >= self.scores[q, -1]) & (scores[row] > -np.inf))
            all_scores = np.concatenate([self.scores[q], scores[row, good]])
            all_ids = np.concatenate([self.ids[q], ids[good]])
            order = np.lexsort((all_ids, -all_scores))[:self.k]
            self.scores[q], self.ids[q] = all_scores[order], all_ids[order]


class Flat:
    """The nodes of a cover tree as arrays, so that many bounds are one product."""

    def __init__(self, root: Node, vectors: np.ndarray):
        nodes = [root]
        self.children: list[np.ndarray] = []
        for node in nodes:  # grows while it is walked
            self.children.append(np.arange(len(nodes), len(nodes) + len(node.children)))
            nodes += node.children
        self.points = [node.points for node in nodes]
        self.centres = vectors[[node.centre for node in nodes]]
        self.radius = np.array([node.radius for node in nodes])
        self.norm = np.sqrt((self.centres ** 2).sum(1))

    def bounds(self, nodes: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
        """What no inner product of a point below each node with one within radius of centre exceeds."""
        limit = self.centres[nodes] @ centre + radius * self.norm[nodes] + self.radius[nodes] * (
            np.sqrt(centre @ centre) + radius)
        return limit + 1e-9 * (1 + np.abs(limit))  # more than rounding can take away

    def opened(self, nodes: np.ndarray, wider: float) -> np.ndarray:
        """The nodes, those with a radius of more than ``wider`` replaced by their children."""
        return np.concatenate([
            np.zeros(0, np.int64),
            *[self.children[n] if len(self.children[n]) and self.radius[n] > wider else np.array([n]) for n in nodes]])


def dual_tree(
    queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int,
    asked: Node | None = None, tree: Flat | None = None, best: Best | None = None,
) -> Best:
    """The k best data vectors of each query, its own id left out.

    A query node goes down with the data nodes that are still possible for it.
    Each of its children drops more of them, and a leaf looks at what is left,
    the most promising nodes first and about CHUNK points at a time. The trees may
    be given, and what other data gave.
    """
    best = Best(len(queries), k) if best is None else best
    tree = Flat(cover_tree(data, DATA_LEAF), data) if tree is None else tree

    def possible(q: Node, nodes: np.ndarray) -> np.ndarray:
        limits = tree.bounds(nodes, queries[q.centre], q.radius)
        order = np.argsort(-limits, kind="stable")
        return nodes[order[limits[order] >= best.worst(q.points)]]

    stack = [(cover_tree(queries, QUERY_LEAF) if asked is None else asked, np.array([0]))]
    while stack:
        q, nodes = stack.pop()
        nodes = possible(q, nodes)
        if q.children:
            nodes = possible(q, tree.opened(nodes, q.radius))
            stack += [(child, nodes) for child in reversed(q.children)]
            continue
        while len(nodes):
            sizes = np.cumsum([len(tree.points[n]) for n in nodes])
            take = int(np.searchsorted(sizes, CHUNK)) + 1
            inner = np.array([len(tree.children[n]) > 0 for n in nodes[:take]])
            if inner.any():
                nodes = possible(q, np.concatenate([tree.opened(nodes[:take], -1.0), nodes[take:]]))
                continue
            points = np.concatenate([tree.points[n] for n in nodes[:take]])
            scores = queries[q.points] @ data[points].T
            scores[query_ids[q.points][:, None] == data_ids[points]] = -np.inf
            best.add(q.points, data_ids[points], scores)
            nodes = possible(q, nodes[take:])
    return best


def _large(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int):
    """The same for numbers beyond float64: every product as Python integers."""
    whole = [[int(x) for x in row] for row in data]
    for q, row in zip(query_ids.tolist(), queries):
        own = [int(x) for x in row]
        scored = [(-sum(a * b for a, b in zip(own, other)), i) for other, i in zip(whole, data_ids.tolist()) if i != q]
        for score, i in sorted(scored)[:k]:
            yield q, i, -score


class _Waiting:
    """Rows of one width that came in and wait until they are a block."""

    def __init__(self, size: int):
        self.size, self.rows, self.parts = size, 0, []

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Whole blocks, once there are any."""
        while len(ids):
            room = self.size - self.rows
            self.parts.append((ids[:room], vectors[:room]))
            self.rows += len(ids[:room])
            ids, vectors = ids[room:], vectors[room:]
            if self.rows == self.size:
                yield from self.rest()

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What has not made up a block."""
        if self.rows:
            ids, vectors = zip(*self.parts)
            self.rows, self.parts = 0, []
            yield np.concatenate(ids), np.concatenate(vectors)


@dataclass
class _Held:
    """A block of queries with its best so far; its tree is built when it is first walked."""

    ids: np.ndarray
    vectors: np.ndarray
    best: Best
    tree: Node | None = None


class _Cell:
    """A sheet of queries, which the vectors of a sheet of data pass block by block."""

    def __init__(self, width: int, k: int, data_block: int, query_block: int):
        self.k = k
        self.asked = _Waiting(query_block)
        self.told = _Waiting(max(1, min(data_block, BLOCK_BYTES // (8 * width))))
        self.held: list[_Held] = []

    def take(self, told: bool, ids: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Take in rows, the queries first; found are those whose numbers are too large to be held."""
        if told:
            self._hold(self.asked.rest())
            for block in self.told.add(ids, vectors) if self.held else ():
                yield from self._search(*block)
        else:
            self._hold(self.asked.add(ids, vectors))

    def found(self) -> Iterator[pa.RecordBatch]:
        """The best of each query, once all rows are in."""
        for block in self.told.rest():
            yield from self._search(*block)
        for held in self.held:
            found = held.best.scores > -np.inf
            yield _rows(
                np.repeat(held.ids, found.sum(1)), held.best.ids[found], held.best.scores[found].astype(np.int64))

    def _hold(self, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
        for ids, vectors in blocks:
            self.held.append(_Held(ids, vectors, Best(len(ids), self.k)))

    def _search(self, data_ids: np.ndarray, data: np.ndarray) -> Iterator[pa.RecordBatch]:
        tree = None
        for held in self.held:
            if np.abs(held.vectors).max(initial=0) * np.abs(data).max(initial=0) * data.shape[1] < 2 ** 53:
                tree = tree or Flat(cover_tree(data, DATA_LEAF), data)
                held.tree = held.tree or cover_tree(held.vectors, QUERY_LEAF)
                dual_tree(held.vectors, held.ids, data, data_ids, self.k, held.tree, tree, held.best)
            else:
                yield _rows(*(list(zip(*_large(held.vectors, held.ids, data, data_ids, self.k))) or [(), (), ()]))


def _rows(*columns) -> pa.RecordBatch:
    return pa.record_batch({
        name: pa.array(column, pa.int64()) for name, column in zip(("query_id", "vec_id", "score"), columns)})


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """First row and the one after the last of each run of rows of one cell, width and side."""
    border = np.ones(batch.num_rows + 1, bool)
    border[1:-1] = False
    for name in ("cell", "width", "told"):
        border[1:-1] |= np.diff(batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)) != 0
    at = np.flatnonzero(border)
    return zip(at[:-1].tolist(), at[1:].tolist())


def _searched(k: int, data_block: int, query_block: int):
    """The best of each cell, whose rows come one after the other, by width and its queries first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell = None, None
        for batch in batches:
            for first, last in _runs(batch):
                part = batch.slice(first, last - first)
                at, width, told = (part.column(name)[0].as_py() for name in ("cell", "width", "told"))
                if (at, width) != key:
                    if cell:
                        yield from cell.found()
                    key, cell = (at, width), _Cell(width, k, data_block, query_block)
                vectors = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                yield from cell.take(told, part.column("vec_id").to_numpy(), np.floor(vectors * SCALE))
        if cell:
            yield from cell.found()

    return run


def _sheets(vectors: DataFrame, queries: DataFrame, k: int) -> tuple[int, int]:
    """How many sheets of data there are, and how many of queries."""
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    rows, held = vectors.count(), queries.agg(F.sum(8 * F.col("width") + 16 * k)).first()[0] or 0
    asked = -(-held // SHEET_BYTES) or 1
    enough = min(-(-rows // DATA_BLOCK), -(-4 * cores // asked))
    return max(1, -(-rows // DATA_SHEET), enough), asked


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of each query.

    Both frames hold vec_id and embedding. Vectors that are NULL or hold a NULL, NaN
    or infinite component take no part, nor do empty ones and NULL ids; a query meets vectors of
    its own width only, and none of its own id. Ties go to the smaller vec_id. Of
    rows that repeat a query's id the smallest vector is the query; repeated data
    rows are candidates each. Other columns are ignored; an empty table on either side
    gives no rows. ``vectors`` is to be read from a table, not made by a shuffle.
    """
    def valid(df: DataFrame) -> DataFrame:
        vector = F.col("embedding").cast("array<double>")
        # x - x is 0 for finite numbers alone.
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).filter(
            F.col("vec_id").isNotNull() & F.coalesce(F.forall("vector", lambda x: F.coalesce(x - x == 0, F.lit(False))), F.lit(False))
        ).withColumn("width", F.size("vector").cast("long")).filter("width > 0")

    asked = valid(queries).groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("width", F.size("vector").cast("long"))
    told = valid(vectors)
    across, down = _sheets(told, asked, k)

    def numbers(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    def dealt(number: Column, count: int) -> Column:
        return F.pmod(number, F.lit(count).cast("long"))

    # Each sheet of queries meets each of the data. Rows of the data may repeat, so they
    # are numbered where they are read; queries come out of a shuffle, once each.
    told = told.withColumn("across", dealt(F.monotonically_increasing_id(), across)).withColumn("down", numbers(down))
    asked = asked.withColumn("down", dealt(F.xxhash64("vec_id"), down)).withColumn("across", numbers(across))
    both = asked.withColumn("told", F.lit(False)).unionByName(told.withColumn("told", F.lit(True))).select(
        (F.col("down") * across + F.col("across")).alias("cell"), "width", "told", "vec_id", "vector")
    cells = both.repartitionById(across * down, F.col("cell").cast("int")).sortWithinPartitions("cell", "width", "told")
    found = cells.mapInArrow(_searched(k, DATA_BLOCK, QUERY_BLOCK), "query_id long, vec_id long, score long")
    ranked = keep_top(found, ["query_id"], [F.col("score").desc(), F.col("vec_id").asc()], k, rank_as="rank")
    return ranked.select("query_id", "rank", "vec_id", "score")
